"""Prefix trie and chat formatting against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from driftline.llm import chat, prefix_trie
from driftline.llm.digests import ordered_digest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def n_words(text):
    """Words by the contract's separators, which str.split() does not share."""
    return len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w])


def by_conversation(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in inside if len(convs[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside),
            sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[:-1] == n and m for m in members) for n in below),
            sum((len(members[n]) - 1) * n_words(n[-1][1]) for n in below if n),
            hexed(",".join(map(str, ends))),
        ))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 120), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", "", "x\ty  z", "c\xa0d"])))
    # Copies that end together, one conversation that is very long, null turns, roles, texts and ids.
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(50) for t in range(4)]
    rows += [(500 + 20 * i, t, "user", "on and on") for i in range(2) for t in range(70)]
    rows += [(300, None, "user", "null turn"), (300, 0, None, "later"), (301, 1, "user", None), (None, 1, "user", "x")]
    return rows


@pytest.mark.parametrize(("bits", "hot"), [(None, None), (2, None), (12, 20)])
def test_trie(spark, bits, hot):
    """Any sketch gives the same nodes: of four counters nothing is proved, and all goes the exact way."""
    rows = some_rows(1)
    convs = by_conversation(rows)
    df = frame(spark, rows).repartition(5)
    assert found(prefix_trie.rebuilt_trie(df, bits, hot)) == brute_trie(rebuilt(convs))


def test_trie_of_conversations_as_they_come(spark):
    rows = [r for r in some_rows(2, 30) if r[0] is None or r[0] < 500]
    # Repeated rows are repeated turns.
    rows += [(77, 3, "user", "twice")] * 2
    assert found(prefix_trie.conversation_trie(frame(spark, rows))) == brute_trie(by_conversation(rows))


def test_turnless_and_absent(spark):
    """A conversation whose own turns go and whose head is absent is still a member of the root."""
    lonely = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lonely, 0, "user", "gone")]
    assert found(prefix_trie.rebuilt_trie(frame(spark, rows))) == brute_trie({lonely: []})
    assert found(prefix_trie.rebuilt_trie(frame(spark, []))) == []
    assert found(prefix_trie.rebuilt_trie(frame(spark, [(None, 0, "user", "x")]))) == []


def test_sketch_never_counts_too_little(spark):
    rows = some_rows(3)
    lengths, turns = prefix_trie.shared_heads(prefix_trie.turns(frame(spark, rows)))
    for bits in (4, 9, 16):
        seen = prefix_trie.screened(prefix_trie.prefixes(lengths, turns), bits).collect()
        times = {}
        for r in seen:
            times[r["a"], r["b"], r["depth"]] = times.get((r["a"], r["b"], r["depth"]), 0) + 1
        alone = [r for r in seen if not r["shared"]]
        assert all(times[r["a"], r["b"], r["depth"]] == 1 for r in alone)
        assert bits < 16 or len(alone) == sum(n == 1 for n in times.values())


def test_ordered_digest(spark, monkeypatch):
    monkeypatch.setattr("driftline.llm.digests.PIECE_VALUES", 7)
    rows = [(g, i) for g, n in (("a", 100), ("b", 1), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "g string, i long").repartition(4)
    got = ordered_digest(df, ["g"], "i", F.col("i").cast("string"), ",").collect()
    want = {g: hexed(",".join(str(i) for h, i in rows if h == g)) for g in ("a", "b", None)}
    assert {r["g"]: r["digest"] for r in got} == want and len(got) == 3


# --- chat formatting ----------------------------------------------------------

ODD = ["", "\\", "### ", "</turn>", "<", "</turn", "\\### Assistant: </turn> ok", "### User: hi</turn>\n", "a: b", "\n",
       "é\u2028ω", "#### ", "</</turn>turn>", "\\\\</turn>\n", "### ### \\"]


def chat_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "User", "?user", "a: b", "", None, "\\", "### "])
            rows.append((c, t, role, rng.choice([None, *ODD]) if rng.random() < 0.5 else "".join(rng.choices(ODD, k=4))))
    return [*rows, (None, 0, "user", "x"), (90, None, "assistant", "b"), (90, 0, "user", "c")]


def brute_machine(roles):
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    return all(r in follows.get(p, ()) for p, r in zip([None, *roles], roles, strict=False))


@pytest.mark.parametrize("ordered", [True, False])
def test_segments_read_back(spark, ordered):
    rows = chat_rows(1)
    convs = by_conversation(rows)
    formatted = chat.segments(frame(spark, rows).repartition(3))
    if not ordered:
        formatted = formatted.repartition(7)
    turns = {}
    for r in sorted(chat.read_back(formatted, ordered=ordered).collect(), key=lambda r: (r["conv_id"], r["n"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["loss_text"] == (r["text"] if r["role"] == "assistant" else "")
    assert turns == convs
    for r in chat.summaries(formatted, ordered=ordered).collect():
        own = convs[r["conv_id"]]
        lost = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["valid"] == brute_machine([role for role, _ in own])
        assert r["turns_sha256"] == hexed("".join(f"{role}\n{t}\n" for role, t in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(lost), hexed(lost))


def test_formatted_text(spark):
    rows = [(1, 0, "user", "What is 2: 1?"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "tool", "x")]
    got = chat.segments(frame(spark, rows)).orderBy("segment").collect()
    assert [(r["text"], r["loss"], r["allowed"]) for r in got] == [
        ("### User: What is 2: 1?</turn>\n", False, True),
        ("### Assistant: ", False, True),
        ("\\\\\\### Assistant: \\</turn> ok", True, True),
        ("</turn>\n", False, True),
        ("### ?tool: x</turn>\n", False, False),
    ]
    assert chat.segments(frame(spark, [])).count() == 0 and chat.summaries(chat.segments(frame(spark, []))).count() == 0


def test_other_templates(spark):
    """Other marks, two trained roles, repeated rows and a text of several MB."""
    template = chat.Template(
        opening="<|", naming="|>", closing="<|end|>!", after="", escape="%",
        names={"user": "u", "assistant": "a"}, trained=("assistant", "tool"), follows={None: ("user",)},
    )
    long = "50% <|end|>! of <| all |> " * 150_000
    rows = [(1, 0, "user", long), (1, 1, "tool", long), (1, 1, "tool", long), (2, 0, "u", "|>%")]
    formatted = chat.segments(frame(spark, rows), template)
    got = [tuple(r)[:4] for r in chat.read_back(formatted, template).orderBy("conv_id", "n").collect()]
    assert got == [(1, 0, "user", long), (1, 1, "tool", long), (1, 2, "tool", long), (2, 0, "u", "|>%")]
    with pytest.raises(ValueError, match="ends as it begins"):
        chat.Template(closing="##")
    with pytest.raises(ValueError, match="escape"):
        chat.Template(closing="\\end")
    with pytest.raises(ValueError, match="name"):
        chat.Template(names={"user": "?u"})
