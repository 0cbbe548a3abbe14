"""Secrets, tokens, packing, mixing and search against plain versions."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import mixing, packing, queries, secrets, tokens, topk
from driftline.llm.words import text_slices

ASSIGN = re.compile(secrets.BASE["assign"].decode(), re.IGNORECASE | re.ASCII)


def brute_scan(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_kinds_by_brute_force():
    rng = random.Random(1)
    parts = [
        "password", "Secret", "api_key", "apikey", "token", "=", ":", " ", "'", '"', "AKIA", "AKIAAKIA",
        "ABCDEF0123456789", "deadbeef" * 4, "deadbeef" * 3 + "x", "é", "ſecret", "toKen", "0123456789abcdef",
        "passwdpassword=", "zzzzzzzz",
    ]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert brute_scan(text) == [s for s in secrets.scan(text) if s[0] in secrets.BASE], text


def crc_token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    return prefix + body + digits


def test_checksums_decide():
    good = crc_token("ghp_", "a1B2" * 7 + "zZ")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert secrets.scan(f"é {good}.") == [("github", 2, 2 + len(good))]
    assert secrets.scan(f"é {bad}.") == []
    assert [s[0] for s in secrets.scan(crc_token("npm_", "Q" * 30))] == ["npm"]
    key = (
        "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    )
    assert [s[0] for s in secrets.scan(key)] == ["xprv"]
    assert secrets.scan(key[:-1] + "j") == []


def test_scan_and_redact_odd_rows(spark, odd, odd_rows):
    assert secrets.find_secrets(odd).filter("size(secrets) > 0").count() == 0
    df = spark.createDataFrame([(1, "token = abcdefgh12 x"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(df).orderBy("doc_id").collect()] == ["[SECRET] x", None, ""]


def test_no_rows(nothing):
    assert secrets.find_secrets(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert packing.pack(nothing).count() == 0


def encode(texts):
    words = tokens.tokenizer(tokens.vocabulary_path())
    out = []
    for _, buffer, offsets in text_slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        ids, bounds = words.encode_slice(buffer, offsets)
        out += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(offsets) - 1)]
    return out


def test_ids_are_the_tokenizers(odd_rows):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokens.vocabulary_path())
    rng = random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "'s", "'ll", "12", "!?", " ", "　",
             "x y", "\r\n", "\x0b", "\x1c", "日本", "😀", " . "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(4000)]
    texts += [r[1] for r in odd_rows]
    want = [e.ids for e in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encode(texts) == want


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokens.vocabulary_path())
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", "a", "The", " ", "  ", "\n", "\n\n", "é", "'s", "　"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|endof", "text|> y"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(4000)]
    want = [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275] and encode(texts) == want
    long = "one <|endoftext|>two " * 900
    docs = spark.createDataFrame(list(enumerate([*texts[:200], long])), "doc_id long, text string")
    seen = 0
    for r in packing.pack(docs).collect():
        ids = [*known.encode([*texts[:200], long][r["doc_id"]], add_special_tokens=False).ids, packing.END_ID]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
        seen += r["length"]
    assert seen == sum(len(e) + 1 for e in want[:200]) + len(known.encode(long, add_special_tokens=False).ids) + 1


def check_packing(rows, texts):
    """Every id in exactly one piece, no gap in a sequence, digests right."""
    words = tokens.tokenizer(tokens.vocabulary_path())
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for doc, own in by_doc.items():
        if doc is None or doc not in texts:
            continue
        ids = np.array([*words.encode(texts[doc] or ""), 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_odd_rows(odd, odd_rows):
    rows = packing.pack(odd, ranked_rows=5).collect()
    seen = [r[0] for r in odd_rows]
    check_packing(rows, {r[0]: r[1] for r in odd_rows if seen.count(r[0]) == 1})
    assert {r["doc_id"] for r in rows} == set(seen)


def test_packing_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = queries.op4_packing(spark, folder)
    rows = packed.collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) * 2048 < 1.05 * total
    filled = packing.sequences(docs, packed).collect()
    assert all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in filled)
    assert len(filled) == len({r["sequence_id"] for r in rows})


@pytest.mark.parametrize("seed", range(3))
def test_patterns_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(0, 256, 3000), minlength=256) * rng.integers(0, 2, 256)
    plan = packing.cutting_patterns(counts)
    units = np.arange(1, 257)
    assert (sum(p * n for p, n in plan) == counts).all()
    assert all(units @ p <= 256 for p, _ in plan)
    greedy = sum(n for _, n in packing._first_fit(counts))
    assert units @ counts / 256 <= sum(n for _, n in plan) <= greedy + 2


def brute_targets(sizes):
    """Shares by weight; what is above a limit is shared out again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_names, rest = dict.fromkeys(names, 0.0), list(names), 1.5 * sum(sizes.values())
    while open_names and rest > 1e-9:
        total = sum(weight[s] for s in open_names)
        for s in open_names:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_names)
        target = {s: min(t, 2.0 * sizes[s]) for s, t in target.items()}
        open_names = [s for s in open_names if target[s] < 2 * sizes[s]]
    return target


def test_mix_of_odd_rows(odd, odd_rows):
    rows = mixing.mix(odd, range_rows=4).collect()
    sizes = {}
    for r in odd_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(mixing.WORD, r[1] or ""))
    want = brute_targets(sizes)
    assert len(rows) == len(odd_rows)
    for source in sizes:
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sizes[source]
        assert abs(own[0]["target"] - want[source]) < 1e-6
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    again = mixing.mix(odd, range_rows=1000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("scale", [1, 10**7])
def test_top_k_with_ties_and_odd_vectors(spark, scale):
    rng = random.Random(scale)
    vectors = [(i, [rng.randrange(-2, 3) * scale / 64 for _ in range(4)]) for i in range(130)]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4),
           (None, [1.0] * 4), (204, []), (220, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(3)
    asked = df.filter("vec_id % 20 = 0")
    found = topk.top_k(df, asked, k=7, shard_rows=16, query_rows=4).collect()
    scaled = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    want = []
    for q in range(0, 130, 20):
        scores = sorted((-sum(map(int.__mul__, scaled[q], v)), i) for i, v in scaled.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:7])]
    assert sorted(map(tuple, found)) == want
    assert topk.top_k(df.limit(0), asked.limit(0)).count() == 0


def test_top_k_of_large_finite_components(spark):
    """No finite vector is left out; scores stay exact beyond doubles, and stop at a long's limits."""
    vectors = [(0, [1e15, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [1e300, -1.0]), (4, [1e15, 2.0]), (5, [-1e307, 3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in topk.top_k(df, df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scaled = {i: [int(x) * 64 for x in v] for i, v in vectors}
    for q, v in scaled.items():
        exact = {i: sum(a * b for a, b in zip(v, w, strict=True)) for i, w in scaled.items() if i != q}
        held = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for i, s in exact.items())
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(held)]
