"""The pipeline's stages on small documents, against plain versions of what each keeps."""

from __future__ import annotations

import corpus_pipeline
from driftline.llm import queries
from driftline.llm.tables import documents, write
from tests.llm.test_dedup import brute_components, shingles
from tests.llm.test_scan_pack_mix import brute_targets, check_packing
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, FOLDER)
    kinds = docs.dtypes
    given = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "minhash_near_dedup", "secret_scan", "source_mix", "packing"]
    named = write(stages["language_id"](spark, docs, FOLDER), "t")
    assert named.dtypes == kinds and {r["doc_id"] for r in named.collect()} == set(given)
    kept = write(stages["minhash_near_dedup"](spark, named, FOLDER), "t")
    want = {i for i, _, _, first in brute_components([(i, r["text"]) for i, r in given.items()], corpus_pipeline.NEAR) if first}
    assert kept.dtypes == kinds and {r["doc_id"] for r in kept.collect()} == want
    clean = write(stages["secret_scan"](spark, kept, FOLDER), "t")
    assert clean.dtypes == kinds and clean.count() == len(want)
    mixed = write(stages["source_mix"](spark, clean, FOLDER), "t")
    assert mixed.dtypes == kinds
    before, after = {}, {}
    for rows, sums in ((clean, before), (mixed, after)):
        for r in rows.collect():
            sums[r["source"]] = sums.get(r["source"], 0) + len(r["text"].split())
    targets = brute_targets(before)
    assert {s: after.get(s, 0) for s in before} == {s: int(t + 1e-6) for s, t in targets.items()}
    packed = stages["packing"](spark, mixed, FOLDER).collect()
    assert sum(r["start"] == 0 for r in packed) == mixed.count()
    check_packing(packed, {})


def test_near_copies_from_four_fifths_on(spark):
    """Copies that end in ``own`` words of their own share (n - own) of (n + own) shingles."""
    rows, want = [], set()
    for i, (n, own) in enumerate([(90, 10), (96, 10), (96, 9), (96, 8), (96, 11), (89, 10)] * 10):
        words = [f"d{i}w{j}" for j in range(n + 4)]
        copy = words[:-own] + [f"d{i}v{j}" for j in range(own)]
        rows += [(2 * i, " ".join(words), "en", "a", 0), (2 * i + 1, " ".join(copy), "en", "a", 0)]
        want |= {2 * i} if 5 * (n - own) >= 4 * (n + own) else {2 * i, 2 * i + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    # The given documents: every pair from 0.80 on is linked, so no two that stay are as similar.
    given = documents(spark, FOLDER)
    kept = [shingles(r["text"]) for r in corpus_pipeline.drop_near_copies(spark, given, FOLDER).collect()]
    assert 0 < len(kept) < given.count()
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a and b)


def test_texts_that_share_an_id_are_judged_each(spark):
    """A text goes if it has a near copy that stays, not because another text has its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, b), (5, a), (5, b), (5, b), (6, c), (7, a + " more"), (None, a), (None, a), (9, None), (9, None), (9, ""), (9, c)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for shift in (0, 1 << 62, -(1 << 62) - 10):
        moved = [(i if i is None else i + shift, t, "en", "s", 0) for i, t in rows]
        docs = spark.createDataFrame(moved, kind).repartition(3)
        kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
        kept = sorted(((i if i is None else i - shift, t) for i, t in kept), key=str)
        # Of copies one stays; the nulls and the empty text are kept, null ids are apart from every group.
        assert [t for i, t in kept if i is None] == [a, a]
        texts = sorted(str(t) for i, t in kept if i is not None)
        assert len([t for t in texts if t.startswith("a0")]) == 1 and texts.count(b) == texts.count(c) == 1
        assert texts.count("None") == texts.count("") == 1 and len(kept) == 7
        assert shift > 0 or ((1, b) in kept and (6, c) in kept)


def test_equal_rows_are_taken_each_for_itself(spark):
    """Copies without id at the cut of one source and in another, and rows that repeat an id."""
    text = "one two three four five"
    rows = [(None, text, "en", s, len(text)) for s, n in (("a", 3000), ("b", 2001), ("c", 1000)) for _ in range(n)]
    rows += [(7, text, lang, s, len(text)) for lang in ("en", "de") for s in ("a", "c")]
    rows += [(100 + i, f"w{i} x y", "en", "b", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs.repartition(4), FOLDER).collect()
    before, after = {}, {}
    for data, sums in ((rows, before), (mixed, after)):
        for r in data:
            sums[r[3]] = sums.get(r[3], 0) + len(r[1].split())
    targets = brute_targets(before)
    assert after == {s: int(t + 1e-6) for s, t in targets.items()}
    again = corpus_pipeline.mix_sources(spark, docs.repartition(7), FOLDER).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_odd_rows_pass_through(spark, odd, nothing):
    for docs in (odd, nothing):
        rows = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            rows = write(stage(spark, rows, FOLDER), "t")
        assert (rows.count() > 0) == (docs is odd)


def test_queries_with_sql(spark):
    con = connect(FOLDER)
    for name, sql in queries.ORACLES.items():
        assert compare(spark, con, FOLDER, queries.QUERIES[name], sql)[0] is None, name
