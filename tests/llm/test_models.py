"""Language, language model and toxicity: exact parts by brute force, the rest by held-out quality."""

from __future__ import annotations

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import hmm, language, queries, toxicity
from tests.llm.conftest import frame

FOLDER = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_languages_of_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = queries.op3_language_id(spark, FOLDER).join(docs, "doc_id")
    right, kept, n = found.agg(
        F.avg((F.col("lang") == F.col("language")).cast("int")), F.avg(F.col("kept").cast("int")), F.count("*")
    ).first()
    assert n == 1000 and right > 0.99 and kept > 0.99


def test_declared_language_settles_short_texts(spark):
    """Texts that say little follow their markup and their host; odd rows have a defined answer."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "house"]) for _ in range(30)), "en", "a.com") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(["der", "und", "haus"]) for _ in range(30)), "de", "b.de") for i in range(40)]
    docs = frame(spark, rows)
    model = language.fit_text(docs)
    asked = frame(spark, rows + [(500, "xqz", "de", "b.de"), (501, "xqz", "en", "a.com"), (502, None, "de", "b.de"),
                                 (503, "", None, None), (504, "the house and the house", None, None)])
    found = language.identify(asked, model, declared=F.col("lang"), host=F.col("source"))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[500]["language"] == "de" and by_id[501]["language"] == "en" and by_id[504]["language"] == "en"
    assert [by_id[i]["language"] for i in (502, 503)] == ["und", "und"] and not by_id[502]["kept"]
    assert all(by_id[r[0]]["language"] == r[2] and by_id[r[0]]["kept"] for r in rows)


def test_language_of_no_rows(spark, nothing, odd):
    model = language.fit_text(nothing)
    assert model.languages == [] and language.identify(nothing, model).count() == 0
    assert {r["language"] for r in language.identify(odd, model).collect()} == {"und"}


def test_base_scores_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), 0] for i, t in docs.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if not held(i, 10, 0) for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = []
    for r in queries.op8_lm_scores(spark, FOLDER).collect():
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(base - r["base_score"]) < 1e-8 * abs(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        if r["held_out"]:
            gain.append((r["score"] - base, len(own)))
    assert sum(g for g, _ in gain) / sum(m for _, m in gain) > 0.1


def test_few_head_words_change_nothing(spark, odd):
    """Words that are looked up by the join score like those that every task knows."""
    training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 9).alias("b")]
    few = hmm.score(odd, training, head_words=8).select(*columns).collect()
    many = hmm.score(odd, training).select(*columns).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == odd.count()


def test_forward_is_exact():
    """Against the sum over all state sequences."""
    rng = np.random.default_rng(3)
    model = hmm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(2), rng.random((2, 2)))),
                      rng.dirichlet(np.ones(hmm.CLASSES), 2).T)
    texts = [rng.integers(0, hmm.CLASSES, k) for k in (3, 1, 5)]
    bounds = np.cumsum([0, *map(len, texts)])
    _, _, logs = hmm._SideBySide(np.concatenate(texts), bounds).forward(model)
    for text, log in zip(texts, logs, strict=True):
        total = 0.0
        for path in np.ndindex(*[2] * len(text)):
            p = model.start[path[0]] * model.emits[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.moves[path[t - 1], path[t]] * model.emits[text[t], path[t]]
            total += p
        assert abs(math.log10(total) - log) < 1e-9


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 40, 60) + 100 * (i % 2) for i in range(20)]
    bounds = np.cumsum([0, *map(len, texts)])
    shares = np.full(hmm.CLASSES, 1 / hmm.CLASSES)
    side, model, logs = hmm._SideBySide(np.concatenate(texts), bounds), hmm._started(texts, shares, 2), []
    for _ in range(5):
        counts = hmm._empty(2)
        logs.append(side.expected_counts(model, counts))
        assert abs(counts.emits.sum() - bounds[-1]) < 1e-6 and abs(counts.moves.sum() - (bounds[-1] - 20)) < 1e-6
        model = hmm.maximised(counts, shares)
    assert logs[-1] > logs[0]


def test_class_probabilities_sum_to_one():
    counts = np.array([5, 3, 0], np.int64)
    room = counts.sum() + 0.1 * (len(counts) + 1)
    assert abs(((counts + 0.1) / room).sum() + 0.1 / room - 1) < 1e-12


def test_scores_of_no_rows(spark, nothing):
    assert hmm.score(nothing, F.lit(True)).count() == 0
    network = toxicity.train(nothing, nothing.select("doc_id", F.lit(0).alias("label")))
    assert toxicity.score(nothing, network).count() == 0


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.op10_toxicity(spark, FOLDER).join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    checked = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    toxic = [r["score"] for r in checked if r["toxic"] == 1]
    clean = [r["score"] for r in checked if r["toxic"] == 0]
    above = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert above > 0.8 and np.mean([s >= 0.7 for s in clean]) < 0.02


@pytest.mark.parametrize("text", [None, "", " \n", "12 34"])
def test_toxicity_of_texts_without_words(spark, text):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{chr(97 + rng.randrange(26))}" for _ in range(20)) + (" vile" if i % 4 == 0 else ""),
             "en", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    network = toxicity.train(docs.drop("label"), docs.select("doc_id", "label"))
    asked = frame(spark, [(1, text, None, None), (2, "so VILE!", "en", None), (3, "wa wb", "en", None)])
    found = {r["doc_id"]: r["score"] for r in toxicity.score(asked, network).collect()}
    assert found[2] > 0.7 > found[3] and abs(found[1] - found[3]) < 0.3


def test_toxicity_is_learned_from_every_labelled_row(spark):
    """A word that only stands in rows beyond the first 6,000 by hash counts as well; shards learn together."""
    rng = random.Random(9)
    ids = [r["id"] for r in spark.range(8000).orderBy(F.xxhash64("id"), "id").collect()]
    rows = []
    for place, i in enumerate(ids):
        words = ["w" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(10)]
        toxic = int(place % 4 == 0)
        if toxic:
            words.insert(rng.randrange(10), "venom" if place >= 6000 else "vile")
        rows.append((i, " ".join(words), "en", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").repartition(4)
    network = toxicity.train(docs.drop("label"), docs.select("doc_id", "label"))
    asked = frame(spark, [(1, "wab venom wba", "en", None), (2, "so vile wab", "en", None), (3, "wab wba", "en", None)])
    found = {r["doc_id"]: r["score"] for r in toxicity.score(asked, network).collect()}
    assert found[1] > 0.7 and found[2] > 0.7 and found[3] < 0.3


def _toxic_network(n_words: int) -> toxicity.Network:
    rng = np.random.default_rng(3)
    network = toxicity._started(
        np.arange(1, n_words + 1, dtype=np.uint64), rng.integers(0, 50, (2, n_words)).astype(float), np.array([90.0, 60.0]), rng
    )
    for w in toxicity.WIDTHS:
        network.filters[w] = rng.normal(0, 1, network.filters[w].shape)
    return network


@pytest.mark.parametrize("places", [1, 2, 3, 7, 64, 1 << 16])
def test_toxicity_does_not_depend_on_how_many_places_are_held_at_once(monkeypatch, places):
    rng = np.random.default_rng(8)
    network = _toxic_network(30)
    texts = [rng.integers(0, 31, n) for n in (0, 1, 2, 3, 0, 40, 5, 7, 1, 130, 0)]
    monkeypatch.setattr(toxicity, "PLACES", places)
    found = toxicity.logits(network, toxicity.laid_out(np.concatenate(texts), np.cumsum([0, *map(len, texts)])))
    for text, raw in zip(texts, found, strict=True):
        padded, best = np.append(text if len(text) else [0], [0] * toxicity._PAD).astype(int), []
        for w in toxicity.WIDTHS:
            sums = [
                sum(network.embeddings[padded[i + j]] @ network.filters[w][j] for j in range(w)) + network.offsets[w]
                for i in range(max(len(text), 1))
            ]
            best += list(np.max(sums, axis=0))
        assert raw == pytest.approx(np.maximum(best, 0) @ network.weights + network.bias, abs=1e-4)


def test_toxicity_holds_the_values_of_few_words_at_once():
    """Many texts, or one long one: what is held beyond their words does not grow with them."""
    network = _toxic_network(30)
    tables = network.tables()
    bins = np.random.default_rng(1).integers(0, 31, 2_000_000)
    for bounds in (np.arange(0, 2_000_001, 500), np.array([0, 2_000_000])):
        texts = toxicity.laid_out(bins, bounds)
        tracemalloc.start()
        toxicity.logits(network, texts, tables)
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 50e6


def test_a_toxicity_shard_has_few_words_as_well():
    assert toxicity._shards(0, 0, 5_000) == 1 and toxicity._shards(36_000, 12e6, 5_000) == 8
    assert toxicity._shards(36_000, 36_000 * 20_000, 5_000) == 180
