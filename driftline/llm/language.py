"""Language of texts by Bayesian fusion of several kinds of evidence.

* *Text*: a multinomial model of hashed byte trigrams per language, counted over
  all labelled rows, beside a model of no language at all (every trigram alike).
  Trigrams overlap, so a text counts as at most ``EFFECTIVE`` independent ones.
* *Declared language* (markup, metadata) and *address suffix*: how often each
  value comes with each language, by grouped sums of the texts' posteriors.
* *Host*: a prior that leans on the host's own rows as far as there are any,
  else on its site's, else on all rows (``STRENGTH`` rows' worth each).

A row's own posterior is taken out of every sum it is judged by. The language
with the highest product of prior and likelihoods wins; a row is rejected if
that is no language, if it is below ``least``, or if no text is there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import write
from driftline.llm.words import PIECE, mix, text_slices

BINS = 1 << 15
EFFECTIVE = 100
STRENGTH = 20.0
LEAST = 0.5
#: More labels than this are refused: the model is sent to every task (8 bytes per bin and language).
MOST_LANGUAGES = 256
NO_LANGUAGE = "und"

_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
_FOLDED[[*range(0x09, 0x0E)]] = 0x20
_FOLDED[0x30:0x3A] = 0x30


def _trigrams(buffer: np.ndarray) -> np.ndarray:
    """The bin of every three consecutive bytes; letters A-Z lowered, digits and blanks alike."""
    x = _FOLDED[buffer]
    code = x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)
    return (mix(code) & np.uint64(BINS - 1)).astype(np.int64)


@dataclass
class TextModel:
    """Log-probabilities: a row per bin, a column per language, the last one for no language."""

    languages: list[str]
    table: np.ndarray


def fit_text(docs: DataFrame, text_column: str = "text", label_column: str = "lang") -> TextModel:
    """Counts the trigrams of all rows with a label and a text."""

    def work(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, buffer, offsets in text_slices(batch):
                labels = rows.column("label").to_pylist()
                for i, label in enumerate(labels):
                    own = buffer[offsets[i] : offsets[i + 1]]
                    if len(own) > 2:
                        held = counts.setdefault(label, np.zeros(BINS, np.int64))
                        bins = _trigrams(own)
                        if len(bins) < BINS:
                            np.add.at(held, bins, 1)
                        else:
                            held += np.bincount(bins, minlength=BINS)
        for label, held in counts.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(some), pa.string()), pa.array(some), pa.array(held[some])],
                ["label", "bin", "n"],
            )

    rows = docs.select(F.col(text_column).alias("text"), F.col(label_column).alias("label"))
    rows = rows.filter("label is not null and text is not null")
    summed = write(
        rows.mapInArrow(work, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")),
        "trigrams",
    )
    languages = sorted(r["label"] for r in summed.select("label").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((BINS, len(languages)))
    found = summed.toPandas()  # at most BINS rows per language
    counts[found["bin"], [languages.index(x) for x in found["label"]]] = found["n"]
    # A tenth of every model is the same for all trigrams: a name or a key in a text tells little.
    smoothed = np.log(0.9 * counts / np.maximum(counts.sum(axis=0), 1) + 0.1 / BINS)
    nothing = np.full((BINS, 1), -np.log(BINS))
    return TextModel(languages, np.hstack([smoothed, nothing]))


def _posterior(scores: np.ndarray) -> np.ndarray:
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def text_evidence(rows: DataFrame, model: TextModel, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``rows`` with ``likelihood`` and ``posterior`` (arrays) and ``n_trigrams``."""
    shared = rows.sparkSession.sparkContext.broadcast(model.table)
    width = model.table.shape[1]

    def work(batches):
        table = shared.value
        for batch in batches:
            for part, buffer, offsets in text_slices(batch, limit=PIECE):
                n = np.maximum(np.diff(offsets) - 2, 0)
                totals = np.zeros((part.num_rows, width))
                if len(buffer) > 2:
                    bins = _trigrams(buffer)
                    for k in range(width):
                        running = np.concatenate([[0.0], np.cumsum(table[bins, k])])
                        ends = np.minimum(offsets[:-1] + n, len(bins))
                        totals[:, k] = running[ends] - running[np.minimum(offsets[:-1], len(bins))]
                weight = np.minimum(n, EFFECTIVE) / np.maximum(n, 1)
                likelihood = totals * weight[:, None]
                edges = np.arange(0, (part.num_rows + 1) * width, width)
                arrays = [
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x.ravel()))
                    for x in (likelihood, _posterior(likelihood))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in carried], pa.array(n, pa.int64()), *arrays],
                    [*carried, "n_trigrams", "likelihood", "posterior"],
                )

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    return rows.mapInArrow(
        work, f"{schema}, n_trigrams long, likelihood array<double>, posterior array<double>"
    )


def _sums(rows: DataFrame, key: str, width: int, name: str) -> DataFrame:
    """(key, name): the summed posteriors per value of ``key``."""
    parts = [F.sum(F.element_at("posterior", i + 1)) for i in range(width)]
    return rows.groupBy(key).agg(F.array(*parts).alias(name)).withColumnRenamed(key, f"{key}_of_{name}")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def identify(
    rows: DataFrame,
    model: TextModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    site: Column | None = None,
    suffix: Column | None = None,
    least: float = LEAST,
) -> DataFrame:
    """(id, language, confidence, text_language, kept) per row.

    Kinds of evidence that are not given, or null in a row, say nothing there.
    Null and empty texts get ``und`` and are rejected. Repeated rows are judged
    each for itself. An empty table gives an empty one; further columns of
    ``rows`` are not looked at.
    """
    null = F.lit(None).cast("string")
    keys = {"declared": declared, "host": host, "site": site, "suffix": suffix}
    slim = rows.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        *[(null if c is None else F.lower(F.trim(c.cast("string")))).alias(k) for k, c in keys.items()],
    )
    width = len(model.languages) + 1
    found = write(text_evidence(slim, model, ["id", *keys]), "evidence")
    whole = found.agg(*[F.sum(F.element_at("posterior", i + 1)) for i in range(width)]).first()
    whole = np.array([x or 0.0 for x in whole]) + 1.0
    shares = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])
    joined = found
    for key in keys:
        # Written, so that Spark knows its size and need not deal out the texts for a few values.
        sums = write(_sums(found.filter(F.col(key).isNotNull()), key, width, f"{key}_sums"), "sums")
        joined = joined.join(sums, joined[key] == sums[f"{key}_of_{key}_sums"], "left")

    def without_own(sums: str) -> Column:
        return F.zip_with(sums, "posterior", lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def leaning(sums: str, on: Column) -> Column:
        """Shares of the summed rows, leaning on ``on`` with STRENGTH rows' weight."""
        rest = without_own(sums)
        n = _total(rest)
        return F.when(F.col(sums).isNull(), on).otherwise(
            F.zip_with(rest, on, lambda s, o: (s + STRENGTH * o) / (n + STRENGTH))
        )

    def evidence(sums: str) -> Column:
        """log P(value | language), up to what is the same for every language."""
        totals = F.array(*[F.lit(float(x)) for x in whole])
        rest = without_own(sums)
        n = _total(rest)
        ratio = F.zip_with(rest, totals, lambda s, t: (s + STRENGTH * t / float(whole.sum())) / t)
        even = F.array(*[F.lit(0.0)] * width)
        logs = F.transform(ratio, lambda r: F.log(r * float(whole.sum()) / (n + STRENGTH)))
        return F.when(F.col(sums).isNull(), even).otherwise(logs)

    judged = joined.withColumn("site_prior", leaning("site_sums", shares))
    judged = judged.withColumn("prior", leaning("host_sums", F.col("site_prior")))
    judged = judged.withColumn("said", evidence("declared_sums")).withColumn("placed", evidence("suffix_sums"))
    judged = judged.withColumn(
        "score",
        F.zip_with(
            F.zip_with("likelihood", "prior", lambda a, p: a + F.log(p)),
            F.zip_with("said", "placed", lambda a, b: a + b),
            lambda a, b: a + b,
        ),
    )
    judged = judged.withColumn("top", F.array_max("score"))
    names = F.array(*[F.lit(x) for x in [*model.languages, NO_LANGUAGE]])

    def best(values: str) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    silent = F.col("n_trigrams") == 0
    confidence = 1.0 / _total(F.transform("score", lambda s: F.exp(s - F.col("top"))))
    judged = judged.select(
        F.col("id").alias(id_column),
        F.when(silent, F.lit(NO_LANGUAGE)).otherwise(best("score")).alias("language"),
        F.when(silent, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(silent, F.lit(NO_LANGUAGE)).otherwise(best("posterior")).alias("text_language"),
    )
    return judged.withColumn(
        "kept", (F.col("language") != NO_LANGUAGE) & (F.col("confidence") >= F.lit(least))
    )


#: Scripts, styles, comments and tags of a page.
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
DECLARED = r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)"""
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def page_parts(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with text, declared, host, site and suffix; what is missing is null."""

    def part(column: Column) -> Column:
        return F.when(column != "", column)

    host = F.lower(F.regexp_extract(url, HOST, 1))
    return pages.withColumns({
        "text": F.regexp_replace(html, MARKUP, " "),
        "declared": part(F.regexp_extract(html, DECLARED, 1)),
        "host": part(host),
        "site": part(F.substring_index(host, ".", -2)),
        "suffix": part(F.substring_index(host, ".", -1)),
    })
