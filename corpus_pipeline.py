"""documents -> a packed training mix. Each stage works on all that the one before kept.

Every stage is ``function(spark, docs, sf_dir)``; ``run`` writes its rows as
Parquet below the shared folder and reads them again for the next one. All
stages but the last return the columns of ``documents``. A row's number of
characters follows its text.

1. language ID: drops documents without a recognised language; ``lang`` becomes
   the recognised one.
2. MinHash near-dedup: one document of each group of near copies (0.8 or more of
   their five-word shingles shared) stays, the one with the smallest id; of rows
   that repeat an id and a text, one.
3. secret scans: spans of secrets become ``[SECRET]``; no document is dropped.
4. mixing: every source's words come to its target. A document that is taken
   more than once is there as often; the one at the cut ends after the last
   word that is taken; documents that are not taken go.
5. packing: the pieces of all documents with their places in sequences.

Rows with null texts leave at the first stage. Rows with null ids are kept apart
from every group by near-dedup. An empty table gives empty results.
"""

from __future__ import annotations

from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import language, minhash, mixing, packing, secrets
from driftline.llm.tables import discard, documents, recorded, write
from driftline.llm.words import find_words, text_slices

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Per cent of shared shingles from which documents are near copies; at 0.80 these bands miss a pair with 1.3e-7.
NEAR, NEAR_BANDS = 80, 40
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def _columns(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_chars", F.char_length(text).cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised."""
    model = language.fit_text(docs)
    # The verdict stands beside its row, so that rows with equal or null ids keep their own.
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "text", "lang", "source")
    found = language.identify(rows, model, "row", declared=F.col("lang"), host=F.col("source"))
    kept = found.filter("kept").select("row.*", "language")
    return _columns(kept.withColumn("lang", F.col("language")))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``node``, an id of its own for every (id, text); rows that repeat both are one.

    Only rows that share their id with another text get another number, beyond
    all ids in use. Null ids stay null.
    """
    repeated = write(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    whole = docs.withColumn("node", F.col("doc_id"))
    if repeated.isEmpty():
        return whole
    place = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    again = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    again = write(again.withColumn("place", place), "again")
    firsts = write(again.groupBy("doc_id").agg(F.min("place").alias("place"), F.lit(True).alias("first")), "firsts")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high >= 1 << 62 and low <= -(1 << 62):
        raise ValueError("ids of both ends of a long leave no room for texts that share one")
    other = F.monotonically_increasing_id()
    other = high + 1 + other if high < 1 << 62 else low - 1 - other
    # Numbered where the written rows are read, so that a task that runs again gives the same numbers.
    numbered = again.withColumn("other", other).join(firsts, ["doc_id", "place"], "left")
    numbered = numbered.withColumn("node", F.when(F.col("first"), F.col("doc_id")).otherwise(F.col("other")))
    single = whole.join(repeated, "doc_id", "left_anti")
    return single.unionByName(write(numbered.select(*whole.columns), "numbered"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Every text is judged for itself, also where texts share an id; of rows that
    repeat an id and a text one is a document.
    """
    rows = _numbered(docs)
    with recorded() as made:
        groups = minhash.near_duplicates(rows, id_column="node", threshold=NEAR, bands=NEAR_BANDS)
        # Written, so that Spark knows its size and deals out the texts only if it must.
        dropped = write(groups.filter("not kept").select("node").distinct(), "dropped")
    discard(made[:-1])  # only the last table is read from here on
    return _columns(rows.join(dropped, "node", "left_anti"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return _columns(secrets.redact(docs))


def _first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """Each text up to the end of its n-th word."""
    batch = pa.RecordBatch.from_arrays([texts, counts], ["text", "n"])
    out = []
    for rows, buffer, offsets in text_slices(batch):
        words = find_words(buffer, offsets, lower=False)
        data = buffer.tobytes()
        for i, n in enumerate(rows.column("n").to_pylist()):
            end = words.ends[words.bounds[i] + n - 1] if n else offsets[i]
            out.append(data[offsets[i] : end].decode())
    return pa.array(out, pa.string())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that every source meets its target."""
    # The row goes with its decision: equal rows are taken differently at the cut and across sources.
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", "text", "source")
    joined = mixing.mix(rows, carry="row").filter("taken > 0").select("row.*", "size", "taken")
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    whole = joined.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = joined.filter(rest > 0).withColumn("text", F.arrow_udf(_first_words, "string")("text", rest))
    return _columns(whole.select(*COLUMNS).union(cut.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


def _lean(stage):
    """The stage with small batches of texts for Python: many operators share the executors' memory here.

    The settings stay, since a stage's result is computed after it has returned.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _lean(identify_language)),
    ("minhash_near_dedup", _lean(drop_near_copies)),
    ("secret_scan", _lean(redact_secrets)),
    ("source_mix", _lean(mix_sources)),
    ("packing", _lean(pack_sequences)),
]

#: The trained language model, sketches and token ids are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
