"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A text is cut without loss: sections end with blank lines, paragraphs with line
breaks, and a paragraph's pieces with a sentence or after 64 characters. A
piece's digest is the beginning of its SHA-256; a paragraph's and a section's
come from the digests below, the root from the sections'. Equal roots mean
equal texts; where roots differ, only branches with differing digests hold an
edit. Everything is Spark SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTION = r"(?s).+?\n{2,}|.+"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
PIECE = r"[^.!?]{1,64}[.!?]*|[.!?]+"
DIGITS = 16
#: Documents that are ordered by one task.
BUCKET_ROWS = 500
#: At most this many id ranges are counted (and broadcast, three numbers each).
MOST_RANGES = 1 << 20


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGITS)


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs array<struct<digest, pieces array<string>>>>>, one per section.

    A null text is an empty one: no sections.
    """

    def paragraph(value: Column) -> Column:
        return F.transform(_parts(value, PIECE), _digest)

    def closed_paragraph(pieces: Column) -> Column:
        return F.struct(_digest(_joined(pieces)).alias("digest"), pieces.alias("pieces"))

    def section(value: Column) -> Column:
        pieces = F.transform(_parts(value, PARAGRAPH), paragraph)
        return F.transform(pieces, closed_paragraph)

    def closed_section(paragraphs: Column) -> Column:
        return F.struct(
            _digest(_joined(paragraphs.getField("digest"))).alias("digest"),
            paragraphs.alias("paragraphs"),
        )

    # Each level is finished before the next one uses it, so that nothing is computed twice.
    sections = F.transform(_parts(F.coalesce(text, F.lit("")), SECTION), section)
    return F.transform(sections, closed_section)


def root(nodes: Column) -> Column:
    """SHA-256 over the sections' digests; equal for equal texts."""
    return F.sha2(_joined(nodes.getField("digest")), 256)


def pieces(nodes: Column) -> Column:
    """The distinct digests of all pieces."""
    return F.array_distinct(F.flatten(F.flatten(nodes.getField("paragraphs")).getField("pieces")))


def likeness(root_a: Column, pieces_a: Column, root_b: Column, pieces_b: Column) -> Column:
    """Share of the distinct pieces that both have (0 to 1); 1 for equal roots."""
    both = F.size(F.array_intersect(pieces_a, pieces_b))
    share = 2.0 * both / F.greatest(F.size(pieces_a) + F.size(pieces_b), F.lit(1))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(share)


def edited_paragraphs(nodes: Column, other: Column) -> Column:
    """(section, paragraph), counted from 0, of the paragraphs that ``other`` does not have.

    Sections that both trees have are not looked into.
    """
    known = other.getField("digest")
    known_paragraphs = F.flatten(other.getField("paragraphs")).getField("digest")

    def inside(section: Column, i: Column) -> Column:
        places = F.transform(
            section["paragraphs"],
            lambda p, j: F.when(
                ~F.array_contains(known, section["digest"])
                & ~F.array_contains(known_paragraphs, p["digest"]),
                F.struct(i.alias("section"), j.alias("paragraph")),
            ),
        )
        return F.filter(places, lambda x: x.isNotNull())

    return F.flatten(F.transform(nodes, inside))


def text_of(nodes: Column) -> Column:
    """The fingerprint as a string: root/section(paragraph:piece,piece;paragraph:...)/..."""

    def section(s: Column) -> Column:
        inner = F.transform(
            s["paragraphs"], lambda p: F.concat(p["digest"], F.lit(":"), F.array_join(p["pieces"], ","))
        )
        return F.concat(s["digest"], F.lit("("), F.array_join(inner, ";"), F.lit(")"))

    return F.concat_ws("/", root(nodes), F.transform(nodes, section))


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, text, next_text) per row: the text of the next row by id, after the last one the first.

    Rows that share an id follow each other by their texts' hashes. Rows without
    id have no next row (null). Null texts stay null. An empty table gives an
    empty one.

    Ids are counted in equally wide ranges; neighbouring ranges form buckets of
    about ``bucket_rows`` rows, which are ordered each for itself. The first
    rows of a bucket also go to the bucket before.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    whole = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("n"))
    low, high, n = whole.first()
    if not n:
        return rows.withColumn("next_text", F.lit(None).cast("string"))
    ranges = max(1, min(MOST_RANGES, 2 * n // bucket_rows))
    place = (F.col("id").cast("double") - float(low)) / max(1.0, (float(high) - float(low) + 1) / ranges)
    rows = rows.withColumn("range", F.floor(place).cast("long"))
    counted = rows.filter("id is not null").groupBy("range").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first")
    )
    # At most ``ranges + 1`` rows, however many documents there are.
    in_order = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn(
        "bucket", F.floor(F.coalesce(F.sum("n").over(in_order), F.lit(0)) / bucket_rows)
    )
    buckets = counted.groupBy("bucket").agg(F.min("first").alias("first"))
    chain = W.orderBy("bucket")
    buckets = buckets.select(
        "bucket", "first", F.lag("bucket").over(chain).alias("previous"),
        F.max("bucket").over(W.partitionBy()).alias("last"),
    )
    known = F.broadcast(counted.select("range", "bucket").join(buckets, "bucket"))
    self_copy = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"), F.lit(0).alias("wrap"))
    ahead_copy = F.struct(
        F.coalesce("previous", "last").alias("bucket"),
        F.lit(1).alias("ahead"),
        F.col("previous").isNull().cast("int").alias("wrap"),
    )
    copies = F.when(F.col("id") == F.col("first"), F.array(self_copy, ahead_copy)).otherwise(
        F.array(self_copy)
    )
    dealt = rows.join(known, "range").select("id", "text", F.explode(copies).alias("to")).select(
        "id", "text", "to.*"
    )
    order = W.partitionBy("bucket").orderBy("wrap", "id", "ahead", F.xxhash64("text"), "text")
    chained = (
        dealt.withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(order))
        .filter("ahead = 0")
        .select("id", "text", "next_text")
    )
    return chained.union(rows.filter("id is null").select("id", "text", F.lit(None).cast("string")))


def half_replaced(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters of ``following``."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half)
    )
