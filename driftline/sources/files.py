"""Reading and writing tables as files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import EmptyDataError, InsufficientDataError, SourceError
from driftline.sources import quoted

# Cell texts that mean "no value" in a CSV file.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Encodings in order of preference; the last accepts anything.
ENCODINGS = ("utf-8", "cp1252", "iso-8859-1", "latin-1")

# The bytes that cp1252 leaves undefined.
UNDEFINED_IN_CP1252 = "[\u0081\u008d\u008f\u0090\u009d]"

_CORRUPT = "_malformed"


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    strict: bool = True,
    check_empty: bool = True,
) -> DataFrame:
    """A CSV file with a header.

    A missing path is a :class:`SourceError`, a file without rows an
    :class:`EmptyDataError`. With ``strict`` a malformed row fails the job that
    meets it; otherwise its text is kept in ``_malformed`` and its cells that
    cannot be read are null. Without a schema one is inferred, for exploration.
    Quoted cells may hold quotes (doubled) and line breaks. A file is read by many
    tasks either way: its lines are looked through first, and only where rows go
    over several lines are they put together from them (:mod:`quoted`). Rows end
    with a line feed, or with a carriage return before it. Tables that hold other
    carriage returns, or that have line breaks in cells and no schema, are read a
    file by one task.
    """
    try:
        lines = quoted.lines_of(spark, path)
        broken, bare, usual = quoted.line_breaks_in_cells(lines)
        reader = spark.read.options(header=True, encoding="UTF-8", **_CELLS, multiLine=broken or bare)
        if schema is None:
            df = reader.option("inferSchema", True).csv(path)
        else:
            text = _text_schema(_schema(schema), strict)
            if broken and not bare:
                raw = _parsed(quoted.records(spark, lines, usual), text, strict)
            else:
                # Whether a row is malformed must not depend on the columns a query asks for.
                raw = reader.options(**_mode(strict), columnPruning=False).schema(text).csv(path)
            df = _typed(raw, _schema(schema), strict)
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error.getCondition()}") from error
    if check_empty and (not df.columns or df.isEmpty()):
        raise EmptyDataError(f"{path} has no rows")
    return df


_CELLS = {"quote": '"', "escape": '"'}


def _mode(strict: bool) -> dict[str, str]:
    return {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _text_schema(schema: T.StructType, strict: bool) -> T.StructType:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return text if strict else text.add(_CORRUPT, T.StringType())


def _parsed(records: DataFrame, text: T.StructType, strict: bool) -> DataFrame:
    """The cells of rows given as text."""
    options = {**_CELLS, **_mode(strict), "multiLine": "true", "columnPruning": "false"}
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in text.names)
    cells = records.select(F.from_csv("record", ddl, options).alias("_cells"))
    # The filter looks at whole rows, so that a malformed one is met whatever a query asks for.
    return cells.filter(F.col("_cells").isNotNull()).select("_cells.*")


def _typed(raw: DataFrame, schema: T.StructType, strict: bool) -> DataFrame:
    def cell(f: T.StructField) -> Column:
        value = F.when(~F.col(f.name).isin(*NA_TOKENS), F.col(f.name))
        typed = value.cast(f.dataType) if strict else value.try_cast(f.dataType)
        return typed.alias(f.name)

    # Spark refuses queries that touch nothing but the corrupt-record column.
    first = F.col(schema.fields[0].name)
    bad = F.when(F.col(_CORRUPT).isNotNull() | first.isNull(), F.col(_CORRUPT)).alias(_CORRUPT)
    extra = [] if strict else [bad]
    return raw.select(*[cell(f) for f in schema.fields], *extra)


def malformed_rows(df: DataFrame) -> DataFrame:
    """Rows of a table read without ``strict`` that did not fit."""
    return df.filter(F.col(_CORRUPT).isNotNull())


def read_feature_source(spark: SparkSession, path: str, timestamp: str) -> DataFrame:
    """A parquet table with an event-time column."""
    df = spark.read.parquet(path)
    return df.withColumn(timestamp, F.col(timestamp).cast("timestamp"))


def stream_source(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream; new files are new rows."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def write_csv(df: DataFrame, path: str) -> None:
    """Cells with quotes, separators or line breaks are quoted, quotes in them doubled."""
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', **whole).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# --- checks of raw files ------------------------------------------------------


def encoding_of(content: Column) -> Column:
    """First listed encoding that decodes the whole content.

    Bytes that cp1252 leaves undefined are the only ones it cannot decode.
    """
    # Read as ISO-8859-1, every byte is the character of the same number.
    undefined = F.decode(content, "ISO-8859-1").rlike(UNDEFINED_IN_CP1252)
    return (
        F.when(F.is_valid_utf8(content.cast("string")), ENCODINGS[0])
        .when(~undefined, ENCODINGS[1])
        .otherwise(ENCODINGS[2])
    )


def _short(name: Column) -> Column:
    return F.regexp_replace(name, "^([A-Za-z0-9]+):/+", "$1:/")


def detect_encoding(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """``(path, encoding)`` of every file below a folder, or of every folder of files.

    Files are read line by line in splits, so that a file of any size is judged
    by many tasks: no encoding here lets a line feed stand inside a character,
    so a file decodes if all its lines do. An empty file decodes as the first
    encoding. A compressed file is judged by its content.
    """
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(path)
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    judged = lines.groupBy(F.col("_metadata.file_path").alias("_file")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.bool_or(raw.rlike(UNDEFINED_IN_CP1252)).alias("_undefined"),
    )
    # A scan leaves empty files out; the list of names, which the driver has anyway, does not.
    files = spark.createDataFrame([(name,) for name in lines.inputFiles()], "name string")
    place = F.regexp_replace("name", "/[^/]*$", "") if folders else F.col("name")
    found = files.join(judged, _short(F.col("name")) == _short(F.col("_file")), "left")
    return (
        found.groupBy(_short(place).alias("path"))
        .agg(
            F.bool_and(F.coalesce("_utf8", F.lit(True))).alias("_utf8"),
            F.bool_or(F.coalesce("_undefined", F.lit(False))).alias("_undefined"),
        )
        .select(
            "path",
            F.when(F.col("_utf8"), ENCODINGS[0])
            .when(~F.col("_undefined"), ENCODINGS[1])
            .otherwise(ENCODINGS[2])
            .alias("encoding"),
        )
    )


def line_counts(spark: SparkSession, path: str, minimum: int = 2) -> DataFrame:
    """``(path, lines, enough)`` per text file, files without any line included."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    counted = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    # A scan leaves empty files out; the list of names, which the driver has anyway, does not.
    files = spark.createDataFrame([(name,) for name in lines.inputFiles()], "name string")
    return (
        files.join(counted, _short(F.col("name")) == _short(F.col("path")), "left")
        .select(F.col("name").alias("path"), F.coalesce("lines", F.lit(0)).alias("lines"))
        .withColumn("enough", F.col("lines") >= minimum)
    )


def min_lines_gate(spark: SparkSession, path: str, minimum: int = 2) -> None:
    """Raises if a text file has too few lines."""
    short = line_counts(spark, path, minimum).filter(~F.col("enough")).orderBy("path").first()
    if short:
        raise InsufficientDataError(
            f"{short['path']} has {short['lines']} lines, at least {minimum} needed"
        )


def tag_static(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Adds constant labels."""
    return df.withColumns({name: F.lit(value) for name, value in tags.items()})
