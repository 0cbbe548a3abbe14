"""CSV files whose quoted cells hold line breaks, read by many tasks.

A line break ends a row only outside quotes, and whether a split of a file begins
inside a quoted cell is decided by all lines before it. Each line maps the state
in front of it (inside a cell or not) to the state behind it. These maps compose,
so that a split is one map, and a running composition over the splits of a file,
one row per split, tells where each begins. Splits are then cut into rows by
themselves; a row that several splits share is put together from its pieces.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.session import materialise


def _state_after(line: Column, inside: bool) -> Column:
    """Whether a cell is open behind a line, given the state in front of it.

    Doubled quotes change nothing. Inside a cell the next quote closes it; outside,
    a quote opens one only where a cell begins.
    """
    single = F.concat(F.lit(","), F.replace(line, F.lit('""'), F.lit("")))
    pieces = F.split(single, '"')
    before_quotes = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    folded = F.aggregate(before_quotes, F.lit(inside), lambda open_, piece: ~open_ & piece.endswith(","))
    return F.when(line.contains('"'), folded).otherwise(F.lit(inside))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, split, length, from_out, from_in)`` per line, in a task in the order of the file."""
    raw = spark.read.text(path, lineSep="\n")
    line = F.col("value")
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_block_length").alias("length"),
        _state_after(line, False).alias("from_out"),
        _state_after(line, True).alias("from_in"),
    )


def line_breaks_in_cells(lines: DataFrame) -> tuple[bool, bool, int]:
    """Whether any row goes over several lines, whether a carriage return stands inside a line, and
    the length of a split."""
    at = F.instr("value", F.lit("\r"))
    found = lines.agg(F.max("from_out"), F.max((at > 0) & (at < F.length("value"))), F.max("length")).first()
    return bool(found[0]), bool(found[1]), found[2] or 0


def _check_split(split: int, length: int, usual: int) -> None:
    """Fails where the files are split otherwise than when their splits' beginnings were looked up."""
    if length > usual or split % usual:
        raise RuntimeError(
            "the splits of the files changed between two passes; set spark.sql.files.minPartitionNum"
        )


def _runs(batch: pa.RecordBatch):
    """(file, split, its length, first line, end) of the lines of one split after the other."""
    n = batch.num_rows
    files, lengths = batch.column("file").dictionary_encode(), batch.column("length")
    codes, splits = files.indices.to_numpy(), batch.column("split").to_numpy()
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(splits) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
        if b > a:
            yield files.dictionary[int(codes[a])].as_py(), int(splits[a]), lengths[a].as_py(), a, b


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _states(from_out: np.ndarray, from_in: np.ndarray, inside: bool) -> np.ndarray:
    """The state behind every line: the last line that sets it, and the changes since."""
    flips = np.cumsum(from_out & ~from_in)
    setting = np.maximum.accumulate(np.where(from_out == from_in, np.arange(len(from_out)), -1))
    since = flips - np.where(setting >= 0, flips[setting], 0)
    return np.where(setting >= 0, from_out[setting], inside) ^ (since % 2 == 1)


def _split_maps(lines: DataFrame, usual: int) -> DataFrame:
    """``(file, split, from_out, from_in)`` of every split with a line that can change the state."""

    def work(batches):
        held: dict[tuple[str, int], tuple[bool, bool]] = {}
        for batch in batches:
            out, in_ = _flags(batch, "from_out"), _flags(batch, "from_in")
            for file, split, length, a, b in _runs(batch):
                _check_split(split, length, usual)
                before = held.get((file, split), (False, True))
                held[file, split] = tuple(bool(_states(out[a:b], in_[a:b], s)[-1]) for s in before)
        if held:
            yield pa.RecordBatch.from_pylist(
                [{"file": f, "split": s, "from_out": o, "from_in": i} for (f, s), (o, i) in held.items()],
                pa.schema([("file", pa.string()), ("split", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())]),
            )

    changing = lines.select("file", "split", "length", "from_out", "from_in").filter("from_out or not from_in")
    return changing.mapInArrow(work, "file string, split long, from_out boolean, from_in boolean")


def open_splits(lines: DataFrame, usual: int) -> DataFrame:
    """``(file, after, until)``: the splits behind ``after``, up to ``until``, begin inside a cell."""
    maps = materialise(_split_maps(lines, usual), "csv-splits")
    order = W.partitionBy("file").orderBy("split")  # one row per split
    setting = F.col("from_out") == F.col("from_in")
    counted = maps.withColumn("flips", F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(order))
    last = F.last(F.when(setting, F.struct("from_out", "flips")), ignorenulls=True).over(order)
    state = counted.withColumn("last", last).select(
        "file",
        F.col("split").alias("after"),
        F.lead("split").over(order).alias("until"),
        (
            F.coalesce("last.from_out", F.lit(False))
            != ((F.col("flips") - F.coalesce("last.flips", F.lit(0))) % 2 == 1)
        ).alias("open"),
    )
    return state.filter("open").select("file", "after", "until")


_PIECES = pa.schema(
    [
        ("record", pa.string()),
        ("file", pa.string()),
        ("split", pa.int64()),
        ("opens", pa.bool_()),
        ("header", pa.bool_()),
    ]
)


class _Cutter:
    """Cuts the lines of one split into rows; remembers the row that is not complete yet."""

    def __init__(self, file: str, split: int, inside: bool) -> None:
        self.file, self.split, self.inside = file, split, inside
        self.waiting: list[str] = []
        self.own = not inside  # whether the waiting lines begin in this split
        self.wants_header = split == 0
        self.whole: list[str] = []
        self.pieces: list[dict] = []

    def _close(self) -> None:
        if not self.waiting:
            return
        text = "\n".join(self.waiting)
        self.waiting = []
        if not self.own:
            self._piece(text, False)
        elif self.wants_header and text.strip("\r"):
            self.wants_header = False
        else:
            self.whole.append(text)

    def _piece(self, text: str, opens: bool) -> None:
        header = opens and self.wants_header
        self.pieces.append(
            {"record": text, "file": self.file, "split": self.split, "opens": opens, "header": header}
        )

    def lines(self, values: pa.Array, from_out: np.ndarray, from_in: np.ndarray) -> pa.Array:
        """Takes the next lines; the rows that are one line each are given back as they are."""
        after = _states(from_out, from_in, self.inside)
        starts = np.flatnonzero(~np.concatenate([[self.inside], after[:-1]]))
        self.inside = bool(after[-1])
        if not len(starts):
            self.waiting += values.to_pylist()
            return values.slice(0, 0)
        self.waiting += values.slice(0, int(starts[0])).to_pylist()
        self._close()
        self.own = True
        ends = np.append(starts[1:], starts[-1])  # the last row may go on
        single = ends - starts == 1
        if self.wants_header:
            single[:] = False
        for a, b in zip(starts[:-1][~single[:-1]].tolist(), ends[:-1][~single[:-1]].tolist(), strict=True):
            self.waiting = values.slice(a, b - a).to_pylist()
            self._close()
        self.waiting = values.slice(int(starts[-1])).to_pylist()
        return values.take(pa.array(starts[single]))

    def end(self) -> None:
        if self.inside and self.waiting:
            text = "\n".join(self.waiting)
            self.waiting = []
            self._piece(text, self.own)
        self._close()


def records(spark: SparkSession, lines: DataFrame, usual: int) -> DataFrame:
    """``record``: the text of every row of the files but their headers; no empty ones.

    ``usual`` is the length of a split, as :func:`line_breaks_in_cells` found it.

    What is sent to every task is at most one entry per split of a file that has
    several: 20 MB or so for 100 TB in splits of 128 MB.
    """
    opened: dict[str, list[tuple[int, int | None]]] = {}
    for row in open_splits(lines, usual).collect():
        opened.setdefault(row["file"], []).append((row["after"], row["until"]))
    shared = spark.sparkContext.broadcast({f: sorted(x, key=lambda s: s[0]) for f, x in opened.items()})

    def begins_inside(file: str, split: int) -> bool:
        spans = shared.value.get(file, [])
        i = bisect_left(spans, split, key=lambda s: s[0]) - 1
        return i >= 0 and (spans[i][1] is None or split <= spans[i][1])

    def rows_of(texts: pa.Array) -> pa.RecordBatch:
        empty = [pa.nulls(len(texts), f.type) for f in list(_PIECES)[1:]]
        return pa.RecordBatch.from_arrays([texts, *empty], schema=_PIECES)

    def given(cutter: _Cutter):
        if cutter.whole:
            yield rows_of(pa.array(cutter.whole, pa.string()))
        if cutter.pieces:
            yield pa.RecordBatch.from_pylist(cutter.pieces, _PIECES)
        cutter.whole, cutter.pieces = [], []

    def work(batches):
        cutter = None
        for batch in batches:
            out, in_ = _flags(batch, "from_out"), _flags(batch, "from_in")
            values = pc.cast(batch.column("value"), pa.string())
            for file, split, length, a, b in _runs(batch):
                _check_split(split, length, usual)
                if cutter is None or (cutter.file, cutter.split) != (file, split):
                    if cutter is not None:
                        cutter.end()
                        yield from given(cutter)
                    cutter = _Cutter(file, split, begins_inside(file, split))
                single = cutter.lines(values.slice(a, b - a), out[a:b], in_[a:b])
                yield rows_of(single)
                yield from given(cutter)
        if cutter is not None:
            cutter.end()
            yield from given(cutter)

    schema = "record string, file string, split long, opens boolean, header boolean"
    cut = lines.mapInArrow(work, schema)
    order = W.partitionBy("file").orderBy("split", "opens")  # two pieces per split at most
    numbered = cut.filter("file is not null").withColumn("row", F.sum(F.col("opens").cast("long")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("split", "opens", "record")))
    joined = (
        numbered.groupBy("file", "row")
        .agg(F.concat_ws("\n", F.transform(pieces, lambda p: p["record"])).alias("record"), F.max("header").alias("header"))
        .filter("not header")
        .select("record")
    )
    text = F.regexp_replace("record", r"\r\z", "").alias("record")
    return cut.filter("file is null").select("record").union(joined).select(text).filter("record <> ''")
