"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters, lower-cased) are hashed; a hash is a row of embeddings. Filters
of several widths slide over a text, the highest value of each filter goes into
a logistic layer. Only hashes that go with a label beyond chance learn an
embedding (of all hashes, ``BY_CHANCE`` would by chance); the others share one
that stays zero, so that wrong labels are not learned by heart through rare
words. Embeddings start from how much more often a hash occurs in texts of one
label; gradients go through the places of the highest values only.

Training takes all labelled rows. Words are counted over the four fifths that
come first by hash; in every round each shard of some ``SHARD_ROWS`` of them goes
on from the same network, and the shards' changes are averaged, a word's over the
places where it stands. The last fifth ends the training, sets the scale of the
scores, and gives each language its own flagging threshold. The language never
enters a score. Scoring reads whole texts, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import small_batches, write
from driftline.llm.words import find_words, long_column, mix, release_memory, sequence_hashes, text_slices

DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Rows of one shard, about; one task learns from them in turn.
SHARD_ROWS = 5_000
#: Words of one shard, about; long texts make smaller shards.
SHARD_WORDS = 4_000_000
#: Places of words whose values are held at once; each takes some 200 bytes.
PLACES = 1 << 16
#: Labels of at most this many rows are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: The last fifth's scores before scaling are told apart in steps of one part of this.
STEPS = 1_000
BY_CHANCE = 0.1
EPOCHS = 8
BATCH = 64
RATE = 0.05
SEED = 10
PREDICTED = 0.7
_PAD = max(WIDTHS) - 1


@dataclass
class Texts:
    """Embedding rows of all texts' words, each text followed by padding; ``real`` marks places of words."""

    bins: np.ndarray
    starts: np.ndarray
    real: np.ndarray


def laid_out(bins: np.ndarray, bounds: np.ndarray) -> Texts:
    """The texts with the rows ``bins[bounds[i]:bounds[i + 1]]``; a text without words is one padded place."""
    sizes = np.diff(bounds)
    room = np.maximum(sizes, 1) + _PAD
    starts = np.cumsum(room) - room
    places, real = np.zeros(room.sum(), np.int64), np.zeros(room.sum(), bool)
    place = np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[0], bounds[-1])
    places[place] = bins[bounds[0] : bounds[-1]]
    real[place] = True
    real[starts] = True
    return Texts(places, starts, real)


def _known(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hashes' rows (from 1 on; 0 is padding and all hashes that are not in the sorted ``vocabulary``)."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def binned(buffer: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> Texts:
    """The words' rows, as :func:`_known` gives them."""
    words = find_words(buffer, offsets, lower=True, letters=True)
    return laid_out(_known(vocabulary, words.hashes), words.bounds)


@dataclass
class Network:
    vocabulary: np.ndarray  # hashes that have an embedding, ascending
    embeddings: np.ndarray  # one row more than the vocabulary, DIMENSIONS
    filters: dict[int, np.ndarray]  # per width: width, DIMENSIONS, FILTERS
    offsets: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        """Per width and place in the filter: what each bin adds to each filter."""
        return {
            (w, j): (self.embeddings @ f[j]).astype(np.float32)
            for w, f in self.filters.items()
            for j in range(w)
        }


def _highest(texts: Texts, tables, offsets, bins: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """(highest value per text and filter, values per width); ``bins`` index the tables."""
    bins = texts.bins if bins is None else bins
    n = len(bins)
    columns, all_values = [], {}
    for width in WIDTHS:
        values = np.full((n, FILTERS), -np.inf, np.float32)
        reach = n - _PAD
        total = tables[width, 0][bins[:reach]]
        for j in range(1, width):
            total += tables[width, j][bins[j : reach + j]]
        values[:reach] = total + offsets[width].astype(np.float32)
        values[~texts.real] = -np.inf
        columns.append(np.maximum.reduceat(values, texts.starts, axis=0))
        all_values[width] = values
    return np.hstack(columns), all_values


def _highest_by_pieces(texts: Texts, tables, offsets) -> np.ndarray:
    """The highest values of :func:`_highest`, for some ``PLACES`` at once, also within a text."""
    n = len(texts.bins)
    highest = np.full((len(texts.starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    for at in range(0, n, PLACES):
        stop = min(at + PLACES, n)
        if stop - at <= _PAD and stop == n:  # padding alone
            break
        reach = min(stop + _PAD, n)
        real = texts.real[at:reach].copy()
        real[stop - at :] = False  # the next piece's
        first = int(np.searchsorted(texts.starts, at, "right")) - 1
        last = int(np.searchsorted(texts.starts, stop))
        own = Texts(texts.bins[at:reach], np.maximum(texts.starts[first:last] - at, 0), real)
        highest[first:last] = np.maximum(highest[first:last], _highest(own, tables, offsets)[0])
    return highest


def logits(network: Network, texts: Texts, tables=None) -> np.ndarray:
    highest = _highest_by_pieces(texts, tables or network.tables(), network.offsets)
    return np.maximum(highest, 0) @ network.weights + network.bias


def probability(network: Network, raw: np.ndarray) -> np.ndarray:
    a, b = network.scale
    return 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _started(vocabulary: np.ndarray, in_texts: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Network:
    """A network that looks for words of label 1, given the texts of each label, with each word and in all."""
    seen = in_texts + 0.5
    odds = np.log(seen[1] / (n[1] + 1)) - np.log(seen[0] / (n[0] + 1))
    embeddings = rng.normal(0, 0.05, (len(vocabulary) + 1, DIMENSIONS))
    embeddings[1:, 0] = np.clip(odds / np.sqrt(1 / seen[0] + 1 / seen[1]) / 4, -1, 2)
    embeddings[0] = 0
    filters = {w: rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    offsets = {w: np.full(FILTERS, -0.3) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][0, 0, : FILTERS // 2] += 1.0
    weights = rng.normal(0, 0.05, len(WIDTHS) * FILTERS)
    weights.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] += 0.3
    share = (n[1] + 1) / (n.sum() + 2)
    return Network(vocabulary, embeddings, filters, offsets, weights, float(np.log(share / (1 - share))))


class _Adagrad:
    def __init__(self):
        self.sums: dict[str, np.ndarray] = {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None):
        sums = self.sums.setdefault(name, np.full(value.shape, 1e-4))
        at = slice(None) if rows is None else rows
        sums[at] += gradient**2
        value[at] -= RATE * gradient / np.sqrt(sums[at])


def _learn(network: Network, texts: Texts, labels: np.ndarray, steps: _Adagrad) -> None:
    """One step on one batch."""
    unique, inverse = np.unique(texts.bins, return_inverse=True)
    own = network.embeddings[unique]
    tables = {(w, j): own @ f[j] for w, f in network.filters.items() for j in range(w)}
    highest, values = _highest(texts, tables, network.offsets, inverse)
    active = np.maximum(highest, 0)
    error = (_sigmoid(active @ network.weights + network.bias) - labels) / len(labels)
    reach_back = error[:, None] * network.weights * (highest > 0)
    toward = np.zeros_like(own)
    ends = np.append(texts.starts[1:], len(texts.bins))
    for k, width in enumerate(WIDTHS):
        back = reach_back[:, k * FILTERS : (k + 1) * FILTERS]
        best = np.array([
            a + values[width][a:b].argmax(axis=0) for a, b in zip(texts.starts, ends, strict=True)
        ])
        grown = np.zeros_like(network.filters[width])
        for j in range(width):
            place = inverse[best + j]  # text, filter
            grown[j] = np.einsum("tfd,tf->df", own[place], back)
            np.add.at(toward, place.ravel(), (back[:, :, None] * network.filters[width][j].T).reshape(-1, DIMENSIONS))
        steps.step(f"filter{width}", network.filters[width], grown)
        steps.step(f"offset{width}", network.offsets[width], back.sum(axis=0))
    steps.step("weights", network.weights, active.T @ error + 1e-4 * network.weights)
    network.bias -= RATE * float(error.sum())
    learned = unique > 0  # row 0 stays zero
    steps.step("embeddings", network.embeddings, toward[learned], unique[learned])


def _loss(p: np.ndarray, labels: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))))


def _scaled(raw: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the labels best, drawn towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(300):
        error = _sigmoid(a * raw + b) - labels
        a -= 0.02 * (float(np.average(error * raw, weights=counts)) + 0.02 * (a - 1))
        b -= 0.02 * (float(np.average(error, weights=counts)) + 0.02 * b)
    return max(a, 0.05), b


def _threshold(p: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """The score from which flagging gives the best F1; the default without both labels."""
    if len(set(labels.tolist())) < 2:
        return PREDICTED
    scores, inverse = np.unique(-p, return_inverse=True)
    flagged = np.cumsum(np.bincount(inverse, counts))
    hits = np.cumsum(np.bincount(inverse, counts * labels))
    return float(-scores[int(np.argmax(2 * hits / (flagged + hits[-1])))])


def _marks(buffer: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Four smallest hashes of three-word runs; near copies have some in common."""
    runs = sequence_hashes(find_words(buffer, offsets, lower=True).hashes, 3)
    return {int(mix(runs + np.uint64(seed)).min()) for seed in range(1, 5)} if len(runs) else set()


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _words_of(texts: DataFrame) -> DataFrame:
    """Adds ``words``, a text's word hashes in order, and ``marks`` in place of the text."""
    others = [c for c in texts.columns if c != "text"]

    def work(batches):
        for batch in batches:
            for part, buffer, offsets in text_slices(batch):
                words = find_words(buffer, offsets, lower=True, letters=True)
                marks = []
                for i in range(part.num_rows):
                    own = buffer[offsets[i] : offsets[i + 1]]
                    marks.append(np.array(sorted(_marks(own, np.array([0, len(own)]))), np.uint64))
                ends = np.cumsum([0, *map(len, marks)])
                made = [
                    _lists(long_column(words.hashes), words.bounds),
                    _lists(long_column(np.concatenate([np.empty(0, np.uint64), *marks])), ends),
                ]
                yield pa.RecordBatch.from_arrays([*map(part.column, others), *made], [*others, "words", "marks"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in others)
    return texts.mapInArrow(work, f"{kinds}, words array<long>, marks array<long>")


def _first_of_copies(rows: DataFrame) -> DataFrame:
    """The rows none of whose marks stands in a row before them."""
    marks = rows.select(F.struct("h", "id", "t", "row").alias("place"), F.explode("marks").alias("mark"))
    firsts = marks.groupBy("mark").agg(F.min("place").alias("first"))
    copies = marks.join(firsts, "mark").filter(F.col("place") != F.col("first")).select("place.row").distinct()
    return rows.join(write(copies, "copies"), "row", "left_anti").drop("marks")


def _vocabulary(rows: DataFrame, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes that go with a label beyond chance, ascending; texts of each label that have them)."""
    words = rows.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )
    words = write(words.filter("n0 + n1 > 2"), "words")
    among = words.count()
    # Likelihood ratio of the labels among a hash's texts against those of all texts.
    ratio = F.lit(0.0)
    for k in (0, 1):
        seen, expected = F.col(f"n{k}"), (F.col("n0") + F.col("n1")) * F.lit(float(n[k] / n.sum()))
        ratio = ratio + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    low, high = 0, 10_000_000  # thousandths; from ``high`` on nothing comes by chance
    while low < high:
        at = (low + high) // 2
        if erfc(sqrt(at / 2000)) * among < BY_CHANCE:
            high = at
        else:
            low = at + 1
    found = words.filter(F.round(ratio, 3) >= low / 1000).toArrow()
    hashes = np.array(found.column("word").to_pylist(), np.int64).view(np.uint64)
    in_texts = np.array([found.column(c).to_pylist() for c in ("n0", "n1")], float)
    order = np.argsort(hashes)
    return hashes[order], in_texts[:, order]


def _ends(column: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _binned(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``bins`` in place of ``words``: each word's embedding."""
    others = [c for c in rows.columns if c != "words"]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        known = shared.value
        for batch in batches:
            column = batch.column("words")
            hashes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            made = _lists(pa.array(_known(known, hashes), pa.int32()), _ends(column))
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), made], [*others, "bins"])
            release_memory()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(work, f"{kinds}, bins array<int>")


def _texts(bins: pa.ListArray) -> Texts:
    """What :func:`binned` gives for the texts."""
    return laid_out(bins.flatten().to_numpy(zero_copy_only=False), _ends(bins))


def _shards(rows: float, words: float, shard_rows: int) -> int:
    return max(1, ceil(rows / shard_rows), ceil(words / SHARD_WORDS))


def _rows_of(network: Network, steps: _Adagrad) -> np.ndarray:
    """All values with their sums of squares, in rows of DIMENSIONS each; embeddings first, the bias last."""
    parts = {"embeddings": network.embeddings, "weights": network.weights}
    parts |= {f"filter{w}": f for w, f in network.filters.items()} | {f"offset{w}": o for w, o in network.offsets.items()}
    values = [x.reshape(-1, DIMENSIONS) for x in parts.values()]
    sums = [steps.sums.get(k, np.full(x.shape, 1e-4)).reshape(-1, DIMENSIONS) for k, x in parts.items()]
    bias = np.zeros((2, 1, DIMENSIONS))
    bias[0, 0, 0] = network.bias
    return np.hstack([np.vstack([*values, bias[0]]), np.vstack([*sums, bias[1]])])


def _from_rows(like: Network, rows: np.ndarray) -> tuple[Network, _Adagrad]:
    """What :func:`_rows_of` was given."""
    network = Network(
        like.vocabulary, like.embeddings, dict(like.filters), dict(like.offsets), like.weights, float(rows[-1, 0])
    )
    steps, at = _Adagrad(), 0

    def taken(name: str, shape: tuple[int, ...]) -> np.ndarray:
        nonlocal at
        n = int(np.prod(shape)) // DIMENSIONS
        values, sums = (rows[at : at + n, k : k + DIMENSIONS].reshape(shape).copy() for k in (0, DIMENSIONS))
        steps.sums[name] = sums
        at += n
        return values

    network.embeddings = taken("embeddings", like.embeddings.shape)
    network.weights = taken("weights", like.weights.shape)
    network.filters = {w: taken(f"filter{w}", f.shape) for w, f in like.filters.items()}
    network.offsets = {w: taken(f"offset{w}", o.shape) for w, o in like.offsets.items()}
    return network, steps


def _epoch(rows: DataFrame, network: Network, steps: _Adagrad, seed: int) -> tuple[Network, _Adagrad]:
    """Every shard learns from its rows once, from the same network on; their changes are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast((network, _rows_of(network, steps)))

    def work(table: pa.Table) -> pa.Table:
        like, before = shared.value
        own, sums = _from_rows(like, before)
        table = table.sort_by([("h", "ascending"), ("t", "ascending"), ("label", "ascending")])
        bins = table.column("bins").combine_chunks()
        labels = np.array(table.column("label").to_pylist(), np.int64)
        rng = np.random.default_rng([seed, table.column("shard")[0].as_py()])
        order = rng.permutation(len(bins))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            _learn(own, _texts(bins.take(pa.array(chosen))), labels[chosen], sums)
        changes = _rows_of(own, sums) - before
        weights = np.full(len(before), float(len(bins)))
        # Row 0 never changes, so its padding need not count.
        places = np.bincount(bins.flatten().to_numpy(zero_copy_only=False), minlength=len(like.embeddings))
        weights[: len(places)] = places
        release_memory()
        some = np.flatnonzero(changes.any(axis=1))
        uses = np.hstack([weights[some, None], changes[some] * weights[some, None]])
        ends = np.arange(0, uses.size + 1, 2 * DIMENSIONS + 1)
        return pa.table({"row": pa.array(some, pa.int64()), "uses": _lists(pa.array(uses.ravel()), ends)})

    changed = rows.groupBy("shard").applyInArrow(work, "row long, uses array<double>")
    parts = [F.sum(F.element_at("uses", k + 1)).alias(f"s{k}") for k in range(2 * DIMENSIONS + 1)]
    # As many rows as the network has.
    summed = write(changed.groupBy("row").agg(*parts), "changes").toPandas()
    shared.unpersist()
    after, sums = _rows_of(network, steps), summed.drop(columns="row").to_numpy()
    after[summed["row"].to_numpy(np.int64)] += sums[:, 1:] / sums[:, :1]
    return _from_rows(network, after)


def _raw(rows: DataFrame, network: Network) -> DataFrame:
    """(lang, label, step, n): how many rows have each logit, in steps, with the label in the language."""
    shared = rows.sparkSession.sparkContext.broadcast((network, network.tables()))

    def work(batches):
        model, tables = shared.value
        for batch in batches:
            raw = logits(model, _texts(batch.column("bins")), tables)
            step = pa.array(np.floor(np.clip(raw, -100, 100) * STEPS).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), step], ["lang", "label", "step"])
            release_memory()

    steps = rows.select("lang", "label", "bins").mapInArrow(work, "lang string, label int, step long")
    return steps.groupBy("lang", "label", "step").agg(F.count(F.lit(1)).alias("n"))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    lang_column: str = "lang", label_column: str = "label", epochs: int = EPOCHS, seed: int = SEED,
    shard_rows: int = SHARD_ROWS,
) -> Network:
    """Fits the network to the texts of all rows of ``labels``.

    Of near copies among them only the first by the id's hash is used. Labels other than 0 and 1
    are left out. Without rows of both labels every score is the share of label 1.
    """
    with small_batches(docs.sparkSession):
        return _trained(docs, labels, id_column, text_column, lang_column, label_column, epochs, seed, shard_rows)


def _trained(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, lang_column: str, label_column: str,
    epochs: int, seed: int, shard_rows: int,
) -> Network:
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.filter("label in (0, 1)")
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    texts = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")
    ).join(known, "id")
    texts = texts.select(
        F.xxhash64("id").alias("h"), F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("t"),
        F.monotonically_increasing_id().alias("row"), "label", F.coalesce("lang", F.lit("")).alias("lang"), "text",
    )
    # Copies of a text would make its label, right or wrong, look certain.
    rows = write(_first_of_copies(write(_words_of(texts), "labelled")), "learned")
    last = rows.agg(F.percentile_approx("h", 0.8, 10_000)).first()[0]
    fit = rows.filter(F.col("h") < F.lit(last))
    n, n_words = np.zeros((2, 2)), 0
    sizes = F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")
    for r in rows.groupBy((F.col("h") < F.lit(last)).alias("fit"), "label").agg(*sizes).collect():
        n[int(r["fit"]), r["label"]] = r["n"]
        n_words += r["words"] if r["fit"] else 0
    rng = np.random.default_rng(seed)
    if not n[1].all():
        share = (n[:, 1].sum() + 1) / (n.sum() + 2)
        network = _started(np.empty(0, np.uint64), np.zeros((2, 0)), n[1], rng)
        network.weights[:] = 0
        network.bias = float(np.log(share / (1 - share)))
        return network
    vocabulary, in_texts = _vocabulary(fit, n[1])
    network, steps, best = _started(vocabulary, in_texts, n[1], rng), _Adagrad(), None
    shards = _shards(n[1].sum(), n_words, shard_rows)
    bins = write(_binned(rows.withColumn("shard", F.pmod(F.xxhash64("h", "t"), F.lit(shards))), vocabulary), "bins")
    fit, held = bins.filter(F.col("h") < F.lit(last)), bins.filter(F.col("h") >= F.lit(last))
    # A number of partitions that is named is kept: a shard's rows are few bytes but much work.
    fit = fit.select("shard", "h", "t", "label", "bins").repartition(shards, "shard")
    for epoch in range(epochs):
        network, steps = _epoch(fit, network, steps, seed + epoch)
        found = _raw(held, network).groupBy("label", "step").agg(F.sum("n").alias("n"))
        p = 1 / (1 + F.exp(-(F.col("step") + 0.5) / STEPS))
        p = F.least(F.greatest(F.when(F.col("label") == 1, p).otherwise(1 - p), F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = found.agg(F.sum(-F.log(p) * F.col("n")) / F.sum("n")).first()[0]
        if best is None or loss < best[0]:
            best = loss, network
        elif loss > 1.1 * best[0]:
            break
    network = best[1]
    found = _raw(held, network).toPandas()  # a row per language, label and step
    step, marks, counts = (found[c].to_numpy(np.int64) for c in ("step", "label", "n"))
    network.scale = _scaled((step + 0.5) / STEPS, marks, counts)
    p = probability(network, step / STEPS)
    for language in sorted(set(found["lang"])):
        of = (found["lang"] == language).to_numpy()
        network.thresholds[language] = _threshold(p[of], marks[of], counts[of])
    return network


def score(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text",
          lang_column: str = "lang") -> DataFrame:
    """(id, lang, score, predicted, threshold, flagged) per row.

    ``predicted`` is 1 from a score of 0.7 on; ``flagged`` uses the language's
    own threshold. Null and empty texts have a score like any text without known
    words. Repeated rows are scored each for itself; further columns are not
    looked at. An empty table gives an empty one. The scores are written to the shared
    folder, so that workers get a few texts at a time whatever the caller's settings.
    """
    small = Network(network.vocabulary, np.empty(0), {}, network.offsets, network.weights, network.bias, network.scale)
    shared = docs.sparkSession.sparkContext.broadcast((small, network.tables()))

    def work(batches):
        model, tables = shared.value
        for batch in batches:
            for part, buffer, offsets in text_slices(batch, limit=2 << 20):
                p = probability(model, logits(model, binned(buffer, offsets, model.vocabulary), tables))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("lang"), pa.array(p.astype(np.float64))],
                    ["id", "lang", "score"],
                )

    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        F.col(lang_column).cast("string").alias("lang"),
    )
    threshold = F.lit(PREDICTED)
    for language, value in network.thresholds.items():
        threshold = F.when(F.coalesce("lang", F.lit("")) == language, F.lit(value)).otherwise(threshold)
    with small_batches(docs.sparkSession):
        scored = write(rows.mapInArrow(work, "id long, lang string, score double"), "scores")
    return scored.select(
        F.col("id").alias(id_column),
        F.col("lang").alias(lang_column),
        "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
