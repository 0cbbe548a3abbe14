"""Language-model scores from a hidden Markov model over words.

Latent states emit word classes, classes emit words. The most frequent words
have a class each, all others share hashed classes, in which a word's
probability is ``(c + 0.1) / (N_class + 0.1 * (V_class + 1))``, an unknown one's
with c = 0. So every text has a probability under the model.

* Word counts are summed over the whole training part. Words that are frequent
  enough for a table of ``HEAD_WORDS`` go to every task; the others are looked
  up by a join, each distinct one once per document.
* Training is Baum-Welch. A bounded sample only breaks the symmetry of the
  states; then every round runs forward and backward over all training texts,
  sums expected counts per task and adds them up across partitions.
* The scaled forward recursion gives a text's exact likelihood, whatever its
  length; texts of a batch are worked on side by side, word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import bounded_sample, write
from driftline.llm.words import PIECE, find_words, long_column, text_slices

STATES = 8
HEAD_WORDS = 1 << 19
OWN_CLASSES = 1 << 13
HASHED_CLASSES = 1 << 13
CLASSES = OWN_CLASSES + HASHED_CLASSES
#: Documents from which the states are started, and rounds over them and over all texts.
SAMPLE_DOCS = 600
SAMPLE_ROUNDS = 8
ROUNDS = 2
ADDED = 0.1
#: Weight, in words, of the corpus' class shares in every state's.
PRIOR_WORDS = 2_000.0
END = np.uint64(0x5EED_E4D0_0000_0001)


def token_hashes(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): lower-cased words of every text and its end."""
    words = find_words(buffer, offsets, lower=True)
    tokens = np.insert(words.hashes, words.bounds[1:], END)
    return tokens, words.bounds + np.arange(len(words.bounds))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (column text), the end included."""
    limit = 2_000_000

    def work(batches):
        held: list[np.ndarray] = []

        def emptied():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([long_column(word), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, buffer, offsets in text_slices(batch):
                held.append(token_hashes(buffer, offsets)[0])
                if sum(map(len, held)) > limit:
                    yield emptied()
        if held:
            yield emptied()

    counted = texts.select("text").mapInArrow(work, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows: the head words by hash, and the classes' sizes."""

    tokens: int
    distinct: int
    words: np.ndarray  # ascending
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(in the head, count there, class) of tokens."""
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        head = self.words[at] == tokens
        hashed = OWN_CLASSES + (tokens % np.uint64(HASHED_CLASSES)).astype(np.int64)
        return head, np.where(head, self.counts[at], 0), np.where(head, self.classes[at], hashed)

    def class_room(self) -> np.ndarray:
        """Per class what a word's ``c + 0.1`` is divided by; 0 for words with a class each."""
        room = self.class_tokens + ADDED * (self.class_words + 1)
        room[:OWN_CLASSES] = 0.0
        return room

    def class_shares(self) -> np.ndarray:
        weights = self.class_tokens.astype(float)
        weights[OWN_CLASSES:] += ADDED * (self.class_words[OWN_CLASSES:] + 1)
        weights[0] += ADDED
        return weights / weights.sum()


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS) -> tuple[Vocabulary, DataFrame]:
    """The shared part of the vocabulary and the counts of all other words."""
    size = F.floor(F.log2("c") * 8)
    steps = counts.groupBy(size.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")
    ).collect()  # at most eight rows per doubling of the largest count
    steps = sorted(((r["step"], r["n"], r["c"]) for r in steps), reverse=True)
    tokens, distinct = sum(s[2] for s in steps), sum(s[1] for s in steps)
    room, lowest = head_words - 1, None
    for step, n, _ in steps:
        if n > room:
            break
        room, lowest = room - n, step
    in_head = (size >= lowest) if lowest is not None else F.lit(False)
    # At most ``head_words`` rows.
    head = counts.filter(in_head | (F.col("word") == int(END.view(np.int64)))).toPandas()
    words, c = head["word"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    if END not in words:
        words, c = np.append(words, END), np.append(c, 0)
    order = np.argsort(words)
    words, c = words[order], c[order]
    classes = OWN_CLASSES + (words % np.uint64(HASHED_CLASSES)).astype(np.int64)
    frequent = np.lexsort((words, -c, words != END))[:OWN_CLASSES]  # the end comes first
    classes[frequent] = np.arange(len(frequent))
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    np.add.at(class_tokens, classes, c)
    np.add.at(class_words, classes, c > 0)
    rest = counts.filter(~in_head & (F.col("word") != int(END.view(np.int64))))
    # 2**64 is a multiple of the number of classes, so that signs do not matter.
    hashed = F.pmod(F.col("word"), F.lit(HASHED_CLASSES))
    for r in rest.groupBy(hashed.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_tokens[OWN_CLASSES + r["k"]] += r["c"]
        class_words[OWN_CLASSES + r["k"]] += r["n"]
    return Vocabulary(tokens, distinct, words, c, classes, class_tokens, class_words), rest


@dataclass
class Model:
    start: np.ndarray  # per state
    moves: np.ndarray  # from state, to state
    emits: np.ndarray  # per class and state


class _SideBySide:
    """Tokens of several texts, ordered by place, then by text from the longest on."""

    def __init__(self, classes: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        steps = int(self.sizes[0]) if len(sizes) else 0
        # Texts that are longer than t, for every t.
        self.alive = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(steps), "right")
        self.edges = np.concatenate([[0], np.cumsum(self.alive)])
        text = np.repeat(np.arange(len(sizes)), self.sizes)
        place = np.arange(self.edges[-1]) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.classes = np.empty(self.edges[-1], np.int64)
        self.classes[self.edges[place] + text] = classes[np.repeat(bounds[:-1][self.order], self.sizes) + place]

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled forward variables, scales, log10 likelihood per text in the given order)."""
        ahead = model.emits[self.classes]
        scales = np.empty(len(ahead))
        for t, n in enumerate(self.alive):
            a, b = self.edges[t], self.edges[t] + n
            now = ahead[a:b]
            now *= model.start if t == 0 else ahead[self.edges[t - 1] : self.edges[t - 1] + n] @ model.moves
            scales[a:b] = now.sum(axis=1)
            now /= scales[a:b, None]
        logs, totals = np.log10(scales), np.zeros(len(self.sizes))
        for t, n in enumerate(self.alive):
            totals[:n] += logs[self.edges[t] : self.edges[t] + n]
        out = np.empty(len(totals))
        out[self.order] = totals
        return ahead, scales, out

    def expected_counts(self, model: Model, into: Model) -> float:
        """Adds the expected uses of starts, moves and emissions; the log10 likelihood."""
        ahead, scales, logs = self.forward(model)
        states = model.moves.shape[0]
        moved = np.zeros((states, states))
        coming = np.empty((0, states))
        for t in range(len(self.alive) - 1, -1, -1):
            a, n = self.edges[t], self.alive[t]
            behind = np.ones((n, states))
            if len(coming):
                moved += ahead[a : a + len(coming)].T @ coming
                behind[: len(coming)] = coming @ model.moves.T
            coming = model.emits[self.classes[a : a + n]] * behind
            coming /= scales[a : a + n, None]
            ahead[a : a + n] *= behind
        if len(self.alive):
            into.start += ahead[: self.alive[0]].sum(axis=0)
        into.moves += moved * model.moves
        for s in range(states):
            into.emits[:, s] += np.bincount(self.classes, ahead[:, s], len(into.emits))
        return float(logs.sum())


def _empty(states: int) -> Model:
    return Model(np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)))


def maximised(counts: Model, shares: np.ndarray) -> Model:
    """The model of expected counts, smoothed by the corpus' class shares."""
    states = len(counts.start)
    start = (counts.start + 1) / (counts.start.sum() + states)
    moves = (counts.moves + 1) / (counts.moves.sum(axis=1, keepdims=True) + states)
    emits = counts.emits + PRIOR_WORDS * shares[:, None]
    return Model(start, moves, emits / emits.sum(axis=0))


def _started(texts: list[np.ndarray], shares: np.ndarray, states: int) -> Model:
    """States that emit like texts as unlike each other as the sample has; staying is likely."""
    bags = np.array([np.bincount(x, minlength=CLASSES) for x in texts], float)
    roots = np.sqrt(bags / np.maximum(bags.sum(axis=1, keepdims=True), 1))
    chosen = [int(np.argmax(bags.sum(axis=1)))]
    nearest = roots @ roots[chosen[0]]
    while len(chosen) < min(states, len(texts)):
        long_enough = bags.sum(axis=1) >= 50
        chosen.append(int(np.argmin(np.where(long_enough, nearest, 2.0))))
        nearest = np.maximum(nearest, roots @ roots[chosen[-1]])
    emits = np.repeat(shares[:, None], states, axis=1)
    for s, i in enumerate(chosen):
        own = bags[i] / max(bags[i].sum(), 1)
        emits[:, s] = 0.5 * shares + 0.5 * (own if own.any() else shares)
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits)


def _expect(texts: DataFrame, known, model: Model) -> Model:
    """One round's expected counts over all rows of ``texts``, summed across partitions."""
    states = len(model.start)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        words, now, sums = known.value, shared.value, _empty(states)
        for batch in batches:
            for _, buffer, offsets in text_slices(batch, limit=6 * PIECE):
                tokens, bounds = token_hashes(buffer, offsets)
                _SideBySide(words.look_up(tokens)[2], bounds).expected_counts(now, sums)
        # Starts and moves follow the classes as further rows.
        rows = np.vstack([sums.emits, sums.moves, sums.start[None, :]])
        some = np.flatnonzero(rows.any(axis=1))
        edges = pa.array(np.arange(0, (len(some) + 1) * states, states), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.ListArray.from_arrays(edges, pa.array(rows[some].ravel()))], ["row", "uses"]
        )

    uses = texts.select("text").mapInArrow(work, "row long, uses array<double>")
    parts = [F.sum(F.element_at("uses", s + 1)).alias(f"s{s}") for s in range(states)]
    summed = write(uses.groupBy("row").agg(*parts), "expected").toPandas()  # at most CLASSES + STATES + 1 rows
    rows = np.zeros((CLASSES + states + 1, states))
    rows[summed["row"].to_numpy(np.int64)] = summed[[f"s{s}" for s in range(states)]].to_numpy()
    shared.unpersist()
    return Model(rows[-1], rows[CLASSES:-1], rows[:CLASSES])


def train(
    texts: DataFrame, known, states: int = STATES, rounds: int = ROUNDS,
    sample_docs: int = SAMPLE_DOCS, sample_rounds: int = SAMPLE_ROUNDS,
) -> Model:
    """Baum-Welch over all rows of ``texts`` (key, text)."""
    shares = known.value.class_shares()
    n_texts = int(known.value.counts[known.value.words == END][0])
    rows = bounded_sample(texts, "key", sample_docs, n_texts).select("text").toArrow()
    sample = []
    for batch in rows.to_batches():
        for part, buffer, offsets in text_slices(batch):
            tokens, bounds = token_hashes(buffer, offsets)
            classes = known.value.look_up(tokens)[2]
            sample += [classes[bounds[i] : bounds[i + 1]] for i in range(part.num_rows)]
    if not sample:
        return maximised(_empty(states), shares)
    model = _started(sample, shares, states)
    together = np.concatenate([[0], np.cumsum([len(x) for x in sample])])
    side = _SideBySide(np.concatenate(sample), together)
    for _ in range(sample_rounds):
        counts = _empty(states)
        side.expected_counts(model, counts)
        model = maximised(counts, shares)
    for _ in range(rounds):
        model = maximised(_expect(texts, known, model), shares)
    return model


def score(
    docs: DataFrame,
    training: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``training`` tells the rows to learn from. ``base_score`` is the log10
    probability under smoothed word frequencies, ``score`` under the hidden
    Markov model. A null or empty text is its end alone. Repeated rows are
    learned from and scored each for itself. An empty table gives an empty one.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(training, F.lit(False)).alias("training"),
        F.col(text_column).alias("text"),
    )
    learned = rows.filter("training").select(F.coalesce("id", F.lit(0)).alias("key"), "text")
    counts = write(count_words(learned), "counts")
    words, rest = vocabulary(counts, head_words)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(words)
    trained = spark.sparkContext.broadcast(train(learned, known, states, rounds))

    def work(batches):
        words, model = known.value, trained.value
        room = words.class_room()
        log_room = np.log10(np.where(room > 0, room, 1.0))
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, buffer, offsets in text_slices(batch, limit=6 * PIECE):
                tokens, bounds = token_hashes(buffer, offsets)
                head, c, classes = words.look_up(tokens)
                _, _, logs = _SideBySide(classes, bounds).forward(model)
                counted = np.where(head, np.log10(c + ADDED), 0.0)
                sharing = classes >= OWN_CLASSES

                def summed(x, bounds=bounds):
                    return np.add.reduceat(x.astype(float), bounds[:-1]) if len(bounds) > 1 else np.empty(0)

                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))[~head]
                rare = tokens[~head]
                order = np.lexsort((rare, doc))
                doc, rare = doc[order], rare[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(doc)))
                edges = np.searchsorted(doc[first], np.arange(part.num_rows + 1))
                tail = pa.StructArray.from_arrays(
                    [long_column(rare[first]), pa.array(times, pa.int64())], names=["word", "n"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(made + np.arange(part.num_rows)),
                        part.column("id"),
                        part.column("training"),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(summed(head & (c > 0)).astype(np.int64)),
                        pa.array(summed(counted)),
                        pa.array(logs + summed(np.where(sharing, counted - log_room[classes], 0.0))),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), tail),
                    ],
                    ["row", "id", "training", "n_tokens", "n_head", "head_base", "head_score", "tail"],
                )
                made += part.num_rows

    scored = write(
        rows.mapInArrow(
            work,
            "row long, id long, training boolean, n_tokens long, n_head long, head_base double, "
            "head_score double, tail array<struct<word:long,n:long>>",
        ),
        "scored",
    )
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(rest, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("tail_log"),
    )
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    room = float(np.log10(words.tokens + ADDED * (words.distinct + 1)))
    return scored.drop("tail").join(tail, "row", "left").select(
        F.col("id").alias(id_column),
        "training",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(int(words.tokens)).cast("long").alias("train_tokens"),
        (F.col("head_base") + tail_log - F.col("n_tokens") * room).alias("base_score"),
        (F.col("head_score") + tail_log).alias("score"),
    )
