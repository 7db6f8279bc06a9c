"""Hidden Markov language model: latent states with word emissions, trained by Baum-Welch.

Words are counted over all training texts. The ``FREQUENT`` most counted words and the end token emit
on their own; every other word emits through one of ``SHAPES`` classes given by its last bytes, and
within its class by its own training count, with the class's share of singletons (Good-Turing) left
to words never seen. All probabilities sum to one over known words, unknown words by class, and end.

Training is Baum-Welch: every pass takes expected counts from all training texts, each from its first word
to its end, adds them up across partitions, and passes go on until one raises the likelihood of all texts by
less than ``TOLERANCE`` of its size. No text is sampled, shortened or cut. The start only breaks the symmetry
of the states: every training text is dealt whole to the state whose random direction its words lean to, against
the average word, so texts alike start together, however many there are. Scoring is the exact likelihood
of each whole text by the scaled forward recursion. The vocabulary is a table that grows with the
corpus: counts of rare words reach the texts by a shuffled join, never through a broadcast. Only the
``FREQUENT`` words, the class table and the states travel with the tasks; their size is fixed.

A null text is an empty one: a single end token. Repeated and null ids are rows of their own. Without
training rows every token is unknown and N is 0. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm import tokens
from ordersight.session import cut

STATES = 8
FREQUENT = 8192
SHAPE_BITS = 12
SHAPES = 1 << SHAPE_BITS
TOLERANCE = 1e-4
STAY = 50.0  # how much likelier than another one a state is to follow itself, before the first pass
GROUP = 1_000_000  # symbols worked on together, or those of one longer text
PRIOR = 5.0
FLUSH = 1_000_000
U = np.uint64
END = 0  # symbol of the end token; then the frequent words, then the shapes


def word_keys(block: tokens.Words, h: np.ndarray) -> np.ndarray:
    """64-bit keys whose low ``SHAPE_BITS`` are the word's shape: a hash of its last three bytes."""
    data = np.concatenate([block.data, np.zeros(2, np.uint8)]).astype(np.uint64)
    size = block.end - block.start
    last = np.zeros(len(h), np.uint64)
    for j in range(3):
        at = np.maximum(block.end - 1 - j, 0)
        last |= np.where(size > j, data[at], U(0)) << U(8 * j)
    shape = tokens.mix(last) >> U(64 - SHAPE_BITS)
    return (h & ~U(SHAPES - 1)) | shape


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of word keys."""
    powers, waiting, held = tokens.powers(), [], 0

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    for batch in batches:
        for block in tokens.words(batch.column(0)):
            waiting.append(word_keys(block, block.hashes(powers)))
            held += len(waiting[-1])
            if held > 2 * FLUSH:
                yield flush()
                waiting, held = [], 0
    if held:
        yield flush()


@dataclass
class Vocabulary:
    """What travels: sorted frequent keys with their symbols and counts, class totals, and the base's sums."""

    keys: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    shape_tokens: np.ndarray
    shape_unknown: np.ndarray
    ends: int
    total: int
    distinct: int

    @property
    def width(self) -> int:
        return 1 + FREQUENT + SHAPES

    def share(self) -> np.ndarray:
        """Share of each symbol in the training texts."""
        n = np.zeros(self.width)
        n[END], n[self.symbols], n[1 + FREQUENT :] = self.ends, self.counts, self.shape_tokens
        return n / max(n.sum(), 1)

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each key among the frequent ones, and whether it is one."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.distinct + 1))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Summary of the counted words; ``ends`` is the number of training texts."""
    size = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()  # fixed size
    shape = F.col("key").bitwiseAND(F.lit(SHAPES - 1)).alias("shape")
    by_shape = counts.groupBy(shape).agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    tokens_of, once = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in by_shape:  # one row per shape
        tokens_of[r["shape"]], once[r["shape"]] = r["n"], r["once"]
    np.subtract.at(tokens_of, (keys & U(SHAPES - 1)).astype(np.int64), n)
    np.subtract.at(once, (keys & U(SHAPES - 1)).astype(np.int64), n == 1)
    order = np.argsort(keys)
    unknown = (once + 0.5) / (tokens_of + 1.0)
    total = (size[0] or 0) + ends
    return Vocabulary(keys[order], 1 + order, n[order], tokens_of, np.where(tokens_of > 0, unknown, 1.0), ends, total, size[1] + (ends > 0))


def _encode(v: Vocabulary):
    """Symbols of a text with its end, the keys of its rare words, and its sums over the rest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, end_base = tokens.powers(), float(v.base(np.array([v.ends]))[0])
        for batch in batches:
            done = 0
            for block in tokens.words(batch.column(batch.schema.get_field_index("_text"))):
                keys = word_keys(block, block.hashes(powers))
                at, known = v.place(keys)
                shape = (keys & U(SHAPES - 1)).astype(np.int64)
                symbol = np.where(known, v.symbols[at] if len(v.keys) else 0, 1 + FREQUENT + shape).astype(np.uint16)
                base = np.where(known, v.base(v.counts[at]) if len(v.keys) else 0.0, 0.0)
                sums, hits = np.concatenate([[0], np.cumsum(base)]), np.concatenate([[0], np.cumsum(known)])
                rare = ~known
                ends = np.searchsorted(np.flatnonzero(rare), block.bounds).astype(np.int32)
                n = block.counts()
                rows = [symbol[a:b].tobytes() + b"\0\0" for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)]
                own = [batch.column(i).slice(done, len(block)) for i in range(batch.num_columns - 1)]
                columns = [
                    pa.array(rows, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[rare].view(np.int64))),
                    pa.array(n + 1),
                    pa.array(hits[block.bounds[1:]] - hits[block.bounds[:-1]] + int(v.ends > 0)),
                    pa.array(sums[block.bounds[1:]] - sums[block.bounds[:-1]] + end_base),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*own, *columns], [*batch.schema.names[:-1], "symbols", "rare", "n_tokens", "n_known", "base"]
                )
                done += len(block)

    return encode


@dataclass
class States:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def _estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> States:
    """Probabilities from expected counts; emissions are smoothed towards the overall share of a symbol."""
    share = (emit.sum(1) + 0.01) / (emit.sum() + 0.01 * len(emit))
    smooth = emit + PRIOR * share[:, None]
    from_start, from_state = start + 1, move + 1
    return States(
        from_start / from_start.sum(), from_state / from_state.sum(1, keepdims=True), smooth / smooth.sum(0, keepdims=True)
    )


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # starts, moves, emissions, log likelihood


def _by_time(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """All first symbols, then all second ones and so on: symbols, their texts, texts of each step, and borders.

    Within a step the texts, numbered by falling length, keep their order, so those that go on come first.
    """
    counts = np.array([len(s) for s in symbols])
    order = np.argsort(-counts, kind="stable")
    counts = counts[order]
    active = np.searchsorted(-counts, -np.arange(1, int(counts[0]) + 1), "right")
    border = np.concatenate([[0], np.cumsum(active)])
    rank = np.repeat(np.arange(len(counts)), counts)
    at = border[np.arange(len(rank)) - np.repeat(np.cumsum(counts) - counts, counts)] + rank
    flat, text = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    flat[at], text[at] = np.concatenate([symbols[i] for i in order]), order[rank]
    return flat, text, active.tolist(), border.tolist()


def expected(model: States, symbols: list[np.ndarray]) -> Counts:
    """Expected counts of starts, moves and emissions over whole texts, and their log likelihood: one E-step.

    Every step is scaled, so single precision holds all ratios; sums over texts are taken in double precision.
    """
    flat, _, active, border = _by_time(symbols)
    move, k = model.move.astype(np.float32), len(model.start)
    onward, ones = np.ascontiguousarray(move.T), np.ones(k, np.float32)
    emit = np.ascontiguousarray(model.emit.T, np.float32).take(flat, axis=1)
    alpha, scale = np.empty_like(emit), np.empty(len(flat), np.float32)
    for t, n in enumerate(active):
        here = slice(border[t], border[t + 1])
        a, s = alpha[:, here], scale[here]
        if t:
            np.matmul(onward, before[:, :n], out=a)
        else:
            a[:] = model.start[:, None]
        a *= emit[:, here]
        np.matmul(ones, a, out=s)
        a /= s
        before = a
    emit /= scale
    # alpha becomes the share of the states, from the last step to the first
    moves, ahead = np.zeros((k, k)), np.ones((k, active[0]), np.float32)
    for t in range(len(active) - 1, 0, -1):
        n, here = active[t], slice(border[t - 1], border[t])
        back, before = emit[:, border[t] : border[t + 1]], alpha[:, here]
        back *= ahead[:, :n]
        moves += before[:, :n] @ back.T
        np.matmul(move, back, out=ahead[:, :n])
        before *= ahead[:, : active[t - 1]]
    emitted = np.stack([np.bincount(flat, share, len(model.emit)) for share in alpha], 1)
    likelihood = np.log(scale).sum(dtype=float, keepdims=True)
    return alpha[:, : active[0]].sum(1, dtype=float), moves * model.move, emitted, likelihood


def log_likelihood(model: States, symbols: list[np.ndarray]) -> np.ndarray:
    """Exact natural log likelihood of each whole sequence by the scaled forward recursion."""
    flat, text, active, border = _by_time(symbols)
    onward, ones = np.ascontiguousarray(model.move.T), np.ones(len(model.start))
    emit, scale = np.ascontiguousarray(model.emit.T).take(flat, axis=1), np.empty(len(flat))
    for t, n in enumerate(active):
        here = slice(border[t], border[t + 1])
        a, s = emit[:, here], scale[here]
        a *= onward @ before[:, :n] if t else model.start[:, None]
        np.matmul(ones, a, out=s)
        a /= s
        before = a
    return np.bincount(text, np.log(scale), len(symbols))


def _pack(parts: Counts) -> bytes:
    return zlib.compress(np.concatenate([p.ravel() for p in parts]).astype(np.float64).tobytes(), 1)


def _unpack(packed: bytes, states: int) -> Counts:
    flat = np.frombuffer(zlib.decompress(packed))
    start, move, emit, rest = np.split(flat, [states, states * (states + 1), len(flat) - 1])
    return start, move.reshape(states, states), emit.reshape(-1, states), rest


def _add(x: bytes, y: bytes) -> bytes:
    if not x or not y:
        return x or y
    return zlib.compress((np.frombuffer(zlib.decompress(x)) + np.frombuffer(zlib.decompress(y))).tobytes(), 1)


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Positions and symbols of all texts, those of similar length together, about ``GROUP`` symbols at a time."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // 2
    order = np.argsort(-size, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // GROUP)) + 1):
        if len(at):
            yield at, [np.frombuffer(column[i].as_buffer(), np.uint16) for i in at.tolist()]


def _summed(encoded: DataFrame, counts: Callable[[list[np.ndarray]], Counts], states: int) -> Counts | None:
    """Sums of ``counts`` over the column ``symbols`` of all rows; nothing without a row."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, rows in _groups(batch.column(0)):
                found = counts(rows)
                total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(total)], pa.binary())], ["counts"])

    parts = encoded.select("symbols").mapInArrow(add_up, "counts binary").rdd.map(lambda r: bytes(r[0]))
    total = parts.treeAggregate(b"", _add, _add, 3)
    return _unpack(total, states) if total else None


def _dealt(directions: np.ndarray, states: int) -> Callable[[list[np.ndarray]], Counts]:
    """Counts of the start: each text wholly in the state whose direction its symbols add up to the most in."""

    def counts(rows: list[np.ndarray]) -> Counts:
        flat, size, width = np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows]), len(directions)
        state = np.add.reduceat(directions[flat], np.cumsum(size) - size, axis=0).argmax(1)
        emitted = np.bincount(flat + width * np.repeat(state, size), minlength=width * states).astype(float)
        start = np.bincount(state, minlength=states).astype(float)
        return start, np.zeros((states, states)), emitted.reshape(states, width).T, np.zeros(1)

    return counts


def train(encoded: DataFrame, v: Vocabulary, states: int = STATES, seed: int = 3) -> States:
    """Baum-Welch over the column ``symbols`` of all rows, until a pass gains less than ``TOLERANCE``."""
    directions = np.random.default_rng(seed).normal(size=(v.width, states))
    directions = (directions - v.share() @ directions).astype(np.float32)
    first = _summed(encoded, _dealt(directions, states), states)
    if first is None:
        return _estimate(np.ones(states), np.eye(states), np.ones((v.width, states)))
    model, before = _estimate(np.zeros(states), STAY * np.eye(states), first[2]), -np.inf
    while True:
        *counts, likelihood = _summed(encoded, partial(expected, model), states)
        model = _estimate(*counts)
        if not likelihood[0] - before > TOLERANCE * abs(likelihood[0]):
            return model
        before = likelihood[0]


def score(docs: DataFrame, train_rows: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``train_rows``, n_tokens, n_known, train_tokens, base_score and score (log10).

    Rows whose boolean column ``train_rows`` is true are learned from; null counts as false.
    """
    own = docs.select(
        F.col(f"`{id}`").alias("_id"),
        F.coalesce(F.col(f"`{train_rows}`"), F.lit(False)).alias("_train"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
    )
    learned = own.filter("_train")
    counts = cut(learned.select("_text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    v = vocabulary(counts, learned.count())
    kind = own.schema["_id"].dataType.simpleString()
    layout = f"_id {kind}, _train boolean, symbols binary, rare array<long>, n_tokens long, n_known long, base double"
    encoded = cut(own.mapInArrow(_encode(v), layout).withColumn("_row", F.monotonically_increasing_id()))
    model = train(encoded.filter("_train"), v)

    @F.arrow_udf("double")
    def likelihood(symbols: pa.Array) -> pa.Array:
        found = np.zeros(len(symbols))
        for at, rows in _groups(symbols):
            found[at] = log_likelihood(model, rows)
        return pa.array(found / np.log(10))

    classes = docs.sparkSession.createDataFrame(
        [(i, float(v.shape_tokens[i]), float(v.shape_unknown[i])) for i in range(SHAPES)],
        "shape int, tokens double, unknown double",
    )
    # word by word: its count decides the base's term and its share within its shape
    shape = F.col("key").bitwiseAND(F.lit(SHAPES - 1)).cast("int")
    total = float(v.total + v.distinct + 1)
    rare = encoded.select("_row", F.explode("rare").alias("key")).join(counts, "key", "left").withColumn("shape", shape)
    known = F.col("n").isNotNull()
    inside = F.when(known, (1 - F.col("unknown")) * F.col("n") / F.col("tokens")).otherwise(F.col("unknown"))
    sums = (
        rare.join(F.broadcast(classes), "shape")
        .groupBy("_row")
        .agg(
            F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(total))).alias("_base"),
            F.sum(F.log10(inside)).alias("_inside"),
            F.count("n").alias("_known"),
        )
    )
    own = encoded.withColumn("_likelihood", likelihood(F.col("symbols"))).drop("symbols", "rare").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.select(
        F.col("_id").alias(id),
        F.col("_train").alias(train_rows),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_base")).alias("base_score"),
        (F.col("_likelihood") + zero("_inside")).alias("score"),
    )
