"""Toxicity by compression distance with two zstandard dictionaries.

Training finds the byte runs that tell the classes apart: five-byte grams inside words whose share of
all words is higher in one class than in the other, so that a run that ordinary texts hold now and
then still marks texts full of it. Each class's runs are the text on which its own zstandard
dictionary is trained; text equally common in both is in neither dictionary. A class without such
runs, or with too few to train on, falls back on its commonest words or runs as raw content, with a
warning. Every window of about ``WINDOW`` bytes of whole words is then compressed with both, and the
difference of the two lengths is compared with a ladder of thresholds on both sides of zero. A window
starts with a fixed carrier that both dictionaries hold, so that a block of sequences pays off and one
matched word shows in the length. A logistic curve, fitted on labelled texts that the dictionaries have
not seen, turns the mean difference and the counts and shares of windows above each threshold into a
probability. How much commoner a toxic run must be is settled by the same texts: of ``CONTRASTS`` the
one with the smallest cross-validated loss.

Fitting uses a bounded sample: up to ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` labelled texts of at most
``LONGEST`` bytes, chosen by a hash of the id. Scoring is one narrow pass over whole texts.

A null, empty or wordless text has no windows and gets the score of a text without any hit. Without
labelled texts of both classes every score is the share of toxic labels (0 without labels). Rows with
null labels or ids are not learned from. Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm import tokens

WINDOW = 24
GRAM = 5
DICT_BYTES = 2048
MOST_RUNS = 300
CARRIER = bytes(range(0x80, 0x98))
LADDER = (-4, -3, -2, -1, 1, 2, 3, 4, 5, 6)
TOXIC_DOCS, ORDINARY_DOCS, LONGEST = 2500, 5000, 64_000
LEAST_DOCS, LEAST_SHARE = 5, 0.005
CONTRASTS, ORDINARY_CONTRAST = (20.0, 12.0, 8.0, 5.0), 4.0


def windows(block: tokens.Words) -> tuple[list[bytes], np.ndarray]:
    """Windows of whole words, each with a space on both sides, and how many each text has."""
    if not len(block.start):
        return [], np.zeros(len(block), np.int64)
    text = np.searchsorted(block.bounds, np.arange(len(block.start)), "right") - 1
    bin_ = (block.start - block.place[text]) // WINDOW
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (bin_[1:] != bin_[:-1])]))
    low, high = block.start[first], block.end[np.concatenate([first[1:], [len(block.start)]]) - 1]
    raw = block.data.tobytes()
    parts = [b"%b %b " % (CARRIER, raw[s:e]) for s, e in zip(low.tolist(), high.tolist(), strict=True)]
    return parts, np.bincount(text[first], minlength=len(block))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        compression_level=3,
        strategy=zstandard.STRATEGY_LAZY,
        min_match=GRAM,
        window_log=17,
        hash_log=15,
        chain_log=15,
        search_log=3,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


def lengths(with_: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    """Compressed length of each part."""
    if not parts:
        return np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in parts], np.uint64)
    places = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes)[:-1]])
    stacked = zstandard.BufferWithSegments(b"".join(parts), np.stack([places, sizes], 1).tobytes())
    return np.array([len(x) for x in with_.multi_compress_to_buffer(stacked, threads=0)], np.int64)


def _grams(word: bytes) -> list[bytes]:
    padded = b" " + word
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


@dataclass
class Frequencies:
    """Grams of a class: texts that hold them, times they occur, and the words of the class."""

    texts: Counter
    times: Counter
    words: int


def _frequencies(texts: list[list[bytes]]) -> Frequencies:
    found = Frequencies(Counter(), Counter(), sum(map(len, texts)))
    for text in texts:
        seen = set()
        for word, n in Counter(text).items():
            for gram in _grams(word):
                found.times[gram] += n
                seen.add(gram)
        found.texts.update(seen)
    return found


def _runs(word: bytes, wanted: set[bytes]) -> list[bytes]:
    """Maximal stretches of a word that wanted grams cover."""
    padded, out = b" " + word, []
    for i in range(len(padded) - GRAM + 1):
        if padded[i : i + GRAM] in wanted:
            if out and i <= out[-1][1]:
                out[-1][1] = i + GRAM
            else:
                out.append([i, i + GRAM])
    return [padded[a:b] for a, b in out]


def train_dictionary(texts: list[list[bytes]], own: Frequencies, other: Frequencies, contrast: float) -> bytes:
    """zstandard dictionary of the runs that mark ``texts`` against the other class."""
    least = max(LEAST_DOCS, LEAST_SHARE * len(texts))
    share = lambda gram: (other.times[gram] + 1) / max(1, other.words)
    wanted = {g for g, n in own.texts.items() if n >= least and own.times[g] / own.words > contrast * share(g)}
    found = [[run for word in text for run in _runs(word, wanted)] for text in texts]
    if not any(found):
        warnings.warn("no runs mark a class of texts; its dictionary is trained on all of its words", stacklevel=2)
        found = [[b" " + word for word in text] for text in texts]
    samples = [b"\n".join(runs) + b"\n" for runs in found if runs]
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError as problem:
        warnings.warn(f"too little text to train a dictionary on ({problem}); it holds raw runs only", stacklevel=2)
        trained = b""
    common = [run for run, _ in Counter(run for runs in found for run in runs).most_common(MOST_RUNS)]
    return trained + b"\n".join(reversed(common)) + CARRIER


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    constant: float | None = None


def measures(model: Model, texts: pa.Array) -> np.ndarray:
    """Per text and threshold logs of the count and of the share of windows at or above it; their mean and their number."""
    with_toxic, with_ordinary = compressor(model.toxic), compressor(model.ordinary)
    out = []
    for block in tokens.words(texts):
        parts, counts = windows(block)
        gain = lengths(with_ordinary, parts) - lengths(with_toxic, parts)
        text = np.repeat(np.arange(len(block)), counts)
        columns = []
        for t in LADDER:
            hits = np.bincount(text[gain >= t], minlength=len(block))
            columns += [np.log1p(hits), np.log1p(100 * hits / np.maximum(counts, 1))]
        mean = np.bincount(text, gain, minlength=len(block)) / np.maximum(counts, 1)
        out.append(np.stack([*columns, mean, np.log1p(counts), np.ones(len(block))], 1))
    return np.concatenate(out) if out else np.zeros((0, 2 * len(LADDER) + 3))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the last column, the constant, is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    """Two-fold cross-validated log loss of the curve; rows of both classes alternate between the folds."""
    fold, loss = np.zeros(len(y), bool), 0.0
    for kind in (0.0, 1.0):
        fold[np.flatnonzero(y == kind)[::2]] = True
    for fit, test in ((fold, ~fold), (~fold, fold)):
        at = np.clip(x[test] @ _logistic(x[fit], y[fit]), -30, 30)
        loss += float(np.logaddexp(0, np.where(y[test] == 1, -at, at)).sum())
    return loss


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit dictionaries and curve on a bounded sample of the labelled rows of ``docs``."""
    named = labels.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).dropna()
    own = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    sized = own.select("_id", F.octet_length("_text").alias("_size")).filter(f"_size > 0 and _size <= {LONGEST}")
    joined = sized.join(named, "_id").select("_id", "_label").distinct()
    by, rows = F.xxhash64(F.col("_id").cast("string")), []
    for kind, most in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS)):
        chosen = joined.filter(F.col("_label") == kind).orderBy(by, "_id").limit(most)
        texts = own.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).orderBy(by, "_id").select("_text")
        rows.append([r[0] for r in texts.collect() if r[0]])  # at most the sample's bound
    if not rows[0] or not rows[1]:
        return Model(b"", b"", np.zeros(0), float(bool(rows[0])))
    # every fourth text is kept from the dictionaries for the curve
    halves = [([t for i, t in enumerate(r) if i % 4], [t for i, t in enumerate(r) if i % 4 == 0]) for r in rows]
    split = [[t.encode().lower().split() for t in part[0]] for part in halves]
    counts = [_frequencies(texts) for texts in split]
    held = pa.array([*halves[0][1], *halves[1][1]], pa.large_string())
    truth = np.array([1.0] * len(halves[0][1]) + [0.0] * len(halves[1][1]))
    ordinary = train_dictionary(split[1], counts[1], counts[0], ORDINARY_CONTRAST)
    best, least = None, np.inf
    for contrast in CONTRASTS:
        model = Model(train_dictionary(split[0], counts[0], counts[1], contrast), ordinary, np.zeros(0))
        x = measures(model, held)
        loss = _loss(x, truth)
        if best is None or loss < least:
            model.weights = _logistic(x, truth)
            best, least = model, loss
    return best


def score(model: Model, text: Column) -> Column:
    """Probability, from 0 to 1, that a text is toxic."""
    if model.constant is not None:
        return F.lit(model.constant)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(measures(model, texts) @ model.weights, -30, 30))))

    return probability(text.cast("string"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Only the rows whose score stays below ``threshold``, with their columns unchanged."""
    scored = docs.withColumn("_toxicity", score(model, F.col(f"`{text}`")))
    return scored.filter(F.col("_toxicity") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
