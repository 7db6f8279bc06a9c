"""Language identification by a linear-chain conditional random field over words.

A word's features are its hashed affixes (two and three bytes at either end), its inner three-byte
grams and the word itself as a lexicon entry; they share one weight table of ``2**FEATURE_BITS`` rows.
Label scores of neighbouring words are tied by learned transitions. Forward-backward gives every
word its label probabilities, so code-switched texts are labelled word by word; a document's language
is the one with the largest summed probability, and its score is that sum's share.

Chains are passages of up to ``CHAIN`` consecutive words; all words of a text are labelled. Weights
are fitted by conditional likelihood on a bounded sample: ``DOCS`` texts of at most ``LONGEST`` bytes for
each language, chosen by a hash of the id, of which ``PIECES`` evenly spread pieces of ``PIECE`` words are
joined across texts, so that transitions are learned from real switches.

A text that is null or has no letter is ``und`` with score 0. Null labels are not learned from; without
any label everything is ``und``. Repeated rows are labelled alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm import tokens

FEATURE_BITS = 16
CHAIN = 256
DOCS, LONGEST, PIECES, PIECE, JOINED = 300, 64_000, 6, 24, 4
EPOCHS, RATE, RIDGE = 60, 0.05, 1e-6
UNKNOWN = "und"
NOT_LETTERS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
KIND = "struct<lang:string,score:double>"
U = np.uint64


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray


def _slots(values: np.ndarray, salt: int) -> np.ndarray:
    return (tokens.mix(values * U(0x9E3779B97F4A7C15) + U(salt)) >> U(64 - FEATURE_BITS)).astype(np.int64)


def word_features(block: tokens.Words, h: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Slots of a word's affixes and lexicon entry, and slots and words of all inner grams."""
    data = np.concatenate([block.data, np.zeros(3, np.uint8)]).astype(np.uint64)
    three = data[:-2] | data[1:-1] << U(8) | data[2:] << U(16)
    start, end = block.start, block.end
    size = end - start
    two_first = np.where(size >= 2, three[start] & U(0xFFFF), data[start])
    two_last = np.where(size >= 2, three[np.maximum(end - 2, 0)] & U(0xFFFF), data[start])
    three_first = np.where(size >= 3, three[start], two_first)
    three_last = np.where(size >= 3, three[np.maximum(end - 3, 0)], two_last)
    own = [_slots(v, salt) for salt, v in enumerate((two_first, two_last, three_first, three_last, h), 1)]
    inner = np.maximum(size - 2, 0)
    word = np.repeat(np.arange(len(start)), inner)
    at = np.arange(len(word)) - np.repeat(np.cumsum(inner) - inner, inner) + np.repeat(start, inner)
    return np.stack(own, 1), (_slots(three[at], 6), word)


def emissions(weights: np.ndarray, features: tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label scores of each word: the sum of its features' weights."""
    own, (slots, word) = features
    total = weights[own[:, 0]].astype(float)
    for j in range(1, own.shape[1]):
        total += weights[own[:, j]]
    for k in range(weights.shape[1]):
        total[:, k] += np.bincount(word, weights[slots, k], len(total))
    return total


def forward_backward(scores: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of padded chains, longest first, and the expected count of each transition.

    ``scores`` is time x chain x label; every step is scaled to sum one.
    """
    steps, _, labels = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    move = np.exp(moves)
    active = [int((length > t).sum()) for t in range(steps)]
    alpha, beta = np.zeros_like(emit), np.ones_like(emit)
    pairs = np.zeros((labels, labels))
    for t in range(steps):
        n = active[t]
        a = emit[t, :n] * (alpha[t - 1, :n] @ move if t else 1.0)
        alpha[t, :n] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = emit[t + 1, :n] * beta[t + 1, :n]
        b = ahead @ move.T
        scale = (alpha[t, :n] * b).sum(1, keepdims=True)
        pairs += (alpha[t, :n] / scale).T @ ahead * move
        beta[t, :n] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both / np.maximum(both.sum(2, keepdims=True), 1e-300), pairs


def _chains(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the passages of every text, longest first."""
    counts = np.diff(bounds)
    parts = -(-counts // most)
    first = np.repeat(bounds[:-1], parts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first + step * most
    length = np.minimum(np.repeat(bounds[1:], parts) - start, most)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def label_words(model: Model, block: tokens.Words, h: np.ndarray) -> np.ndarray:
    """Probability of each language for each word of a block."""
    scores = emissions(model.weights, word_features(block, h))
    start, length = _chains(block.bounds, CHAIN)
    out = np.zeros_like(scores)
    if len(start):
        at = start[None, :] + np.arange(length[0])[:, None]
        inside = np.arange(length[0])[:, None] < length[None, :]
        found, _ = forward_backward(scores[np.minimum(at, len(scores) - 1)], length, model.moves)
        out[at[inside]] = found[inside]
    return out


def _training_chains(texts: list[tuple[str, int]]) -> list[tuple[tokens.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of words with labels: block, hashes, word positions and labels."""
    powers, out, first = tokens.powers(), [], 0
    labels = np.array([k for _, k in texts])
    for block in tokens.words(pa.array([t for t, _ in texts], pa.large_string()), NOT_LETTERS):
        h, at, kind = block.hashes(powers), [], []
        for i, n in enumerate(block.counts().tolist()):
            for p in range(min(PIECES, -(-n // PIECE))):
                low = 0 if n <= PIECES * PIECE else (n - PIECE) * p // (PIECES - 1)
                low = p * PIECE if n <= PIECES * PIECE else low
                at.append(np.arange(low, min(low + PIECE, n)) + block.bounds[i])
                kind.append(np.full(len(at[-1]), labels[first + i]))
        first += len(block)
        out.append((block, h, at, kind))
    return out


def _fit(texts: list[tuple[str, int]], langs: list[str], seed: int = 7) -> Model:
    """Conditional likelihood by Adam over joined pieces."""
    random, k = np.random.default_rng(seed), len(langs)
    own, gram_slot, gram_word, pieces, truth, base = [], [], [], [], [], 0
    for block, h, at, kind in _training_chains(texts):
        features, (slots, word) = word_features(block, h)
        keep = np.zeros(len(features), bool)
        for a in at:
            keep[a] = True
        place = np.cumsum(keep) - 1 + base
        own.append(features[keep])
        gram_slot.append(slots[keep[word]])
        gram_word.append(place[word[keep[word]]])
        pieces += [place[a] for a in at]
        truth += kind
        base += int(keep.sum())
    order = random.permutation(len(pieces))
    chains = [order[i : i + JOINED] for i in range(0, len(order), JOINED)]
    chains = sorted(([np.concatenate([pieces[j] for j in c]), np.concatenate([truth[j] for j in c])] for c in chains), key=lambda c: -len(c[0]))
    length = np.array([len(c[0]) for c in chains])
    at, kind = np.zeros((length[0], len(chains)), np.int64), np.zeros((length[0], len(chains)), np.int64)
    for j, (a, y) in enumerate(chains):
        at[: len(a), j], kind[: len(a), j] = a, y
    inside = np.arange(length[0])[:, None] < length[None, :]
    both = inside[1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (kind[:-1][both], kind[1:][both]), 1)
    features = np.concatenate(own), (np.concatenate(gram_slot), np.concatenate(gram_word))
    target, size = np.zeros((base, k)), float(inside.sum())
    target[at[inside], kind[inside]] = 1
    params = [np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k))]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for epoch in range(1, EPOCHS + 1):
        found, pairs = forward_backward(emissions(params[0], features)[at], length, params[1])
        error = np.zeros((base, k))
        error[at[inside]] = found[inside]
        error -= target
        slope = np.zeros_like(params[0])
        for label in range(k):
            for j in range(features[0].shape[1]):
                slope[:, label] += np.bincount(features[0][:, j], error[:, label], len(slope))
            slope[:, label] += np.bincount(features[1][0], error[features[1][1], label], len(slope))
        for p, s, g in zip(params, state, (slope / size + RIDGE * params[0], (pairs - seen) / size), strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p -= RATE * s[0] / (1 - 0.9**epoch) / (np.sqrt(s[1] / (1 - 0.99**epoch)) + 1e-10)
    return Model(langs, params[0].astype(np.float32), params[1])


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of the rows of ``docs`` with a language."""
    own = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    usable = own.filter(F.col("_lang").isNotNull() & (F.octet_length("_text") <= LONGEST))
    langs = sorted(r[0] for r in usable.select("_lang").distinct().collect())  # the labels themselves
    by, texts = F.xxhash64(F.col("_id").cast("string")), []
    for i, name in enumerate(langs):
        ids = usable.filter(F.col("_lang") == name).select("_id").distinct().orderBy(by, "_id").limit(DOCS)
        chosen = usable.filter(F.col("_lang") == name).join(F.broadcast(ids), "_id").dropDuplicates(["_id"])
        texts += [(r[0], i) for r in chosen.orderBy(by, "_id").select("_text").collect()]  # at most DOCS rows
    if not any(t for t, _ in texts):
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)))
    return _fit(texts, langs)


def detect(model: Model, texts: pa.Array) -> pa.Array:
    """Language and score of each text."""
    powers, names, scores = tokens.powers(), [], []
    for block in tokens.words(texts, NOT_LETTERS):
        counts = block.counts()
        if not model.langs or not len(block.start):
            names += [UNKNOWN] * len(block)
            scores += [0.0] * len(block)
            continue
        found = label_words(model, block, block.hashes(powers))
        total = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found, 0)])
        total = (total[block.bounds[1:]] - total[block.bounds[:-1]]) / np.maximum(counts, 1)[:, None]
        plain = np.concatenate([[0], np.cumsum((block.data >= 97) & (block.data <= 122))])
        ascii_letters = plain[block.place[1:]] - plain[block.place[:-1]]
        for i, best in enumerate(total.argmax(1).tolist()):
            raw = b"" if ascii_letters[i] or not counts[i] else block.data[block.place[i] : block.place[i + 1]].tobytes()
            known = counts[i] > 0 and (ascii_letters[i] > 0 or any(c.isalpha() for c in raw.decode("utf-8", "ignore")))
            names.append(model.langs[best] if known else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, total[i, best]))) if known else 0.0)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])


def language(model: Model, text: Column) -> Column:
    """Struct of ``lang`` and ``score`` of a text."""

    @F.arrow_udf(KIND)
    def found(texts: pa.Array) -> pa.Array:
        return detect(model, texts)

    return found(text.cast("string"))

