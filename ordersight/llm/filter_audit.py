"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Each document becomes a truth-table word of 32 bits: bit S tells whether it survives the set S of filters
(bit k of S stands for filter k). Words are counted by position within part and label class: carry-save
adders fold three words into a sum and a carry word until one word of each weight is left, so a task
emits 32 counts per part and class, whatever number of documents it has. All figures of all 120 orders
follow from these survivors of subsets, as differences between neighbouring subsets.

Four filters look at one text. The fifth fails a text that equals the text of a smaller id: the least id of
each distinct text (by its sha256) is joined back by id, not by text, so a large group of copies is
pre-aggregated and never one task. Only ids, digests and five bits are shuffled; labels come along the same id.

A null text is an empty text, a null source the empty part. A row without an id has no smaller or larger
ids: it never fails the fifth filter, makes no other row fail, and has no labels. Rows that share an id and a text fail
alike. Several labels of one id count if one of them marks it. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.session import cut

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # per cent of the words
MOST_CAPITALS = 5  # per cent of the code points
SYMBOLS = "#$%&*|"
SUBSETS = 1 << len(FILTERS)
CLASSES = ("all", "good", "toxic")


def failures(text: str) -> int:
    """Bits 0 to 3: whether the text fails filter A, B, C or D."""
    data = text.encode()
    words = data.split()  # bytes split at 20 and 09 to 0D only
    capitals = sum(map(data.count, CAPITALS))
    return (
        int(len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * len(text)) << 2
        | any(symbol in text for symbol in SYMBOLS) << 3
    )


CAPITALS = [bytes([c]) for c in range(ord("A"), ord("Z") + 1)]


def judged(text: Column) -> Column:
    """``failures`` of a column of texts without nulls."""

    @F.arrow_udf("int")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([failures(one) for one in texts.to_pylist()], pa.int32())

    return judge(text)


def word(failed: int) -> int:
    """Truth-table word of a document that fails the filters ``failed``."""
    return sum(1 << subset for subset in range(SUBSETS) if not subset & failed)


WORDS = np.array([word(failed) for failed in range(SUBSETS)], np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save addition.

    A full adder turns three words of one weight into a word of that weight and one of twice the weight,
    bit by bit; what cannot be grouped by three is added by a half adder.
    """
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 1:
            third = len(words) // 3
            if third:
                a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
                either = a ^ b
                carries.append(a & b | c & either)
                words = np.concatenate([either ^ c, words[3 * third :]])
            else:
                carries.append(words[:1] & words[1:])
                words = words[:1] ^ words[1:]
        counts += weight * (words[0] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


LAYOUT = "part string, class string, survivors array<long>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of every subset by part and class, for each batch of ``part, failed, good, toxic``."""
    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        part = parts.indices.to_numpy()
        words = WORDS[batch.column(1).to_numpy()]
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=len(parts.dictionary)))
        marks = [np.ones(len(part), bool), *[batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]]
        rows = []
        for name, high, low in zip(parts.dictionary.to_pylist(), ends, [0, *ends], strict=False):
            own = order[low:high]
            for label, mark in zip(CLASSES, marks, strict=True):
                rows.append((name, label, positional_counts(words[own[mark[own]]])))
        columns = [pa.array(column) for column in zip(*[row[:2] for row in rows], strict=True)] if rows else [[], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array([list(r[2]) for r in rows], pa.list_(pa.int64()))],
            ["part", "class", "survivors"],
        )


def survivors(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, class, survivors``: how many documents survive each subset of the filters (position S for subset S)."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    read = cut(
        docs.select(
            F.col(f"`{id}`").alias("id"),
            F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
            judged(whole).alias("failed"),
        )
    )
    named = read.filter("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col(f"`{id}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    later = F.when(F.col("first").isNull() & F.col("id").isNotNull(), 16).otherwise(0)
    joined = read.join(marks, "id", "left").join(first, ["id", "digest"], "left")
    rows = joined.select(
        "part",
        F.col("failed").bitwiseOR(later).alias("failed"),
        F.coalesce("good", no).alias("good"),
        F.coalesce("toxic", no).alias("toxic"),
    )
    counted = rows.mapInArrow(_counted, LAYOUT)
    sums = counted.groupBy("part", "class").agg(*[F.sum(F.get("survivors", F.lit(s))).alias(f"s{s}") for s in range(SUBSETS)])
    return sums.select("part", "class", F.array(*[f"s{s}" for s in range(SUBSETS)]).alias("survivors"))


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see the module for the counts."""
    table = survivors(docs, labels, id, text, part)
    each = [F.max(F.when(F.col("class") == label, F.col("survivors"))).alias(label) for label in CLASSES]
    table = table.groupBy("part").agg(*each)
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    rows = table.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    at = {letter: F.instr("filter_order", letter) for letter in FILTERS}

    def bits(chosen) -> Column:
        return sum((F.when(chosen(at[x]), F.lit(1 << k)).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))

    rows = rows.select("*", bits(lambda p: p < F.col("step")).alias("before"), bits(lambda p: p == F.col("step")).alias("own"))
    left = lambda label, subset: F.get(F.col(label), subset)
    both, rest = F.col("before") + F.col("own"), F.lit(SUBSETS - 1) - F.col("own")
    lost = lambda label: left(label, F.col("before")) - left(label, both)
    rows = rows.select(
        "part",
        "filter_order",
        "step",
        "own",
        left("all", both).alias("kept"),
        lost("all").alias("removed"),
        (left("all", F.lit(0)) - left("all", F.col("own")) - lost("all")).alias("redundant"),
        (left("all", rest) - left("all", F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        "all",
    )
    return rows.withColumn("shapley", _over_orders(F.col("all"), F.col("own"))).drop("own", "all")


def _over_orders(table: Column, own: Column) -> Column:
    """Removals of the filter with bit ``own``, summed over all orders: each set of earlier filters has
    as many orders as there are ways to arrange it and those that follow."""
    ways = [1, 1, 2, 6, 24]
    terms = []
    for before in range(SUBSETS):
        size = before.bit_count()
        if size < len(FILTERS):
            removed = F.get(table, F.lit(before)) - F.get(table, F.lit(before).bitwiseOR(own))
            terms.append(F.when(F.lit(before).bitwiseAND(own) == 0, removed * (ways[size] * ways[4 - size])).otherwise(0))
    return sum(terms[1:], terms[0])


def twin_sql() -> str:
    """The audit in SQL: every document of every part, filter by filter."""
    letters = ", ".join(f"('{x}', {k})" for k, x in enumerate(FILTERS))
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, {word}) AS w FROM texts
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < {LEAST_WORDS})::INT
    + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY t), false)::INT AS failed
  FROM split s LEFT JOIN marks USING (doc_id)
), letters(x, k) AS (VALUES {letters}
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE (1 << a.k) + (1 << b.k) + (1 << c.k) + (1 << d.k) + (1 << e.k) = 31
    AND (1 << a.k) | (1 << b.k) | (1 << c.k) | (1 << d.k) | (1 << e.k) = 31
), steps AS (
  SELECT filter_order, step, 1 << k AS own,
    coalesce((SELECT sum(1 << l.k) FROM letters l WHERE instr(filter_order, l.x) < step), 0)::INT AS before
  FROM orders, unnest([1, 2, 3, 4, 5]) AS u(step), letters WHERE x = filter_order[step]
), grouped AS (
  SELECT part, failed, good, toxic, count(*) AS c FROM masks GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(c) FILTER (failed & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(c) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(c) FILTER (failed & before > 0 AND failed & own > 0), 0)::BIGINT AS redundant,
    coalesce(sum(c) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(c) FILTER (failed & before = 0 AND failed & own > 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(c) FILTER (failed & before = 0 AND failed & own > 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM steps, grouped GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
