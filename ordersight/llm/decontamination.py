"""Benchmark decontamination by a prefix-filtered set join of documents with benchmark windows.

A window is ``WINDOW`` consecutive words of an item (the whole item if it has fewer). Windows are sets
of five-word shingles (a shorter window is one shingle), ordered by rarity over all documents. To
contain a window a text must hold all of its shingles, so one prefix token, the rarest shingle, is
enough to find every candidate. A candidate's offset gives the only possible position; the length
and positional bounds drop those that leave the text, and the rest is verified word by word.

Documents stay where they are: two narrow passes, one that counts benchmark shingles over all
documents and one that joins. The benchmark goes to the tasks in blocks of about ``BLOCK_BYTES`` of
items, one pass each, so that its size is not bounded by a task's memory. Words are compared by
64-bit hashes.

Words: A-Z lower-cased, runs of digits, letters and non-ASCII. A null or wordless text gives zero
counts and is not contaminated. Items without words are ignored, a null item id is named ``""``, and
rows that share an item id count as one item. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm import tokens
from ordersight.session import cut, text_batches

WINDOW = 13
SHINGLE = 5
BLOCK_BYTES = 4 << 20
U = np.uint64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
HITS = "struct<n_words:long,starts:array<long>,ends:array<long>,items:array<string>>"


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, by the position of its first word."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, U(k), np.uint64)
    for j in range(k):
        out += h[j : j + n] * FACTORS[j]
    return tokens.mix(out)


class Windows:
    """The windows of a block of items and, once ranked, their rarest shingles."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        self.words: list[np.ndarray] = []
        self.names = sorted({name or "" for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        owners: dict[bytes, set[int]] = {}
        powers = tokens.powers()
        texts = pa.array([text for _, text in items], pa.large_string())
        for block in tokens.words(texts, tokens.NOT_ALPHANUMERIC):
            h = block.hashes(powers)
            for i in range(len(block)):
                own = h[block.bounds[i] : block.bounds[i + 1]]
                size = min(WINDOW, len(own))
                for at in range(len(own) - size + 1) if size else ():
                    owners.setdefault(own[at : at + size].tobytes(), set()).add(place[items[block.first + i][0] or ""])
        self.words = [np.frombuffer(key, np.uint64) for key in owners]
        self.owners = [sorted(found) for found in owners.values()]
        self.widths = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.tokens = {
            k: np.unique(np.concatenate([shingles(w, k) for w in self.words if min(SHINGLE, len(w)) == k])) for k in self.widths
        }
        self.rarest: dict[int, tuple[np.ndarray, ...]] = {}

    def rank(self, counts: dict[int, int]) -> None:
        """Choose the prefix token of each window: its rarest shingle, ties by hash."""
        for k in self.widths:
            rows = []
            for w, words in enumerate(self.words):
                if min(SHINGLE, len(words)) == k:
                    own = shingles(words, k)
                    offset = min(range(len(own)), key=lambda i: (counts.get(int(own[i]), 0), int(own[i]), i))
                    rows.append((int(own[offset]), w, offset))
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            self.rarest[k] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def found(self, sorted_keys: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Positions of ``g`` whose value is in ``sorted_keys``; a bitmap of top bits drops most at once."""
        top = np.zeros(1 << 16, bool)
        top[(sorted_keys >> U(48)).astype(np.int64)] = True
        at = np.flatnonzero(top[(g >> U(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(sorted_keys, g[at]), len(sorted_keys) - 1)
        return at[sorted_keys[place] == g[at]]


def _counts(windows: Windows):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = tokens.powers(), {}
        for batch in batches:
            for block in tokens.words(batch.column(0), tokens.NOT_ALPHANUMERIC):
                h = block.hashes(powers)
                for k, keys in windows.tokens.items():
                    g = shingles(h, k)
                    for key in g[windows.found(keys, g)].tolist():
                        total[key] = total.get(key, 0) + 1
        keys = np.array(list(total), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    return count


def _join(windows: Windows, block: tokens.Words, h: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Covered words of a block of texts, and by text the items with windows in it."""
    edges, items = np.zeros(len(h) + 1, np.int64), {}
    for k, (keys, owner, offset) in windows.rarest.items():
        g = shingles(h, k)
        at = windows.found(keys, g)
        low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
        for step in range(int((high - low).max()) if len(at) else 0):  # windows that share a prefix token
            more = low + step < high
            window, start = owner[low[more] + step], at[more] - offset[low[more] + step]
            size = np.array([len(windows.words[w]) for w in window], np.int64)
            text = np.searchsorted(block.bounds, at[more], "right") - 1
            fits = (start >= block.bounds[text]) & (start + size <= block.bounds[text + 1])
            for w, s, n, t in zip(window[fits].tolist(), start[fits].tolist(), size[fits].tolist(), text[fits].tolist(), strict=True):
                if np.array_equal(h[s : s + n], windows.words[w]):
                    edges[s] += 1
                    edges[s + n] -= 1
                    items.setdefault(t, set()).update(windows.owners[w])
    return np.cumsum(edges[:-1]) > 0, items


def _hits(windows: Windows, texts: pa.Array) -> pa.Array:
    powers, rows = tokens.powers(), []
    for block in tokens.words(texts, tokens.NOT_ALPHANUMERIC):
        h = block.hashes(powers)
        covered, items = _join(windows, block, h)
        for i, n in enumerate(block.counts().tolist()):
            row = {"n_words": n, "starts": [], "ends": [], "items": []}
            if i in items:
                own = np.concatenate([[False], covered[block.bounds[i] : block.bounds[i + 1]], [False]]).astype(np.int8)
                turn = np.diff(own)
                row |= {"starts": np.flatnonzero(turn == 1).tolist(), "ends": np.flatnonzero(turn == -1).tolist()}
                row["items"] = [windows.names[x] for x in sorted(items[i])]
            rows.append(row)
    kind = pa.struct(
        [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
    )
    return pa.array(rows, kind)


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of about ``BLOCK_BYTES``, each small enough for the driver and every task."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def _union_size(spans: Column) -> Column:
    """Positions covered by spans sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        spans,
        zero,
        lambda s, x: F.struct(
            (s["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("sum"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
        lambda s: s["sum"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add n_words, n_hit, n_items, items (sorted ids), spans (start, end in words) and contaminated to every document.

    Contaminated: at least one word in twenty lies in an occurring window. Columns of these names are replaced.
    """
    whole, parts = F.col(f"`{text}`").cast("string"), []
    named = docs.columns
    for i, block in enumerate(_item_blocks(benchmark, item, item_text)):
        windows = Windows(block)
        counted = docs.select(whole.alias("text")).mapInArrow(_counts(windows), "token long, n long")
        with text_batches(docs.sparkSession):
            tally = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most the shingles of one block
        windows.rank({int(np.int64(r["token"]).view(np.uint64)): r["n"] for r in tally})
        parts.append(f"_hits{i}")
        docs = docs.withColumn(parts[-1], F.arrow_udf(lambda t, w=windows: _hits(w, t), HITS)(whole))
    spans = F.array_sort(
        F.concat(*[F.arrays_zip(F.col(f"{p}.starts").alias("start"), F.col(f"{p}.ends").alias("end")) for p in parts])
    )
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}.items") for p in parts])))
    docs = docs.withColumns({"_spans": spans, "_items": items, "_n_words": F.col(f"{parts[0]}.n_words")})
    docs = docs.withColumn("_n_hit", _union_size(F.col("_spans")))
    added = {
        "n_words": F.col("_n_words"),
        "n_hit": F.col("_n_hit"),
        "n_items": F.size("_items").cast("long"),
        "items": F.col("_items"),
        "spans": F.col("_spans"),
        "contaminated": (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words")),
    }
    return docs.select(*[F.col(f"`{c}`") for c in named if c not in added], *[value.alias(name) for name, value in added.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows that are not contaminated, with their columns unchanged; written, because the batches of texts are small."""
    scanned = scan(docs.withColumn("_keep", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), benchmark, text)
    with text_batches(docs.sparkSession):
        return cut(scanned.filter(~F.col("contaminated")).select("_keep.*"))


def twin_sql() -> str:
    """DuckDB SQL for the query: windows joined with document windows by their exact words."""
    split = "[x for x in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"
    return f"""
with d as (select doc_id, coalesce({split}, []) w from documents),
b as (select cast(item_id as varchar) item, {split} w from benchmark),
windows as (
  select distinct item, len(v) n, array_to_string(v, ' ') v from (
    select item, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) v
    from (select item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, least(len(w), 1)) + 1)) i from b))),
sizes as (select distinct n from windows),
starts as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n),
hits as (
  select doc_id, i, s.n, item from (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') v from starts) s
  join windows using (n, v)),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
named as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
  from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join covered using (doc_id) left join named using (doc_id)"""
