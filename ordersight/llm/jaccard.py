"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets form one
class at once; only classes are joined. Rare tokens come first in their order, by a sketch of counts over
all documents.

* **Rare tokens** are indexed one by one, within the standard prefix.
* **Frequent tokens** are reached only by sets with fewer rare tokens than the prefix is long. Such a
  set indexes all its rare tokens, and its prefix is extended: linked sets of sizes x and y leave at
  most e(x) and e(y) tokens unshared, so among the first e(x) + e(y) + 2 shared tokens two must
  be neighbours in both orders. Neighbouring frequent tokens of the extended prefix are indexed as
  2-token combinations, which are as many as the prefix is long.

The sketch tells frequent from rare and orders both by steps of their counts; tokens of one step are ordered
by their hash.

Two linked sets that are not equal share a key. Of keys with the same members one is kept, and two members
of a key are not compared there if they share one of the ``BEFORE`` keys before it: they met at that one or
earlier. So a pair is met again only after ``BEFORE`` keys in a row that it does not share. A candidate must pass bounds on its sizes and on the
symmetric difference (each set carries the parity of its tokens in 512 buckets; bits that differ
cannot exceed the difference), then it is verified exactly. To find components without all pairs of a
group, keys link their members with leaders first, which all keys choose alike; keys whose members are
one component are done. Rounds with more leaders follow until few partners in other components pass the
bounds, and those are all verified; a sample of the partners tells how many there are, so that what is
compared grows with the postings and not with the square of a group. What is collected is the sketch, whose size is fixed; it decides the order,
never the result.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``. Fewer words than a shingle form one token; without words
the set is empty and linked with nothing. A null id can be linked but names no component; rows with
equal ids and different texts are nodes of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm import tokens
from ordersight.llm.components import components
from ordersight.llm.scratch import release, unused
from ordersight.session import cut, text_batches

SKETCH_BITS = 21
RARE = 64  # a token is frequent if its sketch count exceeds the mean bucket by this
FREQUENT = 128  # level from which tokens are frequent
ADDED = 16  # sketches that a task adds up
SMALL_ROWS = 200_000  # two-column tables up to this many rows (a few megabytes) are broadcast
FEW_PARTNERS = 4  # partners in other components for an average posting, from which on all are looked at
BEFORE = 16  # keys before its own that a posting carries; a pair that shares one of them is not met again
FEW_MET = 0.25  # pairs met and possible for an average posting, up to which all are compared
PROBED = 16  # partners of an average posting that are looked at to tell how many are possible
MORE_LEADERS = 16  # times as many leaders in each round
PARITY_WORDS = 8
WIDE_WORDS = 64  # of the second parity, for candidates only
BITS = tuple(f"w{i}" for i in range(PARITY_WORDS))
U = np.uint64
FACTORS = np.array(
    [
        0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
    ],
    np.uint64,
)


def shingle_sets(block: tokens.Words, h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    n = max(0, len(h) - width + 1)
    g = np.full(n, U(width), np.uint64)
    for j in range(width):
        g += h[j : j + n] * FACTORS[j]
    g = tokens.mix(g)
    for low, high in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
        if high - low >= width:
            own = np.sort(g[low : high - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif high > low:
            yield tokens.mix(np.array([sum(int(x) * int(f) for x, f in zip(h[low:high], FACTORS, strict=False)) + high - low & (1 << 64) - 1], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values that name a set."""
    first, second = tokens.mix(own + U(1)), tokens.mix(own ^ U(0x5851F42D4C957F2D))
    values = tokens.mix(np.array([first.sum() + U(len(own)), np.bitwise_xor.reduce(second) if len(own) else U(0)], np.uint64))
    return tuple(values.view(np.int64).tolist())


def parity(own: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Parity of a set's tokens in ``64 * words`` buckets, as longs."""
    odd = np.bincount((own & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def unshared(n: int, percent: int) -> int:
    """Most tokens of a set of ``n`` that a linked set may lack."""
    return n - (percent * n + 99) // 100


def index_keys(own: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set of tokens of these levels: rare prefix tokens, then combinations of neighbouring frequent ones."""
    loss = unshared(len(own), percent)
    order = np.argsort(level, kind="stable")
    own, frequent = own[order], level[order] >= FREQUENT
    rare = own[~frequent]
    if len(rare) > loss:
        return rare[: loss + 1]
    reach = 2 * loss + (100 - percent) * len(own) // percent + 2
    rest = own[frequent][: max(0, reach - len(rare))]
    return np.concatenate([rare, tokens.mix(rest[:-1] * FACTORS[0] + rest[1:] * FACTORS[1])])


def _sketch(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, shift = tokens.powers(), U(64 - SKETCH_BITS)
        total, waiting, n = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for batch in batches:
            for block in tokens.words(batch.column(0)):
                own = [x >> shift for x in shingle_sets(block, block.hashes(powers), width)]
                waiting += own
                n += sum(map(len, own))
                if n > 2_000_000:
                    total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(total)).astype(np.uint32)
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sketch"])

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0):
            own = np.frombuffer(zlib.decompress(part.as_buffer()), np.uint32)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sketch"])


def levels_of(total: np.ndarray) -> np.ndarray:
    """Level of each bucket from its count: steps of half a standard deviation of chance, ``FREQUENT`` and above if frequent."""
    mean = total.mean()
    above = np.maximum(total - mean, 0.0)
    rare = above <= RARE
    low = np.minimum(2 * above / max(1.0, mean) ** 0.5, FREQUENT - 1)
    high = np.minimum(FREQUENT + 8 * np.log2(np.maximum(above, RARE) / RARE), 255)
    return np.where(rare, low, high).astype(np.uint8)


def bucket_levels(texts: DataFrame, width: int) -> bytes:
    """Level of the tokens of each sketch bucket, from the counts in all sets of ``texts``."""
    parts = cut(texts.mapInArrow(_sketch(width), "sketch binary"))
    with text_batches(texts.sparkSession, ADDED):
        while (left := parts.count()) > 1:
            before, parts = parts, cut(parts.repartition(-(-left // ADDED)).mapInArrow(_added, "sketch binary"))
            release(before)
    found = parts.first()
    release(parts)
    total = np.frombuffer(zlib.decompress(found[0]), np.uint32) if found else np.zeros(1 << SKETCH_BITS, np.uint32)
    return zlib.compress(levels_of(total).tobytes(), 1)


def _prepare(width: int, percent: int, levels: bytes):
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, shift = tokens.powers(), U(64 - SKETCH_BITS)
        level = np.frombuffer(zlib.decompress(levels), np.uint8)
        for batch in batches:
            done = 0
            for block in tokens.words(batch.column(1)):
                rows = []
                for own in shingle_sets(block, block.hashes(powers), width):
                    keys = index_keys(own, level[(own >> shift).astype(np.int64)], percent) if len(own) else own
                    rows.append((len(own), *signature(own), parity(own), keys.view(np.int64)))
                sizes, first, second, odd, keys = zip(*rows, strict=True)
                bits = [pa.array(column) for column in np.stack(odd, 1)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                columns = [pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), listed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(rows)), *columns, *bits], ["id", "n", "node", "check", "keys", *BITS]
                )
                done += len(rows)

    return prepare


def _rows_of(texts: pa.Array, width: int, powers: tokens._Powers) -> Iterator[np.ndarray]:
    for block in tokens.words(texts):
        yield from shingle_sets(block, block.hashes(powers), width)


def _named(width: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tokens.powers()
        for batch in batches:
            rows = [(signature(own)[0], len(own), parity(own, WIDE_WORDS)) for own in _rows_of(batch.column(0), width, powers)]
            nodes, sizes, odd = zip(*rows, strict=True) if rows else ((), (), ())
            odd = pa.FixedSizeListArray.from_arrays(np.concatenate(odd) if odd else np.zeros(0, np.int64), WIDE_WORDS)
            columns = [pa.array(nodes, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), odd.cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "text", "n", "odd"])

    return name


def _verify(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tokens.powers()
        for batch in batches:
            linked = []
            for x, y in zip(*[_rows_of(batch.column(i), width, powers) for i in (2, 3)], strict=True):
                both = np.concatenate([x, y])
                both.sort(kind="mergesort")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return verify


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


class _Join:
    """One run: the classes of equal sets, their postings, and the pairs verified so far."""

    def __init__(self, docs: DataFrame, id: str, text: str, width: int, percent: int) -> None:
        self.width, self.percent = width, percent
        self.kind = docs.schema[id].dataType.simpleString()
        self.docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
        levels = bucket_levels(self.docs.select("text"), width)
        layout = f"id {self.kind}, n long, node long, check long, keys array<long>, " + ", ".join(f"{b} long" for b in BITS)
        rows = cut(self.docs.mapInArrow(_prepare(width, percent, levels), layout))
        filled = rows.filter("n > 0")
        self.classes = cut(
            filled.groupBy("node", "check", "n").agg(
                F.min("id").alias("rep"), *[F.any_value(c).alias(c) for c in ("keys", *BITS)]
            )
        )
        self.rows = cut(rows.select("id", "n", "node", "check"))
        release(rows)
        self.pairs: list[DataFrame] = []

    def postings(self) -> DataFrame:
        """``key, before, node, n`` and parities for the keys that two classes or more share; the classes lose their keys.

        Of keys with the same members one is left. ``before`` are the node's previous keys, less shared keys first.
        """
        full = self.classes
        every = full.select(F.explode("keys").alias("key"), "node")
        shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
        shared = cut(every.join(shared, "key", "left_semi"))
        members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
        kept = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *members)
        kept = kept.groupBy("c", "m0", "m1").agg(F.min("key").alias("key")).select("key", "c")
        own = shared.join(kept, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("own"))
        listed = own.select("node", F.col("own.key").alias("own")).select("node", "own", F.posexplode("own").alias("at", "key"))
        before = F.slice("own", F.greatest(F.col("at") - (BEFORE - 1), F.lit(1)), F.least("at", F.lit(BEFORE)))
        listed = listed.select("node", "key", before.alias("before"))
        postings = cut(listed.join(full.select("node", "n", *BITS), "node"))
        self.classes = cut(full.select("node", "check", "n", "rep"))
        release(full)
        release(shared)
        return postings

    def check(self, pairs: DataFrame) -> DataFrame:
        """Verify pairs ``a, b`` that are new, on the texts of their classes' representatives.

        Texts travel, not sets: a compressed text is a third of its set's hashes.
        """
        for known in self.pairs:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = cut(self.classes.select("node", "rep").join(wanted, "node", "left_semi"))
        reps = _small(wanted.select(F.col("rep")).distinct())
        texts = self.docs.join(reps, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        texts = texts.mapInArrow(_named(self.width), "node long, text string, n long, odd array<long>")
        texts = texts.join(_small(wanted.select("node")), "node", "left_semi")
        texts = cut(texts.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("text", "n", "odd")]))
        right = pairs.join(texts.select(F.col("node").alias("b"), F.col("n").alias("_n"), F.col("odd").alias("_odd")), "b")
        both = right.join(texts.select(F.col("node").alias("a"), "n", "odd"), "a")
        differ = F.aggregate(
            F.zip_with("odd", "_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
        )
        near = cut(both.filter(differ <= self.most_different()).select("a", "b"))
        ready = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        ready = ready.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
        checked = cut(ready.mapInArrow(_verify(self.width, self.percent), "a long, b long, linked boolean"))
        done = cut(pairs.join(checked.filter("linked"), ["a", "b"], "left").select("a", "b", F.col("linked").isNotNull().alias("linked")))
        for table in (pairs, wanted, texts, near, checked):
            release(table)
        self.pairs.append(done)
        return done

    def most_different(self) -> Column:
        """Largest symmetric difference of linked sets of sizes ``n`` and ``_n``."""
        size = F.col("n") + F.col("_n")
        return size - 2 * F.ceil(F.lit(self.percent) * size / (100 + self.percent))

    def links(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.pairs).filter("linked").select("a", "b")

    def possible(self) -> Column:
        """Whether the sizes ``n``, ``_n`` and the parities allow a link; part of the join condition."""
        n, m = F.col("n"), F.col("_n")
        differ = reduce(Column.__add__, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"_{b}"))) for b in BITS])
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & (differ <= self.most_different())

    @staticmethod
    def first_met() -> Column:
        """Whether two postings of a key share none of their keys before: what shares one is a pair there already."""
        return ~F.arrays_overlap("before", "_before")

    def pairs_of(self, postings: DataFrame, partners: DataFrame, of_other: Column) -> DataFrame:
        """Possible pairs of postings with partners of the same key, smaller node first, once each."""
        joined = postings.join(partners, (F.col("key") == F.col("_key")) & self.possible() & of_other)
        return joined.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()

    def possible_partners(self, postings: DataFrame, rows: int, cross: float) -> float:
        """About how many of the ``cross`` pairs of postings in different components are compared if all are."""
        share = min(1.0, PROBED * rows / cross)
        probed = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)
        some = postings.filter(probed).select(*[F.col(c).alias(f"_{c}") for c in ("key", "before", "n", "comp", *BITS)])
        met = (F.col("key") == F.col("_key")) & self.possible() & (F.col("comp") != F.col("_comp")) & self.first_met()
        return postings.join(some, met).count() / share

    def run(self) -> DataFrame:
        """``node, comp`` of the classes with links.

        Leaders are the nodes of least hash, the same for all keys of a group. Every round compares what a
        key still holds outside a leader's component with its leaders: one at first, then more and more, until
        so few possible partners are left that all are compared. Nodes that have joined a component meet none of
        it again.
        """
        written, columns = self.postings(), ("key", "before", "node", "n", "comp", *BITS)
        postings, leaders, found = written.withColumn("comp", F.col("node")), 1, None
        while True:
            sizes = postings.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
            sizes = sizes.agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same")).filter("c * c > same")
            several = postings.join(sizes.select("key", "c", (F.col("c") * F.col("c") - F.col("same")).alias("cross")), "key")
            closed, written = written, cut(several)
            release(closed)
            postings = written
            state = postings.agg(F.count(F.lit(1)), F.sum(F.col("cross") / F.col("c")), F.max("c")).first()
            if not state[0]:
                return found if found is not None else cut(components(self.no_links()))
            every = state[1] <= FEW_PARTNERS * state[0] or leaders >= state[2]
            if not every and leaders > 1:
                every = self.possible_partners(postings, state[0], state[1]) <= FEW_MET * state[0]
            other = postings.select("c", *[F.col(c).alias(f"_{c}") for c in columns])
            if every:
                chosen, once = other, (F.col("comp") < F.col("_comp")) & self.first_met()
            elif leaders == 1:
                by = F.struct(F.xxhash64("_node").alias("by"), *[F.col(f"_{c}") for c in columns[1:]])
                chosen = other.groupBy("_key").agg(F.min(by).alias("top")).select("_key", "top.*")
                once = F.col("comp") != F.col("_comp")
            else:
                share = F.pmod(F.xxhash64("_node"), F.lit(1 << 20)) / (1 << 20)
                # a leader of a key also leads its keys before, which hold fewer
                chosen, once = other.filter(share * F.col("c") < leaders), (F.col("comp") != F.col("_comp")) & self.first_met()
            done = self.check(self.pairs_of(postings, chosen.drop("c"), once))
            links = done.filter("linked").select("a", "b")
            # what is known as one star for each component, and the new links
            known = links if found is None else found.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links)
            before, found = found, cut(components(known))
            if before is not None:
                release(before)
            if every:
                return found
            labels = found.withColumnRenamed("comp", "_new")
            relabelled = postings.join(_small(labels), "node", "left").withColumn("comp", F.coalesce("_new", "comp"))
            postings = relabelled.select(*columns)
            leaders *= MORE_LEADERS

    def no_links(self) -> DataFrame:
        return self.classes.filter("false").select(F.col("node").alias("a"), F.col("node").alias("b"))


def _members(docs: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """``id, n, node, check, component, named``: every row with its component and the node of that component's smallest id."""
    with text_batches(docs.sparkSession):
        join = _Join(docs, id, text, width, percent)
        found = join.run()
    named = join.classes.select("node", "check", "n", "rep").join(found, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    # a null id names no component; of several nodes with the smallest id the smallest counts
    key = F.struct(F.col("rep").isNull().alias("no"), F.col("rep"), F.col("node"), F.col("check"))
    least = named.groupBy("comp").agg(F.min(key).alias("least"))
    named = named.join(least, "comp").select(
        "node", "check", "n", F.col("least.rep").alias("component"), F.struct("least.node", "least.check").alias("named")
    )
    return join.rows.select("id", "n", "node", "check").join(cut(named), ["node", "check", "n"], "left")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    return _members(docs, id, text, width, percent).select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _node_of(text: Column, width: int) -> Column:
    @F.arrow_udf("struct<node:bigint,check:bigint>")
    def name(texts: pa.Array) -> pa.Array:
        both = [signature(own) for own in _rows_of(texts, width, tokens.powers())]
        columns = [pa.array([pair[i] for pair in both], pa.int64()) for i in (0, 1)]
        return pa.StructArray.from_arrays(columns, ["node", "check"])

    return name(text)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component: one with the smallest id.

    Rows without an id or without words stay. Where rows share an id, each is judged by its own text, and of
    rows that share both the id and the words one stays.
    """
    member = _members(docs.select(id, text), id, text, width, percent).filter("id is not null and n > 0")
    # the row that names its component
    first = (F.col("component") == F.col("id")) & (F.struct("node", "check") == F.col("named"))
    member = cut(member.select("id", F.struct("node", "check").alias("own"), first.alias("first")))
    verdict = member.groupBy("id").agg(F.bool_and("first").alias("first"), F.count(F.lit(1)).alias("c"))
    marked = cut(verdict.filter("not first or c > 1"))
    key = unused(docs, "key")
    gone, repeated = marked.filter("c = 1").select(F.col("id").alias(key)), marked.filter("c > 1").select(F.col("id").alias(key))
    at = F.col(f"`{id}`") == F.col(key)
    once = docs.join(_small(gone), at, "left_anti")
    if repeated.isEmpty():
        return once
    own = unused(docs, "own")
    again = docs.join(_small(repeated), at, "left_semi").withColumn(own, _node_of(F.col(f"`{text}`").cast("string"), width))
    firsts = member.join(_small(repeated), F.col("id") == F.col(key), "left_semi").filter("first").distinct()
    firsts = firsts.select(F.col("id").alias(key), F.col("own").alias(f"{own}_"))
    kept = again.join(firsts, at & (F.col(own) == F.col(f"{own}_")), "left_semi").dropDuplicates([id, own]).drop(own)
    wordless = again.filter(F.col(own) == _node_of_nothing()).drop(own)
    return once.join(_small(repeated), at, "left_anti").unionByName(kept).unionByName(wordless)


def _node_of_nothing() -> Column:
    node, check = signature(np.zeros(0, np.uint64))
    return F.struct(F.lit(node).alias("node"), F.lit(check).alias("check"))
