"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups' roots.

A tree is built level by level, by sibling-shift self-joins. Nodes of a level carry their index in the
group; each is equijoined with its siblings by computed index (index XOR 1 in a binary tree, otherwise
the other slots of its run of ``fan_out`` nodes, shift by shift). What a node joins is its proof step: the
digests left and right of it. Rows in slot 0 then know their whole run and emit its parent. A level is
written before the next reads it, so a lost executor repeats one level at most.

Proofs are put together from the top down: a level joins its parents' paths, each parent serving its few
children, so no join key is hot and no group is ever collected. Indices come from a range partitioning by group,
order and digest: a group that holds most rows is cut into many ranges, and the counts of ranges carry
the index across their borders.

``H`` is the lowercase hex sha256 of its inputs, concatenated. A run of one node, where the level has
several runs, still becomes the digest of its one member. Null values enter a leaf as ``-``. The null group comes
first, then groups by their bytes; null order values come first; rows of equal order follow by their
digest, and rows equal in both have interchangeable places. An empty table gives no rows. Columns of
the caller's that are not named in ``keep`` are not read; kept columns give way to results of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.session import cut

FAN_OUT = 8
STEPS = "array<struct<left:string,right:string>>"
ROW = (1 << 33) - 1  # monotonically_increasing_id: partition above, row below bit 33


def leaf(*values: str | Column) -> Column:
    """Digest of a row: of each value its UTF-8 byte count, a colon and the value; ``-`` for a null."""
    parts = []
    for value in values:
        whole = (F.col(value) if isinstance(value, str) else value).cast("string")
        sized = F.concat(F.octet_length(whole).cast("string"), F.lit(":"), whole)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lowered(text: str) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.col(text), upper, upper.lower())


def indexed(nodes: DataFrame) -> DataFrame:
    """Add ``idx``, the place of each row of its group ``g`` by ``o`` and ``hash``, and ``n``, the rows of the group.

    ``nodes`` must be a written table: the last range key tells equal rows apart by their place in it.
    """
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.withColumn("_at", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(width, "g", "o", "hash", F.xxhash64("_at")).drop("_at")
    sorted_ = ranged.sortWithinPartitions("g", "o", "hash").withColumn("at", F.monotonically_increasing_id())
    rows = cut(sorted_.select("*", F.shiftright("at", 33).alias("range")))
    # one row per range and group: ranges are consecutive, so there are fewer than ranges and groups together
    counts = rows.groupBy("g", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("g", "range", (before - F.col("first")).alias("shift"), F.sum("c").over(group).alias("n"))
    joined = rows.join(offsets, ["g", "range"])
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "shift", "o")


def _with_siblings(level: DataFrame, fan_out: int) -> DataFrame:
    """Add ``left`` and ``right``, the joined digests of the siblings before and behind each node."""
    slot = F.col("idx") % fan_out
    out = level
    for k in range(1, fan_out):
        if fan_out == 2:
            sibling = F.col("idx").bitwiseXOR(F.lit(1).cast("long"))
        else:
            sibling = F.col("idx") - slot + (slot + k) % fan_out
        other = level.select(F.col("g").alias(f"g{k}"), F.col("idx").alias(f"i{k}"), F.col("hash").alias(f"h{k}"))
        at = (F.col("g") == F.col(f"g{k}")) & (sibling == F.col(f"i{k}"))
        out = out.join(other, at, "left").drop(f"g{k}", f"i{k}")
    # slots before the node are those that the shift carries past the end of the run
    wraps = lambda k: slot + k >= fan_out
    shifts = range(1, fan_out)
    left = F.concat_ws("", *[F.when(wraps(k), F.col(f"h{k}")) for k in shifts])
    right = F.concat_ws("", *[F.when(~wraps(k), F.col(f"h{k}")) for k in shifts])
    return out.select(*level.columns, left.alias("left"), right.alias("right"))


def _tree(leaves: DataFrame, fan_out: int, payload: tuple[str, ...]) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees of all groups ``g``, each with proof steps, and the roots ``g, height, hash``.

    Leaves carry ``payload`` columns; a level holds the groups that have several nodes there.
    """
    nodes = cut(leaves.select("g", "idx", "n", "hash", *payload))
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], [nodes.filter("n = 1").select("g", F.lit(0).alias("height"), "hash")]
    while most > 1:
        level = cut(_with_siblings(nodes.filter("n > 1"), fan_out))
        levels.append(level)
        parents = level.filter(F.col("idx") % fan_out == 0)
        nodes = parents.select(
            "g",
            F.floor(F.col("idx") / fan_out).alias("idx"),
            F.ceil(F.col("n") / fan_out).alias("n"),
            F.sha2(F.concat("hash", "right"), 256).alias("hash"),
        )
        roots.append(nodes.filter("n = 1").select("g", F.lit(len(levels)).alias("height"), "hash"))
        most = -(-most // fan_out)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, cut(found)


def _proved(levels: list[DataFrame], tops: DataFrame, fan_out: int, payload: tuple[str, ...]) -> DataFrame:
    """Every leaf with the columns of its group's top (``path``, its last steps, among them), steps put in front of ``path``."""
    own = [c for c in tops.columns if c not in ("g", "height", "path")]
    empty = F.lit(0).cast("long")
    above = None
    for height in range(len(levels), 0, -1):
        ended = tops.filter(F.col("height") == height).select("g", empty.alias("idx"), "path", *own)
        parents = (ended if above is None else ended.unionByName(above)).withColumnsRenamed({"g": "_g", "idx": "_idx"})
        level = levels[height - 1]
        at = (F.col("g") == F.col("_g")) & (F.floor(F.col("idx") / fan_out) == F.col("_idx"))
        path = F.concat(F.array(F.struct("left", "right")), F.col("path")).cast(STEPS)
        extra = ("hash", *payload) if height == 1 else ()
        above = level.join(parents, at).select("g", "idx", path.alias("path"), *own, *extra)
    return above


def build(
    rows: DataFrame,
    leaf: str = "leaf",
    group: str = "lang",
    order: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``leaf``, ``subroot``, ``root`` and ``proof``.

    ``proof`` lists, from the leaf up through the group's tree and the tree of groups, the digests left
    and right of the path; ``folded(leaf, proof)`` gives the root.
    """
    name = F.col(f"`{group}`").cast("string")
    kept = {f"k{i}": c for i, c in enumerate(keep)}
    leaves = cut(
        rows.select(
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"),  # a null before all others
            F.col(f"`{order}`").alias("o"),
            F.col(f"`{leaf}`").alias("hash"),
            *[F.col(f"`{c}`").alias(k) for k, c in kept.items()],
        )
    )
    payload = tuple(kept)
    levels, subroots = _tree(indexed(leaves), fan_out, payload)
    # the same tree once more, over the subroots: one group, ordered by the names of the first
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "hash", F.col("g").alias("of"), "height")
    upper, root = _tree(indexed(cut(tops)), fan_out, ("of", "height"))
    none = F.array().cast(STEPS)
    root = root.select("g", F.col("height").alias("top"), F.col("hash").alias("root"))
    if upper:
        high = root.select("g", F.col("top").alias("height"), none.alias("path"), "root")
        proved = _proved(upper, high, fan_out, ("of", "height"))
        proved = cut(proved.select(F.col("of").alias("g"), "height", "path", F.col("hash").alias("subroot"), "root"))
    else:  # a single group, or none: its root is the root of all
        proved = subroots.select("g", "height", none.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    found = leaves.join(proved.filter("height = 0"), "g").select("path", "subroot", "root", "hash", *payload)
    if levels:
        found = found.unionByName(_proved(levels, proved, fan_out, payload).drop("g", "idx"))
    results = {"leaf": "hash", "subroot": "subroot", "root": "root", "proof": "path"}
    left = [F.col(k).alias(c) for k, c in kept.items() if c not in results]
    return found.select(*left, *[F.col(c).alias(r) for r, c in results.items()])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda hash, step: F.sha2(F.concat(step["left"], hash, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """``H`` of the siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def twin_sql() -> str:
    """The manifest of ``documents`` in SQL."""
    value = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    fixed = " || ".join(value(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {fixed} AS head, text, {lower} AS low FROM documents
), leaves AS (
  SELECT doc_id, g, sha256(head || {value('text')}) AS leaf, sha256(head || {value('low')}) AS other, CAST(doc_id AS VARCHAR) AS d
  FROM rows
), checksums AS (
  SELECT d, 4294967295::BIGINT AS c, 1 AS i FROM (SELECT DISTINCT d FROM leaves WHERE d IS NOT NULL)
  UNION ALL
  SELECT d, list_reduce([xor(c, ascii(d[i])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), i + 1
  FROM checksums WHERE i <= length(d)
), marked AS (
  SELECT l.*, coalesce(xor(c, 4294967295::BIGINT) % 3 = 0, false) AS tampered
  FROM leaves l LEFT JOIN checksums s ON s.d = l.d AND s.i = length(s.d) + 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n
  FROM marked
), tree AS (
  SELECT 0 AS lvl, g, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, g, idx // {FAN_OUT}, (n + {FAN_OUT - 1}) // {FAN_OUT}, sha256(string_agg(h, '' ORDER BY idx))
  FROM tree WHERE n > 1 GROUP BY lvl, g, idx // {FAN_OUT}, n
), subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS lvl, idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // {FAN_OUT}, (n + {FAN_OUT - 1}) // {FAN_OUT}, sha256(string_agg(h, '' ORDER BY idx))
  FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // {FAN_OUT}, n
), steps AS (
  SELECT a.lvl AS lvl, a.g, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tree a JOIN tree b ON a.lvl = b.lvl AND a.g = b.g AND a.idx // {FAN_OUT} = b.idx // {FAN_OUT} WHERE a.n > 1 GROUP BY ALL
), upper_steps AS (
  SELECT a.lvl AS lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM upper_tree a JOIN upper_tree b ON a.lvl = b.lvl AND a.idx // {FAN_OUT} = b.idx // {FAN_OUT} WHERE a.n > 1 GROUP BY ALL
), paths AS (
  SELECT g, idx AS leaf_idx, idx, 0 AS lvl, CASE WHEN tampered THEN other ELSE leaf END AS h, '' AS siblings FROM placed
  UNION ALL
  SELECT p.g, leaf_idx, p.idx // {FAN_OUT}, p.lvl + 1, sha256(l || h || r), siblings || l || r
  FROM paths p JOIN steps s ON s.g = p.g AND s.lvl = p.lvl AND s.idx = p.idx
), ends AS (
  SELECT p.g, leaf_idx, p.h, siblings, s.idx FROM paths p JOIN tree t ON t.g = p.g AND t.lvl = p.lvl AND t.n = 1
  JOIN subroots s ON s.g = p.g
), upper_paths AS (
  SELECT g, leaf_idx, idx, 0 AS lvl, h, siblings FROM ends
  UNION ALL
  SELECT g, leaf_idx, p.idx // {FAN_OUT}, p.lvl + 1, sha256(l || h || r), siblings || l || r
  FROM upper_paths p JOIN upper_steps s ON s.lvl = p.lvl AND s.idx = p.idx
), root AS (
  SELECT lvl, h AS root FROM upper_tree WHERE n = 1
)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(siblings) AS proof_sha256, u.h AS folded_root, u.h = root AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN root ON true
JOIN upper_paths u ON u.g = p.g AND u.leaf_idx = p.idx AND u.lvl = root.lvl
"""
