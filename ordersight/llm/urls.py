"""URL filter: a blocked Bloom filter of the listed keys, then an exact hash join of its survivors.

Two kinds of entries share the filter: rules, which fit a host with all its subdomains and every
path that starts with theirs, and listed URLs, compared in canonical form. A URL's candidate keys
(each host suffix with each listed path length, and its canonical form) are probed in the filter by
built-in bit operations; what passes is joined with the entries by exact key, which removes the
false positives. The filter is a table of 256-bit blocks joined by block number: its size follows
the number of entries and it is broadcast only below a counted bound, as are the entries.

Verdicts are found per distinct URL, so that a hot URL is looked up once. A null URL or one without
``://`` has an empty host and path, fits no rule and no list, and is allowed; repeated pages each
get their row; an empty table or empty lists give no rows or allow everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# verdict, host, path
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# names of host labels whose pages make up the block list of the registered query
LISTED_LABELS = ("casino-win", "free-bets", "spam-farm", "ads-track")

BITS_PER_KEY = 12
WORDS = ("_w0", "_w1", "_w2", "_w3")
SMALL_ROWS = 50_000  # tables up to this many rows (a few megabytes) are broadcast


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without closing slashes; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, "^www[.]", ""), F.regexp_replace(path, "/+$", ""))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )


def _mask(key: Column, word: int) -> Column:
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    pick = lambda k: F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    low, high = (F.call_function("shiftleft", one, pick(2 * word + k)) for k in (0, 1))
    return low.bitwiseOR(high)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of the column ``_key``: one row of four words for each block in use."""
    masks = [_mask(F.col("_key"), j).alias(w) for j, w in enumerate(WORDS)]
    at = keys.select(_block(F.col("_key"), blocks).alias("_block"), *masks)
    return at.groupBy("_block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def maybe_listed(candidates: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of ``candidates`` whose ``_key`` the filter of ``keys`` may hold: all true hits, few others."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // 256))
    table = bloom(keys, blocks)
    table = F.broadcast(table) if blocks <= SMALL_ROWS else table
    probed = candidates.withColumn("_block", _block(F.col("_key"), blocks)).join(table, "_block")
    hit = F.lit(True)
    for j, w in enumerate(WORDS):
        hit = hit & (F.col(w).bitwiseAND(_mask(F.col("_key"), j)) == _mask(F.col("_key"), j))
    return probed.filter(hit).drop("_block", *WORDS)


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Keys of rules and listed URLs; among rules with one host and path the first verdict by name counts."""
    longest = F.length(F.concat("host", "path"))
    of_rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        F.concat(F.lit("p"), "host", "path").alias("_key"),
        F.struct(longest.alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("_hit"),
    )
    host, path = parse(F.col("url"))
    form = canonical(host, path)
    urls = listed.select(form.alias("_form")).filter("_form <> ''").distinct()
    none = F.struct(F.lit(-1).alias("size"), F.lit(-1).alias("host_size"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    return of_rules.unionByName(urls.select(F.concat(F.lit("u"), "_form").alias("_key"), none.alias("_hit")))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (the longest that fits, or null) and verdict to every page.

    ``rules`` has verdict, host and path; ``listed`` has the column url. A rule's verdict goes before
    the list's, which is ``block``; without either it is ``default``.
    """
    entries = cut(_entries(rules, listed))
    n_keys = entries.count()
    sizes = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # bounded by the longest path
    address = F.col(f"`{url}`").cast("string")
    host, path = parse(address)
    distinct = pages.select(address.alias("_url")).filter(F.col("_url").isNotNull()).distinct()
    host_of, path_of = parse(F.col("_url"))
    distinct = distinct.select("_url", host_of.alias("_host"), path_of.alias("_path")).filter("_host <> '' or _path <> ''")
    lengths = F.array(*map(F.lit, sorted(sizes))) if sizes else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    of_rules = F.flatten(
        F.transform(_suffixes(F.col("_host")), lambda h: F.transform(prefixes, lambda p: F.concat(F.lit("p"), h, p)))
    )
    keys = F.concat(of_rules, F.array(F.concat(F.lit("u"), canonical(F.col("_host"), F.col("_path")))))
    candidates = distinct.select("_url", F.explode(keys).alias("_key"))
    exact = F.broadcast(entries) if n_keys <= SMALL_ROWS else entries
    found = maybe_listed(candidates, entries, n_keys).join(exact, "_key").groupBy("_url").agg(F.max("_hit").alias("_hit"))
    named = pages.withColumns({"_address": address, "_host": host, "_path": path})
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = named.join(found, F.col("_address") == F.col("_url"), "left")
    return judged.select(
        *kept,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_hit.rule").alias("rule"),
        F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"),
    )


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def listed_pages(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS, url: str = "url") -> DataFrame:
    """Block list: the URLs of ``pages`` whose host has one of the ``labels``."""
    host, _ = parse(F.col(f"`{url}`"))
    return pages.filter(F.arrays_overlap(F.split(host, "[.]"), F.array(*map(F.lit, labels)))).select(F.col(f"`{url}`").alias("url"))


def twin_sql() -> str:
    """DuckDB SQL for ``judge`` with the given rules and labels over ``pages``."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ordered)
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    form = "regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '')"
    return f"""
with rests as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
parsed as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from rests),
listed as (
  select distinct {form} form from parsed
  where len(list_intersect(string_split(host, '.'), [{labels}])) > 0)
select page_id, host, path, case {rule} end rule,
       case {verdict} when {form} in (select form from listed) then 'block' else 'allow' end verdict
from parsed"""
