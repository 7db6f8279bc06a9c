"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Every measure of a text is a count, every rule compares two counts with a rational bound, so the
verdict needs no division and SQL engines agree on it. All work is one narrow projection per row:
no shuffle, no Python, and memory in proportion to one text.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text counts as an empty one: no words, all counts 0,
rejected by ``min_words``. A null or repeated id changes nothing: each input row gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a about all an and are as at be but by for from had has have he her his i in is it its not of on or our she so that "
    "the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einer es für haben hat ich im ist mit nach "
    "nicht noch nur oder sich sie sind über um und unter vom von vor war werden wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous ou où par pas plus pour qui que "
    "sa se ses son sont sur un une vous "
    "al como con del el ella ellos entre era esta este fue han hay lo los las más me mi muy no nos o para pero por si sin "
    "sobre su sus también te tiene una uno y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``scale * count`` is on the wrong side of ``bound * base``."""

    name: str
    count: str
    kind: str  # "min" or "max"
    bound: int
    scale: int = 1
    base: str | None = None

    def broken(self, counts: dict[str, Column]) -> Column:
        left = counts[self.count] * F.lit(self.scale)
        right = F.lit(self.bound) * (counts[self.base] if self.base else F.lit(1))
        return left < right if self.kind == "min" else left > right


BASE_RULES = (
    Rule("min_words", "n_words", "min", 50),
    Rule("max_repeat_words", "n_repeat_words", "max", 50, 100, "n_words"),
)
METHOD_RULES = (
    Rule("max_symbols_per_word", "n_symbols", "max", 10, 100, "n_words"),
    Rule("min_mean_word", "word_chars", "min", 2, 1, "n_words"),
    Rule("max_mean_word", "word_chars", "max", 25, 1, "n_words"),
    Rule("min_stop_words", "n_stop_words", "min", 1, 100, "n_words"),
    Rule("max_dup_lines", "n_dup_lines", "max", 50, 100, "n_lines"),
)


def words_of(text: Column) -> Column:
    """Array of the words of a text without nulls."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def _filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))


def _trigrams(words: Column) -> Column:
    """Hash of every window of three words, by the position of its first word."""
    starting = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(starting, 1, F.size(words) - 2)


def _covered(at: Column) -> Column:
    """Words covered by three-word windows that start at the ascending positions ``at``."""
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last"))
    return F.aggregate(
        at,
        state,
        lambda s, i: F.struct((s["sum"] + F.least(F.lit(3), i - s["last"])).alias("sum"), i.alias("last")),
        lambda s: s["sum"],
    )


def with_counts(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the counts of every text: words, their code points, symbols, stop words, lines, repeats.

    Columns added: n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines and
    n_repeat_words (long), each behind ``prefix``; existing columns of these names are replaced.
    Windows are compared by 64-bit hashes within one text. A text whose window hashes are all
    distinct, the usual case, skips the sorting of positions.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, SYMBOL, ""))
    # one level for each array that is used twice; what a level no longer needs is not carried on
    df = df.withColumns({"_words": words_of(whole), "_lines": _filled_lines(whole), "_symbols": symbols})
    early = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.col("_symbols"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    no_grams = F.array().cast("array<long>")
    df = df.withColumns(
        {prefix + name: value.cast("long") for name, value in early.items()}
        | {"_grams": F.when(F.size("_words") >= 3, _trigrams(F.col("_words"))).otherwise(no_grams)}
    ).drop("_words", "_lines", "_symbols")
    tagged = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    nothing = F.array().cast("array<struct<g:bigint,i:int>>")
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_sorted", F.when(repeats, tagged).otherwise(nothing)).drop("_grams")
    rows = F.col("_sorted")
    twice = F.filter(
        rows,
        lambda x, k: ((k > 0) & (F.get(rows, k - 1)["g"] == x["g"])) | F.coalesce(F.get(rows, k + 1)["g"] == x["g"], F.lit(False)),
    )
    repeated = _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))
    return df.withColumn(f"{prefix}n_repeat_words", repeated).drop("_sorted")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def judge(
    df: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    method: tuple[Rule, ...] = METHOD_RULES,
    prefix: str = "",
) -> DataFrame:
    """Add the counts, ``base_failed``, ``kept`` and ``failed`` (comma-joined names of broken rules).

    All rules become one projection; ``failed`` lists them in the order of the tables.
    """
    df = with_counts(df, text, prefix)
    counts = {name: F.col(f"`{prefix}{name}`") for name in COUNTS}
    broken = [F.when(rule.broken(counts), F.lit(rule.name)) for rule in (*base, *method)]
    any_of = lambda rules: F.coalesce(*[F.when(r.broken(counts), F.lit(True)) for r in rules], F.lit(False))
    return df.withColumns(
        {
            f"{prefix}base_failed": any_of(base) if base else F.lit(False),
            f"{prefix}kept": ~any_of((*base, *method)) if base or method else F.lit(True),
            f"{prefix}failed": F.concat_ws(",", *broken),
        }
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows whose text breaks no rule, with their columns unchanged.

    The row number keeps the optimizer from copying the counts' expressions into the filter.
    """
    judged = judge(docs, text, prefix="_rule_").withColumn("_rule_row", F.monotonically_increasing_id())
    return judged.filter(F.col("_rule_kept") & (F.col("_rule_row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _words_sql(name: str) -> str:
    return f"[x for x in string_split_regex({name}, '[\\x20\\x09-\\x0D]+') if x <> '']"


def _broken_sql(rule: Rule) -> str:
    right = f"{rule.bound} * {rule.base}" if rule.base else f"{rule.bound}"
    return f"{rule.scale} * {rule.count} {'<' if rule.kind == 'min' else '>'} {right}"


def twin_sql(source: str = "documents") -> str:
    """DuckDB SQL for ``judge`` over ``source``, as the query returns it."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    base = " or ".join(f"({_broken_sql(r)})" for r in BASE_RULES)
    rest = " or ".join(f"({_broken_sql(r)})" for r in METHOD_RULES)
    names = ", ".join(f"case when {_broken_sql(r)} then '{r.name}' end" for r in (*BASE_RULES, *METHOD_RULES))
    return f"""
with docs as (select doc_id, coalesce(text, '') t, row_number() over () k from {source}),
parts as (
  select k, doc_id, t, {_words_sql("t")} words,
         [x for x in string_split(t, chr(10)) if translate(x, {spaces}, '') <> ''] rows_of
  from docs),
grams as (
  select k, i, count(*) over (partition by k, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) c
  from (select k, words, unnest(range(1, len(words) - 1)) i from parts)),
repeats as (
  select k, count(distinct i + o) n from grams, (select unnest([0, 1, 2]) o) where c > 1 group by k),
counts as (
  select doc_id, cast(len(words) as bigint) n_words, cast(length(translate(t, {spaces}, '')) as bigint) word_chars,
         cast(length(t) - length(regexp_replace(t, '{SYMBOL}', '', 'g')) as bigint) n_symbols,
         cast(len([x for x in words if lower(x) in ({stop})]) as bigint) n_stop_words,
         cast(len(rows_of) as bigint) n_lines,
         cast(len(rows_of) - len(list_distinct(rows_of)) as bigint) n_dup_lines,
         cast(coalesce(n, 0) as bigint) n_repeat_words
  from parts left join repeats using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} base_failed,
       not ({base} or {rest}) kept, n_stop_words, n_lines, concat_ws(',', {names}) failed
from counts"""
