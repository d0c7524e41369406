"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every text. Its failure is one bit of `fail_bits`, beside the measurements it was
decided on. A policy is a versioned mask over those bits: applying another policy, or asking what one rule alone
rejects, reads the ledger and never the texts. Everything is row-local: no shuffle, no Python on the executors.

Defined results: a null or empty text has zero measurements and fails `few_words`; rows are never merged, so repeated
rows give repeated ledger rows; an empty table gives an empty ledger; other columns of the input, whatever their names,
are carried in `row` and returned unchanged by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule holds its bit and the SQL condition on the measurements under which a text fails."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "capitals", "2 * n_upper > n_letters"),
    Rule(7, "few_letters", "2 * n_letters < word_chars"),
)


def mask(*names: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


#: Policies by version. A version never changes once it is used; a new idea is a new version.
POLICIES = {
    "base-1": mask("few_words", "repeated_windows"),
    "prose-1": mask("few_words", "repeated_windows", "symbols_per_word", "repeated_lines", "capitals", "few_letters"),
    "prose-2": mask(*(r.name for r in RULES)),
}
CURRENT = "prose-2"


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _shifted(values: Column, by: int) -> Column:
    """Each value hashed with the one `by` places later."""
    return F.zip_with(values, F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (the input row), MEASURES and `fail_bits` for every row of docs."""
    df = common.nested(docs, t=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumns({"w": common.words(F.col("t")), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)),
        "n_symbols": _removed(F.col("t"), r"[#*$%&|<>]"),
        "n_upper": _removed(F.col("t"), r"\p{Lu}"),
        "n_letters": _removed(F.col("t"), r"\p{L}"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "hashes": F.transform("w", lambda x: F.xxhash64(x)),
    })
    # Hashes of 8-word windows by doubling: 2, 4, then 8 words; 64 bits within one text.
    pairs = df.withColumn("hashes", _shifted(F.col("hashes"), 1))
    fours = pairs.withColumn("hashes", _shifted(F.col("hashes"), 2))
    df = fours.withColumn("hashes", F.slice(_shifted(F.col("hashes"), 4), F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))
    # Only where a window comes twice: sort (hash, place), keep places with an equal neighbour, and add up what they cover.
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    same = lambda x, j: (F.get("sorted", j - 1)["h"] == x["h"]) | (F.get("sorted", j + 1)["h"] == x["h"])
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, j: F.coalesce(same(x, j), (F.get("sorted", j - 1)["h"] == x["h"]), (F.get("sorted", j + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"])))
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x))
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0)).cast("long")
    # Through a generator of one row: a filter on the bits stays above it, where pushed down it would evaluate every measurement again.
    done = df.select("row", *MEASURES).withColumn("fail_bits", bits)
    return done.select("row", F.inline(F.array(F.struct(*MEASURES, "fail_bits"))))


def kept(policy: str = CURRENT) -> Column:
    """Whether the ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def filter_documents(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with their own columns."""
    return common.unnested(ledger(docs, text).where(kept(policy)))


def ablations(led: DataFrame) -> DataFrame:
    """For each policy and each of its rules: how many rows the policy rejects, how many fail the rule, and how many only that
    rule rejects, which is what dropping it would give back.

    The ledger is first counted by bit pattern (map-side, at most 2 ** len(RULES) patterns); the rest works on patterns.
    """
    patterns = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for p, m in POLICIES.items() for r in RULES if m >> r.bit & 1])
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.select("fail_bits", "n", F.inline(each))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails_rule"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.bit_or(hit).alias("bits_seen"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    led = ledger(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0
    return led.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & kept()).alias("kept"), "fail_bits", F.lit(CURRENT).alias("policy"))


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """The ablations of all policies over all documents."""
    return ablations(ledger(common.read(spark, sf_dir, "documents").select("doc_id", "text")))


def ledger_sql(table: str = "documents") -> str:
    """DuckDB: one row per row of table (all its columns as a struct d), with the same measurements and fail_bits."""
    bits = " + ".join(f"case when {r.fails} then {1 << r.bit} else 0 end" for r in RULES)
    return rf"""
    select d, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cast({bits} as bigint) as fail_bits from (
      select d, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::bigint as n_upper,
        (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::bigint as n_letters,
        len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words
      from (select row_number() over () as k, d, coalesce(d.text, '') as t, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as w,
              list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from {table} d) as m
      left join (
        select k as rk, count(distinct p + o) as n from (
          select k, p, count(*) over (partition by k, s) as c from (
            select k, p, array_to_string(list_slice(w, p, p + 7), ' ') as s from (
              select row_number() over () as k, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as w from {table} d), range(1, len(w) - 6) as g(p)
          )), range(0, 8) as o(o) where c > 1 group by k
      ) as rep on rep.rk = m.k)"""


SQL = f"""
select d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES["base-1"]}) <> 0 as base_failed,
  (fail_bits & {POLICIES["base-1"] | POLICIES[CURRENT]}) = 0 as kept, fail_bits, '{CURRENT}' as policy
from ({ledger_sql()})
"""

_RULES = ", ".join(f"('{p}', {m}, '{r.name}', {1 << r.bit})" for p, m in POLICIES.items() for r in RULES if m >> r.bit & 1)
ABLATION_SQL = f"""
select policy, rule, count_if(fail_bits & mask <> 0)::bigint as rejected, count_if(fail_bits & bit <> 0)::bigint as fails_rule,
  count_if(fail_bits & mask = bit)::bigint as only_this_rule, bit_or(fail_bits & mask)::bigint as bits_seen
from ({ledger_sql()}), (values {_RULES}) as r(policy, mask, rule, bit) group by policy, rule
"""
