"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger keeps the measurements
and one bit per failed rule. A policy is a version with a mask of rules: applying
another version, or asking what a rule changes, reads the ledger and no text again.
Everything is DataFrame expressions.

Repeats inside a text need no shuffle: the 3-word windows are hashed to 64 bits, sorted
inside the row together with their places, and equal neighbours are the repeats.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import words_of

# (rule, failed when), by bit. Integer arithmetic keeps the borders exact.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("exclamations", "100 * n_exclamations > 20 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*rules: str) -> int:
    return reduce(lambda m, r: m | BIT[r], rules, 0)


BASE = mask("few_words", "repeats")
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | mask("symbols", "repeated_lines"),
    "v3": BASE | mask("symbols", "repeated_lines", "long_words", "short_words", "capitals", "exclamations"),
}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")


def _count(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, characters, ""))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements) of every text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count(F.col("text"), r"[A-Z]").alias("n_capitals"),
        _count(F.col("text"), r"!").alias("n_exclamations"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))).drop("h")
    # Most texts have no window twice; only the others are sorted with places.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(again, placed)).drop("windows")
    twin = lambda x, i: (x["x"] == F.get("sorted", i - 1)["x"]) | (x["x"] == F.get("sorted", i + 1)["x"])
    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))).drop("sorted")
    # A place covers three words, or as many as there are before the next place.
    covered = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))
    # A filter on a measurement would be pushed below the steps above, one expression inside the
    # other, and evaluate whole arrays for every element. It can't pass a generated column.
    return rows.select("doc_id", F.inline(F.array(F.struct(*MEASURES))))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failures): bit k of ``failures`` is set where rule k failed.

    Needs doc_id and text. Null, empty and wordless texts have zero words and fail only
    ``few_words``. Rows stay as they are: repeated ids give repeated rows.
    """
    bits = [F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, failed) in enumerate(RULES)]
    return measures(docs).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(table: DataFrame, version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return table.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policies[version])) == 0)


def ablations(table: DataFrame, version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """What each rule of a policy does: (rule, failed, failed_alone, kept_with, kept_without), in one aggregate.

    ``failed_alone`` are the documents that only this rule rejects; without it they would be kept.
    """
    of = policies[version]
    failed = F.col("failures").bitwiseAND(F.lit(of))
    chosen = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if of & (1 << k)]
    sums = [F.sum((failed == 0).cast("long")).alias("kept")]
    for name, bit in chosen:
        sums += [F.sum((failed.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"any_{name}"), F.sum((failed == bit).cast("long")).alias(f"one_{name}")]
    row = table.agg(*sums)
    parts = [F.struct(F.lit(n).alias("rule"), F.coalesce(f"any_{n}", F.lit(0)).alias("failed"), F.coalesce(f"one_{n}", F.lit(0)).alias("failed_alone")) for n, _ in chosen]
    out = row.select(F.coalesce("kept", F.lit(0)).alias("kept_with"), F.explode(F.array(*parts)).alias("r"))
    return out.select("r.rule", "r.failed", "r.failed_alone", "kept_with", (F.col("kept_with") + F.col("r.failed_alone")).alias("kept_without"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    table = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failures").bitwiseAND(F.lit(BASE)) != 0
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


OP3_SQL = r"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select k, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select k, i from g qualify count(*) over (partition by k, g) > 1),
c as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from r) group by k),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(ls) as n_lines,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals, length(regexp_replace(text, '[^!]', '', 'g')) as n_exclamations
  from w left join c using (k)),
f as (
  select *, cast((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (100 * n_symbols > 20 * n_words)::int
    + 8 * (100 * n_dup_lines > 50 * n_lines)::int + 16 * (word_chars > 12 * n_words)::int + 32 * (word_chars < 2 * n_words)::int
    + 64 * (100 * n_capitals > 40 * word_chars)::int + 128 * (100 * n_exclamations > 20 * n_words)::int as bigint) as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 as base_failed, failures = 0 as kept, failures from f
"""
