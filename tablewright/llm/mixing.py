"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its id. A budget of a source is a threshold on
that hash: the documents below it are taken, so that a larger budget takes a superset
of a smaller one. The threshold comes from histograms: words are summed by source and
hash bucket (12 bits), the bucket in which the running sum passes the budget is the
boundary, and only its documents are summed again by the next 12 bits, until the
boundary is a single hash. No documents are sorted; a histogram has at most 4096
rows for each source and budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.names import free_name, ref
from .common import broadcast_ids, stage

HASH_BITS, STEP_BITS = 60, 12
WEIGHTS, SHARE_PERCENT, MOST_TIMES = (5, 2, 1), 150, 2


def words_of(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def id_hash(doc_id) -> F.Column:
    """60 bits of the MD5 of the id as text; a null id hashes as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """Adds ``target`` to a table (source, source_size), one row per source.

    Sources in code-point order, null last, get the weights in turn and share
    ``share_percent`` of all sizes by weight. Where a target would exceed ``most`` times
    the source's size it stops there and the excess is shared again by weight among
    the others. That fixed point is ``min(most * size, level * weight)`` with one level:
    sources are ranked by the level at which they stop, and the level of the others
    follows from running sums. One task holds the rows of this table, not documents.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("limit") / F.col("weight"))
    by_stop = Window.orderBy(F.col("stop"), F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("limit").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share_percent / 100) - stopped) / rest)
    rows = rows.withColumn("rank", F.row_number().over(by_stop))  # sources may stop at the same level
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("rank", "level"))).over(whole)["level"]
    reached = F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", reached.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash below which documents are taken, for every (source, budget name, budget).

    ``rows`` has source, size and hash; ``budgets`` has source, name and budget (words,
    at most the source's size). Returns source, name and below. The document at the
    boundary is taken if that brings the sum nearer to the budget (or as near).
    """
    state = stage(budgets.select("source", "name", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("path")))
    sized = F.col("size") > 0
    for level in range(1, HASH_BITS // STEP_BITS + 1):
        above, here = HASH_BITS - STEP_BITS * (level - 1), HASH_BITS - STEP_BITS * level
        marks = state.select(F.col("source").alias("s"), "name", "rest", "path")
        inside = rows.filter(sized).join(broadcast_ids(marks), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", above) == F.col("path")))
        sums = inside.groupBy("source", "name", F.shiftright("hash", here).alias("path")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("rest").alias("rest")
        )
        upto = F.sum("words").over(Window.partitionBy("source", "name").orderBy("path"))
        sums = sums.withColumn("before", upto - F.col("words")).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        state = stage(sums.select("source", "name", (F.col("rest") - F.col("before")).alias("rest"), "path", "words", "low", "high"))
        if state.filter("low < high").isEmpty():
            break
    nearer = F.col("words") - F.col("rest") <= F.col("rest")
    return state.select("source", "name", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("below"))


def mixture(rows: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target, times, below): a source's documents are taken ``times`` times, those below once more."""
    sources = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = targets(sources, weights, share_percent, most)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = stage(plan.withColumn("times", times.cast("long")))
    budget = F.col("target") - F.col("times") * F.col("source_size")
    budgets = plan.select("source", F.lit(1).alias("name"), budget.alias("budget")).filter("budget > 0")
    cut = thresholds(rows, budgets).select(F.col("source").alias("s"), "below")
    return stage(plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(*plan.columns, F.coalesce("below", F.lit(0)).alias("below")))


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """(doc_id, source, size, source_size, target, times) of every document; ``times`` is how often the mix holds it.

    Needs doc_id, text and source. The size of a document is its number of words (a
    null text has 0). A null source is a source. Rows that share a doc_id are taken
    alike. Documents of size 0 and an empty table give rows and no words. The result
    depends on ids, sources and sizes only, so runs agree under any partitioning.
    """
    rows = stage(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), id_hash(F.col("doc_id")).alias("hash")))
    plan = broadcast_ids(mixture(rows, weights, share_percent, most).withColumnRenamed("source", "s"))
    once_more = F.when((F.col("hash") < F.col("below")) & (F.col("times") < most), 1).otherwise(0)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("times") + once_more).alias("times"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """The documents of the mix with their columns, whatever their names, each as often as it is taken."""
    rows = stage(docs.select("source", F.size(words_of(F.col("text"))).cast("long").alias("size"), id_hash(F.col("doc_id")).alias("hash")))
    of, times, below, copy = (free_name(n, docs.columns) for n in ("mix_source", "mix_times", "mix_below", "mix_copy"))
    plan = mixture(rows, weights, share_percent, most).select(F.col("source").alias(of), F.col("times").alias(times), F.col("below").alias(below))
    joined = docs.join(broadcast_ids(plan), F.col("source").eqNullSafe(ref(of)))
    count = ref(times) + F.when((id_hash(F.col("doc_id")) < ref(below)) & (ref(times) < most), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(1), count.cast("int")))
    return joined.withColumn(copy, copies).select(*[ref(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select source, source_size, 2.0::double * source_size as cap,
         list_extract([5.0::double, 2.0, 1.0], 1 + (row_number() over (order by source nulls last) - 1) % 3) as weight from s),
l as (
  select *, cap / weight as stop, row_number() over (order by cap / weight, source nulls last) as rank,
         (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
k as (select min_by(level, rank) as level from l where level <= stop),
t as (select source, source_size, least(cap, coalesce(k.level * weight, cap)) as target from l left join k on true),
r as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as times from t),
c as (
  select d.doc_id, d.size, r.source_size, r.target, r.times, r.target - r.times * r.source_size as rest,
         sum(size) over (partition by d.source order by h) as upto, sum(size) over (partition by d.source, h) as own
  from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
       cast(size * (times + case when upto - own < rest and (upto - rest <= rest - (upto - own)) then 1 else 0 end) as bigint) as taken
from c
"""
