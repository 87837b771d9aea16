"""Window functions: ranking, offsets, fills and ROWS-framed aggregates.

A group that fits one task is a plain Spark window. A group above
`hot_limit` rows (an un-partitioned window over a large table, or one key with
much of the data) is numbered by range partitions and computed in blocks of
consecutive rows: offsets and bounded frames see copied neighbour rows at the
block edges, unbounded frames add a carry of the other blocks, and whole-group
values come from an aggregate. Results are the same either way.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import CNT, RN, attach, broadcast_if_small, hot_groups, hot_limit, number_large, split_hot, stage
from ..plans.names import Order, UniqueOrder, order_items, ref, require_columns, sort_columns, total_order
from ..streaming import require_batch

RANKING = ("row_number", "rank", "dense_rank", "avg_rank", "percent_rank", "cume_dist", "ntile")
PEER_RANKS = ("rank", "dense_rank", "avg_rank", "percent_rank", "cume_dist")
OFFSET = ("lag", "lead")
WHOLE = ("first_value", "last_value", "nth_value")
FILL = ("fill_down", "fill_up")
MERGEABLE = ("sum", "mean", "average", "min", "max", "count", "product", "stdev", "variance")
FRAMED = (*MERGEABLE, "mode", "median")
SPREAD = ("stdev", "variance")
RUNNING = (None, 0)
TOTAL = (None, None)
BLK = "__blk"
MEDIAN_ROWS = 250_000  # most rows whose running median one Python worker computes
RANK_BITS = 4  # bits of a bucket's number that one pass of the search settles


@dataclass(frozen=True)
class Spec:
    """One output column."""

    out: str
    fn: str
    column: str | None = None
    args: tuple = ()
    frame: tuple[int | None, int | None] = field(default=RUNNING)


def parse_specs(derive: dict, frames: dict | None = None) -> list[Spec]:
    """``{out: "row_number"}`` or ``{out: (fn, column, *args)}``; ``ntile`` takes its count."""
    frames = frames or {}
    unknown = set(frames) - set(derive)
    if unknown:
        raise ValueError(f"frames for columns that are not derived: {sorted(unknown)}")
    specs = []
    for out, spec in derive.items():
        parts = (spec,) if isinstance(spec, str) else tuple(spec)
        fn = parts[0]
        if fn not in (*RANKING, *OFFSET, *WHOLE, *FILL, *FRAMED):
            raise ValueError(f"unknown window function: {fn}")
        if fn in RANKING:
            specs.append(Spec(out, fn, None, parts[1:]))
        else:
            column = parts[1] if len(parts) > 1 else None
            if column is None and fn != "count":
                raise ValueError(f"{fn} needs a column")
            frame = tuple(frames.get(out, RUNNING))
            lo, hi = frame
            if lo is not None and hi is not None and lo > hi:
                raise ValueError(f"frame {frame} starts after it ends")
            specs.append(Spec(out, fn, column, parts[2:], frame))
    return specs


def window(
    df: DataFrame,
    derive: dict,
    order_by: Order,
    partition_by: Sequence[str] = (),
    frames: dict | None = None,
) -> DataFrame:
    """Adds the derived columns; an existing column of the same name is replaced.

    Aggregates default to the frame from the group's start to the row; frames are
    ROWS offsets, ``None`` is unbounded. Ranking, offsets and first / last / nth
    see the whole group. Ties of the order are broken by the other columns,
    except in rank, dense_rank, avg_rank, percent_rank and cume_dist, where they
    count as peers.
    """
    require_batch(df, "window")
    keys, specs = list(partition_by), parse_specs(derive, frames)
    require_columns(df, [*keys, *[s.column for s in specs if s.column]])
    half = [s for s in specs if s.fn in ("median", "mode") and s.frame != TOTAL and None in s.frame]
    if half:
        return _half_unbounded(df, specs, half, order_by, keys)
    return _windows(df, specs, order_by, keys)


def _windows(df: DataFrame, specs: Sequence[Spec], order_by: Order, keys: list[str]) -> DataFrame:
    hot = hot_groups(df, keys)
    if hot is None:
        return plain_windows(df, specs, order_by, keys)
    if not keys:
        rows = hot.first()[CNT]
        return _hot_windows(df, specs, order_by, keys, rows)
    cold_rows, hot_rows = split_hot(df, keys, hot)
    rows = hot.agg(F.sum(CNT)).first()[0]
    return plain_windows(cold_rows, specs, order_by, keys).unionByName(
        _hot_windows(hot_rows, specs, order_by, keys, rows)
    )


# Half-unbounded median and mode ----------------------------------------------


def _half_unbounded(df: DataFrame, specs, half, order_by: Order, keys: list[str]) -> DataFrame:
    """Each such column apart, then the others; helper names are dropped at the end."""
    order = UniqueOrder((n, "desc" if d else "asc") for n, d in total_order(df, order_by))
    out = df
    made = {}
    for i, s in enumerate(half):
        made[s.out] = f"__half{i}"
        step = _running_mode if s.fn == "mode" else _running_median
        out = step(out, s, made[s.out], order, keys)
    rest = [s for s in specs if s not in half]
    helpers = list(made.values())
    if rest:
        ranked = [s for s in rest if s.fn in PEER_RANKS]
        placed = [s for s in rest if s.fn not in PEER_RANKS]
        out = _windows(out, placed, order, keys) if placed else out
        out = _windows(out, ranked, order_by, keys) if ranked else out
    names = [*df.columns, *[s.out for s in specs if s.out not in df.columns]]
    return out.select(*[F.col(made[n]).alias(n) if n in made else ref(n) for n in names if n not in helpers])


def _running_mode(df: DataFrame, s: Spec, out: str, order, keys: list[str]) -> DataFrame:
    """The mode of all rows up to a row (or from it on), as a running minimum.

    With ``c`` the count of a row's value so far, the mode is the value of the
    row with the largest ``c`` seen, the smallest such value on a tie.
    """
    forward = s.frame[0] is None
    flip = {"asc": "desc", "desc": "asc"}
    count_order = order if forward else UniqueOrder((n, flip[d]) for n, d in order)
    seen, best = f"{out}_seen", f"{out}_best"
    counted = _windows(df, [Spec(seen, "row_number")], count_order, [*keys, *([] if s.column in keys else [s.column])])
    pair = F.when(ref(s.column).isNotNull(), F.struct((-F.col(seen)).alias("c"), ref(s.column).alias("v")))
    counted = counted.withColumn(best, pair)
    rows = UniqueOrder([*order, (seen, "asc" if forward else "desc")])
    done = _windows(counted, [Spec(out, "min", best, frame=s.frame)], rows, keys)
    return done.withColumn(out, F.col(out)["v"]).drop(seen, best)


def _running_median(df: DataFrame, s: Spec, out: str, order, keys: list[str]) -> DataFrame:
    """Two heaps: one task per group, or per block of a group above the hot limit or what Python should hold."""
    hot = hot_groups(df, keys, median_rows(df))
    if hot is None:
        return _group_medians(df, s, out, order, keys)
    if not keys:
        return _block_medians(df, s, out, order, keys, hot.first()[CNT])
    cold_rows, hot_rows = split_hot(df, keys, hot)
    rows = hot.agg(F.sum(CNT)).first()[0]
    return _group_medians(cold_rows, s, out, order, keys).unionByName(_block_medians(hot_rows, s, out, order, keys, rows))


def median_rows(df: DataFrame) -> int:
    return min(hot_limit(df.sparkSession), MEDIAN_ROWS)


def _group_medians(df: DataFrame, s: Spec, out: str, order, keys: list[str]) -> DataFrame:
    lo, hi = s.frame
    position = f"{out}_rn"
    numbered = plain_windows(df, [Spec(position, "row_number")], order, keys)
    narrow = numbered.select(*[ref(k) for k in keys], F.col(position), ref(s.column).cast("double").alias("__x"))
    fields = [df.schema[k] for k in keys] + [T.StructField(position, T.LongType()), T.StructField(out, T.DoubleType())]

    def medians(group):
        group = group.sort_values(position)
        values = group["__x"].to_numpy()
        group[out] = prefix_medians(values, hi) if lo is None else prefix_medians(values[::-1], -lo)[::-1]
        return group.drop(columns="__x")

    found = narrow.groupBy(*[ref(k) for k in keys]).applyInPandas(medians, T.StructType(fields))
    return attach_rows(numbered, found, [*keys, position]).drop(position)


def _block_medians(df: DataFrame, s: Spec, out: str, order, keys: list[str], rows: int) -> DataFrame:
    """The same for groups of any size, in blocks of consecutive rows.

    While a block adds m values to the N before it, the median moves among those of
    the N whose rank is within about m / 2 of N / 2. The values are ranked once and
    cut into buckets; a search in counts of (block, bucket) finds the buckets that hold
    those ranks. A block task gets its own rows and the earlier
    values of these buckets: at most `median_rows` rows in all. A frame that reaches the
    end counts positions from the end.
    """
    lo, hi = s.frame
    shift = hi if lo is None else -lo
    size = max(1, median_rows(df) // 4 - 1)
    at, x, bucket, group = f"{out}_at", f"{out}_x", f"{out}_bucket", [ref(k) for k in keys]
    place = F.col(RN) if lo is None else F.col(CNT) - F.col(RN) + 1
    numbered = number_large(df, keys, order, rows).withColumn(at, place)
    block = F.floor((F.col(at) - 1) / size).cast("long").alias(BLK)
    own = numbered.select(*group, block, F.col(at), F.nanvl(ref(s.column).cast("double"), F.lit(None)).alias(x))
    ranked = number_large(own.filter(F.col(x).isNotNull()), keys, UniqueOrder([x, at]), rows)
    ranked = ranked.select(*group, BLK, at, x, F.floor((F.col(RN) - 1) / size).cast("long").alias(bucket))
    needs = _median_buckets(own, ranked, keys, bucket, x)
    # By position: the rows of one bucket lie together, and many blocks may need them.
    spread = ranked.repartition(*group, F.col(at)).withColumnRenamed(BLK, f"{BLK}_of")
    near = attach_needs(spread, needs, [*keys, bucket]).filter(F.col(f"{BLK}_of") < F.col(BLK))
    near = near.select(*group, BLK, F.lit(None).cast("long").alias(at), x, "__n", "__below")
    tasks = own.withColumns({c: F.lit(None).cast("long") for c in ("__n", "__below")}).unionByName(near)
    fields = [df.schema[k] for k in keys] + [T.StructField(at, T.LongType()), T.StructField(out, T.DoubleType())]

    def medians(rows):
        places, values = rows[at].fill_null(0).to_numpy(), rows[x].to_numpy()
        mine = places > 0
        by_place = np.argsort(places[mine])
        n, below = pc.max(rows["__n"]).as_py() or 0, pc.min(rows["__below"]).as_py() or 0
        running = continued_medians(np.sort(values[~mine]), n, below, values[mine][by_place])
        done = rows.select(keys).slice(0, len(running))
        done = [*done.columns, pa.array(places[mine][by_place]), pa.array(running, from_pandas=True)]
        return pa.table(done, names=[*keys, at, out])

    found = stage(tasks.groupBy(*group, F.col(BLK)).applyInArrow(medians, T.StructType(fields)))
    if shift == 0:
        return attach_rows(numbered, found, [*keys, at]).drop(at, RN, CNT)
    # A row takes the median at its frame's end; places outside the group match none and differ, to spread the rows.
    end = F.col(at) + shift
    outside = end > F.col(CNT)
    moved = found.withColumnsRenamed({**{k: f"__k_{k}" for k in keys}, at: "__end_at"})
    cond = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"__k_{k}")) for k in keys], F.col("__end") == F.col("__end_at"))
    rows_at = numbered.withColumn("__end", F.when(outside, -F.col(at)).otherwise(end))
    joined = rows_at.join(moved, cond, "left").drop("__end", "__end_at", *[f"__k_{k}" for k in keys])
    if shift > 0:
        last = found.groupBy(*group).agg(F.max_by(out, at).alias("__last"))
        joined = attach(joined, last, keys).withColumn(out, F.when(outside, F.col("__last")).otherwise(F.col(out))).drop("__last")
    return joined.drop(at, RN, CNT)


def _median_buckets(own: DataFrame, ranked: DataFrame, keys: list[str], bucket: str, x: str) -> DataFrame:
    """(keys, bucket, block, __n, __below): the buckets of earlier values among which a block's medians move.

    ``__n`` counts the values before the block, ``__below`` those of them in lower buckets.
    Each block asks for the buckets of two ranks among the values before it. All asks go down
    the buckets together, `RANK_BITS` of a bucket's number at a time: a pass counts the earlier
    values in the lower parts by running sums over blocks. A pass sorts the (block, bucket)
    counts once, and no window group exceeds three rows per block.
    """
    group, node = [ref(k) for k in keys], f"{bucket}_node"
    cells = stage(ranked.groupBy(*group, BLK, bucket).agg(F.count(F.lit(1)).alias("__here")))
    depth = cells.agg(F.coalesce(F.max(bucket), F.lit(0))).first()[0].bit_length()
    before = Window.partitionBy(*group).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy(*group, BLK).agg(F.count(ref(x)).alias("__m")).withColumn("__n", F.sum("__m").over(before)).filter("__n > 0")
    first = F.greatest(F.lit(1), F.floor((F.col("__n") - F.col("__m")) / 2))
    last = F.least(F.col("__n"), F.floor((F.col("__n") + F.col("__m")) / 2) + 1)
    zero = F.lit(0).cast("long")
    asks = blocks.select(*group, BLK, "__n", F.explode(F.array(first, last)).alias("__rank"), zero.alias(node), zero.alias("__below"))
    # Asks come before the counts of their own block.
    earlier = Window.partitionBy(*group, node).orderBy(BLK, F.col("__rank").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    left = depth
    while left > 0:
        bits = min(RANK_BITS, left)
        left -= bits
        part = F.shiftright(bucket, left).bitwiseAND((1 << bits) - 1)
        lower = [f"__lower{i}" for i in range(1, 1 << bits)]
        sums = [F.sum(F.when(part < i, F.col("__here")).otherwise(0)).alias(c) for i, c in enumerate(lower, 1)]
        counted = cells.groupBy(*group, BLK, F.shiftright(bucket, left + bits).alias(node)).agg(*sums)
        met = asks.withColumns(dict.fromkeys(lower, zero)).unionByName(counted, allowMissingColumns=True)
        met = met.select(*group, BLK, "__n", "__rank", node, "__below", *[F.sum(c).over(earlier).alias(c) for c in lower]).filter("__rank is not null")
        # The part that holds the rank: as many lower sums as lie below it.
        passed = [F.col("__rank") > F.col("__below") + F.col(c) for c in lower]
        child = reduce(lambda a, b: a + b, [p.cast("long") for p in passed])
        skipped = F.greatest(zero, *[F.when(p, F.col(c)) for p, c in zip(passed, lower)])
        asks = met.select(*group, BLK, "__n", "__rank", (F.col(node) * (1 << bits) + child).alias(node), (F.col("__below") + skipped).alias("__below"))
    found = asks.groupBy(*group, BLK, "__n").agg(F.sequence(F.min(node), F.max(node)).alias("__span"), F.min("__below").alias("__below"))
    return found.select(*group, F.explode("__span").alias(bucket), BLK, "__n", "__below")


def attach_needs(df: DataFrame, needs: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on null-safe keys, one at least, with any number of matches."""
    small = broadcast_if_small(needs.withColumnsRenamed({k: f"__k_{k}" for k in keys}))
    cond = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"__k_{k}")) for k in keys])
    return df.join(small, cond).drop(*[f"__k_{k}" for k in keys])


def continued_medians(near, n: int, below: int, values):
    """Medians after each of ``values`` is added to ``n`` earlier ones; NaN is missing.

    ``near`` has the sorted earlier values among which the median moves, ``below``
    of the others are smaller.
    """
    half = (n + 1) // 2 - below
    low, high = (-near[:half][::-1]).tolist(), near[half:].tolist()
    running = np.full(len(values), np.nan)
    for i, v in enumerate(values.tolist()):
        if v == v:
            heapq.heappush(high, -heapq.heappushpop(low, -v))
            n += 1
            if len(low) < (n + 1) // 2 - below:
                heapq.heappush(low, -heapq.heappop(high))
        if n:
            running[i] = -low[0] if n % 2 else (high[0] - low[0]) / 2
    return running


def attach_rows(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one join on null-safe keys."""
    renamed = found.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = [ref(k).eqNullSafe(ref(f"__k_{k}")) for k in keys]
    return df.join(renamed, reduce(lambda a, b: a & b, cond)).drop(*[f"__k_{k}" for k in keys])


def prefix_medians(values, shift: int):
    """Median of ``values[: i + shift + 1]`` for every i; NaN is missing."""
    low: list[float] = []
    high: list[float] = []
    running = np.full(len(values) + 1, np.nan)
    for i, x in enumerate(values):
        if x == x:
            heapq.heappush(high, -heapq.heappushpop(low, -x))
            if len(high) > len(low):
                heapq.heappush(low, -heapq.heappop(high))
        if low:
            running[i + 1] = -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
    return running[np.clip(np.arange(len(values)) + shift + 1, 0, len(values))]


def _with_outputs(df: DataFrame, outputs: dict[str, Column], names: Sequence[str]) -> DataFrame:
    return df.select(
        *[outputs[c].alias(c) if c in outputs else ref(c) for c in names],
        *[v.alias(k) for k, v in outputs.items() if k not in names],
    )


# One task per group ---------------------------------------------------------


def plain_windows(df: DataFrame, specs: Sequence[Spec], order_by: Order, keys: Sequence[str]) -> DataFrame:
    part = [ref(k) for k in keys]
    group = Window.partitionBy(*part)
    peers = group.orderBy(*sort_columns(order_items(order_by)))
    items = [(n, d) for n, d in total_order(df, order_by) if n not in keys] or order_items(order_by)
    rows, back = group.orderBy(*sort_columns(items)), group.orderBy(*sort_columns(items, reverse=True))
    same_key = Window.partitionBy(*part, *[ref(n) for n, _ in order_items(order_by)])
    names = df.columns
    means = {c: F.coalesce(mean.over(group), F.lit(0.0)) for c, mean in _finite_means(specs).items()}
    df, specs = _from_the_mean(df, specs, means)
    outputs = {}
    for s in specs:
        if s.fn in RANKING:
            outputs[s.out] = _plain_rank(s, rows, peers, same_key)
        elif s.fn in FRAMED:
            outputs[s.out] = _frame_value(s, group if s.frame == TOTAL else _framed(rows, back, *s.frame))
        else:
            outputs[s.out] = _positional(df, s, rows, back)
    return _with_outputs(df, outputs, names)


def _finite_means(specs: Sequence[Spec]) -> dict[str, Column]:
    """Mean of the finite values of each column whose spread is framed."""
    found = {}
    for name in dict.fromkeys(s.column for s in specs if s.fn in SPREAD):
        v = ref(name).cast("double")
        found[name] = F.avg(F.when(F.abs(v) < F.lit(float("inf")), v))
    return found


def _from_the_mean(df: DataFrame, specs: Sequence[Spec], means: dict[str, Column]) -> tuple[DataFrame, list[Spec]]:
    """Spreads of distances from the group's mean: values far from zero would lose the digits that differ."""
    away = {c: f"__away{i}" for i, c in enumerate(means)}
    finite = {c: F.when(F.abs(m) < F.lit(float("inf")), m).otherwise(F.lit(0.0)) for c, m in means.items()}
    out = df.withColumns({name: ref(c).cast("double") - finite[c] for c, name in away.items()}) if away else df
    return out, [replace(s, column=away[s.column]) if s.fn in SPREAD else s for s in specs]


def _framed(rows, back, lo: int | None, hi: int | None):
    """ROWS frame. One that reaches the end is taken from the reversed order.

    Spark evaluates a growing frame in one pass, but starts a shrinking one again
    for every row.
    """
    if lo is None:
        return rows.rowsBetween(Window.unboundedPreceding, hi)
    if hi is None:
        return back.rowsBetween(Window.unboundedPreceding, -lo)
    return rows.rowsBetween(lo, hi)


def _plain_rank(s: Spec, rows, peers, same_key) -> Column:
    if s.fn == "row_number":
        return F.row_number().over(rows).cast("long")
    if s.fn == "ntile":
        return F.ntile(int(s.args[0])).over(rows).cast("long")
    if s.fn == "avg_rank":
        return F.rank().over(peers) + (F.count(F.lit(1)).over(same_key) - 1) / F.lit(2)
    if s.fn in ("rank", "dense_rank"):
        return (F.rank if s.fn == "rank" else F.dense_rank)().over(peers).cast("long")
    return (F.percent_rank if s.fn == "percent_rank" else F.cume_dist)().over(peers)


def _positional(df: DataFrame, s: Spec, rows, back) -> Column:
    c = ref(s.column)
    everything = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if s.fn in OFFSET:
        step = int(s.args[0]) if s.args else 1
        default = s.args[1] if len(s.args) > 1 else None
        return (F.lag if s.fn == "lag" else F.lead)(c, step, default).over(rows)
    if s.fn == "first_value":
        return F.first(c).over(everything)
    if s.fn == "last_value":
        return F.last(c).over(everything)
    if s.fn == "nth_value":
        return F.nth_value(c, int(s.args[0])).over(everything)
    if s.fn == "fill_down":
        return F.last(fillable(df, s.column), ignorenulls=True).over(_framed(rows, back, None, 0))
    return F.last(fillable(df, s.column), ignorenulls=True).over(_framed(rows, back, 0, None))


def fillable(df: DataFrame, name: str) -> Column:
    """The value, with NaN as missing."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.nanvl(ref(name), F.lit(None)) if floating else ref(name)


def _frame_value(s: Spec, w, masked=None) -> Column:
    """The framed aggregate; ``masked`` hides rows outside the frame's own block."""
    hide = (lambda x: x) if masked is None else (lambda x: F.when(masked, x))
    if s.fn == "count":
        if masked is None:
            return F.count(F.lit(1)).over(w)
        return F.count(F.when(masked, F.lit(1))).over(w)
    c = hide(ref(s.column))
    if s.fn == "median" and s.frame == TOTAL and masked is None:
        return F.percentile(c.cast("double"), F.lit(0.5)).over(w)
    if s.fn == "median":
        ordered = F.array_sort(F.collect_list(c.cast("double")).over(w))
        n = F.size(ordered)
        low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
        high = F.try_element_at(ordered, F.floor((n + 2) / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)
    if s.fn == "mode":
        return F.mode(c, deterministic=True).over(w)
    if s.fn in ("min", "max"):
        return (F.min if s.fn == "min" else F.max)(c).over(w)
    d = c.cast("double")
    fn = {
        "sum": F.sum, "mean": F.avg, "average": F.avg, "product": F.product, "stdev": F.stddev_samp,
        "variance": F.var_samp,
    }[s.fn]
    return fn(d).over(w)


# Groups larger than a task --------------------------------------------------


def _hot_windows(df: DataFrame, specs, order_by: Order, keys: list[str], rows: int) -> DataFrame:
    return block_windows(number_large(df, keys, order_by, rows), specs, order_by, keys).drop(RN, CNT)


def block_windows(df: DataFrame, specs: Sequence[Spec], order_by: Order, keys: Sequence[str]) -> DataFrame:
    """The same functions over a numbered table (``__rn``, ``__cnt``)."""
    keys, base = list(keys), [c for c in df.columns]
    df, specs = _from_the_mean(*_with_means(df, specs, keys))
    if any(s.fn in PEER_RANKS for s in specs):
        df, rank_specs = _rank_marks(df, order_by, keys)
    else:
        rank_specs = []
    helper = list(rank_specs)
    plan = [*helper, *[s for s in specs if s.fn not in RANKING]]

    before = after = 0
    for s in plan:
        b, a = _reach(s)
        before, after = max(before, b), max(after, a)
    size = max(hot_limit(df.sparkSession), before, after)
    blocks = _with_neighbours(df, size, before, after)

    outputs: dict[str, Column] = {}
    members = Window.partitionBy(*[ref(k) for k in keys], BLK)
    block, back = members.orderBy(RN), members.orderBy(F.col(RN).desc())
    for i, s in enumerate(plan):
        outputs.update(_block_value(df, s, i, size, block, back))
    out = blocks.select(*[ref(c) for c in blocks.columns], *[v.alias(k) for k, v in outputs.items()])
    own = F.floor((F.col(RN) - 1) / size) == F.col(BLK)
    out = out.filter(own)

    for carry in _carries(df, plan, size, keys):
        on = [*keys, BLK] if BLK in carry.columns else keys
        if on:
            out = attach(out, carry, on)
        else:
            row = stage(carry)  # one row; each reference to a scalar reads it again
            out = out.withColumns({c: row.select(c).scalar() for c in row.columns})

    values = {s.out: _merged(s, i) for i, s in enumerate(plan)}
    kept = [ref(c) for c in df.columns if c not in values]
    result = out.select(*kept, *[v.alias(k) for k, v in values.items()])
    ranks = {s.out: _rank_value(s) for s in specs if s.fn in RANKING}
    names = [*base, *[s.out for s in specs if s.out not in base]]
    return result.select(*[ranks[c].alias(c) if c in ranks else ref(c) for c in names])


def _with_means(df: DataFrame, specs: Sequence[Spec], keys: list[str]):
    """`_from_the_mean`'s arguments; the means are one row per group, by an aggregate."""
    found = _finite_means(specs)
    if not found:
        return df, specs, {}
    names = {c: f"__mean{i}" for i, c in enumerate(found)}
    means = df.groupBy(*[ref(k) for k in keys]).agg(*[m.alias(names[c]) for c, m in found.items()])
    if keys:
        return attach(df, means, keys), specs, {c: F.coalesce(F.col(n), F.lit(0.0)) for c, n in names.items()}
    row = means.first()
    return df, specs, {c: F.lit(row[n] if row[n] is not None else 0.0) for c, n in names.items()}


def _reach(s: Spec) -> tuple[int, int]:
    """Neighbour rows needed before and after a block."""
    if s.fn in OFFSET:
        step = int(s.args[0]) if s.args else 1
        step = step if s.fn == "lag" else -step
        return max(step, 0), max(-step, 0)
    if s.fn in FRAMED:
        lo, hi = s.frame
        ends = [x for x in (lo, hi) if x is not None]
        return max([0, *[-x for x in ends]]), max([0, *ends])
    return 0, 0


def _with_neighbours(df: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """One row per block that needs it: its own, and a neighbour within reach."""
    own = F.floor((F.col(RN) - 1) / size).cast("long")
    if not before and not after:
        return df.withColumn(BLK, own)
    end = (own + 1) * size
    copies = [own]
    if before:
        copies.append(F.when((F.col(RN) > end - before) & (end < F.col(CNT)), own + 1))
    if after:
        copies.append(F.when((F.col(RN) <= own * size + after) & (own > 0), own - 1))
    return df.withColumn(BLK, F.explode(F.array_compact(F.array(*copies))))


def _block_value(df, s: Spec, i: int, size: int, block, back) -> dict[str, Column]:
    """Window columns of one spec inside a block, named ``__v<i>…``."""
    name = f"__v{i}"
    if s.fn in OFFSET:
        return {name: _positional(df, s, block, back)}
    if s.fn in WHOLE:
        return {}
    own_first, own_last = F.col(BLK) * size + 1, (F.col(BLK) + 1) * size
    own = F.col(RN).between(own_first, own_last)
    if s.fn in FILL:
        c = F.when(own, fillable(df, s.column))
        reach = (None, 0) if s.fn == "fill_down" else (0, None)
        return {name: F.last(c, True).over(_framed(block, back, *reach))}
    lo, hi = s.frame
    if s.frame == TOTAL:
        return {}
    if lo is not None and hi is not None:
        return {name: _frame_value(s, _framed(block, back, lo, hi))}
    frame = _framed(block, back, lo, hi)
    if lo is None:
        visible = F.col(RN) >= own_first + min(hi, 0)
    else:
        visible = F.col(RN) <= own_last + max(lo, 0)
    return {f"{name}_{k}": v.over(frame) for k, v in _moments(s, visible).items()}


def _moments(s: Spec, visible: Column | None = None) -> dict[str, Column]:
    """Aggregates that two disjoint row sets can merge."""
    hide = (lambda x: x) if visible is None else (lambda x: F.when(visible, x))
    if s.fn == "count":
        return {"n": F.count(hide(F.lit(1)))}
    c = ref(s.column)
    if s.fn in ("min", "max"):
        return {s.fn: (F.min if s.fn == "min" else F.max)(hide(c))}
    d = hide(c.cast("double"))
    if s.fn == "sum":
        return {"sum": F.sum(d)}
    if s.fn == "product":
        return {"product": F.product(d)}
    if s.fn in ("mean", "average"):
        return {"sum": F.sum(d), "n": F.count(d)}
    return {"n": F.count(d), "mean": F.avg(d), "var": F.var_pop(d)}


def _carries(df: DataFrame, plan: Sequence[Spec], size: int, keys: list[str]) -> list[DataFrame]:
    """What other blocks contribute, one row per block, and whole-group values, one row per group.

    Everything that shares a blocking is one aggregate, so the written table is
    scanned a few times however many columns are derived.
    """
    group = [ref(k) for k in keys]
    whole: list[Column] = []
    tables: list[DataFrame] = []
    blocked: dict[int, list[tuple[int, Spec]]] = {}
    for i, s in enumerate(plan):
        name = f"__c{i}"
        if s.fn in WHOLE:
            at = {"first_value": F.lit(1), "last_value": F.col(CNT)}.get(s.fn)
            at = F.lit(int(s.args[0])) if at is None else at
            whole.append(F.max(F.when(F.col(RN) == at, F.struct(ref(s.column).alias("v"))))["v"].alias(name))
        elif s.fn in FRAMED and s.frame == TOTAL:
            if s.fn in ("median", "mode"):
                from .aggregate import aggregate

                tables.append(aggregate(df, {name: (s.fn, s.column)}, keys, round_digits=None))
            else:
                whole.append(_plain_aggregate(s).alias(name))
        elif s.fn in FILL:
            blocked.setdefault(0, []).append((i, s))
        elif s.fn in MERGEABLE and None in s.frame:
            blocked.setdefault(_shift(s), []).append((i, s))
    if whole:
        tables.append(df.groupBy(*group).agg(*whole))
    for shift, members in blocked.items():
        tables.append(_block_carry(df, members, size, shift, group))
    return tables


def _shift(s: Spec) -> int:
    """Blocks of a carry end where the frame of a block's first (or last) row ends."""
    lo, hi = s.frame
    return -min(hi, 0) if lo is None else -max(lo, 0)


def _block_carry(df: DataFrame, members, size: int, shift: int, group: list[Column]) -> DataFrame:
    parts: list[Column] = []
    for i, s in members:
        if s.fn in FILL:
            edge = F.max_by if s.fn == "fill_down" else F.min_by
            here = F.when(fillable(df, s.column).isNotNull(), F.col(RN))
            parts.append(edge(F.struct(ref(s.column).alias("v")), here).alias(f"__p{i}"))
        else:
            parts += [v.alias(f"__p{i}_{k}") for k, v in _moments(s).items()]
    per_block = _by_block(df, size, shift).groupBy(*group, BLK).agg(*parts)
    whole = Window.partitionBy(*group)
    forward, back = whole.orderBy(BLK), whole.orderBy(F.col(BLK).desc())
    centred = [f"__p{i}" for i, s in members if s.fn in ("stdev", "variance")]
    per_block = per_block.withColumns({f"{p}_center": F.avg(f"{p}_mean").over(whole) for p in centred}) if centred else per_block
    earlier, later = _framed(forward, back, None, -1), _framed(forward, back, 1, None)
    merged: list[Column] = []
    for i, s in members:
        if s.fn == "fill_down":
            merged.append(F.last(f"__p{i}", True).over(earlier)["v"].alias(f"__c{i}"))
        elif s.fn == "fill_up":
            merged.append(F.last(f"__p{i}", True).over(later)["v"].alias(f"__c{i}"))
        else:
            w = earlier if s.frame[0] is None else later
            merged += [v.alias(f"__c{i}_{k}") for k, v in _merge_over(s, i, w).items()]
    return per_block.select(*group, BLK, *merged)


def _by_block(df: DataFrame, size: int, shift: int) -> DataFrame:
    return df.withColumn(BLK, F.floor((F.col(RN) - 1 + shift) / size).cast("long"))


def _merge_over(s: Spec, i: int, w) -> dict[str, Column]:
    """`_moments` of many blocks merged over a window of blocks."""
    p = {k: F.col(f"__p{i}_{k}") for k in ("n", "sum", "min", "max", "product", "mean", "var")}
    if s.fn == "count":
        return {"n": F.sum(p["n"]).over(w)}
    if s.fn in ("min", "max"):
        return {s.fn: (F.min if s.fn == "min" else F.max)(p[s.fn]).over(w)}
    if s.fn == "sum":
        return {"sum": F.sum(p["sum"]).over(w)}
    if s.fn == "product":
        return {"product": F.product(p["product"]).over(w)}
    if s.fn in ("mean", "average"):
        return {"sum": F.sum(p["sum"]).over(w), "n": F.sum(p["n"]).over(w)}
    # Squares of distances from one centre of the group: squares of the values themselves would cancel.
    n, away = F.sum(p["n"]).over(w), p["mean"] - F.col(f"__p{i}_center")
    shift = F.try_divide(F.sum(p["n"] * away).over(w), n)
    square = F.try_divide(F.sum(p["n"] * (p["var"] + away * away)).over(w), n)
    return {"n": n, "mean": F.max(f"__p{i}_center").over(w) + shift, "var": F.greatest(square - shift * shift, F.lit(0.0))}


def _merged(s: Spec, i: int) -> Column:
    """Block value and carry combined."""
    v, c = f"__v{i}", f"__c{i}"
    if s.fn in WHOLE or (s.fn in FRAMED and s.frame == TOTAL):
        return F.col(c)
    if s.fn in FILL:
        return F.coalesce(F.col(v), F.col(c))
    lo, hi = s.frame
    if s.fn in OFFSET or s.fn not in MERGEABLE or (lo is not None and hi is not None):
        return F.col(v)

    def both(k: str, combine) -> Column:
        a, b = F.col(f"{v}_{k}"), F.col(f"{c}_{k}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))

    if s.fn == "count":
        return both("n", lambda a, b: a + b)
    if s.fn == "sum":
        return both("sum", lambda a, b: a + b)
    if s.fn == "product":
        return both("product", lambda a, b: a * b)
    if s.fn in ("min", "max"):
        return both(s.fn, F.least if s.fn == "min" else F.greatest)
    if s.fn in ("mean", "average"):
        return F.try_divide(both("sum", lambda a, b: a + b), both("n", lambda a, b: a + b))
    n1, n2 = F.coalesce(F.col(f"{v}_n"), F.lit(0)), F.coalesce(F.col(f"{c}_n"), F.lit(0))
    m1, m2 = F.coalesce(F.col(f"{v}_mean"), F.lit(0.0)), F.coalesce(F.col(f"{c}_mean"), F.lit(0.0))
    s1 = n1 * F.coalesce(F.col(f"{v}_var"), F.lit(0.0))
    s2 = n2 * F.coalesce(F.col(f"{c}_var"), F.lit(0.0))
    n = n1 + n2
    spread = s1 + s2 + F.coalesce(F.try_divide((m1 - m2) * (m1 - m2) * n1 * n2, n), F.lit(0.0))
    variance = F.when(n > 1, spread / (n - 1))
    return F.sqrt(variance) if s.fn == "stdev" else variance


def _plain_aggregate(s: Spec) -> Column:
    if s.fn == "count":
        return F.count(F.lit(1))
    c = ref(s.column)
    if s.fn in ("min", "max"):
        return (F.min if s.fn == "min" else F.max)(c)
    fn = {
        "sum": F.sum, "mean": F.avg, "average": F.avg, "product": F.product, "stdev": F.stddev_samp,
        "variance": F.var_samp,
    }[s.fn]
    return fn(c.cast("double"))


def _rank_marks(df: DataFrame, order_by: Order, keys: list[str]) -> tuple[DataFrame, list[Spec]]:
    """Marks the first and last row of each run of peers.

    The rank is then the last marked position down to a row, the end of the run
    the first marked position from it on, the dense rank a running count of marks.
    """
    names = [n for n, _ in order_items(order_by)]
    size = hot_limit(df.sparkSession)
    blocks = _with_neighbours(df, size, 1, 1)
    w = Window.partitionBy(*[ref(k) for k in keys], BLK).orderBy(RN)
    peer = F.struct(*[ref(n) for n in names])
    marked = blocks.select(
        *[ref(c) for c in blocks.columns],
        (~F.coalesce(F.lag(peer).over(w).eqNullSafe(peer), F.lit(False))).alias("__starts"),
        (~F.coalesce(F.lead(peer).over(w).eqNullSafe(peer), F.lit(False))).alias("__ends"),
    ).filter(F.floor((F.col(RN) - 1) / size) == F.col(BLK)).drop(BLK)
    marked = marked.select(
        *[ref(c) for c in df.columns],
        F.when(F.col("__starts"), F.col(RN)).alias("__start_at"),
        F.when(F.col("__ends"), F.col(RN)).alias("__end_at"),
        F.when(F.col("__starts"), F.lit(1)).alias("__start_one"),
    )
    return marked, [
        Spec("__run_start", "fill_down", "__start_at"),
        Spec("__run_end", "fill_up", "__end_at"),
        Spec("__run_count", "sum", "__start_one"),
    ]


def _rank_value(s: Spec) -> Column:
    rn, cnt = F.col(RN), F.col(CNT)
    if s.fn == "row_number":
        return rn
    if s.fn == "ntile":
        n = int(s.args[0])
        small = F.floor(cnt / n)
        wide = cnt - small * n  # this many buckets hold one row more
        edge = wide * (small + 1)
        first = F.floor((rn - 1) / (small + 1))
        rest = wide + F.coalesce(F.floor(F.try_divide(rn - 1 - edge, small)), F.lit(0))
        return (F.when(rn <= edge, first).otherwise(rest) + 1).cast("long")
    start, end = F.col("__run_start"), F.col("__run_end")
    if s.fn == "rank":
        return start
    if s.fn == "dense_rank":
        return F.col("__run_count").cast("long")
    if s.fn == "avg_rank":
        return (start + end) / F.lit(2)
    if s.fn == "cume_dist":
        return end / cnt
    return F.when(cnt > 1, (start - 1) / (cnt - 1)).otherwise(F.lit(0.0))


__all__ = ["Spec", "block_windows", "parse_specs", "plain_windows", "window"]
