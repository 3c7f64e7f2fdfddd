"""Order statistics and row numbers that never gather a large group in one task.

Every operator here works on *counts of distinct values*, so repeated values are
combined before the first shuffle. A group whose distinct values fit the limit is
ordered in one task; a larger group is cut into value ranges, each range is ordered on
its own and a prefix sum over the (at most ``SPLITS`` + 1) range totals puts them back
together. Both paths are exact. When no group is large, adaptive execution sees an
empty input and drops the second path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from understory.functions.exprs import HASH_RANGE
from understory.session import written

# Distinct values one task may order.
GROUP_LIMIT = 200_000
# Ranges a larger group is cut into.
SPLITS = 256

_ALL = "_all"


def one_group(column: str) -> Column:
    """The number of the only group, told from a column: joins on a literal would be folded into cross joins."""
    return F.pmod(F.hash(F.col(column)), F.lit(1))


def null_safe_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """With no key the whole table is one group."""
    if keys:
        return df, list(keys)
    return df.withColumn(_ALL, one_group(df.columns[0])), [_ALL]


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join a row per group back to the rows; a NULL key is a group like any other.

    ``few`` says that the groups are few whatever the number of rows (regions, columns), so their rows go to every task and
    the rows of a group need not meet in one.
    """
    right = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    right = F.broadcast(right) if few else right
    same = [rows[k].eqNullSafe(right[f"_of_{k}"]) for k in keys]
    return rows.join(right, same, how).drop(*[f"_of_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n) for the non-null values of ``value``."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def _large_groups(counts: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return (counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
            .where(F.col("_distinct") > limit).select(*keys))


_PROBS = ", ".join(f"{i / SPLITS}D" for i in range(1, SPLITS))


# How fine the sketches of the split points are: a few times the ranges, for every task's sketch goes to one task.
CUT_ACCURACY = 4 * SPLITS
_STEPS = [SPLITS >> i for i in range(1, SPLITS.bit_length())]


def _count_below(rows: DataFrame, cuts: str, value: str, out: str) -> DataFrame:
    """Add how many of fewer than ``SPLITS`` ascending cuts are below the value, by halving, one projection a step."""
    rows = rows.withColumn(out, F.lit(0))
    for step in _STEPS:
        rows = rows.withColumn(out, F.when(F.get(cuts, F.col(out) + (step - 1)) < F.col(value), F.col(out) + step).otherwise(F.col(out)))
    return rows


def _cut(rows: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame:
    """Add the value range ``_part`` of each row; split points are approximate quantiles,
    which only decide how evenly the work is spread, never the result. A group gets about
    one range per ``limit`` values, so moderately large groups are compared with few points."""
    found = rows.groupBy(*keys).agg(
        F.expr(f"percentile_approx(`{value}`, array({_PROBS}), {CUT_ACCURACY})").alias("_all_cuts"),
        F.count(F.lit(1)).alias("_d"))
    step = F.greatest(F.lit(1), F.floor(F.lit(SPLITS * max(limit, 1) / 2) / F.col("_d"))).cast("int")
    cuts = found.withColumn("_step", step).select(*keys, F.array_distinct(
        F.filter("_all_cuts", lambda c, i: (i + 1) % F.col("_step") == 0)).alias("_cuts"))
    return _count_below(rows.join(F.broadcast(cuts), list(keys)), "_cuts", value, "_part").drop("_cuts")  # a row per large group


def _run_in_parts(rows: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                  limit: int) -> DataFrame:
    """``running_counts`` for groups too large for one task."""
    whole = W.partitionBy(*keys)
    parts = _cut(rows, keys, value, limit)
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    part_below = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_part",
        *[F.coalesce(F.sum(f"_{s}").over(part_below), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums])
    inside = (W.partitionBy(*keys, "_part").orderBy(value)
              .rowsBetween(W.unboundedPreceding, -1))
    return parts.join(offsets, [*keys, "_part"]).select(
        *keys, value, *sums,
        *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_{s}_off")).alias(f"{s}_before")
          for s in sums],
        *[f"{s}_total" for s in sums])


def running_counts(counts: DataFrame, keys: Sequence[str], value: str,
                   limit: int = GROUP_LIMIT, sums: Sequence[str] = ("n",)) -> DataFrame:
    """Add, for each distinct value, what lies strictly below it and the group total.

    For each column ``s`` of ``sums`` the result has ``s_before`` and ``s_total``.
    """
    keys = list(keys)
    base = written(counts.select(*keys, value, *sums), "value-counts")  # read five times, and counting reads whole tables
    large = F.broadcast(_large_groups(base, keys, limit))  # at most one row per ``limit`` rows

    whole = W.partitionBy(*keys)
    below = whole.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    small = base.join(large, keys, "left_anti").select(
        *keys, value, *sums,
        *[F.coalesce(F.sum(s).over(below), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums])

    cut = _run_in_parts(base.join(large, keys, "left_semi"), keys, value, sums, limit)
    return small.unionByName(cut)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    out: str, weight: str | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """(keys, out ARRAY<DOUBLE>): linearly interpolated quantiles of each group."""
    df, group = null_safe_keys(df, keys)
    extra = [] if weight is None else [weight]
    rows = df.select(*group, F.col(value).cast("double").alias("_v"), *extra).where(F.col("_v").isNotNull())
    large = F.broadcast(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
                        .where(F.col("_rows") > limit).select(*group))  # at most one row per ``limit`` rows
    frequency = F.lit(1) if weight is None else F.col(weight)
    small = (rows.join(large, group, "left_anti").groupBy(*group)
             .agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), frequency).alias(out)))
    cut = _quantiles_in_parts(rows.join(large, group, "left_semi"), group, probs, out, weight, limit)
    return small.unionByName(cut).select(*keys, out)


def _quantiles_in_parts(rows: DataFrame, group: Sequence[str], probs: Sequence[float], out: str, weight: str | None, limit: int,
                        cut_by: Sequence[str] | None = None, slots: Sequence[str] = (),
                        spread: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``exact_quantiles`` of the column ``_v`` for groups too large for one task.

    Rows are counted by value range; only ranges that hold a wanted rank are ordered, so few rows are moved. The ranges are those
    of the groups ``cut_by``; ``spread`` gives a row of these, told by its ``slots``, once for each of its groups in ``group``.
    """
    whole, cut_by = W.partitionBy(*group), list(cut_by or group)
    parts = _cut(rows.where(F.col("_v").isNotNull()), cut_by, "_v", limit)
    counted = parts.groupBy(*cut_by, *slots, "_part").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    totals = spread(counted).groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
    placed = totals.withColumns({
        "_off": F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_pos": F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p * (F.sum("_n").over(whole) - 1))})
    within = lambda rank: (F.col("_off") <= rank) & (rank < F.col("_off") + F.col("_n"))
    needed = placed.where(F.exists("_pos", lambda p: within(F.floor(p)) | within(F.ceil(p)))).select(*group, "_part", "_off", "_pos")
    # A large group has two ranges at most for each quantile.
    held_in = parts.join(F.broadcast(needed.select(*cut_by, "_part")), [*cut_by, "_part"], "left_semi")
    ranges = value_counts(spread(held_in).join(F.broadcast(needed.select(*group, "_part")), [*group, "_part"], "left_semi"), [*group, "_part"], "_v", weight)
    inside = W.partitionBy(*group, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    target = ranges.join(needed, [*group, "_part"]).select(
        *group, "_v", "n", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_off")).alias("n_before"), F.col("_pos").alias("_all_pos"))
    target = target.select(*group, "_v", "n", "n_before", F.posexplode("_all_pos").alias("_i", "_pos"))

    def holds(rank: Column) -> Column:
        return (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))

    held = target.where(holds(F.floor("_pos")) | holds(F.ceil("_pos")))
    picked = held.groupBy(*group, "_i").agg(
        F.max("_pos").alias("_pos"),
        F.max(F.when(holds(F.floor("_pos")), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.ceil("_pos")), F.col("_v"))).alias("_hi"))
    value_at = F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_hi") - F.col("_lo"))
    return (picked.groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct("_i", value_at.alias("q")))).alias("_q"))
            .select(*group, F.col("_q.q").alias(out)))


def exact_quantiles_of_slots(df: DataFrame, cut_by: Sequence[str], slots: Sequence[str], spread: Callable[[DataFrame], DataFrame],
                             keys: Sequence[str], value: str, probs: Sequence[float], out: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """``exact_quantiles`` of groups ``keys`` that overlap: ``spread`` gives a row once for each of its groups.

    It sees the columns ``cut_by`` and ``slots``, adds those of ``keys``, and runs only on counts and on the few rows near a wanted rank.
    """
    rows = df.select(*cut_by, *slots, F.col(value).cast("double").alias("_v"))
    return _quantiles_in_parts(rows, keys, probs, out, None, limit, cut_by, slots, spread)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str,
                 limit: int = GROUP_LIMIT) -> DataFrame:
    q = exact_quantiles(df, keys, value, [0.5], "_q", limit=limit)
    return q.select(*keys, F.get("_q", 0).alias(out))


def exact_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                  limit: int = GROUP_LIMIT, weight: str | None = None) -> DataFrame:
    """Median of several columns per group, as one row per group with the same names.

    Groups within the limit take one aggregation for all columns. Larger groups have their
    columns put under each other and go through one cut into value ranges. A group without
    any value has a row of NULLs while it is within the limit, and none beyond it. A row counts ``weight`` times.
    """
    df, group = null_safe_keys(df, keys)
    extra = [] if weight is None else [weight]
    rows = df.select(*group, *[F.col(v).cast("double").alias(v) for v in values], *extra)
    large = F.broadcast(group_sizes(rows, group).where(F.col("n_group") > limit).select(*group))  # at most one row per ``limit`` rows
    small = rows.join(large, group, "left_anti").groupBy(*group).agg(
        *[F.percentile(v, 0.5, *[F.col(c) for c in extra]).alias(v) for v in values])

    entries = F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).alias("_value")) for v in values])
    long = (rows.join(large, group, "left_semi").select(*group, *extra, F.explode(entries).alias("_kv"))
            .select(*group, *extra, "_kv._name", F.col("_kv._value").alias("_v")))
    cut = _quantiles_in_parts(long, [*group, "_name"], [0.5], "_median", weight, limit).groupBy(*group).agg(*[
        F.max(F.when(F.col("_name") == v, F.get("_median", 0))).alias(v) for v in values])
    return small.unionByName(cut).select(*keys, *values)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank",
                  weight: str | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """(keys, value, n, avg_rank, n_total): 1-based ranks, ties share their mean rank."""
    df, group = null_safe_keys(df, keys)
    ranks = running_counts(value_counts(df, group, value, weight), group, value, limit)
    return ranks.select(*keys, value, "n",
                        (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out), "n_total")


def rank_cuts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, cuts, frequent): value ranges of few groups. A value that takes up a whole range is frequent."""
    found = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.expr(f"percentile_approx(`{value}`, array({_PROBS}), {CUT_ACCURACY})").alias("_all_cuts"))
    again = F.filter("_all_cuts", lambda c, i: c == F.get("_all_cuts", i + 1))
    return written(found.select(*keys, F.array_distinct("_all_cuts").alias("_cuts"), F.array_distinct(again).alias("_frequent")), "rank-cuts")


def in_rank_ranges(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add the value range ``_part`` and whether the value is a frequent one (``_tied``): the last of its range, whose rows need no order."""
    met = rows.where(F.col(value).isNotNull()).join(F.broadcast(cuts), list(keys))  # a row per group
    return _count_below(met, "_cuts", value, "_part").withColumn(
        "_tied", F.coalesce(F.array_contains("_frequent", F.col(value)), F.lit(False))).drop("_cuts", "_frequent")


def rows_below(slots: DataFrame, keys: Sequence[str], count: str) -> dict[str, Column]:
    """Of a row per range and ``_tied``: the rows of its group that lie in lower ranges, and the group's rows."""
    whole = W.partitionBy(*keys)
    return {f"{count}_off": F.coalesce(F.sum(count).over(whole.orderBy("_part", "_tied").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            f"{count}_total": F.sum(count).over(whole)}


def row_ranks(df: DataFrame, base: DataFrame, keys: Sequence[str], value: str, out: str, total: str) -> DataFrame:
    """Each row with a value, its 1-based rank (ties share their mean rank) and its group's number of rows; groups are few.

    Rows move once, by value range; those of frequent values stay where they are. ``base`` holds the same keys and values and is
    read twice before, so it should be cheaper to make than ``df``.
    """
    keys = list(keys)
    slot = [*keys, "_part", "_tied"]
    cuts = rank_cuts(base, keys, value)
    slots = in_rank_ranges(base.select(*keys, value), cuts, keys, value).groupBy(*slot).agg(F.count(F.lit(1)).alias("_n"))
    slots = F.broadcast(written(slots.withColumns(rows_below(slots, keys, "_n")), "rank-ranges"))  # some hundred rows a group
    rows = in_rank_ranges(df, cuts, keys, value)
    inside = W.partitionBy(*keys, "_part")
    place = F.rank().over(inside.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, "_part", value)) - 1) / 2.0
    apart = rows.where(~F.col("_tied")).drop("_tied").withColumn("_rank", place).withColumn("_tied", F.lit(False)).join(slots, slot)
    alike = rows.where("_tied").join(slots, slot)
    return (apart.select(*df.columns, (F.col("_n_off") + F.col("_rank")).alias(out), F.col("_n_total").alias(total))
            .unionByName(alike.select(*df.columns, (F.col("_n_off") + (F.col("_n") + 1) / 2.0).alias(out), F.col("_n_total").alias(total))))


def number_by_hash(df: DataFrame, keys: Sequence[str], hash_col: str, tie: Sequence[str],
                   out: str = "row_no", limit: Column | int | None = None,
                   buckets: int = SPLITS) -> DataFrame:
    """Number the rows of each group 1, 2, ... in hash order.

    The hash is uniform, so equal slices of its range spread one large group over
    ``buckets`` tasks; a prefix sum over slice counts gives each slice its first number.
    With ``limit`` (a number or a column) slices that start beyond it are dropped before
    any row is sorted, and rows numbered above it after.
    """
    # A struct of the keys is never NULL, so rows with NULL keys meet, and join and window share one partitioning.
    df, group = df.withColumn(_ALL, F.struct(*keys) if keys else one_group(hash_col)), [_ALL]
    slices = df.withColumn("_slice", F.floor(F.col(hash_col) * buckets / HASH_RANGE).cast("int"))
    counts = slices.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = slices.join(offsets, [*group, "_slice"])
    if limit is not None:
        bound = F.lit(limit) if isinstance(limit, int) else limit
        placed = placed.where(F.col("_off") < bound)
    order = W.partitionBy(*group, "_slice").orderBy(hash_col, *tie)
    numbered = placed.withColumn(out, F.row_number().over(order) + F.col("_off"))
    if limit is not None:
        numbered = numbered.where(F.col(out) <= bound)
    return numbered.drop("_slice", "_off", _ALL)


def group_sizes(df: DataFrame, keys: Sequence[str], out: str = "n_group") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
