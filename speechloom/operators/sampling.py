"""Deterministic sampling, sharding and ranking: membership by a hash rank, so every engine draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.session import cut


def hash_key(key: Column, seed: int) -> Column:
    """The order that stands for a seeded shuffle: md5 of seed, bar and key; ties broken by the caller."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with the rank, from 1, of each row in a total order: no task sees more than its range of rows.

    Rows are partitioned by ranges of the order; a rank is the row's place in its range plus the sizes of the
    ranges before, of which there is one row each.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # as many rows as partitions
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(offsets, "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def group_rank(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank", size: str | None = None) -> DataFrame:
    """df with the rank, from 1, of each row within its group, and the group's size: a group may fill many tasks.

    Nulls are a group. The global rank in order of group and rows, less that of the group's first row.
    """
    ranked = global_rank(df, [*group, *order], "_global")
    first = ranked.groupBy(*(F.col(c).alias(f"_of_{c}") for c in group)).agg(F.min("_global").alias("_first"), F.count("*").alias(size or "_size"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    # a row for each group: which side to broadcast is left to Spark's size check
    placed = ranked.join(first, same).withColumn(name, F.col("_global") - F.col("_first") + 1)
    return placed.drop("_global", "_first", "_size", *(f"_of_{c}" for c in group))


def _with_total(df: DataFrame, name: str) -> DataFrame:
    # a cross join, as the other side is one row
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def first_n_per_group(df: DataFrame, group: list[str], key: str, n: Column | int, seed: int = 0) -> DataFrame:
    """n rows of each group in hash order, with their rank."""
    n = n if isinstance(n, Column) else F.lit(n)
    return group_rank(df, group, [hash_key(F.col(key), seed), F.col(key)]).where(F.col("rank") <= n)


def first_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order: a seeded shuffle cut to its head."""
    return df.orderBy(hash_key(F.col(key), seed), key).limit(n)


def train_eval_split(df: DataFrame, key: str, fraction: float, seed: int = 0, group: list[str] | None = None) -> DataFrame:
    """df with is_eval: half-even round(n * fraction) rows of each group, one at least and n - 1 at most."""
    shuffled = hash_key(F.col(key), seed)
    if group:
        rows = group_rank(df, group, [shuffled, F.col(key)], "_rank", "_n")
    else:
        rows = _with_total(global_rank(df, [shuffled, key], "_rank"), "_n")
    k = F.least(F.greatest(F.bround(F.col("_n") * F.lit(fraction)), F.lit(1)), F.col("_n") - 1)
    return rows.withColumn("is_eval", F.col("_rank") <= k).drop("_n", "_rank")


def stratified_partitions(df: DataFrame, label: str, key: str, val: float, test: float, seed: int = 0) -> DataFrame:
    """df with part (train, validation, test) by class.

    Classes of one or two rows are all test. Else half-even rounded parts, each at least one; validation, then
    test, shrinks until a row is left for train.
    """
    n, rank = F.col("_n"), F.col("_rank")
    t, v = F.greatest(F.bround(n * F.lit(test)), F.lit(1)), F.greatest(F.bround(n * F.lit(val)), F.lit(1))
    v = F.greatest(F.least(v, n - 1 - t), F.lit(0))
    t = F.least(t, n - 1 - v)
    part = F.when((n <= 2) | (rank <= t), "test").when(rank <= t + v, "validation").otherwise("train")
    return group_rank(df, [label], [hash_key(F.col(key), seed), F.col(key)], "_rank", "_n").withColumn("part", part).drop("_rank", "_n")


def largest_remainder(counts: DataFrame, label: str, share: str, total: int) -> DataFrame:
    """(label, n): total apportioned by normalised shares, the largest remainders first, ties by label."""
    whole = Window.partitionBy(F.lit(0))
    exact = F.col(share) / F.sum(share).over(whole) * total
    base = counts.select(label, F.floor(exact + F.lit(1e-9)).alias("base"), F.greatest(exact - F.floor(exact + F.lit(1e-9)), F.lit(0.0)).alias("rest"))
    left = F.lit(total) - F.sum("base").over(whole)
    order = whole.orderBy(F.round("rest", 9).desc(), label)
    return base.select(label, (F.col("base") + (F.row_number().over(order) <= left).cast("bigint")).alias("n"))


def quota_with_refill(counts: DataFrame, label: str, pooled: str, available: str, total: int) -> DataFrame:
    """(label, n): targets in proportion to pooled counts, capped by availability; what is missing goes to labels with most room."""
    whole = Window.partitionBy(F.lit(0))
    target = F.bround(F.col(pooled) / F.sum(pooled).over(whole) * total)
    base = counts.select(label, F.least(target, F.col(available)).cast("bigint").alias("n"), F.col(available).alias("have"))
    room = F.col("have") - F.col("n")
    missing = F.greatest(F.lit(total) - F.sum("n").over(whole), F.lit(0))
    order = whole.orderBy(room.desc(), label).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(room).over(order), F.lit(0))
    return base.select(label, (F.col("n") + F.greatest(F.least(room, missing - before), F.lit(0))).alias("n"))


def draw_by_quota(df: DataFrame, label: str, key: str, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of each label that its quota (label, n) draws, in hash order."""
    ranked = group_rank(df.where(F.col(label).isNotNull()), [label], [hash_key(F.col(key), seed), F.col(key)], "_rank")
    return ranked.join(quotas.select(label, F.col("n").alias("_n")), label).where("_rank <= _n").drop("_rank", "_n")


def upsample(df: DataFrame, key: str, is_target: Column, factor: float, seed: int = 0) -> DataFrame:
    """df with copy: target rows repeated to ceil(n * factor), the extra copies spread evenly in hash order."""
    target = F.coalesce(is_target, F.lit(False))
    ranked = group_rank(df.withColumn("_target", target), ["_target"], [hash_key(F.col(key), seed), F.col(key)], "_rank", "_n")
    n, rank = F.col("_n"), F.col("_rank")
    wanted = F.ceil(n * F.lit(factor))
    copies = F.when(F.col("_target"), F.floor(wanted / n) + (rank <= wanted % n).cast("bigint")).otherwise(1)
    return ranked.withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies", "_target", "_rank", "_n")


def contiguous_shards(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with shard 0..n-1: contiguous, the first ones larger by a row where needed."""
    ranked = _with_total(global_rank(df, order, "_rank"), "_total")
    base, extra, at = F.floor(F.col("_total") / n), F.col("_total") % n, F.col("_rank") - 1
    long = extra * (base + 1)
    shard = F.when(at < long, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - long) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("shard", shard.cast("bigint")).drop("_rank", "_total")


def session_shards(df: DataFrame, session: str, position: str, n: int) -> DataFrame:
    """(session, shard): sessions in order of first appearance, rank * n / sessions rounded down."""
    first = df.groupBy(session).agg(F.min(position).alias("first"))
    ranked = _with_total(global_rank(first, ["first"], "_rank"), "_total")
    return ranked.select(session, F.floor((F.col("_rank") - 1) * n / F.col("_total")).alias("shard"))


def round_robin_shards(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(key, shard, rows): distinct keys dealt out in hash order, with their rows."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    ranked = global_rank(keys, [hash_key(F.col(key), seed), key], "_rank")
    return ranked.select(key, ((F.col("_rank") - 1) % n).cast("bigint").alias("shard"), "rows")


def interleave(df: DataFrame, group: str, key: str, replicas: int, replica: int, seed: int = 0) -> DataFrame:
    """Balanced interleaving: ranks up to the smallest group's size, in order of rank and group, every replicas-th row."""
    known = df.where(F.col(group).isNotNull())
    ranked = group_rank(known, [group], [hash_key(F.col(key), seed), F.col(key)])
    least = known.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    # a cross join, as the other side is one row
    kept = ranked.crossJoin(F.broadcast(least)).where("rank <= least").drop("least")
    placed = global_rank(kept, ["rank", group], "place").withColumn("place", (F.col("place") - 1).cast("bigint"))
    return placed.where(F.col("place") % replicas == replica)


def top_magnitudes(df: DataFrame, name: str, index: str, value: str, ratio: float, least: int = 1) -> DataFrame:
    """The max(least, ceil(ratio * nonzeros)) largest absolute values of each name; zeros never."""
    nonzero = df.where(F.col(value) != 0)
    k = F.greatest(F.ceil(F.col("_n") * F.lit(ratio)), F.lit(least))
    return group_rank(nonzero, [name], [F.abs(value).desc(), F.col(index)], "_rank", "_n").where(F.col("_rank") <= k).drop("_rank", "_n")


def normalize_indices(df: DataFrame, index: str, size: int) -> DataFrame:
    """(row): indices counted from 1 (no 0, one equal to size) shifted to 0, out of range dropped, each once."""
    low_high = df.agg(F.min(index).alias("low"), F.max(index).alias("high"))
    shift = F.when((F.col("low") >= 1) & (F.col("high") == size), 1).otherwise(0)
    # a cross join, as the other side is one row
    return df.crossJoin(F.broadcast(low_high)).select((F.col(index) - shift).alias("row")).where(F.col("row").between(0, size - 1)).distinct()


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: the last in order."""
    values = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("r")).select(*key, "r.*")


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: the first in order."""
    values = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*values), order).alias("r")).select(*key, "r.*")


#: Rows of one stretch of a group in the windows below.
STRETCH = 4096


def moving_average(df: DataFrame, group: list[str], order: str, value: str, width: int) -> DataFrame:
    """df with smoothed: centred sums divided by the width at the edges too; groups shorter than it keep their values.

    Groups are cut into stretches, each with a copy of the rows that its edges need, so no window holds a whole group.
    """
    low, high = width // 2, width - 1 - width // 2
    ranked = group_rank(df, group, [F.col(order)], "_rank", "_n")
    of = lambda shift: F.floor((F.col("_rank") - 1 + shift) / STRETCH)
    spread = ranked.withColumn("_own", of(0)).withColumn("_stretch", F.explode(F.array_distinct(F.array(of(0), F.greatest(of(-high), F.lit(0)), of(low)))))
    near = Window.partitionBy(*group, "_stretch").orderBy("_rank").rowsBetween(-low, high)
    smoothed = F.when(F.col("_n") < width, F.col(value).cast("double")).otherwise(F.sum(value).over(near) / width)
    return spread.withColumn("smoothed", smoothed).where("_own = _stretch").drop("_own", "_stretch", "_rank", "_n")


def running_mean(df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "running") -> DataFrame:
    """df with the mean of a value over the rows of the group so far: sums within stretches, and of all stretches before."""
    ranked = group_rank(df.withColumn("_v", value), group, [F.col(c) for c in order], "_rank").withColumn("_stretch", F.floor((F.col("_rank") - 1) / STRETCH))
    sums = ranked.groupBy(*group, "_stretch").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each stretch
    sums = sums.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_stretch").alias("_of_stretch"), F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*group, "_stretch").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group] + [F.col("_stretch") == F.col("_of_stretch")]
    placed = ranked.withColumn("_inside", F.sum("_v").over(inside)).join(sums, same)
    return placed.withColumn(name, (F.col("_before") + F.col("_inside")) / F.col("_rank")).drop("_v", "_rank", "_stretch", "_sum", "_before", "_inside", "_of_stretch", *(f"_of_{c}" for c in group))


def running_least(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "best") -> DataFrame:
    """df with the least value of the group so far: within stretches, and of all stretches before."""
    ranked = group_rank(df, group, [F.col(c) for c in order], "_rank").withColumn("_stretch", F.floor((F.col("_rank") - 1) / STRETCH))
    least = ranked.groupBy(*group, "_stretch").agg(F.min(value).alias("_least"))
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each stretch
    least = least.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_stretch").alias("_of_stretch"), F.min("_least").over(before).alias("_before"))
    inside = Window.partitionBy(*group, "_stretch").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group] + [F.col("_stretch") == F.col("_of_stretch")]
    placed = ranked.withColumn("_inside", F.min(value).over(inside)).join(least, same)
    return placed.withColumn(name, F.least("_before", "_inside")).drop("_rank", "_stretch", "_before", "_inside", "_of_stretch", *(f"_of_{c}" for c in group))


def mean_between_events(df: DataFrame, group: list[str], order: str, value: str, is_event: Column) -> DataFrame:
    """Of each event: the mean of the values since the one before (null without any)."""
    w = Window.partitionBy(*group).orderBy(order)
    earlier = F.coalesce(F.sum(F.coalesce(is_event, F.lit(False)).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = df.withColumn("island", earlier).withColumn("_event", F.coalesce(is_event, F.lit(False)))
    means = marked.groupBy(*group, "island").agg(F.max(F.when(F.col("_event"), F.col(order))).alias(order), F.avg(F.when(~F.col("_event"), F.col(value))).alias("mean_before"))
    return means.where(F.col(order).isNotNull())
