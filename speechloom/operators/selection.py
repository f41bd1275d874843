"""Selections with budgets, caps and deficits, and merges of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.operators.sampling import global_rank, hash_key


def within_budget(chunks: DataFrame, position: str, size: str, budget: int) -> DataFrame:
    """chunks with take: the rows of each that a running budget still has room for, in order of position; those without any drop.

    One row for each chunk; the running sum is over ranges of chunks, none of which is a single task's whole table.
    """
    ranked = global_rank(chunks, [position], "_rank").withColumn("_range", F.floor((F.col("_rank") - 1) / 1024))
    inside = F.sum(size).over(Window.partitionBy("_range").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each 1024 chunks
    sums = ranked.groupBy("_range").agg(F.sum(size).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    spent = F.col("_before") + F.coalesce("_inside", F.lit(0))
    taken = ranked.withColumn("_inside", inside).join(before, "_range").withColumn("take", F.least(F.greatest(F.lit(budget) - spent, F.lit(0)), F.col(size)).cast("bigint"))
    return taken.where("take > 0").drop("_rank", "_range", "_before", "_inside")


def merged_intervals(rows: DataFrame, keys: list[str], lo: str, hi: str, gap: float = 0.0) -> DataFrame:
    """(keys, lo, hi, n): intervals merged where one starts no later than gap after the end of all before it.

    Rows with a null bound or hi < lo drop. For one entity with very many rows, operators.intervals has a form
    without a window of the whole entity (its gap is 0).
    """
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(lo) <= F.col(hi)).withColumn("_reach", reach).withColumn("_new", (F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + gap)).cast("bigint"))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("_island")


def by_quota(candidates: DataFrame, quotas: DataFrame, key: str, label: str, most_copies: int, seed: int = 0) -> DataFrame:
    """(key, label, copy): up to n of the candidates (key, label) of each label of quotas (label, n), every key at most most_copies times.

    Set-based: each key offers its copies to its labels in turn, starting at a hashed one, so that a key serves
    different labels first; each label takes its offers in hash order. Labels that lack offers stay short, which the
    sequential form refills.
    """
    several = Window.partitionBy(key).orderBy(hash_key(F.concat_ws("|", F.col(key).cast("string"), F.col(label)), seed), label)
    offered = candidates.select(key, label).distinct().withColumn("_turn", F.row_number().over(several)).where(F.col("_turn") <= most_copies)
    order = [F.col("_turn"), hash_key(F.concat_ws("|", F.col(label), F.col(key).cast("string")), seed), F.col(key)]
    ranked = global_rank(offered, [F.col(label), *order], "_rank")
    first = ranked.groupBy(label).agg(F.min("_rank").alias("_first"))
    placed = ranked.join(first, label).join(quotas.select(label, F.col("n").alias("_n")), label)
    return placed.where(F.col("_rank") - F.col("_first") < F.col("_n")).select(key, label, F.col("_turn").cast("bigint").alias("copy"))


def greedy_by_deficit(candidates: DataFrame, quotas: dict[str, int], key: str, label: str, most_copies: int) -> DataFrame:
    """(step, key, label): at each step a candidate of the label with the largest deficit (the first of equals), in order of key.

    Every key at most most_copies times; a label without candidates is refilled from any label that has one, in
    order of label. Sequential by nature: for tables that one task can hold, as the steps depend on each other.
    """
    kind = candidates.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: dict[str, list] = {x: [] for x in sorted(quotas)}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x in pool:
                    pool[x].append(k)
        used: dict = {}
        made = dict.fromkeys(pool, 0)
        at = dict.fromkeys(pool, 0)
        out = []
        for step in range(sum(quotas.values())):
            first = max(pool, key=lambda x: (quotas[x] - made[x], -sorted(pool).index(x)))
            for x in (first, *(y for y in pool if y != first)):
                own = pool[x]
                while at[x] < len(own) and used.get(own[at[x]], 0) >= most_copies:
                    at[x] += 1
                if at[x] < len(own):
                    k = own[at[x]]
                    used[k] = used.get(k, 0) + 1
                    made[x] += 1
                    # the next question of the label comes first
                    at[x] += used[k] >= most_copies
                    out.append((step, k, x))
                    break
            else:
                break
        columns = zip(*out) if out else ([], [], [])
        steps, keys, labels = columns
        yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(keys, b.schema.field(0).type), pa.array(labels, pa.string())], ["step", key, label])

    single = candidates.select(key, label).distinct().repartition(1).sortWithinPartitions(key, label)
    return single.mapInArrow(run, f"step bigint, `{key}` {kind}, `{label}` string")


def regrouped(rows: DataFrame, path: str, item: str, position: str) -> DataFrame:
    """(path, items): the items of each path in order, paths in order; as large as a path's own record."""
    grouped = rows.groupBy(path).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("_at"), F.col(item).alias("_item")))).alias("_all"))
    return grouped.select(path, F.transform("_all", lambda x: x["_item"]).alias("items")).orderBy(path)


def margin_filter(rows: DataFrame, up: str, down: str, least: int, order: list[str], n: int | None = None) -> DataFrame:
    """Rows with at least `least` more votes for than against; with n, the first in order."""
    kept = rows.where(F.col(up) - F.col(down) >= least)
    return kept.orderBy(*order).limit(n) if n is not None else kept


def changed_rows(rows: DataFrame, pairs: list[tuple[str, str]], order: list[str], n: int) -> DataFrame:
    """The first n rows, in order, that differ in any pair of columns."""
    differs = F.lit(False)
    for a, b in pairs:
        differs = differs | ~F.col(a).eqNullSafe(F.col(b))
    return rows.where(differs).orderBy(*order).limit(n)


def optimizer_steps(rows: Column | int, batch: int, accumulate: int, epochs: float, workers: int = 1) -> Column:
    """Steps of a training run: batches rounded up, then accumulations, then epochs; one at least of each."""
    n = rows if isinstance(rows, Column) else F.lit(rows)
    at_least_one = lambda x: F.greatest(x, F.lit(1).cast("bigint"))
    batches = at_least_one(F.ceil(n / F.lit(max(1, batch * max(1, workers)))))
    return at_least_one(F.ceil(at_least_one(F.ceil(batches / F.lit(max(1, accumulate)))) * F.lit(float(epochs))))


def two_stages(steps: Column, fraction: float) -> Column:
    """struct<first, second>: a half-even share of the steps, with at least one in each stage if there are two."""
    first = F.when(steps > 1, F.greatest(F.least(F.bround(steps * F.lit(fraction)).cast("bigint"), steps - 1), F.lit(1).cast("bigint"))).otherwise(F.lit(1).cast("bigint"))
    return F.struct(first.alias("first"), F.greatest(steps - first, F.lit(0).cast("bigint")).alias("second"))


def parsed_prior(raw: Column) -> Column:
    """map<label, share> of `A:0.25,B:0.25`, normalised to sum 1; tokens without a number or a positive sum fail."""
    # transform gives a function of two parameters the place too, and trim would take it for the characters to cut
    tokens = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    entries = F.transform(tokens, lambda t: F.struct(F.upper(F.trim(F.substring_index(t, ":", 1))).alias("label"), F.trim(F.substring_index(t, ":", -1)).cast("double").alias("share")))
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["share"])
    return F.when(F.assert_true((total > 0) & F.forall(tokens, lambda t: t.contains(":")), F.lit("no prior")).isNull(), F.map_from_entries(F.transform(entries, lambda e: F.struct(e["label"], e["share"] / total))))


def latest(rows: DataFrame, group: list[str], name: str, pattern: str = r"(\d+)$") -> DataFrame:
    """(group, name): the name with the greatest number in it (of equals the greater name); names without one drop."""
    number = F.regexp_extract(name, pattern, 1).try_cast("bigint")
    kept = rows.where(number.isNotNull())
    return kept.groupBy(*group).agg(F.max_by(name, F.struct(number, F.col(name))).alias(name))
