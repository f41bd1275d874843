"""Joins of the speech pipelines: fallback chains, allow-lists, rank alignment, windows, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.operators.sampling import group_rank


def with_fallback(rows: DataFrame, lookups: list[tuple[DataFrame, str, Column]], value: str) -> DataFrame:
    """rows with value: of the first lookup (table, its key column, key of rows) that has the key exactly once.

    Keys found more than once in a table count as not found there, as do null keys.
    """
    names = []
    for i, (table, key, own) in enumerate(lookups):
        unique = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_key{i}")).agg(F.count("*").alias("_n"), F.min(value).alias(f"_value{i}")).where("_n = 1").drop("_n")
        rows = rows.withColumn(f"_own{i}", own).join(unique, F.col(f"_own{i}") == F.col(f"_key{i}"), "left").drop(f"_own{i}", f"_key{i}")
        names.append(f"_value{i}")
    return rows.withColumn(value, F.coalesce(*names)).drop(*names)


def allowed(rows: DataFrame, names: DataFrame, name: str, keys: list[Column]) -> DataFrame:
    """Rows of which any key is in the list: equi semi-joins instead of an OR, each row once."""
    listed = names.select(F.lower(F.trim(name)).alias("_name")).where("_name != ''").distinct()
    rest, out = rows, None
    for key in keys:
        marked = rest.withColumn("_key", key)
        hit = marked.join(listed, F.col("_key") == F.col("_name"), "left_semi").drop("_key")
        rest = marked.join(listed, F.col("_key") == F.col("_name"), "left_anti").drop("_key")
        out = hit if out is None else out.unionByName(hit)
    return out


def rank_aligned(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs of the k-th rows of both sides of each key, of keys with as many rows on both; (keys, rank, left_..., right_...)."""
    def ranked(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return group_rank(df, keys, [F.col(order)], "rank", "size").select(*keys, "rank", "size", *(F.col(c).alias(f"{side}_{c}") for c in rest))

    return ranked(left, "left").join(ranked(right, "right"), [*keys, "size", "rank"]).drop("size")


def in_windows(points: DataFrame, windows: DataFrame, key: str, at: str, lo: str, hi: str, cell: float) -> DataFrame:
    """Each point with the first window of its key (by start, then end) that holds it, bounds included.

    Windows are taken as at most two dyadic ranges of cells: those of the level on which a window spans one or two.
    Points look on the levels that windows have, so the range condition is an equi-join however long a window is.
    Points in none are left out.
    """
    a, b = F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)
    level = F.when(b > a, F.ceil(F.log2((b - a).cast("double")))).otherwise(F.lit(0)).cast("int")
    block = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("bigint")
    wide = windows.where(F.col(lo) <= F.col(hi)).select(key, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), level.alias("_level"), a.alias("_a"), b.alias("_b"))
    wide = wide.select(key, "_lo", "_hi", "_level", F.explode(F.array_distinct(F.array(block(F.col("_a"), F.col("_level")), block(F.col("_b"), F.col("_level"))))).alias("_block"))
    # at most as many as a double has exponents
    levels = [r._level for r in wide.select("_level").distinct().collect()]
    asked = points.withColumn("_level", F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array().cast("array<int>"))).withColumn("_block", block(F.floor(F.col(at) / cell), F.col("_level")))
    hit = asked.join(wide, [key, "_level", "_block"]).where(F.col(at).between(F.col("_lo"), F.col("_hi")))
    columns = points.columns
    return hit.groupBy(*columns).agg(F.min(F.struct("_lo", "_hi")).alias("w")).select(*columns, F.col("w._lo").alias(lo), F.col("w._hi").alias(hi))


def concat_offsets(windows: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """windows with offset: where each begins once all windows of its key are put one after another."""
    before = Window.partitionBy(key).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("offset", F.coalesce(F.sum(F.col(hi) - F.col(lo)).over(before), F.lit(0.0)))


def compare_metrics(first: DataFrame, second: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, first, second, delta in points): a full join, delta null if a side is missing."""
    a, b = first.select(key, F.col(metric).alias("first")), second.select(key, F.col(metric).alias("second"))
    return a.join(b, key, "full_outer").withColumn("delta_pp", F.round((F.col("second") - F.col("first")) * 100, 6))


def candidate_paths(rows: DataFrame, key: str, candidates: list[Column], files: DataFrame, path: str) -> DataFrame:
    """(key, path): the first candidate, in order, that is among the files; null without any."""
    tried = rows.select(key, F.posexplode(F.array(*candidates)).alias("priority", "_path"))
    found = tried.join(files.select(F.col(path).alias("_path")).distinct(), "_path", "left_semi")
    best = found.groupBy(key).agg(F.min_by("_path", "priority").alias(path))
    return rows.select(key).join(best, key, "left")


def segment_references(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """(utt_id, rec_id, audio_path, language, text): the segment's label, or the recording's if it is null; blank ones "unknown"."""
    label = F.lower(F.trim(F.coalesce(F.col("language"), F.col("rec_language"))))
    side = recordings.select("rec_id", "audio_path", F.col("language").alias("rec_language"))
    joined = segments.where("text is not null").join(side, "rec_id")
    return joined.select("utt_id", "rec_id", "audio_path", F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown")).alias("language"), "text")


def write_back(records: DataFrame, key: str, items: str, field: str, fixes: DataFrame) -> DataFrame:
    """records with a field of their array items replaced by fixes (key, pos, value), order kept."""
    names = [f.name for f in records.schema[items].dataType.elementType.fields]
    long = records.select(key, F.posexplode(items).alias("pos", "item")).join(fixes, [key, "pos"], "left")
    item = F.struct(*((F.coalesce("value", F.col(f"item.{n}")) if n == field else F.col(f"item.{n}")).alias(n) for n in names))
    grouped = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("sorted"))
    return records.drop(items).join(grouped.select(key, F.transform("sorted", lambda x: x["item"]).alias(items)), key, "left")
