"""Unions, mixes, pivots and comparisons of whole data sets and of weight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[tuple[str, DataFrame]], name: str = "part") -> DataFrame:
    """All rows with the name of their part; schemas must agree by name."""
    out = None
    for label, rows in parts:
        rows = rows.withColumn(name, F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def mixed(originals: DataFrame, translated: DataFrame, language: str, base: str = "en") -> DataFrame:
    """Originals, and the translated copies of audio in another language than base; version tells them apart."""
    copies = translated.where(~F.lower(F.trim(F.col(language))).startswith(base))
    return union_all([("original", originals), ("translated", copies)], "version")


def replayed(rows: DataFrame, chosen: Column, copies: int) -> DataFrame:
    """rows with copy 1..n: chosen rows several times, others once."""
    n = F.when(F.coalesce(chosen, F.lit(False)), copies).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def shared_and_own(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, side): both, first or second, of the keys of two sets."""
    a, b = (x.where(F.col(key).isNotNull()).select(key).distinct() for x in (first, second))
    a, b = a.withColumn("_a", F.lit(1)), b.withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "second").when(F.col("_b").isNull(), "first").otherwise("both").alias("side"))


def wide_counts(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """(key, a column for each value): counts, 0 where none."""
    return rows.groupBy(key).pivot(column, values).count().fillna(0, values)


def wide_metric(rows: DataFrame, key: str, column: str, values: list[str], metric: str) -> DataFrame:
    """(key, a column for each value): the metric, null where missing."""
    return rows.groupBy(key).pivot(column, values).agg(F.first(metric))


def mix_shares(rows: DataFrame, audio_language: str, text_language: str, group: list[str], base: str = "en") -> DataFrame:
    """(group, mix, n, share): audio and text in base, text in base over other audio, both the same other language, or else."""
    a, t = (F.lower(F.trim(F.col(c))) for c in (audio_language, text_language))
    mix = F.when((a == base) & (t == base), "base").when((t == base) & (a != base), "cross").when(a == t, "same").otherwise("other")
    counts = rows.groupBy(*group, mix.alias("mix")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_all"))
    return counts.join(totals, group).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


def of_shard(rows: DataFrame, shards: DataFrame, path: str, shard: int) -> DataFrame:
    """Rows whose audio id (sha1 of the path) is in a shard of (audio_id, shard)."""
    ids = shards.where(F.col("shard") == shard).select("audio_id").distinct()
    return rows.withColumn("audio_id", F.sha1(path)).join(ids, "audio_id", "left_semi")


def with_text_by_stem(rows: DataFrame, path: str, texts: DataFrame, name: str, text: str, keep: bool = True) -> DataFrame:
    """rows with the text whose name is the path's stem: the last of repeated names; missing ones empty, or dropped without keep."""
    from speechloom.functions.text import stem

    side = texts.groupBy(F.col(name).alias("_stem")).agg(F.max(text).alias("transcript"))
    joined = rows.withColumn("_stem", stem(F.col(path))).join(side, "_stem", "left" if keep else "inner")
    return joined.drop("_stem").withColumn("transcript", F.coalesce("transcript", F.lit("")))


def filled(rows: DataFrame, key: str, column: str, fixes: DataFrame, placeholder: str) -> DataFrame:
    """rows whose column is a placeholder or null with the value that fixes (key, value) has for them."""
    joined = rows.join(fixes.select(key, F.col("value").alias("_new")), key, "left")
    lacking = F.col(column).isNull() | (F.trim(F.col(column)) == placeholder)
    return joined.withColumn(column, F.when(lacking, F.coalesce("_new", column)).otherwise(F.col(column))).drop("_new")


def zipped(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """Arrays of equal length as an array of pairs; others fail."""
    sound = F.assert_true(F.size(left) == F.size(right), F.lit("lists of different lengths"))
    return F.when(sound.isNull(), F.arrays_zip(left.alias(names[0]), right.alias(names[1])))


def audio_overlap(train: DataFrame, held_out: DataFrame, path: str, group: str) -> DataFrame:
    """(group, audio, seen, share): the distinct audio of held-out rows, and how many of them train has."""
    seen = train.select(F.col(path).alias("_path")).distinct().withColumn("_seen", F.lit(1))
    each = held_out.where(F.col(path).isNotNull()).select(group, F.col(path).alias("_path")).distinct().join(seen, "_path", "left")
    return each.groupBy(group).agg(F.count("*").alias("audio"), F.count("_seen").alias("seen"), F.round(F.count("_seen") / F.count("*"), 6).alias("share"))


def mask_statistics(before: DataFrame, after: DataFrame, name: str, index: str, value: str) -> DataFrame:
    """(name, total, nnz_before, nnz_after, kept_ratio): entries of each tensor of long tables, and the nonzero ones left by a mask."""
    kept = after.where(F.col(value) != 0).groupBy(name).agg(F.count("*").alias("nnz_after"))
    had = before.groupBy(name).agg(F.count("*").alias("total"), F.count(F.when(F.col(value) != 0, 1)).alias("nnz_before"))
    joined = had.join(kept, name, "left").fillna(0, ["nnz_after"])
    return joined.withColumn("kept_ratio", F.round(F.coalesce(F.try_divide("nnz_after", "nnz_before"), F.lit(0.0)), 6))


def paired_factors(weights: DataFrame, name: str, first: str = "lora_A", second: str = "lora_B") -> DataFrame:
    """(module, first, second): names of weights that belong to one module, both present."""
    part = F.regexp_extract(name, rf"({first}|{second})[^.]*\.weight$", 1)
    module = F.regexp_replace(name, rf"\.?({first}|{second})[^.]*\.weight$", "")
    named = weights.select(name).distinct().where(part != "").select(module.alias("module"), part.alias("part"), F.col(name).alias("_name"))
    both = named.groupBy("module").agg(F.max(F.when(F.col("part") == first, F.col("_name"))).alias("first"), F.max(F.when(F.col("part") == second, F.col("_name"))).alias("second"))
    return both.where("first is not null and second is not null")


def product_table(left: DataFrame, right: DataFrame, name: str, row: str, column: str, value: str) -> DataFrame:
    """(name, row, column, value): matrix products of long tables by name; left's column meets right's row."""
    a = left.select(name, F.col(row).alias("_i"), F.col(column).alias("_k"), F.col(value).alias("_a"))
    b = right.select(name, F.col(row).alias("_k"), F.col(column).alias("_j"), F.col(value).alias("_b"))
    return a.join(b, [name, "_k"]).groupBy(name, "_i", "_j").agg(F.sum(F.col("_a") * F.col("_b")).alias(value)).withColumnsRenamed({"_i": row, "_j": column})


def cosine_by_name(first: DataFrame, second: DataFrame, name: str, index: list[str], value: str) -> DataFrame:
    """(name, cosine, norm_first, norm_second) of long vectors or matrices; cosine 0 if a norm is 0."""
    a, b = (x.select(name, *index, F.col(value).cast("double").alias(c)) for x, c in ((first, "_a"), (second, "_b")))
    both = a.join(b, [name, *index], "full_outer").fillna(0.0, ["_a", "_b"])
    sums = both.groupBy(name).agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"), F.sqrt(F.sum(F.col("_a") ** 2)).alias("norm_first"), F.sqrt(F.sum(F.col("_b") ** 2)).alias("norm_second"))
    return sums.select(name, F.round(F.coalesce(F.try_divide(F.col("_dot"), F.col("norm_first") * F.col("norm_second")), F.lit(0.0)), 6).alias("cosine"), F.round("norm_first", 6).alias("norm_first"), F.round("norm_second", 6).alias("norm_second"))


def parameter_groups(weights: DataFrame, name: str) -> DataFrame:
    """(name, part, decays): encoder, connector or decoder by the name, and whether weight decay applies; adapters are marked."""
    low = F.lower(F.col(name))
    part = F.when(low.rlike(r"audio_tower|encoder"), "encoder").when(low.rlike(r"multi_modal_projector|connector|adapter"), "connector").otherwise("decoder")
    return weights.select(name).distinct().withColumns({"part": part, "decays": ~low.rlike(r"bias$|norm|embed"), "is_adapter": low.rlike(r"lora_[ab]") & low.endswith(".weight")})
