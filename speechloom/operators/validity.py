"""Which rows can be used, and the reasons why others cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def reasons(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold, in order of name, each once: an empty array for a valid row."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks)))))


def joined_reasons(*checks: tuple[str, Column]) -> Column:
    return F.array_join(reasons(*checks), "|")


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def segment_reasons(start: Column, end: Column, text: Column) -> Column:
    """What is wrong with a segment: null_bound, not_finite, reversed (unless it ends with the recording), no_text."""
    odd = not_finite(start) | not_finite(end)
    return joined_reasons(("null_bound", start.isNull() | end.isNull()), ("not_finite", odd), ("reversed", ~odd & (end != -1) & (end <= start)), ("no_text", F.coalesce(F.trim(text), F.lit("")) == ""))


def audio_reasons(samples: Column, rate: Column, text: Column, least_sec: float = 0.1) -> Column:
    """What is wrong with a decoded recording (array of samples): checks after a missing or empty one do not apply."""
    has, sound = samples.isNotNull() & (F.size(samples) > 0), F.coalesce(rate, F.lit(0)) > 0
    usable = has & sound
    return joined_reasons(
        ("empty_text", F.trim(F.coalesce(text, F.lit(""))) == ""), ("missing_audio", samples.isNull()), ("empty_audio", samples.isNotNull() & (F.size(samples) == 0)),
        ("invalid_sample_rate", has & ~sound), ("non_finite_audio", has & F.exists(samples, not_finite)), ("too_short_<100ms", usable & (F.size(samples) / rate < least_sec)),
        ("digital_zero_wave", usable & ~F.exists(samples, lambda x: x != 0)),
    )


def feature_reason(feature: Column) -> Column:
    """What is wrong with a feature matrix (array of arrays): bad_feature_rank if null, empty_feature, all_zero_feature, else null."""
    cells = F.flatten(feature)
    return F.when(feature.isNull(), "bad_feature_rank").when((F.size(feature) == 0) | (F.size(F.get(feature, F.lit(0))) == 0), "empty_feature").when(~F.exists(cells, lambda x: F.abs(x) > 1e-8), "all_zero_feature")


def has_shape(feature: Column) -> Column:
    """Whether a matrix has rows and columns."""
    return F.coalesce((F.size(feature) > 0) & (F.size(F.get(feature, F.lit(0))) > 0), F.lit(False))


def usable_clips(segments: DataFrame, recordings: DataFrame, least_sec: float = 0.1) -> DataFrame:
    """Segments of known recordings with their sample span (lo, hi): at least least_sec long once rounded to samples."""
    from speechloom.functions.timeref import sample_span

    side = recordings.where("sampling_rate > 0 and duration_sec is not null").select("rec_id", "sampling_rate", F.bround(F.col("duration_sec") * F.col("sampling_rate")).cast("bigint").alias("size"))
    rows = segments.where(~not_finite(F.col("start_sec")) & ~not_finite(F.col("end_sec"))).join(side, "rec_id")
    spanned = rows.withColumn("span", sample_span(F.col("start_sec"), F.col("end_sec"), F.col("sampling_rate"), F.col("size")))
    long = (F.col("span.hi") - F.col("span.lo")) / F.col("sampling_rate") >= least_sec
    return spanned.where((F.col("span.hi") > F.col("span.lo")) & long).select("utt_id", "rec_id", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"))


def counted(rows: DataFrame, checks: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation of how many of them each check holds for, taken while they are used."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(n) for n, c in checks.items())), seen


def check_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(reason, n) of every check, zero counts too, in one pass."""
    counts = rows.agg(F.array(*(F.struct(F.lit(n).alias("reason"), F.count(F.when(c, 1)).alias("n")) for n, c in checks.items())).alias("c"))
    return counts.select(F.inline("c"))


def layout_checks(path: Column, root: str, text_known: Column, allowed: Column, matches: Column) -> dict[str, Column]:
    """The counters of a collection of recordings: layout below a root, a text beside it, the allow-list, the form of its lines."""
    depth = F.size(F.split(F.replace(path, F.lit(root.rstrip("/") + "/"), F.lit("")), "/"))
    flat = depth < 2
    return {"wav_total": path.isNotNull(), "invalid_layout": flat, "missing_txt": ~flat & ~text_known, "filtered_recording_not_allowlisted": ~flat & ~allowed, "segment_txt_nonmatching_lines": ~flat & text_known & ~matches}
