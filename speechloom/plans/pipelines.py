"""Whole pipelines: from stored records to samples, splits, scores and files. Each is a function of data frames and settings."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.functions import phrases, timeref
from speechloom.functions import text as tx
from speechloom.operators import aggregates, batches, ingest, joins, mcq, metrics, nested, sampling, selection
from speechloom.sources import files, kaldi


@dataclass(frozen=True)
class Settings:
    """Settings of the pipelines, with their defaults."""

    source: str = ""
    target: str = ""
    eval_fraction: float = 0.02
    shards: int = 4
    seed: int = 0
    most_samples: int = 0
    most_questions_per_audio: int = 0
    scoring_mode: str = "normalization"
    collar_sec: float = 5.0
    upsample: float = 1.0
    upsampled_languages: tuple[str, ...] = ()
    prompt_language: str | None = None
    keep_original: bool = True


def convert_like(value: Any, default: Any) -> Any:
    """A value given as text in the kind of the default; what cannot be converted fails."""
    if value is None or default is None:
        return value
    if isinstance(default, bool):
        known = {"1": True, "true": True, "yes": True, "y": True, "on": True, "0": False, "false": False, "no": False, "n": False, "off": False}
        low = str(value).strip().lower()
        if low not in known:
            raise ValueError(f"{value!r} is neither true nor false")
        return known[low]
    if isinstance(default, (list, tuple)):
        parts = value.split(",") if isinstance(value, str) else value
        return type(default)(str(x).strip() for x in parts if str(x).strip())
    return type(default)(value)


def merged_settings(stored: dict | None = None, given: dict | None = None, base: Settings | None = None) -> Settings:
    """Defaults, over them stored settings (nested ones under datasets, args or config count too), over them given ones; unknown names fail."""
    base = base or Settings()
    flat: dict[str, Any] = {}
    for part in (stored or {}, given or {}):
        own = {k: v for k, v in part.items() if k not in ("datasets", "args", "config")}
        for name in ("datasets", "args", "config"):
            if isinstance(part.get(name), dict):
                own |= part[name]
        flat |= own
    defaults = asdict(base)
    unknown = sorted(set(flat) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return replace(base, **{k: convert_like(v, defaults[k]) for k, v in flat.items()})


def question_cache(lines: DataFrame, settings: Settings) -> DataFrame:
    """Samples of JSON lines (line_no, jsonl) with split (train, dev, and test, a copy of dev) and shard."""
    made = ingest.samples(nested.json_nodes(lines, "line_no", "jsonl"), settings.most_questions_per_audio, settings.most_samples, settings.seed)
    parted = sampling.train_eval_split(made, "sample_id", settings.eval_fraction, settings.seed)
    splits = F.when(F.col("is_eval"), F.array(F.lit("dev"), F.lit("test"))).otherwise(F.array(F.lit("train")))
    rows = parted.withColumn("split", F.explode(splits)).drop("is_eval")
    return rows.withColumn("shard", F.pmod(F.xxhash64("sample_id"), F.lit(settings.shards)).cast("int"))


def write_question_cache(lines: DataFrame, settings: Settings) -> DataFrame:
    """Writes the cache by split and shard, its table of audio, and returns (split, shard, rows)."""
    cache = question_cache(lines, settings)
    cache.write.mode("overwrite").partitionBy("split", "shard").parquet(f"{settings.target}/samples")
    stored = lines.sparkSession.read.parquet(f"{settings.target}/samples")
    files.audio_table(stored, "audio_path", "split").write.mode("overwrite").parquet(f"{settings.target}/audio")
    counts = stored.groupBy("split", "shard").agg(F.count("*").alias("rows"))
    files.write_json(counts, f"{settings.target}/manifest")
    return counts


def speech_cache(spark: SparkSession, folder: str, recordings: DataFrame | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical rows (utt_id, rec_id, language, text, start_sec, end_sec) of a folder of transcripts and recordings, and the counters."""
    found, counters = files.collected_segments(spark, folder, recordings, keys)
    language = F.split("rec_id", "_")[0]
    span = [F.format_string("%07d", F.bround(F.col(c) * 100).cast("bigint")) for c in ("start_sec", "end_sec")]
    utt = F.concat_ws("-", "rec_id", tx.sanitize_id(F.col("speaker")), *span)
    rows = found.select(utt.alias("utt_id"), "rec_id", tx.normalize_token(language).alias("language"), "text", "start_sec", "end_sec")
    return sampling.first_wins(rows, ["utt_id"], "text"), counters


def relations_to_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(utt_id, rec_id, audio_path, language, text, start_sec, end_sec) of stored relations; without a segments file each recording is one."""
    maps = {n: kaldi.read_map(spark, f"{folder}/{n}") for n in ("wav.scp", "text")}
    text, audio = maps["text"].toDF("utt_id", "text"), maps["wav.scp"].toDF("rec_id", "audio_path")
    try:
        spans = kaldi.read_segments(spark, f"{folder}/segments")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spans = audio.select(F.col("rec_id").alias("utt_id"), "rec_id", F.lit(0.0).alias("start_sec"), F.lit(-1.0).alias("end_sec"))
    rows = spans.join(text, "utt_id").join(audio, "rec_id")
    for name, key, column in (("utt2lang", "utt_id", "_own"), ("reco2lang", "rec_id", "_record")):
        try:
            rows = rows.join(kaldi.read_map(spark, f"{folder}/{name}").toDF(key, column), key, "left")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    language = F.coalesce(F.nullif(F.lower(F.trim(F.coalesce("_own", "_record"))), F.lit("")), F.lit("unknown"))
    return rows.select("utt_id", "rec_id", "audio_path", language.alias("language"), "text", "start_sec", "end_sec")


def training_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows (utt_id, language, ...) with split and copy: a held-out share of each language, the others repeated for chosen languages."""
    parted = sampling.train_eval_split(rows, "utt_id", settings.eval_fraction, settings.seed, ["language"])
    train = parted.where("not is_eval").drop("is_eval")
    chosen = F.col("language").isin(list(settings.upsampled_languages)) if settings.upsampled_languages else F.lit(False)
    repeated = sampling.upsample(train, "utt_id", chosen, settings.upsample, settings.seed).withColumn("split", F.lit("train"))
    held = parted.where("is_eval").drop("is_eval").withColumn("copy", F.lit(1).cast("bigint")).withColumn("split", F.lit("dev"))
    return repeated.unionByName(held)


def scored_pairs(rows: DataFrame, reference: str, hypothesis: str, mode: str, language: Column | None = None) -> DataFrame:
    """rows with both texts in the form of a scoring mode: legacy (as they are), normalization (the hypothesis only) or normalization_both_sides."""
    if mode not in ("legacy", "normalization", "normalization_both_sides"):
        raise ValueError(f"unknown scoring mode {mode}")
    form = lambda c: tx.for_scoring(F.col(c), language)
    out = rows.withColumn(hypothesis, form(hypothesis)) if mode != "legacy" else rows
    return out.withColumn(reference, form(reference)) if mode == "normalization_both_sides" else out


def speech_scores(rows: DataFrame, reference: str, hypothesis: str, language: str, mode: str = "normalization") -> DataFrame:
    """(language, edits, units, rate, character_edits, characters, character_rate): over all rows (null language) and by known language."""
    pairs = scored_pairs(rows, reference, hypothesis, mode, F.col(language))
    counted = metrics.with_character_errors(metrics.with_word_errors(pairs, reference, hypothesis), reference, hypothesis)
    sums = [F.sum(c).alias(n) for c, n in (("word_edits", "edits"), ("words", "units"), ("character_edits", "character_edits"), ("characters", "characters"))]
    grouped = counted.groupingSets([[F.col(language)], []], F.col(language)).agg(F.grouping(language).alias("_whole"), *sums).where(f"_whole = 1 or `{language}` is not null")
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return grouped.select(F.col(language).alias("language"), "edits", "units", rate("edits", "units").alias("rate"), "character_edits", "characters", rate("character_edits", "characters").alias("character_rate"))


def question_scores(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The overall accuracies and the breakdowns of predictions (pred, gold, error)."""
    scored = rows.withColumn("is_correct", F.col("pred") == F.col("gold"))
    return aggregates.overall_accuracy(scored), aggregates.accuracy_breakdowns(scored, by)


def evaluate_questions(rows: DataFrame, key: list[str], score, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions by cyclic choice of questions (key, question, labels, texts, gold), and their scores."""
    chosen = batches.cyclic_choice(rows, key, "question", "labels", "texts", score)
    answered = rows.join(chosen, key, "left").withColumn("pred", F.get("labels", F.col("chosen"))).withColumn("error", F.when(F.col("chosen").isNull(), "no answer"))
    return answered, *question_scores(answered, by)


def proxy_questions(questions: DataFrame, prior: dict[str, float], multiplier: float, most_copies: int, seed: int = 0) -> DataFrame:
    """(key, label, copy, options, gold): questions (key, options, gold) with texts moved so that gold labels follow a prior.

    The number of rows is a multiple of the questions', by label by largest remainder; a question serves at most
    most_copies labels.
    """
    spark = questions.sparkSession
    total = max(1, round(questions.count() * multiplier))
    shares = spark.createDataFrame(list(prior.items()), "label string, share double")
    quotas = sampling.largest_remainder(shares, "label", "share", total)
    each = questions.select("key", F.explode(F.transform("options", lambda o: o["label"])).alias("label"))
    placed = selection.by_quota(each, quotas, "key", "label", most_copies, seed)
    moved = mcq.target_variant(F.col("options"), F.col("gold"), F.col("label"))
    return placed.join(questions, "key").select("key", "label", "copy", moved.alias("options"), F.col("label").alias("gold"))


def swapped_questions(questions: DataFrame, keep_original: bool = True) -> DataFrame:
    return mcq.swap_variants(questions, "options", "gold", keep_original)


def rephrased_questions(questions: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Questions in the wording of evaluations, and (kind, n, changed)."""
    new = questions.withColumn("_r", phrases.rephrased(F.col(text))).withColumns({"kind": F.col("_r.kind"), "changed": F.coalesce(F.col("_r.text") != F.col(text), F.lit(True)), text: F.col("_r.text")}).drop("_r")
    return new, new.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("changed"), 1)).alias("changed"))


def cropped_questions(rows: DataFrame, question: str, duration: str, collar: float) -> DataFrame:
    """rows with windows and question: the windows that the question's times need, and the question in the time of the cropped recording."""
    windows = timeref.crop_windows(timeref.time_ranges(F.col(question)), F.col(duration), collar)
    return rows.withColumn("windows", windows).withColumn(question, timeref.in_local_time(F.col(question), F.col("windows")))


def calibrate(train: DataFrame, probs: str, gold: str, labels: int, alphas: list[float]) -> tuple[list[float], DataFrame]:
    """The mean of each place's probabilities, and the accuracy under each strength of its correction."""
    prior = [r.prior for r in mcq.class_prior(train, probs, labels).orderBy("place").collect()]
    return prior, mcq.calibration_sweep(train, probs, gold, prior, alphas)


def apply_calibration(rows: DataFrame, key: list[str], probs: str, shifts: list[float], labels: list[str]) -> DataFrame:
    """(key, before, after): choices without and with shifts of the log-probabilities."""
    name = lambda place: F.get(F.array(*(F.lit(x) for x in labels)), place)
    after = mcq.shifted_choice(F.col(probs), F.array(*(F.lit(float(g)) for g in shifts)))
    return rows.select(*key, name(mcq.argmax(F.col(probs))).alias("before"), name(after).alias("after"))


def session_transcripts(chunks: DataFrame, session: str, position: str, text: str, overlap_sec: float) -> DataFrame:
    """(session, text): transcripts of overlapping chunks, loops cut, joined in order on their overlaps of words; a session's chunks are as many as its length allows."""
    import math

    most = max(4, math.ceil(3 * overlap_sec))
    clean = chunks.where(F.col(text).isNotNull()).withColumn("_t", tx.repeated_ngram_cut(F.col(text)))
    listed = clean.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), F.col("_t").alias("t")))).alias("all"))
    joined = F.aggregate("all", F.lit(""), lambda acc, x: F.when(acc == "", F.trim(x["t"])).otherwise(tx.merge_overlap(acc, x["t"], most)))
    return listed.select(session, joined.alias("text"))


def split_sessions(rows: DataFrame, session: str, position: str, n: int) -> DataFrame:
    """rows with shard: whole sessions, in order of first appearance."""
    return rows.join(sampling.session_shards(rows, session, position, n), session, "left")


def masked_weights(weights: DataFrame, name: str, index: str, value: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The largest weights of each tensor, and what is left of each."""
    from speechloom.operators.corpora import mask_statistics

    kept = sampling.top_magnitudes(weights, name, index, value, ratio)
    return kept, mask_statistics(weights, kept, name, index, value)


def main(arguments: list[str] | None = None) -> int:
    """build-cache, score or rephrase over files, with settings from a JSON file and the command line."""
    parser = argparse.ArgumentParser(prog="speechloom")
    parser.add_argument("command", choices=["build-cache", "score", "rephrase"])
    parser.add_argument("--config")
    for f in fields(Settings):
        parser.add_argument(f"--{f.name.replace('_', '-')}", default=None)
    given = vars(parser.parse_args(arguments))
    command, path = given.pop("command"), given.pop("config")
    stored = json.load(open(path)) if path else {}
    settings = merged_settings(stored, {k: v for k, v in given.items() if v is not None})
    if not settings.source or not settings.target:
        parser.error("source and target are needed")
    spark = SparkSession.builder.getOrCreate()
    lines = lambda: spark.read.text(settings.source).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("jsonl"))
    if command == "build-cache":
        write_question_cache(lines(), settings)
    elif command == "rephrase":
        questions = nested.jsonl_questions(nested.json_nodes(lines(), "line_no", "jsonl"))
        files.write_json(rephrased_questions(questions, "question_stem")[0], settings.target)
    else:
        rows = spark.read.json(settings.source)
        files.write_json(speech_scores(rows, "reference", "hypothesis", "language", settings.scoring_mode), settings.target)
    return 0


__all__ = ["Settings", "convert_like", "joins", "main", "merged_settings"]
