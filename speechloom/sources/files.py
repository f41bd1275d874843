"""Folders of recordings, transcripts, predictions and caches as data frames, and the files written from them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.functions import text as tx
from speechloom.sources.kaldi import parse_segment_lines

#: Names of text, path and split columns of unknown tables, in order of preference (fixed values).
TEXT_COLUMNS = ["sentence", "text", "transcript", "transcription", "utterance", "normalized_text"]
PATH_COLUMNS = ["path", "audio", "audio_path", "file", "filename", "wav", "wav_path", "flac", "flac_path"]
SPLIT_COLUMNS = ["split", "set", "partition", "subset"]
LANGUAGE_COLUMNS = ["language", "lang", "lang_code", "language_code", "locale"]
SEPARATORS = ["\t", ",", "|", r"\s+"]


def first_existing(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate among the columns, letter case aside."""
    lower = {c.lower(): c for c in columns}
    return next((lower[c] for c in candidates if c in lower), None)


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, relative, modified) of the files below a root; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    # the listing may spell the root as a URI
    at = F.substring_index(path, os.path.basename(root.rstrip("/")) + "/", -1)
    return found.select(path.alias("path"), at.alias("relative"), F.col("modificationTime").alias("modified"))


def read_texts(spark: SparkSession, root: str, suffix: str = "txt") -> DataFrame:
    """(stem, text): whole text files below a root by their path without suffix; bytes that are no UTF-8 are read as Latin-1."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    out.append(data.decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(data.decode("latin-1"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "text"])

    texts = found.mapInArrow(run, "path string, text string")
    return texts.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), r"\.[^./]*$", "").alias("stem"), "text")


def paired_examples(spark: SparkSession, root: str, suffix: str = "wav", with_dialect: bool = True) -> DataFrame:
    """(utt_id, audio_path, language, text) of audio files with a text file beside them, in order of utt_id.

    Language and dialect are the first two folders; files right below the root and empty texts drop.
    """
    audio = list_files(spark, root, suffix).withColumn("parts", F.split("relative", "/")).where(F.size("parts") >= 2)
    dialect = F.when(F.size("parts") >= 3, F.get("parts", F.lit(1)))
    label = tx.language_label(F.get("parts", F.lit(0)), dialect if with_dialect else F.lit(None).cast("string"))
    keyed = audio.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.col("path").alias("audio_path"), label.alias("language"))
    joined = keyed.join(read_texts(spark, root), "stem").withColumn("text", F.trim("text")).where("text != ''")
    return joined.select(F.element_at(F.split("stem", "/"), -1).alias("utt_id"), "audio_path", "language", "text").orderBy("utt_id")


def collected_segments(spark: SparkSession, root: str, recordings: DataFrame | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments of the transcripts beside recordings, and the counters of what was left out.

    Segments: (rec_id, start_sec, end_sec, speaker, text). recordings: allowed ids or stems (name); keys: allowed
    (rec, spk, start_cs, end_cs). Counters: (reason, n).
    """
    from speechloom.operators.intervals import half_even_centiseconds
    from speechloom.operators.joins import allowed

    audio = list_files(spark, root, "wav").withColumn("parts", F.split("relative", "/"))
    audio = audio.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.size("parts").alias("depth"), tx.sanitize_id(F.regexp_replace("relative", r"\.[^./]*$", "")).alias("rec_id"))
    usable = audio.where("depth >= 2").withColumn("short", F.lower(F.element_at(F.split("stem", "/"), -1)))
    chosen = allowed(usable, recordings, "name", [F.lower("rec_id"), F.col("short")]) if recordings is not None else usable
    texts = read_texts(spark, root)
    lines = chosen.join(texts, "stem").select("rec_id", "short", F.explode(F.split("text", "\r?\n")).alias("line"))
    parsed = lines.select("rec_id", "short", F.col("line"))
    parsed = parse_segment_lines(parsed, "line", ["rec_id", "short"])
    kept = parsed.where("kept")
    if keys is not None:
        keyed = kept.withColumns({"spk": F.lower("speaker"), "start_cs": half_even_centiseconds(F.col("start_sec")), "end_cs": half_even_centiseconds(F.col("end_sec"))})
        same = ["spk", "start_cs", "end_cs"]
        full = keyed.withColumn("rec", F.lower("rec_id")).join(keys, ["rec", *same], "left_semi").drop("rec")
        rest = keyed.withColumn("rec", F.lower("rec_id")).join(keys, ["rec", *same], "left_anti").drop("rec")
        kept = full.unionByName(rest.withColumn("rec", F.col("short")).join(keys, ["rec", *same], "left_semi").drop("rec"))
    found = {
        "wav_total": audio, "invalid_layout": audio.where("depth < 2"), "filtered_recording_not_allowlisted": usable.join(chosen.select("stem"), "stem", "left_anti"),
        "missing_txt": chosen.join(texts, "stem", "left_anti"), "segment_txt_nonmatching_lines": parsed.where("rejected"), "segment_rows": kept,
        "filtered_segment_not_allowlisted": parsed.where("kept").select("rec_id", "start_sec", "end_sec", "speaker", "text").exceptAll(kept.select("rec_id", "start_sec", "end_sec", "speaker", "text")),
    }
    counters = None
    for name, rows in found.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("reason"), "n")
        counters = n if counters is None else counters.unionByName(n)
    return kept.select("rec_id", "start_sec", "end_sec", "speaker", "text"), counters


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited table with a header, all columns as strings."""
    return spark.read.option("header", "true").option("sep", sep).option("quote", "" if sep == "\t" else '"').csv(path)


def sniffed_table(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """(audio_path, text) of a table of unknown form: the first separator that parts its header, columns by name or content, one split of it.

    Only the first 50 rows are looked at to choose; the table is then read once with that choice.
    """
    head = spark.read.text(path).first()
    if head is None:
        return spark.createDataFrame([], "audio_path string, text string")
    sep = next((s for s in SEPARATORS[:3] if s in head[0]), None)
    if sep is None:
        fields = F.split(F.trim("value"), r"\s+")
        names = head[0].split()
        rows = spark.read.text(path).where(F.col("value") != head[0]).select(*(F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(names)))
    else:
        rows = read_delimited(spark, path, sep)
    sample = rows.limit(50).toPandas().fillna("").astype(str)
    text = first_existing(rows.columns, TEXT_COLUMNS) or max(rows.columns, key=lambda c: sample[c].str.len().mean() if len(sample) else 0)
    audio = first_existing(rows.columns, PATH_COLUMNS) or next((c for c in rows.columns if sample[c].str.lower().str.contains(r"\.(?:wav|flac|mp3|ogg)$").any()), None)
    if audio is None:
        raise ValueError(f"{path} has no column of audio paths")
    part = first_existing(rows.columns, SPLIT_COLUMNS)
    if part is not None:
        rows = rows.where(F.lower(F.trim(F.col(part))) == split)
    return rows.select(F.col(audio).alias("audio_path"), F.col(text).alias("text"))


def newest_cache(spark: SparkSession, paths: list[str], prefix: str) -> str | None:
    """The path whose last part has a prefix and comes last by name."""
    named = [p for p in paths if p.rstrip("/").rsplit("/", 1)[-1].startswith(prefix)]
    return max(named, key=lambda p: p.rstrip("/").rsplit("/", 1)[-1], default=None)


def read_caches(spark: SparkSession, caches: list[str], splits: list[str]) -> DataFrame:
    """Rows of several caches partitioned by split, only the chosen splits; missing columns are null."""
    out = None
    for path in caches:
        rows = spark.read.parquet(path).where(F.col("split").isin(splits)).withColumn("cache", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_shards(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """Rows of a folder partitioned by shard, with a shard only those: the others are not read."""
    rows = spark.read.parquet(path)
    return rows if shard is None else rows.where(F.col("shard") == shard)


def shard_of(spark: SparkSession, path: str, rows: DataFrame, position: str, shards: int, shard: int) -> DataFrame:
    """A shard from its folder if it was written, else by position mod shards."""
    try:
        return read_shards(spark, path, shard)
    except Exception as e:  # an analysis error of Spark: no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows.where(F.col(position) % shards == shard)


PREDICTION = "session_id string, question_id string, gold_choice string, pred_choice string, debias_content_probs map<string,double>, debias_per_rotation array<map<string,double>>"
DETAIL = "session_id string, question_id string, pred_choice string, n_options int, content_probs map<string,double>, per_rotation_logprobs array<map<string,double>>"


def read_predictions(spark: SparkSession, pattern: str, labels: list[str]) -> DataFrame:
    """Prediction rows of all shards that a glob names, of those with a probability for every label."""
    rows = spark.read.schema(PREDICTION).json(pattern)
    whole = F.forall(F.array(*(F.lit(x) for x in labels)), lambda x: F.map_contains_key("debias_content_probs", x))
    return rows.where(F.coalesce(whole, F.lit(False)))


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETAIL).json(path)


def latest_state(spark: SparkSession, folder: str, file: str = "trainer_state.json") -> DataFrame:
    """(run, path): of each run's folder the checkpoint with the greatest number that holds a state file."""
    from speechloom.operators.selection import latest

    found = list_files(spark, folder, file.rsplit(".", 1)[-1]).where(F.col("path").endswith("/" + file))
    named = found.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("run"), F.regexp_replace("path", "/[^/]+$", "").alias("path"))
    return latest(named, ["run"], "path", r"checkpoint-(\d+)$")


# files written


def write_splits(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A column of splits as partitions; an empty table writes its schema."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a row, in UTF-8, null members left out."""
    rows.write.mode("overwrite").json(path)


def write_details(rows: DataFrame, path: str) -> None:
    write_json(rows.select("session_id", "question_id", "pred_choice", "n_options", "content_probs", "per_rotation_logprobs"), path)


def write_issues(rows: DataFrame, path: str) -> None:
    """A delimited table with a header; arrays as joined text."""
    flat = [F.array_join(F.col(f.name), "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def stm_lines(text: DataFrame, key: str, value: str) -> DataFrame:
    """(value): `utt 1 spk1 0.00 1.00 text` of each row."""
    return text.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "").select(F.concat(F.col(key), F.lit(" 1 spk1 0.00 1.00 "), F.coalesce(F.col(value), F.lit(""))).alias("value"))


def missing_outputs(rows: DataFrame, path: str, done: DataFrame, done_path: str) -> DataFrame:
    """Rows whose output, by the path's stem, does not exist yet."""
    made = done.select(tx.stem(F.col(done_path)).alias("_stem")).distinct()
    return rows.withColumn("_stem", tx.stem(F.col(path))).join(made, "_stem", "left_anti").drop("_stem")


def audio_table(rows: DataFrame, path: str, split: str) -> DataFrame:
    """(audio_id, audio_path, splits): each audio once, with the splits that ask about it."""
    known = rows.where(F.col(path).isNotNull())
    return known.groupBy(F.col(path).alias("audio_path")).agg(F.sort_array(F.collect_set(split)).alias("splits")).select(F.sha1("audio_path").alias("audio_id"), "audio_path", "splits")


def manifest(rows: DataFrame, shard: str, position: str) -> DataFrame:
    """(shard, start, end, rows): what each shard holds; end is exclusive."""
    return rows.groupBy(shard).agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.count("*").alias("rows"))


def block_shards(rows: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """rows with position and shard: contiguous blocks of a size."""
    from speechloom.operators.sampling import global_rank

    ranked = global_rank(rows, order, "_rank")
    return ranked.withColumn("position", F.col("_rank") - 1).withColumn("shard", F.floor(F.col("position") / size)).drop("_rank")


def merged_shards(parts: DataFrame, shard: str, position: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all shards in order of shard and position, and (rows, different, unique) of their keys."""
    check = parts.agg(F.count("*").alias("rows"), F.count_distinct(*key).alias("different"))
    return parts.orderBy(shard, position), check.withColumn("unique", F.col("rows") == F.col("different"))
