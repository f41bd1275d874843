"""Kaldi-style text relations, segment lists, JSON lines, training logs and WAV files, as data frames."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d+(?:\.\d+)?"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, no): lines of text files in an order that rises within each file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("no"))


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """`key value...` lines: the first white space parts them, the last of equal keys wins, lines without a value drop."""
    line = F.trim("line")
    parts = _lines(spark, path).select("no", F.regexp_extract(line, r"^(\S+)\s+(.+)$", 1).alias(key), F.regexp_extract(line, r"^(\S+)\s+(.+)$", 2).alias(value))
    return parts.where(F.col(key) != "").groupBy(key).agg(F.max_by(F.trim(value), "no").alias(value))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """`utt rec start end` lines; those with fewer fields or end <= start drop, a bound that is no number fails."""
    fields = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).where(F.size(fields) >= 4)
    return rows.select(fields[0].alias("utt_id"), fields[1].alias("rec_id"), fields[2].cast("double").alias("start_sec"), fields[3].cast("double").alias("end_sec")).where("end_sec > start_sec")


def parse_segment_lines(lines: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """(start_sec, end_sec, speaker, text, kept, rejected) of `start end speaker text` lines; blank lines drop.

    kept: end > start and a text; rejected: the line has another form. Columns in keep stay.
    """
    pattern = rf"^\s*({NUMBER})\s+({NUMBER})\s+(\S+)\s+(.*?)\s*$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    fits = F.col(line).rlike(pattern)
    out = lines.where(F.trim(line) != "").select(*(keep or []), part(1).try_cast("double").alias("start_sec"), part(2).try_cast("double").alias("end_sec"), F.nullif(part(3), F.lit("")).alias("speaker"), part(4).alias("text"), (~fits).alias("rejected"))
    return out.withColumn("kept", F.coalesce(~F.col("rejected") & (F.col("end_sec") > F.col("start_sec")) & (F.col("text") != ""), F.lit(False)))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(name): one id a line, lower case, each once."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("name")).where("name != ''").distinct()


def read_segment_keys(spark: SparkSession, path: str) -> DataFrame:
    """(rec, spk, start_cs, end_cs) of `rec|spk|start|end` lines; malformed ones drop."""
    parts = F.split(F.trim("value"), r"\|")
    rows = spark.read.text(path).where(F.size(parts) == 4)
    return rows.select(F.lower(parts[0]).alias("rec"), F.lower(parts[1]).alias("spk"), parts[2].try_cast("bigint").alias("start_cs"), parts[3].try_cast("bigint").alias("end_cs")).dropna().distinct()


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, question_id, label) of lines with at least three fields; the label is the last."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].alias("session_id"), parts[1].alias("question_id"), F.element_at(parts, -1).alias("label"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines training log; malformed lines drop."""
    schema = "timestamp string, global_step bigint, epoch double, checkpoint_dir string, train_loss double, eval_loss double, avg_train_loss_since_last_eval double, generalization_gap double"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("global_step is not null")


def best_checkpoint(log: DataFrame) -> DataFrame:
    """(checkpoint_dir): of the smallest absolute gap, or, if no row has one, of the smallest evaluation loss; the first of ties."""
    gap = F.min_by("checkpoint_dir", F.when(F.col("generalization_gap").isNotNull(), F.struct(F.abs("generalization_gap"), "global_step")))
    loss = F.min_by("checkpoint_dir", F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "global_step")))
    return log.where("checkpoint_dir is not null").agg(F.coalesce(gap, loss).alias("checkpoint_dir"))


def write_relations(recordings: DataFrame, segments: DataFrame, folder: str) -> None:
    """wav.scp, reco2lang, segments, text, utt2lang and utt2spk under a folder, times with six decimals."""
    def line(df: DataFrame, name: str, *columns: Column | str) -> None:
        df.select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")

    line(recordings.where("audio_path is not null"), "wav.scp", "rec_id", "audio_path")
    line(recordings.where("language is not null"), "reco2lang", "rec_id", "language")
    timed = segments.where("start_sec is not null and end_sec is not null")
    line(timed, "segments", "utt_id", "rec_id", F.format_string("%.6f", "start_sec"), F.format_string("%.6f", "end_sec"))
    for name, column in (("text", "text"), ("utt2lang", "language"), ("utt2spk", "speaker")):
        line(segments.where(F.col(column).isNotNull()), name, "utt_id", column)


def write_submission(rows: DataFrame, path: str) -> None:
    """`session question label` lines; a missing label is written as A."""
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("A"))
    rows.select(F.concat_ws(" ", "session_id", "question_id", label).alias("value")).write.mode("overwrite").text(path)


def write_shards(rows: DataFrame, position: str, shards: int, path: str) -> DataFrame:
    """Rows by shard = position mod shards, partitioned on disk; returns (shard, rows)."""
    placed = rows.withColumn("shard", (F.col(position) % shards).cast("int"))
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"))


def decode_pcm(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] of a PCM WAV file of 8, 16 or 32 bits, channels averaged, and the rate."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    kinds = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    if width not in kinds:
        raise ValueError(f"{8 * width}-bit samples are not supported")
    kind, middle, scale = kinds[width]
    x = (np.frombuffer(raw, kind).astype(np.float32) - np.float32(middle)) / np.float32(scale)
    return x.reshape(-1, channels).mean(axis=1), rate


def read_wav(spark: SparkSession, path: str, head: int = 16_000) -> DataFrame:
    """(path, sampling_rate, duration_sec, silent, error): silent if the first `head` samples are all zero.

    Files are read by the executors; one that cannot be decoded has a row with its error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1):
                try:
                    x, rate = decode_pcm(data.as_py())
                    out.append((rate, len(x) / rate, bool((x[:head] == 0).all()), None))
                except (ValueError, EOFError, wave.Error) as e:
                    out.append((None, None, None, str(e) or type(e).__name__))
            columns = zip(*out) if out else [[]] * 4
            kinds = [pa.int32(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["path", "sampling_rate", "duration_sec", "silent", "error"])

    return files.mapInArrow(run, "path string, sampling_rate int, duration_sec double, silent boolean, error string")
