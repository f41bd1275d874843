"""Sample arrays: cuts, resampling, speech by energy, and what is derived from a crop. Arrays travel as Arrow lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions import timeref

SPANS = "array<struct<start:bigint,end:bigint>>"


def energies(x: np.ndarray, rate: int) -> tuple[np.ndarray, int, int]:
    """Root mean squares of frames of 30 ms every 10 ms, with both lengths in samples."""
    size, hop = max(1, int(0.03 * rate)), max(1, int(0.01 * rate))
    squares = np.r_[0.0, np.cumsum(x.astype(np.float64) ** 2)]
    start = np.arange(0, len(x) - size + 1, hop)
    return np.sqrt((squares[start + size] - squares[start]) / size + 1e-12).astype(np.float32), size, hop


def speech_by_energy(x: np.ndarray, rate: int, threshold: float = 0.5, least_ms: float = 250.0) -> list[tuple[int, int]]:
    """Spans of samples whose energy is above a share of the way from the quiet fifth to the loud fifth of frames.

    An array shorter than a frame is speech as a whole if it is not silent; spans below least_ms drop.
    """
    n = len(x)
    if not n:
        return []
    if n < max(1, int(0.03 * rate)):
        return [(0, n)] if np.sqrt(np.mean(x.astype(np.float32) ** 2) + 1e-12) > 1e-3 else []
    level, size, hop = energies(x, rate)
    quiet, loud = np.quantile(level, [0.2, 0.8])
    speech = np.r_[False, level > quiet + min(max(threshold, 0.0), 1.0) * max(1e-6, loud - quiet), False]
    edge = np.flatnonzero(np.diff(speech.astype(np.int8)))
    spans = []
    for first, after in zip(edge[::2], edge[1::2]):
        # a span that is open at the last frame goes to the end
        start, end = int(first) * hop, n if after == len(level) else int(after) * hop + size
        if (end - start) * 1000.0 / rate >= least_ms:
            spans.append((start, min(end, n)))
    return spans


def padded_and_merged(spans: list[tuple[int, int]], size: int, pad: int, join: int) -> list[tuple[int, int]]:
    """Spans widened by pad within the array, and merged where the next starts within join after the last end."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a - pad), min(size, b + pad)) for a, b in spans):
        if out and a <= out[-1][1] + join:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def only_speech(x: np.ndarray, rate: int, threshold: float = 0.5, least_ms: float = 250.0, pad_ms: float = 30.0, join_ms: float = 100.0, least_kept: float = 0.3, most: int | None = None) -> np.ndarray:
    """The array cut to its speech; whole if nothing, or less than a share of it, would be left; to at most `most` samples."""
    ms = rate / 1000
    spans = padded_and_merged(speech_by_energy(x, rate, threshold, least_ms), len(x), int(pad_ms * ms), int(join_ms * ms))
    kept = np.concatenate([x[a:b] for a, b in spans]) if spans else x
    kept = kept if len(kept) >= least_kept * len(x) else x
    return kept[:most] if most is not None else kept


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at another rate, channels (a second dimension) averaged first."""
    x = np.asarray(x, np.float32)
    x = x.mean(axis=1, dtype=np.float32) if x.ndim > 1 else x
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.linspace(0.0, 1.0, n, dtype=np.float32), np.linspace(0.0, 1.0, len(x), dtype=np.float32), x).astype(np.float32)


def _arrays(b: pa.RecordBatch, at: int) -> list[np.ndarray]:
    return [np.asarray(x.as_py() if x.as_py() is not None else [], np.float32) for x in b.column(at)]


def speech_spans(rows: DataFrame, key: str, samples: str, rate: str, threshold: float = 0.5, least_ms: float = 250.0) -> DataFrame:
    """(key, spans) by energy; null arrays and rates have none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e} for s, e in speech_by_energy(x, r, threshold, least_ms)] if r else [] for x, r in zip(_arrays(b, 1), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [key, "spans"])

    return rows.select(key, F.col(samples).cast("array<float>"), F.col(rate).cast("int")).mapInArrow(run, f"`{key}` {kind}, spans {SPANS}")


def speech_only(rows: DataFrame, key: str, samples: str, rate: str, to: int = 16_000, **settings: float) -> DataFrame:
    """(key, samples, sampling_rate): resampled to a rate and cut to speech, settings as of only_speech; null arrays are empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [only_speech(resampled(x, r or to, to), to, **settings) for x, r in zip(_arrays(b, 1), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32())), pa.array([to] * len(out), pa.int32())], [key, "samples", "sampling_rate"])

    return rows.select(key, F.col(samples).cast("array<float>"), F.col(rate).cast("int")).mapInArrow(run, f"`{key}` {kind}, samples array<float>, sampling_rate int")


def clips(recordings: DataFrame, spans: DataFrame, key: str, samples: str) -> DataFrame:
    """(utt_id, key, clip): the samples lo to hi of spans (utt_id, key, lo, hi), each recording decoded once and joined to its spans."""
    rows = spans.join(recordings.select(key, samples), key)
    return rows.select("utt_id", key, F.slice(samples, (F.col("lo") + 1).cast("int"), F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast("int")).alias("clip"))


def frame_levels(samples: Column, frame: int, hop: int) -> Column:
    """Root mean squares of frames, as a built-in expression for arrays of any origin."""
    n = F.floor((F.size(samples) - frame) / hop)
    level = lambda i: F.sqrt(F.aggregate(F.slice(samples, (i * hop + 1).cast("int"), F.lit(frame)), F.lit(0.0), lambda a, x: a + x.cast("double") * x) / frame)
    return F.when(F.size(samples) >= frame, F.transform(F.sequence(F.lit(0).cast("bigint"), n), level)).otherwise(F.array().cast("array<double>"))


def quantile_floors(rows: DataFrame, key: list[str], value: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """(key, low, high): exact interpolated quantiles."""
    return rows.groupBy(*key).agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def crop_plan(path: Column, question: Column, duration: Column, sample_id: Column, collar: float, longest: float, seed: int = 0) -> Column:
    """struct<windows, key>: where a question's audio is cut, and the cache key of that.

    The times that the question names, widened by a collar and cut to `longest` seconds in all; else one window of that
    length at a hashed place. The key is the sha1 of path and windows.
    """
    named = timeref.crop_windows(timeref.time_ranges(question), duration, collar)

    def add(acc: Column, w: Column) -> Column:
        room = F.lit(float(longest)) - acc["used"]
        hi = F.least(w["hi"], w["lo"] + room)
        keep = room > 1e-9
        return F.struct((acc["used"] + F.when(keep, hi - w["lo"]).otherwise(0.0)).alias("used"), F.when(keep, F.concat(acc["kept"], F.array(F.struct(w["lo"].alias("lo"), hi.alias("hi"))))).otherwise(acc["kept"]).alias("kept"))

    capped = F.aggregate(named, F.struct(F.lit(0.0).alias("used"), F.array().cast(timeref.RANGES).alias("kept")), add, lambda acc: acc["kept"])
    spare = F.greatest(duration - F.lit(float(longest)), F.lit(0.0))
    start = F.bround(spare * F.pmod(F.xxhash64(F.lit(seed), sample_id), F.lit(1_000_000)) / 1_000_000, 3)
    random = F.array(F.struct(start.alias("lo"), F.least(start + F.lit(float(longest)), duration).alias("hi")))
    windows = F.when(F.size(capped) > 0, capped).otherwise(random)
    return F.struct(windows.alias("windows"), F.sha1(F.to_json(F.struct(path.alias("path"), windows.alias("windows")))).alias("key"))


def zeroed(samples: Column) -> Column:
    """As many zeros: what a model hears without the recording."""
    return F.transform(samples, lambda x: (x * 0).cast("float"))


def padded(values: Column, size: Column | int, fill: float = 0.0) -> Column:
    """struct<values, mask>: an array filled up to a size, and which places are its own."""
    n = size if isinstance(size, Column) else F.lit(size)
    more = F.greatest(n - F.size(values), F.lit(0))
    return F.struct(F.concat(values.cast("array<double>"), F.array_repeat(F.lit(fill), more)).alias("values"), F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), more)).alias("mask"))
