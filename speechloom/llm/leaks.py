"""Evaluation passages inside training documents, by winnowed word fingerprints.

A hash of every K consecutive words; of every WINDOW neighbouring hashes the smallest (the last of equals) is
kept. Two texts that share K + WINDOW - 1 words in a row keep a common fingerprint for certain. Fingerprints
of both sides are joined, and each hit is extended over the whole document to the longest shared stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import Lattice
from speechloom.llm.words import plain_words, word_hashes
from speechloom.session import cut

K, WINDOW = 11, 5
#: Broadcast the evaluation fingerprints up to this many rows of 16 bytes (counted first); beyond it both sides shuffle.
BROADCAST_ROWS = 500_000
#: Broadcast the hits, with their item texts, up to this many (counted first).
BROADCAST_HITS = 20_000
#: Documents with a fingerprint from which it is spread, and over how many keys.
HOT_ROWS, SALTS = 100_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def winnow(hashes: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints of many texts at once: (word position in the flat array, hash). Texts are given by word offsets."""
    n = len(hashes)
    if n < k + window - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    of = grams(hashes, k)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    span = k + window - 1
    whole = np.flatnonzero(text[: n - span + 1] == text[span - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(of, window)
    chosen = np.empty(len(whole), np.int64)
    for i in range(0, len(whole), 1 << 18):
        at = whole[i : i + (1 << 18)]
        chosen[i : i + len(at)] = at + window - 1 - np.argmin(views[at][:, ::-1], axis=1)
    chosen = np.unique(chosen)
    return chosen, of[chosen]


def fingerprints(df: DataFrame, key: str, text: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """(key, fingerprint), distinct within a text; none for texts of fewer than k + window - 1 words."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()
        for b in batches:
            words, offsets = plain_words(b.column(1).to_pylist(), lattice)
            at, kept = winnow(word_hashes(words), offsets, k, window)
            keys = np.asarray(b.column(0))[np.searchsorted(offsets, at, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kept.view(np.int64))], ["key", "fingerprint"])

    return rows.mapInArrow(run, "key bigint, fingerprint bigint").withColumnRenamed("key", key)


def covered_run(text: np.ndarray, passage: np.ndarray, least: int) -> int:
    """Words of the longest stretch of a text each of whose windows of `least` words is one of the passage's; 0 without any.

    Both sides are given by the hashes of their windows.
    """
    if not len(text) or not len(passage):
        return 0
    hit = np.r_[0, np.isin(text, passage).astype(np.int8), 0]
    edge = np.flatnonzero(np.diff(hit))
    return int((edge[1::2] - edge[::2]).max(initial=1 - least)) + least - 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring words."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if len(out) else 0):
            out = out * _BASE + hashes[j : len(hashes) - k + 1 + j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def hits(documents: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, item_id) with a common fingerprint, distinct; of fingerprints (doc_id, fingerprint) and (item_id, fingerprint).

    Few evaluation fingerprints are broadcast. Else both sides shuffle, and one that more than hot_rows documents
    hold is spread over SALTS keys of them, with a copy of its items for each.
    """
    items = cut(items)
    if items.count() <= broadcast_rows:
        return documents.join(F.broadcast(items), "fingerprint").select("doc_id", "item_id").distinct()
    documents = cut(documents)
    # below one row for each hot_rows rows
    hot = documents.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("fingerprint", F.lit(True).alias("hot"))
    left = documents.join(hot, "fingerprint", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    right = items.join(hot, "fingerprint", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.select("fingerprint", "salt", "item_id"), ["fingerprint", "salt"]).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, least: int = K + WINDOW - 1, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, item_id, shared_words): each document with the items of which it holds `least` words in a row or more.

    shared_words is the longest stretch of the document each of whose windows of `least` words is in the item.
    Letter case, punctuation, spacing and character forms do not matter. Null keys are ignored, null, empty and
    short texts share nothing; repeated documents under one key count once; copies under other keys each
    count; empty tables give no rows. least must not be below K + WINDOW - 1, for which finding is certain.
    A document that was hit meets its items once, with its text read and parted once.
    """
    if least < K + WINDOW - 1:
        raise ValueError(f"runs under {K + WINDOW - 1} words are not certain to be found")
    found = hits(fingerprints(documents, "doc_id", "text"), fingerprints(items, "item_id", "item_text").distinct(), broadcast_rows, hot_rows)
    texts = items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").alias("item"))
    # a list is as long as the document's part of the result, but for hits that turn out too short
    asked = cut(found.join(texts, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item")).alias("items")))
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    asked = F.broadcast(asked) if max(size) <= BROADCAST_HITS else asked
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(asked, "doc_id").select("doc_id", "text", F.col("items.item_id").alias("ids"), F.col("items.item").alias("items"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()

        def windows(texts: list[str | None]) -> list[np.ndarray]:
            words, offsets = plain_words(texts, lattice)
            of = grams(word_hashes(words), least)
            return [of[a : max(a, b - least + 1)] for a, b in zip(offsets, offsets[1:])]

        for b in batches:
            coded = b.column(3).flatten().dictionary_encode()
            passages = windows(coded.dictionary.to_pylist())
            count = np.asarray(pc.list_value_length(b.column(3)), np.int64)
            of = np.repeat(np.arange(b.num_rows), count)
            own = windows(b.column(1).to_pylist())
            runs = [covered_run(own[i], passages[k], least) for i, k in zip(of, np.asarray(coded.indices))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(2).flatten(), pa.array(runs, pa.int64())], ["doc_id", "item_id", "shared_words"])

    shared = rows.mapInArrow(extend, "doc_id bigint, item_id bigint, shared_words bigint").where(F.col("shared_words") >= least)
    return shared.groupBy("doc_id", "item_id").agg(F.max("shared_words").alias("shared_words"))
