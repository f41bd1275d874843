"""Word and character error counts, and corpus rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first codepoint that stands for a word; a pair of texts can have this many different words.
FIRST, MOST = 0x4E00, 0xD7FF - 0x4E00


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _as_characters(words: Column, vocabulary: Column) -> Column:
    """A string with one character for each word: its place in the vocabulary from FIRST on."""
    code = lambda w: F.array_position(vocabulary, w).cast("int") + (FIRST - 1)
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(code(w)), 4, "0")), "UTF-16BE")), "")


def with_word_errors(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """rows with word_edits and words (of the reference): the built-in edit distance over one character a word.

    Null texts count as empty. Pairs of more than MOST different words are not supported and fail.
    """
    a, b = _words(F.col(reference)), _words(F.col(hypothesis))
    both = rows.withColumn("_a", a).withColumn("_b", b).withColumn("_v", F.array_union("_a", "_b"))
    fits = F.assert_true(F.size("_v") <= MOST, F.lit("too many different words in a pair"))
    edits = F.levenshtein(_as_characters(F.col("_a"), F.col("_v")), _as_characters(F.col("_b"), F.col("_v")))
    return both.withColumn("word_edits", F.when(fits.isNull(), edits).cast("bigint")).withColumn("words", F.size("_a").cast("bigint")).drop("_a", "_b", "_v")


def with_character_errors(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """rows with character_edits and characters (of the reference)."""
    a, b = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    return rows.withColumn("character_edits", F.levenshtein(a, b).cast("bigint")).withColumn("characters", F.length(a).cast("bigint"))


def error_rate(rows: DataFrame, edits: str, units: str, by: list[str] | None = None) -> DataFrame:
    """(by..., edits, units, rate): sums over the corpus, not the mean of sentences; rate null without units."""
    e, u = F.sum(edits), F.sum(units)
    return rows.groupBy(*(by or [])).agg(e.alias("edits"), u.alias("units"), F.round(F.try_divide(e.cast("double"), u.cast("double")), 6).alias("rate"))


def sentence_rates(rows: DataFrame, edits: str, units: str) -> DataFrame:
    """The corpus rate beside the mean and the greatest rate of sentences."""
    each = F.try_divide(F.col(edits).cast("double"), F.col(units).cast("double"))
    return rows.agg(F.round(F.try_divide(F.sum(edits).cast("double"), F.sum(units).cast("double")), 6).alias("corpus"), F.round(F.avg(each), 6).alias("mean_sentence"), F.round(F.max(each), 6).alias("worst_sentence"))


def align(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions, insertions of one best alignment; substitutions before gaps on ties.

    Equal words at both ends are hits of some best alignment, so only what lies between needs the matrix; its rows are
    whole array operations.
    """
    n, m = len(reference), len(hypothesis)
    head = 0
    while head < min(n, m) and reference[head] == hypothesis[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and reference[n - 1 - tail] == hypothesis[m - 1 - tail]:
        tail += 1
    a, b = reference[head : n - tail], hypothesis[head : m - tail]
    if not a or not b:
        return head + tail, 0, len(a), len(b)
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([code[w] for w in a]), np.array([code[w] for w in b])
    place = np.arange(len(b) + 1)
    cost = np.empty((len(a) + 1, len(b) + 1), np.int32)
    cost[0] = place
    for i in range(1, len(a) + 1):
        best = np.minimum(np.r_[i, cost[i - 1, :-1] + (y != x[i - 1])], cost[i - 1] + 1)
        # insertions carry the least of all earlier places along the row
        cost[i] = np.minimum.accumulate(best - place) + place
    hits = subs = dels = inserted = 0
    i, j = len(a), len(b)
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            same = x[i - 1] == y[j - 1]
            hits, subs, i, j = hits + int(same), subs + int(not same), i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            dels, i = dels + 1, i - 1
        else:
            inserted, j = inserted + 1, j - 1
    return head + tail + hits, subs, dels, inserted


def alignment_counts(rows: DataFrame, key: list[str], reference: str, hypothesis: str) -> DataFrame:
    """(key, hits, substitutions, deletions, insertions) of word alignments; a backtrace, so in Python."""
    chosen = rows.select(*key, _words(F.col(reference)).alias("_a"), _words(F.col(hypothesis)).alias("_b"))
    names = ["hits", "substitutions", "deletions", "insertions"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-2]), *(f"{n} bigint" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())
            counts = [align(x, y) for x, y in pairs]
            columns = zip(*counts) if counts else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(list(c), pa.int64()) for c in columns)], [*b.schema.names[:-2], *names])

    return chosen.mapInArrow(run, schema)
