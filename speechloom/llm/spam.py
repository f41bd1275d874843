"""Pages of repeated keywords, links, tags or product lines instead of sentences.

Corpus counts of neighbouring words tell what is coherent: a pair is incoherent if the documents of ordinary text
hold it less often than chance would (pointwise mutual information under 0), and excessively repeated if a
document holds it far more densely than the ordinary documents that hold it at all. The share of a page's words
in such pairs, in links, tags and product lines is its spam share. Ordinary documents are first those without
much repetition, then, in a second round, those with a small spam share.

Counts are of different sentences, so that an utterance said again is no collocation. A sentence said REPEATED times
or more counts with all its copies if most of it is incoherent, where an incoherent pair need not be in two different
sentences; ordinary utterances are coherent however often they are said, and count once.

Counts cover all documents. Common pairs and words, whose number is bounded by the inverse of their least share,
are looked up in a broadcast table; questions about all other pairs and words are answered by joins on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import Lattice, canonical_text
from speechloom.llm.words import is_consistent
from speechloom.session import cut

#: Least shares of common pairs and words: at most 1 / share of them are broadcast, 24 bytes each.
PAIR_SHARE, WORD_SHARE = 4e-6, 1e-5
#: Spam share from which a page is reported; bounds under which a document counts as ordinary in each round.
THRESHOLD, ORDINARY = 0.38, (0.15, 0.12)
#: A link or tag counts as so many words.
LINK_WORDS = 3
LEAST_WORDS = 8
#: Occurrences, with those in copies of a sentence, from which a pair is repeated.
REPEATED = 3
#: Share of a repeated sentence's words in incoherent pairs from which all its copies count.
MOSTLY = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)

_url = re.compile(r"(?:https?://|www\.)[^\s\"'<>]+", re.I)
_anchor = re.compile(r"<a\s[^>]*>(.*?)</a>", re.I | re.S)
_markup = re.compile(r"<[^>]*>")
_tag = re.compile(r"#[^\W\d][\w-]*")
_word = re.compile(r"[^\W_]+")
_separators = ("\t", *(f" {x} " for x in "-–—|·»;/"))
_field = re.compile(r"\s+[-–—|·»;/]\s+|\t")
_price = re.compile(r"(?<![\d.])\d+[.,]\d\d(?![\d.,]*\d)|[$€£¥]\s?\d")


def is_product_line(line: str) -> bool:
    """At least four fields, one of them a price, and no end of a sentence."""
    return len(_field.findall(line)) >= 3 and bool(_price.search(line)) and not line.rstrip().endswith((".", "!", "?", "。"))


def strip(text: str) -> tuple[str, int]:
    """A text without links, tags and product lines, and the words that they count for."""
    other = 0
    if "<" in text:
        anchors = _anchor.findall(text)
        text = _anchor.sub(" ", text)
        other = LINK_WORDS * len(anchors) + sum(len(_word.findall(x)) for x in anchors)
    if "://" in text or "www." in text.lower():
        text, links = _url.subn(" ", text)
        other += LINK_WORDS * links
    if "<" in text:
        text = _markup.sub(" ", text)
    if "#" in text:
        text, tags = _tag.subn(" ", text)
        other += LINK_WORDS * tags
    if any(x in text for x in _separators) and _price.search(text):
        kept = []
        for line in text.split("\n"):
            if is_product_line(line):
                other += len(_word.findall(line))
            else:
                kept.append(line)
        text = "\n".join(kept)
    return text, other


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different sentences of each text: word hashes with 0 after each sentence, their bounds by text, the copies of each sentence, their bounds by text, and the words of each text.

    Sentences of four words or more are compared, shorter ones all kept; numbers are no words.
    """
    t = pc.utf8_lower(pa.array(texts, pa.large_string()))
    for pattern, form in ((r"[.!?。？！]+(?:\s+|$)|\n+", " \x01 "), (r"([\x{3041}-\x{30FF}\x{3400}-\x{9FFF}])", r" \1 "), (r"[^\p{L}\p{N}\x01]+", " ")):
        t = pc.replace_substring_regex(t, pattern, form)
    lists = pc.split_pattern(pc.utf8_trim_whitespace(t), " ")
    coded = lists.flatten().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashed = (pd.util.hash_array(names, categorize=False) >> np.uint64(1)).astype(np.int64) | 1 if len(names) else np.empty(0, np.int64)
    end = (names == "\x01") | (names == "") if len(names) else np.empty(0, bool)
    number = np.array([x.isdigit() for x in names], bool)
    code = np.asarray(coded.indices)
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), np.int64))
    # a sentence ends at its mark and with its text
    unit = np.cumsum(end[code]) + doc
    keep = ~(end | number)[code]
    words, doc, unit = hashed[code][keep], doc[keep], unit[keep]
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(words)])
    own = np.repeat(np.arange(len(start)), size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=1)), _MIX))
        key = np.add.reduceat(words.astype(np.uint64) * power[np.arange(len(words)) - start[own]], start) if len(start) else np.empty(0, np.uint64)
    of = doc[start]
    key = np.where(size >= 4, _key(key, of), -1 - np.arange(len(start)))
    same, _ = pd.factorize(key)
    times = np.bincount(same)
    first = np.zeros(len(start), bool)
    first[np.unique(same, return_index=True)[1]] = True
    place = np.cumsum(first) - first
    at = np.flatnonzero(first[own])
    flat = np.zeros(len(at) + int(first.sum()), np.int64)
    flat[np.arange(len(at)) + place[own[at]]] = words[at]
    n = np.bincount(of[first], size[first], len(texts)).astype(np.int64)
    many = np.bincount(of[first], minlength=len(texts))
    return flat, np.r_[0, np.cumsum(n + many)], times[same[first]].astype(np.int32), np.r_[0, np.cumsum(many)], n


def _consistent(text: str, lattice: Lattice) -> str:
    """The canonical form line by line; a text that needs none in any line returns at once."""
    return text if is_consistent(text) else "\n".join(canonical_text(line, lattice) for line in text.split("\n"))


def parsed_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, words, copies, n, other, mass): 63-bit word hashes with 0 after each sentence, copies of each, words of the different ones, and a first spam share."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()
        for b in batches:
            parts = [strip(_consistent(x, lattice)) if x else ("", 0) for x in b.column(1).to_pylist()]
            words, ends, times, bounds, n = sentences([x for x, _ in parts])
            other = np.array([x for _, x in parts], np.int64)
            pairs = Pairs(words, ends)
            w = np.bincount(pairs.row, times[_units(words)[pairs.at]], len(pairs.v))
            total, often = np.bincount(pairs.doc, w, len(n)), np.bincount(pairs.doc, w * (w >= 4), len(n))
            mass = np.where(other * 10 < n, often / np.maximum(total, 1) - 0.2, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(times)), pa.array(n), pa.array(other), pa.array(mass)], ["doc_id", "words", "copies", "n", "other", "mass"])

    return rows.mapInArrow(run, "doc_id bigint, words array<bigint>, copies array<int>, n bigint, other bigint, mass double")


def _units(words: np.ndarray) -> np.ndarray:
    """The number of each word's sentence in the batch."""
    return np.cumsum(words == 0) - (words == 0)


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 63-bit key of two words, above 0."""
    with np.errstate(over="ignore"):
        x = first.astype(np.uint64) * _MIX + second.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x >> np.uint64(1)).astype(np.int64) | 1


class Pairs:
    """The different pairs of neighbouring words of each text of a batch.

    names: the different words; first, second, keys: the different pairs of the batch, by place in names; and for each
    pair of each text: doc, pair (its place among those), v (its number). at, row: place and pair of each occurrence.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        code, self.names = pd.factorize(words)
        self.at = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0)) if len(words) > 1 else np.empty(0, np.int64)
        n = max(1, len(self.names))
        of, found = pd.factorize(code[self.at] * np.int64(n) + code[self.at + 1])
        self.first, self.second = found // n, found % n
        self.keys = _key(self.names[self.first], self.names[self.second])
        size = max(1, len(found))
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[self.at]
        self.row, own = pd.factorize(doc * np.int64(size) + of)
        self.doc, self.pair = own // size, own % size
        self.v = np.bincount(self.row, minlength=len(own))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, count, held): of pairs their occurrences and the words of texts that hold them; of words (negative keys) occurrences."""
    for b in batches:
        words, ends = _lists(b.column(0))
        n = np.asarray(b.column(1))
        p = Pairs(words, ends)
        single = np.bincount(pd.factorize(words)[0], minlength=len(p.names))
        real = p.names != 0
        count, held = (np.bincount(p.pair, x, len(p.keys)).astype(np.int64) for x in (p.v, n[p.doc]))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[p.keys, -p.names[real]]), pa.array(np.r_[count, single[real]]), pa.array(np.r_[held, np.zeros(real.sum(), np.int64)])], ["key", "count", "held"])


def _bad(v, w, n, own, count, held, expected, same):
    """Excessively repeated or incoherent in the different sentences; incoherent with their copies.

    A word said over and over (same) is a filler of speech if ordinary texts repeat it too, however often; else it is incoherent.
    """
    rate = np.divide(count, held, out=np.zeros(len(v)), where=held > 0)
    dense, odd = (v >= 3) & (v > 3 * rate * n + 1) & ~same, count - own < expected
    return dense | odd & ((expected > 1) | (v >= 2)), odd & ((expected > 1) | (v >= 2) | (w >= REPEATED))


def _round(parsed: DataFrame, limit: float) -> DataFrame:
    """parsed with new spam shares, under the counts of documents below a limit."""
    spark = parsed.sparkSession
    ordinary = parsed.where((F.col("mass") < limit) & (F.col("n") >= LEAST_WORDS))
    counts = cut(ordinary.select("words", "n").mapInArrow(_counts, "key bigint, count bigint, held bigint").groupBy("key").agg(F.sum("count").alias("count"), F.sum("held").alias("held")))
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("key") < 0, F.col("count"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("key") > 0, F.col("count"))), F.lit(0))).first()
    all_words, all_pairs = max(1, total[0]), total[1]
    least_pair, least_word = max(2, PAIR_SHARE * all_pairs), max(2, WORD_SHARE * all_words)
    table = counts.where(((F.col("key") > 0) & (F.col("count") >= least_pair)) | ((F.col("key") < 0) & (F.col("count") >= least_word))).toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast((table["key"].to_numpy(), table["count"].to_numpy(float), table["held"].to_numpy(float)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each text that are surely bad, and those that may be, with what is known of them and of their words."""
        keys, count, held = shared.value

        def find(x):
            i = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
            hit = keys[i] == x if len(keys) else np.zeros(len(x), bool)
            return hit, np.where(hit, count[i], 0.0) if len(keys) else np.zeros(len(x)), np.where(hit, held[i], 0.0) if len(keys) else np.zeros(len(x))

        for b in batches:
            words, ends = _lists(b.column(1))
            n, mass = np.asarray(b.column(2)), np.asarray(b.column(3))
            p = Pairs(words, ends)
            v, doc = p.v, p.doc
            w = np.bincount(p.row, _lists(b.column(4))[0][_units(words)[p.at]], len(v)).astype(np.int64)
            own = np.where((mass < limit) & (n >= LEAST_WORDS), 1, 0)[doc] * v
            # between the least and the most that words below the least share can count; what is bad stays so as more is expected
            has, said, _ = find(-p.names)
            least_said, most_said = np.where(has, said, 1), np.where(has, said, least_word)
            low, high = ((x[p.first] * x[p.second] / all_words)[p.pair] for x in (least_said, most_said))
            known, c, h = (x[p.pair] for x in find(p.keys))
            # a rare pair is surely incoherent above the least count of common ones, and cannot be bad if seldom seen and unexpected
            same = (p.first == p.second)[p.pair]
            least, most = (_bad(v, w, n[doc], own, c, h, x, same) for x in (low, high))
            twice, often = v >= 2, (v >= 2) | (w >= REPEATED)
            bad, odd = (np.where(known, x, (low > least_pair) & ((low > 1) | y)) for x, y in zip(least, (twice, often)))
            may, may_odd = (np.where(known, x, y | (high > 1)) for x, y in zip(most, (twice, often)))
            open_ = (may & ~bad) | (may_odd & ~odd)
            for at, is_open in ((np.flatnonzero((bad | odd) & ~open_), False), (np.flatnonzero(open_), True)):
                first, second = p.first[p.pair[at]], p.second[p.pair[at]]
                counted = [pa.array(x.astype(np.int64), mask=~hit) for x, hit in ((said[first], has[first]), (said[second], has[second]), (c[at], known[at]), (h[at], known[at]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[doc[at]]), pa.array(p.keys[p.pair[at]]), pa.array(p.names[first]), pa.array(p.names[second]), pa.array(v[at].astype(np.int64)), pa.array(w[at]), pa.array(n[doc[at]]), pa.array(own[at].astype(np.int64)), *counted, pa.array(bad[at]), pa.array(odd[at]), pa.array(np.full(len(at), is_open))], ["row", "pair", "left", "right", "v", "w", "n", "own", "first", "second", "count", "held", "bad", "odd", "open"])

    asked = cut(parsed.select("row", "words", "n", "mass", "copies").mapInArrow(ask, "row bigint, pair bigint, left bigint, right bigint, v bigint, w bigint, n bigint, own bigint, first bigint, second bigint, count bigint, held bigint, bad boolean, odd boolean, open boolean"))
    open_ = asked.where("open")
    rare = counts.where((F.col("key") > 0) & (F.col("count") < least_pair)).select(F.col("key").alias("pair"), F.col("count").alias("rare_count"), F.col("held").alias("rare_held"))
    rare_words = counts.where((F.col("key") < 0) & (F.col("count") < least_word)).select((-F.col("key")).alias("word"), F.col("count").alias("said"))
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.when(F.col(c).isNull(), F.col(x)).alias("word")) for k, c, x in ((1, "first", "left"), (2, "second", "right"))))
    sought = open_.where("first is null or second is null").select("pair", "left", "right", "first", "second").distinct().select("pair", F.inline(sides)).where("word is not null")
    said = sought.join(rare_words, "word").groupBy("pair").agg(*(F.max(F.when(F.col("side") == k, F.col("said"))).alias(f"said_{k}") for k in (1, 2)))
    # words that no ordinary document holds count once
    one, two = F.coalesce("first", "said_1", F.lit(1)), F.coalesce("second", "said_2", F.lit(1))
    answered = open_.join(rare, "pair", "left").join(said, "pair", "left").withColumns({"count": F.coalesce("count", "rare_count", F.lit(0)), "held": F.coalesce("held", "rare_held", F.lit(0)), "expected": one.cast("double") * two / F.lit(float(all_words))})
    dense = (F.col("left") != F.col("right")) & (F.col("v") >= 3) & (F.col("v") > F.lit(3) * F.coalesce(F.try_divide("count", "held"), F.lit(0.0)) * F.col("n") + 1)
    odd = F.col("count") - F.col("own") < F.col("expected")
    strict = (F.col("expected") > 1) | (F.col("v") >= 2)
    answers = answered.select("row", "pair", (dense | odd & strict).alias("bad"), (odd & (strict | (F.col("w") >= REPEATED))).alias("odd"))
    found = asked.where("not open").select("row", "pair", "bad", "odd").unionByName(answers.where("bad or odd"))
    flagged = found.groupBy("row").agg(*(F.collect_list(F.when(F.col(c), F.col("pair"))).alias(f"{c}_pairs") for c in ("bad", "odd")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ends = _lists(b.column(2))
            copies, parts = _lists(b.column(3))
            n, other = np.asarray(b.column(4)), np.asarray(b.column(5))
            p = Pairs(words, ends)
            mine = _key(p.keys[p.pair], p.doc)

            def marked(column):
                mark = np.zeros(len(words), bool)
                bad_pairs, bounds = _lists(column)
                asked = _key(bad_pairs, np.repeat(np.arange(len(n)), np.diff(bounds)))
                hit = p.at[pd.Series(mine).isin(asked).to_numpy()[p.row]]
                mark[hit] = True
                mark[hit + 1] = True
                return mark

            bad, odd = marked(b.column(6)), marked(b.column(7))
            unit = _units(words)
            length, some, incoherent, either = (np.bincount(unit[x], minlength=len(copies)) for x in (words != 0, bad, odd, bad | odd))
            keywords = (copies >= REPEATED) & (incoherent >= MOSTLY * length)
            times = np.where(keywords, copies, 1)
            covered = np.where(keywords, either, some) * times
            text = np.repeat(np.arange(len(n)), np.diff(parts))
            size = np.bincount(text, length * times, len(n)) + other
            mass = np.where(size >= LEAST_WORDS, (np.bincount(text, covered, len(n)) + other) / np.maximum(size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(mass)], ["row", "doc_id", "words", "copies", "n", "other", "mass"])

    joined = parsed.drop("mass").join(flagged, "row", "left").withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("bad_pairs", "odd_pairs")})
    return joined.mapInArrow(weigh, "row bigint, doc_id bigint, words array<bigint>, copies array<int>, n bigint, other bigint, mass double")


def spam_shares(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_share) of every document with a key; 0 for null, empty and very short texts.

    Every text of a repeated doc_id is judged, and the greatest share counts. Whole texts are read; an empty table gives no rows.
    """
    # row numbers hold once the rows are written
    parsed = cut(parsed_documents(documents).select(F.monotonically_increasing_id().alias("row"), "*"))
    for limit in ORDINARY:
        parsed = cut(_round(parsed, limit))
    return parsed.groupBy("doc_id").agg(F.round(F.max("mass"), 6).alias("spam_share"))


def spam_pages(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spam_share) of documents that consist mostly of keywords, links, tags or product lines."""
    return spam_shares(documents).where(F.col("spam_share") >= threshold)
