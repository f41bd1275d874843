"""Languages of texts and of the stretches of mixed ones, by Bayesian evidence fusion.

The likelihood of a text under each language comes from counts over all labelled texts: of its common words and,
for other words, of hashed letter n-grams, and of the words' scripts. A Viterbi path over the words finds
stretches of one language. The text's likelihood is combined with the declared label, the language named in the
recording's address (the leading part of its id), and a prior of the recording and session ("host") that is
estimated by grouped aggregation and smoothed from session to address to the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import Lattice
from speechloom.llm.overlaps import file_of_path, file_of_recording
from speechloom.llm.words import plain_words
from speechloom.session import cut

#: A word is common from this share of all words; so fewer than 1 / COMMON words are.
COMMON = 5e-5
BUCKETS = 1 << 14
#: Relative frequencies under this part of a word's greatest are taken for label errors.
NOISE = 0.1
#: A language some of whose labels are right has at least this share of words that are most frequent in it.
OWN = 0.2
WORD_SPAN, NGRAM_SPAN, SCRIPT_SPAN = 6.0, 3.0, 9.0
SWITCH = 6.0
LABEL_WEIGHT, ADDRESS_WEIGHT, HOST_WEIGHT = 2.0, 1.0, 1.0
LEAST_LETTERS = 12

_SCRIPTS = [("hiragana", 0x3041, 0x309F), ("katakana", 0x30A0, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("thai", 0xE00, 0xE7F), ("arabic", 0x600, 0x6FF), ("hebrew", 0x590, 0x5FF), ("devanagari", 0x900, 0x97F)]
#: Scripts written without spaces, where a stretch can be a single word.
_UNSPACED = {"hiragana", "han", "katakana", "thai"}


def word_script(word: str) -> str:
    """The script of a word's first letter beyond Latin; else latin, or none without letters."""
    found = "none"
    for x in word:
        c = ord(x)
        if c < 0x250:
            if x.isalpha():
                found = "latin"
            continue
        for name, low, high in _SCRIPTS:
            if low <= c <= high:
                return name
    return found


def ngrams(word: str) -> list[int]:
    """Buckets of the word's letter n-grams of two to four."""
    import zlib

    padded = f"<{word}>"
    return [zlib.crc32(padded[i : i + n].encode()) % BUCKETS for n in (2, 3, 4) for i in range(len(padded) - n + 1)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, code, n) of labelled texts (text, code), counted within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()
        for b in batches:
            words, offsets = plain_words(b.column(0).to_pylist(), lattice, False, True)
            coded, labels = words.dictionary_encode(), b.column(1).dictionary_encode()
            at = np.repeat(np.asarray(labels.indices), np.diff(offsets))
            n = len(labels.dictionary)
            if not len(words) or not n:
                continue
            both, counts = np.unique(np.asarray(coded.indices, np.int64) * n + at, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(both // n)).cast(pa.string()), labels.dictionary.take(pa.array(both % n)), pa.array(counts)], ["word", "code", "n"])

    return texts.mapInArrow(run, "word string, code string, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihood differences of words under each language."""

    def __init__(self, codes, words, grams, scripts):
        self.codes, self.words, self.grams, self.scripts = codes, words, grams, scripts
        self.known: dict[str, tuple[np.ndarray, int, bool]] = {}

    def word(self, w: str) -> tuple[np.ndarray, int, bool]:
        """Scores, letters, and whether the word's script is written without spaces."""
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            kind = word_script(w)
            score = self.scripts.get(kind)
            score = np.zeros(len(self.codes), np.float32) if score is None else score
            if kind != "none":
                own = self.words.get(w)
                if own is None and w:
                    # long unbroken runs by how often they have each bucket, in bounded memory
                    own = (self.grams[ngrams(w)].sum(axis=0) if len(w) < BUCKETS // 3 else np.bincount(ngrams(w), minlength=BUCKETS) @ self.grams) * 0.3
                    own = np.maximum(own - own.max(), -NGRAM_SPAN)
                score = score + own
            self.known[w] = (score.astype(np.float32), sum(x.isalpha() for x in w), kind in _UNSPACED)
        return self.known[w]


def _scores(counts: np.ndarray, totals: np.ndarray, span: float, noise: float = NOISE) -> np.ndarray:
    """Rows of counts by language to capped log relative frequencies, the greatest 0."""
    rate = counts / totals
    most = rate.max(axis=1, keepdims=True)
    rate = np.where(rate < noise * most, 0, rate)
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(rate / np.maximum(most, 1e-300)), -span).astype(np.float32)


def train(labelled: DataFrame) -> Model | None:
    """A model of texts (text, code) from counts over all of them; None without any labelled word.

    To the driver come at most 1 / COMMON words, BUCKETS n-grams and the scripts, by language.
    """
    counts = cut(word_counts(labelled))
    totals = {r.code: r.n for r in counts.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    codes = sorted(totals)
    whole = sum(totals.values())
    often = counts.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= max(3.0, COMMON * whole))
    common = counts.join(often, "word").select("word", "code", "n").toPandas()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the letters of words, each different word counts by the logarithm of its number
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for w, code, n in zip(*(c.to_pylist() for c in b.columns)):
                sums["script:" + word_script(w), code] = sums.get(("script:" + word_script(w), code), 0.0) + n
                for g in ngrams(w):
                    sums[str(g), code] = sums.get((str(g), code), 0.0) + math.log1p(n)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array(list(sums.values()))], ["feature", "code", "n"])

    table = counts.mapInArrow(features, "feature string, code string, n double").groupBy("feature", "code").agg(F.sum("n").alias("n")).toPandas()

    def matrix(frame, key):
        wide = frame.pivot_table(index=key, columns="code", values="n", aggfunc="sum", fill_value=0).reindex(columns=codes, fill_value=0)
        return list(wide.index), wide.to_numpy(float)

    total = np.array([totals[c] for c in codes], float)
    words, n = matrix(common, "word")
    # a language that is most frequent for hardly any of its own words and n-grams has no right labels
    is_script = table.feature.str.startswith("script:")

    def leading(x, total):
        most = (x / total).argmax(axis=1)
        return np.bincount(most, weights=x[np.arange(len(x)), most], minlength=x.shape[1]) / np.maximum(x.sum(axis=0), 1)

    grams = matrix(table[~is_script], "feature")[1]
    real = (leading(n, total) >= OWN) | (leading(grams, grams.sum(axis=0) + 1) >= OWN)
    real = real if real.any() else np.ones(len(codes), bool)
    codes = [c for c, r in zip(codes, real) if r]
    word_scores = _scores(n[:, real] + 1e-9, total[real], WORD_SPAN)
    kinds, s = matrix(table[is_script], "feature")
    script_scores = _scores(s + 1e-9, total[real], SCRIPT_SPAN)
    # scripts used by several languages tell little between them
    script_scores = np.where(script_scores > -2.5, 0, script_scores)
    buckets, g = matrix(table[~is_script], "feature")
    gram_scores = np.zeros((BUCKETS, len(codes)), np.float32)
    gram_scores[[int(b) for b in buckets]] = _scores(g + 1e-9, g.sum(axis=0) + 1, 5.0)
    return Model(codes, dict(zip(words, word_scores)), gram_scores, {k.removeprefix("script:"): v for k, v in zip(kinds, script_scores)})


def _paths(scores: np.ndarray) -> np.ndarray:
    """Best language of each word, of many texts of one length: scores (texts, words, languages)."""
    texts, length, n = scores.shape
    best = scores[:, 0].copy()
    stay = np.empty((texts, length, n), bool)
    jump = np.empty((texts, length), np.int64)
    for i in range(1, length):
        top = best.argmax(axis=1)
        switched = best[np.arange(texts), top] - SWITCH
        stay[:, i] = best >= switched[:, None]
        jump[:, i] = top
        best = np.maximum(best, switched[:, None]) + scores[:, i]
    path = np.empty((texts, length), np.int64)
    path[:, -1] = best.argmax(axis=1)
    rows = np.arange(texts)
    for i in range(length - 1, 0, -1):
        at = path[:, i]
        path[:, i - 1] = np.where(stay[rows, i, at], at, jump[:, i])
    return path


def analyse(texts: list[str | None], model: Model, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[tuple]]]:
    """Words, letters and summed scores of each text; of texts whose path changes, by place, their stretches
    (first word, words, language, letters, summed scores, known).
    """
    words, offsets = plain_words(texts, lattice, False, True)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    n = len(model.codes)
    rows = [model.word(w) for w in distinct]
    index = np.asarray(coded.indices)
    table = np.stack([r[0] for r in rows]) if rows else np.zeros((0, n), np.float32)
    score = table[index]
    letters = np.array([r[1] for r in rows], np.int64)[index]
    length = np.diff(offsets)
    full = length > 0
    total, size = np.zeros((len(texts), n), np.float32), np.zeros(len(texts), np.int64)
    if full.any():
        total[full], size[full] = np.add.reduceat(score, offsets[:-1][full]), np.add.reduceat(letters, offsets[:-1][full])
    path = np.zeros(len(index), np.int64)
    for count in np.unique(length[full]):
        at = np.flatnonzero(length == count)
        for part in np.array_split(at, max(1, len(at) * int(count) // 400_000)):
            flat = offsets[part][:, None] + np.arange(count)
            path[flat] = _paths(score[flat])
    turn = np.flatnonzero(path[1:] != path[:-1]) + 1
    of = np.searchsorted(offsets, turn, side="right") - 1
    changed = np.unique(of[turn > offsets[of]])
    unspaced = np.array([r[2] for r in rows], bool)
    common = np.array([w in model.words for w in distinct], bool)
    out = {}
    for i in changed.tolist():
        a, b = offsets[i], offsets[i + 1]
        p = path[a:b]
        edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), b - a]
        stretches = []
        for x, y in zip(edges, edges[1:]):
            c, at, part = int(p[x]), index[a + x : a + y], score[a + x : a + y]
            own = part[:, c]
            known = bool((unspaced[at] & (own > -1)).any() or (common[at] & (own > -0.7) & (part.mean(axis=1) < -1.5)).any())
            stretches.append((x, int(y - x), c, int(letters[a + x : a + y].sum()), part.sum(axis=0), known))
        out[i] = stretches
    return length, size, total, out


def _add(prior: np.ndarray, column, codes: list[str], weight: float) -> None:
    """Adds a weight where a row's code is one of the model's."""
    coded = column.dictionary_encode()
    places = {c: i for i, c in enumerate(codes)}
    to = np.array([places.get(c, -1) for c in coded.dictionary.to_pylist()] + [-1], np.int64)
    at = to[np.asarray(coded.indices.fill_null(len(to) - 1))]
    rows = np.flatnonzero(at >= 0)
    prior[rows, at[rows]] += weight


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _judge(model: Broadcast):
    """Rows (kind, key, text, label_code, address_code, host rates of the model's codes) to stretches."""
    names = ["record_kind", "record_key", "label_code", "stretch", "first_word", "words", "letters", "text_letters", "language", "confidence", "mixed"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lattice = Model(*model.value), Lattice()
        codes = np.array(m.codes, dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            prior = np.zeros((b.num_rows, len(m.codes)))
            _add(prior, b.column(3), m.codes, LABEL_WEIGHT)
            _add(prior, b.column(4), m.codes, ADDRESS_WEIGHT)
            rate = np.asarray(b.column(5).flatten()).reshape(b.num_rows, len(m.codes))
            prior += HOST_WEIGHT * np.log(np.maximum(rate, 0.01) / 0.01) / math.log(100)

            length, letters, score, changed = analyse(b.column(2).to_pylist(), m, lattice)
            mixed, out = [], []
            for i, stretches in changed.items():
                by_code: dict[int, int] = {}
                for _, _, c, n, _, known in stretches:
                    if known:
                        by_code[c] = by_code.get(c, 0) + n
                if sum(v >= LEAST_LETTERS for v in by_code.values()) > 1:
                    mixed.append(i)
                    first = [b.column(k)[i].as_py() for k in (0, 1, 3)]
                    for k, (start, words, c, n, s, _) in enumerate(stretches):
                        out.append((*first, k, start, words, n, int(letters[i]), m.codes[c], round(float(_softmax(s + prior[i])[c]), 6), by_code.get(c, 0) >= LEAST_LETTERS))
            one = np.setdiff1d(np.arange(b.num_rows), np.array(mixed, np.int64))
            z = _softmax(score[one] + prior[one])
            best = z.argmax(axis=1)
            empty = length[one] == 0
            zero = np.zeros(len(one), np.int32)
            take = pa.array(one)
            language = np.where(empty, None, codes[best])
            sure = np.where(empty, 0.0, np.round(z[np.arange(len(one)), best], 6))
            columns = [b.column(0).take(take), b.column(1).take(take), b.column(3).take(take), zero, zero, length[one].astype(np.int32), letters[one], letters[one], language, sure, np.zeros(len(one), bool)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


STRETCHES = "record_kind string, record_key string, label_code string, stretch int, first_word int, words int, letters bigint, text_letters bigint, language string, confidence double, mixed boolean"


def language_rows(segments: DataFrame, samples: DataFrame, codes: DataFrame) -> DataFrame:
    """(record_kind, record_key, text, label_code, session, address): one row for each record, its label's code null if missing."""
    label = F.lower(F.trim("language"))
    one = segments.where("utt_id is not null").select(F.lit("segment").alias("record_kind"), F.col("utt_id").alias("record_key"), "text", label.alias("label"), F.element_at(F.split(file_of_recording(F.col("rec_id")), "_"), 1).alias("session"), F.lower(F.element_at(F.split("rec_id", "__"), 1)).alias("address"))
    file = file_of_path(F.col("audio_path"))
    folder = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce("audio_path", F.lit("")), r"%2[Ff]|\\+", "/"), r"([A-Za-z]+)[/_][A-Za-z]+/+[^/]+$", 1))
    two = samples.where("sample_no is not null").select(F.lit("sample").alias("record_kind"), F.col("sample_no").cast("string").alias("record_key"), F.col("question").alias("text"), label.alias("label"), F.element_at(F.split(file, "_"), 1).alias("session"), F.nullif(folder, F.lit("")).alias("address"))
    both = one.unionByName(two).groupBy("record_kind", "record_key").agg(F.min(F.struct("text", "label", "session", "address")).alias("r")).select("record_kind", "record_key", "r.*")
    # the fixed table of label spellings
    named = codes.select("label", F.col("code").alias("label_code"))
    both = both.join(named, "label", "left").drop("label")
    return both.join(named.withColumnsRenamed({"label": "address", "label_code": "address_code"}), "address", "left")


def host_rates(rows: DataFrame, codes: list[str]) -> DataFrame:
    """(session, address, rates) of every session at an address, with or without labels: the rate of each code in order.

    The labels of a session, smoothed by those of its address, and these by the whole corpus. A null session has no
    labels of its own, nor has a null address.
    """
    labels = cut(rows.where("label_code is not null").groupBy("session", "address", "label_code").agg(F.count("*").alias("n")))
    # at most as many as the fixed table has codes
    base = {r.label_code: r.n for r in labels.groupBy("label_code").agg(F.sum("n").alias("n")).collect()}
    every = max(1, sum(base.values()))

    def counted(keys: list[str], name: str) -> DataFrame:
        by_code = labels.where(F.col(keys[0]).isNotNull()).groupBy(*keys, "label_code").agg(F.sum("n").alias("n"))
        return by_code.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label_code", "n"))).alias(name), F.sum("n").alias(f"{name}_n"))

    by_session = counted(["session", "address"], "s").withColumnsRenamed({"session": "own_session", "address": "own_address"})
    hosts = rows.select("session", "address").distinct()
    hosts = hosts.join(by_session, (F.col("session") == F.col("own_session")) & F.col("address").eqNullSafe(F.col("own_address")), "left").join(counted(["address"], "a"), "address", "left")
    of = lambda name, code: F.coalesce(F.try_element_at(name, F.lit(code)), F.lit(0))
    size = lambda name: F.coalesce(f"{name}_n", F.lit(0))
    middle = lambda code: (of("a", code) + F.lit(10 * base.get(code, 0) / every)) / (size("a") + 10)
    return hosts.select("session", "address", F.array(*((of("s", c) + 5 * middle(c)) / (size("s") + 5) for c in codes)).alias("rates"))


def text_languages(rows: DataFrame) -> DataFrame:
    """Stretches of every record of language_rows, with language and confidence.

    A text of one language has one row; a mixed one a row for each stretch, mixed true for those of a language
    with at least LEAST_LETTERS letters in the text. Null, empty and letterless texts have one row with a null
    language and confidence 0 (words without evidence get the language of label, address and host). Without
    any labelled text the result is empty.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    model = train(rows.where("label_code is not null and text is not null").select("text", F.col("label_code").alias("code")))
    if model is None:
        return spark.createDataFrame([], STRETCHES)
    # its parts, since a broadcast is pickled by reference to the package
    shared = spark.sparkContext.broadcast((model.codes, model.words, model.grams, model.scripts))
    host = ["session", "address"]
    rates = host_rates(rows, model.codes)
    joined = rows.join(rates.withColumnsRenamed({c: f"host_{c}" for c in host}), [F.col(c).eqNullSafe(F.col(f"host_{c}")) for c in host], "left")
    ready = joined.select("record_kind", "record_key", "text", "label_code", "address_code", "rates")

    return ready.mapInArrow(_judge(shared), STRETCHES)


def label_cases(stretches: DataFrame) -> DataFrame:
    """(record_kind, record_key, language): missing or wrong labels, and both languages of mixed texts."""
    enough = stretches.where(F.col("text_letters") >= LEAST_LETTERS)
    wrong: Column = F.col("label_code").isNull() | (F.col("label_code") != F.col("language"))
    one = enough.where((F.col("stretch") == 0) & (F.col("words") > 0)).where("language is not null")
    mixed = enough.where("mixed").select("record_kind", "record_key", "language").distinct()
    single = one.join(mixed.select("record_kind", "record_key").distinct(), ["record_kind", "record_key"], "left_anti").where(wrong).select("record_kind", "record_key", "language")
    return single.unionByName(mixed)
