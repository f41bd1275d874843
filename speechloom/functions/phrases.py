"""Repeated and stock phrases of transcripts, quotes, question templates, and the choice of labels."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from speechloom.functions.text import WORD, collapse, mask, normalize_label, repeated_ngram_cut, single_runs_collapsed, unmask

#: Closing phrases after which a transcript is cut (fixed values).
CLOSINGS = "thank you for watching|next video|please subscribe|please like and subscribe|check description|don't forget to|in this video"
#: Quotes that are masked, with their greatest length (fixed values).
QUOTES = "|".join(["„[^”\"]{0,300}[”\"]", "“[^”]{0,300}”", "‘[^’]{0,300}’", "«[^»]{0,300}»", "「[^」]{0,300}」", "『[^』]{0,300}』", '"[^"\\n]{2,200}"'])
#: Numbers and ranges that are masked before translation (fixed values).
TIMESTAMPS = r"[\[\(]?\d+(?:[.,]\d+)?\s*[-–]\s*\d+(?:[.,]\d+)?[\]\)]?|\d+(?:[.,]\d+)+[\p{L}\p{N}_]{0,2}"
NOTE = "\n[Note: ASR transcription may contain errors]"


def masked_quotes(text: Column) -> tuple[Column, Column]:
    """The text with its k-th quote as [Qk], and the quotes."""
    return mask(text, QUOTES, "[Q", "]")


def restored_quotes(text: Column, found: Column) -> Column:
    return unmask(text, found, "[Q", "]")


def masked_timestamps(text: Column) -> tuple[Column, Column]:
    """The text with its k-th number or range as TSkTS, and those."""
    return mask(text, TIMESTAMPS, "TS", "TS")


def _collapsed(text: str, least: int, most: int, repeats: int) -> str:
    words = text.split()
    if len(words) < least * repeats:
        return text
    low = [w.lower() for w in words]
    out: list[str] = []
    i = 0
    while i < len(words):
        step = 1
        for n in range(min(most, (len(words) - i) // repeats), least - 1, -1):
            times = 1
            while low[i : i + n] == low[i + times * n : i + (times + 1) * n]:
                times += 1
            if times >= repeats:
                out += words[i : i + n]
                step = 0
                i += times * n
                break
        if step:
            out.append(words[i])
            i += 1
    return " ".join(out)


def phrases_collapsed(text: Column, least: int = 2, most: int = 4, repeats: int = 3) -> Column:
    """Phrases of `least` to `most` words said `repeats` times or more in a row are kept once, the longest first.

    From left to right, letter case aside; shorter texts stay as they are. The search restarts after each phrase,
    which a regular expression cannot express.
    """
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else _collapsed(x, least, most, repeats))

    return run(text)


def normal_phrase(text: Column) -> Column:
    return collapse(F.lower(F.trim(F.coalesce(text, F.lit("")))))


def mined_phrases(rows: DataFrame, text: str, least_count: int = 2, least_length: int = 6, most_words: int = 6, seeds: list[str] | None = None) -> DataFrame:
    """(phrase, n): whole texts and their runs of 2 to most_words words that occur least_count times or more, and seeds.

    Lower case, spaces collapsed; phrases shorter than least_length characters do not count. Runs are counted within
    partitions before the shuffle. Null and empty texts give none; seeds have the number they were found with, or 0.
    """
    t = rows.select(normal_phrase(F.col(text)).alias("t")).where("t != ''")
    words = F.regexp_extract_all("t", F.lit(f"[{WORD}]+"), F.lit(0))

    def runs(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
        return F.when(F.size("w") >= k, found).otherwise(F.array().cast("array<string>"))

    each = t.withColumn("w", words).select(F.explode(F.concat(F.array("t"), *(runs(k) for k in range(2, most_words + 1)))).alias("phrase"))
    counted = each.where(F.length("phrase") >= least_length).groupBy("phrase").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") >= least_count)
    if not seeds:
        return found
    spark = rows.sparkSession
    given = spark.createDataFrame([(s,) for s in seeds], "phrase string").select(normal_phrase(F.col("phrase")).alias("phrase")).where("phrase != ''").distinct()
    return found.unionByName(given.join(found, "phrase", "left_anti").select("phrase", F.lit(0).cast("bigint").alias("n")))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the union of spans."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a] if a > at else "")
        at = max(at, b)
    return "".join(out) + text[at:]


def without_phrases(text: Column, phrases: Broadcast) -> Column:
    """A text without the union of all places of given phrases (a broadcast list, in lower case), letter case aside.

    One automaton holds all phrases, so the work does not grow with their number; their total size is the caller's
    bound. Texts whose lower case has another length are matched as they are.
    """
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in phrases.value:
            if p:
                machine.add_word(p, len(p))
        if not len(machine):
            return texts
        machine.make_automaton()

        def one(x: str | None) -> str | None:
            if not x:
                return x
            low = x.lower() if len(x.lower()) == len(x) else x
            return without_spans(x, [(end + 1 - n, end + 1) for end, n in machine.iter(low)])

        return texts.map(one)

    return run(text)


def without_hallucinations(text: Column, phrases: Broadcast | None = None) -> Column:
    """A transcript without given phrases, with words and short phrases said over and over kept once, cut at a stock closing."""
    out = F.coalesce(text, F.lit(""))
    out = out if phrases is None else without_phrases(out, phrases)
    out = phrases_collapsed(single_runs_collapsed(out))
    # only from the last line, as far as its end
    return collapse(F.regexp_replace(out, rf"(?i)(?:{CLOSINGS}).*?$", ""))


def usable_transcript(text: Column, most_words: int = 0) -> Column:
    """A transcript cut at its loop, with a note if it was, and to most_words words (0: all); null gives an empty text."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    kept = repeated_ngram_cut(whole)
    words = F.filter(F.split(kept, r"\s+"), lambda w: w != "")
    few = F.array_join(F.slice(words, 1, most_words), " ") if most_words else F.array_join(words, " ")
    looped = kept != whole
    return F.when(looped, F.trim(F.concat(few, F.lit(NOTE)))).otherwise(few if most_words else whole)


def nearest_label(text: Column, labels: Column) -> Column:
    """The label an answer names: equal once normalised, else the longest that it contains, else the most similar; the text itself without labels.

    Similarity is the ratio of matching blocks, and of equal ones the greater label in order; always answered.
    """
    @F.pandas_udf(StringType())
    def similar(texts: pd.Series, own: pd.Series, normal: pd.Series) -> pd.Series:
        # the text is the second sequence, as the measure is not symmetric; of equal names the last label
        def one(x: str | None, labels, names) -> str | None:
            if x is None or labels is None:
                return None
            matcher = difflib.SequenceMatcher()
            matcher.set_seq2(x)
            best: tuple[float, str, str] | None = None
            for name, label in dict(zip(names, labels)).items():
                matcher.set_seq1(name)
                best = max(best or (-1.0, "", ""), (matcher.ratio(), name, label))
            return best[2] if best else None

        return pd.Series([one(*x) for x in zip(texts, own, normal)], dtype=object)

    raw = F.trim(F.coalesce(text, F.lit("")))
    normal = F.coalesce(normalize_label(raw), F.lit(""))
    pairs = F.transform(labels, lambda x: F.struct(normalize_label(x).alias("n"), x.alias("x")))
    last = lambda n: F.try_element_at(F.filter(pairs, lambda p: p["n"] == n), F.lit(-1))["x"]
    inside = F.filter(pairs, lambda p: (p["n"] != "") & normal.contains(p["n"]))
    longest = F.try_element_at(F.filter(inside, lambda p: F.length(p["n"]) == F.array_max(F.transform(inside, lambda q: F.length(q["n"])))), F.lit(1))["n"]
    found = F.coalesce(F.when(F.array_contains(F.transform(pairs, lambda p: p["n"]), normal), normal), longest)
    # Python sees only what the first two rules leave
    asked = F.when(found.isNull(), normal)
    return F.coalesce(last(found), similar(asked, labels, F.transform(pairs, lambda p: p["n"])), raw)


#: Lead-ins of questions, and words whose capital is lowered (fixed values).
LEADS = "listen to|compare|based on|according to|in the segment|in this segment"
QUESTION_WORDS = "What|Which|How|Why|Who|Where|When"
_ATOM = r"(?:\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?|\d{1,4}(?:\.\d+)?)"
_SPAN = rf"({_ATOM})\s*(?:-|to|~|–|—)\s*({_ATOM})"


def question_core(question: Column) -> Column:
    """A question without a lead-in, a range of times at its start, and its question mark."""
    s = collapse(question)
    lead = rf"(?i)^(?:{LEADS}) "
    s = F.when(s.rlike(lead), F.regexp_replace(F.regexp_replace(s, lead, ""), r"^[ ,.\-]+|[ ,.\-]+$", "")).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"\?+$", ""))
    return F.trim(F.regexp_replace(s, rf"^\s*{_ATOM}\s*(?:-|to|~|–|—)\s*{_ATOM}\s*[,.:;\-]?\s*", ""))


def rephrased(question: Column) -> Column:
    """struct<text, kind>: a question in the wording of evaluations, by the ranges of times it names or its lead-in.

    kind: empty, compare_multi_range, listen_single_range, according_no_range, based_no_range, generic_eval_style.
    """
    raw = collapse(F.coalesce(question, F.lit("")))
    core = question_core(raw)
    lowered = F.when(core.rlike(f"^(?:{QUESTION_WORDS}) "), F.concat(F.lower(F.substring(core, 1, 1)), F.substr(core, F.lit(2)))).otherwise(core)
    a, b = (F.regexp_extract_all(raw, F.lit(_SPAN), F.lit(i)) for i in (1, 2))
    span = lambda i: F.concat(F.lit("["), F.get(a, F.lit(i)), F.lit(", "), F.get(b, F.lit(i)), F.lit("]"))

    def asked(*parts: Column) -> Column:
        s = F.trim(F.concat(*parts))
        return F.when(s.endswith("?"), s).otherwise(F.concat(s, F.lit("?")))

    several = asked(F.lit("Compare the audio evidence between "), span(0), F.lit(" and "), span(1), F.lit(". "), core)
    single = asked(F.lit("Listen to the segment "), span(0), F.lit(". "), core)
    according, based = (asked(F.lit(f"{x} the conversation, "), lowered) for x in ("According to", "Based on"))
    low = F.lower(raw)
    kind = F.when(raw == "", "empty").when(F.size(a) >= 2, "compare_multi_range").when(F.size(a) == 1, "listen_single_range").when(low.startswith("according to"), "according_no_range").when(low.startswith("based on"), "based_no_range").otherwise("generic_eval_style")
    text = F.when(raw == "", raw).when(F.size(a) >= 2, several).when(F.size(a) == 1, single).when(low.startswith("according to"), according).otherwise(based)
    return F.struct(text.alias("text"), kind.alias("kind"))


def range_pairs(question: Column) -> Column:
    """array<struct<a, b>> of the ranges that rephrased sees, as text."""
    return F.arrays_zip(*(F.regexp_extract_all(question, F.lit(_SPAN), F.lit(i)).alias(c) for i, c in ((1, "a"), (2, "b"))))
