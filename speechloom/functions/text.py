"""String functions of speech and question data, as column expressions.

Letters and digits of any script are \\p{L} and \\p{N}: combining marks are not word characters here.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"\p{L}\p{N}_"
#: Scripts spaced by character before scoring (fixed values): CJK, kana, Hangul, Thai.
SPACED = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0E00}-\x{0E7F}"
#: Serbian letters of two characters, then of one (fixed values).
SERBIAN_PAIRS = {"dž": "џ", "lj": "љ", "nj": "њ"}
SERBIAN_FROM, SERBIAN_TO = "abvgdđežzijklmnoprstćufhcčš", "абвгдђежзијклмнопрстћуфхцчш"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value); however often body names the value, it stands in the plan and is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def rewritten(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """A text with each match of a pattern replaced by a function of it: parted, changed and joined on the JVM side."""
    def joined(t: Column) -> Column:
        parts, found = F.split(t, pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        before = F.concat(F.array(F.lit(None).cast("string")), found)
        return F.array_join(F.zip_with(parts, before, lambda p, m: F.concat(F.when(m.isNotNull(), change(m)).otherwise(F.lit("")), p)), "")

    return bound(text, joined)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_label(text: Column) -> Column:
    """Lower case; characters other than word characters, white space and hyphens become spaces; spaces collapse."""
    return collapse(F.regexp_replace(F.lower(F.trim(text)), rf"[^{WORD}\s-]", " "))


def normalize_choice(text: Column) -> Column:
    return F.upper(F.trim(text))


def normalize_token(text: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(text, "_", " ")))


def sanitize_id(text: Column) -> Column:
    """Characters that ids must not have become underscores, which do not repeat or stand at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), "_+", "_"), "^_+|_+$", "")


def language_label(base: Column, dialect: Column) -> Column:
    """`base (dialect)`, or the base alone."""
    b, d = normalize_token(base), normalize_token(dialect)
    return F.when(F.coalesce(d, F.lit("")) == "", b).otherwise(F.concat(b, F.lit(" ("), d, F.lit(")")))


def language_of_path(path: Column) -> Column:
    """The folder that holds the file, up to its first underscore, in lower case."""
    return F.lower(F.regexp_extract(path, r"([^/_]+)[^/]*/[^/]+$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def last_parts(text: Column, n: int, sep: str = "_") -> Column:
    """The last n parts of an id."""
    parts = F.split(text, sep)
    return F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(n)), F.least(F.size(parts), F.lit(n))), sep)


def label_or_null(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def stable_hash(payload: Column) -> Column:
    return F.substring(F.sha1(payload), 1, 12)


def letters(text: Column) -> Column:
    """Number of letters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")).cast("bigint")


def is_translatable(text: Column) -> Column:
    return letters(text) >= 4


def space_characters(text: Column) -> Column:
    """A space on both sides of each character of scripts written without spaces."""
    return collapse(F.regexp_replace(text, f"([{SPACED}])", " $1 "))


#: Languages scored by character (fixed values).
BY_CHARACTER = ["ja", "ko", "th", "zh", "zh-cn", "zh-tw", "yue"]
#: Names of languages and their codes (fixed values).
LANGUAGE_CODES = {
    "english": "en", "french": "fr", "french(canada)": "fr", "german": "de", "italian": "it", "japanese": "ja", "korean": "ko",
    "portuguese": "pt", "portuguese(brazil)": "pt", "russian": "ru", "spanish": "es", "spanish(mexico)": "es", "tagalog": "tl",
    "thai": "th", "turkish": "tr", "urdu": "ur", "vietnamese": "vi",
}
_B = rf"(?<![{WORD}])(?=[{WORD}])"
_E = rf"(?<=[{WORD}])(?![{WORD}])"


def language_code(name: Column) -> Column:
    """The code of a language's name; another name is its own code, in lower case."""
    low = F.lower(F.trim(name))
    codes = F.create_map(*(F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(codes, low), low)


@F.pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Letters without their accents; there is no built-in decomposition."""
    import unicodedata

    return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def for_scoring(text: Column, language: Column | None = None, lower: bool = True, accents: bool = True, zeros: bool = False, punctuation: bool = False, number_words: bool = False) -> Column:
    """The form that word errors are counted on, of the language's name or code; null counts as empty.

    Lower case; without accents if they are not kept; a 0 between two single characters as o; punctuation to
    spaces; languages of BY_CHARACTER by character, digits too; whole numbers in English words where wanted.
    """
    out = F.coalesce(text, F.lit(""))
    out = F.lower(out) if lower else out
    out = out if accents else strip_accents(out)
    if zeros:
        out = F.regexp_replace(out, rf"(?<={_B}[{WORD}])0(?=[{WORD}]{_E})", "o")
    if not punctuation:
        out = F.regexp_replace(out, rf"[^{WORD}\s]", " ")
    if language is not None:
        single = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", ""), "(.)", "$1 "))
        out = F.when(F.coalesce(language_code(language), F.lit("")).isin(BY_CHARACTER), single).otherwise(out)
    if number_words:
        out = rewritten(out, rf"{_B}\p{{Nd}}+{_E}", lambda m: F.coalesce(in_words(m.try_cast("bigint")), m))
    return collapse(out)


#: Latin letters of words between which a lone 0 stands (fixed values).
_LATIN = r"A-Za-zÀ-ÖØ-öø-ÿ"


def for_scoring_spoken(text: Column, language: Column | None = None, zeros: bool = True) -> Column:
    """Another form for scoring: a lone 0 and the words around it become ` o `, underscores are spaces, and languages of BY_CHARACTER keep runs of other scripts whole.

    The words beside the 0 are dropped with it, as the original does.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    if zeros:
        out = F.regexp_replace(out, rf"{_B}[{_LATIN}]+\s+0\s+[{_LATIN}]+{_E}", " o ")
    out = F.replace(F.regexp_replace(out, rf"[^{WORD}\s]", " "), F.lit("_"), F.lit(" "))
    if language is not None:
        spaced = F.regexp_replace(out, r"([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0E00}-\x{0E7F}])", " $1 ")
        out = F.when(F.coalesce(language_code(language), F.lit("")).isin(BY_CHARACTER), spaced).otherwise(out)
    return collapse(out)


#: English number words (fixed values).
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def in_words(n: Column) -> Column:
    """English words of 0 to 999,999,999; null beyond."""
    ones, tens = (F.array(*(F.lit(w) for w in words)) for words in (ONES, TENS))
    place = lambda words, i: F.get(words, i.cast("int"))

    def below_hundred(x: Column) -> Column:
        return F.when(x < 20, place(ones, x)).otherwise(F.concat(place(tens, F.floor(x / 10) - 2), F.when(x % 10 > 0, F.concat(F.lit("-"), place(ones, x % 10))).otherwise(F.lit(""))))

    def below_thousand(x: Column) -> Column:
        rest = F.when(x % 100 > 0, F.concat(F.lit(" and "), below_hundred(x % 100))).otherwise(F.lit(""))
        return F.when(x < 100, below_hundred(x)).otherwise(F.concat(place(ones, F.floor(x / 100)), F.lit(" hundred"), rest))

    parts = [(F.floor(n / 1_000_000), " million"), (F.floor(n / 1000) % 1000, " thousand")]
    high = F.concat_ws(", ", *(F.when(x > 0, F.concat(below_thousand(x), F.lit(name))) for x, name in parts))
    low = n % 1000
    joint = F.when(low < 100, F.lit(" and ")).otherwise(F.lit(", "))
    whole = F.when(n < 1000, below_thousand(n)).when(low == 0, high).otherwise(F.concat(high, joint, below_thousand(low)))
    return F.when(n.between(0, 999_999_999), whole)


def serbian_cyrillic(text: Column) -> Column:
    out = F.lower(text)
    for pair, letter in SERBIAN_PAIRS.items():
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return F.translate(out, SERBIAN_FROM, SERBIAN_TO)


def single_runs_collapsed(text: Column) -> Column:
    """A word said three times or more in a row is kept once."""
    return F.regexp_replace(text, rf"(?i)(?<![{WORD}])([{WORD}]+)(\s+\1){{2,}}(?![{WORD}])", "$1")


def first_option_letter(text: Column) -> Column:
    """The first character that is one of A to D, in upper case only; else a question mark."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "([ABCD])", 1), F.lit("")), F.lit("?"))


def pick_option(text: Column, labels: Column) -> Column:
    """The label an answer names, by the first rule that gives one: the whole answer, its normalised form, its
    first word that is a label, the first one-letter label that it contains. Null if none does.
    """
    upper = F.upper(F.trim(text))
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)")), F.upper)
    normal = F.upper(normalize_label(text))
    return F.coalesce(
        F.when(F.array_contains(labels, upper), upper),
        F.when(F.array_contains(labels, normal), normal),
        F.try_element_at(F.filter(words, lambda w: F.array_contains(labels, w)), F.lit(1)),
        F.try_element_at(F.filter(labels, lambda x: (F.length(x) == 1) & F.upper(text).contains(x)), F.lit(1)),
    )


def resolve_gold(labels: Column, texts: Column, answer: Column) -> Column:
    """The label that an answer denotes: itself, or the first whose text is equal once normalised; else null."""
    given = normalize_choice(answer)
    same = F.filter(F.arrays_zip(labels.alias("l"), texts.alias("t")), lambda p: normalize_label(p["t"]) == normalize_label(answer))
    return F.coalesce(F.when(F.array_contains(labels, given), given), F.try_element_at(F.transform(same, lambda p: p["l"]), F.lit(1)))


def prompt(question: Column, labels: Column, texts: Column, lead: str = "") -> Column:
    """A prompt with an option a line."""
    options = F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), F.coalesce(b, F.lit(""))))
    return F.concat(F.lit(lead), F.lit("Pick one label from "), F.array_join(labels, ", "), F.lit(".\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n\n"), F.array_join(options, "\n"))


def mask(text: Column, pattern: str, left: str, right: str) -> tuple[Column, Column]:
    """The text with its k-th match replaced by left + k + right, and the matches, k from 0."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"))
    parts = F.split(text, pattern)
    pieces = F.transform(F.arrays_zip(parts.alias("p"), F.sequence(F.lit(0), F.size(parts) - 1).alias("i")), lambda x: F.when(x["i"] == 0, x["p"]).otherwise(F.concat(F.lit(left), (x["i"] - 1).cast("string"), F.lit(right), x["p"])))
    return F.array_join(pieces, ""), found


def unmask(text: Column, found: Column, left: str, right: str) -> Column:
    """The inverse of mask: higher numbers first, so that 1 does not match inside 10."""
    order = F.reverse(F.arrays_zip(found.alias("m"), F.sequence(F.lit(0), F.size(found) - 1).alias("i")))
    whole = F.aggregate(order, text, lambda acc, x: F.replace(acc, F.concat(F.lit(left), x["i"].cast("string"), F.lit(right)), x["m"]))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def quoted_runs(text: Column) -> Column:
    """The text as an array of runs, quoted ones apart."""
    return F.regexp_extract_all(text, F.lit(r"(\"[^\"]*\"|«[^»]*»|“[^”]*”|[^\"«“]+|[\"«“])"))


def cut_loop(text: str | None, n: int = 5, window: int = 150, step: int = 50, most: int = 5) -> str | None:
    """The text cut before the second occurrence of an n-gram that a window holds more than `most` times.

    Windows of `window` words start every `step` words while a whole one is left (at 0 for short texts); the
    last n-gram of a window is not counted; among equals the first seen is taken. Texts of n words or fewer
    and those without such an n-gram stay as they are.
    """
    words = (text or "").split()
    if len(words) <= n:
        return text
    grams = list(zip(*(words[i:] for i in range(n))))
    for start in range(0, max(1, len(words) - window + 1), step):
        counts: dict[tuple, int] = {}
        for g in grams[start : max(start, min(start + window, len(words)) - n)]:
            counts[g] = counts.get(g, 0) + 1
        best = max(counts, key=counts.__getitem__, default=None)
        if best is not None and counts[best] > most:
            second = grams.index(best, grams.index(best) + 1)
            return " ".join(words[:second])
    return text


def repeated_ngram_cut(text: Column, n: int = 5, window: int = 150, step: int = 50, most: int = 5) -> Column:
    """cut_loop over a column: counting n-grams by window has no built-in form of linear cost."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_loop(x, n, window, step, most) for x in texts], dtype=object)

    return cut(text)


def merge_overlap(a: Column, b: Column, most: int) -> Column:
    """Two texts joined on the longest run of at most `most` words that ends the first and begins the second."""
    x, y = F.split(F.trim(a), r"\s+"), F.split(F.trim(b), r"\s+")
    longest = F.least(F.size(x), F.size(y), F.lit(most))
    fits = F.filter(F.sequence(F.lit(0), longest), lambda k: (k == 0) | (F.slice(x, -F.greatest(k, F.lit(1)), k) == F.slice(y, F.lit(1), k)))
    k = F.array_max(fits)
    rest = F.slice(y, k + 1, F.greatest(F.size(y) - k, F.lit(0)))
    return F.trim(F.concat_ws(" ", F.array_join(x, " "), F.array_join(rest, " ")))
