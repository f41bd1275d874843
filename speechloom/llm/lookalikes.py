"""One consistent character form for texts that look the same.

Compatibility normalisation, deletion of ignorable characters, one kind of space, and a Viterbi search of the
lattice of look-alike letters: each letter may stand for its counterpart in another script, and the path keeps
the script within words (and, more weakly, across them) under script-consistent character bigram scores of the
corpus. Only texts with a character outside the plain set, or with letters of two of the three alphabets that
share shapes, reach Python; a pattern on the JVM side passes the others through unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that look the same (fixed values): Latin, Cyrillic, Greek; "-" for none.
SAME = """a а - | c с - | e е - | i і ι | j ј - | o о ο | p р ρ | s ѕ - | v - ν | x х χ | y у - |
A А Α | B В Β | C С - | E Е Ε | H Н Η | I І Ι | J Ј - | K К Κ | M М Μ | N - Ν | O О Ο | P Р Ρ | S Ѕ - | T Т Τ | X Х Χ | Y У Υ | Z - Ζ"""
#: Latin letters of other notations that look like a plain one (fixed values).
LATIN_FORMS = {"ɑ": "a", "Ɑ": "A", "ɡ": "g", "ı": "i", "ʏ": "y"}
#: Characters without a shape of their own besides the format category (fixed values).
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
#: The plain characters, as a class for Java and Python patterns alike: no form of them needs a change.
PLAIN = "\\u0020-\\u007E\\u00A1-\\u00A7\\u00A9\\u00AB\\u00AC\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0130\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0401\\u0410-\\u044F\\u0451\\u3001\\u3002\\u300C-\\u300F\\u3041-\\u3096\\u30A1-\\u30FA\\u30FC\\u4E00-\\u9FFF\\uAC00-\\uD7A3"
LATIN, CYRILLIC = "A-Za-z\\u00C0-\\u024F", "\\u0400-\\u04FF"
ODD, LATIN_LETTER, CYRILLIC_LETTER = f"[^{PLAIN}]", f"[{LATIN}]", f"[{CYRILLIC}]"

SCRIPTS = 3
#: Codepoints below this hold all letters of the three alphabets.
TOP = 0x530
CHANGE, SWITCH_WORD, SWITCH_LETTER = 1.0, 2.5, 14.0
NEVER = -1e9


def script(letter: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Greek, -1 another."""
    c = ord(letter)
    if c < 0x250 or 0x1E00 <= c < 0x1F00 or c in (0x251, 0x261, 0x28F, 0x2C6D):
        return 0
    if 0x400 <= c < 0x530:
        return 1
    return 2 if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else -1


def _counterparts() -> dict[str, list[str | None]]:
    out: dict[str, list[str | None]] = {}
    for row in SAME.split("|"):
        forms = [None if x == "-" else x for x in row.split()]
        for x in forms:
            if x:
                out[x] = forms
    for odd, usual in LATIN_FORMS.items():
        out[odd] = list(out.get(usual, [usual, None, None]))
    return out


COUNTERPARTS = _counterparts()


def forms(text: str) -> str:
    """Compatibility and composed forms, ignorable characters deleted, U+0020 as the only space."""
    text = "".join(" " if x.isspace() else x for x in text if x.isspace() or not (unicodedata.category(x) == "Cf" or x in IGNORABLE or 0xFE00 <= ord(x) <= 0xFE0F))
    text = unicodedata.normalize("NFKC", text)
    return text if text.isascii() else "".join(" " if x.isspace() else x for x in text if unicodedata.category(x) != "Cf")


class Lattice:
    """Best path through the look-alike letters of a text."""

    def __init__(self, bigrams: dict[tuple[int, int], int] | None = None):
        """bigrams: corpus counts of lower-case letter pairs by codepoint, 32 for a word boundary."""
        self.score = {}
        if bigrams:
            total: dict[int, int] = {}
            for (a, _), n in bigrams.items():
                total[a] = total.get(a, 0) + n
            self.score = {(chr(a), chr(b)): float(np.log((n + 0.1) / (total[a] + 100))) for (a, b), n in bigrams.items()}
        self.least = -11.0 if bigrams else 0.0

    def path(self, text: str) -> str:
        best, back = [0.0, 0.0, 0.0], []
        inside = False
        last = [" "] * SCRIPTS
        for x in text:
            s = script(x) if x.isalpha() else -1
            if s < 0:
                # another letter or none: scripts go on, the word ends at what is no letter
                if not x.isalpha():
                    inside = False
                    last = [" "] * SCRIPTS
                continue
            options = COUNTERPARTS.get(x)
            cost = SWITCH_LETTER if inside else SWITCH_WORD
            now, come, shown = [NEVER] * SCRIPTS, [0] * SCRIPTS, [" "] * SCRIPTS
            for t in range(SCRIPTS):
                y = x if t == s and x not in LATIN_FORMS else options[t] if options else None
                if y is None:
                    continue
                shown[t] = low = y.lower()
                for f in range(SCRIPTS):
                    value = best[f] - (cost if f != t else 0.0)
                    if value > now[t]:
                        now[t], come[t] = value, f
                prior = last[come[t]] if come[t] == t else " "
                now[t] += self.score.get((prior, low), self.least) * 0.3 - (CHANGE if y != x else 0.0)
            best = now
            back.append((come, x, options))
            last, inside = shown, True
        if not back:
            return text
        t = max(range(SCRIPTS), key=best.__getitem__)
        letters = []
        for come, x, options in reversed(back):
            letters.append(x if t == script(x) and x not in LATIN_FORMS else options[t])
            t = come[t]
        letters.reverse()
        at = iter(letters)
        return "".join(next(at) if x.isalpha() and script(x) >= 0 else x for x in text)

    def canonical(self, text: str) -> str:
        text = forms(text)
        found = {script(x) for x in text if x.isalpha()} - {-1}
        if len(found) > 1 or any(x in text for x in "ɑⱭɡıʏѕіјЅІЈ"):
            return self.path(text)
        return text


_odd, _latin, _cyrillic = (re.compile(x).search for x in (ODD, LATIN_LETTER, CYRILLIC_LETTER))


def canonical_text(text: str, lattice: Lattice) -> str:
    """The canonical form; plain texts return at once."""
    return lattice.canonical(text) if not text.isascii() and (_odd(text) or _cyrillic(text) and _latin(text)) or text.isascii() and _odd(text) else text


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of lower-case letter pairs within words of one script, over a partition."""
    lower = np.zeros(0x110000, np.int32)
    for c in range(TOP):
        x = chr(c)
        if x.isalpha() and script(x) >= 0 and len(x.lower()) == 1 and ord(x.lower()) < TOP:
            lower[c] = ord(x.lower())
    alphabet = np.array([script(chr(c)) if c and chr(c).isalpha() else -1 for c in range(TOP)])
    counts = np.zeros(TOP * TOP, np.int64)
    for b in batches:
        text = " ".join(x for x in b.column(0).to_pylist() if x)
        if not text:
            continue
        x = lower[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4")]
        x[x == 0] = 32
        a, c = x[:-1], x[1:]
        keep = (a == 32) | (c == 32) | (alphabet[a] == alphabet[c])
        counts += np.bincount(a[keep] * TOP + c[keep], minlength=TOP * TOP)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at // TOP, pa.int64()), pa.array(at % TOP, pa.int64()), pa.array(counts[at])], ["a", "b", "n"])


def letter_bigrams(*texts: DataFrame) -> dict[tuple[int, int], int]:
    """Letter pairs of whole text columns (one column each), counted within partitions first.

    At most TOP * TOP sums come to the driver, whatever the size of the corpus.
    """
    parts = [t.toDF("text").mapInArrow(_pairs, "a bigint, b bigint, n bigint") for t in texts]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return {(r.a, r.b): r.n for r in every.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def suspect(text: Column | str) -> Column:
    """Whether a text may differ from its canonical form: patterns of one character each, so one pass each."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return text.rlike(ODD) | (text.rlike(CYRILLIC_LETTER) & text.rlike(LATIN_LETTER))


def canonical_column(df: DataFrame, text: str, bigrams: dict | None = None, out: str = "canonical", only_changed: bool = False) -> DataFrame:
    """df with the canonical form of a text column; with only_changed, only the rows whose text changes.

    Null stays null, an empty text empty; repeated rows stay; an empty table gives none; texts are
    processed whole. Columns of df named as the text column or `out` are used or replaced, others kept.
    """
    lattice = Lattice(bigrams)

    @F.pandas_udf("string")
    def fix(texts):
        import pandas as pd

        return pd.Series([None if x is None else lattice.canonical(x) for x in texts], dtype=object)

    odd = suspect(text)
    if only_changed:
        return df.where(odd).withColumn(out, fix(text)).where(F.col(out) != F.col(text))
    plain = df.where(~odd).withColumn(out, F.col(text))
    return plain.unionByName(df.where(odd).withColumn(out, fix(text)))
