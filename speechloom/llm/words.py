"""Comparable words of whole texts: canonical characters, lower case, no punctuation."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from speechloom.llm.lookalikes import CYRILLIC_LETTER, LATIN_LETTER, PLAIN, Lattice, canonical_text

_odd, _latin, _cyrillic = (re.compile(x).search for x in (f"[^{PLAIN}\\n]", LATIN_LETTER, CYRILLIC_LETTER))


def is_consistent(text: str) -> bool:
    """Whether each line of a text is surely in its canonical form: a line break alone is no irregular character here."""
    return not _odd(text) and (text.isascii() or not (_cyrillic(text) and _latin(text)))


def plain_words(texts: list[str | None], lattice: Lattice, join_apostrophes: bool = True, part_dense: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the offsets of each text's words.

    An apostrophe joins the letters around it, or parts them like any character that is no letter, mark or digit. With part_dense each letter of scripts written without spaces is a word.
    """
    clean = pa.array([(x if is_consistent(x) else canonical_text(x, lattice)) if x else "" for x in texts], pa.large_string())
    clean = pc.utf8_lower(clean)
    if join_apostrophes:
        clean = pc.replace_substring_regex(clean, r"['’`´]", "")
    if part_dense:
        clean = pc.replace_substring_regex(clean, r"([\x{3041}-\x{30FF}\x{3400}-\x{9FFF}])", r" \1 ")
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(clean, r"[^\p{L}\p{M}\p{N}]+", " "))
    lists = pc.split_pattern(clean, " ")
    size = np.asarray(pc.list_value_length(lists), np.int64)
    flat = lists.flatten()
    blank = np.asarray(pc.equal(clean, ""), bool)
    if blank.any():  # an empty text splits into one empty word
        flat = flat.filter(pc.not_equal(flat, ""))
        size = np.where(blank, 0, size)
    return flat, np.r_[0, np.cumsum(size)]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each word, computed once for each distinct one."""
    coded = words.dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist(), dtype=object)
    if not len(distinct):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(distinct, categorize=False)[np.asarray(coded.indices)]
