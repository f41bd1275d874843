"""Session ids, paths and keys, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom.functions.text import stem

#: Accents of English that are folders of their own, and folders named by language and country (fixed values).
ENGLISH = ["American", "Australian", "British", "Filipino", "Indian"]
COUNTRIES = {"French(Canada)": "French_Canada", "Portuguese(Brazil)": "Portuguese_Brazil", "Spanish(Mexico)": "Spanish_Mexico"}
AUDIO_SUFFIXES = ["wav", "flac", "mp3", "m4a", "ogg"]


def session_id(raw: Column) -> Column:
    """A session id with slashes and brackets as underscores, which do not repeat or stand at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[/()]", "_"), "_{2,}", "_"), "^_+|_+$", "")


def session_of_path(path: Column) -> Column:
    """The session id that an audio path stands for: its folder below the last `data` folder, and its stem.

    English accents have a folder of their own below English; folders named by language and country lose their
    brackets; another folder becomes a session id. A file without a folder is its own stem.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    after = F.size(parts) - F.array_position(F.reverse(parts), F.lit("data")).cast("int") + 1
    below = F.slice(parts, after + 1, F.greatest(F.size(parts) - after - 1, F.lit(0)))
    chosen = F.when(F.array_contains(parts, "data") & (F.size(below) > 0), below).otherwise(folders)
    last, before = F.try_element_at(chosen, F.lit(-1)), F.try_element_at(chosen, F.lit(-2))
    countries = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    lead = F.when((before == "English") & last.isin(ENGLISH), F.concat(F.lit("English_"), last)).otherwise(F.coalesce(F.try_element_at(countries, last), session_id(last)))
    return F.when(last.isNull(), stem(path)).otherwise(F.concat(lead, F.lit("_"), stem(path)))


def paths_of_session(session: Column) -> Column:
    """The relative audio paths that a session id may stand for, the likeliest first; none without a folder and a stem."""
    sid = session_id(session)
    parts = F.split(sid, "_")
    pair = F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    english = pair.isin([f"English_{x}" for x in ENGLISH])
    country = pair.isin(list(COUNTRIES.values()))
    lead = F.when(english | country, F.lit(2)).otherwise(F.lit(1))
    name = F.concat(F.array_join(F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead, F.lit(0))), "_"), F.lit(".wav"))
    bracketed = F.regexp_replace(pair, "^([^_]+)_(.+)$", "$1($2)")
    file = lambda folder: F.concat(folder, F.lit("/"), name)
    found = F.when(english, F.array(file(F.replace(pair, F.lit("_"), F.lit("/"))))).when(country, F.array(file(bracketed), file(pair))).otherwise(F.array(file(F.get(parts, F.lit(0)))))
    return F.when(F.size(parts) > lead, found).otherwise(F.array().cast("array<string>"))


def accent_and_stem(path: Column) -> Column:
    """`folder_stem` of a path in either slash; the stem alone without a folder."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return F.when(folder != "", F.concat(folder, F.lit("_"), name)).otherwise(name)


def language_of_utterance(utt_id: Column, sep: str = "__") -> Column:
    """The part of an utterance id before its first separator."""
    return F.split(utt_id, sep)[0]


def audio_candidates(raw: Column, root: str | Column, prefix: str = "") -> Column:
    """Paths that a scp value may stand for: without pipe, `scp:` and a prefix; itself if absolute, below the root, and with .wav; null without any."""
    root = F.lit(root) if isinstance(root, str) else root
    p = F.trim(F.split(F.trim(raw), r"\|")[0])
    p = F.trim(F.regexp_replace(p, "^scp:", ""))
    p = F.when(p.startswith(prefix), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p) if prefix else p
    joined = F.when(p.startswith("/"), p).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), p))
    every = F.array_compact(F.array(joined, F.when(~p.endswith(".wav"), F.concat(joined, F.lit(".wav")))))
    return F.when(F.trim(raw) != "", every)


def resolved_candidates(raw: Column, root: str, marker: str) -> Column:
    """Paths that a record's audio path may stand for: itself if absolute; else below the root, there with `data` after the marker folder, and as it is."""
    below = F.concat(F.lit(root.rstrip("/") + "/"), raw)
    pattern = rf"(^|/){marker}/(?!data(?:/|$))"
    with_data = F.when(raw.rlike(pattern), F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(raw, pattern, f"$1{marker}/data/")))
    return F.when(raw.startswith("/"), F.array(raw)).otherwise(F.array_compact(F.array(below, with_data, raw)))


def canonical_key(settings: dict, n: int = 12) -> str:
    """The first characters of the sha1 of settings as JSON with sorted keys: names a cache by what made it."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:n]
