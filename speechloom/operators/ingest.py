"""From nested question records to samples: one row for each question that can be asked, with its gold label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions import ids
from speechloom.functions.text import prompt, resolve_gold, stem
from speechloom.operators import nested
from speechloom.operators.joins import with_fallback
from speechloom.operators.mcq import first_place_last_text
from speechloom.operators.sampling import hash_key

#: Attributes that a question without them takes from its record (fixed names).
INHERITED = ["task_name", "language", "difficulty", "category", "subtype", "sub-category", "sub-sub-category", "linguistics_sub_discipline"]
OPTIONS = "array<struct<label:string,text:string>>"


def neutral_labels(options: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Two options as 1 and 2: the options, the gold, and the map back to their own labels; others stay, with a null map."""
    two = F.size(options) == 2
    named = F.transform(options, lambda o, i: F.struct((i + 1).cast("string").alias("label"), o["text"].alias("text")))
    place = F.array_position(F.transform(options, lambda o: o["label"]), gold)
    back = F.map_from_entries(F.transform(options, lambda o, i: F.struct((i + 1).cast("string"), o["label"])))
    return F.when(two, named).otherwise(options), F.when(two & (place > 0), place.cast("string")).otherwise(gold), F.when(two, back)


def reversed_map(m: Column) -> Column:
    """Values to keys; of equal values the last key."""
    entries = F.map_entries(m)
    values = F.array_distinct(F.map_values(m))
    return F.map_from_entries(F.transform(values, lambda v: F.struct(v, F.element_at(F.filter(entries, lambda e: e["value"] == v), -1)["key"])))


def question_rows(nodes: DataFrame, most_per_audio: int = 0) -> DataFrame:
    """(line_no, question_idx, raw_path, session, question_id, question, options, answer, sample_weight, attributes) of grouped and flat records.

    Options are in order, by normalised label, blank ones dropped and the last text of a label kept. Attributes
    that a question lacks come from its record. With most_per_audio only the first questions of each record
    (a feature of the loader). sample_weight is 1.0 unless the question or the record has one.
    """
    f = F.col("fields")
    given = F.map_from_arrays(F.array(*(F.lit(c) for c in INHERITED)), F.array(*(f[c] for c in INHERITED)))
    records = nested.record_nodes(nodes).select("doc", F.col("node").alias("record_node"), F.coalesce(F.nullif(F.trim(f["path"]), F.lit("")), F.nullif(F.trim(f["audio_path"]), F.lit(""))).alias("raw_path"), f["session_id"].alias("session"), f["sample_weight"].try_cast("double").alias("own_weight"), given.alias("own"))
    record = F.when(F.col("schema_path").startswith("$.item"), F.array_join(F.slice(F.split("node", r"\."), 1, 2), ".")).otherwise("0")
    asked = nested.question_nodes(nodes).select("doc", record.alias("record_node"), F.col("node").alias("question_node"), "question_idx", f["question_id"].alias("question_id"), F.coalesce(f["question_stem"], F.lit("")).alias("question"), F.coalesce(f["correct_answer"], F.lit("")).alias("answer"), f["sample_weight"].try_cast("double").alias("weight"), given.alias("attributes"))
    if most_per_audio > 0:
        asked = asked.where(F.col("question_idx") < most_per_audio)
    # a question's options lie together in its document, so the group is as large as the question
    options = nested.jsonl_options(nodes).groupBy("line_no", "question_node").agg(F.sort_array(F.collect_list(F.struct("position", "label", "text"))).alias("o"))
    listed = options.select(F.col("line_no").alias("doc"), "question_node", first_place_last_text(F.transform("o", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text")))).alias("options"))
    merged = F.map_from_arrays(F.array(*(F.lit(c) for c in INHERITED)), F.array(*(F.coalesce(F.col("attributes")[c], F.col("own")[c]) for c in INHERITED)))
    rows = asked.join(records, ["doc", "record_node"]).join(listed, ["doc", "question_node"], "left")
    return rows.select(F.col("doc").alias("line_no"), "question_idx", "raw_path", "session", "question_id", "question", F.coalesce("options", F.array().cast(OPTIONS)).alias("options"), "answer", F.coalesce("weight", "own_weight", F.lit(1.0)).alias("sample_weight"), merged.alias("attributes"))


def samples(nodes: DataFrame, most_per_audio: int = 0, most_samples: int = 0, seed: int = 0, files: DataFrame | None = None) -> DataFrame:
    """(sample_id, audio_path, question, prompt_text, options, gold_choice, sample_weight, attributes, line_no, question_id).

    Of records with a path, the questions with two options or more whose gold denotes one of them; the id is
    `jsonl:line:question`, by index for a question without an id. With files (audio_path), only samples whose
    audio is among them. With most_samples, that many in hash order: a seeded draw that every engine repeats.
    """
    rows = question_rows(nodes, most_per_audio).where("raw_path is not null")
    labels = F.transform("options", lambda o: o["label"])
    texts = F.transform("options", lambda o: o["text"])
    name = F.coalesce(F.nullif(F.nullif("question_id", F.lit("")), F.lit("0")), F.col("question_idx").cast("string"))
    made = rows.where(F.size("options") >= 2).withColumn("gold_choice", resolve_gold(labels, texts, F.col("answer"))).where("gold_choice is not null")
    out = made.select(F.concat_ws(":", F.lit("jsonl"), "line_no", name).alias("sample_id"), F.col("raw_path").alias("audio_path"), "question", prompt(F.col("question"), labels, texts).alias("prompt_text"), "options", "gold_choice", "sample_weight", "attributes", "line_no", name.alias("question_id"))
    if files is not None:
        out = out.join(files.select("audio_path").distinct(), "audio_path", "left_semi")
    return out.orderBy(hash_key(F.col("sample_id"), seed), "sample_id").limit(most_samples) if most_samples > 0 else out


def evaluation_rows(nodes: DataFrame, index: DataFrame, neutral: bool = False) -> DataFrame:
    """Samples of grouped and flat records for evaluation, with the audio of those that name only a session.

    index: (session, path) of the audio files. The path is the record's own; else the file of that session; else
    the only file of the session's stem (its last three parts); else the first of its likely relative paths that is
    a file; else the likeliest. With neutral, questions of two options are asked with 1 and 2.
    (line_no, question_idx, question_id, question, options, gold_choice, to_label, audio_path); gold_choice may be null.
    """
    rows = question_rows(nodes).where(F.size("options") >= 2)
    sid = F.nullif(ids.session_id(F.col("session")), F.lit(""))
    parts = F.split(sid, "_")
    short = F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(3)), F.lit(3)), "_")
    rel = ids.paths_of_session(F.col("session"))
    files = index.select("session", "path", stem(F.col("path")).alias("stem"))
    found = with_fallback(rows.where("raw_path is null"), [(files, "session", sid), (files, "stem", short), (files, "path", F.get(rel, F.lit(0))), (files, "path", F.get(rel, F.lit(1)))], "path")
    guessed = found.withColumn("audio_path", F.coalesce("path", F.get(rel, F.lit(0)))).drop("path")
    every = rows.where("raw_path is not null").withColumn("audio_path", F.col("raw_path")).unionByName(guessed)
    labels, texts = F.transform("options", lambda o: o["label"]), F.transform("options", lambda o: o["text"])
    gold = resolve_gold(labels, texts, F.col("answer"))
    options, choice, back = neutral_labels(F.col("options"), F.col("gold"))
    asked = every.withColumn("gold", gold)
    if neutral:
        asked = asked.withColumns({"to_label": back, "shown": options, "gold": choice}).withColumn("options", F.col("shown"))
    else:
        asked = asked.withColumn("to_label", F.lit(None).cast("map<string,string>"))
    return asked.select("line_no", "question_idx", "question_id", "question", "options", F.col("gold").alias("gold_choice"), "to_label", "audio_path")


def audio_index(files: DataFrame, path: str) -> DataFrame:
    """(session, path): the first file, in order, of each session that an audio path stands for."""
    known = files.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(ids.AUDIO_SUFFIXES))
    return known.groupBy(ids.session_id(ids.session_of_path(F.col(path))).alias("session")).agg(F.min(path).alias("path"))


def gold_by_session(nodes: DataFrame) -> DataFrame:
    """(session, question_id, gold): the first letter of each answer, by the session of the record's path; the last of repeated keys."""
    rows = question_rows(nodes).where("answer != '' and question_id is not null and question_id != ''")
    keyed = rows.select(ids.accent_and_stem(F.coalesce("raw_path", F.lit(""))).alias("session"), "question_id", F.upper(F.substring(F.trim("answer"), 1, 1)).alias("gold"), "line_no", "question_idx")
    return keyed.groupBy("session", "question_id").agg(F.max_by("gold", F.struct("line_no", "question_idx")).alias("gold"))


def with_gold(rows: DataFrame, golds: DataFrame, labels: list[str], gold: str = "gold_choice") -> DataFrame:
    """rows (session, question_id, gold) whose gold is one of the labels, or else that of (session, question_id) in golds; rows without either drop."""
    joined = rows.join(golds.select("session", "question_id", F.col("gold").alias("_other")), ["session", "question_id"], "left")
    own = F.when(F.col(gold).isin(labels), F.col(gold)).otherwise(F.col("_other"))
    return joined.withColumn(gold, own).where(F.col(gold).isin(labels)).drop("_other")
