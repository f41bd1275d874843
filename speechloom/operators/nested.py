"""Nested JSON to flat tables by Dewey labels.

Every object and array of a document becomes a node. Its label is the path of ordinals from the root
("0" is the root, "0.2.1" the second child of the root's third child); cutting the last component gives
the parent's label, so child tables link to parent tables by (document, label) without a lookup. Nodes of
one schema path ("$.questions[].options[]") form a table. Scalar members stay with their node as a map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "doc {}, node string, schema_path string, kind string, key string, ordinal bigint, place bigint, within map<string,bigint>, fields map<string,string>, sizes map<string,bigint>"
_ARROW = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.int64()), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.int64())]
_NAMES = ["node", "schema_path", "kind", "key", "ordinal", "place", "within", "fields", "sizes"]
#: Containers whose key may hold its value as a JSON string.
EMBEDDED = ("questions", "sections", "options")


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value if value is None or value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return json.dumps(value, ensure_ascii=False)


def shred(text: str | None, embedded: tuple[str, ...] = EMBEDDED) -> list[tuple]:
    """The nodes of one document; none if it is null, blank or not readable as JSON."""
    if text is None or not text.strip():
        return []
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(root, (dict, list)):
        return []
    out: list[tuple] = []
    placed: dict[str, int] = {}  # elements of all arrays of a key so far, nulls included
    stack = [(root, "0", "$", "", 0, None, {})]
    while stack:
        value, label, path, key, ordinal, place, within = stack.pop()
        fields, sizes, below = [], [], []
        if isinstance(value, dict):
            kind, members = "object", list(value.items())
        else:
            kind, members = "array", [(str(i), x) for i, x in enumerate(value)]
            at = placed.get(key, 0)
            placed[key] = at + len(value)
        for i, (k, x) in enumerate(members):
            if not k.isascii():
                k = _text(k)
            if x.__class__ is str:
                if k not in embedded or x.lstrip()[:1] not in ("[", "{"):
                    fields.append((k, x if x.isascii() else _text(x)))
                    continue
                try:
                    x = json.loads(x)
                except (ValueError, RecursionError):
                    pass
            if x.__class__ is dict or x.__class__ is list:
                sizes.append((k, len(x)))
                if kind == "array":
                    below.append((x, f"{label}.{i}", f"{path}[]", key, i, at + i, within | {key: at + i}))
                else:
                    below.append((x, f"{label}.{i}", f"{path}.{k}", k, i, None, within))
            else:
                fields.append((k, _text(x)))
        out.append((label, path, kind, key, ordinal, place, list(within.items()), fields, sizes))
        stack.extend(reversed(below))
    return out


def json_nodes(df: DataFrame, doc: str, text: str, embedded: tuple[str, ...] = EMBEDDED) -> DataFrame:
    """One row for each object and array of each document, without a shuffle.

    Columns: doc; node and, by truncation, its parent; schema_path; kind (object or array); key, the name it
    or its array has; ordinal among its siblings; place, for array elements, among the elements of all arrays
    of that key in the document; within, that place of each enclosing element by key; fields, the scalar
    members as text; sizes, the number of members of the container members. Null, blank and unreadable
    documents give no rows; a repeated document gives its nodes again; an empty table none.
    """
    rows = df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def maps(column: list, kind: pa.DataType) -> pa.MapArray:
        ends = np.cumsum([0, *map(len, column)]).astype(np.int32)
        pairs = [p for c in column for p in c]
        keys, values = zip(*pairs) if pairs else ((), ())
        return pa.MapArray.from_arrays(pa.array(ends), pa.array(keys, pa.string()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, nodes = [], []
            for x in b.column(1).to_pylist():
                own = shred(x, embedded)
                nodes += own
                count.append(len(own))
            columns = list(zip(*nodes)) if nodes else [()] * len(_NAMES)
            made = [maps(c, t.item_type) if pa.types.is_map(t) else pa.array(c, t) for c, t in zip(columns, _ARROW)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), count))), *made], ["doc", *_NAMES])

    return rows.mapInArrow(run, NODE.format(kind)).withColumn("parent", parent("node"))


def unreadable(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, reason) of the documents that give no nodes: null, blank, too deep to read, or no JSON object or array."""
    rows = df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [problem(x) for x in b.column(1).to_pylist()]
            at = [i for i, x in enumerate(reasons) if x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([reasons[i] for i in at], pa.string())], ["doc", "reason"])

    return rows.mapInArrow(run, f"doc {kind}, reason string").withColumnRenamed("doc", doc)


def problem(text: str | None) -> str | None:
    """Why a document gives no nodes; None if it gives some."""
    if text is None or not text.strip():
        return "null" if text is None else "blank"
    try:
        return None if isinstance(json.loads(text), (dict, list)) else "no object or array"
    except RecursionError:
        return "too deep"
    except ValueError:
        return "no JSON"


def parent(label: Column | str, steps: int = 1) -> Column:
    """The label of an ancestor: null beyond the root."""
    parts = F.split(label, r"\.")
    return F.when(F.size(parts) > steps, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - steps, F.lit(1))), "."))


def schema_paths(nodes: DataFrame) -> DataFrame:
    """(schema_path, kind, nodes, documents, fields): a row for each table that the documents hold, with the names of its columns."""
    named = nodes.select("doc", "schema_path", "kind", F.map_keys("fields").alias("names"))
    # names are merged within partitions first, in number bounded by the schema
    counted = named.groupBy("schema_path", "kind", "doc").agg(F.count("*").alias("n")).groupBy("schema_path", "kind").agg(F.sum("n").alias("nodes"), F.count("*").alias("documents"))
    fields = named.where("kind = 'object'").select("schema_path", "kind", F.explode("names").alias("name")).distinct().groupBy("schema_path", "kind").agg(F.sort_array(F.collect_list("name")).alias("fields"))
    return counted.join(fields, ["schema_path", "kind"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def path_table(nodes: DataFrame, where: Column, fields: dict[str, list[str]], *keys: Column) -> DataFrame:
    """One flat table: the nodes of the chosen schema paths, with keys and the first named member of each field."""
    f = F.col("fields")
    return nodes.where(where).select(*keys, *(F.coalesce(*(f[n] for n in names)).alias(c) for c, names in fields.items()))


def _has(map_column: str, key: str) -> Column:
    return F.coalesce(F.map_contains_key(map_column, F.lit(key)), F.lit(False))


def _either(key: str) -> Column:
    return _has("fields", key) | _has("sizes", key)


def letter(position: Column) -> Column:
    """The label of an option by its position: A..Z, then AA, AB, ..."""
    one = lambda x: F.char(x + 65)
    return F.when(position < 26, one(position)).otherwise(F.concat(one(F.floor(position / 26) - 1), one(position % 26)))


def record_nodes(nodes: DataFrame) -> DataFrame:
    """The record of each document: its root, or the object in a delivery's `item`."""
    wrapped = (F.col("schema_path") == "$") & _has("sizes", "item") & ~_either("questions") & ~_either("question_stem")
    return nodes.where("kind = 'object'").where(((F.col("schema_path") == "$") & ~wrapped) | (F.col("schema_path") == "$.item"))


def is_question() -> Column:
    """Whether a node is a question: an element of any `questions`, a lone object there, or a flat record."""
    is_record = F.col("schema_path").isin("$", "$.item")
    flat = is_record & ~_either("questions") & ~_either("sections") & (_either("question_stem") | _either("options") | _either("correct_answer"))
    return (F.col("kind") == "object") & (flat | (F.col("key") == "questions"))


def question_nodes(nodes: DataFrame) -> DataFrame:
    """Question objects with question_idx."""
    return nodes.where(is_question()).withColumn("question_idx", F.coalesce("place", F.lit(0).cast("bigint")))


RECORD = {"path": ["path", "audio_path"], "session_id": ["session_id"], "language": ["language"], "category": ["category"]}
QUESTION = {c: [c] for c in ("question_id", "question_stem", "correct_answer", "difficulty")}


def jsonl_records(nodes: DataFrame) -> DataFrame:
    """(line_no, record_node, path, session_id, language, category)."""
    return path_table(record_nodes(nodes), F.lit(True), RECORD, F.col("doc").alias("line_no"), F.col("node").alias("record_node"))


def jsonl_questions(nodes: DataFrame) -> DataFrame:
    """(line_no, question_node, record_node, question_idx, question_id, question_stem, correct_answer, difficulty, n_options)."""
    record = F.when(F.col("schema_path").startswith("$.item"), F.array_join(F.slice(F.split("node", r"\."), 1, 2), ".")).otherwise("0")
    keys = [F.col("doc").alias("line_no"), F.col("node").alias("question_node"), record.alias("record_node"), F.col("question_idx"), F.coalesce(F.col("sizes")["options"], F.lit(0).cast("bigint")).alias("n_options")]
    return path_table(question_nodes(nodes), F.lit(True), QUESTION, *keys)


_OPTION = "array<struct<node:string,parent:string,position:bigint,label:string,text:string>>"


def _options_of(nodes: DataFrame) -> Column:
    """The options that a node holds: itself as an element of `options`, or the plain members of an `options` container; null for other nodes."""
    f, is_object = F.col("fields"), F.col("kind") == "object"
    element = F.col("place").isNotNull()
    given = F.upper(F.trim(F.when(is_object, f["label"]).otherwise(f["0"])))
    label = F.when(given != "", given).otherwise(letter(F.col("ordinal")))
    one = F.array(F.struct(F.col("node"), parent("node", 2).alias("parent"), F.col("ordinal").alias("position"), label.alias("label"), F.when(is_object, f["text"]).otherwise(f["1"]).alias("text")))

    def member(e: Column, at: Column) -> Column:
        position = F.when(is_object, at.cast("bigint")).otherwise(e["key"].try_cast("bigint"))
        named = F.upper(F.trim(e["key"]))
        return F.struct(F.concat_ws(".", "node", position).alias("node"), F.col("parent"), position.alias("position"), F.when(is_object & (named != ""), named).otherwise(letter(position)).alias("label"), e["value"].alias("text"))

    several = F.filter(F.transform(F.map_entries("fields"), member), lambda o: is_object | o["text"].isNotNull())
    return F.when(F.col("key") == "options", F.when(element, one.cast(_OPTION)).otherwise(several.cast(_OPTION)))


def _question_idx() -> Column:
    return F.coalesce(F.col("within")["questions"], F.lit(0).cast("bigint"))


def jsonl_options(nodes: DataFrame) -> DataFrame:
    """(line_no, option_node, question_node, question_idx, position, label, text) of options in any layout.

    An option is an object {label, text}, a pair [label, text], a plain text, or a member label: text.
    """
    each = nodes.where("key = 'options'").select(F.col("doc").alias("line_no"), _question_idx().alias("question_idx"), F.inline(_options_of(nodes)))
    return each.select("line_no", F.col("node").alias("option_node"), F.col("parent").alias("question_node"), "question_idx", "position", "label", "text")


def option_labels(nodes: DataFrame) -> DataFrame:
    """(line_no, question_idx, label): the distinct labels of each question, an empty one if it has no option.

    Questions and options come from one pass over the nodes.
    """
    labels = F.transform(_options_of(nodes), lambda o: F.struct(_question_idx().alias("question_idx"), o["label"].alias("label")))
    bare = is_question() & (F.coalesce(F.col("sizes")["options"], F.lit(0)) == 0)
    none = F.array(F.struct(F.coalesce("place", F.lit(0).cast("bigint")).alias("question_idx"), F.lit("").alias("label")))
    kind = "array<struct<question_idx:bigint,label:string>>"
    return nodes.select(F.col("doc").alias("line_no"), F.inline(F.coalesce(labels.cast(kind), F.when(bare, none.cast(kind))))).distinct()
