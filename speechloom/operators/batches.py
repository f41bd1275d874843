"""Where a model meets a table: batch functions over Arrow, by language where that saves set-up.

A model is any function of a pandas frame (or of a list of texts); the library holds none. `stub_scores` stands for one
in tests and examples: a deterministic function of its input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.operators import mcq


def _schema(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)


def map_batches(rows: DataFrame, change: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int | None = None) -> DataFrame:
    """rows changed frame by frame, of at most `size` rows each; without a shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            step = size or max(1, len(f))
            for i in range(0, len(f), step):
                yield change(f.iloc[i : i + step])

    return rows.mapInPandas(run, schema)


def safe_batches(rows: DataFrame, key: list[str], change: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(key, schema..., error): a batch whose function fails is tried row by row, and a row that fails has its error and nulls."""
    names = [x.split()[0].strip("`") for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                yield pd.concat([f[key].reset_index(drop=True), change(f).reset_index(drop=True)[names].assign(error=None)], axis=1)
            except Exception:
                for i in range(len(f)):
                    one = f.iloc[i : i + 1]
                    try:
                        out = change(one).reset_index(drop=True)[names].assign(error=None)
                    except Exception as e:
                        out = pd.DataFrame([{**dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}])
                    yield pd.concat([one[key].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(run, f"{_schema(rows, key)}, {schema}, error string")


def generated(rows: DataFrame, make: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that a generator gives for each row."""
    names = [x.split()[0].strip("`") for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [r for x in f.to_dict("records") for r in make(x)]
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def changed_text(text: Column, change: Callable[[str], str]) -> Column:
    """A hook over predictions: a text function by Arrow batch; null stays null."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else change(x))

    return run(text)


def decoded(rows: DataFrame, key: list[str], source: str, language: str, decode: Callable[[list, str | None], list[str]], mode: str = "fixed", fixed: str | None = None, partitions: int = 64) -> DataFrame:
    """(key, prediction): decode(batch, language) with one language for all (fixed), none (autodetect) or each row's own (oracle).

    For oracle, rows of a language come together within partitions, so a batch has few switches; a language's rows are spread
    over hashed partitions, so none is gathered in one task. A row without a language fails in that mode.
    """
    if mode not in ("fixed", "autodetect", "oracle"):
        raise ValueError(f"unknown mode {mode}")
    rows = rows.select(*key, F.col(source).alias("_source"), F.col(language).alias("_language"))
    if mode == "oracle":
        known = F.when(F.assert_true(F.col("_language").isNotNull(), F.lit("a row has no language")).isNull(), F.col("_language"))
        spread = F.pmod(F.xxhash64(*key), F.lit(16))
        rows = rows.withColumn("_language", known).repartition(partitions, "_language", spread).sortWithinPartitions("_language")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [(x, g) for x, g in f.groupby("_language", dropna=False, sort=False)] if mode == "oracle" else [(fixed if mode == "fixed" else None, f)]
            for x, g in parts:
                texts = decode(g["_source"].tolist(), x)
                if len(texts) != len(g):
                    raise ValueError("a prediction is missing")
                yield g[key].assign(prediction=texts)

    return rows.mapInPandas(run, f"{_schema(rows, key)}, prediction string")


def translated(rows: DataFrame, key: list[str], text: str, language: str, known: dict[str, str], translate: Callable[[list[str], str], list[str]], skip: tuple[str, ...] = ("en",)) -> DataFrame:
    """(key, text, translated): texts of languages that have a code for the translator; those of skipped or other languages, and without four letters, stay."""
    from speechloom.functions.text import is_translatable

    codes = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.create_map().cast("map<string,string>")
    code = F.try_element_at(codes, F.lower(F.trim(F.col(language))))
    route = F.when(~F.lower(F.trim(F.col(language))).isin(*skip) & is_translatable(F.col(text)), code)
    routed = rows.select(*key, F.col(text).alias("text"), route.alias("_code"))
    stays = routed.where("_code is null").select(*key, "text", F.lit(False).alias("translated"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x, g in f.groupby("_code", sort=False):
                yield g[[*key, "text"]].assign(text=translate(g["text"].tolist(), x), translated=True)

    spread = F.pmod(F.xxhash64(*key), F.lit(16))
    moved = routed.where("_code is not null").repartition("_code", spread).sortWithinPartitions("_code")
    return moved.mapInPandas(run, f"{_schema(rows, key)}, text string, translated boolean").unionByName(stays)


def scored(rows: DataFrame, key: list[str], prompt: str, labels: str, score: Callable[[list[str], list[list[str]]], list[list[float]]]) -> DataFrame:
    """(key, labels, logprobs): a score of each label after each prompt."""
    chosen = rows.select(*key, F.col(prompt).alias("_prompt"), F.col(labels).alias("labels"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [list(x) for x in f["labels"]]
            yield f[[*key, "labels"]].assign(labels=own, logprobs=[[float(v) for v in x] for x in score(f["_prompt"].tolist(), own)])

    return chosen.mapInPandas(run, f"{_schema(rows, key)}, labels array<string>, logprobs array<double>")


def stub_scores(prompts: list[str], labels: list[list[str]]) -> list[list[float]]:
    """Scores that depend on prompt and label alone."""
    return [[-(zlib.crc32(f"{p}|{x}".encode()) % 1000) / 250 for x in own] for p, own in zip(prompts, labels)]


def cyclic_choice(rows: DataFrame, key: list[str], question: str, labels: str, texts: str, score: Callable) -> DataFrame:
    """(key, rotations, consistent, chosen): the option of the greatest mean probability over all rotations of the texts under fixed labels."""
    turned = mcq.rotations(rows.select(*key, F.col(question).alias("_q"), F.col(labels).alias("_labels"), F.col(texts).alias("_texts")), "_texts")
    shown = F.array_join(F.zip_with("_labels", "shown", lambda a, b: F.concat(a, F.lit(". "), F.coalesce(b, F.lit("")))), "\n")
    asked = turned.select(*key, "rotation", F.concat_ws("\n", "_q", shown).alias("_prompt"), "_labels")
    probs = scored(asked, [*key, "rotation"], "_prompt", "_labels", score).withColumn("slots", mcq.softmax(F.col("logprobs")))
    return mcq.rotation_summary(probs, key, "rotation", "slots")


def calibrated_choice(rows: DataFrame, key: list[str], prompt: Column, null_prompt: Column, labels: str, score: Callable) -> DataFrame:
    """(key, chosen): the place of the greatest score once that of a prompt without the recording is taken off, the first of equals."""
    real = scored(rows.withColumn("_p", prompt), key, "_p", labels, score)
    null = scored(rows.withColumn("_p", null_prompt), key, "_p", labels, score).select(*key, F.col("logprobs").alias("_null"))
    gained = F.zip_with("logprobs", "_null", lambda a, b: F.round(a - b, 9))
    return real.join(null, key).select(*key, mcq.argmax(gained).alias("chosen"))


def rotated_shots(rows: DataFrame, position: str, batch: int, shots: int, wanted: int) -> DataFrame:
    """rows with shots: the example numbers that their batch is shown, starting one further with every batch."""
    first = F.floor(F.col(position) / batch)
    return rows.withColumn("shots", F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: ((first + i) % shots).cast("int")))
