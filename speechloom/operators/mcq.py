"""Multiple-choice questions: option variants, rotations, calibration of label probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTION = "array<struct<label:string,text:string>>"


def options_in_order(labels: Column, choices: Column) -> Column:
    """array<struct<label, text>> of a label list and a map of texts."""
    return F.transform(labels, lambda x: F.struct(x.alias("label"), F.try_element_at(choices, x).alias("text")))


def first_place_last_text(options: Column) -> Column:
    """Options by normalised label: the first place and the last text of each; blank labels dropped."""
    named = F.filter(F.transform(options, lambda o: F.struct(F.upper(F.trim(o["label"])).alias("label"), o["text"].alias("text"))), lambda o: o["label"] != "")
    labels = F.array_distinct(F.transform(named, lambda o: o["label"]))
    return F.transform(labels, lambda x: F.struct(x.alias("label"), F.element_at(F.filter(named, lambda o: o["label"] == x), -1)["text"].alias("text")))


def swap_whole(options: Column, i: Column, j: Column) -> Column:
    """Options i and j (from 0) change places with label and text: the right letter stays the same."""
    return F.transform(options, lambda o, k: F.when(k == i, F.get(options, j)).when(k == j, F.get(options, i)).otherwise(o))


def swap_texts(options: Column, i: Column, j: Column) -> Column:
    """Options i and j exchange their texts under fixed labels: the right letter moves."""
    def text(o: Column, k: Column) -> Column:
        return F.when(k == i, F.get(options, j)["text"]).when(k == j, F.get(options, i)["text"]).otherwise(o["text"])

    return F.transform(options, lambda o, k: F.struct(o["label"].alias("label"), text(o, k).alias("text")))


def swap_variants(questions: DataFrame, options: str, gold: str, keep_original: bool = True) -> DataFrame:
    """A row for each place the right option can take by a whole swap: (..., variant), 0 the original.

    A question whose gold is not among its labels passes only as its original.
    """
    at = F.array_position(F.transform(options, lambda o: o["label"]), F.col(gold)).cast("int") - 1
    places = F.when(at >= 0, F.filter(F.sequence(F.lit(0), F.size(options) - 1), lambda k: k != at)).otherwise(F.array().cast("array<int>"))
    numbered = F.transform(places, lambda p, k: F.struct((k + 1).alias("variant"), p.alias("place")))
    original = F.array(F.struct(F.lit(0).alias("variant"), F.lit(-1).alias("place")))
    wanted = F.concat(original, numbered) if keep_original else F.when(at >= 0, numbered).otherwise(original)
    out = questions.withColumn("_at", at).withColumn("_v", F.explode(wanted))
    moved = F.when(F.col("_v.place") >= 0, swap_whole(F.col(options), F.col("_at"), F.col("_v.place"))).otherwise(F.col(options))
    return out.withColumn(options, moved).withColumn("variant", F.col("_v.variant")).drop("_v", "_at")


def target_variant(options: Column, gold: Column, target: Column) -> Column:
    """Options with texts exchanged so that the right text stands under the target label; as they are if it is missing."""
    labels = F.transform(options, lambda o: o["label"])
    i, j = F.array_position(labels, gold).cast("int") - 1, F.array_position(labels, target).cast("int") - 1
    return F.when((i >= 0) & (j >= 0), swap_texts(options, i, j)).otherwise(options)


def rotations(questions: DataFrame, texts: str) -> DataFrame:
    """A row for each rotation r: slot j shows text (j + r) mod n."""
    n = F.size(texts)
    out = questions.where(n > 0).withColumn("rotation", F.explode(F.sequence(F.lit(0), n - 1)))
    shown = F.transform(F.col(texts), lambda _, j: F.get(F.col(texts), ((j + F.col("rotation")) % n).cast("int")))
    return out.withColumn("shown", shown)


def softmax(scores: Column) -> Column:
    most = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - most))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def log_sum_exp(scores: Column) -> Column:
    most = F.array_max(scores)
    return most + F.ln(F.aggregate(F.transform(scores, lambda x: F.exp(x - most)), F.lit(0.0), lambda a, x: a + x))


def argmax(values: Column) -> Column:
    """The first place, from 0, of the greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def contents_of_rotations(rows: DataFrame, key: list[str], rotation: str, slot_probs: str) -> DataFrame:
    """(key, content, prob): the mean over rotations of each content's probability; slot j of rotation r shows (j + r) mod n."""
    long = rows.select(*key, rotation, F.size(slot_probs).alias("n"), F.posexplode(slot_probs).alias("slot", "p"))
    content = ((F.col("slot") + F.col(rotation)) % F.col("n")).cast("int")
    return long.groupBy(*key, content.alias("content")).agg(F.sum(F.col("p") / F.col("n")).alias("prob"))


def rotation_summary(rows: DataFrame, key: list[str], rotation: str, slot_probs: str) -> DataFrame:
    """(key, rotations, consistent, chosen): whether all rotations choose one content, and the content of the greatest mean."""
    n = F.size(slot_probs)
    choice = ((argmax(F.col(slot_probs)) + F.col(rotation)) % n).cast("int")
    agreed = rows.groupBy(*key).agg(F.count("*").alias("rotations"), (F.count_distinct(choice) == 1).alias("consistent"))
    means = contents_of_rotations(rows, key, rotation, slot_probs)
    best = means.groupBy(*key).agg(F.max_by("content", F.struct(F.round("prob", 9), -F.col("content"))).alias("chosen"))
    return agreed.join(best, key)


def margin(probs: Column) -> Column:
    """The greatest less the second greatest."""
    ranked = F.sort_array(probs, asc=False)
    return F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))


def shifted_choice(probs: Column, shifts: Column) -> Column:
    """The place of the greatest log(max(p, 1e-9)) + shift, first of ties."""
    return argmax(F.zip_with(probs, shifts, lambda p, g: F.round(F.ln(F.greatest(p, F.lit(1e-9))) + g, 9)))


def class_prior(rows: DataFrame, probs: str, n: int) -> DataFrame:
    """(place, prior): the mean probability of each place."""
    return rows.agg(F.array(*(F.avg(F.get(F.col(probs), F.lit(i))) for i in range(n))).alias("p")).select(F.posexplode("p").alias("place", "prior"))


def calibration_sweep(rows: DataFrame, probs: str, gold: str, prior: list[float], alphas: list[float]) -> DataFrame:
    """(alpha, n, accuracy) of choices by p * prior ** -alpha; all alphas in one pass."""
    steps = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.array(*(F.lit(float(-a * np.log(max(x, 1e-9)))) for x in prior)).alias("shift")) for a in alphas))).alias("s")
    each = rows.select(probs, gold, steps)
    right = (shifted_choice(F.col(probs), F.col("s.shift")) == F.col(gold)).cast("bigint")
    return each.groupBy(F.col("s.alpha").alias("alpha")).agg(F.count("*").alias("n"), F.round(F.sum(right) / F.count("*"), 6).alias("accuracy"))


def uniform_shifts(rows: DataFrame, probs: str, n: int, iterations: int = 800) -> list[float]:
    """Shifts under which the choices are spread evenly over n places, by damped steps.

    Every step is one aggregation of n sums; only those come to the driver.
    """
    shift = np.zeros(n)
    data = rows.select(F.col(probs).alias("p")).where(F.size("p") == n)
    total = data.count()
    if not total:
        return shift.tolist()
    for t in range(iterations):
        chosen = shifted_choice(F.col("p"), F.array(*(F.lit(float(g)) for g in shift)))
        counts = data.select(chosen.alias("c")).agg(*(F.count(F.when(F.col("c") == i, 1)) for i in range(n))).first()
        share = np.maximum(np.array(counts, float) / total, 1e-6)
        if np.abs(share - 1 / n).max() < 0.5 / total:
            break
        shift += (0.6 * (1 - t / iterations) + 0.05) * (np.log(1 / n) - np.log(share))
        shift -= shift.mean()
    return shift.tolist()
