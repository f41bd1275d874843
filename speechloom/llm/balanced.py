"""Balanced samples with target category shares, by the cube method.

Every record gets the inclusion probability of its category. The flight phase walks in the null space of
the category indicators: two undecided records of a category trade probability until one of them is decided,
which leaves the expected and the drawn number of the category equal. It runs within partitions, one record at
a time and with at most one undecided record of each category in memory; those left merge upward in groups of
FAN partitions until one group is left, whose landing phase decides the rest keeping the total. The draws of each
level are hashes of the level and the record's key, so levels are independent and a recomputed task repeats its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.session import cut

FAN = 32
EPSILON = 1e-9


class Flight:
    """Undecided units, at most one for each slot (a category, or a whole field when landing), and the chosen ones."""

    def __init__(self):
        self.open: dict = {}
        self.chosen: list = []

    def _settle(self, slot, unit, p: float) -> None:
        if p >= 1 - EPSILON:
            self.chosen.append(unit)
        elif p > EPSILON:
            self.open[slot] = (unit, p)

    def meet(self, slot, unit, p: float, draw: float) -> None:
        """A unit of probability p meets the slot's open one: one of the two is decided, by a uniform draw."""
        held = self.open.pop(slot, None)
        if held is None or not EPSILON < p < 1 - EPSILON:
            if held is not None:
                self.open[slot] = held
            self._settle(slot, unit, p)
            return
        (other, a), total = held, held[1] + p
        if total <= 1:
            self._settle(slot, *((unit, total) if draw * total < p else (other, total)))
        else:
            full, part = (unit, other) if draw * (2 - total) < 1 - a else (other, unit)
            self.chosen.append(full)
            self._settle(slot, part, total - 1)

    def land(self, field, draw_of) -> None:
        """Decides the open units: they trade probability across categories, and the last is drawn."""
        rest = sorted(self.open.items(), key=repr)
        self.open = {}
        for slot, (unit, p) in rest:
            self.meet(field(slot), unit, p, draw_of(unit, 1))
        for unit, p in self.open.values():
            if draw_of(unit, 2) < p:
                self.chosen.append(unit)
        self.open = {}


def _flown(batches: Iterator[pa.RecordBatch], landing: bool = False) -> Iterator[pa.RecordBatch]:
    """Flight over one partition of (target_field, record_key, category, p, and draws): the chosen rows with p = 1, then the open ones."""
    names = ["target_field", "record_key", "category", "p"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]
    flight = Flight()

    def rows(units):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*units), kinds)], names)

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for unit in zip(*columns):
            flight.meet((unit[0], unit[2]), unit, unit[3], unit[4])
        if flight.chosen:
            yield rows([(*u[:3], 1.0) for u in flight.chosen])
            flight.chosen = []
    if landing:
        flight.land(lambda slot: slot[0], lambda unit, k: unit[4 + k])
    last = [(*u[:3], 1.0) for u in flight.chosen] + [(*u[:3], p) for u, p in flight.open.values()]
    if last:
        yield rows(last)


def plan(records: DataFrame, targets: DataFrame, share: float = 0.2) -> DataFrame:
    """A row for each target: sample_size, target_rows, min_rows, wanted (the greater of the two), available and the inclusion probability.

    The sample size of a field is the given share of all its records, rounded down. A category gets its
    target share of that, min_rows at least, and all its records if they are fewer.
    """
    n = records.groupBy("target_field", "category").agg(F.count("*").alias("available"))
    sizes = n.groupBy("target_field").agg(F.floor(F.sum("available") * F.lit(share)).alias("sample_size"))
    goal = F.col("target_share") * F.col("sample_size")
    joined = targets.select("target_field", "category", "target_share", "min_rows").join(n, ["target_field", "category"], "left").join(sizes, "target_field", "left").fillna(0, ["available", "sample_size"])
    want = F.greatest(F.coalesce(goal, F.lit(0.0)), F.coalesce("min_rows", F.lit(0)).cast("double"))
    return joined.select("target_field", "category", "sample_size", goal.alias("target_rows"), "min_rows", want.alias("wanted"), "available", F.coalesce(F.when(F.col("available") > 0, F.least(want / F.col("available"), F.lit(1.0))), F.lit(0.0)).alias("p"))


def uniform(seed: int, level: int) -> Column:
    """A draw in [0, 1) from the record's key, independent between seeds and levels."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "target_field", "record_key"), 11).cast("double") / F.lit(float(1 << 53))


def draw(records: DataFrame, targets: DataFrame, share: float = 0.2, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The sample (target_field, record_key, category) and the report of its targets.

    records: one row for each (target_field, record_key), category null for none; those count for the sample
    size but are not drawn. The report compares what was drawn with the targets: one is not met if all records of
    its category were drawn and they are fewer than wanted. Targets without records are not met. An empty table
    gives an empty sample and no target met.
    """
    quota = cut(plan(records, targets, share))
    # one row for each target of a table that states them: a broadcast is left to Spark's size check
    pool = records.where("category is not null").join(quota.where("p > 0").select("target_field", "category", "p"), ["target_field", "category"])
    columns = ["target_field", "record_key", "category", "p"]
    shape = "target_field string, record_key string, category string, p double"
    flown = cut(pool.select(*columns, uniform(seed, 0).alias("draw")).mapInArrow(_flown, shape).withColumn("part", F.spark_partition_id()))
    decided = flown.where("p >= 1").drop("part")
    rest = flown.where("p < 1")
    groups, level = max(1, flown.rdd.getNumPartitions()), 0
    while True:
        groups, level = -(-groups // FAN), level + 1
        last = groups <= 1
        rest = rest.withColumn("part", F.floor(F.col("part") / FAN))
        # at most one row for each category of each group that merges
        merged = (rest.repartition(1) if last else rest.repartition(groups, "part")).sortWithinPartitions("target_field", "record_key")
        draws = [uniform(seed, 3 * level + k).alias(f"draw_{k}") for k in range(3)]
        flown = cut(merged.select(*columns, *draws).mapInArrow(lambda b, last=last: _flown(b, last), shape).withColumn("part", F.spark_partition_id()))
        decided = decided.unionByName(flown.where("p >= 1").drop("part"))
        rest = flown.where("p < 1")
        if last:
            break
    sample = decided.select("target_field", "record_key", "category")
    drawn = sample.groupBy("target_field", "category").agg(F.count("*").alias("drawn"))
    report = quota.drop("p").join(drawn, ["target_field", "category"], "left").fillna(0, ["drawn"])
    exhausted = (F.col("drawn") == F.col("available")) & ((F.col("available") == 0) | (F.col("drawn") < F.col("wanted")))
    return sample, report.select("target_field", "category", "sample_size", "target_rows", "min_rows", "available", "drawn", (~exhausted).alias("can_be_met"), F.round(F.col("drawn") - F.col("target_rows"), 6).alias("residual"))


def gold_label() -> Column:
    """The label that a gold_choice denotes, in upper case: by label in any spelling, or by exact option text; else null."""
    gold, labels, choices = F.col("gold_choice"), F.col("choice_labels"), F.col("choices")
    bare = F.upper(F.regexp_replace(gold, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    known = F.transform(labels, lambda x: F.upper(F.trim(x)))
    by_text = F.element_at(F.transform(F.filter(F.map_entries(choices), lambda e: e["value"] == gold), lambda e: F.upper(F.trim(e["key"]))), 1)
    return F.when(F.coalesce(gold, F.lit("")) == "", None).when(F.array_contains(known, bare), bare).otherwise(by_text)


def target_records(samples: DataFrame, segments: DataFrame, codes: DataFrame) -> DataFrame:
    """Records of both target fields: distinct sample_id with the label of its gold, distinct utt_id with its label's code."""
    label = F.lower(F.trim("language"))
    gold = samples.select(F.lit("gold_choice").alias("target_field"), F.col("sample_id").alias("record_key"), gold_label().alias("category"))
    spoken = segments.select(F.lit("language").alias("target_field"), F.col("utt_id").alias("record_key"), label.alias("label"))
    # the fixed table of label spellings, one row for each
    spoken = spoken.join(codes.select("label", F.col("code").alias("category")), "label", "left").drop("label")
    both = gold.unionByName(spoken.select(*gold.columns)).where("record_key is not null")
    return both.groupBy("target_field", "record_key").agg(F.min("category").alias("category"))
