"""Preclassifiers and buckets: which class a row is in, and what each pipeline is worth there."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import CompileError


def linear(features: Column, weights: list[float], intercept: float) -> Column:
    """w · x + b over an array column."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    products = F.zip_with(features, w, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(float(intercept)), lambda a, b: a + b)


def binary(features: Column, weights: list[float], intercept: float, threshold: float = 0.5) -> Column:
    """1 if the logistic probability is above the threshold.

    It compares the linear form with the threshold's logit, so large values do not overflow.
    """
    if not 0 < threshold < 1:
        return F.lit(1 if threshold <= 0 else 0)
    return (linear(features, weights, intercept) > math.log(threshold / (1 - threshold))).cast("int")


def n_way(features: Column, components: list[dict]) -> Column:
    """Bits of binary classifiers, the first one highest."""
    n = len(components)
    bits = [binary(features, c["weights"], c["intercept"], c.get("threshold", 0.5)) * (1 << (n - 1 - i)) for i, c in enumerate(components)]
    return reduce(lambda a, b: a + b, bits)


def multiclass(features: Column, weights: list[list[float]], intercepts: list[float]) -> Column:
    """The class of greatest value; of equal ones the last."""
    scores = F.array(*[linear(features, w, b) for w, b in zip(weights, intercepts, strict=True)])
    top = F.array_max(scores)
    return (F.lit(len(weights)) - F.array_position(F.reverse(scores), top)).cast("int")


@dataclass
class Bucket:
    rewards: list[float]
    costs: list[float]
    id: int | str | None = None
    valid: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.valid = self.valid or list(range(len(self.rewards)))


@dataclass
class Preclassifier:
    kind: str
    spec: dict
    buckets: list[Bucket]

    def classify(self, features: Column) -> Column:
        return classify(self.kind, self.spec, features)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, b.valid, b.rewards, b.costs) for c, b in enumerate(self.buckets)]
        return spark.createDataFrame(rows, "class int, valid array<int>, rewards array<double>, costs array<double>")

    def bucketed(self, df: DataFrame, class_col: str) -> DataFrame:
        """Rows with the bucket of their class; there are as many buckets as classes."""
        table = self.table(df.sparkSession).withColumnRenamed("class", "_class")
        return df.join(F.broadcast(table), F.col(class_col) == F.col("_class"), "left").drop("_class")


    def bucketed_by_id(self, df: DataFrame, id_col: str) -> DataFrame:
        """Rows with the bucket whose label equals ``id_col``; nulls without one.  The first of equal labels counts."""
        first: dict = {}
        for c, b in enumerate(self.buckets):
            if b.id is not None:
                first.setdefault(str(b.id), (str(b.id), c, b.valid, b.rewards, b.costs))
        table = df.sparkSession.createDataFrame(list(first.values()), "_label string, class int, valid array<int>, rewards array<double>, costs array<double>")
        return df.join(F.broadcast(table), F.col(id_col).cast("string") == F.col("_label"), "left").drop("_label")


#: Rewards of the language models' answers (cheapest first), for texts found hard and easy (fixed values).
LLM_REWARDS = ((0.704, 0.856), (0.814, 0.860), (0.814, 0.893))


def llm_buckets(costs: list[float]) -> list[Bucket]:
    """Eight buckets: bit k (the first one highest) says that model k finds the text easy.  Pipeline 0 drops."""
    n = len(LLM_REWARDS)
    return [Bucket([0.0, *(LLM_REWARDS[k][c >> (n - 1 - k) & 1] for k in range(n))], [0.0, *costs], f"{c:0{n}b}") for c in range(1 << n)]


def llm_bucket(df: DataFrame, features: Column, confidence: list[dict], costs: list[dict]) -> DataFrame:
    """``df`` with the class, rewards and predicted costs of its text.

    ``confidence`` and ``costs`` hold a linear form for each model over the features; a bit is set if
    the logistic probability is above one half.
    """
    table = F.array(*[F.array(*[F.lit(r) for r in b.rewards]) for b in llm_buckets([0.0] * len(LLM_REWARDS))])
    out = df.withColumn("class", n_way(features, confidence))
    price = F.array(F.lit(0.0), *[linear(features, m["weights"], m["intercept"]) for m in costs])
    return out.withColumns({"rewards": F.get(table, F.col("class")), "costs": price})


def classify(kind: str, spec: dict, features: Column) -> Column:
    if kind.lower() == "static":
        return F.lit(int(spec.get("class", spec.get("num_class", 0))))
    if "components" in spec:
        return n_way(features, spec["components"])
    weights = spec["weights"]
    if weights and isinstance(weights[0], list):
        return multiclass(features, weights, spec["intercept"])
    return binary(features, weights, spec["intercept"], spec.get("threshold", 0.5))


def load(text: str | dict) -> Preclassifier:
    """A preclassifier file: classes must run from 0, and buckets get a free drop pipeline in front."""
    raw = json.loads(text) if isinstance(text, str) else text
    spec = raw["preclassifier"]
    buckets = sorted(raw["buckets"], key=lambda b: b["class"])
    if [b["class"] for b in buckets] != list(range(len(buckets))):
        raise CompileError(f"classes must run from 0; found {[b['class'] for b in buckets]}")
    out = []
    for b in buckets:
        rewards, costs = [float(v) for v in b["rewards"]], [float(v) for v in b["costs"]]
        if len(rewards) != len(costs):
            raise CompileError(f"class {b['class']} has {len(rewards)} rewards and {len(costs)} costs")
        if not costs or costs[0] != 0:
            rewards, costs = [0.0, *rewards], [0.0, *costs]
        out.append(Bucket(rewards, costs, b["class"]))
    return Preclassifier(spec.get("kind", "binary"), spec, out)
