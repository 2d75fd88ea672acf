"""Boxes and detections: areas, overlap, suppression, top classes, splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import CompileError


def area(box: Column) -> Column:
    """Of a box [x1, y1, x2, y2]; 0 if it is turned over."""
    g = lambda i: F.get(box, F.lit(i))
    return F.greatest(g(2) - g(0), F.lit(0)) * F.greatest(g(3) - g(1), F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    g = lambda box, i: F.get(box, F.lit(i))
    w = F.greatest(F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0)), F.lit(0))
    h = F.greatest(F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1)), F.lit(0))
    both = w * h
    either = area(a) + area(b) - both
    return F.when(either > 0, both / F.when(either > 0, either)).otherwise(0.0)


def np_iou(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    w = np.maximum(np.minimum(box[2], boxes[:, 2]) - np.maximum(box[0], boxes[:, 0]), 0)
    h = np.maximum(np.minimum(box[3], boxes[:, 3]) - np.maximum(box[1], boxes[:, 1]), 0)
    size = np.maximum(boxes[:, 2] - boxes[:, 0], 0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0)
    own = max(box[2] - box[0], 0) * max(box[3] - box[1], 0)
    either = own + size - w * h
    return np.where(either > 0, w * h / np.where(either > 0, either, 1), 0.0)


def suppress(boxes: np.ndarray, scores: np.ndarray, overlap: float = 0.5, top_k: int = 200) -> list[int]:
    """Hard non-maximum suppression, best score first, ties to the earlier box."""
    left, kept = np.lexsort((np.arange(len(scores)), -scores)), []
    while len(left) and len(kept) < top_k:
        kept.append(int(left[0]))
        left = left[1:]
        if len(left):
            left = left[np_iou(boxes[kept[-1]], boxes[left]) <= overlap]
    return kept


def nms(df: DataFrame, boxes: str, scores: str, overlap: float = 0.5, top_k: int = 200, least: float = 0.0) -> DataFrame:
    """``df`` with ``kept``: places of the boxes that stay, best first."""

    @F.pandas_udf("array<int>")
    def keep(b, s):
        import pandas as pd

        out = []
        for own, score in zip(b, s, strict=True):
            if own is None or score is None or not len(own):
                out.append([])
                continue
            own, score = np.array([np.asarray(v, float) for v in own]), np.asarray(score, float)
            good = np.flatnonzero(score > least)
            out.append([int(good[i]) for i in suppress(own[good], score[good], overlap, top_k)])
        return pd.Series(out)

    return df.withColumn("kept", keep(F.col(boxes), F.col(scores)))


def ssd_postprocess(scores: np.ndarray, boxes: np.ndarray, width: int, height: int, least: float = 0.7, overlap: float = 0.5, top_k: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Boxes in pixels and probabilities from a detector's [n, 2] scores and [n, 4] unit boxes."""
    p = scores[:, 1]
    good = np.flatnonzero(p > least)
    kept = good[suppress(boxes[good], p[good], overlap, top_k)] if len(good) else good
    return (boxes[kept] * np.array([width, height, width, height])).astype(np.int64), p[kept]


def letterbox(width: int, height: int, size: int = 640) -> tuple[float, float, float]:
    """Scale and the padding on the left and on top that fit an image into a square."""
    scale = min(size / width, size / height)
    return scale, (size - width * scale) / 2, (size - height * scale) / 2


def yolo_postprocess(output: np.ndarray, width: int, height: int, least: float = 0.25, overlap: float = 0.45, max_det: int = 300, agnostic: bool = False, size: int = 640) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boxes, probabilities, classes) in the image from a [4 + classes, anchors] output."""
    out = output.reshape(output.shape[-2:])
    probability, label = out[4:].max(0), out[4:].argmax(0)
    good = np.flatnonzero(probability >= least)
    x, y, w, h = out[:4, good]
    scale, left, top = letterbox(width, height, size)
    boxes = np.stack([(x - w / 2 - left) / scale, (y - h / 2 - top) / scale, (x + w / 2 - left) / scale, (y + h / 2 - top) / scale], 1)
    boxes = np.clip(boxes, 0, [width, height, width, height])
    p, c = probability[good], label[good]
    # Classes far apart never overlap, so one pass suppresses within classes.
    apart = boxes if agnostic else boxes + c[:, None] * (max(width, height) + 1)
    kept = suppress(apart, p, overlap, max_det)
    return boxes[kept], p[kept], c[kept]


def split_classes(df: DataFrame, image_id: str, probabilities: str, detection: list[str], top_n: int = 3, least: float = 0.01, classes: tuple[int, int] | None = (14, 23), normalise: str = "none", dummy: bool = True) -> DataFrame:
    """A row for each detection's best classes, and one of class 0 with probability 0 for each image.

    ``normalise``: none, l1 (shares) or softmax, over the classes kept.
    """
    each = df.select(image_id, *detection, F.posexplode(probabilities).alias("class_id", "probability")).filter(F.col("probability") >= least)
    if classes:
        each = each.filter(F.col("class_id").between(*classes))
    own = Window.partitionBy(image_id, *detection)
    ranked = each.withColumn("rank", F.row_number().over(own.orderBy(F.desc("probability"), "class_id"))).filter(F.col("rank") <= top_n)
    if normalise == "l1":
        ranked = ranked.withColumn("probability", F.col("probability") / F.sum("probability").over(own))
    elif normalise == "softmax":
        ranked = ranked.withColumn("probability", F.exp("probability") / F.sum(F.exp("probability")).over(own))
    elif normalise != "none":
        raise CompileError(f"unknown normalisation {normalise!r}")
    out = ranked.withColumn("class_id", F.col("class_id").cast("string"))
    if not dummy:
        return out
    none = df.select(image_id).distinct().select(image_id, F.lit("0").alias("class_id"), F.lit(0.0).alias("probability"))
    return out.unionByName(none, allowMissingColumns=True)


def softmax_split(probabilities: Column, threshold: float) -> Column:
    """Entries of a softmax above a threshold, as structs (class, probability)."""
    top = F.array_max(probabilities)
    e = F.transform(probabilities, lambda p: F.exp(p - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    both = F.transform(e, lambda v, i: F.struct(i.alias("class"), (v / total).alias("probability")))
    return F.filter(both, lambda s: s["probability"] > threshold)


def split_boxes(df: DataFrame, boxes: str, width: str, height: str) -> DataFrame:
    """A row for each box, clamped to the image, with its sizes; without boxes one row of nulls."""
    n = F.coalesce(F.size(boxes), F.lit(0))
    out = df.withColumn("boxes_detected", F.when(n > 0, n)).select("*", F.posexplode_outer(boxes).alias("my_box_number", "_b"))
    edge = [F.least(F.greatest(F.get("_b", F.lit(i)), F.lit(0)), F.col(width if i % 2 == 0 else height)) for i in range(4)]
    out = out.withColumn("my_bounding_box", F.when(F.col("_b").isNotNull(), F.array(*edge)))
    g = lambda i: F.get("my_bounding_box", F.lit(i)).cast("double")
    h, w = g(3) - g(1), g(2) - g(0)
    return out.drop("_b").withColumns({"new_height_float": h, "new_width_float": w, "new_area_float": h * w, "new_hw_ratio_float": h / F.when(w != 0, w)})


def split_embeddings(df: DataFrame, shape: str, data: str, name: str = "embedding") -> DataFrame:
    """A tensor [n, d] to n rows of d values."""
    dim = F.get(shape, F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.get(shape, F.lit(0)).cast("int") - 1), lambda i: F.slice(data, i * dim + 1, dim))
    some = F.when(F.get(shape, F.lit(0)) > 0, parts).otherwise(F.array().cast(df.schema[data].dataType.simpleString().join(["array<", ">"])))
    return df.select("*", F.posexplode(some).alias("position", name)).drop(shape, data)


def is_unknown(match_ids: Column) -> Column:
    """No match: null or an empty list."""
    return match_ids.isNull() | (F.size(match_ids) == 0)
