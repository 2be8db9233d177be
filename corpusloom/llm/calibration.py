"""Labels, and isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clear_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): ids whose label rows agree; null ids and null labels say nothing."""
    y = F.col(column).cast("double")
    rows = labels.where(F.col("doc_id").isNotNull() & y.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.agg(F.min(y).alias("y"), F.max(y).alias("most")).where("y = most and y in (0, 1)").select("doc_id", "y")


class Isotonic:
    """A non-decreasing map of raw scores to shares of label 1, linear between the pooled blocks' means."""

    def __init__(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # weight, sum of raw, sum of y
        for r, v, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([w, r * w, v * w])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
                w2, r2, v2 = blocks.pop()
                blocks[-1][0] += w2
                blocks[-1][1] += r2
                blocks[-1][2] += v2
        b = np.array(blocks).reshape(-1, 3)
        self.x = b[:, 1] / b[:, 0] if len(b) else np.zeros(1)
        self.p = b[:, 2] / b[:, 0] if len(b) else np.full(1, 0.5)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        p = np.interp(raw, self.x, self.p)
        # beyond the pooled blocks the order of the raw scores still shows, by a hair
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)
