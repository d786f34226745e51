"""Small dense nets: trained on a bounded table, applied in Arrow batches with broadcast weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = list[tuple[np.ndarray, np.ndarray]]


def forward(weights: Weights, x: np.ndarray) -> np.ndarray:
    for i, (w, b) in enumerate(weights):
        x = x @ w + b
        if i + 1 < len(weights):
            x = np.maximum(x, 0)
    return x[:, 0]


def predict(rows: DataFrame, features: list[str], ensembles: list[Weights]) -> DataFrame:
    """rows with prediction, the mean of the nets."""
    model = rows.sparkSession.sparkContext.broadcast(ensembles)
    names = [*rows.columns, "prediction"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1) if len(batch) else np.zeros((0, len(features)))
            y = np.mean([forward(w, x) for w in model.value], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y)], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "prediction double"])
    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame, features: list[str], target: str, hidden: int = 16, steps: int = 400, rate: float = 0.01, seed: int = 0, most: int = 20_000) -> Weights:
    """Least-squares training by Adam on at most `most` rows, taken by hash: the bound of what the driver reads."""
    share = rows.count()
    sample = rows if share <= most else rows.where(F.pmod(F.xxhash64(*features), F.lit(share)) < most)
    data = sample.select(*features, target).dropna().toPandas().sort_values([*features, target]).to_numpy(float)
    x, y = data[:, :-1], data[:, -1]
    rng = np.random.default_rng(seed)
    weights = [(rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in ((len(features), hidden), (hidden, 1))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for layer in weights for p in layer]
    for t in range(1, steps + 1):
        hid = np.maximum(x @ weights[0][0] + weights[0][1], 0)
        err = (hid @ weights[1][0] + weights[1][1])[:, 0] - y
        g_out = 2 * err[:, None] / len(y)
        g_hid = (g_out @ weights[1][0].T) * (hid > 0)
        grads = [x.T @ g_hid, g_hid.sum(0), hid.T @ g_out, g_out.sum(0)]
        params = [p for layer in weights for p in layer]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights
