"""Training and scoring of per-depth models; physical reconstruction of what they read and write."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import Z_QUANTILE
from .climatology import denormalised
from .features import FEATURES


def train_depth_models(rows: DataFrame, targets: list[str], features: tuple[str, ...] = FEATURES, trees: int = 20, depth: int = 5, seed: int = 0) -> dict:
    """One gradient-boosted regressor per target column, on the rows whose target is there.

    The learner is Spark ML's; its values differ from those of other boosting libraries. Fewer rows than bins: one split per row at most.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows).select("_x", *targets)
    found = {}
    for target in targets:
        own = data.where(F.col(target).isNotNull())
        found[target] = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol=f"pred_{target}", maxIter=trees, maxDepth=depth, seed=seed).fit(own)
    return found


def check_models(models: dict) -> None:
    """Every model must have grown a tree."""
    empty = [k for k, m in models.items() if m.getNumTrees < 1]
    if empty:
        raise ValueError(f"models without trees: {empty}")


def score_depth_models(rows: DataFrame, models: dict, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """rows plus pred_<target> of every model."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    for model in models.values():
        out = model.transform(out)
    return out.drop("_x")


_sessions: dict = {}


def linear_network(weights: np.ndarray) -> bytes:
    """An ONNX model y = x W as bytes: one matrix product, in the format's own field numbers (fixed values)."""

    def field(number: int, payload: bytes | int) -> bytes:
        def varint(n: int) -> bytes:
            out = b""
            while n > 127:
                out += bytes([n & 127 | 128])
                n >>= 7
            return out + bytes([n])

        if isinstance(payload, int):
            return varint(number << 3) + varint(payload)
        return varint(number << 3 | 2) + varint(len(payload)) + payload

    def value(name: bytes, width: int) -> bytes:
        shape = field(1, field(2, b"n")) + field(1, field(1, width))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    tensor = b"".join(field(1, d) for d in weights.shape) + field(2, 1) + field(8, b"w") + field(9, weights.astype("<f4").tobytes())
    node = field(1, b"x") + field(1, b"w") + field(2, b"y") + field(4, b"MatMul")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, value(b"x", weights.shape[0])) + field(12, value(b"y", weights.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def score_network(rows: DataFrame, model: str | bytes, inputs: str, outputs: dict[str, int], keep: list[str]) -> DataFrame:
    """rows with a feature array column `inputs` through an ONNX network: keep plus an array column per output.

    model: the network's bytes, which are sent along, or a path that all workers can open. outputs: name -> width. A worker opens
    the network once and scores Arrow batches.
    """
    import hashlib

    import pyarrow as pa

    name = model if isinstance(model, str) else hashlib.sha256(model).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(model)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + "".join(f", {o} array<float>" for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime as ort

        if name not in _sessions:
            _sessions[name] = ort.InferenceSession(sent.value, providers=["CPUExecutionProvider"])
        session = _sessions[name]
        feed = session.get_inputs()[0].name
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(b.schema.get_field_index("_in")).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
            found = session.run(list(outputs), {feed: x})
            own = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(list(np.asarray(o, np.float32).reshape(len(x), -1)), pa.list_(pa.float32())) for o in found]], names=[*keep, *outputs])

    return rows.select(*keep, F.col(inputs).alias("_in")).mapInArrow(run, schema)


def predict_climatology(days: DataFrame, clim: DataFrame) -> DataFrame:
    """Climatology as a model: (day, i, j, mean) by day of the year."""
    return days.withColumn("doy", F.dayofyear("day")).join(clim, "doy").select("day", "i", "j", F.col("clim").alias("mean"))


def scatter_to_grid(cells: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """All cells, with NULL where no value was predicted."""
    return cells.select("i", "j").join(values.select("i", "j", *columns), ["i", "j"], "left")


def reconstruct(scored: DataFrame) -> DataFrame:
    """scored (day, i, j, d, z, z_sigma, mean_norm, std_norm, clim, truth, wet, bottom) -> the day's fields.

    mean and sigma in degrees, p10 and p90, anomaly from the climatology, error against the truth; NULL on land and below the floor.
    """
    shown = (F.col("wet") == 1) & (F.col("bottom") == 1)
    mean = denormalised(F.col("z"), F.col("mean_norm"), F.col("std_norm"), F.col("clim"))
    sigma = F.col("z_sigma") * F.coalesce("std_norm", F.lit(1.0))
    z90 = Z_QUANTILE[0.8]
    out = {"mean": mean, "sigma": sigma, "p10": mean - z90 * sigma, "p90": mean + z90 * sigma, "anomaly": mean - F.col("clim"), "error": mean - F.col("truth")}
    return scored.select("day", "i", "j", "d", *[F.when(shown, v).alias(k) for k, v in out.items()])


def physical_inputs(x: DataFrame, norm: dict[str, tuple[float, float]]) -> DataFrame:
    """x (day, i, j, z_<var>, mask_<m>, clim_<var>) -> physical fields and the speeds of currents and winds; NULL where mask is 0."""
    from .features import MASK_OF, X_VARS

    out: dict[str, Column] = {}
    for v in X_VARS:
        mean, std = norm.get(v, (0.0, 1.0))
        out[v] = F.when(F.col(f"mask_{MASK_OF[v]}") == 1, F.col(f"z_{v}") * std + mean + F.col(f"clim_{v}"))
    fields = x.select("day", "i", "j", *[c.alias(k) for k, c in out.items()])
    return fields.withColumns({"cur": F.hypot("cur_u", "cur_v"), "wind": F.hypot("wnd_u", "wnd_v")})


def ar1_recurrence(noise: DataFrame, keys: list[str], rho: float = 0.9, value: str = "eta") -> DataFrame:
    """noise (keys, t, eta) -> adds x: x_t = rho x_(t-1) + sqrt(1 - rho^2) eta_t. A group is one cell's series, in time order.

    Within blocks of a bounded number of steps the recurrence is a sum of eta_s rho^(t - s), taken with one cumulative sum.
    """
    kinds = dict(noise.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "t", value]) + ", x double"
    gain = float(np.sqrt(1 - rho * rho))
    # powers within a block stay above 1e-6, so that the quotients lose few digits
    block = max(1, int(np.log(1e-6) / np.log(rho))) if 0 < rho < 1 else 1

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        eta, out, last = rows[value].to_numpy(float), np.empty(len(rows)), 0.0
        for k in range(0, len(eta), block):
            part = eta[k : k + block]
            power = rho ** np.arange(1, len(part) + 1)
            out[k : k + block] = power * (last + np.cumsum(gain * part / power))
            last = out[k + len(part) - 1]
        return rows.assign(x=out)[[*keys, "t", value, "x"]]

    return noise.select(*keys, "t", value).groupBy(*keys).applyInPandas(one, schema)
