"""Training batches of tiles: seeded draws of days and tiles, dense tensors of each, and scores over their cores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gaussian_nll, uniform
from .windows import assign_tiles, axis_plan


def _pick(u: Column, of: str) -> Column:
    """The first entry of an array of (upto, ...), ascending, whose upto is above u; the last if rounding leaves none."""
    above = F.filter(of, lambda t: t["upto"] > u)
    return F.coalesce(F.get(above, F.lit(0)), F.element_at(of, -1))


def draw_tiles(days: DataFrame, tiles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """days (day), tiles (oi, oj, p: chances that add up to 1) -> (draw, day, oi, oj): n draws with replacement, days alike, tiles by p.

    The same on every run: draw k goes by the MD5 of seed and k. days and tiles are a calendar and a plan, some thousand rows each, and meet
    the draws as two sorted arrays. Without days or tiles there are no draws.
    """
    dated = days.select(F.col("day")).distinct().groupBy().agg(F.sort_array(F.collect_list("day")).alias("days"))
    placed = tiles.select("oi", "oj", F.sum("p").over(Window.orderBy("oi", "oj")).alias("upto"))
    chances = placed.groupBy().agg(F.sort_array(F.collect_list(F.struct("upto", "oi", "oj"))).alias("tiles"))
    draws = tiles.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(dated)).join(F.broadcast(chances))  # one row each
    u, w = uniform(seed, "draw", "_day"), uniform(seed, "draw", "_tile")
    named = draws.withColumns({"_day": F.lit("day"), "_tile": F.lit("tile")}).where("size(days) > 0 and size(tiles) > 0")
    picked = named.select("draw", F.get("days", F.floor(u * F.size("days")).cast("int")).alias("day"), _pick(w, "tiles").alias("t"))
    return picked.select("draw", "day", F.col("t.oi").alias("oi"), F.col("t.oj").alias("oj"))


def tile_batches(draws: DataFrame, cells: DataFrame, inputs: list[str], targets: dict[str, str], ny: int, nx: int, tile: int, core: int, k: int, masks: tuple[str, ...] = ()) -> DataFrame:
    """(draw, day, oi, oj, x, y, mask, core): a row per draw, with tensors as flat arrays in row-major order.

    cells (day, i, j, inputs, masks, targets and their loss masks): a row for every cell and usable day. x has k x (inputs + masks) x tile x tile values,
    for the days day - k + 1 to day; y and mask have targets x tile x tile; core is 1 where the tile answers for a cell. What is missing,
    outside the grid or on a day without rows is 0. targets: value -> loss mask. Tiles are put together by one join on (day, tile) and
    one group-by on the draw, a group being a tile's window.
    """
    channels, out = [*inputs, *masks], list(targets)
    back = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("ago")
    asked = draws.select("draw", F.col("day").alias("of"), "oi", "oj", back).withColumn("day", F.date_sub("of", F.col("ago")))
    zero = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float"))
    loss = [F.coalesce(F.col(m).cast("int"), F.lit(0)) for m in targets.values()]
    values = cells.select("day", "i", "j", F.array(*[zero(c) for c in channels]).alias("v"), F.array(*[F.when(m == 1, zero(t)).otherwise(0.0).cast("float") for t, m in zip(out, loss, strict=True)]).alias("y"), F.array(*loss).alias("m"))
    placed = assign_tiles(values, ny, nx, tile, core).select("day", "oi", "oj", "ti", "tj", "v", "y", "m")
    # targets are those of the draw's own day
    rows = asked.join(placed, ["day", "oi", "oj"], "left").select("draw", "of", "oi", "oj", "ago", "ti", "tj", "v", F.when(F.col("ago") == 0, F.col("y")).alias("y"), F.when(F.col("ago") == 0, F.col("m")).alias("m"))
    cores = {**{("i", o): (a - o, b - o) for o, a, b in axis_plan(ny, tile, core)}, **{("j", o): (a - o, b - o) for o, a, b in axis_plan(nx, tile, core)}}

    def dense(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((k, len(channels), tile, tile), np.float32)
        y, m = (np.zeros((len(out), tile, tile), t) for t in (np.float32, np.int32))
        own = np.zeros((tile, tile), np.int32)
        (i0, i1), (j0, j1) = cores["i", key[2]], cores["j", key[3]]
        own[i0:i1, j0:j1] = 1
        part = part[part["ti"].notna()]
        if len(part):
            ti, tj, ago = (part[c].to_numpy(np.int64) for c in ("ti", "tj", "ago"))
            x[k - 1 - ago, :, ti, tj] = np.stack(part["v"].to_list())
            now = ago == 0
            if now.any():
                y[:, ti[now], tj[now]] = np.stack(part["y"][now].to_list()).T
                m[:, ti[now], tj[now]] = np.stack(part["m"][now].to_list()).T
        flat = {"x": x, "y": y, "mask": m, "core": own}
        return pd.DataFrame({"draw": [key[0]], "day": [key[1]], "oi": [key[2]], "oj": [key[3]], **{c: [a.reshape(-1)] for c, a in flat.items()}})

    return rows.groupBy("draw", "of", "oi", "oj").applyInPandas(dense, "draw long, day date, oi int, oj int, x array<float>, y array<float>, mask array<int>, core array<int>")


def dev_scores(draws: DataFrame, pairs: DataFrame, ny: int, nx: int, tile: int, core: int, depth: Column, widest: float = 6.0) -> DataFrame:
    """One row (n_draws, n, dev_nll, dev_rmse) over the cores of drawn tiles: the masked mean log loss, and the RMSE where `depth` holds.

    pairs (day, i, j, mean, log_sigma, truth, mask, ...). A tile that is drawn twice counts twice. log_sigma is kept within -widest and
    widest. Without any draw both scores are NULL; draws without a counted cell score 0. A cell lies in one core, so pairs meet draws by an
    equi-join on day and tile, and only sums are gathered.
    """
    own = {c: F.col(c) for c in pairs.columns}
    keyed = assign_tiles(pairs, ny, nx, tile, core).where(F.col("core") & (F.col("mask") == 1))
    times = draws.groupBy("day", "oi", "oj").agg(F.count(F.lit(1)).alias("_times"))
    log_sigma = F.greatest(F.lit(-widest), F.least(F.lit(widest), own["log_sigma"]))
    e = own["mean"] - own["truth"]
    found = keyed.join(times, ["day", "oi", "oj"]).select("_times", gaussian_nll(own["mean"], F.exp(log_sigma), own["truth"]).alias("_nll"), F.when(depth, F.col("_times")).alias("_at"), (e * e).alias("_se"))
    sums = found.agg(F.coalesce(F.sum("_times"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_nll") * F.col("_times")), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_at"), F.lit(0)).alias("_n"), F.coalesce(F.sum(F.col("_se") * F.col("_at")), F.lit(0.0)).alias("_e"))
    drawn = draws.agg(F.count(F.lit(1)).alias("n_draws"))
    some = F.col("n_draws") > 0
    scores = sums.join(drawn)  # a row each
    return scores.select("n_draws", "n", F.when(some, F.col("_s") / F.greatest("n", F.lit(1))).alias("dev_nll"), F.when(some, F.sqrt(F.col("_e") / F.greatest("_n", F.lit(1)))).alias("dev_rmse"))
