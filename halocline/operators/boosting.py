"""Gradient-boosted trees for squared error: histograms by one group-by a level, the leaf with the best gain split first."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Steps of a unit in which targets, gradients and leaf values are whole numbers: their sums are the same in any order.
UNIT = 1 << 20
#: Trees whose predictions are worked out in one projection.
TOGETHER = 8
MIN_DATA_IN_LEAF = 20


@dataclass
class Node:
    """A leaf has a value; an inner node sends rows whose feature's bin is at most `bin` to the left."""

    value: int = 0
    feature: int = -1
    bin: int = -1
    left: Node | None = None
    right: Node | None = None

    def column(self, goes_left, leaf=lambda n: F.lit(n.value)) -> Column:
        """The leaf that a row falls in. goes_left(feature, bin): a condition; rows where it is NULL go right."""
        if self.left is None:
            return leaf(self)
        return F.when(goes_left(self.feature, self.bin), self.left.column(goes_left, leaf)).otherwise(self.right.column(goes_left, leaf))

    def leaves(self) -> int:
        return 1 if self.left is None else self.left.leaves() + self.right.leaves()


@dataclass
class Booster:
    """start + the sum of all trees' values, in steps of 1 / UNIT. cuts: each feature's upper bounds of its bins but the last."""

    features: list[str]
    cuts: list[list[float]]
    start: int
    trees: list[Node] = field(default_factory=list)

    def check(self) -> None:
        """Every booster must have grown a tree with a split."""
        if not any(t.leaves() > 1 for t in self.trees):
            raise ValueError("a booster without splits")

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """rows plus the prediction, from the features' values; a few trees a projection. A missing value goes right."""
        left = lambda f, b: F.col(self.features[f]) <= F.lit(self.cuts[f][b])
        out = rows.withColumn(name, F.lit(self.start).cast("long"))
        for k in range(0, len(self.trees), TOGETHER):
            out = out.withColumn(name, sum((t.column(left) for t in self.trees[k : k + TOGETHER]), F.col(name)))
        return out.withColumn(name, F.col(name) / float(UNIT))


def even_cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Bins of equal width between each feature's smallest and largest value; one aggregate."""
    ends = rows.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in features for n, f in (("low", F.min), ("high", F.max))]).first()
    return [[low + (high - low) * k / bins for k in range(1, bins)] if low is not None else [] for low, high in ((ends[f"{c}_low"], ends[f"{c}_high"]) for c in features)]


def quantile_cuts(rows: DataFrame, features: list[str], bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """Bins of about as many rows each, from mergeable sketches; bins that fall together become one."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(c) for c in features]).first()
    return [sorted(set(found[c] or [])) for c in features]


def bin_of(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below x; a missing value is in the last bin."""
    if not cuts:
        return F.lit(0)
    return F.when(x.isNull(), len(cuts)).otherwise(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x)))


@dataclass
class _Found:
    """What is known of a node: gradient sum, rows, and its best split (gain, feature, bin; gain 0 if none is allowed)."""

    g: int
    n: int
    gain: float
    feature: int
    bin: int


def best_splits(rows: DataFrame, node: Column, least: int) -> dict[int, _Found]:
    """rows (bins array<int>, g) -> the best split of each node (a number, or NULL for rows that are not asked for).

    A row per node, feature and bin is summed on the map side; each feature's bins are then added up from the left. Only one row a node comes to the
    driver. Ties go to the first feature, then the lowest bin.
    """
    each = rows.select(node.alias("node"), "g", F.posexplode("bins").alias("f", "bin")).where("node is not null")
    sums = each.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("node", "f")  # as many rows as bins
    up_to = of.orderBy("bin")
    cut = sums.select("node", "f", "bin", F.sum("g").over(up_to).alias("gl"), F.sum("n").over(up_to).alias("nl"), F.sum("g").over(of).alias("g"), F.sum("n").over(of).alias("n"))
    square = lambda g, n: g.cast("double") * g.cast("double") / n
    gl, nl, g, n = (F.col(c) for c in ("gl", "nl", "g", "n"))
    gain = F.when((nl >= least) & (n - nl >= least), square(gl, nl) + square(g - gl, F.nullif(n - nl, F.lit(0))) - square(g, n))
    best = cut.groupBy("node").agg(F.max("g").alias("g"), F.max("n").alias("n"), F.max(F.struct(F.coalesce(gain, F.lit(0.0)).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("b"))
    return {r["node"]: _Found(r.g, r.n, max(r.b.gain, 0.0), -r.b.f, -r.b.bin) for r in best.collect()}


def _grown(known: dict[str, _Found], leaves: int) -> tuple[dict[str, int], list[str]]:
    """(paths of the leaves -> number, leaves whose best split is not known yet) of the tree that the known splits give.

    Best first: of the leaves the one with the greatest gain is split, ties by number; the left part keeps the number, the right
    one gets the next.
    """
    tree = {"": 0}
    while len(tree) < leaves:
        unknown = [p for p in tree if p not in known]
        if unknown:
            return tree, unknown
        path = min(tree, key=lambda p: (-known[p].gain, tree[p]))
        if known[path].gain <= 0:
            break
        number = tree.pop(path)
        tree[f"{path}L"], tree[f"{path}R"] = number, len(tree) + 1
    return tree, []


def _node(known: dict[str, _Found], path: str, stops: dict[str, int]) -> Node:
    if path in stops or path not in known or known[path].gain <= 0:
        return Node(value=stops.get(path, -1))
    own = known[path]
    return Node(feature=own.feature, bin=own.bin, left=_node(known, f"{path}L", stops), right=_node(known, f"{path}R", stops))


def grow_tree(rows: DataFrame, leaves: int, rate: float, least: int) -> Node:
    """One tree on rows (bins array<int>, g: gradients in steps of 1 / UNIT).

    A round asks for the splits of all leaves that lack one and of the parts of all others, so that rounds are as many as levels, not
    as splits; which leaves are split in the end is decided as if one had been split at a time.
    """
    known: dict[str, _Found] = {}
    left = lambda f, b: F.get("bins", F.lit(f)) <= b
    while True:
        tree, unknown = _grown(known, leaves)
        if not unknown:
            break
        asked = {p: k for k, p in enumerate([*unknown, *(p + side for p in tree if p in known and known[p].gain > 0 for side in "LR" if p + side not in known)])}
        node = _node(known, "", asked).column(left, lambda n: F.lit(n.value if n.value >= 0 else None).cast("int"))
        found = best_splits(rows, node, least)
        known |= {p: found[k] for p, k in asked.items()}
    # leaves of a finished tree may be unknown: their sums are those of their parents' parts
    missing = {p: k for k, p in enumerate(p for p in tree if p not in known)}
    if missing:
        node = _node(known, "", missing | {p: -1 for p in tree if p in known}).column(left, lambda n: F.lit(n.value if n.value >= 0 else None).cast("int"))
        sums = rows.select(node.alias("node"), "g").where("node is not null").groupBy("node").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).collect()  # a row per leaf
        by = {r["node"]: _Found(r.g, r.n, 0.0, -1, -1) for r in sums}
        known |= {p: by[k] for p, k in missing.items()}
    return _node(known, "", {p: math.floor(-known[p].g * rate / known[p].n + 0.5) for p in tree})


def fit_booster(rows: DataFrame, target: str, features: list[str], cuts: list[list[float]], trees: int = 20, leaves: int = 63, rate: float = 0.05, least: int = MIN_DATA_IN_LEAF) -> Booster:
    """Boosted trees for rows whose target is there; each tree has at most `leaves` leaves and starts from the mean.

    A leaf keeps at least min(least, a quarter of the rows) rows. Targets are rounded to 1 / UNIT. Rows become bins and a gradient once; each tree then
    reads these narrow rows a few times. No rows: a booster that predicts 0, which check() rejects.
    """
    bins = F.array(*[bin_of(F.col(f).cast("double"), c) for f, c in zip(features, cuts, strict=True)])
    y = F.round(F.col(target).cast("double") * UNIT).cast("long")
    own = written(rows.where(F.col(target).isNotNull()).select(bins.alias("bins"), y.alias("y")), "binned")
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    booster = Booster(features, cuts, math.floor(total / n + 0.5) if n else 0)
    if not n:
        return booster
    least = min(least, max(1, n // 4))
    own = own.select("bins", (F.lit(booster.start) - F.col("y")).alias("g"))
    for k in range(trees):
        tree = grow_tree(own, leaves, rate, least)
        booster.trees.append(tree)
        own = own.withColumn("g", F.col("g") + tree.column(lambda f, b: F.get("bins", F.lit(f)) <= b))
        if k % TOGETHER == TOGETHER - 1:
            own = written(own, "gradients")
    return booster
