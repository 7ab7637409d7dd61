"""Mixing sources to target weights: random keys, a range sort within each source, prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, prefix_sums, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: The order of a source's rows: a random key, then what tells rows of one id apart.
ORDER = ["_key", "size", "_tie"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus target: words to take of each source.

    Sources in order of code points, null last, get the weights in turn. They divide share * (all sizes) by
    weight; none takes over epochs * source_size, and what is cut off goes to the others by weight. That is the
    water level at which the sources filled first, by cap over weight, are full: two prefix sums over one row per source.
    """
    ranked = prefix_sums(sizes.withColumn("one", F.lit(1).cast("long")), ["source"], ["one"])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", F.col("before_one").alias("rank"), turn.alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("cap"))
    capped = written(capped.withColumn("ratio", F.col("cap") / F.col("weight")), "mix-caps")
    filled = written(prefix_sums(capped, ["ratio", "rank"], ["cap", "weight"]), "mix-filled")
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, weight = share * (total[0] or 0), total[1] or 0.0
    level = (F.lit(float(budget)) - F.col("before_cap")) / (F.lit(weight) - F.col("before_weight"))
    open_ = filled.select("ratio", "rank", "weight", "cap", level.alias("level")).where(F.col("level") * F.col("weight") < F.col("cap"))
    first = open_.agg(F.min(F.struct("ratio", "rank", "level"))).first()[0]
    if first is None:
        return filled.select("source", "source_size", F.col("cap").alias("target"))
    full = (F.col("ratio") < F.lit(first[0])) | ((F.col("ratio") == F.lit(first[0])) & (F.col("rank") < F.lit(first[1])))
    target = F.when(full, F.col("cap")).otherwise(F.lit(first[2]) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def _figures(seed: int) -> tuple[Column, Column, Column]:
    """Random key, size and tie-breaker of a row (doc_id, text)."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return key, size, F.xxhash64("text")


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: int) -> DataFrame:
    """(doc_id, source, _key, size, _tie, source_size, target, times, rest): a row for every row of docs.

    times: whole epochs that the source gives; rest: words of its last, partial epoch that are left where the row stands.
    """
    figures = [c.alias(n) for c, n in zip(_figures(seed), ORDER, strict=True)]
    narrow = written(docs.select("doc_id", "source", *figures), "mix-sizes")
    sizes = written(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = source_targets(sizes, weights, share, epochs)
    starts = prefix_sums(sizes, ["source"], ["source_size"]).select("source", F.col("before_source_size").alias("_start"))
    per_source = written(targets.alias("t").join(starts.alias("s"), F.expr("t.source <=> s.source")).select("t.*", "s._start"), "mix-targets")
    placed = prefix_sums(narrow, ["source", *ORDER], ["size"])
    placed = placed.alias("p").join(per_source.alias("t"), F.expr("p.source <=> t.source"), "left").select("p.*", "t.source_size", "t.target", "t._start")
    budget = F.round("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), budget - times * F.col("source_size") - (F.col("before_size") - F.col("_start")))
    return placed.select("doc_id", "source", *ORDER, "source_size", "target", times.cast("long").alias("times"), rest.cast("long").alias("rest"))


def mix_to_weights(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: int = 42
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row for every row of docs; taken: words the mix takes.

    Documents stand in their source by a random key (MD5 of id and seed). A source takes whole epochs first; the
    rest of its budget is cut exactly, so the last document may be taken in part. Null texts have size 0 and are
    taken 0 times; null sources form one source, sorted last; rows that repeat an id stand next to each other, the
    smaller first, and ties in size are broken by a hash of the text; equal rows stand one after another. Source
    totals of 0 take nothing. Of a text, however long it is, only the number of words goes on. An empty table gives no
    rows. Other columns are not read. Same rows, same result, however they are partitioned.
    """
    taken = F.col("times") * F.col("size") + F.least("size", "rest")
    return _placed(docs, weights, share, epochs, seed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: int = 42
) -> DataFrame:
    """docs with the mix's figures in their rows; documents of which nothing is taken go.

    The cut of a source is one place in its order: rows before it are taken once more than those behind it. So one row
    per source decides about whole documents, which stay where they are. Rows equal in id and text that stand at the cut
    share what is left there evenly, rounded down. Columns named size, source_size, target or taken are replaced; all others stay,
    whatever their names. Nulls, other ties and empty tables: as in mix_to_weights.
    """
    place = lambda of="": F.struct(*[F.col(f"{of}{c}") for c in ORDER])
    placed = written(_placed(docs, weights, share, epochs, seed), "mix-placed")
    last = F.max(F.when((F.col("rest") > 0) & (F.col("size") > 0), place()))
    ends = written(placed.groupBy("source", "source_size", "target", "times").agg(last.alias("cut")), "mix-ends")
    at_cut = placed.alias("p").join(ends.alias("e"), F.expr("p.source <=> e.source")).where(place("p.") == F.col("e.cut"))
    left = at_cut.groupBy("p.source").agg(F.count(F.lit(1)).alias("rows"), F.max("p.rest").alias("left"))
    cuts = written(ends.alias("e").join(left.alias("l"), F.expr("e.source <=> l.source"), "left").select("e.*", "l.rows", "l.left"), "mix-cuts")
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    mine = docs.select(F.struct(*own).alias("own"), F.col("source").alias("_of"), *[c.alias(n) for c, n in zip(_figures(seed), ORDER, strict=True)])
    joined = mine.alias("d").join(cuts.alias("c"), F.expr("d._of <=> c.source"))  # one row per source: Catalyst broadcasts it
    once = F.when(place("d.") < F.col("c.cut"), F.col("d.size")).when(place("d.") == F.col("c.cut"), F.least(F.col("d.size"), F.floor(F.col("c.left") / F.col("c.rows")))).otherwise(0)
    taken = (F.col("c.times") * F.col("d.size") + once).cast("long")
    found = joined.select(*[F.col(f"d.own.`{c}`").alias(c) for c in own], F.col("d.size").alias("size"), F.col("c.source_size").alias("source_size"), F.col("c.target").alias("target"), taken.alias("taken"))
    return found.where("taken > 0")
