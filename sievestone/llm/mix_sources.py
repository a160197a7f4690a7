"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent from 0 (all sources
alike) to 1 (as they come), normalised.  The exponent is bisected to the evenest mix that keeps a
repetition limit or that has a target entropy.  The weights are then realised: each source is
passed ``epochs`` times, every pass a permutation of its blocks of documents and of the documents
within a block, and the last pass stops when its share of the budget is spent.

Only tables of one row per source, and of one row per block of a source, are ranked; the texts
themselves are never shuffled.  A pass order is (epoch, block_order, doc_order), all hashes of
identifiers, so any order can be drawn again.

Defined cases: a null text has no tokens; a null source is a source of its own; sources without
tokens keep their documents once; one source, or sources of equal size, give one pass of each;
repeated rows share a place and are kept or left together; an empty table gives no rows; further
columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import table, written

#: Levels of bisection that one job evaluates together, and jobs: 40 binary places in all.
LEVELS, JOBS = 5, 8
BLOCK_TOKENS = 1_000_000


def token_estimate(text: Column) -> Column:
    """Tokens as a quarter of the UTF-8 bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def bisect_exponent(totals: DataFrame, max_repeat: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The least exponent in [0, 1] that keeps the limits; 1 if none does.

    totals: (source, tokens).  Each job evaluates the 31 inner points of five levels of bisection
    in one aggregate over sources and brings back one row per point.
    """
    totals = totals.where("tokens > 0")
    least, most, everything = totals.agg(F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    if least is None:
        return 1.0
    share = F.log(F.col("tokens") / float(everything))
    low, high = 0.0, 1.0
    ends = [0.0, 1.0]
    for job in range(JOBS):
        inner = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
        points = [*inner, *ends] if job == 0 else inner
        power = F.exp(F.col("x") * share)
        rows = (
            totals.withColumn("x", F.explode(F.array(*(F.lit(p) for p in points))))
            .groupBy("x")
            .agg(F.sum(power).alias("z"), F.sum(power * share).alias("zs"))
            .collect()
        )
        kept = {r.x: _keeps(r.x, r.z, r.zs, least / everything, most / everything, everything, max_repeat, target_entropy, budget) for r in rows}
        if job == 0:
            if kept[0.0]:
                return 0.0
            if not kept[1.0]:
                return 1.0
        for _ in range(LEVELS):
            middle = (low + high) / 2
            near = min(inner, key=lambda p: abs(p - middle))
            low, high = (low, near) if kept[near] else (near, high)
    return high


def _keeps(x: float, z: float, zs: float, least: float, most: float, everything: float, max_repeat: float | None, target_entropy: float | None, budget: float | None) -> bool:
    epochs = (least / most) ** (x - 1) if budget is None else budget / everything * least ** (x - 1) / z
    entropy = math.log(z) - x * zs / z
    return (max_repeat is None or epochs <= max_repeat) and (target_entropy is None or entropy <= target_entropy)


def plan_mix(sized: DataFrame, max_repeat: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """One row per source: exponent, weight, epochs, and where the last pass ends.

    sized: (doc_id, source, n_tokens), a table.  Without a budget every source is passed at least
    once, so that no document is lost.
    """
    totals = written(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "totals")
    x = bisect_exponent(totals, max_repeat, target_entropy, budget)
    full = totals.where("tokens > 0")
    power = F.exp(F.lit(x) * F.log(F.col("tokens").cast("double")))
    z, most = full.agg(F.sum(power), F.max("tokens")).first() if full.limit(1).count() else (1.0, 1)
    weight = F.when(F.col("tokens") > 0, power / z).otherwise(0.0)
    epochs = F.exp(F.lit(x - 1) * F.log(F.col("tokens") / float(most))) if budget is None else budget * weight / F.col("tokens")
    weights = totals.select(
        "source", "tokens", F.lit(x).alias("exponent"), weight.alias("weight"),
        F.when(F.col("tokens") > 0, F.round(epochs, 9)).otherwise(1.0).alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"),
    )
    weights = written(weights.withColumns({"last": F.floor("epochs").cast("int"), "quota": F.col("tokens") * (F.col("epochs") - F.floor("epochs"))}), "weights")
    last = _placed(_with_source(sized, weights).withColumn("epoch", F.col("last")).where("quota > 0"), seed).select("source", "quota", "n_tokens", "block_order", "doc_order")
    ordered = lambda by: Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda by: F.coalesce(F.sum("n").over(ordered(by)), F.lit(0))
    blocks = last.groupBy("source", "quota", "block_order").agg(F.sum("n_tokens").alias("n")).withColumn("before", before("block_order"))
    ends = blocks.where("before < quota").groupBy("source", "quota").agg(F.max_by(F.struct("block_order", "before"), "block_order").alias("e"))
    ends = written(ends.select(F.col("source").alias("s"), F.col("e.block_order").alias("end_block"), (F.col("quota") - F.col("e.before")).alias("rest")), "ends")
    inside = last.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block_order") == F.col("end_block")))
    inside = inside.groupBy("source", "end_block", "rest", "doc_order").agg(F.sum("n_tokens").alias("n")).withColumn("before", before("doc_order"))
    cuts = inside.where("before < rest").groupBy(F.col("source").alias("s"), "end_block").agg(F.max("doc_order").alias("end_doc"))
    return written(weights.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")


def _with_source(docs: DataFrame, weights: DataFrame) -> DataFrame:
    return docs.join(weights.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Adds block_order and doc_order; rows have doc_id, source, blocks and epoch."""
    block = F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id"), F.col("blocks"))
    return rows.withColumns({"block_order": F.xxhash64(F.lit(seed + 1), "epoch", "source", block), "doc_order": F.xxhash64(F.lit(seed + 2), "epoch", "doc_id")})


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeat: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with ``mix``: a struct of n_tokens,
    exponent, weight, epochs, epoch, block_order and doc_order.  Its name replaces a column ``mix``."""
    tokens = token_estimate(F.col(text_col))
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("n_tokens")), "sized")
    plan = plan_mix(sized, max_repeat, target_entropy, budget, block_tokens, seed)
    names = [c for c in docs.columns if c != "mix"]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("n_tokens"))
    rows = _with_source(held, plan).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = _placed(rows, seed)
    in_last = (F.col("block_order") < F.col("end_block")) | ((F.col("block_order") == F.col("end_block")) & (F.col("doc_order") <= F.col("end_doc")))
    rows = rows.where((F.col("epoch") < F.col("last")) | ((F.col("quota") > 0) & in_last))
    return rows.select("row.*", F.struct("n_tokens", "exponent", "weight", "epochs", "epoch", "block_order", "doc_order").alias("mix"))


def op9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "mix.*")
