"""Interaction of filters: what each would remove at each place of every order, by part.

A row's failures are a mask of one bit per filter.  Rows are counted by (part, mask) with those of
good and of toxic rows, so at most two to the number of filters cells of a part remain, however
large it is.  Cells are then unpivoted against the steps of all orders; a running bit-or over the
steps before tells which filters a cell has failed earlier, conditional sums over the cells give the
step's figures, and a window over all orders and steps of a filter gives its share.

The last filter asks for a text that a smaller identifier has.  Texts are compared by SHA-256: rows
are first counted by identifier and text, then the least identifier of a text comes from its counts by
part and labels, of which a text has few however many copies there are.

Defined cases: a null text is empty, and equal to one; a null part is the empty string's; words,
distinct words and characters are counted in whole texts of any length, one text at a time;
repeated rows count each, and do not make each other fail, as no identifier is smaller; a row with a
null identifier has no smaller one and is none, so it never fails as a copy, and has no labels; an
identifier with several label rows is good or toxic if any says so; rows without labels are neither;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import table

#: The filters in the order of their bits, and the limits of the first three.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
COPY = 1 << FILTERS.index("E")
_COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """The bits of the filters that a text fails by itself."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # evaluated once: the words of a text are not kept
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    few = F.transform(F.array(counts), lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c["d"] < LEAST_DISTINCT * c["n"], 2).otherwise(0))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return few + F.when(100 * capitals > MOST_CAPITALS * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good and toxic: rows of each part that fail exactly the mask's filters."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("print"), failures(text).alias("mask"))
    counted = rows.groupBy("id", "part", "print", "mask").agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("i")).agg(is_one("quality").alias("is_good"), is_one("toxic").alias("is_toxic"))
    # rows without an identifier have no labels; by that alone they would meet in one task of the join
    key = F.coalesce("id", F.xxhash64("print", "part"))
    named = counted.withColumn("key", key).join(known, (F.col("key") == F.col("i")) & F.col("id").isNotNull(), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    named = named.select("id", "part", "print", "mask", "n", flag("is_good"), flag("is_toxic"), F.col("id").isNull().alias("unnamed"))
    # of the rows of a text that agree in all else: how many, and how many of them have the least identifier
    held = named.groupBy("print", "part", "mask", "is_good", "is_toxic", "unnamed").agg(F.min("id").alias("id"), F.min_by("n", "id").alias("first"), F.sum("n").alias("n"))
    # a text has a row per part, and for each kind of labels, however many copies there are
    held = held.withColumn("least", F.min("id").over(Window.partitionBy("print")))
    fresh = F.when(F.col("unnamed"), F.col("n")).when(F.col("id") == F.col("least"), F.col("first")).otherwise(0)
    kinds = F.explode(F.array(F.struct(F.col("mask").alias("mask"), fresh.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - fresh).alias("n"))))
    held = held.select("part", "is_good", "is_toxic", kinds.alias("c")).select("part", "c.mask", "c.n", "is_good", "is_toxic").where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return held.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from the masks' counts."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    orders = ["".join(p) for p in permutations(filters)]
    literal = F.array(*(F.lit(o) for o in orders))
    bits = F.map_from_arrays(F.array(*(F.lit(f) for f in bit)), F.array(*(F.lit(b) for b in bit.values())))
    long = cells.select("part", "mask", *_COUNTS, F.explode(literal).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where(F.col("filter") != "")
    long = long.withColumns({"step": F.col("at") + 1, "bit": F.element_at(bits, F.col("filter"))})
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, failed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda test, c="n": F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~failed).alias("kept"), total(fails & ~failed).alias("removed"), total(fails & failed).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~failed, "good").alias("good_lost"), total(fails & ~failed, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_ORDERS = ", ".join("('" + "".join(p) + "')" for p in permutations(FILTERS))

# each document at each step of each order, by the letters that it fails
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
    f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN least < doc_id THEN 'E' ELSE '' END) AS fails FROM w),
    g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1) l ON f.doc_id = l.doc_id GROUP BY 1, 2),
    o AS (SELECT o AS filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM (VALUES {_ORDERS}) t(o)),
    s AS (SELECT g.*, filter_order, step, substr(filter_order, step, 1) AS filter, strpos(fails, substr(filter_order, step, 1)) > 0 AS now, translate(fails, substr(filter_order, 1, step - 1), '') != fails AS gone FROM g, o),
    r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (now AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = filter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (now AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT gone), 0)::BIGINT AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
