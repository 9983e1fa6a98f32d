"""Interaction audit of filters: what each filter removes in every order of application.

One pass turns documents into mask cells: per part, the set of filters that a document fails (a bit
each) with counts of documents, good and toxic ones. All orders are then computed from the cells.
A recursive common table expression starts from the masks that occur, extends each filter prefix by
every unused letter, carries the bits applied so far, and each level emits that step's state of each
mask: kept, removed here, or redundant. The recursion has at most 32 x 326 rows whatever the data
and its parts (hence it is broadcast); joined to the cells by mask it gives the counts of every prefix,
and the orders share their prefixes.

Duplicates are found by sha256 of the text. Copies are pre-aggregated before each shuffle, so a
group of copies of any size is a few rows a task.

Null texts count as empty. A null lang is the part ''. A document with a null doc_id is no duplicate
and makes none; rows with the least doc_id of a text are no duplicates, however often repeated.
Repeated label rows count a document once (it is good or toxic if any says so). An empty table has
no parts and gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import written

FILTERS = "ABCDE"
SPACE = "[\\x20\\x09-\\x0D]+"
DUPLICATE = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(t, F.lit("[A-Z]")) > 10 * F.length(t),
             t.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails[1:], 1)), fails[0].cast("int"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"),
                       F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    ids = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("k"))
    some = F.col("doc_id").isNotNull()
    groups = ids.groupBy(*kind).agg(F.sum("k").alias("n"), F.sum(F.when(some, 0).otherwise(F.col("k"))).alias("nameless"),
                                    F.min(F.when(some, F.struct("doc_id", "k"))).alias("least"))
    # copies have one mask: a text has a row per part and label here, however many copies
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    single = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.k")).otherwise(0)
    split = F.explode(F.array(F.struct("mask", single.alias("n")),
                              F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - single).alias("n"))))
    flat = groups.withColumn("first", first).select("part", split.alias("s"), "good", "toxic").select("part", "s.mask", "s.n", "good", "toxic")
    return flat.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


WALK = """
WITH RECURSIVE walk(prefix, bit, before, applied, step, mask, kept, removed, redundant) AS (
  SELECT '', 0, 0, 0, 0, mask, 1, 0, 0 FROM {masks}
  UNION ALL
  SELECT concat(prefix, l.name), l.bit, applied, applied | l.bit, step + 1, mask,
         CAST(mask & (applied | l.bit) = 0 AS INT), CAST(mask & l.bit <> 0 AND mask & applied = 0 AS INT),
         CAST(mask & l.bit <> 0 AND mask & applied <> 0 AS INT)
  FROM (SELECT *, explode(filter(array(%s), x -> applied & x.bit = 0)) AS l FROM walk WHERE step < %d)
)
SELECT prefix, step, bit, mask, kept, removed, redundant FROM walk WHERE step > 0
"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step; see the module's text."""
    spark = docs.sparkSession
    cells = written(mask_cells(docs, labels), "mask-cells")
    letters = ", ".join(f"struct('{f}' AS name, {1 << k} AS bit)" for k, f in enumerate(FILTERS))
    walk = spark.sql(WALK % (letters, len(FILTERS)), masks=cells.select("mask").distinct())
    n = F.col("n")
    steps = cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "bit").agg(
        F.sum(n * F.col("kept")).alias("kept"), F.sum(n * F.col("removed")).alias("removed"),
        F.sum(n * F.col("redundant")).alias("redundant"),
        F.sum(F.when(F.col("mask") == F.col("bit"), n).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("good") * F.col("removed")).alias("good_lost"),
        F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"))
    # a prefix of k letters is shared by the orders of the letters left: (letters - k)! of them
    shares = F.factorial(F.lit(len(FILTERS)) - F.col("step"))
    shapley = steps.groupBy("part", "bit").agg(F.sum(F.col("removed") * shares).alias("shapley"))
    orders = walk.filter(F.col("step") == len(FILTERS)).select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substr(filter_order, 1, step)"))
    return F.broadcast(orders).join(steps.join(shapley, ["part", "bit"]).drop("step"), "prefix").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost",
                                                    "toxic_lost", "shapley")])
