"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in
DataFrame functions only.

Targets. Each source's share of the wanted words is its weight's, but no more than ``epochs``
times its size; the excess is shared again by weight (water-filling, solved in closed form).

Layout. A source's documents are permuted by hash and laid end to end, once per epoch, on a line
of words. The mix takes the line up to the source's target: the last document drawn is cut. The
line is divided into blocks of ``block_words``; a document belongs to the block it begins in, and
a source's quota is an exact number of blocks.

Splitting tree. The blocks go to output shards: a node of the tree holds the block count of each
source and a range of shards; its left child's counts are a multivariate-hypergeometric draw (one
hypergeometric draw per source, each from what is left), the right child gets the rest. At the
leaves every shard has exact quotas, which take disjoint runs of each source's permuted blocks;
within a shard the documents are ordered by hash. A draw costs the same whatever the counts, and
blocks are permuted by a keyed bijection of their numbers, so no source's blocks are listed or sorted
in one place. A node is a row with a count for each source, so sources are taken to be few beside
documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import WORDS, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 1 << 15
SHARD_WORDS = 1 << 22
SEED = "mix-1"


def _uniform(*cols) -> Column:
    """(0, 1), from a hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(sk, source, source_size, target, quota) from (sk, source, source_size); one row per source.
    Weights repeat over the sources in code point order, null last. The windows run over the
    sources, not over documents."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    everything = Window.partitionBy()
    ranked = (sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
              .withColumn("cap", F.col("source_size").cast("double") * epochs))
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    # with the k sources of least cap per weight at their caps the level is
    # (wanted - their caps) / (weights of the others); the true level is the greatest of these
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), zero))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)))
    return (ranked.withColumn("at", level).withColumn("level", F.max("at").over(everything))
            .withColumn("target", F.least("cap", F.col("level") * F.col("w")))
            .withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
            .select("sk", "source", "source_size", "target", "quota"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_factorial(n: Column) -> Column:
    return _let(n.cast("double"), _stirling)


def _stirling(n: Column) -> Column:
    x = F.greatest(n, F.lit(1.0))
    value = ((x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x)
             - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))
    return F.when(n < 2, F.lit(0.0)).otherwise(value)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


SMALL_DRAW = 64         # up to so many possible outcomes the distribution is added up
TRIES = 64              # points of a rejection draw; each fails with a chance below 0.35
SWAPS = 48              # rounds of the permutation of blocks


def _inverse(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Inverse distribution function at ``u``, for few outcomes."""
    given = F.struct(total.alias("n"), good.alias("k"), drawn.alias("m"), u.alias("u"),
                     _log_choose(total, drawn).alias("rest"))

    def of(g):
        lo, hi = F.greatest(F.lit(0).cast("long"), g["m"] + g["k"] - g["n"]), F.least(g["m"], g["k"])
        start = F.struct(F.lit(0.0).alias("p"), hi.alias("x"), F.lit(False).alias("done"))

        def step(s, x):
            p = s["p"] + F.exp(_log_choose(g["k"], x) + _log_choose(g["n"] - g["k"], g["m"] - x) - g["rest"])
            return _let(p, lambda p: F.struct(p.alias("p"), F.when(~s["done"] & (p >= g["u"]), x).otherwise(s["x"]).alias("x"),
                                              (s["done"] | (p >= g["u"])).alias("done")))

        return F.aggregate(F.sequence(lo, F.least(hi, lo + SMALL_DRAW)), start, step, lambda s: s["x"])

    return _let(given, of)


def _rejection(total: Column, good: Column, drawn: Column, key: list[Column]) -> Column:
    """Ratio-of-uniforms draw for many outcomes: points are kept that lie under the square root of
    the distribution's shape, which two uniforms and a comparison of factorials decide. Drawn for
    the rarer kind of item and the smaller part; should all tries fail, the mode is taken."""
    n = total.cast("double")
    k, m = (F.least(c, total - c).cast("double") for c in (good, drawn))

    def height(g, x):
        return -(_log_factorial(x) + _log_factorial(g["k"] - x) + _log_factorial(g["m"] - x)
                 + _log_factorial(g["n"] - g["k"] - g["m"] + x))

    def shaped(g):
        mean = g["m"] * g["k"] / g["n"]
        spread = F.sqrt(mean * (1 - g["k"] / g["n"]) * (g["n"] - g["m"]) / (g["n"] - 1) + 0.5)
        # the enclosing rectangle: 2 sqrt(2/e) spreads and half a step of each side
        width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
        mode = F.floor((g["m"] + 1) * (g["k"] + 1) / (g["n"] + 2)).cast("double")
        return F.struct(g["n"].alias("n"), g["k"].alias("k"), g["m"].alias("m"), (mean + 0.5).alias("middle"),
                        width.alias("width"), mode.alias("mode"), height(g, mode).alias("top"), g["key"].alias("key"))

    def found(g):
        def attempt(s, r):
            def tried(p):
                fits = (p["x"] >= 0) & (p["x"] <= F.least(g["m"], g["k"])) & (2 * F.log(p["u"]) <= height(g, p["x"]) - g["top"])
                return F.when(fits, F.struct(p["x"].alias("x"), F.lit(True).alias("done"))).otherwise(s)

            u, v = _uniform(g["key"], r, F.lit("u")), _uniform(g["key"], r, F.lit("v"))
            point = _let(F.struct(u.alias("u"), v.alias("v")), lambda w: F.struct(
                w["u"].alias("u"), F.floor(g["middle"] + g["width"] * (w["v"] - 0.5) / w["u"]).cast("double").alias("x")))
            return F.when(s["done"], s).otherwise(_let(point, tried))

        start = F.struct(g["mode"].alias("x"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), start, attempt, lambda s: s["x"].cast("long"))

    given = F.struct(n.alias("n"), k.alias("k"), m.alias("m"), F.concat_ws(":", *key).alias("key"))
    x = _let(_let(given, shaped), found)
    few = F.least(drawn, total - drawn)                       # items in the smaller part
    return _let(F.when(good * 2 > total, few - x).otherwise(x), lambda y: F.when(drawn * 2 > total, good - y).otherwise(y))


def hypergeometric(total: Column, good: Column, drawn: Column, key: list[Column]) -> Column:
    """How many of ``drawn`` items out of ``total`` are among its ``good`` ones: a draw that ``key``
    decides. Its work and memory don't grow with the counts."""
    given = F.struct(total.alias("n"), good.alias("k"), drawn.alias("m"))

    def of(g):
        n, k, m = g["n"], g["k"], g["m"]
        lo, hi = F.greatest(F.lit(0).cast("long"), m + k - n), F.least(m, k)
        return (F.when(hi <= lo, lo).when(hi - lo <= SMALL_DRAW, _inverse(n, k, m, _uniform(*key)))
                .otherwise(_rejection(n, k, m, key)))

    return _let(given, of)


def permuted(at: Column, n: Column, key: Column) -> Column:
    """Place of ``at`` in a keyed permutation of 0..n-1, n of any size: in each round x and k - x
    (modulo n, for a k of the round) are swapped if a bit of the greater of them says so."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), at.cast("long"), swap)


def split_quotas(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(shard, sk, blocks): block quotas (sk, blocks) of the sources dealt to ``shards`` shards by
    the splitting tree. Each source's counts add up exactly; shards are equal in size to a block.
    Each level is written: the expression of a draw is long, and a plan that nests one per level takes
    the driver more memory the more shards there are."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("sk", F.col("blocks").cast("long").alias("k")))).alias("ks")) \
        .select(F.lit(0).alias("lo"), F.lit(shards).alias("n"), "ks")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        zero = F.lit(0).cast("long")
        total = F.aggregate("ks", zero, lambda s, x: s + x["k"])
        left = F.floor(F.col("n") / 2).cast("int")
        start = F.struct(F.col("total").alias("total"),
                         F.floor(F.col("total") * F.col("left") / F.col("n")).cast("long").alias("left"),
                         F.array().cast("array<bigint>").alias("out"))

        def fold(s, x):
            got = hypergeometric(s["total"], x["k"], s["left"], [F.lit(seed), F.col("lo"), F.col("n"), x["sk"]])
            return F.struct((s["total"] - x["k"]).alias("total"), (s["left"] - got).alias("left"),
                            F.concat(s["out"], F.array(got)).alias("out"))

        node = (node.withColumn("total", total).withColumn("left", left)
                .withColumn("got", F.aggregate("ks", start, fold, lambda s: s["out"])))
        pick = lambda f: F.zip_with("ks", "got", f)
        children = F.array(
            F.struct(F.col("lo"), F.col("left").alias("n"),
                     pick(lambda x, g: F.struct(x["sk"].alias("sk"), g.alias("k"))).alias("ks")),
            F.struct((F.col("lo") + F.col("left")).alias("lo"), (F.col("n") - F.col("left")).alias("n"),
                     pick(lambda x, g: F.struct(x["sk"].alias("sk"), (x["k"] - g).alias("k"))).alias("ks")))
        same = F.array(F.struct("lo", "n", "ks"))
        node = written(node.select(F.explode(F.when(F.col("n") > 1, children).otherwise(same)).alias("c")).select("c.*"), "mix-nodes")
    return node.select(F.col("lo").alias("shard"), F.explode("ks").alias("x")).select(
        "shard", F.col("x.sk").alias("sk"), F.col("x.k").alias("blocks"))


def layout(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
           weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: rid (hash of the whole row), id, source, sk, size (words), start
    (place on its source's line), source_size, target, quota.

    Null texts have size 0; a null source is a source of its own. Rows with equal ids are laid one
    after another. The running sums go by (source, leading hex digits of the hash): the sums of the
    groups are added up first, so no source is gathered, whatever its share of the rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    sk = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source)))
    rows = written(docs.select(
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("rid"), F.col(id_col).alias("id"),
        F.col(source).alias("source"), sk.alias("sk"), size.alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("order"))
        .withColumn("part", F.substring("order", 1, 3)), "mix-rows")
    parts = rows.groupBy("sk", "part").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    by_source = parts.groupBy("sk").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goals = targets(by_source, weights, share, epochs)
    run = Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("sk", "part", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sk", "part").orderBy("order", "id", "size", "rid").rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["sk", "part"]).join(F.broadcast(goals.drop("source")), "sk")
            .select("rid", "id", "source", "sk", "size", (F.col("offset") + F.col("inside")).alias("start"),
                    "source_size", "target", "quota", "order"))


def draws(placed: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
          epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(shard, place, sk, block, epoch, rid, id, size, start, words) from ``layout``: each drawn
    document, the shard and the sort key within it, and how many of its first words are taken."""
    goals = placed.groupBy("sk").agg(F.max("quota").alias("quota"))
    quotas = goals.select("sk", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks")).filter("blocks > 0")
    total = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, math.ceil(total * block_words / shard_words))
    # written by themselves: the tree's expressions are long, and a plan over documents that holds
    # them is optimised anew at each of its stages
    quotas = written(quotas, "mix-quotas")
    dealt = written(split_quotas(quotas, shards, seed).filter("blocks > 0"), "mix-tree")
    run = Window.partitionBy("sk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    turn = (dealt.withColumn("lo", F.coalesce(F.sum("blocks").over(run), F.lit(0)))
            .select("sk", "shard", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("blocks") - 1)).alias("turn")))
    every = (quotas.select("sk", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
             .withColumn("turn", permuted(F.col("block"), F.col("blocks"), F.xxhash64(F.lit(seed), "sk"))))
    where = written(every.join(turn, ["sk", "turn"]).select("sk", "block", "shard"), "mix-blocks")
    taken = (placed.filter("size > 0")
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
             .withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start"))
             .filter("begin < quota")
             .withColumn("words", F.least("size", F.col("quota") - F.col("begin")))
             .withColumn("block", F.floor(F.col("begin") / block_words).cast("long")))
    return taken.join(where, ["sk", "block"]).select(
        "shard", F.md5(F.concat_ws(":", F.lit(seed), "shard", "epoch", "order", "rid")).alias("place"),
        "sk", "block", "epoch", "rid", "id", "size", "start", "words")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **kw) -> DataFrame:
    """The mixed documents: every draw as a row of ``docs`` (a document drawn twice is two rows; a
    cut one keeps its first words, joined by a space), with shard and place (sort key within the
    shard) added. Documents beyond their source's target and those without words are not drawn. An
    empty table gives no rows. Columns of ``docs`` named shard or place are replaced."""
    base = docs.drop("shard", "place")
    placed = written(layout(base, text, source, id_col, **kw), "mix-layout")
    drawn = draws(placed).select("rid", "shard", "place", "size", "words")
    keyed = base.withColumn("__rid", F.xxhash64(*[F.col(f"`{c}`") for c in base.columns]))
    once = keyed.dropDuplicates(["__rid"])
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)), 1, F.col("words").cast("int")), " ")
    return once.join(drawn, once["__rid"] == drawn["rid"]).select(
        *[F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(text)).alias(c) if c == text
          else F.col(f"`{c}`") for c in base.columns], "shard", "place")


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for each row of ``docs``, from the draws;
    ``shards`` lists the output shard of each draw, in ascending order, and is empty without one."""
    placed = written(layout(docs), "mix-layout")
    taken = draws(placed).groupBy("sk", "start").agg(F.sum("words").alias("taken"),
                                                     F.array_sort(F.collect_list("shard")).alias("shards"))   # one an epoch
    some = placed.filter("size > 0").join(taken, ["sk", "start"], "left")
    none = placed.filter("size = 0").withColumns({"taken": F.lit(None).cast("long"), "shards": F.lit(None).cast("array<int>")})
    return some.unionByName(none).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
