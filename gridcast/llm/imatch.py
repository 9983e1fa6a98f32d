"""I-Match fingerprints in DataFrame functions only.

Terms are words with A-Z lower-cased. The lexicon holds the terms whose document frequency lies in
a band (so neither stop words nor rarities decide). It is cut into randomised subsets: a subset
keeps a term when three hex digits of the term's SHA-256 fall under the subset's rate, with rates
from 1/4 down to 1/1024. A document's signature for a subset is the hash of its distinct terms in
it, sorted; the fingerprint is the list of signatures. A text that shares many of its terms keeps
the signatures of sparse subsets, so the share of equal signatures grades likeness.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import row_key, written

RATES = [1024, 256, 64, 16, 4]          # of 4096
COPIES = 8                              # subsets per rate
SUBSETS = len(RATES) * COPIES
BAND = (0.0005, 0.05)                   # document frequency as a share of all documents
BROADCAST_TERMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "\t\n\x0b\f\r"


def terms(text: Column) -> Column:
    """Distinct lower-cased words of a text (empty for null). White space becomes a blank in the same
    step as letters are lowered, since a split at one character takes no regular expression."""
    return F.array_remove(_parts(text), "")


def _parts(text: Column) -> Column:
    """The terms, and '' where white space stands at an end or twice; no lexicon has that."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SPACES, _LOWER + " " * len(_SPACES))
    return F.array_distinct(F.split(low, " "))


def _mask(term: Column) -> Column:
    """Bit k is set when the term is in subset k."""
    digest = F.concat(F.sha2(term, 256), F.sha2(F.concat(term, F.lit("#")), 256))
    bits = [F.when(F.conv(F.substring(digest, 3 * k + 1, 3), 16, 10).cast("int")
                   < RATES[k // COPIES], F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
            for k in range(SUBSETS)]
    return sum(bits[1:], bits[0])


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, mask): terms of which the document frequency lies in the band (at least 2), over all
    rows of ``docs``. At most (mean distinct terms of a document) / band[0] rows, whatever the
    corpus."""
    n = docs.count()
    lo, hi = max(2, math.ceil(band[0] * n)), max(2, math.floor(band[1] * n))
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    return written(df.filter(F.col("count").between(lo, hi)).select("term", _mask(F.col("term"))
                                                                    .alias("mask")), "lexicon")


def _bit(mask: int):
    return lambda t: t["mask"].bitwiseAND(F.lit(mask).cast("long")) != 0


def signatures(levels: list[Column]) -> Column:
    """Signature of each subset from the sorted (term, mask) of each rate: '' for an empty subset."""
    def one(k: int) -> Column:
        return F.array_join(F.filter(levels[k // COPIES], _bit(1 << k))["term"], " ")

    return F.transform(F.array(*[one(k) for k in range(SUBSETS)]),
                       lambda p: F.when(p == "", p).otherwise(F.substring(F.md5(p), 1, 10)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: the share of equal signatures among those that either
    has, where a rate counts by how many of its subsets are empty in both (a rate so dense that no
    subset is empty says little about how much is shared). A fingerprint without signatures is its
    text's hash, equal or not."""
    x, y = F.split(a, "-"), F.split(b, "-")
    start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("seen"))

    def level(s, j):
        p, q = F.slice(x, j * COPIES + 1, COPIES), F.slice(y, j * COPIES + 1, COPIES)
        pairs = F.arrays_zip(p.alias("p"), q.alias("q"))
        seen = F.size(F.filter(pairs, lambda v: (v["p"] != "") | (v["q"] != "")))
        same = F.size(F.filter(pairs, lambda v: (v["p"] != "") & (v["p"] == v["q"])))
        weight = F.lit(100 * COPIES + 1) - 100 * seen
        return F.struct((s["same"] + weight * same).alias("same"), (s["seen"] + weight * seen).alias("seen"))

    ratio = F.aggregate(F.sequence(F.lit(0), F.lit(len(RATES) - 1)), start, level, lambda s: s["same"] / s["seen"])
    return F.when(F.contains(a, F.lit(":")) | F.contains(b, F.lit(":")) | (a == b),
                  (a == b).cast("double")).otherwise(ratio)


def _fingerprints(rows: DataFrame, sides: dict[str, tuple[int, str]]) -> DataFrame:
    """Adds, for each name: (bit of the side, hash of the whole text), the fingerprint from the
    column ``found``. Step by step, so that no step is computed once per subset. A rate's terms
    come first, so that its subsets look at those alone; the densest rate has nearly all terms."""
    def of(*rates: int):
        return _bit(sum(((1 << COPIES) - 1) << (COPIES * j) for j in rates))

    sparse = range(2, len(RATES))
    rows = rows.withColumn("found", F.sort_array("found"))
    rows = rows.withColumns({f"{n}_0": F.filter("found", _bit(flag)) for n, (flag, _) in sides.items()})
    rows = rows.withColumns({f"{n}_1": F.filter(f"{n}_0", of(1)) for n in sides}
                            | {f"{n}_r": F.filter(f"{n}_0", of(*sparse)) for n in sides})
    rows = rows.withColumns({f"{n}_{j}": F.filter(f"{n}_r", of(j)) for n in sides for j in sparse})
    rows = rows.withColumns({f"{n}_s": signatures([F.col(f"{n}_{j}") for j in range(len(RATES))]) for n in sides})
    rows = rows.withColumns({n: F.when(F.exists(f"{n}_s", lambda v: v != ""), F.array_join(f"{n}_s", "-"))
                             .otherwise(F.col(whole)) for n, (_, whole) in sides.items()})
    return rows.drop("found", *[f"{n}_{x}" for n in sides for x in ("r", "s", *range(len(RATES)))])


LEFT, RIGHT = 1 << SUBSETS, 2 << SUBSETS     # bits of a term's side, above those of the subsets


def _with_lexicon(texts: DataFrame, lex: DataFrame, keys: list[str]) -> DataFrame:
    """Terms of each row that are in the lexicon: keys, meta and ``found``, an array of (term, mask
    with the bits of its sides). ``texts``: keys, meta, elems (null, then the terms of both sides,
    of the left and of the right one) and the counts ``n_both`` and ``n_left``. The rows are
    already partitioned by keys[0], so nothing is shuffled here."""
    small = F.broadcast(lex) if lex.count() <= BROADCAST_TERMS else lex
    side = (F.when(F.col("pos") <= F.col("n_both"), F.lit(LEFT | RIGHT))
            .when(F.col("pos") <= F.col("n_both") + F.col("n_left"), F.lit(LEFT)).otherwise(F.lit(RIGHT)))
    rows = texts.select(*keys, "meta", "n_both", "n_left", F.posexplode("elems").alias("pos", "term")).select(
        *keys, "term", side.alias("side"), F.when(F.col("pos") == 0, F.col("meta")).alias("meta"))
    hit = rows.join(small, "term", "left").filter("mask is not null or meta is not null")
    pair = F.struct("term", F.col("mask").bitwiseOR(F.col("side")).alias("mask"))
    return hit.groupBy(*keys).agg(F.max("meta").alias("meta"),
                                  F.collect_list(F.when(F.col("mask").isNotNull(), pair)).alias("found"))


def _whole(text: Column) -> Column:
    return F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit(""))))


def fingerprints(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND,
                 out: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``out``: the I-Match fingerprint of each text. Null and empty texts,
    and texts without a term in the band, get the hash of their whole text instead; equal texts
    always have equal fingerprints. Repeated rows are counted and answered one by one; extra
    columns pass through (one named ``out`` is replaced)."""
    base = docs.drop(out).withColumn("__key", row_key(text))
    lex = lexicon(docs, text, band)
    texts = (base.groupBy("__key").agg(F.first(text).alias("t"))
             .select("__key", F.struct(_whole(F.col("t")).alias("w")).alias("meta"), terms(F.col("t")).alias("a"))
             .select("__key", "meta", F.concat(F.array(F.lit(None).cast("string")), "a").alias("elems"), F.lit(0).alias("n_both"),
                     F.size("a").alias("n_left")))
    fp = _fingerprints(_with_lexicon(texts, lex, ["__key"]), {out: (LEFT, "meta.w")})
    return base.join(fp.select("__key", out), "__key").drop("__key")


def _ranges(docs: DataFrame, buckets: int):
    """Bucket of an id (descending ids have ascending ranks within and across falling buckets)
    from quantiles of the ids: two levels, so that a row compares with about 2 sqrt(buckets)
    bounds. Null ids are bucket 0."""
    q = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    q = sorted(set(q))
    step = max(1, math.isqrt(len(q)))
    groups = [q[i:i + step] for i in range(0, len(q), step)] or [[]]
    ids = F.col("doc_id")

    def below(values):
        return F.size(F.filter(values, lambda v: v <= ids))

    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups if g]) if q else F.array().cast("array<long>")
    table = F.array(*[F.array(*[F.lit(v).cast("long") for v in g]).cast("array<long>") for g in groups])
    group = F.greatest(below(heads), F.lit(1))
    return F.when(ids.isNull(), 0).otherwise(1 + (group - 1) * step + below(F.element_at(table, group)))


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    for each row of documents (doc_id, text).

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document in descending doc_id, after the last one the first. Null texts count
    as empty; rows of one doc_id follow each other by content; null ids come last. A single
    document is its own next; an empty table gives no rows.

    Ids are cut into ranges; each range gets, besides its own rows, the row that follows its last
    one, so that the texts are shuffled once and each range is read in order by itself.
    """
    spark = docs.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = src.select("doc_id")
    bucket = _ranges(ids, buckets)
    tops = sorted((r["b"], r["top"]) for r in ids.select(bucket.alias("b"), "doc_id").groupBy("b")
                  .agg(F.max("doc_id").alias("top")).collect())          # a row per range
    lex = lexicon(src, "text", band)
    # the top rows of a range also follow the last row of the range above it (the first range of
    # all follows the lowest); a range not in the map is empty
    ranges = F.array(*[F.lit(b) for b, _ in tops]).cast("array<int>")
    above = F.array(*[F.lit(b) for b, _ in tops[1:] + tops[:1]]).cast("array<int>")
    high = F.array(*[F.lit(t).cast("long") for _, t in tops]).cast("array<long>")
    place = F.array_position(ranges, F.col("b")).cast("int")
    ghost = F.when(F.col("doc_id").eqNullSafe(F.get(high, place - 1)), F.get(above, place - 1))
    placed = (src.withColumn("b", bucket).withColumn("ghost", ghost)
              .withColumn("at", F.explode(F.expr(
                  "if(ghost is null, array(named_struct('b', b, 'g', 0)), "
                  "array(named_struct('b', b, 'g', 0), named_struct('b', ghost, 'g', 1)))")))
              .select(F.col("at.b").alias("b"), F.col("at.g").alias("g"), "doc_id", "text",
                      row_key("doc_id", "text").alias("key")))
    order = Window.partitionBy("b").orderBy("g", F.col("doc_id").desc_nulls_last(), "key")
    n = F.length("text")
    rows = (placed.withColumn("next", F.lead("text").over(order))
            .withColumn("next_key", F.lead("key").over(order)).withColumn("i", F.row_number().over(order))
            .filter("g = 0")
            .withColumn("edited", F.concat(F.expr("substring(text, 1, int(length(text) - length(text) div 3))"),
                                           F.expr("substring(next, 1, int(length(text) div 3))")))
            .withColumn("a", _parts(F.col("text"))).withColumn("e", _parts(F.col("edited"))))

    rows = rows.select(
        "b", "i", F.struct("doc_id", "key", "next_key", n.cast("long").alias("n_chars"),
                           F.sha2("edited", 256).alias("edited_sha256"),
                           _whole(F.col("text")).alias("w"), _whole(F.col("edited")).alias("ew")).alias("meta"),
        "a", F.array_except("a", "e").alias("left"), F.array_except("e", "a").alias("right"))
    rows = rows.withColumn("both", F.array_except("a", "left")).select("b", "i", "meta", F.concat(F.array(F.lit(None).cast("string")), "both", "left", "right").alias("elems"),
                       F.size("both").alias("n_both"), F.size("left").alias("n_left"))
    fp = written(_fingerprints(_with_lexicon(rows, lex, ["b", "i"]),
                               {"fingerprint": (LEFT, "meta.w"), "edited_fingerprint": (RIGHT, "meta.ew")})
                 .select("meta.*", "fingerprint", "edited_fingerprint").drop("w", "ew"), "imatch")
    nxt = fp.groupBy(F.col("key").alias("next_key")).agg(F.first("fingerprint").alias("next_fingerprint"))
    return fp.join(nxt, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
