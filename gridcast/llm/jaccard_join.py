"""N-gram Jaccard self-join by vertical partitioning.

All shingles have one global order: by a weight class from a count sketch over the whole corpus
(common last), then by hash. A document is the ordered list of its distinct shingles.

1. Candidates. Two sets with Jaccard >= t share a shingle of their prefixes (the first
   n - ceil(t n) + 1 in the global order). Documents with the same set are one node, merged in
   each task before the shuffle. Prefix shingles meet by hash.
2. Vertical partitions. The global order is cut into ``fragments``; each node's list becomes one
   segment per fragment. For a pair, the overlap is counted fragment by fragment (pairs joined to
   segments by node and fragment) and the partial counts are summed per pair.
3. Links. Each prefix shingle first pairs its nodes with one hub only; pairs that hold are united,
   and only nodes of one shingle that are still in different classes are paired in full. Since
   links only matter up to connection, no pair inside a class is lost, and a group of copies of
   any size gives rows in proportion to its size. The full pairing keeps a pair only at the first
   shingle that both have, and only if the parity bitmaps of the two sets differ in no more bits
   than two linked sets may differ in shingles (each shingle flips one bit, so the bitmaps never
   differ in more bits than the sets in shingles: no link is lost). Sets that fill the short bitmaps
   are compared once more, by bitmaps of a bit or more for each shingle, before any segment moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import WORDS, at_most, components, local, map_rows, mix, row_key, window_hashes, word_hashes, written

WORDS_IN_SHINGLE = 5
PERCENT = 80
BUCKETS = 1 << 20
BITMAP = 8  # longs of a set's parity bitmap
LANES = 16  # counts in a row of the sketch
COMMON = 4  # a bucket is common that many standard deviations (of rare shingles only) over the mean


def _sets(texts: list[bytes], k: int):
    """Distinct shingle hashes of each text, sorted: (text index, hash), and the set sizes."""
    h, bounds = word_hashes(texts, fold=True)
    n = np.diff(bounds)
    count = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s = window_hashes(h, k)[bounds[doc] + first] if len(doc) else np.empty(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence is one shingle
        whole = [window_hashes(h[bounds[i]:bounds[i + 1]], int(n[i]))[0] for i in short]
        doc, s = np.concatenate([doc, short]), np.concatenate([s, np.array(whole, np.uint64)])
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])])
        doc, s = doc[new], s[new]
    return doc, s, np.bincount(doc, minlength=len(texts))


def _nodes(doc: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit id of each set (0 for an empty one)."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))])
    end = np.cumsum(sizes)
    ids = mix((total[end] - total[end - sizes]) ^ sizes.astype(np.uint64)).view(np.int64)
    return np.where(sizes > 0, ids, 0)


def _bitmaps(doc: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """Parity bitmap of each of ``n`` sets: every shingle flips one of 64 * BITMAP bits."""
    bit = mix(s ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)
    out = np.zeros(n * BITMAP, np.uint64)
    np.bitwise_xor.at(out, doc * BITMAP + (bit // np.uint64(64) % np.uint64(BITMAP)).astype(np.int64),
                      np.uint64(1) << (bit % np.uint64(64)))
    return out.view(np.int64).reshape(n, BITMAP)


def _wide_bitmaps(doc: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> list:
    """Parity bitmap of each set of more than 64 * BITMAP shingles, else None: a power of two times
    BITMAP longs, a bit or more for each shingle. A longer one folds to a shorter by xor of its parts."""
    longs = np.where(sizes > 64 * BITMAP, BITMAP << np.ceil(np.log2(np.maximum(sizes, 1) / (64 * BITMAP))).clip(0).astype(np.int64), 0)
    end = np.cumsum(longs)
    big = longs[doc] > 0 if len(doc) else np.empty(0, bool)
    doc, bit = doc[big], mix(s[big] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)
    out = np.zeros(longs.sum(), np.uint64)
    at = (end - longs)[doc] + (bit // np.uint64(64)).astype(np.int64) % longs[doc]
    np.bitwise_xor.at(out, at, np.uint64(1) << (bit % np.uint64(64)))
    return [out[e - m:e].view(np.int64) if m else None for e, m in zip(end, longs, strict=True)]


def _order(s: np.ndarray, common: dict | np.ndarray) -> np.ndarray:
    """Weight class of each shingle: 0 unless its bucket is common."""
    return common[(s % np.uint64(len(common))).astype(np.int64)]


class _Sketch:
    """Counts of shingles per bucket within a task: a row holds the counts of LANES buckets."""

    def __init__(self, k: int, buckets: int):
        self.k, self.count = k, np.zeros(buckets, np.int64)

    def __call__(self, rows: pd.DataFrame):
        _, s, _ = _sets(list(rows["text"]), self.k)
        self.count += np.bincount((s % np.uint64(len(self.count))).astype(np.int64),
                                  minlength=len(self.count))

    def end(self):
        lanes = self.count.reshape(-1, LANES)
        at = np.flatnonzero(lanes.any(1))
        return pd.DataFrame({"row": at, **{f"c{i}": lanes[at, i] for i in range(LANES)}})


def _common(docs: DataFrame, k: int, buckets: int) -> np.ndarray:
    """Weight class of each bucket, from counts over the whole corpus: 0, or for a common bucket
    the power of two of its excess over the mean. ``buckets`` (a multiple of LANES) bytes, whatever
    the corpus."""
    def make():
        return _Sketch(k, buckets)

    make.stateful = True
    lanes = [f"c{i}" for i in range(LANES)]
    summed = map_rows(docs, make, "row int, " + ", ".join(f"{c} long" for c in lanes)).groupBy("row").agg(
        *[F.sum(c).alias(c) for c in lanes])
    counts = written(summed.select("row", F.posexplode(F.array(*lanes)).alias("lane", "c"))
                     .select((F.col("row") * LANES + F.col("lane")).alias("bucket"), "c").filter("c > 0"), "sketch")
    out = np.zeros(buckets, np.uint8)
    mean = (counts.agg(F.sum("c")).first()[0] or 0) / buckets
    heavy = local(counts.filter(F.col("c") >= mean + COMMON * mean ** 0.5 + 8))
    if len(heavy):
        out[heavy["bucket"]] = 1 + np.floor(np.log2((heavy["c"] - mean).clip(1))).clip(0, 60)
    return out


def _ceil(n, percent):
    return -(-n * percent // 100)


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                       k: int = WORDS_IN_SHINGLE, percent: int = PERCENT, fragments: int = 8,
                       buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_shingles, component_id): one row per row of ``docs``.

    Words: runs of other characters than space and 9-13, A-Z lower-cased; a set holds the distinct
    ``k``-word shingles, with fewer words the whole sequence. Two rows link when
    100 * intersection >= percent * union; component_id is the least id reachable. Null and empty
    texts have an empty set, link with nothing and keep their own id. Rows with equal ids or texts
    are rows of their own; a null id is reported as null and never the least. Extra columns of
    ``docs`` are not read.
    """
    found = _classes(docs, id_col, text, k, percent, fragments, buckets)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS_IN_SHINGLE,
             percent: int = PERCENT, fragments: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """(key, id, n, c, least) per row: row key, set size, class (null for an empty set) and the
    least id of the class."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn(
        "key", row_key("id", "text"))
    weight = spark.sparkContext.broadcast(_common(src.select("text"), k, buckets))

    def members(rows: pd.DataFrame):
        doc, s, sizes = _sets(list(rows["text"]), k)
        out = pd.DataFrame({"key": rows["key"], "id": rows["id"], "node": _nodes(doc, s, sizes), "n": sizes})
        return out.assign(**dict(zip(bitmap, _bitmaps(doc, s, len(rows)).T, strict=True)),
                          wide=_wide_bitmaps(doc, s, sizes))

    bitmap = [f"w{i}" for i in range(BITMAP)]
    narrow = written(map_rows(src, members, f"key long, id {src.schema['id'].dataType.simpleString()}, node long, n int, "
                              + ", ".join(f"{w} long" for w in bitmap) + ", wide array<long>"), "sets")
    bitmaps = written(narrow.filter("n > 0").groupBy("node").agg(*[F.max(w).alias(w) for w in bitmap]), "bitmap")
    wide = narrow.filter("wide is not null").select("node", "wide")
    narrow = narrow.drop("wide", *bitmap)

    def prefixes():
        return _Prefixes(k, percent, weight)

    prefixes.stateful = True
    post = map_rows(src.select("text"), prefixes, "token long, node long, n int, rank int")
    by_token = Window.partitionBy("token")
    post = (post.repartition("token").groupBy("token", "node").agg(F.max("n").alias("n"), F.max("rank").alias("rank"))
            .withColumn("nodes", F.count("*").over(by_token)).filter("nodes > 1")
            .withColumn("hub", F.min(F.struct("rank", "node")).over(by_token)["node"]).drop("nodes"))
    post = written(post, "prefix")

    sizes_ok = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    # a pair at the threshold has alpha shingles in common
    alpha = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - F.lit(1e-9))

    def bits_of(x: str) -> DataFrame:
        return bitmaps.select(F.col("node").alias(x), *[F.col(w).alias(w + x) for w in bitmap])

    apart = sum((F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in bitmap), F.lit(0))
    close = apart <= F.col("na") + F.col("nb") - 2 * alpha

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def close_wide(pairs: DataFrame) -> DataFrame:
        """Without the pairs of two large sets whose wide bitmaps differ in too many bits."""
        both = F.least("na", "nb") > 64 * BITMAP
        large = pairs.filter(both)
        maps = written(wide.join(at_most(nodes_of(large)), "node").groupBy("node").agg(F.first("wide").alias("wide")), "wide")
        met = (large.join(maps.select(F.col("node").alias("a"), F.col("wide").alias("wa")), "a")
               .join(maps.select(F.col("node").alias("b"), F.col("wide").alias("wb")), "b"))
        m = F.least(F.size("wa"), F.size("wb"))

        def fold(x: str):
            return F.transform(F.sequence(F.lit(1), m), lambda i: F.aggregate(
                F.sequence(i, F.size(x), m), F.lit(0).cast("long"), lambda t, j: t.bitwiseXOR(F.element_at(x, j))))

        met = met.withColumns({"wa": fold("wa"), "wb": fold("wb")})
        differ = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
        return pairs.filter(~both).unionByName(
            met.filter(differ <= F.col("na") + F.col("nb") - 2 * alpha).select(*pairs.columns))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) that reach the threshold: partial overlaps by fragment, summed per pair. Only the
        texts of nodes in a pair are read again; a key per node finds them."""
        pairs = written(close_wide(written(pairs.select("a", "b", "na", "nb"), "pair")), "close")
        keys = written(narrow.join(at_most(nodes_of(pairs)), "node").groupBy("node").agg(F.min("key").alias("key")).select("key"), "key")
        texts = src.select("key", "text").join(at_most(keys), "key")
        if narrow.join(at_most(keys), "key").count() > keys.count():     # repeated rows: one of each
            texts = texts.dropDuplicates(["key"])
        seg = written(map_rows(texts.select("text"), cut, "node long, part int, seg array<long>"), "segment")
        left = seg.select(F.col("node").alias("a"), "part", F.col("seg").alias("sa"))
        right = seg.select(F.col("node").alias("b"), "part", F.col("seg").alias("sb"))
        overlap = F.size(F.array_intersect("sa", "sb"))
        # the first fragment bounds the overlap: most pairs that fail end here
        hopeful = written(pairs.join(left.filter("part = 0"), "a").join(right.filter("part = 0").drop("part"), "b")
                          .select("a", "b", "na", "nb", overlap.alias("o"), F.size("sa").alias("fa"), F.size("sb").alias("fb"))
                          .filter(F.col("o") + F.least(F.expr("na - fa"), F.expr("nb - fb")) >= alpha)
                          .drop("fa", "fb"), "hopeful")
        rest = (hopeful.join(left.filter("part > 0"), "a").join(right.filter("part > 0"), ["b", "part"])
                .select("a", "b", "na", "nb", overlap.alias("o")))
        return (hopeful.unionByName(rest).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
                .filter(f"100 * o >= {percent} * (na + nb - o)").select("a", "b"))

    def cut(rows: pd.DataFrame):
        doc, s, sizes = _sets(list(rows["text"]), k)
        ids = _nodes(doc, s, sizes)
        # a quarter of the order is fragment 0, which every node has; the others share the rest
        part = np.where(s >> np.uint64(62) == 0, 0, 1 + ((s >> np.uint64(32)).astype(np.int64) - (1 << 30)) * (fragments - 1) // (3 << 30))
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])) if len(doc) else []
        vals = np.split(s.view(np.int64), edge[1:]) if len(doc) else []
        out = pd.DataFrame({"node": ids[doc[edge]] if len(doc) else [], "part": part[edge] if len(doc) else [], "seg": vals})
        bare = np.setdiff1d(ids, out["node"][out["part"] == 0])
        more = pd.DataFrame({"node": bare, "part": 0, "seg": [np.empty(0, np.int64)] * len(bare)})
        return pd.concat([out, more]) if len(bare) else out

    # with the hub of each shingle, the node with the fewest shingles before it (of a group of edited
    # copies the least edited). Only pairs that met often are tested here: the next round
    # examines every other pair that is not in one class by then
    hubs = post.filter("node = hub").groupBy("hub").agg(F.max("n").alias("nb"))
    first = (post.filter("node <> hub").groupBy("node", "hub").agg(F.max("n").alias("na"), F.count("*").alias("met"))
             .join(hubs, "hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "na", "nb", "met")
             .filter(sizes_ok).filter(F.col("met") >= alpha - F.ceil(F.lit(percent) * F.greatest("na", "nb") / 100) + 1)
             .join(bits_of("a"), "a").join(bits_of("b"), "b").filter(close))
    links = written(verified(first), "link")
    comp = components(links)

    # every pair of one shingle whose nodes are not yet in one class
    rest = (post.select("token", "node", "n", "rank").join(comp, "node", "left")
            .withColumn("c", F.coalesce("component", "node")))
    # a pair with sizes na <= nb must share a shingle of the first na - alpha + 1 and nb - alpha + 1:
    # a shingle that no node has as early as the smaller of a pair must have it brings no pair
    early = F.col("rank") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent) - F.lit(1e-9))
    rest = written(rest.withColumn("lo", F.min("c").over(by_token)).withColumn("hi", F.max("c").over(by_token))
                   .withColumn("some", F.max(early).over(by_token)).filter("lo <> hi and some")
                   .select("token", "node", "n", "rank", "c"), "rest")
    # with each shingle of a node the two before it that are also in question, and the node's bitmap
    by_node = Window.partitionBy("node").orderBy("rank")
    rest = (rest.withColumn("p", F.lag("token", 1).over(by_node)).withColumn("q", F.lag("token", 2).over(by_node))
            .join(bitmaps, "node").repartition("token"))

    def side(x: str) -> DataFrame:
        return rest.select("token", F.col("node").alias(x), *[F.col(c).alias(c + x) for c in ("n", "rank", "c", "p", "q", *bitmap)])

    a, b = side("a"), side("b")         # two readings of one shuffle
    # a shared shingle before this one has lower ranks in both, so the pair meets there as well
    before = F.coalesce(F.col("pa").isin(F.col("pb"), F.col("qb")) | F.col("qa").isin(F.col("pb"), F.col("qb")), F.lit(False))
    more = (a.join(b, (a["token"] == b["token"]) & (F.col("ca") != F.col("cb")) & F.expr(sizes_ok)
                   & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
                   & (F.col("ranka") <= F.col("na") - alpha) & (F.col("rankb") <= F.col("nb") - alpha)
                   & ~before & close)
            .select("a", "b", "na", "nb").distinct())
    links = written(links.unionByName(verified(more)), "link")
    comp = components(links)

    whole = (narrow.join(comp, "node", "left")
             .withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "node"))))
    least = whole.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    return whole.join(least, "c", "left").select("key", "id", "n", "c", "least")


class _Prefixes:
    """Prefix shingles of each set, once per task and set."""

    def __init__(self, k: int, percent: int, weight):
        self.k, self.percent, self.weight, self.seen = k, percent, weight.value, set()

    def __call__(self, rows: pd.DataFrame):
        doc, s, sizes = _sets(list(rows["text"]), self.k)
        ids = _nodes(doc, s, sizes)
        fresh = np.zeros(len(ids), bool)
        for i, x in enumerate(ids.tolist()):
            if sizes[i] and x not in self.seen:
                self.seen.add(x)
                fresh[i] = True
        order = np.lexsort((s, _order(s, self.weight), doc))
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = sizes - _ceil(sizes, self.percent) + 1
        doc, s = doc[order], s[order]
        keep = (rank < length[doc]) & fresh[doc]
        return pd.DataFrame({"token": s[keep].view(np.int64), "node": ids[doc[keep]],
                             "n": sizes[doc[keep]], "rank": rank[keep]})


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one row left of each class: one of the least id (of several, the one of least
    content hash; repeated rows are one). Rows without words are in no class and all stay; a null
    id comes after all others. All columns pass through."""
    found = _classes(docs, id_col, text, **kw).filter("c is not null")
    kept = found.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("x")).select(
        F.col("x.key").alias("__key"))
    keyed = docs.withColumn("__key", row_key(id_col, text))
    words = F.coalesce(F.col(text).rlike(WORDS), F.lit(False))
    some = keyed.filter(words).join(kept, "__key").dropDuplicates(["__key"])
    return some.unionByName(keyed.filter(~words)).drop("__key")
