"""Operators of gridcast.llm against brute force on small fixtures: nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcast.llm import (
    hnsw_dedup, html_text, imatch, jaccard_join, mixing, quality, sentencepiece_codec as sp, substring_dedup,
    toxicity, url_rules,
)

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base, shared = words(120, 1), words(60, 2)
    edited = base[:3] + ["new"] + base[4:]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n"),
            (7, "one two"), (8, "One  two"), (9, " ".join(words(30, 3) + shared)), (10, " ".join(shared + words(30, 4))),
            (11, "a " * 100), (12, " ".join(words(5000, 5, 5000))), (7, "one two"), (None, "null id text here now ok"),
            (13, "é漢字 \U0001f600 x y z")]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 12 else None, len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def empty(docs):
    return docs.limit(0)


def test_substring(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    seqs = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for w in seqs:
        for s in range(len(w) - 34):
            seen[tuple(w[s:s + 35])] = seen.get(tuple(w[s:s + 35]), 0) + 1
    want = []
    for (i, _), w in zip(rows, seqs, strict=True):
        dead = {k for s in range(len(w) - 34) if seen[tuple(w[s:s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in dead)
        want.append((i, len(w), len(dead), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs, digest=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 200
    full = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash"))).collect()
    for r in full:
        digest = [w for w in want if w[0] == r.doc_id][0]
        assert (r.n_words, r.n_removed) == digest[1:3]
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == digest[3]
    assert substring_dedup.remove_repeats(empty(docs), digest=True).count() == 0


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None]
        out.append((i, len(sets[a]), (min(ids) if ids else None) if sets[a] else i))
    return out


def test_jaccard(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in jaccard_join.shingle_components(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(rows), key=str)
    assert jaccard_join.shingle_components(empty(docs)).count() == 0
    kept = jaccard_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(
        ["1", "4", "5", "6", "7", "9", "10", "11", "12", "13", "None"])


def test_jaccard_edited_group(spark):
    """A large group around the threshold: many edited copies of one text."""
    r, base = random.Random(9), words(80, 6, 5000)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{i}x{r.randrange(999)}"
        rows.append((i, " ".join(w)))
    got = [tuple(x) for x in jaccard_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


def test_mixing(docs, spark):
    rows = mixing.taken_words(docs).collect()
    sizes = sum(r["size"] for r in rows)
    assert len(rows) == docs.count()
    by = {}
    for r, d in zip(sorted(rows, key=lambda r: (str(r.doc_id), r["size"])),
                    sorted(docs.collect(), key=lambda d: (str(d.doc_id), len(WORD.findall(d.text or "")))), strict=True):
        assert r["size"] == len(WORD.findall(d.text or "")) and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(d.source, [0, r.target, r.source_size])[0] += r.taken
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sizes)
    for taken, target, size in by.values():
        assert abs(taken - target) <= 0.5 and target <= 2 * size
    assert mixing.taken_words(empty(docs)).count() == 0
    mixed = mixing.mix(docs.withColumn("shard", F.lit("clash")))
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty(docs)).count() == 0


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([("=a", 100), ("=b", 37), ("-", 3)], "sk string, blocks long")
    rows = mixing.split_quotas(quotas, 7).collect()
    for sk, n in (("=a", 100), ("=b", 37), ("-", 3)):
        assert sum(r.blocks for r in rows if r.sk == sk) == n
    shards = [sum(r.blocks for r in rows if r.shard == s) for s in range(7)]
    assert max(shards) - min(shards) <= 2 and min(r.blocks for r in rows) >= 0


def _long(*values):
    return [F.lit(v).cast("long") for v in values]


def test_hypergeometric(spark):
    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    got = grid.select(mixing._inverse(*_long(50, 20, 10), F.col("u")).alias("x"))
    mean, var = got.agg(F.avg("x"), F.var_pop("x")).first()
    assert mean == pytest.approx(4.0, abs=0.01) and var == pytest.approx(10 * 0.4 * 0.6 * 40 / 49, abs=0.02)


@pytest.mark.parametrize("total,good,drawn", [(1000, 400, 300), (1000, 700, 300), (1000, 300, 800), (1000, 800, 900), (10**9, 3 * 10**8, 10**8),
                                              (10**12, 999 * 10**9, 10**11)])
def test_hypergeometric_of_many(spark, total, good, drawn):
    n = 3000
    begun = time.time()
    got = spark.range(n).select(mixing.hypergeometric(*_long(total, good, drawn), [F.lit("k"), F.col("id").cast("string")]).alias("x"))
    mean, var, lo, hi = got.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    assert time.time() - begun < 60                       # a draw takes milliseconds, whatever the counts
    share = good / total
    want = drawn * share * (1 - share) * (total - drawn) / (total - 1)
    assert abs(mean - drawn * share) < 4 * (want / n) ** 0.5 and abs(var / want - 1) < 4 * (2 / n) ** 0.5
    assert max(0, drawn + good - total) <= lo and hi <= min(drawn, good)


def test_hypergeometric_has_its_distribution(spark):
    n, total, good, drawn = 40_000, 400, 150, 120
    got = {r.x: r["count"] for r in spark.range(n).select(mixing.hypergeometric(
        *_long(total, good, drawn), [F.lit("d"), F.col("id").cast("string")]).alias("x")).groupBy("x").count().collect()}
    p = {x: math.comb(good, x) * math.comb(total - good, drawn - x) / math.comb(total, drawn) for x in range(drawn + 1)}
    assert sum((got.get(x, 0) - n * q) ** 2 / (n * q) for x, q in p.items() if n * q > 10) < 70     # about 35 outcomes
    for args in ((10, 0, 5), (10, 10, 5), (10, 4, 0), (10, 4, 10)):
        assert spark.range(1).select(mixing.hypergeometric(*_long(*args), [F.lit("e")])).first()[0] == args[1] * args[2] // 10


def test_blocks_are_permuted(spark):
    for n in (1, 2, 5, 777):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_mixed_shards(spark):
    """Each draw is in one shard, shards hold their blocks' words, and the pipeline writes them in order."""
    docs = spark.createDataFrame([(i, " ".join(words(20 + i % 50, i)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    placed = mixing.layout(docs)
    drawn = mixing.draws(placed, block_words=64, shard_words=1024).collect()
    per = {}
    for r in drawn:
        per[r["shard"]] = per.get(r["shard"], 0) + r["words"]
    size = sum(per.values())
    assert len(per) == math.ceil(sum(math.ceil(r["q"] / 64) for r in placed.groupBy("sk").agg(F.max("quota").alias("q")).collect()) * 64 / 1024)
    assert max(per.values()) < 2 * size / len(per)
    begins = {}
    for r in drawn:
        begins.setdefault((r["sk"], r["block"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in begins.values())
    rows = mixing.taken_words(docs).collect()
    assert all((len(r.shards) == 0) == (r.taken == 0) and r.shards == sorted(r.shards) for r in rows)


def test_imatch(docs):
    rows = imatch.edited_fingerprints(docs).collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None), key=lambda r: -r[0])
    assert len(rows) == docs.count()
    unique = [o for o in order if o[0] != 7]
    for (i, t), (_, after) in zip(unique, unique[1:], strict=False):
        got = [r for r in rows if r.doc_id == i][0]
        third = len(t) // 3
        if i != 8:
            assert got.edited_sha256 == hashlib.sha256((t[:len(t) - third] + after[:third]).encode()).hexdigest()
        assert got.n_chars == len(t) and 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1      # A-Z are lower-cased
    assert imatch.edited_fingerprints(empty(docs)).count() == 0
    more = imatch.fingerprints(docs.withColumn("fingerprint", F.lit(1)))
    assert more.count() == docs.count() and dict(more.dtypes)["fingerprint"] == "string"


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, module, label):
    r = random.Random(4)
    bad = {"toxic": lambda w: w + ["moronic"], "quality": lambda w: [x.upper() + "!!" for x in w]}[label]
    rows = []
    for i in range(400):
        w, mark = words(r.randrange(20, 90), 1000 + i, 300), r.random() < 0.4
        rows.append((i, " ".join(bad(w) if mark else w), int(mark) if label == "toxic" else int(not mark)))
    data = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = data.select("doc_id", F.col("y").alias(label)).unionByName(spark.createDataFrame([(None, 1), (3, None)], f"doc_id long, {label} int"))
    model = module.fit(toxicity.labelled_sample(data, labels, label, 5, 0, 300))
    got = module.score(data.withColumn("score", F.lit("clash")), model).filter(toxicity.held_out(F.col("doc_id"), 5, 0)).collect()
    assert len(got) > 40 and sum((x.score >= 0.5) == (x.y == 1) for x in got) / len(got) > 0.95
    odd = module.score(docs, model).collect()
    assert all(0 <= x.score <= 1 for x in odd) and len({x.score for x in odd if not x.text}) == 1
    none = module.fit(toxicity.labelled_sample(data, labels.limit(0), label, 5, 0, 300))
    assert {x.score for x in module.score(docs, none).collect()} == {0.5}
    assert module.score(empty(docs), model).count() == 0


def test_sentencepiece(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    pieces = sp.load_pieces()
    for head in (3, 100_000):      # nearly all words by the task's fold; all by the lattice
        rows = sp.encode(docs.withColumn("ids", F.lit(0)), pieces, head=head, decoded="back").collect()
        for r in rows:
            assert r.ids == lib.encode(r.text or "") and r.back == (r.text or "")
    rows = sp.decode(sp.encode(docs, pieces), pieces).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert sp.encode(empty(docs), pieces).count() == 0


def test_sentencepiece_folds_many_words_at_once():
    p = sp.load_pieces()
    r = random.Random(12)
    ids = {t: i for i, (t, ok) in enumerate(zip(p.text, p.normal, strict=True)) if ok}
    full = {w: k for k, w in enumerate(sorted(ids, key=lambda w: (-p.score[ids[w]], ids[w])))}
    odd = {w: k for k, w in enumerate(["ab", "ba", "abb", "a", "aba", "bab", "éa"])}     # b and é have no piece
    words = ["".join(r.choice("abethin▁é漢,😀") for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    words += ["".join(r.choice("aab") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    words += ["", "\n", "a" * 60, "▁oferstshtion"]
    for rank, of in ((full, ids), (odd, {w: 50 - k for w, k in odd.items()})):
        got = list(sp.Merges(rank, of).fold(words))
        for w, g in zip(words, got, strict=True):
            parts = sp._merged(w, rank)
            assert (None if g is None else np.frombuffer(g, np.int32).tolist()) == (
                [of[x] for x in parts] if all(x in of for x in parts) else None)
        assert sum(g is not None for g in got) > 20
    assert list(sp.Merges(full, ids).fold([])) == []


def test_sentencepiece_cuts_words_and_slices():
    r = random.Random(13)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", " ", "\n", "▁", "\t"]) for _ in range(r.randrange(0, 9)))
        assert sp.words_of(text) == (sp.WORD.findall("▁" + text.replace(" ", "▁")) if text else [])
    rows = pa.RecordBatch.from_pydict({"t": ["x" * n if n else None for n in [700_000, 0, 400_000, 2_000_000, *range(1, 300)]]})
    cut = [x.num_rows for x in sp._slices(rows, "t", 256)]
    assert cut == [2, 1, 1, 256, 43] and sum(cut) == rows.num_rows


def test_unigram_viterbi(spark):
    p = sp.Pieces(["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"], [0, -1.0, -2.0, -2.5, -2.2, -3.9, -1.5, -2.1],
                  [False] + [True] * 7, -1, 0, "unigram")
    r = random.Random(3)
    ws = sorted({"".join(r.choice("abc▁") for _ in range(r.randrange(1, 9))) for _ in range(80)})
    value = {t: s for t, s, ok in zip(p.text, p.score, p.normal, strict=True) if ok}

    def best(w):
        return 0.0 if not w else max([value[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in value]
                                     + ([-13.9 + best(w[1:])] if w[0] not in value else []))

    for row in sp.encode_words(spark.createDataFrame([(w,) for w in ws], "word string"), p).collect():
        assert sum(p.score[i] if i else -13.9 for i in row.ids) == pytest.approx(best(row.word))


def test_url_rules(spark):
    urls = ["http://a.org/x", "https://Example.ORG/es/1?q#f", "http://example.org/en/123", "http://x.com/fr/2",
            "http://x.com/de/2", None, "no scheme", "ftp://y.net", "http://y.net?x=/a", "http://notorg/x", "http://z.net/de/5"]
    rows = [(i, u) for i, u in enumerate(urls + ["http://h%d.com/de/%d" % (k, k) for k in range(30)] + [urls[0]])]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(11)] == [
        ("a.org", "/x", "org/"), ("example.org", "/es/1", "example.org/es/"), ("example.org", "/en/123", "example.org/en/1"),
        ("x.com", "/fr/2", "com/fr/"), ("x.com", "/de/2", "com/de/"), ("", "", None), ("", "", None), ("y.net", "", None),
        ("y.net", "", None), ("notorg", "/x", None), ("z.net", "/de/5", None)]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (got[10].verdict, got[10].by) == ("block", "mined") and got[5].by == "default"
    assert len(got) == len(rows)
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_read_deep_parts(spark):
    rows = [f"http://{h}/a/b/c/d/{deep}" for _ in range(20) for h, deep in (("bad.org", "casino"), ("good.org", "news"))]
    rows += ["http://u.net/a/b/c/d/casino", "http://u.net/a/b/c/d/x", "http://u.net/a/b/c/d/news"]
    judged = url_rules.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"),
                             [("block", "bad.org", "/"), ("allow", "good.org", "/")], default="unknown").collect()
    got = {r.page_id: (r.verdict, r.by) for r in judged}
    assert [got[40 + i] for i in range(3)] == [("block", "mined"), ("unknown", "default"), ("allow", "mined")]


def brute_rules(rows, least, confidence):
    """Pruned rules over tokens: every combination that is the least one, by items, of its rows."""
    tokens = sorted({t for items, _ in rows for t in items})
    held = {c: [(i, v) for i, (items, v) in enumerate(rows) if set(c) <= set(items)]
            for k in range(1, 5) for c in itertools.combinations(tokens, k)}
    out = {}
    for c, of in held.items():
        for verdict in ("allow", "block"):
            n = sum(v == verdict for _, v in of)
            if n >= least and n >= confidence * len(of):
                out[c, verdict] = n / len(of)
    return {(c, v): p for (c, v), p in out.items()
            if not any(out.get((d, v), 0) >= p for k in range(1, len(c)) for d in itertools.combinations(c, k))}


def test_url_rules_equal_enumeration(spark):
    r = random.Random(5)
    rows = []
    for _ in range(120):
        items = sorted({r.choice("ab"), r.choice("cd"), r.choice("cde"), "x", "y"} | ({"p", "q"} if r.random() < 0.4 else set()))
        bad = ("a" in items and "c" in items) or ("p" in items and r.random() < 0.9)
        rows.append((items, "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "items array<string>, verdict string")
    items = url_rules.items_of(df)
    same = {}
    for t in items.collect():
        same.setdefault(t["item"], set()).add(t["token"])
    assert same["p"] == {"p", "q"} and same["x"] == {"x", "y"}
    found = url_rules.mine(url_rules.transactions(df, items), 3 / 120, 0.8, 3).collect()
    got = {(tuple(sorted(c)), f.verdict): f.confidence for f in found for c in itertools.product(*[same[i] for i in f["items"]])}
    want = {k: p for k, p in brute_rules(rows, 3, 0.8).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 5


def test_url_rules_end_on_deep_urls(spark):
    deep = "http://deep.org/" + "/".join(f"part{k}" for k in range(30))
    chain = ["http://deep.org/" + "/".join(f"part{k}" for k in range(n)) for n in range(1, 31)]
    for rows in ([deep] + [f"http://h{k}.net/x" for k in range(9)],
                 [deep, *chain][:20] + [f"http://h{k}.com/{c}/{k % 7}" for k in range(990) for c in ("fr", "de")]):
        df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
        begun = time.time()
        got = {r.page_id: r for r in url_rules.judge(df).collect()}
        assert time.time() - begun < 60 and len(got) == len(rows)       # hours where every combination is mined
        assert got[0].verdict == "allow" and got[0].by == "rule"


def test_hnsw(spark):
    r = random.Random(8)
    vecs = [[r.gauss(0, 1) for _ in range(16)] for _ in range(300)]
    for k in range(120):
        vecs.append([x + r.gauss(0, 0.06) for x in vecs[k % 7]])
    vecs += [vecs[0], [2 * x for x in vecs[1]], None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 8]
    rows = list(enumerate(vecs))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    single = {x.vec_id: x.embedding for x in df.collect()}
    got = {x.vec_id: x for x in hnsw_dedup.near_duplicates(df, shard=128).collect()}
    links = {i: 0 for i, _ in rows}
    for i, a in single.items():
        for j, b in single.items():
            if i < j and a and b and len(a) == len(b) and any(a) and any(b) and a[0] == a[0] and b[0] == b[0]:
                dot, na, nb = (sum(x * y for x, y in zip(p, q, strict=True)) for p, q in ((a, b), (a, a), (b, b)))
                if dot / (na * nb) ** 0.5 >= 0.95:
                    links[i] += 1
                    links[j] += 1
    found = sum(got[i].n_links for i in links)
    assert 0.98 * sum(links.values()) <= found <= sum(links.values()) and sum(links.values()) > 500
    assert all(got[i].n_links == 0 and got[i].kept for i in range(422, 427)) and len(got) == len(rows)
    assert hnsw_dedup.near_duplicates(df.limit(0)).count() == 0


def _shard(rng, group, centres, far, first):
    """A shard of one large near group, a vector near each centre and vectors without links."""
    hot = np.ones(32) + rng.normal(0, 0.02, (group, 32))
    x = np.concatenate([hot, centres + rng.normal(0, 0.02, centres.shape), rng.normal(0, 1, (far, 32))]).astype(np.float32)
    return hnsw_dedup.build(x, np.arange(first, first + len(x)), np.ones(len(x), np.int64))


def _exact(g, q):
    x, y = (v["x"] / np.linalg.norm(v["x"].astype(float), axis=1, keepdims=True) for v in (q, g))
    return ((x @ y.T >= 0.95) & (q["gid"][:, None] != g["gid"])).sum(1)


def _audited(g, q):
    """The width that one pair of shards, audited by all of ``q``, would get, and its links with it."""
    told = hnsw_dedup.audit_shard(g, q, 0.95)
    kinds = [(len(k), {w: (k[f"w{w}"] / k["links"]).mean() for w in hnsw_dedup.WIDTHS})
             for k in (told[told["links"] <= hnsw_dedup.FEW], told[told["links"] > hnsw_dedup.FEW]) if len(k)]
    width = hnsw_dedup.beam_width(kinds, True)
    return width, hnsw_dedup.link_shards(g, q, 0.95, width)[0]


def test_hnsw_audit_needs_evidence(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (3, 32))
    search = hnsw_dedup._hits
    for group in (0, 400):       # hardly a node of a sample has a link; nearly all links are the large group's
        g, q = _shard(rng, group, centres, 900, 0), _shard(rng, group, centres, 901, 5000)
        want = _exact(g, q)

        def blind(graph, u, queries, width, low, group=group):
            for r, c in search(graph, u, queries, width, low):
                seen = (c < group) | (width == 0)
                yield r[seen], c[seen]               # beams never reach the small groups
        monkeypatch.setattr(hnsw_dedup, "_hits", blind)
        width, links = _audited(g, q)
        assert (want[group:group + 3] > 0).all() and (links == want).all() and width == 0
        monkeypatch.undo()
        width, links = _audited(g, q)
        assert (links == want).all()
    assert hnsw_dedup.beam_width([], False) == hnsw_dedup.beam_width([(5, dict.fromkeys(hnsw_dedup.WIDTHS, 1.0))], False) == hnsw_dedup.UNTOLD
    assert hnsw_dedup.beam_width([], True) == hnsw_dedup.WIDTHS[0]


def test_hnsw_forest_spans_its_links():
    r = random.Random(4)
    links = [(q, n) for q in range(300) for n in range(260) if r.random() < (0.3 if q % 7 == n % 7 == 0 else 0.0006)]
    f = hnsw_dedup._Forest(300, 260)
    for at in range(0, len(links), 97):
        f.add(*np.array(links[at:at + 97]).T)
    groups = lambda pairs: brute_groups(560, pairs)
    assert groups(f.links) == groups([(q, 300 + n) for q, n in links])
    assert len(f.links) == 560 - len(set(groups(f.links)))


def brute_groups(n, pairs):
    root = list(range(n))
    for _ in range(n):
        old = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if old == root:
            return root
    return root


def test_hnsw_of_very_large_and_small_vectors(spark):
    r = random.Random(6)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x * s for x in base[i % 6]]) for i, s in enumerate([1.0, 1e200, 1e-200, 1e-310, 1e307, 3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in hnsw_dedup.near_duplicates(df).collect()}
    assert all(x.component_id == i % 6 and x.n_links == 5 for i, x in got.items())


def test_hnsw_large_groups_keep_links_outside():
    rng = np.random.default_rng(2)
    g = _shard(rng, 600, rng.normal(0, 1, (3, 32)), 600, 0)
    nbrs = g["layers"][0][1]
    assert all((nbrs[i] >= 600).any() for i in range(600))


def test_hnsw_searches_only_cells_that_can_hold_links():
    rng = np.random.default_rng(3)
    for dim, spread, least in ((3, 0.05, 0.1), (16, 0.04, 0.0)):      # cells that touch, cells that hardly do
        x = rng.normal(0, 1, (30, dim))[rng.integers(0, 30, 1500)] + rng.normal(0, spread, (1500, dim))
        u = hnsw_dedup._unit(x.astype(np.float32))
        c = hnsw_dedup.fit_centres(u, 12)
        cell = hnsw_dedup.nearest(u, c)
        r, into = hnsw_dedup.asked_cells(u, cell, c, 0.95, hnsw_dedup.STEPS)
        asked = np.zeros((len(u), len(c)), bool)
        asked[r, into] = True
        a, b = np.nonzero((u @ u.T >= 0.95) & (cell[:, None] > cell))          # the later cell's is searched
        assert asked[a, cell[b]].all() and len(a) >= least * len(u)
        step = hnsw_dedup.step_to(u[a], cell[a], cell[b], c, 0.95)
        assert (step <= hnsw_dedup.STEPS).all()
        assert asked.sum() < 0.5 * (cell[:, None] > np.arange(len(c))).sum()   # all of them before
        near = hnsw_dedup.asked_cells(u, cell, c, 0.95, 2)
        assert set(zip(*near, strict=True)) <= set(zip(r, into, strict=True))
    assert hnsw_dedup.asked_cells(u, cell * 0, c[:1], 0.95, hnsw_dedup.STEPS)[0].size == 0
    assert hnsw_dedup.reach_step([(50, [0.9, 0.9995, 1, 1, 1, 1, 1, 1, 1]), (50, [1] * 9)], False) == 1
    assert hnsw_dedup.reach_step([(3, [1] * 9)], False) == hnsw_dedup.STEPS and hnsw_dedup.reach_step([], True) == 0


def test_hnsw_nodes_are_their_own_way_in():
    rng = np.random.default_rng(4)
    g = _shard(rng, 50, rng.normal(0, 1, (3, 32)), 200, 10)
    own = hnsw_dedup._own(g, np.array([12, 5, 262, 263]))["own"]
    assert own.tolist() == [2, -1, 252, -1]
    want = _exact(g, g)
    cut = {k: v for k, v in g.items() if k != "layers"} | {"layers": [g["layers"][0], (np.arange(1), np.full((1, 1), -1))]}
    assert (hnsw_dedup.link_shards(cut, g, 0.95, 24)[0] == want).all() and want.sum() > 2000


def test_hnsw_of_many_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (500, 24))
    x = np.concatenate([base, base[:200] + rng.normal(0, 0.1, (200, 24)), base[0] + rng.normal(0, 0.05, (300, 24))])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame([*rows, (None, rows[3][1]), (7, rows[7][1]), (2000, [0.5] * 3)], "vec_id long, embedding array<double>")
    got = hnsw_dedup.near_duplicates(df, shard=100).collect()             # cells, and one that is cut by hash
    x = np.concatenate([x, x[[3, 7]]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    links = {i: int(n) for i, n in enumerate(want[:1000])} | {2000: 0}
    assert len(got) == 1003 and all(r.n_links <= links[r.vec_id] for r in got if r.vec_id is not None)
    assert sum(r.n_links for r in got) >= 0.995 * want.sum() and sum(r.n_links == want[1000] for r in got if r.vec_id is None) == 1


def test_html(spark):
    page = ("<!doctype html><title>T</title><style>x</style><p>One<p>Two <b>bold</b>&amp;<br>line<ul><li>a<li>b<ul><li>c</ul></ul>"
            "<ol start=3><li>x</ol><div style='display: none'>no</div><span hidden>no</span><script>no</script>"
            "<table><tr><th>Name<th>N<tr><td>long name<td>1</table><pre>k  v\n  w</pre>end<!-- no --></unknown>")
    want = ("One\n\nTwo bold&\nline\n\n- a\n- b\n  - c\n\n3. x\n\nName      | N\nlong name | 1\n\nk  v\n  w\n\nend")
    assert html_text.render(page) == want
    deep = "<div>" * 20000 + "deep"
    rows = spark.createDataFrame([(1, page, "clash"), (2, None, None), (3, "", ""), (4, deep, ""), (1, page, "x")],
                                 "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(rows).collect()) == sorted(
        [(1, want), (1, want), (2, ""), (3, ""), (4, "deep")])
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<head><title>T</title>Hello <b>x</b>", "Hello x"),
    ("<html><head><title>T</title>\n<meta charset=utf-8>\n<a name=top><h1>Top</h1>text", "Top\n\ntext"),
    ("<head><title>T</title><style>s</style><noscript>n</noscript><span>in</span><p>out", "in\n\nout"),
    ("<head><title>T</title><svg><path/></svg>Hello", "Hello"),
    ("<div>a <svg width=1 /> b</div><p>c <math/> d", "a b\n\nc d"),
    ("<p>a<svg><path d='M'/><g><circle r=1 /></g><title>no</title>no<text>yes <tspan>too</tspan></text>"
     "<text>next</text><defs><text>no</text></defs><text display=none>no</text></svg>b", "a yes too next b"),
    ("<svg><foreignObject><div>in</div></foreignObject><foreignObject/><text/></svg> out", "in\nout"),
    ("<svg><path d='M'><p>out", "out"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></math> holds", "so x=1 holds"),
    ("<p><math><semantics><mi>x</mi><annotation>no</annotation></semantics></math> <annotation>yes</annotation>", "x yes"),
    ("a<object>no</object><iframe>no</iframe><video>no</video><audio>no</audio><canvas>no</canvas>b", "ab"),
])
def test_html_keeps_visible_text(page, want):
    assert html_text.render(page) == want


@pytest.mark.parametrize("page,want", [
    ("<ol start='\u00b2'><li>x</ol><ol start=' +4x'><li>y</ol><ol start='-2'><li>z</ol>", "1. x\n\n4. y\n\n-2. z"),
    ("<ol start=" + "9" * 6000 + "><li>x</ol>", "1. x"),
    ("a<![xyz[ b ]]>c<!ENTITY x>d<?php e ?>f<!>g", "acdfg"),
    ("<!DOCTYPE html [ <!ELEMENT x (y)> ]><p>t", "t"),
    ("<svg><text><![CDATA[1 < 2]]></text></svg>", "1 < 2"),
    ("<ul><li><p>a</p><li><div>b</div>c<li><li>d<ul><li><h2>n</h2></ul></ul>", "- a\n\n- b\nc\n-\n- d\n  - n"),
    ("<ul><li><table><tr><td>1<td>2<tr><td>33<td>4</table></ul>", "-\n1  | 2\n33 | 4"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>aaa<td>b<td>c</table>", "wide    | z\naaa | b | c"),
    ("<table><tr><td colspan=3>a long heading<td>z<tr><td>a<td>b<td>c<td>d</table>", "a long heading | z\na | b | c      | d"),
    ("<table><tr><td rowspan=2>r<td>b<tr><td>c<tr><td>d<td>e</table>", "r | b\n  | c\nd | e"),
    ("<table><tr><td rowspan=2 colspan=2>big<td>1<tr><td>2<tr><td>x<td>y<td>3</table>", "big   | 1\n      | 2\nx | y | 3"),
    ("<table><tr><td>a<td rowspan=0 colspan='-3'>b<tr><td rowspan=99999999>c<td>d<tr><td>e</table>", "a | b\nc | d\n  | e"),
    ("a&nbsp;&nbsp;b  c&nbsp;", "a\u00a0\u00a0b c\u00a0"),
    ("<p style='visibility:hidden'>no<b style='visibility: visible !important'>yes</b>no<i style='display:none;'>no</i>", "yes"),
    ("<p style='x-display:none'>yes<b style='display:inline;DISPLAY : none'>no</b>", "yes"),
    ("x<a href='", "x"), ("x <!-- never ends <p>y", "x"), ("a < b & c &amp", "a < b & c &"), ("x</", "x</"),
])
def test_html_edges(page, want):
    assert html_text.render(page) == want


def test_html_never_fails():
    r = random.Random(11)
    bits = ("<div>,<p>,</p>,<li>,<ul>,<ol start='\u00b2'>,</ol>,<table>,<tr>,<td>,<td colspan=3>,<td rowspan=9>,</table>,<![xyz[,]]>,"
            "<!doctype,<!--,-->,&,&nbsp;,&amp,<,>,<svg>,</svg>,<math>,<mi>,<![CDATA[,x,\n,\u00a0,</br>,<head>,<title>,<body>,<html>,"
            "</html>,<b,<a href=',\",',=,/>,<textarea>,<script>,</script>,<select>,<option>,<pre>,<? ?>,<!x>,<!>,<!- --!>,</,</ >,<//,"
            "<th style='visibility:hidden'>,<i style=visibility:visible>,<blockquote>,<dd>,<caption>,<p hidden>,\x00,\ud800").split(",")
    for _ in range(4000):
        html_text.render("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(1, 50))))


@pytest.mark.parametrize("unit", ["<div>", "<p><table><td><div>", "<li><p>", "<ul><li>", "<a <", "<!--", "<![", "</p>", "<a title=\"",
                                  "<td rowspan=9999>", "<tr><td colspan=999><td>x", "<svg><g>", "<blockquote>", "<script></a"])
def test_html_takes_time_in_proportion(unit):
    begun = time.process_time()
    html_text.render(unit * 20_000 + "end")
    assert time.process_time() - begun < 20       # minutes where the work grows with the square



def test_parity_bitmaps_never_differ_in_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 30, n)).encode() for n in (0, 3, 40, 40, 400, 5000)]
    texts.append(texts[3] + b" more words here")
    doc, s, sizes = jaccard_join._sets(texts, 5)
    bits = jaccard_join._bitmaps(doc, s, len(texts))
    sets = [set(s[doc == i].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(len(texts)):
            apart = sum(int(v).bit_count() for v in (bits[i] ^ bits[j]).view(np.uint64))
            assert apart <= len(sets[i] ^ sets[j])
    assert not bits[0].any() and (bits[3] != bits[2]).any()


def test_wide_bitmaps_keep_every_link_of_large_sets(spark):
    rng = np.random.default_rng(5)
    long = [" ".join(f"w{v}" for v in rng.integers(0, 10 ** 6, n)) for n in (1000, 1000, 1020, 3000)]
    texts = [*long, long[0] + " " + " ".join(f"x{i}" for i in range(60)),    # 1024 shingles lie between
             long[3] + " " + " ".join(f"y{i}" for i in range(500)), long[3] + " " + " ".join(f"z{i}" for i in range(900)),
             " ".join(long[1].split()[:830]), " ".join(long[1].split()[:700])]
    raw = [t.encode() for t in texts]
    doc, s, sizes = jaccard_join._sets(raw, 5)
    sets = [set(s[doc == i].tolist()) for i in range(len(texts))]
    wide = jaccard_join._wide_bitmaps(doc, s, sizes)
    assert {len(w) for w in wide} == {16, 32, 64}
    for i in range(len(texts)):
        for j in range(len(texts)):
            m = min(len(wide[i]), len(wide[j]))
            x, y = (np.bitwise_xor.reduce(wide[k].reshape(-1, m)) for k in (i, j))
            assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(sets[i] ^ sets[j])
    least = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.shingle_components(docs).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) < len(texts)


def test_url_rules_keep_every_item_of_a_url(spark):
    # twelve surer or more frequent items stand before the pair of items that decides
    rows = []
    for k in range(240):
        both = [k % 2, (k // 2) % 2]
        items = ["y%d" % i for i, b in enumerate(both) if b] + ["c%02d" % i for i in range(12) if i >= (k // 4) % 12]
        rows.append((sorted(items), "block" if all(both) else "allow"))
    df = spark.createDataFrame(rows, "items array<string>, verdict string")
    deals = url_rules.transactions(df, url_rules.items_of(df))
    assert max(len(d["items"]) for d in deals.collect()) == 14
    found = {(tuple(f["items"]), f.verdict) for f in url_rules.mine(deals, 0.2, 0.95, 2).collect()}
    assert (("y0", "y1"), "block") in found


def test_mixing_tree_plans_stay_small(spark):
    quotas = spark.createDataFrame([("=a", 400), ("=b", 90), ("-", 22)], "sk string, blocks long")
    got = mixing.split_quotas(quotas, 64)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000                                   # megabytes where a plan holds six levels
    total = {}
    for x in got.collect():
        total[x.sk] = total.get(x.sk, 0) + x.blocks
    assert total == {"=a": 400, "=b": 90, "-": 22}
