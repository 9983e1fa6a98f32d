"""Token counts, centroid clustering and the filter audit against brute force: nulls, empty and very
long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import itertools
import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridcast.llm import filter_audit, hadamard_kmeans as hk, token_counts as tc

WORD = re.compile("[^\x20\x09-\x0d]+")
SPECIAL = "a <|endoftext|> b<|endoftext|><|endoftext|>  c"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tc.TOKENIZER))


def test_token_counts(spark, tokenizer):
    texts = ["plain words, here's one", None, "", " \n\t ", SPECIAL, "é漢字。漢字、\U0001f600 x", "w" * 3000,
             "many  blanks \n\n and lines\r\n " * 2000, SPECIAL * 300, "plain words, here's one", "漢字。" * 3000,
             "he'll say 'tis 12 o'clock " * 500]
    docs = spark.createDataFrame([(i % 9, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    want = sorted((i % 9, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
                  for i, t in enumerate(texts))
    for batch in (64, tc.BATCH):
        got = tc.token_counts(docs, batch=batch).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tc.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_files(spark, file):
    texts = ["Some text  here", "", "x" * 50 + " y\n z", "été 漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kind, raw = tc.tokenizer_file(file)
    assert not tc.can_split(kind, raw)
    if kind == ".json":
        tok = Tokenizer.from_file(public_tokenizers.path(file))
        want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file)).encode(texts)]
    got = tc.token_counts(docs, path=file, batch=8).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want


def test_splits_are_safe(tokenizer):
    rng = np.random.default_rng(3)
    alphabet = list("ab9 \n\t'!.,漢。、é_") + ["'s", "  ", " ", " ", "́", "\u00a0", "\u2003", "\x0b", "—", "<|endoftext|>", "'ll"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, 40))
        pieces = tc.split_text(text, int(rng.integers(1, 9)))
        assert "".join(pieces) == text
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert [i for p in pieces for i in tokenizer.encode(p, add_special_tokens=False).ids] == whole
    assert tc.split_text("x" * 100, 10) == ["x" * 100]
    assert list(tc.batches_of(iter([(0, "aaaa"), (1, "b"), (2, "cc")]), 4)) == [[(0, "aaaa")], [(1, "b"), (2, "cc")]]


def brute_clusters(rows, k, rounds, seed, scale):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e200 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    pick = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds if kept else 0):
        groups = {}
        for (_, v), (_, j) in zip(kept, pick(), strict=True):
            groups.setdefault(j, []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = pick()
    inertia = {j: sum(d for d, c in got if c == j) for _, j in got}
    fit = lambda x: x if x < 1 << 63 else None
    return [(i, j, fit(d), fit(inertia[j]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, got, strict=True)]


def vectors(n, seed, kind=float):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (5, 64))
    return [[kind(x) for x in np.float32(middles[i % 5] + rng.normal(0, 0.1, 64))] for i in range(n)]


def same(a, b):
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_clusters(spark):
    rows = list(enumerate(vectors(120, 1)))
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (200, None), (201, []), (202, [0.5] * 63), (203, [0.0] * 64),
             (204, [float("nan")] * 64), (205, [None, *[0.1] * 63]), (206, [float("inf"), *[0.1] * 63]), (207, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    same(hk.cluster(df).collect(), brute_clusters([(r.vec_id, r.embedding) for r in df.collect()], 8, 10, 3, 1024))
    assert hk.cluster(df.limit(0)).count() == 0
    three = df.filter("vec_id < 3").repartition(3)
    same(hk.cluster(three).collect(), brute_clusters(rows[:3], 8, 10, 3, 1024))


def test_clusters_of_large_and_equal_vectors(spark):
    rows = [(i, [x * s for x in v]) for i, (v, s) in enumerate(zip(vectors(40, 2), [1, 1, 1, 5000, 1e17] * 8, strict=True))]
    rows += [(100 + i, [0.25] * 64) for i in range(20)] + [(300, [1e300] * 64), (301, [-1e307, *[1e307] * 63])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(hk.cluster(df, rounds=3).collect(), brute_clusters(rows, 8, 3, 3, 1024))


def test_progressive_search_equals_full_search():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (8, 64))
    c[5] = c[2]
    full = ((x[:, None] - c[None]) ** 2).sum(-1)
    cluster, distance = hk.nearest(hk.hadamard(x), hk.hadamard(c))
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
    changes = [int(sum(a != b for a, b in itertools.pairwise(np.sign(r)))) for r in hk.hadamard(np.eye(64, dtype=np.int64)).T]
    assert changes == list(range(64))


def brute_audit(rows, labels):
    fails, seen = [], {}
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        least = min((j for j, u, _ in rows if (u or "") == t and j is not None), default=None)
        fails.append((lang or "", i, {f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > least), strict=True) if bad}))
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for k, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                total[letter] += len(gone)
                out[part, order, k] = [len(left), len(gone), sum(letter in f for _, f in mine) - len(gone),
                                       sum(f == {letter} for _, f in mine), sum(i in good for i, _ in gone),
                                       sum(i in toxic for i, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return [(*k, *v) for k, v in out.items()]


def test_filter_audit(spark):
    long = " ".join(f"w{i}" for i in range(150))
    texts = ["short", None, "", long, long + " #", "A B C " * 50, "x " * 120, long, long, "LOUD $ TEXT", long.upper(), "x " * 30_000]
    langs = ["en", None, "", "de", "en", "de", "en", "de", "de", "fr", "fr", "de"]
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    rows += [(3, long, "de"), (None, long, "en"), (None, "only here " * 70, "en"), (20, "only here " * 70, "en"), (3, long, "es"), (3, "short", "de")]
    labels = [(0, 1, 0), (0, 0, 1), (7, 1, None), (3, 1, 1), (8, 0, 1), (99, 1, 1), (None, 1, 1), (20, None, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(docs, marks).collect()]
    assert sorted(got) == sorted(brute_audit(rows, labels))
    assert len(got) == 600 * len({g or "" for _, _, g in rows})
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
