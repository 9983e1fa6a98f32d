"""Registered queries of the operators and their DuckDB SQL (where SQL can express one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import (
    filter_audit, hadamard_kmeans, hnsw_dedup, html_text, imatch, jaccard_join, mixing, quality, sentencepiece_codec,
    substring_dedup, token_counts, toxicity, url_rules,
)
from gridcast.llm.common import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_codec.load_pieces()
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    coded = sentencepiece_codec.encode(docs, pieces, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic", 5, 0, toxicity.FIT_ROWS))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(toxicity.labelled_sample(docs, labels, "quality", 4, 2, quality.FIT_ROWS))
    return quality.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.shingle_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("shards")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages", "page_id", "html")).select(
        "page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_kmeans.cluster(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                              read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_imatch, op3_toxicity, op4_quality, op5_url_rules,
                                   op6_ngram_join, op7_mixing, op8_hnsw, op9_html, op10_substring,
                                   op11_token_counts, op12_hadamard, op13_filter_audit)}

_WORD = r"'[^\x20\x09-\x0D]+'"

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size,
         md5(concat_ws(':', '{mixing.SEED}', CAST(doc_id AS VARCHAR))) AS ord
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) AS rnk FROM d GROUP BY source),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][CAST(rnk % 3 + 1 AS INTEGER)] AS DOUBLE) AS w,
             CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
lv AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER b, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
  FROM w WINDOW b AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(lvl) OVER () * w) AS target FROM lv),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5) AS quota,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)) AS BIGINT) AS taken
FROM p
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS seq FROM p),
r AS (SELECT doc_id, s FROM k WHERE seq IN (SELECT seq FROM k GROUP BY seq HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
         FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_TERMS = ("list_filter(list_distinct(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+')), lambda x: x <> '')")


def _op2_sql() -> str:
    lo, hi = imatch.BAND
    rate = ", ".join(f"{imatch.RATES[k // imatch.COPIES]}" for k in range(imatch.SUBSETS))
    weight = 100 * imatch.COPIES + 1
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS nid,
             coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, n - n // 3) || substr(nt, 1, n // 3) AS et FROM n),
a AS (SELECT doc_id, 0 AS side, unnest({_TERMS.format('t')}) AS term FROM e
      UNION ALL SELECT doc_id, 1, unnest({_TERMS.format('et')}) FROM e),
f AS (SELECT term FROM a WHERE side = 0 GROUP BY term
      HAVING count(*) BETWEEN greatest(2, ceil({lo} * (SELECT count(*) FROM d)))
                          AND greatest(2, floor({hi} * (SELECT count(*) FROM d)))),
x AS (SELECT term, sha256(term) || sha256(term || '#') AS h FROM f),
m AS (SELECT term, k FROM (SELECT term, h, unnest(range(0, {imatch.SUBSETS})) AS k FROM x)
      WHERE CAST('0x' || substr(h, CAST(3 * k + 1 AS INTEGER), 3) AS INTEGER) < [{rate}][k + 1]),
g AS (SELECT doc_id, side, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 10) AS sig
      FROM a JOIN m USING (term) GROUP BY doc_id, side, k),
grid AS (SELECT doc_id, side, k, sig FROM
         (SELECT DISTINCT doc_id, side FROM g) CROSS JOIN (SELECT unnest(range(0, {imatch.SUBSETS})) AS k) LEFT JOIN g USING (doc_id, side, k)),
fp AS (SELECT doc_id, side, string_agg(coalesce(sig, ''), '-' ORDER BY k) AS fp FROM grid GROUP BY doc_id, side),
z AS (SELECT e.doc_id, e.nid, e.n, sha256(e.et) AS edited_sha256, coalesce(p.fp, 'text:' || md5(e.t)) AS fingerprint,
             coalesce(q.fp, 'text:' || md5(e.et)) AS edited_fingerprint
      FROM e LEFT JOIN fp p ON p.doc_id = e.doc_id AND p.side = 0 LEFT JOIN fp q ON q.doc_id = e.doc_id AND q.side = 1),
pairs AS (SELECT z.doc_id, 'e' AS kind, z.fingerprint AS a, z.edited_fingerprint AS b FROM z
          UNION ALL SELECT z.doc_id, 'n', z.fingerprint, y.fingerprint FROM z JOIN z y ON y.doc_id = z.nid),
cells AS (SELECT doc_id, kind, unnest(range(0, {imatch.SUBSETS})) // {imatch.COPIES} AS lvl,
                 unnest(string_split(a, '-')) AS p, unnest(string_split(b, '-')) AS q
          FROM pairs WHERE a NOT LIKE 'text:%' AND b NOT LIKE 'text:%' AND a <> b),
lvls AS (SELECT doc_id, kind, lvl, sum(CASE WHEN p <> '' OR q <> '' THEN 1 ELSE 0 END) AS seen,
                sum(CASE WHEN p <> '' AND p = q THEN 1 ELSE 0 END) AS same FROM cells GROUP BY ALL),
likes AS (SELECT doc_id, kind, CAST(sum(({weight} - 100 * seen) * same) AS DOUBLE)
                 / CAST(sum(({weight} - 100 * seen) * seen) AS DOUBLE) AS near FROM lvls GROUP BY doc_id, kind),
res AS (SELECT p.doc_id, p.kind, coalesce(l.near, CASE WHEN p.a = p.b THEN 1.0 ELSE 0.0 END) AS near
        FROM pairs p LEFT JOIN likes l USING (doc_id, kind))
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_chars, z.edited_sha256, z.fingerprint, z.edited_fingerprint,
       re.near AS near_edited, rn.near AS near_next
FROM z JOIN res re ON re.doc_id = z.doc_id AND re.kind = 'e' JOIN res rn ON rn.doc_id = z.doc_id AND rn.kind = 'n'
"""


OP6_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS gram FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""


def _op12_sql() -> str:
    k, dim = hadamard_kmeans.K, hadamard_kmeans.DIM
    rounds = [f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{hadamard_kmeans.SEED}:' || vec_id), v) - 1 AS c, v
  FROM e QUALIFY c < {k})"""]
    near = f"""SELECT vec_id, row, e.v, min({{'d': list_sum(list_transform(range(1, {dim} + 1),
         lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i]))), 'c': c.c}}) AS m FROM e CROSS JOIN <from> AS c GROUP BY ALL"""
    for r in range(1, hadamard_kmeans.ROUNDS + 1):
        rounds.append(f"""a{r} AS MATERIALIZED ({near.replace('<from>', f'c{r - 1}')}),
s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT m.c AS c, unnest(v) AS x, unnest(range(1, {dim} + 1)) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r - 1} o LEFT JOIN m{r} m USING (c))""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
{', '.join(rounds)},
z AS MATERIALIZED ({near.replace('<from>', f'c{hadamard_kmeans.ROUNDS}')})
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM z JOIN c{hadamard_kmeans.ROUNDS} c ON c.c = m.c
"""


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w
  FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INTEGER)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
p AS (SELECT '' AS prefix, 0 AS bit, 0 AS before, 0 AS step
      UNION ALL SELECT prefix || name, b.bit, before | p.bit, step + 1 FROM p JOIN b ON (before | p.bit) & b.bit = 0),
s AS (
  SELECT part, prefix, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN p WHERE step > 0 GROUP BY ALL),
o AS (SELECT s.*, q.prefix AS filter_order FROM s JOIN p q ON q.step = 5 AND q.prefix[1:s.step] = s.prefix)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM o
"""

ORACLE_SQL = {"op2_imatch": _op2_sql(), "op6_ngram_join": OP6_SQL, "op7_mixing": OP7_SQL, "op10_substring": OP10_SQL,
              "op12_hadamard": _op12_sql(), "op13_filter_audit": OP13_SQL}
