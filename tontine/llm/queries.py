"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tontine.llm import bitplanes, decontam, exact, jaccard, linededup, mainhtml, pieces, quality, ranked, sharding, tokens, topk, warc
from tontine.llm.registry import QUERIES, SQL, Build, query, table


def queries() -> dict[str, Build]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def held_out(key: str = "doc_id") -> Column:
    """The fold that never trains: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@query(
    "op1_topk",
    """WITH u AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM u),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.w) = len(c.w) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality.score(documents, model).withColumnRenamed("key", "doc_id")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "d",
        "r",
    )


@query("op3_pieces")
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query(
    "op4_jaccard",
    r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.m FROM r JOIN e ON r.doc_id = e.x WHERE r.m < e.y)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(m) AS component_id
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
)
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


@query("op5_mainhtml")
def op5_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mainhtml.extract(pages, mainhtml.learn(pages))


@query(
    "op6_warc",
    """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS origin FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM g""",
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(spark, path).drop("url")


@query(
    "op7_linededup",
    """WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (
  SELECT DISTINCT source, text, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)),
common AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source = t.source WHERE l.line <> ''
  GROUP BY l.source, l.line, t.pages HAVING count(*) >= 5 AND count(*) * 100 > t.pages),
bad AS (SELECT source, list(line) AS bad FROM common GROUP BY source),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)),
           lambda x: NOT list_contains(coalesce(b.bad, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM documents d LEFT JOIN bad b ON d.source = b.source)
SELECT doc_id, CASE WHEN kept IS NULL OR len(kept) = len(lines) THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(lines) - len(kept), 0) AS INTEGER) AS dropped_lines
FROM cut""",
)
def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean(table(spark, sf_dir, "documents")).select("doc_id", "text", "dropped_lines")


@query("op9_decontam")
def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, _ = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


@query("op10_tokens")
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.archive(table(spark, sf_dir, "documents"))
    records = tokens.read_shards(spark, path)
    return records.select(
        "slot",
        "shard",
        (F.col("slot") % tokens.ROWS_PER_SHARD).cast("int").alias("position"),
        "doc_id",
        "part",
        "n_tokens",
        F.length("tokens").alias("stride"),
        F.crc32("tokens").alias("tokens_crc32"),
    )


@query(
    "op11_exactdedup",
    """WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256, 0 AS chain
FROM g""",
)
def op11_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def centroid_sql(k: int, rounds: int) -> str:
    """K-means in plain SQL: one pair of tables per round."""
    body = f"""WITH v AS (
  SELECT vec_id, row_number() OVER () AS i,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT w, sha256('1:' || CAST(vec_id AS VARCHAR)) AS name FROM v WHERE vec_id IS NOT NULL),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY name, w) - 1 AS INTEGER) AS cluster, w FROM h ORDER BY name, w LIMIT {k}),"""
    for r in range(rounds + 1):
        body += f"""
d{r} AS (
  SELECT v.i, v.vec_id, v.w, c.cluster,
         CAST(list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c{r} c),
a{r} AS (
  SELECT i, any_value(vec_id) AS vec_id, any_value(w) AS w, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster
  FROM d{r} GROUP BY i),"""
        if r < rounds:
            body += f"""
m{r} AS (
  SELECT cluster, list(whole ORDER BY j) AS w FROM (
    SELECT cluster, j, CAST(sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS whole
    FROM (SELECT cluster, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM a{r}) GROUP BY cluster, j)
  GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.w, c.w) AS w FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster),"""
    return (
        body.rstrip(",")
        + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
    )


@query("op12_centroids", centroid_sql(bitplanes.K, bitplanes.ROUNDS))
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(table(spark, sf_dir, "embeddings"))


@query(
    "op13_ranked",
    r"""WITH t AS (
  SELECT i, doc_id, unnest(ws) AS w FROM (
    SELECT row_number() OVER () AS i, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents)),
u AS (
  SELECT item_id, unnest(ws) AS w FROM (
    SELECT item_id, regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM benchmark GROUP BY item_id)),
q AS (SELECT item_id, w, count(*) AS qtf FROM u GROUP BY ALL),
tf AS (SELECT i, doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT i, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY i),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
weight AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM df, s),
p AS (
  SELECT tf.i, tf.doc_id, tf.w, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)) AS impact
  FROM tf JOIN n ON tf.i = n.i CROSS JOIN s WHERE tf.w IN (SELECT w FROM q)),
r AS (
  SELECT item_id, i, doc_id, CAST(sum(qtf * weight * impact) AS BIGINT) AS score
  FROM q JOIN weight ON q.w = weight.w JOIN p ON p.w = q.w WHERE doc_id IS NOT NULL GROUP BY ALL),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 20""",
)
def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
