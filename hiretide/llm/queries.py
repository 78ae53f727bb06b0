"""The registered queries of this subpackage, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.llm import (
    decontamination, embedding_dedup, importance, language_id, license_scan, lm_scoring, orchard, packing, sharding, simhash, span_dedup,
    suffix_dedup, toxicity,
)
from hiretide.llm.common import fold, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the digest of their ids and their place in a sequence."""
    pieces = packing.tokenise(docs.select("doc_id", "text"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language_id.train(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model, drop=("text",))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontamination.digest_items().alias("items_sha256"), "contaminated")


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    found = sharding.interleaved_shards(rows, tie="text_crc32")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@query("op6_span_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", F.to_json("removed").alias("removed"), "text")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    confirmed = F.filter("blocks", lambda b: b["confirmed"])
    return found.select(
        "doc_id", F.size("blocks").cast("bigint").alias("n_blocks"), F.size(confirmed).cast("bigint").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda b: b["license"]))), ",").alias("licenses"),
        F.to_json("blocks").alias("blocks"),
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = docs.join(labels, "doc_id").select("doc_id", "text", (F.col("quality") == 0).alias("low_quality"), (F.col("toxic") == 1).alias("toxic"))
    chain = toxicity.train(labelled, ["low_quality", "toxic"])
    return toxicity.predict(docs, chain)


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) == 0).alias("held_out"))
    docs = docs.withColumn("learn", ~F.col("held_out"))
    return lm_scoring.score(docs, "learn").drop("learn")


@query("op10_embedding_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


@query("op11_orchard_clustering")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return orchard.cluster_vectors(rows, keep_vector=False)


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


@query("op13_suffix_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeated_bytes(docs, keep_text=False)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op4_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n_words FROM b),
win AS (
  SELECT DISTINCT item, n, t FROM (
    SELECT item, n, i, n_words, string_agg(word, ' ') OVER (PARTITION BY item ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS t FROM bw)
  WHERE i + n - 1 <= n_words),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n_words FROM d),
g AS (
  SELECT doc_id, i, n, n_words, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS t
  FROM dw CROSS JOIN (SELECT DISTINCT n FROM win)),
m AS (SELECT doc_id, i, n, item FROM g JOIN win USING (n, t) WHERE i + n - 1 <= n_words),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)"""

SQL["op10_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(c AS BIGINT) AS component_id, c = e.vec_id AS kept
FROM embeddings e JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) k ON k.x = e.vec_id
LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) l ON l.x = e.vec_id"""

_START, _ROUNDS = range(8), range(10)


def _clustering_sql() -> str:
    """All rounds written out; sums are exact, quotients rounded down."""
    parts = ["""
v AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, 65)) AS d, unnest(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) ORDER BY c LIMIT 8),
c0 AS MATERIALIZED (SELECT c, d, x FROM seed JOIN v USING (vec_id))"""]
    for r in [*_ROUNDS, len(_ROUNDS)]:
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, q * 8 + c) AS c, min(q) AS q
  FROM (SELECT vec_id, c, sum((v.x - k.x) * (v.x - k.x)) AS q FROM v JOIN c{r} k USING (d) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < len(_ROUNDS):
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c, d, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (
    SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
    FROM (SELECT c, d, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, d)) n USING (c, d))""")
    last = len(_ROUNDS)
    return f"""
WITH {",".join(parts)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(q AS BIGINT) AS distance, CAST(sum(q) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(q) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN h USING (c)"""


SQL["op11_orchard_clustering"] = _clustering_sql()

_CRC_STEP = "SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM"

SQL["op12_importance_resampling"] = rf"""
WITH RECURSIVE t8 AS MATERIALIZED ({_CRC_STEP} ({_CRC_STEP} ({_CRC_STEP} ({_CRC_STEP} ({_CRC_STEP} ({_CRC_STEP} ({_CRC_STEP} ({_CRC_STEP} (
  SELECT i, i AS c FROM range(256) r(i)))))))))),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
words AS (SELECT doc_id, unnest(w) AS word FROM d),
target AS (SELECT unnest(w) AS word FROM b),
spelled AS (SELECT word, encode(word) AS x, octet_length(encode(word)) AS size FROM (SELECT word FROM words UNION SELECT word FROM target)),
moves AS (
  SELECT -1 AS i, 0 AS n, 4294967295 AS c UNION ALL SELECT i, 0, c FROM t8
  UNION ALL SELECT m.i, n + 1, xor(m.c >> 8, t8.c) FROM moves m JOIN t8 ON t8.i = m.c & 255 WHERE n < (SELECT max(size) FROM spelled)),
bytes AS (SELECT word, size, unnest(range(1, size + 1)) AS pos, x FROM spelled),
hashed AS (
  SELECT word, xor(xor(bit_xor(m.c), any_value(z.c)), 4294967295) % 10000 AS bucket
  FROM (SELECT word, size, size - pos AS n, CAST('0x' || substr(hex(x), 2 * pos - 1, 2) AS BIGINT) AS i FROM bytes) y
  JOIN moves m USING (i, n) JOIN moves z ON z.i = -1 AND z.n = y.size GROUP BY word),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * (ss + 10000)) / ((coalesce(s.n, 0) + 1) * (tt + 10000)))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket),
    (SELECT coalesce(sum(n), 0) AS ss FROM s), (SELECT coalesce(sum(n), 0) AS tt FROM t)),
weighed AS (SELECT doc_id, sum(g) AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= 10 * n // 100 THEN r END AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
