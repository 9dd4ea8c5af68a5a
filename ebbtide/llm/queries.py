"""The registered queries of the document operators: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    bit_plane_clusters,
    bpe,
    decontamination,
    importance_resampling,
    language_id,
    licences,
    near_dedup,
    pii,
    quality_attention,
    quality_rules,
    token_counts,
    token_files,
    toxicity,
)
from ebbtide.llm.texts import fold_of, read_table
from ebbtide.session import shared_dir


def vocabulary_path() -> str:
    """The public byte-level vocabulary; installed on every machine like the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=2, similarity=80)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    encoded = read_table(spark, sf_dir, "documents").select("doc_id", bpe.encode("text", path).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe.decode("ids", path))
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(read_table(spark, sf_dir, "documents"), folder, vocabulary_path(), end_id=2)
    return token_files.read_back(spark, folder)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    fold = fold_of("doc_id", 4)
    model = toxicity.learn(documents, labels.where(fold != 2))
    scored = documents.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), toxicity.score(documents, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of("doc_id", 3)
    model = language_id.learn(documents.where(fold != 1))
    scored = documents.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), language_id.identify(documents, model).alias("found"))
    return scored.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: str, kind: Callable) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.PATTERNS]
    base = joined("base", lambda s: s["kind"])
    every = F.concat_ws(",", F.when(F.size("base") > 0, base), joined("terms", lambda s: F.lit("term")))
    n_terms = F.coalesce(F.array_size("terms"), F.lit(0)).cast("long").alias("n_term")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), n_terms)


def op10_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    fold = fold_of("doc_id", 5)
    model = quality_attention.learn(documents, labels.where(fold != 0))
    scored = documents.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), quality_attention.score(documents, model).alias("found"))
    return scored.select("doc_id", "held_out", "found.*").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    counted = documents.select("doc_id", n_bytes, token_counts.count("text", vocabulary_path()).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op12_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_plane_clusters.cluster(read_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return importance_resampling.resample(documents, benchmark, percent=10, seed=2024, buckets=10_000, longest=1, least_words=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_licences": op4_licences,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_quality_attention": op10_quality_attention,
    "op11_token_counts": op11_token_counts,
    "op12_bit_plane_clusters": op12_bit_plane_clusters,
    "op13_importance_resampling": op13_importance_resampling,
}

def _clusters_sql(clusters: int, rounds: int, seed: int) -> str:
    """Exact k-means, a pair of expressions a round."""
    steps = [
        f"""WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS q FROM rows),
v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(q) AS x FROM q),
c0 AS MATERIALIZED (SELECT n AS k, unnest(range(64)) AS i, unnest(q) AS x FROM (
  SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS n FROM q) WHERE n < {clusters})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, min(far) AS far, arg_min(k, (far, k)) AS k FROM (
  SELECT r, k, CAST(sum((v.x - c{n}.x) * (v.x - c{n}.x)) AS BIGINT) AS far FROM v JOIN c{n} USING (i) GROUP BY r, k) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{n} USING (r) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN m.s IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{n} c LEFT JOIN m{n} m USING (k, i))""")
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(far) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN q USING (r) JOIN (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY k) USING (k)"""
    )


#: What SQL can express; the others learn from the data or encode bytes, and are held against brute force in tests/llm.
SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingles FROM words),
sizes AS (SELECT doc_id, len(shingles) AS n FROM sets),
single AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM single x JOIN single y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS place FROM sizes UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.place = edges.a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT id AS doc_id, min(place) AS component_id FROM reach GROUP BY id) USING (doc_id)
""",
    "op12_bit_plane_clusters": _clusters_sql(8, 10, 3),
    # crc32 by its table of 256 entries, over the bytes of each distinct word.
    "op13_importance_resampling": r"""
WITH
entries AS (SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
texts AS MATERIALIZED (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, 0, coalesce(text, '') FROM benchmark),
words AS MATERIALIZED (SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
kinds AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM words),
coded AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM kinds, entries),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN coded USING (w) GROUP BY bucket),
sums AS (SELECT CAST(sum(s) AS BIGINT) AS all_s, CAST(sum(t) AS BIGINT) AS all_t FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain FROM counts, sums),
weights AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM words JOIN coded USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, n_features >= 20 AS eligible, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN eligible AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM ranked
""",
}
