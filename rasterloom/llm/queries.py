"""Queries of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.common import materialize, table
from rasterloom.llm import cluster, leakage, neighbours, packing, repetition


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "model_results"), table(spark, d, "model_catalog")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(*_vectors(spark, d))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """All five neighbours, however far: with denser graphs in smaller shards than pairs of 0.8 and more need."""
    return neighbours.nearest_vectors(*_vectors(spark, d), shard_rows=16_384, ef=64, m=20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster.mutual_groups(*_vectors(spark, d)).select("cluster_id", "result_id")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.describe(*_vectors(spark, d))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(materialize(packing.token_counts(table(spark, d, "documents")), "tokens"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p7_packed(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, checked over all documents: each is packed whole once, no container is overfull, tokens
    lie side by side, and only documents of more tokens than the capacity are cut."""
    docs = table(spark, d, "documents")
    sizes = materialize(packing.token_counts(docs), "tokens")
    packed = materialize(packing.pack(sizes), "packed")
    by_doc = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"))
    want = F.greatest(F.ceil(F.col("n_tokens") / 4096), F.lit(1))
    whole = sizes.join(by_doc, "doc_id", "left").agg(
        F.count("*").alias("n_docs"), F.count_if(~(F.coalesce("packed", F.lit(-1)) == F.col("n_tokens"))).alias("wrong_tokens"), F.count_if(~(F.coalesce("pieces", F.lit(0)) == want)).alias("wrong_pieces")
    )
    boxes = packing.containers(packed)
    ends = packed.groupBy("container_id").agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("used"))
    full = boxes.agg(F.count_if(F.col("unused") < 0).alias("overfull"), F.count_if(F.col("unused") > 4096 * 0.02).alias("slack"))
    tight = ends.agg(F.count_if(F.col("end") != F.col("used")).alias("gaps"))
    return whole.join(full).join(tight).select("n_docs", "wrong_tokens", "wrong_pieces", "overfull", "gaps", (F.col("slack") <= 1).alias("tight"))  # single rows


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("distance = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_method(spark: SparkSession, d: str) -> DataFrame:
    return repetition.scores(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents")).filter("repetitive").select("doc_id")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents")).select("doc_id", "n_words", F.round("share", 9).alias("share"))


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_nearest, p4_found, p4_clusters, p7_packed, p7_containers, p7_invariants, p8_found, p8_near, p9_method, p9_found, p9_share)}


_USABLE = """
u AS (SELECT DISTINCT r.result_id, r.model, CAST(r.embedding AS DOUBLE[]) AS e FROM model_results r
  JOIN model_catalog c ON c.model = r.model AND len(r.embedding) = c.dim
  WHERE r.result_id IS NOT NULL AND len(list_filter(r.embedding, lambda v: v IS NULL OR isnan(v))) = 0
    AND len(list_filter(r.embedding, lambda v: v <> 0)) > 0),
s AS (SELECT a.model, a.result_id AS i, b.result_id AS j, CASE WHEN a.e = b.e THEN 1.0 ELSE list_cosine_similarity(a.e, b.e) END AS sim
  FROM u a JOIN u b ON a.model = b.model AND a.result_id <> b.result_id)"""
_WORDS = r"""regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"""
_CLEAN = r"lower(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '[-‐]\r?\n', '', 'g'))"
_BARE = r"lower(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '[-‐]\r?\n', '', 'g'), '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g'))"
_RUNS = """
w AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM w),
c AS (SELECT doc_id, n, len(g) AS runs, len(g) - len(list_distinct(g)) AS again FROM g)"""


def oracle_sql() -> dict[str, str]:
    runs = _RUNS.format(words=_WORDS.format(_CLEAN))
    grams = "SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL)"
    d, i = (grams.format(key=k, words=_WORDS.format(_BARE), table=t) for k, t in (("doc_id", "documents"), ("item_id", "eval_items")))
    return {
        "p1_found": f"WITH {_USABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS k FROM s) SELECT DISTINCT least(i, j) AS result_id_1, greatest(i, j) AS result_id_2 FROM r WHERE k <= 5 AND sim >= 0.8",
        "p4_found": f"""WITH {_USABLE}, n AS (SELECT i, list_sort(list_append(list(j), i)) AS g FROM s WHERE sim >= 0.8 GROUP BY i),
c AS (SELECT g FROM n GROUP BY g HAVING count(*) = len(g) AND len(g) >= 3) SELECT g[1] AS cluster_id, unnest(g) AS result_id FROM c""",
        "p7_invariants": "SELECT count(*) AS n_docs, 0::BIGINT AS wrong_tokens, 0::BIGINT AS wrong_pieces, 0::BIGINT AS overfull, 0::BIGINT AS gaps, TRUE AS tight FROM documents",
        "p8_found": f"WITH d AS ({d}), i AS ({i}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
        "p9_found": f"WITH {runs} SELECT doc_id FROM c WHERE n >= 30 AND again >= 0.3 * runs - 1e-9",
        "p9_share": f"""WITH {runs} SELECT d.doc_id, coalesce(c.n, 0) AS n_words, round(CASE WHEN c.runs > 0 THEN c.again / c.runs ELSE 0.0 END, 9) AS share
FROM documents d LEFT JOIN c USING (doc_id)""",
    }
