"""The registered queries of the training-data operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm.common import materialize, table
from thalweg.llm.tokens import tokenizer_path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.editprint import edit_fingerprints, near_groups

    return near_groups(materialize(edit_fingerprints(table(spark, sf_dir, "documents")), "prints"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, share=85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.pfor import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.license import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.centroids import cluster_vectors, with_inertia

    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thalweg.llm.ngrams import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), width=4, share=85)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_edit_fingerprints": op2_edit_fingerprints,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality": op6_quality,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_centroids": op11_centroids,
    "op12_whitening": op12_whitening,
    "op13_ngram_join": op13_ngram_join,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _links_sql(width: int, share: int) -> str:
    """Components of documents by links between sets of ``width``-word shingles."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(width))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {width} THEN list_transform(range(1, len(ws) - {width - 2}), lambda i: {shingle})
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= {share} * (nx.n + ny.n - i)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.component, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.component, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _lloyd_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """Whole-number Lloyd rounds, one pair of subqueries a round."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda c: isfinite(c))) = {size})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"d{r} AS (SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r}),"
            f" a{r} AS (SELECT vec_id, any_value(x) AS x, min_by(c, d * {k} + c) AS c, min(d) AS d FROM d{r} GROUP BY vec_id)"
        )
        if r < rounds:
            parts.append(
                f"s{r} AS (SELECT c, place, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({size})) AS place FROM a{r}) GROUP BY c, place),"
                f" m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM s{r} GROUP BY c),"
                f" c{r + 1} AS (SELECT c{r}.c, CAST(coalesce(m{r}.x, c{r}.x) AS BIGINT[]) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)"
            )
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST({last}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON {last}.c = c{rounds}.c"
    )


ORACLE_SQL: dict[str, str] = {
    "op5_near_duplicates": _links_sql(3, 85),
    "op9_decontamination": rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda k: array_to_string(ws[k : k + least(13, len(ws)) - 1], ' '))) AS win
  FROM i WHERE len(ws) > 0
), d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), sizes AS (SELECT DISTINCT size FROM iw
), dw AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS k, unnest(list_transform(range(1, len(ws) - size + 2), lambda k: array_to_string(ws[k : k + size - 1], ' '))) AS win
  FROM d, sizes WHERE len(ws) >= size
), m AS (SELECT DISTINCT doc_id, k, dw.size, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size
), h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS w FROM m) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op11_centroids": _lloyd_sql(),
    "op13_ngram_join": _links_sql(4, 85),
}
