"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, licenses, minhash, mixing, negatives, packing, phrases, quality, repeats, sharding, toxicity, urls, vectors
from .common import documents


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return licenses.scan(documents(spark, sf_dir)).select(*cols)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "tokens", "chance", "drawn")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.score(documents(spark, sf_dir)).select(*cols, "log_perplexity", "low", "high")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


_ALL = (
    op1_suffix_array, op2_url_filter, op3_embedding_duplicates, op4_toxicity, op5_best_fit_packing, op6_license_scan, op7_sharding, op8_mixing, op9_quality, op10_minhash,
    op11_phrases, op12_fingerprints, op13_hard_negatives,
)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """The list of domains here is the cascade's: in SQL it is a plain look-up."""
    listed = ", ".join(f"('{x}')" for x in urls.LISTED)
    op2 = f"""
    WITH parts AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
    ), rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in urls.RULES)}), listed(h) AS (VALUES {listed}),
    fits AS (
        SELECT page_id, host, path, max_by(rules.h || rules.p, length(rules.h || rules.p)) AS rule, max_by(rules.verdict, length(rules.h || rules.p)) AS said
        FROM parts LEFT JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.p) GROUP BY ALL
    )
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
    FROM (SELECT *, EXISTS (SELECT 1 FROM listed WHERE host = listed.h OR ends_with(host, '.' || listed.h)) AS listed FROM fits)
    """
    op3 = f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {vectors.COSINE}
    ), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN lowest ON vec_id = lowest.a LEFT JOIN counted ON vec_id = counted.a
    """
    op11 = f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
    spans AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS sizes(m)),
    f AS MATERIALIZED (SELECT lang, m, w[i : i + m - 1] AS p, count(*) AS a FROM spans GROUP BY ALL),
    sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    cut AS (SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND a >= 10),
    scored AS (
        SELECT c.lang, c.m, c.p, c.a, c.k, h.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * r.a))::BIGINT AS score
        FROM cut c JOIN f h ON h.lang = c.lang AND h.p = c.p[: c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1 :]
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    longer AS (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, a FROM f WHERE m = 3 AND a >= 10),
    kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = b.lang AND x.p = b.p AND 100 * x.a >= 50 * b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
    """
    op13 = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    ), met AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    ), positives AS (SELECT anchor_id, id, score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY m.score DESC, m.id))::INT AS rank, m.id AS negative_id, p.score AS positive_score, m.score AS negative_score
    FROM positives p JOIN met m ON p.anchor_id = m.anchor_id AND NOT m.same AND 50 * p.score <= 100 * m.score AND 100 * m.score <= 95 * p.score QUALIFY rank <= 3
    """
    return {"op2_url_filter": op2, "op3_embedding_duplicates": op3, "op11_phrases": op11, "op13_hard_negatives": op13}
