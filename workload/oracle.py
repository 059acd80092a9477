"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from opinarium.functions.text import FUNNEL_STOP_WORDS, REPORT_STOP_WORDS

MIN = 30

# RE2 has no Unicode white space or word classes, so both are spelled out.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = "a-záàâãéèêíïóôõöúüçñ"
REPORT = "a-záâãéêíóôõúç"
WORD = r"\p{L}\p{N}_"

CTES = {
    "v_reviews": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id,
               md5(CAST(l_orderkey AS VARCHAR)) AS reviewer_id,
               CAST(l_partkey AS VARCHAR) AS product_id,
               p_name AS product_name,
               CASE WHEN l_linenumber <> 6 THEN s_name END AS product_brand,
               p_type AS site_category_lv1,
               concat('size-', p_size) AS site_category_lv2,
               p_name AS review_title,
               CASE WHEN l_returnflag <> 'N' THEN concat('Sold by ', s_name) END AS review_text,
               CASE WHEN l_linenumber <> 7 THEN CAST(floor((l_quantity - 1) / 10) AS INTEGER) + 1 END AS overall_rating,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity < 21 THEN 0 WHEN l_quantity >= 31 THEN 1 END AS polarity,
               CASE l_linestatus WHEN 'O' THEN 'Yes' ELSE 'No' END AS recommend_to_a_friend,
               round(l_discount * 10, 4) AS pred_prob,
               CASE WHEN l_returnflag = 'R' THEN NULL WHEN round(l_discount * 10, 4) >= 0.5 THEN 1 ELSE 0 END AS pred_label,
               l_shipdate AS submission_date,
               CASE WHEN l_linenumber <> 5 THEN CAST(l_suppkey % 60 + 1940 AS DOUBLE) END AS reviewer_birth_year,
               CASE WHEN l_linenumber < 4 THEN 'F' ELSE 'M' END AS reviewer_gender,
               CASE WHEN l_linenumber <> 2 THEN concat('S', l_linenumber) END AS reviewer_state,
               CASE WHEN l_linenumber IN (2, 4, 6) THEN 'val' ELSE 'test' END AS split,
               concat('model_', l_linestatus) AS model,
               l_partkey % 200 + 200 AS tokens_in,
               l_suppkey % 10 + 5 AS tokens_out,
               round(l_extendedprice / 100000, 4) AS seconds,
               CASE WHEN l_returnflag = 'R' THEN 'TimeoutError: late' WHEN l_linenumber < 4 THEN '' END AS failure
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_docs": """
        SELECT doc_id, text AS review_text, split_part(text, chr(10), 1) AS review_title, source AS product_id,
               lang AS reviewer_id, quality AS polarity,
               CASE quality WHEN 1 THEN 5 WHEN 0 THEN 1 END AS overall_rating
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "v_vectors": "SELECT CAST(vec_id AS VARCHAR) AS product_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "v_predictions": """
        SELECT review_id AS row_id, split, polarity AS true_polarity, pred_label AS predicted_polarity,
               failure AS error, tokens_in AS input_tokens, tokens_out AS output_tokens, seconds AS response_time_s
        FROM v_reviews WHERE polarity IS NOT NULL""",
    "cells": """
        SELECT product_id, 0 AS a, product_name AS v FROM v_reviews
        UNION ALL SELECT product_id, 1, product_brand FROM v_reviews
        UNION ALL SELECT product_id, 2, site_category_lv1 FROM v_reviews
        UNION ALL SELECT product_id, 3, site_category_lv2 FROM v_reviews""",
    "modes": """
        SELECT product_id, a, v FROM (
            SELECT product_id, a, v, row_number() OVER (PARTITION BY product_id, a ORDER BY count(*) DESC, v) AS r
            FROM cells WHERE v IS NOT NULL GROUP BY product_id, a, v) WHERE r = 1""",
    "v_totals": """
        SELECT product_id, count(*) AS num_reviews,
               coalesce(avg(CASE WHEN pred_label IS NOT NULL THEN CAST(pred_label = 1 AS INTEGER) END), 0.0) AS sentiment_score,
               coalesce(avg(CASE WHEN overall_rating IS NOT NULL THEN CAST(overall_rating >= 4 AS INTEGER) END), 0.0) AS rating_score
        FROM v_reviews GROUP BY product_id""",
    "v_catalog": """
        SELECT t.product_id, coalesce(n.v, '') AS product_name, coalesce(b.v, '') AS product_brand,
               coalesce(c.v, '') AS site_category_lv1, coalesce(s.v, '') AS site_category_lv2,
               t.num_reviews, t.sentiment_score, t.rating_score
        FROM v_totals t
        LEFT JOIN modes n ON n.product_id = t.product_id AND n.a = 0
        LEFT JOIN modes b ON b.product_id = t.product_id AND b.a = 1
        LEFT JOIN modes c ON c.product_id = t.product_id AND c.a = 2
        LEFT JOIN modes s ON s.product_id = t.product_id AND s.a = 3""",
    "v_stats": """
        SELECT product_id, round(coalesce(avg(overall_rating), 0.0), 1) AS avg_rating, count(*) AS review_count
        FROM v_reviews GROUP BY product_id""",
    "v_corpus": "SELECT c.*, e.embedding FROM v_catalog c JOIN v_vectors e USING (product_id)",
    "v_eligible": f"SELECT * FROM v_corpus WHERE num_reviews >= {MIN}",
    "sims": """
        SELECT q.product_id AS query_id, c.product_id, list_inner_product(q.embedding, c.embedding) AS similarity
        FROM v_vectors q CROSS JOIN v_eligible c""",
    "hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, product_id) AS r FROM sims)""",
    "candidates": """
        SELECT h.query_id, h.similarity, h.r, e.* EXCLUDE (embedding) FROM hits h JOIN v_eligible e USING (product_id)""",
    "scored": "SELECT *, 0.7 * similarity + (1.0 - 0.7) * sentiment_score AS score FROM candidates WHERE r <= 50 AND product_id <> query_id",
    "recs": """
        SELECT * FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, product_id) AS rank FROM scored)
        WHERE rank <= 10""",
    "ratings": f"""
        SELECT site_category_lv1, product_id, min(product_name) AS product_name,
               avg(overall_rating) AS avg_rating, count(*) AS num_reviews
        FROM v_reviews GROUP BY site_category_lv1, product_id HAVING count(*) >= {MIN}""",
    "graded": """
        SELECT site_category_lv1, product_id, avg_rating,
               CASE WHEN hi = lo THEN 0.0 ELSE coalesce((avg_rating - lo) / (hi - lo), 0.0) END AS relevance
        FROM (SELECT *, min(avg_rating) OVER (PARTITION BY site_category_lv1) AS lo,
                     max(avg_rating) OVER (PARTITION BY site_category_lv1) AS hi FROM ratings)""",
    "asked": """
        SELECT v.product_id AS query_id, p_type AS query_category
        FROM v_vectors v JOIN part ON v.product_id = CAST(p_partkey AS VARCHAR)""",
    "judged": """
        SELECT r.query_id, r.rank, a.query_category, coalesce(g.relevance, 0.0) AS relevance
        FROM recs r JOIN asked a USING (query_id)
        LEFT JOIN graded g ON g.site_category_lv1 = a.query_category AND g.product_id = r.product_id""",
    "totals": """
        SELECT a.query_id, a.query_category,
               coalesce((SELECT count(*) FROM graded g WHERE g.site_category_lv1 = a.query_category AND g.relevance >= 0.7
                         AND g.product_id <> a.query_id), 0) AS total_relevant
        FROM asked a""",
    "pr": """
        SELECT j.query_id, any_value(t.total_relevant) AS total_relevant,
               count(*) FILTER (rank <= 5 AND relevance >= 0.7) AS h5, count(*) FILTER (rank <= 10 AND relevance >= 0.7) AS h10
        FROM judged j JOIN totals t USING (query_id) GROUP BY j.query_id""",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS best FROM judged""",
    "ndcgs": """
        SELECT query_id,
               coalesce(sum(relevance / log2(rank + 1)) FILTER (rank <= 5) / nullif(sum(relevance / log2(best + 1)) FILTER (best <= 5), 0), 0) AS n5,
               coalesce(sum(relevance / log2(rank + 1)) FILTER (rank <= 10) / nullif(sum(relevance / log2(best + 1)) FILTER (best <= 10), 0), 0) AS n10,
               coalesce(sum((2 ** relevance - 1) / log2(rank + 1)) FILTER (rank <= 5) / nullif(sum((2 ** relevance - 1) / log2(best + 1)) FILTER (best <= 5), 0), 0) AS e5,
               coalesce(sum((2 ** relevance - 1) / log2(rank + 1)) FILTER (rank <= 10) / nullif(sum((2 ** relevance - 1) / log2(best + 1)) FILTER (best <= 10), 0), 0) AS e10
        FROM placed GROUP BY query_id""",
    "matrix": """
        SELECT model, split, count(*) FILTER (polarity = 0 AND pred_label = 0) AS tn, count(*) FILTER (polarity = 0 AND pred_label = 1) AS fp,
               count(*) FILTER (polarity = 1 AND pred_label = 0) AS fn, count(*) FILTER (polarity = 1 AND pred_label = 1) AS tp
        FROM v_reviews WHERE polarity IS NOT NULL AND pred_label IS NOT NULL GROUP BY model, split""",
    "report": """
        SELECT model, split,
               coalesce(tn / nullif(tn + fn, 0), 0) AS pn, coalesce(tn / nullif(tn + fp, 0), 0) AS rn, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1n, tn + fp AS sn,
               coalesce(tp / nullif(tp + fp, 0), 0) AS pp, coalesce(tp / nullif(tp + fn, 0), 0) AS rp, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1p, tp + fn AS sp,
               (tn + tp) / (tn + fp + fn + tp) AS acc, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS auc
        FROM matrix""",
    "pmatrix": """
        SELECT coalesce(split, 'overall') AS split,
               count(*) AS total, count(*) FILTER (coalesce(error, '') = '') AS ok,
               count(*) FILTER (coalesce(error, '') = '' AND true_polarity = 0 AND predicted_polarity = 0) AS tn,
               count(*) FILTER (coalesce(error, '') = '' AND true_polarity = 0 AND predicted_polarity = 1) AS fp,
               count(*) FILTER (coalesce(error, '') = '' AND true_polarity = 1 AND predicted_polarity = 0) AS fn,
               count(*) FILTER (coalesce(error, '') = '' AND true_polarity = 1 AND predicted_polarity = 1) AS tp,
               avg(input_tokens) FILTER (coalesce(error, '') = '') AS tin, avg(output_tokens) FILTER (coalesce(error, '') = '') AS tout,
               avg(response_time_s) FILTER (coalesce(error, '') = '') AS sec, sum(response_time_s) FILTER (coalesce(error, '') = '') AS secs
        FROM v_predictions GROUP BY ROLLUP (split)""",
    "words": rf"""
        SELECT doc_id, polarity, word FROM (
            SELECT doc_id, polarity, unnest(string_split(regexp_replace(lower(review_text), '[^{WORD}]+', ' ', 'g'), ' ')) AS word FROM v_docs)
        WHERE regexp_full_match(word, '[{REPORT}]+') AND length(word) > 2""",
    "tokens": rf"""
        SELECT doc_id, polarity, regexp_extract_all(lower(review_text), '[{WORD}]{{2,}}') AS t FROM v_docs""",
    "unigrams": "SELECT doc_id, polarity, unnest(t) AS term FROM tokens",
    "bigrams": """
        SELECT doc_id, polarity, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tokens""",
    "grams": "SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams",
    # The approximate search: centroids by id digest, cells in the order a vector probes them, calibrated probes.
    "ann_centroids": """
        SELECT row_number() OVER (ORDER BY least) AS cell,
               list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS center
        FROM (SELECT embedding, min(r) AS least FROM (
                  SELECT embedding, row_number() OVER (ORDER BY md5(product_id), product_id) AS r FROM v_vectors)
              WHERE r <= 64 GROUP BY embedding ORDER BY least LIMIT 16)""",
    "ann_order": """
        SELECT product_id, cell, row_number() OVER (PARTITION BY product_id ORDER BY list_inner_product(embedding, center) DESC, cell) AS place
        FROM v_vectors CROSS JOIN ann_centroids""",
    "ann_exact": """
        SELECT query_id, product_id FROM (
            SELECT q.product_id AS query_id, c.product_id,
                   row_number() OVER (PARTITION BY q.product_id ORDER BY round(list_inner_product(q.embedding, c.embedding), 12) DESC, c.product_id) AS r
            FROM v_vectors q CROSS JOIN v_vectors c) WHERE r <= 10""",
    "ann_places": """
        SELECT e.query_id, o.place FROM ann_exact e JOIN ann_order own ON own.product_id = e.product_id AND own.place = 1
        JOIN ann_order o ON o.product_id = e.query_id AND o.cell = own.cell""",
    "ann_sampled": """
        SELECT place FROM ann_places WHERE query_id IN (SELECT product_id FROM v_vectors ORDER BY md5(product_id), product_id LIMIT 256)""",
    "ann_probes": """
        SELECT min(place) AS probes FROM (SELECT place, sum(count(*)) OVER (ORDER BY place) AS found FROM ann_sampled GROUP BY place)
        WHERE found >= 0.95 * (SELECT count(*) FROM ann_sampled)""",
    "draws": "SELECT *, md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')) AS draw FROM v_docs",
    "v_split": """
        SELECT *, CASE WHEN b < 6000 THEN 'train' WHEN b < 8000 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, ('0x' || substr(draw, 1, 8))::BIGINT % 10000 AS b FROM draws)""",
    "v_answers": """
        SELECT event_id, CASE event_type WHEN 'click' THEN '{"sentiment": "positive"}' WHEN 'view' THEN '{"sentiment": "negative"}'
               WHEN 'purchase' THEN '{"sentiment": "neutral"}' WHEN 'signup' THEN substr(props, 1, 3) ELSE props END AS raw FROM events""",
}


def _uses(name: str, sql: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", sql) is not None


def with_views(sql: str) -> str:
    """Puts the views a query needs in front of it, in definition order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        current = pending.pop()
        for name, body in CTES.items():
            if name not in needed and _uses(name, current):
                needed.add(name)
                pending.append(body)
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def _stops(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _normal(column: str) -> str:
    text = f"regexp_replace(lower(coalesce({column}, '')), '<[^>]+>', ' ', 'g')"
    text = rf"nfc_normalize(regexp_replace({text}, 'https?://[^{SPACE}]+|www\.[^{SPACE}]+', ' ', 'g'))"
    text = f"regexp_replace({text}, '[^{LETTERS}0-9{SPACE}]', ' ', 'g')"
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'), ' ')"


def _light(column: str) -> str:
    text = f"regexp_replace(coalesce({column}, ''), '<[^>]+>', ' ', 'g')"
    text = rf"nfc_normalize(regexp_replace({text}, 'https?://[^{SPACE}]+|www\.[^{SPACE}]+', ' ', 'g'))"
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'), ' ')"


def _strip(column: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({column}, ''), '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def _vocabulary(source: str, size: int | None, where: str = "TRUE") -> str:
    limit = f"ORDER BY tf DESC, term LIMIT {size}" if size else ""
    return f"""
        SELECT term, df, tf, ln((1.0 + (SELECT count(*) FROM v_docs WHERE {where})) / (1.0 + df)) + 1.0 AS idf FROM (
            SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM (
                SELECT doc_id, term, count(*) AS n FROM {source} WHERE {where} GROUP BY doc_id, term)
            GROUP BY term HAVING count(*) >= 2) {limit}"""


def _auc(by: str, score: str) -> str:
    return f"""
        SELECT {by}, round(sum(pos * (below + neg * 0.5)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0), 6) AS auc FROM (
            SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS below FROM (
                SELECT {by}, {score} AS score, count(*) FILTER (polarity = 1) AS pos, count(*) FILTER (polarity = 0) AS neg
                FROM v_reviews WHERE polarity IS NOT NULL GROUP BY {by}, {score}))
        GROUP BY {by}"""


def _fixed(rows: list[tuple[str, str]], key: str, value: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS {key}, (SELECT count(*) FROM {source} WHERE {cond}) AS {value}"
        for i, (name, cond) in enumerate(rows)
    )


CATALOG = "product_id, product_name, product_brand, site_category_lv1, site_category_lv2, num_reviews"
RECS = f"query_id, {CATALOG}, round(similarity, 6) AS similarity, round(sentiment_score, 6) AS sentiment_score, round(score, 6) AS score, rank"
TOP10 = """
    SELECT query_id, product_id, round(similarity, 6) AS similarity FROM (
        SELECT q.product_id AS query_id, c.product_id, list_inner_product(q.embedding, c.embedding) AS similarity,
               row_number() OVER (PARTITION BY q.product_id ORDER BY round(list_inner_product(q.embedding, c.embedding), 12) DESC, c.product_id) AS r
        FROM v_vectors q CROSS JOIN v_vectors c) WHERE r <= 10"""
DESCRIBE = """
    concat_ws(' ', CASE WHEN product_brand <> '' THEN concat('Marca: ', product_brand, '.') END,
        CASE WHEN site_category_lv1 <> '' AND site_category_lv2 <> '' AND site_category_lv1 <> site_category_lv2
             THEN concat('Categoria: ', site_category_lv1, ' › ', site_category_lv2, '.')
             WHEN site_category_lv1 <> '' THEN concat('Categoria: ', site_category_lv1, '.') END)"""
WIDE = [("1 a 9", "n <= 9"), ("10 a 99", "n > 9 AND n <= 99"), ("100 a 299", "n > 99 AND n <= 299"), ("300 a 399", "n > 299 AND n <= 399"), ("400 a 500", "n > 399 AND n <= 500")]
DENSE = [(str(i), f"n = {i}") for i in range(1, 6)] + [
    ("6 a 10", "n BETWEEN 6 AND 10"), ("11 a 20", "n BETWEEN 11 AND 20"), ("21 a 50", "n BETWEEN 21 AND 50"),
    ("51 a 100", "n BETWEEN 51 AND 100"), ("101 a 300", "n BETWEEN 101 AND 300"), ("301+", "n > 300")]
CASE_1 = "CASE WHEN overall_rating IN (4, 5) AND lower(recommend_to_a_friend) = 'no' THEN '1a' WHEN overall_rating IN (1, 2) AND lower(recommend_to_a_friend) = 'yes' THEN '1b' END"
CASE_2 = "CASE WHEN pred_label = 1 AND overall_rating IN (1, 2) THEN '2a' WHEN pred_label = 0 AND overall_rating IN (4, 5) THEN '2b' END"
TWO_POLE = "CASE WHEN coalesce(overall_rating >= 4, FALSE) THEN 'Positiva (4-5)' ELSE 'Negativa (1-2)' END"


def _examples(case: str, columns: str) -> str:
    return f"""
        SELECT "case", rank, review_id, overall_rating, {columns} FROM (
            SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY review_id) AS rank
            FROM (SELECT *, {case} AS "case" FROM v_reviews) WHERE "case" IS NOT NULL) WHERE rank <= 4"""


def _case_counts(case: str) -> str:
    return f'SELECT "case", count(*) AS reviews FROM (SELECT {case} AS "case" FROM v_reviews) WHERE "case" IS NOT NULL GROUP BY 1'


QUERIES = {
    "sp_hard": """
        SELECT product_id, count(*) AS num_reviews, count(*) FILTER (pred_label = 1) AS num_positive,
               round(count(*) FILTER (pred_label = 1) / count(*), 6) AS sentiment_score
        FROM v_reviews GROUP BY product_id""",
    "sp_valid": "SELECT product_id, round(sentiment_score, 6) AS sentiment_score FROM v_totals",
    "sp_rating": "SELECT product_id, round(rating_score, 6) AS sentiment_score FROM v_totals",
    "catalog_min": f"SELECT {CATALOG}, round(sentiment_score, 6) AS sentiment_score FROM v_catalog WHERE num_reviews >= {MIN}",
    "catalog_top": f"SELECT {CATALOG}, round(rating_score, 6) AS sentiment_score FROM v_catalog ORDER BY num_reviews DESC, product_id LIMIT 100",
    "product_stats": "SELECT * FROM v_stats",
    "product_enriched": f"""
        SELECT {CATALOG}, round(sentiment_score, 6) AS sentiment_score, avg_rating, coalesce(review_count, num_reviews) AS review_count,
               {DESCRIBE} AS description
        FROM v_catalog LEFT JOIN (
            SELECT product_id, round(coalesce(avg(overall_rating), 0.0), 1) AS avg_rating, count(*) AS review_count
            FROM v_reviews WHERE split = 'val' GROUP BY product_id) USING (product_id)""",
    "build_counts": f"""
        SELECT count(*) AS storefront, count(*) FILTER (num_reviews >= {MIN}) AS recommendable, CAST(sum(num_reviews) AS BIGINT) AS reviews
        FROM v_catalog""",
    "category_ratings": "SELECT site_category_lv1, product_id, product_name, round(avg_rating, 6) AS avg_rating, num_reviews FROM ratings",
    "category_list": "SELECT DISTINCT site_category_lv1 FROM v_catalog",
    "subcategory_list": "SELECT DISTINCT site_category_lv2 FROM v_catalog WHERE site_category_lv1 = 'PROMO'",
    "category_count": "SELECT count(*) AS total FROM v_catalog WHERE site_category_lv1 = 'PROMO' AND regexp_matches(product_name, '(?i)RED|ring')",
    "category_profile": f"""
        SELECT site_category_lv1, count(*) AS products, CAST(sum(num_reviews) AS BIGINT) AS reviews,
               count(*) FILTER (num_reviews >= {MIN}) AS recommendable,
               round(avg(sentiment_score) FILTER (num_reviews >= {MIN}), 6) AS mean_sentiment,
               count(*) FILTER (num_reviews >= {MIN} AND sentiment_score < 0.3) AS low_sentiment
        FROM v_catalog GROUP BY site_category_lv1""",
    "top_words": f"SELECT word, count(*) AS n FROM words WHERE word NOT IN ({_stops(REPORT_STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "top_words_funnel": f"SELECT word, count(*) AS n FROM words WHERE word NOT IN ({_stops(FUNNEL_STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "words_by_class": f"""
        SELECT polarity, word, n, rank FROM (
            SELECT polarity, word, count(*) AS n, row_number() OVER (PARTITION BY polarity ORDER BY count(*) DESC, word) AS rank
            FROM words WHERE polarity IS NOT NULL AND word NOT IN ({_stops(REPORT_STOP_WORDS)}) GROUP BY polarity, word)
        WHERE rank <= 20""",
    "reviews_csv": """
        SELECT CAST(doc_id AS VARCHAR) AS product_id, reviewer_id AS product_brand, product_id AS site_category_lv1, overall_rating, md5(review_text) AS text_md5
        FROM v_docs WHERE doc_id IS NOT NULL AND review_title IS NOT NULL""",
    "text_profile": """
        SELECT count(*) AS reviews, count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT product_id) AS products,
               (SELECT CAST(sum(len(t)) AS BIGINT) FROM tokens) AS tokens,
               (SELECT count(DISTINCT term) FROM unigrams) AS distinct_tokens,
               (SELECT CAST(median(len(t)) AS DOUBLE) FROM tokens) AS median_tokens,
               round(100.0 * count(*) FILTER (overall_rating IN (1, 2)) / count(*), 1) AS negative_pct,
               round(100.0 * count(*) FILTER (overall_rating = 3) / count(*), 1) AS neutral_pct,
               round(100.0 * count(*) FILTER (overall_rating IN (4, 5)) / count(*), 1) AS positive_pct
        FROM v_docs""",
    "missing_values": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing, count(*) AS rows FROM v_reviews"""
        for c in ("product_brand", "review_text", "overall_rating", "reviewer_state", "pred_label")
    ),
    "length_by_polarity": "SELECT polarity, round(avg(length(review_text)), 6) AS avg_chars, count(*) AS reviews FROM v_docs GROUP BY polarity",
    "top_categories_products": "SELECT site_category_lv1, count(DISTINCT product_id) AS products FROM v_reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "best_categories": "SELECT site_category_lv1, round(avg(overall_rating), 6) AS avg_rating, count(*) AS reviews FROM v_reviews GROUP BY 1 HAVING count(*) >= 50 ORDER BY avg(overall_rating) DESC, 1 LIMIT 10",
    "worst_categories": "SELECT site_category_lv1, round(avg(overall_rating), 6) AS avg_rating, count(*) AS reviews FROM v_reviews GROUP BY 1 HAVING count(*) >= 50 ORDER BY avg(overall_rating), 1 LIMIT 10",
    "product_volume": "SELECT product_name, count(*) AS reviews FROM v_reviews GROUP BY 1",
    "product_volume_top": "SELECT product_name, count(*) AS reviews FROM v_reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "rating_hist": "SELECT CAST(overall_rating AS DOUBLE) AS overall_rating, count(*) AS reviews FROM v_reviews WHERE overall_rating IS NOT NULL GROUP BY 1",
    "pole_share": f"""
        SELECT CASE pole WHEN 'Negativa (1-2)' THEN 0 ELSE 1 END AS position, pole, count(*) AS reviews,
               round(100.0 * count(*) / (SELECT count(*) FROM v_reviews), 1) AS percentage
        FROM (SELECT {TWO_POLE} AS pole FROM v_reviews) GROUP BY pole""",
    "strict_poles": _fixed(
        [("Polo Negativo (1 e 2)", "overall_rating IN (1, 2)"), ("Polo Positivo (4 e 5)", "overall_rating IN (4, 5)")], "pole", "reviews", "v_reviews"
    ),
    "review_bins_wide": _fixed(WIDE, "bin", "products", "(SELECT product_name, count(*) AS n FROM v_reviews GROUP BY 1)"),
    "review_bins_dense": _fixed(DENSE, "bin", "products", "(SELECT product_id, count(*) AS n FROM v_reviews GROUP BY 1)"),
    "top5_sentiment": f"""
        SELECT site_category_lv1, count(*) AS total,
               round(100.0 * count(*) FILTER ({TWO_POLE} = 'Positiva (4-5)') / count(*), 1) AS positive_pct,
               round(100.0 * count(*) FILTER ({TWO_POLE} = 'Negativa (1-2)') / count(*), 1) AS negative_pct
        FROM v_reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "semi_join_categories": """
        SELECT review_id, site_category_lv1, overall_rating FROM v_reviews
        WHERE site_category_lv1 IN (SELECT site_category_lv1 FROM v_reviews GROUP BY 1 HAVING count(*) >= 50)""",
    "mismatch_rating": _examples(CASE_1, "recommend_to_a_friend"),
    "mismatch_rating_counts": _case_counts(CASE_1),
    "mismatch_pred": _examples(CASE_2, "pred_label, pred_prob"),
    "mismatch_pred_counts": _case_counts(CASE_2),
    "polarity": f"""
        SELECT review_id, CASE WHEN overall_rating IN (1, 2) THEN 0 WHEN overall_rating IN (4, 5) THEN 1 END AS polarity,
               CASE WHEN overall_rating IN (1, 2) THEN 'Polo Negativo (1 e 2)' WHEN overall_rating IN (4, 5) THEN 'Polo Positivo (4 e 5)'
                    ELSE 'Outros' END AS strict_pole, {TWO_POLE} AS pole
        FROM v_reviews""",
    "drop_neutral": "SELECT review_id, overall_rating FROM v_reviews WHERE overall_rating IS DISTINCT FROM 3",
    "coerce_rating": "SELECT review_id, TRY_CAST(coalesce(' ' || CAST(overall_rating AS VARCHAR) || '.5 ', reviewer_state) AS DOUBLE) AS value FROM v_reviews",
    "review_view": """
        SELECT product_id, concat(substr(reviewer_id, 1, 8), '...') AS reviewer_id, coalesce(review_title, '') AS review_title, overall_rating,
               recommend_to_a_friend, coalesce(review_text, '') AS review_text, CAST(reviewer_birth_year AS INTEGER) AS reviewer_birth_year,
               reviewer_gender, coalesce(reviewer_state, '') AS reviewer_state, substr(CAST(submission_date AS VARCHAR), 1, 10) AS submission_date,
               CASE WHEN pred_label IS NULL THEN NULL WHEN pred_label = 1 THEN 'positive' ELSE 'negative' END AS sentiment_label,
               CASE WHEN pred_label IS NULL THEN NULL WHEN pred_label = 1 THEN round(pred_prob, 4) ELSE round(1.0 - pred_prob, 4) END AS sentiment_confidence
        FROM v_reviews""",
    "review_filters": "SELECT review_id, product_id FROM v_reviews WHERE lower(recommend_to_a_friend) = 'yes' AND overall_rating = 4",
    "parse_answers": """
        SELECT event_id, CASE WHEN s IN ('positive', 'negative') THEN s END AS sentiment,
               CASE s WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS polarity,
               CASE WHEN s IN ('positive', 'negative') THEN NULL ELSE concat('malformed_response: ', coalesce(s, 'no sentiment')) END AS error
        FROM (SELECT event_id, json_extract_string(TRY_CAST(raw AS JSON), '$.sentiment') AS s FROM v_answers)""",
    "row_ids": """
        SELECT concat(split, ':', sha256(concat_ws(',', review_id, product_id, coalesce(CAST(overall_rating AS VARCHAR), '')))) AS row_id, split, review_id
        FROM v_reviews""",
    "prompts": f"""
        SELECT review_id, concat('Título: "', {_strip('review_title')}, '"', chr(10), 'Texto: "', {_strip('review_text')}, '"') AS prompt FROM v_reviews""",
    "query_text": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id,
               concat('Instruct: Given a retail product title, retrieve titles of similar products', chr(10), 'Query:', p_name) AS query FROM part""",
    "normalize_text": f"SELECT doc_id, {_normal('review_text')} AS text FROM v_docs",
    "normalize_light": f"SELECT doc_id, {_light('review_text')} AS text FROM v_docs",
    "normalize_pages": f"SELECT page_id, {_normal('html')} AS text FROM pages",
    "text_input": "SELECT doc_id, " + _normal("concat(review_title, ' ', review_text)") + " AS text FROM v_docs",
    "clean_fields": f"SELECT doc_id, {_strip('review_title')} AS title FROM v_docs",
    "lemma_filter": rf"""
        SELECT doc_id, coalesce(string_agg(lemma, ' ' ORDER BY i) FILTER (lower(lemma) NOT IN ({_stops(REPORT_STOP_WORDS)})), '') AS lemmas FROM (
            SELECT doc_id, i, CASE WHEN length(form) > 3 AND form LIKE '%s' THEN left(form, length(form) - 1) ELSE form END AS lemma FROM (
                SELECT doc_id, unnest(f) AS form, generate_subscripts(f, 1) AS i FROM (
                    SELECT doc_id, list_filter(regexp_extract_all(review_text, '[{WORD}]+'), lambda x: regexp_full_match(x, '\p{{L}}+')) AS f FROM v_docs)))
        GROUP BY doc_id
        UNION ALL SELECT doc_id, '' FROM v_docs WHERE NOT regexp_matches(review_text, '(^|[^{WORD}])\p{{L}}+($|[^{WORD}])')""",
    "ngrams": """
        SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS digest FROM (
            SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM tokens)""",
    "vocabulary": f"SELECT term, df, tf, round(idf, 6) AS idf FROM ({_vocabulary('grams', 50000)})",
    "vocabulary_bigrams": f"SELECT term, df, tf, round(idf, 6) AS idf FROM ({_vocabulary('bigrams', 50000)})",
    "tfidf": f"""
        SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
            SELECT doc_id, term, (1 + ln(n)) * idf AS raw FROM (SELECT doc_id, term, count(*) AS n FROM unigrams GROUP BY doc_id, term)
            JOIN ({_vocabulary('unigrams', 50000, 'polarity IS NOT NULL')}) USING (term))""",
    "split_hash": "SELECT doc_id, split FROM v_split",
    "split_no_neutral": """
        SELECT review_id, overall_rating, CASE WHEN b < 6000 THEN 'train' WHEN b < 8000 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', review_id, '42')), 1, 8))::BIGINT % 10000 AS b FROM v_reviews)
        WHERE overall_rating IS DISTINCT FROM 3""",
    "split_stratified": """
        SELECT doc_id, reviewer_id, CASE WHEN r <= n - rest THEN 'train' WHEN r <= n - ceil(rest * 0.5) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, ceil(n * 0.4::DOUBLE) AS rest FROM (
            SELECT doc_id, reviewer_id, row_number() OVER (PARTITION BY reviewer_id ORDER BY draw) AS r, count(*) OVER (PARTITION BY reviewer_id) AS n
            FROM draws))""",
    "folds": "SELECT doc_id, polarity, (row_number() OVER (PARTITION BY polarity ORDER BY draw) - 1) % 5 AS fold FROM draws WHERE polarity IS NOT NULL",
    "sample_unique": """
        SELECT doc_id, review_text FROM (SELECT min(doc_id) AS doc_id, review_text FROM v_docs GROUP BY review_text)
        ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 50""",
    "head_per_split": "SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS r FROM v_split) WHERE r <= 20",
    "union_splits": "SELECT doc_id, split FROM v_split WHERE split IN ('val', 'test')",
    "cosine_topk": TOP10,
    "blocked_topk": TOP10,
    "rescore": TOP10,
    "ann_all_cells": TOP10,
    "pruned_topk": TOP10,
    "ann_topk": """
        SELECT query_id, product_id, round(similarity, 6) AS similarity FROM (
            SELECT q.product_id AS query_id, c.product_id, list_inner_product(q.embedding, c.embedding) AS similarity,
                   row_number() OVER (PARTITION BY q.product_id ORDER BY round(list_inner_product(q.embedding, c.embedding), 12) DESC, c.product_id) AS r
            FROM v_vectors q JOIN ann_order o ON o.product_id = q.product_id AND o.place <= (SELECT probes FROM ann_probes)
            JOIN ann_order own ON own.cell = o.cell AND own.place = 1 JOIN v_vectors c ON c.product_id = own.product_id) WHERE r <= 10""",
    "ann_recall": """
        SELECT query_id, round(avg(CAST(place <= (SELECT probes FROM ann_probes) AS INTEGER)), 6) AS recall FROM ann_places GROUP BY query_id""",
    "filtered_topk": "SELECT query_id, product_id, round(similarity, 6) AS similarity FROM hits WHERE r <= 10",
    "rerank": """
        SELECT query_id, product_id, round(score, 6) AS score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, product_id) AS rank FROM (
                SELECT split_part(review_id, '-', 1) AS query_id, review_id AS product_id,
                       0.6::DOUBLE * pred_prob + (1.0::DOUBLE - 0.6::DOUBLE) * coalesce(polarity, 0) AS score
                FROM v_reviews WHERE split_part(review_id, '-', 2) <> '1')) WHERE rank <= 3""",
    "recommend": f"SELECT {RECS} FROM recs",
    "recommend_floor": f"""
        SELECT {RECS} FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, product_id) AS rank
                            FROM scored WHERE similarity >= 0.1) WHERE rank <= 10""",
    "recommend_enriched": f"""
        SELECT query_id, rank, product_id, round(score, 6) AS score, avg_rating, coalesce(review_count, num_reviews) AS review_count,
               {DESCRIBE} AS description
        FROM recs LEFT JOIN v_stats USING (product_id) WHERE rank <= 5""",
    "alpha_sweep": """
        SELECT query_id, alpha, product_id, rank, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, alpha ORDER BY round(score, 12) DESC, product_id) AS rank FROM (
                SELECT query_id, product_id, alpha, alpha * similarity + (1.0::DOUBLE - alpha) * sentiment_score AS score
                FROM candidates, (SELECT unnest([0.0, 0.3, 0.7, 1.0]::DOUBLE[]) AS alpha)
                WHERE r <= 20 AND product_id <> query_id)) WHERE rank <= 3""",
    "resolve_queries": """
        SELECT concat('q', p_partkey) AS query_id, v.product_id AS exclude_id,
               CASE WHEN v.product_id IS NULL THEN concat('unknown product: ', p_partkey) END AS reason
        FROM part LEFT JOIN v_vectors v ON v.product_id = CAST(p_partkey AS VARCHAR)""",
    "catalog_page": f"""
        SELECT {CATALOG}, round(sentiment_score, 6) AS sentiment_score FROM v_catalog
        WHERE site_category_lv1 = 'ECONOMY' AND regexp_matches(product_name, '(?i)E') ORDER BY num_reviews DESC, product_id LIMIT 24 OFFSET 24""",
    "product_lookup": f"SELECT {CATALOG}, round(sentiment_score, 6) AS sentiment_score FROM v_catalog WHERE product_id = '17'",
    "confusion": "SELECT * FROM matrix",
    "class_report": """
        SELECT model, split, round(pn, 6) AS precision_negative, round(rn, 6) AS recall_negative, round(f1n, 6) AS f1_negative, sn AS support_negative,
               round(pp, 6) AS precision_positive, round(rp, 6) AS recall_positive, round(f1p, 6) AS f1_positive, sp AS support_positive,
               round((f1n + f1p) / 2, 6) AS f1_macro, round(acc, 6) AS accuracy, round(auc, 6) AS auc_hard FROM report""",
    "auc_prob": _auc("model, split", "pred_prob"),
    "auc_raw": _auc("split", "seconds * tokens_in"),
    "auc_hard": "SELECT model, split, round(auc, 6) AS auc FROM report",
    "kappa": """
        SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM (
            SELECT avg(CAST(polarity = pred_label AS INTEGER)) AS po,
                   avg(polarity) * avg(pred_label) + (1 - avg(polarity)) * (1 - avg(pred_label)) AS pe
            FROM v_reviews WHERE polarity IS NOT NULL AND pred_label IS NOT NULL)""",
    "class_weights": """
        SELECT polarity, count(*) AS n,
               round((SELECT count(*) FROM v_docs WHERE polarity IS NOT NULL) / (2.0 * count(*)), 6) AS class_weight
        FROM v_docs WHERE polarity IS NOT NULL GROUP BY polarity""",
    "prediction_counts": "SELECT split, total, ok, total - ok AS failed, round(100.0 * (total - ok) / total, 1) AS failed_pct FROM pmatrix",
    "usage_stats": """
        SELECT split, round(tin, 2) AS avg_input_tokens, round(tout, 2) AS avg_output_tokens, round(sec, 4) AS avg_response_time_s,
               round(secs, 2) AS total_response_time_s FROM pmatrix""",
    "eval_rollup": """
        SELECT split, total, ok, total - ok AS failed,
               round((2 * tn / (2 * tn + fp + fn) + 2 * tp / (2 * tp + fp + fn)) / 2, 4) AS f1_macro,
               round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS auc_hard,
               round((tn + tp) / (tn + fp + fn + tp), 4) AS accuracy, round(tin, 2) AS avg_input_tokens FROM pmatrix""",
    "champion": "SELECT model, split, round((f1n + f1p) / 2, 6) AS f1_macro FROM report WHERE split = 'test' ORDER BY round((f1n + f1p) / 2, 6) DESC, model LIMIT 1",
    "champion_scores": """
        SELECT product_id, count(*) AS num_reviews, count(*) FILTER (pred_label = 1) AS num_positive,
               round(count(*) FILTER (pred_label = 1) / count(*), 6) AS sentiment_score
        FROM v_reviews WHERE model = (SELECT model FROM report WHERE split = 'test' ORDER BY round((f1n + f1p) / 2, 6) DESC, model LIMIT 1)
        GROUP BY product_id""",
    "resume_pending": """
        SELECT review_id AS row_id, split FROM v_reviews
        WHERE review_id NOT IN (SELECT row_id FROM v_predictions WHERE coalesce(error, '') = '')""",
    "relevance": "SELECT site_category_lv1, product_id, round(relevance, 6) AS relevance FROM graded",
    "precision_recall_k": """
        SELECT query_id, total_relevant, round(h5 / 5, 6) AS precision_at_5, round(h10 / 10, 6) AS precision_at_10,
               round(coalesce(h5 / nullif(total_relevant, 0), 0), 6) AS recall_at_5, round(coalesce(h10 / nullif(total_relevant, 0), 0), 6) AS recall_at_10
        FROM pr""",
    "ndcg_k": "SELECT query_id, round(n5, 6) AS ndcg_at_5, round(n10, 6) AS ndcg_at_10 FROM ndcgs",
    "ndcg_exp_k": "SELECT query_id, round(e5, 6) AS ndcg_at_5, round(e10, 6) AS ndcg_at_10 FROM ndcgs",
    "objective_eval": """
        SELECT t.query_id, t.total_relevant, round(coalesce(h5 / 5, 0), 6) AS precision_at_5, round(coalesce(h10 / 10, 0), 6) AS precision_at_10,
               round(coalesce(h5 / nullif(t.total_relevant, 0), 0), 6) AS recall_at_5, round(coalesce(h10 / nullif(t.total_relevant, 0), 0), 6) AS recall_at_10,
               round(coalesce(n5, 0), 6) AS ndcg_at_5, round(coalesce(n10, 0), 6) AS ndcg_at_10
        FROM totals t JOIN graded g ON g.site_category_lv1 = t.query_category AND g.product_id = t.query_id
        LEFT JOIN pr ON pr.query_id = t.query_id LEFT JOIN ndcgs d ON d.query_id = t.query_id""",
    "list_quality": """
        SELECT r.query_id, round(avg(similarity), 4) AS mean_similarity, round(avg(sentiment_score), 4) AS mean_sentiment,
               round(min(sentiment_score), 4) AS min_sentiment, count(*) FILTER (sentiment_score < 0.3) AS n_low_relevance,
               count(*) FILTER (sentiment_score > 0.7) AS n_high_relevance, count(*) FILTER (similarity < 0.5) AS n_off_topic,
               count(*) FILTER (site_category_lv1 = query_category) AS n_same_category
        FROM recs r JOIN asked a USING (query_id) GROUP BY r.query_id""",
    "linear_scores": f"""
        SELECT doc_id, CAST(m > 0 AS INTEGER) AS pred_label, round(1 / (1 + exp(-m)), 4) AS pred_prob FROM (
            SELECT d.doc_id, coalesce(s / sqrt(q), 0) + 0.25 AS m FROM v_docs d LEFT JOIN (
                SELECT doc_id, sum(raw * c) AS s, sum(raw * raw) AS q FROM (
                    SELECT doc_id, (1 + ln(n)) * idf AS raw, CAST(length(term) % 5 - 2 AS DOUBLE) AS c
                    FROM (SELECT doc_id, term, count(*) AS n FROM unigrams GROUP BY doc_id, term) JOIN ({_vocabulary('unigrams', 50000)}) USING (term))
                GROUP BY doc_id) x ON x.doc_id = d.doc_id)""",
    "prompt_scores": f"""
        SELECT review_id, CASE WHEN NOT failed THEN concat('{{"sentiment": "', s, '"}}') END AS raw_response,
               CASE WHEN NOT failed THEN CAST(s = 'positive' AS INTEGER) END AS predicted_polarity,
               CASE WHEN failed THEN 'ValueError: blank text' END AS error, length(p) AS input_tokens,
               CASE WHEN failed THEN 0 ELSE 7 END AS output_tokens, 0.0::DOUBLE AS response_time_s
        FROM (SELECT review_id, p, length(split_part(p, chr(10), 2)) <= 9 AS failed, CASE WHEN length(p) % 2 = 1 THEN 'positive' ELSE 'negative' END AS s FROM (
            SELECT review_id, concat('Título: "', coalesce(review_title, ''), '"', chr(10), 'Texto: "', coalesce(review_text, ''), '"') AS p FROM v_reviews))""",
    "resumed_scores": f"""
        SELECT row_id, concat('{{"sentiment": "', CASE WHEN length(p) % 2 = 1 THEN 'positive' ELSE 'negative' END, '"}}') AS raw_response,
               length(p) % 2 AS predicted_polarity, CAST(NULL AS VARCHAR) AS error, length(p) AS input_tokens, 7 AS output_tokens,
               0.0::DOUBLE AS response_time_s, CASE WHEN review_text IS NULL THEN 'run-2' ELSE 'run-1' END AS run_id
        FROM (SELECT review_id AS row_id, review_text,
                     concat('Título: "', split, '"', chr(10), 'Texto: "', coalesce(review_text, 'retried'), '"') AS p FROM v_reviews)""",
    "embed_cache": "SELECT sha256(review_text) AS digest, bool_and(reviewer_id <> 'en') AS fresh FROM v_docs GROUP BY 1",
}

QUERIES["stream_scores"] = QUERIES["linear_scores"]


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in QUERIES.items()}
