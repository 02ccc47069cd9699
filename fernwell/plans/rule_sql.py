"""SQL (DuckDB) for the queries of ``rule_queries``: the same rows by another way."""

from __future__ import annotations

from fernwell.plans.feedback_sql import ASPECTS, ORACLE_SQL, ORDERS, PICK, PREDICTED, he, pct, wilson
from fernwell.plans.rule_queries import TOKENS


def lit(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def one_of(*values: str | None) -> str:
    return f"([{', '.join(map(lit, values))}])[1 + CAST(review_id % {len(values)} AS INTEGER)]"


RESOLVED = f"""{ORDERS}, given AS (
    SELECT review_id, rating, entity, has_text, CASE WHEN review_id % 4 <> 0 THEN CASE WHEN rating <= 2 THEN 'Negative' WHEN rating >= 4 THEN 'Positive' WHEN rating IS NOT NULL THEN 'Neutral' END END AS by_rating,
        {one_of("Positive", "Negative", None, "Neutral")} AS by_text, {one_of("ai", "cache", "baseline", "baseline_fallback", "not_sampled", "no_text", "failed")} AS label_source, CAST(1 + review_id % 3 AS DOUBLE) AS weight FROM fb),
res AS (
    SELECT review_id, rating, entity, has_text, by_rating, coalesce(by_rating, CASE WHEN review_id % 7 < 4 THEN by_text END) AS sentiment,
        CASE WHEN by_rating IS NOT NULL THEN 'rating' WHEN review_id % 7 < 4 AND by_text IS NOT NULL THEN CASE WHEN review_id % 7 < 2 THEN 'text_ai' ELSE 'text_baseline' END END AS sentiment_source,
        review_id % 7 < 4 AS in_label_sample, CASE WHEN review_id % 7 < 4 THEN weight END AS sample_weight FROM given)"""

COUNTED = "count(*) AS n"
MISSING = lambda c: f"count(*) FILTER ({c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', '--', '?'))"
_T, _P = one_of("yes", "no", "", "no", "1"), "CASE WHEN review_id % 7 <> 0 THEN review_id % 3 = 0 END"
_ASPECT = lambda t, p, i: f"{{'t': {t}, 'p': {p}, 'i': {i}}}"

ORACLE_SQL.update(
    {
        "numeric_range": f"WITH {ORDERS} SELECT review_id, CASE WHEN review_id % 900 - 200 BETWEEN 0 AND 500 THEN CAST(review_id % 900 - 200 AS DOUBLE) END AS minutes FROM fb",
        "plausible_dates": f"WITH {ORDERS} SELECT review_id, CASE WHEN date BETWEEN DATE '1993-02-01' AND DATE '1997-06-30' THEN CAST(date AS VARCHAR) END AS day FROM fb",
        "outcome_tokens": f"WITH {ORDERS} SELECT review_id, ([1, 1, 1, 0, 0, 0, NULL, NULL, NULL, 0])[1 + CAST(review_id % 10 AS INTEGER)]::DOUBLE AS outcome FROM fb",
        "value_aliases": f"WITH {ORDERS} SELECT CASE region WHEN 'ASIA' THEN 'Asia-Pacific' WHEN 'EUROPE' THEN 'Europe' ELSE region END AS region, count(*) AS n, count(*) FILTER (region IN ('ASIA', 'EUROPE')) AS corrected FROM fb GROUP BY fb.region",
        "title_and_text": f"""WITH {ORDERS}, t AS (SELECT review_id, {one_of('Good value. ', 'Why? ', None, 'Late. ', None)} AS a, {one_of('Good value', 'Why?', None, 'Late.', None)} AS alone, CASE WHEN review_id % 3 <> 0 THEN 'From ' || entity END AS b FROM fb)
            SELECT review_id, CASE WHEN b IS NULL THEN alone ELSE coalesce(a, '') || b END AS analysis_text, b IS NOT NULL OR alone IS NOT NULL AS has_text FROM t""",
        "missing_tokens": f"WITH {ORDERS}, t AS (SELECT {one_of(*TOKENS)} AS a, CAST(rating AS VARCHAR) AS b, CASE WHEN review_id % 4 <> 0 THEN 'x' END AS c FROM fb) SELECT {MISSING('a')} AS review_text, {MISSING('b')} AS rating, {MISSING('c')} AS review_id FROM t",
        "csv_nulls": f"WITH {ORDERS} SELECT {one_of(None, None, None, None, 'none', None, None, None, 'N/a', None, 'x')} AS value, count(*) AS n FROM fb GROUP BY 1",
        "character_references": f"WITH {ORDERS} SELECT review_id, CASE WHEN review_id % 9 <> 0 THEN 'Tom & ' || entity || ' — café ’' || region || '– &lt; &unknown; x' END AS text FROM fb",
        "label_lists": f"""WITH {ORDERS}, l AS (SELECT review_id, CASE WHEN review_id % 10 <> 0 THEN CASE WHEN entity = region THEN [entity, segment] ELSE [entity, region, segment] END ELSE [] END AS l FROM fb)
            SELECT review_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '|') AS items FROM l""",
        "truth_from_aspects": f"""WITH {ORDERS} SELECT review_id, CASE WHEN review_id % 5 <> 0 THEN priority ELSE '' END AS issues, CASE WHEN review_id % 5 <> 0 AND review_id % 3 = 0 THEN region ELSE '' END AS praise,
            CASE WHEN review_id % 5 <> 0 THEN priority END AS main_issue FROM fb""",
        "truth_from_lists": f"""WITH {ORDERS}, l AS (SELECT *, list_filter([CASE WHEN review_id % 2 = 0 THEN priority END, CASE WHEN review_id % 3 = 0 THEN segment END], lambda x: x IS NOT NULL) AS l FROM fb)
            SELECT review_id, array_to_string(l, '|') AS issues, CASE WHEN review_id % 7 = 0 THEN region ELSE '' END AS praise, l[1] AS main_issue FROM l""",
        "truth_from_one_issue": f"WITH {ORDERS} SELECT CASE WHEN review_id % 3 = 1 THEN segment END AS main_issue, count(*) AS n, CAST(sum(CASE WHEN review_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS issues FROM fb GROUP BY 1",
        "truth_values": f"WITH {ORDERS} SELECT review_id, (['true', 'true', 'true', 'true', 'false', 'false', 'false', 'false', NULL, NULL, NULL])[1 + CAST(review_id % 11 AS INTEGER)] AS flag FROM fb",
        "primary_issue": f"WITH {ASPECTS} SELECT review_id, CASE WHEN rating <= 3 THEN priority || ' issue' WHEN review_id % 7 = 0 THEN segment || ' issue' END AS issue_ai FROM lab",
        "aspect_sides": f"""WITH {ASPECTS} SELECT review_id, array_to_string(list_filter([CASE WHEN rating <= 3 THEN priority || ' issue' END, CASE WHEN review_id % 7 = 0 THEN segment || ' issue' END], lambda x: x IS NOT NULL), '|') AS issues,
            CASE WHEN review_id % 2 = 0 THEN segment ELSE '' END AS topics FROM lab""",
        "score_sentiment": f"""WITH {ORDERS}, s AS (SELECT review_id, (review_id * 7) % 200 - 100 AS s, 25 * (review_id % 3) AS p FROM fb)
            SELECT review_id, CASE WHEN s <= -5 THEN 'Negative' WHEN s >= 5 THEN 'Positive' ELSE 'Neutral' END AS plain, CASE WHEN s - p <= -25 THEN 'Negative' WHEN s - p >= 50 THEN 'Positive' ELSE 'Neutral' END AS calibrated FROM s""",
        "resolved_sentiment": f"WITH {RESOLVED} SELECT review_id, sentiment, sentiment_source, in_label_sample, sample_weight, CASE WHEN by_rating IS NOT NULL THEN 1.0::DOUBLE WHEN sentiment_source IS NOT NULL THEN sample_weight END AS sentiment_weight FROM res",
        "label_sample": f"WITH {RESOLVED} SELECT entity, count(*) AS n FROM res WHERE in_label_sample GROUP BY entity",
        "sampling_strata": f"WITH {RESOLVED} SELECT coalesce(by_rating, 'Unrated') AS stratum, count(*) AS with_text, count(*) FILTER (in_label_sample) AS labelled, sum(sample_weight) AS weight FROM res WHERE has_text GROUP BY 1",
        "no_text_labels": f"WITH {ORDERS} SELECT CASE WHEN has_text THEN 'not_sampled' ELSE 'no_text' END AS label_source, count(*) AS n, CAST(0 AS BIGINT) AS labelled, CAST(0 AS BIGINT) AS weighted FROM fb GROUP BY 1",
        "usable_rows": f"WITH {ORDERS} SELECT region, count(*) AS n FROM fb WHERE has_text OR rating IS NOT NULL GROUP BY region",
        "cut_texts": r"""WITH c AS (SELECT doc_id, text[1:500] AS t FROM documents), m AS (SELECT max(length(t)) AS m, count(t) AS n FROM c), k AS (SELECT count(*) FILTER (length(t) >= m.m - 10) AS near FROM c, m)
            SELECT doc_id, coalesce(near >= greatest(20, n * 0.01) AND length(t) >= m.m - 10 AND NOT regexp_matches(t, '[.!?…"''”’)\]]\s*$'), false) AS text_truncated FROM c, m, k""",
        "prompt_guard": """WITH t AS (SELECT lang, text, left(text, 2000) AS t FROM documents)
            SELECT lang, count(*) FILTER (length(text) > 2000) AS cut, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(length(t) + 4 * len(regexp_extract_all(t, '&')) + 3 * len(regexp_extract_all(t, '[<>]')) + 5 * len(regexp_extract_all(t, '["'']'))) AS BIGINT) AS escaped_chars FROM t GROUP BY lang""",
        "cache_keys": "SELECT doc_id, sha256('model-1|v2|abcdef' || coalesce('|' || text, '')) AS key FROM documents",
        "label_repair": f"""WITH {ORDERS}, g AS (SELECT review_id, {one_of('Positive', 'negative', None, 'Neutral')} AS s, {one_of('A', 'Q', None)} AS q, {one_of('low', 'sure', None)} AS c,
                CASE WHEN review_id % 6 <> 0 THEN [{_ASPECT(one_of('A', 'B', 'Z'), one_of('negative', 'positive', 'mixed', 'negative'), one_of('Late', 'Rude', 'Unknown', None, 'Lost'))}, {_ASPECT("'B'", "'negative'", "'Rude'")}, {_ASPECT("'B'", "'positive'", "'Rude'")}, {_ASPECT("'A'", "'negative'", one_of('Late', 'Lost'))}] ELSE [] END AS a FROM fb),
            e AS (SELECT review_id, i, x.p AS p, CASE WHEN x.p = 'negative' AND x.i IN ('Late', 'Lost') THEN 'A' WHEN x.p = 'negative' AND x.i = 'Rude' THEN 'B' WHEN x.t IN ('A', 'B', 'Other') THEN x.t ELSE 'Other' END AS t,
                CASE WHEN x.p = 'negative' THEN CASE WHEN x.i IN ('Late', 'Lost', 'Rude') THEN x.i ELSE 'Other' END END AS n FROM (SELECT review_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM g) WHERE x.p IN ('positive', 'negative')),
            d AS (SELECT review_id, t, p, n, min(i) AS i FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY i) AS nth FROM d),
            j AS (SELECT review_id, string_agg(t || ':' || p || ':' || coalesce(n, ''), '|' ORDER BY i) AS aspects, max(t) FILTER (nth = 1) AS first FROM k WHERE nth <= 3 GROUP BY review_id)
            SELECT review_id, CASE WHEN s IN ('Positive', 'Neutral') THEN s ELSE 'Neutral' END AS sentiment_ai, CASE WHEN q = 'A' THEN q ELSE coalesce(first, 'Other') END AS primary_topic_ai, CASE WHEN c = 'low' THEN c ELSE 'medium' END AS confidence_ai, coalesce(aspects, '') AS aspects FROM g LEFT JOIN j USING (review_id)""",
        "flag_metrics": f"""WITH {ORDERS}, b AS (SELECT CASE {_T} WHEN 'yes' THEN true WHEN '1' THEN true WHEN 'no' THEN false END AS t, {_P} AS p FROM fb), c AS (SELECT count(*) AS n, count(*) FILTER (t AND p)::DOUBLE AS tp, count(*) FILTER (NOT t AND p)::DOUBLE AS fp, count(*) FILTER (t AND NOT p)::DOUBLE AS fn FROM b WHERE t IS NOT NULL AND p IS NOT NULL)
            SELECT n, {pct('n - fp - fn', 'n')} AS accuracy, {he('tp / (tp + fp)', 3)} AS precision, {he('tp / (tp + fn)', 3)} AS recall, {he('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))', 3)} AS f1, {wilson('tp', 'tp + fn', 'low')} AS recall_low, {wilson('tp', 'tp + fn', 'high')} AS recall_high FROM c""",
        "truth_problems": f"""WITH {ORDERS}, g AS (SELECT CASE WHEN review_id % 50 = 0 THEN -review_id ELSE review_id END AS id, {one_of('Positive', 'Negative', 'positive', '', 'Awful', 'Negative')} AS s, {one_of('A', '', 'B', 'a')} AS t, CASE WHEN review_id % 3 = 0 THEN {one_of('Late', 'Rude', 'Unheard', 'Lost')} END AS i FROM fb WHERE review_id % 5 = 0),
            p AS (SELECT id, 'error' AS level, 'unknown sentiment: ' || s || CASE s WHEN 'positive' THEN ' (did you mean Positive?)' ELSE '' END AS problem FROM g WHERE s IN ('positive', 'Awful')
            UNION ALL SELECT id, 'error', 'unknown topic: a (did you mean A?)' FROM g WHERE t = 'a'
            UNION ALL SELECT id, 'error', 'topic is empty' FROM g WHERE t = '' AND s <> '' UNION ALL SELECT id, 'error', 'sentiment is empty' FROM g WHERE s = '' AND t <> ''
            UNION ALL SELECT id, 'error', 'unknown issue' FROM g WHERE i = 'Unheard' UNION ALL SELECT id, 'error', 'review_id is not in the data' FROM g WHERE id < 0
            UNION ALL SELECT id, 'warning', 'negative without an issue' FROM g WHERE s = 'Negative' AND i IS NULL
            UNION ALL SELECT id, 'warning', 'main issue is of another topic' FROM g WHERE (i IN ('Late', 'Lost') AND t <> 'A') OR (i = 'Rude' AND t <> 'B'))
            SELECT level, problem, count(*) AS n FROM p GROUP BY ALL""",
        "truth_agreement": f'WITH {PREDICTED} SELECT rating, count(sentiment) AS n, count(*) FILTER (sentiment = pred) AS "right" FROM pr WHERE review_id % 3 = 0 GROUP BY rating',
        "cost_estimate": f"""WITH {ORDERS}, t AS (SELECT count(*) AS reviews, sum(ceil(least(length(entity) * (review_id % 300), 2000) / CAST(4 AS DOUBLE))) AS tokens FROM fb WHERE has_text), b AS (SELECT *, ceil(reviews / CAST(25 AS DOUBLE)) AS batches FROM t)
            SELECT reviews, CAST(batches AS BIGINT) AS batches, CAST(tokens + batches * 1200 AS BIGINT) AS input_tokens, reviews * 120 AS output_tokens, round((tokens + batches * 1200) * 3 / 1e6 + reviews * 120 * 15 / 1e6, 2) AS cost FROM b""",
        "multilabel_by_label": f"""WITH {ORDERS}, m AS (SELECT list_filter([{PICK(0)}], lambda x: x IS NOT NULL) AS t, list_filter([{PICK(1)}], lambda x: x IS NOT NULL) AS p FROM fb), l AS (SELECT 'L' || i.range AS label, list_contains(t, 'L' || i.range) AS t, list_contains(p, 'L' || i.range) AS p FROM m, range(2, 7) i),
            c AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM l GROUP BY label) SELECT label, tp, fp, fn, {he('CAST(2 AS DOUBLE) * tp / (2 * tp + fp + fn)', 3)} AS f1, tp + fn AS support FROM c WHERE tp + fp + fn > 0""",
        "band_left": f"""WITH {ORDERS}, v AS (SELECT review_id, review_id % 120 AS x FROM fb)
            SELECT review_id, CASE WHEN x < 20 THEN 'few' WHEN x < 50 THEN 'some' WHEN x < 100 THEN 'many' END AS band, CASE WHEN x <= 20 THEN 'few' WHEN x <= 50 THEN 'some' WHEN x <= 100 THEN 'many' END AS right_band FROM v""",
        "significant_drivers": f'SELECT dimension, "group", lift FROM ({ORACLE_SQL["low_rating_drivers"]}) WHERE significant AND lift > 1',
        "issue_months": f"WITH {ASPECTS} SELECT CAST(month AS VARCHAR) AS month, count(*) AS n FROM lab WHERE rating <= 3 AND priority = '1-URGENT' GROUP BY 1",
        "true_issue_months": f"WITH {ORDERS} SELECT region, CASE WHEN review_id % 4 = 0 THEN priority END AS true_issue, count(*) AS n FROM fb GROUP BY 1, 2",
        "sample_by_truth": f"WITH {ORDERS} SELECT review_id, sentiment FROM fb QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY sha256(review_id || '|7'), review_id) <= 50",
        "tuning_exclusions": f"WITH {ORDERS} SELECT CASE WHEN review_id % 6 = 0 THEN 'excluded' WHEN right(sha256(CAST(review_id AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'tune' ELSE 'test' END AS side, count(*) AS n FROM fb GROUP BY 1",
        "stratified_sample": """WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'Negative' WHEN doc_id % 10 < 4 THEN 'Neutral' WHEN doc_id % 10 < 9 THEN 'Positive' ELSE 'Unrated' END AS stratum, count(*) AS big FROM documents GROUP BY 1), t AS (SELECT sum(big) AS whole FROM s),
            u AS (SELECT least(round_even(200 * CAST(big AS DOUBLE) / whole, 0), big) AS u FROM s, t WHERE stratum = 'Unrated'),
            a AS (SELECT stratum, big, CASE WHEN big >= (200 - u) * 0.5 THEN 0 ELSE 1 END AS full_, (200 - u) AS budget, CASE stratum WHEN 'Negative' THEN 0.5 ELSE 0.25 END AS share FROM s, u WHERE stratum <> 'Unrated'),
            f AS (SELECT *, CASE WHEN stratum = 'Negative' AND big <= budget * 0.5 THEN big END AS capped FROM a), r AS (SELECT *, budget - coalesce((SELECT sum(capped) FROM f), 0) AS rest, (SELECT sum(share) FROM f WHERE capped IS NULL) AS shares FROM f),
            w AS (SELECT *, coalesce(capped, rest * share / shares) AS want FROM r), n AS (SELECT *, coalesce(capped, floor(want)) AS n0, row_number() OVER (PARTITION BY capped IS NULL ORDER BY floor(want) - want, stratum) AS rk, rest - (SELECT sum(floor(want)) FROM w WHERE capped IS NULL) AS short FROM w),
            done AS (SELECT stratum, big, CAST(n0 + CASE WHEN capped IS NULL AND rk <= short THEN 1 ELSE 0 END AS BIGINT) AS n FROM n UNION ALL SELECT 'Unrated', big, CAST(u AS BIGINT) FROM s, u WHERE stratum = 'Unrated')
            SELECT stratum, CASE WHEN whole <= 200 THEN big ELSE n END AS n, big AS weight FROM done, t""",
    }
)
