"""SQL (DuckDB) that gives the same rows as the registered queries, over the same tables."""

from __future__ import annotations

from fernwell.functions.numbers import ERFC

ORDERS = """fb0 AS (
    SELECT o_orderkey AS review_id, n_name AS entity, o_orderpriority AS priority, c_mktsegment AS segment, r_name AS region,
        CASE WHEN o_orderkey % 29 <> 0 THEN CAST(1 + (o_orderkey * 7 + o_custkey * 3) % 5 - CASE WHEN n_nationkey % 4 = 0 AND (o_orderkey * 7 + o_custkey * 3) % 5 > 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS rating,
        CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_totalprice AS DOUBLE) AS value,
        CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.0::DOUBLE END AS fulfilled,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1 + o_orderkey % 4 AS DOUBLE) END AS weight, o_orderkey % 10 <> 0 AS has_text
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fb AS (SELECT *, coalesce(weight, 0.0::DOUBLE) AS w, CASE WHEN review_id % 31 <> 0 THEN CASE WHEN rating <= 2 THEN 'Negative' WHEN rating >= 4 THEN 'Positive' WHEN rating IS NOT NULL THEN 'Neutral' END END AS sentiment FROM fb0)"""


def he(x: str, digits: int) -> str:
    k = 10**digits
    return f"(round_even(CAST(({x}) AS DOUBLE) * {k}, 0) / {k})"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN {he(f'CAST(100 AS DOUBLE) * ({a}) / ({b})', 1)} END)"


def ratio(a: str, b: str, digits: int = 2) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN {he(f'CAST(({a}) AS DOUBLE) / ({b})', digits)} END)"


def erfc(z: str) -> str:
    t = f"(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ({z})))"
    total = f"CAST({ERFC[-1]!r} AS DOUBLE)"
    for c in reversed(ERFC[:-1]):
        total = f"(CAST({c!r} AS DOUBLE) + {t} * {total})"
    return f"({t} * exp(-({z}) * ({z}) + {total}))"


def two_proportion(p1: str, n1: str, p2: str, n2: str) -> str:
    pooled = f"((({p1}) * ({n1}) + ({p2}) * ({n2})) / CAST(({n1}) + ({n2}) AS DOUBLE) / CAST(100 AS DOUBLE))"
    spread = f"sqrt({pooled} * (1 - {pooled}) * (CAST(1 AS DOUBLE) / ({n1}) + CAST(1 AS DOUBLE) / ({n2})))"
    z = f"(abs(({p1}) - ({p2})) / CAST(100 AS DOUBLE) / {spread} / sqrt(CAST(2 AS DOUBLE)))"
    return f"(CASE WHEN ({p1}) IS NOT NULL AND ({p2}) IS NOT NULL AND ({n1}) > 0 AND ({n2}) > 0 THEN CASE WHEN {spread} > 0 THEN {he(erfc(z), 4)} ELSE 1.0::DOUBLE END END)"


def sums(weight: str = "w", sentiment: str = "sentiment") -> str:
    given = lambda cond, v: f"coalesce(sum(CASE WHEN {cond} THEN {v} ELSE 0 END), 0)::DOUBLE"
    return f"""count(*) AS n, coalesce(sum({weight}), 0)::DOUBLE AS sw, {given('rating IS NOT NULL', weight)} AS w_rated, {given('rating IS NOT NULL', f'{weight} * rating')} AS w_rating,
        {given('rating <= 2', weight)} AS w_low, {given(f'{sentiment} IS NOT NULL', weight)} AS w_sent, {given(f"{sentiment} = 'Negative'", weight)} AS w_neg"""


METRICS = f"n AS reviews, {ratio('w_rating', 'w_rated')} AS avg_rating, {pct('w_neg', 'w_sent')} AS pct_negative, {pct('w_low', 'w_rated')} AS pct_low_rating"
ASC3 = "(VALUES ('Positive'), ('Neutral'), ('Negative')) AS s(sentiment)"
UNPIVOT = "SELECT rating, sentiment, w, unnest([{'d': 'entity', 'g': entity}, {'d': 'priority', 'g': priority}, {'d': 'segment', 'g': segment}, {'d': 'region', 'g': region}]) AS k FROM fb"

ORACLE_SQL: dict[str, str] = {
    "kpis_overview": f"""WITH {ORDERS} SELECT count(*) AS total_reviews, count(*) FILTER (has_text) AS reviews_with_text, count(rating) AS rated_reviews,
        {ratio('sum(CASE WHEN rating IS NOT NULL THEN w * rating END)', 'sum(CASE WHEN rating IS NOT NULL THEN w END)')} AS avg_rating,
        {', '.join(f"{pct(f'''sum(CASE WHEN sentiment = '{s}' THEN w ELSE 0 END)''', 'sum(CASE WHEN sentiment IS NOT NULL THEN w END)')} AS pct_{s.lower()}" for s in ('Positive', 'Neutral', 'Negative'))},
        {pct('sum(CASE WHEN rating <= 2 THEN w ELSE 0 END)', 'sum(CASE WHEN rating IS NOT NULL THEN w END)')} AS pct_low_rating, max(abs(w - 1)) > 1e-5 AS weighted,
        CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max, count(DISTINCT entity) AS n_entity, count(DISTINCT priority) AS n_priority FROM fb""",
    "rating_distribution": f"""WITH {ORDERS} SELECT CAST(r.range AS INTEGER) AS rating, count(fb.rating) AS reviews,
        {pct('count(fb.rating)', '(SELECT count(rating) FROM fb)')} AS pct FROM range(1, 6) r LEFT JOIN fb ON fb.rating = r.range GROUP BY r.range""",
    "sentiment_distribution": f"""WITH {ORDERS} SELECT s.sentiment, count(fb.sentiment) AS reviews, {pct('coalesce(sum(w), 0)', '(SELECT sum(w) FROM fb WHERE sentiment IS NOT NULL)')} AS pct
        FROM {ASC3} LEFT JOIN fb USING (sentiment) GROUP BY s.sentiment""",
    "sentiment_sources": f"""WITH {ORDERS}, s AS (SELECT CASE WHEN rating IS NOT NULL THEN 'rating' WHEN review_id % 2 = 0 THEN 'text_baseline' ELSE 'none' END AS sentiment_source FROM fb)
        SELECT sentiment_source, count(*) AS reviews, {pct('count(*)', '(SELECT count(*) FROM s)')} AS pct_of_rows FROM s GROUP BY 1""",
    "trend_monthly": f"""WITH {ORDERS}, m AS (SELECT month, {sums()} FROM fb WHERE month IS NOT NULL AND month_keep GROUP BY month), x AS (SELECT min(month) AS a, max(month) AS b FROM m),
        sp AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM x)
        SELECT CAST(month AS VARCHAR) AS month, coalesce(n, 0) AS reviews, {ratio('w_rating', 'w_rated')} AS avg_rating, {pct('w_neg', 'w_sent')} AS pct_negative, coalesce(n, 0) >= 15 AS reliable FROM sp LEFT JOIN m USING (month)""".replace("AND month_keep", "AND extract(month FROM month) <> 7"),
    "sentiment_trend": f"""WITH {ORDERS}, m AS (SELECT month, sum(w) AS total FROM fb WHERE month IS NOT NULL AND sentiment IS NOT NULL GROUP BY month)
        SELECT CAST(month AS VARCHAR) AS month, s.sentiment, count(fb.sentiment) AS reviews, {pct('coalesce(sum(fb.w), 0)', 'any_value(total)')} AS pct FROM m CROSS JOIN {ASC3} LEFT JOIN fb USING (month, sentiment) GROUP BY month, s.sentiment""",
    "recent_change": f"""WITH {ORDERS}, l AS (SELECT max(month) AS last FROM fb), r AS (SELECT *, date_diff('month', month, last) AS ago FROM fb, l WHERE month IS NOT NULL),
        g AS (SELECT entity AS "group", {', '.join(f"count(*) FILTER ({c} AND sentiment IS NOT NULL) AS {k}_reviews, sum(w) FILTER ({c} AND sentiment IS NOT NULL) AS {k}_w, sum(w * w) FILTER ({c} AND sentiment IS NOT NULL) AS {k}_w2, coalesce(sum(w) FILTER ({c} AND sentiment = 'Negative'), 0) AS {k}_neg" for k, c in (('recent', 'ago < 3'), ('previous', 'ago BETWEEN 3 AND 5')))}
            FROM r WHERE ago < 6 GROUP BY entity),
        h AS (SELECT *, {pct('recent_neg', 'recent_w')} AS recent_pct_negative, {pct('previous_neg', 'previous_w')} AS previous_pct_negative, recent_w * recent_w / nullif(recent_w2, 0) AS rn, previous_w * previous_w / nullif(previous_w2, 0) AS pn FROM g),
        i AS (SELECT *, {he('recent_pct_negative - previous_pct_negative', 1)} AS change_pp, {two_proportion('recent_pct_negative', 'rn', 'previous_pct_negative', 'pn')} AS p_value, least(recent_reviews, previous_reviews) >= 15 AS reliable FROM h)
        SELECT "group", previous_reviews, previous_pct_negative, recent_reviews, recent_pct_negative, change_pp, p_value,
            CASE WHEN NOT reliable OR change_pp IS NULL THEN 'Not enough data' WHEN p_value < 0.05 AND change_pp >= 2 THEN 'Increasing' WHEN p_value < 0.05 AND change_pp <= -2 THEN 'Decreasing' ELSE 'No clear change' END AS direction, reliable FROM i""",
    "group_summary": f"""WITH {ORDERS}, g AS (SELECT entity AS "group", {sums()}, coalesce(sum(CASE WHEN fulfilled IS NOT NULL THEN w END), 0) AS ov, coalesce(sum(CASE WHEN fulfilled = 1 THEN w END), 0) AS oy FROM fb WHERE entity IS NOT NULL GROUP BY entity)
        SELECT "group", {METRICS}, {pct('sw', '(SELECT sum(sw) FROM g)')} AS pct_of_reviews, {pct('oy', 'ov')} AS pct_fulfilled, n >= 15 AS reliable FROM g""",
    "breakdown_observed": f"""WITH {ORDERS}, g AS (SELECT priority AS "group", {sums('1')}, sum(CASE WHEN sentiment = 'Negative' THEN w ELSE 0 END) AS pn, sum(CASE WHEN sentiment IS NOT NULL THEN w ELSE 0 END) AS ps FROM fb WHERE priority IS NOT NULL GROUP BY priority)
        SELECT "group", n AS reviews, {ratio('w_rating', 'w_rated')} AS avg_rating, {pct('pn', 'ps')} AS pct_negative, {pct('w_low', 'w_rated')} AS pct_low_rating, {pct('n', '(SELECT sum(n) FROM g)')} AS pct_of_reviews, n >= 15 AS reliable FROM g""",
    "breakdowns_fused": f"""WITH {ORDERS}, g AS (SELECT k.d AS dimension, k.g AS "group", {sums()} FROM ({UNPIVOT}) GROUP BY 1, 2)
        SELECT dimension, "group", {METRICS}, {pct('sw', 'sum(sw) OVER (PARTITION BY dimension)')} AS pct_of_reviews, n >= 15 AS reliable FROM g WHERE "group" IS NOT NULL""",
    "band_fixed": f"""WITH {ORDERS}, b AS (SELECT rating, CASE WHEN value >= 0 AND value <= 50000 THEN 'low' WHEN value > 50000 AND value <= 150000 THEN 'mid' WHEN value > 150000 AND value <= 300000 THEN 'high' WHEN value > 300000 AND value <= 100000000 THEN 'top' END AS band FROM fb WHERE rating IS NOT NULL)
        SELECT s.band, count(b.rating) AS reviews, {he('avg(b.rating)', 2)} AS avg_rating, {pct('count(*) FILTER (b.rating <= 2)', 'count(b.rating)')} AS pct_low_rating, count(b.rating) >= 15 AS reliable
        FROM (VALUES ('low'), ('mid'), ('high'), ('top')) AS s(band) LEFT JOIN b USING (band) GROUP BY s.band""",
    "band_quantile": f"""WITH {ORDERS}, v AS (SELECT rating, (review_id * 37) % 1009 AS x FROM fb WHERE rating IS NOT NULL), e AS (SELECT quantile_cont(x::DOUBLE, [0, 0.25, 0.5, 0.75, 1]) AS q FROM v),
        b AS (SELECT rating, CASE WHEN x >= q[1] AND x <= q[2] THEN 1 WHEN x <= q[3] THEN 2 WHEN x <= q[4] THEN 3 ELSE 4 END AS i, q FROM v, e)
        SELECT CAST(round_even(any_value(q)[i], 0) AS BIGINT)::VARCHAR || '–' || replace(format('{{:,}}', CAST(round_even(any_value(q)[i + 1], 0) AS BIGINT)), '"', '') AS band, count(*) AS reviews, {he('avg(rating)', 2)} AS avg_rating,
            {pct('count(*) FILTER (rating <= 2)', 'count(*)')} AS pct_low_rating, count(*) >= 15 AS reliable FROM b GROUP BY i""",
    "spearman": f"""WITH {ORDERS}, v AS (SELECT rating AS y, CAST((review_id * 37) % 1009 + rating * 20 AS DOUBLE) AS x FROM fb WHERE rating IS NOT NULL),
        r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM v), c AS (SELECT count(*) AS n, {he('corr(rx, ry)', 3)} AS rho FROM r)
        SELECT n, rho, CASE WHEN abs(rho) < 0.1 THEN 'negligible' WHEN abs(rho) < 0.3 THEN 'weak' WHEN abs(rho) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength FROM c""",
    "low_rating_drivers": f"""WITH {ORDERS}, g AS (SELECT k.d AS dimension, k.g AS "group", count(*) AS reviews, count(*) FILTER (rating <= 2) AS l FROM ({UNPIVOT}) WHERE rating IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT count(*) AS all_n, count(*) FILTER (rating <= 2) AS all_low FROM fb WHERE rating IS NOT NULL),
        k AS (SELECT *, {pct('l', 'reviews')} AS pct_low_rating FROM g, t WHERE "group" IS NOT NULL AND reviews >= 15),
        m AS (SELECT *, all_n - reviews AS rest_n, CASE WHEN all_n > reviews THEN CAST(100 AS DOUBLE) * (all_low - pct_low_rating / CAST(100 AS DOUBLE) * reviews) / (all_n - reviews) END AS rest_pct FROM k),
        p AS (SELECT *, {he('pct_low_rating / (CAST(100 AS DOUBLE) * all_low / all_n)', 2)} AS lift, {two_proportion('pct_low_rating', 'reviews', 'rest_pct', 'rest_n')} AS p_value FROM m),
        r AS (SELECT *, row_number() OVER (ORDER BY coalesce(p_value, 1)) AS rk, count(*) OVER () AS m FROM p),
        q AS (SELECT *, {he('least(min(coalesce(p_value, 1) * m / CAST(rk AS DOUBLE)) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 1)', 4)} AS q_value FROM r)
        SELECT dimension, "group", reviews, pct_low_rating, lift, p_value, q_value, q_value < 0.05 AS significant FROM q""",
    "priority": f"""WITH {ORDERS}, g AS (SELECT entity AS "group", {sums()} FROM fb WHERE entity IS NOT NULL GROUP BY entity), m AS (SELECT "group", sw, {METRICS} FROM g),
        s AS (SELECT *, {pct('sw', '(SELECT sum(w) FROM fb)')} AS frequency_pct, {he('coalesce(pct_negative, 0) / CAST(100 AS DOUBLE) * coalesce(least(greatest((5 - avg_rating) / CAST(4 AS DOUBLE), 0), 1), 1)', 3)} AS severity FROM m),
        x AS (SELECT *, frequency_pct / CAST(100 AS DOUBLE) * severity AS score FROM s),
        i AS (SELECT *, CASE WHEN reviews >= 15 THEN round_even(CAST(100 AS DOUBLE) * score / (SELECT max(score) FROM x WHERE reviews >= 15), 0) END AS priority_index FROM x)
        SELECT "group", reviews, frequency_pct, avg_rating, pct_negative, severity, priority_index, CASE WHEN reviews < 15 THEN 'Insufficient data' WHEN priority_index >= 60 THEN 'High' WHEN priority_index >= 25 THEN 'Medium' ELSE 'Low' END AS priority FROM i""",
    "outcome_agreement": f"""WITH {ORDERS}, c AS (SELECT count(*) AS n, count(*) FILTER ((rating >= 4) = (fulfilled = 1)) AS agree, count(*) FILTER (rating >= 4 AND fulfilled = 0) AS positive_but_no, count(*) FILTER (rating <= 2 AND fulfilled = 1) AS negative_but_yes
            FROM fb WHERE fulfilled IS NOT NULL AND (rating <= 2 OR rating >= 4)),
        p AS (SELECT *, agree / CAST(n AS DOUBLE) AS p, CAST(1.96 AS DOUBLE) AS z FROM c)
        SELECT n, {pct('agree', 'n')} AS agreement_pct, {he('greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0) * 100', 1)} AS ci_low,
            {he('least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1) * 100', 1)} AS ci_high, positive_but_no, negative_but_yes FROM p""",
    "filtered_group_summary": f"""WITH {ORDERS}, g AS (SELECT entity AS "group", {sums()} FROM fb WHERE region IN ('ASIA', 'EUROPE') AND priority IN ('1-URGENT', '2-HIGH') GROUP BY entity)
        SELECT "group", {METRICS}, {pct('sw', '(SELECT sum(sw) FROM g)')} AS pct_of_reviews, n >= 15 AS reliable FROM g""",
}

ASPECTS = f"""{ORDERS}, lab AS (SELECT *, coalesce(weight, 1.0::DOUBLE) AS sw FROM fb WHERE has_text),
asp AS (SELECT review_id, rating, sentiment, sw, entity, region, priority AS topic, 'negative' AS polarity, priority || ' issue' AS issue FROM lab WHERE rating <= 3
    UNION ALL SELECT review_id, rating, sentiment, sw, entity, region, segment, 'positive', NULL FROM lab WHERE review_id % 2 = 0
    UNION ALL SELECT review_id, rating, sentiment, sw, entity, region, segment, 'negative', segment || ' issue' FROM lab WHERE review_id % 7 = 0),
tot AS (SELECT sum(sw) AS total FROM lab)"""
PREDICTED = f"""{ORDERS}, pr AS (SELECT *, CASE WHEN review_id % 17 = 0 THEN NULL WHEN review_id % 3 = 0 THEN 'Negative' WHEN (review_id * 13) % 7 < 2 THEN 'Neutral' ELSE coalesce(sentiment, 'Positive') END AS pred FROM fb),
cm AS (SELECT sentiment AS "true", coalesce(pred, '(none)') AS pred, count(*) AS n FROM pr WHERE sentiment IS NOT NULL GROUP BY 1, 2)"""
CLASSES = f"""k AS (SELECT s.sentiment AS label, coalesce(sum(n) FILTER ("true" = s.sentiment AND pred = s.sentiment), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (pred = s.sentiment), 0)::DOUBLE AS pp, coalesce(sum(n) FILTER ("true" = s.sentiment), 0)::DOUBLE AS sup FROM cm, {ASC3} GROUP BY 1),
    pr3 AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r FROM k), f3 AS (SELECT *, {he('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 3)} AS f1 FROM pr3)"""


def wilson(s: str, n: str, side: str) -> str:
    p, z = f"(CAST({s} AS DOUBLE) / ({n}))", "CAST(1.96 AS DOUBLE)"
    half = f"{z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))"
    centre = f"({p} + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n}))"
    return f"CASE WHEN ({n}) > 0 THEN {he(f'greatest({centre} - {half}, 0) * 100' if side == 'low' else f'least({centre} + {half}, 1) * 100', 1)} END"


def whole(words: str) -> str:
    """Whole words by Unicode's letters; the engine's own word edge knows ASCII only."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:[^\p{{L}}\p{{N}}_]|$)"


MATCH = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
PICK = lambda m: ", ".join(f"CASE WHEN review_id % {i + m} = 0 THEN 'L{i}' END" for i in range(2, 6))
GRID = ", ".join(f"({a / 10}::DOUBLE, {b / 10}::DOUBLE, {p / 10}::DOUBLE)" for a in (-3, -1) for b in (2, 5) for p in (0, 1))

ORACLE_SQL.update(
    {
        "dedup_exact": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
        "dedup_resubmission": f"""WITH m AS (SELECT doc_id, lang, {MATCH} AS m FROM documents)
            SELECT doc_id, lang FROM m QUALIFY length(m) < 20 OR row_number() OVER (PARTITION BY m, lang ORDER BY doc_id) = 1""",
        "canonical_labels": f"""WITH {ORDERS}, l AS (SELECT review_id, trim(CASE WHEN review_id % 3 = 0 THEN upper(region) WHEN review_id % 5 = 1 THEN lower(region) || ' ' ELSE array_to_string(list_transform(string_split(lower(region), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END) AS label FROM fb),
            c AS (SELECT lower(label) AS k, label, count(*) AS n, min(review_id) AS o FROM l GROUP BY 1, 2), b AS (SELECT k, label FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, o) = 1)
            SELECT review_id, b.label FROM l JOIN b ON lower(l.label) = b.k""",
        "id_repair": f"""WITH {ORDERS}, i AS (SELECT review_id AS k, CASE WHEN review_id % 50 <> 0 THEN CAST(review_id % 9000 AS VARCHAR) END AS id FROM fb),
            g AS (SELECT k, coalesce(id, 'gen_' || lpad(CAST(row_number() OVER (PARTITION BY id IS NULL ORDER BY k) AS VARCHAR), 6, '0')) AS id FROM i), r AS (SELECT k, id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS again FROM g)
            SELECT k, CASE WHEN again > 0 THEN id || '_dup' || again ELSE id END AS review_id FROM r""",
        "parse_values": f"""WITH {ORDERS} SELECT review_id, CASE WHEN review_id % 4 IN (0, 1) AND 1 + review_id % 7 <= 5 THEN CAST(1 + review_id % 7 AS DOUBLE) WHEN review_id % 4 = 3 AND 1 + review_id % 7 <= 4 THEN CAST(2 + review_id % 7 AS DOUBLE) END AS rating,
            CAST(review_id * 10 AS DOUBLE) + 0.25 AS amount, CAST(date AS VARCHAR) AS day FROM fb""",
        "keyword_hits": f"""SELECT lang, count(*) FILTER (regexp_matches(text, '{whole('the(?:s|d)?|and(?:s|es|ed|ing)?')}')) AS english, count(*) FILTER (regexp_matches(text, '{whole('und(?:s|es|ed|ing)?|der(?:s|es|ed|ing)?')}')) AS german,
            count(*) FILTER (regexp_matches(text, '{whole('with(?:s|es|ed|ing)?')}')) AS rare FROM documents GROUP BY lang""",
        "sentence_split": r"""WITH s AS (SELECT conv_id, turn, text, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '(?i)\s+(?:but|however|unfortunately)\s+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM conversations)
            SELECT conv_id, turn, CAST(len(parts) AS INTEGER) AS n_sentences, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM s""",
        "tuning_split": "SELECT doc_id, CASE WHEN right(sha256(CAST(doc_id AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'tune' ELSE 'test' END AS side FROM documents",
        "semi_filter": f"WITH {ORDERS} SELECT entity, count(*) AS n FROM fb WHERE review_id IN (SELECT review_id FROM fb WHERE fulfilled = 1) GROUP BY entity",
        "anti_filter": f"WITH {ORDERS} SELECT entity, count(*) AS n FROM fb WHERE NOT EXISTS (SELECT 1 FROM fb x WHERE x.review_id = fb.review_id AND x.fulfilled = 1) GROUP BY entity",
        "aspect_explode": f"WITH {ASPECTS} SELECT review_id, topic, polarity, issue FROM asp",
        "topics_outer": f"""WITH {ASPECTS}, o AS (SELECT DISTINCT review_id, topic, polarity, sw FROM asp) SELECT topic, count(*) FILTER (polarity = 'negative') AS reviews_complaint, {pct("coalesce(sum(sw) FILTER (polarity = 'negative'), 0)", '(SELECT total FROM tot)')} AS est_pct_of_reviews_complaint,
            count(*) FILTER (polarity = 'positive') AS reviews_praise, {pct("coalesce(sum(sw) FILTER (polarity = 'positive'), 0)", '(SELECT total FROM tot)')} AS est_pct_of_reviews_praise FROM o GROUP BY topic""",
        "praise": f"WITH {ASPECTS}, o AS (SELECT DISTINCT review_id, topic, sw FROM asp WHERE polarity = 'positive') SELECT topic, count(*) AS reviews, {pct('sum(sw)', '(SELECT total FROM tot)')} AS est_pct_of_reviews FROM o GROUP BY topic",
        "flags": f"""WITH {ASPECTS} SELECT 'late' AS flag, count(*) FILTER (review_id % 11 = 0) AS reviews, {pct('sum(CASE WHEN review_id % 11 = 0 THEN sw ELSE 0 END)', 'sum(sw)')} AS est_pct_of_reviews, 'came late' AS definition FROM lab
            UNION ALL SELECT 'again', count(*) FILTER (review_id % 6 = 0), {pct('sum(CASE WHEN review_id % 6 = 0 THEN sw ELSE 0 END)', 'sum(sw)')}, 'bought again' FROM lab""",
        "issues_by_segment": f"""WITH {ASPECTS}, o AS (SELECT DISTINCT review_id, issue, region, sw FROM asp WHERE polarity = 'negative'), b AS (SELECT issue FROM o GROUP BY issue ORDER BY sum(sw) DESC, issue LIMIT 4), w AS (SELECT region, sum(sw) AS total FROM lab GROUP BY region)
            SELECT region, issue, count(*) AS reviews, {pct('sum(sw)', 'any_value(total)')} AS est_pct_of_segment FROM o JOIN w USING (region) WHERE issue IN (FROM b) GROUP BY region, issue""",
        "issue_priority": f"""WITH {ASPECTS}, d AS (SELECT DISTINCT review_id, issue, rating, sentiment, sw FROM asp WHERE polarity = 'negative'), g AS (SELECT issue AS "group", {sums('sw')} FROM d GROUP BY issue), m AS (SELECT "group", sw, {METRICS} FROM g),
            s AS (SELECT *, {pct('sw', '(SELECT total FROM tot)')} AS frequency_pct, {he('coalesce(pct_negative, 0) / CAST(100 AS DOUBLE) * coalesce(least(greatest((5 - avg_rating) / CAST(4 AS DOUBLE), 0), 1), 1)', 3)} AS severity FROM m), x AS (SELECT *, frequency_pct / CAST(100 AS DOUBLE) * severity AS score FROM s),
            i AS (SELECT *, CASE WHEN reviews >= 15 THEN round_even(CAST(100 AS DOUBLE) * score / (SELECT max(score) FROM x WHERE reviews >= 15), 0) END AS priority_index FROM x)
            SELECT "group", reviews, frequency_pct, avg_rating, pct_negative, severity, priority_index, CASE WHEN reviews < 15 THEN 'Insufficient data' WHEN priority_index >= 60 THEN 'High' WHEN priority_index >= 25 THEN 'Medium' ELSE 'Low' END AS priority FROM i""",
        "confusion": f'WITH {PREDICTED} SELECT "true", pred, n FROM cm',
        "class_metrics": f"WITH {PREDICTED}, {CLASSES} SELECT label, {he('p', 3)} AS precision, {he('r', 3)} AS recall, f1, CAST(sup AS BIGINT) AS support FROM f3",
        "classification_summary": f"""WITH {PREDICTED}, {CLASSES}, t AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER ("true" = pred)::BIGINT AS c FROM cm)
            SELECT n, {pct('c', 'n')} AS accuracy, {wilson('c', 'n', 'low')} AS ci_low, {wilson('c', 'n', 'high')} AS ci_high, (SELECT {he('avg(f1)', 3)} FROM f3 WHERE sup > 0) AS macro_f1 FROM t""",
        "binary_metrics": f"""WITH {PREDICTED}, b AS (SELECT sentiment = 'Negative' AS t, pred = 'Negative' AS p FROM pr WHERE sentiment IS NOT NULL AND pred IS NOT NULL), c AS (SELECT count(*) AS n, count(*) FILTER (t AND p)::DOUBLE AS tp, count(*) FILTER (NOT t AND p)::DOUBLE AS fp, count(*) FILTER (t AND NOT p)::DOUBLE AS fn FROM b)
            SELECT n, {pct('n - fp - fn', 'n')} AS accuracy, {he('tp / (tp + fp)', 3)} AS precision, {he('tp / (tp + fn)', 3)} AS recall, {he('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))', 3)} AS f1,
            {wilson('tp', 'tp + fn', 'low')} AS recall_low, {wilson('tp', 'tp + fn', 'high')} AS recall_high FROM c""",
        "multilabel_summary": f"""WITH {ORDERS}, m AS (SELECT list_filter([{PICK(0)}], lambda x: x IS NOT NULL) AS t, list_filter([{PICK(1)}], lambda x: x IS NOT NULL) AS p FROM fb), l AS (SELECT 'L' || i.range AS label, t, p FROM m, range(2, 6) i),
            c AS (SELECT label, count(*) FILTER (list_contains(t, label) AND list_contains(p, label))::DOUBLE AS tp, count(*) FILTER (NOT list_contains(t, label) AND list_contains(p, label))::DOUBLE AS fp, count(*) FILTER (list_contains(t, label) AND NOT list_contains(p, label))::DOUBLE AS fn FROM l GROUP BY label)
            SELECT (SELECT count(*) FROM m) AS n, {he('2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))', 3)} AS micro_f1, {he(f"avg({he('2 * tp / (2 * tp + fp + fn)', 3)})", 3)} AS macro_f1, {pct('(SELECT count(*) FROM m WHERE list_sort(t) = list_sort(p))', '(SELECT count(*) FROM m)')} AS exact_pct FROM c""",
        "population_accuracy": f"""WITH {PREDICTED}, r AS (SELECT * FROM pr WHERE sentiment IS NOT NULL), s AS (SELECT * FROM r WHERE review_id % 5 = 0 OR sentiment = 'Negative'), b AS (SELECT sentiment, count(*)::DOUBLE AS big FROM r GROUP BY 1), k AS (SELECT sentiment, count(*)::DOUBLE AS small FROM s GROUP BY 1)
            SELECT {pct('sum(CASE WHEN sentiment = pred THEN big / small ELSE 0 END)', 'sum(big / small)')} AS weighted_accuracy FROM s JOIN b USING (sentiment) JOIN k USING (sentiment)""",
        "rating_outcome_table": f"WITH {ORDERS} SELECT rating, count(*) FILTER (fulfilled = 0) AS no, count(*) FILTER (fulfilled = 1) AS yes FROM fb WHERE rating IS NOT NULL AND fulfilled IS NOT NULL GROUP BY rating",
        "calibration": f"""WITH {ORDERS}, g AS (SELECT * FROM (VALUES {GRID}) AS g(negative_max, positive_min, penalty)), v AS (SELECT sentiment AS "true", {he("((review_id * 7) % 200 - 100) / CAST(100 AS DOUBLE)", 4)} AS score, review_id % 3 AS k FROM fb WHERE sentiment IS NOT NULL),
            a AS (SELECT negative_max, positive_min, penalty, "true", CASE WHEN score - penalty * k <= negative_max THEN 'Negative' WHEN score - penalty * k >= positive_min THEN 'Positive' ELSE 'Neutral' END AS pred, count(*) AS n FROM v, g GROUP BY ALL),
            k AS (SELECT negative_max, positive_min, penalty, s.sentiment AS label, coalesce(sum(n) FILTER ("true" = s.sentiment AND pred = s.sentiment), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (pred = s.sentiment), 0)::DOUBLE AS pp, coalesce(sum(n) FILTER ("true" = s.sentiment), 0)::DOUBLE AS sup FROM a, {ASC3} GROUP BY ALL),
            p3 AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r FROM k), f3 AS (SELECT *, {he('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 3)} AS f1 FROM p3),
            m AS (SELECT negative_max, positive_min, penalty, {he('avg(f1)', 3)} AS macro_f1 FROM f3 WHERE sup > 0 GROUP BY ALL), t AS (SELECT negative_max, positive_min, penalty, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER ("true" = pred), 0)::BIGINT AS c FROM a GROUP BY ALL)
            SELECT negative_max, positive_min, penalty, n, {pct('c', 'n')} AS accuracy, {wilson('c', 'n', 'low')} AS ci_low, {wilson('c', 'n', 'high')} AS ci_high, macro_f1 FROM t JOIN m USING (negative_max, positive_min, penalty)""",
        "events_windows": f"""WITH fb AS (SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS window_start, event_type AS "group", CAST(1 + event_id % 5 AS DOUBLE) AS rating, CASE WHEN 1 + event_id % 5 <= 2 THEN 'Negative' WHEN 1 + event_id % 5 >= 4 THEN 'Positive' ELSE 'Neutral' END AS sentiment FROM events),
            g AS (SELECT window_start, "group", {sums('1')} FROM fb GROUP BY 1, 2) SELECT window_start, "group", {METRICS} FROM g""",
    }
)
