"""ANSI SQL for the registered queries, run by another engine to check the results.

The statements are written from the definitions (row-level sums, pairwise complements,
cross-joined grids), not from the Spark plans.
"""

from __future__ import annotations

from tidewatch.functions.stats import t_expansion_terms, t_table
from tidewatch.operators.labels import PROBLEM_WORDS
from tidewatch.params import ForecastParams, ImpactParams, TextParams, TrendParams
from tidewatch.plans.derived import APP_ID, APP_NAME, STORE_APP_ID

# The 97.5 % quantile of the normal distribution, and texts of the results.
Z_975 = 1.959963984540054
NO_TEST = "sample too small for a meaningful test"
RANK_REASON = ("ordinal 1-5 ratings / non-normal or moderate n -> "
               "Mann-Whitney U (rank-based)")

TREND, IMPACT, FORECAST, TEXT = TrendParams(), ImpactParams(), ForecastParams(), TextParams()

SPACE = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}]")
NOT_SPACE = SPACE.replace("[", "[^", 1)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def py_round(x: str, digits: int) -> str:
    """Exact binary rounding, ties to even, by splitting the product's error."""
    s = f"{10**digits}::DOUBLE"
    p, t = f"({x} * {s})", f"({x} * 134217729::DOUBLE)"
    high = f"({t} - ({t} - {x}))"
    rest = f"({p} - floor({p}) - 0.5::DOUBLE + (({high} * {s} - {p}) + ({x} - {high}) * {s}))"
    return (f"((CASE WHEN {rest} > 0 THEN floor({p}) + 1 WHEN {rest} < 0 THEN floor({p}) "
            f"WHEN floor({p}) % 2 = 0 THEN floor({p}) ELSE floor({p}) + 1 END) / {s})")


def erfc(x: str) -> str:
    """Complementary error function for x >= 0 (relative error 1.2e-7)."""
    t = f"(1 / (1 + 0.5 * {x}))"
    # The Chebyshev fit of Numerical Recipes.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = "0"
    for c in reversed(coefficients):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def two_sided(z: str) -> str:
    return f"CASE WHEN {z} > 38 THEN 0 ELSE {erfc(f'({z} / sqrt(2::DOUBLE))')} END"


def t_critical_real(df: str, alpha: float) -> str:
    """Large-sample expansion; the groups of the test tables have hundreds of rows."""
    out = "0::DOUBLE"
    for c in reversed(t_expansion_terms(alpha)):
        out = f"({out} / {df} + {c!r}::DOUBLE)"
    return out


# --- named parts ---------------------------------------------------------------------

def _series(name: str, unit: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Totals, statistics, grid and metrics of one period length."""
    p = TREND
    return {
        f"totals_{name}": (f"""
            SELECT date_trunc('{unit}', review_date)::DATE AS date, count(*) AS total_reviews
            FROM reviews GROUP BY 1""", ("reviews",)),
        f"stats_{name}": (f"""
            SELECT issue_id, date_trunc('{unit}', review_date)::DATE AS date,
                   count(*) AS mention_count, avg(rating) AS average_rating,
                   avg(CASE WHEN rating <= 2 THEN 1::DOUBLE ELSE 0 END) AS negative_share
            FROM assigned JOIN reviews USING (review_id) GROUP BY 1, 2""", ("assigned",)),
        f"grid_{name}": (f"""
            SELECT i.issue_id, t.date, coalesce(s.mention_count, 0) AS mention_count,
                   coalesce(s.mention_count, 0) / t.total_reviews AS issue_share,
                   s.average_rating, s.negative_share
            FROM (SELECT DISTINCT issue_id FROM stats_{name}) i
            CROSS JOIN totals_{name} t
            LEFT JOIN stats_{name} s ON s.issue_id = i.issue_id AND s.date = t.date""",
            (f"totals_{name}", f"stats_{name}")),
        f"steps_{name}": (f"""
            SELECT *, lag(issue_share, 1) OVER w AS prev,
                   lag(issue_share, {p.growth_lookback}) OVER w AS prior,
                   CASE WHEN count(*) OVER past >= {p.min_baseline}
                        THEN avg(issue_share) OVER past END AS base,
                   CASE WHEN count(*) OVER past >= {p.min_baseline}
                        THEN stddev_samp(issue_share) OVER past END AS sd
            FROM grid_{name}
            WINDOW w AS (PARTITION BY issue_id ORDER BY date),
                   past AS (PARTITION BY issue_id ORDER BY date
                            ROWS BETWEEN {p.rolling_periods} PRECEDING AND 1 PRECEDING)""",
            (f"grid_{name}",)),
        f"trends_{name}": (f"""
            SELECT issue_id, date, mention_count, issue_share, average_rating,
                   negative_share,
                   coalesce(issue_share - prev, 0) AS wow_change,
                   coalesce(base, 0) AS rolling_baseline, coalesce(sd, 0) AS rolling_std,
                   coalesce((issue_share - base) / nullif(sd, 0), 0) AS deviation_score,
                   coalesce(CASE WHEN prior = 0 AND issue_share > 0 THEN {p.growth_cap}
                            ELSE (issue_share - prior) / nullif(prior, 0) END, 0)::DOUBLE
                     AS growth_rate,
                   coalesce((issue_share - base) / nullif(sd, 0) >= {p.anomaly_z}
                            AND mention_count >= {p.min_mentions}, false) AS anomaly_flag
            FROM steps_{name}""", (f"steps_{name}",)),
    }


_HEX = "CAST(1 + least(4, floor(value / 25)) AS INTEGER)"

_ISSUE_CASE = """CASE
    WHEN event_type = 'error' AND event_id % 31 >= day(review_date) THEN 'other'
    WHEN event_type = 'signup' AND NOT (day(review_date) BETWEEN 20 AND 22
    OR event_id % 4 = 0) THEN 'other'
    ELSE event_type END"""
# Issues that reach every risk level.
_TIER_CASE = """CASE
    WHEN event_id BETWEEN 10 AND 13 THEN 'rare'
    WHEN day(review_date) = 30 OR rating = 3 THEN 'other'
    WHEN rating = 1 AND event_id % 100 >= 36 THEN 'crash'
    WHEN rating = 1 THEN 'login'
    WHEN event_id % 100 < 85 THEN 'slow' ELSE 'other' END"""


PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "reviews": (f"""
        SELECT 'ev_' || event_id AS review_id, event_id AS ingest_seq, {_HEX} AS rating,
               ts AS review_date,
               CASE WHEN event_id % 2 = 0 THEN 'google_play' ELSE 'app_store' END
                 AS source_platform,
               '{APP_ID}' AS app_id, '{APP_NAME}' AS app_name,
               CAST(NULL AS VARCHAR) AS app_version,
               event_type || ' ' || props AS review_text, event_id % 100 AS review_length,
               CASE WHEN event_id % 2 = 0 THEN CAST(user_id % 20 AS INTEGER) END
                 AS helpful_count,
               strftime(ts, '%Y-%m') AS review_month, event_id, event_type
        FROM events""", ()),
    "assigned": (f"""
        SELECT review_id, 'issue_' || name AS issue_id, name || ' problem' AS issue_label
        FROM (SELECT review_id, rating, {_ISSUE_CASE} AS name FROM reviews)
        WHERE rating <= 3""", ("reviews",)),
    "dirty": ("""
        SELECT CASE WHEN event_id % 71 <> 0 THEN review_id END AS review_id,
               CASE WHEN event_id % 73 = 0 THEN '   ' ELSE review_text END AS review_text,
               CASE WHEN event_id % 97 = 0 THEN 9 ELSE rating END AS rating,
               CASE WHEN event_id % 101 <> 0 THEN review_date END AS review_date,
               CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 'web'
                    ELSE source_platform END AS source_platform,
               CASE WHEN event_id % 79 = 0 THEN '' ELSE app_id END AS app_id,
               app_name, app_version, helpful_count,
               ingest_seq + c.copy * 1000000000 AS ingest_seq
        FROM reviews JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR event_id % 50 = 0""",
        ("reviews",)),
    "flagged": ("""
        SELECT *, missing_text OR invalid_rating OR invalid_date OR missing_platform
                  OR unknown_platform OR missing_app_id OR missing_review_id
                  OR duplicate_review_id AS dropped
        FROM (SELECT *,
          review_text IS NULL OR trim(review_text) = '' AS missing_text,
          rating IS NULL OR rating < 1 OR rating > 5 AS invalid_rating,
          review_date IS NULL AS invalid_date,
          source_platform IS NULL AS missing_platform,
          coalesce(source_platform NOT IN ('google_play', 'app_store'), true)
            AS unknown_platform,
          app_id IS NULL OR trim(app_id) = '' AS missing_app_id,
          review_id IS NULL OR trim(review_id) = '' AS missing_review_id,
          review_id IS NOT NULL AND trim(review_id) <> '' AND row_number() OVER (
            PARTITION BY review_id ORDER BY ingest_seq) > 1 AS duplicate_review_id
        FROM dirty)""", ("dirty",)),
    "docs": (f"""
        SELECT 'doc_' || doc_id AS review_id, doc_id, lang,
               CAST(CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2
                    WHEN quality = 1 THEN 3 + doc_id % 3 ELSE 1 + doc_id % 5 END AS INTEGER)
                 AS rating,
               DATE '2024-01-01' + CAST(doc_id % 84 AS INTEGER) AS day,
               lower(trim(regexp_replace(
                 replace(replace(replace(replace(replace(replace(replace(replace(
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                     regexp_replace(nfc_normalize(coalesce(text, '')),
                       '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'),
                     '!{{3,}}', '!!', 'g'), '\\?{{3,}}', '??', 'g'),
                     '\\.{{3,}}', '..', 'g'), ',{{3,}}', ',,', 'g'),
                   '²', '2'), '³', '3'), '¹', '1'), 'ª', 'a'), 'º', 'o'), '…', '...'),
                   '™', 'TM'), '½', '1⁄2'),
                 '{SPACE}+', ' ', 'g'))) AS cleaned_text
        FROM documents LEFT JOIN labels USING (doc_id)""", ()),
    "tokenized": ("""
        SELECT review_id, rating, lang, list_filter(
                 regexp_extract_all(cleaned_text, '[\\p{L}\\p{N}_]{2,}'),
                 lambda t: t NOT IN (@STOP@)) AS tokens
        FROM docs""", ("docs",)),
    "grams": ("""
        SELECT review_id, unnest(tokens) AS term FROM tokenized
        UNION ALL
        SELECT review_id, tokens[i] || ' ' || tokens[i + 1] AS term
        FROM (SELECT review_id, tokens, unnest(range(1, len(tokens))) AS i FROM tokenized)
        """, ("tokenized",)),
    "tf": ("SELECT review_id, term, count(*) AS tf FROM grams GROUP BY 1, 2", ("grams",)),
    "vocab": (f"""
        SELECT term, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1),
             (SELECT count(*) AS n FROM docs)
        WHERE df >= {TEXT.min_df} AND df <= {TEXT.max_df}::DOUBLE * n""", ("tf", "docs")),
    "weights": ("""
        SELECT review_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY review_id))
                 AS weight
        FROM (SELECT review_id, term, tf * idf AS raw FROM tf JOIN vocab USING (term))""",
        ("vocab",)),
    "members": ("""
        SELECT review_id, rating, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1
               WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS cluster_id FROM docs""",
        ("docs",)),
    "centres": ("""
        SELECT cluster_id, term, sum(weight) / any_value(size) AS mean_weight
        FROM weights JOIN members USING (review_id)
        JOIN (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1)
        USING (cluster_id) GROUP BY 1, 2""", ("weights", "members")),
    "top_terms": (f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
          ORDER BY round(mean_weight, 12) DESC, term) AS rank
          FROM centres WHERE mean_weight > 0) WHERE rank <= {TEXT.top_keywords}""",
        ("centres",)),
    **_series("day", "day"),
    **_series("week", "week"),
    "labels_of": ("""
        SELECT issue_id, min(issue_label) AS issue_label FROM assigned GROUP BY 1""",
        ("assigned",)),
    "scored": (f"""
        SELECT *, {TREND.w_growth} * s1 + {TREND.w_deviation} * s2 + {TREND.w_rating} * s3
                  + {TREND.w_negative} * s4 + {TREND.w_volume} * s5 AS blend,
               least(total_mentions / {TREND.confidence_cap}, 1)::DOUBLE AS confidence
        FROM (SELECT *,
          least(greatest(growth_rate, 0) / {TREND.growth_cap}::DOUBLE, 1) AS s1,
          least(greatest(deviation_score, 0) / {TREND.z_cap}::DOUBLE, 1) AS s2,
          CASE WHEN average_rating IS NULL THEN 0
               ELSE least(greatest((5 - average_rating) / 4, 0), 1) END AS s3,
          coalesce(negative_share, 0) AS s4,
          least(mention_count / {TREND.volume_cap}::DOUBLE, 1) AS s5
        FROM (SELECT *, lag(issue_share) OVER (PARTITION BY issue_id ORDER BY date)
                 AS previous_share,
               CAST(sum(mention_count) OVER (PARTITION BY issue_id) AS BIGINT)
                 AS total_mentions
              FROM trends_day)
        WHERE date = (SELECT max(date) FROM trends_day))""", ("trends_day",)),
    "summary": (f"""
        SELECT issue_id, issue_label, date AS latest_date,
               {py_round('issue_share', 4)} AS latest_share,
               {py_round('previous_share', 4)} AS previous_share,
               {py_round('growth_rate', 4)} AS recent_growth,
               {py_round('deviation_score', 3)} AS deviation_score,
               {py_round('average_rating', 3)} AS average_rating,
               {py_round('s4', 3)} AS negative_share, mention_count, total_mentions,
               anomaly_flag, {py_round('(100 * blend)', 1)} AS risk_score,
               CASE WHEN 100 * blend >= {TREND.risk_high} THEN 'HIGH'
                    WHEN 100 * blend >= {TREND.risk_medium} THEN 'MEDIUM' ELSE 'LOW' END
                 AS risk_level,
               {py_round('confidence', 3)} AS confidence,
               CASE WHEN confidence >= {TREND.confidence_high} THEN 'HIGH'
                    WHEN confidence >= {TREND.confidence_medium} THEN 'MEDIUM'
                    ELSE 'LOW' END AS confidence_level
        FROM scored LEFT JOIN labels_of USING (issue_id)""", ("scored", "labels_of")),
    # --- impact: every issue against every other review, row by row
    "placed": ("""
        SELECT rating, review_length AS len, issue_id,
               floor(date_diff('microsecond', (SELECT min(review_date) FROM reviews),
                     review_date) / 604800000000) AS week
        FROM reviews LEFT JOIN assigned USING (review_id)""", ("assigned",)),
    "compared": ("""
        SELECT i.issue_id AS issue, p.*, coalesce(p.issue_id = i.issue_id, false) AS own
        FROM placed p CROSS JOIN (SELECT DISTINCT issue_id FROM assigned) i""", ("placed",)),
    "groups": (f"""
        SELECT issue AS issue_id,
               count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n2,
               avg(rating) FILTER (own) AS mean1, avg(rating) FILTER (NOT own) AS mean2,
               avg(rating) AS overall,
               median(rating) FILTER (own) AS median1,
               median(rating) FILTER (NOT own) AS median2,
               avg((rating <= {IMPACT.low_rating})::INTEGER) FILTER (own) AS low1,
               avg((rating <= {IMPACT.low_rating})::INTEGER) FILTER (NOT own) AS low2,
               var_samp(rating) FILTER (own) AS var1,
               var_samp(rating) FILTER (NOT own) AS var2
        FROM compared GROUP BY 1""", ("compared",)),
    "welch": ("""
        SELECT *, mean1 - mean2 AS diff, sqrt(var1 / n1 + var2 / n2) AS se,
               (var1 / n1 + var2 / n2) ** 2 / ((var1 / n1) ** 2 / (n1 - 1)
                 + (var2 / n2) ** 2 / (n2 - 1)) AS dof
        FROM groups""", ("groups",)),
    "ranked": ("""
        SELECT issue, own, c, below + (c + 1) / 2::DOUBLE AS rank, c AS tie
        FROM (SELECT issue, rating, own,
                count(*) OVER (PARTITION BY issue, rating) AS c,
                rank() OVER (PARTITION BY issue ORDER BY rating) - 1 AS below
              FROM compared)""", ("compared",)),
    "rank_test": ("""
        SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2::DOUBLE - 0.5) / sigma AS z
        FROM (SELECT *, sqrt(n1 * n2 / 12::DOUBLE * ((n + 1) - ties / (n * (n - 1)::DOUBLE)))
                       AS sigma
              FROM (SELECT issue AS issue_id,
                      count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n2,
                      count(*) AS n,
                      sum(rank) FILTER (own)
                        - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2::DOUBLE
                        AS u1,
                      sum(tie::DOUBLE * tie - 1) AS ties
                    FROM ranked GROUP BY 1))""", ("ranked",)),
    # --- regression by two residualizing steps and the HC3 sandwich
    "sums": ("""
        SELECT issue, count(*) AS n, avg(own::INTEGER) AS p, avg(len) AS ml,
               avg(week) AS mw, avg(rating) AS my,
               regr_sxx(len, len) AS aa, regr_sxx(week, week) AS bb,
               regr_sxy(len, week) AS ab, regr_sxy(rating, len) AS ay,
               regr_sxy(rating, week) AS by_, regr_sxy(own::INTEGER, len) AS da,
               regr_sxy(own::INTEGER, week) AS db
        FROM compared GROUP BY 1""", ("compared",)),
    "residual": ("""
        SELECT c.issue, n,
               own::INTEGER - p - (da * bb - db * ab) / (aa * bb - ab * ab) * (len - ml)
                 - (db * aa - da * ab) / (aa * bb - ab * ab) * (week - mw) AS d,
               rating - my - (ay * bb - by_ * ab) / (aa * bb - ab * ab) * (len - ml)
                 - (by_ * aa - ay * ab) / (aa * bb - ab * ab) * (week - mw) AS y,
               ((len - ml) ** 2 * bb - 2 * (len - ml) * (week - mw) * ab
                 + (week - mw) ** 2 * aa) / (aa * bb - ab * ab) AS q
        FROM compared c JOIN sums s ON s.issue = c.issue""", ("sums",)),
    "slopes": ("""
        SELECT issue, sum(d * y) / sum(d * d) AS effect, sum(d * d) AS s
        FROM residual GROUP BY 1""", ("residual",)),
    "regression": (f"""
        SELECT issue AS issue_id, effect, se AS effect_se,
               effect - {Z_975} * se AS effect_low,
               effect + {Z_975} * se AS effect_high
        FROM (SELECT r.issue, any_value(effect) AS effect,
                sqrt(sum((d * (y - effect * d) / (1 - (1::DOUBLE / n + q + d * d / s))) ** 2))
                  / any_value(s) AS se
              FROM residual r JOIN slopes l ON l.issue = r.issue GROUP BY 1)""",
        ("slopes",)),
    "impact_raw": (f"""
        SELECT *, tq * se AS half,
          CASE WHEN n1 < {IMPACT.hard_floor} OR n2 < {IMPACT.hard_floor} THEN NULL
               ELSE least(1, {two_sided('greatest(z, 0)')}) END AS p_value,
          {two_sided('abs(effect / effect_se)')} AS effect_p
        FROM (SELECT w.*, r.z, {t_critical_real('w.dof', IMPACT.alpha)} AS tq,
                     g.effect, g.effect_se, g.effect_low, g.effect_high
              FROM welch w JOIN rank_test r USING (issue_id)
              JOIN regression g USING (issue_id))""", ("welch", "rank_test", "regression")),
    "impact": (f"""
        SELECT issue_id, issue_label, n1 AS sample_size, n2 AS non_issue_size,
          {py_round('mean1', 3)} AS average_issue_rating,
          {py_round('mean2', 3)} AS average_non_issue_rating,
          {py_round('overall', 3)} AS overall_rating,
          median1 AS median_issue_rating, median2 AS median_non_issue_rating,
          {py_round('diff', 3)} AS rating_difference,
          {py_round('low1', 3)} AS low_rating_share_issue,
          {py_round('low2', 3)} AS low_rating_share_non_issue,
          CASE WHEN p_value IS NULL THEN 'none' ELSE 'mann_whitney_u' END AS test_used,
          CASE WHEN p_value IS NULL THEN '{NO_TEST}' ELSE '{RANK_REASON}' END
            AS test_reasoning,
          {py_round('p_value', 5)} AS p_value,
          coalesce(p_value < {IMPACT.alpha}, false) AS significant,
          {py_round('(diff - half)', 3)} AS diff_ci_low,
          {py_round('(diff + half)', 3)} AS diff_ci_high,
          {py_round('effect', 3)} AS regression_effect,
          {py_round('effect_low', 3)} AS regression_ci_low,
          {py_round('effect_high', 3)} AS regression_ci_high,
          {py_round('effect_p', 5)} AS regression_p,
          n1 >= {IMPACT.min_sample} AS reliable,
          CASE WHEN n1 < {IMPACT.min_sample} THEN 'low'
               WHEN p_value < {IMPACT.alpha} AND (effect_low > 0 OR effect_high < 0)
                 THEN 'high'
               WHEN p_value < {IMPACT.alpha} OR effect_low > 0 OR effect_high < 0
                 THEN 'medium' ELSE 'low' END AS confidence_level,
          CASE WHEN n1 >= {IMPACT.min_sample} THEN
            'Reviews mentioning this issue are historically associated with approximately '
            || printf('%.1f', abs(effect)) || '-star '
            || CASE WHEN effect < 0 THEN 'lower' ELSE 'higher' END
            || ' ratings (association, not causation).'
          ELSE 'Too few observations for a reliable estimate; treat as indicative only.'
          END AS interpretation
        FROM impact_raw LEFT JOIN labels_of USING (issue_id)""", ("impact_raw", "labels_of")),
    # --- forecast
    "t_quantiles": (
        "SELECT * FROM (VALUES " + ", ".join(
            f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(t_table(FORECAST.alpha), 1))
        + ") t(df, tq)", ()),
    "indexed": ("""
        SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY date) - 1 AS x
        FROM trends_day""", ("trends_day",)),
    "fits": (f"""
        SELECT issue_id, n, slope, least(greatest(point, 0), 1) AS predicted,
               least(greatest(point - width, 0), 1) AS low,
               least(greatest(point + width, 0), 1) AS high
        FROM (SELECT *, icpt + slope * x0 AS point,
                tq * sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2))
                  * sqrt(1 + 1::DOUBLE / n + (x0 - mx) ** 2 / sxx) AS width
              FROM (SELECT issue_id, count(*) AS n, regr_slope(issue_share, x) AS slope,
                      regr_intercept(issue_share, x) AS icpt,
                      regr_sxx(issue_share, x) AS sxx, regr_syy(issue_share, x) AS syy,
                      avg(x) AS mx, count(*) - 1 + {FORECAST.horizon} AS x0
                    FROM indexed GROUP BY 1)
              JOIN t_quantiles ON df = n - 2)""", ("indexed", "t_quantiles")),
    "penalties": (f"""
        SELECT issue_id, issue_label,
               coalesce(CASE WHEN reliable THEN regression_effect END, rating_difference)
                 AS penalty,
               significant OR coalesce(regression_p < {FORECAST.alpha}, false) AS significant,
               reliable, low_rating_share_issue AS low_issue,
               low_rating_share_non_issue AS low_rest
        FROM impact""", ("impact",)),
    "snapshot": ("""
        SELECT t.issue_id, p.issue_label, p.penalty, p.significant, p.reliable, p.low_issue,
               p.low_rest, f.slope, f.predicted, f.low, f.high,
               t.issue_share AS current_share, t.growth_rate AS growth,
               t.anomaly_flag AS anomaly,
               (SELECT count(DISTINCT date) FROM trends_day) AS n_periods
        FROM trends_day t JOIN fits f USING (issue_id)
        LEFT JOIN penalties p USING (issue_id)
        WHERE t.date = (SELECT max(date) FROM trends_day)""", ("fits", "penalties")),
}


def _prediction(forecast: bool) -> str:
    """The risk table with or without enough history; all penalties are known there."""
    p, level = FORECAST, "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"
    has = "true" if forecast else "false"
    return f"""
      SELECT issue_id, issue_label, n_periods, 'next {p.horizon} days' AS horizon,
        {py_round('current_share', 4)} AS current_share,
        {py_round('growth', 4)} AS recent_growth, trend AS current_trend,
        {py_round('penalty', 3)} AS historical_rating_impact,
        {py_round('predicted', 4)} AS predicted_share,
        {py_round('harm', 3)} AS predicted_rating_impact,
        {py_round('b_low', 3)} AS lower_bound, {py_round('b_high', 3)} AS upper_bound,
        level AS risk_level,
        CASE WHEN NOT {has} THEN 'low' ELSE CASE reliable::INTEGER + significant::INTEGER + 1
          WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS confidence_level,
        CASE WHEN penalty >= 0 OR coalesce(harm >= 0, false) THEN 'no_negative_pressure'
          WHEN NOT {has} THEN 'current_burden'
          WHEN growth > 0 AND level IN ('HIGH', 'CRITICAL') THEN 'accelerating_rating_risk'
          WHEN level <> 'LOW' THEN 'elevated_rating_risk' ELSE 'low_rating_risk' END
          AS reason_code,
        CASE WHEN penalty >= 0 THEN
            printf('Issue share is %.1f%%', current_share * 100) || ' and ' || trend
            || '; it is historically associated with ' || printf('%+.2f', penalty)
            || '-star (non-negative) ratings, so it is not a rating-deterioration risk.'
          WHEN coalesce(harm >= 0, false) THEN
            printf('Issue share is %.1f%%', current_share * 100) || ' and ' || trend
            || printf(' (%+.0f%% recent growth); its projected impact over the ',
                      growth * 100)
            || 'next {p.horizon} days is not negative, so rating risk is low.'
          ELSE 'Risk is ' || level || ' because '
            || printf('issue share is %.1f%%', current_share * 100) || ' and ' || trend
            || CASE WHEN {has} THEN printf(' (%+.0f%% vs recent baseline)', growth * 100)
               ELSE '' END
            || '; it is historically associated with a ' || printf('%+.2f', penalty)
            || '-star rating change (' || CASE WHEN significant THEN '' ELSE 'not ' END
            || 'statistically significant)'
            || CASE WHEN low_issue >= low_rest + {p.disproportion_gap} THEN
                 '; it is disproportionately present in low-rated reviews ('
                 || printf('%.0f%%', low_issue * 100) || ' vs '
                 || printf('%.0f%%', low_rest * 100) || ')' ELSE '' END
            || CASE WHEN {has} THEN '; the projected impact over the next {p.horizon} days is '
                 || printf('%+.2f', harm) || ' stars'
               ELSE '; it currently accounts for an estimated ' || printf('%+.2f', burden)
                 || '-star drag on the overall rating; (too little history yet for a '
                 || 'forward forecast — based on the current snapshot)' END
            || '.' END AS explanation
      FROM (SELECT *, {level}[1 + CASE WHEN basis < 0 AND penalty < 0 THEN
              CASE WHEN anomaly AND growth > 0 AND backed > 0 THEN least(backed + 1, 3)
                   ELSE backed END ELSE 0 END] AS level
        FROM (SELECT *, CASE WHEN tier >= 2 AND NOT (reliable AND significant)
                             THEN tier - 1 ELSE tier END AS backed
          FROM (SELECT *, CASE WHEN abs(basis) >= {p.impact_critical} THEN 3
                  WHEN abs(basis) >= {p.impact_high} THEN 2
                  WHEN abs(basis) >= {p.impact_medium} THEN 1 ELSE 0 END AS tier
            FROM (SELECT * EXCLUDE (predicted),
                CASE WHEN {has} THEN predicted END AS predicted,
                CASE WHEN {has} THEN (predicted - current_share) * penalty END AS harm,
                CASE WHEN {has} THEN least((low - current_share) * penalty,
                  (high - current_share) * penalty) END AS b_low,
                CASE WHEN {has} THEN greatest((low - current_share) * penalty,
                  (high - current_share) * penalty) END AS b_high,
                current_share * penalty AS burden,
                CASE WHEN {has} THEN (predicted - current_share) * penalty
                  ELSE current_share * penalty END AS basis,
                CASE WHEN slope > {p.flat_slope} THEN 'rising'
                  WHEN slope < -{p.flat_slope} THEN 'falling' ELSE 'flat' END AS trend
              FROM snapshot))))"""


PARTS["prediction"] = (_prediction(True), ("snapshot",))
PARTS["burden_prediction"] = (_prediction(False), ("snapshot",))
PARTS["cutoffs"] = (f"""
    SELECT issue_id, date, x + 1 AS n, issue_share AS share,
           lead(issue_share, {FORECAST.horizon}) OVER w AS actual,
           regr_slope(issue_share, x) OVER past AS slope,
           avg(issue_share) OVER past AS mean_share,
           regr_syy(issue_share, x) OVER past AS syy, avg(x) OVER past AS mx,
           regr_sxx(issue_share, x) OVER past AS sxx
    FROM indexed
    WINDOW w AS (PARTITION BY issue_id ORDER BY date),
           past AS (PARTITION BY issue_id ORDER BY date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ("indexed",))
PARTS["windows"] = (f"""
    SELECT *, abs(predicted - actual) AS abs_error,
           sign(predicted - share) = sign(actual - share) AS hit,
           actual >= low AND actual <= high AS covered,
           abs((predicted - share) * penalty - (actual - share) * penalty) AS impact_error
    FROM (SELECT issue_id, date, n, share, actual,
            least(greatest(point, 0), 1) AS predicted,
            least(greatest(point - width, 0), 1) AS low,
            least(greatest(point + width, 0), 1) AS high, penalty
          FROM (SELECT c.*, p.penalty,
                  mean_share + slope * (n - 1 + {FORECAST.horizon} - mx) AS point,
                  tq * sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2)) * sqrt(
                    1 + 1::DOUBLE / n + (n - 1 + {FORECAST.horizon} - mx) ** 2 / sxx)
                    AS width
                FROM cutoffs c JOIN t_quantiles ON df = n - 2
                LEFT JOIN penalties p USING (issue_id)
                WHERE n >= {FORECAST.min_fit} AND actual IS NOT NULL))""",
    ("cutoffs", "t_quantiles", "penalties"))

_STOP = sorted({w.lower() for w in (
    *TEXT.stop_words, *TEXT.extra_stop_words, *APP_NAME.lower().split())})
PARTS["tokenized"] = (PARTS["tokenized"][0].replace("@STOP@", quoted(_STOP)), ("docs",))


def query(select: str, *needs: str) -> str:
    """A statement with the named parts it needs, each before its users."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in PARTS[name][1]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][0]})" for n in order)
    return f"WITH {ctes}\n{select}" if ctes else select


def rounded(columns: str, doubles: str, digits: int = 9) -> str:
    parts = [columns] if columns else []
    parts += [f"round({c}, {digits}) AS {c}" for c in doubles.split()]
    return ", ".join(parts)


_FLAGS = ("missing_text, invalid_rating, invalid_date, missing_platform, "
          "unknown_platform, missing_app_id, missing_review_id, duplicate_review_id")
_STANDARD = ("review_id, review_text, rating, review_date, source_platform, app_id, "
             "app_name, app_version, helpful_count")
_TREND_COLUMNS = rounded("issue_id, date, mention_count, anomaly_flag", (
    "issue_share average_rating negative_share wow_change rolling_baseline rolling_std "
    "deviation_score growth_rate"))

_GOOGLE = f"""
    SELECT 'ev_' || event_id AS review_id, event_type || ' ' || props AS review_text,
      CASE WHEN event_id % 40 = 0 OR event_id % 41 = 0 THEN NULL
           WHEN event_id % 42 = 0 THEN 4 ELSE {_HEX} END AS rating,
      CASE WHEN event_id % 43 = 0 THEN NULL
           WHEN event_id % 44 = 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
           ELSE date_trunc('second', ts) END AS review_date,
      'google_play' AS source_platform, '{APP_ID}' AS app_id, '{APP_NAME}' AS app_name,
      CASE WHEN event_id % 3 = 1 THEN '5.4.1' ELSE '5.0' END AS app_version,
      CAST(user_id % 20 AS INTEGER) AS helpful_count, event_id AS ingest_seq
    FROM events"""
_APPLE = f"""
    SELECT substr(sha1('app_store|{STORE_APP_ID}|'
        || CASE WHEN event_id % 17 <> 0 THEN 'user' || user_id ELSE 'None' END || '|'
        || CASE event_id % 7 WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
             WHEN 2 THEN strftime(ts, '%m/%d/%Y') WHEN 3 THEN strftime(ts, '%b %-d, %Y')
             WHEN 4 THEN strftime(ts, '%Y%m%d') WHEN 5 THEN strftime(ts, '%Y-13-%d')
             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
        || '|' || event_type || ' ' || props), 1, 16)
        AS review_id,
      event_type || ' ' || props AS review_text, {_HEX} AS rating,
      CASE WHEN event_id % 7 = 5 THEN NULL
           WHEN event_id % 7 IN (2, 3, 4) THEN date_trunc('day', ts)::TIMESTAMP
           ELSE date_trunc('second', ts) END AS review_date, 'app_store' AS source_platform,
      '{STORE_APP_ID}' AS app_id, '{APP_NAME}' AS app_name,
      CAST(NULL AS VARCHAR) AS app_version, CAST(NULL AS INTEGER) AS helpful_count,
      event_id AS ingest_seq
    FROM events"""
_WORDS = f"len(regexp_extract_all(cleaned_text, '{NOT_SPACE}+'))"

ORACLE_SQL: dict[str, str] = {
    "standardize_google_play": _GOOGLE,
    "standardize_app_store": _APPLE,
    "stacked_sources": f"""
        SELECT source_platform, app_id, rating, count(*) AS reviews,
               count(review_date) AS dated, count(app_version) AS versioned,
               count(DISTINCT review_id) AS ids,
               min(ingest_seq + before) AS first_seq, max(ingest_seq + before) AS last_seq
        FROM (SELECT *, CAST(0 AS BIGINT) AS before FROM ({_GOOGLE}) UNION ALL
              SELECT *, (SELECT max(event_id) + 1 FROM events) AS before FROM ({_APPLE}))
        GROUP BY 1, 2, 3""",
    "validate_flags": query(
        f"SELECT ingest_seq, review_id, {_FLAGS}, dropped FROM flagged", "flagged"),
    "validated_reviews": query(
        f"SELECT {_STANDARD}, ingest_seq FROM flagged WHERE NOT dropped", "flagged"),
    "validation_report": query(
        "SELECT count(*) AS total, "
        + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in _FLAGS.split(", "))
        + """, count(*) FILTER (dropped) AS dropped,
               count(*) FILTER (NOT dropped) AS clean,
               count(*) FILTER (NOT dropped AND NOT regexp_matches(review_text,
                 '[\\p{L}\\p{N}]')) AS empty_after_cleaning,
               count(*) FILTER (NOT dropped AND regexp_matches(review_text,
                 '[\\p{L}\\p{N}]')) AS cleaned_rows
           FROM flagged""", "flagged"),
    "clean_text": query(
        "SELECT review_id, cleaned_text, length(cleaned_text) AS review_length, "
        f"{_WORDS} AS word_count FROM docs", "docs"),
    "cleaned_features": query("""
        SELECT review_id, review_text, cleaned_text, rating,
          CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral'
               ELSE 'positive' END AS rating_bucket,
          review_date, review_date::DATE AS review_day,
          strftime(review_date, '%G-W%V') AS review_week,
          strftime(review_date, '%Y-%m') AS review_month,
          CAST(year(review_date) AS INTEGER) AS review_year,
          source_platform, app_id, app_name, app_version, helpful_count,
          length(cleaned_text) AS review_length,
          len(string_split(cleaned_text, ' ')) AS word_count
        FROM (SELECT *, lower(trim(review_text)) AS cleaned_text
              FROM flagged WHERE NOT dropped)""", "flagged"),
    "data_quality": query("""
        SELECT 'raw_reviews' AS "table", count(*) AS row_count,
          (SELECT count(*) FROM (SELECT review_id FROM dirty GROUP BY 1
             HAVING count(*) > 1)) AS duplicate_review_ids,
          count(*) FILTER (review_text IS NULL OR review_text = '') AS missing_text,
          count(*) FILTER (rating IS NULL) AS missing_rating,
          count(*) FILTER (rating < 1 OR rating > 5) AS invalid_rating,
          CAST(min(review_date) AS VARCHAR) AS date_min,
          CAST(max(review_date) AS VARCHAR) AS date_max
        FROM dirty""", "dirty"),
    "period_totals": query("SELECT * FROM totals_day", "totals_day"),
    "issue_period_agg": query(
        "SELECT " + rounded("issue_id, date, mention_count",
                            "average_rating negative_share") + " FROM stats_day",
        "stats_day"),
    "issue_trends_daily": query(f"SELECT {_TREND_COLUMNS} FROM trends_day", "trends_day"),
    "issue_trends_weekly": query(f"SELECT {_TREND_COLUMNS} FROM trends_week", "trends_week"),
    "streamed_issue_trends": query(
        f"SELECT {_TREND_COLUMNS} FROM trends_week", "trends_week"),
    "anomalies": query(
        f"SELECT {_TREND_COLUMNS} FROM trends_day WHERE anomaly_flag", "trends_day"),
    "issue_summary": query("SELECT * FROM summary", "summary"),
    "risk_scores": query("""
        SELECT issue_id, round(100 * blend, 9) AS risk_score,
               round(confidence, 9) AS confidence, round(growth_rate, 9) AS recent_growth,
               round(deviation_score, 9) AS deviation_score FROM scored""", "scored"),
    "impact_group_stats": query(
        "SELECT " + rounded("issue_id, n1, n2", "mean1 mean2 overall median1 median2 low1 "
                            "low2 var1 var2") + ", round(mean1 - mean2, 9) AS diff "
        "FROM groups", "groups"),
    "impact_welch_parts": query(
        "SELECT " + rounded("issue_id", "diff se dof", 6) + " FROM welch", "welch"),
    "impact_mann_whitney_z": query(
        "SELECT " + rounded("issue_id", "u1 sigma z", 6) + " FROM rank_test", "rank_test"),
    "impact_hc3": query(
        "SELECT " + rounded("issue_id", "effect effect_se effect_low effect_high")
        + " FROM regression", "regression"),
    "impact_table": query("SELECT * FROM impact", "impact"),
    "share_forecast": query(
        "SELECT " + rounded("issue_id, n", "slope predicted low high") + " FROM fits",
        "fits"),
    "penalty_choice": query("SELECT * FROM penalties", "penalties"),
    "rating_risk": query("SELECT * FROM prediction", "prediction"),
    "rating_risk_burden": query("SELECT * FROM burden_prediction", "burden_prediction"),
    "backtest_windows": query(
        "SELECT " + rounded("issue_id, date, n, hit, covered",
                            "share actual predicted low high penalty abs_error impact_error")
        + " FROM windows", "windows"),
    "backtest_report": query(f"""
        SELECT n AS n_backtests, {py_round('mae', 4)} AS share_mae,
          {py_round('hits', 3)} AS directional_accuracy,
          {py_round('cover', 3)} AS interval_coverage,
          {1 - FORECAST.alpha}::DOUBLE AS target_coverage,
          {py_round('impact_mae', 4)} AS rating_impact_mae,
          CASE WHEN n < 10
            THEN 'Small sample — treat metrics as indicative, not conclusive.'
            ELSE 'Linear share extrapolation; assumes recent trend persists over the '
                 || 'horizon.' END AS limitations,
          CAST(NULL AS VARCHAR) AS note
        FROM (SELECT count(*) AS n, avg(abs_error) AS mae, avg(hit::INTEGER) AS hits,
                avg(covered::INTEGER) AS cover, avg(impact_error) AS impact_mae
              FROM windows)""", "windows"),
    "warning_count": query("""
        SELECT count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS n_warnings
        FROM prediction""", "prediction"),
    "complaint_filter": query(f"""
        SELECT review_id, rating FROM docs WHERE rating <= {TEXT.max_issue_rating}
        AND {_WORDS} >= {TEXT.min_words}""", "docs"),
    "app_name_words": f"""
        SELECT DISTINCT unnest(string_split(lower('{APP_NAME}'), ' ')) AS token
        FROM documents""",
    "tokens": query("""
        SELECT review_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens
        FROM tokenized""", "tokenized"),
    "ngrams": query("""
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY 1""",
        "tf"),
    "vocabulary": query("SELECT term, df, round(idf, 9) AS idf FROM vocab", "vocab"),
    "tfidf_weights": query(
        "SELECT review_id, term, round(weight, 9) AS weight FROM weights", "weights"),
    "cluster_keywords": query(
        "SELECT cluster_id, rank, term, round(mean_weight, 9) AS mean_weight "
        "FROM top_terms", "top_terms"),
    "readable_labels": query(f"""
        SELECT cluster_id, array_to_string(kw, ', ') AS issue_keywords,
          upper(text[1]) || text[2:] AS issue_label,
          printf('issue_%02d', cluster_id) AS issue_id
        FROM (SELECT *, array_to_string(words, ' ')
                || CASE WHEN list_has_any(words, [{quoted(PROBLEM_WORDS)}]) THEN ''
                   ELSE ' problem' END AS text
          FROM (SELECT *, CASE WHEN len(two) > 0 THEN string_split(two[1], ' ')[:2]
                               ELSE kw[:2] END AS words
            FROM (SELECT cluster_id, list(term ORDER BY rank) AS kw,
                    list(term ORDER BY rank) FILTER (contains(term, ' ')) AS two
                  FROM top_terms GROUP BY 1)))""", "top_terms"),
    "representatives": query(f"""
        SELECT * FROM (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id
            ORDER BY round(coalesce(sim, 0), 12) DESC, review_id) AS rank, review_id
          FROM members LEFT JOIN (
            SELECT w.review_id, sum(w.weight * c.mean_weight) AS sim
            FROM weights w JOIN members m ON m.review_id = w.review_id
            JOIN centres c ON c.cluster_id = m.cluster_id AND c.term = w.term
            GROUP BY 1) USING (review_id)) WHERE rank <= {TEXT.n_representative}""",
        "centres"),
    "cluster_stats": query("""
        SELECT cluster_id, count(*) AS cluster_size,
               round(avg(rating), 9) AS cluster_avg_rating
        FROM members GROUP BY 1""", "members"),
    "monthly_rating": query("""
        SELECT review_month, round(rating, 9) AS rating, round(rating - lag(rating) OVER (
                 ORDER BY review_month), 9) AS delta
        FROM (SELECT strftime(day, '%Y-%m') AS review_month, avg(rating) AS rating
              FROM docs GROUP BY 1)""", "docs"),
    "kpis": query(f"""
        SELECT total_reviews, {py_round('mean', 2)} AS avg_rating,
          {py_round('delta', 2)} AS rating_trend_delta,
          {py_round('negative', 1)} AS negative_pct,
          (SELECT count(*) FROM prediction) AS n_issues,
          (SELECT count(*) FROM prediction WHERE risk_level <> 'LOW') AS n_emerging,
          (SELECT count(*) FROM prediction WHERE risk_level IN ('HIGH', 'CRITICAL'))
            AS n_high_risk
        FROM (SELECT count(*) AS total_reviews, avg(rating) AS mean,
                100 * (count(*) FILTER (rating <= 2) / count(*)) AS negative,
                (SELECT m - prev FROM (SELECT review_month, avg(rating) AS m,
                   lag(avg(rating)) OVER (ORDER BY review_month) AS prev
                   FROM reviews GROUP BY 1) ORDER BY review_month DESC LIMIT 1) AS delta
              FROM reviews)""", "prediction"),
    "warning_ranked": query("""
        SELECT issue_id, issue_label, risk_level, predicted_rating_impact
        FROM prediction""", "prediction"),
    "top_warnings": query("""
        SELECT issue_id, risk_level FROM prediction ORDER BY
          list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], risk_level),
          coalesce(predicted_rating_impact, 0), issue_id LIMIT 4""", "prediction"),
    "risk_level_filter": query("""
        SELECT issue_id, risk_level FROM prediction
        WHERE risk_level IN ('LOW', 'MEDIUM')""", "prediction"),
    "evidence_topk": query("""
        SELECT issue_id, rank, review_date, rating, source_platform, review_text
        FROM (SELECT *, row_number() OVER (PARTITION BY issue_id
                ORDER BY rating, review_length DESC, review_id) AS rank
              FROM assigned JOIN reviews USING (review_id)) WHERE rank <= 8""", "assigned"),
    "evidence_one_issue": query("""
        SELECT review_date, rating, source_platform, review_text
        FROM assigned JOIN reviews USING (review_id) WHERE issue_id = 'issue_error'
        ORDER BY rating, review_length DESC, review_id LIMIT 8""", "assigned"),
    "impact_long": query("""
        SELECT issue_id, coalesce(issue_label, issue_id) AS issue,
               'when issue present' AS "group", average_issue_rating AS rating FROM impact
        UNION ALL
        SELECT issue_id, coalesce(issue_label, issue_id), 'when absent',
               average_non_issue_rating FROM impact""", "impact"),
    "regression_bars": query("""
        SELECT issue_id, coalesce(issue_label, issue_id) AS issue, regression_effect,
               round(regression_ci_high - regression_effect, 9) AS plus,
               round(regression_effect - regression_ci_low, 9) AS minus
        FROM impact WHERE regression_effect IS NOT NULL""", "impact"),
    "impact_display": query("""
        SELECT issue_id, printf('%+.2f', predicted_rating_impact) || '★' AS impact_text,
               'forecast' AS basis FROM prediction""", "prediction"),
    "display_table": query("""
        SELECT issue_id, coalesce(issue_label, issue_id) AS issue, risk_level AS risk,
          confidence_level AS confidence,
          round(current_share * 100, 9) AS current_share_pct,
          round(recent_growth * 100, 9) AS growth_pct,
          historical_rating_impact AS historical_impact,
          predicted_rating_impact AS predicted_impact,
          lower_bound AS ci_low, upper_bound AS ci_high,
          printf('%.1f%%', current_share * 100) AS share_text,
          printf('%+.2f', historical_rating_impact) || '★' AS impact_text
        FROM prediction""", "prediction"),
    "issue_gloss": query("""
        SELECT issue_id, 'Grouped from **' || sample_size || ' complaint reviews**, '
          || 'averaging **' || printf('%.1f', average_issue_rating) || '★**, **'
          || printf('%.0f', low_rating_share_issue * 100) || '%** of them rated 1–2★. '
          || 'Users most often mention: *' || issue_id[7:] || '*, *' || issue_label || '*.'
          AS gloss
        FROM impact""", "impact"),
    "as_of_date": query("SELECT max(date) AS as_of_date FROM totals_day", "totals_day"),
}
# A stream ends with the table that one batch of its rows gives.
ORACLE_SQL["streamed_reviews"] = ORACLE_SQL["cleaned_features"]
for _name in ("impact_table", "rating_risk", "warning_count", "risk_level_filter"):
    ORACLE_SQL[f"{_name}_tiers"] = ORACLE_SQL[_name].replace(_ISSUE_CASE, _TIER_CASE)
ORACLE_SQL["impact_table_tiers"] = (
    f"SELECT * EXCLUDE (diff_ci_low, diff_ci_high) FROM ({ORACLE_SQL['impact_table_tiers']})")
