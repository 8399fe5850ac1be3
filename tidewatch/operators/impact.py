"""Historical association of every issue with ratings.

Each issue is compared with all other reviews, unassigned ones included. Nothing is
computed per issue over the reviews: reviews collapse once into cells
(issue, rating, length, week, count), and group statistics, tests and regressions are
arithmetic on cells. The complement of an issue is the total minus its own numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.functions.exprs import add, pick, quoted, ratio, sql
from tidewatch.functions.rounding import fixed, round_columns
from tidewatch.operators.trends import issue_labels
from tidewatch.params import ImpactParams
from tidewatch.plans.lineage import cut_lineage
from tidewatch.schemas import IMPACT

RATINGS = (1, 2, 3, 4, 5)
_CELL_SALTS = 32
# Share of a sum of squares below which a regressor counts as explained by the others.
_SINGULAR = 1e-12

IMPACT_DIGITS = {
    "average_issue_rating": 3, "average_non_issue_rating": 3, "overall_rating": 3,
    "rating_difference": 3, "low_rating_share_issue": 3, "low_rating_share_non_issue": 3,
    "p_value": 5, "diff_ci_low": 3, "diff_ci_high": 3, "regression_effect": 3,
    "regression_ci_low": 3, "regression_ci_high": 3, "regression_p": 5,
}

# Texts of the results.
NO_TEST = "sample too small for a meaningful test"
WELCH_REASON = ("large samples, normality not rejected -> Welch's t-test "
                "(unequal variance)")
RANK_REASON = ("ordinal 1-5 ratings / non-normal or moderate n -> "
               "Mann-Whitney U (rank-based)")


def rating_cells(cleaned: DataFrame, assignments: DataFrame) -> DataFrame:
    """Review counts per (issue_id, rating, review_length, week).

    Weeks are whole weeks since the first review, time of day included. `issue_id` is
    NULL for unassigned reviews. Assignments hold one row per review.
    """
    if "review_length" in cleaned.columns:
        length = "coalesce(review_length, 0)"
    elif "cleaned_text" in cleaned.columns:
        length = "coalesce(length(cleaned_text), 0)"
    else:
        length = "0"
    return sql(
        f"""
        WITH reviews AS (
          SELECT review_id, CAST(rating AS INT) AS rating,
                 CAST({length} AS BIGINT) AS review_length,
                 CAST(coalesce(floor(extract(DAY FROM review_date - (
                   SELECT min(review_date) FROM {{cleaned}})) / 7), 0) AS BIGINT) AS week
          FROM {{cleaned}} WHERE rating IS NOT NULL)
        SELECT issue_id, rating, review_length, week, count(*) AS n
        FROM reviews LEFT JOIN (SELECT review_id, issue_id FROM {{assignments}})
        USING (review_id)
        GROUP BY issue_id, rating, review_length, week""",
        cleaned=cleaned, assignments=assignments)


def _kth(prefix: str, k: str) -> str:
    """k-th smallest rating of a histogram."""
    steps = (f"WHEN {' + '.join(f'{prefix}{u}' for u in RATINGS[:i + 1])} >= {k} THEN {v}.0D"
             for i, v in enumerate(RATINGS))
    return f"CASE {' '.join(steps)} END"


def _median(prefix: str, n: str) -> str:
    low, high = _kth(prefix, f"floor(({n} + 1) / 2)"), _kth(prefix, f"floor({n} / 2) + 1")
    return f"({low} + {high}) / 2"


def _weighted(prefix: str, weight) -> str:
    return " + ".join(f"{weight(v)} * {prefix}{v}" for v in RATINGS)


def group_stats(cells: DataFrame, params: ImpactParams = ImpactParams()) -> DataFrame:
    """Sizes, means, medians, low-rating shares and variances: issue against the rest.

    Sums are exact integers; `g` carries the totals over all reviews.
    """
    wide = "CAST(n AS DECIMAL(38,0))"
    sums = {f"c{v}": f"sum(if(rating = {v}, n, 0))" for v in RATINGS} | {
        "l": f"sum({wide} * review_length)",
        "w": f"sum({wide} * week)",
        "ll": f"sum({wide} * (CAST(review_length AS DECIMAL(19,0)) * review_length))",
        "ww": f"sum({wide} * (CAST(week AS DECIMAL(19,0)) * week))",
        "lw": f"sum({wide} * (CAST(review_length AS DECIMAL(19,0)) * week))",
        "ly": f"sum({wide} * review_length * rating)",
        "wy": f"sum({wide} * week * rating)",
    }
    columns = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    totals = ", ".join(f"'{n}', sum({n})" for n in sums)
    df = sql(
        f"""
        WITH moments AS (SELECT issue_id, {columns} FROM {{cells}} GROUP BY issue_id)
        SELECT *, (SELECT named_struct({totals}) FROM moments) AS g
        FROM moments WHERE issue_id IS NOT NULL""", cells=cells)
    df = add(df, **{f"o{v}": f"g.c{v} - c{v}" for v in RATINGS})
    low = [v for v in RATINGS if v <= params.low_rating]
    df = add(
        df,
        n1=_weighted("c", lambda v: 1), n2=_weighted("o", lambda v: 1),
        y1=f"CAST({_weighted('c', lambda v: v)} AS DOUBLE)",
        y2=f"CAST({_weighted('o', lambda v: v)} AS DOUBLE)",
        q1=f"CAST({_weighted('c', lambda v: v * v)} AS DOUBLE)",
        q2=f"CAST({_weighted('o', lambda v: v * v)} AS DOUBLE)",
        below1=" + ".join(f"c{v}" for v in low) or "0",
        below2=" + ".join(f"o{v}" for v in low) or "0",
    )

    def variance(n: str, y: str, q: str) -> str:
        d = f"CAST({n} AS DOUBLE)"
        return f"CASE WHEN {n} >= 2 THEN {ratio(f'{d} * {q} - {y} * {y}', f'{d} * ({d} - 1)')} END"

    return add(
        df,
        mean1="y1 / n1", mean2=ratio("y2", "CAST(n2 AS DOUBLE)"),
        overall="(y1 + y2) / (n1 + n2)",
        median1=_median("c", "n1"), median2=f"CASE WHEN n2 > 0 THEN {_median('o', 'n2')} END",
        low1="below1 / n1", low2=ratio("below2", "CAST(n2 AS DOUBLE)"),
        var1=variance("n1", "y1", "q1"), var2=variance("n2", "y2", "q2"),
        diff=f"y1 / n1 - {ratio('y2', 'CAST(n2 AS DOUBLE)')}",
    )


def welch_parts(df: DataFrame) -> DataFrame:
    """Standard error and Satterthwaite degrees of freedom of the mean difference."""
    df = add(df, v1="CASE WHEN n1 >= 2 AND n2 >= 2 THEN var1 / n1 END",
             v2="CASE WHEN n1 >= 2 AND n2 >= 2 THEN var2 / n2 END")
    return add(
        df, se="sqrt(v1 + v2)",
        dof=ratio("(v1 + v2) * (v1 + v2)",
                  f"({ratio('v1 * v1', 'n1 - 1.0D')} + {ratio('v2 * v2', 'n2 - 1.0D')})"))


def rank_parts(df: DataFrame) -> DataFrame:
    """Mann-Whitney U of the issue and its tie- and continuity-corrected z."""
    wins, below = [], "0.0D"
    for v in RATINGS:
        wins.append(f"c{v} * ({below} + o{v} / 2.0D)")
        below = f"{below} + o{v}"
    both = {v: f"CAST(c{v} + o{v} AS DOUBLE)" for v in RATINGS}
    ties = " + ".join(f"({t} * {t} * {t} - {t})" for t in both.values())
    df = add(df, u1=" + ".join(wins), ties=ties,
             pairs="CAST(n1 AS DOUBLE) * n2", total="CAST(n1 + n2 AS DOUBLE)")
    spread = f"sqrt(pairs / 12 * ((total + 1) - {ratio('ties', '(total * (total - 1))')}))"
    df = add(df, sigma=f"CASE WHEN pairs > 0 THEN {spread} END")
    return add(df, z=ratio("greatest(u1, pairs - u1) - pairs / 2 - 0.5D", "sigma"))


def with_tails(df: DataFrame, params: ImpactParams = ImpactParams()) -> DataFrame:
    """Add all tail probabilities and the t quantile, in one Python pass over the issues.

    Normality is tested from the five counts of a group, whatever its size.
    """
    p = params
    testable = f"least(n1, n2) >= {p.normal_min_n}"
    inputs = {f"{c}{v}": f"CASE WHEN {testable} THEN {c}{v} END"
              for c in "co" for v in RATINGS}
    inputs |= {"t": ratio("diff", "se"), "dof": "CASE WHEN se > 0 THEN dof END", "z": "z",
               "effect_z": ratio("effect", "effect_se")}
    fields = ", ".join(f"'{n}', {e}" for n, e in inputs.items())
    df = add(df, tail_inputs=f"named_struct({fields})")
    df = df.withColumn("tails", stats.tails(p.alpha)(F.col("tail_inputs")))
    # Missing probabilities come back as NaN.
    return add(df, **{n: f"nanvl(tails.{n}, CAST(NULL AS DOUBLE))" for n in stats.TAILS})


def choose_test(df: DataFrame, params: ImpactParams = ImpactParams()) -> DataFrame:
    """`test_used`, `test_reasoning` and `p_value` of the group comparison."""
    p = params
    df = add(df, enough=f"least(n1, n2) >= {p.hard_floor}",
             normal=f"coalesce(normal1 > {p.alpha}D AND normal2 > {p.alpha}D, false)")
    # A rank test without z has no spread: all ratings are equal.
    return add(
        df,
        test_used="CASE WHEN NOT enough THEN 'none' WHEN normal THEN 'welch_t' "
                  "ELSE 'mann_whitney_u' END",
        test_reasoning=f"CASE WHEN NOT enough THEN {quoted(NO_TEST)} WHEN normal "
                       f"THEN {quoted(WELCH_REASON)} ELSE {quoted(RANK_REASON)} END",
        p_value="CASE WHEN NOT enough THEN NULL WHEN normal THEN p_t "
                "ELSE coalesce(p_rank, 1.0D) END")


# --- regression: rating ~ issue + review length + week, HC3 standard errors ----------

def _cross(xy: str, x: str, y: str) -> str:
    """Centred sum of products from exact integer sums; one rounding at the end."""
    return (f"CAST(CAST(total_n AS DECIMAL(38,0)) * {xy} - "
            f"CAST({x} AS DECIMAL(38,0)) * {y} AS DOUBLE) / total_n")


def _solve(x: str, y: str) -> tuple[str, str]:
    """Coefficients of length and week for right-hand sides (x, y)."""
    first = (f"CASE kind WHEN 'both' THEN ({x} * bb - {y} * ab) / det "
             f"WHEN 'length' THEN {x} / aa ELSE 0.0D END")
    second = (f"CASE kind WHEN 'both' THEN ({y} * aa - {x} * ab) / det "
              f"WHEN 'week' THEN {y} / bb ELSE 0.0D END")
    return first, second


def regression_coefficients(df: DataFrame, params: ImpactParams = ImpactParams()) -> DataFrame:
    """Adjusted effect of each issue by partialling out length and week.

    A constant control is left out; of two collinear controls only the length stays.
    The effect is NULL for fewer than `min_regression_rows` reviews, for an issue that
    covers every review and for one that the controls determine.
    """
    df = add(df, total_n="n1 + n2", total_y="CAST(y1 + y2 AS DECIMAL(38,0))",
             own_y="CAST(y1 AS DECIMAL(38,0))")
    df = add(
        df,
        aa=_cross("g.ll", "g.l", "g.l"), bb=_cross("g.ww", "g.w", "g.w"),
        ab=_cross("g.lw", "g.l", "g.w"),
        ay=_cross("g.ly", "g.l", "total_y"), by=_cross("g.wy", "g.w", "total_y"),
        da=_cross("l", "n1", "g.l"), db=_cross("w", "n1", "g.w"),
        dy=_cross("own_y", "n1", "total_y"),
        mean_l="CAST(g.l AS DOUBLE) / total_n", mean_w="CAST(g.w AS DOUBLE) / total_n",
        mean_y="CAST(total_y AS DOUBLE) / total_n",
        p="CAST(n1 AS DOUBLE) / total_n", own_ss="CAST(n1 AS DOUBLE) * n2 / total_n",
    )
    df = add(df, det="aa * bb - ab * ab",
             kind=f"CASE WHEN aa > 0 AND bb > 0 AND aa * bb - ab * ab > {_SINGULAR}D * aa * bb "
                  "THEN 'both' WHEN aa > 0 THEN 'length' WHEN bb > 0 THEN 'week' "
                  "ELSE 'none' END")
    ga, gb = _solve("da", "db")
    alpha_a, alpha_b = _solve("ay", "by")
    df = add(df, ga=ga, gb=gb, alpha_a=alpha_a, alpha_b=alpha_b)
    df = add(df, s="own_ss - ga * da - gb * db")
    return add(df, effect=f"CASE WHEN total_n >= {params.min_regression_rows} AND n2 > 0 "
                          f"AND s > {_SINGULAR}D * own_ss "
                          "THEN (dy - ga * ay - gb * by) / s END")


_COEFFICIENTS = ("total_n", "mean_l", "mean_w", "mean_y", "aa", "bb", "ab", "det", "kind",
                 "ga", "gb", "alpha_a", "alpha_b", "p", "s", "effect")


def robust_variance(cells: DataFrame, fits: DataFrame,
                    params: ImpactParams = ImpactParams()) -> DataFrame:
    """HC3 variance of each issue's effect: (issue_id, effect_variance).

    Every regression needs every cell once, which is the number of issues times the
    number of cells and independent of the number of reviews. Fits are packed into
    arrays of about `issue_chunk` issues; cells meet each array through an equi-join
    that is salted, so it stays balanced when Spark does not broadcast the arrays.
    """
    coefficients = ", ".join(_COEFFICIENTS)
    fields = ", ".join(f"f.{c} AS {c}" for c in _COEFFICIENTS)
    return sql(
        f"""
        WITH chunks AS (
          SELECT CAST(greatest(ceil(count(*) / {params.issue_chunk}), 1) AS INT) AS k
          FROM {{fits}} WHERE effect IS NOT NULL),
        packed AS (
          SELECT chunk, collect_list(f) AS fits FROM (
            SELECT CAST(pmod(xxhash64(issue_id), (SELECT k FROM chunks)) AS INT) AS chunk,
                   struct(issue_id AS fit_issue, {coefficients}) AS f
            FROM {{fits}} WHERE effect IS NOT NULL)
          GROUP BY chunk),
        salted_fits AS (
          SELECT *, explode(sequence(0, {_CELL_SALTS - 1})) AS salt FROM packed),
        salted_cells AS (
          SELECT *, explode(sequence(0, (SELECT k FROM chunks) - 1)) AS chunk,
                 CAST(pmod(xxhash64(rating, review_length, week), {_CELL_SALTS}) AS INT)
                   AS salt
          FROM {{cells}}),
        pairs AS (
          SELECT issue_id, rating, review_length, week, n, explode(fits) AS f
          FROM salted_cells JOIN salted_fits USING (chunk, salt)),
        centred AS (
          SELECT f.fit_issue AS fit_issue, n, rating,
                 CAST(coalesce(issue_id = f.fit_issue, false) AS INT) AS own,
                 review_length - f.mean_l AS a, week - f.mean_w AS b, {fields}
          FROM pairs),
        residuals AS (
          SELECT *, own - p - ga * a - gb * b AS d,
                 rating - mean_y - alpha_a * a - alpha_b * b AS y,
                 CASE kind
                   WHEN 'both' THEN (a * a * bb - 2 * a * b * ab + b * b * aa) / det
                   WHEN 'length' THEN a * a / aa WHEN 'week' THEN b * b / bb
                   ELSE 0.0D END AS controls
          FROM centred),
        leverage AS (
          SELECT *, 1 - (1.0D / total_n + controls + d * d / s) AS room FROM residuals),
        terms AS (
          SELECT fit_issue, s, n, d * (y - effect * d)
                   / CASE WHEN room > {_SINGULAR}D THEN room END AS t
          FROM leverage),
        sums AS (
          SELECT fit_issue, max(s) AS s, sum(n * t * t) AS meat,
                 count_if(t IS NULL) AS undefined
          FROM terms GROUP BY fit_issue)
        -- A review with leverage 1 leaves no HC3 estimate.
        SELECT fit_issue AS issue_id,
               CASE WHEN undefined = 0 THEN meat / (s * s) END AS effect_variance
        FROM sums""", cells=cells, fits=fits)


def regress(cells: DataFrame, groups: DataFrame,
            params: ImpactParams = ImpactParams()) -> DataFrame:
    """Group rows with `effect`, its standard error and its interval.

    The fits are one row per issue and are read several times, so they are written once.
    """
    fits = cut_lineage(regression_coefficients(groups, params))
    z = stats.normal_quantile(1 - params.alpha / 2)
    out = fits.join(robust_variance(cells, fits, params), "issue_id", "left")
    out = add(out, effect_se="sqrt(effect_variance)")
    # Without a standard error there is no estimate to report.
    keep = [c for c in out.columns if c != "effect"]
    out = pick(out, *keep, effect="CASE WHEN effect_se IS NOT NULL THEN effect END")
    return add(out, effect_low=f"effect - {z!r}D * effect_se",
               effect_high=f"effect + {z!r}D * effect_se")


def interpretation() -> str:
    # The texts.
    return (
        "CASE WHEN reliable AND effect IS NOT NULL THEN concat('Reviews mentioning this "
        "issue are historically associated with approximately ', "
        f"{fixed('abs(effect)', 1)}, '-star ', "
        "CASE WHEN effect < 0 THEN 'lower' ELSE 'higher' END, "
        "' ratings (association, not causation).') ELSE 'Too few observations for a "
        "reliable estimate; treat as indicative only.' END")


def compute_issue_impact(cleaned: DataFrame, assignments: DataFrame,
                         params: ImpactParams = ImpactParams(),
                         rounded: bool = True) -> DataFrame:
    """One row per issue: group comparison, test, regression and reliability.

    Reviews are read once; their cells are written and everything else starts there.
    """
    p = params
    cells = cut_lineage(rating_cells(cleaned, assignments))
    df = regress(cells, group_stats(cells, p), p)
    df = choose_test(with_tails(rank_parts(welch_parts(df)), p), p)
    df = add(
        df,
        half="coalesce(t_value * se, se)",
        # A perfect fit has no spread left: any effect at all is certain.
        effect_p="coalesce(effect_tail, CASE WHEN effect_se = 0 AND effect <> 0 THEN 0.0D END)",
        significant=f"coalesce(p_value < {p.alpha}D, false)",
        clear="coalesce(effect_low > 0 OR effect_high < 0, false)",
        reliable=f"n1 >= {p.min_sample}",
    ).join(issue_labels(assignments), "issue_id", "left")
    out = pick(
        df, "issue_id", "issue_label",
        sample_size="n1", non_issue_size="n2",
        average_issue_rating="mean1", average_non_issue_rating="mean2",
        overall_rating="overall",
        median_issue_rating="median1", median_non_issue_rating="median2",
        rating_difference="diff",
        low_rating_share_issue="low1", low_rating_share_non_issue="low2",
        test_used="test_used", test_reasoning="test_reasoning", p_value="p_value",
        significant="significant",
        diff_ci_low="diff - half", diff_ci_high="diff + half",
        regression_effect="effect", regression_ci_low="effect_low",
        regression_ci_high="effect_high", regression_p="effect_p",
        reliable="reliable",
        confidence_level="CASE WHEN NOT reliable THEN 'low' "
                         "WHEN significant AND clear THEN 'high' "
                         "WHEN significant OR clear THEN 'medium' ELSE 'low' END",
        interpretation=interpretation(),
    )
    if rounded:
        out = round_columns(out, IMPACT_DIGITS)
    return (out.select(*IMPACT.fieldNames())
            .orderBy(F.asc_nulls_last("rating_difference"), "issue_id"))
