"""Forward-looking rating risk from issue shares and historical impact, with backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import add, array_of, pick, quoted, ratio, sql
from tidewatch.functions.rounding import percent, round_columns, signed, signed_percent
from tidewatch.functions.stats import t_critical
from tidewatch.operators.risk import clip01
from tidewatch.operators.trends import UNITS
from tidewatch.params import ForecastParams
from tidewatch.schemas import PREDICTION

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

PREDICTION_DIGITS = {
    "current_share": 4, "recent_growth": 4, "historical_rating_impact": 3,
    "predicted_share": 4, "predicted_rating_impact": 3, "lower_bound": 3,
    "upper_bound": 3,
}


def horizon_text(p: ForecastParams) -> str:
    return f"next {p.horizon} {UNITS.get(p.freq, 'periods')}"


_SERIES = "OVER (PARTITION BY issue_id ORDER BY date)"
_SO_FAR = ("OVER (PARTITION BY issue_id ORDER BY date "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
# Least-squares sums of the share on its position x = 0, 1, ..., n - 1.
_FIT = {"n": "count(issue_share)", "slope": "regr_slope(issue_share, x)",
        "mean_share": "avg(issue_share)", "syy": "regr_syy(issue_share, x)"}


def _numbered(trends: DataFrame) -> DataFrame:
    return add(trends, x=f"CAST(row_number() {_SERIES} - 1 AS DOUBLE)")


def _with_forecast(df: DataFrame, p: ForecastParams) -> DataFrame:
    """Add the line's value `horizon` steps ahead and its prediction interval.

    The moments of the position are closed forms of n.
    """
    df = add(df, sxx="n * (CAST(n AS DOUBLE) * n - 1) / 12.0D",
             ahead=f"n - 1 + {p.horizon} - (n - 1) / 2.0D")
    df = add(
        df,
        point="mean_share + slope * ahead",
        width=f"{t_critical('(n - 2)', p.alpha)} * sqrt("
              f"{ratio('greatest(syy - slope * slope * sxx, 0.0D)', 'n - 2.0D')}) "
              f"* sqrt(1 + 1.0D / n + {ratio('ahead * ahead', 'sxx')})")

    def clipped(x: str) -> str:
        return f"CASE WHEN n >= {p.min_fit} THEN {clip01(x)} END"

    return add(df, predicted=clipped("point"), low=clipped("point - width"),
               high=clipped("point + width"))


def forecast_share(trends: DataFrame,
                   params: ForecastParams = ForecastParams()) -> DataFrame:
    """Share of every issue `horizon` periods ahead with its prediction interval.

    Columns: issue_id, n, slope, predicted, low, high. The forecast is NULL below
    `min_fit` points. Needs issue_id, date and issue_share.
    """
    fits = sql(f"SELECT issue_id, {_columns(_FIT)} FROM {{rows}} GROUP BY issue_id",
               rows=_numbered(trends))
    return _with_forecast(fits, params).select(
        "issue_id", "n", "slope", "predicted", "low", "high")


def _columns(formulas: dict[str, str], over: str = "") -> str:
    return ", ".join(f"{e} {over} AS {n}" for n, e in formulas.items())


def penalties(impact: DataFrame, params: ForecastParams = ForecastParams()) -> DataFrame:
    """Rating change per mention and the strength of its evidence, per issue.

    The adjusted effect counts when the issue is reliable, else the plain difference.
    """
    return pick(
        impact, "issue_id", "issue_label",
        penalty="coalesce(CASE WHEN reliable THEN regression_effect END, rating_difference)",
        significant="coalesce(significant, false) "
                    f"OR coalesce(regression_p < {params.alpha}D, false)",
        reliable="coalesce(reliable, false)",
        low_issue="low_rating_share_issue", low_rest="low_rating_share_non_issue",
    )


def risk_tier(p: ForecastParams) -> dict[str, str]:
    """Steps to the tier number 0 to 3, from the size of a harmful impact.

    Weak evidence costs the two top tiers one step; an active spike then adds one step
    to any tier above LOW. Only issues tied to lower ratings are risks at all.
    """
    return {
        "base_tier": f"CASE WHEN abs(basis) >= {p.impact_critical}D THEN 3 "
                     f"WHEN abs(basis) >= {p.impact_high}D THEN 2 "
                     f"WHEN abs(basis) >= {p.impact_medium}D THEN 1 ELSE 0 END",
        "backed_tier": "CASE WHEN base_tier >= 2 AND NOT (reliable AND significant) "
                       "THEN base_tier - 1 ELSE base_tier END",
        "tier": "CASE WHEN basis < 0 AND penalty < 0 THEN "
                "CASE WHEN anomaly AND recent_growth > 0 AND backed_tier > 0 "
                "THEN least(backed_tier + 1, 3) ELSE backed_tier END ELSE 0 END",
    }


def level_rank(column: str = "risk_level") -> str:
    """0 for LOW up to 3 for CRITICAL; 0 for anything else."""
    return (f"CASE {column} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 "
            "WHEN 'MEDIUM' THEN 1 ELSE 0 END")


def _explanation(horizon: str, p: ForecastParams) -> dict[str, str]:
    """Reason code and text; `lead` is the shared beginning without its first letter.

    Fixed values: the codes and the wording of the texts.
    """
    lead = f"concat('ssue share is ', {percent('current_share', 1)}, ' and ', current_trend)"
    growth = signed_percent("recent_growth", 0)
    unknown = ("concat('I', lead, ', but there is no reliable historical rating "
               "association to assess.')")
    benign = (f"concat('I', lead, '; it is historically associated with ', "
              f"{signed('penalty', 2)}, '-star (non-negative) ratings, so it is not a "
              "rating-deterioration risk.')")
    easing = (f"concat('I', lead, ' (', {growth}, ' recent growth); its projected impact "
              f"over the {horizon} is not negative, so rating risk is low.')")
    clauses = f"""concat_ws('; ',
        concat('i', lead, CASE WHEN has_forecast
               THEN concat(' (', {growth}, ' vs recent baseline)') ELSE '' END),
        concat('it is historically associated with a ', {signed('penalty', 2)},
               '-star rating change (', CASE WHEN significant
               THEN 'statistically significant' ELSE 'not statistically significant' END,
               ')'),
        CASE WHEN low_issue >= low_rest + {p.disproportion_gap}D
             THEN concat('it is disproportionately present in low-rated reviews (',
                         {percent('low_issue', 0)}, ' vs ', {percent('low_rest', 0)}, ')')
             END,
        CASE WHEN has_forecast
             THEN concat('the projected impact over the {horizon} is ',
                         {signed('predicted_rating_impact', 2)}, ' stars') END,
        CASE WHEN NOT has_forecast
             THEN concat('it currently accounts for an estimated ', {signed('burden', 2)},
                         '-star drag on the overall rating') END,
        CASE WHEN NOT has_forecast
             THEN '(too little history yet for a forward forecast — based on the current snapshot)'
             END)"""
    easy = "has_forecast AND predicted_rating_impact >= 0"
    return {
        "lead": lead,
        "reason_code": f"""CASE WHEN penalty IS NULL THEN 'no_historical_impact'
            WHEN penalty >= 0 OR ({easy}) THEN 'no_negative_pressure'
            WHEN NOT has_forecast THEN 'current_burden'
            WHEN recent_growth > 0 AND tier >= 2 THEN 'accelerating_rating_risk'
            WHEN tier >= 1 THEN 'elevated_rating_risk' ELSE 'low_rating_risk' END""",
        "explanation": f"""CASE WHEN penalty IS NULL THEN {unknown}
            WHEN penalty >= 0 THEN {benign} WHEN {easy} THEN {easing}
            ELSE concat('Risk is ', risk_level, ' because ', {clauses}, '.') END""",
    }


def predict_rating_risk(trends: DataFrame, impact: DataFrame,
                        params: ForecastParams = ForecastParams(),
                        rounded: bool = True) -> DataFrame:
    """One explained risk row per issue, worst first.

    `trends` is the dense grid, so every issue has one row per observed period. One
    aggregation per issue gives both the fit and the last row.
    """
    p = params
    fits = sql(
        f"""
        SELECT issue_id, {_columns(_FIT)},
               max(struct(date, issue_share, growth_rate, anomaly_flag)) AS last,
               (SELECT count(DISTINCT date) FROM {{trends}}) AS n_periods
        FROM {{rows}} GROUP BY issue_id""", rows=_numbered(trends), trends=trends)
    df = _with_forecast(fits, p).join(penalties(impact, p), "issue_id", "left")
    enough = f"n_periods >= {p.min_history}"
    df = pick(
        df, "issue_id", "issue_label", "n_periods", "penalty", "low_issue", "low_rest",
        "predicted", "low", "high",
        current_share="last.issue_share", recent_growth="last.growth_rate",
        anomaly="last.anomaly_flag",
        fitted=f"{enough} AND predicted IS NOT NULL",
        has_forecast=f"{enough} AND predicted IS NOT NULL AND penalty IS NOT NULL",
        significant="coalesce(significant, false)", reliable="coalesce(reliable, false)",
        slope="coalesce(slope, 0.0D)", burden="last.issue_share * penalty",
    )

    def effect(share: str) -> str:
        return f"({share} - current_share) * penalty"

    def forecast_only(x: str) -> str:
        return f"CASE WHEN has_forecast THEN {x} END"

    low, high = effect("low"), effect("high")
    df = add(
        df,
        current_trend=f"CASE WHEN slope > {p.flat_slope}D THEN 'rising' "
                      f"WHEN slope < -{p.flat_slope}D THEN 'falling' ELSE 'flat' END",
        predicted_share=forecast_only("predicted"),
        predicted_rating_impact=forecast_only(effect("predicted")),
        lower_bound=forecast_only(f"least({low}, {high})"),
        upper_bound=forecast_only(f"greatest({low}, {high})"),
        basis=f"CASE WHEN has_forecast THEN {effect('predicted')} ELSE burden END",
        votes=f"CAST(reliable AS INT) + CAST(significant AS INT) + CAST({enough} AS INT)",
    )
    for name, formula in risk_tier(p).items():
        df = add(df, **{name: formula})
    horizon = horizon_text(p)
    df = add(
        df,
        horizon=quoted(horizon), historical_rating_impact="penalty",
        risk_level=f"element_at({array_of(LEVELS)}, tier + 1)",
        confidence_level="CASE WHEN NOT fitted THEN 'low' WHEN votes = 3 THEN 'high' "
                         "WHEN votes = 2 THEN 'medium' ELSE 'low' END",
    )
    texts = _explanation(horizon, p)
    df = add(df, lead=texts.pop("lead"))
    out = add(df, **texts).select(*PREDICTION.fieldNames())
    if rounded:
        out = round_columns(out, PREDICTION_DIGITS)
    return out.orderBy(
        F.expr(level_rank()).desc(),
        F.asc_nulls_last("predicted_rating_impact"),
        F.asc_nulls_last("historical_rating_impact"), "issue_id")


# --- backtest ------------------------------------------------------------------------

def backtest_windows(trends: DataFrame, impact: DataFrame | None = None,
                     params: ForecastParams = ForecastParams()) -> DataFrame:
    """One row per issue and past cut-off: forecast against what then happened.

    Every fit uses a cumulative window frame, so one sort per issue serves all
    cut-offs; the outcome is the share `horizon` rows later.
    """
    p = params
    fits = sql(
        f"""
        SELECT issue_id, date, issue_share AS share, {_columns(_FIT, _SO_FAR)},
               lead(issue_share, {p.horizon}) {_SERIES} AS actual
        FROM {{rows}}""", rows=_numbered(trends))
    rows = _with_forecast(fits, p).filter(
        f"n >= {p.min_fit} AND actual IS NOT NULL").select(
        "issue_id", "date", "n", "share", "actual", "predicted", "low", "high")
    if impact is None:
        rows = add(rows, penalty="CAST(NULL AS DOUBLE)")
    else:
        rows = rows.join(penalties(impact, p).select("issue_id", "penalty"),
                         "issue_id", "left")
    return add(
        rows,
        abs_error="abs(predicted - actual)",
        hit="signum(predicted - share) = signum(actual - share)",
        covered="actual BETWEEN low AND high",
        impact_error="abs((predicted - share) * penalty - (actual - share) * penalty)",
    )


def backtest(trends: DataFrame, impact: DataFrame | None = None,
             params: ForecastParams = ForecastParams(), rounded: bool = True) -> DataFrame:
    """One row of forecast quality over all windows; only a note when there are none."""
    out = sql(
        f"""
        SELECT *,
          CASE WHEN n_backtests > 0 THEN {1 - params.alpha!r}D END AS target_coverage,
          CASE WHEN n_backtests = 0 THEN NULL WHEN n_backtests < 10
            THEN 'Small sample — treat metrics as indicative, not conclusive.'
            ELSE 'Linear share extrapolation; assumes recent trend persists over the horizon.'
            END AS limitations,
          CASE WHEN n_backtests = 0
            THEN 'Insufficient history for backtesting; need more periods.' END AS note
        FROM (
          SELECT count(*) AS n_backtests, avg(abs_error) AS share_mae,
                 avg(CAST(hit AS DOUBLE)) AS directional_accuracy,
                 avg(CAST(covered AS DOUBLE)) AS interval_coverage,
                 avg(impact_error) AS rating_impact_mae
          FROM {{windows}})""", windows=backtest_windows(trends, impact, params))
    if rounded:
        out = round_columns(out, {
            "share_mae": 4, "directional_accuracy": 3, "interval_coverage": 3,
            "target_coverage": 3, "rating_impact_mae": 4})
    return out.select("n_backtests", "share_mae", "directional_accuracy",
                      "interval_coverage", "target_coverage", "rating_impact_mae",
                      "limitations", "note")


def warning_count(prediction: DataFrame) -> DataFrame:
    return prediction.selectExpr(
        "count_if(risk_level IN ('HIGH', 'CRITICAL')) AS n_warnings")
