"""Fixtures as literal sequences."""

from datetime import datetime, timedelta

REVIEW_DDL = "review_id string, review_date timestamp_ntz, rating int, review_length bigint"
ASSIGNED_DDL = "review_id string, issue_id string, issue_label string"


def standard(spark, rows):
    """Standard reviews from partial records, numbered in list order."""
    from tidewatch.schemas import STANDARD, SEQ
    from tidewatch.sources.native import to_standard

    names = [n for n in STANDARD.fieldNames() if n != SEQ]
    texts = [tuple(None if r.get(n) is None else str(r[n]) for n in names) + (i,)
             for i, r in enumerate(rows)]
    ddl = ", ".join(f"{n} string" for n in names) + f", {SEQ} bigint"
    return to_standard(spark.createDataFrame(texts, ddl))


def review(**changes):
    base = dict(review_id="r", review_text="some text here", rating=3,
                review_date="2026-08-01", source_platform="google_play", app_id="a")
    return {**base, **changes}


def weekly(spark, counts, ratings, start=datetime(2026, 6, 1), lengths=None):
    """Reviews and assignments: issue -> mentions per week, ratings taken in turn."""
    reviews, assigned = [], []
    for issue, per_week in counts.items():
        turn = 0
        for week, n in enumerate(per_week):
            for _ in range(n):
                rid = f"{issue}_{turn}"
                choices = ratings[issue]
                reviews.append((rid, start + timedelta(days=7 * week),
                                choices[turn % len(choices)],
                                (lengths or {}).get(issue, 40) + turn % 7))
                assigned.append((rid, issue, f"{issue} label"))
                turn += 1
    return (spark.createDataFrame(reviews, REVIEW_DDL),
            spark.createDataFrame(assigned, ASSIGNED_DDL))


def rows(df, key=None):
    out = [r.asDict(recursive=True) for r in df.collect()]
    return {r[key]: r for r in out} if key else out
