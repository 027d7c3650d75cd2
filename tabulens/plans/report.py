"""The whole profile of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import numeric_columns, q
from tabulens.operators import categorical, correlation, distribution, kpi, narrative, predict, profile, tables, timeseries


def full_report(df: DataFrame, approx: bool = False, order_by: str | None = None, predicted: str | bool = False) -> dict[str, DataFrame]:
    """Every section that applies, by name.

    Times are found, values counted and quantiles computed when the report is made; all sections that need quantiles
    share them. The other sections are computed when they are used. ``order_by``: a numeric or time column
    along which sparklines run (default: the first time column). ``predicted``: the target of a baseline
    prediction, True for an automatic one; a table that allows none has the reason in its place.
    """
    df, times = timeseries.convert_time_columns(df)
    numbers = numeric_columns(df)
    report = {
        "summary": narrative.dataset_summary(df),
        "types": profile.column_types(df, approx),
        "missing": profile.missing_table(df),
        "missing_comment": narrative.missing_comment(df),
        "kpis": kpi.key_figures(df),
        "gauges": kpi.gauges(df),
        "head": tables.head(df),
        "top_values": categorical.top_values(df),
        "frequencies": categorical.frequency_tables(df),
        "category_samples": categorical.category_samples(df),
        "modes": categorical.mode_share(df),
    }
    if numbers:
        found = profile.quartiles(df, numbers, approx)
        report |= {
            "statistics": profile.numeric_stats(df, numbers, approx, found),
            "five_numbers": distribution.five_numbers(df, numbers, approx, found),
            "distributions": distribution.describe_distribution(df, numbers, approx, found),
            "distribution_comments": narrative.distribution_comments(df, numbers, approx, found),
            "outliers": distribution.iqr_outliers(df, numbers, approx=approx, found=found),
            "histograms": distribution.histogram(df, numbers),
            "histograms_auto": distribution.histogram(df, numbers, "fd", approx, found),
            "density": distribution.density(df, numbers[0]),
            "variance": correlation.top_variance(df),
            "correlation": correlation.correlation(df, digits=2),
        }
    for c in times[:1]:
        report["trend"] = timeseries.trend_count(df, c)
        if numbers:
            key = F.struct(*[q(x) for x in (c, *numbers)])
            points = [timeseries.trend_points(df, c, v, key).select(F.lit(v).alias("column"), "time", F.col("value").cast("double").alias("value")) for v in numbers[:2]]
            report["trend_points"] = points[0] if len(points) == 1 else points[0].union(points[1])
            report["trend_comments"] = narrative.trend_comments(df, numbers[:2])
    along = order_by or next(iter(times), None)
    if along:
        lines = [timeseries.sparkline(df, c, along).select(F.lit(c).alias("column"), "bucket", "mean") for c in numbers[:3] if c != along]
        for line in lines:
            report["sparklines"] = report["sparklines"].union(line) if "sparklines" in report else line
    if predicted:
        try:
            found = predict.predict(df, None if predicted is True else predicted)
            report |= {"prediction": found.metrics, "importances": found.importances}
        except ValueError as reason:
            report["prediction"] = df.sparkSession.createDataFrame([(str(reason),)], "reason string")
    return report
