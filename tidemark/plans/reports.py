"""Reports as Markdown: every table in them is a query over the operators, collected at report size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import fixed
from tidemark.operators import coverage, integrity
from tidemark.sources.tables import markdown


def _document(title: str, parts: list[tuple[str, DataFrame]]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df)}" for name, df in parts)]) + "\n"


def fetch_report(articles: DataFrame, ticker: str, ts: str = "timestamp_utc") -> str:
    """Span, active days and gap; spread of a day's count; months."""
    days = coverage.daily_counts(articles, ts)
    return _document(f"Coverage of {ticker}", [("Span", coverage.coverage_summary(days)), ("Articles a day", coverage.describe(days, "articles")), ("Months", coverage.monthly(days).orderBy("month"))])


def cross_report(articles: DataFrame, by: str = "ticker", ts: str = "timestamp_utc") -> str:
    """Coverage of all tickers side by side, and whether their heavy months coincide."""
    days = coverage.daily_counts(articles, ts, by)
    peaks = coverage.peak_months(coverage.monthly(days, by), by)
    return _document("Coverage by ticker", [("Span", coverage.coverage_summary(days, by).orderBy(by)), ("Heaviest months", peaks.orderBy(by, "rank")), ("Shared months", coverage.shared_peaks(peaks, by).orderBy("month"))])


def market_report(final: DataFrame, ticker: str, n_articles: int) -> str:
    months = coverage.monthly_balance(final, "timestamp_utc")
    by_session = final.groupBy("session").agg(F.count("*").alias("rows"), *[F.count_if(F.col("label_direction") == v).alias(n) for v, n in ((1, "up"), (-1, "down"), (0, "flat"))]).orderBy("session")
    kept = final.agg(F.lit(n_articles).alias("articles"), F.count("*").alias("labelled"))
    return _document(f"Market features of {ticker}", [("Rows", kept), ("Label balance", coverage.label_balance(final)), ("Months", months.orderBy("month")), ("Extreme months", coverage.balance_extremes(months)), ("Sessions", by_session), ("Columns", coverage.column_profile(final))])


def merge_report(text: DataFrame, markets: DataFrame, merged: DataFrame, checks: DataFrame, tested: DataFrame, pooled: DataFrame, ticker: str) -> str:
    score = "fus_conf_graft_floor_mean"
    parts = [
        ("Join", integrity.merge_accounting(text, markets)),
        ("Checks", checks.withColumn("offenders", F.array_join("offenders", ", "))),
        ("Leakage", integrity.leakage_summary(tested)),
        ("Leakage by session", integrity.leakage_by_session(tested).orderBy("session")),
        ("Dropped by month", coverage.dropped_by_month(text, merged, "article_id", "timestamp_utc").orderBy("month")),
        ("Overlap", integrity.overlap_summary(pooled).where(F.col("ticker") == ticker).orderBy(F.desc("shared_articles"))),
    ]
    if score in merged.columns:
        parts.append(("Score and return", coverage.pearson(merged, score, "abnormal_return_1d")))
    return _document(f"Merge of {ticker}", parts)


def feature_dictionary(final: DataFrame, descriptions: dict[str, str]) -> str:
    """Columns with type, coverage, mean, deviation and description."""
    words = final.sparkSession.createDataFrame(list(descriptions.items()) or [("", "")], "column string, description string")
    return _document("Feature dictionary", [("Columns", coverage.column_profile(final).join(F.broadcast(words), "column", "left"))])


def model_card(metadata: dict, metrics: DataFrame) -> str:
    head = "\n".join(f"- {k}: {v}" for k, v in sorted(metadata.items()) if k != "features")
    listed = ", ".join(metadata["features"])
    return f"# Model card\n\n{head}\n- features: {listed}\n\n## Folds\n\n{markdown(metrics)}\n\nSessions: {', '.join(fixed.SESSIONS)}\n"
