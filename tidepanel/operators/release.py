"""Point-in-time corrections: when a value was known, and what an insider's text says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The day of the next month on which a monthly series counts as published.
MONTHLY_DAY = {"FEDFUNDS": 3, "UNRATE": 8, "CPIAUCSL": 15}
#: The direction of each transaction type.
DIRECTION = {"PURCHASE": "BUY", "SALE": "SELL"}


def business_day(day: Column) -> Column:
    """day, or the Monday after it if it lies on a weekend."""
    k = F.weekday(day)
    return F.date_add(day, F.when(k >= 5, 7 - k).otherwise(0))


def correct_release_dates(df: DataFrame) -> DataFrame:
    """df (series, date, ...) with release_date: monthly series in the next month on their day, others a day later, never on a weekend."""
    day = F.coalesce(*(F.when(F.col("series") == s, d) for s, d in MONTHLY_DAY.items()))
    monthly = business_day(F.date_add(F.add_months("date", 1), day - 1))
    return df.withColumn("release_date", F.when(day.isNotNull(), monthly).otherwise(business_day(F.date_add("date", 1))))


def transaction_type(text: Column) -> Column:
    """The type of an insider's transaction; the first rule that holds decides."""
    t = F.lower(F.trim(text))
    has = lambda *words: F.coalesce(*(F.when(t.contains(w), True) for w in words), F.lit(False))
    rules = F.when(t.startswith("sale"), "SALE").when(t.startswith("purchase"), "PURCHASE").when(has("award", "grant"), "GRANT")
    return rules.when(has("gift"), "GIFT").when(has("exercise", "conversion"), "EXERCISE").otherwise("UNKNOWN")


def enrich_insider(df: DataFrame) -> DataFrame:
    """df (text, ...) with txn_type and direction; a type that is neither a purchase nor a sale is neutral."""
    named = df.withColumn("txn_type", transaction_type(F.col("text")))
    return named.withColumn("direction", F.coalesce(*(F.when(F.col("txn_type") == k, v) for k, v in DIRECTION.items()), F.lit("NEUTRAL")))
