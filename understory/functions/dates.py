"""Date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# First and last year of the altimeter period.
GEDI_YEARS = (2019, 2022)


def month_ranges(years: DataFrame, year: str) -> DataFrame:
    """Twelve half-open month intervals of every year."""
    months = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    start = F.make_date(F.col(year), F.col("month"), F.lit(1))
    return months.select(year, "month", start.alias("start_date"), F.add_months(start, 1).alias("end_date"))


def gedi_period(start: str, end: str) -> tuple[Column, Column]:
    """The altimeter period between two month-days."""
    return tuple(F.to_date(F.lit(f"{y}-{md}")) for y, md in zip(GEDI_YEARS, (start, end)))
