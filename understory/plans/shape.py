"""Small helpers that give query results one stable shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def round_half_away(c: Column, digits: int) -> Column:
    """Rounded on the binary value, as DuckDB does. Spark's ``round`` goes by the shortest decimal form, so exact halves of
    that form, frequent among shares and medians of decimals, could come out one last digit apart."""
    scale = 10.0 ** digits
    scaled = F.round(c * scale)
    return F.when(F.abs(scaled) < float("inf"), scaled / scale).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column and cast it to double."""
    return df.select(*[
        round_half_away(F.col(n).cast("double"), digits).alias(n) if t in ("double", "float") else F.col(n)
        for n, t in df.dtypes])
