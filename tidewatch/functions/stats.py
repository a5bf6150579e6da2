"""Statistics over groups, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.themes import mean_correlation


def quantile(value: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation; ``q`` outside 0 to 1 counts as the nearer end."""
    return F.percentile(value, F.lit(min(1.0, max(0.0, q))))


def winsorized(rows: DataFrame, value: str, group: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Rows with ``value`` brought inside its group's quantiles; nulls stay."""
    bounds = rows.groupBy(*group).agg(quantile(value, low).alias("__low"), quantile(value, high).alias("__high"))
    inside = F.when(F.col(value).isNotNull(), F.greatest("__low", F.least("__high", F.col(value))))
    return rows.join(bounds, group).withColumn(value, inside).drop("__low", "__high")


def mean_pairwise_correlation(rows: DataFrame, group: list[str], member: str, order: str, value: str) -> DataFrame:
    """(group..., n_series, mean_r): mean correlation of all pairs of members' series, aligned from their ends; linear in
    the rows. A member's series in a group is one array, so groups hold stretches of bounded length."""
    series = rows.where(F.col(value).isNotNull()).groupBy(*group, member).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("__values"))
    return mean_correlation(series, group, "__values", least=2)
