"""What the operators of this subpackage share: input tables and the shared work folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.storage import exists, remove, stored, work_dir

#: White space of the contracts, as characters and inside a regular-expression class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"

__all__ = ["SPACE", "SPACE_CLASS", "carried", "exists", "remove", "stored", "table", "text_or_empty", "work_dir"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def carried(keep: tuple[str, ...], own: tuple[str, ...] | list[str]) -> list[Column]:
    """The columns ``keep``; one whose name an operator needs for itself comes out with ``_in`` behind it."""
    out, taken = [], {n.lower() for n in own}
    for name in keep:
        new = name
        while new.lower() in taken:
            new += "_in"
        taken.add(new.lower())
        out.append(F.col(f"`{name}`").alias(new))
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
