"""A caller's columns carried as one struct, so that none can clash with those that an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns (all, if none are named) of df in one struct, by position: their names may be any."""
    return F.struct(F.lit(0).alias("c"), *[df[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(df.columns if columns is None else columns)])


def unpacked(columns: list[str], row: str = "row") -> list[Column]:
    """The columns that packed() took, under their names."""
    return [F.col(row)[f"c{k}"].alias(c) for k, c in enumerate(columns)]


def schema_of(df: DataFrame, added: str) -> T.StructType:
    """The schema of df's columns and of those that a DDL string names."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
