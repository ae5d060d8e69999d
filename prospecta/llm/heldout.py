"""The split by document id that trained operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def bounded_sample(rows: DataFrame, bound: int, id_col: str = "doc_id") -> DataFrame:
    """About ``bound`` rows of ``rows`` at most, chosen by a hash of the id: the same rows in any partitioning."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 32)) < int(bound / total * (1 << 32)))
