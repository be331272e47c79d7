"""Folds and bounded samples by hashes of the id: the same rows on every run and cluster; names that do not clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows at most: all, or those whose hashed id lies under the fraction that this leaves."""
    n = rows.count()
    if n <= most:
        return rows
    cut = most * (1 << 32) // n
    return rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 32)) < cut)


def clear_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores at its end until no column of ``taken`` is called so, whatever the case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def clear_prefix(prefix: str, taken: list[str]) -> str:
    """``prefix``, with underscores before it until no column of ``taken`` begins so, whatever the case."""
    while any(c.lower().startswith(prefix.lower()) for c in taken):
        prefix = f"_{prefix}"
    return prefix
