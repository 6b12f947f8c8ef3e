"""Patch numbers such as 16.9 and 16.18, which order by their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_key(patch: Column) -> Column:
    return F.split(patch, "[.]").cast("array<int>")


def patch_of(version: Column, deduced: Column) -> Column:
    """The first two parts of a game version, else the deduced patch."""
    parts = F.concat(F.split_part(version, F.lit("."), F.lit(1)), F.lit("."), F.split_part(version, F.lit("."), F.lit(2)))
    return F.coalesce(F.nullif(parts, F.lit(".")), deduced)
