"""Fields of JSON whose types vary from tool to tool, as VARIANT expressions: every spelling is accepted, what is missing is nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def text(v: Column, key: str) -> Column:
    """A string that isn't empty when trimmed; null for other types."""
    t = F.trim(_text(v, key))
    return F.when((_kind(v, key) == "STRING") & (t != ""), t)


def number(v: Column, key: str) -> Column:
    """A whole number from 0, or a string that spells one; else 0."""
    n = F.trim(_text(v, key)).try_cast("bigint")
    whole = F.trim(_text(v, key)).rlike("^[+]?[0-9]+$")
    return F.coalesce(F.when(whole, n), F.lit(0).cast("bigint"))


def flag(v: Column, key: str) -> Column:
    """true, 1, "1", "true" or "True"."""
    return F.coalesce(F.trim(_text(v, key)).isin("1", "true", "True"), F.lit(False))
