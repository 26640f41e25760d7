"""Text expressions for reports and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def title(name: Column) -> Column:
    """``is_fraud`` -> ``Is Fraud``"""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def joined_or(items: Column, separator: str, otherwise: str) -> Column:
    """Array joined into text, or a word for an empty one."""
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0,
                  F.array_join(items, separator)).otherwise(F.lit(otherwise))


def gather(order: Column, text: Column) -> Column:
    """Aggregate: texts of a group as an array in a given order, NULLs left out."""
    pairs = F.sort_array(
        F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("at"), text.alias("text"))))
    )
    return F.transform(pairs, lambda p: p["text"])


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the file name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
