"""Deterministic order and identity from SHA-256, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = 20260821


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def stable_hash(namespace: str, *parts: Column, seed: int = SEED) -> Column:
    """First 16 hex digits of sha256("seed:namespace:part:.."); sorts as the unsigned number does."""
    return F.substring(sha256_hex(F.concat_ws(":", F.lit(f"{seed}:{namespace}"), *(p.cast("string") for p in parts))), 1, 16)


def hash_number(namespace: str, *parts: Column, seed: int = SEED) -> Column:
    """The first 8 hex digits as a number: for shares and picks."""
    return F.conv(F.substring(stable_hash(namespace, *parts, seed=seed), 1, 8), 16, 10).cast("bigint")


def content_hash(text: Column) -> Column:
    """Identity of a text by content."""
    return sha256_hex(text)


def ordered_hash(order: Column, value: Column) -> Column:
    """Aggregate: sha256 over value + newline in order. For groups that fit a row, such as id lists of a panel."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("string").alias("v"))))
    return sha256_hex(F.concat(F.array_join(F.transform(rows, lambda r: r["v"]), "\n"), F.lit("\n")))
