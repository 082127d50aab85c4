"""The encrypted vault: AES-GCM cells, insert-if-absent, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_from_hex(hex_key: str) -> Column:
    """A 32-byte key; callers take it from their secret store."""
    if len(bytes.fromhex(hex_key)) != 32:
        raise ValueError("the vault key must have 32 bytes")
    return F.unhex(F.lit(hex_key))


def encrypt(value: Column, key: Column) -> Column:
    """AES-256-GCM with a random IV: IV, ciphertext and tag in one binary."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(cell: Column, key: Column) -> Column:
    """The value, or '' when the cell was altered or the key is wrong."""
    return F.coalesce(F.try_aes_decrypt(cell, key, F.lit("GCM")).cast("string"), F.lit(""))


def insert_new(vault: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("conv_id", "placeholder")) -> DataFrame:
    """Entries to append: the first per key among those the vault does not hold yet.

    ``entries`` carry ``ord``, their order of arrival.
    """
    rest = [col for col in entries.columns if col not in keys]
    first = entries.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("e")).select(*keys, "e.*")
    return first.join(vault.select(*keys), list(keys), "left_anti")


def erase(table: DataFrame, erased: DataFrame, key: str) -> DataFrame:
    """What is left of a table after erasing the listed keys."""
    return table.join(erased.select(key), key, "left_anti")
