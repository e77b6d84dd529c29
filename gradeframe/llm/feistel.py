"""Reproducible shuffle into shards by a Feistel permutation.

Every row has a global row number.  A balanced Feistel network permutes the
smallest domain of 4**k numbers that holds all rows; a value at or beyond the
row count is permuted again until it falls inside (cycle walking), so the
result is a permutation of 0..n-1.  Position p goes to shard ``p mod shards``
at slot ``p div shards``: shard sizes differ by one row at most, slots have no
gaps, and both can be computed (and inverted) from the row number alone.

Null, empty and repeated texts are rows like any other; equal rows take
neighbouring row numbers; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common, rownum

ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:8], "big") for r in range(rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permute(x, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 at ``x`` (its inverse with ``back``)."""
    keys, bits = round_keys(seed), _half_bits(n)
    with np.errstate(over="ignore"):
        out = _network(np.asarray(x, dtype=np.uint64), bits, keys, back)
        while len(far := np.flatnonzero(out >= np.uint64(n))):
            out[far] = _network(out[far], bits, keys, back)
    return out.astype(np.int64)


def locate(row_no: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row number, without touching the data."""
    p = int(permute([row_no], n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that sits at a slot of a shard."""
    return int(permute([slot * shards + shard], n, seed, back=True)[0])


def assign(df: DataFrame, n: int, shards: int, seed: int, row_no: str = "row_no") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that carry their number."""
    @F.pandas_udf(LongType())
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(np.int64), n, seed))

    return (df.withColumn("_p", place(row_no))
            .withColumn("shard", (F.col("_p") % shards).cast("int"))
            .withColumn("slot", F.expr(f"_p div {shards}")).drop("_p"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard and slot of every document.

    Only (doc_id, size, checksum) leaves the scan; that narrow table is
    checkpointed, counted and numbered in the order of its md5 key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = common.checkpoint(narrow.withColumn("_key", rownum.order_key(F.col("doc_id"), F.col("size"), F.col("text_crc32"))))
    numbered = rownum.number_rows(narrow, "_key", ["doc_id", "size", "text_crc32"])
    return assign(numbered, narrow.count(), shards, seed).drop("_key")


def op10_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards; the law is ``rows``."""
    placed = shard_documents(common.read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_no")
