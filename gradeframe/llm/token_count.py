"""Token counts by a map-side two-tier lookup.

A text's token count is the sum over its pre-tokens, because no piece of the
vocabulary holds a word-start mark after another character or a line break
(checked when the model is loaded): no merge crosses those borders.

Tier 1 is a broadcast hash table with the lengths of the most frequent
pre-tokens.  Tier 2 is a cache in each Python worker: pre-tokens that the
table lacks are encoded by the library once and kept, up to a bound.  Neither
tier changes a count; they only save encodings.  Pre-tokens are never
shuffled: the frequent ones come from one bounded summary per input
partition (lossy counting over all its texts), merged pairwise-wide in a tree
of fixed fan-in, so no task reads more than ``FAN_IN`` summaries.

A null or empty text has no bytes and no tokens; every input row gives one
output row, repeated rows included; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
TABLE_SIZE = 32_768        # entries of the broadcast table
SUMMARY_SIZE = 4_096       # entries of one partition's summary
COUNTER_BOUND = 200_000    # entries a task holds while it counts
CACHE_BOUND = 200_000      # entries of a worker's cache
FAN_IN = 32                # summaries merged by one task

MARK = "▁"
PRE_TOKEN = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizer, after the check that pre-token borders are safe."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if len(piece) > 1 and ("\n" in piece or MARK in piece.lstrip(MARK)):
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
    return sp


def pre_tokens(text: str) -> list[str]:
    """The pieces between borders, after the library's word-start mark."""
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def encoded_lengths(path: str, tokens: list[str]) -> list[int]:
    """Tokens of each pre-token by the library.  It puts a mark before every
    input: a leading mark is left to it, and before other pre-tokens a line
    break keeps the mark apart, which adds two tokens."""
    sp = _library(path)
    inputs = [t[1:] if t[0] == MARK and len(t) > 1 else "\n" + t for t in tokens]
    ids = sp.encode(inputs, num_threads=1)
    return [len(x) - (0 if t[0] == MARK and len(t) > 1 else 2) for t, x in zip(tokens, ids)]


def _summarise(text: str):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in common.text_blocks(batch, text):
                for t in texts:
                    counts.update(pre_tokens(t))
                    if len(counts) > COUNTER_BOUND:
                        counts = Counter(dict(_top(counts, COUNTER_BOUND // 4)))
        if counts:
            yield _as_batch(TaskContext.get().partitionId(), _top(counts, SUMMARY_SIZE))
    return run


def _top(counts: dict, n: int) -> list[tuple[str, int]]:
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


def _as_batch(part: int, top: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": [part], "tokens": [[t for t, _ in top]], "counts": [[c for _, c in top]]},
        schema=pa.schema([("part", pa.int64()), ("tokens", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))


SUMMARY = "part long, tokens array<string>, counts array<long>"


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for tokens, counts in zip(table.column("tokens").to_pylist(), table.column("counts").to_pylist()):
            total.update(dict(zip(tokens, counts)))
        return pa.Table.from_batches([_as_batch(table.column("part")[0].as_py() // FAN_IN, _top(total, size))])
    return run


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """The tier-1 table: lengths of about the ``size`` most frequent pre-tokens
    of all texts.  The driver gets one row of at most ``size`` entries."""
    parts = max(1, docs.rdd.getNumPartitions())
    summaries = docs.select(F.col(text).alias("text")).mapInArrow(_summarise("text"), SUMMARY)
    while parts > 1:
        # each round leaves 1/FAN_IN of the summaries, one per group of neighbours
        summaries = (summaries.groupBy(F.floor(F.col("part") / FAN_IN).alias("_g"))
                     .applyInArrow(_merge(size), SUMMARY))
        parts = -(-parts // FAN_IN)
    row = summaries.select("tokens").head()
    tokens = list(row["tokens"])[:size] if row else []
    return dict(zip(tokens, encoded_lengths(path, tokens))) if tokens else {}


_WORKER: dict = {}


def _count(path: str, table, columns: list[str]):
    def run(batches):
        tier1 = table.value
        cache = _WORKER.setdefault(path, {})
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in common.text_blocks(batch, "_text"):
                split = [pre_tokens(t) for t in texts]
                if len(cache) > CACHE_BOUND:
                    cache.clear()
                missing = sorted({t for ts in split for t in ts} - tier1.keys() - cache.keys())
                cache.update(zip(missing, encoded_lengths(path, missing)) if missing else ())
                known = _Tiers(tier1, cache)
                n_tokens += [sum(map(known.length, ts)) for ts in split]
                n_bytes += [len(t.encode("utf-8")) for t in texts]
            keep = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=[*columns, "n_bytes", "n_tokens"])
    return run


class _Tiers:
    """Tier 1, then the worker's cache."""

    def __init__(self, tier1: dict, cache: dict):
        self.first, self.second = tier1.get, cache.get

    def length(self, token: str) -> int:
        n = self.first(token)
        return self.second(token) if n is None else n


def count_tokens(docs: DataFrame, path: str, ids: list[str], text: str = "text") -> DataFrame:
    """``ids`` columns, n_bytes and n_tokens of every row of ``docs``."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text))
    rows = docs.select(*ids, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*ids).schema.fields),
                        "n_bytes long", "n_tokens long"])
    return rows.mapInArrow(_count(path, table, ids), schema)


def op5_two_tier_counts(spark, sf_dir: str, limit: int = 4096) -> DataFrame:
    counted = count_tokens(common.read(spark, sf_dir, "documents"), common.tokenizer_path(MODEL), ["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
