"""Quality rules: hashed n-gram log-likelihood ratio of two corpora.

The n-grams are pairs of neighbouring characters of a text's words, word
borders included, dealt to ``BUCKETS`` hash buckets.  (Word n-grams were tried
first: with few labels their counts are too thin, clean and junk texts
overlap; character pairs part them at every size of the given tables.)  Two
multinomials over the buckets are learned: one from all documents (raw), one
from trusted documents, a bounded sample of the rows labelled good
(``TRUSTED_ROWS`` rows of the smallest md5), smoothed by ``PRIOR`` n-grams of
the raw shares.  A document's score is the mean over its n-grams of the log of
the ratio of the two, in units of 1/``UNIT``; the weights are whole numbers,
so a score does not depend on the order of sums.  A document is kept when its
score reaches ``THRESHOLD``: nothing is ranked or sampled, its verdict depends
on its text and the two models alone.

Base rules come first: a text of fewer than 20 words, or with over 30 % of its
words inside repeated 8-word windows, fails whatever its score.

A null text has no words, hence fails; every input row gives one row, repeated
rows included; labels with nulls or of unknown documents count for nothing;
without trusted rows all weights are 0 and the base rules decide alone.  An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 16_381           # prime
TRUSTED_ROWS = 20_000      # bound of the labelled sample
PRIOR = 2_000              # n-grams' worth of raw shares in the trusted model
UNIT = 1 << 16
THRESHOLD = -0.3           # mean log ratio
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8").split()


def char_pairs(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every pair of neighbouring characters of each
    document's words, set one space apart and between two spaces."""
    lined = [(b" " + b" ".join(ws) + b" ").decode("utf-8") if ws else "" for ws in split]
    code = np.frombuffer("".join(lined).encode("utf-32-le"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(split)), [len(x) for x in lined])
    inside = doc[1:] == doc[:-1]
    return ((code[:-1] * 40503 + code[1:] * 30103 + 1) % BUCKETS)[inside], doc[1:][inside]


def repeated_words(split: list[list[bytes]], width: int = WINDOW) -> list[int]:
    """Per document: words inside windows that the text holds twice or more."""
    sizes = np.array([len(ws) for ws in split], np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    n, n_docs = len(doc), len(split)
    if n < width:
        return [0] * n_docs
    flat = np.empty(n, object)
    flat[:] = [w for ws in split for w in ws]
    code, span = pd.factorize(flat)[0].astype(np.int64), 1
    while span < width:             # codes of 2, 4, 8 words from pairs of shorter ones
        code = pd.factorize(code[:-span] * (int(code.max()) + 1) + code[span:])[0].astype(np.int64)
        span *= 2
    at = np.flatnonzero(doc[:len(code)] == doc[width - 1:])
    same = pd.factorize(code[at] * n_docs + doc[at])[0]
    again = at[np.bincount(same)[same] > 1] if len(at) else at
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs).tolist()


def base_counts(texts: list[str], split: list[list[bytes]]) -> dict[str, list[int]]:
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    return {"n_words": [len(ws) for ws in split],
            "word_chars": [len(t) - sum(map(t.count, BLANKS)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": repeated_words(split)}


@common.lean
def _histogram(batches):
    """Sums of a task's texts: bucket, n-grams of all rows, of trusted rows."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.array(batch.column("trusted").to_pylist(), bool)
        for start, texts in common.text_blocks(batch):
            bucket, doc = char_pairs([split_words(t) for t in texts])
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[trusted[start:start + len(texts)][doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "good": good[at]})


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of a bounded sample of the rows labelled good: the smallest md5."""
    return (labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
            .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows))


def weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of every bucket, from counts over all documents."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(True))), "doc_id", "left")   # TRUSTED_ROWS at most
    marked = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = (marked.mapInArrow(_histogram, "bucket long, raw long, good long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():          # BUCKETS rows at most
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(BUCKETS, np.int64)
    share = np.where(raw > 0, raw, 1) / raw.sum()
    ratio = np.where(raw > 0, (good + PRIOR * share) / ((good.sum() + PRIOR) * share), 1)
    return np.rint(np.log(ratio) * UNIT).astype(np.int64)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*COLUMNS, "base_failed", "kept", "n_grams", "llr_units"]


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, the base counts, base_failed, kept, the number of
    n-grams and the sum of their weights of every row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(weights(docs, labels))
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))
    limit = round(threshold * UNIT)

    def run(batches):
        weight = table.value
        for batch in batches:
            for start, texts in common.text_blocks(batch):
                split = [split_words(t) for t in texts]
                bucket, doc = char_pairs(split)
                n = np.bincount(doc, minlength=len(texts))
                total = np.bincount(doc, weight[bucket], minlength=len(texts)).astype(np.int64)
                base = base_counts(texts, split)
                size, again = (np.array(base[c], np.int64) for c in ("n_words", "n_repeat_words"))
                failed = (size < MIN_WORDS) | (100 * again > REPEAT_PERCENT * size)
                kept = ~failed & (total >= limit * n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(start, len(texts)) for i in range(len(keep))),
                     *(pa.array(base[c], pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(kept),
                     pa.array(n, pa.int64()), pa.array(total)],
                    names=[*(f"_{i}" for i in range(len(keep))), *ADDED])

    kinds = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema = ", ".join([*kinds, *(f"{c} long" for c in COLUMNS), "base_failed boolean, kept boolean, n_grams long, llr_units long"])
    out = rows.mapInArrow(common.lean(run), schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *ADDED)


def op6_ngram_llr(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", *ADDED)


ORACLE_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM rows),
words AS (
  SELECT r, doc_id, x, i, n FROM (
    SELECT r, doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM split)),
windows AS (
  SELECT r, i, k FROM (
    SELECT r, i, n, string_agg(x, ' ') OVER (
      PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM words)
  WHERE i + {WINDOW - 1} <= n),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest(range(0, {WINDOW})) AS o FROM again) GROUP BY r),
grams AS (
  SELECT r, doc_id, (unicode(s[j]) * 40503 + unicode(s[j + 1]) * 30103 + 1) % {BUCKETS} AS b
  FROM (SELECT r, doc_id, ' ' || x || ' ' AS s, unnest(range(1, length(x) + 2)) AS j FROM words)),
trusted AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED_ROWS}),
hist AS (
  SELECT b, count(*)::DOUBLE AS raw, (count(*) FILTER (doc_id IN (SELECT doc_id FROM trusted)))::DOUBLE AS good
  FROM grams GROUP BY b),
sums AS (SELECT sum(raw) AS n_raw, sum(good) AS n_good FROM hist),
weights AS (
  SELECT b, CASE WHEN n_good = 0 THEN 0 ELSE
         round(ln((good + {PRIOR} * (raw / n_raw)) / ((n_good + {PRIOR}) * (raw / n_raw))) * {UNIT})::BIGINT END AS u
  FROM hist, sums),
scored AS (SELECT r, count(*) AS n, sum(u)::BIGINT AS total FROM grams JOIN weights USING (b) GROUP BY r),
counted AS (
  SELECT s.r, s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(g.n, 0) AS n_grams, coalesce(g.total, 0) AS llr_units
  FROM split s LEFT JOIN covered c ON c.r = s.r LEFT JOIN scored g ON g.r = s.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
         AND llr_units >= {round(THRESHOLD * UNIT)} * n_grams AS kept,
       n_grams, llr_units
FROM counted
"""
