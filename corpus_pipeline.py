"""The corpus pipeline: stages applied to ``documents`` one after another.

Every stage takes what the one before has kept and returns the columns of
``documents`` (the last one: the encoded documents).  Columns beyond these are
left out at the start of each stage.  Null and empty texts fail the quality
rules; where a stage gets them all the same it keeps them as they are.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import bpe, common, decontam, minhash_bayes, quality_llr, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE = 5                # words, for near duplicates
BATCH_ROWS = 1000          # rows sent to a Python worker at a time

#: The models and similarity joins have no SQL form; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio stay."""
    scored = quality_llr.score_documents(_start(docs), common.read(spark, sf_dir, "labels"), COLUMNS)
    return scored.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every group stays, once: of rows
    with one doc_id and text that of the least lang, source and n_chars."""
    docs = _start(docs)
    found = common.stored(minhash_bayes.near_duplicates(docs, SHINGLE))
    gone = found.where("not (doc_id <=> component_id)").select("doc_id", "k1", "k2").distinct()
    left = _without(docs, gone)
    own = ["doc_id", "k1", "k2"]
    again = common.checkpoint(found.where("n_shingles > 0").groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if again.isEmpty():
        return left
    left = left.select("*", *common.content_key("text"))
    same = (left["k1"] == again["k1"]) & (left["k2"] == again["k2"]) & left["doc_id"].eqNullSafe(again["doc_id"])
    one = left.join(again, same, "left_semi").groupBy(*own).agg(
        F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return left.join(again, same, "left_anti").select(*COLUMNS).union(
        one.select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = _start(docs)
    found = decontam.contamination(docs, common.read(spark, sf_dir, "benchmark"), ["doc_id"], proximity=False)
    return _without(docs, found.where("n_hit > 0").select("doc_id", "k1", "k2").distinct())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark."""
    docs = _start(docs)
    return secrets.redact(docs, secrets.train(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the digest of their
    decoded text."""
    coded = bpe.encode_documents(_start(docs), common.tokenizer_path(bpe.MODEL), ["doc_id", "lang", "source"])
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return coded.select("doc_id", "lang", "source", "n_tokens", ids.alias("ids"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _start(docs: DataFrame) -> DataFrame:
    """The columns of documents; from here on workers get texts in batches of
    ``BATCH_ROWS``, since both ends of the pipe hold a batch and all stages
    share the executors' memory."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text ``gone`` names."""
    few = common.checkpoint(gone.withColumnRenamed("doc_id", "gone_id"))
    if common.small_enough(few, 100_000):
        few = F.broadcast(few)
    keyed = docs.select(*COLUMNS, *common.content_key("text"))
    same = (keyed["k1"] == few["k1"]) & (keyed["k2"] == few["k2"]) & keyed["doc_id"].eqNullSafe(few["gone_id"])
    return keyed.join(few, same, "left_anti").select(*COLUMNS)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each one's rows are written to the shared folder and
    read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
