"""Merkle fixity audit of archive replicas.

Every record of an archive file is a leaf: sha256 of its bytes at its offset.
Records are grouped by ranges of offsets, ``RANGE`` bytes wide; a range's hash
covers its records in order of offset, and each further level covers
``FANOUT`` neighbouring ranges, ``LEVELS`` levels up to the file's root (files
beyond 4 GB have several).  Two replicas are compared at the roots; only the
children of ranges that differ are compared at the next level, down to the
records.

Groups are ranges of bytes, so their size is bounded whatever file or host
holds most records, and only hashes are shuffled.

The query lays ``pages`` out as response records, ``PER_FILE`` to a file in
the order of a hash, and audits them against a replica in which a few records,
chosen by the same hash, are altered, cut short or lost.

Null html and url read as empty; repeated rows are records of their own;
files that only one replica has are reported record by record; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, rownum

RANGE, FANOUT, LEVELS = 1 << 16, 16, 5
PER_FILE = 1024


def ranges(leaves: DataFrame) -> DataFrame:
    """Level 1: file, idx and hash of every range of records."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "digest")))     # RANGE bytes of records
    listed = F.array_join(F.transform(inside, lambda x: F.concat_ws(":", x["offset"].cast("string"), x["digest"])), ",")
    return leaves.groupBy("file", F.expr(f"offset div {RANGE}").alias("idx")).agg(F.sha2(listed.cast("binary"), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level up."""
    inside = F.array_sort(F.collect_list(F.struct("idx", "hash")))          # FANOUT children
    listed = F.array_join(F.transform(inside, lambda x: F.concat_ws(":", x["idx"].cast("string"), x["hash"])), ",")
    return nodes.groupBy("file", F.expr(f"idx div {FANOUT}").alias("up")).agg(
        F.sha2(listed.cast("binary"), 256).alias("hash")).withColumnRenamed("up", "idx")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels 1 (ranges) to ``LEVELS`` (roots)."""
    levels = [common.checkpoint(ranges(leaves))]
    for _ in range(LEVELS - 1):
        levels.append(common.checkpoint(parents(levels[-1])))
    return levels


def compared(a: DataFrame, b: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Both replicas' values by key, null where a replica has none."""
    sides = [df.select(*key, F.struct(*value).alias("v")).withColumn("side", F.lit(s)) for s, df in (("a", a), ("b", b))]
    return sides[0].unionAll(sides[1]).groupBy(*key).agg(
        *[F.max(F.when(F.col("side") == s, F.col("v"))).alias(s) for s in "ab"])


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (file, idx, root_a, root_b) of two replicas' leaves (file,
    offset, length, record_id, digest), and the records that differ (file,
    offset, a, b)."""
    tree_a, tree_b = tree(a), tree(b)
    roots = compared(tree_a[-1], tree_b[-1], ["file", "idx"], ["hash"])
    open_ = roots.where("not (a <=> b)").select("file", "idx")
    for level in range(LEVELS - 2, -1, -1):
        up = open_.withColumnRenamed("idx", "up")
        below = [t[level].withColumn("up", F.expr(f"idx div {FANOUT}")).join(up, ["file", "up"], "left_semi") for t in (tree_a, tree_b)]
        open_ = common.checkpoint(compared(*below, ["file", "idx"], ["hash"]).where("not (a <=> b)").select("file", "idx"))
    records = [x.withColumn("idx", F.expr(f"offset div {RANGE}")).join(open_, ["file", "idx"], "left_semi") for x in (a, b)]
    found = compared(*records, ["file", "offset"], ["digest", "length", "record_id"]).where("not (a.digest <=> b.digest)")
    return roots.select("file", "idx", F.col("a.hash").alias("root_a"), F.col("b.hash").alias("root_b")), found


def record(html) -> F.Column:
    """A response record's bytes, as text."""
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def damaged(html, key) -> F.Column:
    """What a replica holds instead: another middle character, half the page,
    nothing, or (for nearly all keys) the same."""
    end, half = F.substring(key, 31, 2), F.floor(F.length(html) / 2).cast("int")
    return (F.when(end == "a0", F.concat(html.substr(F.lit(1), half), F.lit("~"), html.substr(half + 2, F.length(html))))
            .when(end == "0f", html.substr(F.lit(1), half)).when(end == "ff", F.lit(None)).otherwise(html))


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves of the laid-out pages and of the replica; html is read once and
    only digests are shuffled."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"),
                         rownum.order_key(F.col("page_id"), F.col("url"), F.md5(html.cast("binary"))).alias("key"))
    other = damaged(F.col("html"), F.col("key"))
    narrow = keyed.select("page_id", "key", *[
        c for side, text in (("a", F.col("html")), ("b", other))
        for c in (F.sha2(record(text).cast("binary"), 256).alias(f"digest_{side}"),
                  F.octet_length(record(text)).cast("long").alias(f"length_{side}"))])
    numbered = rownum.number_rows(common.checkpoint(narrow), "key", ["digest_a"])
    before = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)    # PER_FILE rows
    placed = common.checkpoint(numbered.withColumn("file", F.expr(f"row_no div {PER_FILE}"))
                               .withColumn("offset", F.coalesce(F.sum("length_a").over(before), F.lit(0))))
    return tuple(placed.where(f"digest_{s} is not null").select(
        "file", "offset", F.col(f"length_{s}").alias("length"), F.col("page_id").alias("record_id"), F.col(f"digest_{s}").alias("digest"))
        for s in "ab")


def op1_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """One row per intact root and one per record that differs."""
    roots, found = audit(*replicas(common.read(spark, sf_dir, "pages")))
    roots = common.checkpoint(roots)
    width = RANGE * FANOUT ** (LEVELS - 1)
    bad = (found.withColumn("idx", F.expr(f"offset div {width}")).join(roots, ["file", "idx"])
           .select("file", "root_a", "root_b",
                   F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered").alias("status"),
                   "offset", F.coalesce("a.length", "b.length").alias("length"), F.coalesce("a.record_id", "b.record_id").alias("page_id"),
                   F.col("a.digest").alias("digest_a"), F.col("b.digest").alias("digest_b")))
    good = roots.where("root_a <=> root_b").select(
        "file", "root_a", "root_b", F.lit("intact").alias("status"), *[F.lit(None).cast(bad.schema[c].dataType).alias(c) for c in bad.columns[4:]])
    return good.unionAll(bad)


def _sql_record(html: str) -> str:
    return (f"'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || "
            f"coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || "
            f"'Content-Length: ' || strlen({html}) || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10)")


def _sql_tree(side: str) -> str:
    out = (f", {side}1 AS (SELECT file, off // {RANGE} AS idx, sha256(string_agg(off || ':' || digest_{side}, ',' ORDER BY off)) AS hash "
           f"FROM placed WHERE digest_{side} IS NOT NULL GROUP BY ALL)")
    for i in range(2, LEVELS + 1):
        out += (f", {side}{i} AS (SELECT file, idx // {FANOUT} AS idx, sha256(string_agg(idx || ':' || hash, ',' ORDER BY idx)) AS hash "
                f"FROM (SELECT file, idx AS idx, hash FROM {side}{i - 1}) GROUP BY file, idx // {FANOUT})")
    return out


ORACLE_SQL = f"""
WITH keyed AS (
  SELECT page_id, url, coalesce(html, '') AS h,
         md5(concat_ws(chr(31), coalesce('=' || page_id::VARCHAR, '-'), coalesce('=' || url, '-'), '=' || md5(coalesce(html, '')))) AS key
  FROM pages),
other AS (
  SELECT *, CASE substr(key, 31, 2)
    WHEN 'a0' THEN substr(h, 1, length(h) // 2) || '~' || substr(h, length(h) // 2 + 2)
    WHEN '0f' THEN substr(h, 1, length(h) // 2) WHEN 'ff' THEN NULL ELSE h END AS g FROM keyed),
narrow AS (
  SELECT page_id, key, sha256({_sql_record('h')}) AS digest_a, strlen({_sql_record('h')}) AS length_a,
         sha256({_sql_record('g')}) AS digest_b, strlen({_sql_record('g')}) AS length_b FROM other),
numbered AS (SELECT *, row_number() OVER (ORDER BY key, digest_a) - 1 AS row_no FROM narrow),
placed AS (
  SELECT *, row_no // {PER_FILE} AS file,
         coalesce(sum(length_a) OVER (PARTITION BY row_no // {PER_FILE} ORDER BY row_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM numbered)
{_sql_tree('a')}{_sql_tree('b')}
, roots AS (SELECT file, idx, a{LEVELS}.hash AS root_a, b{LEVELS}.hash AS root_b FROM a{LEVELS} FULL JOIN b{LEVELS} USING (file, idx))
SELECT file, root_a, root_b, 'intact' AS status, NULL::BIGINT AS "offset", NULL::BIGINT AS length, NULL::BIGINT AS page_id,
       NULL::VARCHAR AS digest_a, NULL::VARCHAR AS digest_b
FROM roots WHERE root_a IS NOT DISTINCT FROM root_b
UNION ALL
SELECT p.file, root_a, root_b, CASE WHEN digest_b IS NULL THEN 'missing' ELSE 'altered' END, off, length_a, page_id, digest_a, digest_b
FROM placed p JOIN roots r ON r.file = p.file AND r.idx = off // {RANGE * FANOUT ** (LEVELS - 1)}
WHERE digest_a IS DISTINCT FROM digest_b
"""
