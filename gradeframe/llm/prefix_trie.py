"""Prefix trie of rebuilt conversations.

Conversation ``c`` is rebuilt from the head of its base ``c - c % 100`` (the
first ``h`` turns of it, ``h`` = crc32 of the decimal ``c`` modulo 6) and its
own turns after its first ``h``.  A node is a distinct sequence of first turns
(role, text) of rebuilt conversations.

* *Fingerprints.*  A turn is an element (1, t) of the monoid
  ``(n, s) * (m, t) = (n + m, s + B^n t)`` modulo the prime 2^61 - 1, in two
  lanes of bases drawn from a seed.  The product over a stored conversation's
  first ``d`` turns is found by a scan that runs over ranges of the whole
  order, so that one very long conversation is spread.  It is a group: the
  fingerprint of a rebuilt prefix is ``head * own(h)^-1 * own(j)``, from one
  product of the base and two of the conversation.  No rebuilt text exists.
* *Members.*  Every rebuilt turn is one narrow row: its conversation, depth,
  fingerprint, that of its parent, and the stored turn it refers to.  Their
  number is that of the turns, and up to five heads' turns a conversation.
* *Equality.*  Rows of one fingerprint are one node if all have one parent
  fingerprint and the stored turns they refer to have one role and one text.
  That is asked of every node, of depth after depth in one aggregation; were
  it ever false, the whole is done anew with another seed.
* *Subtrees.*  A node is credited to its smallest member.  For a member of a
  node, what is credited to it at that depth and below lies in the node's
  subtree, and each node of the subtree is credited once.  So sums over
  subtrees are suffix sums along conversations (again over ranges), added up
  over members: no path is walked and no ancestor pairs are made.
* *Ends.*  Ids of members that end at a node are joined into texts of one
  block of ids; nodes of several blocks are hashed block after block.

Turns are ordered by (turn, role, text), null turns first; null role and text
are empty.  Rows without conv_id belong to no conversation and are left out.
Repeated rows are repeated turns.  A conversation without turns of its own
does not occur in the table; a rebuilt one may have none and is a member of
the root.  Other columns are not read.  An empty table has no node at all.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeframe.llm import common
from gradeframe.operators.ordered import sequence_number, with_ranges

PRIME = (1 << 61) - 1
FAMILY = 100               # conversations of one base
HEADS = 6                  # heads have 0 to 5 turns
BLOCK = 512                # ids joined into one text
NODE = ["depth", "f1", "f2"]


def bases(seed: int) -> list[int]:
    return [random.Random(f"{seed}:{lane}").randrange(1 << 32, PRIME) for lane in (1, 2)]


def prefix_products(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, pos, chars, p1, p2, q1, q2): the product up to each turn and
    the one before it, of ``turns`` (conv_id, pos, role, text)."""
    narrow = turns.select("conv_id", "pos", F.length("text").cast("long").alias("chars"), *[
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(lane), "role", "text"), 4).alias(f"t{lane}") for lane in (1, 2)])
    ranged = with_ranges(narrow, ["conv_id"], [F.col("pos")])
    base = bases(seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products within a range: as if its turns came first."""
        own, s, power = None, [0, 0], [1, 1]
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for c, r, *t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "_range", "t1", "t2")), strict=True):
                if (c, r) != own:
                    own, n, s, power = (c, r), 0, [0, 0], [1, 1]
                n += 1
                out[0].append(n)
                for lane in (0, 1):
                    out[3 + lane].append(s[lane])
                    s[lane] = (s[lane] + power[lane] * t[lane]) % PRIME
                    out[1 + lane].append(s[lane])
                    power[lane] = power[lane] * base[lane] % PRIME
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("conv_id", "pos", "chars", "_range")), *(pa.array(x, pa.int64()) for x in out)],
                names=["conv_id", "pos", "chars", "_range", "n", "p1", "p2", "q1", "q2"])

    local = common.checkpoint(ranged.sortWithinPartitions("_range", "conv_id", "pos").mapInArrow(
        scan, "conv_id long, pos long, chars long, _range int, n long, p1 long, p2 long, q1 long, q2 long"))
    # conversations that go over a range's bound: at most one row a range and conversation
    ends = local.groupBy("conv_id", "_range").agg(F.max("n").alias("n"), F.max_by("p1", "n").alias("p1"),
                                                  F.max_by("p2", "n").alias("p2"))
    over = ends.join(ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("conv_id"),
                     "conv_id", "left_semi")

    def carry(key, rows):
        rows = rows.sort_values("_range")
        before, n, s = [], 0, [0, 0]
        for r in rows.itertuples():
            before.append((r.conv_id, r[2], n, *s))
            s = [(x + pow(b, n, PRIME) * p) % PRIME for x, b, p in zip(s, base, (r.p1, r.p2), strict=True)]
            n += r.n
        return rows.iloc[:, :0].assign(**dict(zip(("conv_id", "_range", "n", "p1", "p2"), zip(*before, strict=True), strict=True)))

    earlier = over.groupBy("conv_id").applyInPandas(carry, "conv_id long, _range int, n long, p1 long, p2 long")
    earlier = earlier.where("n > 0").select(
        F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), F.struct("n", "p1", "p2").alias("before"))
    # fewer rows than ranges
    joined = local.join(F.broadcast(earlier), (F.col("conv_id") == F.col("_c")) & (F.col("_range") == F.col("_r")), "left")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {x: batch.column(x).to_pylist() for x in ("p1", "p2", "q1", "q2")}
            for i, b in enumerate(batch.column("before").to_pylist()):
                if b:
                    for x in cols:
                        lane = int(x[1]) - 1
                        cols[x][i] = (b[f"p{lane + 1}"] + pow(base[lane], b["n"], PRIME) * cols[x][i]) % PRIME
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("pos"), batch.column("chars"),
                 *(pa.array(x, pa.int64()) for x in cols.values())], names=["conv_id", "pos", "chars", *cols])

    return common.checkpoint(joined.mapInArrow(add, "conv_id long, pos long, chars long, p1 long, p2 long, q1 long, q2 long"))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def members(products: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, depth) and the rows of their rebuilt turns
    (conv_id, depth, f1, f2, g1, g2 of the parent, ref_conv, ref_pos, chars,
    ends)."""
    base = bases(seed)
    taken = products.withColumn("h", head_length(F.col("conv_id")))
    at = F.when(F.col("pos") == F.col("h"), F.struct("p1", "p2"))
    convs = taken.groupBy("conv_id").agg(F.first("h").alias("h"), F.max("pos").alias("own"),
                                         F.first(at, ignorenulls=True).alias("cut"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = products.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).groupBy(
        F.col("conv_id").alias("base")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "chars", "p1", "p2", "q1", "q2"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = common.checkpoint(convs.select(
        "conv_id", "base", "h", "head", "cut",
        (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("depth")))
    from_head = convs.select("conv_id", "base", "depth", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), F.col("t.p1").alias("f1"), F.col("t.p2").alias("f2"),
        F.col("t.q1").alias("g1"), F.col("t.q2").alias("g2"), F.col("base").alias("ref_conv"),
        F.col("t.pos").alias("ref_pos"), F.col("t.chars").alias("chars"), (F.col("t.pos") == F.col("depth")).alias("ends"))
    last = F.element_at("head", -1)
    parts = convs.where(F.col("depth") > F.size("head")).select(
        "conv_id", "h", "depth", "cut", F.size("head").alias("k"),
        F.when(F.size("head") > 0, F.struct(last["p1"].alias("p1"), last["p2"].alias("p2"))).alias("top"))
    own = products.join(parts, "conv_id").where(F.col("pos") > F.col("h"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """top * cut^-1 * product, for the turn and for the one before it."""
        shift = {(lane, n): pow(base[lane], n, PRIME) for lane in (0, 1) for n in range(-HEADS, 1)}
        for batch in batches:
            out: dict[str, list[int]] = {"f1": [], "f2": [], "g1": [], "g2": []}
            for row in zip(*(batch.column(x).to_pylist() for x in ("k", "h", "top", "cut", "p1", "p2", "q1", "q2")), strict=True):
                k, h, top, cut = row[:4]
                for x, s in zip(out, row[4:], strict=True):
                    lane = int(x[1]) - 1
                    s = (s - (cut[f"p{lane + 1}"] if cut else 0)) * shift[lane, k - h]
                    out[x].append((s + (top[f"p{lane + 1}"] if top else 0)) % PRIME)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("at"), *(pa.array(x, pa.int64()) for x in out.values()),
                 batch.column("conv_id"), batch.column("pos"), batch.column("chars"), batch.column("ends")],
                names=["conv_id", "depth", *out, "ref_conv", "ref_pos", "chars", "ends"])

    at = (F.col("k") + F.col("pos") - F.col("h")).cast("long")
    from_own = own.select("*", at.alias("at"), (at == F.col("depth")).alias("ends")).mapInArrow(
        combine, "conv_id long, depth long, f1 long, f2 long, g1 long, g2 long, ref_conv long, ref_pos long, "
                 "chars long, ends boolean")
    return convs.select("conv_id", "depth"), common.checkpoint(from_head.union(from_own))


def unequal(rows: DataFrame, turns: DataFrame) -> bool:
    """Whether rows of one fingerprint differ in their parents or in the turns
    they refer to.  A conversation's reference to its own turn stands for all
    others to that turn: each is in the base's own rows."""
    texts = turns.select(F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "role", "text")
    seen = rows.where(F.col("conv_id") == F.col("ref_conv")).join(texts, ["ref_conv", "ref_pos"])
    differ = [F.max(c) != F.min(c) for c in ("g1", "g2", "role", "text")]
    return not seen.groupBy(*NODE).agg((differ[0] | differ[1] | differ[2] | differ[3]).alias("no")).where("no").isEmpty()


def _suffix_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with each of ``values`` summed over the conversation's rows of
    this depth and below, spread over ranges of (conv_id, depth)."""
    ranged = with_ranges(rows, ["conv_id"], [F.col("depth").desc()])
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("conv_id", "_range").agg(*[F.sum(v).alias(v) for v in values]).select(
        F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), *[F.sum(v).over(earlier).alias(f"_{v}") for v in values])
    totals = totals.where(F.col(f"_{values[0]}").isNotNull())         # fewer rows than ranges
    here = Window.partitionBy("conv_id", "_range").orderBy(F.col("depth").desc())
    joined = ranged.join(F.broadcast(totals), (F.col("conv_id") == F.col("_c")) & (F.col("_range") == F.col("_r")), "left")
    return joined.withColumns({v: F.sum(v).over(here) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(
        "_c", "_r", "_range", *[f"_{v}" for v in values])


def end_digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256) over the conv_ids of ``rows``, ascending and joined
    by commas."""
    blocks = rows.withColumn("block", F.expr(f"conv_id div {BLOCK}")).groupBy(*key, "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    blocks = common.checkpoint(blocks)
    counts = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))
    single = counts.where("n = 1").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    several = blocks.join(counts.where("n > 1").select(*key), key, "left_semi")
    kinds = {c: blocks.schema[c].dataType.simpleString() for c in key}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, found = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if own != node:
                    if sha:
                        found.append((*node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            found.append((*node, sha.hexdigest()))
        if found:
            schema = pa.schema([*((c, batch.schema.field(c).type) for c in key), ("ends_sha256", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), schema.types, strict=True)],
                                             schema=schema)

    dealt = several.repartition(*key).sortWithinPartitions(*key, "block")
    return single.union(dealt.mapInArrow(digest, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node; see the contract's columns in the module's query."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = sequence_number(turns, ["conv_id"], ["turn", "role", "text"], "pos")
    for seed in range(1 << 10):
        products = prefix_products(turns, seed)
        convs, rows = members(products, seed)
        if not unequal(rows, turns):
            break
    nodes = common.checkpoint(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("smallest"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"),
        F.first("chars").alias("chars"), F.first("g1").alias("g1"), F.first("g2").alias("g2")))
    # members of shared nodes, with what is credited to them there
    shared = nodes.where("n_convs > 1").select(*NODE, "smallest", "n_convs", "n_ends", "chars")
    credit = F.col("conv_id") == F.col("smallest")
    on_shared = rows.select("conv_id", *NODE).join(shared, NODE)
    leaf = (credit & (F.col("n_ends") == F.col("n_convs"))).cast("long")
    saved = F.when(credit, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    # a leaf of one member lies below its conversation's shared nodes: credited to the deepest of them
    alone = nodes.where("n_convs = 1 and n_ends = 1").select(F.col("smallest").alias("conv_id"), F.lit(True).alias("alone"))
    deepest = on_shared.groupBy("conv_id").agg(F.max("depth").alias("depth")).join(alone, "conv_id").select(
        "conv_id", "depth", "alone")
    credited = on_shared.join(deepest, ["conv_id", "depth"], "left").select(
        "conv_id", *NODE, (leaf + F.coalesce("alone", F.lit(False)).cast("long")).alias("leaves"), saved.alias("saved"))
    sums = _suffix_sums(credited, ["leaves", "saved"]).groupBy(*NODE).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"),
                                                F.col("g2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    # a node's smallest member has the parent's row one depth above
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), *["f1", "f2"]).join(
        nodes.select(*NODE, "smallest").withColumn("depth", F.col("depth") + 1), NODE).select(
            F.col("conv_id"), "depth", F.col("smallest").alias("parent_conv_id"))
    parents = nodes.where("depth > 1").select(*NODE, F.col("smallest").alias("conv_id")).join(
        above, ["conv_id", "depth"]).select(*NODE, "parent_conv_id")
    digests = end_digests(rows.where("ends").select(*NODE, "conv_id"), NODE)
    empty = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    found = nodes.join(sums, NODE, "left").join(children, NODE, "left").join(parents, NODE, "left").join(digests, NODE, "left")
    root_id = convs.agg(F.min("conv_id").alias("root_id"))            # one row
    found = found.crossJoin(F.broadcast(root_id)).select(
        F.col("smallest").alias("conv_id"), "depth",
        F.when(F.col("depth") == 1, F.col("root_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    totals = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("n_ends") == F.col("n_convs")).alias("leaves"),
                       F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), zero).alias("saved_tokens"))
    ends = end_digests(convs.where("depth = 0").select(F.lit(0).cast("long").alias("depth"), "conv_id"), ["depth"])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").crossJoin(
        F.broadcast(totals)).withColumn("depth", zero).join(ends, "depth", "left").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    return found.union(root)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(common.read(spark, sf_dir, "conversations"))


#: A prefix is the text of its turns' digests, 33 characters each.
ORACLE_SQL = """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
rebuilt AS (SELECT * FROM heads UNION ALL
  SELECT t.conv_id, t.pos - c.h + coalesce(k, 0), t.role, t.text FROM turns t JOIN convs c ON c.conv_id = t.conv_id
  LEFT JOIN (SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id) n ON n.conv_id = c.conv_id WHERE t.pos > c.h),
rows AS (SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS chars FROM convs UNION ALL
  SELECT conv_id, depth, string_agg(md5(role || chr(1) || text), ' ') OVER (PARTITION BY conv_id ORDER BY depth) || ' ',
    length(text) FROM rebuilt),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM rows),
nodes AS (SELECT prefix, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY prefix),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, p.prefix AS parent, (SELECT count(*) FROM nodes c
    WHERE c.depth = n.depth + 1 AND starts_with(c.prefix, n.prefix)) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = left(n.prefix, length(n.prefix) - 33))
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs, n.n_children,
  count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN linked u ON starts_with(u.prefix, n.prefix) GROUP BY ALL"""
