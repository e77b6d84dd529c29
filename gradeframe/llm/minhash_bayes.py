"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning,
exact confirmation, connected components.

1. Texts with the same set of shingles are one node; only nodes go on.
2. A node's signature has ``BANDS`` bands; nodes that share a band share a
   bucket.  Buckets are dealt into subgroups of about ``SUBGROUP`` nodes and
   every node is paired with the least of its subgroup: pairs grow with nodes,
   not with the square of a group.
3. A pair's signatures are compared batch by batch.  It is dropped as soon as
   the posterior probability of the wanted similarity falls under ``MISS``.
   Of the survivors each node's ``PARTNERS`` most alike are confirmed on the
   full sets.
4. Links are closed to components.  In a bucket that still holds several
   components, every node outside its largest one is compared with every
   bucket mate of another component, in blocks of ``BLOCK`` nodes (a pair that
   shares several bands is looked at in the first).  So no link between
   components is lost, while groups that hang together cost nothing more.
   The links are closed once more.

Two texts of similarity 0.8 share no band with probability 5e-8; the pruning
adds at most ``MISS`` per batch.

Documents without words (null or empty text) have no shingles, are linked with
nothing and are their own component.  A component is named by its smallest
doc_id (nulls aside; null where all are).  Every row gives one row; repeated
rows fall in one component.  An empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
SIMILARITY = 80            # percent
HASHES, BANDS, BATCH = 128, 32, 16
ROWS = HASHES // BANDS
MISS = 1e-9
BLOCK = 256
SUBGROUP, PARTNERS = 8, 3
BROADCAST_NODES = 300_000

_rng = np.random.default_rng(8)
FLIP = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
ODD = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    split = [t.encode("utf-8").lower().split() for t in texts]     # bytes: A-Z and ASCII white space only
    sizes = [len(ws) for ws in split]
    flat = np.empty(sum(sizes), object)
    flat[:] = [w for ws in split for w in ws]
    code, distinct = pd.factorize(flat)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    word = hashed[code] if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(max(len(word) - k + 1, 0), np.uint64)
        for i in range(k):
            run = run * PRIME + word[i:len(run) + i]
        run = _mix(run)
        out, at = [], 0
        for n in sizes:
            if n >= k:
                out.append(np.unique(run[at:at + n - k + 1]))
            elif n:
                short = np.uint64(n)
                for h in word[at:at + n]:
                    short = short * PRIME + h
                out.append(_mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``HASHES`` hashes over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (((x[None, i:i + 4096] ^ FLIP) * ODD)).min(axis=1))
    return low


@lru_cache
def survival_table(similarity: float = SIMILARITY / 100, miss: float = MISS) -> np.ndarray:
    """For each number of compared hashes (batches of ``BATCH``) the least
    number of agreements with which the posterior probability, under an even
    prior, that the similarity is reached is still ``miss``."""
    s = (np.arange(4000) + 0.5) / 4000
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        density = np.exp(log - log.max(axis=1, keepdims=True))
        tail = density[:, s >= similarity].sum(axis=1) / density.sum(axis=1)
        least.append(int(np.argmax(tail >= miss)))
    return np.array(least)


def survivors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature matrices pass all batches, and in how many
    hashes they agree."""
    alive = np.arange(len(left))
    agree = np.zeros(len(left), np.int64)
    for i, least in enumerate(survival_table()):
        part = slice(i * BATCH, (i + 1) * BATCH)
        agree[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    return alive, agree[alive]


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, the text's key, the set's key and size, and the signature."""
    rows = docs.select("doc_id", *common.content_key("text"), "text")

    def run(batches):
        for batch in batches:
            for start, texts in common.text_blocks(batch):
                sets = shingle_sets(texts, k)
                keys = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(texts)) for c in ("doc_id", "k1", "k2")),
                     pa.array([_signed(a) for a, _ in keys]), pa.array([_signed(b) for _, b in keys]),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "k1", "k2", "s1", "s2", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.lean(run), f"doc_id {kind}, k1 long, k2 long, s1 long, s2 long, n long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and set of the ``wanted`` nodes (node, k1, k2, doc), from the text
    of one document each; stored."""
    if common.small_enough(wanted, BROADCAST_NODES):
        wanted = F.broadcast(wanted)
    text = (docs.select("doc_id", *common.content_key("text"), "text").join(wanted, ["k1", "k2"])
            .where(F.col("doc_id").eqNullSafe(F.col("doc"))).groupBy("node").agg(F.first("text").alias("text")))

    def run(batches):
        for batch in batches:
            for start, texts in common.text_blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(start, len(texts)), pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())],
                    names=["node", "set"])

    return common.stored(text.mapInArrow(common.lean(run), "node long, set binary"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


@common.lean
def _prune(batches):
    for batch in batches:
        if batch.num_rows:
            keep, agree = survivors(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).take(pa.array(keep)).columns, pa.array(agree)],
                                             names=["a", "b", "agree"])


@common.lean
def _confirm(batches):
    for batch in batches:
        pairs = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
        keep = [i for i, (a, b) in enumerate(pairs) if similar(_set(a), _set(b))]
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """A column of ``table`` for either node of every pair."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def best_partners(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, its most alike partners (an array) and whether it had more."""
    sub = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("c") / SUBGROUP))
    dealt = shared.withColumn("sub", sub)
    hubs = dealt.groupBy("bucket", "sub").agg(F.min("node").alias("b"))
    pairs = dealt.join(hubs, ["bucket", "sub"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    alive = with_both(pairs, nodes, "sig").mapInArrow(_prune, "a long, b long, agree long")
    ranked = F.sort_array(F.collect_list(F.struct("agree", "b")), asc=False)        # BANDS partners at most
    return (alive.groupBy(F.col("a").alias("node")).agg(ranked.alias("p"))
            .select("node", F.slice("p", 1, PARTNERS)["b"].alias("partners"), (F.size("p") > PARTNERS).alias("cut")))


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) of every linked node.

    Each round gives a node the least label around it, then follows labels of
    labels; a written table ends each round.  Rounds grow with the logarithm
    of a component's diameter."""
    both = common.checkpoint(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    label = common.checkpoint(label)
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        new = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        new = common.checkpoint(new.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("new"), "comp"))
        moved = new.where("new <> comp").limit(1).count()
        label = new.select("node", F.col("new").alias("comp"))
        if not moved:
            return label


def block_items(members: DataFrame) -> DataFrame:
    """Blocks of open buckets: rows (bucket, band, i, j, node, comp, few).
    ``few`` marks the side outside the bucket's largest component."""
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = (sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("total"), F.max("c").alias("most"))
            .where("total > most"))
    rows = members.join(main, "bucket")
    rows = rows.withColumn("few", F.col("comp") != F.col("main"))
    h = F.xxhash64("node")
    n_few, n_all = (F.ceil(c / BLOCK).cast("int") for c in (F.col("total") - F.col("most"), F.col("total")))
    few = rows.where("few").withColumn("i", F.pmod(h, n_few).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), n_all - 1)))
    every = rows.withColumn("j", F.pmod(h, n_all).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), n_few - 1)))
    return few.unionByName(every.withColumn("few", F.lit(False))).select("bucket", "band", "i", "j", "node", "comp", "few")


def _open_pairs(table: pa.Table):
    """Candidate pairs of a block that pass the pruning: positions in the few
    and the all side, most alike first."""
    few = np.array(table.column("few").to_pylist(), bool)
    node, comp = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "comp"))
    sig = _matrix(table.column("sig"))
    a, b = np.flatnonzero(few), np.flatnonzero(~few)
    twice = np.isin(node[b], node[a])[None, :] & (node[a][:, None] > node[b][None, :])      # both on the few side: one order
    open_ = (comp[a][:, None] != comp[b][None, :]) & ~twice
    bands = sig.view(np.uint64).reshape(len(sig), BANDS, -1)
    for earlier in range(table.column("band")[0].as_py()):                                  # met in an earlier band already
        same = np.ones_like(open_)
        for half in range(bands.shape[2]):
            same &= bands[a, earlier, half][:, None] == bands[b, earlier, half][None, :]
        open_ &= ~same
    x, y = np.nonzero(open_)
    x, y = a[x], b[y]
    keep, agree = survivors(sig[x], sig[y])
    order = keep[np.argsort(-agree, kind="stable")]
    return x[order], y[order], node, comp


def _needed(table: pa.Table) -> pa.Table:
    x, y, _, _ = _open_pairs(table)
    rows = np.union1d(x, y)
    return table.take(pa.array(rows)) if len(rows) else table.slice(0, 0)


def _block_links(table: pa.Table) -> pa.Table:
    x, y, node, comp = _open_pairs(table)
    raw = table.column("set")
    sets: dict[int, np.ndarray] = {}
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    out = []
    for p, q in zip(x.tolist(), y.tolist()):
        u, v = root(int(comp[p])), root(int(comp[q]))
        if u == v:                    # joined by an earlier link of this block
            continue
        for r in (p, q):
            if r not in sets:
                sets[r] = _set(raw[r].as_py())
        if similar(sets[p], sets[q]):
            top[max(u, v)] = min(u, v)
            out.append((int(node[p]), int(node[q])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


ITEM = "bucket long, band int, i int, j int, node long, comp long, few boolean, sig binary"


def open_links(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that a bucket still holds apart."""
    items = block_items(members).join(nodes.select("node", "sig"), "node").select(*[x.split()[0] for x in ITEM.split(", ")])
    key = ["bucket", "i", "j"]
    needed = common.checkpoint(items.groupBy(*key).applyInArrow(_needed, ITEM))
    return needed.join(sets, "node").groupBy(*key).applyInArrow(_block_links, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, key of the text (k1, k2), n_shingles and component_id of every
    row of ``docs``."""
    docs = docs.select("doc_id", "text")
    sketched = common.stored(sketch(docs, k))
    nodes = (sketched.where("n > 0").groupBy("s1", "s2")
             .agg(F.min(F.struct("doc_id", "k1", "k2")).alias("own"), F.min("doc_id").alias("least"), F.first("sig").alias("sig")))
    nodes = common.stored(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "least", F.col("own.doc_id").alias("doc"),
                                       F.col("own.k1").alias("k1"), F.col("own.k2").alias("k2"), "sig"))
    band = F.col("band")
    spread = (nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
              .select("node", "band", F.xxhash64("band", F.col("sig").substr(band * ROWS * 4 + 1, F.lit(ROWS * 4))).alias("bucket")))
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = common.checkpoint(spread.join(buckets, "bucket"))
    partners = common.checkpoint(best_partners(shared, nodes))
    wanted = common.checkpoint(nodes.join(shared.select("node").distinct(), "node").select("node", "k1", "k2", "doc"))
    sets = full_sets(docs, wanted, k)
    pairs = partners.select(F.col("node").alias("a"), F.explode("partners").alias("b"))
    links = common.checkpoint(with_both(pairs, sets, "set").mapInArrow(_confirm, "a long, b long"))
    label = components(links)
    members = (shared.join(label, "node", "left").join(partners.select("node", "cut"), "node", "left")
               .withColumn("comp", F.coalesce("comp", "node")))
    # closed: buckets whose nodes hang together, and those of two nodes whose pair is decided
    decided = (F.col("node") != F.col("low")) & ~F.coalesce("cut", F.lit(False))
    still = (members.groupBy("bucket").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.max("c").alias("c"),
                                           F.max(decided.cast("int")).alias("t"))
             .where("p <> q and not (c = 2 and t = 1)").select("bucket"))
    members = common.checkpoint(members.join(still, "bucket").select("bucket", "band", "node", "comp"))
    more = common.checkpoint(open_links(members, nodes, sets).distinct())
    if more.limit(1).count():
        label = components(links.unionAll(more))
    named = nodes.join(label, "node", "left").select("s1", "s2", "least", F.coalesce("comp", "node").alias("comp"))
    named = common.checkpoint(named)
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(least, "comp").select("s1", "s2", "component_id")
    rows = sketched.select("doc_id", "k1", "k2", "s1", "s2", "n")
    linked = rows.join(named, ["s1", "s2"], "left")
    return linked.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_bayes_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
