"""Removal of repeated byte strings through suffix arrays.

A byte goes if it lies in a string of ``length`` bytes (400) that also starts
anywhere else in the corpus, the same text included.  Texts are judged as they
came in; matches end at a text's end.

1. *Anchors.*  Each window of ``length`` bytes is named by the least hash of
   the ``k``-byte strings in it.  Neighbouring windows mostly share that name,
   so a text becomes runs of windows (hash, first, last).  Equal windows have
   equal names: only runs whose hash occurs twice go on.
2. *Regions.*  The bytes of such a run are cut out of the text, equal regions
   are merged and their number kept as a weight.  Texts and regions that are
   there twice are repeated as a whole; the others are open.
3. *Suffix arrays.*  A region is cut to what it shares with another one around
   their common string (:func:`shared_extents`); a window beyond that stands
   nowhere else.  The regions of one hash are then sorted together by
   :func:`suffix_order`: suffixes are grouped by their longest Lyndon prefix,
   the groups taken in descending order and the groups before them refined
   over previous-smaller pointers, and each group's order is then emitted in
   one pass, without renaming and recursion.  Windows that are equal stand
   next to each other; those of a total weight of two or more are repeated.
4. *Hot groups.*  Regions of one hash whose bytes exceed ``MOST_BYTES`` (a
   passage that very many different texts share) are texts of a next level
   with a larger ``k``.  At ``k = length`` a region is one window and a group
   one region, so no group is ever too large.

Equal regions of one text (of a periodic passage, say) are one row with all
their starts.

Equal texts are one row from step 2 on.  Nothing is collected to the driver.
Hashes of step 1 only choose what is compared; texts and regions are merged by
128 bits of their content.

Nulls count as empty texts; texts below ``length`` bytes keep everything.
Repeated rows are repeated texts: each loses what it shares with the other.
Other columns, whatever their names, are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import common

LENGTH = 400               # bytes of a repeated string
MOST_BYTES = 1 << 18       # bytes sorted together; larger groups are split
LONGEST_RUN = 4096         # windows of one region
PIECE = 1 << 20            # windows hashed at once
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
PARTS = ["s1", "s2"]


# -- suffix order -----------------------------------------------------------

def lyndon_groups(text: bytes) -> tuple[list[list[int]], list[int]]:
    """Suffixes with an equal longest Lyndon prefix, in ascending order of
    that prefix, and each suffix's previous smaller one (-1: none).

    Groups start as the first bytes.  The highest group that is left is final:
    its members' previous smaller suffixes are found over the pointers of
    higher ones, and each of these has its known prefix lengthened by the
    group's, once for every member that points to it.  Those leave their group
    for a new one right above it, the most often lengthened ones highest.
    """
    n = len(text)
    by_byte: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_byte.setdefault(c, []).append(i)
    members = [by_byte[c] for c in sorted(by_byte)]      # those that have left are still listed
    size = [len(m) for m in members]
    below = [g - 1 for g in range(len(members))]
    above = [g + 1 for g in range(len(members))]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    smaller, done, final = [-1] * n, bytearray(n), []

    def split(h: int, leaving: list[int]) -> None:
        size[h] -= len(leaving)
        g, up = len(members), above[h]
        members.append(leaving)
        size.append(len(leaving))
        below.append(h)
        above.append(up)
        above[h] = below[up] = g
        for i in leaving:
            group[i] = g

    g = len(members) - 1          # a group is split while a higher one is taken: ``above`` is set
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = sorted(i for i in own if group[i] == g)
        final.append(own)
        if len(own) == 1:         # most are
            i = own[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0 and size[group[p]] > 1:
                split(group[p], [p])
            g = below[g]
            continue
        for i in own:
            done[i] = 1
        counts: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        lengthened: dict[tuple[int, int], list[int]] = {}
        for p in sorted(counts):
            lengthened.setdefault((counts[p], group[p]), []).append(p)
        for times, h in sorted(lengthened, reverse=True):
            if len(lengthened[times, h]) < size[h]:
                split(h, lengthened[times, h])
        g = below[g]
    final.reverse()
    return final, smaller


def suffix_order(text: bytes) -> list[int]:
    """The starts of all suffixes in lexicographic order.

    The suffixes that end their Lyndon prefix where suffix ``i`` begins are
    ``i - 1`` and its previous smaller ones that are not placed yet.  Taking
    the ``i`` in order places every group's members in order.
    """
    groups, smaller = lyndon_groups(text)
    n, at = len(text), 0
    group, free = [0] * n, []
    for g, m in enumerate(groups):
        free.append(at)
        at += len(m)
        for i in m:
            group[i] = g
    order, placed = [0] * n, bytearray(n)
    j, k = n - 1, 0                       # the empty suffix comes first
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
        if k == n:
            return order
        j = order[k] - 1
        k += 1


def repeated_windows(regions: list[bytes], weights: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each region the ranges (first, last) of the starts of windows that
    occur twice or more among all regions, each counted with its weight."""
    joined = b"\xff".join(regions)        # a byte that UTF-8 never has
    weight, place = [0] * len(joined), 0
    for r, w in zip(regions, weights, strict=True):
        runs = len(r) - length + 1
        weight[place:place + runs] = [w] * runs
        place += len(r) + 1
    hit = np.zeros(len(joined), bool)
    same: list[int] = []
    window, total = None, 0
    for i in suffix_order(joined):
        if not weight[i]:
            continue
        found = joined[i:i + length]
        if found != window:
            if total > 1:
                hit[same] = True
            same, window, total = [], found, 0
        same.append(i)
        total += weight[i]
    if total > 1:
        hit[same] = True
    out, place = [], 0
    for r in regions:
        edge = np.flatnonzero(np.diff(hit[place:place + len(r)].astype(np.int8), prepend=0, append=0))
        out.append([(int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)])
        place += len(r) + 1
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of leading bytes that are equal."""
    n = min(len(x), len(y))
    differs = x[:n] != y[:n]
    at = int(differs.argmax()) if n else 0
    return at if n and differs[at] else n


def shared_extents(regions: list[bytes], at: list[int]) -> list[tuple[int, int]]:
    """The part (start, end) of each region around its place ``at`` that holds
    all it has in common there with any other one."""
    out = [[a, a] for a in at]
    for side, parts in enumerate(([r[:a][::-1] for r, a in zip(regions, at, strict=True)],
                                  [r[a:] for r, a in zip(regions, at, strict=True)])):
        order = sorted(range(len(parts)), key=parts.__getitem__)    # the most in common: neighbours
        most = [0] * len(parts)
        for i, j in zip(order, order[1:], strict=False):
            n = _common(np.frombuffer(parts[i], np.uint8), np.frombuffer(parts[j], np.uint8))
            most[i], most[j] = max(most[i], n), n
        for i, n in enumerate(most):
            out[i][side] += n if side else -n
    return [(a, z) for a, z in out]


# -- anchors ----------------------------------------------------------------

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` to the powers 1..n modulo 2^64, and their inverses."""
    inverse = pow(BASE, -1, 1 << 64)
    return np.cumprod(np.full(n, BASE, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


def string_hashes(b: np.ndarray, k: int, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The hash of the ``k`` bytes that start at each place."""
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=total[1:])
    h = (total[k:] - total[:-k]) * inverse[:len(b) - k + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: np.ndarray, k: int, length: int, power: np.ndarray, inverse: np.ndarray,
            longest: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of ``text`` (hash, first, last) whose least ``k``-byte
    hash is the same, and the places in the run where it stands; long texts
    are taken in pieces of ``piece`` windows."""
    width = length - k + 1
    for at in range(0, len(text) - length + 1, piece):
        b = text[at:at + piece + length - 1]
        h = string_hashes(b, k, power, inverse)
        blocks = -(-len(h) // width)
        table = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        table[:len(h)] = h
        table = table.reshape(blocks, width)
        ahead = np.minimum.accumulate(table, 1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        n = len(h) - width + 1
        least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        if int((last - first).max()) >= longest:
            cuts = [np.arange(a, z + 1, longest) for a, z in zip(first, last, strict=True)]
            first = np.concatenate(cuts)
            last = np.concatenate([first[1:], [n]]) - 1
        # a window that starts with its least string is the last to hold it there
        again = np.concatenate([[False], (h[:n - 1] == least[:-1]) & (least[1:] == least[:-1])]).cumsum()
        yield least[first].view(np.int64), first + at, last + at, 1 + again[last] - again[first]


def equal_runs(text: np.ndarray, found, length: int):
    """The runs of one text (see :func:`anchors`) with one row for those of
    equal bytes, and the further starts of each (None: it stands once)."""
    h, first, last, times = found
    if len(set(h.tolist())) == len(h):
        return found, [None] * len(h)
    rows: dict[bytes, list[int]] = {}
    for j, (a, z) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        rows.setdefault(text[a:z + length].tobytes(), []).append(j)
    one = np.array([own[0] for own in rows.values()])
    return (h[one], first[one], last[one], np.array([times[own].sum() for own in rows.values()])), \
        [first[own[1:]].tolist() or None for own in rows.values()]


def _anchor_rows(texts: DataFrame, k: int, length: int) -> DataFrame:
    """(h, s1, s2, weight, first, last, again) of all texts; a run counts as
    often as its least string stands in it.  Equal runs of a text are one row:
    ``again`` are their further starts."""
    longest, piece = 1 if k == length else LONGEST_RUN, PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, inverse = powers(piece + length)
        for batch in batches:
            s1, s2, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*PARTS, "weight"))
            rows, of, again = [], [], []
            size = 0
            for i, t in enumerate(batch.column("text")):
                b = np.frombuffer(t.as_buffer(), np.uint8)
                for found in anchors(b, k, length, power, inverse, longest, piece):
                    found, more = equal_runs(b, found, length)
                    again += more
                    size += sum(map(len, filter(None, more)))
                    rows.append(found)
                    of.append(np.full(len(found[0]), i))
                    size += len(found[0])
                if size > 100_000:
                    yield out(rows, np.concatenate(of), again, s1, s2, weight)
                    rows, of, again, size = [], [], [], 0
            if rows:
                yield out(rows, np.concatenate(of), again, s1, s2, weight)

    def out(rows, of, again, s1, s2, weight) -> pa.RecordBatch:
        h, first, last, times = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int64()) for x in (h, s1[of], s2[of], weight[of] * times, first, last)],
             pa.array(again, pa.list_(pa.int64()))],
            names=["h", *PARTS, "weight", "first", "last", "again"])

    return texts.select(*PARTS, "weight", "text").mapInArrow(
        common.lean(cut), "h long, s1 long, s2 long, weight long, first long, last long, again array<long>")


def _cut_regions(found: DataFrame, length: int) -> DataFrame:
    """(s1, s2, weight, h, first, again, region) of the runs of every text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, weight = (batch.column(c).to_pylist() for c in (*PARTS, "weight"))
            rows, size = [], 0
            for i, (t, runs) in enumerate(zip(batch.column("text"), batch.column("runs"), strict=True)):
                b = t.as_py()
                for run in runs.as_py():
                    rows.append((s1[i], s2[i], weight[i], run["h"], run["first"], run["again"], b[run["first"]:run["last"] + length]))
                    size += len(rows[-1][-1])
                if size > 1 << 23:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    def out(rows) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=[*PARTS, "weight", "h", "first", "again", "region"])

    return found.mapInArrow(common.lean(cut), "s1 long, s2 long, weight long, h long, first long, again array<long>, region binary")


RANGES = "array<struct<a: long, z: long>>"
RANGE_LIST = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))


def _sort_groups(regions: DataFrame, length: int, k: int) -> DataFrame:
    """(r1, r2, ranges): the repeated windows of every open region that has
    any, from one suffix array for each hash of ``k`` bytes."""
    longest = LONGEST_RUN

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group = None, []
        factors = powers(longest + length)
        found: list[tuple[int, int, list[dict]]] = []
        for batch in batches:
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "r1", "r2", "weight", "region")), strict=True):
                if h != name and group:
                    found += windows(name, group, factors)
                    group = []
                name = h
                group.append(row)
            if len(found) > 10_000:
                yield out(found)
                found = []
        if group:
            found += windows(name, group, factors)
        if found:
            yield out(found)

    def windows(h, group, factors) -> Iterator[tuple[int, int, list[dict]]]:
        if min(row[2] for row in group) > 1:
            return
        places = [np.flatnonzero(string_hashes(np.frombuffer(row[3], np.uint8), k, *factors).view(np.int64) == h)
                  for row in group] if k < length else []
        # where the string stands once in each, equal windows hold it at the same place
        if places and all(len(p) == 1 for p in places):
            extents = shared_extents([row[3] for row in group], [int(p[0]) for p in places])
            group = [(*row[:3], row[3][a:z], a) for row, (a, z) in zip(group, extents, strict=True) if z - a >= length]
            if len(group) < 2:
                return
        else:
            group = [(*row, 0) for row in group]
        if min(row[2] for row in group) > 1:
            return
        r1, r2, weights, bodies, starts = zip(*group, strict=True)
        for i, own in enumerate(repeated_windows(bodies, weights, length)):
            if own and weights[i] == 1:
                yield r1[i], r2[i], [{"a": a + starts[i], "z": z + starts[i]} for a, z in own]

    def out(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), RANGE_LIST], strict=True)],
            names=["r1", "r2", "ranges"])

    dealt = regions.select("h", "r1", "r2", "weight", "region").repartition("h").sortWithinPartitions("h", "r1", "r2")
    return dealt.mapInArrow(common.lean(sort), f"r1 long, r2 long, ranges {RANGES}")


def _merge(ranges: DataFrame) -> DataFrame:
    """(s1, s2, ranges) of each text: its ranges of starts, joined where they
    meet."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"a": a, "z": z - 1} for a, z in merged(r, 1)] for r in batch.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), pa.array(out, RANGE_LIST)],
                                             names=[*PARTS, "ranges"])

    return ranges.groupBy(*PARTS).agg(F.flatten(F.collect_list("ranges")).alias("ranges")).mapInArrow(
        common.lean(merge), f"s1 long, s2 long, ranges {RANGES}")


# -- levels -----------------------------------------------------------------

def ladder(length: int) -> list[int]:
    """Bytes of an anchor at each level; the last is the window itself."""
    return sorted({max(1, length * share // 100) for share in (16, 58, 85, 95, 99, 100)})


def _whole(text: str, length: int) -> F.Column:
    """The range of all windows of a text."""
    last = F.octet_length(text).cast("long") - length
    return F.array(F.struct(F.lit(0).cast("long").alias("a"), last.alias("z"))).alias("ranges")


def _level(texts: DataFrame, length: int, ks: list[int], most: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (s1, s2, weight, text): those with candidate runs, one row for
    equal ones, and the ranges of starts of repeated windows (s1, s2, ranges)
    of the open ones, whose weight is 1."""
    runs = common.stored(_anchor_rows(texts, ks[0], length))
    # stored, so that a hot hash can be split in the join
    often = common.stored(runs.groupBy("h").agg(F.sum("weight").alias("n")).where("n > 1").select("h"))
    runs = runs.join(often, "h", "left_semi").groupBy(*PARTS).agg(
        F.collect_set(F.struct("h", "first", "last", "again")).alias("runs"))
    once = texts.groupBy(*PARTS).agg(F.first("text").alias("text"), F.sum("weight").alias("weight"))
    found = common.stored(once.join(runs, PARTS))
    key = [F.xxhash64(F.lit(1), "region").alias("r1"), F.xxhash64(F.lit(2), "region").alias("r2")]
    regions = common.stored(_cut_regions(found, length).select("*", *key))
    distinct = common.stored(regions.groupBy("r1", "r2").agg(
        F.first("h").alias("h"), F.first("region").alias("region"),
        F.sum(F.col("weight") * (1 + F.when(F.col("again").isNull(), 0).otherwise(F.size("again")))).alias("weight")))
    hot = distinct.groupBy("h").agg(F.sum(F.octet_length("region")).alias("bytes"), F.min("weight").alias("least"))
    hot = common.stored(hot.where((F.col("bytes") > most) & (F.col("least") == 1)).select("h"))
    whole = distinct.where("weight > 1").select("r1", "r2", _whole("region", length))
    if len(ks) == 1 or hot.isEmpty():
        windows = whole.union(_sort_groups(distinct, length, ks[0]))
    else:
        large = distinct.join(hot, "h", "left_semi").select(
            F.col("r1").alias("s1"), F.col("r2").alias("s2"), "weight", F.col("region").alias("text"))
        windows = whole.union(_sort_groups(distinct.join(hot, "h", "left_anti"), length, ks[0])).union(
            _level(common.stored(large), length, ks[1:], most)[1])
    windows = common.stored(windows)
    starts = F.concat(F.array("first"), F.coalesce("again", F.array().cast("array<long>"))).alias("starts")
    members = regions.where("weight = 1").select(*PARTS, starts, "r1", "r2").join(windows, ["r1", "r2"])
    moved = F.flatten(F.transform("starts", lambda s: F.transform("ranges", lambda r: F.struct(
        (r["a"] + s).alias("a"), (r["z"] + s).alias("z")))))
    return found, _merge(members.select(*PARTS, moved.alias("ranges")))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, most: int = MOST_BYTES) -> DataFrame:
    """(k1, k2, spans, kept) of every text that has repeated strings: its
    content key, the maximal removed runs (start, end) and what is left."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(body.alias("text")).select(
        F.xxhash64(F.lit(1), "text").alias("s1"), F.xxhash64(F.lit(2), "text").alias("s2"),
        F.lit(1).cast("long").alias("weight"), "text")
    found, ranges = _level(texts, length, ladder(length), most)
    ranges = ranges.union(found.where("weight > 1").select(*PARTS, _whole("text", length)))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for t, r in zip(batch.column("text"), batch.column("ranges"), strict=True):
                own = merged(r.as_py(), length)
                spans.append([{"start": a, "end": z} for a, z in own])
                kept.append(b"".join(_between(t.as_py(), own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("s1"), batch.column("s2"),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["k1", "k2", "spans", "kept"])

    return found.select(*PARTS, "text").join(ranges, PARTS).mapInArrow(
        common.lean(remove), "k1 long, k2 long, spans array<struct<start: long, end: long>>, kept binary")


def merged(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows whose starts are in ``ranges``."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((r["a"], r["z"] + length) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _between(text: bytes, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    at = 0
    for a, z in spans:
        yield text[at:a]
        at = z
    yield text[at:]


def deduplicate(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH,
                most: int = MOST_BYTES) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_bytes, n_removed,
    n_spans and kept_sha256."""
    spans = repeated_spans(docs, text, length, most)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digests = spans.select("k1", "k2", removed.alias("_removed"), F.size("spans").cast("long").alias("_spans"),
                           F.sha2("kept", 256).alias("_sha"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # keep may name a column as one of ours: nested until the end
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), body.alias("_body")).select(
        "_keep", F.octet_length("_body").cast("long").alias("n_bytes"), F.sha2("_body", 256).alias("_plain"),
        F.xxhash64(F.lit(1), "_body").alias("k1"), F.xxhash64(F.lit(2), "_body").alias("k2"))
    return rows.join(digests, ["k1", "k2"], "left").select(
        *[F.col(f"_keep.{c}") for c in keep], "n_bytes",
        F.coalesce("_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("_sha", "_plain").alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.read(spark, sf_dir, "documents"), ["doc_id"])
