"""Benchmark decontamination with a distributed positional inverted index.

Every benchmark item is cut into windows of ten words (a shorter item is one
window).  The terms of the windows are counted in all training texts; a
window's rarest terms are its anchors (of those that occur: a window with a
term that occurs nowhere has proximity matches only).  The index stores, for the anchor terms
of all windows, the postings of the training texts: the text's 128-bit key and
the term's word position (and, for a window's rarest term, the words around
it).  Each posting of a window's rarest term implies a start of the window;
where the words around it spell the window, that is an exact phrase match, which
the stored words alone decide.  For proximity the other anchors' lists, held as
bits of positions, are intersected with these starts: matches are windows whose
anchors point at starts within one of the half-overlapping stretches of twice
``SLOP`` words.

All of it is DataFrame functions: no Python runs on the executors.  Windows,
terms and anchors grow with the benchmark alone; they are broadcast up to
``BROADCAST_WINDOWS`` windows (a count that is checked) and joined by shuffle
beyond.  Copies of a text share one key, so their matches meet after a
map-side aggregation and a hot text makes no hot group.

Null and empty texts (and texts without words) have no words and are clean;
every row of the documents gives one row, repeated rows included; items that
are null or without words match nothing; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 10
ANCHORS = 3
SLOP = 20
BROADCAST_WINDOWS = 200_000
BIN = 64
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"       # A-Z are lower-cased, so no separators


def lowered(word: Column) -> Column:
    """A-Z in lower case and no other character changed."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return (F.when(ascii_only, F.lower(word))
            .when(word.rlike("[A-Z]"), F.translate(word, string.ascii_uppercase, string.ascii_lowercase)).otherwise(word))


def split_words(df: DataFrame, text: str) -> DataFrame:
    """Add ``parts`` (the text between separators, in its own case: an empty
    first or last part is no word), ``skip`` (1 if the first is empty) and
    ``n_words``."""
    df = df.withColumn("parts", F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS, -1))
    df = df.withColumn("skip", (F.element_at("parts", 1) == "").cast("int"))
    last = ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    return df.withColumn("n_words", F.size("parts") - F.col("skip") - last)


class Benchmark:
    """Windows of the test items: ``windows`` (win, phrase, size),
    ``items`` (win, item_id) and ``slots`` (win, term, offset)."""

    def __init__(self, benchmark: DataFrame, width: int = WINDOW):
        items = split_words(benchmark.select("item_id", "text"), "text").where("n_words > 0")
        items = items.select("item_id", "n_words", F.transform(F.expr("slice(parts, skip + 1, n_words)"), lowered).alias("w"))
        cut = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - width, F.lit(0)))).alias("i"))
        cut = common.checkpoint(cut.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, width), " ").alias("phrase")).distinct())
        numbered = cut.select("phrase").distinct().withColumn("win", F.monotonically_increasing_id())
        self.windows = common.checkpoint(numbered.withColumn("terms", F.split("phrase", " "))
                                         .withColumn("size", F.size("terms")))
        self.items = cut.join(self.windows.select("win", "phrase"), "phrase").select("win", "item_id")
        self.slots = self.windows.select("win", F.posexplode("terms").alias("offset", "term"))
        self.small = common.small_enough(self.windows, BROADCAST_WINDOWS)

    def sent(self, df: DataFrame) -> DataFrame:
        """A table that grows with the benchmark, as one side of a join."""
        return F.broadcast(df) if self.small else df


def anchors(docs: DataFrame, bench: Benchmark, count: int = ANCHORS) -> DataFrame:
    """The rarest of the terms that occur, for every window that has ``count``
    of them or as many as it is long: win, term, offset, rank (0: rarest), need
    (a bit for each of the window's anchors) and whole (whether all its terms
    occur; no exact match without)."""
    terms = bench.slots.select("term").distinct()
    parts = F.split(F.coalesce(docs["text"], F.lit("")), SEPARATORS, -1)
    # explode_outer: a plain explode is given a filter that splits every text again
    said = docs.select(F.explode_outer(parts).alias("part")).select(lowered(F.col("part")).alias("term"))
    seen = common.checkpoint(said.join(bench.sent(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    known = bench.slots.join(bench.sent(seen), "term", "left")
    by_win = Window.partitionBy("win")
    known = known.withColumn("size", F.count(F.lit(1)).over(by_win)).withColumn("left", F.count("n").over(by_win))
    ranked = (known.where(F.col("n").isNotNull() & (F.col("left") >= F.least(F.lit(count), "size")))
              .withColumn("whole", F.col("left") == F.col("size"))
              .withColumn("rank", F.row_number().over(by_win.orderBy("n", "offset")) - 1).where(F.col("rank") < count))
    return common.checkpoint(ranked.withColumn("need", F.sum(F.expr("shiftleft(1, rank)")).over(by_win))
                             .select("win", "term", "offset", "rank", "need", "whole"))


def build_index(docs: DataFrame, bench: Benchmark, anchored: DataFrame, ids: list[str]) -> DataFrame:
    """The postings of the anchor terms, stored in the shared folder, and one
    row with ``first`` for every document: ``ids``, the text's key, n_words,
    position, term and, for rarest terms, the words around."""
    terms = anchored.groupBy("term").agg(F.min("rank").alias("best"))
    words = split_words(docs.select(*ids, F.coalesce("text", F.lit("")).alias("text")), "text")
    words = words.select(*ids, *common.content_key("text"), "parts", "skip", "n_words")
    every = words.select(*ids, "k1", "k2", "parts", "skip", "n_words", F.posexplode_outer("parts").alias("at", "part"))
    every = every.withColumn("term", lowered(F.col("part")))
    found = every.join(bench.sent(terms), "term", "left").where("best is not null or at = 0")
    left = F.greatest(F.col("at") - (WINDOW - 1), F.col("skip"))
    around = F.array_join(F.slice("parts", left + 1, F.col("at") - left + WINDOW), " ")
    return common.checkpoint(found.select(
        *ids, "k1", "k2", "n_words", (F.col("at") == 0).alias("first"), (F.col("at") - F.col("skip")).alias("pos"),
        F.when(F.col("best").isNotNull(), F.col("term")).alias("term"),
        F.when(F.col("best") == 0, lowered(around)).alias("around"), (left - F.col("skip")).alias("left")))


def leads(index: DataFrame, bench: Benchmark, anchored: DataFrame) -> DataFrame:
    """The postings of the rarest terms as the starts that they imply: the
    text's key, win, start, need and whether the words around spell the window."""
    windows = bench.windows.select("win", "phrase", "size")
    rarest = anchored.where("rank = 0").select("win", "term", "offset", "need").join(bench.sent(windows), "win")
    rows = (index.where("around is not null").select("k1", "k2", "term", "pos", "around", "left")
            .join(bench.sent(rarest), "term").withColumn("start", F.col("pos") - F.col("offset")))
    inside = (F.col("start") >= 0) & (F.col("start") >= F.col("left"))
    there = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("left") + 1, F.col("size")), " ")
    spelt = F.when(inside, there == F.col("phrase")).otherwise(False)
    return rows.select("k1", "k2", "win", "start", "need", "size", spelt.alias("spelt")).distinct()


def matches(index: DataFrame, bench: Benchmark, anchored: DataFrame, proximity: bool, slop: int = SLOP) -> DataFrame:
    """The text's key, win, start, size, exact and near of the leads that match.

    The lists of the other anchors are kept as one bit per position, ``BIN``
    positions to a row, and looked up where a lead wants them: at their exact
    place, and within either of the two half-overlapping stretches of twice
    ``slop`` words that hold the lead."""
    lists = (index.where("term is not null").withColumn("bin", F.floor(F.col("pos") / BIN))
             .groupBy("k1", "k2", "term", "bin").agg(F.expr(f"bit_or(shiftleft(1L, pos % {BIN}))").alias("bits")))
    lead = common.checkpoint(leads(index, bench, anchored))
    others = anchored.where("rank > 0").select("win", "term", "offset", "rank")
    place = F.col("start") + F.col("offset")
    cell = F.floor(F.col("start") / slop) * slop + F.col("offset")      # where the lead's first stretch has its middle
    low, high = (F.greatest(cell - slop, F.lit(0)), cell + 2 * slop) if proximity else (place, place + 1)
    wanted = lead if proximity else lead.where("spelt")
    wanted = (wanted.join(bench.sent(others), "win").withColumn("bin", F.explode(F.sequence(F.floor(low / BIN), F.floor((high - 1) / BIN)))))

    def has(start: Column, end: Column) -> Column:
        """Whether the row's list has a position from ``start`` to before ``end``."""
        a = F.greatest(start - F.col("bin") * BIN, F.lit(0)).cast("int")
        b = F.least(end - F.col("bin") * BIN, F.lit(BIN)).cast("int")
        span = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), BIN - (b - a)), a)
        return F.when(b > a, F.col("bits").bitwiseAND(span) != 0).otherwise(False)

    def bit(yes: Column) -> Column:
        return F.when(yes, F.call_function("shiftleft", F.lit(1), F.col("rank"))).otherwise(0)

    found = wanted.join(lists, ["k1", "k2", "term", "bin"]).select(
        "k1", "k2", "win", "start", "need", "size", bit(has(place, place + 1)).alias("exact"),
        bit(has(cell - slop, cell + slop)).alias("first"), bit(has(cell, cell + 2 * slop)).alias("second"))
    own = lead.select("k1", "k2", "win", "start", "need", "size", F.col("spelt").cast("int").alias("exact"),
                      F.lit(1).alias("first"), F.lit(1).alias("second"))
    met = (own.unionByName(found).groupBy("k1", "k2", "win", "start", "need", "size")
           .agg(*[F.bit_or(c).alias(c) for c in ("exact", "first", "second")]))
    exact, near = F.col("exact") == F.col("need"), (F.col("first") == F.col("need")) | (F.col("second") == F.col("need"))
    return (met.select("k1", "k2", "win", "start", "size", exact.alias("exact"), near.alias("near"))
            .where((F.col("exact") | F.col("near")) if proximity else F.col("exact")))


def contamination(docs: DataFrame, benchmark: DataFrame, ids: list[str], proximity: bool = True) -> DataFrame:
    """One row per document: ``ids``, the text's key, n_words, n_hit, n_items,
    the item ids (sorted as strings) and n_near, the windows that match by
    proximity only."""
    bench = Benchmark(benchmark)
    anchored = anchors(docs, bench)
    if not proximity:
        anchored = anchored.where("whole")
    index = build_index(docs, bench, anchored, ids)
    found = common.checkpoint(matches(index, bench, anchored, proximity))
    exact = found.where("exact")
    hit = (exact.groupBy("k1", "k2", "start").agg(F.max("size").alias("size"))
           .select("k1", "k2", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
           .distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (exact.select("k1", "k2", "win").distinct().join(bench.sent(bench.items), "win")
             .select("k1", "k2", F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("items")))   # a document's share of the benchmark
    rows = index.where("first").select(*ids, "k1", "k2", "n_words").join(hit, ["k1", "k2"], "left").join(named, ["k1", "k2"], "left")
    if proximity:
        near = (found.groupBy("k1", "k2", "win").agg(F.max("exact").alias("exact")).where("not exact")
                .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_near")))
        rows = rows.join(near, ["k1", "k2"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    return (rows.withColumn("n_words", F.col("n_words").cast("long"))
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))


def op7_positional_index(spark, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")


ORACLE_SQL = None
