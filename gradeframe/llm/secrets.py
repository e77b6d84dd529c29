"""Secret scan with character Markov models, in DataFrame functions only.

Base spans come from three patterns (assignments, access keys, hex runs).  The
method adds spans of kind ``markov``: every run of 20 or more key characters
is scored by two first-order character models, one of random strings and one
of ordinary identifiers, and reported when the mean log-likelihood ratio per
character pair reaches ``THRESHOLD``.

The models are trained from labelled samples, bounded by ``SAMPLE_DOCS`` and
``SAMPLE_RANDOM``: values that the assignment pattern labels as secrets and
encoded digests are random; the words of a sample of distinct texts, as they
are and joined into identifiers (also with digits), its numbers and other short
runs with digits or joiners, and coined numbers, dates and rule lines are
ordinary.  Both models are smoothed against one pooled background model, so a
pair that either knows little of counts little.  Everything else covers all
rows, and runs of any length.

Offsets are found without a Python function: the lengths of what a pattern
leaves between its matches, and of the matches, are summed up in blocks.

Null and empty texts have no spans; every row gives one row, repeated rows
included; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "markov"]
SAMPLE_DOCS = 200
SAMPLE_RANDOM = 5_000
THRESHOLD = 0.75           # nats per character pair
UNIT = 1000                # weights are whole thousandths of a nat
FIRST, WIDTH = 43, 80      # '+' .. 'z'
BLOCK = 256
TRUST, KNOWN = 0.995, 50   # most weight of a model against the background; pairs at which it is half of that
LONGEST = 200              # characters of a training string


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _before(values: Column, i: Column, blocks: Column) -> Column:
    """Sum of the first ``i`` of ``values``, whose blocks' sums are given."""
    b = F.floor(i / BLOCK).cast("int")
    return (_total(F.slice(blocks, F.lit(1), b))
            + _total(F.slice(values, b * BLOCK + 1, i - b * BLOCK)))


def with_matches(df: DataFrame, text: str, name: str, pattern: str, value_group: int = 0) -> DataFrame:
    """Add ``name``: array of (start, end, value) of the pattern's matches,
    leftmost and not overlapping, in code points."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    hit = t.rlike(pattern)
    df = (df.withColumn("_all", F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
          .withColumn("_value", F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(value_group))).otherwise(none))
          .withColumn("_gap", F.when(hit, F.split(t, pattern, -1)).otherwise(none)))
    df = (df.withColumn("_len", F.transform("_all", F.length))
          .withColumn("_gap", F.transform("_gap", F.length)))
    df = df.withColumn("_step", F.transform("_len", lambda n, i: n + F.get("_gap", i)))
    n_blocks = F.ceil(F.size("_step") / BLOCK).cast("int")
    df = df.withColumn("_blocks", F.when(n_blocks > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1),
        lambda b: _total(F.slice(F.col("_step"), b * BLOCK + 1, BLOCK)))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_start", F.transform(
        "_len", lambda n, i: _before(F.col("_step"), i, F.col("_blocks")) + F.get("_gap", i)))
    spans = F.transform("_start", lambda s, i: F.struct(
        s.alias("start"), (s + F.get("_len", i)).alias("end"), F.get("_value", i).alias("value")))
    return df.withColumn(name, spans).drop("_all", "_value", "_gap", "_len", "_step", "_blocks", "_start")


def pair_counts(strings: DataFrame, column: str) -> DataFrame:
    """How often each pair of neighbouring key characters stands in strings."""
    s = F.substring(F.regexp_replace(column, "[^A-Za-z0-9+/_-]", ""), 1, LONGEST)
    pairs = (strings.select(s.alias("s")).where("length(s) > 1")
             .select("s", F.explode(F.expr("sequence(1, length(s) - 1)")).alias("i")))
    code = F.expr(f"(ascii(substr(s, i, 1)) - {FIRST}) * {WIDTH} + ascii(substr(s, i + 1, 1)) - {FIRST}")
    return pairs.groupBy(code.cast("int").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def labelled_samples(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Random strings and ordinary identifiers, one per row."""
    spark = docs.sparkSession
    hashed = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    chosen = common.checkpoint(hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS))
    sample = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).select("text")
    sample = common.checkpoint(sample)
    found = sample.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("s")).where("length(s) >= 16")
    digest = spark.range(SAMPLE_RANDOM).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hex"))
    encoded = F.regexp_replace(F.base64(F.unhex("hex")), "=", "")
    coined = digest.select(F.explode(F.array(
        F.substring("hex", 1, 40), encoded, F.regexp_replace(encoded, "[+/]", ""), F.upper(F.regexp_replace(encoded, "[+/]", "")))).alias("s"))
    words = sample.select(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 1).alias("w"))
    words = words.select(F.array_distinct("w").alias("w"))

    def pairs(mark: str, shape):
        """Every word joined to the next."""
        return F.transform("w", lambda w, i: F.concat_ws(mark, shape(w), shape(F.get("w", i + 1))))

    def numbered(mark: str):
        """Every eighth word with a number, and some with the next one after it."""
        n = F.pmod(F.xxhash64("w"), F.lit(100)).cast("string")
        return F.transform("w", lambda w, i: F.when(i % 8 == 0, F.concat(
            w, F.lit(mark), n, F.when(i % 32 == 0, F.get("w", i + 1)).otherwise(""))))

    ordinary = words.select(F.explode(F.concat(
        F.col("w"), pairs("_", F.lower), pairs("-", F.lower), pairs("/", F.lower), pairs("", F.initcap), pairs("_", F.upper),
        numbered(""), numbered("_"))).alias("s")).where("s is not null")
    # runs with digits or joiners that are no secrets: short ones, and long ones without letters
    plain = F.regexp_replace("text", ASSIGN, " ")
    runs = sample.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_-]{2,}"), F.lit(0))).alias("s"))
    runs = runs.where(F.col("s").rlike("[0-9+/_-]") & ((F.length("s") < 20) | ~F.col("s").rlike("[A-Za-z]")))
    number = F.pmod(F.xxhash64("id"), F.lit(10 ** 17)).cast("string")
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit("day")), F.lit(15_000)).cast("int"))
    clock = F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit("time")), F.lit(2 * 10 ** 9)))
    written = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(
        number, F.date_format(day, "yyyy-MM-dd/yyyy-MM-dd"), F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "dd-MM-yyyy"),
        F.date_format(clock, "yyyyMMddHHmmss"), F.date_format(clock, "yyyy-MM-dd'T'HH-mm-ss"), F.date_format(clock, "yyyyMMdd_HHmmss"),
        F.concat(F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 4), F.lit("-"), F.substring(number, 8, 4)))).alias("s"))
    rules = spark.range(SAMPLE_RANDOM // 50).select(F.explode(F.array(
        *[F.lit(c * 60) for c in "-_/+"], *[F.lit(m * 20) for m in ("-+", "--+", "_-", "/-", "__/")])).alias("s"))
    return coined.unionAll(found), ordinary.unionAll(runs).unionAll(written).unionAll(rules)


def train(docs: DataFrame) -> list[int]:
    """Weight of every pair: log of its probability after its first character
    among random strings over that among identifiers."""
    random, ordinary = labelled_samples(docs)
    both = (pair_counts(random, "s").withColumn("kind", F.lit(0))
            .unionAll(pair_counts(ordinary, "s").withColumn("kind", F.lit(1))))
    counts = [[0] * (WIDTH * WIDTH) for _ in range(2)]
    for r in both.collect():               # 2 * WIDTH**2 rows at most
        counts[r["kind"]][r["pair"]] += r["n"]
    weights = []
    for first in range(WIDTH):
        rows = [c[first * WIDTH:(first + 1) * WIDTH] for c in counts]
        seen = min(map(sum, rows))
        trust = TRUST * seen / (seen + KNOWN)
        shares = [[n / max(sum(row), 1) for n in row] for row in rows]
        for x, y in zip(*shares):
            background = (x + y) / 2 + 0.5 / WIDTH / (seen + KNOWN)
            weights.append(round(UNIT * (math.log(trust * x + (1 - trust) * background)
                                         - math.log(trust * y + (1 - trust) * background))))
    return weights


def score(token: Column, weights: Column) -> Column:
    """Sum of the weights of a string's pairs of neighbouring characters."""
    def code(part, i):
        return F.ascii(part.substr(i, F.lit(1))) - FIRST

    # in blocks, since a place in a string is found from its start; each with the next one's first character
    parts = F.regexp_extract_all(token, F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
    linked = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(parts, i + 1).substr(1, 1), F.lit(""))))

    def total(part):
        return F.when(F.length(part) > 1, F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(2)) - 1), F.lit(0).cast("long"),
            lambda a, i: a + F.get(weights, code(part, i) * WIDTH + code(part, i + 1)))).otherwise(F.lit(0).cast("long"))

    return F.aggregate(linked, F.lit(0).cast("long"), lambda a, p: a + total(p))


def find_spans(docs: DataFrame, weights: list[int], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one array of (start, end, value) per kind."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    df = with_matches(docs, text, "assign", ASSIGN, 2)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_VALUE))
    df = with_matches(df, text, "access", ACCESS)
    df = with_matches(df, text, "hex", HEX)
    df = with_matches(df, text, "markov", CANDIDATE)
    limit = F.lit(round(threshold * UNIT)).cast("long")
    return df.withColumn("markov", F.filter(
        "markov", lambda s: score(s["value"], table) >= limit * (F.length(s["value"]) - 1)))


def ordered(kinds: list[str]) -> Column:
    """All spans of some kinds: (start, rank of the kind, end), in order."""
    def ranked(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*map(ranked, kinds)))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, weights: list[int], mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by a mark;
    n_chars follows where the text has changed."""
    columns = docs.columns
    df = find_spans(docs.withColumn("_t", F.coalesce("text", F.lit(""))), weights, "_t").withColumn("_s", ordered(KINDS))
    # what lies before each span and after all spans that start before it
    reach = F.transform("_s", lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(F.col("_s"), F.lit(1), i), lambda p: p["end"])), F.lit(0)))
    df = df.withColumn("_reach", reach).withColumn("_end", F.array_max(F.transform("_s", lambda s: s["end"])))
    parts = F.transform("_s", lambda s, i: F.when(
        s["start"] >= F.get("_reach", i),
        F.concat(F.col("_t").substr(F.get("_reach", i) + 1, s["start"] - F.get("_reach", i)), F.lit(mark))).otherwise(""))
    new = F.concat(F.array_join(parts, ""), F.col("_t").substr(F.col("_end") + 1, F.length("_t")))
    changed = F.size("_s") > 0
    df = df.withColumn("text", F.when(changed, new).otherwise(F.col("text")))
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*columns)


def op4_markov_secrets(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_spans(docs, train(docs))
    found = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                         joined(ordered(KINDS[:3])).alias("base"), joined(ordered(KINDS)).alias("spans"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_markov")
