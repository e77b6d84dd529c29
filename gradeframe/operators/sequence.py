"""Per-learner sequence operators: segmentation, first/dedupe, next-step
alignment, sequence assembly, padding, batching, splits and sampling
(W1-W7, W10, T1-T6).

Numbering inside a student uses :func:`sequence_number`, which spreads a
student holding a large share of all rows over ranges of the whole order, so
no single task has to sort a hot student.  Per-segment windows and collects
are bounded by ``max_len`` (a segment never holds more rows than that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.operators.ordered import sequence_number


def segment_records(df: DataFrame, student: str, order: list[str], max_len: int = 200,
                    seq_col: str = "seq_id", ranges: int | None = None) -> DataFrame:
    """Cut each student's ordered rows into segments of ``max_len``.

    k = 0-based position of the row in the student's order (ts, id: D4);
    timestep = k mod max_len, segment = k div max_len + 1,
    seq_id = "{student}_{segment}".
    """
    d = sequence_number(df, [student], order, "_k", ranges)
    k = F.col("_k") - 1
    return (d.withColumn("timestep", (k % max_len).cast("int"))
             .withColumn("segment", (F.floor(k / max_len) + 1).cast("int"))
             .withColumn(seq_col, F.concat_ws("_", F.col(student).cast("string"),
                                              F.col("segment").cast("string")))
             .drop("_k"))


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W3 (and W2): keep the first row per ``keys`` in ``order``.

    Implemented as ``min_by(struct(row), struct(order))`` in a
    sort aggregate, whose map-side partial step collapses a hot key before the
    shuffle (a window would send the whole group to one task).  NULL
    keys form one group, like pandas ``drop_duplicates``.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    ordk = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.min_by(row, ordk).alias("_first"))
              .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]))


def first_submission(df: DataFrame, student: str, problem: str, order: list[str]) -> DataFrame:
    """The first submission of each student to each problem."""
    return dedupe_first(df, [student, problem], order)


def next_step(df: DataFrame, seq: str, order: str, cols: list[str],
              prefix: str = "next_") -> DataFrame:
    """Features at t with the values of ``cols`` at t+1 in the same
    sequence (NULL at the last step).  Window partitions are segments, so
    at most ``max_len`` rows each."""
    w = Window.partitionBy(seq).orderBy(order)
    out = df
    for c in cols:
        out = out.withColumn(prefix + c, F.lead(c).over(w))
    return out


def to_sequences(df: DataFrame, seq: str, order: str, cols: list[str]) -> DataFrame:
    """One row per sequence with ordered arrays of ``cols``.  Group size
    is bounded by the segment length (W1), so the collect is bounded."""
    st = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"),
                                              *[F.col(c) for c in cols])))
    g = df.groupBy(seq).agg(st.alias("_s"))
    return g.select(seq, F.size("_s").alias("length"),
                    *[F.col(f"_s.{c}").alias(c) for c in cols])


def pad_array(col: str, length, fill) -> F.Column:
    """Right-pad an array column to ``length`` with ``fill`` (arrays
    longer than ``length`` are kept whole)."""
    c = F.col(col)
    n = F.greatest(F.lit(0), (F.lit(length) if isinstance(length, int) else length) - F.size(c))
    return F.concat(c, F.array_repeat(F.lit(fill), n))


def pad_sequences(seqs: DataFrame, cols: dict[str, object], length=None) -> DataFrame:
    """Pad every array in ``cols`` (name -> fill value: -100 for labels,
    0 for inputs, '' for strings) to ``length`` or, when None, to the
    longest array of any of them (a scalar subquery, no driver round trip)."""
    if length is None:
        length = seqs.select(F.max(F.greatest(F.lit(0), *[F.size(c) for c in cols]))).scalar()
    out = seqs
    for c, fill in cols.items():
        out = out.withColumn(c, pad_array(c, length, fill))
    return out


def pad_steps(seqs: DataFrame, nested: dict[str, object], flat: dict[str, object] | None = None,
              widths: dict[str, int] | None = None, length: int | None = None) -> DataFrame:
    """W6 in two dimensions: a batch's padded tensors.

    ``nested`` columns hold an array for each step (name -> fill value): every
    step is padded to the column's width (``widths``, or its longest step: the
    most tests of a problem, the length of a vector) and the sequence to the
    longest one with steps of fill values.  ``flat`` columns hold one value
    for each step and are padded to the same longest sequence.  Lengths are
    taken over all named columns, each null counting as empty; nothing is cut.
    All of them come from one aggregate of one row.
    """
    flat, widths = flat or {}, widths or {}
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in (*nested, *flat)]
    longest = [F.max(F.greatest(F.lit(0), *sizes)).alias("_steps")] + [
        F.max(F.aggregate(F.coalesce(c, F.array().cast(seqs.schema[c].dataType)), F.lit(0),
                          lambda n, x: F.greatest(n, F.size(x)))).alias(f"_w_{c}") for c in nested]
    sized = seqs.crossJoin(F.broadcast(seqs.agg(*longest)))              # one row
    steps = F.greatest(F.lit(length), F.col("_steps")) if length else F.col("_steps")

    def filled(array, kind, value, size) -> F.Column:
        whole = F.coalesce(array, F.array().cast(kind))
        return F.concat(whole, F.array_repeat(value, size - F.size(whole)))

    def padded(c: str, fill) -> F.Column:
        kind = seqs.schema[c].dataType
        if c in flat:
            return filled(F.col(c), kind, F.lit(fill).cast(kind.elementType), steps)
        width = F.greatest(F.lit(widths.get(c, 0)), F.col(f"_w_{c}"))
        value = F.lit(fill).cast(kind.elementType.elementType)
        whole = F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: filled(x, kind.elementType, value, width))
        return F.concat(whole, F.array_repeat(F.array_repeat(value, width), steps - F.size(whole)))

    return sized.withColumns({c: padded(c, fill) for c, fill in {**nested, **flat}.items()}).select(*seqs.columns)


def assign_batches(df: DataFrame, order: list[str], size: int, by: list[str] | None = None,
                   out: str = "batch", ranges: int | None = None) -> DataFrame:
    """Consecutive rows (in ``order``, within ``by``) form batches of
    ``size``; numbering is the skew-safe :func:`sequence_number`."""
    d = sequence_number(df, list(by or []), order, "_rn", ranges)
    return d.withColumn(out, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def state_at(states: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The knowledge state of each requested (student, step)."""
    return requests.join(states, keys, "left")


def unit_hash(cols: list[str], seed: int) -> F.Column:
    """A uniform value in [0, 1) from the text of ``cols``: the first 52 bits
    of an md5, which any engine gives alike."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def sample_n(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """A reproducible sample of ``n`` rows: the ``n`` smallest hashes of
    the row key (a top-k, planned as TakeOrderedAndProject)."""
    return df.withColumn("_h", unit_hash(key, seed)).orderBy("_h", *key).limit(n).drop("_h")


def split_by_hash(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 0,
                  out: str = "split") -> DataFrame:
    """T4 / T5 (hash form): train / valid / test by a hash of ``key``.  All
    rows of one key land in the same split; no shuffle at all."""
    u = unit_hash(key, seed)
    return df.withColumn(out, F.when(u >= test_size, "train")
                         .when(u < test_size / 2, "valid").otherwise("test"))


def split_exact(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 0,
                out: str = "split") -> DataFrame:
    """T4 / T5 (exact sizes, D5): distinct keys ranked by hash; the last
    ceil(n*test_size) keys are held out, of which ceil(m/2) are test and the
    rest valid.  The ranking is the skew-safe global numbering.  Rows with
    null keys are one key like any other."""
    keys = df.select(*key).distinct().withColumn("_h", unit_hash(key, seed))
    n = keys.select(F.count(F.lit(1))).scalar()
    ranked = sequence_number(keys, [], ["_h", *key], "_r")
    m = F.ceil(n * F.lit(test_size))
    t = F.ceil(m / 2)
    lab = (F.when(F.col("_r") <= n - m, "train")
            .when(F.col("_r") <= n - m + (m - t), "valid").otherwise("test"))
    ranked = ranked.select(*[F.col(c).alias(f"_key_{c}") for c in key], lab.alias(out))
    same = F.lit(True)
    for c in key:
        same = same & df[c].eqNullSafe(ranked[f"_key_{c}"])
    return df.join(ranked, same, "left").drop(*[f"_key_{c}" for c in key])


def problem_index(problems: DataFrame, id_col: str, out: str = "problem_ix") -> DataFrame:
    """Distinct problem ids -> dense 0-based index in id order."""
    d = problems.select(id_col).distinct()
    return sequence_number(d, [], [id_col], out).withColumn(out, F.col(out) - 1)


def time_major(seqs: DataFrame, batch: str, member_order: list[str], arrays: list[str],
               group: int = 2) -> DataFrame:
    """Inside every batch, members form micro-groups of ``group`` (in
    ``member_order``); each micro-group is regrouped time-major: one row per
    (batch, micro, t, member) with the member's values at step t.  Member
    numbering is per batch (a batch holds ``size`` members, bounded)."""
    w = Window.partitionBy(batch).orderBy(*member_order)
    d = seqs.withColumn("_m", F.row_number().over(w) - 1)
    d = d.withColumn("micro", F.floor(F.col("_m") / group).cast("long")) \
        .withColumn("member", (F.col("_m") % group).cast("int"))
    z = F.arrays_zip(*[F.col(a) for a in arrays])
    out = d.select(batch, "micro", "member", F.posexplode(z).alias("t", "_z"))
    return out.select(batch, "micro", F.col("t").cast("int").alias("t"), "member",
                      *[F.col(f"_z.{a}").alias(a) for a in arrays])
