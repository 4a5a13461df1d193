"""Scale patterns shared by the operators.

* ``exact_rank``: a deterministic global 0-based rank without a one-partition
  window (hash-prefix buckets + prefix sums over a tiny counts table).
* ``keep_first``: first row per key through an aggregate (map-side combine),
  so a key holding a third of all rows never lands whole in one task.
* ``global_rank``: a 0-based rank in any total order, over range partitions.
* ``lead_in_order``: next value per key in order, splitting hot keys into
  pieces along the order column and stitching the piece boundaries.
* ``fill_forward``: last non-null value at or before each row in a global
  order, without pulling the rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hex_bucket(hex_key: Column, n_hex: int = 3) -> Column:
    """Leading ``n_hex`` hex digits as an int: 16**n_hex order-preserving buckets."""
    return F.conv(F.substring(hex_key, 1, n_hex), 16, 10).cast("int")


def bucket_offsets(keyed: DataFrame, parts: list[str], bucket: str, max_groups: int = 1024):
    """Row counts per (group, bucket) -> (offsets DataFrame, totals per group, largest bucket).

    The counts table has at most 16**n_hex rows per group, so it is brought to
    the driver (checked), prefix-summed there and shipped back as a broadcast
    table: one small job, no single-partition window over data rows.
    """
    spark = keyed.sparkSession
    counts = keyed.groupBy(*parts, bucket).agg(F.count(F.lit(1)).alias("_n"))
    limit = max_groups * 65536
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rank groups for a broadcast offsets table")
    rows.sort(key=lambda r: (tuple(r[p] for p in parts), r[bucket]))
    offsets, totals, run, prev, largest = [], {}, 0, None, 0
    for r in rows:
        g = tuple(r[p] for p in parts)
        if g != prev:
            run, prev = 0, g
        offsets.append((*g, r[bucket], run))
        run += r["_n"]
        totals[g] = run
        largest = max(largest, r["_n"])
    schema = ", ".join([f"`{p}` {t}" for p, t in keyed.select(*parts).dtypes] + [f"`{bucket}` int", "_off bigint"])
    return spark.createDataFrame(offsets, schema), totals, largest


# rows one rank window may hold before the buckets are refined
MAX_BUCKET_ROWS = 2_000_000


def exact_rank(df: DataFrame, hex_key: str, tiebreak: str, out: str = "rank",
               partition_by: list[str] | None = None, n_hex: int = 3, with_totals: bool = False,
               max_bucket_rows: int = MAX_BUCKET_ROWS):
    """Add ``out`` = 0-based position of each row ordered by (hex_key, tiebreak).

    ``hex_key`` must be a uniformly spread hex string (an md5) and the
    (hex_key, tiebreak) pairs unique. Rows are counted per leading-hex
    bucket; the prefix sums of that counts table are broadcast back, and only
    rows of one bucket are ranked together. When a bucket holds more than
    ``max_bucket_rows``, the buckets are refined by one more hex digit (16x
    finer, up to 16**4 per group), so a rank window stays bounded as the data
    grows. With ``with_totals`` the row count per group is returned as well.
    """
    parts = list(partition_by or [])
    b = "_bucket"
    while True:
        keyed = df.withColumn(b, hex_bucket(F.col(hex_key), n_hex))
        offsets, totals, largest = bucket_offsets(keyed, parts, b)
        if largest <= max_bucket_rows or n_hex >= 4:
            break
        n_hex += 1
    ranked = keyed.join(F.broadcast(offsets), on=parts + [b], how="inner")
    within = Window.partitionBy(*parts, b).orderBy(F.col(hex_key), F.col(tiebreak))
    out_df = (ranked.withColumn(out, (F.col("_off") + F.row_number().over(within) - 1).cast("bigint"))
              .drop(b, "_off"))
    return (out_df, totals) if with_totals else out_df


def kth_key(df: DataFrame, hex_key: str, tiebreak: str, k, few: int = 10_000, step: int = 3):
    """The (hex_key, tiebreak) at 0-based position ``k`` of the order (hex_key, tiebreak), without sorting the rows.

    ``k`` may be a function of the number of rows. Rows are counted by the next ``step`` hex digits (at most 16^step
    counts reach the driver), the bucket that holds the position is opened, and so on until it has at most ``few`` rows
    or the keys are spent; each round reads the rows once. Keys are spread evenly (an md5), so two or three rounds do.
    """
    at, prefix = k, ""
    while True:
        rows = df.where(F.startswith(F.col(hex_key), F.lit(prefix))) if prefix else df
        digits = F.substring(hex_key, 1, len(prefix) + step).alias("b")
        counts = sorted((r["b"], r["n"]) for r in rows.groupBy(digits).agg(F.count(F.lit(1)).alias("n")).collect())
        if callable(at):
            at = at(sum(n for _, n in counts))
        for bucket, n in counts:
            if at < n:
                break
            at -= n
        else:
            raise IndexError("position beyond the last row")
        spent = len(bucket) < len(prefix) + step or bucket == prefix
        prefix = bucket
        if n <= few or spent:
            found = df.where(F.startswith(F.col(hex_key), F.lit(prefix))).orderBy(hex_key, tiebreak).limit(at + 1)
            row = found.orderBy(F.desc(hex_key), F.desc(tiebreak)).first()
            return row[hex_key], row[tiebreak]


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", n_parts: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in a total order, without a one-partition window.

    Rows are range-partitioned once and stored with their partition number; the prefix sums of the row counts (one
    number per partition) are joined back, and rows are numbered within their partition only.
    """
    from papyra.session import materialize
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    offsets, run = [], 0
    for r in sorted(stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], run))
        run += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _off bigint")   # at most n rows
    within = Window.partitionBy("_part").orderBy(*order)
    return (stored.join(F.broadcast(table), "_part")
            .withColumn(out, (F.col("_off") + F.row_number().over(within) - 1).cast("bigint")).drop("_part", "_off"))


def keep_first(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """One row per ``key``: the one with the smallest ``order_by`` (ties: smallest row struct).

    Implemented as ``min(struct(order_by, *rest))`` so partial aggregation
    collapses duplicates before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, order_by)]
    picked = df.groupBy(key).agg(F.min(F.struct(order_by, *rest)).alias("_first"))
    return picked.select(key, *[F.col(f"_first.{c}").alias(c) for c in [order_by] + rest]).select(*df.columns)


def order_pieces(df: DataFrame, col: str, n: int) -> DataFrame:
    """``df`` with ``_piece``: the number of the range partition of ``col`` that a row lies in.

    The rows are stored with their number, so every later use agrees on the pieces, however often a plan runs.
    """
    from papyra.session import materialize
    return materialize(df.repartitionByRange(max(n, 1), col).withColumn("_piece", F.spark_partition_id()), "pieces")


def lead_in_order(df: DataFrame, key: list[str], order_cols: list[str], value: str, out: str,
                  n_parts: int | None = None) -> DataFrame:
    """``lead(value) over (partition by key order by order_cols)`` that splits hot keys.

    Rows are cut into pieces along the first (numeric) order column, so one
    key's sequence may span many tasks; the lead is taken within (key, piece)
    and the last row of each piece gets the first value of the key's next
    non-empty piece. ``order_cols`` must be a total order within a key.
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = order_pieces(df, order_cols[0], n)
    w = Window.partitionBy(*key, "_piece").orderBy(*order_cols)
    local = (ranged.withColumn(out, F.lead(value).over(w))
             .withColumn("_last", F.lead(F.lit(1)).over(w).isNull()))
    # first value of every (key, piece): at most n rows per key
    firsts = (ranged.groupBy(*key, "_piece")
              .agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                                   F.col(value).alias("_v"))).alias("_f"))
              .select(*key, "_piece", F.col("_f._v").alias("_first")))
    nxt = firsts.withColumn("_next_first", F.lead("_first").over(
        Window.partitionBy(*key).orderBy("_piece"))).drop("_first")
    return (local.join(nxt, on=[*key, "_piece"], how="left")
            .withColumn(out, F.when(F.col("_last"), F.col("_next_first")).otherwise(F.col(out)))
            .drop("_piece", "_next_first", "_last"))


def fill_forward(df: DataFrame, key: str | list[str], order_col: str, value: str, out: str, n_parts: int | None = None,
                 strict: bool = False) -> DataFrame:
    """``last(value, ignorenulls) over (partition by key order by order_col rows unbounded preceding)``, distributed.

    Rows are cut into pieces along ``order_col``, so one key may span many tasks; each piece fills forward locally,
    and its leading gap takes the last non-null value of the key's pieces before it, from a table with one row per
    (key, piece). ``order_col`` must be numeric and unique within a key. ``strict`` leaves the row's own value out.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = order_pieces(df, order_col, n)
    last = Window.currentRow - 1 if strict else Window.currentRow
    w = Window.partitionBy(*keys, "_piece").orderBy(order_col).rowsBetween(Window.unboundedPreceding, last)
    local = ranged.withColumn(out, F.last(F.col(value), ignorenulls=True).over(w))
    lasts = ranged.groupBy(*keys, "_piece").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order_col))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, "_piece", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return (local.join(carry, [*keys, "_piece"], "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
            .drop("_piece", "_carry"))
