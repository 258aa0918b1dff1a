"""Sharding along a Hilbert curve: levels of several columns, curve order, runs of equal length."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import private_names, stored

SHARDS = 24
#: Bits of a level: each column is cut into at most 2^BITS levels.
BITS = 4
#: Bits of all levels together. The table of the curve has a row a cell, so it has 65536 rows at most.
MOST_BITS = 16


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve through a cube of 2^bits cells a side (Skilling, 2004)."""
    x = list(point)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i, v in enumerate(x):
            if x[i] & q:
                x[0] ^= low  # turn the lower bits round
            else:
                swap = (x[0] ^ v) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = 0
    for bit in range(bits - 1, 0, -1):
        if x[-1] >> bit & 1:
            turn ^= (1 << bit) - 1
    out = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ turn) >> bit & 1)
    return out


def in_order(rows: DataFrame, order: list[str], weight: Column | None = None) -> DataFrame:
    """``rows`` with ``_before``: rows (or their weight) before each one in the order of all.

    Rows are dealt out by ranges and stored; sums of the ranges, one row each, shift the sums inside them.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    w = F.lit(1).cast("long") if weight is None else weight
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = dealt.groupBy("_range").agg(F.sum(w).alias("_w"))
    shift = F.coalesce(F.sum("_w").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", shift.alias("_shift"))
    summed = dealt.withColumn("_inside", F.sum(w).over(inside) - w).join(F.broadcast(ranges), "_range")  # a row a partition
    return summed.withColumn("_before", (F.col("_shift") + F.col("_inside")).cast("long")).drop("_range", "_shift", "_inside")


def level_starts(rows: DataFrame, dims: list[str], levels: int, n: int) -> dict[str, list[tuple[int, str]]]:
    """For each column the first value of each level; a value's level follows from the rows before it.

    At most ``levels`` values a column come to the driver.
    """
    if not n:
        return {d: [] for d in dims}
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_dim"), F.col(d).alias("_value")) for i, d in enumerate(dims)])).alias("_v"))
    counts = long.groupBy("_v._dim", "_v._value").agg(F.count(F.lit(1)).alias("_n"))
    # Every column has n rows, so the sum before a column's first value is n times its number.
    placed = in_order(counts, ["_dim", "_value"], F.col("_n"))
    level = F.floor((F.col("_before") - F.col("_dim") * F.lit(n)) * levels / F.lit(n)).cast("int")
    firsts = placed.groupBy("_dim", level.alias("_level")).agg(F.min("_value").alias("_value")).collect()
    return {d: sorted((r["_level"], r["_value"]) for r in firsts if r["_dim"] == i) for i, d in enumerate(dims)}


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    dims: tuple[str, ...] = ("lang", "source"),
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and curve of every row.

    The columns ``dims`` and the size of the text are quantised to levels that hold about as many rows
    each; equal values have equal levels. Cells of levels are sorted along the Hilbert curve, rows of a cell
    by id, and the order is cut into runs whose lengths differ by one at most (law ``rows``). So each shard
    covers a compact region, and the ranges of its columns (``manifest``) rule most shards out.

    Null texts have size 8 and the checksum of the empty text; null values of ``dims`` count as '', null ids
    come first. Repeated rows each have a slot. With fewer rows than shards some stay empty; no rows give none.
    """
    private_names(docs, id_col, text_col, *dims)
    if bits * (len(dims) + 1) > MOST_BITS:
        raise ValueError(f"{len(dims) + 1} levels of {bits} bits are over {MOST_BITS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    rows = stored(rows).withColumn("_ds", F.lpad(F.col("_size").cast("string"), 19, "0"))
    names = [f"_d{i}" for i in range(len(dims))] + ["_ds"]
    n = rows.count()
    cell = F.lit(0)
    for name, firsts in level_starts(rows, names, 1 << bits, n).items():
        level = F.lit(0)
        for k, value in firsts:
            level = F.when(F.col(name) >= F.lit(value), F.lit(k)).otherwise(level)
        cell = F.shiftleft(cell, bits).bitwiseOR(level)
    cells = [(i, curve_index(p, bits)) for i, p in enumerate(product(range(1 << bits), repeat=len(names)))]
    curve = docs.sparkSession.createDataFrame(cells, "_cell int, _curve int")  # of fixed size
    rows = rows.select("_id", "_size", "_crc", cell.alias("_cell")).join(F.broadcast(curve), "_cell")
    placed = in_order(rows.select("_curve", "_id", "_size", "_crc"), ["_curve", "_id"])
    shard = F.expr(f"(_before * {shards}) div {max(n, 1)}")
    return placed.withColumn("_shard", shard).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_before - (_shard * {n} + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_curve").alias("curve"),
    )


def manifest(shards: DataFrame, docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """shard, n_rows and, for each column, its least and greatest value: what a reader needs to leave a shard out."""
    rows = shards.select(id_col, "shard").join(docs.select(id_col, *columns), id_col)
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("greatest", F.max))],
    )


def written(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Rows with their shard as Parquet, a folder a shard, files and rows in order of slots. Ids must be unique."""
    rows = docs.join(shards.select(id_col, "shard", "slot"), id_col)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
