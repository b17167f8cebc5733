"""Rows with boxes stored in the order of a Hilbert curve, with the box and number of rows of each file, so that a view reads few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
BOX = ("x0", "x1", "y0", "y1")


def hilbert(x: Column, y: Column, bits: int = BITS) -> Column:
    """Place of a cell (whole x and y, 0 to 2^bits - 1) on the Hilbert curve; cells next to each other on it share a side."""
    full = 2**bits - 1

    def turn(s: Column, i: Column) -> Column:
        rx, ry = (F.call_function("shiftright", s[c], i.cast("int")).bitwiseAND(F.lit(1)) for c in "xy")
        d = s["d"] * 4 + (rx * 3).bitwiseXOR(ry)
        flip = lambda c: F.when(rx == 1, full - s[c]).otherwise(s[c])
        return F.struct(d.cast("bigint").alias("d"), F.when(ry == 0, flip("y")).otherwise(s["x"]).cast("bigint").alias("x"), F.when(ry == 0, flip("x")).otherwise(s["y"]).cast("bigint").alias("y"))

    start = F.struct(F.lit(0).cast("bigint").alias("d"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, turn, lambda s: s["d"])


def write(rows: DataFrame, path: str, files: int) -> None:
    """rows (with whole box columns x0, x1, y0, y1) under path in about as many files of equal ranges of the curve; rows without a box come first."""
    lo_x, hi_x, lo_y, hi_y = rows.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    shift = max(((hi_x or 0) - (lo_x or 0)).bit_length(), ((hi_y or 0) - (lo_y or 0)).bit_length(), BITS) - BITS
    at = lambda a, b, lo: F.shiftright(F.expr(f"({a} + {b}) div 2 - {lo or 0}"), shift)
    ordered = rows.withColumn("_h", hilbert(at("x0", "x1", lo_x), at("y0", "y1", lo_y)))
    ordered.repartitionByRange(files, "_h").sortWithinPartitions("_h").drop("_h").write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows").select("*", F.col("_metadata.file_path").alias("file"))
    stored.groupBy("file").agg(F.count("*").alias("n"), *[f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max), BOX)]).write.parquet(f"{path}/ranges")


def _overlaps(view: tuple[int, int, int, int]) -> Column:
    lo_x, lo_y, hi_x, hi_y = view
    return (F.col("x1") > lo_x) & (F.col("x0") < hi_x) & (F.col("y1") > lo_y) & (F.col("y0") < hi_y)


def _of_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Rows of some files; only their names come to the driver."""
    names = [r["file"] for r in files.select("file").collect()]
    return spark.read.parquet(*names) if names else spark.read.parquet(f"{path}/rows").filter(F.lit(False))


def read_view(spark: SparkSession, path: str, view: tuple[int, int, int, int]) -> DataFrame:
    """Rows whose box overlaps a view (lo_x, lo_y, hi_x, hi_y; touching isn't enough), from the files whose box does."""
    return _of_files(spark, path, spark.read.parquet(f"{path}/ranges").filter(_overlaps(view))).filter(_overlaps(view))


def nearest_in_view(spark: SparkSession, path: str, view: tuple[int, int, int, int], most: int, order: list[str]) -> DataFrame:
    """Of the rows that overlap a view those whose box's middle is nearest to the view's, with d2 (of doubled coordinates); ties by order.

    Files that lie in the view as a whole, the nearest ends first, hold enough rows up to some distance; files that begin
    beyond it aren't read.
    """
    lo_x, lo_y, hi_x, hi_y = view
    cx, cy = lo_x + hi_x, lo_y + hi_y
    files = spark.read.parquet(f"{path}/ranges").filter(_overlaps(view))
    # a middle lies in its file's box
    near = lambda a, b, c: F.greatest(F.lit(0), 2 * F.col(a) - c, c - 2 * F.col(b))
    far = lambda a, b, c: F.greatest(F.abs(2 * F.col(a) - c), F.abs(2 * F.col(b) - c))
    two = lambda f: f("x0", "x1", cx) * f("x0", "x1", cx) + f("y0", "y1", cy) * f("y0", "y1", cy)
    files = files.withColumns({"begin": two(near), "end": two(far)})
    inside = files.filter((F.col("x0") > lo_x) & (F.col("x1") < hi_x) & (F.col("y0") > lo_y) & (F.col("y1") < hi_y))
    # most files, each with a row at least, are enough
    ends = inside.orderBy("end").limit(most).select("end", "n").collect() if most <= 100_000 else []
    held, reach = 0, None
    for end, n in ends:
        held += n
        if held >= most:
            reach = end
            break
    rows = _of_files(spark, path, files if reach is None else files.filter(F.col("begin") <= reach)).filter(_overlaps(view))
    d2 = (F.col("x0") + F.col("x1") - cx) * (F.col("x0") + F.col("x1") - cx) + (F.col("y0") + F.col("y1") - cy) * (F.col("y0") + F.col("y1") - cy)
    return rows.withColumn("d2", d2).orderBy("d2", *order).limit(most)
