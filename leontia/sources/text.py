"""Headerless numeric text files as cells.

Rows are numbered by where they stand in the file: Spark numbers the lines that it reads, and the first number and
the count of each block of the file, a row a block, give the offsets.  Bad tokens count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leontia.model import DimensionError


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_pos, line) of the lines that are not blank."""
    kept = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block")).where(F.col("value").rlike(r"[^ \t\r,;]"))
    kept = kept.withColumn("id", F.monotonically_increasing_id())
    blocks = kept.groupBy("block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(blocks.select("block", "first", before.alias("before")), "block").select((F.col("before") + F.col("id") - F.col("first")).alias("row_pos"), F.col("value").alias("line"))


def numbers(rows: DataFrame, delimiter: str = ",", width: int | None = None, strict: bool = False) -> DataFrame:
    """Cells of (row_pos, line); with ``width``, every row must have that many fields; ``strict`` fails, when the cells are read, at a row that is not as wide as the first."""
    parts = rows.select("row_pos", F.split(F.regexp_replace("line", r"\s+$", ""), "[" + delimiter.replace("\t", "\\t") + "]").alias("parts"))
    if width is not None:
        ragged = parts.where(F.size("parts") != width).limit(1).collect()
        if ragged:
            raise DimensionError(f"row {ragged[0]['row_pos'] + 1} has {len(ragged[0]['parts'])} fields, not {width}")
    if strict:
        first = width_of(rows, delimiter)
        said = F.concat(F.lit("row "), (F.col("row_pos") + 1).cast("string"), F.lit(" has "), F.size("parts").cast("string"), F.lit(f" fields, not {first}"))
        parts = parts.withColumn("parts", F.when(F.size("parts") == first, F.col("parts")).otherwise(F.raise_error(said)))
    cells = parts.select("row_pos", F.posexplode("parts").alias("col_pos", "token"))
    return cells.select("row_pos", F.col("col_pos").cast("long").alias("col_pos"), F.coalesce(F.trim("token").try_cast("double"), F.lit(0.0)).alias("value"))


def width_of(rows: DataFrame, delimiter: str = ",") -> int:
    first = rows.where("row_pos = 0").first()
    return 0 if first is None else len([t for t in first["line"].rstrip().split(delimiter)])


def label_table(spark: SparkSession, path: str, names: dict[int, str], delimiter: str = "\t") -> DataFrame:
    """(pos, named columns) of a headerless label file; columns count from 1."""
    parts = F.split("line", delimiter)
    return lines(spark, path).select(F.col("row_pos").alias("pos"), *[F.nullif(F.trim(F.try_element_at(parts, F.lit(k))), F.lit("")).alias(n) for k, n in names.items()])
