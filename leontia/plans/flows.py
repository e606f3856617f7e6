"""A trade system from the star-schema tables: suppliers' nation and part type sell to customers' nation and sector.

Intermediate flows are the line items that were kept, final demand those that were returned.  Rows are
(nation, part type); columns the same, with the customer's sector taken from its key; demand columns are
nations.  Extensions are sums of quantity, tax and discount.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leontia.model import LabeledMatrix, densify
from leontia.plans.algebra import written
from leontia.plans.system import MRIO

STRESSORS = ("Discount", "Quantity", "Tax")


class Flows:
    """The tables of a folder as matrices, each a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        types = self.read("part").select(F.col("p_type").alias("Sector")).distinct()
        self.types = types.withColumn("t", F.row_number().over(Window.orderBy("Sector")) - 1)  # a handful of rows
        self.k = self.types.count()
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        self.nations = nations.select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("CountryCode"), F.col("r_name").alias("Region"))
        n = self.nations.select(F.col("pos").alias("n"), "CountryCode", "Region")
        self.axis = n.crossJoin(self.types).select((F.col("n") * self.k + F.col("t")).alias("pos"), "CountryCode", "Region", "Sector")

    @cached_property
    def sums(self) -> DataFrame:
        """(row_pos, col_pos, returned, price, Quantity, Tax, Discount): the line items summed by place, once for all matrices; at most two rows a place."""
        return written(self.lines().groupBy("row_pos", "col_pos", "returned").agg(*[F.sum(c).alias(c) for c in ("price", *STRESSORS)]))

    def lines(self) -> DataFrame:
        """(row_pos, col_pos, returned, price, Quantity, Tax, Discount) of each line item; only the columns used are scanned."""
        line = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        sold = (
            line.join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.read("part").select("p_partkey", F.col("p_type").alias("Sector")), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.types, "Sector")
        )
        return sold.select(
            (F.col("s_nationkey") * self.k + F.col("t")).cast("long").alias("row_pos"),
            (F.col("c_nationkey") * self.k + F.col("c_custkey") % self.k).cast("long").alias("col_pos"),
            (F.col("l_returnflag") == "R").alias("returned"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("Quantity"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("Tax"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("Discount"),
        )

    def z(self) -> LabeledMatrix:
        kept = self.sums.where(~F.col("returned")).select("row_pos", "col_pos", F.col("price").alias("value"))
        return LabeledMatrix(densify(kept, self.axis, self.axis), self.axis, self.axis)

    def y(self) -> LabeledMatrix:
        nation = F.floor(F.col("col_pos") / self.k).cast("long")
        sums = self.sums.where("returned").groupBy("row_pos", nation.alias("col_pos")).agg(F.sum("price").alias("value"))
        cols = self.nations.select("pos", "CountryCode")
        return LabeledMatrix(densify(sums, self.axis, cols), cols, self.axis)

    def impacts(self) -> LabeledMatrix:
        sums = self.sums.groupBy(F.col("row_pos").alias("col_pos")).agg(*[F.sum(s).alias(s) for s in STRESSORS])
        entries = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("row_pos"), F.col(s).alias("value")) for i, s in enumerate(STRESSORS)]))
        rows = self.spark.createDataFrame([(i, s, "lineitem") for i, s in enumerate(STRESSORS)], "pos long, Stressor string, Source string")
        cells = sums.select("col_pos", entries.alias("e")).select("e.row_pos", "col_pos", "e.value")
        return LabeledMatrix(densify(cells, rows, self.axis), self.axis, rows)

    def value_added(self) -> LabeledMatrix:
        """One row: quantity sold by the column's sector."""
        sums = self.sums.groupBy(F.col("row_pos").alias("col_pos")).agg(F.sum("Quantity").alias("value")).withColumn("row_pos", F.lit(0).cast("long"))
        rows = self.spark.createDataFrame([(0, "Quantity")], "pos long, PrimaryInput string")
        return LabeledMatrix(densify(sums.select("row_pos", "col_pos", "value"), rows, self.axis), self.axis, rows)

    def system(self) -> MRIO:
        return MRIO.of(self.z(), self.y(), self.value_added(), impacts=self.impacts())
