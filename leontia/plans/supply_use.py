"""From supply-use tables to an input-output system (product by product, industry technology)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leontia.model import LabeledMatrix, LabeledSeries, densify
from leontia.operators import axis as ax
from leontia.plans.algebra import LeontiefSystem, matmul, written
from leontia.plans.system import MRIO, EnvironmentalExtension


@dataclass
class SupplyUse:
    """Cells of supply V (industry x product), use U (product x industry), final demand Y and value added VA (by industry); n sectors of each kind."""

    V: DataFrame
    U: DataFrame
    Y: DataFrame
    VA: DataFrame
    n: int
    regions: int
    sectors: int


def _inverse(sums: DataFrame) -> DataFrame:
    """(k, f) with f = 1 / sum, and 0 for a sum of 0."""
    return sums.select("k", F.when(F.col("s") == 0, 0.0).otherwise(1.0 / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("f"))


def input_output(sut: SupplyUse, q_cells: DataFrame) -> dict[str, DataFrame]:
    """Cells of Z = U T, A = Z / q, VA T and Q T with T = V / g, and q itself; g and q are the row sums of V and of (U, Y)."""
    g = _inverse(sut.V.groupBy(F.col("row_pos").alias("k")).agg(F.sum("value").alias("s")))
    share = written(sut.V.where("value <> 0").join(g.select(F.col("k").alias("row_pos"), "f"), "row_pos").select("row_pos", "col_pos", (F.col("value") * F.col("f")).alias("value")))
    z = written(matmul(sut.U, share))
    q = written(sut.U.select("row_pos", "value").unionByName(sut.Y.select("row_pos", "value")).groupBy(F.col("row_pos").alias("pos")).agg(F.sum("value").alias("value")))
    by = _inverse(q.select(F.col("pos").alias("k"), F.col("value").alias("s"))).select(F.col("k").alias("col_pos"), "f")
    a = z.join(by, "col_pos").select("row_pos", "col_pos", (F.col("value") * F.col("f")).alias("value"))
    return {"Z": z, "A": a, "VA": matmul(sut.VA, share), "Q": matmul(q_cells, share), "q": q}


def empty_regions(z: DataFrame, regions: DataFrame, sectors: int) -> DataFrame:
    """The regions (pos) all of whose row sums and column sums in Z are 0."""
    live = None
    for side in ("row_pos", "col_pos"):
        sums = z.groupBy(side).agg(F.sum("value").alias("s")).where("s <> 0").select(F.floor(F.col(side) / sectors).cast("long").alias("pos"))
        live = sums if live is None else live.unionByName(sums)
    return regions.select("pos").join(live.distinct(), "pos", "left_anti")


def product_axis(regions: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Regions x names, regions slowest: (pos, CountryCode, <name>)."""
    n = names.count()
    r = regions.select(F.col("pos").alias("r"), "CountryCode")
    return r.crossJoin(names.select(F.col("pos").alias("k"), name)).select((F.col("r") * n + F.col("k")).alias("pos"), "CountryCode", name)


def assemble(sut: SupplyUse, q_cells: DataFrame, regions: DataFrame, sectors: DataFrame, value_added: DataFrame, categories: DataFrame, stressors: DataFrame) -> MRIO:
    """The system, without the regions that have no transactions.  Output is the q of all regions, as coefficients are."""
    io = input_output(sut, q_cells)
    gone = empty_regions(io["Z"], regions, sut.sectors)
    flagged = lambda axis: axis.join(regions.join(gone, "pos", "left_anti").select("CountryCode").distinct(), "CountryCode")
    sector_axis, demand_axis = product_axis(regions, sectors, "Sector"), product_axis(regions, categories, "Category")
    value_axis = value_added if "CountryCode" not in value_added.columns else flagged(value_added)

    def part(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> LabeledMatrix:
        new_rows, new_cols = ax.renumbered(rows), ax.renumbered(cols)
        kept = cells.join(new_rows.select(F.col("old").alias("row_pos"), F.col("pos").alias("r")), "row_pos").join(new_cols.select(F.col("old").alias("col_pos"), F.col("pos").alias("c")), "col_pos")
        new_rows, new_cols = new_rows.drop("old"), new_cols.drop("old")
        return LabeledMatrix(densify(kept.select(F.col("r").alias("row_pos"), F.col("c").alias("col_pos"), "value"), new_rows, new_cols), new_cols, new_rows)

    kept_sectors, kept_demand = flagged(sector_axis), flagged(demand_axis)
    z, a = part(io["Z"], kept_sectors, kept_sectors), part(io["A"], kept_sectors, kept_sectors)
    fd, va, f = part(sut.Y, kept_sectors, kept_demand), part(io["VA"], value_axis, kept_sectors), part(io["Q"], stressors, kept_sectors)
    output = ax.renumbered(kept_sectors).join(io["q"].select(F.col("pos").alias("old"), "value"), "old", "left").drop("old")
    x = LabeledSeries(output.withColumn("value", F.coalesce("value", F.lit(0.0))))
    return MRIO(a, z, va, fd, LeontiefSystem(a), x, EnvironmentalExtension.of(f, x))


