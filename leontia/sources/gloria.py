"""Archives of the GLORIA kind: block files of supply and use, final demand, value added and satellites.

A block file has, for each region, the rows (columns) of its industries and then those of its products.
Files are found by name in a folder or a ZIP archive; of an archive, the members needed are unpacked beside
the session's shared folder, where every executor can read them.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leontia.operators import axis as ax
from leontia.plans.supply_use import SupplyUse, assemble, product_axis
from leontia.plans.system import MRIO
from leontia.sources.text import lines, numbers, width_of
from leontia.sources.xlsx import column, read_sheet

# File names of the release, price variants, and the number of final demand categories of a region.
PREFIX = "20260121_120secMother_AllCountries_002_"
MARKUP = {"base": "Markup001", "purchaser": "Markup005"}
CATEGORIES = 6


def archive_name(version: int, year: int) -> str:
    return f"GLORIA_MRIOs_{version}_{year}"


def result_file(kind: str, year: int, version: int, price: str = "base") -> str:
    return f"{PREFIX}{kind}-Results_{year}_0{version}_{MARKUP[price]}(full).csv"


def satellite_suffix(kind: str, year: int, version: int) -> str:
    return f"{kind}-Results_{year}_0{version}_Markup001(full).csv"


# ---- finding files


def base_path(path: str | Path, year: int) -> Path:
    """The folder itself, or its sub-folder for the year."""
    sub = Path(path) / str(year)
    return sub if sub.is_dir() else Path(path)


def find_file(folder: Path, suffix: str) -> Path | None:
    return next((p for p in sorted(folder.rglob("*")) if p.is_file() and p.name.lower().endswith(suffix.lower())), None)


def find_entry(archive: Path, suffix: str) -> str | None:
    with zipfile.ZipFile(archive) as z:
        return next((n for n in sorted(z.namelist()) if n.lower().endswith(suffix.lower())), None)


def _unpacked(spark: SparkSession, archive: Path, entry: str) -> str:
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    place = re.sub(r"^file:/*", "/", place) if place and place.startswith(("file:", "/")) else None
    if place:
        Path(place).mkdir(parents=True, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="leontia-zip-", dir=place)
    with zipfile.ZipFile(archive) as z, z.open(entry) as source, open(f"{folder}/part.csv", "wb") as out:
        shutil.copyfileobj(source, out)
    return f"{folder}/part.csv"


def locate(spark: SparkSession, folder: Path, name: str, suffix: str) -> str:
    """The path of a file in the folder ``name`` or the archive ``name``.zip."""
    if (folder / name).is_dir():
        found = find_file(folder / name, suffix)
        if found:
            return str(found)
    archive = folder / f"{name}.zip"
    if archive.is_file():
        entry = find_entry(archive, suffix)
        if entry:
            return _unpacked(spark, archive, entry)
    raise FileNotFoundError(f"no file ending in {suffix} in {folder / name} or its archive")


def find_readme(folder: Path) -> Path:
    found = next((p for p in sorted(folder.iterdir()) if "readme" in p.name.lower() and p.suffix.lower() == ".xlsx"), None)
    if found is None:
        raise FileNotFoundError(f"no readme workbook in {folder}")
    return found


def find_satellites(folder: Path, version: int, year: int) -> Path:
    """The folder or archive of the satellite accounts; one of another version only with a warning."""
    named = [p for p in sorted(folder.iterdir()) if re.search(r"sat+el+ite", p.name.lower()) and (p.is_dir() or p.suffix.lower() == ".zip") and str(year) in p.name]
    named = named or [p for p in sorted(folder.iterdir()) if re.search(r"sat+el+ite", p.name.lower()) and (p.is_dir() or p.suffix.lower() == ".zip")]
    if not named:
        raise FileNotFoundError(f"no satellite accounts in {folder}")
    fitting = [p for p in named if re.search(rf"(?<!\d)0?{version}(?!\d)", p.name)]
    if not fitting:
        warnings.warn(f"no satellite accounts of version {version}; {named[0].name} is used", stacklevel=2)
    return (fitting or named)[0]


# ---- block files


def _global(pos: str, s: int):
    """The place among all industries, or all products, of a place in the block file."""
    return (F.floor(F.col(pos) / (2 * s)) * s + F.pmod(F.col(pos), F.lit(s))).cast("long")


def _is_product(pos: str, s: int):
    return F.pmod(F.floor(F.col(pos) / s), F.lit(2)) == 1


def _checked(regions: int, sectors: int) -> None:
    if regions < 0 or sectors < 0:
        raise ValueError("there are no fewer than 0 regions or sectors")


def parse_supply_use(rows: DataFrame, regions: int, sectors: int, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(supply, use): the cells at industry rows and product columns, and at product rows and industry columns."""
    _checked(regions, sectors)
    cells = numbers(rows, delimiter, strict=True)
    moved = [_global("row_pos", sectors).alias("row_pos"), _global("col_pos", sectors).alias("col_pos"), F.col("value")]
    row, col = _is_product("row_pos", sectors), _is_product("col_pos", sectors)
    return cells.where(~row & col).select(*moved), cells.where(row & ~col).select(*moved)


def parse_industry_columns(rows: DataFrame, regions: int, sectors: int, delimiter: str = ",") -> DataFrame:
    """Value added or satellites: all rows, industry columns."""
    _checked(regions, sectors)
    return numbers(rows, delimiter, strict=True).where(~_is_product("col_pos", sectors)).select("row_pos", _global("col_pos", sectors).alias("col_pos"), "value")


def parse_product_rows(rows: DataFrame, regions: int, sectors: int, delimiter: str = ",") -> DataFrame:
    """Final demand: product rows, all columns."""
    _checked(regions, sectors)
    return numbers(rows, delimiter, strict=True).where(_is_product("row_pos", sectors)).select(_global("row_pos", sectors).alias("row_pos"), "col_pos", "value")


def parse_household_satellites(rows: DataFrame, delimiter: str = ",") -> DataFrame:
    return numbers(rows, delimiter, strict=True)


def detect_dims(y_rows: DataFrame, delimiter: str = ",", categories: int = CATEGORIES) -> tuple[int, int]:
    """(regions, sectors) from the shape of the final demand file; (0, 0) if it is empty."""
    width, height = width_of(y_rows, delimiter), y_rows.count()
    if not width or not height:
        return 0, 0
    regions = max(1, width // categories)
    return regions, max(1, height // (2 * regions))


def parse_sut(spark: SparkSession, path: str, year: int = 2019, version: int = 60, price: str = "base", delimiter: str = ",") -> SupplyUse:
    folder, name = base_path(path, year), archive_name(version, year)
    files = {k: locate(spark, folder, name, result_file(k, year, version, price)) for k in ("T", "Y", "V")}
    return sut_from_files(spark, files, delimiter)


def sut_from_files(spark: SparkSession, files: dict[str, str], delimiter: str = ",") -> SupplyUse:
    t, y, v = (lines(spark, files[k]) for k in ("T", "Y", "V"))
    regions, sectors = detect_dims(y, delimiter)
    if not regions:
        none = spark.createDataFrame([], "row_pos long, col_pos long, value double")
        return SupplyUse(none, none, none, none, 0, 0, 0)
    supply, use = parse_supply_use(t, regions, sectors, delimiter)
    return SupplyUse(supply, use, parse_product_rows(y, regions, sectors, delimiter), parse_industry_columns(v, regions, sectors, delimiter), regions * sectors, regions, sectors)


def gloria(spark: SparkSession, path: str, year: int, version: int = 60, price: str = "base", country_names: str = "gloria") -> MRIO:
    """The system of a release folder; ``country_names`` is 'gloria' for acronyms, else full names."""
    folder = base_path(path, year)
    readme = str(find_readme(folder))
    sut = parse_sut(spark, path, year, version, price)
    sat = find_satellites(folder, version, year)
    tq = satellite_suffix("TQ", year, version)
    if sat.is_dir():
        found = find_file(sat, tq)
        if found is None:
            raise FileNotFoundError(f"no file ending in {tq} in {sat}")
        q_path = str(found)
    else:
        entry = find_entry(sat, tq)
        if entry is None:
            raise FileNotFoundError(f"no file ending in {tq} in {sat}")
        q_path = _unpacked(spark, sat, entry)
    q = parse_industry_columns(lines(spark, q_path), sut.regions, sut.sectors)
    axis = lambda name, values: ax.numbered(spark, [{name: v} for v in values])
    regions = axis("CountryCode", column(readme, "Regions", "Region_acronyms" if country_names == "gloria" else "Region_names")[: sut.regions])
    sectors = axis("Sector", column(readme, "Sectors", "Sector_names")[: sut.sectors])
    value_added = product_axis(regions, axis("Category", column(readme, "Value added and final demand", "Value_added_names")), "Category")
    categories = axis("Category", column(readme, "Value added and final demand", "Final_demand_names"))
    table = read_sheet(readme, "Satellites")
    stressors = ax.numbered(spark, [{"Stressor": a, "Source": b, "Unit": c} for a, b, c in zip(table["Sat_indicator"], table["Sat_head_indicator"], table["Sat_unit"]) if a is not None])
    return assemble(sut, q, regions, sectors, value_added, categories, stressors)
