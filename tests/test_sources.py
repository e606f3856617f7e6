import zipfile

import numpy as np
import pytest

from leontia import DimensionError
from leontia.sources import gloria as g
from leontia.sources.eora import eora
from leontia.sources.text import lines, numbers
from leontia.sources.xlsx import column, read_sheet


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.row_pos, r.col_pos] = r.value
    return out.tolist()


def test_numbers(spark, tmp_path):
    rows = lines(spark, write(tmp_path / "a.csv", "2.5,?\r\n\r\n-,7\r\n"))
    assert dense(numbers(rows), 2, 2) == [[2.5, 0], [0, 7]]
    with pytest.raises(DimensionError):
        numbers(lines(spark, write(tmp_path / "b.csv", "1,2\n3\n")), width=2)
    assert numbers(lines(spark, write(tmp_path / "c.csv", "\r\n"))).count() == 0
    with pytest.raises(Exception, match="row 3 has 1 fields, not 2"):
        numbers(lines(spark, write(tmp_path / "d.csv", "1,2\n3,4\n5\n")), strict=True).collect()


def test_rows_are_numbered_across_blocks(spark, tmp_path):
    path = write(tmp_path / "long.csv", "".join(f"{i}\n" + "\n" * (i % 3) for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.row_pos: r.line for r in lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: str(i) for i in range(3000)}


def test_blocks(spark, tmp_path):
    rows = lambda t, d=",": lines(spark, write(tmp_path / f"{abs(hash(t))}.csv", t))
    s, u = g.parse_supply_use(rows("1.0,2.0\n3.0,4.0\n"), 1, 1)
    assert (dense(s, 1, 1), dense(u, 1, 1)) == ([[2]], [[3]])
    s, u = g.parse_supply_use(rows("1;2\r\n3;4\r\n"), 1, 1, ";")
    assert (dense(s, 1, 1), dense(u, 1, 1)) == ([[2]], [[3]])
    assert dense(g.parse_industry_columns(rows("6.0,0.0\n7.0,0.0\n"), 1, 1), 2, 1) == [[6], [7]]
    y = rows("1,1,1,1,1,1\n5,5,5,5,5,5\n")
    assert dense(g.parse_product_rows(y, 1, 1), 1, 6) == [[5] * 6] and g.detect_dims(y) == (1, 1) and g.detect_dims(rows("")) == (0, 0)
    with pytest.raises(ValueError):
        g.parse_supply_use(y, -1, 1)
    big = np.arange(64).reshape(8, 8)
    s, u = g.parse_supply_use(rows("\n".join(",".join(map(str, r)) for r in big)), 2, 2)
    i, p = [0, 1, 4, 5], [2, 3, 6, 7]
    assert dense(s, 4, 4) == big[np.ix_(i, p)].tolist() and dense(u, 4, 4) == big[np.ix_(p, i)].tolist()


def workbook(path, sheets):
    shared, sheet_xml = [], []
    for rows in sheets.values():
        body = ""
        for i, row in enumerate(rows, 1):
            body += f'<row r="{i}">'
            for j, v in enumerate(row):
                if v is not None:
                    shared.append(v)
                    body += f'<c r="{chr(65 + j)}{i}" t="s"><v>{len(shared) - 1}</v></c>'
            body += "</row>"
        sheet_xml.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, x in enumerate(sheet_xml, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", x)


@pytest.fixture
def release(tmp_path):
    """2 regions x 1 sector; the second region has no transactions."""
    t = "0,4,0,0\n2,0,0,0\n0,0,0,0\n0,0,0,0\n"
    y = "\n".join(",".join(["0"] * 12) for _ in range(1)) + "\n" + ",".join(["1"] * 6 + ["0"] * 6) + "\n" + "\n".join(",".join(["0"] * 12) for _ in range(2)) + "\n"
    files = {"T": t, "Y": y, "V": "3,0,0,0\n0,0,0,0\n"}
    folder = tmp_path / "2019"
    for k, text in files.items():
        write(folder / g.archive_name(60, 2019) / "inner" / g.result_file(k, 2019, 60), text)
    write(folder / "GLORIA_SattelliteAccounts_060_2019" / ("20260121_" + g.satellite_suffix("TQ", 2019, 60)), "8,0,0,0\n")
    workbook(folder / "GLORIA_ReadMe_060.xlsx", {
        "Regions": [["Region_acronyms", "Region_names"], ["AAA", "Aland"], ["BBB", "Beland"]],
        "Sectors": [["Sector_names"], ["Wheat"], [None]],
        "Value added and final demand": [["Value_added_names", "Final_demand_names"], ["Wages", "d1"]] + [[None, f"d{i}"] for i in range(2, 7)],
        "Satellites": [["Sat_indicator", "Sat_head_indicator", "Sat_unit"], ["CO2", "air", "kt"]],
    })
    return tmp_path, folder


def test_release(spark, release):
    path, folder = release
    m = g.gloria(spark, str(path), 2019)
    assert m.countries() == ["AAA"] and m.sectors() == ["Wheat"] and m.stressors() == ["CO2"]
    assert m.T.to_numpy().tolist() == [[2]] and m.X.to_numpy().tolist() == [8] and m.FD.shape == (1, 6) and m.VA.to_numpy().tolist() == [[3]]
    assert np.isclose(m.env.A.to_numpy()[0, 0], 1)
    assert g.gloria(spark, str(path), 2019, country_names="full").countries() == ["Aland"]


def test_archives(spark, release):
    path, folder = release
    for name in (g.archive_name(60, 2019), "GLORIA_SattelliteAccounts_060_2019"):
        with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
            for p in sorted((folder / name).rglob("*.csv")):
                z.write(p, f"{name}/deep/{p.name}")
                p.unlink()
        for p in sorted((folder / name).rglob("*"), reverse=True):
            p.rmdir()
        (folder / name).rmdir()
    assert g.gloria(spark, str(path), 2019).T.to_numpy().tolist() == [[2]]
    with pytest.warns(UserWarning):
        assert g.find_satellites(folder, 59, 2019).suffix == ".zip"
    with pytest.raises(FileNotFoundError):
        g.locate(spark, folder, "none", "x.csv")


def test_workbook(release):
    path = str(release[1] / "GLORIA_ReadMe_060.xlsx")
    assert column(path, "Sectors", "Sector_names") == ["Wheat"] and read_sheet(path, "Regions")["Region_names"] == ["Aland", "Beland"]
    with pytest.raises(KeyError):
        read_sheet(path, "None")


def test_eora(spark, tmp_path):
    write(tmp_path / "T.txt", "10\t2\t1\n3\t8\t1\n9\t9\t9\n")
    write(tmp_path / "FD.txt", "5\t1\n7\t1\n9\t9\n")
    write(tmp_path / "VA.txt", "4\t6\t9\n")
    write(tmp_path / "Q.txt", "17\t36\t9\n")
    write(tmp_path / "labels_T.txt", "Austria\tAUT\tInd\tA\nGermany\tDEU\tInd\tB\nRest\tROW\tInd\tTotal\n")
    write(tmp_path / "labels_FD.txt", "Austria\tAUT\tFinal\tHH\nRest\tROW\tFinal\tHH\n")
    write(tmp_path / "labels_VA.txt", "x\tWages\n")
    write(tmp_path / "labels_Q.txt", "CO2\tenergy\n")
    m = eora(spark, str(tmp_path))
    assert m.T.to_numpy().tolist() == [[10, 2], [3, 8]] and m.FD.to_numpy().tolist() == [[5], [7]] and m.VA.to_numpy().tolist() == [[4, 6]]
    assert m.X.to_numpy().tolist() == [17, 18] and m.env.A.to_numpy().tolist() == [[1, 2]] and m.countries() == ["AUT", "DEU"] and m.stressors() == ["CO2"]
