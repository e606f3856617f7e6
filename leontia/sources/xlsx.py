"""Reads sheets of an .xlsx workbook with the standard library: a header row, then columns of values."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_sheet(path: str, sheet: str) -> dict[str, list[str | None]]:
    """Header -> values of a sheet, all as text; empty cells are None."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        found = {s.get("name"): s.get(_REL) for s in book.iter(f"{{{_NS['m']}}}sheet")}
        if sheet not in found:
            raise KeyError(f"the workbook has no sheet {sheet!r}")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[found[sheet]].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        values: dict[int, str | None] = {}
        for i, c in enumerate(row.findall("m:c", _NS)):
            v, kind = c.find("m:v", _NS), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            values[_column(c.get("r")) if c.get("r") else i] = text or None
        rows.append(values)
    if not rows:
        return {}
    return {name: [r.get(i) for r in rows[1:]] for i, name in rows[0].items() if name}


def column(path: str, sheet: str, name: str) -> list[str]:
    """The values of a column that are there."""
    return [v for v in read_sheet(path, sheet)[name] if v is not None]
