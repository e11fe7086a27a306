"""Lines of sheets as PDF files.

Text is set in a standard font for Korean that readers supply, so none is embedded.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE, MARGIN, SIZE, LEADING = (595, 842), 42, 10, 14


def wrapped(line: str) -> list[str]:
    """A line in pieces as wide as a page, parted at blanks where there are any; letters outside ASCII are twice as wide."""
    room, out = 2 * (PAGE[0] - 2 * MARGIN) // SIZE, []
    start = width = 0
    blank = -1
    for k, c in enumerate(line):
        width += 1 if c < "\x80" else 2
        if c == " ":
            blank = k
        if width > room:
            end = blank if blank > start else k
            out.append(line[start:end])
            start = end + (line[end] == " ")
            width = sum(1 if x < "\x80" else 2 for x in line[start : k + 1])
    return [*out, line[start:]]


def pdf_of(pages: list[list[str]]) -> bytes:
    """A file with the lines of each page; what does not fit goes on on another line or page."""
    fit = (PAGE[1] - 2 * MARGIN) // LEADING
    pages = [[piece for line in p for piece in wrapped(line)] for p in pages]
    sheets = [p[k : k + fit] for p in pages for k in range(0, max(len(p), 1), fit)] or [[]]
    kids = [5 + 2 * k for k in range(len(sheets))]
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(sheets), b" ".join(b"%d 0 R" % k for k in kids)),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /HYSMyeongJo-Medium /Encoding /UniKS-UTF16-H /DescendantFonts [4 0 R] >>",
        b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /HYSMyeongJo-Medium /CIDSystemInfo << /Registry (Adobe) /Ordering (Korea1) /Supplement 2 >> /DW 1000 /W [1 95 500]"
        b" /FontDescriptor << /Type /FontDescriptor /FontName /HYSMyeongJo-Medium /Flags 6 /FontBBox [0 -148 1001 880] /ItalicAngle 0 /Ascent 752 /Descent -271 /CapHeight 737 /StemV 58 >> >>",
    ]
    for k, lines in zip(kids, sheets, strict=True):
        shown = b" T* ".join(b"<%s> Tj" % s.encode("utf-16-be", "replace").hex().encode() for s in lines)
        text = b"BT /F1 %d Tf %d TL %d %d Td %s ET" % (SIZE, LEADING, MARGIN, PAGE[1] - MARGIN - SIZE, shown)
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*PAGE, k + 1))
        bodies.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text))
    out, places = b"%PDF-1.5\n", []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table, len(bodies) + 1, len(out))


def rendered(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, content): one file for each sheet, of its lines (page, row, text).  A sheet's lines are one array."""
    pages = F.array_sort(F.collect_list(F.struct("page", "row", F.coalesce("text", F.lit("")).alias("text"))))

    @F.pandas_udf("binary")
    def render(sheets: pd.Series) -> pd.Series:
        out = []
        for rows in sheets:
            by_page: dict[int, list[str]] = {}
            for r in rows:
                by_page.setdefault(r["page"], []).append(r["text"])
            out.append(pdf_of(list(by_page.values())))
        return pd.Series(out, dtype=object)

    return lines.groupBy(doc).agg(pages.alias("__rows")).select(doc, render("__rows").alias("content"))


def save(files: DataFrame, name: str, folder: str) -> None:
    """Writes each content under its name into a folder that all executors reach.

    A file is written aside and moved into place, so a task that runs again leaves whole files.
    """

    def write(rows) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        fs.create_dir(root, recursive=True)
        for r in rows:
            aside = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as f:
                f.write(bytes(r["content"]))
            fs.move(aside, f"{root}/{os.path.basename(r[name])}")

    files.select(name, "content").foreachPartition(write)
