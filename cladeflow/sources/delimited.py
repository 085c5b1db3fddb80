"""Delimited files: dialect sniffing, header terms, cleaning, archives of several files."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_cell

SNIFFED_LINES = 50


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    quote: str | None
    columns: int


def sniff(lines: list[str]) -> Dialect:
    """The delimiter and quote that give the most columns, the same number on each line."""
    best = Dialect(",", '"', 1)
    for delimiter in ("\t", ",", ";", "|"):
        for quote in ('"', "'", None):
            reader = csv.reader(
                io.StringIO("\n".join(lines)), delimiter=delimiter,
                quotechar=quote or '"', quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE,
            )
            widths = {len(row) for row in reader if row}
            if len(widths) == 1 and (n := widths.pop()) > best.columns:
                best = Dialect(delimiter, quote, n)
    return best


def tabular(lines: list[str]) -> bool:
    """Whether the first lines look like a table and not like markup, JSON or binary data."""
    head = "\n".join(lines[:10]).lstrip()
    return bool(head) and not head.startswith(("<", "{", "[", "%PDF", "PK")) and "\0" not in head


def encoding_of(data: bytes) -> str:
    """UTF-16 or UTF-8 by mark or validity, else Windows-1252, or Latin-1 for what that lacks."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    for name in ("UTF-8", "windows-1252"):
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return "ISO-8859-1"


def read_delimited(
    spark: SparkSession, path: str, terms: dict[str, str] | None = None, defaults: dict[str, str] | None = None
) -> DataFrame:
    """A file or folder of one schema, as cleaned text columns, without rows that are empty.

    Headers are matched to `terms` by their letters and digits; unknown ones keep
    their name. `defaults` fill missing values, or whole columns. Quoted cells may
    span lines.
    """
    lines = [r[0] for r in spark.read.text(path).limit(SNIFFED_LINES).collect()]
    if not tabular(lines):
        raise ValueError(f"{path} doesn't look like a table")
    dialect = sniff(lines)
    rows = spark.read.csv(
        path, sep=dialect.delimiter, quote=dialect.quote or "", header=True, multiLine=dialect.quote is not None,
        escape=dialect.quote or "\\", encoding="UTF-8",
    )
    plain = lambda h: re.sub(r"[^a-z0-9]", "", h.rpartition(":")[2].rpartition("/")[2].lower())
    named = {plain(k): v for k, v in (terms or {}).items()}
    out = rows.select(*(clean_cell(F.col(f"`{c}`")).alias(named.get(plain(c), c)) for c in rows.columns))
    out = out.dropna(how="all")
    for column, value in (defaults or {}).items():
        filled = F.coalesce(F.col(column), F.lit(value)) if column in out.columns else F.lit(value)
        out = out.withColumn(column, filled)
    return out


def read_star_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The core and extensions that a folder's meta.xml describes, by row type.

    Columns are named by the last part of their term; the id column is `id`.
    """
    meta = spark.read.text(f"{folder}/meta.xml", wholetext=True).first()[0]
    out = {}
    for part in ElementTree.fromstring(meta):
        local = lambda e: e.tag.rpartition("}")[2]
        if local(part) not in ("core", "extension"):
            continue
        files = [e.text for e in part.iter() if local(e) == "location"]
        places = {int(e.get("index")): "id" for e in part if local(e) in ("id", "coreid")}
        fields = [e for e in part if local(e) == "field"]
        places |= {int(e.get("index")): e.get("term").rpartition("/")[2] for e in fields if e.get("index")}
        skipped = int(part.get("ignoreHeaderLines") or 0)
        if skipped > 1:
            raise ValueError(f"{files[0]} has {skipped} header lines; one at most is read")
        rows = spark.read.csv(
            [f"{folder}/{f}" for f in files],
            sep=(part.get("fieldsTerminatedBy") or ",").replace("\\t", "\t"),
            quote=part.get("fieldsEnclosedBy") or "",
            encoding=part.get("encoding") or "UTF-8",
            header=skipped == 1,
        )
        rows = rows.toDF(*(f"_c{i}" for i in range(len(rows.columns))))
        table = rows.select(*(clean_cell(F.col(f"_c{i}")).alias(n) for i, n in sorted(places.items())))
        for e in fields:
            if e.get("default"):
                name = e.get("term").rpartition("/")[2]
                table = table.withColumn(name, F.coalesce(F.col(name), F.lit(e.get("default"))) if name in table.columns else F.lit(e.get("default")))
        out[part.get("rowType").rpartition("/")[2]] = table.dropna(how="all")
    return out


def read_folder(spark: SparkSession, folder: str, kinds: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """The tables of a folder of delimited files, by kind; files of other names are left out.

    kinds: by kind, which is the file's name without its ending, the terms of its
    header. Names match by letters and digits, so that `name_usage.tsv` is NameUsage.
    """
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    known = {plain(k): k for k in kinds}
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    out: dict[str, DataFrame] = {}
    for path in sorted(f.getPath().toString() for f in found):
        kind = known.get(plain(path.rpartition("/")[2].partition(".")[0]))
        if kind:
            rows = read_delimited(spark, path, kinds[kind])
            out[kind] = out[kind].unionByName(rows, allowMissingColumns=True) if kind in out else rows
    return out


def write_delimited(rows: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """Text files with arrays joined by a bar; empty values stay empty."""
    flat = [
        F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c)
        for c, t in rows.dtypes
    ]
    rows.select(*flat).write.csv(path, sep=sep, header=header, nullValue="", emptyValue="")


def write_folder(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as tab-separated files in a folder of its own; read_folder() reads them back."""
    for kind, rows in tables.items():
        write_delimited(rows, f"{folder}/{kind}.tsv")


def write_star_archive(core: tuple[str, DataFrame], extensions: dict[str, DataFrame], folder: str, terms: str = "") -> None:
    """A core table and its extensions, with the meta.xml that read_star_archive() reads.

    Each table has a column `id`; the others are terms, named with `terms` before
    them. Extension rows whose id the core lacks are left out. Tables are folders
    of files, so that no task writes a whole one.
    """
    kind, rows = core
    ids = rows.select("id").distinct()
    tables = {kind: rows} | {k: t.join(ids, "id", "left_semi") for k, t in extensions.items()}
    root = ElementTree.Element("archive", xmlns="http://rs.tdwg.org/dwc/text/")
    for name, table in tables.items():
        write_delimited(table, f"{folder}/{name}")
        part = ElementTree.SubElement(
            root, "core" if name == kind else "extension", rowType=terms + name, encoding="UTF-8",
            fieldsTerminatedBy="\\t", fieldsEnclosedBy='"', ignoreHeaderLines="1",
        )
        ElementTree.SubElement(ElementTree.SubElement(part, "files"), "location").text = name
        for i, c in enumerate(table.columns):
            ElementTree.SubElement(part, ("id" if name == kind else "coreid") if c == "id" else "field", index=str(i), **({} if c == "id" else {"term": terms + c}))
    spark = rows.sparkSession
    text = ElementTree.tostring(root, encoding="unicode")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta.xml")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
