"""Records that line breaks have torn apart, put together over the splits of a file.

A line with too few cells goes on in the next one, if their cells together are
no more than the columns. So where records begin depends on all lines before. But
all that a split needs to know of them is how many cells are open at its start: a
first pass tells for each split what each such number turns into, these tables
are strung together, and a second pass assembles every split's records at
once. Only the pieces at the edges of splits meet in a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Assembler:
    """Takes lines in turn; `open` is how many cells a record has that can go on, or 0."""

    def __init__(self, columns: int, open_: int = 0):
        self.columns, self.open = columns, open_

    def goes_on(self, cells: int) -> bool:
        """Whether the line belongs to the open record; else it begins one."""
        together = self.open + cells - 1
        if self.open and together <= self.columns:
            self.open = together if together < self.columns else 0
            return True
        self.open = cells if 1 < cells < self.columns else 0
        return False


def _lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Lines that aren't blank, in order within their split (file and block)."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.size(F.split("value", F.lit(_quoted(delimiter)), -1)).alias("cells"), F.col("value").alias("line"),
    )
    return text.filter(F.trim("line") != "")


def _quoted(delimiter: str) -> str:
    return "".join("\\" + c if c in "|.*+?()[]{}^$\\" else c for c in delimiter)


def _by_split(batches, header: bool):
    """(file, block), whether it is another one than before, and the rows of each batch's stretch of a split, without headers."""
    before = None
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())
        for _, part in pdf.groupby(change.cumsum(), sort=False):
            now = (part["file"].iat[0], int(part["block"].iat[0]))
            other = now != before
            yield now, other, part.iloc[1:] if header and other and not now[1] else part
            before = now


def _turns(columns: int, header: bool):
    """For each split, what each number of open cells at its start is at its end."""

    def run(batches):
        now, states = None, []
        starts = [0, *range(2, columns)]
        done = lambda: pd.DataFrame({"file": [now[0]], "block": [now[1]], "ends": [[s.open for s in states]]})
        for split, other, part in _by_split(batches, header):
            if other:
                if now is not None:
                    yield done()
                now, states = split, [Assembler(columns, s) for s in starts]
            for cells in part["cells"].tolist():
                for s in {id(x): x for x in states}.values():
                    s.goes_on(cells)
                if len(states) > 1 and len({s.open for s in states}) == 1:  # from here on all go alike
                    states = [states[0]] * len(states)
        if now is not None:
            yield done()

    return run


def _pieces(columns: int, opened: dict, header: bool):
    """Records, or pieces of those at a split's edges; opened: by split, the open cells and where their record began."""

    def run(batches):
        now, state, begun, held, edge, n = None, None, None, [], False, 0
        rows: list = []

        def close(last: bool):
            if held:
                rows.append((*begun, now[1], edge or last, "\n".join(held)))
                held.clear()

        for split, other, part in _by_split(batches, header):
            if other:
                close(True)
                now, n = split, 0
                cells, begun = opened[split]
                state, edge = Assembler(columns, cells), True
            for cells, line in zip(part["cells"].tolist(), part["line"].tolist()):
                if not state.goes_on(cells):
                    close(False)
                    begun, edge = (split[0], split[1], n), False
                held.append(line)
                n += 1
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=["file", "block", "n", "at", "piece", "record"])
                rows.clear()
        close(True)
        yield pd.DataFrame(rows, columns=["file", "block", "n", "at", "piece", "record"])

    return run


def read_torn(spark: SparkSession, path: str, columns: list[str], delimiter: str = "\t", header: bool = True) -> DataFrame:
    """A delimited file or folder without quotes, as text columns, where records may be torn by line breaks.

    A line of more than one cell and fewer than the columns goes on with the next
    line, whose first cell is added to its last one after a line feed, as long as
    the cells together are no more than the columns. Blank lines are left out, and
    so are records with nothing but empty cells; missing cells are null, cells
    beyond the columns are left out. Files are apart from each other. The driver
    holds a number for each split and column.
    """
    width = len(columns)
    given = _lines(spark, path, delimiter)
    tables = given.mapInPandas(_turns(width, header), "file string, block long, ends array<int>").collect()
    starts = [0, *range(2, width)]
    opened: dict = {}
    file = None
    for r in sorted(tables, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, cells = r["file"], 0
        opened[r["file"], r["block"]] = (cells, None)
        cells = r["ends"][starts.index(cells)]
    # where a record that is open at a split's start began: its last line that begins one before
    opened = _begun(given, opened, width, header)
    pieces = given.mapInPandas(_pieces(width, opened, header), "file string, block long, n long, at long, piece boolean, record string")
    whole = pieces.filter("not piece").select("record")
    torn = pieces.filter("piece").groupBy("file", "block", "n").agg(F.array_sort(F.collect_list(F.struct("at", "record"))).alias("parts"))
    joined = torn.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    cells = F.split("record", F.lit(_quoted(delimiter)), -1)
    out = whole.unionByName(joined).select(*(F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))
    return out.dropna(how="all")


def _begun(lines: DataFrame, opened: dict, width: int, header: bool) -> dict:
    """opened, with where the record that is open at each split's start began."""

    def run(batches):
        now, state, last, n = None, None, None, 0
        done = lambda: pd.DataFrame({"file": [now[0]], "block": [now[1]], "last": pd.array([last], "Int64")})
        for split, other, part in _by_split(batches, header):
            if other:
                if now is not None:
                    yield done()
                now, state, last, n = split, Assembler(width, opened[split][0]), None, 0
            for cells in part["cells"].tolist():
                if not state.goes_on(cells):
                    last = n
                n += 1
        if now is not None:
            yield done()

    begins = {(r["file"], r["block"]): r["last"] for r in lines.mapInPandas(run, "file string, block long, last long").collect()}
    out, at = {}, None
    for split in sorted(opened):
        if at is not None and at[0] != split[0]:
            at = None
        out[split] = (opened[split][0], at)
        if begins[split] is not None:
            at = (*split, begins[split])
    return out
