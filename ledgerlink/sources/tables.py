"""Uploaded tables in and result tables out: delimited text, spreadsheets, HTML."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlink.functions import normalize as N

ALLOWED = ("csv", "tsv", "xlsx", "xlsm")
DELIMITERS = [",", ";", "\t", "|"]
SIRET_COLUMNS = ["FR_SIRET", "SIRET", "Siret", "siret", "Original_SIRET"]
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def extension(path: str) -> str:
    """The file's kind; other kinds are refused."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind not in ALLOWED:
        raise ValueError(f"unsupported file type: {kind or 'none'}")
    return kind


def sniffed_delimiter(head: str) -> str:
    """The delimiter that stands equally often, and most often, in the first lines; ',' if none does."""
    lines = [x for x in head[:4096].lstrip("\ufeff").splitlines() if x.strip()][:20]
    counts = {d: [x.count(d) for x in lines] for d in DELIMITERS}
    steady = [d for d in DELIMITERS if lines and min(counts[d]) > 0]
    return max(steady or [d for d in DELIMITERS if any(counts[d])] or [","], key=lambda d: min(counts[d], default=0))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded table, every column as text; values that are missing are null."""
    kind = extension(path)
    if kind in ("xlsx", "xlsm"):
        spark.dataSource.register(SheetSource)
        return spark.read.format("sheet").load(path)
    head = spark.read.text(path).limit(20).collect()
    sep = "\t" if kind == "tsv" else sniffed_delimiter("\n".join(r.value for r in head))
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def header_row(rows: list[list[str]]) -> int:
    """Which of the first 25 rows is the header: many filled cells, words rather than numbers, filled rows below; of equals the first."""
    filled = [sum(bool((c or "").strip()) for c in r) for r in rows]
    best, at = -1, 0
    for i, r in enumerate(rows[:25]):
        if filled[i] < 2:
            continue
        wordy = sum(bool(re.search(r"[^\W\d_]", c or "")) for c in r)
        score = 10 * filled[i] + 3 * wordy + sum(min(f, filled[i]) for f in filled[i + 1 : i + 4])
        if score > best:
            best, at = score, i
    return at


def unique_headers(names: list[str | None]) -> list[str]:
    """Blank names numbered, repeated ones marked."""
    seen: dict[str, int] = {}
    out = []
    for k, n in enumerate(names, 1):
        n = (n or "").strip() or f"Colonne {k}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def sheet_matrix(path: str) -> list[list[str]]:
    """The first sheet's cells as text; rich text joined, formulas by their result."""
    with zipfile.ZipFile(path) as z:
        files = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in files:
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        sheet = min((f for f in files if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", f)), key=lambda f: int(re.sub(r"\D", "", f)))
        rows: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{NS}row"):
            cells: list[str] = []
            for c in row.iter(f"{NS}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = 26 * at + ord(letter) - 64
                while len(cells) < at - 1:
                    cells.append("")
                value = c.find(f"{NS}v")
                text = shared[int(value.text)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{NS}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                cells.append(text.strip())
            rows.append(cells)
    return rows


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        rows = sheet_matrix(self.path)
        for r in rows[header_row(rows) + 1 :]:
            if any(r):
                r = (r + [""] * self.width)[: self.width]
                yield tuple(x or None for x in r)


class SheetSource(DataSource):
    """Spreadsheets as a Spark data source; one upload is one partition."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self):
        from pyspark.sql.types import StringType, StructField, StructType

        rows = sheet_matrix(self.options["path"])
        names = unique_headers(rows[header_row(rows)] if rows else [])
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema):
        return SheetReader(self.options["path"], len(schema))


def first_column(df: DataFrame, wanted: list[str]) -> str | None:
    return next((c for c in wanted if c in df.columns), None)


def prepared(df: DataFrame, column: str) -> DataFrame:
    """The chosen column as FR_SIRET, over any that was there."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.withColumn("FR_SIRET", F.col(f"`{column}`"))


def regrouped(df: DataFrame) -> DataFrame:
    """ERP_ID, then Original_, Enriched_ and API_ columns, then the others, in their order."""
    groups = [lambda c: c == "ERP_ID", lambda c: c.startswith("Original_"), lambda c: c.startswith("Enriched_"), lambda c: c.startswith("API_")]
    return df.select(*[f"`{c}`" for c in sorted(df.columns, key=lambda c: next((k for k, g in enumerate(groups) if g(c)), 4))])


def column_widths(df: DataFrame, least: int = 12, most: int = 42) -> DataFrame:
    """Width of each column: its longest value or name and two, within bounds."""
    longest = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns])
    return longest.select(*[F.least(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0)) + 2, F.lit(len(c) + 2), F.lit(least)), F.lit(most)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls empty."""
    df.select(*[N.text(F.col(f"`{c}`")).alias(c) for c in df.columns]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def html_rows(df: DataFrame) -> DataFrame:
    """One escaped table row for each row."""
    cells = [F.concat(F.lit("<td>"), N.html_escape(F.col(f"`{c}`")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))
