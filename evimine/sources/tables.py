"""Reading and writing tables: workbooks, CSV of unknown encoding, JSON manifests, audits and packages."""

from __future__ import annotations

import csv
import json
import os
import re
import shutil
import zipfile
from datetime import datetime
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from evimine.sources import csv_splits

ENCODINGS = ("UTF-8", "GB18030")


def find_sheet(names: list[str], keywords: list[str]) -> str | None:
    """The sheet that holds all keywords, else any of them; of several the one with the smallest number in front."""

    def place(name: str) -> int:
        found = re.match(r"(\d+)_", name)
        return int(found[1]) if found else 9999

    for test in (all, any):
        if found := [n for n in names if test(k in n for k in keywords)]:
            return min(found, key=lambda n: (place(n), names.index(n)))
    return None


def first_existing(spark: SparkSession, folders: list[str], name: str) -> str | None:
    """The first path that exists, by the file system that the path names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}" if folder else name)
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    return None


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """All columns as text, empty ones null, names without white space around them. The first encoding that all bytes allow wins, else the last; a byte order mark goes.

    Files are split among tasks, whatever their quoted line ends; UTF-16, whose bytes cannot be split so, is read a file at a time.
    """
    if not encodings:
        raise ValueError("no encoding given")
    if any(e.upper().startswith("UTF-16") for e in encodings):
        return stripped(spark.read.option("header", True).option("encoding", encodings[0]).option("multiLine", True).option("escape", '"').csv(path))
    return stripped(csv_splits.read(spark, path, encodings))


def stripped(df: DataFrame) -> DataFrame:
    """df without white space around its column names."""
    return df.toDF(*(c.strip() for c in df.columns))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With header; one_file only for results of bounded size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def export_csv(df: DataFrame, path: str, encoding: str = "utf-8-sig") -> int:
    """One file for people, in their encoding (`utf-8-sig` has a byte order mark, `gb18030` is the other); the number of rows.

    Rows pass through the driver a partition at a time, so memory is bounded but time is not: for reports and cohorts.
    """
    n = 0
    with open(path, "w", encoding=encoding, newline="") as f:
        writer = csv.writer(f)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def named_features(df: DataFrame, candidates: tuple[str, ...] = ("Selected_Features", "Feature", "feature"), strict: bool = True) -> DataFrame:
    """`feature`: the non-blank texts of the first candidate column that there is; without one an error, or the first column unless strict."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and (strict or not df.columns):
        raise KeyError(f"none of {candidates}")
    text = F.trim(F.col(f"`{found or df.columns[0]}`").cast("string"))
    return df.select(text.alias("feature")).where("feature <> ''")


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a table; columns may be new."""
    df.write.mode("append").option("mergeSchema", True).parquet(path)


def read_manifest(path: str) -> dict:
    """A JSON file as dict, empty if there is none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_manifest(content: dict, path: str, **defaults: str) -> None:
    """content over provenance defaults; the run id comes from the environment unless given."""
    whole = {"run_id": os.environ.get("RUN_ID", ""), **defaults, **content}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, ensure_ascii=False, indent=2)


def package(files: list[str], path: str) -> list[str]:
    """Writes files into a zip archive, checks it, and returns the names of files that were missing."""
    missing = [f for f in files if not os.path.exists(f)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            if f not in missing:
                z.write(f, os.path.basename(f))
    with zipfile.ZipFile(path) as z:
        if z.testzip() is not None or len(z.namelist()) != len(files) - len(missing):
            raise ValueError(f"{path} is damaged")
    return missing


INDEX = "00_PACKAGE_INDEX.csv"


def verify_package(path: str, required: list[str], manifests: list[str] | None = None) -> list[tuple[str, str, int, list[str]]]:
    """Per list of files (the required ones, and the `outputs` of each manifest): its name, status, length, and which of them the archive lacks. Files count by their last name."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
    lists = {"required": required}
    for m in manifests or []:
        outputs = read_manifest(m).get("outputs", [])
        lists[os.path.basename(m)] = [outputs] if isinstance(outputs, str) else outputs if isinstance(outputs, list) else []
    rows = []
    for name, files in lists.items():
        wanted = [os.path.basename(str(f)) for f in files if str(f).strip()]
        missing = sorted(set(wanted) - names)
        rows.append((name, "FAIL" if missing else "PASS", len(wanted), missing))
    return rows


def package_folder(files: list[str], folder: str, archive: str, category) -> list[dict]:
    """Copies files into a folder, with an index of all of them (also the missing) beside; the index's rows.

    category tells what a file of some name belongs to. A folder that is there is replaced if it holds an index, so is an earlier package, or
    nothing; any other is an error. Of two files of one name, which would overwrite each other, none is copied: that is an error too.
    """
    names = [os.path.basename(f) for f in files]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several files named {', '.join(twice)}")
    if os.path.isdir(folder) and os.listdir(folder):
        if not os.path.exists(os.path.join(folder, INDEX)):
            raise ValueError(f"{folder} holds something else than a package")
        inside = os.path.realpath(folder) + os.sep
        if held := [f for f in files if os.path.realpath(f).startswith(inside)]:
            raise ValueError(f"{held[0]} lies in the folder that is replaced")
        shutil.rmtree(folder)
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        packed = set(z.namelist())
    rows = []
    for f, name in zip(files, names, strict=True):
        there = os.path.exists(f)
        if there:
            shutil.copy2(f, os.path.join(folder, name))
        changed = datetime.fromtimestamp(os.path.getmtime(f)).isoformat(timespec="seconds") if there else ""
        rows.append({
            "File": name, "Category": category(name), "Required": True, "Exists": there, "Size_Bytes": os.path.getsize(f) if there else 0,
            "Modified_Time": changed, "Included_In_Zip": name in packed, "Notes": "" if there else "missing",
        })
    with open(os.path.join(folder, INDEX), "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.DictWriter(out, ["File", "Category", "Required", "Exists", "Size_Bytes", "Modified_Time", "Included_In_Zip", "Notes"])
        writer.writeheader()
        writer.writerows(rows)
    return rows


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROW, _OPEN = re.compile(rb"<row(?:\s[^>]*)?(?:/>|(?<!/)>(.*?)</row>)", re.DOTALL), re.compile(rb"<row[\s/>]")
_HEAD = f'<row xmlns="{_MAIN[1:-1]}">'.encode()


class Workbook:
    """Sheets of an .xlsx file, as text."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(BytesIO(content))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        self.paths = {s.get("name"): "xl/" + links[s.get(_REL)].removeprefix("/xl/") for s in sheets}
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for item in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                self.shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))

    def raw_rows(self, sheet: str):
        """The XML between the tags of each row, a megabyte of the sheet at a time."""
        with self.zip.open(self.paths[sheet]) as f:
            left = b""
            while True:
                more = f.read(1 << 20)
                left += more
                done = 0
                for found in _ROW.finditer(left):
                    yield found[1] or b""
                    done = found.end()
                # what no row can begin in goes
                left = left[done:] if _OPEN.search(left, done) else left[max(done, len(left) - 8) :]
                if not more:
                    return

    def count(self, sheet: str) -> int:
        return sum(1 for _ in self.raw_rows(sheet))

    def rows(self, sheet: str, low: int = 0, high: int | None = None):
        """Lists of texts, None for empty cells, of the rows from low to before high; only those are parsed."""
        for raw in islice(self.raw_rows(sheet), low, high):
            out: list[str | None] = []
            for cell in ElementTree.fromstring(_HEAD + raw + b"</row>").iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]+", cell.get("r", "") or "")
                at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else len(out)
                out += [None] * (at + 1 - len(out))
                out[at] = self._text(cell)
            yield out

    def _text(self, cell) -> str | None:
        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        return self.shared[int(value.text)] if kind == "s" else value.text


class XlsxSource(DataSource):
    """`spark.read.format("xlsx").option("path", ...).option("sheet", ...)`: one sheet, its first row the header, all columns text.

    Options: path (seen by all workers), sheet or keywords (comma-separated, see find_sheet), and rows, how many a task parses (50,000). Tasks
    unpack the sheet up to their rows; the texts that cells share are held by each.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _open(self) -> tuple[Workbook, str]:
        with open(self.options["path"], "rb") as f:
            book = Workbook(f.read())
        sheet = self.options.get("sheet") or find_sheet(list(book.paths), self.options.get("keywords", "").split(","))
        if sheet not in book.paths:
            raise ValueError(f"no sheet {sheet} in {self.options['path']}")
        return book, sheet

    def schema(self) -> StructType:
        book, sheet = self._open()
        header = next(iter(book.rows(sheet)), [])
        return StructType([StructField((c or f"_c{i}").strip(), StringType()) for i, c in enumerate(header)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self, len(schema.fields))


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _XlsxReader(DataSourceReader):
    def __init__(self, source: XlsxSource, width: int):
        self.source, self.width = source, width

    def partitions(self):
        book, sheet = self.source._open()
        n, each = book.count(sheet), int(self.source.options.get("rows", "50000"))
        return [_Rows(low, min(n, low + each)) for low in range(1, n, each)] or [_Rows(1, 1)]

    def read(self, partition):
        book, sheet = self.source._open()
        for row in book.rows(sheet, partition.low, partition.high):
            yield tuple((row + [None] * self.width)[: self.width])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
