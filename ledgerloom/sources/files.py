"""Data sources of this library: a writer of one file an invoice or supplier, a reader of pages that skips files.

``register(spark)`` makes them known; then ``df.write.format("invoice_files")`` and ``spark.read.format("page_files")``.
Paths go through pyarrow's file systems, so a shared store works as a local folder does.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.operators.report import with_egp, with_subtotals

#: Staged files lie here until the job commits; Spark's readers pass over it.
STAGING = "_staging"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]+:", path) else (pafs.LocalFileSystem(), path)


def file_name(key: object, part: int, suffix: str) -> str:
    """A key's file: letters, digits and _.- stay, all else is percent-encoded, so different keys, and their parts from 1 on (after a +), never meet; a null key is ``%00``."""
    name = "%00" if key is None else quote(str(key), safe="").replace("~", "%7E")
    return f"{'%2E' + name[1:] if name.startswith('.') else '%5F' + name[1:] if name.startswith('_') else name}{f'+{part}' if part else ''}{suffix}"


@dataclass
class Written(WriterCommitMessage):
    """What a task staged: its folder and its files' final names, compressed; the staged files are numbered in that order."""

    folder: str
    names: bytes

    def files(self) -> Iterator[tuple[str, str]]:
        """(staged path, final name) of each file."""
        names = zlib.decompress(self.names).decode()
        return ((f"{self.folder}/{i}", name) for i, name in enumerate(names.split("\n") if names else ()))


class _Csv:
    def __init__(self, out: io.BufferedIOBase, header: Sequence[str]) -> None:
        self.out = io.TextIOWrapper(out, encoding="utf-8", newline="")
        self.rows = csv.writer(self.out, lineterminator="\n")
        self.rows.writerow(header)

    def add(self, values: Sequence[object]) -> None:
        self.rows.writerow(["" if v is None else v for v in values])

    def close(self) -> None:
        self.out.close()


class _Workbook:
    """Needs openpyxl, whose write-only sheets stream their rows."""

    def __init__(self, out: io.BufferedIOBase, header: Sequence[str]) -> None:
        from openpyxl import Workbook

        self.out, self.book = out, Workbook(write_only=True)
        self.sheet = self.book.create_sheet("Invoices")
        self.sheet.append(list(header))

    def add(self, values: Sequence[object]) -> None:
        self.sheet.append(list(values))

    def close(self) -> None:
        self.book.save(self.out)
        self.out.close()


class InvoiceFilesWriter(DataSourceWriter):
    """Rows arrive sorted by key and part; a task streams each run of them into one staged file.

    A task that fails or runs twice leaves its staged files behind, which nobody names: only what committed tasks name is
    moved, each over the file it replaces, and the staging folder goes at the end, whatever the outcome.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.by = options["path"], options["by"]
        self.part = options.get("part")
        self.suffix = ".xlsx" if options.get("kind", "csv") == "xlsx" else ".csv"
        self.columns = [c for c in schema.names if c not in (self.by, self.part)]
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _store(self.path)
        staged, names, now, out = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", [], None, None
        fs.create_dir(staged, recursive=True)
        for row in iterator:
            key = (row[self.by], row[self.part] if self.part else 0)
            if out is None or key != now:
                if out is not None:
                    out.close()
                stream = fs.open_output_stream(f"{staged}/{len(names)}")
                names.append(file_name(*key, self.suffix))
                now, out = key, (_Workbook if self.suffix == ".xlsx" else _Csv)(stream, self.columns)
            out.add([row[c] for c in self.columns])
        if out is not None:
            out.close()
        return Written(staged, zlib.compress("\n".join(names).encode()))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        names = set()
        for _, name in (f for m in messages if m for f in m.files()):
            if name in names:
                self.abort(messages)
                raise ValueError("rows of one key lie in several tasks or apart: repartition and sort by it first")
            names.add(name)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if info.type == pafs.FileType.File and info.base_name.endswith(self.suffix) and info.base_name not in names:
                    fs.delete_file(info.path)
        for staged, name in (f for m in messages if m for f in m.files()):
            fs.move(staged, f"{root}/{name}")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        folder = f"{root}/{STAGING}/{self.job}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)
        if not fs.get_file_info(pafs.FileSelector(f"{root}/{STAGING}", allow_not_found=True)) and fs.get_file_info(f"{root}/{STAGING}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{STAGING}")


class InvoiceFiles(DataSource):
    """One file for each value of the column ``by``; options: path, by, part (a column that cuts a key's rows into several files), kind (csv or xlsx)."""

    @classmethod
    def name(cls) -> str:
        return "invoice_files"

    def writer(self, schema: StructType, overwrite: bool) -> InvoiceFilesWriter:
        return InvoiceFilesWriter(dict(self.options), schema, overwrite)


def export_files(df: DataFrame, path: str, by: str = "doc_id", order: str = "row_idx", rates: dict[str, float] | None = None, kind: str = "csv", max_rows: int = 1_000_000) -> None:
    """Writes one file for each value of ``by``: its rows in ``order``, their EGP amounts, and last the subtotal.

    Keys are dealt over tasks, and keys whose ``order`` passes ``max_rows`` over several files, so one large key is no task
    of its own. Files of keys that are written again are replaced; other files stay.
    """
    register(df.sparkSession)
    whole = with_subtotals(with_egp(df, rates), by, order)
    part = F.coalesce(F.floor(F.col(f"`{order}`") / max_rows).cast("int"), F.lit(0))
    dealt = whole.withColumn("__part", part).repartition(by, "__part").sortWithinPartitions(by, "__part", "is_total", order)
    dealt.drop("is_total", order).write.format("invoice_files").mode("append").options(path=path, by=by, part="__part", kind=kind).save()


# Pages


@dataclass
class Files(InputPartition):
    """(path, doc_id, page, bytes) of the files that one task reads."""

    files: list[tuple[str, str, int, int]]


_PAGE = re.compile(r"(.+)/page-(\d+)\.[^./]+")


class PageFilesReader(DataSourceReader):
    """Lists the files once, drops those that pushed filters rule out, and deals the rest into tasks of about ``task_bytes``."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.suffix, self.task_bytes = options.get("suffix", ""), int(options.get("task_bytes", 64 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("doc_id",), ("page",), ("length",)):
                continue  # they never are
            if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual, StringStartsWith)) and f.attribute in (("doc_id",), ("page",)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, doc_id: str, page: int) -> bool:
        return all(self._passes(f, doc_id if f.attribute == ("doc_id",) else page) for f in self.tests)

    @staticmethod
    def _passes(f: Filter, value: str | int) -> bool:
        if isinstance(f, In):
            return value in f.value
        tests = {EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, StringStartsWith: str.startswith}
        return tests[type(f)](value, f.value)

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _store(self.path)
        root = root.rstrip("/")
        files, size = [[]], 0
        found = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and i.path.lower().endswith(self.suffix.lower())]
        for info in sorted(found, key=lambda i: i.path):
            name = info.path[len(root) + 1 :]
            if any(p.startswith(("_", ".")) for p in name.split("/")):
                continue
            paged = _PAGE.fullmatch(name)
            doc_id, page = (paged[1], int(paged[2])) if paged else (name, 0)
            if self._wanted(doc_id, page):
                if files[-1] and size + info.size > self.task_bytes:
                    files.append([])
                    size = 0
                files[-1].append((info.path, doc_id, page, info.size))
                size += info.size
        return [Files(f) for f in files]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        names = self.schema.names
        for path, doc_id, page, size in partition.files:
            # Contents are opened only if a column asks for them.
            content = None
            if "content" in names:
                with fs.open_input_stream(path) as stream:
                    content = stream.read().decode("utf-8", errors="replace")
            whole = {"doc_id": doc_id, "page": page, "length": size, "content": content}
            yield tuple(whole[n] for n in names)


class PageFiles(DataSource):
    """(doc_id, page, length, content) of text files below ``path``: box dumps or recognizer answers, a page a file.

    ``<name>/page-<n>.<suffix>`` is page n of the document ``<name>``; any other file is page 0 of a document of its own.
    Options: path, suffix, task_bytes, and columns, those to read; filters on doc_id and page leave files unopened.
    """

    COLUMNS = {"doc_id": "string", "page": "int", "length": "bigint", "content": "string"}

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", ",".join(self.COLUMNS)).split(",")]
        return ", ".join(f"{c} {self.COLUMNS[c]}" for c in wanted)

    def reader(self, schema: StructType) -> PageFilesReader:
        return PageFilesReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (InvoiceFiles, PageFiles):
        spark.dataSource.register(source)


def page_files(spark: SparkSession, path: str, suffix: str = "", columns: Sequence[str] = tuple(PageFiles.COLUMNS), task_bytes: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("page_files").options(path=path, suffix=suffix, columns=",".join(columns), task_bytes=task_bytes).load()


def dumped_boxes(pages: DataFrame) -> DataFrame:
    """Boxes of tab-separated dumps among ``pages`` (doc_id, page, content), like ``readers.read_box_dump``; # lines are left out."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line")).where("line <> '' and line not like '#%'")
    part = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    numbers = [part(i).try_cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "confidence"), 1)]
    # Blank and comment lines don't count, so a box's number is its place among the others.
    nth = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("at")) - 1
    return lines.withColumn("box_id", nth).select("doc_id", "page", "box_id", part(0).alias("text"), *numbers, F.lit(None).cast("double").alias("page_width"))

