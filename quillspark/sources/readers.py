"""Python data sources with planned partitions: members of zip archives, MDict dictionaries, SQLite tables.

A path is a local one or a URI of a store that Arrow reaches (file, hdfs, s3, gs); a folder stands for the files in it.
The driver reads directories and indexes only and plans partitions from them; contents are read by the tasks.
"""

from __future__ import annotations

import fnmatch
import re
import sqlite3
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from .dictionaries import _entries, decoded


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://|file:", path) else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[str]:
    """The files under a path, as paths of its file system."""
    store, name = _located(path)
    if store.get_file_info(name).type == fs.FileType.Directory:
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(suffix))
    return [name]


@dataclass
class Part(InputPartition):
    file: str
    first: int
    last: int
    members: Sequence[str] = ()


class ZipMembers(DataSource):
    """(archive, member, size, content): the members of archives whose names match ``pattern``, up to ``bytes`` of content a partition.

    Conditions on the member (equal, in, starts with) are decided from the archive's directory, before a member is read.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZipReader(self.options)


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern, self.most = options["path"], options.get("pattern", "*"), int(options.get("bytes", 64 << 20))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("member",):
                self.wanted.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("member",):
                self.wanted.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("member",):
                self.wanted.append(("prefix", f.value))
            else:
                yield f

    def _takes(self, member: str) -> bool:
        return fnmatch.fnmatch(member, self.pattern) and all(member in v if kind == "in" else member.startswith(v) for kind, v in self.wanted)

    def partitions(self) -> list[Part]:
        out = []
        store, _ = _located(self.path)
        for file in _files(self.path, ".zip"):
            with store.open_input_file(file) as source, zipfile.ZipFile(source) as archive:
                held, size = [], 0
                for info in archive.infolist():
                    if info.is_dir() or not self._takes(info.filename):
                        continue
                    if held and size + info.file_size > self.most:
                        out.append(Part(file, 0, 0, held))
                        held, size = [], 0
                    held.append(info.filename)
                    size += info.file_size
                if held:
                    out.append(Part(file, 0, 0, held))
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.members:
            return
        store, _ = _located(self.path)
        with store.open_input_file(part.file) as source, zipfile.ZipFile(source) as archive:
            for member in part.members:
                content = archive.read(member)
                yield part.file, member, len(content), content


class Mdict:
    """The directory of an MDict file (versions 1 and 2, without encryption; blocks plain or deflated)."""

    def __init__(self, source):
        self.source = source
        size = int.from_bytes(source.read(4), "big")
        header = source.read(size).decode("utf-16-le", "replace")
        source.read(4)
        self.header = dict(re.findall(r'(\w+)="([^"]*)"', header))
        if self.header.get("Encrypted", "No") not in ("No", "0", ""):
            raise ValueError("encrypted dictionaries are not read")
        self.new = float(self.header.get("GeneratedByEngineVersion", "2.0")) >= 2
        self.width = 8 if self.new else 4
        name = self.header.get("Encoding", "") or "UTF-8"
        self.encoding = {"GBK": "gb18030", "GB2312": "gb18030", "UTF-16": "utf-16-le"}.get(name.upper(), name)
        self.mark = 2 if self.encoding == "utf-16-le" else 1
        self._keys()
        self._records()

    def _number(self, n: int | None = None) -> int:
        return int.from_bytes(self.source.read(n or self.width), "big")

    def _keys(self) -> None:
        blocks, _ = self._number(), self._number()
        if self.new:
            self._number()
        info_size, keys_size = self._number(), self._number()
        if self.new:
            self.source.read(4)
        info = self.source.read(info_size)
        at, small = 0, 2 if self.new else 1
        if self.new:
            info = unpacked(info)
        self.key_blocks, start = [], self.source.tell()
        for _ in range(blocks):
            entries = int.from_bytes(info[at : at + self.width], "big")
            at += self.width
            for _ in range(2):  # the first and the last key
                n = int.from_bytes(info[at : at + small], "big") + (1 if self.new else 0)
                at += small + n * self.mark
            packed, plain = (int.from_bytes(info[at + i * self.width : at + (i + 1) * self.width], "big") for i in range(2))
            at += 2 * self.width
            self.key_blocks.append((start, packed, plain, entries))
            start += packed
        self.source.seek(self.key_blocks[0][0] + keys_size if self.key_blocks else self.source.tell() + keys_size)

    def _records(self) -> None:
        blocks, _, _, _ = (self._number() for _ in range(4))
        sizes = [(self._number(), self._number()) for _ in range(blocks)]
        self.record_blocks, start, offset = [], self.source.tell(), 0
        for packed, plain in sizes:
            self.record_blocks.append((start, packed, offset, plain))
            start, offset = start + packed, offset + plain
        self.total = offset

    def keys(self, block: int) -> list[tuple[int, str]]:
        """The offset and key of each entry of a key block."""
        start, packed, _, _ = self.key_blocks[block]
        self.source.seek(start)
        data, at, out = unpacked(self.source.read(packed)), 0, []
        end = b"\0" * self.mark
        while at + self.width < len(data):
            offset, stop = int.from_bytes(data[at : at + self.width], "big"), at + self.width
            while data[stop : stop + self.mark] != end:
                stop += self.mark
            out.append((offset, data[at + self.width : stop].decode(self.encoding, "replace")))
            at = stop + self.mark
        return out

    def entries(self, first: int, last: int) -> Iterator[tuple[str, str]]:
        """(key, text) of the entries of key blocks first to last."""
        found = [x for b in range(first, last + 1) for x in self.keys(b)]
        after = self.keys(last + 1)[0][0] if last + 1 < len(self.key_blocks) else self.total
        blocks, held = iter(self.record_blocks), (0, b"")
        for (offset, key), stop in zip(found, [o for o, _ in found[1:]] + [after], strict=True):
            while held[0] + len(held[1]) < stop:  # records may cross blocks
                start, packed, begin, plain = next(blocks)
                if begin + plain <= offset:
                    continue
                self.source.seek(start)
                data = unpacked(self.source.read(packed))
                held = (begin, data) if begin + plain > offset >= begin else (offset, held[1][offset - held[0] :] + data)
            yield key, held[1][offset - held[0] : stop - held[0]].decode(self.encoding, "replace").rstrip("\0")


def unpacked(block: bytes) -> bytes:
    kind = block[:4]
    if kind == b"\x02\0\0\0":
        return zlib.decompress(block[8:])
    if kind == b"\0\0\0\0":
        return block[8:]
    raise ValueError("blocks packed with LZO are not read")


class MdictEntries(DataSource):
    """(headword, definition): the entries of .mdx files, so many key blocks a partition.  An entry that only points to another is left as it is."""

    @classmethod
    def name(cls) -> str:
        return "mdict"

    def schema(self) -> str:
        return "headword string, definition string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MdictReader(self.options)


class _MdictReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blocks = options["path"], int(options.get("blocks", 32))

    def partitions(self) -> list[Part]:
        store, _ = _located(self.path)
        out = []
        for file in _files(self.path, ".mdx"):
            with store.open_input_file(file) as source:
                n = len(Mdict(source).key_blocks)
            out += [Part(file, i, min(i + self.blocks, n) - 1) for i in range(0, n, self.blocks)]
        return out or [Part("", 0, -1)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.last < part.first:
            return
        store, _ = _located(self.path)
        with store.open_input_file(part.file) as source:
            yield from Mdict(source).entries(part.first, part.last)


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteTable(DataSource):
    """Rows of a table (option ``table``) with the columns of the schema given, by ranges of row ids (option ``partitions``).

    Comparisons of a column with a number or string are made by the database.  A file of a remote store is held in a task's memory.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.columns, self.wanted = schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _SIGNS and len(f.attribute) == 1 and type(f.value) in (int, float, str):
                self.wanted.append((f"{_quoted(f.attribute[0])} {_SIGNS[type(f)]} ?", f.value))
            else:
                yield f

    def _open(self) -> sqlite3.Connection:
        store, name = _located(self.path)
        if isinstance(store, fs.LocalFileSystem):
            return sqlite3.connect(f"file:{name}?mode=ro&immutable=1", uri=True)
        with store.open_input_file(name) as source:
            data = source.read()
        database = sqlite3.connect(":memory:")
        database.deserialize(data)
        return database

    def partitions(self) -> list[Part]:
        database = self._open()
        try:
            low, high = database.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        finally:
            database.close()
        if low is None:
            return [Part("", 0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [Part(self.path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.last < part.first:
            return
        database = self._open()
        try:
            where = " AND ".join(["rowid BETWEEN ? AND ?", *(w for w, _ in self.wanted)])
            rows = database.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE {where}", (part.first, part.last, *(v for _, v in self.wanted)))
            while some := rows.fetchmany(1000):
                yield from some
        finally:
            database.close()


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipMembers, MdictEntries, SqliteTable):
        spark.dataSource.register(source)


def zipped_texts(spark: SparkSession, path: str, pattern: str = "*", encoding: str | None = None) -> DataFrame:
    """(archive, member, text) of the texts in zip archives, decoded as single files are."""
    register(spark)
    rows = spark.read.format("zip_members").option("path", path).option("pattern", pattern).load()
    return rows.select("archive", "member", decoded(F.col("content"), encoding).alias("text"))


def mdict(spark: SparkSession, path: str, blocks: int = 32) -> DataFrame:
    """Entries of MDict dictionaries, in the columns of every dictionary; entries that point to another (@@@LINK=) are left out."""
    register(spark)
    none = F.lit(None).cast("string")
    rows = spark.read.format("mdict").option("path", path).option("blocks", blocks).load()
    return _entries(rows.filter(~F.col("definition").startswith("@@@LINK=")), F.col("headword"), none, F.col("definition"), none, none)


def sqlite_entries(spark: SparkSession, path: str, table: str, headword: str, definition: str, reading: str | None = None, external_id: str | None = None, partitions: int = 8) -> DataFrame:
    """Entries of a dictionary in an SQLite table, by the names of its columns."""
    register(spark)
    fields = list(dict.fromkeys(f for f in (headword, definition, reading, external_id) if f))
    rows = spark.read.format("sqlite").schema(", ".join(f"`{f}` string" for f in fields)).option("path", path).option("table", table).option("partitions", partitions).load()
    col = lambda f: F.col(f"`{f}`") if f else F.lit(None).cast("string")
    return _entries(rows, col(headword), col(reading), col(definition), col(external_id), F.lit(None).cast("string"))
