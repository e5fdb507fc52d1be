"""The data source ``sqldump``: rows of all tables of a SQL dump, read in byte ranges. See ``sqldump`` for its use."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilwork.sources import files, sqltext
from veilwork.sources.sqltext import Segment

META = "struct<quoted:boolean,bare:string,tail:string,prefix:string>"
SCHEMA = f"table string, segment long, row long, columns array<string>, cells array<string>, meta array<{META}>"
PIECE_BYTES = 16 << 20


@dataclass
class _Piece(InputPartition):
    """Part of a dump: for each segment its number, kind, table, columns, byte range, header length and first row."""

    parts: list

    def __init__(self, parts: list):
        self.parts = parts


def index(path: str, dialect: str = "postgres") -> list[Segment]:
    """The segments of a dump; INSERTs without columns take those of the table's definition."""
    with files.opened(path) as file:
        found = list(sqltext.segments(file, dialect, PIECE_BYTES))
    defined = {s.table.lower(): [c for c, _ in s.more["definition"]] for s in found if s.kind == "create"}
    for s in found:
        if s.kind in ("insert", "copy") and s.columns is None:
            s.columns = defined.get(s.table.lower())
            if s.columns is None:
                raise sqltext.DumpError(f"rows of {s.table} name no columns, and its definition is not in the dump")
    return found


def lengths(found: list[Segment]) -> dict[str, dict[str, int]]:
    """Declared text lengths by table, under its qualified and, if it is the only one of that name, its bare name."""
    out: dict[str, dict[str, int]] = {}
    for s in found:
        if s.kind == "create":
            own = {c.lower(): n for c, n in s.more["definition"] if n is not None}
            for name in {s.table.lower(), s.table.lower().rpartition(".")[2]}:
                out.setdefault(name, {}).update(own)
    return out


def tables(found: list[Segment]) -> dict[str, list[str]]:
    """Columns by table: of definitions, INSERTs and COPYs."""
    out: dict[str, list[str]] = {}
    for s in found:
        columns = [c for c, _ in s.more["definition"]] if s.kind == "create" else s.columns or []
        if s.kind != "text":
            own = out.setdefault(s.table, [])
            own += [c for c in columns if c.lower() not in {o.lower() for o in own}]
    return out


def _pieces(path: str, found: list[Segment], table: str | None) -> list[_Piece]:
    out, parts, held = [], [], 0
    with files.opened(path) as file:
        for number, s in enumerate(found):
            if s.kind not in ("insert", "copy") or table is not None and s.table.lower() != table.lower():
                continue
            start, cuts = s.body if s.kind == "copy" else s.start, iter([*s.more.get("cuts", ()), s.end])
            while start < s.end:
                end = next(cuts) if s.kind == "insert" else s.end
                if s.kind == "copy" and end - start > PIECE_BYTES:
                    file.seek(start + PIECE_BYTES)
                    file.readline()
                    end = min(file.tell(), s.end)
                parts.append((number, s.kind, s.table, s.columns, start, end, len(s.header) if start == s.start else 0, start - s.start))
                held += end - start
                start = end
                if held >= PIECE_BYTES:
                    out.append(_Piece(parts))
                    parts, held = [], 0
    return out + ([_Piece(parts)] if parts else []) or [_Piece([])]


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("sqldump needs a path")
        self.index = options.get("index")
        self.dialect = sqltext.DIALECTS[options.get("dialect", "postgres").lower()]
        self.table = options.get("table")

    def partitions(self):
        if self.index:
            with files.opened(self.index) as file:
                return _pieces(self.path, pickle.load(file), self.table)
        return _pieces(self.path, index(self.path, self.dialect), self.table)

    def read(self, partition: _Piece) -> Iterator[tuple]:
        with files.opened(self.path) as file:
            for number, kind, table, columns, start, end, header, base in partition.parts:
                file.seek(start)
                if kind == "insert":  # rows count from their piece's place, which is far enough from the next
                    text = file.read(end - start).decode("utf-8", "surrogateescape")
                    for i, row in enumerate(sqltext.rows(text if header else text.lstrip().removeprefix(","), header)[0]):
                        yield table, number, base + i, columns, [c.value for c in row], [(c.quoted, c.bare, c.tail, c.prefix) for c in row]
                    continue
                at = start
                while at < end:  # a row's number is its byte place, which is in order and needs no counting across pieces
                    raw = file.readline()
                    cells = raw.decode("utf-8", "surrogateescape").rstrip("\r\n").split("\t")
                    yield table, number, at, columns, [sqltext.copy_decoded(c) for c in cells], None
                    at += len(raw)


class SqlDump(DataSource):
    """Options: path, dialect (postgres, sqlite, mssql), table, and index, a file of segments found before (``save_index``)."""

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)
