"""Reading SQL dump text: statements, rows of INSERT and COPY, table definitions; and writing cells back.

A dump is a run of segments: stretches of text that pass through as they are, INSERT statements, COPY blocks and table
definitions. Segments are found line by line with the state of quotes and parentheses carried along, so each character is
looked at once however long a statement is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

DIALECTS = {"postgres": "postgres", "postgresql": "postgres", "pg": "postgres", "sqlite": "sqlite", "sqlite3": "sqlite", "mssql": "mssql", "sqlserver": "mssql"}

#: Names are never given back in part: of a list of names whose statement goes on in the next line, all ways to cut them would be tried.
NAME = r'(?:"(?:[^"]|"")++"|\[(?:[^\]]|\]\])++\]|`[^`]+`|[^\s"\[\]`(),;.]++)'
TABLE = rf"{NAME}(?:\s*\.\s*{NAME})*"
INSERT = re.compile(rf"\s*INSERT\s+(?:OR\s+(?:REPLACE|IGNORE)\s+)?INTO\s+(?P<table>{TABLE})\s*(?P<columns>\((?:{NAME}|[\s,])*+\))?\s*(?:OVERRIDING\s+\w+\s+VALUE\s*)?VALUES\s*(?=\()", re.I)
INSERT_START = re.compile(r"\s*INSERT\s+(?:OR\s+(?:REPLACE|IGNORE)\s+)?INTO\b", re.I)
COPY = re.compile(rf"COPY\s+(?P<table>{TABLE})\s*(?P<columns>\((?:{NAME}|[\s,])*+\))?\s*FROM\s+stdin\s*(?P<options>[^;]*);\s*$", re.I)
CREATE = re.compile(rf"\s*CREATE\s+(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:ONLY\s+)?(?P<table>{TABLE})\s*\(", re.I)
CREATE_START = re.compile(r"\s*CREATE\s+(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\b", re.I)
BOUNDED = re.compile(r"^(?:n?varchar|character\s+varying|n?char|character|bpchar)\s*\(\s*(\d+)\s*\)", re.I)
#: A name in brackets; brackets around nothing or a number are those of an array.
BRACKETED = re.compile(r"\[(?!\s*\d*\s*\])[^\]]+\]")
CONSTRAINT = re.compile(r"^(?:constraint|primary|foreign|unique|check|exclude|like|index|key)\b", re.I)


class DumpError(ValueError):
    """Text that can't be read as the dump it seems to be."""


def plain_name(name: str) -> str:
    name = name.strip()
    if name[:1] == '"':
        return name[1:-1].replace('""', '"')
    if name[:1] == "[":
        return name[1:-1].replace("]]", "]")
    return name[1:-1] if name[:1] == "`" else name


def table_name(text: str) -> str:
    """``schema.table`` or ``table`` without quotes; of longer names the last two parts."""
    return ".".join(plain_name(p) for p in re.findall(NAME, text)[-2:])


def column_names(text: str | None) -> list[str] | None:
    return None if not text else [plain_name(p) for p in re.findall(NAME, text[1:-1])]


# -- segments -----------------------------------------------------------------------------------------------------------


@dataclass
class Segment:
    """``kind``: text, insert, copy or create. ``start`` and ``end`` are byte places; a copy's rows begin at ``body``."""

    kind: str
    start: int
    end: int
    header: str = ""
    table: str = ""
    columns: list[str] | None = None
    body: int = 0
    more: dict = field(default_factory=dict)


class Boundary:
    """Where a statement ends: a semicolon outside quotes, comments and parentheses, fed piece by piece."""

    _mark = re.compile(r"""'|"|\[|`|--|/\*|\(|\)|;""")
    _next = re.compile(r"\s*\S?")
    #: A whole row without parentheses inside it, found in one step. What it doesn't fit is looked at mark by mark.
    _row = {
        dialect: re.compile(rf"""[\s,]*+\((?:[^'"`()\-/{other}]++|-(?!-)|/(?!\*)|'[^']*+'|"[^"]*+"|`[^`]*+`|{more})*+\)""", re.S)
        for dialect, other, more in (
            ("postgres", "eE", r"[eE](?!')|(?<![^\W_])[eE]'(?:[^'\\]++|\\.)*+'(?!')"), ("sqlite", r"\[", r"\[[^\]]*+\]"), ("mssql", r"\[", r"\[[^\]]*+\]"),
        )
    }

    def __init__(self, dialect: str, rows: bool = False):
        self.dialect, self.open, self.depth = dialect, "", 0
        #: Where rows end, in the piece fed last: after the first row that no comma follows. Only looked for in rows.
        self.rows_end: int | None = None
        self._seeks, self._after_row = rows, False

    def feed(self, text: str) -> int | None:
        """Where the statement ends in this piece, after its semicolon; None if it goes on."""
        i = 0
        self.rows_end = None
        if self._after_row:
            self._look(text, 0)
        while i < len(text):
            if self.open:
                i = self._close(text, i)
                continue
            if self._seeks and not self.depth and (row := self._row[self.dialect].match(text, i)):
                i = row.end()
                self._look(text, i)
                continue
            found = self._mark.search(text, i)
            if not found:
                return None
            mark, i = found[0], found.end()
            if mark == ";":
                if self.depth <= 0:
                    return i
            elif mark == "(":
                self.depth += 1
            elif mark == ")":
                self.depth -= 1
                if self._seeks and not self.depth:
                    self._look(text, i)
            elif mark == "--":
                end = text.find("\n", i)
                i = len(text) if end < 0 else end
            elif mark == "'":
                self.open = "e'" if self.dialect == "postgres" and found.start() and text[found.start() - 1] in "eE" and not text[found.start() - 2 : found.start() - 1].isalnum() else "'"
            elif mark == "[" and self.dialect == "postgres":
                continue  # an array
            else:
                self.open = {"[": "]", "/*": "*/"}.get(mark, mark)
        return None

    def _look(self, text: str, i: int) -> None:
        """What follows a row: a comma, nothing yet, or something else, which ends the rows."""
        found = self._next.match(text, i)[0].strip()
        self._after_row = not found
        if found and found != ",":
            self.rows_end, self._seeks = i, False

    def between_rows(self) -> bool:
        return self._seeks and not self.open and not self.depth

    def _close(self, text: str, i: int) -> int:
        if self.open == "e'":
            while i < len(text):
                if text[i] == "\\":
                    i += 2
                elif text[i] == "'":
                    self.open = ""
                    return i + 1
                else:
                    i += 1
            return i
        end = text.find(self.open, i)
        if end < 0:
            return len(text)
        i, self.open = end + len(self.open), ""
        return i


class _Statement:
    """An INSERT or a table definition while its lines come. Of an INSERT only what stands around its rows is kept."""

    def __init__(self, kind: str, start: int, dialect: str, cut_bytes: int):
        self.kind, self.start, self.dialect, self.cut_bytes = kind, start, dialect, cut_bytes
        self.boundary, self.parts, self.header = Boundary(dialect), [], None
        self.tail: list[str] | None = None
        self.cuts: list[int] = []

    def feed(self, line: str, start: int) -> bool:
        """Takes a line that begins at byte ``start``; whether the statement ends with it."""
        if self.header is not None:
            if self.tail is None and self.boundary.between_rows() and start - max([self.start, *self.cuts[-1:]]) >= self.cut_bytes:
                self.cuts.append(start)
            return self._rows(line)
        self.parts.append(line)
        if self.kind == "insert" and re.search(r"\bVALUES\b", line, re.I) or self.kind == "insert" and line.lstrip().startswith("("):
            text = "".join(self.parts)
            self.header = INSERT.match(text)
            if self.header is not None:
                self.boundary, self.parts = Boundary(self.dialect, rows=True), []
                return self._rows(text[self.header.end() :])
        return self.boundary.feed(line) is not None

    def _rows(self, text: str) -> bool:
        ended = self.boundary.feed(text) is not None
        if self.tail is not None:
            self.tail.append(text)
        elif self.boundary.rows_end is not None:
            self.tail = [text[self.boundary.rows_end :]]
        return ended

    def segment(self, end: int) -> Segment:
        if self.kind == "insert" and self.header is not None:
            found = self.header
            return Segment("insert", self.start, end, found[0], table_name(found["table"]), column_names(found["columns"]), more={"cuts": self.cuts, "tail": "".join(self.tail or []).lstrip()})
        text = "".join(self.parts)
        found = CREATE.match(text) if self.kind == "create" else None
        if not found:
            return Segment("text", self.start, end)
        return Segment("create", self.start, end, found[0], table_name(found["table"]), more={"definition": definition(text, found.end())})


def segments(lines: Iterable[bytes], dialect: str = "postgres", cut_bytes: int = 16 << 20) -> Iterator[Segment]:
    """The segments of a dump, in order; together they cover all of its bytes. INSERTs of more than ``cut_bytes`` come with
    places (``cuts``) of lines that begin with a row, about that far apart; all with what follows their rows (``tail``)."""
    at = text_from = 0
    statement: _Statement | None = None
    copy: Segment | None = None
    for raw in lines:
        start, at = at, at + len(raw)
        if copy is not None:
            if raw.rstrip(b"\r\n") == b"\\.":
                copy.end = start
                yield copy
                copy, text_from = None, start
            continue
        line = raw.decode("utf-8", "surrogateescape")
        if statement is None:
            if dialect == "postgres" and line[:4].upper() == "COPY" and (found := COPY.match(line)):
                if found["options"].strip():
                    raise DumpError(f"COPY {table_name(found['table'])} has options that aren't understood: {found['options'].strip()}")
                if text_from < at:
                    yield Segment("text", text_from, at)
                copy = Segment("copy", at, at, line, table_name(found["table"]), column_names(found["columns"]), at)
                continue
            kind = "insert" if INSERT_START.match(line) else "create" if CREATE_START.match(line) else None
            if kind is None:
                continue
            if text_from < start:
                yield Segment("text", text_from, start)
            text_from, statement = start, _Statement(kind, start, dialect, cut_bytes)
        if statement.feed(line, start):
            yield statement.segment(at)
            statement, text_from = None, at
    if copy is not None:
        raise DumpError(f"the rows of {copy.table} have no end")
    if statement is not None:
        yield statement.segment(at)
    elif text_from < at:
        yield Segment("text", text_from, at)


def definition(text: str, at: int) -> list[tuple[str, int | None]]:
    """Columns of a table definition and their declared text lengths; constraints and comments are left out."""
    out, depth, begun, quote = [], 0, at, ""
    items, parts = [], []
    i = at
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif (mark := text[i : i + 2]) in ("--", "/*"):
            parts.append(text[begun:i] + " ")
            end = text.find("\n" if mark == "--" else "*/", i + 2)
            i = begun = len(text) if end < 0 else end + 2 * (mark == "/*")
            continue
        elif c in "'\"`" or c == "[" and BRACKETED.match(text, i):
            quote = "]" if c == "[" else c
        elif c == "(":
            depth += 1
        elif c == ")" and depth == 0 or c == "," and depth == 0:
            items.append("".join(parts) + text[begun:i])
            parts, begun = [], i + 1
            if c == ")":
                break
        elif c == ")":
            depth -= 1
        i += 1
    for item in items:
        item = item.strip()
        if not item or CONSTRAINT.match(item):
            continue
        name = re.match(NAME, item)
        if name:
            kind = re.sub(r"[\[\]\"]", "", item[name.end() :].strip())
            bounded = BOUNDED.match(kind)
            out.append((plain_name(name[0]), int(bounded[1]) if bounded else None))
    return out


# -- cells --------------------------------------------------------------------------------------------------------------


class Cell(NamedTuple):
    """``value``: None for NULL and DEFAULT. ``bare``: how an unquoted cell is written. ``tail``: what follows, such as a cast."""

    value: str | None
    quoted: bool = False
    bare: str | None = None
    tail: str = ""
    prefix: str = ""


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


def _literal(text: str, i: int, escaped: bool) -> tuple[str, int]:
    """The content of a quoted literal whose quote is at ``i``, and the place after it."""
    out, i = [], i + 1
    while i < len(text):
        c = text[i]
        if c == "'":
            if text[i + 1 : i + 2] != "'":
                return "".join(out), i + 1
            out.append("'")
            i += 2
        elif escaped and c == "\\" and i + 1 < len(text):
            out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
            i += 2
        else:
            end = min((e for e in (text.find("'", i), text.find("\\", i) if escaped else -1) if e >= 0), default=len(text))
            out.append(text[i:end])
            i = end
    raise DumpError("a quoted value has no end")


def _until(text: str, i: int) -> int:
    """Where a cell ends: a comma or a closing parenthesis outside quotes and parentheses."""
    depth = 0
    while i < len(text):
        c = text[i]
        if c == "'":
            i = _literal(text, i, False)[1]
            continue
        if c == "(":
            depth += 1
        elif c == ")" and depth == 0 or c == "," and depth == 0:
            return i
        elif c == ")":
            depth -= 1
        i += 1
    raise DumpError("a row has no end")


_QUOTE = re.compile(r"([NEBXnebx]?)'")
#: A cell and the sign that ends it, where no quotes or parentheses follow its literal and none are in it if it is bare.
_CELL = re.compile(r"\s*+(?:([NBXnbx]?)'((?:[^']++|'')*+)'|[Ee]'((?:[^'\\]++|\\.|'')*+)'|(?![NEBXnebx]?')([^'(),]*+))([^'(),]*+)([,)])", re.S)
_ESCAPED = re.compile(r"\\(.)|''", re.S)


def _unescaped(found: re.Match) -> str:
    return "'" if found[1] is None else _ESCAPES.get(found[1], found[1])



def rows(text: str, at: int) -> tuple[list[list[Cell]], str]:
    """The rows after VALUES, and what follows them."""
    out = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if text[at : at + 1] != "(":
            return out, text[at:]
        at += 1
        row: list[Cell] = []
        while True:
            if found := _CELL.match(text, at):
                prefix, plain, escaped, bare, tail, mark = found.groups()
                if bare is not None:
                    bare = bare.strip()
                    row.append(Cell(None if bare.upper() in ("NULL", "DEFAULT") else bare, False, bare))
                elif escaped is not None:
                    row.append(Cell(_ESCAPED.sub(_unescaped, escaped), True, None, tail.rstrip()))
                else:
                    prefix = prefix.upper()
                    row.append(Cell(plain.replace("''", "'"), True, None, tail.rstrip(), prefix if prefix in ("B", "X") else ""))
                at = found.end()
                if mark == ")":
                    break
                continue
            while text[at : at + 1].isspace():
                at += 1
            found = _QUOTE.match(text, at)
            if found:
                prefix = found[1].upper()
                value, after = _literal(text, found.end() - 1, prefix == "E")
                end = _until(text, after)
                row.append(Cell(value, True, None, text[after:end].rstrip(), prefix if prefix in "BX" else ""))
            else:
                end = _until(text, at)
                bare = text[at:end].strip()
                row.append(Cell(None if bare.upper() in ("NULL", "DEFAULT") else bare, False, bare))
            at = end + 1
            if text[end] == ")":
                break
        out.append(row)
        while at < len(text) and text[at].isspace():
            at += 1
        if text[at : at + 1] != ",":
            return out, text[at:]
        at += 1


_COPY_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
_COPY_CODES = {"\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def copy_decoded(field_: str) -> str | None:
    if field_ == "\\N":
        return None
    return re.sub(r"\\(.)", lambda m: _COPY_ESCAPES.get(m[1], m[1]), field_, flags=re.S) if "\\" in field_ else field_


def copy_encoded(value: str | None) -> str:
    return "\\N" if value is None else re.sub("[\\\\\b\f\n\r\t\v]", lambda m: _COPY_CODES[m[0]], value)
