"""What an input is, from its first bytes; unwrapping of gzip and zip; PostgreSQL archives through pg_restore."""

from __future__ import annotations

import gzip
import os
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

GZIP, ZIP, ARCHIVE, PLAIN = "gzip", "zip", "pg_archive", "plain"
SNIFF = 4096
MOST_WRAPPERS = 16


class InputError(ValueError):
    """An input that can't be read as a dump."""


def kind_of(path: str | os.PathLike) -> str:
    path = Path(path)
    if path.is_dir():
        if (path / "toc.dat").is_file():
            return ARCHIVE
        raise InputError(f"{path.name} is a folder without toc.dat, so no directory-format archive")
    with path.open("rb") as file:
        head = file.read(5)
    if head.startswith(b"\x1f\x8b"):
        return GZIP
    if head.startswith((b"PK\x03\x04", b"PK\x05\x06")):
        return ZIP
    return ARCHIVE if head == b"PGDMP" else PLAIN


def refuse_for_mssql(path: str | os.PathLike) -> None:
    """SQL Server dumps must be plain text in UTF-8."""
    name = Path(path).name
    kind = kind_of(path)
    if kind == ARCHIVE:
        raise InputError(f"{name} is a PostgreSQL archive, not a SQL Server script")
    with open(path, "rb") as file:
        head = file.read(SNIFF)
    if kind == ZIP:
        raise InputError(f"{name} is a ZIP or BACPAC file; export a plain SQL script instead")
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise InputError(f"{name} is UTF-16; save it as UTF-8")
    control = sum(b < 9 or 13 < b < 32 for b in head)
    if kind == PLAIN and (b"\0" in head or len(head) >= 64 and control > 0.15 * len(head)):
        raise InputError(f"{name} looks binary, such as a native backup; export a plain SQL script instead")


def check_extension(path: str | os.PathLike, allowed: Iterable[str]) -> None:
    """``allowed``: extensions in any case, with or without a dot; none allows all."""
    wanted = {a.lower().lstrip(".") for a in allowed}
    if wanted and Path(path).suffix.lower().lstrip(".") not in wanted:
        raise InputError(f"{Path(path).name} has none of the allowed extensions {', '.join(sorted(wanted))}")


@dataclass
class Input:
    """A plain SQL file, and what was made on the way to it."""

    path: Path
    archive: Path | None = None
    made: list[Path] = field(default_factory=list)

    @property
    def is_original(self) -> bool:
        return not self.made

    def close(self) -> None:
        for p in self.made:
            p.unlink(missing_ok=True)


def resolve(path: str | os.PathLike, *, dialect: str = "postgres", spool: str | os.PathLike | None = None, pg_restore: str | None = None, pg_restore_args: Sequence[str] = ()) -> Input:
    """The plain SQL text of an input, through up to 16 wrappers. What has to be unpacked goes to ``spool``, a folder that
    the executors see too."""
    out = Input(Path(path))
    if dialect == "mssql":
        refuse_for_mssql(path)
    try:
        for _ in range(MOST_WRAPPERS):
            kind = kind_of(out.path)
            if kind == PLAIN:
                return out
            if kind == ARCHIVE:
                if dialect != "postgres":
                    raise InputError(f"{out.path.name} is a PostgreSQL archive; the dialect is {dialect}")
                out.archive = Path(path)
                _into(out, spool, lambda to: _restore(out.path, to, pg_restore or "pg_restore", pg_restore_args))
            elif kind == GZIP:
                _into(out, spool, lambda to: _gunzip(out.path, to))
            else:
                _into(out, spool, lambda to: _unzip(out.path, to))
        raise InputError(f"{Path(path).name} has more than {MOST_WRAPPERS} wrappers")
    except BaseException:
        out.close()
        raise


def _into(out: Input, spool: str | os.PathLike | None, fill) -> None:
    if spool is not None:
        os.makedirs(spool, exist_ok=True)
    handle, name = tempfile.mkstemp(suffix=".sql", dir=spool)
    os.close(handle)
    out.made.append(Path(name))
    fill(Path(name))
    out.path = Path(name)


def _gunzip(source: Path, to: Path) -> None:
    try:
        with gzip.open(source, "rb") as a, to.open("wb") as b:
            shutil.copyfileobj(a, b, 1 << 20)
    except (OSError, EOFError) as bad:
        raise InputError(f"{source.name} can't be unpacked: {bad}") from None


def _unzip(source: Path, to: Path) -> None:
    """The only file in it, or the only .sql file."""
    try:
        with zipfile.ZipFile(source) as z:
            files = [n for n in z.namelist() if not n.endswith("/")]
            sql = [n for n in files if n.lower().endswith(".sql")]
            chosen = files if len(files) == 1 else sql
            if len(chosen) != 1:
                raise InputError(f"{source.name} must hold one file, or one .sql file; it holds {len(files)} and {len(sql)}")
            with z.open(chosen[0]) as a, to.open("wb") as b:
                shutil.copyfileobj(a, b, 1 << 20)
    except zipfile.BadZipFile as bad:
        raise InputError(f"{source.name} can't be unpacked: {bad}") from None


def _restore(source: Path, to: Path, tool: str, args: Sequence[str]) -> None:
    try:
        with to.open("wb") as file:
            done = subprocess.run([tool, "-f", "-", *args, str(source)], stdout=file, stderr=subprocess.PIPE)
    except FileNotFoundError:
        raise InputError(f"{tool} was not found; install the PostgreSQL client tools or give its path") from None
    if done.returncode:
        raise InputError(f"{tool} failed on {source.name}: {done.stderr.decode(errors='replace').strip()[-500:]}")
