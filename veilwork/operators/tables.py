"""Masking stored tables: any Spark source in, any sink out, with a seal beside the files.

A table that the very same policy, profile and version have masked carries the seal that this run would write; its rows
pass through as they are, so that a second run doesn't mask masked values. Files named with an underscore are not read as
data, so the seal can lie in the table's folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from veilwork.operators import coverage, report, scan, seal
from veilwork.operators.masking import Masking

SEAL_FILE = "_SEAL"


class Findings(Exception):
    """The output scan's gate failed; nothing was published."""


@dataclass(frozen=True)
class Source:
    """Where a table is read: a Spark format, a path (none for such as JDBC) and options."""

    format: str = "parquet"
    path: str | None = None
    options: Mapping[str, str] | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**(self.options or {}))
        return reader.load(self.path) if self.path else reader.load()


def _file(spark: SparkSession, folder: str, name: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}" if name else folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def read_seal(spark: SparkSession, folder: str | None) -> str:
    """The seal's line, or nothing."""
    if not folder:
        return ""
    fs, path = _file(spark, folder, SEAL_FILE)
    if not fs.exists(path):
        return ""
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def write_seal(spark: SparkSession, folder: str, line: str) -> None:
    fs, path = _file(spark, folder, SEAL_FILE)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(line.encode()))
    finally:
        stream.close()


def _move(spark: SparkSession, staged: str, target: str, *, append: bool) -> None:
    """Files of one folder to another, in place of what is there or beside it."""
    fs, source = _file(spark, staged, "")
    _, at = _file(spark, target, "")
    if not append or not fs.exists(at):
        fs.delete(at, True)
        if not fs.rename(source, at):
            raise OSError(f"{staged} can't be moved to {target}")
        return
    files, root = fs.listFiles(source, True), fs.makeQualified(source).toUri().getPath().rstrip("/")
    while files.hasNext():
        path = files.next().getPath()
        _, to = _file(spark, target, path.toUri().getPath()[len(root) + 1 :])
        fs.mkdirs(to.getParent())
        if not fs.rename(path, to) and path.getName() != "_SUCCESS":
            raise OSError(f"{path} can't be moved to {target}")


def mask_table(
    spark: SparkSession, m: Masking, table: str, source: Source, target: str, *, format: str = "parquet", mode: str = "errorifexists", options: Mapping[str, str] | None = None, partition_by: Sequence[str] = (),
    strict_coverage: bool = False, scan_output: bool = False, fail_on_findings: bool = False,
) -> dict[str, Any]:
    """Reads, masks and writes a table, and returns the run's report. What fails a gate is never published: with
    ``scan_output`` the rows are written beside the target, those very files are scanned, and then they are moved, so that
    values drawn at random are judged as they will stand."""
    rows = source.read(spark)
    columns = {table: rows.columns}
    if strict_coverage:
        coverage.require(m.policy, columns)
    current = seal.make(m.policy, m.profile, {"table": table.lower()})
    trusted = seal.verdict(read_seal(spark, source.path), current) == "trusted"
    out = rows if trusted else m.with_unique({table: rows}).apply(rows, table)
    def save(place: str, how: str) -> None:
        writer = out.write.format(format).mode(how).options(**(options or {}))
        (writer.partitionBy(*partition_by) if partition_by else writer).save(place)

    scanned = None
    if scan_output:
        fs, at = _file(spark, target, "")
        if fs.exists(at) and mode in ("error", "errorifexists"):
            raise FileExistsError(target)
        if fs.exists(at) and mode == "ignore":
            return {}
        staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
        try:
            save(staged, "errorifexists")
            written = spark.read.format(format).options(**(options or {})).schema(out.schema).load(staged)
            scanned = scan.report(written, None, m.policy.output_scan)
            if fail_on_findings and scanned["failed"]:
                raise Findings(", ".join(scanned["failed_categories"]))
            _move(spark, staged, target, append=mode == "append")
        finally:
            fs.delete(_file(spark, staged, "")[1], True)
    else:
        save(target, mode)
    write_seal(spark, target, current.line())
    counted = [] if trusted else report.counts(m, rows, table).collect()
    return report.summary(counted, hardened=m.profile.hardened, coverage=coverage.coverage(m.policy, columns), usage=report.domain_usage(m, columns), scan=scanned)
