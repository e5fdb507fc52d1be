"""SQL dumps as a Spark data source, and writing a masked dump.

``spark.read.format("sqldump").load(path)`` gives the rows of all tables of a dump: table, segment and row numbers, column
names, cells as text, and how each cell was written. The driver finds the segments' places in one pass for all tables and
holds none of their rows; large COPY blocks and INSERTs are cut between rows; tasks then read and parse their own byte
ranges, so parsing is spread over the executors, which must see the file (see ``files``). ``read_table`` gives one table
with its columns.

``rewrite`` masks a dump: text that no rule touches is copied byte for byte, rewritten rows come from one ordered stream
of rendered lines.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators import storage
from veilwork.operators.masking import Masking
from veilwork.sources import files, sqltext
from veilwork.sources.dumpreader import SqlDump, index, lengths, tables
from veilwork.sources.sqltext import Segment


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqlDump)


def save_index(spark: SparkSession, found: list[Segment]) -> str:
    """The segments of a dump in a file beside the checkpoints, so that reading its tables doesn't search it again."""
    context = spark.sparkContext
    name = f"{storage.folder(spark).rstrip('/')}/dump-index-{uuid.uuid4().hex}.pickle"
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(pickle.dumps(found)))
    finally:
        stream.close()
    fs.deleteOnExit(path)
    return name


def read(spark: SparkSession, path: str, *, dialect: str = "postgres", table: str | None = None, saved: str | None = None) -> DataFrame:
    """``saved``: the dump's index if there is one (``save_index``)."""
    register(spark)
    reader = spark.read.format("sqldump").option("dialect", dialect)
    reader = reader.option("index", saved) if saved else reader
    return (reader.option("table", table) if table else reader).load(str(path))


def with_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as columns; ``__segment``, ``__row``, ``__cells`` and ``__meta`` go along. A row's columns are found by name."""
    place = lambda c: F.array_position(F.transform("columns", lambda x: F.lower(x)), c.lower())
    cell = lambda c: F.when(place(c) > 0, F.get("cells", (place(c) - 1).cast("int")))
    return rows.select(*(cell(c).alias(c) for c in columns), F.col("segment").alias("__segment"), F.col("row").alias("__row"), F.col("columns").alias("__columns"), F.col("cells").alias("__cells"), F.col("meta").alias("__meta"))


def read_table(spark: SparkSession, path: str, table: str, *, dialect: str = "postgres") -> DataFrame:
    """One table of a dump, its columns as text."""
    found = index(path, sqltext.DIALECTS[dialect.lower()])
    columns = next((c for t, c in tables(found).items() if t.lower() == table.lower()), None)
    if columns is None:
        raise sqltext.DumpError(f"{table} is not in the dump")
    rows = with_columns(read(spark, path, dialect=dialect, table=table, saved=save_index(spark, found)), columns)
    return rows.select(*(F.col(f"`{c}`") for c in columns))


# -- writing ------------------------------------------------------------------------------------------------------------


def copy_encoded(value: Column) -> Column:
    """A COPY field: NULL as backslash N, control characters escaped."""
    out = value
    for c, code in {"\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}.items():
        out = F.replace(out, F.lit(c), F.lit(code))
    return F.coalesce(out, F.lit("\\N"))


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_cell(value: Column, meta: Column, masked: Column, force: Column) -> Column:
    """A cell of VALUES. ``masked``: whether a rule applies; what none applies to is written as it was."""
    tail = F.coalesce(meta["tail"], F.lit(""))
    as_literal = F.coalesce(meta["quoted"], F.lit(False)) | force
    fresh = F.when(value.isNull(), "NULL").when(as_literal, F.concat(quoted(value), tail)).otherwise(F.concat(value, tail))
    kept = F.when(F.coalesce(meta["quoted"], F.lit(False)), F.concat(F.coalesce(meta["prefix"], F.lit("")), quoted(value), tail)).otherwise(F.coalesce(meta["bare"], value, F.lit("NULL")))
    return F.when(masked, fresh).otherwise(kept)


def rendered(m: Masking, rows: DataFrame, table: str, columns: list[str], copy: bool) -> DataFrame:
    """(segment, row, text) of the rows of one table that stay, masked."""
    source = with_columns(rows, columns)
    plan = m.plan(source.select(*(F.col(f"`{c}`") for c in columns)), table)
    strategy = F.struct(*(m.strategy_of(plan[c], columns).isNotNull().alias(f"s{i}") if c in plan else F.lit(False).alias(f"s{i}") for i, c in enumerate(columns)))
    force = F.struct(*(m.forced_quotes(plan[c], columns).alias(f"s{i}") if c in plan else F.lit(False).alias(f"s{i}") for i, c in enumerate(columns)))
    done = m.apply(source.select("*", strategy.alias("__masked"), force.alias("__force")), table)
    values = F.array(*(F.col(f"`{c}`").cast("string") for c in columns))
    masks, forces = F.array(*(F.col(f"__masked.s{i}") for i in range(len(columns)))), F.array(*(F.col(f"__force.s{i}") for i in range(len(columns))))
    names = F.array(*(F.lit(c.lower()) for c in columns))
    done = done.select("__segment", "__row", "__cells", "__meta", values.alias("v"), masks.alias("m"), forces.alias("f"), F.transform("__columns", lambda x: F.array_position(names, F.lower(x))).alias("at"))

    def cell(original: Column, i: Column) -> Column:
        at = (F.get("at", i) - 1).cast("int")
        known = at.isNotNull() & (at >= 0)
        masked, force = F.coalesce(F.get("m", at), F.lit(False)) & known, F.coalesce(F.get("f", at), F.lit(False)) & known
        value = F.when(masked, F.get("v", at)).otherwise(original)
        return copy_encoded(value) if copy else sql_cell(value, F.get("__meta", i), masked, force)

    joined = F.array_join(F.transform("__cells", cell), "\t" if copy else ", ")
    return done.select(F.col("__segment").alias("segment"), F.col("__row").alias("row"), (joined if copy else F.concat(F.lit("("), joined, F.lit(")"))).alias("text"))


def touched(m: Masking, table: str, columns: list[str]) -> bool:
    policy = m.policy
    return policy.row_filter(table) is not None or any(policy.rule(table, c) is not None or policy.cases(table, c) or policy.json_rules(table, c, tuple(columns)) for c in columns)


def rewrite(spark: SparkSession, path: str, out, m: Masking, *, dialect: str = "postgres", found: list[Segment] | None = None) -> dict[str, DataFrame]:
    """Writes the masked dump to ``out``, a binary file, and returns the tables that the policy touches, as read.
    ``found``: the dump's segments if they are known."""
    dialect = sqltext.DIALECTS[dialect.lower()]
    found = index(path, dialect) if found is None else found
    saved = save_index(spark, found)
    m = Masking(m.policy, m.profile, lengths(found), m.mappings)
    by_table = tables(found)
    changed = {t: c for t, c in by_table.items() if touched(m, t, c)}
    read_in = {t: with_columns(read(spark, path, dialect=dialect, table=t, saved=saved), c) for t, c in changed.items()}
    m = m.with_unique(read_in)
    lines = None
    for t, columns in changed.items():
        kinds = {s.kind for s in found if s.table == t}
        for kind in kinds & {"insert", "copy"}:
            numbers = [i for i, s in enumerate(found) if s.table == t and s.kind == kind]
            own = read(spark, path, dialect=dialect, table=t, saved=saved)
            if len(kinds & {"insert", "copy"}) > 1:
                own = own.join(F.broadcast(spark.createDataFrame([(n,) for n in numbers], "segment long")), "segment", "left_semi") if len(numbers) < 10_000 else own.where(F.col("meta").isNull() if kind == "copy" else F.col("meta").isNotNull())
            part = rendered(m, own, t, columns, kind == "copy")
            lines = part if lines is None else lines.unionByName(part)
    stream = iter(()) if lines is None else storage.cut(lines.repartitionByRange("segment", "row").sortWithinPartitions("segment", "row")).orderBy("segment", "row").toLocalIterator(prefetchPartitions=True)
    with files.opened(path) as source:
        _splice(source, out, found, set(changed), stream)
    return read_in


def _splice(source, out, found: list[Segment], changed: set[str], stream: Iterator) -> None:
    row = next(stream, None)
    for number, s in enumerate(found):
        if s.kind not in ("insert", "copy") or s.table not in changed:
            source.seek(s.start if s.kind != "copy" else s.body)
            _copied(source, out, s.end - source.tell())
            continue
        if s.kind == "insert":
            tail, first = s.more["tail"], True
            while row is not None and row["segment"] == number:
                out.write(((s.header.rstrip() + " ") if first else ", ").encode("utf-8", "surrogateescape") + row["text"].encode("utf-8", "surrogateescape"))
                first, row = False, next(stream, None)
            if not first:  # a statement whose rows are all dropped goes as a whole
                spaced = tail if tail[:1] in (";", "") else " " + tail
                out.write(spaced.encode("utf-8", "surrogateescape"))
            continue
        while row is not None and row["segment"] == number:
            out.write(row["text"].encode("utf-8", "surrogateescape") + b"\n")
            row = next(stream, None)


def _copied(source, out, n: int) -> None:
    while n > 0:
        data = source.read(min(n, 1 << 18))
        if not data:
            return
        out.write(data)
        n -= len(data)


def spool_folder(spark: SparkSession) -> str:
    """Where unpacked dumps go: beside the checkpoints, which the executors see."""
    return os.path.join(storage.folder(spark).removeprefix("file://"), "spool")
