"""Masking streams. All but unique pseudonyms is a pure function of a row, so a policy applies to a stream as to a table.

Unique pseudonyms need to know those given before: ``with_unique`` keeps, micro-batch by micro-batch, a table of (value,
pseudonym), and replays of a batch find its values already there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilwork.operators import domains
from veilwork.operators.masking import Masking


def apply(m: Masking, stream: DataFrame, table: str) -> DataFrame:
    """The masked stream. Policies with unique pseudonyms for the table are refused."""
    if domains._unique_specs(m, stream, table):
        raise ValueError(f"{table} has unique pseudonyms, which need with_unique")
    return m.apply(stream, table)


def with_unique(m: Masking, stream: DataFrame, table: str, store: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that masks each micro-batch with mappings kept under the folder ``store`` and hands it to ``write``."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        mappings = {}
        for n, (name, _, spec, most) in enumerate(domains._unique_specs(m, rows, table)):
            key, place = domains.key_of(spec, most), f"{store.rstrip('/')}/{n}"
            values = rows.select(F.col(f"`{name}`").cast("string").alias("value")).where("value IS NOT NULL").distinct()
            known = _known(spark, place)
            fresh = values.join(known.select("value"), "value", "left_anti")
            given = domains.assign(m, spec, most, fresh, taken=known)
            if not given.isEmpty():  # a batch that comes again finds its values known
                given.write.mode("append").parquet(place)
            mappings[key] = _known(spark, place)
        write(Masking(m.policy, m.profile, m.lengths, mappings).apply(rows, table), number)

    return stream.writeStream.foreachBatch(batch)


def _known(spark, place: str) -> DataFrame:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "value string, pseudonym string")
    return spark.read.parquet(place).select("value", "pseudonym")
