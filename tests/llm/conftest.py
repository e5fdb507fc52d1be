import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import edited, prose  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, row string, class string, digest int, keys string, words int, batch string, bucket int, stratum int, base int, n_words string"
def texts() -> list[tuple]:
    """Documents with nulls, empty, long and repeated texts, copies, near copies and shared passages."""
    base, passage = prose(1, 300), prose(2, 70)
    out = [(None, None), (None, "  \n\t"), (7, None), (7, ""), (8, "one"), (8, "one"), (9, "One  two three"), (10, "one two three"), (11, base), (12, base), (13, base.replace(" ", "\n")), (5, base + "  "), (12, base)]
    out += [(100 + i, edited(base, i, 60)) for i in range(12)] + [(200 + i, prose(50 + i, 90) + " " + passage + " " + prose(80 + i, 40)) for i in range(8)]
    out += [(300, prose(3, 30_000)), (301, "日本語テキスト" * 700), (302, "é" * 3000), (303, passage), (None, passage), (304, "a" * 400), (305, "a" * 300)]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The documents with null columns and columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en" if n % 3 else None, None, None, 1, "x", "y", 2, "k", 3, "b", 4, 5, 6, "w") for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, n % 2, n % 5 == 0 and 1 or 0) for n, (i, _) in enumerate(rows)] + [(11, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
