from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from motefield.session import get_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, value string, lines string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null, empty, blank and very long texts, a repeated row, columns with names used inside the operators."""
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of the" for i in range(60))
    texts = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (None, "a null id\nand a second line of it"), (6, "x" * 150_000), (7, "One two three four five six. " * 4000)]
    return [(i, t, None if i == 7 else "en", None if i == 4 else "src", 0, "k", "v", "l") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
