"""Fixtures of the text operators' tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus import SCHEMA, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", "src0", None if t is None else len(t), "clash", 1, 2, 3, 4) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
