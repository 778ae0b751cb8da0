"""Small awkward tables that every operator and stage must take."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import prose  # noqa: E402

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, h long, n long, rep long, slot int, shard string, score double, cluster long, spans string, away_id long, host string")


def row(doc_id, text, source="s1"):
    return (doc_id, text, "en", source, None if text is None else len(text), "k", 1, 2, 3, 4, "x", 0.5, 6, "z", 7, "hh")


@pytest.fixture(scope="session")
def awkward_rows():
    long_text = prose(30_000, 1, 5_000)
    a = prose(120, 2)
    near = a.replace(a.split()[60], "other", 1)
    return [row(1, a), row(2, a), row(3, near), row(4, None, None), row(5, ""), row(6, " \n\t "), row(7, long_text), row(8, "one two"),
            row(9, "é" * 50 + " ñ 日本語 text"), row(10, "x" * 3000), row(11, a[:200] + " tail " + prose(30, 9)), row(12, prose(80, 10) + " " + a),
            row(13, "Call +1 (212) 555-0143 now or mail a.b@mail.example.com, ip 10.0.0.1, card 4111 1111 1111 1111."),
            row(13, "Call +1 (212) 555-0143 now or mail a.b@mail.example.com, ip 10.0.0.1, card 4111 1111 1111 1111."),
            row(None, "a row without an id"), row(14, a + "\n" + a), row(15, long_text + " end")]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
