"""Registered text queries beside their SQL, or their rows, on the smallest data."""

import pytest

from tests.compare import TESTDATA, compare
from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    status, _, note = compare(spark, duck, "sf0.001", name, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "ok", note


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, f"{TESTDATA}/sf0.001").count() > 0


def test_op4_mixes_whole_documents(spark, monkeypatch):
    kept, stored = {}, queries.common.stored
    monkeypatch.setattr(queries.common, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    rows = queries.QUERIES["op4_mixing"](spark, f"{TESTDATA}/sf0.001")
    docs = queries.common.table(spark, f"{TESTDATA}/sf0.001", "documents")
    mixed = kept["mixture"].select(*docs.columns)
    assert mixed.count() == rows.count() > 0
    assert mixed.distinct().exceptAll(docs.distinct()).count() == 0
