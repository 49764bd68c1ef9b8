"""Each registered query of the evidence engine against its SQL."""

import pytest
from tests.compare import of_duck, of_spark
from tidemark.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck, sf):
    got = of_spark(QUERIES[name](spark, sf))
    want = of_duck(duck, SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_entry_works_without_training_text_operators(monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tidemark.llm") else find(name, *a))
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(SQL)
