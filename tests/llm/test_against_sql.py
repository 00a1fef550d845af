import pytest

from annoframe.llm import catalog
from tests.llm import cases
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_whole_tables(name, spark, tables):
    assert_same(catalog.QUERIES[name](spark, tables), connect(tables), catalog.SQL[name])


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return cases.write(tmp_path_factory.mktemp("odd"), cases.odd_texts())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_odd_texts(name, spark, odd):
    assert_same(catalog.QUERIES[name](spark, odd), cases.connect(odd), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(name, spark, tmp_path):
    assert catalog.QUERIES[name](spark, cases.write(tmp_path, [], [], [])).collect() == []


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_one_row_for_each_document(name, spark, odd):
    rows = catalog.QUERIES[name](spark, odd).collect()
    n = len(cases.odd_texts())
    assert {r["doc_id"] for r in rows} == set(range(n))
    if name not in ("op5_best_fit_packing", "op6_token_counts"):
        assert len(rows) == n
