"""Every query again, on tables in which one key holds a third of all rows and some values are missing."""

from pathlib import Path

import duckdb
import pytest

from annoframe.catalog import QUERIES, SQL
from tests.oracle import assert_same, connect

SMALL = "/root/testdata/sf0.001"
CHANGES = {
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS o_custkey",
    "lineitem": "CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey, "
    "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    "events": "CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END AS user_id, "
    "CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS value",
    "documents": "CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE lang END AS lang, "
    "CASE WHEN doc_id % 60 = 0 THEN NULL WHEN doc_id % 61 = 0 THEN '' ELSE text END AS text",
    "customer": "CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_custkey % 33 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment",
    "part": "CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_name END AS p_name",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for file in sorted(Path(SMALL).glob("*.parquet")):
        columns = f"* REPLACE ({CHANGES[file.stem]})" if file.stem in CHANGES else "*"
        connection.execute(
            f"COPY (SELECT {columns} FROM read_parquet('{file}')) TO '{folder / file.name}' (FORMAT parquet)"
        )
    return str(folder)


@pytest.fixture(scope="module")
def duck(skewed):
    return connect(skewed)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(name, spark, duck, skewed):
    assert_same(QUERIES[name](spark, skewed), duck, SQL[name])
