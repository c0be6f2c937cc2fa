"""The queries over OCCURS tables against SQL over whole tables."""

from collections import Counter

import duckdb
import pytest

from mainspring.operators import queries

TABLES = "/root/testdata/sf0.001"
WHOLE = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT), l_partkey, CAST(floor(l_quantity) AS BIGINT) FROM '%s/lineitem.parquet'"


@pytest.mark.parametrize("name", ["occurs_explode", "odo_explode"])
def test_every_line_of_every_order(spark, name):
    want = Counter(duckdb.query(WHOLE % TABLES).fetchall())
    got = Counter(map(tuple, queries.queries()[name](spark, TABLES).collect()))
    assert got == want and max(Counter(k for k, *_ in got.elements()).values()) > 7


@pytest.mark.parametrize("name", ["occurs_explode", "odo_explode"])
def test_an_order_of_most_lines(spark, tmp_path, name):
    rows = [(1, k % 9 + 1, k, 1.0) for k in range(500)] + [(2, 8, 1, 2.0), (2, 8, 1, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Counter(map(tuple, queries.queries()[name](spark, str(tmp_path)).collect()))
    assert got == Counter((a, b, c, int(d)) for a, b, c, d in rows)


def test_every_letter_of_a_segment(spark):
    sql = "SELECT c_custkey, length(regexp_replace(c_mktsegment, '[^AEIOU]', '', 'g')), length(regexp_replace(c_mktsegment, '[^A-I]', '', 'g')) FROM '%s/customer.parquet'"
    want = duckdb.query(sql % TABLES).fetchall()
    assert Counter(map(tuple, queries.queries()["level88_in_tables"](spark, TABLES).collect())) == Counter(want)
