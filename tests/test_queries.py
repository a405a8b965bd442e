from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from evalspark.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = oracle.rows_of(registry.QUERIES[name](spark, oracle.SF))
    assert got == oracle.sql_rows(con, registry.ORACLE_SQL[name])


def test_edge_crossings_of_odd_rows(spark, tmp_path):
    """Orders, lines and parts that are NULL, lines that are repeated, all parts alike."""
    lines = spark.read.parquet(f"{oracle.SF}/lineitem.parquet").where("l_orderkey < 200")
    odd = [lines, lines.where("l_orderkey % 5 = 0")]
    odd += [lines.where(f"l_orderkey % 5 = {k}").withColumn(c, F.lit(v).cast(lines.schema[c].dataType)) for k, (c, v) in enumerate((("l_orderkey", None), ("l_linenumber", None), ("l_partkey", None)))]
    odd += [lines.withColumns({"l_orderkey": -F.col("l_orderkey") - 1, "l_partkey": F.lit(7).cast("long"), "l_suppkey": F.lit(14).cast("long")})]
    rows = odd[0]
    for x in odd[1:]:
        rows = rows.unionByName(x)
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert oracle.rows_of(registry.QUERIES["edge_crossings"](spark, str(tmp_path))) == oracle.sql_rows(con, registry.ORACLE_SQL["edge_crossings"])


def test_every_query_without_sql_has_a_plain_version():
    text = (Path(__file__).parent / "test_probe_queries.py").read_text()
    assert all(f'"{name}"' in text for name in set(registry.QUERIES) - set(registry.ORACLE_SQL))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
