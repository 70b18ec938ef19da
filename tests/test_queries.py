"""Every registered query against its SQL on the smallest tables."""
import duckdb
import pytest

from freqforge.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, con, name):
    assert canon(Q.queries()[name](spark, SF).toPandas()) == canon(con.execute(Q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.columns and len(df.collect()) > 0


def test_partition_counts_dont_matter(spark):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(canon(Q.queries()["f4"](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
