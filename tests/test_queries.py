"""Each query with SQL gives the rows that DuckDB gives, whatever the partitions; all have named columns."""

import duckdb
import pytest

from codexloom.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value) if hasattr(value, "isoformat") else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == names
    rows = result.fetchall()
    assert ordered(df.select(*(f"`{n}`" for n in names)).collect()) == ordered([[r[given.index(n)] for n in names] for r in rows])


def test_partitions_do_not_matter(spark, data):
    for name in ("q04_running_headers", "q14_span_partition", "q23_hash_chain", "q51_components"):
        want = ordered(QUERIES[name](spark, data).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            assert ordered(QUERIES[name](spark, data).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_html_blocks_have_rows(spark, data):
    assert {r.tag for r in QUERIES["q08_page_blocks"](spark, data).collect()} >= {"h1", "p"}
