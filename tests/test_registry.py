"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from patchloom.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("~" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert plain([tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]) == plain([tuple(r[c] for c in cols) for r in df.collect()])


def test_rate_window_rounds_as_sql_does(spark, tmp_path):
    times = ["00:00:00.6", "00:00:01.5", "00:00:02.5", "00:00:03", "00:00:03.4999995", None]
    days = [(1, "2024-01-01"), (1, "2024-01-02"), (2, "1969-12-30"), (2, "1969-12-31"), (None, "2024-01-01"), (None, "2024-01-02")]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, user_id bigint, ts timestamp)")
    con.executemany("insert into events values (?, ?, ?)", [(10 * k + i, user, t and f"{day} {t}") for k, (user, day) in enumerate(days) for i, t in enumerate(times)])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = [tuple(r) for r in QUERIES["rate_window_24h"](spark, str(tmp_path)).select("event_id", "n_day").collect()]
    assert len(got) == 36 and plain(got) == plain(con.execute(ORACLE_SQL["rate_window_24h"]).fetchall())


def test_contract_sides_are_not_sent_to_the_driver(spark):
    # less than the parsed files take, more than the plan would take them for by the size of part
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        plan = QUERIES["api_contract"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.catalog.clearCache()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
