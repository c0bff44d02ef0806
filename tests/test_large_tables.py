"""Steps whose tasks must not grow with the tables: numbering, grouped aggregation, round trips."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel import catalog, series
from tidewheel.series import ID, STEP, TIME, spread, to_series
from tidewheel.sources import readers, writers


def sizes(df):
    """Rows of each task that has some."""
    return [n for n in df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def numbers(got):
    return sorted(tuple((v is None, 0.0 if v is None else round(float(v), 4)) for v in r) for r in got)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Lines with nulls among quantities and taxes."""
    d = tmp_path_factory.mktemp("odd")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE l AS SELECT * REPLACE (CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS l_quantity, CASE WHEN l_orderkey % 5 > 0 THEN l_tax END AS l_tax) FROM '/root/testdata/sf0.001/lineitem.parquet'")
        con.execute(f"COPY l TO '{d}/lineitem.parquet'")
    return str(d)


def same_as_sql(spark, name, d, table):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
        sql = con.sql(catalog.ORACLE[name])
        cols, want = sql.columns, sql.fetchall()
    return numbers(map(tuple, catalog.QUERIES[name](spark, d).select(*cols).collect())) == numbers(want)


def test_tasks_follow_the_bytes_read(spark, sf, monkeypatch):
    make = lambda: to_series(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id"), ["ts", "event_id"], F.lit(0.0), {"v": F.col("value")})
    want = rows(make())
    monkeypatch.setattr(series, "TASK_BYTES", 1000)
    assert len(sizes(make())) > 4 and rows(make()) == want
    assert spread(spark.createDataFrame([(1,)], "a int"), "a").count() == 1


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def run(spark):
    t = F.floor(F.col("id") / 3).cast("double")  # three rows a time
    return spark.range(3000).select(F.lit(0).cast("long").alias(ID), F.lit("p").alias("partition_name"), F.col("id").alias(STEP), t.alias(TIME), F.array(F.col("id").cast("double"), F.when(F.col("id") % 7 > 0, -0.5 * F.col("id"))).alias("state"))


def test_arrow_files_are_written_and_read_by_many_tasks(uncoalesced, run, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.ipc

    monkeypatch.setattr(readers, "numbered", lambda df, by, order: series.numbered(df, by, order, 100))
    spark, path = uncoalesced, str(tmp_path / "run")
    writers.write_arrow(run, path, {"p": 2}, rows=90)
    files = sorted((tmp_path / "run").glob("*.arrow"))
    tables = [pa.ipc.open_file(f).read_all() for f in files]
    assert len(files) > 30 and max(t.num_rows for t in tables) <= 90
    assert pa.concat_tables(tables)["time"].to_pylist() == [float(k // 3) for k in range(3000)]
    back = readers.read_arrow(spark, path)
    assert rows(back) == rows(run.select(back.columns)) and max(sizes(back)) < 2000
    writers.write_arrow(run.limit(7), path, {"p": 2})
    assert readers.read_arrow(spark, path).count() == 7
    writers.write_arrow(run.limit(0), path, {"p": 2})
    assert readers.read_arrow(spark, path).count() == 0
    with pytest.raises(Exception, match="no row of partition"):
        writers.write_arrow(run, path, {"p": 2, "q": 1})


def test_two_keys_sum_without_a_grid(spark, sf, odd):
    got = catalog.QUERIES["grouped_two_keys"](spark, sf)
    assert plan(got).count("Window [") == 1
    for d in (sf, odd):
        assert same_as_sql(spark, "grouped_two_keys", d, "lineitem")


def test_rows_that_may_differ_are_read_once(spark):
    bare = spark.range(5).select(F.col("id").cast("double").alias("0"))
    assert [r["state"] for r in readers.from_dataframe(bare, "p").orderBy(STEP).collect()] == [[float(k)] for k in range(5)]


@pytest.mark.parametrize("name", ["arrow", "parquet", "csv", "json_log", "dataframe"])
def test_round_trips_are_numbered_by_many_tasks(uncoalesced, sf, monkeypatch, name):
    spark = uncoalesced
    numbered = series.numbered
    monkeypatch.setattr(catalog, "SPAN_ROWS", 50)
    monkeypatch.setattr(readers, "numbered", lambda df, by, order: numbered(df, by, order, 50))
    got = catalog.QUERIES[f"round_trip_{name}"](spark, sf)
    assert max(sizes(got)) < 0.8 * got.count()
    assert same_as_sql(spark, f"round_trip_{name}", sf, "events")


@pytest.mark.parametrize("name", ["max", "rolling_max", "rolling_min", "rolling_sum", "sum", "min", "rolling_mean", "count", "mean", "rolling_count"])
def test_groups_are_exploded_after_the_sorts(spark, odd, name):
    above = plan(catalog.QUERIES[f"grouped_{name}"](spark, odd)).split("Generate")
    assert len(above) == 2 and "Window" not in above[0] and "Sort" not in above[0] and "Window" in above[1]
    assert same_as_sql(spark, f"grouped_{name}", odd, "lineitem")
