"""Writers of the long relation, and conditions on what is written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import ID, STEP, TIME, spread, to_wide


def condition(long: DataFrame, kind: str = "every_step", n: int = 1, partitions: Sequence[str] = ()) -> DataFrame:
    if kind == "nil":
        return long.where(F.lit(False))
    if kind == "every_step":
        return long
    if kind == "every_n_steps":
        return long.where(F.col(STEP) % n == 0)
    if kind == "only_given_partitions":
        return long.where(F.col("partition_name").isin(*partitions))
    raise ValueError(f"no output condition {kind!r}")


def write_nil(long: DataFrame) -> None:
    long.write.format("noop").mode("overwrite").save()


def write_stdout(long: DataFrame, rows: int | None = None) -> None:
    """``time name [values]`` lines, by step, streamed one partition at a time; all of them
    unless a number of ``rows`` is asked for."""
    for k, r in enumerate(long.orderBy(ID, STEP, "partition_name").toLocalIterator()):
        if rows is not None and k >= rows:
            break
        print(r[TIME], r.partition_name, list(r.state))


def write_json_log(long: DataFrame, path: str) -> None:
    long.select("partition_name", "state", TIME).write.mode("overwrite").json(path)


def write_parquet(long: DataFrame, path: str) -> None:
    long.write.mode("overwrite").partitionBy("partition_name").parquet(path)


def write_csv(long: DataFrame, path: str, partition: str, width: int) -> None:
    rows = long.where(F.col("partition_name") == partition)
    rows.select(TIME, *[F.get("state", F.lit(i)).alias(str(i)) for i in range(width)]).write.mode("overwrite").option("header", True).csv(path)


#: Rows of an Arrow file, and of a record batch in it.
FILE_ROWS, BATCH_ROWS = 250_000, 10_000


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_arrow(long: DataFrame, path: str, widths: dict[str, int], rows: int = FILE_ROWS) -> None:
    """A folder of Arrow IPC files of one run: ``time`` and a fixed-size list per partition.
    Tasks write the files, of at most ``rows`` rows each, by pyarrow, so the folder must be in a
    store that it knows and all share; in the order of names they hold the run in order of
    steps. Partitions must have a row at every step. What was at the path goes first."""
    import pyarrow as pa
    import pyarrow.ipc
    from pyspark import TaskContext

    names = list(widths)
    schema = pa.schema([("time", pa.float64()), *[(n, pa.list_(pa.float64(), w)) for n, w in widths.items()]])

    def fixed(column, name: str):
        if column.null_count:
            raise ValueError(f"a step has no row of partition {name!r}")
        if len(column) and set(column.value_lengths().unique().to_pylist()) != {widths[name]}:
            raise ValueError(f"a state of partition {name!r} has not {widths[name]} values")
        return pa.FixedSizeListArray.from_arrays(column.flatten(), widths[name])

    def emptied() -> tuple:
        fs, base = filesystem(path)
        if fs.get_file_info(base).is_file:
            fs.delete_file(base)
        fs.create_dir(base, recursive=True)
        fs.delete_dir_contents(base)
        return fs, base

    def run(batches):
        fs, base = filesystem(path)
        task, parts = TaskContext.get(), 0
        held, n = [], 0

        def flush():
            nonlocal held, n, parts
            name = f"part-{task.partitionId():05d}-{parts:05d}.arrow"
            mine = f"{base}/.{name}.{task.taskAttemptId()}"  # another attempt may write at the same time
            with fs.open_output_stream(mine) as f, pyarrow.ipc.new_file(f, schema) as out:
                out.write_table(pa.Table.from_batches(held, schema), BATCH_ROWS)
            fs.move(mine, f"{base}/{name}")
            held, n, parts = [], 0, parts + 1

        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0), *[fixed(b.column(i + 1), c) for i, c in enumerate(names)]], schema=schema)
            while len(b):
                held.append(b.slice(0, rows - n))
                n, b = n + len(held[-1]), b.slice(rows - n)
                if n == rows:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([parts], pa.int64())], names=["files"])

    fs, base = emptied()
    wide = spread(to_wide(long, names), ID, STEP, by_range=True).sortWithinPartitions(ID, STEP)
    files = sum(r.files for r in wide.select(TIME, *names).mapInArrow(run, "files long").collect())
    if not files:
        with fs.open_output_stream(f"{base}/part-00000-00000.arrow") as f, pyarrow.ipc.new_file(f, schema):
            pass


def write_duckdb(long: DataFrame, path: str, table: str, rows: int = 50_000) -> None:
    """Replace a DuckDB table by the rows. The file is the driver's, so rows go through it, a
    partition at a time, in one transaction: the table is whole or as it was."""
    import duckdb
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names = to_arrow_schema(long.schema), long.columns

    def batch(held: list) -> pa.Table:
        return pa.Table.from_pydict({n: [r[n] for r in held] for n in names}, schema=schema)

    with duckdb.connect(path) as con:
        con.begin()
        con.register("batch", batch([]))
        con.execute(f'CREATE OR REPLACE TABLE "{table}" AS SELECT * FROM batch')
        held = []
        for r in long.toLocalIterator():
            held.append(r)
            if len(held) >= rows:
                con.register("batch", batch(held))
                con.execute(f'INSERT INTO "{table}" SELECT * FROM batch')
                held = []
        con.register("batch", batch(held))
        con.execute(f'INSERT INTO "{table}" SELECT * FROM batch')
        con.unregister("batch")
        con.commit()


POSTGRES_TABLE = "CREATE TABLE IF NOT EXISTS {table} (partition_name TEXT, time DOUBLE PRECISION, state FLOAT8[], PRIMARY KEY (partition_name, time))"
POSTGRES_UPSERT = "INSERT INTO {table} (partition_name, time, state) VALUES (%s, %s, %s) ON CONFLICT (partition_name, time) DO UPDATE SET state = EXCLUDED.state"


def write_postgres(long: DataFrame, connect: Callable, table: str, rows: int = 1000) -> None:
    """Upsert by (partition_name, time) from every task; ``connect`` opens a DB-API connection on
    the executor. A retried task writes the same rows again. Errors fail the job."""
    with_table = connect()
    with_table.cursor().execute(POSTGRES_TABLE.format(table=table))
    with_table.commit()

    def run(part):
        con = connect()
        cur, held = con.cursor(), []
        for r in part:
            held.append((r.partition_name, r.time, list(r.state)))
            if len(held) >= rows:
                cur.executemany(POSTGRES_UPSERT.format(table=table), held)
                held = []
        if held:
            cur.executemany(POSTGRES_UPSERT.format(table=table), held)
        con.commit()
        con.close()

    long.select("partition_name", TIME, "state").foreachPartition(run)


SINKS: dict[str, Callable] = {
    "nil": write_nil, "stdout": write_stdout, "json_log": write_json_log, "parquet": write_parquet, "csv": write_csv, "arrow": write_arrow,
    "duckdb": write_duckdb, "postgres": write_postgres,
}


def write(long: DataFrame, kind: str, **fields) -> None:
    if kind == "s3":
        kind, fields["path"] = fields.pop("format"), f"s3a://{fields.pop('bucket')}/{fields.pop('key')}"
    if kind not in SINKS:
        raise ValueError(f"no sink {kind!r}")
    SINKS[kind](long, **fields)
