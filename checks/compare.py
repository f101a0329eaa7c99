"""Comparison of a Spark result with a DuckDB query, used by the tests and the check tool."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: str = "8", app: str = "skyframe") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Long generated methods are compiled too; the JVM leaves them interpreted by default.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def register_tables(con, sf_dir: str) -> None:
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_timestamp(kind):
        return "timestamp" + ("_tz" if kind.tz else "")
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return "string"
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"list<{_kind(kind.value_type)}>"
    return str(kind)


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(tuple(_plain(v) for v in row) for row in zip(*columns, strict=True))


def compare(got: pa.Table, con, sql: str) -> str | None:
    """None when both agree on column names, types and the multiset of rows."""
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}"
    kinds = {n: (_kind(got.schema.field(n).type), _kind(want.schema.field(n).type)) for n in got.column_names}
    wrong = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if wrong:
        return f"types (spark, duckdb): {wrong}"
    mine, theirs = rows_of(got), rows_of(want)
    if mine != theirs:
        return (
            f"rows {got.num_rows} vs {want.num_rows}; only spark: {list((mine - theirs).items())[:3]}"
            f" only duckdb: {list((theirs - mine).items())[:3]} of {sorted(got.column_names)}"
        )
    return None
