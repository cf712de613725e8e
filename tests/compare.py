"""Side-by-side run of registered queries and their SQL."""

import datetime as dt
import glob
import math
import os

import duckdb

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def oracle_connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(plain, key=repr)


def spark_rows(frame):
    return _sorted(frame.columns, [tuple(r) for r in frame.collect()])


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return _sorted([d[0] for d in cursor.description], cursor.fetchall())


# Spark type names and the SQL types that hold the same values.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(frame, con, sql):
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    ours = {n: TYPES.get(t, t) for n, t in frame.dtypes}
    return {n: (ours.get(n), theirs.get(n)) for n in {*ours, *theirs} if ours.get(n) != theirs.get(n)}
