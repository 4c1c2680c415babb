"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [query …]
"""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FAMILY = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "integer": "int32", "bigint": "int64", "double": "double",
    "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
}


def session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hierspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(name, df, con, sql) -> list[str]:
    """Problems found, empty when schema and rows agree."""
    found = con.execute(sql)
    want_types = {d[0]: FAMILY.get(str(d[1]).lower(), str(d[1]).lower()) for d in found.description}
    columns = [d[0] for d in found.description]
    want = _rows(columns, found.fetchall())
    got_types = {f.name: FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    problems = []
    if set(got_types) != set(columns):
        problems.append(f"{name}: columns {sorted(got_types)} != {sorted(columns)}")
        return problems
    declared = con.execute(f"DESCRIBE {sql}").fetchall()
    want_types = {r[0]: FAMILY.get(r[1].lower(), r[1].lower()) for r in declared}
    if got_types != want_types:
        problems.append(f"{name}: types " + str({c: (got_types[c], want_types[c]) for c in columns if got_types[c] != want_types[c]}))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        problems.append(f"{name}: {len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{name}: {len(bad)} rows differ, first {bad[0]}")
    return problems


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), database(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems = differences(name, df, con, oracles[name])
                n = ""
            else:
                problems, n = [], f"rows only: {len(df.collect())}"
        except Exception as e:  # a broken query must not hide the others
            problems, n = [f"{name}: {type(e).__name__} {str(e)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.1f}s {n}", *problems, sep="\n     " if problems else " ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
