"""Spark-vs-DuckDB comparison used by the tests (and runnable as a script).

For one key: run the Spark query, run the DuckDB SQL over the same parquet
files, then compare column names, row counts, column types (by family) and
the sorted values.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_FAMILY = {
    "bigint": "int64", "long": "int64", "int": "int32", "integer": "int32",
    "smallint": "int16", "tinyint": "int8", "hugeint": "int128",
    "double": "float64", "float": "float32", "string": "string", "varchar": "string",
    "date": "date", "boolean": "bool", "timestamp_ntz": "timestamp", "timestamp": "timestamp",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(v))  # exact: both sides do the same double arithmetic
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, repr(v))


def compare(spark, key: str, sf_dir: str, queries: dict, oracle: dict, con=None) -> list[str]:
    """Return a list of problems (empty when the two results agree)."""
    problems: list[str] = []
    df = queries[key](spark, sf_dir)
    s_types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    rel = con.sql(oracle[key])
    d_types = [(n, str(t).lower()) for n, t in zip(rel.columns, rel.types)]
    d_rows = rel.fetchall()
    s_names = [n for n, _ in s_types]
    d_names = [n for n, _ in d_types]
    if s_names != d_names:
        problems.append(f"columns: spark {s_names} duckdb {d_names}")
    else:
        for (n, st), (_, dt) in zip(s_types, d_types):
            sf, df_ = _FAMILY.get(st, st), _FAMILY.get(dt, dt)
            if sf != df_:
                problems.append(f"type of {n}: spark {st} duckdb {dt}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows: spark {len(s_rows)} duckdb {len(d_rows)}")
    order = sorted(range(len(s_names)), key=lambda i: s_names[i])
    d_pos = {n: i for i, n in enumerate(d_names)}

    def canon(rows, names):
        pos = {n: i for i, n in enumerate(names)}
        return sorted(tuple(_norm(r[pos[s_names[i]]]) for i in order) for r in rows)

    if not problems:
        a, b = canon(s_rows, s_names), canon(d_rows, [n for n in d_names if n in d_pos])
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return problems


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from shopflow.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(E.oracle_sql())
    spark = build_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        if k not in o:
            print(f"{k:32s} (no oracle) rows={q[k](spark, sf_dir).count()}")
            continue
        try:
            p = compare(spark, k, sf_dir, q, o, con)
        except Exception as e:  # noqa: BLE001
            p = [f"error: {type(e).__name__}: {str(e)[:300]}"]
        bad += bool(p)
        print(f"{k:32s} {'OK' if not p else 'FAIL ' + '; '.join(p)}")
    print(f"{len(keys) - bad}/{len(keys)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
