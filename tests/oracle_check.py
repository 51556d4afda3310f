"""Compare each registered Spark query with its DuckDB oracle (the
driver's correctness gate, reproduced locally): row count, column names
and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        # exact: both engines must produce the same double
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "as_py"):
        return v.as_py()
    return v


def digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                  "DATE": "date", "BOOLEAN": "boolean", "SMALLINT": "smallint", "FLOAT": "float"}


def duck_types(con, sql):
    rel = con.sql(sql)
    return {c: _DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}


def compare(spark, name, fn, sql, sf_dir, con):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out["oracle_rows"] = len(d_rows)
    out["columns_match"] = sorted(s_cols) == sorted(d_cols)
    d_types = duck_types(con, sql)
    type_diff = {c: (t, d_types.get(c)) for c, t in df.dtypes if d_types.get(c) != t}
    out["types_match"] = not type_diff
    if type_diff:
        out["type_diff"] = type_diff
    out["hash_match"] = digest(s_cols, s_rows) == digest(d_cols, d_rows)
    out["status"] = "ok" if (out["columns_match"] and out["hash_match"] and out["types_match"]
                             and len(s_rows) == len(d_rows)) else "MISMATCH"
    if not out["columns_match"]:
        out["cols"] = (sorted(s_cols), sorted(d_cols))
    return out


def main(sf_dir: str = "/root/testdata/sf0.01", only: list[str] | None = None) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from custodia.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            res = compare(spark, name, fn, oracle.get(name), sf_dir, con)
        except Exception as exc:  # report and continue
            res = {"name": name, "status": "ERROR", "error": str(exc)[:400]}
        bad += res["status"] in ("MISMATCH", "ERROR")
        print(res, flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(main(sf, args[1:] or None))
