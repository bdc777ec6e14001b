"""Query against SQL on whole tables. Usage: python tests/compare.py FOLDER NAME..."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings user_doc seed_user
follower_edge entry_log manifest_modify sst_file sst_record eval_item page_label""".split()


TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "binary": "BLOB", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            source = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def compare(spark, con, name, query, sql, folder) -> str:
    """'' if columns and rows agree, else what differs."""
    got = query(spark, folder)
    names = sorted(got.columns)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    if sorted(cols) != names:
        return f"columns {got.columns} against {cols}"
    types = dict(got.dtypes)
    other = {d[0]: str(d[1]) for d in con.execute("describe " + sql).fetchall()}
    wrong = {c: (types[c], other[c]) for c in names if TYPES.get(types[c], types[c]).upper() != other[c]}
    if wrong:
        return f"types {wrong}"
    con.execute(sql)
    res = con
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in res.fetchall())
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows against {len(b)}; only Spark: {only_a}; only SQL: {only_b}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e
    from lodestrata.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    oracle, all_ = e.oracle_sql(), e.queries()
    for n in names or all_:
        t = time.time()
        try:
            if n in oracle:
                why = compare(spark, con, n, all_[n], oracle[n], folder)
            else:
                why = f"{all_[n](spark, folder).count()} rows, no SQL"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{n}: {why or 'ok'} ({time.time() - t:.1f} s)", flush=True)
