"""Holds queries against their SQL: python tests/compare.py SF_DIR [NAME-PREFIX ...]"""

import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings wal_log batch_writes repl_feed repl_runs snap_primary snap_replica value_pointers vlog_entries sst_manifest eval_items mix_targets".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(cols: list[str], data: list) -> tuple[list[str], list]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    t = time.time()
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    t = time.time() - t
    if sql is None:
        return f"rows only {len(got[1])} ({t:.1f} s)"
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows(cols, cur.fetchall())
    kinds = {c: k for c, k in df.dtypes}
    if got == want:
        return f"ok {len(got[1])} ({t:.1f} s)" + ("" if not set(kinds.values()) - {"bigint", "double", "string", "boolean"} else f" types {kinds}")
    only = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
    return f"DIFFERS {got[0]} {len(got[1])} against {want[0]} {len(want[1])}; only ours {only[0]}; only SQL {only[1]}"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = sys.argv[1]
    spark, con, sql = session(), connect(sf), e.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    for n, q in e.queries().items():
        if len(sys.argv) == 2 or any(n.startswith(p) for p in sys.argv[2:]):
            try:
                said = compare(spark, con, n, q, sql.get(n), sf)
            except Exception as x:  # noqa: BLE001
                said = f"FAILED {type(x).__name__} {str(x)[:600]}"
            print(n, said, flush=True)
