"""Run queries side by side with their SQL on one folder of tables; ``python tests/compare.py DIR NAME...``."""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, con, sf_dir: str, query, sql: str, show: int = 3) -> str:
    """Empty where rows, names and kinds of columns agree."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = df.select(*names).toArrow()
    want = con.sql(sql)
    if sorted(want.columns) != names:
        return f"columns {names} and {sorted(want.columns)}"
    want = want.select(", ".join(f'"{n}"' for n in names)).to_arrow_table()
    kinds = [(n, str(a.type), str(b.type)) for n, a, b in zip(names, got.schema, want.schema) if str(a.type) != str(b.type)]
    said = f"types {kinds} " if kinds else ""
    a, b = (sorted(map(repr, zip(*[c.to_pylist() for c in t.columns]))) for t in (got, want))
    if a != b:
        x, y = [r for r in a if r not in set(b)][:show], [r for r in b if r not in set(a)][:show]
        said += f"rows {len(a)} and {len(b)}; only Spark: {x}; only SQL: {y}"
    return said


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e

    spark = session(int(__import__("os").environ.get("CORES", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, found = connect(sys.argv[1]), e.oracle_sql(), e.queries()
    for name in sys.argv[2:] or list(found):
        began = time.time()
        try:
            said = differences(spark, con, sys.argv[1], found[name], sqls[name]) if name in sqls else f"no SQL; {found[name](spark, sys.argv[1]).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name} {time.time() - began:.1f}s {said or 'same'}", flush=True)
