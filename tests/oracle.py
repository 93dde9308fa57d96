"""Run registered queries and compare them with their oracle: ``python tests/oracle.py [sf] [names]``."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else a short description of the difference."""
    frame = query(spark, sf_dir)
    columns = frame.columns
    ours = rows_of(columns, [tuple(row) for row in frame.collect()])
    if not ours:
        return "no rows"
    if sql is None:
        return None
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} != {sorted(names)}"
    theirs = rows_of(names, found.fetchall())
    if ours != theirs:
        return f"{sum((ours - theirs).values())} rows only here, {sum((theirs - ours).values())} only there: " \
               f"{list((ours - theirs))[:2]} / {list((theirs - ours))[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    wanted = sys.argv[2:]
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, entry.oracle_sql().get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)
