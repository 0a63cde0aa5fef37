"""python tests/run_compare.py <sf folder> [query ...]: compare and print."""

import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import compare, duck

folder = sys.argv[1]
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = duck(folder)
queries, oracles = entry.queries(), entry.oracle_sql()
bad = []
for name in sys.argv[2:] or queries:
    try:
        problem, n, sec = compare(spark, con, folder, queries[name], oracles.get(name))
    except Exception as error:
        problem, n, sec = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0
    print(f"{'ok ' if problem is None else 'BAD'} {'O' if name in oracles else 'R'} "
          f"{name:24s} {n:8d} {sec:6.2f}s {problem or ''}", flush=True)
    bad += [name] if problem else []
print("bad:", bad)
