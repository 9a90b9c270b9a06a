"""Run queries against their oracles: python tests/check.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import connect, differences, type_differences
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from respeval.session import configure

spark = (
    configure(SparkSession.builder.master("local[8]"))
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "12g")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
sf_dir, names = sys.argv[1], sys.argv[2:]
queries, oracles = entry.queries(), entry.oracle_sql()
con = connect(sf_dir)
bad = 0
for name in names or queries:
    start = time.time()
    try:
        df = queries[name](spark, sf_dir)
        if name in oracles:
            verdict = differences(df, con, oracles[name]) or "ok"
            kinds = type_differences(df, con, oracles[name])
            verdict += f"  TYPES {kinds}" if kinds else ""
        else:
            verdict = f"rows only: {len(df.collect())}"
    except Exception as error:
        verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
    bad += not verdict.startswith(("ok", "rows"))
    print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)
print("failed:", bad, "of", len(names or queries), "unmatched oracles:", set(oracles) - set(queries))
sys.exit(bool(bad))
