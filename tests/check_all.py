"""Command line: compare every registered query with its SQL.  ``check_all.py [sf_dir [names...]]``"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = differences(build(spark, sf_dir), con, sql[name]) if name in sql else [
                f"no SQL, {build(spark, sf_dir).count()} rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found) and name in sql
        print(f"{name:20s} {time.time() - start:6.2f}s {'ok' if not found else ''}", *found, sep="\n   " if found else " ", flush=True)
    print("mismatches:", bad)
