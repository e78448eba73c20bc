"""Run registered queries and their SQL side by side: ``python tests/oracle.py SF_DIR [NAME...]``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return str(value)


def differences(df, con, sql):
    """Up to three rows that only one side has, and the two counts."""
    from collections import Counter

    names = sorted(df.columns)
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    want = Counter(tuple(shown(r[i]) for i in order) for r in result.fetchall())
    got = Counter(tuple(shown(r[n]) for n in names) for r in df.collect())
    if got == want:
        return ""
    return f"{names}: {sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want))[:3]}; only SQL {list((want - got))[:3]}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    con = connect(sys.argv[1])
    queries, oracles = entry.queries(), entry.oracle_sql()
    good = 0
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            said = differences(queries[name](spark, sys.argv[1]), con, oracles[name])
        except Exception as e:  # report and go on with the next query
            said = f"{type(e).__name__}: {str(e)[:700]}"
        good += not said
        if said or len(sys.argv) > 2:
            print("@@", name, round(time.time() - began, 1), said or "same", flush=True)
    print("@@ same:", good, "of", len(sys.argv[2:] or oracles))
