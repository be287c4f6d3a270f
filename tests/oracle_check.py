"""Compares registered queries with their SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

import sys

import duckdb

sys.path.insert(0, ".")


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(repr(round(v, 6) if isinstance(v, float) else None if v is None or v != v else v.item() if hasattr(v, "item") else v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def compare(spark, sf_dir, name, fn, sql):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    got, want = fn(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, list(got.columns), list(want.columns))
    a, b = rows(got), rows(want)
    assert a == b, (name, len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    return len(a)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        try:
            print(name, compare(spark, sf, name, queries[name], sql[name]))
        except Exception as e:
            print("BAD", name, str(e)[:700])
