"""Compare Spark and DuckDB result column types for every query with oracle SQL."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from oracle_check import TABLES  # noqa: E402
from tagwise.plans.registry import load_all  # noqa: E402
from tagwise.session import local_session  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    reg = load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for n, spec in reg.items():
        if spec.sql is None:
            continue
        st = {f.name: f.dataType.simpleString() for f in spec.fn(spark, sf).schema.fields}
        rel = con.sql(spec.sql)
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        for c, t in st.items():
            if SPARK_TO_DUCK.get(t, t) != dt.get(c):
                print(f"{n}.{c}: spark={t} duck={dt.get(c)}")
                bad += 1
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
