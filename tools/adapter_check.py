"""Compare every Spark adapter view with its DuckDB restatement (arrays included)."""
import sys, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from collections import Counter
from tools.oracle_check import duck, rows_of
from casespark.session import get_spark
from casespark.sources import fixtures as fx
from oracles.views import VIEWS, with_views

def main(sf="/root/testdata/sf0.01", names=None):
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf)
    bad = []
    for name in names or list(VIEWS):
        sdf = getattr(fx, name)(spark, sf)
        s = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
        cur = con.execute(with_views(f"SELECT * FROM {name}", name))
        cols = [c[0] for c in cur.description]
        d = rows_of(cols, cur.fetchall())
        ok = sorted(cols) == sorted(sdf.columns) and Counter(s) == Counter(d)
        print("OK  " if ok else "FAIL", name, len(s), len(d))
        if not ok:
            bad.append(name)
            print("  cols", sorted(sdf.columns), sorted(cols))
            print("  spark-only", list((Counter(s) - Counter(d)).elements())[:2])
            print("  duck-only ", list((Counter(d) - Counter(s)).elements())[:2])
    return 1 if bad else 0

if __name__ == "__main__":
    sys.exit(main(names=sys.argv[1:] or None))
