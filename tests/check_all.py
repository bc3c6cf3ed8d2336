"""Compare every registered query with its DuckDB oracle: python tests/check_all.py [sf_dir] [name...]"""

import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

from cartlake.plans.session import get_session  # noqa: E402
from cartlake.queries import REGISTRY  # noqa: E402
from oracle import compare, duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(REGISTRY)
spark = get_session("local[8]", 8)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
bad = 0
for n in names:
    fn, sql = REGISTRY[n]
    t0 = time.time()
    try:
        if sql:
            ok, msg = compare(spark, fn, sql, sf, con)
        else:
            ok, msg = True, f"rows-only: {fn(spark, sf).count()} rows"
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {n:34s} {time.time()-t0:5.1f}s {msg}", flush=True)
print(f"{len(names)-bad}/{len(names)} ok")
