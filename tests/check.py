"""Command line check: python tests/check.py SF [plan ...] (all plans by default)."""

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import difference, duck  # noqa: E402
from pulsegrid.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    plans, texts = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or plans:
        started = time.time()
        try:
            df = plans[name](spark, sf_dir)
            if name in texts:
                problem = difference(df, con, texts[name])
            else:
                count = df.count()
                problem = None if count else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:1500]
        failed += problem is not None
        spark.catalog.clearCache()
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed", failed, "of", len(sys.argv[2:] or plans), "with sql", len(texts))
    return failed


if __name__ == "__main__":
    sys.exit(main())
