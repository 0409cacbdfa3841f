"""Compare queries with their SQL: python tests/check_oracles.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import oracle  # noqa: E402

from folio.plans import catalogue, oracles  # noqa: E402
from folio.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(catalogue.QUERIES)
    spark = build_session(
        "folio-check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.duck(sf_dir)
    for name in names:
        start = time.time()
        try:
            if name in oracles.ORACLES:
                n, diff = oracle.compare(spark, con, catalogue.QUERIES[name], oracles.ORACLES[name], sf_dir)
            else:
                n, diff = catalogue.QUERIES[name](spark, sf_dir).count(), "(no SQL)"
        except Exception as e:
            n, diff = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:28} {n:8} rows {time.time() - start:6.1f}s  {diff or 'equal'}", flush=True)
