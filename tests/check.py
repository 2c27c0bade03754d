"""Compare named queries with their oracles: ``python tests/check.py SF [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import diff, duck  # noqa: E402
from tidegate.plans import MODULES, load_all  # noqa: E402
from tidegate.registry import ORACLES, QUERIES  # noqa: E402
from tidegate.session import local_session  # noqa: E402


def main(sf: str, wanted: list[str]) -> int:
    load_all()
    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = diff(spark, con, sf_dir, fn, ORACLES[name])
                rows = ""
            else:
                rows = f"{fn(spark, sf_dir).count()} rows, no oracle"
                problem = ""
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or rows}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
