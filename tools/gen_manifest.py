"""Record, per registered query with an oracle, the double columns of its Spark output.

The registry rounds exactly these columns in the oracle SQL (wattpanel/plans/rounding.py).
Run after changing a query's output columns: python tools/gen_manifest.py
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from wattpanel.plans.registry import load_raw
    from wattpanel.plans.rounding import MANIFEST
    from wattpanel.session import get_spark

    spark = get_spark("local[8]")
    qs, ors = load_raw()
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    out = {}
    for name in sorted(ors):
        df = qs[name](spark, sf)
        out[name] = [n for n, t in df.dtypes if t == "double"]
        print(name, len(out[name]), file=sys.stderr)
    with open(MANIFEST, "w") as f:
        json.dump(out, f, indent=1, sort_keys=True)


if __name__ == "__main__":
    main()
