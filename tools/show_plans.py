"""Print the formatted physical plan of registered queries.

Usage: python tools/show_plans.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    from tagwise.plans.registry import load_all
    from tagwise.session import local_session

    spark = local_session()
    reg = load_all()
    for n in args.names:
        print(f"===== {n} =====")
        reg[n].fn(spark, args.sf).explain("formatted")


if __name__ == "__main__":
    main()
