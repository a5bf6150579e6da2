"""``python -m tidewatch list | run QUERY | brief USER | report`` over the tables of ``--sf-dir``."""

from __future__ import annotations

import argparse

from tidewatch import api
from tidewatch.plans.queries import QUERIES
from tidewatch.session import get_spark


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    parser.add_argument("command", choices=["list", "run", "brief", "report"])
    parser.add_argument("what", nargs="?", default="")
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.001")
    parser.add_argument("--out", help="write Parquet here instead of showing rows")
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = get_spark("tidewatch")
    if args.command == "report":
        print(api.calibration_report(spark, args.sf_dir))
    elif args.command == "brief":
        for name, df in api.brief(spark, args.sf_dir, int(args.what)).items():
            print(name)
            df.show(truncate=False)
    elif args.out:
        QUERIES[args.what](spark, args.sf_dir).write.parquet(args.out)
    else:
        QUERIES[args.what](spark, args.sf_dir).show(truncate=False)


if __name__ == "__main__":
    main()
