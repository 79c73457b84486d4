"""spark-submit job: run one registered query over a table folder and write its rows as parquet.

    spark-submit --py-files stayflow.zip stayflow/jobs/report.py --query property_report --tables <folder> --out <folder>
"""

from __future__ import annotations

import argparse

from stayflow.plans import analytics, people, projections, reads, rules, streams, tables  # noqa: F401
from stayflow.plans.catalog import QUERIES
from stayflow.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--query", required=True, choices=sorted(QUERIES))
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args()

    spark = build_session(f"report-{args.query}")
    QUERIES[args.query](spark, args.tables).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
