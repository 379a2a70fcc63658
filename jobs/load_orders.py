"""Load an order file into the order-line table.

spark-submit jobs/load_orders.py --source orders.csv --table warehouse/lines --audit warehouse/loads \
    [--returns returns.csv] [--append] [--encoding utf-8] [--number-rows] [--star warehouse/star]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyworks.operators.cleaning import quality_report, require_sound  # noqa: E402
from tallyworks.plans.rfm import rfm_quintiles  # noqa: E402
from tallyworks.plans.star import build_star, write_star  # noqa: E402
from tallyworks.session import build_session  # noqa: E402
from tallyworks.sources import files, sinks  # noqa: E402
from tallyworks.sources.flat import read_flat  # noqa: E402


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    options.add_argument("--source", required=True, help="order file or folder of files with one header")
    options.add_argument("--table", required=True)
    options.add_argument("--audit", required=True)
    options.add_argument("--returns", help="ledger of returned orders")
    options.add_argument("--encoding", help="found from the data unless given")
    options.add_argument("--append", action="store_true", help="keep the lines already stored")
    options.add_argument("--number-rows", action="store_true", help="add row_id 1..n, which sorts the whole table")
    options.add_argument("--star", help="also write the star schema there")
    chosen = options.parse_args()

    # Large tables want large files: tasks after a shuffle aim at this size.
    spark = build_session("load_orders", **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m"})
    returned = files.read_returns_csv(spark, chosen.returns) if chosen.returns else None
    result = sinks.load_order_lines(
        files.read_orders_csv(spark, chosen.source, chosen.encoding),
        chosen.table,
        chosen.audit,
        os.path.basename(chosen.source),
        files.size_in_bytes(spark, chosen.source),
        replace=not chosen.append,
        returned_orders=returned,
        number_rows=chosen.number_rows,
        load_id=files.file_identity(spark, chosen.source),
    )
    print(result)
    lines = read_flat(spark, chosen.table)
    require_sound(lines)
    quality_report(lines).show(vertical=True, truncate=False)
    if chosen.star:
        write_star(build_star(lines, rfm_quintiles(lines)), chosen.star)
    spark.stop()


if __name__ == "__main__":
    main()
