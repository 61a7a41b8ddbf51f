"""``python -m tidemill.run OPERATION PATH CATALOG``: runs one operation of a catalog."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tidemill.common import ship
from tidemill.plans.pipeline import Catalog


def main(arguments: list[str]) -> int:
    if len(arguments) != 3:
        print(__doc__)
        return 2
    operation, path, catalog = arguments
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    Catalog(path).load(catalog).run(spark, operation)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
