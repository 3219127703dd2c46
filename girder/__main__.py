"""python -m girder QUERY SF_DIR DESTINATION: run a registered query and publish its result; without arguments, list the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from girder.plans import catalogue
from girder.sinks.exports import publish


def main(args: list[str]) -> int:
    queries = catalogue.queries()
    if len(args) != 3 or args[0] not in queries:
        print("\n".join(sorted(queries)))
        return int(bool(args))
    spark = SparkSession.builder.appName(f"girder {args[0]}").getOrCreate()
    publish(queries[args[0]](spark, args[1]), args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
