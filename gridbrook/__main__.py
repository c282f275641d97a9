"""Command line: ``python -m gridbrook --list`` or ``python -m gridbrook QUERY INPUT [--output PATH]``."""

from __future__ import annotations

import argparse
import fnmatch
import logging
import sys
import time

log = logging.getLogger("gridbrook")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridbrook", description="Run a query of the engine over a folder of tables.")
    out.add_argument("query", nargs="?", help="name of the query, or with --list a pattern of names (* and ?)")
    out.add_argument("input", nargs="?", help="folder of <table>.parquet")
    out.add_argument("--output", help="write the result there as Parquet instead of showing it")
    out.add_argument("--rows", type=int, default=20, help="rows to show")
    out.add_argument("--list", action="store_true", help="list the queries and whether they have SQL")
    out.add_argument("-v", "--verbose", action="count", default=0, help="say more (twice: the plan too)")
    out.add_argument("-q", "--quiet", action="store_true", help="say errors only")
    return out


def main(arguments: list[str] | None = None) -> int:
    told = parser().parse_args(arguments)
    logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s", level=logging.ERROR if told.quiet else logging.DEBUG if told.verbose else logging.INFO)
    from gridbrook.plans import catalog

    queries = catalog.queries()
    if told.list:
        for name in sorted(n for n in queries if fnmatch.fnmatchcase(n, told.query or "*")):
            print(name, "sql" if name in catalog.oracle_sql() else "-")
        return 0
    if told.query not in queries or not told.input:
        log.error("no such query: %s" if told.query not in queries else "no input for %s", told.query)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    start = time.perf_counter()
    result = queries[told.query](spark, told.input)
    if told.verbose > 1:
        result.explain("formatted")
    if told.output:
        result.write.mode("overwrite").parquet(told.output)
    else:
        result.show(told.rows, truncate=False)
    log.info("%s took %.3f s", told.query, time.perf_counter() - start)
    return 0


if __name__ == "__main__":
    sys.exit(main())
