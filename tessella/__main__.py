"""A prompt for statements: ``python -m tessella`` reads one a line, from a terminal or a pipe.

``--table name=path[:key]`` adds a Parquet table, ``--edges name=path`` an edge table with columns src and dst,
``--catalog folder`` loads a saved catalog and saves it again at the end.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessella.errors import TessellaError
from tessella.plans.catalog import Catalog
from tessella.plans.engine import Engine


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    p.add_argument("--table", action="append", default=[])
    p.add_argument("--edges", action="append", default=[])
    p.add_argument("--catalog")
    given = p.parse_args(args)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    catalog = Catalog.load(spark, given.catalog) if given.catalog and Catalog.saved(spark, given.catalog) else Catalog(spark)
    for t in given.table:
        name, _, path = t.partition("=")
        path, _, key = path.rpartition(":") if ":" in path.rsplit("/", 1)[-1] else (path, "", "")
        catalog.add_table(name, spark.read.parquet(path), key or None)
    for t in given.edges:
        name, _, path = t.partition("=")
        catalog.add_edges(name, spark.read.parquet(path))
    engine, batch = Engine(spark, catalog), None
    for line in sys.stdin:
        s = line.strip().rstrip(";").strip()
        if s.lower() in ("exit", "quit"):
            break
        if s.upper() == "BEGIN BATCH":
            batch = [s]
        elif batch is not None:
            batch.append(s)
            if s.upper() == "END BATCH":
                print("\n".join(engine.run_lines(batch)), flush=True)
                batch = None
        elif s:
            try:
                for piece in engine.pieces(s):
                    print(piece, end="")
                print(flush=True)
            except TessellaError:
                print(engine.run(s), flush=True)  # as an error of the form that the statement asks for
    if given.catalog:
        catalog.save(given.catalog)


if __name__ == "__main__":
    main()
