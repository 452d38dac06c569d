"""python -m tidegraph --abox FILE --tbox FILE [--syntax ntriples] [--query FILE]: load, materialize, report."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from tidegraph.graph import Graph


def main() -> None:
    args = argparse.ArgumentParser(prog="tidegraph")
    args.add_argument("--abox", required=True, help="facts, a path that Spark can read")
    args.add_argument("--tbox", required=True, help="rules, a path that Spark can read")
    args.add_argument("--syntax", default="ntriples", choices=("ntriples", "nquads", "turtle", "trig"))
    args.add_argument("--query", help="a SPARQL query")
    args.add_argument("--output", help="folder for the materialized facts")
    a = args.parse_args()
    spark = SparkSession.builder.appName("tidegraph").getOrCreate()
    start = time.time()
    rules = "\n".join(r.value for r in spark.read.text(a.tbox, wholetext=True).collect())
    graph = Graph(spark, rules=rules).read(a.abox, a.syntax)
    print(f"loaded {len(graph)} facts and {len(graph.rules)} rules in {time.time() - start:.2f} s")
    start = time.time()
    graph.materialize()
    print(f"materialized {len(graph)} facts in {time.time() - start:.2f} s")
    if a.query:
        graph.query(a.query).show(truncate=False)
    if a.output:
        graph.dump().write.text(a.output)


if __name__ == "__main__":
    main()
