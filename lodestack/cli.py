"""python -m lodestack.cli FILE QUERY: prints the payload for one file as JSON."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .sources import code


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("path")
    p.add_argument("query", help='text, a file, or "-" for standard input')
    for name, value in (("top-k", 6), ("prefilter", 300), ("depth", 1), ("max-add", 12), ("hard-cap", 1200), ("soft-cap", 1800)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--tokens", default="bytes4", help="bytes4, or the path of a vocabulary")
    given = p.parse_args(args)
    path = Path(given.path)
    if not path.is_file() or path.suffix != ".py":
        print(json.dumps({"error": f"no Python file: {path}"}))
        return 2
    if given.hard_cap <= 0 or given.soft_cap <= 0:
        print(json.dumps({"error": "token caps must be positive"}))
        return 2
    spark = SparkSession.builder.appName("lodestack").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = api.select_from_file(spark, given.path, code.read_query(given.query), given.top_k, given.prefilter, given.depth, given.max_add, given.hard_cap, given.soft_cap, given.tokens)
    print(json.dumps(json.loads(found.first()["payload"]), indent=2, ensure_ascii=False))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
