"""python -m quarry index|search|context|dump|serve"""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index a folder or file")
    i.add_argument("path")
    i.add_argument("--force", action="store_true")
    i.add_argument("--ext", nargs="*")
    s = sub.add_parser("search", help="search an index")
    s.add_argument("path")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=8)
    s.add_argument("--mode", default="hybrid")
    c = sub.add_parser("context", help="build context for a prompt")
    c.add_argument("path")
    c.add_argument("query")
    c.add_argument("--budget", type=int, default=8000)
    d = sub.add_parser("dump", help="show chunks and store nothing")
    d.add_argument("path")
    sub.add_parser("serve", help="answer tool calls on standard input")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from quarry.plans.config import load_config
    from quarry.plans.engine import Engine
    from quarry.plans.server import serve
    from quarry.sources.embedders import build_embedder

    config = load_config(a.config)
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, config.home, build_embedder(config.embedding.backend, **config.embedding.options()), chunking=config.index.chunking(), max_file_size_kb=config.index.max_file_size_kb)
    if a.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
        return 0
    if a.command == "dump":
        from quarry.operators.chunk import dump_chunks
        from quarry.sources.files import read_sources

        for shown in dump_chunks(read_sources(spark, a.path)):
            print(shown, end="\n\n")
        return 0
    if a.command == "index":
        out = engine.index_codebase(a.path, a.force, a.ext)
    elif a.command == "search":
        out = engine.search_code(query=a.query, path=a.path, top_k=a.top_k, mode=a.mode)
    else:
        out = engine.get_context_for_prompt(query=a.query, path=a.path, token_budget=a.budget)
    print(json.dumps(out, indent=2))
    return int(out.get("status") == "error")


if __name__ == "__main__":
    sys.exit(main())
