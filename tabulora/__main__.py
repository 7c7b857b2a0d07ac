"""Command line: python -m tabulora {queries,run,preflight,eval} …"""

from __future__ import annotations

import argparse
import os
import sys

from tabulora.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabulora", description="Queries, checks and evaluations of the engine.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the queries")
    run = commands.add_parser("run", help="runs a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="folder for the result as Parquet; else some rows are shown")
    check = commands.add_parser("preflight", help="rows of stored tables, settings, warnings")
    check.add_argument("store", help="folder with documents and chunks")
    cases = commands.add_parser("eval", help="evaluation cases against stored documents")
    cases.add_argument("dataset")
    cases.add_argument("store")
    cases.add_argument("--layer", default="all", choices=("all", "chunk", "retrieval", "facts", "answer"))
    args = parser.parse_args(argv)

    from tabulora.plans import queries

    if args.command == "queries":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    spark = get_session("tabulora")
    if args.command == "run":
        if args.name not in queries.QUERIES:
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        out = queries.QUERIES[args.name](spark, args.tables)
        out.write.parquet(args.out) if args.out else out.show(20, truncate=60)
        return 0
    from tabulora.plans import cases as case_files
    from tabulora.plans import preflight
    from tabulora.sources import tables

    documents, chunks = (tables.Table(spark, f"{args.store}/{n}", s).read() for n, s in (("documents", tables.DOCUMENTS), ("chunks", tables.CHUNKS)))
    if args.command == "preflight":
        names = ("embedding_base_url", "embedding_model", "embedding_api_key", "llm_base_url", "llm_model", "llm_api_key")
        settings = {n: os.environ.get(f"TABULORA_{n.upper()}") for n in names}
        preflight.report(spark, settings, documents=documents, chunks=chunks).show(100, truncate=False)
        return 0
    out = case_files.run(spark, case_files.load(spark, args.dataset), documents, chunks, args.layer).collect()
    for r in out:
        print(f"{r['layer']}: {r.passed} of {r.cases} ({r.rate})")
    return int(any(r.passed < r.cases for r in out))


if __name__ == "__main__":
    sys.exit(main())
