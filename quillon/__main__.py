"""`python -m quillon load [flags] FILE.csv ...` and `python -m quillon shell [flags]`."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from .catalog import Catalog
from .errors import QuillonError
from .plans.sql import Engine
from .sources.files import load_csvs
from .sources.store import Store

HELP = """SELECT, INSERT, UPDATE and DELETE end with a semicolon and may take several lines. Also:
  joinopt SELECT ...;  the join orders that were considered and the best one
  cbo SELECT ...;      the rows, with the joins reordered
  tables;              the tables and their columns
  help                 this text
  exit or \\q           the end"""


def arguments(given: list[str]) -> argparse.Namespace:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-catalog", "--catalog", default="catalog.json", help="file with tables and indexes")
    common.add_argument("-db", "--db", default="quillon_data", help="folder of the store, on any file system that Spark reads")
    common.add_argument("-buffer", "--buffer", type=int, default=1000, help="buffers that the join costs assume")
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", parents=[common], help="append CSV files to the tables of their names")
    load.add_argument("-truncate", "--truncate", action="store_true", help="empty these tables first")
    load.add_argument("files", nargs="+")
    commands.add_parser("shell", parents=[common], help="statements from the terminal or a pipe")
    return parser.parse_args(given)


def opened(spark, options: argparse.Namespace) -> tuple[Catalog, Store]:
    """The catalog and a store that has all its tables."""
    catalog, store = Catalog.load(options.catalog), Store(spark, options.db)
    for name in sorted(set(catalog.tables) - set(store.tables())):
        store.create(name, catalog.tables[name].schema)
    return catalog, store


def load(spark, options: argparse.Namespace) -> list[str]:
    catalog, store = opened(spark, options)
    if options.truncate:
        with store.begin() as transaction:
            for file in options.files:
                name = file.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")
                if name in catalog.tables:
                    transaction.delete(name)
    loaded = load_csvs(spark, catalog, options.files, store)
    skipped = [f"{f}: no such table" for f in options.files if f.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv") not in loaded]
    return [*(f"{name}: {n} rows" for name, n in loaded.items()), *skipped]


def shell(spark, options: argparse.Namespace, lines: Iterable[str]) -> Iterable[str]:
    """What the shell answers to lines. An error ends a statement, not the shell."""
    catalog, store = opened(spark, options)
    engine, held = Engine(spark, store, catalog, options.buffer), ""
    for line in lines:
        word = line.strip().rstrip(";").lower()
        if not held and word in ("exit", "quit", "\\q"):
            return
        if not held and word == "help":
            yield HELP
            continue
        if not held and word == "tables":
            yield "\n".join(f"{t.name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in t.schema)})" for t in catalog.tables.values())
            continue
        held += line if line.endswith("\n") else f"{line}\n"
        if held.strip() and held.rstrip().endswith(";"):
            statement, held = held.strip(), ""
            try:
                yield engine.run(statement)
            except (QuillonError, ValueError, *_spark_errors()) as error:
                yield f"error: {str(error).splitlines()[0]}"
        elif not held.strip():
            held = ""


def _spark_errors() -> tuple:
    from pyspark.errors import PySparkException

    return (PySparkException,)


def main(given: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    options = arguments(sys.argv[1:] if given is None else given)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    for told in load(spark, options) if options.command == "load" else shell(spark, options, sys.stdin):
        print(told, flush=True)


if __name__ == "__main__":
    main()
