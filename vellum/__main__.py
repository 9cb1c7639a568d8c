"""``python -m vellum ROOT COMMAND``: get, set, delete, query, list-stores and shell over the managed stores of a folder."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from vellum.engine import Engine
from vellum.errors import EngineError
from vellum.sources.storage import subfolders


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__)
    parser.add_argument("root")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in {"get": ["store", "id"], "set": ["store", "id", "delta"], "delete": ["store", "id"], "query": ["store", "query"], "list-stores": [], "ping": [], "shell": []}.items():
        command = commands.add_parser(name)
        for word in words:
            command.add_argument(word)
        if name == "query":
            command.add_argument("--hydrate", action="store_true")
    return parser


def run(engine: Engine, args: argparse.Namespace) -> dict:
    """One command as a request."""
    store = getattr(args, "store", "")
    if store and store not in engine.specs:
        try:
            engine.open_store(store)
        except EngineError as error:
            return {"ok": False, "error": f"no store {error}", "code": 404}
    if args.command == "list-stores":
        for name in subfolders(engine.spark, f"{engine.root}/stores", "config"):
            engine.open_store(name)
    actions = {"get": "read", "set": "write", "list-stores": "list_stores"}
    params = {"record_id": getattr(args, "id", "")}
    if args.command == "set":
        params["delta"] = json.loads(args.delta)
    if args.command == "query":
        params = json.loads(args.query) | {"hydrate": args.hydrate}
    return engine.execute(actions.get(args.command, args.command), store, params)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    parser = _parser()
    args = parser.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), args.root)
    if args.command != "shell":
        out = run(engine, args)
        print(json.dumps(out, default=str, ensure_ascii=False))
        return 0 if out["ok"] else 1
    for line in sys.stdin:
        if words := shlex.split(line):
            try:
                print(json.dumps(run(engine, parser.parse_args([args.root, *words])), default=str, ensure_ascii=False), flush=True)
            except SystemExit:
                continue
    return 0


if __name__ == "__main__":
    sys.exit(main())
