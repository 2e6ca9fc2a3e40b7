"""python -m memloom.cli search QUERY | status | config show|set|profiles|drop: JSON to standard output."""

from __future__ import annotations

import argparse
import json
import sys

from memloom.config import as_dict, drop_profile, list_profiles, load_config, set_value, with_overrides


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="memloom")
    p.add_argument("--config", default="memloom.json")
    p.add_argument("--profile")
    for name in ("workspace", "store"):
        p.add_argument(f"--{name}")
    for name in ("max-results", "min-score", "token-max", "fts-weight", "chunk-size"):
        p.add_argument(f"--{name}", type=float)
    sub = p.add_subparsers(dest="command", required=True)
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--after")
    search.add_argument("--before")
    sub.add_parser("status")
    config = sub.add_parser("config").add_subparsers(dest="action", required=True)
    config.add_parser("show")
    config.add_parser("profiles")
    one = config.add_parser("set")
    one.add_argument("key")
    one.add_argument("value", help="JSON, or else a text")
    config.add_parser("drop").add_argument("name")
    return p


def _configure(a: argparse.Namespace) -> int:
    """Settings need no session."""
    try:
        if a.action == "set":
            try:
                value = json.loads(a.value)
            except ValueError:
                value = a.value
            set_value(a.config, a.key, value, a.profile)
            out = {"key": a.key, "value": value}
        elif a.action == "drop":
            out = {"dropped": drop_profile(a.config, a.name)}
        elif a.action == "profiles":
            out = {"profiles": list_profiles(a.config)}
        else:
            out = as_dict(load_config(a.config, a.profile))
    except (KeyError, ValueError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    print(json.dumps(out, indent=2, ensure_ascii=False))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "config":
        return _configure(a)
    names = ("workspace", "store", "max_results", "min_score", "token_max", "fts_weight", "chunk_size")
    config = with_overrides(load_config(a.config, a.profile), **{n: getattr(a, n) for n in names})
    from pyspark.sql import SparkSession

    from memloom.api import Memory

    memory = Memory(SparkSession.builder.appName("memloom").getOrCreate(), config)
    memory.sync()
    if a.command == "status":
        print(json.dumps(memory.status(), indent=2))
    else:
        rows = [r.asDict() for r in memory.search(a.query, after=a.after, before=a.before).orderBy("rank").collect()]
        print(json.dumps({"results": rows, "count": len(rows)}, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
