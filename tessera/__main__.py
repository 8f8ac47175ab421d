"""python -m tessera COMMAND: index, explain, callers, callees, dependents, context, doctor, status, rm.

Exit codes: 0 done, 1 failed, 2 usage, 3 refused, 4 unhealthy.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["index", "explain", "callers", "callees", "dependents", "context", "doctor", "status", "rm"])
    p.add_argument("target", nargs="?")
    p.add_argument("--root", default=".")
    p.add_argument("--index-dir")
    p.add_argument("--json", action="store_true")
    p.add_argument("--budget", type=int, default=4000)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--subtree", action="store_true")
    a = p.parse_args(argv)
    if a.command in ("explain", "callers", "callees", "dependents", "context", "rm") and not a.target:
        p.error(f"{a.command} needs a target")

    from pyspark.sql import SparkSession

    from tessera.api import AmbiguousTarget, CodeGraph, UnknownTarget
    from tessera.operators.context import BudgetTooSmall
    from tessera.operators.stats import worst
    from tessera.operators.store import StoreError

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    say = lambda rows: print(json.dumps(rows, default=str) if a.json else "\n".join(map(str, rows if isinstance(rows, list) else [rows])))
    try:
        g = CodeGraph(spark, a.root, a.index_dir)
        if a.command == "index":
            say(g.index())
        elif a.command == "status":
            say(g.status())
        elif a.command == "rm":
            say({"removed": g.remove(a.target, a.subtree)})
        elif a.command == "doctor":
            d = g.doctor()
            say([r.asDict() for r in d.collect()])
            return 4 if worst(d) == "fail" else 0
        elif a.command == "context":
            pack = g.peek(a.target, a.budget)
            print(json.dumps({"status": pack.status, "spent": pack.spent, "text": pack.render()}) if a.json else pack.render())
        elif a.command == "explain":
            say([r.asDict() for r in g.explain(a.target).collect()])
        else:
            w = {"callers": g.callers, "callees": g.callees}.get(a.command)
            w = w(a.target) if w else g.dependents(a.target, a.depth)
            say([r.asDict() for r in w.steps.orderBy("distance", "id").collect()])
    except (UnknownTarget, AmbiguousTarget, BudgetTooSmall, StoreError) as e:
        print(json.dumps({"refused": getattr(e, "kind", "budget"), "message": str(e), "candidates": getattr(e, "candidates", [])}), file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
