"""Tools over JSON-RPC lines on standard input and output: python -m tessera.server --root REPO."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from tessera.api import AmbiguousTarget, CodeGraph, UnknownTarget
from tessera.operators.context import BudgetTooSmall
from tessera.operators.store import StoreError
from tessera.sources import discovery

MAX_LINE = 4 * 1024 * 1024
TOOLS = ("index", "index_status", "explain", "callers", "callees", "dependents", "context", "doctor", "watch_start", "watch_stop")


class Poller:
    """Changed paths of a tree by modification time and size; a batch closes after ``quiet``
    seconds without a change, or ``most`` seconds after its first."""

    def __init__(self, root: str, quiet: float = 0.2, most: float | None = None):
        self.root, self.quiet, self.most = root, quiet, 20 * quiet if most is None else most
        self.seen = self.snapshot()
        self.open: set[str] = set()
        self.first = self.last = 0.0

    def snapshot(self) -> dict[str, tuple[int, int]]:
        out = {}
        for p in discovery.walk(self.root)[0]:
            try:
                s = os.stat(os.path.join(self.root, p))
            except OSError:
                continue
            out[p] = (s.st_mtime_ns, s.st_size)
        return out

    def poll(self, now: float) -> list[str] | None:
        new = self.snapshot()
        changed = {p for p in new.keys() | self.seen.keys() if new.get(p) != self.seen.get(p)}
        self.seen = new
        if changed:
            self.first = self.first if self.open else now
            self.last = now
            self.open |= changed
        if self.open and (now - self.last >= self.quiet or now - self.first >= self.most):
            return self.take()
        return None

    def take(self) -> list[str]:
        out, self.open = sorted(self.open), set()
        return out


class Server:
    def __init__(self, graph: CodeGraph):
        self.graph, self.lock = graph, threading.Lock()
        self.stop: threading.Event | None = None
        self.counters = {"applied": 0, "failed": 0, "events": 0}
        self.failures: list[str] = []

    def _steps(self, w):
        return {"steps": [r.asDict() for r in w.steps.orderBy("distance", "id").collect()], "visited": w.visited, "closed": w.closed, "bounded": w.bounded}

    def call(self, tool: str, a: dict):
        g = self.graph
        if tool == "watch_start":
            return self.watch_start(a)
        if tool == "watch_stop":
            return self.watch_stop()
        with self.lock:
            if tool == "index":
                return g.index()
            if tool == "index_status":
                return g.status() | {"stale": g.store.is_stale(), "watch": dict(self.counters)}
            if tool == "explain":
                return [r.asDict() for r in g.explain(a["target"]).collect()]
            if tool in ("callers", "callees"):
                return self._steps(getattr(g, tool)(a["target"]))
            if tool == "dependents":
                return self._steps(g.dependents(a["target"], int(a.get("depth", 2))))
            if tool == "context":
                p = g.peek(a["target"], int(a.get("budget", 4000)))
                return {"status": p.status, "spent": p.spent, "text": p.render()}
            if tool == "doctor":
                return [r.asDict() for r in g.doctor().collect()]
        raise KeyError(tool)

    def watch_start(self, a: dict) -> dict:
        if self.stop and not self.stop.is_set():
            return {"verdict": "already_running"}
        self.stop, ready = threading.Event(), threading.Event()

        def loop(stop):
            poller = Poller(self.graph.root, float(a.get("quiet_ms", 200)) / 1000)
            ready.set()
            while not stop.is_set():
                self._apply(poller.poll(time.monotonic()))
                stop.wait(0.05)
            self._apply(poller.take() or None)

        self.thread = threading.Thread(target=loop, args=(self.stop,), daemon=True)
        self.thread.start()
        ready.wait(30)
        return {"verdict": "watching"}

    def _apply(self, paths: list[str] | None) -> None:
        if not paths:
            return
        self.counters["events"] += len(paths)
        try:
            with self.lock:
                self.graph.refresh(paths)
            self.counters["applied"] += 1
        except Exception as e:  # noqa: BLE001  the watch goes on
            self.counters["failed"] += 1
            self.failures = (self.failures + [str(e)])[-32:]

    def watch_stop(self) -> dict:
        if not self.stop:
            return {"verdict": "not_running"}
        self.stop.set()
        self.thread.join(120)
        self.stop = None
        return {"verdict": "stopped", **self.counters}

    def answer(self, line: str) -> dict | None:
        """One request to one response; a notification (without id) has none."""
        if len(line) > MAX_LINE:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "the line is too long"}}
        try:
            r = json.loads(line)
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if not isinstance(r, dict) or r.get("jsonrpc") != "2.0" or not isinstance(r.get("method"), str):
            return {"jsonrpc": "2.0", "id": r.get("id") if isinstance(r, dict) else None, "error": {"code": -32600, "message": "not a request"}}
        out: dict = {"jsonrpc": "2.0", "id": r.get("id")}
        method, params = r["method"], r.get("params") or {}
        try:
            if method == "tools/list":
                out["result"] = {"tools": [{"name": t} for t in TOOLS]}
            elif method == "tools/call" and params.get("name") in TOOLS:
                out["result"] = {"verdict": "ok", "value": self.call(params["name"], params.get("arguments") or {})}
            else:
                out["error"] = {"code": -32601, "message": f"no method {params.get('name', method)!r}"}
        except AmbiguousTarget as e:
            out["result"] = {"verdict": "refused", "reason": e.kind, "candidates": e.candidates, "advice": "name one of the candidates by path or qualified name"}
        except (UnknownTarget, StoreError) as e:
            out["result"] = {"verdict": "refused", "reason": e.kind, "message": str(e)}
        except BudgetTooSmall as e:
            out["result"] = {"verdict": "refused", "reason": "budget_too_small", "minimum": e.minimum}
        except KeyError as e:
            out["error"] = {"code": -32602, "message": f"missing argument {e}"}
        return out if "id" in r else None


def main(argv: list[str] | None = None) -> int:
    import argparse

    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(prog="tessera.server")
    p.add_argument("--root", default=".")
    p.add_argument("--index-dir")
    a = p.parse_args(argv)
    server = Server(CodeGraph(SparkSession.builder.appName("tessera").getOrCreate(), a.root, a.index_dir))
    for line in sys.stdin:
        if line.strip():
            reply = server.answer(line)
            if reply is not None:
                print(json.dumps(reply, default=str), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
