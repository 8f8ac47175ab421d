import json
import os
import time

from tessera.api import CodeGraph
from tessera.server import TOOLS, Poller, Server


def test_poller(tmp_path):
    (tmp_path / "a.rs").write_text("fn a() {}")
    p = Poller(str(tmp_path), quiet=1.0)
    assert p.poll(0.0) is None
    (tmp_path / "b.rs").write_text("fn b() {}")
    os.remove(tmp_path / "a.rs")
    assert p.poll(1.0) is None and p.poll(1.5) is None
    assert p.poll(2.0) == ["a.rs", "b.rs"] and p.poll(9.0) is None


def test_requests(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/lib.rs").write_text("pub fn one() { two(); }\nfn two() {}\n")
    s = Server(CodeGraph(spark, str(tmp_path / "r"), str(tmp_path / "i")))
    ask = lambda method, **params: s.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    tool = lambda name, **a: ask("tools/call", name=name, arguments=a)
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == list(TOOLS)
    assert tool("index")["result"]["value"]["orphans"] == 0
    assert len(tool("callers", target="two")["result"]["value"]["steps"]) == 1
    assert tool("callers", target="nope")["result"]["reason"] == "unknown_target"
    assert tool("context", target="one", budget=1)["result"]["minimum"] > 1
    assert ask("x")["error"]["code"] == -32601 and s.answer("{")["error"]["code"] == -32700 and tool("explain")["error"]["code"] == -32602
    assert s.answer(json.dumps({"jsonrpc": "2.0", "method": "tools/list"})) is None
    assert tool("watch_start", quiet_ms=50)["result"]["value"]["verdict"] == "watching"
    (tmp_path / "r/more.rs").write_text("fn three() {}\n")
    time.sleep(1)
    assert tool("watch_stop")["result"]["value"]["applied"] >= 1
    assert tool("callers", target="three")["result"]["verdict"] == "ok"
