"""A small tree: extract, resolve, ask, refresh, and the outline reader."""
import os

import pytest

from tessera.api import AmbiguousTarget, CodeGraph, UnknownTarget
from tessera.sources import discovery
from tessera.sources.rust import outline, validate_rules

FILES = {
    "src/lib.rs": "pub mod model;\npub mod service;\n\n/// Entry.\npub fn handler() { service::process(); }\n",
    "src/model.rs": "/// A ledger.\npub struct Ledger { pub total: u64 }\nimpl Ledger {\n    pub fn append(&mut self, n: u64) { self.total += n; self.check(); }\n    fn check(&self) {}\n}\npub fn render() {}\n",
    "src/service.rs": "use crate::model::{Ledger, render as draw};\npub fn process() {\n    let mut l = Ledger { total: 0 };\n    settle(&mut l);\n    draw();\n    missing();\n    std::mem::drop(1);\n    let f = |x| x;\n    f(2);\n}\nfn settle(l: &mut Ledger) { l.append(1); }\n#[test]\nfn works() { assert!(true); }\n",
    "src/ui.rs": "pub fn render() {}\npub trait Shape: Clone { fn area(&self) -> f64; }\npub enum Kind { A, B { x: u8 } }\n",
    "target/junk.rs": "fn x() {}",
    "README.md": "hello",
    "src/bad.rs": b"fn a() { \xff }",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in FILES.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(t if isinstance(t, bytes) else t.encode())
    g = CodeGraph(spark, str(root), str(tmp_path_factory.mktemp("index") / "i"))
    g.index()
    return g


def state(g, name, kind="calls", path="src/service.rs"):
    return g.store.edges().where(f"target_name = '{name}' AND kind = '{kind}' AND source_path = '{path}'").first()


def test_resolution(graph):
    assert state(graph, "settle")["ev_class"] == "same_file"
    d = state(graph, "draw")
    assert (d["resolution_state"], d["ev_class"], d["target_path"]) == ("resolved", "import_binding", "src/model.rs")
    assert state(graph, "missing")["reason"] == "no_candidate"
    assert state(graph, "drop")["reason"] == "external"
    assert state(graph, "f")["reason"] == "local_binding"
    m = state(graph, "check", path="src/model.rs")
    assert (m["resolution_state"], m["ev_class"], m["target_qualified_name"]) == ("resolved", "receiver_type", "Ledger.check")
    p = state(graph, "process", path="src/lib.rs")
    assert (p["resolution_state"], p["target_path"]) == ("resolved", "src/service.rs")


def test_invariants_and_doctor(graph):
    assert [r for r in graph.store.verify().collect() if r["violations"]] == []
    found = {r["check"]: r["severity"] for r in graph.doctor().collect()}
    assert found["integrity"] == "ok" and found["orphan_edges"] == "ok" and found["pending_work"] == "ok"
    assert {r["reason"] for r in graph.issues.collect()} == {"unsupported_extension", "invalid_utf8"}


def test_queries(graph):
    got = {r["id"].split("\x1f")[2]: r["distance"] for r in graph.dependents("settle", 2).steps.collect()}
    assert got["process"] == 1 and got["handler"] == 2
    with pytest.raises(AmbiguousTarget):
        graph.target("render")
    with pytest.raises(UnknownTarget):
        graph.target("nothing_here")
    assert graph.target("src/model.rs")["kind"] == "file"
    steps, note = graph.chain("settle", 4)
    assert steps.count() >= 1 and note


def test_lookups_reach_the_scan(graph):
    from tessera.operators import graph as G
    from tessera.operators import store as S

    node = graph.target("settle")["id"]
    edges, entities = graph.store.edges(), graph.store.entities()
    for df, column in ((G.adjacency(edges, node, "in"), "target_path"), (G.one_hop(edges, node, "out"), "source_path"), (G.strongest_incoming(edges.where(G.touches(edges, "dst", node))), "target_path"),
                       (S.point(entities, "src/ui.rs", "trait", "Shape"), "path"), (S.in_file(entities, "src/ui.rs"), "path")):
        pushed = [line for line in graph.store.query_plan(df).split("\n") if "PushedFilters" in line]
        assert pushed and any(f"EqualTo({column}," in line for line in pushed), pushed
    # what the stored columns say is what the id says
    assert {r["src"] for r in G.adjacency(edges, node, "in").collect()} == {r["src"] for r in edges.where(edges["dst"] == node).collect()}


def test_neighbours_without_an_entity_stay_in_a_pack(graph):
    store = graph.store
    whole = store.entities
    shown = graph.peek("settle", 4000).render()
    try:
        store.entities = lambda: whole().where("qualified_name <> 'process'")
        less = graph.peek("settle", 4000).render()
    finally:
        del store.entities
    assert "process" in shown and "(not in the index)" not in shown
    assert "process" in less and "(not in the index)" in less


def test_module_fingerprints_are_of_the_common_kind(graph):
    from tessera.functions.exprs import fnv1a64

    rows = graph.store.entities().where("kind IN ('module', 'package')").collect()
    assert rows and all(r["structural_fingerprint"].startswith("fnv1a64:") for r in rows)
    assert all(r["structural_fingerprint"] == fnv1a64(r["qualified_name"]) for r in rows if r["kind"] == "package")
    assert fnv1a64("") == "fnv1a64:cbf29ce484222325" and fnv1a64("a") == "fnv1a64:af63dc4c8601ec8c"


def test_header_is_cut_by_bytes(spark):
    from tessera.functions import exprs as X

    rows = [(1, "é" * 1000 + " do not edit"), (2, "é" * 1030 + " do not edit"), (3, "x" * 2000 + " Code Generated")]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, t string").selectExpr("i", "'src/main.rs' AS p", "t").select("i", X.classify("p", "t").alias("c")).collect()}
    assert got == {1: "generated", 2: "source", 3: "generated"}


def test_pack_budgets(graph):
    full = graph.peek("process", 100_000)
    assert full.status == "complete" and full.spent <= 100_000
    last = -1
    for budget in (graph.minimum_budget(), full.floor_for_target(), full.floor_for_target() + 60, full.spent):
        p = graph.peek("process", budget)
        assert p.spent <= budget
        n = p.rows.where("included").count()
        assert n >= last
        last = n
    assert graph.peek("process", graph.minimum_budget()).status == "insufficient"


def test_refresh_equals_rebuild(graph, spark, tmp_path_factory):
    f = os.path.join(graph.root, "src/service.rs")
    with open(f, "a") as h:
        h.write("pub fn extra() { settle_all(); }\nfn settle_all() {}\n")
    before = graph.store.generation
    graph.refresh(["src/service.rs"])
    assert graph.store.generation > before
    fresh = CodeGraph(spark, graph.root, str(tmp_path_factory.mktemp("index2") / "i"))
    fresh.index()
    for a, b in zip(graph.store.snapshot(), fresh.store.snapshot()):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    os.remove(os.path.join(graph.root, "src/ui.rs"))
    graph.refresh(["src/ui.rs"])
    assert graph.store.table("entity").where("path = 'src/ui.rs'").count() == 0


def test_scoped_refresh_decides_the_names_of_the_change(graph, spark, tmp_path_factory):
    """Rename what other files call, take a file away and bring another: as a rebuild, and no
    relation outside the names of the change is decided."""
    total = graph.store.table("relation").where("kind NOT IN ('defines', 'contains', 'owns')").count()
    model = os.path.join(graph.root, "src/model.rs")
    text = open(model).read()
    for new, changed in ((text.replace("render", "paint"), ["src/model.rs"]), (text, ["src/model.rs", "src/late.rs"])):
        with open(model, "w") as h:
            h.write(new)
        if "src/late.rs" in changed:
            with open(os.path.join(graph.root, "src/late.rs"), "w") as h:
                h.write("pub fn missing() {}\npub fn settle() {}\n")
        graph.refresh(changed)
        assert 0 < graph.decided < total
        fresh = CodeGraph(spark, graph.root, str(tmp_path_factory.mktemp("index3") / "i"))
        fresh.index()
        for a, b in zip(graph.store.snapshot(), fresh.store.snapshot()):
            assert a.exceptAll(b).collect() == [] and b.exceptAll(a).collect() == []
    assert state(graph, "missing")["resolution_state"] == "inferred"


def test_outline_details():
    ents, rels, quality = outline("src/ui.rs", FILES["src/ui.rs"])
    names = {(e["kind"], e["qualified_name"]) for e in ents}
    assert {("trait", "Shape"), ("method", "Shape.area"), ("enum", "Kind"), ("constant", "Kind.A"), ("field", "Kind.B.x")} <= names
    assert ("inherits", "Clone") in {(r["kind"], r["target_name"]) for r in rels}
    assert quality["defects"] == 0 and outline("a.rs", "fn f( {")[2]["defects"] > 0
    assert validate_rules() == []
    e = next(e for e in outline("a.rs", "// é\nfn f() {}\n")[0] if e["name"] == "f")
    assert (e["start_byte"], e["start_line"], e["start_column"]) == (6, 2, 1)


def test_lexical_paths_and_ignores(tmp_path):
    assert discovery.normalise_lexically("a/./b/../c") == "a/c" and discovery.climbs("../a") and discovery.drive_relative("C:x")
    assert discovery.contains("/a/b", "/a/b/c") and not discovery.contains("/a/b", "/a/bc")
    (tmp_path / "x").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n/x/skip/\n")
    for n in ("a.log", "keep.log", "x/y.rs"):
        (tmp_path / n).write_text("1")
    (tmp_path / "x/skip").mkdir()
    (tmp_path / "x/skip/z.rs").write_text("1")
    os.symlink("/nonexistent", tmp_path / "gone")
    paths, issues = discovery.walk(str(tmp_path))
    assert "keep.log" in paths and "a.log" not in paths and "x/skip/z.rs" not in paths and issues[0][1] == "dangling_link"
    assert discovery.empty_reason(0, 2, 2) == "no_indexable_extensions"
