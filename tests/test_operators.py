"""Operators on small data: expressions, walks against a plain search, the store, streams."""
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.operators import context, gate, graph, store
from tessera.streaming import debounce


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_expressions(spark):
    assert one(spark, X.normalize_path(F.lit("a//./b\\c"))) == "a/b/c"
    assert one(spark, X.normalize_path(F.lit("a/../b"))) is None and one(spark, X.normalize_path(F.lit(""))) is None
    assert one(spark, X.extension(F.lit("a/.rs"))) is None and one(spark, X.extension(F.lit("a/B.RS"))) == "rs"
    assert one(spark, X.is_within(F.lit("a/bc"), F.lit("a/b"))) is False
    assert one(spark, X.ascii_lower(F.lit("ÄB"))) == "Äb"
    assert one(spark, X.token_cost(F.lit("héllo"))) == 2
    assert one(spark, X.unresolved_reason(F.lit(".foo."))) == "no_candidate"
    assert one(spark, X.kind_ord(F.lit("file"))) == 4
    assert one(spark, X.hundredths(F.lit(1), F.lit(3))) == 3333 and one(spark, X.hundredths(F.lit(2), F.lit(3))) == 6667
    assert one(spark, X.classify(F.lit("src/a.rs"), F.lit("// Code generated by x"))) == "generated"
    assert X.fnv1a64("") == "fnv1a64:cbf29ce484222325" and X.parse_language("Golang") == "go"
    assert one(spark, X.byte_slice("'héllo'", 1, 3)) == "é"


def plain_walk(edges, target, depth):
    into = {}
    for s, d in edges:
        into.setdefault(d, []).append(s)
    seen, queue = {target: 0}, deque([target])
    while queue:
        n = queue.popleft()
        if seen[n] < depth:
            for s in into.get(n, []):
                if s not in seen:
                    seen[s] = seen[n] + 1
                    queue.append(s)
    return {k: v for k, v in seen.items() if k != target}


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_against_plain_search(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(150)]
    rows = [(s, d, "calls", "resolved", "same_file", d, s, k) for k, (s, d) in enumerate(pairs)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, state string, ev_class string, target_name string, source_path string, start_byte int")
    w = graph.dependents(edges, "n05", 3, max_edges=None, max_visited=None)
    assert {x["id"]: x["distance"] for x in w.steps.collect()} == plain_walk(pairs, "n05", 3)
    capped = graph.dependents(edges, "n05", 3, max_edges=1, max_visited=2)
    assert capped.bounded and capped.visited <= 2


def relation(src, dst, name, state="resolved", kind="calls", at=0):
    row = dict.fromkeys(c.split()[0] for c in V.RELATION_SCHEMA.split(", "))
    return row | {"kind": kind, "source_path": src, "source_kind": "function", "source_qualified_name": "f", "source_ordinal": 0, "target_name": name, "start_byte": at, "end_byte": at + 1, "start_line": 1,
                  "start_column": 1, "end_line": 1, "end_column": 2, "resolution_state": state, **({"target_path": dst, "target_kind": "function", "target_qualified_name": "f", "target_ordinal": 0, "ev_class": "same_file"} if dst else {})}


def entity(path):
    row = dict.fromkeys(c.split()[0] for c in V.ENTITY_SCHEMA.split(", "))
    return row | {"path": path, "kind": "function", "kind_ord": 5, "qualified_name": "f", "entity_ordinal": 0, "name": "f", "is_test": False}


def table(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_store(spark, tmp_path):
    s = store.GraphStore.open(spark, str(tmp_path / "i"), "r1")
    e = table(spark, [entity(p) for p in ("a/x.rs", "a/y.rs", "ab/z.rs")], V.ENTITY_SCHEMA)
    s.apply_update(e, table(spark, [relation("ab/z.rs", "a/x.rs", "f"), relation("a/x.rs", "a/y.rs", "f"), relation("ab/z.rs", None, "g", "unresolved", at=9)], V.RELATION_SCHEMA))
    assert s.generation == 1 and s.table("relation").count() == 3
    with pytest.raises(store.StoreError):
        s.apply_update(relations=table(spark, [relation("nowhere.rs", None, "g", "unresolved")], V.RELATION_SCHEMA))
    assert s.generation == 1
    other = store.GraphStore.open(spark, str(tmp_path / "i"), "r1")
    assert s.remove("a", subtree=True) == 2 and other.is_stale()
    left = {(r["target_name"], r["resolution_state"], r["target_path"]) for r in s.table("relation").collect()}
    assert left == {("f", "unresolved", None), ("g", "unresolved", None)}
    assert [r for r in s.verify().collect() if r["violations"]] == []
    s.vacuum()
    with pytest.raises(store.StoreError):
        store.GraphStore.open(spark, str(tmp_path / "i"), "r2")


def test_expectations_and_scores(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# labels\nsymbol | a.rs | function | f\nfloor | calls | 5000\n")
    got = gate.expectations(spark, str(p)).collect()
    assert [(r["line"], r["keyword"], r["f"]) for r in got] == [(2, "symbol", ["a.rs", "function", "f"]), (3, "floor", ["calls", "5000"])]
    p.write_text("nonsense | x\n")
    with pytest.raises(ValueError):
        gate.expectations(spark, str(p))
    bag = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    m = gate.bag_match(bag("a", "a", "b"), bag("a", "c"))
    assert m.first().asDict() == {"hits": 1, "labelled": 3, "found": 2}


def test_report_fits_its_reserve():
    big = context.report_text(2**60, 2**60, "insufficient", {("unit", r): 2**50 for r in context.UNIT_PHRASES} | {("edge", r): 2**50 for r in context.EDGE_PHRASES})
    assert context.tokens(big) <= context.report_reserve()


def test_stream_debounce_and_watch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("r", f"p{k % 3}", f"2024-01-01 00:00:00.{k * 10:03}") for k in range(10)] + [("r", "q", "2024-01-01 00:00:09")]
    spark.createDataFrame(rows, "root string, path string, ts string").select("root", "path", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(src))
    changes = spark.readStream.schema("root string, path string, ts timestamp").parquet(str(src))
    q = debounce.debounce_stream(changes, 200).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = spark.sql("select * from batches order by first").collect()
            if len(got) >= 1:
                break
    finally:
        q.stop()
    assert got[0]["paths"] == ["p0", "p1", "p2"] and got[0]["events"] == 10
    seen = []
    w = debounce.Watch(seen.append, lambda p: "reindex" if p != "q" else "ignored")
    w.start(changes, str(tmp_path / "c2"), once=True).awaitTermination(120)
    assert seen == [["p0", "p1", "p2"]] and w.skipped == {"ignored": 1} and w.superseded == 7


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """Driver tables of one nation: 300 methods ``run`` in a file, and 200 calls of that name in it."""
    d = tmp_path_factory.mktemp("one_file")
    for name, n, columns in (("nation", 1, "id AS n_nationkey"), ("customer", 20, "id AS c_custkey, 0L AS c_nationkey"), ("supplier", 300, "id AS s_suppkey, 0L AS s_nationkey"),
                             ("orders", 1400, "id AS o_orderkey, id % 20 AS o_custkey")):
        spark.range(n).selectExpr(*columns.split(", ")).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["doctor_after_resolution", "resolver_candidates", "resolver_ladder", "unresolved_reasons"])
def test_names_of_a_file_are_counted_before_relations_meet_them(spark, one_file, monkeypatch, name):
    import duckdb

    from tessera import runtime
    from tessera.operators import resolve
    from tessera.plans import registry

    stored = []

    def watch(real):
        def cut(df):
            out = real(df)
            stored.append(out.count())
            return out

        return cut

    for cut in ("checkpoint", "spool"):
        if hasattr(resolve, cut):
            monkeypatch.setattr(resolve, cut, watch(getattr(runtime, cut)))
    df = registry.QUERIES[name](spark, one_file)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders"):
        c.execute(f"create view {t} as select * from '{one_file}/{t}.parquet/*.parquet'")
    r = c.execute(registry.ORACLES[name])
    columns = [x[0] for x in r.description]
    assert got == sorted(map(repr, (tuple(x[columns.index(k)] for k in sorted(columns)) for x in r.fetchall())))
    # every call of ``run`` with every ``run`` would be 60,000 rows
    assert max(stored) <= 1400


def test_candidates_carry_columns_of_their_relation(spark, one_file):
    from tessera.operators import resolve
    from tessera.plans import engine

    entities, relations = engine._code(spark, one_file)
    _, found = resolve.resolve(entities, relations.unionByName(relations), carry=("start_byte", "target_name"))
    rows = found.collect()
    ids = {r["relation_id"]: r["start_byte"] for r in relations.select(F.xxhash64(*V.RELATION_KEY).alias("relation_id"), "start_byte").collect()}
    assert len(rows) == 200 * V.MAX_CANDIDATES and {r["target_name"] for r in rows} == {"run"}
    assert all(ids[r["relation_id"]] == r["start_byte"] for r in rows)
    names = [r["qualified_name"] for r in sorted(rows, key=lambda r: (r["relation_id"], r["ordinal"]))][:32]
    assert names == sorted(f"s{k}.run" for k in range(300))[:32]


def test_decisions_store_each_relation_once_with_what_is_taken(spark, one_file, monkeypatch):
    from tessera import runtime
    from tessera.operators import resolve
    from tessera.plans import engine, registry

    stored = []

    def watch(df):
        out = runtime.spool(df)
        stored.append((set(df.columns), out.count()))
        return out

    monkeypatch.setattr(resolve, "spool", watch)
    got = {r["reason"]: r["n"] for r in registry.QUERIES["unresolved_reasons"](spark, one_file).collect()}
    assert got == {"local_binding": 200, "no_candidate": 200, "unsupported": 200}
    tables = [(c, n) for c, n in stored if "rel" in c]
    assert sum(n for _, n in tables) == 1400 and not any("start_byte" in c for c, _ in tables)
    # a repeated key is one relation; rows decided before come back as they are, in the columns taken
    entities, relations = engine._code(spark, one_file)
    old = relations.where("start_byte % 7 = 5").withColumn("resolution_state", F.lit("unresolved")).withColumn("reason", F.lit("external"))
    rows = resolve.decisions(entities, relations.where("start_byte % 7 <> 5").unionByName(relations.where("start_byte % 7 = 3")).unionByName(old), take=("resolution_state", "reason"))
    assert rows.columns == ["resolution_state", "reason"]
    got = {r["reason"]: r["count"] for r in rows.where("resolution_state = 'unresolved'").groupBy("reason").count().collect()}
    assert got == {"local_binding": 200, "external": 200, "unsupported": 200}
