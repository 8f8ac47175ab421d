"""Registered queries and their SQL, gathered from the operator modules.

Each query runs an operator of the library over whole driver tables. Integers are BIGINT on
both sides, and every computed column has the same alias on both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.operators import context, gate, graph, resolve, stats, store
from tessera.plans import tabular as T
from tessera.runtime import read_table
from tessera.streaming import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])


NODE = "nation/7"
GRAPH = f"{T.ENTITIES_SQL}, {T.EDGES_SQL}"
DEP = "kind NOT IN ('defines', 'contains', 'owns') AND state IN ('resolved', 'inferred') AND dst IS NOT NULL"

# --- walks -------------------------------------------------------------------------------


@query(f"""WITH {T.EDGES_SQL}, d1 AS (SELECT DISTINCT src AS id FROM edges WHERE {DEP} AND dst = '{NODE}'),
d2 AS (SELECT DISTINCT e.src AS id FROM edges e JOIN d1 ON e.dst = d1.id WHERE {DEP})
SELECT id, 1::BIGINT AS distance FROM d1 UNION ALL SELECT id, 2::BIGINT FROM d2 WHERE id NOT IN (SELECT id FROM d1) AND id <> '{NODE}'""")
def walk_dependents_d2(spark, sf_dir):
    w = graph.dependents(T.edges(spark, sf_dir), NODE, 2, max_edges=None, max_visited=None)
    return _long(w.steps.select("id", "distance"), "distance")


@query(f"""WITH RECURSIVE {T.EDGES_SQL}, r AS (SELECT '{NODE}' AS id, 0 AS d UNION SELECT e.src, r.d + 1 FROM edges e JOIN r ON e.dst = r.id WHERE r.d < 3 AND e.{DEP.replace(' AND ', ' AND e.')})
SELECT id, min(d)::BIGINT AS distance FROM r WHERE id <> '{NODE}' GROUP BY id""")
def walk_dependents_d3(spark, sf_dir):
    w = graph.dependents(T.edges(spark, sf_dir), NODE, 3, max_edges=None, max_visited=None)
    return _long(w.steps.select("id", "distance"), "distance")


@query(f"WITH {T.EDGES_SQL} SELECT DISTINCT dst AS id, 1::BIGINT AS distance FROM edges WHERE src = 'orders/1' AND kind = 'calls'")
def walk_callees_kind(spark, sf_dir):
    w = graph.callees(T.edges(spark, sf_dir), "orders/1", kind="calls", max_edges=None, max_visited=None)
    return _long(w.steps.select("id", "distance"), "distance")


@query(f"WITH {T.EDGES_SQL} SELECT DISTINCT src AS id FROM edges WHERE dst = 'supplier/5' AND state IN ('resolved', 'inferred')")
def callers_one_hop(spark, sf_dir):
    return graph.one_hop(T.edges(spark, sf_dir), "supplier/5", "in")


@query(f"WITH {T.EDGES_SQL} SELECT DISTINCT dst AS id FROM edges WHERE src = 'orders/3' AND state IN ('resolved', 'inferred')")
def callees_one_hop(spark, sf_dir):
    return graph.one_hop(T.edges(spark, sf_dir), "orders/3", "out")


@query(f"""WITH {T.EDGES_SQL}, h1 AS (SELECT * FROM edges WHERE dst = '{NODE}'), f1 AS (SELECT * FROM h1 WHERE {DEP}), n1 AS (SELECT DISTINCT src AS id FROM f1),
h2 AS (SELECT e.* FROM edges e JOIN n1 ON e.dst = n1.id), f2 AS (SELECT * FROM h2 WHERE {DEP}), n2 AS (SELECT DISTINCT src AS id FROM f2 WHERE src <> '{NODE}' AND src NOT IN (SELECT id FROM n1))
SELECT ((SELECT count(*) FROM h1) + (SELECT count(*) FROM h2))::BIGINT AS inspected, (1 + (SELECT count(*) FROM n1))::BIGINT AS visited,
((SELECT count(*) FROM f1) - (SELECT count(*) FROM n1) + (SELECT count(*) FROM f2) - (SELECT count(*) FROM n2))::BIGINT AS closed,
((SELECT count(*) FROM f1) - (SELECT count(*) FROM n1) + (SELECT count(*) FROM f2) - (SELECT count(*) FROM n2) - (SELECT count(*) FROM f2 WHERE src = '{NODE}'))::BIGINT AS revisits,
2::BIGINT AS max_distance""")
def walk_counters(spark, sf_dir):
    w = graph.dependents(T.edges(spark, sf_dir), NODE, 2, max_edges=None, max_visited=None)
    return _long(w.summary(spark).select("inspected", "visited", "closed", "revisits", "max_distance"), "max_distance")


@query(f"""WITH {T.EDGES_SQL}, h AS (SELECT *, row_number() OVER (ORDER BY kind, source_path, start_byte, src, dst) AS rn FROM edges WHERE dst = '{NODE}')
SELECT DISTINCT src AS id, 1::BIGINT AS distance FROM h WHERE rn <= 64 AND {DEP}""")
def walk_edge_cap(spark, sf_dir):
    w = graph.callers(T.edges(spark, sf_dir), NODE)
    return _long(w.steps.select("id", "distance"), "distance")


@query(f"WITH {T.EDGES_SQL} SELECT dst AS id, max(state) AS state FROM edges WHERE src = 'region/2' AND kind IN ('defines', 'contains', 'owns') GROUP BY dst")
def container_members(spark, sf_dir):
    return graph.membership(T.edges(spark, sf_dir), T.entities(spark, sf_dir), "region/2")


@query(f"""WITH {T.EDGES_SQL}, m AS (SELECT DISTINCT dst AS id FROM edges WHERE src = 'region/2' AND kind = 'contains'),
d2 AS (SELECT DISTINCT e.src AS id FROM edges e JOIN m ON e.dst = m.id WHERE {DEP})
SELECT id, 1::BIGINT AS distance FROM m UNION ALL SELECT id, 2::BIGINT FROM d2 WHERE id NOT IN (SELECT id FROM m)""")
def walk_container(spark, sf_dir):
    e = T.edges(spark, sf_dir)
    w = graph.dependents(e, "region/2", 2, members=graph.membership(e, T.entities(spark, sf_dir), "region/2"), max_edges=None, max_visited=None)
    return _long(w.steps.select("id", "distance"), "distance")


@query(f"""WITH {T.EDGES_SQL} SELECT 'in' AS side, src AS neighbour, kind, state, ({T.STRENGTH_SQL})::BIGINT AS strength FROM edges WHERE dst = 'supplier/5'
UNION ALL SELECT 'out', dst, kind, state, ({T.STRENGTH_SQL})::BIGINT FROM edges WHERE src = 'supplier/5'""")
def explain_edges(spark, sf_dir):
    return _long(graph.explain(T.edges(spark, sf_dir), "supplier/5", None).select("side", "neighbour", "kind", "state", "strength"), "strength")


@query(f"""WITH {T.EDGES_SQL}, r AS (SELECT *, {T.STRENGTH_SQL} AS w FROM edges WHERE state IN ('resolved', 'inferred') AND dst IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, kind, source_path, src, target_name, start_byte) AS rn, count(*) OVER (PARTITION BY dst) AS n FROM r)
SELECT dst AS id, src AS via, kind, w::BIGINT AS strength, n::BIGINT AS alternatives FROM b WHERE rn = 1""")
def chain_top1(spark, sf_dir):
    return _long(graph.strongest_incoming(T.edges(spark, sf_dir)), "strength", "alternatives")


@query(f"""WITH {T.EDGES_SQL}, r AS (SELECT *, {T.STRENGTH_SQL} AS w FROM edges),
b AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, kind, source_path, src, target_name, start_byte) AS rn, count(*) OVER (PARTITION BY dst) AS n FROM r),
s1 AS (SELECT 1 AS d, src, kind, w, n FROM b WHERE dst = 'supplier/5' AND rn = 1), s2 AS (SELECT 2 AS d, b.src, b.kind, b.w, b.n FROM b JOIN s1 ON b.dst = s1.src WHERE rn = 1)
SELECT d::BIGINT AS distance, src AS id, kind, w::BIGINT AS strength, n::BIGINT AS alternatives FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)""")
def provenance_chain(spark, sf_dir):
    steps, _ = graph.chain(T.edges(spark, sf_dir), "supplier/5", 2)
    return _long(steps, "distance", "strength", "alternatives")


# --- lookups -----------------------------------------------------------------------------


@query(f"WITH {T.ENTITIES_SQL} SELECT * FROM entities WHERE path = 'customer/42' AND kind = 'customer' AND qualified_name = 'customer.42'")
def entity_point_lookup(spark, sf_dir):
    return store.point(T.entities(spark, sf_dir), "customer/42", "customer", "customer.42")


@query(f"WITH {T.ENTITIES_SQL} SELECT id, kind, qualified_name FROM entities WHERE (kind, qualified_name, id) > ('customer', 'customer.20', 'customer/20') ORDER BY kind, qualified_name, id LIMIT 50")
def entity_keyset_page(spark, sf_dir):
    return store.keyset_page(T.entities(spark, sf_dir), ["kind", "qualified_name", "id"], ("customer", "customer.20", "customer/20"), 50).select("id", "kind", "qualified_name")


@query("SELECT page_id, url FROM pages WHERE split_part(url, '/', 3) = 'x' OR (regexp_replace(url, '^https?://', '') >= 'a/' AND regexp_replace(url, '^https?://', '') < 'z0')")
def subtree_range(spark, sf_dir):
    rows = read_table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", "^https?://", "").alias("p"))
    return rows.where((F.col("p") >= "a/") & (F.col("p") < "z0")).select("page_id", "url")


@query(f"WITH {T.ENTITIES_SQL} SELECT id, kind, qualified_name, name FROM entities WHERE path = 'nation/3' OR qualified_name = 'nation.3'")
def name_lookup_precedence(spark, sf_dir):
    found = context.resolve_targets(T.entities(spark, sf_dir), "nation/3", file_kind="nation")
    return found.candidates.select("id", "kind", "qualified_name", "name")


@query(f"WITH {T.ENTITIES_SQL} SELECT id, name FROM entities WHERE name = (SELECT min(p_name) FROM part)")
def entities_by_name(spark, sf_dir):
    low = read_table(spark, sf_dir, "part").agg(F.min("p_name").alias("n"))
    return T.entities(spark, sf_dir).join(F.broadcast(low), F.col("name") == F.col("n"), "left_semi").select("id", "name")


@query(f"WITH {T.ENTITIES_SQL} SELECT DISTINCT path FROM entities")
def indexed_paths(spark, sf_dir):
    return store.paths(T.entities(spark, sf_dir))


@query(f"WITH {T.EDGES_SQL} SELECT src, dst, kind FROM edges WHERE state = 'inferred'")
def relations_in_state(spark, sf_dir):
    return store.in_state(T.edges(spark, sf_dir), "inferred").select("src", "dst", "kind")


@query(f"WITH {T.EDGES_SQL} SELECT src, kind, target_name FROM edges WHERE dst = '{NODE}' ORDER BY kind, source_path, start_byte, src, dst LIMIT 20")
def adjacency_top20(spark, sf_dir):
    return graph.adjacency(T.edges(spark, sf_dir), NODE, "in", None, 20).select("src", "kind", "target_name")


# --- expressions -------------------------------------------------------------------------


@query("SELECT doc_id, ((strlen(text) + 2) // 3)::BIGINT AS tokens, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def token_cost(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.token_cost("text").alias("tokens"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"),
                    (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


_DOC_PATH = "CASE doc_id % 6 WHEN 0 THEN 'src/vendor/a.rs' WHEN 1 THEN 'gen/x.py' WHEN 2 THEN 'lib/tests/b.go' WHEN 3 THEN 'lib/test_c.py' WHEN 4 THEN 'web/app.min.js' ELSE 'src/main.rs' END"


# the header's 2048 bytes are looked through as 4096 hex digits, at even places only
_MARKS = "|".join(m.encode().hex().upper() for m in V.GENERATED_MARKERS)


@query(f"""WITH d AS (SELECT doc_id, substr(hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), 1, {2 * V.HEADER_BYTES}) AS head FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'vendored' WHEN doc_id % 6 = 1 OR doc_id % 6 = 4 THEN 'generated' WHEN regexp_matches(head, '^(?:..)*?(?:{_MARKS})') THEN 'generated'
WHEN doc_id % 6 IN (2, 3) THEN 'test' ELSE 'source' END AS classification FROM d""")
def classify_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").withColumn("path", F.expr(_DOC_PATH))
    return d.select("doc_id", X.classify("path", "text").alias("classification"))


@query("SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.')), '/') AS path, len(list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.')))::BIGINT AS depth FROM pages WHERE NOT list_contains(string_split(url, '/'), '..')")
def path_normalize_urls(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", X.normalize_path("url").alias("path")).where(F.col("path").isNotNull())
    return p.withColumn("depth", X.depth("path").cast("long"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b.RS' WHEN 1 THEN 'a/c.py' WHEN 2 THEN 'x.tsx' WHEN 3 THEN 'a.b/Makefile' ELSE 'k/.hidden' END AS path FROM pages)
SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'tsx' END AS ext, CASE page_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' END AS language FROM p""")
def language_by_extension(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").withColumn("path", F.expr("CASE page_id % 5 WHEN 0 THEN 'a/b.RS' WHEN 1 THEN 'a/c.py' WHEN 2 THEN 'x.tsx' WHEN 3 THEN 'a.b/Makefile' ELSE 'k/.hidden' END"))
    return p.select("page_id", "path", X.extension("path").alias("ext"), X.language_of("path").alias("language"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_orderkey % 50 <= l_partkey % 60 AND l_partkey % 60 + 5 <= l_orderkey % 50 + 20) AS inside,
(l_orderkey % 50 < l_partkey % 60 + 5 AND l_partkey % 60 < l_orderkey % 50 + 20) AS overlaps, least(l_orderkey % 50, l_partkey % 60)::BIGINT AS u0, greatest(l_orderkey % 50 + 20, l_partkey % 60 + 5)::BIGINT AS u1 FROM lineitem""")
def span_operations(spark, sf_dir):
    t = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber AS BIGINT) AS l_linenumber", "l_orderkey % 50 AS a0", "l_orderkey % 50 + 20 AS a1", "l_partkey % 60 AS b0", "l_partkey % 60 + 5 AS b1")
    u0, u1 = X.span_union("a0", "a1", "b0", "b1")
    return t.select("l_orderkey", "l_linenumber", X.span_contains("a0", "a1", "b0", "b1").alias("inside"), X.span_overlaps("a0", "a1", "b0", "b1").alias("overlaps"), u0.alias("u0"), u1.alias("u1"))


# --- aggregations and checks -------------------------------------------------------------


@query(f"""WITH {T.EDGES_SQL}, s(state) AS (VALUES ('resolved'), ('pending'), ('ambiguous'), ('unresolved'), ('inferred'))
SELECT s.state, count(e.src)::BIGINT AS n FROM s LEFT JOIN edges e ON e.state = s.state GROUP BY s.state""")
def state_counts_zero_filled(spark, sf_dir):
    return stats.state_counts(T.edges(spark, sf_dir))


@query(f"WITH {T.EDGES_SQL} SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}')::BIGINT AS \"{s}\"" for s in V.STATES) + " FROM edges GROUP BY kind")
def kind_state_crosstab(spark, sf_dir):
    return stats.crosstab(T.edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT kind, count(*)::BIGINT AS n FROM entities GROUP BY kind")
def entity_counts_by_kind(spark, sf_dir):
    return T.entities(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT src, dst, kind FROM edges e WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entities n WHERE n.id = e.dst AND n.kind <> 'part')")
def orphan_anti_join(spark, sf_dir):
    return stats.orphans(T.edges(spark, sf_dir), T.entities(spark, sf_dir).where("kind <> 'part'")).select("src", "dst", "kind")


@query(f"""WITH {GRAPH} SELECT (SELECT count(*) FROM entities)::BIGINT AS entities, count(*)::BIGINT AS relations, count(*) FILTER (WHERE state = 'resolved')::BIGINT AS resolved,
count(*) FILTER (WHERE state = 'inferred')::BIGINT AS inferred, (SELECT count(*) FROM edges e LEFT JOIN entities n ON n.id = e.dst WHERE n.id IS NULL)::BIGINT AS orphans FROM edges""")
def store_stats(spark, sf_dir):
    return stats.store_stats(T.entities(spark, sf_dir), T.edges(spark, sf_dir)).select("entities", "relations", "resolved", "inferred", "orphans")


@query(f"WITH {T.EDGES_SQL}, c AS (SELECT src, count(*) AS n FROM edges GROUP BY src) SELECT max(n)::BIGINT AS widest, count(*)::BIGINT AS sources FROM c")
def widest_source(spark, sf_dir):
    return stats.widest(T.edges(spark, sf_dir))


@query(f"WITH {T.EDGES_SQL} SELECT dst AS id, count(DISTINCT src)::BIGINT AS definers FROM edges WHERE kind = 'contains' GROUP BY dst HAVING count(DISTINCT src) = 1")
def definer_uniqueness(spark, sf_dir):
    return stats.definers(T.edges(spark, sf_dir).where("kind = 'contains'")).where("definers = 1")


_FIND = f"""WITH {GRAPH}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE state = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE state = 'pending') AS pending FROM edges),
o AS (SELECT count(*) AS orphans FROM edges e LEFT JOIN entities n ON n.id = e.dst WHERE n.id IS NULL)
SELECT 'orphan_edges' AS "check", CASE WHEN orphans > 0 THEN 'fail' ELSE 'ok' END AS severity, orphans::BIGINT AS n FROM o
UNION ALL SELECT 'pending_work', CASE WHEN pending > 0 THEN 'notice' ELSE 'ok' END, pending::BIGINT FROM s
UNION ALL SELECT 'ambiguity', CASE WHEN ambiguous * 100 // greatest(total, 1) >= 50 THEN 'warn' WHEN ambiguous > 0 THEN 'notice' ELSE 'ok' END, ambiguous::BIGINT FROM s"""


@query(_FIND)
def doctor_findings(spark, sf_dir):
    return stats.graph_findings(T.entities(spark, sf_dir), T.edges(spark, sf_dir)).select("check", "severity", "n")


@query("""WITH r AS (SELECT event_type AS reason, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT reason, event_id AS sample, n::BIGINT AS n FROM r WHERE rn <= 5""")
def samples_per_reason(spark, sf_dir):
    return stats.samples(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), F.col("event_id").alias("sample")), 5)


# --- context packs -----------------------------------------------------------------------

_UNITS_SQL = f"""u AS (SELECT doc_id AS id, CASE WHEN doc_id = 0 THEN 0 ELSE 1 + doc_id % 5 END AS section, (strlen(text) + 2) // 3 AS cost, row_number() OVER (ORDER BY CASE WHEN doc_id = 0 THEN 0 ELSE 1 + doc_id % 5 END, doc_id) AS rank FROM documents),
r AS (SELECT * FROM u WHERE rank <= {V.MAX_UNITS}), p AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS used FROM r)"""


def _units(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id = 0 THEN 0 ELSE 1 + doc_id % 5 END").alias("section"), X.token_cost("text").alias("cost"))


@query(f"WITH {_UNITS_SQL} SELECT id, rank::BIGINT AS rank, cost::BIGINT AS cost FROM p WHERE used <= 20000")
def context_pack_prefix(spark, sf_dir):
    packed = context.pack_units(context.rank_units(_units(spark, sf_dir), ["section", "id"]), 20000)
    return _long(packed.where("included").select("id", "rank", "cost"), "rank", "cost")


@query(f"WITH {_UNITS_SQL} SELECT CASE WHEN cost > 20000 THEN 'exceeds_budget' ELSE 'budget_exhausted' END AS reason, count(*)::BIGINT AS n, sum(cost)::BIGINT AS cost FROM p WHERE used > 20000 GROUP BY 1")
def context_omissions(spark, sf_dir):
    packed = context.pack_units(context.rank_units(_units(spark, sf_dir), ["section", "id"]), 20000)
    return packed.where(~F.col("included")).groupBy("reason").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query(f"WITH {_UNITS_SQL} SELECT id, section::BIGINT AS section, rank::BIGINT AS rank FROM r")
def rank_top256(spark, sf_dir):
    return _long(context.rank_units(_units(spark, sf_dir), ["section", "id"]).select("id", "section", "rank"), "section", "rank")


@query(f"""WITH {GRAPH}, o AS (SELECT CASE WHEN src = 'supplier/5' THEN dst ELSE src END AS id, CASE WHEN src = 'supplier/5' AND kind = 'calls' THEN 3 WHEN src = 'supplier/5' THEN 5 ELSE 4 END AS section
FROM edges WHERE {DEP} AND (src = 'supplier/5' OR dst = 'supplier/5')), a AS (SELECT 'supplier/5' AS id, 0 AS section UNION ALL SELECT * FROM o)
SELECT id, min(section)::BIGINT AS section FROM a GROUP BY id""")
def context_neighbourhood(spark, sf_dir):
    n = context.neighbourhood(T.edges(spark, sf_dir), T.entities(spark, sf_dir), "supplier/5", "supplier", limit=None)
    return _long(n.select("id", "section"), "section")


# --- resolution --------------------------------------------------------------------------

_REFS_SQL = """refs AS (SELECT o_orderkey AS rel, CASE o_orderkey % 4 WHEN 0 THEN (SELECT c_name FROM customer WHERE c_custkey = o_custkey) WHEN 1 THEN (SELECT p_name FROM part WHERE p_partkey = 1 + o_orderkey % 100)
WHEN 2 THEN 'absent' || o_orderkey ELSE 'std::x' || o_orderkey END AS name FROM orders)"""


def _refs(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(p, p["p_partkey"] == 1 + o["o_orderkey"] % 100, "left")
    return rows.select(F.col("o_orderkey").alias("rel"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN p_name WHEN 2 THEN concat('absent', o_orderkey) ELSE concat('std::x', o_orderkey) END").alias("name"))


@query(f"""WITH {T.ENTITIES_SQL}, {_REFS_SQL}, c AS (SELECT rel, refs.name, count(e.id) AS n, min(e.id) AS one_id FROM refs LEFT JOIN entities e ON e.name = refs.name GROUP BY rel, refs.name)
SELECT rel, CASE WHEN n = 1 THEN 'inferred' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, CASE WHEN n = 1 THEN one_id END AS target, CASE WHEN n = 0 THEN CASE WHEN contains(name, '::') THEN 'external' ELSE 'no_candidate' END END AS reason FROM c""")
def resolve_unique_ambiguous_none(spark, sf_dir):
    return resolve.unique_name(_refs(spark, sf_dir), T.entities(spark, sf_dir)).select("rel", "state", "target", "reason")


@query(f"""WITH {T.ENTITIES_SQL}, {_REFS_SQL}, c AS (SELECT rel, e.id, row_number() OVER (PARTITION BY rel ORDER BY e.id) AS rn, count(*) OVER (PARTITION BY rel) AS n FROM refs JOIN entities e ON e.name = refs.name)
SELECT rel, id, rn::BIGINT AS ordinal FROM c WHERE n > 1 AND rn <= 32""")
def candidate_cap32(spark, sf_dir):
    return _long(resolve.candidate_lists(_refs(spark, sf_dir), T.entities(spark, sf_dir)).select("rel", "id", "ordinal"), "ordinal")


_CLAIMS_SQL = "claims AS (SELECT l_orderkey AS rel, l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'same_file' WHEN 1 THEN 'import_binding' WHEN 2 THEN 'unique_name' ELSE 'receiver_type' END AS ev_class FROM lineitem)"


@query(f"""WITH {_CLAIMS_SQL}, s AS (SELECT *, {T.STRENGTH_SQL} AS w FROM claims), m AS (SELECT rel, max(w) AS w FROM s GROUP BY rel), t AS (SELECT DISTINCT s.rel, s.id, s.w FROM s JOIN m USING (rel, w))
SELECT rel, CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN max(w) = 40 THEN 'inferred' ELSE 'resolved' END AS state, CASE WHEN count(*) = 1 THEN min(id) END AS target, max(w)::BIGINT AS strength FROM t GROUP BY rel""")
def resolve_evidence_top1(spark, sf_dir):
    c = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rel"), F.col("l_partkey").alias("id"), F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'same_file' WHEN 1 THEN 'import_binding' WHEN 2 THEN 'unique_name' ELSE 'receiver_type' END").alias("ev_class"))
    return _long(resolve.decide(c).select("rel", "state", "target", "strength"), "strength")


@query("SELECT CASE WHEN contains(url, '::') OR contains(url, '/') THEN 'external' ELSE 'no_candidate' END AS reason, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def unresolved_reason_histogram(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(X.unresolved_reason("url").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# --- modules -----------------------------------------------------------------------------

_PATHS = "concat('pkg', page_id % 7, CASE page_id % 4 WHEN 0 THEN '/src/lib.rs' WHEN 1 THEN concat('/src/m', page_id % 11, '.rs') WHEN 2 THEN concat('/src/m', page_id % 11, '/mod.rs') ELSE '/src/main.rs' END)"


@query(f"""WITH p AS (SELECT DISTINCT {_PATHS} AS path FROM pages)
SELECT path, split_part(path, '/', 1) AS package, CASE WHEN ends_with(path, '/lib.rs') OR ends_with(path, '/main.rs') THEN '' ELSE regexp_replace(regexp_replace(replace(path, split_part(path, '/', 1) || '/src/', ''), '\\.rs$', ''), '/mod$', '') END AS module FROM p""")
def module_location(spark, sf_dir):
    from tessera.operators import modules

    paths = read_table(spark, sf_dir, "pages").select(F.expr(_PATHS).alias("path")).distinct()
    return modules.locate(paths).select("path", "package", "module")


@query(f"WITH p AS (SELECT DISTINCT {_PATHS} AS path FROM pages) SELECT DISTINCT split_part(path, '/', 1) AS root FROM p WHERE ends_with(path, '/lib.rs') OR ends_with(path, '/main.rs')")
def package_roots(spark, sf_dir):
    from tessera.operators import modules

    return modules.package_roots(read_table(spark, sf_dir, "pages").select(F.expr(_PATHS).alias("path")).distinct())


# --- writes ------------------------------------------------------------------------------


@query("""WITH d AS (SELECT c_custkey, c_name || '!' AS c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, c_name FROM customer WHERE c_custkey % 10 = 0)
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM d) UNION ALL SELECT * FROM d""")
def upsert_merge(spark, sf_dir):
    base = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    delta = base.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name")).unionByName(base.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), "c_name"))
    return store.upsert(base, delta, ["c_custkey"])


@query(f"WITH {T.EDGES_SQL} SELECT src, dst, kind FROM edges WHERE src <> '{NODE}' AND NOT starts_with(src, 'customer/')")
def remove_cascade(spark, sf_dir):
    return store.without_scope(T.edges(spark, sf_dir), "source_path", [("subtree", "customer"), ("file", NODE)]).select("src", "dst", "kind")


@query(f"WITH {T.EDGES_SQL} SELECT src, kind, CASE WHEN starts_with(dst, 'customer/') THEN NULL ELSE dst END AS dst, CASE WHEN starts_with(dst, 'customer/') THEN 'unresolved' ELSE state END AS state FROM edges")
def demote_incoming(spark, sf_dir):
    removed = T.entities(spark, sf_dir).where("kind = 'customer'").select("id")
    return store.demote(T.edges(spark, sf_dir), removed).select("src", "kind", "dst", "state")


_SNAP = "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0"
_SNAP2 = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 9 <> 0"


@query(f"WITH a AS ({_SNAP}), b AS ({_SNAP2}) SELECT 'left' AS side, k, v FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', k, v FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def snapshot_symdiff(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 10 <> 0").selectExpr("o_orderkey AS k", "o_orderstatus AS v")
    b = o.where("o_orderkey % 9 <> 0").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v")
    return store.symmetric_difference(a, b)


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 9 = 0")
def stale_paths(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return store.stale(o.where("o_orderkey % 10 <> 0").selectExpr("o_orderkey AS k"), o.where("o_orderkey % 9 <> 0").selectExpr("o_orderkey AS k"))


# --- measurement -------------------------------------------------------------------------

_TRUTH = "SELECT l_partkey % 50 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A'"
_FOUND = "SELECT l_partkey % 50 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'"


@query(f"""WITH t AS (SELECT k, n, count(*) AS c FROM ({_TRUTH}) GROUP BY 1, 2), f AS (SELECT k, n, count(*) AS c FROM ({_FOUND}) GROUP BY 1, 2)
SELECT (SELECT sum(least(t.c, f.c)) FROM t JOIN f USING (k, n))::BIGINT AS hits, (SELECT sum(c) FROM t)::BIGINT AS labelled, (SELECT sum(c) FROM f)::BIGINT AS found""")
def multiset_precision_recall(spark, sf_dir):
    t = read_table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 50 AS k", "l_linenumber AS n", "l_returnflag")
    return gate.bag_match(t.where("l_returnflag = 'A'").select("k", "n"), t.where("l_returnflag = 'R'").select("k", "n"))


@query("""WITH s AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) AS d FROM lineitem GROUP BY 1)
SELECT k, ((n * 20000 + d) // (2 * d))::BIGINT AS hundredths, (n * 10000 // d)::BIGINT AS truncated, n * 10000 >= 5000 * d AS meets FROM s""")
def floor_check_hundredths(spark, sf_dir):
    s = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("n"), F.count("*").alias("d"))
    return s.select("k", X.hundredths("n", "d").alias("hundredths"), F.expr("n * 10000 div d").alias("truncated"), X.meets_floor("n", "d", F.lit(5000)).alias("meets"))


_ARM = "SELECT l_orderkey AS k, l_linenumber AS n, {state} AS state, {ev} AS ev_class, {target} AS target FROM lineitem"
_OFF = _ARM.format(state="CASE WHEN l_linestatus = 'O' THEN 'unresolved' ELSE 'resolved' END", ev="CASE WHEN l_linestatus <> 'O' THEN 'same_file' END", target="CASE WHEN l_linestatus <> 'O' THEN l_partkey END")
_ON = _ARM.format(state="CASE l_returnflag WHEN 'N' THEN 'resolved' WHEN 'A' THEN 'inferred' ELSE 'unresolved' END", ev="CASE l_returnflag WHEN 'N' THEN 'import_binding' WHEN 'A' THEN 'unique_name' END", target="CASE WHEN l_returnflag <> 'R' THEN l_partkey + l_linenumber % 2 END")


@query(f"""WITH a AS ({_OFF}), b AS ({_ON}), j AS (SELECT a.state AS s0, b.state AS s1, a.target AS t0, b.target AS t1, a.ev_class AS e0, b.ev_class AS e1 FROM a JOIN b ON a.k = b.k AND a.n = b.n)
SELECT CASE WHEN s0 = s1 AND t0 IS NOT DISTINCT FROM t1 AND e0 IS NOT DISTINCT FROM e1 THEN 'unchanged' WHEN s0 <> 'resolved' AND s1 = 'resolved' THEN 'gained a proof' WHEN s0 = 'resolved' AND s1 <> 'resolved' THEN 'lost its proof'
WHEN s0 = 'resolved' AND s1 = 'resolved' THEN 'proof rerouted' WHEN s0 = 'inferred' AND s1 = 'inferred' THEN 'claim rerouted' WHEN s1 = 'inferred' THEN 'nothing gained but a claim' ELSE 'moved among the undecided' END AS bucket, count(*)::BIGINT AS n FROM j GROUP BY 1""")
def ab_transitions(spark, sf_dir):
    t = read_table(spark, sf_dir, "lineitem")
    t.createOrReplaceTempView("_tessera_lineitem")
    arm = lambda q: spark.sql(q.replace("FROM lineitem", "FROM _tessera_lineitem"))
    return gate.transitions(arm(_OFF), arm(_ON), ["k", "n"])


@query("SELECT count(*)::BIGINT AS labelled, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars < 200))::BIGINT AS violations FROM labels l WHERE l.quality = 0")
def negative_controls(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return gate.violations(labels, read_table(spark, sf_dir, "documents").where("n_chars < 200").select("doc_id"), ["doc_id"])


# --- streams -----------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, count(*)::BIGINT AS changes, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, sf_dir):
    return debounce.sessions(read_table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("""WITH e AS (SELECT DISTINCT user_id AS path FROM events ) SELECT path, CASE WHEN path % 5 = 0 THEN 'outside' WHEN path % 5 = 1 THEN 'ignored' ELSE 'reindex' END AS plan FROM e""")
def coalesce_batch(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("path"))
    return debounce.coalesce(e, outside=F.col("path") % 5 == 0, indexable=F.col("path") % 5 != 1)


from tessera.plans import engine  # noqa: E402,F401  registers the rest
