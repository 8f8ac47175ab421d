"""More registered queries: the resolver's ladder, lookups, kinds, counts, checks and measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.operators import context, extract, gate, graph, resolve, stats, store
from tessera.plans import tabular as T
from tessera.plans.registry import DEP, GRAPH, NODE, _long, query
from tessera.runtime import read_table, spool

# --- the resolver on a code graph made of the driver tables ------------------------------
# A nation is a file, its customers are functions and its suppliers structs with a method
# ``run``; an order is a call from its customer's function, of one of seven forms.

_SUP = "(SELECT count(*) FROM supplier)"
_CALLS_SQL = f"""calls AS (SELECT o_orderkey AS k, 'src/n' || c_nationkey || '.rs' AS p, 'c' || o_custkey AS me, o_orderkey % 7 AS form, o_orderkey % {_SUP} AS s FROM orders JOIN customer ON c_custkey = o_custkey),
sup AS (SELECT s_suppkey AS s, 'src/n' || s_nationkey || '.rs' AS sp FROM supplier), runs AS (SELECT sp, count(*) AS n, min('s' || s || '.run') AS one FROM sup GROUP BY sp),
j AS (SELECT calls.*, sup.sp, n, one FROM calls JOIN sup USING (s) LEFT JOIN runs ON runs.sp = calls.p)"""


def _code(spark, sf_dir):
    """(entities, relations) with the schemas of the store."""
    null = lambda t: F.lit(None).cast(t)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey")
    path = lambda k: F.concat(F.lit("src/n"), F.col(k).cast("string"), F.lit(".rs"))
    name = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    rows = n.select(path("n_nationkey").alias("path"), F.lit("file").alias("kind"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".rs")).alias("qualified_name"))
    rows = rows.unionByName(c.select(path("c_nationkey").alias("path"), F.lit("function").alias("kind"), name("c", "c_custkey").alias("qualified_name")))
    rows = rows.unionByName(s.select(path("s_nationkey").alias("path"), F.lit("struct").alias("kind"), name("s", "s_suppkey").alias("qualified_name")))
    rows = rows.unionByName(s.select(path("s_nationkey").alias("path"), F.lit("method").alias("kind"), F.concat(name("s", "s_suppkey"), F.lit(".run")).alias("qualified_name")))
    have = {"path": F.col("path"), "kind": F.col("kind"), "kind_ord": X.kind_ord("kind"), "qualified_name": F.col("qualified_name"), "entity_ordinal": F.lit(0), "name": F.when(F.col("kind") == "file", F.col("qualified_name")).otherwise(X.last_name("qualified_name"))}
    fields = [x.split() for x in V.ENTITY_SCHEMA.split(", ")]
    entities = rows.select(*[have.get(f, null(t)).cast(t).alias(f) for f, t in fields])
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    total = s.agg(F.count("*").alias("_s"))
    o = o.join(F.broadcast(total.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).withColumn("s", F.expr("concat('s', o_orderkey % _s)"))
    form = F.col("o_orderkey") % 7
    pick = lambda *values: F.coalesce(*[F.when(form == k, v) for k, v in enumerate(values) if v is not None])
    self = name("c", "o_custkey")
    have = {
        "kind": F.when(form == 6, "imports").otherwise("calls"), "source_path": path("c_nationkey"), "source_kind": F.lit("function"), "source_qualified_name": self, "source_ordinal": F.lit(0),
        "target_name": pick(self, F.col("s"), F.lit("run"), F.lit("x"), F.lit("run"), F.concat(F.lit("absent"), F.col("o_orderkey").cast("string")), F.lit("*")),
        "start_byte": F.col("o_orderkey"), "end_byte": F.col("o_orderkey"), "start_line": F.lit(1), "start_column": F.lit(1), "end_line": F.lit(1), "end_column": F.lit(1), "resolution_state": F.lit("pending"),
        "ev_class": F.when(form == 3, "local_binding").when(form == 4, "receiver_type").otherwise("name_only"), "ev_receiver": F.when(form == 4, F.col("s")),
    }
    fields = [x.split() for x in V.RELATION_SCHEMA.split(", ")]
    return entities, o.select(*[have.get(f, null(t)).cast(t).alias(f) for f, t in fields])


@query(f"""WITH {_CALLS_SQL} SELECT k, CASE form WHEN 0 THEN 'resolved' WHEN 1 THEN CASE WHEN sp = p THEN 'resolved' ELSE 'inferred' END
WHEN 2 THEN CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 OR {_SUP} > 1 THEN 'ambiguous' ELSE 'inferred' END WHEN 4 THEN CASE WHEN sp = p THEN 'resolved' ELSE 'unresolved' END ELSE 'unresolved' END AS state,
CASE form WHEN 0 THEN me WHEN 1 THEN 's' || s WHEN 2 THEN CASE WHEN n = 1 THEN one END WHEN 4 THEN CASE WHEN sp = p THEN 's' || s || '.run' END END AS target,
CASE form WHEN 0 THEN 'same_file' WHEN 1 THEN CASE WHEN sp = p THEN 'same_file' ELSE 'unique_name' END WHEN 2 THEN CASE WHEN n = 1 THEN 'same_file' ELSE 'name_only' END WHEN 3 THEN 'local_binding' WHEN 4 THEN 'receiver_type' ELSE 'name_only' END AS ev_class,
CASE form WHEN 3 THEN 'local_binding' WHEN 4 THEN CASE WHEN sp <> p THEN 'no_candidate' END WHEN 5 THEN 'no_candidate' WHEN 6 THEN 'unsupported' END AS reason FROM j""")
def resolver_ladder(spark, sf_dir):
    done = resolve.decisions(*_code(spark, sf_dir), take=("start_byte", "resolution_state", "target_qualified_name", "ev_class", "reason"))
    return done.select(F.col("start_byte").cast("long").alias("k"), F.col("resolution_state").alias("state"), F.col("target_qualified_name").alias("target"), "ev_class", "reason")


@query(f"""WITH {_CALLS_SQL}, a AS (SELECT k, p, n FROM j WHERE form = 2 AND coalesce(n, 0) <> 1), c AS (SELECT a.k, sup.sp AS path, 's' || sup.s || '.run' AS qualified_name FROM a JOIN sup ON sup.sp = a.p OR a.n IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path || chr(31) || '06' || chr(31) || qualified_name) - 1 AS ordinal FROM c) SELECT k, ordinal::BIGINT AS ordinal, path, qualified_name FROM r WHERE ordinal < {V.MAX_CANDIDATES}""")
def resolver_candidates(spark, sf_dir):
    _, found = resolve.resolve(*_code(spark, sf_dir), carry=("start_byte",))
    return _long(found.select(F.col("start_byte").alias("k"), "ordinal", "path", "qualified_name"), "k", "ordinal")


@query(f"""WITH {_CALLS_SQL}, d AS (SELECT CASE form WHEN 0 THEN 'resolved' WHEN 1 THEN CASE WHEN sp = p THEN 'resolved' ELSE 'inferred' END WHEN 2 THEN CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 OR {_SUP} > 1 THEN 'ambiguous' ELSE 'inferred' END
WHEN 4 THEN CASE WHEN sp = p THEN 'resolved' ELSE 'unresolved' END ELSE 'unresolved' END AS state FROM j), s AS (SELECT count(*) AS total, count(*) FILTER (WHERE state = 'ambiguous') AS n FROM d)
SELECT 'orphan_edges' AS "check", 'ok' AS severity, 0::BIGINT AS n UNION ALL SELECT 'pending_work', 'ok', 0::BIGINT UNION ALL SELECT 'ambiguity', CASE WHEN n * 100 // greatest(total, 1) >= 50 THEN 'warn' WHEN n > 0 THEN 'notice' ELSE 'ok' END, n::BIGINT FROM s""")
def doctor_after_resolution(spark, sf_dir):
    entities, relations = _code(spark, sf_dir)
    done = resolve.decisions(entities, relations, take=("target_path", "target_kind", "target_qualified_name", "target_ordinal", "resolution_state"))
    edges = spool(done.select(X.entity_id("target_path", "target_kind", "target_qualified_name", "target_ordinal").alias("dst"), F.col("resolution_state").alias("state")))
    return stats.graph_findings(entities.withColumn("id", X.entity_id()), edges).select("check", "severity", "n")


@query(f"""WITH {_CALLS_SQL} SELECT CASE WHEN form = 3 THEN 'local_binding' WHEN form = 6 THEN 'unsupported' ELSE 'no_candidate' END AS reason, count(*)::BIGINT AS n FROM j WHERE form IN (3, 5, 6) OR form = 4 AND sp <> p GROUP BY 1""")
def unresolved_reasons(spark, sf_dir):
    done = resolve.decisions(*_code(spark, sf_dir), take=("resolution_state", "reason"))
    return stats.reasons(done.withColumn("state", F.col("resolution_state")))


@query("""WITH e AS (SELECT 'src/n' || c_nationkey || '.rs' AS path, 'function' AS kind FROM customer UNION ALL SELECT 'src/n' || s_nationkey || '.rs', 'struct' FROM supplier UNION ALL SELECT 'src/n' || s_nationkey || '.rs', 'method' FROM supplier
UNION ALL SELECT 'src/n' || n_nationkey || '.rs', 'file' FROM nation), r AS (SELECT 'src/n' || c_nationkey || '.rs' AS path, CASE WHEN o_orderkey % 7 = 6 THEN 'imports' ELSE 'calls' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT path, 'entity' AS what, kind, count(*)::BIGINT AS n FROM e GROUP BY 1, 3 UNION ALL SELECT path, 'relation', kind, count(*)::BIGINT FROM r GROUP BY 1, 3""")
def counts_by_file(spark, sf_dir):
    return extract.counts_by_file(*_code(spark, sf_dir))


@query("SELECT qualified_name, kind FROM (SELECT 'c' || c_custkey AS qualified_name, 'function' AS kind FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 's' || s_suppkey, 'struct' FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 's' || s_suppkey || '.run', 'method' FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'n7.rs', 'file') ORDER BY kind, qualified_name LIMIT 2000")
def entities_in_file(spark, sf_dir):
    return store.in_file(_code(spark, sf_dir)[0], "src/n7.rs").select("qualified_name", "kind")


@query("SELECT 's5.run' AS qualified_name, 'src/n' || s_nationkey || '.rs' AS path FROM supplier WHERE s_suppkey = 5")
def target_by_qualified_name(spark, sf_dir):
    found = context.resolve_targets(_code(spark, sf_dir)[0].withColumn("id", X.entity_id()), "s5.run")
    return found.candidates.select("qualified_name", "path")


@query("SELECT 's' || s_suppkey || '.run' AS qualified_name, 'src/n' || s_nationkey || '.rs' AS path FROM supplier ORDER BY path || chr(31) || '06' || chr(31) || qualified_name LIMIT 2000")
def target_by_bare_name(spark, sf_dir):
    found = context.resolve_targets(_code(spark, sf_dir)[0].withColumn("id", X.entity_id()), "run")
    return found.candidates.select("qualified_name", "path")


# --- lookups -----------------------------------------------------------------------------


@query(f"WITH {T.ENTITIES_SQL} SELECT id, kind FROM entities WHERE name = 'Customer#000000007'")
def entities_of_a_name(spark, sf_dir):
    return store.by_name(T.entities(spark, sf_dir), "Customer#000000007").select("id", "kind")


@query(f"WITH {T.EDGES_SQL} SELECT src, dst, kind FROM edges WHERE state IN ('inferred', 'ambiguous')")
def relations_in_states(spark, sf_dir):
    return store.in_state(T.edges(spark, sf_dir), "inferred", "ambiguous").select("src", "dst", "kind")


@query(f"WITH {T.ENTITIES_SQL} SELECT DISTINCT path FROM entities")
def all_paths(spark, sf_dir):
    return store.paths(T.entities(spark, sf_dir))


@query(f"""WITH {T.EDGES_SQL}, x AS (SELECT * FROM edges WHERE NOT (src = 'orders/3' AND kind = 'references'))
SELECT 'in' AS side, src AS neighbour, kind, state FROM x WHERE dst = 'orders/3' UNION ALL SELECT 'out', dst, kind, state FROM x WHERE src = 'orders/3'""")
def explain_relation(spark, sf_dir):
    e = T.edges(spark, sf_dir)
    it = e.where("src = 'orders/3' AND kind = 'references'").first()
    return graph.explain_relation(e, it["src"], it["kind"], it["target_name"], it["start_byte"], None).select("side", "neighbour", "kind", "state")


@query(f"""WITH {T.EDGES_SQL} SELECT src, kind, CASE WHEN starts_with(dst, 'customer/') THEN 'unresolved' ELSE state END AS state FROM edges WHERE src = 'orders/5' AND starts_with(dst, 'customer/')""")
def uncertain_edges(spark, sf_dir):
    gone = T.entities(spark, sf_dir).where("kind = 'customer'").select("id")
    return graph.uncertain(graph.explain(store.demote(T.edges(spark, sf_dir), gone), "orders/5", None)).select("src", "kind", "state")


@query(f"""WITH {T.EDGES_SQL}, h AS (SELECT * FROM edges WHERE dst = '{NODE}' AND {DEP}), n1 AS (SELECT DISTINCT src AS id FROM h), f AS (SELECT id FROM n1 ORDER BY id LIMIT 9),
n2 AS (SELECT DISTINCT e.src AS id FROM edges e JOIN f ON e.dst = f.id WHERE {DEP} AND e.src NOT IN (SELECT id FROM n1) AND e.src <> '{NODE}')
SELECT id, 1::BIGINT AS distance FROM n1 UNION ALL SELECT id, 2::BIGINT FROM n2""")
def walk_visit_cap(spark, sf_dir):
    w = graph.dependents(T.edges(spark, sf_dir), NODE, 2, max_edges=None, max_visited=10)
    return _long(w.steps.select("id", "distance"), "distance")


@query("""WITH b AS (SELECT o_custkey AS relation_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS ordinal, 'o' || o_orderkey AS path FROM orders), n AS (SELECT c_custkey AS relation_id, 0 AS ordinal, c_name AS path FROM customer WHERE c_nationkey < 10)
SELECT relation_id, ordinal::BIGINT AS ordinal, path FROM b WHERE relation_id NOT IN (SELECT relation_id FROM n) UNION ALL SELECT relation_id, ordinal::BIGINT, path FROM n""")
def replace_candidate_lists(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    base = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relation_id"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    new = read_table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("relation_id"), F.lit(0).cast("long").alias("ordinal"), F.col("c_name").alias("path"))
    return store.replace_candidates(base, new, new)


@query("""WITH b AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), d AS (SELECT l_orderkey, l_partkey, max(l_quantity) + 1000 AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, CAST(coalesce(d.q, b.q) AS BIGINT) AS q FROM b LEFT JOIN d USING (l_orderkey, l_partkey)""")
def upsert_last_write(spark, sf_dir):
    t = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "cast(l_quantity AS BIGINT) AS q", "l_returnflag")
    base = t.groupBy("l_orderkey", "l_partkey").agg(F.max("q").alias("q"))
    delta = t.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", (F.col("q") + 1000).alias("q"))
    return store.upsert(base, delta, ["l_orderkey", "l_partkey"], "q")


# --- kinds, names, paths -----------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _kinds(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(k) for k in V.ENTITY_KINDS]), (F.col("o_orderkey") % len(V.ENTITY_KINDS) + 1).cast("int")).alias("kind"))


@query(f"""WITH k AS (SELECT o_orderkey, o_orderkey % {len(V.ENTITY_KINDS)} AS ord, {_list(V.ENTITY_KINDS)}[1 + o_orderkey % {len(V.ENTITY_KINDS)}] AS kind FROM orders)
SELECT o_orderkey, kind, ord::BIGINT AS ord, kind IN {_in(V.TYPE_KINDS)} AS is_type, kind IN {_in(V.CALLABLE_KINDS)} AS is_callable, kind IN {_in(V.MEMBER_KINDS)} AS is_member, kind IN {_in(V.CONTAINER_KINDS)} AS is_container,
kind <> 'file' AS is_declaration, kind IN {_in(V.BINDING_KINDS)} AS is_binding, kind IN {_in(V.NAMESPACE_KINDS)} AS is_namespace FROM k""")
def kind_classifiers(spark, sf_dir):
    return _kinds(spark, sf_dir).select("o_orderkey", "kind", X.kind_ord("kind").cast("long").alias("ord"), X.is_type("kind").alias("is_type"), X.is_callable("kind").alias("is_callable"), X.is_member("kind").alias("is_member"),
                                        X.is_container("kind").alias("is_container"), X.is_declaration("kind").alias("is_declaration"), X.is_binding("kind").alias("is_binding"), X.is_namespace("kind").alias("is_namespace"))


@query("""SELECT p_partkey, split_part(reverse(q), '.', 1) AS rev, CASE WHEN contains(q, '.') THEN left(q, length(q) - length(split_part(reverse(q), '.', 1)) - 1) END AS parent FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS q FROM part)""")
def qualified_name_parts(spark, sf_dir):
    q = read_table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("q"))
    return q.select("p_partkey", F.reverse(X.last_name("q")).alias("rev"), X.parent_name("q").alias("parent"))


_FILES = "CASE page_id % 6 WHEN 0 THEN 'a/b/c.tar.gz' WHEN 1 THEN 'Makefile' WHEN 2 THEN 'src/.hidden' WHEN 3 THEN 'src/x' || page_id || '.RS' WHEN 4 THEN 'a.b/c' ELSE 'src' END"


@query(f"""SELECT page_id, path, CASE page_id % 6 WHEN 0 THEN 'c.tar.gz' WHEN 1 THEN 'Makefile' WHEN 2 THEN '.hidden' WHEN 3 THEN 'x' || page_id || '.RS' WHEN 4 THEN 'c' ELSE 'src' END AS file,
CASE page_id % 6 WHEN 0 THEN 'a/b' WHEN 2 THEN 'src' WHEN 3 THEN 'src' WHEN 4 THEN 'a.b' END AS folder, CASE page_id % 6 WHEN 0 THEN 'a/b/c.tar' WHEN 3 THEN 'src/x' || page_id ELSE path END AS stem,
path = 'src' OR starts_with(path, 'src/') AS inside, lower(path) = 'makefile' AS same FROM (SELECT page_id, {_FILES} AS path FROM pages)""")
def path_parts(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", F.expr(_FILES).alias("path"))
    return p.select("page_id", "path", X.file_name("path").alias("file"), X.parent("path").alias("folder"), X.without_extension("path").alias("stem"), X.is_within("path", F.lit("src")).alias("inside"), X.eq_ignore_case("path", F.lit("MAKEFILE")).alias("same"))


@query(f"""WITH s AS (SELECT o_orderkey, {_list(V.STATES)}[1 + o_orderkey % 5] AS state, o_orderkey % 3 = 0 AS bare, CASE WHEN o_orderkey % 2 = 0 THEN 'contains' ELSE 'calls' END AS kind FROM orders)
SELECT o_orderkey, state, state IN ('resolved', 'inferred') AND NOT bare AS followable, kind <> 'contains' AND state IN ('resolved', 'inferred') AND NOT bare AS walkable, state = 'resolved' AND NOT bare AS proof,
CASE state WHEN 'ambiguous' THEN 0 WHEN 'unresolved' THEN 1 WHEN 'pending' THEN 2 WHEN 'inferred' THEN 3 ELSE 4 END::BIGINT AS uncertainty,
CASE state WHEN 'resolved' THEN 'resolved (same_file)' WHEN 'inferred' THEN 'inferred (same_file): b' WHEN 'pending' THEN 'pending (same_file): b' WHEN 'ambiguous' THEN 'ambiguous (0 candidates)' ELSE 'unresolved (no_candidate)' END AS described FROM s""")
def state_predicates(spark, sf_dir):
    s = read_table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in V.STATES]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("state"),
                                                   F.when(F.col("o_orderkey") % 3 != 0, F.lit("t")).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "contains").otherwise("calls").alias("kind"))
    return s.select("o_orderkey", "state", X.is_followable("state", "dst").alias("followable"), X.walk_followable("kind", "state", "dst").alias("walkable"), X.chainable("state", "dst", False).alias("proof"),
                    X.uncertainty("state").cast("long").alias("uncertainty"), X.describe_state("state", F.lit("same_file"), F.lit("b"), F.lit(None).cast("string")).alias("described"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'crate::a' WHEN 1 THEN 'self::b' WHEN 2 THEN 'serde::de' WHEN 3 THEN 'mine::x' ELSE 'std' END AS module, o_orderkey % 5 IN (0, 1, 3) AS relative FROM orders""")
def crate_relative_modules(spark, sf_dir):
    m = read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'crate::a' WHEN 1 THEN 'self::b' WHEN 2 THEN 'serde::de' WHEN 3 THEN 'mine::x' ELSE 'std' END").alias("module"))
    return m.select("o_orderkey", "module", X.crate_relative("module", F.lit("mine")).alias("relative"))


# --- counts and measurement --------------------------------------------------------------


@query("""WITH s AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS hits, count(*) FILTER (WHERE l_returnflag <> 'N') AS found, count(*) AS labelled FROM lineitem GROUP BY 1)
SELECT hits AS precision_n, found AS precision_d, hits AS recall_n, labelled AS recall_d, CASE WHEN found > 0 THEN (hits * 20000 + found) // (2 * found) END::BIGINT AS "precision", ((hits * 20000 + labelled) // (2 * labelled))::BIGINT AS recall FROM s""")
def precision_recall(spark, sf_dir):
    count = lambda c: F.count(F.when(c, 1))
    s = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(count(F.col("l_returnflag") == "A").alias("hits"), count(F.col("l_returnflag") != "N").alias("found"), F.count("*").alias("labelled"))
    return gate.precision_recall(s)


@query("""WITH s AS (SELECT 's' || l_suppkey AS dimension, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) AS d FROM lineitem GROUP BY 1), f AS (SELECT 's' || s_suppkey AS dimension, 4800 + (s_suppkey % 7) * 100 AS floor FROM supplier UNION ALL SELECT 'none', 1)
SELECT f.dimension, f.floor::BIGINT AS floor, coalesce(n, 0)::BIGINT AS n, coalesce(d, 0)::BIGINT AS d, coalesce(n * 10000 >= floor * d, false) AS meets FROM f LEFT JOIN s USING (dimension)""")
def floors_of_dimensions(spark, sf_dir):
    s = read_table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dimension")).agg(F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("n"), F.count("*").alias("d"))
    f = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dimension"), (4800 + (F.col("s_suppkey") % 7) * 100).cast("long").alias("floor"))
    return gate.check_floors(s, f.unionByName(spark.createDataFrame([("none", 1)], "dimension string, floor long"))).select("dimension", "floor", F.col("n").cast("long").alias("n"), F.col("d").cast("long").alias("d"), "meets")


_PLACED = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS target FROM orders"


@query(f"""WITH l AS ({_PLACED}), r AS (SELECT o_orderkey AS k, o_custkey AS target, CASE WHEN o_orderkey % 4 = 0 THEN 'unresolved' ELSE 'resolved' END AS state FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN r.k IS NULL THEN 'no_relation' WHEN r.state = 'resolved' AND r.target = l.target THEN 'correct' WHEN r.state = 'resolved' THEN 'wrong' ELSE 'undecided' END AS verdict, count(*)::BIGINT AS n FROM l LEFT JOIN r USING (k) GROUP BY 1""")
def placement(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    labels = o.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS target")
    found = o.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS k", "o_custkey AS target", "CASE WHEN o_orderkey % 4 = 0 THEN 'unresolved' ELSE 'resolved' END AS state")
    return gate.placement(labels, found, ["k"])


@query(f"""WITH l AS ({_PLACED}), j AS (SELECT l.target AS t, o_custkey AS b, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS v FROM l JOIN orders ON o_orderkey = k)
SELECT count(*) FILTER (WHERE v = t AND b <> t)::BIGINT AS repairs, count(*) FILTER (WHERE b = t AND v <> t)::BIGINT AS damage FROM j""")
def price_of_a_rule(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    labels = o.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS target")
    return gate.price_rule(o.selectExpr("o_orderkey AS k", "o_custkey AS target"), o.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS target"), labels, ["k"])


@query(f"""WITH {T.EDGES_SQL} SELECT split_part(src, '/', 1) AS repo, count(*)::BIGINT AS relations, """ + ", ".join(f"count(*) FILTER (WHERE state = '{s}')::BIGINT AS \"{s}\"" for s in V.STATES) + """,
true AS partitioned, true AS settled FROM edges GROUP BY 1""")
def per_repository(spark, sf_dir):
    return gate.per_repository(T.edges(spark, sf_dir).withColumn("repo", F.substring_index("src", "/", 1)))


@query(f"""WITH {GRAPH}, e AS (SELECT count(*) AS e FROM entities), r AS (SELECT count(*) AS r FROM edges) SELECT (r * 1000 // e)::BIGINT AS relations_per_1000_entities, (r * 64 // r)::BIGINT AS bytes_per_relation FROM e, r""")
def size_ratios(spark, sf_dir):
    s = stats.store_stats(T.entities(spark, sf_dir), T.edges(spark, sf_dir)).first()
    got = stats.ratios(s["entities"], s["relations"], 64 * s["relations"], 1.0)
    return spark.createDataFrame([(int(got["relations_per_entity"] * 1000 + 1e-6), int(got["bytes_per_relation"]))], "relations_per_1000_entities long, bytes_per_relation long")


@query(f"""WITH {GRAPH}, o AS (SELECT count(*) AS n FROM edges e LEFT JOIN entities n ON n.id = e.dst AND n.kind <> 'part' WHERE n.id IS NULL) SELECT CASE WHEN n > 0 THEN 'fail' ELSE 'ok' END AS severity FROM o""")
def worst_severity(spark, sf_dir):
    found = stats.graph_findings(T.entities(spark, sf_dir).where("kind <> 'part'"), T.edges(spark, sf_dir))
    return spark.createDataFrame([(stats.worst(found),)], "severity string")
