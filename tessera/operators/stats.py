"""Statistics, integrity checks and health findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V

SEVERITY = {"ok": 0, "notice": 1, "warn": 2, "fail": 3}


def state_counts(edges: DataFrame) -> DataFrame:
    """(state, n) for all five states, with 0 for those that don't occur."""
    states = edges.sparkSession.createDataFrame([(s,) for s in V.STATES], "state string")
    return states.join(edges.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def crosstab(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in V.STATES])


def orphans(edges: DataFrame, entities: DataFrame) -> DataFrame:
    keys = entities.select(F.col("id").alias("_id"))
    return edges.where("dst IS NOT NULL").join(keys, F.col("dst") == F.col("_id"), "left_anti")


def store_stats(entities: DataFrame, edges: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    e = entities.agg(F.count("*").alias("entities"))
    r = edges.agg(F.count("*").alias("relations"), *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in V.STATES])
    o = orphans(edges, entities).agg(F.count("*").alias("orphans"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each side has exactly one row
    out = one(e).join(one(r), "_one").join(one(o), "_one")
    if candidates is not None:
        out = out.join(one(candidates.agg(F.count("*").alias("candidates"))), "_one")
    return out.drop("_one")


def ratios(entities: int, relations: int, size: int, seconds: float) -> dict[str, float]:
    return {"bytes_per_relation": size / max(1, relations), "relations_per_entity": relations / max(1, entities), "relations_per_second": relations / max(1e-9, seconds)}


def widest(edges: DataFrame) -> DataFrame:
    c = edges.groupBy("src").agg(F.count("*").alias("n"))
    return c.agg(F.max("n").alias("widest"), F.count("*").alias("sources"))


def definers(edges: DataFrame) -> DataFrame:
    return edges.where("dst IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("definers"))


def reasons(edges: DataFrame) -> DataFrame:
    return edges.where("state = 'unresolved'").groupBy("reason").agg(F.count("*").alias("n"))


def samples(rows: DataFrame, most: int = 5) -> DataFrame:
    """(reason, sample, n): a count by reason and its first samples. Counts come from a
    map-side aggregation; only the samples are ranked."""
    n = rows.groupBy("reason").agg(F.count("*").alias("n"))
    top = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("reason").orderBy("sample"))).where(F.col("_rn") <= most).drop("_rn")
    return top.join(n, "reason").select("reason", "sample", "n")


def _finding(check: str, severity: str, n: int, summary: str, action: str = ""):
    return (check, severity, int(n), summary, action)


FINDING_SCHEMA = "`check` string, severity string, n long, summary string, action string"


def graph_findings(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphan edges, pending work and ambiguity, from one aggregate and one anti-join."""
    s = edges.agg(F.count("*").alias("total"), F.count(F.when(F.col("state") == "ambiguous", 1)).alias("ambiguous"), F.count(F.when(F.col("state") == "pending", 1)).alias("pending"))
    o = orphans(edges, entities).agg(F.count("*").alias("n"))
    orphan = o.select(F.lit("orphan_edges").alias("check"), F.when(F.col("n") > 0, "fail").otherwise("ok").alias("severity"), "n", F.lit("edges into entities that are not there").alias("summary"), F.lit("rebuild the index").alias("action"))
    pending = s.select(F.lit("pending_work").alias("check"), F.when(F.col("pending") > 0, "notice").otherwise("ok").alias("severity"), F.col("pending").alias("n"), F.lit("relations not yet decided").alias("summary"), F.lit("resolve").alias("action"))
    share = X.percent_floor("ambiguous", "total")
    ambiguity = s.select(F.lit("ambiguity").alias("check"), F.when(share >= 50, "warn").when(F.col("ambiguous") > 0, "notice").otherwise("ok").alias("severity"), F.col("ambiguous").alias("n"), F.lit("relations with several candidates").alias("summary"), F.lit("").alias("action"))
    return orphan.unionByName(pending).unionByName(ambiguity)


def worst(findings: DataFrame) -> str:
    rank = F.lit(0)
    for name, n in SEVERITY.items():
        rank = F.when(F.col("severity") == name, n).otherwise(rank)
    top = findings.agg(F.max(rank)).first()[0] or 0
    return {v: k for k, v in SEVERITY.items()}[top]


def doctor(spark, root: str, repo_id: str, repo_root: str | None = None, issues: DataFrame | None = None, durability: str = "full") -> DataFrame:
    """All twelve checks of an index; a failed opening ends them."""
    from tessera.operators.store import GraphStore, StoreError

    rows = []
    add = lambda *a: rows.append(_finding(*a))
    try:
        store = GraphStore.open(spark, root, repo_id, create=False)
    except StoreError as e:
        check = {"schema_too_new": "schema_version", "foreign_repository": "repository_identity"}.get(e.kind, "index_openable")
        if check != "index_openable":
            add("index_openable", "ok", 0, "the index opens")
        add(check, "fail", 1, str(e), "index again")
        return spark.createDataFrame(rows, FINDING_SCHEMA)
    except (OSError, ValueError, KeyError) as e:
        add("index_openable", "fail", 1, str(e), "index again")
        return spark.createDataFrame(rows, FINDING_SCHEMA)
    add("index_openable", "ok", 0, "the index opens")
    add("schema_version", "ok", 0, f"schema {V.SCHEMA_VERSION}")
    try:
        broken = store.verify().agg(F.sum("violations")).first()[0] or 0
        add("integrity", "fail" if broken else "ok", broken, "violated invariants", "rebuild the index")
    except Exception as e:  # noqa: BLE001  whatever stops the reading is the finding
        add("integrity", "fail", 1, str(e)[:200], "rebuild the index")
        return spark.createDataFrame(rows, FINDING_SCHEMA)
    add("repository_identity", "ok", 0, repo_id)
    inside = repo_root is not None and (root + "/").startswith(repo_root.rstrip("/") + "/")
    add("index_location", "warn" if inside else "ok", int(inside), "the index lies in the repository" if inside else root, "move it" if inside else "")
    add("durability", "warn" if durability == "normal" else "ok", int(durability == "normal"), durability)
    n = store.table("entity").count()
    bad = store.generation == 0 and n > 0
    add("generation", "fail" if bad else "notice" if n == 0 else "ok", store.generation, "the index is empty" if n == 0 else f"generation {store.generation}")
    staged = store.sizes()["staged"]
    add("wal_size", "notice" if staged else "ok", staged, "bytes of superseded or uncommitted generations", "vacuum" if staged else "")
    refused = issues.count() if issues is not None else 0
    add("unsupported_files", "notice" if refused else "ok", refused, "files that were not indexed")
    return spark.createDataFrame(rows, FINDING_SCHEMA).unionByName(graph_findings(store.entities(), store.edges()))


def invariants(entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(check, violations) of keys, all-or-none groups, states and references."""
    span = ["start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column"]
    target = ["target_path", "target_kind", "target_qualified_name", "target_ordinal"]

    def none_or_all(columns):
        n = sum(F.col(c).isNotNull().cast("int") for c in columns)
        return (n != 0) & (n != len(columns))

    def count(name, df):
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    keys = entity.select(X.entity_id().alias("_id"))
    ends = relation.withColumn("src", X.entity_id("source_path", "source_kind", "source_qualified_name", "source_ordinal")).withColumn("dst", X.entity_id(*target))
    checks = [
        count("entity_key", entity.groupBy(*V.ENTITY_KEY).count().where("count > 1")),
        count("relation_key", relation.groupBy(*V.RELATION_KEY).count().where("count > 1")),
        count("entity_span", entity.where(none_or_all(span))),
        count("relation_target", relation.where(none_or_all(target))),
        count("decided_has_target", relation.where(F.col("resolution_state").isin("resolved", "inferred") & F.col("target_path").isNull())),
        count("state_known", relation.where(~F.col("resolution_state").isin(*V.STATES))),
        count("kind_known", relation.where(~F.col("kind").isin(*V.RELATION_KINDS))),
        count("entity_kind_known", entity.where(~F.col("kind").isin(*V.ENTITY_KINDS))),
        count("source_exists", ends.join(keys, F.col("src") == F.col("_id"), "left_anti")),
        count("target_exists", ends.where("dst IS NOT NULL").join(keys, F.col("dst") == F.col("_id"), "left_anti")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
