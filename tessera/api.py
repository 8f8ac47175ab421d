"""The facade: index a tree, keep it fresh, ask the graph."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.operators import context, extract, graph, modules, resolve, stats
from tessera.operators.store import GraphStore
from tessera.runtime import checkpoint
from tessera.sources import discovery


class UnknownTarget(LookupError):
    kind = "unknown_target"


class AmbiguousTarget(LookupError):
    kind = "ambiguous_target"

    def __init__(self, text: str, candidates: list[str]):
        super().__init__(f"{text!r} means {len(candidates)} entities")
        self.candidates = candidates


class CodeGraph:
    def __init__(self, spark: SparkSession, root: str, index_dir: str | None = None):
        self.spark, self.root = spark, os.path.realpath(root)
        self.repo_id = discovery.fnv_repo_id(self.root)
        self.index_dir = index_dir or discovery.index_location(self.repo_id)
        self.store = GraphStore.open(spark, self.index_dir, self.repo_id)

    # -- building

    def _discover(self, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        paths, links = discovery.walk(self.root)
        self.walked = paths
        paths = paths if only is None else [p for p in paths if p in set(only)]
        found, issues = discovery.discover(discovery.read_files(self.spark, self.root, paths), fold_case=discovery.case_insensitive(self.root))
        return checkpoint(found), issues.unionByName(self.spark.createDataFrame(links, discovery.ISSUES))

    def index(self) -> dict:
        """Full build: one commit of what was extracted, one of what was resolved."""
        found, self.issues = self._discover()
        entities, relations, _ = extract.extract(found)
        self.store.clear()
        self.store.apply_update(entities, relations)
        return self.resolve()

    def resolve(self, names: DataFrame | None = None, full: bool = True) -> dict:
        """Decide pending relations (all others but structural ones too, if ``full``); with ``names``
        those that a change of entities of these names can touch."""
        e, r = self.store.table("entity"), self.store.table("relation")
        only = None if names is None else checkpoint(resolve.affected(r, names))
        done, candidates = resolve.resolve(e, r, force=full, only=only)
        done = checkpoint(done)
        self.decided = done.where(~X.is_structural("kind")).count()
        new = checkpoint(resolve.changed(r, done))
        if new.isEmpty():
            return self.status()
        ids = new.select(F.xxhash64(*V.RELATION_KEY).alias("relation_id"))
        self.store.apply_update(relations=new, candidates=candidates.join(ids, "relation_id", "left_semi"))
        return self.status()

    def refresh(self, paths: list[str]) -> dict:
        """Re-extract changed files, drop vanished ones, decide anew. Files whose package root
        came or went are read again too."""
        wide = set(paths)
        for p in paths:
            folder, _, name = p.rpartition("/")
            if name.split(".")[0] in modules.ROOT_FILES:
                base = folder.removesuffix("src").rstrip("/")
                known = self.store.table("entity").where("kind = 'file'").select("path").where(X.is_within("path", F.lit(base)) if base else F.lit(True))
                wide |= {r["path"] for r in known.where(modules.needs_roots(F.col("path"))).collect()}
        wide |= self._holders(sorted(wide))
        found, self.issues = self._discover(sorted(wide))
        indexed = self.store.table("entity").where("kind = 'file'").select("path")
        layout = indexed.unionByName(found.select("path")).distinct().where(~F.col("path").isin(*[p for p in wide if p not in self.walked] or [""]))
        entities, relations, _ = extract.extract(found, checkpoint(layout.where("path LIKE '%.rs'")))
        # names that were or are declared in these files: no other relation can be decided otherwise
        scope = sorted(wide)
        old = self.store.table("entity").where(F.col("path").isin(*scope)).select("name")
        entities, relations = checkpoint(entities), checkpoint(relations)
        names = checkpoint(old.unionByName(entities.select("name")).distinct())
        moved = checkpoint(resolve.displaced(self.store.table("relation"), scope))
        self.store.apply_update(entities, relations.unionByName(moved.select(*relations.columns)), removals=[("file", p) for p in scope])
        return self.resolve(names=names)

    def _holders(self, changed: list[str]) -> set[str]:
        """Files that hold the package entities of files that came or went, before and after: a
        package's edges to its modules are theirs."""
        indexed = self.store.table("entity").where("kind = 'file'").select("path").where("path LIKE '%.rs'").distinct()
        mine = self.spark.createDataFrame([(p,) for p in changed if p.endswith(".rs")], "path string")
        there = mine.where(F.col("path").isin(*[p for p in changed if os.path.isfile(os.path.join(self.root, p))] or [""]))
        came, went = there.join(indexed, "path", "left_anti"), mine.join(there, "path", "left_anti").join(indexed, "path", "left_semi")
        moved = checkpoint(came.unionByName(went))
        if moved.isEmpty():
            return set()
        layouts = [checkpoint(modules.locate(x)) for x in (indexed, indexed.join(went, "path", "left_anti").unionByName(came))]
        both = layouts[0].unionByName(layouts[1])
        touched = both.join(moved, "path", "left_semi").select("package").distinct()
        holders = [x.join(touched, "package", "left_semi").groupBy("package").agg(F.min("path").alias("p")) for x in layouts]
        return {r["p"] for r in holders[0].unionByName(holders[1]).collect()}

    def remove(self, path: str, subtree: bool = False) -> int:
        return self.store.remove(path, subtree)

    # -- asking

    def target(self, text: str):
        found = context.resolve_targets(self.store.entities(), text)
        rows = found.candidates.limit(50).collect()
        if not rows:
            raise UnknownTarget(f"nothing is called {text!r}")
        if len(rows) > 1:
            raise AmbiguousTarget(text, [f"{r['path']}::{r['qualified_name']}" for r in rows])
        return rows[0]

    def walk(self, text: str, depth: int, direction: str = "in", kind: str | None = None, **options) -> graph.Walk:
        t, edges = self.target(text), self.store.edges()
        members = None
        if t["kind"] in V.CONTAINER_KINDS:
            members = graph.membership(edges, self.store.entities(), t["id"], t["path"] if t["kind"] == "file" else None)
        return graph.walk(edges, t["id"], depth, direction, kind, members=members, **options)

    def callers(self, text: str, **options) -> graph.Walk:
        return self.walk(text, 1, "in", **options)

    def callees(self, text: str, **options) -> graph.Walk:
        return self.walk(text, 1, "out", **options)

    def dependents(self, text: str, depth: int = 2, **options) -> graph.Walk:
        return self.walk(text, depth, "in", **options)

    def explain(self, text: str) -> DataFrame:
        return graph.explain(self.store.edges(), self.target(text)["id"])

    def chain(self, text: str, depth: int = V.CHAIN_DEPTH):
        return graph.chain(self.store.edges(), self.target(text)["id"], depth)

    def minimum_budget(self) -> int:
        return context.report_reserve()

    def peek(self, text: str, budget: int) -> context.Pack:
        """The target with its neighbourhood, packed under a token budget."""
        if budget < context.report_reserve():
            raise context.BudgetTooSmall(budget, context.report_reserve())
        t, edges, entities = self.target(text), self.store.edges(), self.store.entities()
        near = context.neighbourhood(edges, entities, t["id"], t["kind"], container_path=t["path"] if t["kind"] == "file" else None)
        shown = f"{t['path']}::{t['qualified_name']}" + (f"#{t['entity_ordinal']}" if t["entity_ordinal"] else "")
        # a neighbour without an entity is shown by its id rather than dropped
        units = near.join(entities, "id", "left").withColumn("qualified_name", F.coalesce("qualified_name", F.translate("id", "\x1f", " "))).withColumn("path", F.coalesce("path", F.lit("(not in the index)")))
        units = units.withColumn("kind", F.coalesce("kind", F.lit("entity"))).withColumn("entity_ordinal", F.coalesce("entity_ordinal", F.lit(0))).withColumn("of", F.lit(shown)).withColumn("self", X.entity_display("path", "qualified_name", "entity_ordinal"))
        units = units.withColumn("text", context.render_unit())
        incident = graph.adjacency(edges, t["id"], "in", None, V.RELATIONS_PER_ENTITY).unionByName(graph.adjacency(edges, t["id"], "out", None, V.RELATIONS_PER_ENTITY))
        lists = self.store.ambiguous_candidates(incident).select("relation_id", F.transform("candidates", lambda c: X.entity_display(c["path"], c["qualified_name"], c["entity_ordinal"])).alias("candidates"))
        e = incident.join(lists, "relation_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
        e = e.withColumn("outgoing", F.col("src") == t["id"]).withColumn("place", F.coalesce(X.entity_display("target_path", "target_qualified_name", "target_ordinal"), F.col("target_name")))
        e = e.withColumn("state_text", X.describe_state(candidates=F.col("candidates"))).withColumn("uncertainty", X.uncertainty("state"))
        return context.compile_pack(units, e.withColumn("text", context.render_edge()), budget)

    def status(self) -> dict:
        row = stats.store_stats(self.store.entities(), self.store.edges(), self.store.candidates()).first().asDict()
        return row | {"generation": self.store.generation, "index": self.index_dir}

    def doctor(self) -> DataFrame:
        return stats.doctor(self.spark, self.index_dir, self.repo_id, self.root, getattr(self, "issues", None))
