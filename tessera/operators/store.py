"""Graph tables in generation folders with an atomically replaced manifest."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.operators import stats


class StoreError(RuntimeError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


# --- set-at-a-time operators -------------------------------------------------------------


def point(entities: DataFrame, path: str, kind: str, qualified_name: str, ordinal: int | None = None) -> DataFrame:
    out = entities.where((F.col("path") == path) & (F.col("kind") == kind) & (F.col("qualified_name") == qualified_name))
    return out if ordinal is None else out.where(F.col("entity_ordinal") == ordinal)


def in_file(entities: DataFrame, path: str, limit: int = V.ENTITIES_PER_FILE) -> DataFrame:
    return entities.where(F.col("path") == path).orderBy("kind", "qualified_name", "entity_ordinal").limit(limit)


def by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.col("name") == name)


def paths(entities: DataFrame) -> DataFrame:
    return entities.select("path").distinct()


def in_state(edges: DataFrame, *states: str, state: str = "state") -> DataFrame:
    return edges.where(F.col(state).isin(*states))


def candidates_of(candidates: DataFrame, relation: int, most: int = V.MAX_CANDIDATES) -> DataFrame:
    """The ordered candidates of one relation."""
    return candidates.where(F.col("relation_id") == relation).orderBy("ordinal").limit(most)


def replace_candidates(base: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Candidate lists of the relations in ``touched`` (relation_id) are replaced by ``new``."""
    return base.join(touched.select("relation_id").distinct(), "relation_id", "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def keyset_page(rows: DataFrame, key: list[str], after: tuple, limit: int) -> DataFrame:
    """The rows after a cursor. The leading ``>=`` reaches the scan; the struct does not."""
    cursor = F.struct(*[F.lit(v).alias(k) for k, v in zip(key, after)])
    return rows.where((F.col(key[0]) >= after[0]) & (F.struct(*key) > cursor)).orderBy(*key).limit(limit)


def last_write_wins(delta: DataFrame, key: list[str], order: str | None) -> DataFrame:
    if order is None:
        return delta.dropDuplicates(key)
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return delta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, delta: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with the same key; the last write wins."""
    delta = last_write_wins(delta, key, order).select(*base.columns)
    return base.join(delta, key, "left_anti").select(*base.columns).unionByName(delta)


def scope(column: str, removals: list[tuple[str, str]]) -> F.Column:
    """In any of the removed files or subtrees (kind, path)."""
    out = F.lit(False)
    for kind, path in removals:
        out = out | (X.within_range(column, path) if kind == "subtree" else F.col(column) == path)
    return out


def without_scope(rows: DataFrame, column: str, removals: list[tuple[str, str]]) -> DataFrame:
    return rows.where(~scope(column, removals))


def demote(edges: DataFrame, removed: DataFrame, dst: str = "dst", state: str = "state", clear: tuple = (), reason: str | None = None) -> DataFrame:
    """Edges into removed entities (id) become unresolved without a target; ``clear`` names more
    columns that are emptied, and ``reason`` the one that says no_candidate."""
    gone = removed.select(F.col("id").alias("_gone")).distinct()
    out = edges.join(gone, edges[dst] == gone["_gone"], "left")
    hit = F.col("_gone").isNotNull()
    new = {c: F.when(~hit, F.col(c)) for c in (dst, *clear)} | {state: F.when(hit, F.lit("unresolved")).otherwise(F.col(state))}
    if reason:
        new[reason] = F.when(hit, F.lit("no_candidate")).otherwise(F.col(reason))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in edges.columns])


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def stale(indexed: DataFrame, walked: DataFrame) -> DataFrame:
    return indexed.join(walked, indexed.columns, "left_anti")


def relation_id() -> F.Column:
    return F.xxhash64(*V.RELATION_KEY)


# --- the store ---------------------------------------------------------------------------


class GraphStore:
    """entity, relation and candidate as Parquet under ``gen=<n>/``; readers of a generation
    never see a half-written one. Rows are sorted by path inside their files, so that path
    ranges prune row groups."""

    TABLES = {"entity": V.ENTITY_SCHEMA, "relation": V.RELATION_SCHEMA, "candidate": V.CANDIDATE_SCHEMA}

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    @classmethod
    def open(cls, spark: SparkSession, root: str, repo_id: str, create: bool = True) -> "GraphStore":
        file = os.path.join(root, "manifest.json")
        if not os.path.exists(file):
            if not create:
                raise StoreError("no_index", f"no index at {root}")
            os.makedirs(root, exist_ok=True)
            out = cls(spark, root, {"schema_version": V.SCHEMA_VERSION, "repo_id": repo_id, "generation": 0})
            out._swap(out.manifest)
            return out
        with open(file) as f:
            manifest = json.load(f)
        if manifest["schema_version"] > V.SCHEMA_VERSION:
            raise StoreError("schema_too_new", f"schema {manifest['schema_version']} is newer than {V.SCHEMA_VERSION}")
        if manifest["repo_id"] != repo_id:
            raise StoreError("foreign_repository", f"the index belongs to {manifest['repo_id']}")
        out = cls(spark, root, manifest)
        if manifest["schema_version"] < V.SCHEMA_VERSION:  # rebuilt empty; identity and generation stay
            out._write({k: spark.createDataFrame([], s) for k, s in cls.TABLES.items()}, {"schema_version": V.SCHEMA_VERSION})
        return out

    def _swap(self, manifest: dict) -> None:
        tmp = os.path.join(self.root, f".manifest-{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.root, "manifest.json"))
        self.manifest = manifest

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    def is_stale(self) -> bool:
        """Whether another writer has committed since this handle was opened."""
        with open(os.path.join(self.root, "manifest.json")) as f:
            return json.load(f)["generation"] != self.generation

    def table(self, name: str) -> DataFrame:
        if self.generation == 0:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(os.path.join(self.root, f"gen={self.generation}", name))

    def entities(self) -> DataFrame:
        return self.table("entity").withColumn("id", X.entity_id())

    def edges(self) -> DataFrame:
        r = self.table("relation")
        return (
            r.withColumn("src", X.entity_id("source_path", "source_kind", "source_qualified_name", "source_ordinal"))
            .withColumn("dst", X.entity_id("target_path", "target_kind", "target_qualified_name", "target_ordinal"))
            .withColumn("state", F.col("resolution_state")).withColumn("relation_id", relation_id())
        )

    def candidates(self) -> DataFrame:
        return self.table("candidate")

    def ambiguous_candidates(self, source: DataFrame | None = None) -> DataFrame:
        """Ambiguous relations with their ordered candidate lists (only these rows are joined)."""
        rel = (source or self.edges()).where("state = 'ambiguous'")
        lists = self.candidates().groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "kind", "qualified_name", "entity_ordinal"))).alias("candidates"))
        return rel.join(lists, "relation_id", "left")

    def _write(self, tables: dict[str, DataFrame], more: dict | None = None) -> None:
        n = self.generation + 1
        order = {"entity": ["path", "kind", "qualified_name"], "relation": ["source_path", "kind"], "candidate": ["relation_id", "ordinal"]}
        for name, df in tables.items():
            df.repartitionByRange(order[name][0]).sortWithinPartitions(*order[name]).write.mode("overwrite").parquet(os.path.join(self.root, f"gen={n}", name))
        self._swap(self.manifest | (more or {}) | {"generation": n})

    def apply_update(self, entities: DataFrame | None = None, relations: DataFrame | None = None, candidates: DataFrame | None = None,
                     removals: list[tuple[str, str]] = ()) -> int:
        """One commit: removals (files or subtrees, with their relations and candidates; edges
        into them are demoted), entity and relation upserts, candidate lists replaced for the
        relations given. Dangling sources or targets are refused. Every commit is a new
        generation, an empty one too."""
        empty = {k: self.spark.createDataFrame([], s) for k, s in self.TABLES.items()}
        entities = (entities if entities is not None else empty["entity"]).select(*empty["entity"].columns)
        relations = (relations if relations is not None else empty["relation"]).select(*empty["relation"].columns)
        base_e, base_r, base_c = (self.table(k) for k in self.TABLES)
        if removals:
            kept = without_scope(base_e, "path", list(removals))
            added = entities.select(*V.ENTITY_KEY)
            gone = base_e.where(scope("path", list(removals))).select(*V.ENTITY_KEY).join(added, list(V.ENTITY_KEY), "left_anti").select(X.entity_id().alias("id"))
            base_r = without_scope(base_r, "source_path", list(removals))
            aimed = base_r.withColumn("_dst", X.entity_id("target_path", "target_kind", "target_qualified_name", "target_ordinal"))
            cleared = ("target_path", "target_kind", "target_qualified_name", "target_ordinal", "ev_class", "ev_module", "ev_alias", "ev_receiver", "ev_scope", "ev_binder", "basis")
            base_r, base_e = demote(aimed, gone, "_dst", "resolution_state", cleared, "reason").select(*base_r.columns), kept
        new_e = upsert(base_e, entities, list(V.ENTITY_KEY))
        new_r = upsert(base_r, relations, list(V.RELATION_KEY))
        touched = relations.select(relation_id().alias("relation_id")).distinct()
        alive = new_r.where("resolution_state = 'ambiguous'").select(relation_id().alias("relation_id")).distinct()
        new_c = replace_candidates(base_c, candidates if candidates is not None else empty["candidate"], touched)
        new_c = new_c.join(alive, "relation_id", "left_semi")
        self._refuse_dangling(relations, new_e)
        self._write({"entity": new_e, "relation": new_r, "candidate": new_c})
        return self.generation

    def _refuse_dangling(self, relations: DataFrame, entities: DataFrame) -> None:
        keys = entities.select(X.entity_id().alias("id")).distinct()
        for side in (X.entity_id("source_path", "source_kind", "source_qualified_name", "source_ordinal"), X.entity_id("target_path", "target_kind", "target_qualified_name", "target_ordinal")):
            ends = relations.select(side.alias("id")).where("id IS NOT NULL")
            bad = ends.join(keys, "id", "left_anti").first()
            if bad is not None:
                raise StoreError("dangling_relation", f"no entity {bad['id']!r}")

    def remove(self, path: str, subtree: bool = False) -> int:
        """Remove a file or a subtree; returns the number of indexed paths it covered."""
        kind = "subtree" if subtree else "file"
        n = self.table("entity").where(scope("path", [(kind, path)])).select("path").distinct().count()
        self.apply_update(removals=[(kind, path)])
        return n

    def clear(self) -> int:
        self._write({k: self.spark.createDataFrame([], s) for k, s in self.TABLES.items()})
        return self.generation

    def sizes(self) -> dict[str, int]:
        out = {"committed": 0, "staged": 0}
        for folder, _, names in os.walk(self.root):
            for n in names:
                key = "committed" if f"gen={self.generation}" in folder.split(os.sep) or n == "manifest.json" else "staged"
                out[key] += os.path.getsize(os.path.join(folder, n))
        return out

    def vacuum(self) -> None:
        """Delete superseded generations."""
        import shutil

        for name in os.listdir(self.root):
            if name.startswith("gen=") and name != f"gen={self.generation}":
                shutil.rmtree(os.path.join(self.root, name))

    def verify(self) -> DataFrame:
        """(check, violations): the invariants of the tables; all must be 0."""
        return stats.invariants(self.table("entity"), self.table("relation"))

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        return self.table("entity").select(*V.ENTITY_KEY), self.table("relation").select(*V.RELATION_KEY, "resolution_state", "ev_class", "target_path", "target_qualified_name")

    def query_plan(self, df: DataFrame) -> str:
        return df._jdf.queryExecution().toString()
