"""The driver tables as a graph: entities, edges and the corpora the operators run on.

Ids are ``<kind>/<key>``, so their text order is the order of identities here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import read_table

TABLES = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"),
          "part": ("p_partkey", "p_name"), "orders": ("o_orderkey", None)}


def _id(kind: str, key) -> F.Column:
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


def entities(spark, sf_dir: str) -> DataFrame:
    """(id, path, kind, qualified_name, name)"""
    out = None
    for kind, (key, name) in TABLES.items():
        t = read_table(spark, sf_dir, kind)
        i = _id(kind, key)
        rows = t.select(i.alias("id"), i.alias("path"), F.lit(kind).alias("kind"), F.concat(F.lit(kind + "."), F.col(key).cast("string")).alias("qualified_name"),
                        (F.col(name) if name else F.col(key).cast("string")).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark, sf_dir: str) -> DataFrame:
    """(src, dst, kind, state, ev_class, target_name, source_path, start_byte): nations
    contained in regions; customers and suppliers refer to nations, orders to customers, and
    orders call the parts and suppliers of their lines."""

    def rows(t, src, dst, kind, ev, state="resolved"):
        return t.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(state).alias("state"), F.lit(ev).alias("ev_class"), dst.alias("target_name"),
                        src.alias("source_path"), F.lit(0).alias("start_byte"))

    line = read_table(spark, sf_dir, "lineitem")
    parts = [
        rows(read_table(spark, sf_dir, "nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains", "containment"),
        rows(read_table(spark, sf_dir, "customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "references", "same_file"),
        rows(read_table(spark, sf_dir, "supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "references", "import_binding"),
        rows(read_table(spark, sf_dir, "orders"), _id("orders", "o_orderkey"), _id("customer", "o_custkey"), "references", "qualified_name_in_scope"),
        rows(line.select("l_orderkey", "l_partkey").distinct(), _id("orders", "l_orderkey"), _id("part", "l_partkey"), "calls", "unique_name", "inferred"),
        rows(line.select("l_orderkey", "l_suppkey").distinct(), _id("orders", "l_orderkey"), _id("supplier", "l_suppkey"), "calls", "receiver_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same in SQL, as common table expressions (without WITH).
ENTITIES_SQL = "entities AS (" + " UNION ALL ".join(
    f"SELECT '{k}/' || {key} AS id, '{k}/' || {key} AS path, '{k}' AS kind, '{k}.' || {key} AS qualified_name, {name or f'CAST({key} AS VARCHAR)'} AS name FROM {k}"
    for k, (key, name) in TABLES.items()) + ")"


def _edge(src: str, dst: str, kind: str, ev: str, table: str, state: str = "resolved") -> str:
    return f"SELECT {src} AS src, {dst} AS dst, '{kind}' AS kind, '{state}' AS state, '{ev}' AS ev_class, {dst} AS target_name, {src} AS source_path, 0 AS start_byte FROM {table}"


EDGES_SQL = "edges AS (" + " UNION ALL ".join([
    _edge("'region/' || n_regionkey", "'nation/' || n_nationkey", "contains", "containment", "nation"),
    _edge("'customer/' || c_custkey", "'nation/' || c_nationkey", "references", "same_file", "customer"),
    _edge("'supplier/' || s_suppkey", "'nation/' || s_nationkey", "references", "import_binding", "supplier"),
    _edge("'orders/' || o_orderkey", "'customer/' || o_custkey", "references", "qualified_name_in_scope", "orders"),
    _edge("'orders/' || l_orderkey", "'part/' || l_partkey", "calls", "unique_name", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "inferred"),
    _edge("'orders/' || l_orderkey", "'supplier/' || l_suppkey", "calls", "receiver_type", "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"),
]) + ")"

#: Strength of an evidence class and dependency test, for use in SQL.
STRENGTH_SQL = ("CASE ev_class WHEN 'containment' THEN 100 WHEN 'import_binding' THEN 90 WHEN 'receiver_type' THEN 85 WHEN 'path_match' THEN 80 "
                "WHEN 'qualified_name_in_scope' THEN 70 WHEN 'same_file' THEN 50 WHEN 'unique_name' THEN 40 WHEN 'name_only' THEN 10 ELSE 0 END")
