"""Target resolution, neighbourhoods and packs under a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.operators import graph

WIDEST = 2**64 - 1
#: Fixed phrases of the report; they are priced, so their bytes are part of the budget.
UNIT_PHRASES = {"budget_exhausted": "did not fit the budget", "exceeds_budget": "costs more than the entire budget", "edge_limit": "hit the per-unit edge cap"}
EDGE_PHRASES = {"budget_exhausted": "did not fit beside its unit", "exceeds_budget": "cost more than the entire budget", "edge_limit": "hit the per-unit edge cap"}
TITLE = "context pack"


@dataclass
class Found:
    matched: str | None
    candidates: DataFrame


def resolve_targets(entities: DataFrame, text: str, file_kind: str = "file", limit: int = V.ENTITIES_PER_FILE) -> Found:
    """The entities that a target's text means, by the first of three lookups that finds any: a
    file by its path, a qualified name, a bare name (declarations before files). More than one
    row is an ambiguity, none an unknown target."""
    path = None if "\0" in text or ".." in text.replace("\\", "/").split("/") else "/".join(p for p in text.replace("\\", "/").split("/") if p not in ("", "."))
    if path:
        by_path = entities.where((F.col("path") == path) & (F.col("kind") == file_kind)).limit(1)
        if not by_path.isEmpty():
            return Found("path", by_path)
    by_name = entities.where(F.col("qualified_name") == text).orderBy("id").limit(limit)
    if not by_name.isEmpty():
        return Found("qualified_name", by_name)
    bare = entities.where(F.col("name") == text)
    declared = bare.where(F.col("kind") != "file")
    chosen = (bare if declared.isEmpty() else declared).orderBy("id").limit(limit)
    return Found(None if chosen.isEmpty() else "name", chosen)


def neighbourhood(edges: DataFrame, entities: DataFrame, target: str, target_kind: str, follow_inferred: bool = True, limit: int | None = V.RELATIONS_PER_ENTITY,
                  container_path: str | None = None) -> DataFrame:
    """(id, section, distance, via_kind): everything one hop from a target with the best reason
    to include it: target 0, member 1, container 2, callee 3, caller 4, referenced 5."""
    spark = edges.sparkSession
    incident = graph.adjacency(edges, target, "in", None, limit).unionByName(graph.adjacency(edges, target, "out", None, limit))
    rows = [spark.createDataFrame([(target, 0, 0, None)], "id string, section int, distance int, via_kind string")]
    if target_kind in V.CONTAINER_KINDS:
        inside = graph.membership(edges, entities, target, container_path).where(F.col("id") != target)
        rows.append(inside.select("id", F.lit(1).alias("section"), F.lit(1).alias("distance"), F.lit("contains").alias("via_kind")))
    else:
        up = incident.where(X.is_structural("kind") & X.is_followable("state", "dst") & (F.col("src") != target))
        rows.append(up.select(F.col("src").alias("id"), F.lit(2).alias("section"), F.lit(0).alias("distance"), F.col("kind").alias("via_kind")))
    near = graph.followable(incident, follow_inferred)
    out = F.col("src") == target
    rows.append(near.select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("id"), F.when(out & (F.col("kind") == "calls"), 3).when(out, 5).otherwise(4).alias("section"),
                            F.lit(1).alias("distance"), F.col("kind").alias("via_kind")).where(F.col("id") != target))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    best = every.groupBy("id").agg(F.min(F.struct("section", "distance", "via_kind")).alias("b"))
    return best.select("id", "b.section", "b.distance", "b.via_kind")


def rank_units(units: DataFrame, order: list, most: int = V.MAX_UNITS) -> DataFrame:
    """The first ``most`` units in order, numbered. Taking them is a top-k; only these few rows
    meet in the window that numbers them."""
    top = units.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def pack_units(ranked: DataFrame, available: int) -> DataFrame:
    """Whole units in rank order until the first that does not fit; what follows is left out.
    Adds ``used``, ``included`` and ``reason``."""
    used = F.sum("cost").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranked.withColumn("used", used).withColumn("included", F.col("used") <= available)
    return out.withColumn("reason", F.when(~F.col("included"), F.when(F.col("cost") > available, "exceeds_budget").otherwise("budget_exhausted")))


def render_unit(section="section") -> F.Column:
    """Text of a unit; what is priced is what is shown."""
    head = F.concat(F.col("kind"), F.lit(" "), F.col("qualified_name"), F.lit(" — "), F.col("path"),
                    F.when(F.col("start_line").isNotNull(), F.concat(F.lit(":"), F.col("start_line").cast("string"))).otherwise(F.lit("")))
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n  {label}: "), F.col(c))).otherwise(F.lit(""))
    of = F.concat(F.lit("`"), F.col("of"), F.lit("`"))
    why = (
        F.when(F.col(section) == 0, F.lit("it is what you asked for."))
        .when(F.col(section) == 1, F.concat(of, F.lit(" declares or contains it.")))
        .when(F.col(section) == 2, F.concat(F.lit("`"), F.col("self"), F.lit("` contains the target.")))
        .when(F.col(section) == 3, F.concat(of, F.lit(" calls it, "), F.col("distance").cast("string"), F.lit(" hop away.")))
        .when(F.col(section) == 4, F.concat(F.lit("it calls "), of, F.lit(", "), F.col("distance").cast("string"), F.lit(" hop away.")))
        .otherwise(F.concat(of, F.lit(" names it as a `"), F.col("via_kind"), F.lit("` target, "), F.col("distance").cast("string"), F.lit(" hop away.")))
    )
    return F.concat(head, part("signature", "signature"), part("doc", "doc"), F.lit("\n  included because: "), why)


def render_edge(list_candidates: bool = True) -> F.Column:
    """Text of an edge (outgoing, state_text, basis, candidates as names, source_path, line)."""
    between = F.when(F.size("candidates") == 0, F.lit("no candidate was recorded")).otherwise(
        F.array_join("candidates", ", ") if list_candidates else F.concat(F.size("candidates").cast("string"), F.lit(" candidate(s), not listed")))
    return F.concat(
        F.lit("  "), F.when(F.col("outgoing"), "->").otherwise("<-"), F.lit(" "), F.col("kind"), F.lit(" "), F.col("place"), F.lit("  ["), F.col("state_text"), F.lit("]  "),
        F.col("source_path"), F.lit(":"), F.col("start_line").cast("string"),
        F.when(F.col("state").isin("inferred", "pending"), F.concat(F.lit("\n      because: "), F.coalesce("basis", F.lit("")))).otherwise(F.lit("")),
        F.when(F.col("state") == "ambiguous", F.concat(F.lit("\n      between: "), between)).otherwise(F.lit("")))


def tokens(text: str, per: int = V.BYTES_PER_TOKEN) -> int:
    n = len(text.encode("utf-8"))
    return n if per == 0 else -(-n // per)


def rule(per: int = V.BYTES_PER_TOKEN) -> str:
    return f"ceil(utf8 bytes / {per})"


def report_reserve(per: int = V.BYTES_PER_TOKEN) -> int:
    """Tokens of the widest report there can be: the least budget."""
    lines = [TITLE, f"budget: {WIDEST} tokens requested, {WIDEST} spent, {WIDEST} remaining", f"counted as: {rule(per)}", "status: insufficient"]
    lines += [f"  {WIDEST} unit(s) {p}" for p in UNIT_PHRASES.values()] + [f"  {WIDEST} edge(s) {p}" for p in EDGE_PHRASES.values()]
    return tokens("\n".join(lines) + "\n", per)


def report_text(requested: int, spent: int, status: str, dropped: dict[tuple[str, str], int], per: int = V.BYTES_PER_TOKEN) -> str:
    out = f"{TITLE}\nbudget: {requested} tokens requested, {spent} spent, {max(0, requested - spent)} remaining\ncounted as: {rule(per)}\nstatus: {status}\n"
    if not dropped:
        return out + "dropped: nothing\n"
    out += "dropped:\n"
    for what, phrases in (("unit", UNIT_PHRASES), ("edge", EDGE_PHRASES)):
        for reason, phrase in phrases.items():
            if n := dropped.get((what, reason)):
                out += f"  {n} {what}(s) {phrase}\n"
    return out


class BudgetTooSmall(ValueError):
    def __init__(self, budget: int, minimum: int):
        super().__init__(f"a budget of {budget} tokens is under the minimum of {minimum}")
        self.budget, self.minimum = budget, minimum


@dataclass
class Pack:
    rows: DataFrame  # what, id, rank, cost, text, included, reason
    status: str
    budget: int
    spent: int
    reserve: int
    report: str
    target_cost: int

    def render(self) -> str:
        got = self.rows.where("included").orderBy("rank").select("text").collect()
        return self.report + "\n" + "\n".join(r["text"] for r in got) + "\n"

    def floor_for_target(self) -> int:
        return self.reserve + self.target_cost


def compile_pack(units: DataFrame, target_edges: DataFrame, budget: int, per: int = V.BYTES_PER_TOKEN, most: int = V.MAX_UNITS) -> Pack:
    """Units (id, section, text, and the columns of the rank) and the target's edges (text, and
    those of their order) packed under a budget.

    Rank: the target, its edges by uncertainty, the other units. The target is in if its cost
    fits; its edges while their running sum fits beside it; then units while the running sum
    fits. Everything left out is a row with its reason.
    """
    spark = units.sparkSession
    reserve = report_reserve(per)
    if budget < reserve:
        raise BudgetTooSmall(budget, reserve)
    available = budget - reserve
    order = [c for c in ("section", "distance", "path", "kind_ord", "qualified_name", "entity_ordinal", "id") if c in units.columns]
    ranked = rank_units(units.withColumn("cost", X.token_cost("text", per)), order, most)
    first = ranked.where("section = 0").first()
    target_cost = int(first["cost"]) if first else 0
    room = available - target_cost
    fits = bool(first) and room >= 0
    edge_order = [c for c in ("uncertainty", "kind", "source_path", "src", "target_name", "start_byte") if c in target_edges.columns]
    e = target_edges.withColumn("cost", X.token_cost("text", per)).withColumn("r", F.row_number().over(Window.orderBy(*edge_order)))
    e = e.withColumn("used", F.sum("cost").over(Window.orderBy("r"))).withColumn("included", F.lit(fits) & (F.col("used") <= room))
    edge_spent = int(e.where("included").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])
    start = target_cost + edge_spent
    u = ranked.where("section > 0").withColumn("used", F.lit(start) + F.sum("cost").over(Window.orderBy("rank"))).withColumn("included", F.lit(fits) & (F.col("used") <= available))
    exceeds = F.when(F.col("cost") > available, "exceeds_budget").otherwise("budget_exhausted")
    rows = (
        ranked.where("section = 0").select(F.lit("unit").alias("what"), "id", F.lit(0).cast("long").alias("rank"), "cost", "text", F.lit(fits).alias("included"), exceeds.alias("reason"))
        .unionByName(e.select(F.lit("edge").alias("what"), (F.col("src") if "src" in e.columns else F.lit("")).alias("id"), F.col("r").cast("long").alias("rank"), "cost", "text", "included", F.lit("budget_exhausted").alias("reason")))
        .unionByName(u.select(F.lit("unit").alias("what"), "id", (F.col("rank") + 1_000_000).cast("long").alias("rank"), "cost", "text", "included", exceeds.alias("reason")))
    )
    rows = rows.withColumn("reason", F.when(~F.col("included"), F.col("reason")))
    got = rows.groupBy("what", "reason", "included").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).collect()
    dropped = {(r["what"], r["reason"]): r["n"] for r in got if not r["included"]}
    spent = reserve + sum(r["c"] for r in got if r["included"])
    status = "insufficient" if not fits else "reduced" if dropped else "complete"
    return Pack(rows, status, budget, spent, reserve, report_text(budget, spent, status, dropped, per), target_cost)
