"""Parents and children: what tables refer to, import order, link frames, cascades, orphans."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import cut
from rillstore.schema import Schema, parse_idl


@dataclass(frozen=True)
class Link:
    """A field that refers to children: ``kind`` is single, vector, union or vector_union."""

    parent: str
    field: str
    kind: str
    children: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.parent}__{self.field}"

    def ddl(self) -> str:
        return f"CREATE TABLE `{self.name}` (id BIGINT, parent_rowid BIGINT, child_rowid BIGINT, vec_index INT, union_type STRING)"


def links(schema: Schema) -> list[Link]:
    """Every field of a table that refers to tables, whatever the order of declaration."""
    out = []
    for t in schema.tables.values():
        for f in t.fields:
            if f.type in schema.tables:
                out.append(Link(t.name, f.name, "vector" if f.vector else "single", (f.type,)))
            elif f.type in schema.unions:
                out.append(Link(t.name, f.name, "vector_union" if f.vector else "union", tuple(schema.unions[f.type])))
    return out


def merge(files: Mapping[str, str]) -> Schema:
    """One schema from several files' texts."""
    out = Schema()
    for text in files.values():
        s = parse_idl(text)
        for group in ("tables", "structs", "enums", "unions"):
            getattr(out, group).update(getattr(s, group))
    return out


def _imports(files: Mapping[str, str]) -> dict[str, list[str]]:
    names = {re.split(r"[/\\]", n)[-1]: n for n in files}
    return {n: [names[b] for i in parse_idl(text).includes if (b := re.split(r"[/\\]", i)[-1]) in names] for n, text in files.items()}


def import_cycle(files: Mapping[str, str]) -> list[str]:
    """A path of includes that returns to its start, or nothing."""
    graph, done = _imports(files), set()
    for root in sorted(graph):
        path, open_ = [root], [iter(graph[root])]
        while open_:
            step = next(open_[-1], None)
            if step is None:
                done.add(path.pop())
                open_.pop()
            elif step in path:
                return [*path[path.index(step) :], step]
            elif step not in done:
                path.append(step)
                open_.append(iter(graph[step]))
    return []


def import_order(files: Mapping[str, str]) -> list[str]:
    """Files with those they include before them."""
    if cycle := import_cycle(files):
        raise ValueError("includes go round: " + " -> ".join(cycle))
    graph, out = _imports(files), []
    waiting = sorted(graph)
    while waiting:
        ready = [n for n in waiting if all(i in out for i in graph[n])]
        out += ready
        waiting = [n for n in waiting if n not in out]
    return out


LINK = ("id", "parent_rowid", "child_rowid", "vec_index", "union_type")


def extract(parents: DataFrame, link: Link, rowid: str = "_rowid") -> tuple[DataFrame, DataFrame]:
    """Child rows and link rows of one field of decoded parents.

    A child's row id is a hash of its parent's row id and place, so that both frames can be worked out
    independently and again; single and union children have no ``vec_index``.
    """
    many = link.kind.startswith("vector")
    own = parents.select(F.col(rowid).alias("parent_rowid"), F.col(link.field).alias("_c")).filter("_c is not null")
    if many:
        own = own.select("parent_rowid", F.posexplode("_c").alias("vec_index", "_c"))
    else:
        own = own.withColumn("vec_index", F.lit(None).cast("int"))
    own = own.withColumn("child_rowid", F.xxhash64(F.lit(link.name), "parent_rowid", F.coalesce("vec_index", F.lit(-1))).bitwiseAND(F.lit((1 << 62) - 1)))
    union = F.col("_c.type") if "union" in link.kind else F.lit(None).cast("string")
    children = own.select(F.col("child_rowid").alias("_rowid"), "_c.*")
    out = own.select(F.col("child_rowid").alias("id"), "parent_rowid", "child_rowid", "vec_index", union.alias("union_type"))
    return children, out


def children(link_rows: DataFrame, child: DataFrame, parent_rowid: int) -> DataFrame:
    own = link_rows.filter(F.col("parent_rowid") == parent_rowid).select("child_rowid", "vec_index")
    return child.join(own, child["_rowid"] == own["child_rowid"]).drop("child_rowid").orderBy("vec_index")


def parents(link_rows: DataFrame, parent: DataFrame, child_rowid: int) -> DataFrame:
    own = link_rows.filter(F.col("child_rowid") == child_rowid).select("parent_rowid").distinct()
    return parent.join(own, parent["_rowid"] == own["parent_rowid"]).drop("parent_rowid")


def reference_counts(link_rows: DataFrame) -> DataFrame:
    return link_rows.groupBy("child_rowid").agg(F.count("*").alias("references"))


def orphans(child: DataFrame, link_rows: DataFrame) -> DataFrame:
    """Children that no link reaches."""
    return child.join(link_rows.select(F.col("child_rowid").alias("_c")).distinct(), child["_rowid"] == F.col("_c"), "left_anti")


def cascade(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows to delete with ``roots`` (column ``node``): those whose every parent is deleted, to the end.

    ``edges(parent, child)`` names nodes of all tables in one space of ids. A round takes the children of
    what was deleted in the last round that have no parent left; it ends when a round finds none, so
    cycles end too (a cycle that something outside it still refers to stays).
    """
    gone = cut(roots.select(F.col("node").cast("long")).distinct())
    edges = edges.select(F.col("parent").cast("long"), F.col("child").cast("long")).distinct()
    fresh = gone
    while True:
        candidates = edges.join(fresh, edges["parent"] == fresh["node"], "left_semi").select("child").distinct()
        alive = edges.join(gone, edges["parent"] == gone["node"], "left_anti").select("child").distinct()
        fresh = candidates.join(alive, "child", "left_anti").select(F.col("child").alias("node"))
        fresh = cut(fresh.join(gone, "node", "left_anti"))
        if fresh.isEmpty():
            return gone
        gone = cut(gone.unionByName(fresh))
