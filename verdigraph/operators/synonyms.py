"""Names that mean one substance: groups, lookups, and the offline compiler of groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A name with more direct partners than this has no group of its own; a compiled group has no more names.
PARTNERS, MEMBERS = 50, 100


def star_groups(pairs: DataFrame) -> DataFrame:
    """(gid, norm_name): each name with its direct partners, no further; pairs (a, b). The group's id is its centre's key."""
    both = pairs.select(T.normalize_name(F.col("a")).alias("x"), T.normalize_name(F.col("b")).alias("y")).where("x != y and x != '' and y != ''")
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    centres = both.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") <= PARTNERS).select("x")
    own = centres.select(F.col("x").alias("gid"), F.col("x").alias("norm_name"))
    return own.unionByName(both.join(centres, "x").select(F.col("x").alias("gid"), F.col("y").alias("norm_name")))


def lookup(names: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, member): the names that share a group with each name, itself left out."""
    own = names.select("name", T.normalize_name(F.col("name")).alias("norm_name"))
    ids = own.join(groups, "norm_name").select("name", F.col("norm_name").alias("self"), "gid")
    return ids.join(groups, "gid").where("norm_name != self").select("name", F.col("norm_name").alias("member")).distinct()


def name_score(same_name: bool, same_group: bool) -> int:
    """Points of a product name for showing: 50 the same, 45 a synonym, 0 neither."""
    return 50 if same_name else 45 if same_group else 0


def extract(flows: DataFrame) -> DataFrame:
    """(a, b): a flow's name with each of its synonyms, and names of one CAS number in a chain by order; flows (name, cas, synonyms)."""
    own = flows.select(F.col("name").alias("a"), F.explode("synonyms").alias("b")).where("a != b")
    names = flows.where("cas is not null and trim(cas) != ''").select(T.cas_first(F.col("cas")).alias("cas"), "name").distinct()
    chain = names.withColumn("b", F.lead("name").over(Window.partitionBy("cas").orderBy("name"))).where("b is not null").select(F.col("name").alias("a"), "b")
    return own.unionByName(chain).distinct()


def compile_groups(cas_groups: Iterable[Iterable[str]], pairs: Iterable[tuple[str, str]], most: int = MEMBERS) -> list[list[str]]:
    """Groups of names by CAS and then by pairs in their order; a merge beyond most names is left out, so order counts.

    An offline tool over reference files, in one process: the order rules out a distributed form.
    """
    parent: dict[str, str] = {}
    size: dict[str, int] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        size.setdefault(x, 1)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(x: str, y: str) -> None:
        a, b = find(x), find(y)
        if a != b and size[a] + size[b] <= most:
            parent[b] = a
            size[a] += size[b]

    for group in cas_groups:
        names = list(dict.fromkeys(group))
        if len(names) >= 2:
            for other in names[1:]:
                union(names[0], other)
    for x, y in pairs:
        union(x, y)
    found: dict[str, list[str]] = {}
    for x in list(parent):
        found.setdefault(find(x), []).append(x)
    return sorted(sorted(g) for g in found.values() if len(g) > 1)
