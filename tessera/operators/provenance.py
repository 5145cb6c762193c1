"""Several sources as named graphs: which source a file belongs to, what sources ask for, and what they disagree on."""

from __future__ import annotations

import json
import tomllib

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import source_graph
from ..sources.corpus import flat_map
from .closure import reached
from .cycles import strong_components
from .lineage import stored

#: Names of configuration files, in the order in which they are looked for.
CONFIGS = ("wiki.yml", "wiki.yaml", "wiki.json", "wiki.toml")
DECLARED = "parent string, name string, url string, ref string, path string, position int"


def source_graphs(files: DataFrame, sources: DataFrame, base: str) -> DataFrame:
    """The files (path, ...) with the graph g of the source whose folder they lie in, the innermost if sources are nested, or the root's.

    ``sources`` are (name, root). Each folder above a file is looked up, so files are joined by equality and as often as their paths are deep; of two
    sources with one folder the first name has it.
    """
    roots = sources.where("name IS NOT NULL AND root IS NOT NULL").select(F.regexp_replace("root", "^(\\./)+|/+$", "").alias("folder"), "name").groupBy("folder").agg(F.min("name").alias("name"))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    above = files.select("path").distinct().select("path", F.explode(folders).alias("folder"))
    found = above.join(roots, "folder").groupBy("path").agg(F.max_by("name", F.length("folder")).alias("source"))
    return files.join(found, "path", "left").withColumn("g", source_graph(F.col("source"), base)).drop("source")


def declarations(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(parent, name, url, ref, path, position) of what the configuration in each source's folder asks for; the first file that is there counts.

    Files that can't be read, and entries without a name or address, ask for nothing.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, CONFIGS)), name)
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    here = files.where(name.isin(*CONFIGS)).select(folder.alias("folder"), F.struct(rank.alias("rank"), "path", "text").alias("file")).groupBy("folder").agg(F.min_by("file", "file.rank").alias("file"))
    asked = sources.select(F.col("name").alias("parent"), F.regexp_replace("root", "/+$", "").alias("folder")).join(here, "folder").select("parent", "file.path", "file.text")

    def rows(parent: str, path: str, text: str) -> list[tuple]:
        read = tomllib.loads if path.endswith(".toml") else json.loads if path.endswith(".json") else yaml.safe_load
        try:
            listed = read(text).get("sources")
        except (ValueError, AttributeError, yaml.YAMLError):
            return []
        entries = [x for x in listed if isinstance(x, dict) and x.get("name") and x.get("url")] if isinstance(listed, list) else []
        return [(parent, str(x["name"]), str(x["url"]), *(None if x.get(k) is None else str(x[k]) for k in ("ref", "path")), n) for n, x in enumerate(entries)]

    return flat_map(asked, DECLARED, rows)


class Resolution:
    """What a set of declarations comes to: the sources in use, who asks for each, conflicts and cycles.

    ``declared`` are (parent, name, url, ref, path, position), the root's own with parent null. Only what the root leads to counts. Of several
    declarations of a name the root's own is taken, then that of the least parent; others that differ in url or ref are conflicts.
    """

    def __init__(self, declared: DataFrame) -> None:
        named = declared.where("name IS NOT NULL")
        roots = named.where("parent IS NULL").select(F.col("name").alias("x"))
        edges = named.where("parent IS NOT NULL").select(F.col("parent").alias("x"), F.col("name").alias("y"))
        used = reached(edges, roots)
        self.declared = stored(named.where("parent IS NULL").unionByName(named.join(used.withColumnRenamed("x", "parent"), "parent", "left_semi").select(named.columns)), "declared")

    @property
    def sources(self) -> DataFrame:
        """(name, url, ref, path)."""
        first = F.min_by(F.struct("url", "ref", "path"), F.struct(F.coalesce("parent", F.lit("")), "position"))
        return self.declared.groupBy("name").agg(first.alias("x")).select("name", "x.*")

    @property
    def required_by(self) -> DataFrame:
        """(name, parent)."""
        return self.declared.where("parent IS NOT NULL").select("name", "parent").distinct()

    def conflicts(self) -> DataFrame:
        """(name, parent, url, ref, taken_url, taken_ref): declarations that differ from the one that is taken."""
        taken = self.sources.select("name", F.col("url").alias("taken_url"), F.col("ref").alias("taken_ref"))
        same = F.col("url").eqNullSafe(F.col("taken_url")) & F.col("ref").eqNullSafe(F.col("taken_ref"))
        return self.declared.join(taken, "name").where(~same).select("name", "parent", "url", "ref", "taken_url", "taken_ref").distinct()

    def cycles(self) -> DataFrame:
        """(name, cycle) of sources that ask for themselves by way of others; cycle is the least name that they reach and are reached from."""
        found = strong_components(self.required_by.select(F.col("parent").alias("x"), F.col("name").alias("y")))
        least = found.groupBy("component").agg(F.min("node").alias("cycle"))
        return found.join(least, "component").select(F.col("node").alias("name"), "cycle")
