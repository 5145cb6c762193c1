"""RDFS and OWL 2 RL entailment by semi-naive forward chaining over a quad table.

Equal things are one: facts are kept on the least name of each class of equals, the representative, and other names come back only where
results are expanded. So a class of a thousand names costs a thousand rows, not a million, and the rounds don't depend on its size. What is
known is a table for each round, written once; a round reads all of them, as one scan, and writes what is new. After each round its shuffle files
and plans are let go, so that neither the disk nor the driver's memory grows with the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import representatives
from .lineage import let_go, stored, together
from .rules import FACT, SAME, Rules, in_schema, is_node

QUAD = ("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
#: Members of a class of equals that one task pairs with all of the class.
CHUNK = 8_192


def encoded(quads: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with nodes as one string each, blank ones marked by a leading ``_:``."""
    node = lambda c, kind: F.when(F.col(kind) == "bnode", F.concat(F.lit("_:"), F.col(c))).otherwise(F.col(c)).alias(c)
    literal = F.col("o_kind") == "literal"
    return quads.select(*keys, node("s", "s_kind"), "p", node("o", "o_kind"), F.when(literal, "literal").otherwise("node").alias("o_kind"), *[F.when(literal, F.coalesce(c, F.lit(""))).otherwise("").alias(c) for c in ("o_dt", "o_lang")])


def node_name(c: str, is_node: Column | None = None) -> Column:
    blank = F.col(c).startswith("_:")
    return F.when(blank if is_node is None else is_node & blank, F.substring(c, 3, 2**31 - 1)).otherwise(F.col(c))


def node_kind(c: str) -> Column:
    return F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri")


def decoded(facts: DataFrame, keys: list[str]) -> DataFrame:
    kind: Column = F.when(F.col("o_kind") == "literal", "literal").otherwise(node_kind("o"))
    return facts.select(*keys, node_name("s").alias("s"), node_kind("s").alias("s_kind"), "p", node_name("o", is_node()).alias("o"), kind.alias("o_kind"), "o_dt", "o_lang")


class Closure:
    """All that follows from quads: over the union of graphs (no column g), or within each graph.

    Axiomatic and datatype triples are not added. No rule makes new terms, so rounds end when nothing is new.
    ``facts`` are on representatives; ``classes`` (keys..., node, rep) names the other members of each class of equals, or is None.
    """

    def __init__(self, quads: DataFrame, per_graph: bool = False) -> None:
        self.keys = ["g"] if per_graph else []
        self.columns = [*self.keys, *FACT]
        self.classes: DataFrame | None = None
        # A row that lacks a part says nothing.
        self.given = encoded(quads, self.keys).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        self.parts = [self.part(self.given.distinct())]
        new, whole = self.parts[0], True
        rules: Rules | None = None
        while True:
            merged = self.merge(new)
            if merged is not None:
                fresh, renamed = merged
                new = new.unionByName(fresh)
                if rules is not None and not renamed.select("node").union(renamed.select("rep")).join(rules.names, "node", "left_semi").isEmpty():
                    rules = None
            if rules is None:
                rules = Rules(self.known(), self.keys, self.classes)
                fresh = self.part(self.minus(rules.first()))
                self.parts.append(fresh)
                new, whole = self.known(), True
            found = self.part(self.minus(rules.apply(new.where(F.col("p") != SAME), self.known(), whole)))
            if found.isEmpty():
                break
            self.parts.append(found)
            new, whole = found, False
            # Rules whose schema is itself inferred: the tables are made anew, and all facts are new to them.
            if not found.where(in_schema()).isEmpty():
                rules = None
        self.rules = rules

    def part(self, facts: DataFrame) -> DataFrame:
        """A table of facts, each file sorted by predicate, so that a rule reads the row groups of its predicates."""
        made = stored(facts.select(*self.columns).sortWithinPartitions("p"), "facts")
        let_go(made.sparkSession)
        return made

    def known(self) -> DataFrame:
        return together(self.parts).where(F.col("p") != SAME)

    def minus(self, found: list[DataFrame]) -> DataFrame:
        """The facts found, on representatives, that are not known yet."""
        if not found:
            return self.parts[0].limit(0)
        facts = self.canonical(reduce(DataFrame.unionByName, (f.select(*self.columns) for f in found)))
        facts = facts.where((F.col("p") != SAME) | (F.col("s") != F.col("o"))).distinct()
        return facts.join(together(self.parts), self.columns, "left_anti")

    def canonical(self, facts: DataFrame) -> DataFrame:
        if self.classes is None:
            return facts
        k = self.keys
        at = lambda c: self.classes.select(*k, F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"))  # type: ignore[union-attr]
        named = facts.join(at("s"), [*k, "s"], "left").withColumn("s", F.coalesce("s_rep", "s")).drop("s_rep")
        # A literal that reads like a name is none.
        named = named.withColumn("node", F.when(is_node(), F.col("o"))).join(at("node"), [*k, "node"], "left")
        return named.withColumn("o", F.coalesce("node_rep", "o")).select(*self.columns)

    def merge(self, new: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(facts, nodes): the known facts of those who have a new representative, told of it; None where nobody has."""
        k = self.keys
        edges = new.where((F.col("p") == SAME) & is_node() & (F.col("s") != F.col("o"))).select(*k, F.col("s").alias("x"), F.col("o").alias("y"))
        if edges.isEmpty():
            return None
        before = self.classes
        if before is not None:
            edges = edges.unionByName(before.select(*k, F.col("node").alias("x"), F.col("rep").alias("y")))
        self.classes = representatives(edges, k)
        changed = self.classes if before is None else self.classes.join(before, [*k, "node", "rep"], "left_anti")
        nodes = stored(changed.select(*k, "node", "rep"), "renamed")
        known = self.known()
        of = lambda c: nodes.select(*k, F.col("node").alias(c))
        touched = known.join(of("s"), [*k, "s"], "left_semi").unionByName(known.where(is_node()).join(of("o"), [*k, "o"], "left_semi"))
        fresh = self.part(self.minus([touched]))
        self.parts.append(fresh)
        return fresh, nodes

    @property
    def facts(self) -> DataFrame:
        """All facts but equalities, on representatives: once each."""
        facts = self.known()
        if self.classes is None:
            return facts
        k = self.keys
        of = lambda c: self.classes.select(*k, F.col("node").alias(c))  # type: ignore[union-attr]
        facts = facts.withColumn("node", F.when(is_node(), F.col("o"))).join(of("node"), [*k, "node"], "left_anti").drop("node")
        return facts.join(of("s"), [*k, "s"], "left_anti").select(*self.columns)

    def expanded(self) -> DataFrame:
        """Quads with every name of every thing. Lazy: a filter by predicate leaves the other facts, and the pairs of equals, unmade."""
        k = self.keys
        if self.classes is None:
            same = self.parts[0].where(F.col("p") == SAME)
            return decoded(self.known().unionByName(same), k)
        reps = self.classes.select(*k, "rep").distinct()
        members = self.classes.unionByName(reps.select(*k, F.col("rep").alias("node"), "rep"))
        at = lambda c: members.select(*k, F.col("rep").alias(c), F.col("node").alias(f"{c}_name"))
        facts = self.facts.join(at("s"), [*k, "s"], "left").withColumn("s", F.coalesce("s_name", "s")).withColumn("node", F.when(is_node(), F.col("o")))
        facts = facts.join(at("node"), [*k, "node"], "left").withColumn("o", F.coalesce("node_name", "o")).select(*self.columns)
        other = self.given.where((F.col("p") == SAME) & ((F.col("s") == F.col("o")) | ~is_node())).distinct()
        return decoded(facts.unionByName(other), k).unionByName(self.equals(members))

    def equals(self, members: DataFrame) -> DataFrame:
        """Quads of all pairs of equals, from (keys..., node, rep).

        Names are read once a member, not once a pair. Pairs are far more than members, so these are dealt out by class to as many tasks as
        there are shuffle partitions, and a class of over CHUNK members to one for each CHUNK of them.
        """
        k = self.keys
        sizes = self.classes.groupBy(*k, "rep").agg(F.ceil((F.count(F.lit(1)) + 1) / CHUNK).alias("chunks"))  # type: ignore[union-attr]
        named = members.join(sizes, [*k, "rep"]).select(*k, "rep", "node", node_name("node").alias("name"), node_kind("node").alias("kind"), "chunks")
        a = named.select(*k, "rep", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.col("node").alias("a"), F.col("name").alias("s"), F.col("kind").alias("s_kind"))
        b = named.select(*k, "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("node").alias("b"), F.col("name").alias("o"), F.col("kind").alias("o_kind"))
        many = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # type: ignore[arg-type]
        dealt = lambda df: df.repartition(many, *k, "rep", "chunk")
        pairs = dealt(a).join(dealt(b), [*k, "rep", "chunk"]).where("a != b")
        return pairs.select(*k, "s", "s_kind", F.lit(SAME).alias("p"), "o", "o_kind", F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))

    def inconsistencies(self) -> DataFrame:
        """(keys..., rule, s, detail) of what can't be true together, named by the rules of the profile; blank nodes with a leading ``_:``."""
        return self.rules.contradictions(self.facts)


def infer(quads: DataFrame, per_graph: bool = False) -> DataFrame:
    """The quads with all that follows from them."""
    return Closure(quads, per_graph).expanded()


def inconsistencies(quads: DataFrame, per_graph: bool = False) -> DataFrame:
    return Closure(quads, per_graph).inconsistencies()
