"""The OWL 2 RL rules as joins of facts with the schema that stands among them.

Facts are (keys..., s, p, o, o_kind, o_dt, o_lang). Nodes are written as one string, blank ones with a leading ``_:``; o_kind
is ``node`` or ``literal``. A rule whose schema statements don't occur is left out. Each rule is given the facts that are new in a round and all known
ones, new ones included, and gives what follows from at least one new fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import OWL, RDF, RDFS, TYPE
from .closure import transitive
from .lineage import stored

SAME = OWL + "sameAs"
THING, NOTHING = OWL + "Thing", OWL + "Nothing"
#: Predicates whose objects are lists.
LISTS = [OWL + p for p in ("intersectionOf", "unionOf", "oneOf", "propertyChainAxiom", "hasKey", "members", "distinctMembers")]
SCHEMA = (
    [RDFS + p for p in ("subClassOf", "subPropertyOf", "domain", "range")]
    + [OWL + p for p in ("equivalentClass", "equivalentProperty", "inverseOf", "hasValue", "someValuesFrom", "allValuesFrom", "onProperty", "onClass", "maxCardinality", "maxQualifiedCardinality")]
    + [OWL + p for p in ("disjointWith", "complementOf", "propertyDisjointWith", "sourceIndividual", "assertionProperty", "targetIndividual", "targetValue")]
    + LISTS
)
MARKS = [OWL + p for p in ("SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "AsymmetricProperty", "AllDisjointClasses", "AllDifferent")]
LIMITS = [OWL + "maxCardinality", OWL + "maxQualifiedCardinality"]
FACT = ("s", "p", "o", "o_kind", "o_dt", "o_lang")


def is_node() -> Column:
    return F.col("o_kind") == "node"


def in_schema() -> Column:
    return F.col("p").isin(SCHEMA) | ((F.col("p") == TYPE) & F.col("o").isin(MARKS))


class Rules:
    def __init__(self, known: DataFrame, keys: list[str], classes: DataFrame | None) -> None:
        self.keys = keys
        self.schema = stored(known.where(in_schema()).select(*keys, *FACT).distinct(), "schema")
        # Bounded by the fixed lists above; limits of none or one are told apart, as rules know these only.
        limit = F.expr("try_cast(o AS INT)")
        kind = F.when(F.col("p") == TYPE, F.col("o")).when(F.col("p").isin(LIMITS) & limit.isin(0, 1), F.concat_ws(" ", "p", limit.cast("string"))).otherwise(F.col("p"))
        self.present = {r[0] for r in self.schema.select(kind).distinct().collect()}
        self._known, self._predicates, self._names = known, None, None
        self.lists = self.positions(known) if self.present & set(LISTS) else None
        equal = None
        if classes is not None:
            predicates = self.predicates
            mine = classes.select(*keys, F.col("node").alias("x"), F.col("rep").alias("y"))
            equal = mine.join(predicates.withColumnRenamed("node", "x"), "x", "left_semi").unionByName(mine.join(predicates.withColumnRenamed("node", "y"), "y", "left_semi"))
        self.sub_class = self.closed(RDFS + "subClassOf", OWL + "equivalentClass", None)
        self.sub_property = self.closed(RDFS + "subPropertyOf", OWL + "equivalentProperty", equal)

    # Schema tables.

    @property
    def predicates(self) -> DataFrame:
        if self._predicates is None:
            self._predicates = stored(self._known.selectExpr("p AS node").distinct(), "predicates")
        return self._predicates

    @property
    def names(self) -> DataFrame:
        """The vocabulary: what a change of representatives must not touch without the rules being made anew."""
        if self._names is None:
            self._names = stored(self.schema.selectExpr("s AS node").union(self.schema.where(is_node()).selectExpr("o")).union(self.predicates).distinct(), "names")
        return self._names

    def pairs(self, p: str) -> DataFrame:
        return self.schema.where(F.col("p") == p).select(*self.keys, F.col("s").alias("x"), F.col("o").alias("y"))

    def marked(self, kind: str) -> DataFrame:
        """Properties of a type, as column p."""
        return self.schema.where((F.col("p") == TYPE) & (F.col("o") == OWL + kind)).select(*self.keys, F.col("s").alias("p"))

    def positions(self, known: DataFrame) -> DataFrame:
        """(keys..., head, place, member, n): the members of every list, places from 0; cells find their head by jumps that double."""
        k = self.keys
        firsts = known.where(F.col("p") == RDF + "first")
        first = firsts.where(is_node()).select(*k, F.col("s").alias("cell"), F.col("o").alias("member"))
        before = known.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select(*k, F.col("o").alias("cell"), F.col("s").alias("prior"))
        cells = firsts.select(*k, F.col("s").alias("cell")).distinct().join(before, [*k, "cell"], "left")
        at = stored(cells.select(*k, "cell", F.coalesce("prior", "cell").alias("head"), F.col("prior").isNotNull().cast("long").alias("place")), "cells")
        for _ in range(max(1, at.count().bit_length())):
            up = at.select(*k, F.col("cell").alias("head"), F.col("head").alias("top"), F.col("place").alias("more"))
            at = stored(at.join(up, [*k, "head"]).select(*k, "cell", F.col("top").alias("head"), (F.col("place") + F.col("more")).alias("place")), "cells")
            if at.join(before.select(*k, F.col("cell").alias("head")), [*k, "head"], "left_semi").isEmpty():
                break
        sizes = at.groupBy(*k, "head").agg(F.count(F.lit(1)).alias("n"))
        return stored(at.join(sizes, [*k, "head"]).join(first, [*k, "cell"]).select(*k, "head", "place", "member", "n"), "lists")

    def members(self, p: str) -> DataFrame:
        """(keys..., head, x, place, member, n): of each thing x that has a list by this predicate, the list's members."""
        heads = self.pairs(p).select(*self.keys, "x", F.col("y").alias("head"))
        return heads.join(self.lists, [*self.keys, "head"])

    def closed(self, below: str, same: str, equal: DataFrame | None) -> DataFrame | None:
        k, edges = self.keys, []
        turned = lambda df: df.select(*k, F.col("y").alias("x"), F.col("x").alias("y"))
        if below in self.present:
            edges.append(self.pairs(below))
        for both in ([self.pairs(same)] if same in self.present else []) + ([equal] if equal is not None else []):
            edges += [both, turned(both)]
        if same == OWL + "equivalentClass":
            if OWL + "intersectionOf" in self.present:
                edges.append(self.members(OWL + "intersectionOf").select(*k, "x", F.col("member").alias("y")))
            if OWL + "unionOf" in self.present:
                edges.append(self.members(OWL + "unionOf").select(*k, F.col("member").alias("x"), F.col("x").alias("y")))
        return transitive(reduce(DataFrame.unionByName, edges), k) if edges else None

    def restrictions(self, what: str) -> DataFrame:
        """(keys..., class, p, v, v_kind, v_dt, v_lang)."""
        on = self.pairs(OWL + "onProperty").select(*self.keys, F.col("x").alias("class"), F.col("y").alias("p"))
        value = self.schema.where(F.col("p") == OWL + what).select(*self.keys, F.col("s").alias("class"), F.col("o").alias("v"), F.col("o_kind").alias("v_kind"), F.col("o_dt").alias("v_dt"), F.col("o_lang").alias("v_lang"))
        return on.join(value, [*self.keys, "class"])

    def at_most(self, n: int) -> DataFrame:
        """(keys..., class, p, of): classes whose members have at most n values of a property, counting those of class ``of``."""
        k = self.keys
        plain = self.restrictions("maxCardinality").where(F.expr(f"try_cast(v AS INT) = {n}")).select(*k, "class", "p", F.lit(THING).alias("of"))
        if not self.limited(n, LIMITS[1:]):
            return plain
        of = self.pairs(OWL + "onClass").select(*k, F.col("x").alias("class"), F.col("y").alias("of"))
        return plain.unionByName(self.restrictions("maxQualifiedCardinality").where(F.expr(f"try_cast(v AS INT) = {n}")).select(*k, "class", "p").join(of, [*k, "class"]).select(*k, "class", "p", "of"))

    def limited(self, n: int, kinds: list[str] = LIMITS) -> bool:
        """Whether the schema has limits of n, so that no rule on them is planned in vain."""
        return any(f"{p} {n}" in self.present for p in kinds)

    # Shapes of facts.

    def typed(self, df: DataFrame, s: str, kind: str) -> DataFrame:
        return df.select(*self.keys, F.col(s).alias("s"), F.lit(TYPE).alias("p"), F.col(kind).alias("o"), F.lit("node").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))

    def linked(self, df: DataFrame, s: str, p: Column, o: str) -> DataFrame:
        return df.select(*self.keys, F.col(s).alias("s"), p.alias("p"), F.col(o).alias("o"), F.lit("node").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))

    def least_of(self, df: DataFrame, group: list[str], member: str) -> DataFrame:
        """Members of a group as equal to the least of it: a star, not all pairs."""
        group = [*self.keys, *group]
        least = df.groupBy(*group).agg(F.min(member).alias("least"))
        return self.linked(df.join(least, group).where(F.col(member) != F.col("least")), member, F.lit(SAME), "least")

    def types(self, facts: DataFrame, s: str, kind: str) -> DataFrame:
        return facts.where(F.col("p") == TYPE).select(*self.keys, F.col("s").alias(s), F.col("o").alias(kind))

    # Rules.

    def first(self) -> list[DataFrame]:
        """What the schema alone says: its closure, and the members of enumerated classes."""
        out = []
        for closed, p in ((self.sub_class, RDFS + "subClassOf"), (self.sub_property, RDFS + "subPropertyOf")):
            if closed is not None:
                out.append(self.linked(closed, "x", F.lit(p), "y"))
        if OWL + "oneOf" in self.present:
            out.append(self.typed(self.members(OWL + "oneOf"), "member", "x"))
        return out

    def apply(self, new: DataFrame, known: DataFrame, whole: bool) -> list[DataFrame]:
        """What follows; ``whole`` says that all known facts are new."""
        k, have = self.keys, self.present
        out = []
        if self.sub_class is not None:
            up = self.sub_class.select(*k, F.col("x").alias("o"), F.col("y").alias("up"))
            out.append(self.typed(new.where(F.col("p") == TYPE).join(up, [*k, "o"]), "s", "up"))
        if self.sub_property is not None:
            up = self.sub_property.select(*k, F.col("x").alias("p"), F.col("y").alias("up"))
            out.append(new.join(up, [*k, "p"]).select(*k, "s", F.col("up").alias("p"), "o", "o_kind", "o_dt", "o_lang"))
        for p, at in ((RDFS + "domain", "s"), (RDFS + "range", "o")):
            if p in have:
                of = self.pairs(p).select(*k, F.col("x").alias("p"), F.col("y").alias("class"))
                found = new.join(of, [*k, "p"])
                out.append(self.typed(found.where(is_node()) if at == "o" else found, at, "class"))
        if OWL + "inverseOf" in have:
            one = self.pairs(OWL + "inverseOf").select(*k, F.col("x").alias("p"), F.col("y").alias("q"))
            inverse = one.unionByName(one.select(*k, F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
            out.append(self.linked(new.where(is_node()).join(inverse, [*k, "p"]), "o", F.col("q"), "s"))
        if OWL + "SymmetricProperty" in have:
            out.append(self.linked(new.where(is_node()).join(self.marked("SymmetricProperty"), [*k, "p"]), "o", F.col("p"), "s"))
        if OWL + "TransitiveProperty" in have:
            out += self.steps(new, known, whole)
        for kind, shared, other in (("FunctionalProperty", "s", "o"), ("InverseFunctionalProperty", "o", "s")):
            if OWL + kind in have:
                of = lambda facts: facts.where(is_node()).join(self.marked(kind), [*k, "p"], "left_semi").select(*k, "p", F.col(shared).alias("of"), F.col(other).alias("x"))  # noqa: E731,B023
                facts = of(known) if whole else of(known).join(of(new).select(*k, "p", "of").distinct(), [*k, "p", "of"], "left_semi")
                out.append(self.least_of(facts, ["p", "of"], "x"))
        if OWL + "hasValue" in have:
            r = self.restrictions("hasValue")
            out.append(self.types(new, "s", "class").join(r, [*k, "class"]).select(*k, "s", "p", F.col("v").alias("o"), F.col("v_kind").alias("o_kind"), F.col("v_dt").alias("o_dt"), F.col("v_lang").alias("o_lang")))
            same = [F.col(f"o{x}") == F.col(f"v{x}") for x in ("", "_kind", "_dt", "_lang")]
            out.append(self.typed(new.join(r, [*k, "p"]).where(reduce(Column.__and__, same)), "s", "class"))
        if OWL + "someValuesFrom" in have:
            r = self.restrictions("someValuesFrom")
            out.append(self.typed(new.join(r.where(F.col("v") == THING), [*k, "p"]), "s", "class"))
            for a, b in self.sides(new, known, whole):
                out.append(self.typed(a.where(is_node()).join(r, [*k, "p"]).join(self.types(b, "o", "v"), [*k, "o", "v"], "left_semi"), "s", "class"))
        if OWL + "allValuesFrom" in have:
            r = self.restrictions("allValuesFrom")
            for a, b in self.sides(new, known, whole):
                out.append(self.typed(a.where(is_node()).join(r, [*k, "p"]).join(self.types(b, "s", "class"), [*k, "s", "class"], "left_semi"), "o", "v"))
        if OWL + "intersectionOf" in have:
            out.append(self.intersections(new, known, whole))
        if OWL + "propertyChainAxiom" in have:
            out += self.chains(new, known, whole)
        if OWL + "hasKey" in have:
            out.append(self.keyed(new, known, whole))
        if self.limited(1):
            out.append(self.single(new, known, whole))
        return out

    @staticmethod
    def sides(new: DataFrame, known: DataFrame, whole: bool) -> list[tuple[DataFrame, DataFrame]]:
        return [(new, known)] if whole else [(new, known), (known, new)]

    def steps(self, new: DataFrame, known: DataFrame, whole: bool) -> list[DataFrame]:
        k, out = self.keys, []
        marked = self.marked("TransitiveProperty")
        for left, right in self.sides(new, known, whole):
            a = left.where(is_node()).join(marked, [*k, "p"], "left_semi").select(*k, "p", "s", F.col("o").alias("m"))
            b = right.join(marked, [*k, "p"], "left_semi").select(*k, "p", F.col("s").alias("m"), "o", "o_kind", "o_dt", "o_lang")
            out.append(a.join(b, [*k, "p", "m"]).select(*k, *FACT))
        return out

    def intersections(self, new: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
        """What has every class of an intersection's list has the intersection."""
        k = self.keys
        of = self.members(OWL + "intersectionOf").select(*k, "head", F.col("x").alias("class"), "member").distinct()
        had = self.types(known, "s", "member").join(of, [*k, "member"])
        if not whole:
            had = had.join(self.types(new, "s", "member").join(of, [*k, "member"]).select(*k, "head", "class", "s").distinct(), [*k, "head", "class", "s"], "left_semi")
        full = had.groupBy(*k, "head", "class", "s").agg(F.count_distinct("member").alias("m"))
        wanted = of.groupBy(*k, "head", "class").agg(F.count_distinct("member").alias("wanted"))
        return self.typed(full.join(wanted, [*k, "head", "class"]).where("m = wanted"), "s", "class")

    def chains(self, new: DataFrame, known: DataFrame, whole: bool) -> list[DataFrame]:
        """Property chains of any length: from each new fact of a chain, known facts are joined on its left and on its right until the chain is whole.

        Where all facts are new, chains begin at their first property only.
        """
        k = self.keys
        chain = self.members(OWL + "propertyChainAxiom").select(*k, "head", F.col("x").alias("q"), "place", F.col("member").alias("p"), "n")
        longest = chain.agg(F.max("n")).head()[0] or 0
        begun = new.join(chain.where("place = 0") if whole else chain, [*k, "p"]).where(is_node() | (F.col("place") == F.col("n") - 1))
        rows = begun.select(*k, "head", "q", "n", F.col("place").alias("low"), F.col("place").alias("high"), "s", "o", "o_kind", "o_dt", "o_lang")
        for step, end, near, far in ((-1, "low", "s", "o"), (1, "high", "o", "s")):
            if whole and step < 0:
                continue
            open_ = F.col(end) != (F.lit(0) if step < 0 else F.col("n") - 1)
            link = chain.select(*k, "head", "q", F.col("place").alias("at"), "p")
            ends = known.where(is_node()) if step < 0 else known
            ends = ends.select(*k, "p", F.col(far).alias("m"), *([F.col("s").alias("to")] if step < 0 else [F.col(c).alias(f"to{c[1:]}") for c in FACT[2:]]))
            for _ in range(longest - 1):
                going = rows.where(open_).where(is_node() | F.lit(step < 0)).withColumn("at", F.col(end) + step).withColumnRenamed(near, "m")
                met = going.join(link, [*k, "head", "q", "at"]).join(ends, [*k, "p", "m"])
                if step < 0:
                    met = met.withColumn("low", F.col("at")).withColumnRenamed("to", "s")
                else:
                    met = met.drop("o_kind", "o_dt", "o_lang").withColumn("high", F.col("at")).select("*", *[F.col(f"to{c[1:]}").alias(c) for c in FACT[2:]])
                rows = rows.where(~open_).unionByName(met.select(*rows.columns))
        return [rows.where((F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).select(*k, "s", F.col("q").alias("p"), "o", "o_kind", "o_dt", "o_lang")]

    def keyed(self, new: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
        """Members of a class that agree in a value of each property of its key are equal."""
        k = self.keys
        of = self.members(OWL + "hasKey").select(*k, "head", F.col("x").alias("class"), "place", F.col("member").alias("p"), "n")
        longest = of.agg(F.max("n")).head()[0] or 0
        rows = self.types(known, "s", "class").join(of.select(*k, "head", "class", "n").distinct(), [*k, "class"]).withColumn("shared", F.lit("").cast("string"))
        value = F.sha2(F.concat_ws("\x00", "o_kind", "o_dt", "o_lang", "o"), 256)
        for at in range(longest):
            link = of.where(F.col("place") == at).select(*k, "head", "p")
            found = known.join(link, [*k, "p"]).select(*k, "head", "s", value.alias("value"))
            longer = rows.where(F.col("n") > at).join(found, [*k, "head", "s"]).withColumn("shared", F.concat("shared", "value")).drop("value")
            rows = rows.where(F.col("n") <= at).unionByName(longer)
        rows = rows.select(*k, "head", "class", "shared", "s").distinct()
        if not whole:
            touched = new.where(F.col("p") == TYPE).select(*k, "s").unionByName(new.join(of.select(*k, "p").distinct(), [*k, "p"], "left_semi").select(*k, "s")).distinct()
            rows = rows.join(rows.join(touched, [*k, "s"], "left_semi").select(*k, "head", "class", "shared").distinct(), [*k, "head", "class", "shared"], "left_semi")
        return self.least_of(rows, ["head", "class", "shared"], "s")

    def counted(self, known: DataFrame, n: int) -> DataFrame:
        """(keys..., class, p, of, s, o): the values that count against a limit of n."""
        k, limits = self.keys, self.at_most(n)
        facts = known.where(is_node()).join(limits, [*k, "p"]).join(self.types(known, "s", "class"), [*k, "s", "class"], "left_semi").select(*k, "class", "p", "of", "s", "o")
        if not self.limited(n, LIMITS[1:]):
            return facts
        any_ = facts.where(F.col("of") == THING)
        return any_.unionByName(facts.where(F.col("of") != THING).join(self.types(known, "o", "of"), [*k, "o", "of"], "left_semi").select(*k, "class", "p", "of", "s", "o"))

    def single(self, new: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
        """Where one value is allowed at most, all values are equal."""
        k, limits = self.keys, self.at_most(1)
        facts = self.counted(known, 1)
        if not whole:
            links = new.join(limits.select(*k, "p").distinct(), [*k, "p"], "left_semi")
            kinds = self.types(new, "s", "class")
            subject = kinds.join(limits.select(*k, "class").distinct(), [*k, "class"], "left_semi").select(*k, "s")
            value = kinds.withColumnRenamed("class", "of").join(limits.select(*k, "of").distinct(), [*k, "of"], "left_semi").select(*k, F.col("s").alias("o"))
            holders = facts.join(value.distinct(), [*k, "o"], "left_semi").select(*k, "s")
            facts = facts.join(links.select(*k, "s").unionByName(subject).unionByName(holders).distinct(), [*k, "s"], "left_semi")
        return self.least_of(facts, ["class", "p", "of", "s"], "o")

    # Contradictions.

    def contradictions(self, known: DataFrame) -> DataFrame:
        """(keys..., rule, s, detail) of canonical facts that can't be true together, by the profile's names of rules."""
        k, have = self.keys, self.present
        out = [self.types(known, "s", "detail").where(F.col("detail") == NOTHING).select(*k, F.lit("cls-nothing2").alias("rule"), "s", "detail")]
        say = lambda df, rule, s, detail: out.append(df.select(*k, F.lit(rule).alias("rule"), F.col(s).alias("s"), F.col(detail).alias("detail")).distinct())
        for p, rule in (("disjointWith", "cax-dw"), ("complementOf", "cls-com")):
            if OWL + p in have:
                pairs = self.pairs(OWL + p).withColumn("detail", F.concat_ws(" ", F.least("x", "y"), F.greatest("x", "y")))
                say(self.types(known, "s", "x").join(pairs, [*k, "x"]).join(self.types(known, "s", "y"), [*k, "s", "y"], "left_semi"), rule, "s", "detail")
        if OWL + "AllDisjointClasses" in have:
            of = self.all_of("AllDisjointClasses").join(self.members(OWL + "members"), [*k, "x"]).select(*k, "x", F.col("member").alias("class"))
            # Members of one list are counted for each thing, so no pairs of classes are made.
            say(self.types(known, "s", "class").join(of, [*k, "class"]).groupBy(*k, "x", "s").agg(F.count_distinct("class").alias("n")).where("n > 1"), "cax-adc", "s", "x")
        say(known.where((F.col("p") == OWL + "differentFrom") & is_node() & (F.col("s") == F.col("o"))), "eq-diff1", "s", "o")
        if OWL + "AllDifferent" in have:
            for p, rule in (("members", "eq-diff2"), ("distinctMembers", "eq-diff3")):
                if OWL + p in have:
                    of = self.all_of("AllDifferent").join(self.members(OWL + p), [*k, "x"])
                    say(of.groupBy(*k, "x", "member").agg(F.count_distinct("head", "place").alias("n")).where("n > 1"), rule, "member", "x")
        if OWL + "propertyDisjointWith" in have:
            pairs = self.pairs(OWL + "propertyDisjointWith").select(*k, F.col("x").alias("p"), F.col("y").alias("q"))
            other = known.withColumnRenamed("p", "q")
            say(known.join(pairs, [*k, "p"]).join(other, [*k, "s", "q", "o", "o_kind", "o_dt", "o_lang"], "left_semi").withColumn("detail", F.concat_ws(" ", F.least("p", "q"), F.greatest("p", "q"))), "prp-pdw", "s", "detail")
        if OWL + "IrreflexiveProperty" in have:
            say(known.where(is_node() & (F.col("s") == F.col("o"))).join(self.marked("IrreflexiveProperty"), [*k, "p"], "left_semi"), "prp-irp", "s", "p")
        if OWL + "AsymmetricProperty" in have:
            own = known.where(is_node()).join(self.marked("AsymmetricProperty"), [*k, "p"], "left_semi")
            say(own.join(own.select(*k, "p", F.col("o").alias("s"), F.col("s").alias("o")), [*k, "p", "s", "o"], "left_semi"), "prp-asyp", "s", "p")
        if self.limited(0):
            say(self.counted(known, 0), "cls-maxc1", "s", "class")
        if OWL + "sourceIndividual" in have:
            parts = {name: self.schema.where(F.col("p") == OWL + p).select(*k, F.col("s").alias("x"), F.col("o").alias(name)) for name, p in (("s", "sourceIndividual"), ("p", "assertionProperty"))}
            target = self.schema.where(F.col("p").isin(OWL + "targetIndividual", OWL + "targetValue")).select(*k, F.col("s").alias("x"), "o", "o_kind", "o_dt", "o_lang")
            denied = parts["s"].join(parts["p"], [*k, "x"]).join(target, [*k, "x"])
            say(denied.join(known, [*k, *FACT], "left_semi"), "prp-npa1", "s", "p")
        return reduce(DataFrame.unionByName, out).distinct()

    def all_of(self, kind: str) -> DataFrame:
        return self.marked(kind).select(*self.keys, F.col("p").alias("x"))
