"""Inference by lists, keys, cardinality and equality, contradictions, and shapes on nested and typed values: over orders and customers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, shacl
from ..operators.rules import SAME
from ..plans.algebra import TYPE, XSD
from .graphs import all_of, facts, gapped_orders, key, nation_facts, schema_quads
from .mapping import EX, table


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return facts(o, key("order/", "o_orderkey"), EX + "customer", key("customer/", "o_custkey"))


def customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return facts(c, key("customer/", "c_custkey"), EX + "nation", key("nation/", "c_nationkey"))


def closed(spark: SparkSession, tbox: str, *data: DataFrame) -> inference.Closure:
    return inference.Closure(all_of(*data, schema_quads(spark, tbox)).drop("g"))


def infer_sameas_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand orders of a batch are one thing, as their batch is an inverse functional property: each has every status of its batch."""
    o = table(spark, sf_dir, "orders")
    me = key("order/", "o_orderkey")
    batch = facts(o, me, EX + "batch", F.concat(F.lit("batch/"), F.floor(F.col("o_orderkey") / 1000).cast("string")))
    status = facts(o, me, EX + "status", F.col("o_orderstatus"), "literal", XSD + "string")
    found = closed(spark, "ex:batch a owl:InverseFunctionalProperty .", batch, status).expanded()
    return found.where(F.col("p") == EX + "status").select("s", "o")


def infer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders lead to regions by their customers and nations; orders of one region's name by two chains of their own."""
    tbox = "ex:orderRegion owl:propertyChainAxiom ( ex:customer ex:nation ex:region ) . ex:orderNation owl:propertyChainAxiom ( ex:customer ex:nation ) . ex:inRegion owl:propertyChainAxiom ( ex:orderNation ex:region ) ."
    found = closed(spark, tbox, order_customers(spark, sf_dir), customer_nations(spark, sf_dir), nation_facts(spark, sf_dir)).expanded()
    return found.where(F.col("p").isin(EX + "orderRegion", EX + "inRegion")).select("s", "p", "o")


def infer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the same nation and segment are the same, as these are their key."""
    c = table(spark, sf_dir, "customer")
    me = key("customer/", "c_custkey")
    segment = facts(c, me, EX + "segment", F.col("c_mktsegment"), "literal", XSD + "string")
    found = closed(spark, "ex:Customer owl:hasKey ( ex:nation ex:segment ) .", facts(c, me, TYPE, F.lit("Customer")), customer_nations(spark, sf_dir), segment).expanded()
    return found.where(F.col("p") == SAME).select("s", "o")


def infer_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single orders have one customer at most, so a second name of it is the same customer's."""
    o = table(spark, sf_dir, "orders")
    me = key("order/", "o_orderkey")
    some = o.where("o_orderkey % 13 = 0")
    data = [order_customers(spark, sf_dir), facts(some, me, EX + "customer", key("twin/", "o_custkey")), facts(some, me, TYPE, F.lit("Single"))]
    found = closed(spark, "ex:Single owl:onProperty ex:customer ; owl:maxCardinality 1 .", *data).expanded()
    return found.where(F.col("p") == SAME).select("s", "o")


def contradictory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of several disjoint states, orders before themselves, and paid orders with a claim, which they may not have."""
    o = table(spark, sf_dir, "orders")
    me = key("order/", "o_orderkey")
    tbox = """ex:states a owl:AllDisjointClasses ; owl:members ( ex:StateO ex:StateF ex:StateP ) . ex:before a owl:IrreflexiveProperty , owl:TransitiveProperty .
        ex:Closed owl:equivalentClass ex:StateF . ex:Closed owl:onProperty ex:claim ; owl:maxCardinality 0 ."""
    following = F.concat(F.lit("order/"), F.when(F.col("o_orderkey") % 100 == 99, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey") + 1).cast("string"))
    data = [
        facts(o, me, TYPE, F.concat(F.lit("State"), "o_orderstatus")),
        facts(o.where("o_orderkey % 17 = 0"), me, TYPE, F.lit("StateO")),
        facts(o.where("o_orderkey % 100 > 97"), me, EX + "before", following),
        facts(o.where("o_orderkey % 19 = 0"), me, EX + "claim", key("claim/", "o_orderkey")),
    ]
    return closed(spark, tbox, *data).inconsistencies()


def address_shape(inner: str) -> str:
    return f"ex:OrderShape a sh:NodeShape ; sh:targetClass ex:Order ; sh:node ex:Known . ex:Known a sh:NodeShape ; sh:property [ sh:path ex:customer ; {inner} ] ."


def shacl_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a shape of shapes rejects, as a customer of theirs has no name or a balance below zero."""
    c = table(spark, sf_dir, "customer")
    me = key("customer/", "c_custkey")
    data = [gapped_orders(spark, sf_dir), facts(c.where("c_custkey % 3 <> 0"), me, EX + "name", F.col("c_name"), "literal", XSD + "string"), facts(c, me, EX + "balance", F.col("c_acctbal"), "literal", XSD + "double")]
    shapes = schema_quads(spark, address_shape("sh:property [ sh:path ex:name ; sh:minCount 1 ] , [ sh:path ex:balance ; sh:minInclusive 0 ]"))
    return shacl.validate(all_of(*data), shapes).select("focus", "component", "value")


def shacl_in_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status that is a string, an IRI or a number of the same text: only the string is allowed. Whole numbers must look like some."""
    o = table(spark, sf_dir, "orders")
    me, number = key("order/", "o_orderkey"), F.col("o_orderkey")
    state = (number % 3).cast("string")
    data = [
        facts(o, me, TYPE, F.lit("Order")),
        facts(o.where("o_orderkey % 5 = 0"), me, EX + "state", state, "literal", XSD + "string"),
        facts(o.where("o_orderkey % 5 = 1"), me, EX + "state", state, "literal", XSD + "integer"),
        facts(o, me, EX + "amount", F.when(number % 7 == 0, F.concat(number.cast("string"), F.lit(".5"))).otherwise(number.cast("string")), "literal", XSD + "integer"),
    ]
    shape = 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:state ; sh:in ( "0" "1" ) ] , [ sh:path ex:state ; sh:hasValue "1" ; sh:maxCount 1 ] , [ sh:path ex:amount ; sh:datatype xsd:integer ] .'
    return shacl.validate(all_of(*data), schema_quads(spark, shape)).select("focus", "component", "value")


def customer_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph per customer: it, and the orders that name it."""
    o = table(spark, sf_dir, "orders")
    me = key("order/", "o_orderkey")
    parts = [facts(o, me, TYPE, F.lit("Order")), facts(o, me, EX + "status", F.col("o_orderstatus"), "literal", XSD + "string"), facts(o.where("o_orderkey % 11 <> 0"), me, EX + "customer", key("customer/", "o_custkey"))]
    of = o.select(F.concat(F.lit(EX), me).alias("s"), key("doc/", "o_custkey").alias("doc"))
    return all_of(*parts).join(of, "s").withColumn("g", F.col("doc")).drop("doc")


SHAPE = "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:customer ; sh:minCount 1 ] , [ sh:path ex:status ; sh:in ( \"O\" \"F\" ) ] ."


def shacl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's graph validated by itself, in one run."""
    return shacl.validate_documents(customer_graphs(spark, sf_dir), schema_quads(spark, SHAPE)).select("g", "focus", "component", "value")


def shacl_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of one customer's graph alone, with all other graphs as what they may refer to."""
    quads = customer_graphs(spark, sf_dir)
    names = facts(table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), key("customer/", "c_custkey"), EX + "name", F.col("c_name"), "literal", XSD + "string", graph="names")
    shape = SHAPE + " ex:T a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ( ex:customer ex:name ) ; sh:minCount 1 ; sh:message \"no name\" ] ."
    return shacl.validate(all_of(quads, names), schema_quads(spark, shape), within=quads.where(F.col("g") == "doc/7")).select("focus", "component", "value", "message")


O = f"concat('{EX}order/', o_orderkey)"
C = f"concat('{EX}customer/', c_custkey)"
BAD = "o_orderstatus NOT IN ('O', 'F')"

ROWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "infer_sameas_orders": (infer_sameas_orders, f"SELECT {O} AS s, state AS o FROM orders JOIN (SELECT DISTINCT o_orderkey // 1000 AS batch, o_orderstatus AS state FROM orders) b ON b.batch = o_orderkey // 1000"),
    "infer_chain": (infer_chain, f"SELECT {O} AS s, '{EX}' || unnest(['orderRegion', 'inRegion']) AS p, concat('{EX}region/', n_regionkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "infer_key": (infer_key, f"SELECT concat('{EX}customer/', a.c_custkey) AS s, concat('{EX}customer/', b.c_custkey) AS o FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey"),
    "infer_cardinality": (
        infer_cardinality,
        f"WITH t AS (SELECT DISTINCT concat('{EX}customer/', o_custkey) AS a, concat('{EX}twin/', o_custkey) AS b FROM orders WHERE o_orderkey % 13 = 0) SELECT a AS s, b AS o FROM t UNION ALL SELECT b, a FROM t",
    ),
    "inconsistencies": (
        contradictory,
        f"""SELECT 'cax-adc' AS rule, {O} AS s, '{EX}states' AS detail FROM orders WHERE o_orderkey % 17 = 0 AND o_orderstatus <> 'O'
        UNION ALL SELECT 'cls-maxc1', {O}, '{EX}Closed' FROM orders WHERE o_orderkey % 19 = 0 AND o_orderstatus = 'F'
        UNION ALL SELECT 'prp-irp', {O}, '{EX}before' FROM orders o WHERE o_orderkey % 100 > 97 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey + CASE WHEN o.o_orderkey % 100 = 99 THEN -1 ELSE 1 END)""",
    ),
    "shacl_nested": (
        shacl_nested,
        f"""WITH bad AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_acctbal < 0)
        SELECT DISTINCT {O} AS focus, 'node' AS component, {O} AS value FROM orders WHERE (o_orderkey % 11 <> 0 AND (o_custkey IN (FROM bad) OR o_custkey NOT IN (SELECT c_custkey FROM customer))) OR o_orderkey % 13 = 0""",
    ),
    "shacl_in_typed": (
        shacl_in_typed,
        f"""SELECT {O} AS focus, 'in' AS component, CAST(o_orderkey % 3 AS VARCHAR) AS value FROM orders WHERE (o_orderkey % 5 = 0 AND o_orderkey % 3 = 2) OR o_orderkey % 5 = 1
        UNION ALL SELECT {O}, 'hasValue', NULL FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 3 = 1)
        UNION ALL SELECT {O}, 'datatype', o_orderkey || '.5' FROM orders WHERE o_orderkey % 7 = 0""",
    ),
    "shacl_documents": (
        shacl_documents,
        f"SELECT concat('doc/', o_custkey) AS g, {O} AS focus, 'minCount' AS component, NULL::VARCHAR AS value FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT concat('doc/', o_custkey), {O}, 'in', o_orderstatus FROM orders WHERE {BAD}",
    ),
    "shacl_document": (
        shacl_document,
        f"""SELECT {O} AS focus, 'minCount' AS component, NULL::VARCHAR AS value, '' AS message FROM orders WHERE o_custkey = 7 AND o_orderkey % 11 = 0 UNION ALL SELECT {O}, 'in', o_orderstatus, '' FROM orders WHERE o_custkey = 7 AND {BAD}
        UNION ALL SELECT {O}, 'minCount', NULL, 'no name' FROM orders WHERE o_custkey = 7""",
    ),
}

QUERIES = {name: run for name, (run, _) in ROWS.items()}
ORACLES = {name: sql for name, (_, sql) in ROWS.items()}
