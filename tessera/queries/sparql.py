"""SPARQL over the tables: name -> (query, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .mapping import EX, GRAPHS, ask

N = f"'{EX}nation/'"
R = f"'{EX}region/'"
C = f"'{EX}customer/'"
S = f"'{EX}supplier/'"
P = f"'{EX}part/'"
O = f"'{EX}order/'"  # noqa: E741
DT = "'http://www.w3.org/2001/XMLSchema#"


def g(table: str) -> str:
    return f"'{GRAPHS[table]}'"


CATALOGUE: dict[str, tuple[str, str]] = {
    "flagship": (
        "SELECT ?rn (COUNT(*) AS ?n) (ROUND(SUM(?price)) AS ?total) WHERE { ?o ex:customer ?c ; ex:totalPrice ?price . ?c ex:nation ?n0 . ?n0 ex:region ?r . ?r ex:name ?rn } GROUP BY ?rn",
        "SELECT r_name AS rn, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "bgp_single": ("SELECT ?n ?name WHERE { ?n a ex:Nation ; ex:name ?name }", f"SELECT concat({N}, n_nationkey) AS n, n_name AS name FROM nation"),
    "bgp_chain": (
        "SELECT ?o ?name WHERE { ?o ex:customer ?c . ?c ex:nation ?n . ?n ex:region ?r . ?r ex:name ?name . FILTER(?price > 300000) ?o ex:totalPrice ?price }",
        f"SELECT concat({O}, o_orderkey) AS o, r_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000",
    ),
    "bgp_star": (
        "SELECT ?p ?name ?brand ?size WHERE { ?p ex:name ?name ; ex:brand ?brand , ?b2 ; ex:size ?size ; ex:partType ?t }",
        f"SELECT concat({P}, p_partkey) AS p, p_name AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part",
    ),
    "bgp_repeated_var": (
        "SELECT ?n (COUNT(*) AS ?pairs) WHERE { ?x a ex:Supplier ; ex:nation ?n . ?y a ex:Customer ; ex:nation ?n } GROUP BY ?n",
        f"SELECT concat({N}, s_nationkey) AS n, count(*) AS pairs FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1",
    ),
    "bgp_constant": ("SELECT ?c ?name WHERE { ?c ex:nation <http://example.org/nation/7> ; ex:name ?name ; ex:segment \"BUILDING\" }", f"SELECT concat({C}, c_custkey) AS c, c_name AS name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'"),
    "bgp_variable_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { GRAPH <http://example.org/graphs/source/supplier> { ?s ?p ?o } } GROUP BY ?p",
        f"SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{EX}name', '{EX}nation', '{EX}balance']) AS p, (SELECT count(*) FROM supplier) AS n",
    ),
    "filter_cmp": ("SELECT ?o ?t WHERE { ?o ex:totalPrice ?t FILTER(?t >= 100000 && ?t < 120000) }", f"SELECT concat({O}, o_orderkey) AS o, o_totalprice AS t FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000"),
    "filter_bool": ("SELECT ?p WHERE { ?p ex:size ?s ; ex:brand ?b FILTER(!(?s > 10) || ?b = \"Brand#11\" && ?s != 20) }", f"SELECT concat({P}, p_partkey) AS p FROM part WHERE NOT p_size > 10 OR p_brand = 'Brand#11' AND p_size <> 20"),
    "filter_strstarts": ("SELECT ?d WHERE { ?d a ex:Document ; ex:text ?t FILTER(STRSTARTS(STR(?t), \"The\")) }", f"SELECT concat('{EX}document/', doc_id) AS d FROM documents WHERE starts_with(text, 'The')"),
    "filter_contains_lcase": ("SELECT ?d WHERE { ?d ex:language ?l ; ex:text ?t FILTER(CONTAINS(LCASE(?t), \"worthless\")) }", f"SELECT concat('{EX}document/', doc_id) AS d FROM documents WHERE contains(lower(text), 'worthless')"),
    "filter_regex": ("SELECT ?c ?n WHERE { ?c a ex:Customer ; ex:name ?n FILTER(REGEX(?n, \"0{3}[1-3]7$\", \"i\")) }", f"SELECT concat({C}, c_custkey) AS c, c_name AS n FROM customer WHERE regexp_matches(c_name, '0{{3}}[1-3]7$', 'i')"),
    "filter_in": ("SELECT ?e ?t WHERE { ?e ex:eventType ?t FILTER(?t IN (\"signup\", \"error\")) }", f"SELECT concat('{EX}event/', event_id) AS e, event_type AS t FROM events WHERE event_type IN ('signup', 'error')"),
    "filter_not_in": ("SELECT ?t (COUNT(?e) AS ?n) WHERE { ?e ex:eventType ?t FILTER(?t NOT IN (\"signup\", \"error\")) } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'error') GROUP BY 1"),
    "optional_left": (
        "SELECT ?n ?s WHERE { ?n a ex:Nation OPTIONAL { ?s a ex:Supplier ; ex:nation ?n ; ex:balance ?b FILTER(?b > 9000) } }",
        f"SELECT concat({N}, n_nationkey) AS n, {S} || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000",
    ),
    "optional_filter_inside": (
        "SELECT ?c ?o WHERE { ?c a ex:Customer ; ex:balance ?b OPTIONAL { ?o ex:customer ?c ; ex:totalPrice ?t FILTER(?t > 40 * ?b) } }",
        f"SELECT concat({C}, c_custkey) AS c, {O} || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal",
    ),
    "optional_bound": (
        "SELECT ?n WHERE { ?n a ex:Nation OPTIONAL { ?s a ex:Supplier ; ex:nation ?n ; ex:balance ?b FILTER(?b > 9000) } FILTER(!BOUND(?s)) }",
        f"SELECT concat({N}, n_nationkey) AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
    ),
    "optional_then_join": (
        "SELECT ?n ?r ?x WHERE { ?n a ex:Nation OPTIONAL { ?n ex:region ?r FILTER(?r = ex:none || ?n IN (<http://example.org/nation/3>, <http://example.org/nation/5>)) } ?r a ex:Region ; ex:name ?x }",
        f"SELECT concat({N}, n_nationkey) AS n, concat({R}, r_regionkey) AS r, r_name AS x FROM nation, region WHERE n_nationkey NOT IN (3, 5) OR n_regionkey = r_regionkey",
    ),
    "union_two": ("SELECT ?x ?n WHERE { { ?x a ex:Supplier } UNION { ?x a ex:Customer } ?x ex:nation ?n }", f"SELECT concat({S}, s_suppkey) AS x, concat({N}, s_nationkey) AS n FROM supplier UNION ALL SELECT concat({C}, c_custkey), concat({N}, c_nationkey) FROM customer"),
    "union_hetero": ("SELECT ?x ?seg ?size WHERE { { ?x ex:segment ?seg } UNION { ?x ex:size ?size } }", f"SELECT concat({C}, c_custkey) AS x, c_mktsegment AS seg, NULL::BIGINT AS size FROM customer UNION ALL SELECT concat({P}, p_partkey), NULL, p_size FROM part"),
    "graph_named": ("SELECT ?s ?n WHERE { GRAPH <http://example.org/graphs/source/nation> { ?s ex:name ?n } }", f"SELECT concat({N}, n_nationkey) AS s, n_name AS n FROM nation"),
    "graph_var": ("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ex:name ?o } } GROUP BY ?g", " UNION ALL ".join(f"SELECT {g(t)} AS g, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part"))),
    "graph_default_union": ("SELECT (COUNT(*) AS ?n) WHERE { ?s ex:nation ?o }", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"),
    "from_graph": ("SELECT (COUNT(*) AS ?n) FROM <http://example.org/graphs/source/supplier> WHERE { ?s ex:nation ?o }", "SELECT count(*) AS n FROM supplier"),
    "distinct_classes": ("SELECT DISTINCT ?c WHERE { ?s a ?c }", f"SELECT '{EX}' || unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order', 'Event', 'Document', 'Page']) AS c"),
    "distinct_values": ("SELECT DISTINCT ?b ?t WHERE { ?p ex:brand ?b ; ex:partType ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "order_limit": ("SELECT ?o ?t WHERE { ?o ex:totalPrice ?t } ORDER BY DESC(?t) ?o LIMIT 10", f"SELECT concat({O}, o_orderkey) AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 10"),
    "order_desc_offset": ("SELECT ?c ?b WHERE { ?c a ex:Customer ; ex:balance ?b } ORDER BY DESC(?b) ?c OFFSET 20 LIMIT 15", f"SELECT concat({C}, c_custkey) AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, 1 LIMIT 15 OFFSET 20"),
    "construct_flip": (
        "CONSTRUCT { ?n ex:hasSupplier ?s } WHERE { ?s a ex:Supplier ; ex:nation ?n }",
        f"SELECT concat({N}, s_nationkey) AS s, 'iri' AS s_kind, '{EX}hasSupplier' AS p, concat({S}, s_suppkey) AS o, 'iri' AS o_kind, '' AS o_dt, '' AS o_lang FROM supplier",
    ),
    "construct_multi": (
        "CONSTRUCT { ?r ex:contains ?n . ?n ex:label ?x } WHERE { ?n ex:region ?r ; ex:name ?x }",
        f"SELECT DISTINCT concat({R}, n_regionkey) AS s, 'iri' AS s_kind, '{EX}contains' AS p, concat({N}, n_nationkey) AS o, 'iri' AS o_kind, '' AS o_dt, '' AS o_lang FROM nation "
        f"UNION SELECT concat({N}, n_nationkey), 'iri', '{EX}label', n_name, 'literal', {DT}string', '' FROM nation",
    ),
    "construct_where": ("CONSTRUCT WHERE { ?n ex:region ?r }", f"SELECT concat({N}, n_nationkey) AS s, 'iri' AS s_kind, '{EX}region' AS p, concat({R}, n_regionkey) AS o, 'iri' AS o_kind, '' AS o_dt, '' AS o_lang FROM nation"),
    "ask_true": ("ASK { ?c ex:segment \"BUILDING\" ; ex:balance ?b FILTER(?b > 9900) }", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9900) AS ask"),
    "ask_false": ("ASK { ?c ex:segment \"NOWHERE\" }", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'NOWHERE') AS ask"),
    "describe_entity": (
        "DESCRIBE <http://example.org/nation/4>",
        f"SELECT concat({N}, n_nationkey) AS s, 'iri' AS s_kind, p, o, o_kind, o_dt, '' AS o_lang FROM nation, LATERAL (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{EX}Nation', 'iri', ''), ('{EX}name', n_name, 'literal', {DT}string'), ('{EX}region', concat({R}, n_regionkey), 'iri', '')) v(p, o, o_kind, o_dt) WHERE n_nationkey = 4",
    ),
    "describe_where": (
        "DESCRIBE ?r WHERE { ?n ex:region ?r . FILTER(?n = <http://example.org/nation/4>) }",
        f"SELECT concat({R}, r_regionkey) AS s, 'iri' AS s_kind, p, o, o_kind, o_dt, '' AS o_lang FROM region, LATERAL (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{EX}Region', 'iri', ''), ('{EX}name', r_name, 'literal', {DT}string')) v(p, o, o_kind, o_dt) WHERE r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 4)",
    ),
    "minus": ("SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:customer ?c ; ex:totalPrice ?t FILTER(?t > 200000) } }", f"SELECT concat({C}, c_custkey) AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "minus_disjoint": ("SELECT ?r WHERE { ?r a ex:Region MINUS { ?x a ex:Nation } }", f"SELECT concat({R}, r_regionkey) AS r FROM region"),
    "exists": ("SELECT ?c WHERE { ?c a ex:Customer FILTER EXISTS { ?o ex:customer ?c ; ex:status \"F\" } }", f"SELECT concat({C}, c_custkey) AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "not_exists": ("SELECT ?c WHERE { ?c a ex:Customer ; ex:balance ?b FILTER NOT EXISTS { ?o ex:customer ?c ; ex:totalPrice ?t FILTER(?t > 50 * ?b) } }", f"SELECT concat({C}, c_custkey) AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50 * c_acctbal)"),
    "exists_nested": ("SELECT ?c WHERE { ?c a ex:Customer ; ex:balance ?b FILTER(?b > 9000 || EXISTS { ?o ex:customer ?c ; ex:priority \"1-URGENT\" }) }", f"SELECT concat({C}, c_custkey) AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "bind_expr": ("SELECT ?p ?double WHERE { ?p ex:size ?s BIND(?s * 2 + 1 AS ?double) }", f"SELECT concat({P}, p_partkey) AS p, CAST(p_size * 2 + 1 AS BIGINT) AS double FROM part"),
    "select_expr": ("SELECT (UCASE(?n) AS ?u) (?b / 2 AS ?half) WHERE { ?s a ex:Supplier ; ex:name ?n ; ex:balance ?b }", "SELECT upper(s_name) AS u, s_acctbal / 2 AS half FROM supplier"),
    "values_join": ("SELECT ?c ?w WHERE { VALUES (?seg ?w) { (\"BUILDING\" 1) (\"MACHINERY\" 2) } ?c ex:segment ?seg }", f"SELECT concat({C}, c_custkey) AS c, CAST(w AS BIGINT) AS w FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(seg, w) ON seg = c_mktsegment"),
    "values_undef": ("SELECT ?n ?r WHERE { ?n a ex:Nation ; ex:region ?r VALUES (?n ?r) { (<http://example.org/nation/2> UNDEF) (UNDEF <http://example.org/region/1>) } }", f"SELECT concat({N}, n_nationkey) AS n, concat({R}, n_regionkey) AS r FROM nation WHERE n_nationkey = 2 UNION ALL SELECT concat({N}, n_nationkey), concat({R}, n_regionkey) FROM nation WHERE n_regionkey = 1"),
    "subselect": ("SELECT ?name ?top WHERE { { SELECT ?c (MAX(?t) AS ?top) WHERE { ?o ex:customer ?c ; ex:totalPrice ?t } GROUP BY ?c } ?c ex:name ?name FILTER(?top > 400000) }", "SELECT c_name AS name, top FROM (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey WHERE top > 400000"),
    "agg_count_sum_avg": ("SELECT ?b (COUNT(?p) AS ?n) (SUM(?s) AS ?sizes) (AVG(?s) AS ?mean) WHERE { ?p ex:brand ?b ; ex:size ?s } GROUP BY ?b", "SELECT p_brand AS b, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes, avg(p_size) AS mean FROM part GROUP BY 1"),
    "agg_having": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?o ex:customer ?c } GROUP BY ?c HAVING(COUNT(*) > 15)", f"SELECT concat({C}, o_custkey) AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "agg_distinct": ("SELECT ?st (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o ex:customer ?c ; ex:status ?st } GROUP BY ?st", "SELECT o_orderstatus AS st, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "agg_group_concat": ("SELECT ?r (GROUP_CONCAT(?x ; SEPARATOR=\", \") AS ?names) WHERE { ?n ex:region ?r ; ex:name ?x } GROUP BY ?r", f"SELECT concat({R}, n_regionkey) AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "agg_min_max_sample": ("SELECT ?t (MIN(?p) AS ?least) (MAX(?p) AS ?most) (SAMPLE(?b) AS ?brand) WHERE { ?x ex:partType ?t ; ex:retailPrice ?p ; ex:brand ?b } GROUP BY ?t", "SELECT p_type AS t, min(p_retailprice) AS least, max(p_retailprice) AS most, min(p_brand) AS brand FROM part GROUP BY 1"),
    "agg_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?t) WHERE { ?p ex:size ?s FILTER(?s < 0) }", "SELECT count(*) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS t FROM part WHERE p_size < 0"),
    "agg_expression": ("SELECT ?st (ROUND(100 * SUM(?t) / COUNT(*)) / 100 AS ?mean) WHERE { ?o ex:status ?st ; ex:totalPrice ?t } GROUP BY ?st ORDER BY DESC(COUNT(*))", "SELECT o_orderstatus AS st, floor(100 * sum(o_totalprice) / count(*) + 0.5) / 100 AS mean FROM orders GROUP BY 1"),
    "group_by_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o ex:date ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "builtin_string": (
        "SELECT ?s (STRLEN(?n) AS ?l) (SUBSTR(?n, 3, 4) AS ?sub) (STRBEFORE(?n, \"#\") AS ?before) (STRAFTER(?n, \"#\") AS ?after) (CONCAT(LCASE(?n), \"-x\") AS ?cat) (REPLACE(?n, \"[0-9]\", \"d\") AS ?rep) (STRENDS(?n, \"7\") AS ?ends) (ENCODE_FOR_URI(?n) AS ?enc) WHERE { ?s a ex:Supplier ; ex:name ?n }",
        f"SELECT concat({S}, s_suppkey) AS s, length(s_name) AS l, substr(s_name, 3, 4) AS sub, CASE WHEN contains(s_name, '#') THEN split_part(s_name, '#', 1) ELSE '' END AS before, CASE WHEN contains(s_name, '#') THEN substr(s_name, instr(s_name, '#') + 1) ELSE '' END AS after, concat(lower(s_name), '-x') AS cat, regexp_replace(s_name, '[0-9]', 'd', 'g') AS rep, ends_with(s_name, '7') AS ends, url_encode(s_name) AS enc FROM supplier",
    ),
    "builtin_numeric": (
        "SELECT ?s (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (-?b AS ?neg) (?b / 0 AS ?none) WHERE { ?s a ex:Supplier ; ex:balance ?b }",
        f"SELECT concat({S}, s_suppkey) AS s, abs(s_acctbal) AS a, floor(s_acctbal + 0.5) AS r, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, -s_acctbal AS neg, NULL::DOUBLE AS none FROM supplier",
    ),
    "builtin_date": ("SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?day) (HOURS(?d) AS ?h) WHERE { ?o ex:date ?d FILTER(?d < \"1993-01-01T00:00:00\"^^xsd:dateTime) }", f"SELECT concat({O}, o_orderkey) AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS day, hour(o_orderdate) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'"),
    "builtin_hash": ("SELECT ?n (MD5(?x) AS ?m) (SHA1(?x) AS ?s1) (SHA256(?x) AS ?s2) WHERE { ?n a ex:Nation ; ex:name ?x }", f"SELECT concat({N}, n_nationkey) AS n, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation"),
    "builtin_cond": ("SELECT ?p (IF(?s > 25, \"large\", \"small\") AS ?c) (COALESCE(?nothing, ?s) AS ?v) (BOUND(?nothing) AS ?b) WHERE { ?p ex:size ?s }", f"SELECT concat({P}, p_partkey) AS p, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS c, CAST(p_size AS VARCHAR) AS v, false AS b FROM part"),
    "builtin_cast": ("SELECT ?p (xsd:string(?s) AS ?t) (xsd:double(?s) AS ?d) (xsd:integer(?price) AS ?i) (xsd:integer(?n) AS ?none) WHERE { ?p ex:size ?s ; ex:retailPrice ?price ; ex:brand ?n }", f"SELECT concat({P}, p_partkey) AS p, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS d, CAST(trunc(p_retailprice) AS BIGINT) AS i, NULL::BIGINT AS none FROM part"),
    "builtin_terms": (
        "SELECT ?n (isIRI(?n) AS ?i) (isLITERAL(?x) AS ?l) (isNUMERIC(?x) AS ?u) (DATATYPE(?x) AS ?d) (STR(?r) AS ?rs) (sameTerm(?n, ?n) AS ?same) WHERE { ?n ex:region ?r ; ex:name ?x }",
        f"SELECT concat({N}, n_nationkey) AS n, true AS i, true AS l, false AS u, {DT}string' AS d, concat({R}, n_regionkey) AS rs, true AS same FROM nation",
    ),
    "path_seq_inv": ("SELECT ?c ?name WHERE { ?c a ex:Customer ; ex:nation/ex:region/ex:name ?name . ?r ^ex:region/ex:name ?x . ?r ex:name ?name FILTER(?x = \"NATION_3\") }", f"SELECT concat({C}, c_custkey) AS c, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = r_regionkey AND m.n_name = 'NATION_3')"),
    "path_alt": ("SELECT ?x ?y WHERE { ?x ex:nation|ex:region ?y }", f"SELECT concat({C}, c_custkey) AS x, concat({N}, c_nationkey) AS y FROM customer UNION ALL SELECT concat({S}, s_suppkey), concat({N}, s_nationkey) FROM supplier UNION ALL SELECT concat({N}, n_nationkey), concat({R}, n_regionkey) FROM nation"),
    "path_plus": ("SELECT ?x ?y WHERE { ?x a ex:Supplier . ?x (ex:nation|ex:region)+ ?y }", f"SELECT concat({S}, s_suppkey) AS x, concat({N}, s_nationkey) AS y FROM supplier UNION ALL SELECT concat({S}, s_suppkey), concat({R}, n_regionkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_star": ("SELECT ?y WHERE { <http://example.org/nation/6> ex:region* ?y }", f"SELECT concat({N}, 6) AS y UNION ALL SELECT concat({R}, n_regionkey) FROM nation WHERE n_nationkey = 6"),
    "path_optional": ("SELECT ?x WHERE { ?x ex:region? <http://example.org/region/2> }", f"SELECT concat({R}, 2) AS x UNION ALL SELECT concat({N}, n_nationkey) FROM nation WHERE n_regionkey = 2"),
    "path_negated": ("SELECT ?y WHERE { <http://example.org/nation/6> !(ex:name|rdf:type) ?y }", f"SELECT concat({R}, n_regionkey) AS y FROM nation WHERE n_nationkey = 6"),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ask(spark, sf_dir, CATALOGUE[name][0]).df


QUERIES = {name: query(name) for name in CATALOGUE}
ORACLES = {name: sql for name, (_, sql) in CATALOGUE.items()}
