"""Identity, merges and propagation (survey 2.7, 2.8, 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import confidence as conf
from tidemark.functions import text as tx
from tidemark.operators import graph, identity
from tidemark.operators.propagate import propagate
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

def _names(t: Tables) -> DataFrame:
    """The distinct names, each with the smallest key that bears it."""
    return t.read("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


_NAMES = ", nm AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name), tok AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s,.\\-_/]+'), lambda x: length(x) > 1))) AS w FROM nm)"


_KINDS = """, nm AS (SELECT p_name || ' ' || p_type AS name, min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT p_name || ' ' || p_type || ' ' || p_brand, min(p_partkey) + 1000000000 FROM part GROUP BY 1),
tok AS (SELECT id, list_distinct(list_filter(string_split(lower(name), ' '), lambda x: length(x) > 1)) AS w FROM nm)"""


def _long_names(t: Tables, kept: str = "true") -> DataFrame:
    p = t.read("part").filter(kept)
    short = p.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    return short.unionByName(p.groupBy(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")).agg((F.min("p_partkey") + 1000000000).alias("id")))


@query(_KINDS + "SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS jaccard FROM tok a JOIN tok b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 2 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.67")
def similar_names(t: Tables) -> DataFrame:
    return identity.same_name(_long_names(t))


@query(""", pp AS (SELECT *, lower(substr(name, 1, 17)) AS k FROM pe), ed AS (SELECT person_id, count(*) AS edges FROM ep GROUP BY person_id)
SELECT k AS name, arg_max(pp.person_id, [is_user::INT, coalesce(edges, 0), -pp.person_id]) AS winner, count(*) AS members FROM pp LEFT JOIN ed USING (person_id) GROUP BY k HAVING count(*) > 1""")
def same_named(t: Tables) -> DataFrame:
    """People whose names are equal once wrappers and case are gone, and who of them stays."""
    return identity.name_groups(_people(t))


def _people(t: Tables) -> DataFrame:
    edges = t.event_persons.groupBy("person_id").agg(F.count("*").alias("edges"))
    name = F.when(F.col("person_id") % 2 == 0, F.concat(F.lit("list >> "), F.upper(F.substring("name", 1, 17)))).otherwise(F.concat(F.substring("name", 1, 17), F.lit(" (via Mail)")))
    return t.store("pe").join(edges, "person_id", "left").select(F.col("person_id").alias("id"), name.alias("name"), "is_user", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(""", ed AS (SELECT person_id, count(*) AS edges FROM ep GROUP BY person_id),
w AS (SELECT pe.person_id, first_value(pe.person_id) OVER (PARTITION BY substr(name, 1, 17) ORDER BY is_user DESC, coalesce(edges, 0) DESC, pe.person_id) AS winner FROM pe LEFT JOIN ed USING (person_id))
SELECT DISTINCT event_id, coalesce(winner, ep.person_id) AS person_id, role FROM ep LEFT JOIN w USING (person_id)""")
def merged_edges(t: Tables) -> DataFrame:
    """Edges after people of one name are merged."""
    return identity.merged_edges(t.event_persons, _people(t))


@query("SELECT c_custkey, 'ann,lee' AS tokens, CASE c_custkey % 3 WHEN 0 THEN 'x' || c_custkey || '.co.uk' ELSE 'x' || c_custkey || '.com' END AS domain FROM customer")
def address_parts(t: Tables) -> DataFrame:
    """The names in an address, and its root domain."""
    key = F.col("c_custkey").cast("string")
    mail = F.concat(F.element_at(F.array(F.lit("Ann.Lee"), F.lit("lee_ann+info"), F.lit("ann77-lee.team")), (F.col("c_custkey") % 3 + 1).cast("int")), F.when(F.col("c_custkey") % 2 == 0, "@mail.x").otherwise("@x"), key, F.when(F.col("c_custkey") % 3 == 0, ".co.uk").otherwise(".com"))
    p = identity.email_parts(mail)
    return t.read("customer").select("c_custkey", F.array_join(p["tokens"], ",").alias("tokens"), p["domain"].alias("domain"))


@query(_KINDS.replace("FROM part", "FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')") + """, e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.id < b.id AND a.id < 1000000000 AND b.id >= 1000000000 AND len(list_intersect(a.w, b.w)) = 3 AND len(b.w) = 4),
g AS (SELECT a AS component, count(*) + 1 AS n FROM e GROUP BY a HAVING count(*) + 1 <= 15)
SELECT b AS node, component FROM e JOIN g ON e.a = g.component UNION ALL SELECT component, component FROM g""")
def name_clusters(t: Tables) -> DataFrame:
    """Names that are alike, as groups of at most fifteen."""
    links = identity.same_name(_long_names(t, "p_type not in ('SMALL', 'LARGE')")).filter("a < 1000000000 and b >= 1000000000")
    return identity.small_components(links)


_LONGER = _NAMES.replace("nm AS (", "nm AS (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) + 1000000000 AS id FROM part WHERE p_size = 1 GROUP BY 1 UNION ALL ")


@query(_LONGER + "SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.id <> b.id AND len(a.w) BETWEEN 2 AND 4 AND len(b.w) >= 2 AND len(list_intersect(a.w, b.w)) = len(a.w) AND (len(a.w) < len(b.w) OR a.id < b.id)")
def subset_names(t: Tables) -> DataFrame:
    longer = t.read("part").filter("p_size = 1").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg((F.min("p_partkey") + 1000000000).alias("id"))
    return identity.subset_names(_names(t).unionByName(longer))


@query("""SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 50) AS component FROM customer""")
def merged_persons(t: Tables) -> DataFrame:
    """Customers chained by neighbouring links within a nation and residue; a chain is one person."""
    c = t.read("customer").select(F.col("c_custkey").alias("node"), F.lag("c_custkey").over(Window.partitionBy("c_nationkey", F.col("c_custkey") % 50).orderBy("c_custkey")).alias("before"))
    return graph.components(c.select("node"), c.filter("before is not null").select(F.col("node").alias("a"), F.col("before").alias("b")))


@query("""SELECT 'person:' || substr(sha256(e || '|' || p), 1, 16) AS person_id, name, e AS email, p AS phone FROM (
    SELECT 'user' || c_custkey || '@gmail.com' AS e, '+1' || (2000000000 + c_custkey)::VARCHAR AS p, c_name AS name FROM customer)""")
def resolved_persons(t: Tables) -> DataFrame:
    """Customers seen twice, once by a dotted e-mail and once by phone, come out as one person each."""
    c = t.read("customer")
    key = F.col("c_custkey").cast("string")
    phone = (F.lit(2000000000) + F.col("c_custkey")).cast("string")
    mail = c.select(F.concat(F.lit("U.ser"), key, F.lit("@GMail.com ")).alias("email"), F.concat(F.lit("("), F.substring(phone, 1, 3), F.lit(") "), F.substring(phone, 4, 7)).alias("phone"), F.col("c_name").alias("name"), F.lit(0).alias("rank"))
    call = c.select(F.lit(None).cast("string").alias("email"), F.concat(F.lit("1"), phone).alias("phone"), F.lit("x").alias("name"), F.lit(1).alias("rank"))
    p = identity.resolve(mail.unionByName(call))
    return p.select("person_id", "name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"))


@query("SELECT c_custkey, c_mktsegment || ' ' || c_name AS name FROM customer")
def cleaned_names(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(", "), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("list >> "), "c_mktsegment", F.lit(" "), "c_name")).otherwise(F.concat("c_mktsegment", F.lit("  "), "c_name", F.lit(" (via Groups)")))
    return t.read("customer").select("c_custkey", tx.clean_name(raw).alias("name"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'group' WHEN 3 THEN 'name' ELSE 'noise' END AS kind FROM customer")
def parsed_participants(t: Tables) -> DataFrame:
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    raw = F.when(k == 0, F.concat("c_name", F.lit(" <a"), key, F.lit("@x.org>; CC: b@y.org"))).when(k == 1, F.concat(F.lit("+49 30 100"), F.lpad(key, 6, "0"))).when(k == 2, F.concat(F.lit("#team"), key)).when(k == 3, F.lit("Ann Lee")).otherwise("  ")
    return t.read("customer").select("c_custkey", tx.participant(raw)["kind"].alias("kind"))


def items(t: Tables) -> DataFrame:
    """Messages with a score, for propagation."""
    n = t.events.groupBy(F.col("person_id").alias("sender")).agg(F.count("*").alias("n")).select("sender", conf.tier_two(F.col("n") - 40).alias("tier"))
    kind = F.expr("case source when 'mail' then 'email' when 'calendar' then 'meeting' else 'message' end")
    e = t.events.select("event_id", (F.col("event_id") * 37 % 101 / 101.0).alias("score"), kind.alias("event_type"), "thread_id", F.col("person_id").alias("sender"), F.col("is_from_me").alias("sender_is_user"), (F.col("event_id") % 4).alias("n_cc"), (F.col("event_id") % 9).alias("recipients"), "ts")
    return e.join(n, "sender")


@query()
def propagated_scores(t: Tables) -> DataFrame:
    """Three rounds of five rules: no one SQL statement; tests hold it against a plain loop."""
    found, _ = propagate(items(t), t.now.first()["now"])
    return found.select("event_id", F.round("before", 6).alias("before"), F.round("score", 6).alias("score"))
