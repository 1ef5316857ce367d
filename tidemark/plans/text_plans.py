"""Annotation, extraction and masking of texts (survey 2.1, 2.9, 2.12, 2.15, 2.22, 2.24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

_MAIL = tx.EMAIL.replace("'", "''")


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_MAIL}'))) AS email FROM documents")
def email_mentions(t: Tables) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(tx.EMAIL), F.lit(0)))
    return t.read("documents").select("doc_id", F.explode(found).alias("email"))


_MASK = r"regexp_replace(regexp_replace(regexp_replace(text, '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+[.][0-9A-Za-z_.-]*[0-9A-Za-z_]', '[email]', 'g'), '\b1?[-. ]?[(]?[0-9]{3}[)]?[-. ]?[0-9]{3}[-. ]?[0-9]{4}\b', '[phone]', 'g'), 'https?://[^ \n]+', '[url]', 'g')"


@query(f"SELECT doc_id, length({_MASK}) AS n, md5({_MASK}) AS h FROM documents")
def masked_contacts(t: Tables) -> DataFrame:
    m = tx.mask_contacts(F.col("text"))
    return t.read("documents").select("doc_id", F.length(m).cast("long").alias("n"), F.md5(m).alias("h"))


@query("SELECT event_id, list_extract(string_split(a, ','), 1) AS amount, len(string_split(a, ','))::INT AS n FROM (SELECT event_id, printf('%.2f', amount) || CASE WHEN event_id % 2 = 0 THEN ',1999.50' ELSE '' END AS a FROM ev WHERE printf('%.2f', amount) <> '1999.50')")
def dollar_mentions(t: Tables) -> DataFrame:
    own = F.format_string("%.2f", "amount")
    body = F.concat(F.lit("paid $"), own, F.lit(" and $"), own, F.when(F.col("event_id") % 2 == 0, " then $1,999.50.").otherwise(""))
    found = tx.dollar_amounts(body)
    return t.events.filter(own != "1999.50").select("event_id", F.get(found, F.lit(0)).alias("amount"), F.size(found).alias("n"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')))::INT AS n_tokens FROM documents")
def distinct_tokens(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    return t.read("documents").select("doc_id", F.size(F.array_distinct(words)).alias("n_tokens"))


@query("SELECT event_id, facet, value FROM (SELECT event_id, unnest(['source', 'is_from_me', 'is_group', 'large']) AS facet, unnest([source, is_from_me::VARCHAR, is_group::VARCHAR, CASE WHEN amount > 50 THEN 'true' END]) AS value FROM ev) WHERE value IS NOT NULL")
def structural_facets(t: Tables) -> DataFrame:
    """Facets of each event as rows; a facet without value has none."""
    pair = lambda k, v: F.struct(F.lit(k).alias("facet"), v.alias("value"))
    facets = F.array(pair("source", F.col("source")), pair("is_from_me", F.col("is_from_me").cast("string")), pair("is_group", F.col("is_group").cast("string")), pair("large", F.when(F.col("amount") > 50, "true")))
    return t.events.select("event_id", F.explode(facets).alias("f")).filter("f.value is not null").select("event_id", "f.facet", "f.value")


@query("SELECT doc_id, w AS name FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS w FROM documents) WHERE w IN (SELECT unnest(string_split(lower(p_name), ' ')) FROM part) OR w IN (SELECT lower(n_name) FROM nation)")
def name_mentions(t: Tables) -> DataFrame:
    """Names of the index that a text contains as whole words: an equi-join on words, not a scan for each name."""
    names = t.read("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).union(t.read("nation").select(F.lower("n_name"))).distinct()
    words = t.read("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("name"))
    return words.join(names, "name", "left_semi").select("doc_id", "name")


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS size_class, text ILIKE '%license%' OR text ILIKE '%copyright%' AS has_licence, regexp_matches(text, '[0-9a-f]{40}') AS has_key FROM documents")
def content_flags(t: Tables) -> DataFrame:
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return t.read("documents").select("doc_id", size.alias("size_class"), (F.col("text").ilike("%license%") | F.col("text").ilike("%copyright%")).alias("has_licence"), F.col("text").rlike("[0-9a-f]{40}").alias("has_key"))


@query("SELECT doc_id, strpos(text, 'token = ') > 0 AS masked FROM documents WHERE regexp_matches(text, 'token = \"')")
def redacted_secrets(t: Tables) -> DataFrame:
    """Texts that assign a secret, and whether the mark took the value's place."""
    d = t.read("documents").filter(F.col("text").rlike('token = "'))
    return d.select("doc_id", tx.mask_secrets(F.col("text")).contains("token = [REDACTED]").alias("masked"))


@query("SELECT event_id, 'mail body' AS body FROM ev WHERE source = 'mail'")
def mail_bodies(t: Tables) -> DataFrame:
    """Bodies of mails with a quote, an attribution or a forward below, cut back to what was written."""
    tail = F.element_at(F.array(F.lit("> old"), F.lit("On Monday Ann wrote:\nx"), F.lit("--- Original Message\ny"), F.lit("Sent from my phone")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.filter("source = 'mail'").select("event_id", tx.clean_mail_body(F.concat(F.lit("mail​ body\n\n\n\n"), tail)).alias("body"))


@query("SELECT conv_id, turn, role, length(text) AS n, regexp_matches(lower(text), '(^|[^a-z])(please|could|would|can)([^a-z]|$)') AS actionable FROM conversations")
def actionable_turns(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), F.lower("text").rlike("(^|[^a-z])(please|could|would|can)([^a-z]|$)").alias("actionable"))


@query("""SELECT doc_id, CASE WHEN has_email AND toxic THEN 'block' WHEN has_email OR toxic THEN 'review' ELSE 'share' END AS decision FROM (SELECT d.doc_id, regexp_matches(text, '""" + _MAIL + """') AS has_email, coalesce(l.toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))""")
def privacy_decisions(t: Tables) -> DataFrame:
    marks = t.read("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = t.read("documents").select("doc_id", F.col("text").rlike(tx.EMAIL).alias("m")).join(marks, "doc_id", "left").withColumn("x", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return d.select("doc_id", F.when(F.col("m") & F.col("x"), "block").when(F.col("m") | F.col("x"), "review").otherwise("share").alias("decision"))
