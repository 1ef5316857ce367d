"""Who is who: persons from shared identifiers, and people whose names say they are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.graph import components


#: Short names, and the name each stands for.
NICKNAMES = {
    "rob": "robert", "bob": "robert", "bobby": "robert", "mike": "michael", "mikey": "michael", "bill": "william", "will": "william", "billy": "william", "willy": "william",
    "jim": "james", "jimmy": "james", "jamie": "james", "tom": "thomas", "tommy": "thomas", "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard",
    "joe": "joseph", "joey": "joseph", "dave": "david", "davy": "david", "dan": "daniel", "danny": "daniel", "matt": "matthew", "chris": "christopher", "tony": "anthony",
    "steve": "stephen", "steven": "stephen", "ted": "theodore", "ed": "edward", "eddie": "edward", "al": "albert", "ben": "benjamin", "sam": "samuel", "pat": "patrick",
    "andy": "andrew", "drew": "andrew", "nick": "nicholas", "charlie": "charles", "chuck": "charles", "jeff": "jeffrey", "greg": "gregory", "lex": "alexander", "alex": "alexander",
    "liz": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "sue": "susan", "susie": "susan",
    "jen": "jennifer", "jenny": "jennifer", "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "vicky": "victoria", "vic": "victoria", "nicky": "nicole", "ari": "arianna",
}


def resolve(sightings: DataFrame) -> DataFrame:
    """(person_id, name, emails, phones) from sightings (email, phone, name, rank): e-mail and phone of one sighting are one person.

    The name with the lowest rank wins, then the longest, then the first in order. Sightings with neither identifier are left out.
    """
    ids = sightings.select(tx.normal_email(F.col("email")).alias("e"), tx.normal_phone(F.col("phone")).alias("p"), "name", "rank")
    ids = ids.select(F.when(F.col("e").isNotNull(), F.concat(F.lit("e:"), "e")).alias("a"), F.when(F.col("p").isNotNull(), F.concat(F.lit("p:"), "p")).alias("b"), "name", "rank").filter("a is not null or b is not null")
    nodes = ids.select(F.explode(F.array_compact(F.array("a", "b"))).alias("node"))
    found = components(nodes, ids.filter("a is not null and b is not null").select("a", "b"))
    members = found.groupBy("component").agg(F.array_sort(F.collect_set(F.when(F.col("node").startswith("e:"), F.substr("node", F.lit(3))))).alias("emails"), F.array_sort(F.collect_set(F.when(F.col("node").startswith("p:"), F.substr("node", F.lit(3))))).alias("phones"))
    named = ids.select(F.coalesce("a", "b").alias("node"), "name", "rank").join(found, "node").groupBy("component").agg(F.min(F.struct("rank", -F.length("name"), "name")).alias("best"))
    key = F.concat(F.lit("person:"), F.substring(F.sha2(F.array_join(F.concat("emails", "phones"), "|"), 256), 1, 16))
    return members.join(named, "component").select(key.alias("person_id"), F.col("best.name").alias("name"), "emails", "phones")


def rarest_first(names: DataFrame, nicknames: dict[str, str] | None = NICKNAMES) -> DataFrame:
    """(id, w): the tokens of each name (id, name), those that few names have first."""
    tokens = names.select("id", F.explode(tx.name_tokens(F.col("name"), nicknames)).alias("t"))
    common = tokens.groupBy("t").agg(F.count("*").alias("n"))
    return tokens.join(common, "t").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("w"))


def same_name(names: DataFrame, least: float = 0.67, shared: int = 2, nicknames: dict[str, str] | None = NICKNAMES) -> DataFrame:
    """(a, b, jaccard): names (id, name) whose token sets share enough tokens and are alike enough; each pair once.

    Two sets that are alike enough share one of their rarest tokens: of n all but the last ceil(least * n) - 1. Only these are
    joined on, so a token that very many names have brings no pair together unless all of a name's tokens are so common.
    """
    tokens = rarest_first(names, nicknames)
    n = F.size("w")
    last = F.greatest(F.ceil(F.lit(least) * n).cast("int"), F.lit(min(shared, 2))) - 1
    keyed = tokens.filter(n >= shared).select("id", "w", F.explode(F.slice("w", F.lit(1), F.greatest(n - last, F.lit(1)))).alias("t"))
    pairs = keyed.select(F.col("id").alias("a"), F.col("w").alias("wa"), "t").join(keyed.select(F.col("id").alias("b"), F.col("w").alias("wb"), "t"), "t").filter("a < b")
    both, j = F.size(F.array_intersect("wa", "wb")), tx.jaccard(F.col("wa"), F.col("wb"))
    fit = pairs.filter((F.least(F.size("wa"), F.size("wb")) >= least * F.greatest(F.size("wa"), F.size("wb"))) & (both >= shared) & (j >= least))
    return fit.select("a", "b", j.alias("jaccard")).distinct()


def name_groups(persons: DataFrame) -> DataFrame:
    """(name, winner, members): persons (id, name, is_user, edges) whose cleaned names are the same but for case, two and more; the user wins, then who has most edges."""
    keyed = persons.select(F.lower(tx.clean_name(F.col("name"))).alias("name"), "id", F.struct("is_user", "edges", (-F.col("id")).alias("turned")).alias("rank"))
    return keyed.filter("name <> ''").groupBy("name").agg(F.max_by("id", "rank").alias("winner"), F.count("*").alias("members")).filter("members > 1")


def merged_edges(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """edges (event_id, person_id, role) with each person of a group of equal names as the group's winner; edges that become equal are one."""
    winners = name_groups(persons).select("name", "winner")
    moved = persons.select(F.col("id").alias("person_id"), F.lower(tx.clean_name(F.col("name"))).alias("name")).join(winners, "name").filter("person_id <> winner").select("person_id", "winner")
    return edges.join(moved, "person_id", "left").select("event_id", F.coalesce("winner", "person_id").alias("person_id"), "role").distinct()


def small_components(links: DataFrame, most: int = 15) -> DataFrame:
    """(node, component) of links (a, b), components of more than ``most`` nodes left out: chains that long join different people."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = components(nodes, links.select("a", "b"))
    fit = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("component")
    return found.join(fit, "component").select("node", "component")


#: Local parts that name a function, not a person, and second-level labels under which names are registered.
ROLE_WORDS = (
    "noreply no-reply donotreply do-not-reply info support help admin contact hello team mail email sales billing service notify notification "
    "notifications alerts newsletter news updates marketing promo feedback reply bounce postmaster webmaster web root abuse security privacy"
).split()
REGISTRIES = ["co", "com", "org", "ac", "edu"]


def email_parts(email: Column) -> Column:
    """struct(tokens, domain): the words of the local part without functions, and the last two labels of the domain (three under a registry). An address of a function has no tokens and its whole domain; no @, no domain."""
    low = F.lower(email)
    local, domain = F.regexp_extract(low, "^(.*)@[^@]*$", 1), F.substring_index(low, "@", -1)
    words = F.filter(F.split(F.regexp_replace(local, r"[._\-+0-9]+", " "), " +"), lambda t: F.length(t) > 1)
    role = (F.size(words) == 0) | F.regexp_replace(local, r"[._\-+0-9 ]+", "").isin(ROLE_WORDS)
    labels = F.split(domain, r"\.")
    root = F.when((F.size(labels) >= 3) & F.get(labels, F.size(labels) - 2).isin(REGISTRIES), F.substring_index(domain, ".", -3)).otherwise(F.substring_index(domain, ".", -2))
    tokens = F.when(role, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(words, lambda t: ~t.isin(ROLE_WORDS)))))
    return F.when(email.contains("@"), F.struct(tokens.alias("tokens"), F.when(role, domain).otherwise(root).alias("domain")))


def subset_names(names: DataFrame) -> DataFrame:
    """(a, b): a's tokens, two to four of them, are all among b's, and fewer than b's or equal with a smaller id."""
    tokens = names.select("id", tx.name_tokens(F.col("name")).alias("w"))
    keyed = tokens.filter(F.size("w") >= 2).select("id", "w", F.explode("w").alias("t"))
    small = keyed.filter(F.size("w").between(2, 4) & (F.col("t") == F.get("w", F.lit(0)))).select(F.col("id").alias("a"), F.col("w").alias("wa"), "t")
    pairs = small.join(keyed.select(F.col("id").alias("b"), F.col("w").alias("wb"), "t"), "t").filter("a <> b")
    return pairs.filter((F.size(F.array_except("wa", "wb")) == 0) & ((F.size("wa") < F.size("wb")) | (F.col("a") < F.col("b")))).select("a", "b")
