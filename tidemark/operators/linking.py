"""Who takes part in an event, and how: participant strings resolved to persons, with a role for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx

#: Sources whose messages belong to a thread: the user's part in them follows from the thread, not from an edge of each.
THREADED = ["mail", "imessage", "whatsapp"]


def identities(events: DataFrame) -> DataFrame:
    """events with one row for each identity among their ``participants``: ``at`` (0 first), ``is_cc``, kind, value and name; noise and groups have none.

    A mail's participant string may hold copies after "; CC:".
    """
    pieces = F.transform(F.filter("participants", lambda raw: raw.isNotNull()), lambda raw: F.transform(F.split(raw, r"(?i);\s*CC:\s*"), lambda piece, i: F.struct(piece.alias("raw"), (i > 0).alias("is_cc"))))
    one = events.select("*", F.posexplode(F.flatten(pieces)).alias("at", "piece")).drop("participants")
    who = one.withColumn("who", tx.participant(F.col("piece.raw"))).filter(F.col("who.kind").isin("email", "phone", "name"))
    return who.select("*", F.col("piece.is_cc").alias("is_cc"), "who.kind", "who.value", F.when(F.col("who.kind") == "name", F.col("who.value")).otherwise(F.col("who.name")).alias("name")).drop("piece", "who")


def resolve(found: DataFrame, identifiers: DataFrame) -> DataFrame:
    """identities() with the ``person_id`` each stands for, by address, then number, then display name; unknown ones are left out."""
    key = lambda kind, value: F.struct(F.lit(kind).alias("id_type"), value.alias("identifier"))
    keys = F.array(key("email", F.when(F.col("kind") == "email", F.col("value"))), key("phone", F.when(F.col("kind") == "phone", F.col("value"))), key("display_name", F.col("name")))
    tried = found.select("*", F.posexplode(keys).alias("place", "k")).filter("k.identifier is not null")
    met = tried.join(identifiers.select("id_type", "identifier", "person_id"), (F.col("k.id_type") == F.col("id_type")) & (F.col("k.identifier") == F.col("identifier")))
    first = Window.partitionBy("event_id", "at").orderBy("place", "person_id")
    return met.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "k", "place", "id_type", "identifier")


def role(user: Column) -> Column:
    """The role of a resolved identity, null if its source links it by its thread alone."""
    source, me, first = F.col("source"), F.col("person_id") == user, F.col("at") == 0
    mine = F.col("is_from_me")
    mail = F.when(me, None).when(first & ~mine, "sender").when(F.col("recent"), F.when(F.col("is_cc"), "cc").otherwise("recipient"))
    message = F.when(~me & first & ~mine, "sender")
    slack = F.when(me, "self").when(mine, "recipient").when(first, "sender").otherwise("recipient")
    calendar = F.when(me, "self").when((F.col("kind") == "email") & (F.col("value") == tx.normal_email(F.col("organizer"))), "organizer").otherwise("attendee")
    call = F.when(me, "self").when(F.col("originated"), "recipient").otherwise("sender")
    by = F.when(source == "mail", mail).when(source.isin("imessage", "whatsapp"), message).when(source == "slack", slack).when(source == "calendar", calendar)
    return by.when(source == "granola", F.when(me, "self").otherwise("attendee")).when(source.startswith("call"), call).when(source == "contacts", F.when(first, "identity"))


def link(events: DataFrame, identifiers: DataFrame, user) -> DataFrame:
    """(event_id, person_id, role): the edges of events (event_id, source, participants, is_from_me, recent, organizer, originated), each once.

    The user gets a self edge in every event of a source without threads, even if not named.
    """
    found = resolve(identities(events), identifiers).withColumn("role", role(F.lit(user)))
    own = events.filter(~F.col("source").isin(*THREADED, "contacts")).select("event_id", F.lit(user).cast(found.schema["person_id"].dataType).alias("person_id"), F.lit("self").alias("role"))
    return found.filter("role is not null").select("event_id", "person_id", "role").unionByName(own).distinct()


def group_mentions(messages: DataFrame, members: DataFrame, persons: DataFrame, user) -> DataFrame:
    """(event_id, person_id): members of a message's group whose name has a word of three letters or more in its text; not its sender, not the user.

    messages has event_id, sender and text, members event_id and person_id, persons person_id and name. Words meet in an equi-join.
    """
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w+\b"), F.lit(0)))
    said = messages.select("event_id", "sender", F.explode(words(F.col("text"))).alias("word"))
    called = members.join(persons, "person_id").select("event_id", "person_id", F.explode(F.filter(words(F.col("name")), lambda w: F.length(w) >= 3)).alias("word"))
    return said.join(called, ["event_id", "word"]).filter((F.col("person_id") != F.col("sender")) & (F.col("person_id") != user)).select("event_id", "person_id").distinct()
