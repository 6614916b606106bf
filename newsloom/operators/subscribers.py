"""Readers' subscriptions and the digests sent to them, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from .order import numbered


def by_email(subscribers: DataFrame, emails: DataFrame) -> DataFrame:
    """The subscribers of the addresses (column email), whatever their case."""
    norm = F.lower(F.trim("email"))
    return subscribers.withColumn("_e", norm).join(emails.select(norm.alias("_e")).distinct(), "_e", "left_semi").drop("_e")


#: Fixed value: characters of a user agent that are kept.
AGENT_CHARS = 500


def _address(c: str = "email") -> Column:
    return F.lower(F.trim(c))


def request(subscribers: DataFrame, requests: DataFrame) -> DataFrame:
    """After requests (id, email, language, requested_at, source_ip, user_agent): one row for each address, whatever its case.

    A known address gets the language and the time of its last request; its status and the rest stay.
    A new one becomes a pending row with the id, origin and agent of its first request. Requests
    without an address are left out.
    """
    r = requests.where(F.length(_address()) > 0).select(_address().alias("_e"), "id", F.when(F.col("language") == "np", "np").otherwise("en").alias("language"), "requested_at", "source_ip", F.substring("user_agent", 1, AGENT_CHARS).alias("user_agent"))
    when = F.struct("requested_at", "id")
    one = r.groupBy("_e").agg(F.max_by("language", when).alias("_l"), F.max("requested_at").alias("_at"), *[F.min_by(c, when).alias(f"_{c}") for c in ("id", "source_ip", "user_agent")])
    known = subscribers.withColumn("_e", _address()).join(one, "_e", "left")
    known = known.withColumn("language", F.coalesce("_l", "language")).withColumn("requested_at", F.coalesce("_at", "requested_at")).select(*subscribers.columns)
    new = one.join(subscribers.select(_address().alias("_e")), "_e", "left_anti")
    made = {"id": F.col("_id"), "email": F.col("_e"), "language": F.col("_l"), "status": F.lit("pending"), "requested_at": F.col("_at"), "source_ip": F.col("_source_ip"), "user_agent": F.col("_user_agent")}
    return known.unionByName(new.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in subscribers.schema]))


def confirm(subscribers: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subscribers after confirmations (id, email, at), and what changed: (subscriber_id, event, at, detail).

    An address that is not confirmed yet becomes so and is no longer unsubscribed; one that is stays
    as it is and changes nothing; one that is unknown gets a confirmed row with the confirmation's id.
    """
    c = confirmations.where(F.length(_address()) > 0).groupBy(_address().alias("_e")).agg(F.min("at").alias("_at"), F.min_by("id", "at").alias("_id"))
    t = subscribers.withColumn("_e", _address()).join(c, "_e", "left")
    moved = F.col("_at").isNotNull() & ~F.col("status").eqNullSafe("confirmed")
    new = c.join(subscribers.select(_address().alias("_e")), "_e", "left_anti")
    after = t.withColumn("confirmed_at", F.when(moved, F.col("_at")).otherwise(F.col("confirmed_at"))).withColumn("unsubscribed_at", F.when(moved, F.lit(None)).otherwise(F.col("unsubscribed_at"))).withColumn("status", F.when(moved, "confirmed").otherwise(F.col("status")))
    made = {"id": F.col("_id"), "email": F.col("_e"), "language": F.lit("en"), "status": F.lit("confirmed"), "requested_at": F.col("_at"), "confirmed_at": F.col("_at")}
    rows = after.select(*subscribers.columns).unionByName(new.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in subscribers.schema]))
    told = t.where(moved).select("id", "_at", F.lit("{}").alias("detail")).unionByName(new.select(F.col("_id").alias("id"), "_at", F.lit('{"backfilled":true}').alias("detail")))
    return rows, told.select(F.col("id").alias("subscriber_id"), F.lit("confirmed").alias("event"), F.col("_at").alias("at"), "detail")


def unsubscribe(subscribers: DataFrame, leavers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subscribers after leavers (email, at), and what changed; who has left already, or is unknown, changes nothing."""
    c = leavers.where(F.length(_address()) > 0).groupBy(_address().alias("_e")).agg(F.min("at").alias("_at"))
    t = subscribers.withColumn("_e", _address()).join(c, "_e", "left")
    moved = F.col("_at").isNotNull() & ~F.col("status").eqNullSafe("unsubscribed")
    after = t.withColumn("unsubscribed_at", F.when(moved, F.col("_at")).otherwise(F.col("unsubscribed_at"))).withColumn("status", F.when(moved, "unsubscribed").otherwise(F.col("status")))
    return after.select(*subscribers.columns), t.where(moved).select(F.col("id").alias("subscriber_id"), F.lit("unsubscribed").alias("event"), F.col("_at").alias("at"), F.lit("{}").alias("detail"))


def log(events: DataFrame, changes: DataFrame) -> DataFrame:
    """The event log with changes (subscriber_id, event, at, detail) added, numbered on from its last id in order of time."""
    last = events.agg(F.max("id")).first()[0] or 0
    new = numbered(changes, "_n", F.col("at").asc(), F.col("subscriber_id").asc(), F.col("event").asc())
    return events.unionByName(new.withColumn("id", F.col("_n") + last + 1).select(*events.columns))


def unlogged_repeats(events: DataFrame) -> DataFrame:
    """The events without those logged twice: same subscriber, kind and time; the least id stays."""
    n = F.row_number().over(Window.partitionBy("subscriber_id", "event", "at").orderBy("id"))
    return events.withColumn("_n", n).where("_n = 1").drop("_n")


def latest_event(events: DataFrame) -> DataFrame:
    """(subscriber_id, event, n): each subscriber's last event by time, then id, and how many different ones there are."""
    e = unlogged_repeats(events)
    return e.groupBy("subscriber_id").agg(F.max_by("event", F.struct("at", "id")).alias("event"), F.count("*").alias("n"))


def event_details(events: DataFrame, *fields: str) -> DataFrame:
    """The events with fields of their JSON detail as columns; null where there is none."""
    return events.select("*", *[F.get_json_object("detail", f"$.{f}").alias(f"detail_{f}") for f in fields])


def claimable(subscribers: DataFrame, deliveries: DataFrame, day: Column, now: Column, lease_min: int = 15) -> DataFrame:
    """Confirmed subscribers whose digest of the day is neither sent nor being sent by a run with a fresh lease."""
    d = deliveries.where((F.col("digest_date") == day) & ((F.col("status") == "sent") | ((F.col("status") == "sending") & (F.col("attempted_at") > now - F.make_dt_interval(mins=F.lit(lease_min))))))
    return subscribers.where("status = 'confirmed'").join(d.select(F.col("subscriber_id").alias("id")), "id", "left_anti")


def claim(subscribers: DataFrame, deliveries: DataFrame, day: Column, now: Column, limit: int, exclude: DataFrame | None = None, lease_min: int = 15) -> tuple[DataFrame, DataFrame]:
    """The deliveries after a run has claimed up to ``limit`` recipients of the day, and those (id, email, language), in order of id.

    Who may be claimed is as in ``claimable``, without the ids of ``exclude`` (id), which the run has
    had already. Claims are leases: they stand as "sending" since now, over a failed or stale try.
    """
    free = claimable(subscribers, deliveries, day, now, lease_min)
    if exclude is not None:
        free = free.join(exclude.select("id").where("id IS NOT NULL"), "id", "left_anti")
    mine = cut(free.orderBy("id").limit(max(0, limit)).select(F.col("id").alias("subscriber_id")), "claim")
    lease = mine.select(day.alias("digest_date"), "subscriber_id", F.lit("sending").alias("status"), now.alias("attempted_at"), F.lit(None).cast("string").alias("error"))
    return mark(deliveries, lease), subscribers.join(mine.select(F.col("subscriber_id").alias("id")), "id", "left_semi").select("id", "email", "language").orderBy("id")


def delivered_to(deliveries: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The deliveries with their reader's address and language; those of readers that are gone are left out."""
    return deliveries.join(subscribers.select(F.col("id").alias("subscriber_id"), "email", "language"), "subscriber_id")


def mark(deliveries: DataFrame, marks: DataFrame) -> DataFrame:
    """After marks (digest_date, subscriber_id, status, attempted_at, error) were written over the rows with their keys, or added."""
    keys = ["digest_date", "subscriber_id"]
    return deliveries.join(marks.select(*keys), keys, "left_anti").unionByName(marks.select(*deliveries.columns))


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("digest_date", "status").agg(F.count("*").alias("n"))
