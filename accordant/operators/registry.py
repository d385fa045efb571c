"""Who consumes what: subscriptions joined to failures and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import values as V

SUBSCRIPTION = (
    "contract_id string, subscriber_id string, fields_consumed array<string>, breaking_fields array<struct<field: string, reason: string>>, "
    "validation_mode string, registered_at string, contact struct<owner: string, role: string, email: string>"
)
MATCHED = "Subscribers of the contract that name the failing field."
FALLBACK = "All subscribers of the contract, for none of them names the failing field."
NONE = "The registry knows no subscriber of this contract, so it can't tell who is hit."


def subscriptions_frame(spark: SparkSession, registry: dict) -> DataFrame:
    """Subscriptions of a registry document; breaking fields may be named alone or with a reason, contacts as text or in parts."""
    rows = []
    for s in registry.get("subscriptions") or []:
        breaking = [(b.get("field"), b.get("reason")) if isinstance(b, dict) else (str(b), None) for b in s.get("breaking_fields") or [] if b]
        contact = s.get("contact")
        contact = (contact.get("owner"), contact.get("role"), contact.get("email")) if isinstance(contact, dict) else ((str(contact), None, None) if contact else None)
        registered = s.get("registered_at")
        rows.append(
            (s.get("contract_id"), s.get("subscriber_id"), [str(f) for f in s.get("fields_consumed") or []], [b for b in breaking if b[0]], s.get("validation_mode", "AUDIT"), None if registered is None else str(registered), contact)
        )
    return spark.createDataFrame(rows, SUBSCRIPTION)


def contract_key(col):
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def contract_subscriptions(subscriptions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Subscriptions of each contract in contracts(contract_id), whatever the case of the ids."""
    wanted = contracts.select(F.col("contract_id").alias("wanted_contract"), contract_key(F.col("contract_id")).alias("_key")).distinct()
    return subscriptions.withColumn("_key", contract_key(F.col("contract_id"))).join(wanted, "_key").drop("_key")


def declared_aliases(subscriptions: DataFrame) -> DataFrame:
    """(contract key, subscriber_id, alias): every name that a subscriber's fields go by."""
    fields = F.array_distinct(F.concat(F.coalesce("fields_consumed", F.array().cast("array<string>")), F.coalesce(F.transform("breaking_fields", lambda b: b["field"]), F.array().cast("array<string>"))))
    exploded = subscriptions.select(contract_key(F.col("contract_id")).alias("_key"), "subscriber_id", F.explode(fields).alias("field"))
    return exploded.select("_key", "subscriber_id", F.explode(V.field_aliases(F.col("field"))).alias("alias")).distinct()


def field_matches(subscriptions: DataFrame, failures: DataFrame) -> DataFrame:
    """(contract_id, field, subscriber_id): subscribers that name the failing field, by any of its names. failures: contract_id, field."""
    wanted = failures.select("contract_id", "field").distinct().withColumn("_key", contract_key(F.col("contract_id")))
    named = wanted.select("*", F.explode(V.field_aliases(F.col("field"))).alias("alias"))
    return named.join(declared_aliases(subscriptions), ["_key", "alias"]).select("contract_id", "field", "subscriber_id").distinct()


def _radius(subscriptions: DataFrame, failures: DataFrame) -> DataFrame:
    """(contract_id, field) with the subscriptions that name the field by any of its names, else all of the contract, and match_type: one join, one group a field."""
    wanted = failures.select("contract_id", "field").distinct().withColumns({"_key": contract_key(F.col("contract_id")), "_names": V.field_aliases(F.col("field"))})
    none = F.array().cast("array<string>")
    fields = F.concat(F.coalesce("fields_consumed", none), F.coalesce(F.transform("breaking_fields", lambda b: b["field"]), none))
    own = subscriptions.select(contract_key(F.col("contract_id")).alias("_key"), *[c for c in subscriptions.columns if c != "contract_id"], F.flatten(F.transform(fields, V.field_aliases)).alias("_aliases"))
    met = wanted.join(own, "_key").withColumn("_hit", F.coalesce(F.arrays_overlap("_names", "_aliases"), F.lit(False)))
    named = met.groupBy("contract_id", "field").agg(F.max("_hit").alias("_any"))  # counted in the tasks first, so that no task holds a contract's subscribers
    met = met.join(named, ["contract_id", "field"])
    mode = F.coalesce("validation_mode", F.lit("AUDIT"))
    return met.where(F.col("_hit") | ~F.col("_any")).withColumns({"validation_mode": mode, "match_type": F.when(F.col("_any"), "field_match").otherwise("contract_fallback")}).drop("_key", "_names", "_aliases", "_hit", "_any")


def blast_radius(subscriptions: DataFrame, failures: DataFrame) -> DataFrame:
    """(contract_id, field, subscriber_id, validation_mode, contact_summary, match_type): subscribers that name the field, else all of the contract."""
    contact = V.contact_summary(F.col("contact.owner"), F.col("contact.role"), F.col("contact.email"))
    return _radius(subscriptions, failures).select("contract_id", "field", "subscriber_id", "validation_mode", contact.alias("contact_summary"), "match_type")


def blast_summary(subscriptions: DataFrame, failures: DataFrame) -> DataFrame:
    """(contract_id, field, subscriber_count, matched_on_field, confidence, summary), a row for each failing field."""
    wanted = failures.select("contract_id", "field").distinct()
    counted = blast_radius(subscriptions, failures).groupBy("contract_id", "field").agg(F.count("*").alias("n"), F.max("match_type").alias("kind"))
    out = wanted.join(counted, ["contract_id", "field"], "left")
    matched = F.coalesce(F.col("kind") == "field_match", F.lit(False))
    return out.select(
        "contract_id", "field", F.coalesce("n", F.lit(0)).alias("subscriber_count"), matched.alias("matched_on_field"),
        F.when(matched, "high").when(F.col("n") > 0, "medium").otherwise("low").alias("confidence"), F.when(matched, MATCHED).when(F.col("n") > 0, FALLBACK).otherwise(NONE).alias("summary"),
    )


def change_impact(subscriptions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(contract_id, field, classification, ...) with affected_consumers, impact_level, requires_registry_update, matched_field_subscriptions.

    affected_consumers has a record for each subscriber: subscriber_id, fields_consumed, breaking_fields, validation_mode, contact, match_type."""
    consumer = F.struct("subscriber_id", "fields_consumed", "breaking_fields", "validation_mode", "contact", "match_type")
    radius = _radius(subscriptions, changes).groupBy("contract_id", "field").agg(F.array_sort(F.collect_set(consumer)).alias("affected_consumers"), F.max(F.col("match_type") == "field_match").alias("matched_field_subscriptions"))
    out = changes.join(radius, ["contract_id", "field"], "left")
    matched, some = F.coalesce("matched_field_subscriptions", F.lit(False)), F.col("affected_consumers").isNotNull()
    breaking = F.col("classification") == "breaking"
    level = F.when(breaking & matched, "HIGH").when(breaking & some, "MEDIUM").when(breaking | some, "LOW").otherwise("NONE")
    return out.withColumns(
        {"impact_level": level, "requires_registry_update": breaking, "matched_field_subscriptions": matched, "affected_consumers": F.coalesce("affected_consumers", F.array())}
    )


def registry_context(subscriptions: DataFrame, contract_id: str, notes: list[str] | None = None) -> dict:
    """What a contract document says of its subscribers."""
    own = subscriptions.where(contract_key(F.col("contract_id")) == contract_id.strip().lower())
    rows = own.withColumn("contact_summary", V.contact_summary(F.col("contact.owner"), F.col("contact.role"), F.col("contact.email"))).collect()  # the subscribers of one contract
    first = "Who is hit by a failure is read from the registry first." if rows else "The registry knows no subscriber of this contract; only lineage can tell who is hit."
    return {"role": "primary_blast_radius_source", "subscriber_count": len(rows), "subscriptions": [r.asDict(recursive=True) for r in rows], "notes": [first, *map(str, notes or [])]}
