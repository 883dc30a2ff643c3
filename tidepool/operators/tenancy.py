"""Tenants, members and what they may see and change. Tenant tables are small beside objects; AQE broadcasts them by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenants_of(tenants: DataFrame, members: DataFrame, email: str) -> DataFrame:
    mine = members.where(F.col("email") == email).select(F.col("tenant_id").alias("id"), "role")
    return tenants.join(mine, "id").select("id", "name", "role")


def visible_namespaces(namespaces: DataFrame, members: DataFrame, email: str) -> DataFrame:
    """Namespaces of the caller's tenants; unowned ones are nobody's."""
    mine = members.where(F.col("email") == email).select("tenant_id")
    return namespaces.join(mine, "tenant_id", "left_semi").select("id", "name", "tenant_id")


def namespaces_of(namespaces: DataFrame, tenant_ids: list[int]) -> DataFrame:
    """No ids, no rows."""
    return namespaces.where(F.col("tenant_id").isin(tenant_ids)).select("id", "name", "tenant_id")


def owner_counts(tenants: DataFrame, members: DataFrame) -> DataFrame:
    counts = members.groupBy("tenant_id").agg(F.count_if(F.col("role") == "owner").alias("owners"), F.count("*").alias("members"))
    joined = tenants.join(counts, F.col("id") == F.col("tenant_id"), "left")
    return joined.select("id", "name", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("members", F.lit(0)).alias("members"))


def stats_inputs(objects: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Objects of owned namespaces with their tenant: a blob shared by two tenants counts for both."""
    owned = namespaces.where("tenant_id is not null").select(F.col("id").alias("namespace_id"), "tenant_id")
    return objects.join(owned, "namespace_id").select("tenant_id", "namespace_id", "key", "hash", "size")


def blob_visible(requests: DataFrame, objects: DataFrame, namespaces: DataFrame) -> DataFrame:
    """requests(tenant_id, hash) with whether any namespace of the tenant refers to the blob."""
    seen = stats_inputs(objects, namespaces).select("tenant_id", "hash").distinct().withColumn("seen", F.lit(True))
    return requests.join(seen, ["tenant_id", "hash"], "left").select("tenant_id", "hash", F.coalesce("seen", F.lit(False)).alias("visible"))


def create_outcomes(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted(name, seq): created, or exists if it was there or an earlier request made it."""
    known = existing.select("name").distinct().withColumn("there", F.lit(True))
    rank = F.expr("row_number() over (partition by name order by seq)")
    out = wanted.withColumn("rank", rank).join(known, "name", "left")
    return out.select("seq", "name", F.when(F.col("there") | (F.col("rank") > 1), "exists").otherwise("created").alias("status"))


def create_tenants(wanted: DataFrame, tenants: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after wanted(name, email, seq): each new tenant with its first owner, neither without the other; names in use change nothing."""
    made = create_outcomes(wanted.select("seq", "name"), tenants).where("status = 'created'").select("seq").join(wanted, "seq")
    last = tenants.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = made.withColumn("id", F.expr("row_number() over (order by seq)") + F.lit(last).cast("long"))  # one request's names
    owners = made.select(F.col("id").alias("tenant_id"), "email", F.lit("owner").alias("role"))
    return tenants.select("id", "name").unionByName(made.select("id", "name")), members.select("tenant_id", "email", "role").unionByName(owners)


def delete_namespace_outcomes(wanted: DataFrame, namespaces: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted(name): missing, not_empty or deleted."""
    used = objects.select(F.col("namespace_id").alias("id")).distinct().withColumn("used", F.lit(True))
    found = wanted.join(namespaces.select("name", "id"), "name", "left").join(used, "id", "left")
    return found.select("name", F.when(F.col("id").isNull(), "missing").when(F.col("used"), "not_empty").otherwise("deleted").alias("status"))


def delete_tenant_outcomes(wanted: DataFrame, tenants: DataFrame, namespaces: DataFrame) -> DataFrame:
    owns = namespaces.where("tenant_id is not null").select(F.col("tenant_id").alias("id")).distinct().withColumn("owns", F.lit(True))
    found = wanted.join(tenants, "name", "left").join(owns, "id", "left")
    return found.select("name", F.when(F.col("id").isNull(), "missing").when(F.col("owns"), "not_empty").otherwise("deleted").alias("status"))


def upsert_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest role by (tenant_id, email); changes(tenant_id, email, role, seq)."""
    both = members.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    return both.groupBy("tenant_id", "email").agg(F.max_by("role", "seq").alias("role"))


def remove_member_outcomes(requests: DataFrame, members: DataFrame) -> DataFrame:
    """requests(tenant_id, email): absent (nothing to do), last_owner (refused) or removed."""
    owners = members.groupBy("tenant_id").agg(F.count_if(F.col("role") == "owner").alias("owners"))
    found = requests.join(members, ["tenant_id", "email"], "left").join(owners, "tenant_id", "left")
    status = F.when(F.col("role").isNull(), "absent").when((F.col("role") == "owner") & (F.col("owners") <= 1), "last_owner").otherwise("removed")
    return found.select("tenant_id", "email", status.alias("status"))


def authorise_namespace(requests: DataFrame, namespaces: DataFrame, members: DataFrame) -> DataFrame:
    """requests(name, email) -> status: 404 where there is no such namespace or the tenant that owns it does not have the caller."""
    known = namespaces.join(members, "tenant_id").select("name", "email").distinct().withColumn("own", F.lit(True))
    return requests.join(known, ["name", "email"], "left").select("name", "email", F.when(F.col("own"), 200).otherwise(404).alias("status"))


def authorise(requests: DataFrame, tenants: DataFrame, members: DataFrame) -> DataFrame:
    """requests(tenant, email, owner_only) -> status: 404 hides tenants from strangers, 403 stops members where owners are asked for."""
    known = tenants.join(members, F.col("id") == F.col("tenant_id")).select(F.col("name").alias("tenant"), "email", "role")
    found = requests.join(known, ["tenant", "email"], "left")
    status = F.when(F.col("role").isNull(), 404).when(F.col("owner_only") & (F.col("role") != "owner"), 403).otherwise(200)
    return found.select("tenant", "email", "owner_only", status.alias("status"))


def member_lists(tenants: DataFrame, members: DataFrame) -> DataFrame:
    """(id, name, email, role): the members of every tenant; a row of nulls where there are none."""
    return tenants.join(members.withColumnRenamed("tenant_id", "id"), "id", "left").select("id", "name", "email", "role")
