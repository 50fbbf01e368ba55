"""Resource envelopes in a folder tree of JSON files, one resource a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import flatten_json

#: Reserved property names that the connector adds.
SCOPE, IDENTITY = "_scope", "_identity"
_ENVELOPE = "resourceArn string, resourceId string, resourceType string, accountId string, awsRegion string, capturedAt string, payload string, resourceName string, lifecycle string"
_FIELDS = ["resourceArn", "resourceId", "resourceType", "accountId", "awsRegion", "capturedAt", "payload"]
_OPTIONAL = ["resourceName", "lifecycle"]


def read(spark: SparkSession, root: str) -> DataFrame:
    """``(file, text)`` of all JSON files below ``root``; links are followed only as the file system's reader does."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def stream(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("value").alias("text"))


#: The codes of an envelope's rejection, in the order in which they are looked for.
CODES = (
    "invalid_resource_envelope", "invalid_resource_identity", "invalid_resource_account", "invalid_resource_region", "invalid_resource_arn",
    "resource_arn_scope_mismatch", "invalid_capture_time", "invalid_resource_lifecycle", "invalid_resource_name", "invalid_resource_object",
)


def _broken(e: Column, keys: Column) -> dict[str, Column]:
    """For each code whether an envelope has that fault."""
    required, allowed = F.array(*map(F.lit, _FIELDS)), F.array(*map(F.lit, _FIELDS + _OPTIONAL))
    missing = lambda c: c.isNull() | (F.trim(c) == "")
    scheme, partition, service, region, account, resource = (F.coalesce(F.try_element_at(F.split(e["resourceArn"], ":", 6), F.lit(i)), F.lit("")) for i in range(1, 7))
    other = lambda own, said: (own != "") & (own != said)
    payload = F.json_object_keys(e["payload"])
    return {
        "invalid_resource_envelope": keys.isNull() | (F.size(F.array_except(required, keys)) + F.size(F.array_except(keys, allowed)) > 0),
        "invalid_resource_identity": missing(e["resourceArn"]) | missing(e["resourceId"]) | missing(e["resourceType"]) | missing(e["accountId"]),
        "invalid_resource_account": ~e["accountId"].rlike("^[0-9]{12}$"),
        "invalid_resource_region": ~F.coalesce(e["awsRegion"].rlike("^[a-z0-9-]*$"), F.lit(False)),
        "invalid_resource_arn": (scheme != "arn") | (partition == "") | (service == "") | (resource == "") | e["resourceArn"].rlike(r"[\s*?]"),
        "resource_arn_scope_mismatch": other(region, e["awsRegion"]) | other(account, e["accountId"]),
        "invalid_capture_time": F.try_to_timestamp(e["capturedAt"]).isNull(),
        "invalid_resource_lifecycle": ~F.coalesce(e["lifecycle"], F.lit("active")).isin("active", "deleted"),
        "invalid_resource_name": F.trim(F.coalesce(e["resourceName"], e["resourceId"])) == "",
        "invalid_resource_object": payload.isNull() | F.exists(payload, lambda k: k.rlike(rf"^({SCOPE}|{IDENTITY})(\.|$)")),
    }


def _problem(e: Column, keys: Column) -> Column:
    """The first of CODES that applies, never with the envelope's values; null if it is fine."""
    faults = _broken(e, keys)
    return F.coalesce(*(F.when(faults[code], code) for code in CODES))


def envelopes(files: DataFrame) -> DataFrame:
    """Parsed envelopes with ``problem``: null, or the reason of the rejection."""
    parsed = files.withColumn("e", F.from_json("text", _ENVELOPE)).withColumn("keys", F.json_object_keys("text"))
    return parsed.withColumn("problem", _problem(F.col("e"), F.col("keys"))).drop("keys")


def entities(accepted: DataFrame, namespace: str, source: str) -> DataFrame:
    """Entity drafts of accepted envelopes: flat typed properties, the ARN as primary key, and additional keys: scope with
    every object path that equals the resource id, scope with the id itself, and every path that equals the own ARN."""
    e = F.col("e")
    flat = flatten_json(e["payload"])
    own = F.array(
        F.struct(F.lit(f"{SCOPE}.account_id").alias("key"), e["accountId"].alias("value")),
        F.struct(F.lit(f"{SCOPE}.region").alias("key"), F.nullif(e["awsRegion"], F.lit("")).alias("value")),
        F.struct(F.lit(f"{IDENTITY}.arn").alias("key"), e["resourceArn"].alias("value")),
        F.struct(F.lit(f"{IDENTITY}.resource_id").alias("key"), e["resourceId"].alias("value")),
    )
    rows = accepted.withColumn("flat", F.filter(F.concat(flat, own), lambda x: x["value"].isNotNull()))
    scope = F.filter(F.array(F.lit(f"{SCOPE}.account_id"), F.when(e["awsRegion"] != "", F.lit(f"{SCOPE}.region"))), lambda x: x.isNotNull())
    at = lambda v: F.transform(F.filter("flat", lambda x: (x["value"] == v) & ~x["key"].startswith("_")), lambda x: x["key"])
    groups = F.concat(
        F.transform(at(e["resourceId"]), lambda p: F.array_append(scope, p)),
        F.array(F.array_append(scope, F.lit(f"{IDENTITY}.resource_id"))),
        F.transform(at(e["resourceArn"]), lambda p: F.array(p)),
    )
    return rows.select(
        F.lit(namespace).alias("namespace"), F.lit(source).alias("source"), e["resourceType"].alias("entity_type"), F.coalesce(e["resourceName"], e["resourceId"]).alias("name"),
        F.array(F.lit(f"{IDENTITY}.arn")).alias("primary_key"), F.array_distinct(groups).alias("additional_keys"), F.map_from_entries("flat").alias("properties"),
        F.coalesce(e["lifecycle"], F.lit("active")).alias("lifecycle"), F.to_timestamp(e["capturedAt"]).alias("captured_at"),
    )
