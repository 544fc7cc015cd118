"""The inventory question catalogue: DataFrame functions over live rows.

Every function takes live inventory rows. Filters on type reach the scan, the payload of
a row is parsed once however many members are asked for, and children are counted before
they are joined to parents.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.operators import stats
from cloudinv.operators.shaping import has_value, of_type, probe, search_text


def _histogram(df: DataFrame, count: str, *keys: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), *[F.asc_nulls_last(k) for k in keys])
    )


def _first(df: DataFrame, limit: int | None, *order) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def type_histogram(live: DataFrame, limit: int = 15) -> DataFrame:
    return stats.by_type(live, limit)


def instances_per_account(live: DataFrame, limit: int = 10) -> DataFrame:
    return _histogram(of_type(live, S.INSTANCE), "instance_count", "account_id").limit(limit)


def top_accounts(live: DataFrame, limit: int = 10) -> DataFrame:
    return stats.by_account(live, limit).drop("distinct_regions")


def largest_volumes(live: DataFrame, limit: int = 10) -> DataFrame:
    paths = {"size": "$.size", "volume_type": "$.volumeType", "is_encrypted": "$.encrypted"}
    return (
        probe(of_type(live, S.VOLUME), paths, keep=("resource_id", "account_id"))
        .select(
            F.col("resource_id").alias("volume_id"),
            F.col("size").try_cast("int").alias("size_gib"),
            "volume_type",
            F.col("is_encrypted").try_cast("boolean").alias("encrypted"),
            "account_id",
        )
        .orderBy(F.desc_nulls_last("size_gib"), "volume_id", "account_id")
        .limit(limit)
    )


def count_by_tag(
    live: DataFrame, name: str = "Environment", types: tuple[str, ...] = (), limit: int = 10
) -> DataFrame:
    """Resources per value of a tag; those without it form the NULL group."""
    rows = of_type(live, *types) if types else live
    tagged = probe(rows, {"tag_value": f"$['{name}']"}, column="tags")
    return _histogram(tagged, "resource_count", "tag_value").limit(limit)


def functions_by_runtime(live: DataFrame) -> DataFrame:
    rows = probe(of_type(live, S.FUNCTION), {"runtime": "$.runtime"})
    return _histogram(rows, "function_count", "runtime")


def engines_by_version(live: DataFrame) -> DataFrame:
    rows = probe(
        of_type(live, S.DB_INSTANCE), {"engine": "$.engine", "engine_version": "$.engineVersion"}
    )
    return _histogram(rows, "instance_count", "engine", "engine_version")


def instance_volumes(live: DataFrame, limit: int | None = 20) -> DataFrame:
    """Instances with their attached volumes, within an account."""
    instances = probe(
        of_type(live, S.INSTANCE),
        {"instance_state": "$.state.name", "instance_type": "$.instanceType"},
        keep=("account_id", "aws_region", "resource_id", "resource_name"),
    ).withColumnsRenamed({"resource_id": "instance_id", "resource_name": "instance_name"})
    volumes = probe(
        of_type(live, S.VOLUME),
        {
            "volume_type": "$.volumeType",
            "size": "$.size",
            "volume_state": "$.state.value",
            "encrypted": "$.encrypted",
            "instance_id": "$.attachments[0].instanceId",
            "device_name": "$.attachments[0].device",
            "delete_on_termination": "$.attachments[0].deleteOnTermination",
        },
        keep=("account_id", "resource_id"),
    ).withColumnRenamed("resource_id", "volume_id")
    joined = instances.join(volumes, ["instance_id", "account_id"]).select(
        "account_id",
        "aws_region",
        "instance_id",
        "instance_name",
        "instance_state",
        "instance_type",
        "volume_id",
        "volume_type",
        F.col("size").try_cast("int").alias("size_gib"),
        "volume_state",
        "encrypted",
        "device_name",
        "delete_on_termination",
    )
    order = ("instance_id", F.asc_nulls_last("device_name"), "volume_id", "account_id")
    return _first(joined, limit, *order)


def function_roles(live: DataFrame, limit: int | None = 25) -> DataFrame:
    """Functions with the role they assume; a role ARN is unique across accounts."""
    functions = probe(
        of_type(live, S.FUNCTION),
        {"runtime": "$.runtime", "role_arn": "$.role"},
        keep=("account_id", "resource_id", "resource_name"),
    )
    roles = of_type(live, S.ROLE).select(
        F.col("arn").alias("role_arn"),
        F.col("resource_name").alias("role_name"),
        F.col("account_id").alias("role_account_id"),
    )
    joined = functions.join(roles, "role_arn").select(
        "account_id",
        F.col("resource_id").alias("function_id"),
        F.col("resource_name").alias("function_name"),
        "runtime",
        "role_arn",
        "role_name",
        "role_account_id",
    )
    return _first(joined, limit, "function_id", "account_id", "role_account_id")


def volume_keys(live: DataFrame, limit: int | None = 25) -> DataFrame:
    """Encrypted volumes with the key that encrypts them; key ids are unique."""
    volumes = probe(
        of_type(live, S.VOLUME),
        {"encrypted": "$.encrypted", "key_id": "$.kmsKeyId"},
        keep=("account_id", "resource_id"),
    ).where(F.col("encrypted").try_cast("boolean"))
    keys = (
        probe(
            of_type(live, S.KEY),
            {"key_state": "$.keyState"},
            keep=("resource_id", "arn", "account_id"),
        )
        .withColumnRenamed("resource_id", "key_id")
        .withColumnRenamed("arn", "key_arn")
        .withColumnRenamed("account_id", "key_account_id")
    )
    joined = volumes.join(keys, "key_id").select(
        "account_id",
        F.col("resource_id").alias("volume_id"),
        "key_id",
        "key_arn",
        "key_account_id",
        "key_state",
    )
    return _first(joined, limit, "volume_id", "account_id", "key_account_id")


def subnet_occupancy(live: DataFrame) -> DataFrame:
    """Every subnet with its instances and network interfaces.

    Both kinds of children come from one scan and are counted in one aggregation.
    """
    children = (
        probe(
            of_type(live, S.INSTANCE, S.NETWORK_INTERFACE),
            {"subnet_id": "$.subnetId"},
            keep=("account_id", "resource_type"),
        )
        .where(F.col("subnet_id").isNotNull())
        .groupBy("account_id", "subnet_id")
        .agg(
            F.count_if(F.col("resource_type") == S.INSTANCE).alias("instances"),
            F.count_if(F.col("resource_type") == S.NETWORK_INTERFACE).alias("interfaces"),
        )
    )
    subnets = probe(
        of_type(live, S.SUBNET),
        {"az": "$.availabilityZone", "vpc_id": "$.vpcId", "cidr_block": "$.cidrBlock"},
        keep=("account_id", "aws_region", "resource_id", "resource_name"),
    ).withColumnsRenamed({"resource_id": "subnet_id", "resource_name": "subnet_name"})
    zero = F.lit(0)
    instances = F.coalesce("instances", zero)
    interfaces = F.coalesce("interfaces", zero)
    return subnets.join(children, ["account_id", "subnet_id"], "left").select(
        "subnet_id",
        "subnet_name",
        "account_id",
        "aws_region",
        "az",
        "vpc_id",
        "cidr_block",
        instances.alias("ec2_instance_count"),
        interfaces.alias("network_interface_count"),
        (instances + interfaces).alias("total_resources"),
    )


def top_subnets(live: DataFrame, limit: int = 15) -> DataFrame:
    return _first(
        subnet_occupancy(live), limit, F.desc("total_resources"), "subnet_id", "account_id"
    )


def empty_subnets(
    live: DataFrame, children: tuple[str, ...] = (S.INSTANCE, S.NETWORK_INTERFACE)
) -> DataFrame:
    """Subnets in which no resource of the given types lies."""
    used = (
        probe(of_type(live, *children), {"subnet_id": "$.subnetId"}, keep=("account_id",))
        .where(F.col("subnet_id").isNotNull())
        .distinct()
    )
    return (
        of_type(live, S.SUBNET)
        .select("account_id", F.col("resource_id").alias("subnet_id"), "resource_name")
        .join(used, ["account_id", "subnet_id"], "left_anti")
    )


def vpc_inventory(live: DataFrame) -> DataFrame:
    """Instances, databases, functions and interfaces per VPC.

    The VPC of a database or function lies deeper in its configuration. Resources are
    counted per VPC before the join; a VPC row that is listed several times multiplies
    the counts, as joining row by row would.
    """
    kinds = {
        "ec2_instances": S.INSTANCE,
        "rds_instances": S.DB_INSTANCE,
        "lambda_functions": S.FUNCTION,
        "network_interfaces": S.NETWORK_INTERFACE,
    }
    members = (
        probe(
            of_type(live, *kinds.values()),
            {"own": "$.vpcId", "attached": "$.vpcConfig.vpcId", "group": "$.dbSubnetGroup.vpcId"},
            keep=("account_id", "resource_type"),
        )
        .select("account_id", "resource_type", F.coalesce("own", "attached", "group").alias("vpc_id"))
        .where(has_value(F.col("vpc_id")))
        .groupBy("vpc_id", "account_id")
        .agg(
            *[F.count_if(F.col("resource_type") == t).alias(name) for name, t in kinds.items()],
            F.count(F.lit(1)).alias("total_resource_count"),
        )
    )
    info = (
        probe(
            of_type(live, S.VPC),
            {"vpc_id": "$.vpcId", "cidr_block": "$.cidrBlock"},
            keep=("account_id", "aws_region"),
        )
        .groupBy("vpc_id", "account_id", "aws_region", "cidr_block")
        .agg(F.count(F.lit(1)).alias("listed"))
    )
    times = F.coalesce("listed", F.lit(1))
    return members.join(info, ["vpc_id", "account_id"], "left").select(
        "vpc_id",
        "account_id",
        "aws_region",
        "cidr_block",
        *[(F.col(name) * times).alias(name) for name in (*kinds, "total_resource_count")],
    )


def top_vpcs(live: DataFrame, limit: int = 20) -> DataFrame:
    return _first(
        vpc_inventory(live),
        limit,
        F.desc("total_resource_count"),
        "vpc_id",
        "account_id",
        F.asc_nulls_last("aws_region"),
        F.asc_nulls_last("cidr_block"),
    )


def used_keys(live: DataFrame) -> DataFrame:
    """Key ids that volumes and databases name in their configuration and buckets in
    their relationships, each once."""
    configured = probe(of_type(live, S.VOLUME, S.DB_INSTANCE), {"key_id": "$.kmsKeyId"})
    related = (
        of_type(live, S.BUCKET)
        .select(F.explode(F.from_json("relationships", S.RELATIONSHIPS)).alias("edge"))
        .where(F.col("edge.resourceType") == S.KEY)
        .select(F.col("edge.resourceId").alias("key_id"))
    )
    return configured.unionByName(related).where(F.col("key_id").isNotNull()).distinct()


def orphan_keys(live: DataFrame) -> DataFrame:
    """Keys that nothing uses."""
    keys = probe(
        of_type(live, S.KEY), {"key_state": "$.keyState"}, keep=("resource_id", "account_id")
    ).withColumnRenamed("resource_id", "key_id")
    return keys.join(used_keys(live), "key_id", "left_anti")


def roles_trusting(live: DataFrame, *needles: str) -> DataFrame:
    """Roles whose configuration text holds all of some words, such as a trust policy."""
    return search_text(of_type(live, S.ROLE), "configuration", *needles).select(
        "account_id", "arn", "resource_name"
    )


def volume_encryption_fields(live: DataFrame) -> DataFrame:
    """The fields that tell how a volume is encrypted."""
    return probe(
        of_type(live, S.VOLUME),
        {
            "encrypted": "$.encrypted",
            "kms_key_id": "$.kmsKeyId",
            "volume_type": "$.volumeType",
            "state": "$.state.value",
        },
        keep=("account_id", "resource_id"),
    )
