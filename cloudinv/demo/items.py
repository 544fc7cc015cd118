"""Inventory items derived from the star-schema, event, page and document tables.

Accounts are nations, regions are regions. Customers are subnets, orders instances,
line items volumes, events network interfaces, parts keys and functions, suppliers
roles, documents databases and pages buckets.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.functions.times import instant

INGESTED = "2026-04-09T09:00:00"
AS_OF = "2026-04-09T10:00:00"

_KEEP_NULLS = {"ignoreNullFields": "false"}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it lies."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), _KEEP_NULLS)


def _id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(p) if isinstance(p, str) else p for p in parts]))


def _relation(target: str, resource_id: Column, name: str) -> Column:
    return F.struct(
        resource_id.alias("resourceId"),
        F.lit(target).alias("resourceType"),
        F.lit(name).alias("name"),
    )


def account(nation: Column) -> Column:
    return F.lpad(nation.cast("string"), 12, "0")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name"
    )


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation, region and VPC."""
    places = _places(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    return customers.join(places, customers.c_nationkey == places.n_nationkey).withColumn(
        "vpc_id", _id("vpc-", "c_nationkey", "c_mktsegment")
    )


def _placed(df: DataFrame, spark: SparkSession, sf_dir: str, nation: Column) -> DataFrame:
    keyed = df.withColumn("nation", nation.cast("int"))
    return keyed.join(_places(spark, sf_dir), F.col("nation") == F.col("n_nationkey"))


def _rows(
    df: DataFrame,
    resource_type: str,
    resource_id: Column,
    nation: Column,
    configuration: Column,
    name: Column | None = None,
    tags: Column | None = None,
    relationships: Column | None = None,
    captured_at: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = resource_type.rsplit("::", 1)[-1].lower()
    columns = {
        "account_id": account(nation),
        "arn": F.concat(F.lit(f"arn:{kind}/"), resource_id),
        "resource_type": F.lit(resource_type),
        "resource_id": resource_id,
        "resource_name": none if name is None else name,
        "aws_region": F.col("r_name"),
        "captured_at": (F.lit(None) if captured_at is None else captured_at).cast("timestamp"),
        "tags": none if tags is None else tags,
        "relationships": none if relationships is None else F.to_json(relationships),
        "configuration": configuration,
    }
    return completed(df.select(*[column.alias(c) for c, column in columns.items()]))


#: Of an item's columns those from which the others follow.
OWN = (
    "account_id",
    "arn",
    "resource_type",
    "resource_name",
    "aws_region",
    "captured_at",
    "tags",
    "relationships",
    "configuration",
)


def completed(df: DataFrame) -> DataFrame:
    """Inventory rows from items that have their own columns at least; others follow from these or are alike for all."""
    none = F.lit(None).cast("string")
    columns = {
        "resource_id": F.substring("arn", F.locate("/", F.col("arn")) + 1, F.length("arn")),
        "availability_zone": F.concat(F.col("aws_region"), F.lit("-a")),
        "status": F.lit("OK"),
        "created_at": F.lit(None).cast("timestamp"),
        "state_id": none,
        "state_hash": F.md5("configuration"),
        "supplementary_configuration": none,
        "last_seen_at": instant(INGESTED),
        "source_key": F.lit("derived"),
    }
    return df.select(*[F.col(c) if c in df.columns else columns[c].alias(c) for c in S.OPERATIONAL_COLUMNS])


def vpcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = _homes(spark, sf_dir).select("vpc_id", "c_nationkey", "c_mktsegment", "r_name").distinct()
    return _rows(
        distinct,
        S.VPC,
        F.col("vpc_id"),
        F.col("c_nationkey"),
        _json(
            vpcId=F.col("vpc_id"),
            cidrBlock=F.concat(F.lit("10."), F.col("c_nationkey"), F.lit(".0.0/16")),
        ),
        name=F.col("c_mktsegment"),
        tags=_json(Environment=F.col("c_mktsegment")),
    )


def subnets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(
        _homes(spark, sf_dir),
        S.SUBNET,
        _id("subnet-", "c_custkey"),
        F.col("c_nationkey"),
        _json(
            vpcId=F.col("vpc_id"),
            cidrBlock=F.concat(
                F.lit("10."), F.col("c_nationkey"), F.lit("."), F.col("c_custkey") % 256, F.lit(".0/24")
            ),
            availabilityZone=F.concat(F.col("r_name"), F.lit("-a")),
        ),
        name=F.col("c_name"),
        tags=_json(Environment=F.col("c_mktsegment")),
        relationships=F.array(_relation(S.VPC, F.col("vpc_id"), "Is contained in Vpc")),
    )


def _placed_in(subnet: Column, customer: str) -> Column:
    """One customer in seven has nothing in its subnet, only in its network."""
    return F.when(F.col(customer) % 7 != 0, subnet)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    homes = _homes(spark, sf_dir)
    subnet = _id("subnet-", "o_custkey")
    return _rows(
        orders.join(homes, orders.o_custkey == homes.c_custkey),
        S.INSTANCE,
        _id("i-", "o_orderkey"),
        F.col("c_nationkey"),
        _json(
            subnetId=_placed_in(subnet, "o_custkey"),
            vpcId=F.col("vpc_id"),
            instanceType=F.col("o_orderpriority"),
            state=F.struct(F.col("o_orderstatus").alias("name")),
        ),
        name=_id("order ", "o_orderkey"),
        tags=_json(Environment=F.col("c_mktsegment")),
        relationships=F.array(
            _relation(S.VPC, F.col("vpc_id"), "Is contained in Vpc"),
            _relation(S.SUBNET, subnet, "Is contained in Subnet"),
        ),
        captured_at=F.col("o_orderdate"),
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    homes = _homes(spark, sf_dir).select("c_custkey", "c_nationkey", "r_name")
    # Orders find their homes first, so that lines are shuffled once.
    placed = orders.join(homes, orders.o_custkey == homes.c_custkey)
    instance = _id("i-", "l_orderkey")
    encrypted = F.col("l_linestatus") == "F"
    owned = lines.join(placed, lines.l_orderkey == placed.o_orderkey)
    return _rows(
        owned,
        S.VOLUME,
        _id("vol-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        F.col("c_nationkey"),
        _json(
            size=F.col("l_quantity").cast("int"),
            volumeType=F.col("l_returnflag"),
            encrypted=encrypted,
            state=F.struct(
                F.when(F.col("l_linestatus") == "O", "in-use").otherwise("available").alias("value")
            ),
            kmsKeyId=F.when(encrypted & (F.col("l_quantity") >= 45), _id("key-", "l_partkey")),
            attachments=F.array(
                F.struct(
                    instance.alias("instanceId"),
                    F.concat(F.lit("/dev/sd"), F.col("l_linenumber")).alias("device"),
                    (F.col("l_linenumber") == 1).alias("deleteOnTermination"),
                )
            ),
        ),
        relationships=F.array(_relation(S.INSTANCE, instance, "Is attached to Instance")),
        captured_at=F.col("l_shipdate"),
    )


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    homes = _homes(spark, sf_dir)
    subnet = _id("subnet-", "user_id")
    return _rows(
        events.join(homes, events.user_id == homes.c_custkey),
        S.NETWORK_INTERFACE,
        _id("eni-", "event_id"),
        F.col("c_nationkey"),
        _json(subnetId=_placed_in(subnet, "user_id"), vpcId=F.col("vpc_id"), status=F.col("event_type")),
        relationships=F.array(
            _relation(S.SUBNET, subnet, "Is contained in Subnet"),
            _relation(S.VPC, F.col("vpc_id"), "Is contained in Vpc"),
        ),
        captured_at=F.col("ts"),
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _placed(table(spark, sf_dir, "part"), spark, sf_dir, F.col("p_partkey") % 25)
    return _rows(
        parts,
        S.KEY,
        _id("key-", "p_partkey"),
        F.col("nation"),
        _json(keyState=F.when(F.col("p_size") > 40, "Disabled").otherwise("Enabled")),
        name=F.col("p_name"),
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _placed(table(spark, sf_dir, "supplier"), spark, sf_dir, F.col("s_nationkey"))
    service = F.when(F.col("s_acctbal") > 5000, "EC2.amazonaws.com").otherwise("lambda.amazonaws.com")
    return _rows(
        suppliers,
        S.ROLE,
        F.col("s_suppkey").cast("string"),
        F.col("s_nationkey"),
        _json(
            trust=F.struct(
                service.alias("Service"), F.lit("sts:AssumeRole").alias("Action")
            )
        ),
        name=F.col("s_name"),
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _placed(table(spark, sf_dir, "part"), spark, sf_dir, F.col("p_partkey") % 25)
    role = F.col("p_partkey") % 10
    return _rows(
        parts,
        S.FUNCTION,
        _id("fn-", "p_partkey"),
        F.col("nation"),
        _json(
            runtime=F.col("p_brand"),
            role=_id("arn:role/", role),
            vpcConfig=F.struct(_id("vpc-", "nation", F.lit("MACHINERY")).alias("vpcId")),
        ),
        name=F.col("p_name"),
        relationships=F.array(
            _relation(S.ROLE, role.cast("string"), "Is associated with IAM Role")
        ),
    )


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _placed(table(spark, sf_dir, "documents"), spark, sf_dir, F.col("doc_id") % 25)
    return _rows(
        documents,
        S.DB_INSTANCE,
        _id("db-", "doc_id"),
        F.col("nation"),
        _json(
            engine=F.col("source"),
            engineVersion=F.col("lang"),
            dbSubnetGroup=F.struct(_id("vpc-", "nation", F.lit("HOUSEHOLD")).alias("vpcId")),
            kmsKeyId=F.when(F.col("lang") == "en", _id("key-", "doc_id")),
        ),
    )


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _placed(table(spark, sf_dir, "pages"), spark, sf_dir, F.col("page_id") % 25)
    return _rows(
        pages,
        S.BUCKET,
        _id("b-", "page_id"),
        F.col("nation"),
        _json(bytes=F.length("html")),
        name=F.col("url"),
        relationships=F.array(
            _relation(S.KEY, _id("key-", "page_id"), "Is encrypted by KMS Key")
        ),
    )


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    S.VPC: vpcs,
    S.SUBNET: subnets,
    S.INSTANCE: instances,
    S.VOLUME: volumes,
    S.NETWORK_INTERFACE: interfaces,
    S.KEY: keys,
    S.ROLE: roles,
    S.FUNCTION: functions,
    S.DB_INSTANCE: databases,
    S.BUCKET: buckets,
}


def operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items as one table; a filter on type removes the other branches."""
    return reduce(DataFrame.unionByName, [build(spark, sf_dir) for build in BUILDERS.values()])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated observations: one resource per user and event type."""
    kind = F.col("event_type")
    none = F.lit(None).cast("string")
    columns = {
        "account_id": account(F.col("user_id") % 25),
        "arn": F.concat(F.lit("arn:event/"), F.col("user_id"), F.lit("/"), kind),
        "resource_type": kind,
        "resource_id": F.concat(F.lit("ev-"), F.col("event_id")),
        "status": F.lit("OK"),
        "captured_at": F.col("ts").cast("timestamp"),
        "state_hash": F.md5("props"),
        "configuration": F.col("props"),
        "last_seen_at": F.col("ts").cast("timestamp"),
        "source_key": F.concat(F.lit("event/"), F.col("event_id")),
    }
    times = {"created_at": F.lit(None).cast("timestamp")}
    return table(spark, sf_dir, "events").select(
        *[{**columns, **times}.get(c, none).alias(c) for c in S.OPERATIONAL_COLUMNS]
    )


def latest_event(spark: SparkSession, sf_dir: str) -> Column:
    """The time of the newest event, as a scalar of the plan."""
    events = table(spark, sf_dir, "events")
    return events.agg(F.max("ts").cast("timestamp")).scalar()
