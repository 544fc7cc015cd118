import pytest
from helpers import collected, inventory
from pyspark.sql import functions as F

from cloudinv import schema as S
from cloudinv.operators import relations
from cloudinv.operators.shaping import has_value, probe, search_text
from cloudinv.plans import catalog

A, B = "000000000001", "000000000002"


def net(spark):
    return inventory(
        spark,
        dict(account_id=A, resource_type=S.VPC, resource_id="vpc-1", aws_region="eu",
             configuration={"vpcId": "vpc-1", "cidrBlock": "10.0.0.0/16"}),
        dict(account_id=A, resource_type=S.VPC, resource_id="vpc-1", aws_region="eu",
             configuration={"vpcId": "vpc-1", "cidrBlock": "10.0.0.0/16"}),
        dict(account_id=A, resource_type=S.SUBNET, resource_id="s1", configuration={"vpcId": "vpc-1"}),
        dict(account_id=A, resource_type=S.SUBNET, resource_id="s2", configuration={"vpcId": "vpc-1"}),
        dict(account_id=B, resource_type=S.SUBNET, resource_id="s1", configuration={}),
        dict(account_id=A, resource_type=S.INSTANCE, resource_id="i1", resource_name="web",
             tags='{"Environment":"prod"}',
             configuration={"subnetId": "s1", "vpcId": "vpc-1", "state": {"name": "running"}}),
        dict(account_id=A, resource_type=S.INSTANCE, resource_id="i2", tags="{}",
             configuration={"subnetId": "s1", "vpcId": ""}),
        dict(account_id=B, resource_type=S.INSTANCE, resource_id="i1", tags='{"Environment":{"a":1}}',
             configuration={"vpcId": "vpc-9"}),
        dict(account_id=A, resource_type=S.NETWORK_INTERFACE, resource_id="e1",
             configuration={"subnetId": "s1", "vpcId": "vpc-1"}),
        dict(account_id=A, resource_type=S.FUNCTION, resource_id="f1",
             configuration={"runtime": "py", "role": "arn:role/1", "vpcConfig": {"vpcId": "vpc-1"}}),
        dict(account_id=A, resource_type=S.FUNCTION, resource_id="f2", configuration={"role": "arn:role/0"}),
        dict(account_id=A, resource_type=S.ROLE, resource_id="r1", arn="arn:role/1", resource_name="admin",
             configuration={"trust": "EC2.amazonaws.com sts:AssumeRole"}),
        dict(account_id=A, resource_type=S.DB_INSTANCE, resource_id="d1",
             configuration={"engine": "pg", "dbSubnetGroup": {"vpcId": "vpc-1"}, "kmsKeyId": "k2"}),
        dict(account_id=A, resource_type=S.VOLUME, resource_id="v1",
             configuration={"size": 8, "encrypted": True, "kmsKeyId": "k1",
                            "attachments": [{"instanceId": "i1", "device": "sda"}]}),
        dict(account_id=A, resource_type=S.VOLUME, resource_id="v2",
             configuration={"size": "big", "encrypted": False, "kmsKeyId": "k4", "attachments": []}),
        dict(account_id=B, resource_type=S.VOLUME, resource_id="v3",
             configuration={"size": 100, "attachments": [{"instanceId": "i2"}]}),
        dict(account_id=A, resource_type=S.KEY, resource_id="k1", configuration={"keyState": "Enabled"}),
        dict(account_id=A, resource_type=S.KEY, resource_id="k2", configuration={}),
        dict(account_id=A, resource_type=S.KEY, resource_id="k3", configuration={"keyState": "Disabled"}),
        dict(account_id=B, resource_type=S.KEY, resource_id="k5", configuration={}),
        dict(account_id=B, resource_type=S.BUCKET, resource_id="b1",
             relationships='[{"resourceId":"k5","resourceType":"%s","name":"Is encrypted by KMS Key"},'
                           '{"resourceId":"k3","resourceType":"Other","name":"x"}]' % S.KEY),
    )


def test_volumes(spark):
    got = [tuple(r) for r in catalog.largest_volumes(net(spark)).collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [("v3", 100, None), ("v1", 8, True), ("v2", None, False)]
    assert len(catalog.largest_volumes(net(spark), 1).collect()) == 1
    assert collected(catalog.volume_encryption_fields(net(spark)), "resource_id", "kms_key_id")[0] == ("v1", "k1")


def test_tags_and_histograms(spark):
    live = net(spark)
    got = [tuple(r) for r in catalog.count_by_tag(live, types=(S.INSTANCE,)).collect()]
    assert got == [(None, 2), ("prod", 1)]
    assert collected(catalog.functions_by_runtime(live).na.fill("-")) == [("-", 1), ("py", 1)]
    assert [tuple(r) for r in catalog.engines_by_version(live).collect()] == [("pg", None, 1)]
    assert [tuple(r) for r in catalog.instances_per_account(live).collect()] == [(A, 2), (B, 1)]
    assert catalog.type_histogram(live, 3).count() == 3
    assert catalog.top_accounts(live).columns == ["account_id", "resource_count", "distinct_resource_types"]


def test_joins_stay_within_account(spark):
    got = catalog.instance_volumes(net(spark)).collect()
    assert [(r["account_id"], r["instance_id"], r["volume_id"], r["size_gib"]) for r in got] == [
        (A, "i1", "v1", 8)
    ]
    assert collected(catalog.function_roles(net(spark)), "function_id", "role_name") == [("f1", "admin")]
    assert collected(catalog.volume_keys(net(spark)), "volume_id", "key_id", "key_state") == [
        ("v1", "k1", "Enabled")
    ]


def test_occupancy(spark):
    got = collected(
        catalog.subnet_occupancy(net(spark)),
        "account_id", "subnet_id", "ec2_instance_count", "network_interface_count", "total_resources",
    )
    assert got == [(A, "s1", 2, 1, 3), (A, "s2", 0, 0, 0), (B, "s1", 0, 0, 0)]
    top = catalog.top_subnets(net(spark), 2).collect()
    assert [(r["account_id"], r["subnet_id"]) for r in top] == [(A, "s1"), (B, "s1")]
    empty = collected(catalog.empty_subnets(net(spark)), "account_id", "subnet_id")
    assert empty == [(A, "s2"), (B, "s1")]


def test_vpc_inventory_counts_like_a_row_join(spark):
    """The VPC is listed twice, so every resource in it counts twice."""
    got = {r["vpc_id"]: tuple(r)[1:] for r in catalog.vpc_inventory(net(spark)).collect()}
    assert got == {
        "vpc-1": (A, "eu", "10.0.0.0/16", 2, 2, 2, 2, 8),
        "vpc-9": (B, None, None, 1, 0, 0, 0, 1),
    }


def test_orphan_keys(spark):
    assert collected(catalog.orphan_keys(net(spark)), "key_id", "key_state") == [("k3", "Disabled")]


def test_text_search(spark):
    found = catalog.roles_trusting(net(spark), "ec2.amazonaws.com", "STS:assumerole")
    assert collected(found, "arn") == [("arn:role/1",)]
    assert catalog.roles_trusting(net(spark), "ec2.amazonaws.com", "s3").count() == 0
    percent = search_text(inventory(spark, dict(arn="a", configuration="50% off")), "configuration", "0%")
    assert percent.count() == 1


def test_has_value(spark):
    rows = probe(net(spark).where(F.col("resource_type") == S.INSTANCE), {"v": "$.vpcId"})
    assert rows.where(has_value(F.col("v"))).count() == 2


def test_edges(spark):
    live = net(spark)
    got = collected(relations.resolve_edges(live).na.fill("-"), "source_id", "target_id", "target_arn")
    assert got == [("b1", "k3", "-"), ("b1", "k5", "-")]
    counts = collected(relations.edge_counts(live), "target_type", "edge_count", "resolved_count")
    assert counts == [(S.KEY, 1, 1), ("Other", 1, 0)]


def test_edges_to_a_target_listed_twice(spark):
    live = inventory(
        spark,
        dict(arn="t1", resource_type="T", resource_id="t"),
        dict(arn="t1", resource_type="T", resource_id="t"),
        dict(arn="s", resource_type="S", resource_id="s",
             relationships='[{"resourceId":"t","resourceType":"T","name":"n"}]'),
    )
    assert collected(relations.resolve_edges(live), "source_id", "target_arn") == [("s", "t1")]
    assert collected(relations.edge_counts(live), "edge_count", "resolved_count") == [(1, 1)]


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_state_changes_across_slices(spark, unit):
    """Changes within a slice, across slices, and across slices without observations."""
    from datetime import datetime

    seen = [(1, 1, "x"), (1, 9, "x"), (1, 20, "y"), (2, 3, "y"), (5, 4, "z"), (5, 5, None), (6, 1, None), (6, 2, "z")]
    df = inventory(
        spark,
        *[dict(arn="a", state_hash=h, last_seen_at=datetime(2026, 4, d, hour)) for d, hour, h in seen],
        dict(arn="b", state_hash="only"),
        dict(arn="c", state_hash="unknown time", last_seen_at=None),
    )
    got = relations.state_changes(df, slice_unit=unit).orderBy("changed_at").collect()
    assert [(r["changed_at"].day, r["changed_at"].hour, r["previous_state"], r["current_state"]) for r in got] == [
        (1, 20, "x", "y"), (5, 4, "y", "z"), (5, 5, "z", None), (6, 2, None, "z"),
    ]
