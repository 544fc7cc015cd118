from datetime import timedelta

from helpers import NOON, collected, inventory

from cloudinv.operators import stats


def table(spark):
    rows = [
        dict(resource_type="V", aws_region="eu", account_id="1"),
        dict(resource_type="V", aws_region="us", account_id="1"),
        dict(resource_type="I", aws_region="us", account_id="1", last_seen_at=NOON - timedelta(hours=1)),
        dict(resource_type="I", aws_region=None, account_id="2"),
        dict(resource_type=None, aws_region="eu", account_id="2"),
    ]
    return inventory(spark, *rows)


def test_overview(spark):
    got = stats.overview(table(spark)).first().asDict()
    assert got == {
        "total_resources": 5,
        "distinct_accounts": 2,
        "distinct_resource_types": 2,
        "distinct_regions": 2,
        "first_seen_at": NOON - timedelta(hours=1),
        "last_seen_at": NOON,
    }


def test_empty_table_gives_one_row(spark):
    empty = table(spark).where("false")
    assert tuple(stats.overview(empty).first()) == (0, 0, 0, 0, None, None)
    assert tuple(stats.totals(empty).first()) == (0, 0, 0)
    assert stats.by_region(empty).count() == 0


def test_by_type_breaks_ties_by_name(spark):
    got = [tuple(r) for r in stats.by_type(table(spark)).collect()]
    assert got == [("I", 2), ("V", 2), (None, 1)]
    assert stats.by_type(table(spark), 0).count() == 1
    assert stats.by_type(table(spark), 10_000).count() == 3


def test_by_account_and_region(spark):
    assert [tuple(r) for r in stats.by_account(table(spark)).collect()] == [
        ("1", 3, 2, 2),
        ("2", 2, 1, 1),
    ]
    assert [tuple(r) for r in stats.by_region(table(spark)).collect()] == [
        ("eu", 2, 2, 1),
        ("us", 2, 1, 2),
        (None, 1, 1, 1),
    ]


def test_totals(spark):
    assert collected(stats.totals(table(spark))) == [(5, 2, 2)]
