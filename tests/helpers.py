"""Literal inventory rows and snapshot files for tests."""

import gzip
import json
import os
from datetime import datetime

from cloudinv.schema import OPERATIONAL, OPERATIONAL_COLUMNS

NOON = datetime(2026, 4, 9, 12)


def row(**values):
    base = dict.fromkeys(OPERATIONAL_COLUMNS)
    base.update(account_id="000000000012", status="OK", last_seen_at=NOON)
    base.update(values)
    base["configuration"] = (
        base["configuration"]
        if isinstance(base["configuration"], (str, type(None)))
        else json.dumps(base["configuration"])
    )
    return tuple(base[c] for c in OPERATIONAL_COLUMNS)


def inventory(spark, *rows):
    return spark.createDataFrame([row(**r) for r in rows], OPERATIONAL)


def item(**values):
    base = {
        "awsAccountId": "000000000012",
        "ARN": "arn:x",
        "resourceType": "AWS::EC2::Volume",
        "resourceId": "vol-1",
        "configurationItemStatus": "OK",
        "configurationItemCaptureTime": "2026-04-09T10:00:00.000Z",
    }
    base.update(values)
    return {k: v for k, v in base.items() if v != "ABSENT"}


def folder(root, account="000000000012", region="eu-west-2", day="2026/4/9"):
    return os.path.join(root, "AWSLogs", account, "Config", region, day, "ConfigSnapshot")


def deliver(root, name, items, document=None, **place):
    path = folder(str(root), **place)
    os.makedirs(path, exist_ok=True)
    doc = {"fileVersion": "1.0", "configSnapshotId": name, "configurationItems": items}
    text = json.dumps(doc if document is None else document) if not isinstance(document, str) else document
    target = os.path.join(path, name)
    with gzip.open(target, "wt", encoding="utf-8") as out:
        out.write(text)
    return target


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())
