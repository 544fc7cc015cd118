"""The reader that cuts documents item by item."""

import gzip
import json
import os
import random
import tracemalloc
import zlib

import pytest
from helpers import collected, deliver, folder, item

from cloudinv.operators.shaping import explode_items, flatten_items
from cloudinv.sources import items, snapshots

T0 = "2026-04-09T12:00:00"


def cut(text, size):
    return iter([text[i : i + size] for i in range(0, len(text), size)])


def value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind < 5:
        return [rng.randint(-(10**6), 10**6), rng.random(), 'te"x\\t ]}, é ', None, True][kind]
    if kind < 7:
        return {f"k{i}": value(rng, depth - 1) for i in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_items_of_random_documents(size):
    rng = random.Random(size)
    for _ in range(60):
        members = {f"m{i}": value(rng, 3) for i in range(rng.randrange(3))}
        want = [value(rng, 3) for _ in range(rng.randrange(5))]
        members["configurationItems"] = want
        members |= {"after": value(rng, 2)}
        text = json.dumps(members, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        assert [json.loads(t) for t in items.item_texts(cut(text, size))] == want


@pytest.mark.parametrize("text", [
    "", "[1]", '{"configurationItems": 3}', '{"configurationItems": [1', '{"configurationItems": [1 2]}', '{"configurationItems": [{]}',
    '{"a": NaN}', '{"a": 1} x', '{"a": tru', '{"a" 1}', '{"configurationItems": ["a\\q"]}', '{"a":' + "[" * 100_000,
])
def test_broken_documents(text):
    for size in (1, 1000):
        with pytest.raises(items.BrokenDocument):
            list(items.item_texts(cut(text, size)))


def test_no_items():
    for text in ("{}", '{"configurationItems": null}', '{"configurationItems": [ ], "a": 1}', ' {"a": [1]} '):
        assert list(items.item_texts(cut(text, 3))) == []


def test_memory_does_not_grow_with_the_document():
    """A document of 200 MB in an archive of some 600 KB, read in a few MB."""
    one = json.dumps({"ARN": "x", "configuration": "y" * 2000})
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    parts = [packer.compress(b'{"configurationItems": [')]
    for i in range(100_000):
        parts.append(packer.compress((one if not i else "," + one).encode()))
    data = b"".join([*parts, packer.compress(b"]}"), packer.flush()])
    tracemalloc.start()
    n = sum(1 for _ in items.item_texts(items.inflated(iter([data[i : i + items.CHUNK] for i in range(0, len(data), items.CHUNK)]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < 24 << 20


def test_a_wrong_character_is_found_where_it_is():
    """Not after the rest of the document has been gathered."""
    read = []

    def pieces():
        yield '{"configurationItems": [{"a": 1}, {"a" "b"}, '
        for i in range(1000):
            read.append(i)
            yield '{"a": 2}, '

    with pytest.raises(items.BrokenDocument):
        list(items.item_texts(pieces()))
    assert len(read) < 5


def test_rows_equal_the_whole_document_reader(spark, tmp_path):
    root = str(tmp_path)
    deliver(root, "a b+c.json.gz", [
        item(ARN="arn:1", tags={"é": "x y"}, configuration={"n": [1.50, {"z": None}], "t": "a\nb"}, configurationStateId=4),
        item(ARN="arn:2", configuration=None), item(ARN="arn:3", configuration="plain"), item(ARN=None),
    ])
    deliver(root, "other.json.gz", [item(ARN="arn:4")], account="000000000099", region="us-east-1", day="2026/12/31")
    deliver(root, "none.json.gz", [])
    deliver(root, "skipped.json", [item(ARN="arn:no")])
    good = collected(flatten_items(explode_items(snapshots.read_snapshots(spark, root)), T0))
    deliver(root, "array.json.gz", None, document="[1,2]")
    deliver(root, "half.json.gz", None, document='{"configurationItems": [{"ARN": "arn:half"}, {')
    for name, data in (("noarchive", b"this is no archive"), ("cut", gzip.compress(os.urandom(5000))[:2000]), ("nothing", b"")):
        with open(os.path.join(folder(root), f"{name}.json.gz"), "wb") as out:
            out.write(data)
    got = collected(flatten_items(items.read_items(spark, root), T0))
    assert got == good and len(got) == 4
    assert collected(items.read_items(spark, f"file://{root}"), "source_key") == collected(items.read_items(spark, root), "source_key")
    bad = items.read_item_texts(spark, root).where("error IS NOT NULL").collect()
    assert {os.path.basename(r.source_key) for r in bad} == {f"{n}.json.gz" for n in ("array", "half", "noarchive", "cut", "nothing")}
    assert items.read_item_texts(spark, root).where("value IS NULL AND error IS NULL").count() == 1
    assert items.read_items(spark, root, region="us-east-1").count() == 1
    assert items.read_items(spark, root, day=["2026-12-31", "2020-01-01"]).count() == 1
    assert items.read_items(spark, root, day="2020-01-01").count() == 0
    assert items.read_lines(spark, root, day="2026-04-09").count() == 4


def test_files_are_dealt_to_partitions_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(items, "PARTITION", 1000)
    for i in range(20):
        deliver(tmp_path, f"{i}.json.gz", [item(ARN=os.urandom(100 + 20 * i).hex())])
    reader = items.ItemsReader({"path": str(tmp_path), "glob": snapshots.snapshot_glob("").lstrip("/")})
    parts = reader.partitions()
    sizes = [sum(os.path.getsize(p) for p in part.paths) for part in parts]
    assert sum(len(p.paths) for p in parts) == 20 and len(parts) > 5
    assert all(s <= 1000 or len(p.paths) == 1 for s, p in zip(sizes, parts))
