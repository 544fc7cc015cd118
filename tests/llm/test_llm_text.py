"""Line dedup, decontamination, packing and token counts against plain Python."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import PASSAGE, cases, documents, lowered, prose, split_words
from pyspark.sql import functions as F

from cloudinv.llm import decontamination, line_dedup, packing, token_counts
from cloudinv.llm.byte_bpe import Encoder, encoder


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


# -- line dedup ------------------------------------------------------------------------


def plain_line_dedup(rows, min_chars=20, min_docs=3):
    held: dict[str, set] = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= min_chars:
                held.setdefault(key, set()).add(doc_id)
    rank = lambda i: (i is not None, i or 0)
    keeper = {k: max(ids, key=rank) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        keys = [lowered(line.strip(" \t\n\x0b\x0c\r")) for line in lines]
        kept = [line for line, k in zip(lines, keys) if k not in keeper or keeper[k] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_lines_against_plain_python(spark):
    rows = cases() + [(50 + i, f"{PASSAGE}\nown {i}\n{PASSAGE}", "en", "s", 1) for i in range(4)]
    found = line_dedup.line_dedup(documents(spark, rows))
    got = [(r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in found.collect()]
    assert order(got) == order(plain_line_dedup(rows))


def test_lines_keep_other_columns_and_replace_their_own(spark):
    rows = [(i, f"the very same long line here\nrow {i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("pos", "h", "key", "row", "keeper", "n_lines", "docs")])
    found = line_dedup.line_dedup(clash)
    assert set(found.columns) == set(clash.columns) | {"n_dropped"}
    assert sorted((r.doc_id, r.text, r.pos, r.n_lines) for r in found.collect()) == [
        (0, "row 0", "x", 2), (1, "row 1", "x", 2), (2, rows[2][1], "x", 2)
    ]
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


def test_hot_line_is_split(spark):
    """One line in all documents: the join that brings it back has bare shuffles on both sides."""
    rows = [(i, f"a line that everybody has got\nown line of document {i:06d}") for i in range(3000)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("n_dropped = 1").count() == 2999


# -- decontamination -------------------------------------------------------------------


def shingle_set(text, n=5):
    w = split_words(lowered(text or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_find(rows, items):
    out = set()
    for doc_id, text, *_ in rows:
        own = shingle_set(text)
        for item_id, item in items:
            s = shingle_set(item)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((doc_id, item_id, len(s), len(s & own)))
    return out


ITEMS = [
    (0, PASSAGE), (1, prose(3, 30)), (2, "one"), (3, None), (4, ""), (None, "another under id three"), (6, prose(99, 20)),
    (7, " ".join(prose(4, 200).split()[50:70])), (8, " ".join(prose(4, 200).split()[50:66] + ["x", "y", "z"])),
    (9, "one"), (9, "one"), (9, "One TWO three"),
]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_items_against_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("row", F.lit(1))
    docs = documents(spark).withColumn("items", F.lit(1)).withColumn("words", F.lit(1))
    found = [tuple(r) for r in decontamination.find_items(docs, items).select("doc_id", "item_id", "n_shingles", "n_shared").collect()]
    assert set(found) == plain_find(cases(), ITEMS)
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns
    bad = {r[:1] for r in plain_find(cases(), ITEMS)}
    assert {(r.doc_id,) for r in clean.collect()} >= {(r[0],) for r in cases()} - bad


def test_every_share_of_an_item(spark):
    """Random parts of items, around the bound: the signatures miss none."""
    rng = random.Random(5)
    items = [(i, prose(1000 + i, rng.randint(5, 40))) for i in range(30)]
    rows = []
    for i, text in items:
        w = text.split()
        for _ in range(10):
            a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
            rows.append((len(rows), " ".join([prose(len(rows), 5), *w[a:b], prose(len(rows) + 7, 300)]), None, None, None))
    found = decontamination.find_items(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found.collect()}
    assert got == plain_find(rows, items) and len(got) > 5


def test_an_opening_that_all_items_share_makes_no_candidates(spark):
    """Signatures hold what few items hold; equal sets of shingles are looked for once."""
    opening = "choose the one right answer below "
    items = [(i, opening + prose(5000 + i, 12)) for i in range(400)] + [(1000 + i, opening + prose(5007, 12)) for i in range(50)]
    table = spark.createDataFrame(items, "item_id long, text string")
    _, sets, signed = decontamination.signatures(table.select("item_id", decontamination._words().alias("words")), 5, 0.8)
    assert sets.count() == 400
    assert signed.groupBy("h").count().agg({"count": "max"}).first()[0] == 1
    rows = [(i, opening + prose(9000 + i, 40), None, None, None) for i in range(100)]
    rows += [(200, prose(1, 10) + " " + items[7][1] + " " + prose(2, 10), None, None, None)]
    found = decontamination.find_items(documents(spark, rows), table).collect()
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found}
    assert got == plain_find(rows, items) and {r[1] for r in got} == {7, *range(1000, 1050)}


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_items(documents(spark), none).count() == 0
    assert decontamination.decontaminate(documents(spark), none).count() == len(cases())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_items(documents(spark, []), items).count() == 0


# -- ids, packing ----------------------------------------------------------------------


def test_ids_equal_the_public_tokenizer(tokenizer):
    bits = ["a", "the", " ", " ", "\n", " \n", "\t", "'s", "'ll", " 12", "é", "中", "!", "<|endoftext|>", "  ", "\x1c", "x,"]
    rng, bpe = random.Random(0), Encoder(limit=50)
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 9, 80]))) for _ in range(400)]
    for text in texts + [t or "" for _, t, *_ in cases()]:
        assert np.frombuffer(bpe.ids(text), "<u4").tolist() == encode(tokenizer, text), repr(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_ids_of_very_long_runs_of_blanks(tokenizer, blank):
    text = "before" + blank * (2_000_000 // len(blank)) + "after it"
    assert np.array_equal(np.frombuffer(Encoder().ids(text), "<u4"), np.array(encode(tokenizer, text), "<u4"))
    near = "x" + blank * (65_534 // len(blank)) + " y"
    assert np.frombuffer(Encoder().ids(near), "<u4").tolist() == encode(tokenizer, near)


def test_blank_documents_are_packed_and_counted(spark):
    docs = documents(spark, [(1, " " * 2_000_000, None, None, 0), (2, "\n" * 2_000_000, None, None, 0)])
    ids = {r.doc_id: r.n for r in packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert ids == {i: n + 1 for i, n in counted.items()} and min(counted.values()) > 1000


def test_packed_pieces(spark, tokenizer):
    rows = cases()
    docs = documents(spark, rows).withColumn("sequence_id", F.lit("x")).withColumn("length", F.lit("x"))
    found = [r.asDict() for r in packing.pack_documents(docs).collect()]
    want = []
    for doc_id, text, *_ in rows:
        ids = [*encode(tokenizer, text or ""), 0]
        first = len(ids) % 2048
        edges = ([0] if first else []) + list(range(first, len(ids) + 1, 2048))
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found]
    assert order(got) == order(want)
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) <= 2048
    assert packing.pack_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("open_bins", [1, 3, 4096])
def test_best_fit_keeps_its_bounds(open_bins):
    rng = random.Random(open_bins)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    if open_bins == 4096:
        sizes.sort(reverse=True)
    bins, offsets = packing.best_fit(sizes, 100, open_bins)
    filled: dict[int, int] = {}
    for b, o, s in zip(bins, offsets, sizes):
        assert filled.get(b, 0) == o
        filled[b] = o + s
    assert max(filled.values()) <= 100
    if open_bins == 4096:
        assert len(filled) <= 1.02 * sum(sizes) / 100 + 1


# -- token counts ----------------------------------------------------------------------


def test_counts_follow_random_edits(tokenizer):
    bits = ["a", "the", " ", " ", "\n", " \n", "'s", " 12", "é", "中", "...", "<|endoftext|>", " The", "  ", "word"]
    rng, bpe = random.Random(3), encoder()
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 40, 200])))
        run = rng.choice([1, 16, 64])
        tree = token_counts.plant(text, bpe, run)
        for _ in range(4):
            start = rng.randint(-1, len(text) + 2)
            stop = start + rng.choice([0, 1, 20, 1000])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 30])))
            low = min(max(start, 0), len(text))
            want = text[:low] + new + text[min(max(stop, low), len(text)) :]
            text, tree, _ = token_counts.edit(text, tree, start, stop, new, bpe, run)
            assert text == want and tree.chars[1] == len(text) and tree.tokens[1] == len(encode(tokenizer, text))


def test_only_the_edited_part_is_encoded():
    text, bpe = prose(11, 3000), encoder()
    tree = token_counts.plant(text, bpe, 512)
    _, _, encoded = token_counts.edit(text, tree, 9000, 9010, "new words", bpe, 512)
    assert encoded < 2000 < len(text)


def test_rows_that_share_an_id_share_three_edits(spark):
    rows = [(i % 2 or None, f"row {i} of some words", "en", f"s{i}", 0) for i in range(10_000)]
    docs = documents(spark, rows)
    assert {tuple(r) for r in token_counts.demo_edits(docs).groupBy("doc_id").count().collect()} == {(None, 3), (1, 3)}
    found = token_counts.apply_edits(token_counts.count_tokens(docs), token_counts.demo_edits(docs))
    assert {(r.n_edits, r["count"]) for r in found.groupBy("n_edits").count().collect()} == {(3, 10_000)}


def test_edits_of_a_table(spark, tokenizer):
    docs = documents(spark).withColumn("tokens", F.lit("x"))
    edits = spark.createDataFrame(
        [(9, 1, 0, 4, "New"), (9, 2, 5, 5, None), (14, 1, 20000, 20100, "zz"), (14, 2, None, None, " end"), (999, 1, 0, 0, "x"),
         (None, 1, 0, 2, "id"), (0, 1, 3, 2, "from null"), (3, 1, 1, None, "q")],
        "doc_id long, seq int, start int, stop int, replacement string",
    )
    found = token_counts.apply_edits(token_counts.count_tokens(docs), edits).collect()
    assert len(found) == len(cases())
    for r in found:
        assert r.n_tokens == len(encode(tokenizer, r.text)) == r.tokens[1]
        assert r.n_edits == {9: 2, 14: 2, None: 1, 0: 1, 3: 1}.get(r.doc_id, 0)
    by_id = {r.doc_id: r.text for r in found}
    assert by_id[0] == "from null" and by_id[9].startswith("New") and by_id[14].endswith(" end")
    assert token_counts.count_tokens(documents(spark, [])).count() == 0
    none = edits.where("false")
    assert token_counts.apply_edits(token_counts.count_tokens(docs), none).where("n_edits > 0").count() == 0
