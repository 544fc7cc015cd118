"""SimHash groups, repeated bytes, language model, classifiers, top-k and pipeline against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_cases import PASSAGE, cases, crc, documents, lowered, prose, split_words
from pyspark.sql import functions as F

import corpus_pipeline
from cloudinv.llm import components, lm, quality, repeats, simhash, topk, toxicity
from cloudinv.llm.common import held_out, stored


def order(rows):
    return sorted(rows, key=repr)


# -- simhash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    w = split_words(lowered(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_groups_against_plain_python(spark):
    rows = cases()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = groups(len(rows), close)
    least = {}
    for (doc_id, *_), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    want = [(row[0], p, least.get(r)) for row, p, r in zip(rows, prints, root)]
    docs = documents(spark).withColumn("fp", F.lit("x")).withColumn("label", F.lit("x")).withColumn("row", F.lit(1))
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert order(got) == order(want)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))
    assert {i for (i,) in kept.select("doc_id").collect() if i is not None} == set(least.values())
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_dedup(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("blocks", "group"), [(1, 300), (2, 16_384), (5, 16_384), (5, 50)])
def test_trees_lose_no_pair(spark, blocks, group):
    rng = np.random.default_rng(1)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k), dtype=np.uint64), axis=1)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    points = np.unique(np.concatenate([b ^ flips(150, 3) for b in base] + [rng.integers(0, 2**63, 900, dtype=np.uint64)]))
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4, 1))
    want = groups(len(points), zip(i.tolist(), j.tolist()))
    nodes = stored(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long"), "points")
    pairs = simhash.close_pairs(nodes, 4, blocks, group).collect()
    place = {int(p): k for k, p in enumerate(points.view(np.int64))}
    got = groups(len(points), [(place[a], place[b]) for a, b in pairs])
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 8 for a, b in pairs)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, None), (300, 301), (301, 300)]
    more = [(rng.randint(400, 440), rng.randint(400, 440)) for _ in range(25)]
    pairs = chain + more
    found = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    whole = [(a, b) for a, b in pairs if b is not None]
    nodes = sorted({x for p in whole for x in p})
    place = {x: i for i, x in enumerate(nodes)}
    root = groups(len(nodes), [(place[a], place[b]) for a, b in whole])
    least = {r: min(n for n, q in zip(nodes, root) if q == r) for r in root}
    assert found == {n: least[r] for n, r in zip(nodes, root)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated bytes --------------------------------------------------------------------


def plain_repeats(texts):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, kept))
    return out


def found_repeats(docs):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()]


def test_repeats_against_plain_python(spark, monkeypatch):
    rows = [r for r in cases() if r[0] is not None]
    rows = list({r[0]: r for r in rows[::-1]}.values())
    rows += [(60 + i, prose(70 + i, 15 + i) + " " + PASSAGE[i * 7 :] + prose(90 + i, 9), None, None, None) for i in range(25)]
    rows.sort()
    want = [(r[0], *p) for r, p in zip(rows, plain_repeats([r[1] for r in rows]))]
    docs = documents(spark, rows).withColumn("doc", F.lit("x")).withColumn("copy", F.lit("x"))
    assert order(found_repeats(docs)) == order(want)
    # Small chunks cut long texts, and a low bound makes nearly all repeated seeds frequent ones.
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert sum(len(p) for _, p in repeats.chunks([((0, 0), b"x" * 5000)])) > 5


def test_repeats_of_rare_and_frequent_seeds(spark, monkeypatch):
    rows = [(i, prose(500 + i, 20) + PASSAGE[: 150 + 10 * i] + prose(600 + i, 20), None, None, None) for i in range(12)]
    want = order([(r[0], *p) for r, p in zip(rows, plain_repeats([r[1] for r in rows]))])
    for frequent in (1, 3, 1000):
        monkeypatch.setattr(repeats, "FREQUENT", frequent)
        assert order(found_repeats(documents(spark, rows))) == want


def test_repeats_of_dense_seeds(spark, monkeypatch):
    """Seeds found over DENSE times, counted or known from the sample, are compared string by string."""
    rows = [(i, prose(500 + i, 20) + PASSAGE[: 150 + 10 * i] + prose(600 + i, 20), None, None, None) for i in range(12)]
    want = order([(r[0], *p) for r, p in zip(rows, plain_repeats([r[1] for r in rows]))])
    monkeypatch.setattr(repeats, "DENSE", 3)
    for frequent in (1, 1000):
        monkeypatch.setattr(repeats, "FREQUENT", frequent)
        assert order(found_repeats(documents(spark, rows))) == want


def test_hot_seeds_have_buckets_of_their_own(spark, monkeypatch):
    """Near copies that send most of all bytes are spread over buckets of a bounded size."""
    monkeypatch.setattr(repeats, "BUCKET", 1 << 16)
    monkeypatch.setattr(repeats, "SAMPLE", 200)
    copy = prose(77, 300)
    rows = [(i, copy + f" {i}" if i % 2 else prose(7000 + i, 60), None, None, None) for i in range(600)]
    sent, plain = [], repeats.settle
    monkeypatch.setattr(repeats, "settle", lambda df: plain(sent.append(stored(df, "sent")) or sent[-1]))
    found = {r.doc_id: r.n_removed for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    assert found == {r[0]: p[1] for r, p in zip(rows, plain_repeats([r[1] for r in rows]))}
    sizes = sent[0].groupBy("bucket").agg(F.sum(F.length("string")).alias("n"), F.countDistinct("seed").alias("seeds")).collect()
    total, most = sum(r.n for r in sizes), max(r.n for r in sizes)
    assert len(sizes) > 8 and most < 3 * total / len(sizes) and sum(r.seeds for r in sizes) > 40


@pytest.mark.parametrize("most", [4096, 2])
def test_document_filter_grows_with_its_keys(spark, monkeypatch, most):
    """More keys than the least filter has bits: others still stay out, or all are joined."""
    monkeypatch.setattr(repeats, "SEGMENTS", 1)
    monkeypatch.setattr(repeats, "MOST_SEGMENTS", most, raising=False)
    docs = spark.range(200_000).select(F.col("id").alias("doc"), F.lit("x").alias("text"))
    lists = stored(docs.where("doc % 2 = 0").select("doc", F.lit(1).alias("list")), "lists")
    near, others = repeats.with_lists(docs, lists, ["doc"])
    listed, n = near.agg(F.sum("list"), F.count("*")).first()
    assert listed == 100_000 and n + others.count() == 200_000 and others.columns == docs.columns
    assert others.where("doc % 2 = 0").isEmpty()
    assert n == 200_000 if most == 2 else n < 102_000


def test_repeats_with_shared_ids(spark):
    """Null ids come first; of equal rows one stays; different texts under one id come one after the other."""
    long = prose(1234, 60)
    rows = [(5, long, None, None, None), (5, long, None, None, None), (5, long + " more", None, None, None),
            (None, long, None, None, None), (7, long, None, None, None), (8, "x", None, None, None)]
    found = found_repeats(documents(spark, rows))
    size = len(long.encode())
    assert order((i, n, gone) for i, n, gone, _, _ in found) == order(
        [(5, size, size), (5, size, size), (5, size + 5, size), (None, size, 0), (7, size, size), (8, 1, 0)]
    )
    assert found_repeats(documents(spark, [])) == []


def test_equal_strings_sorts_by_several_keys():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + bytes(range(200)) * 3
    at = np.arange(len(data) - 24)
    group = repeats.equal_strings(data, at, 24)
    want = [data[i : i + 24] for i in at]
    assert len({*zip(group.tolist(), want)}) == len(set(want)) == len(set(group.tolist()))


# -- language model --------------------------------------------------------------------


def tokens(text):
    return [*[w.encode() for w in split_words(lowered(text or ""))], b"\n"]


def test_tokens_against_plain_python():
    """Equal words have equal hashes and others do not, wherever they stand and however texts are cut."""
    seen = {}
    own = [t for _, t, *_ in cases()]
    for texts in (own, own[::-1], [], [None], ["a" * 2_500_000 + " b A B", "", "b"], ["é", " ", "É e\xa0e"]):
        blocks = list(lm.token_blocks(pa.array(texts, pa.string())))
        assert [i for part, *_ in blocks for i in range(len(texts))[part]] == list(range(len(texts)))
        got = [w for _, _, words, _ in blocks for w in words.tolist()]
        want = [x for t in texts for x in split_words(lowered(t or "")) + ["\n"]]
        assert len(got) == len(want)
        assert all(seen.setdefault(x, w) == w for x, w in zip(want, got))
        for part, h, words, doc in blocks:
            assert h.tolist() == [int(lm.END), *words.tolist()[:-1]]
            assert np.bincount(doc, minlength=part.stop - part.start).tolist() == [len(split_words(t or "")) + 1 for t in texts[part]]
    assert len(set(seen.values())) == len(seen) > 900


def test_numbers_are_packed_and_read_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(lm.unstepped(lm.steps(x)), x)
        y = rng.integers(0, 2**32, n).astype("<u4")
        assert np.array_equal(lm.unplaned(lm.planes(y), "<u4"), y)


def test_scores_against_plain_python(spark):
    """Bigram probabilities from exact counts put through the levels, whichever way the filter is read."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randint(0, 60), weights=range(1, 31))) for i in range(300)}
    texts |= {300: None, 301: "w1 nowhere W2\tw29", 302: ""}
    train = {i: t for i, t in texts.items() if i < 250}
    split = lambda t: split_words(lowered(t or "")) + ["\n"]
    count, pairs = Counter(), Counter()
    for t in train.values():
        w = split(t)
        count.update(w)
        pairs.update(zip(["\n", *w], w))
    total, types = sum(count.values()), len(count)
    after = Counter(h for t in train.values() for h in ["\n", *split(t)][:-1])
    q = {p: math.floor(2 * 2 ** (math.floor(2 * math.log2(n / 2) + 1e-9) / 2) + 1e-9) for p, n in pairs.items() if n > 1}
    kept, words = Counter(h for h, _ in q), defaultdict(int)
    for (h, _), n in q.items():
        words[h] += n

    def score(t):
        out, h = 0.0, "\n"
        for w in split(t):
            share = (count[w] + 1) / (total + types + 1)
            s = after[h] + kept[h]
            p = (q.get((h, w), 0) + (s - words[h]) * share) / s if kept[h] else share
            out, h = out + math.log10(p), w
        return out

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (lm.SEGMENTS, 0):
        model, counts = lm.train_model(docs.where("doc_id < 250"), broadcast_to=most)
        assert (model.dealt is None) == (most > 0)
        # The filter's false positives are rare, so nearly all texts score as they should.
        got = {r.doc_id: r.score for r in lm.score_documents(docs, model, counts).collect()}
        right = [abs(got[i] - score(t)) < 1e-6 for i, t in texts.items()]
        assert len(got) == len(texts) and sum(right) >= 0.97 * len(right)


def test_base_scores_and_gain(spark, sf_dir):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    counted = Counter(t for i, text in rows if crc(i) % 7 != 2 for t in tokens(text))
    total, types = sum(counted.values()), len(counted)
    base = held_score = 0.0
    for r in lm.op6_lm_score(spark, sf_dir).collect():
        own = tokens(dict(rows)[r.doc_id])
        want = sum(math.log10((counted[t] + 1) / (total + types + 1)) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in counted for t in own), total)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.held_out == (crc(r.doc_id) % 7 == 2)
        assert r.score <= 0
        if r.held_out:
            base, held_score = base + r.base_score, held_score + r.score
    assert held_score > base


def test_probabilities_add_up_to_one(spark):
    """After any history, over all known words and the unknown one, apart from false positives."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=30, weights=range(1, 41))) for _ in range(200)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for frequent in (lm.FREQUENT, 5):
        model, counts = lm.train_model(train, frequent=frequent, broadcast_to=lm.SEGMENTS)
        exact = {r.h % 2**64: r.c for r in counts.collect()}
        _, _, words, _ = next(lm.token_blocks(pa.array([" ".join(vocabulary) + " unknown"])))
        for h in words:
            count, logs, backed = model.score_block(np.full(len(words), h, np.uint64), words)
            share = model.log_share(np.array([exact.get(int(w), 0) for w in words]))
            mass = (10 ** (logs + np.where(backed, share, 0))).sum()
            # Rare histories are rounded, so that they lose mass.
            assert 0.3 < mass < 1.01 if frequent == 5 else 0.98 < mass < 1.01


def test_levels_are_read_back(spark):
    keys = lm.mix(np.arange(3000, dtype=np.uint64))
    want = np.arange(3000) % 9
    rows = spark.createDataFrame([(int(k), int(v)) for k, v in zip(keys.view(np.int64), want) if v], "key long, level long")
    got = lm.levels(lm.build_filter(rows, 16), keys)
    assert (got >= want).all() and (got == want).mean() > 0.98


def test_a_filter_beyond_the_broadcast_keeps_all_counts(spark):
    """More entries than the broadcast holds: more segments, met in a shuffle, and the same scores."""
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(60)) for _ in range(400)] + [None, ""]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    model, counts = lm.train_model(docs, 1, 20)
    assert model.cut == 2 and model.n_segments > 1 and model.bits is None
    whole, same = lm.train_model(docs, model.n_segments, 20, model.n_segments)
    assert whole.cut == 2 and whole.n_segments == model.n_segments and whole.dealt is None
    got = {r.doc_id: r for r in lm.score_documents(docs, model, counts).collect()}
    want = {r.doc_id: r for r in lm.score_documents(docs, whole, same).collect()}
    assert got.keys() == want.keys() == set(range(402))
    for i, r in want.items():
        assert (got[i].n_tokens, got[i].n_known) == (r.n_tokens, r.n_known)
        assert got[i].score == pytest.approx(r.score, rel=1e-9) and got[i].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_odd_texts_are_scored(spark):
    model, counts = lm.train_model(documents(spark).where(~held_out("doc_id", 7, 2)))
    docs = documents(spark).withColumn("score", F.lit("x")).withColumn("t", F.lit("x")).withColumn("uid", F.lit("x"))
    found = lm.score_documents(docs, model, counts).collect()
    assert order((r.doc_id, r.n_tokens) for r in found) == order((i, len(tokens(t))) for i, t, *_ in cases())
    empty = documents(spark, [])
    model, counts = lm.train_model(empty)
    assert lm.score_documents(empty, model, counts).count() == 0
    assert all(r.score <= 0 for r in lm.score_documents(documents(spark), model, counts).collect())


# -- classifiers -----------------------------------------------------------------------


@pytest.mark.parametrize(("query", "column", "module"), [
    (toxicity.op9_toxicity, "toxic", toxicity), (quality.op2_quality_votes, "quality", quality)])
def test_held_out_accuracy(spark, query, column, module):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in query(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in held)
    assert len(held) > 30 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(crc(r.doc_id) % 5 == 0 for r in held)


@pytest.mark.parametrize(("scored", "column"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_odd_documents_and_labels(spark, scored, column):
    docs = documents(spark).withColumn("score", F.lit("x")).withColumn("label", F.lit("x"))
    some = [(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (3, 0, 0), (999, 1, 1)]
    for rows in (some, [], [(1, 1, 1), (2, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
        found = scored(docs, labels).collect()
        assert len(found) == len(cases()) and all(0 <= r.score <= 1 for r in found)
    assert scored(documents(spark, []), labels).count() == 0


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("rows", [
    [], [(i, 1, 1) for i in range(30)], [(i, 1, 0) for i in range(30)], [(i, 1, i % 2) for i in range(10)]])
def test_labels_that_teach_nothing_drop_nothing(spark, tmp_path, rows):
    """No labels, one class only, very few: the stage keeps all documents; predictions follow the score."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    assert order(map(tuple, kept.collect())) == order(map(tuple, docs.collect()))
    found = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found}) == 1


def test_rows_under_one_id_are_one_text_of_the_sample(spark):
    rows = [(1, f"text {i} of many", None, None, 0) for i in range(500)] + [(i, "fine", None, None, 0) for i in range(2, 60)]
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 60)], LABELS)
    many = toxicity.train(documents(spark, rows), labels)
    one = toxicity.train(documents(spark, rows[:1] + rows[500:]), labels)
    assert (many.learned, many.bias) == (one.learned, one.bias)


def test_prior_is_that_of_all_labels(spark):
    """The sample is balanced, the labels are not."""
    docs = documents(spark, [(i, "same", None, None, 4) for i in range(60)])
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(60)], LABELS)
    kept = [i for i in range(60) if crc(i) % 5]
    share = (sum(i % 10 == 1 for i in kept) + 1) / (len(kept) + 2)
    assert {round(r.score, 9) for r in toxicity.toxicity(docs, labels, per_class=2).collect()} == {round(share, 9)}


def test_votes_against_plain_python(spark):
    """The neighbours' votes, one document and one neighbour at a time."""
    rows = [(i, prose(3000 + i, 20 + i) + (" !! 12 AB" * (i % 3)), None, None, 0) for i in range(60)] + [(60, "", None, None, 0), (61, None, None, None, 0)]
    docs = documents(spark, rows)
    model = quality.train(docs, spark.createDataFrame([(i, int(i % 3 == 1), 0) for i in range(60)], LABELS))

    def plain(text):
        found = [0.0] * quality.SIZE
        last = None
        for word in (text or "").encode().split():
            w, s = xxhash.xxh64_intdigest(word.lower()) % 4096, 4096 + xxhash.xxh64_intdigest(quality.shape(word)) % 1023
            found[w] += 1
            found[s] += 1
            found[quality.REPEAT] += (w, s) == last
            last = w, s
        if not any(found):
            return model.prior
        shapes = max(1, sum(found[4096 : quality.REPEAT]))
        parts = [math.log1p(c) * float(i) for c, i in zip(found[:4096], model.idf)], [math.sqrt(c / shapes) for c in found[4096:]]
        x = []
        for part, share in zip(parts, (quality.WORD_PART, quality.SHAPE_PART)):
            length = math.sqrt(sum(c * c for c in part))
            x += [share * c / length for c in part]
        at = [sum(c * float(a) for c, a in zip(x, axis) if c) for axis in model.axes.T]
        length = math.sqrt(sum(c * c for c in at))
        votes = []
        for point, label, weight in zip(model.points, model.labels, model.weights):
            votes.append((sum(c * float(p) for c, p in zip(at, point)) / length, int(label), float(weight)))
        votes = [(max(0.0, like) ** quality.POWER * weight, label) for like, label, weight in sorted(votes)[-quality.NEIGHBOURS :]]
        return sum(v for v, label in votes if label) / sum(v for v, _ in votes)

    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(model.points) > 30 and len({round(s, 6) for s in got.values()}) > 10
    assert all(got[i] == pytest.approx(plain(t), abs=1e-3) for i, t, *_ in rows)


def test_logits_against_all_pairs(spark):
    """The factorization machine's score, one pair of terms at a time."""
    rows = [(i, prose(4000 + i, 30) + (" insult group" if i % 2 else " insult" if i % 3 else " group"), None, None, 0) for i in range(400)]
    docs = documents(spark, [*rows, (400, None, None, None, 0)])
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(400)], LABELS))
    place = {int(t): i for i, t in enumerate(model.known)}
    assert model.learned and len(place) > 3

    def plain(text):
        bare = {w.encode().strip(toxicity.MARKS) or w.encode() for w in split_words(lowered(text or ""))}
        own = {xxhash.xxh64_intdigest(t) % toxicity.BUCKETS for w in bare for t in (b"w" + w, b"4" + w[:4], b"5" + w[:5])}
        at = [place[t] for t in own if t in place]
        z = model.bias + sum(float(model.weights[i]) for i in at)
        z += sum(float(a * b) for n, i in enumerate(at) for j in at[:n] for a, b in zip(model.factors[i], model.factors[j]))
        return 1 / (1 + math.exp(-z))

    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == pytest.approx(plain(t), abs=1e-9) for i, t, *_ in rows) and got[400] == pytest.approx(plain(None))


def test_pairs_of_terms_are_learned():
    """Neither word alone is toxic, both together are."""
    rng, rows, labels = random.Random(0), [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        rows.append(toxicity.terms(" ".join(["insult"] * a + ["group"] * b + [f"w{rng.randrange(300)}" for _ in range(20)])))
        labels.append(a & b)
    model = toxicity.fit(rows, np.array(labels), deviates=2.0, epochs=60)
    seen = toxicity._Positions(model)
    score = lambda t: model.logit(t, seen)
    assert score("insult group") > 0 > max(score("insult"), score("group"), score("other"))
    both, single = score("insult group") - score(""), score("insult") + score("group") - 2 * score("")
    assert both > single


# -- top-k -----------------------------------------------------------------------------


def plain_topk(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in good]
    out = []
    for q, v in whole:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v)]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize(("block", "per"), [(8192, 2048), (16, 3)])
def test_topk_against_plain_python(spark, block, per):
    rng = random.Random(block)
    vector = lambda n=6: [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]
    rows = [(i, vector()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(40, vector()), (41, vector()), (41, rows[3][1])]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [math.nan] * 6), (None, vector())]
    rows += [(304, [math.inf] + [0.0] * 5), (320, vector(3)), (321, vector(3)), (340, [0.0] * 6), (360, [1e9] * 6), (380, [1.5] * 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("number", F.lit(1)).withColumn("rank", F.lit(1))
    found = topk.topk(vectors, vectors.where("vec_id % 20 = 0"), 5, block, per)
    assert order(tuple(r) for r in found.collect()) == order(plain_topk(rows, 5))
    none = vectors.where("false")
    assert topk.topk(none, none).count() == topk.topk(vectors, none).count() == topk.topk(none, vectors).count() == 0


def test_reading_stops_at_the_threshold(monkeypatch):
    """With one long dimension, few vectors are met before the bound falls below the k-th score."""
    rng = np.random.default_rng(0)
    cells = rng.integers(-3, 4, (5000, 4))
    cells[:, 0] = rng.permutation(5000)
    block = topk.Block(np.arange(5000), cells)
    asked = np.array([[50, 1, 0, 0]])
    met = []
    plain = topk.Block._better
    monkeypatch.setattr(topk.Block, "_better", lambda s, b, rows, *a: (met.append(len(rows)), plain(s, b, rows, *a))[1])
    _, ids, score = block.top(np.array([-1]), asked, 10)
    want = sorted((-(asked @ cells.T)[0]).tolist())[:10]
    assert sorted((-score).tolist()) == want and sum(met) < 5000


@pytest.mark.parametrize("kind", ["clustered", "random", "equal"])
def test_blocks_that_cannot_reach_a_floor_are_not_met(spark, kind):
    """Of clustered vectors few pairs are shipped and fewer scored; of random and equal ones all may be."""
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=(n, 16)) * (0.05 if kind == "clustered" else 1) + (rng.normal(size=(40, 16))[rng.integers(0, 40, n)] if kind == "clustered" else 0)
    x = np.ones((n, 16)) if kind == "equal" else x
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0")
    own, asked = topk.blocks(vectors, queries, 100, 20)
    asked = topk.with_floors(asked, own, 5)
    met = topk.meetings(asked, own).collect()
    shipped = sum(len(r.places) // 4 for r in met) / (200 * own.count())
    cells = {r.v_block: (np.frombuffer(r.v_ids, "<i8"), topk._numbers(r.v_cells, 16)) for r in own.collect()}
    some = {r.q_block: r for r in asked.collect()}
    scored = 0
    for r in met:
        q, at, block = some[r.m_query], np.frombuffer(r.places, "<i4"), topk.Block(*cells[r.m_block])
        block.top(np.frombuffer(q.q_ids, "<i8")[at], topk._numbers(q.q_cells, 16)[at], 5, np.frombuffer(q.floors, "<i8")[at])
        scored += block.scored
    if kind == "clustered":
        assert shipped < 0.3 and scored / (200 * n) < 0.25
    whole = np.floor(64 * x).astype(np.int64)
    want = []
    for i in range(0, n, 20):
        scores = whole @ whole[i]
        best = [j for j in np.lexsort((np.arange(n), -scores)).tolist() if j != i][:5]
        want += [(i, place, j, int(scores[j])) for place, j in enumerate(best, 1)]
    assert order(tuple(r) for r in topk.topk(vectors, queries, 5, 100, 20).collect()) == order(want)


# -- pipeline --------------------------------------------------------------------------


def test_each_stage_against_plain_python(spark, sf_dir):
    from test_llm_text import plain_find, plain_line_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]

    clean = stored(stages["toxicity"](spark, docs, sf_dir), "t")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}

    short = stored(stages["line_dedup"](spark, clean, sf_dir), "l")
    kept = [r for r in rows if scores[r[0]] < toxicity.THRESHOLD]
    assert order((r.doc_id, r.text) for r in short.collect()) == order(r[:2] for r in plain_line_dedup(kept))

    single = stored(stages["simhash_near_dedup"](spark, short, sf_dir), "s")
    texts = sorted((r.doc_id, r.text) for r in short.collect())
    prints = [plain_fingerprint(t) for _, t in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    firsts = {}
    for (doc_id, _), root in zip(texts, groups(len(texts), close)):
        firsts.setdefault(root, doc_id)
    assert {r.doc_id for r in single.collect()} == set(firsts.values())

    fair = stored(stages["decontamination"](spark, single, sf_dir), "d")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {r[0] for r in plain_find([tuple(r) for r in single.collect()], items)}
    assert {r.doc_id for r in fair.collect()} == set(firsts.values()) - held

    packed = stages["best_fit_packing"](spark, fair, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in fair.collect()}
    assert clean.columns == short.columns == single.columns == fair.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_digests_of_repeats(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest())
            for (i, _), (n, gone, spans, kept) in zip(docs, plain_repeats([t for _, t in docs]))]
    assert order(tuple(r) for r in repeats.op4_suffix_dedup(spark, sf_dir).collect()) == order(want)
