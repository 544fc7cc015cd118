"""Token counts that follow edits.

Each document keeps a segment tree over runs of pre-tokens: the characters and tokens of each run
in the leaves, sums above. A run ends only where a single space stands between two visible
characters, which always begins a new pre-token whatever else the text holds. An edit re-encodes
the runs it touches, with those whose border lies too near, and updates the sums above them.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudinv.llm.byte_bpe import Encoder, encoder
from cloudinv.llm.common import read

#: Characters of a run, about.
RUN = 512
_VISIBLE = "[!-~À-ɏͰ-ϿЀ-ӿ]"
BORDER = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")


def runs(text: str, run: int) -> list[str]:
    """``text`` cut at borders, each cut at least ``run`` characters after the last."""
    found, at = [], 0
    while at < len(text):
        border = BORDER.search(text, at + run)
        end = border.start() if border else len(text)
        found.append(text[at:end])
        at = end
    return found


class Tree:
    """Leaf i of ``size`` stands at ``size + i``; node n sums 2n and 2n+1; node 1 sums all."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    @classmethod
    def of(cls, leaves: list[tuple[int, int]]) -> "Tree":
        size = 1
        while size < len(leaves):
            size *= 2
        empty = [(0, 0)] * (size - len(leaves))
        tree = cls(*([0] * size + [leaf[i] for leaf in leaves + empty] for i in (0, 1)))
        for node in range(size - 1, 0, -1):
            tree._sum(node)
        return tree

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character at ``place``, where that leaf starts); the last at the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, first: int, leaves: list[tuple[int, int]]) -> None:
        """New leaves from ``first`` on, and the sums above them."""
        low = self.size + first
        high = low + len(leaves) - 1
        for node, (chars, tokens) in enumerate(leaves, low):
            self.chars[node], self.tokens[node] = chars, tokens
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                self._sum(node)


def plant(text: str, bpe: Encoder, run: int) -> Tree:
    return Tree.of([(len(r), bpe.count(r)) for r in runs(text, run)] or [(0, 0)])


def edit(text: str, tree: Tree, start: int, stop: int, new: str, bpe: Encoder, run: int) -> tuple[str, Tree, int]:
    """The text and tree with ``new`` in place of [start, stop), and how many characters were encoded.

    A border stays one while the characters on both sides of its space stay, so the runs from the
    last border two characters before the edit to the first one after it are encoded again.
    """
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    first, begin = tree.find(max(start - 2, 0))
    last, end = tree.find(stop)
    end += tree.chars[tree.size + last]
    if end == stop and end < len(text):
        last, end = tree.find(end)
        end += tree.chars[tree.size + last]
    whole = text[:start] + new + text[stop:]
    region = whole[begin : end + len(whole) - len(text)]
    made = [(len(r), bpe.count(r)) for r in runs(region, run)]
    slots = last - first + 1
    if len(made) > 8 * slots:
        # A long insertion: the leaves are laid out anew, the counts of the untouched ones stay.
        old = list(zip(tree.chars, tree.tokens))[tree.size :]
        leaves = [leaf for leaf in old[:first] + made + old[last + 1 :] if leaf[0]]
        return whole, Tree.of(leaves or [(0, 0)]), len(region)
    kept = made[: slots - 1] + [tuple(map(sum, zip(*made[slots - 1 :]))) or (0, 0)]
    tree.put(first, kept + [(0, 0)] * (slots - len(kept)))
    return whole, tree, len(region)


TREE = "chars array<int>, tokens array<int>, n_tokens long"


def count_tokens(docs: DataFrame, run: int = RUN, ranks_path: str | None = None) -> DataFrame:
    """doc_id, text, chars, tokens (the tree, root at 1), n_tokens of each row of ``docs``.

    A null text is empty and has no tokens. Repeated rows have a tree each.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                trees = [plant(t or "", bpe, run) for t in own.column(1).to_pylist()]
                yield _with_trees(own.column(0), own.column(1), trees)

    names = ["doc_id long", "text string", TREE]
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        build, ", ".join(names)
    )


def _with_trees(ids, texts, trees, *more) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    columns = [
        ids, texts, pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind),
        pa.array([t.tokens[1] for t in trees], pa.int64()), *[pa.array(c, pa.int64()) for c in more],
    ]
    names = ["doc_id", "text", "chars", "tokens", "n_tokens", "n_before", "n_edits", "n_encoded"]
    return pa.RecordBatch.from_arrays(columns, names[: len(columns)])


def apply_edits(counted: DataFrame, edits: DataFrame, run: int = RUN, ranks_path: str | None = None) -> DataFrame:
    """``counted`` rows after their edits, with n_before, n_edits and n_encoded (characters).

    ``edits``: doc_id, seq, start, stop, replacement. They are applied by ascending seq (ties by
    start, stop, replacement), each to the text that the former one left; [start, stop) is clipped
    to that text. A null replacement is empty, a null start is the end, a null stop is the start.
    Rows without edits stay as they are; rows that share a doc_id get the same edits; edits of
    other ids are passed over. One document's edits meet in one row, as its text does.
    """
    own = F.struct("seq", "start", "stop", F.coalesce("replacement", F.lit("")).alias("new"))
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("edits")).withColumnRenamed("doc_id", "e")
    # A shuffle of its own lets adaptive execution split an id that very many rows share.
    listed = listed.hint("rebalance")
    joined = counted.join(listed, counted["doc_id"].eqNullSafe(listed["e"]), "left")

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, trees, before, n_edits, encoded = [], [], [], [], []
                for text, chars, tokens, mine in zip(*(c.to_pylist() for c in part.columns[1:])):
                    tree, done = Tree(chars, tokens), 0
                    before.append(tokens[1])
                    for e in mine or ():
                        start = len(text) if e["start"] is None else e["start"]
                        stop = start if e["stop"] is None else e["stop"]
                        text, tree, n = edit(text, tree, start, stop, e["new"], bpe, run)
                        done += n
                    texts.append(text)
                    trees.append(tree)
                    n_edits.append(len(mine or ()))
                    encoded.append(done)
                yield _with_trees(part.column(0), pa.array(texts, pa.string()), trees, before, n_edits, encoded)

    return joined.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(
        run_all, f"doc_id long, text string, {TREE}, n_before long, n_edits long, n_encoded long"
    )


def demo_edits(docs: DataFrame) -> DataFrame:
    """Three edits for every doc_id: a cut at a third, a repeat at the half, and its source at the end.

    Of rows that share an id (null ids are one id) the least edits count, so an id has three however
    many rows it has.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    edit_of = lambda seq, start, stop, new: F.struct(
        F.lit(seq).alias("seq"), start.cast("int").alias("start"), stop.cast("int").alias("stop"),
        new.alias("replacement"),
    )
    three = F.array(
        edit_of(1, F.floor(n / 3), F.floor(n / 3) + 12, F.lit("")),
        edit_of(2, F.floor(n / 2), F.floor(n / 2), F.substring("text", 1, 24)),
        edit_of(3, F.lit(None), F.lit(None), F.concat(F.lit(" "), F.coalesce("source", F.lit("")))),
    )
    one = docs.groupBy("doc_id").agg(F.min(three).alias("three"))
    return one.select("doc_id", F.explode("three").alias("x")).select("doc_id", "x.*")


def op1_token_counts(spark, sf_dir) -> DataFrame:
    """Tokens of all ``documents`` before and after three edits of each; see :func:`apply_edits`.

    Null texts are empty. Rows that share an id, or have none, get the same three edits.
    """
    docs = read(spark, sf_dir, "documents")
    found = apply_edits(count_tokens(docs), demo_edits(docs))
    return found.select("doc_id", "n_before", "n_edits", "n_encoded", "n_tokens")
