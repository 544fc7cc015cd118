"""Keeping the inventory fresh: latest rows, merging, expiry."""

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudinv.functions.times import instant
from cloudinv.operators.shaping import live
from cloudinv.sources.tables import staged

KEY = ("account_id", "arn")
RECENCY = ("last_seen_at", "captured_at", "source_key")


def _newest_first(df: DataFrame, order: tuple[str, ...]) -> list[Column]:
    """Descending recency; a hash of the whole row settles equal observations."""
    ranking = [F.col(c).desc_nulls_last() for c in order if c in df.columns]
    return [*ranking, F.xxhash64(*df.columns).desc()]


def latest(
    df: DataFrame, keys: tuple[str, ...] = KEY, order: tuple[str, ...] = RECENCY
) -> DataFrame:
    """The newest row of every key.

    The rank filter is applied before the shuffle as well, so a key with very many
    observations sends one row per input partition.
    """
    newest = Window.partitionBy(*keys).orderBy(*_newest_first(df, order))
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def live_latest(df: DataFrame, as_of, ttl_hours: int = 24) -> DataFrame:
    """One row per live resource."""
    return latest(live(df, as_of, ttl_hours))


def merge_latest(
    target: DataFrame,
    source: DataFrame | None = None,
    mode: str = "collapse",
    keys: tuple[str, ...] = KEY,
    order: tuple[str, ...] = RECENCY,
) -> DataFrame:
    """Merge newer observations into the table.

    ``collapse`` gives one row per key. ``update`` keeps the row count of the target:
    older rows take the newest values, unknown keys are added. Without a source the
    table is merged with its own newest rows.
    """
    if mode == "collapse":
        both = target if source is None else target.unionByName(source.select(*target.columns))
        return latest(both, keys, order)
    if mode != "update":
        raise ValueError(f"unknown merge mode: {mode}")
    newest = latest(target if source is None else source, keys, order)
    payload = [c for c in target.columns if c not in keys]
    # A shuffle of its own lets adaptive execution split a key with very many rows.
    incoming = newest.select(*keys, F.struct(*payload).alias("_new")).hint("rebalance")
    time = order[0]
    newer = F.coalesce(F.col(time) < F.col("_new")[time], F.lit(False))
    updated = target.join(incoming, list(keys), "left").select(
        *[
            F.col(c)
            if c in keys
            else F.when(newer, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            for c in target.columns
        ]
    )
    # The anti join ships each key of the target once and no payload. A NULL key equals
    # nothing and is inserted, as MERGE does.
    known = target.select(*keys).distinct()
    added = newest.join(known, list(keys), "left_anti").select(*target.columns)
    return updated.unionByName(added)


def drop_expired(df: DataFrame, as_of, days: int = 7, column: str = "last_seen_at") -> DataFrame:
    """What a delete of rows older than some days leaves; unknown times stay."""
    cutoff = instant(as_of) - F.expr(f"interval {int(days)} days")
    return df.where(F.col(column).isNull() | (F.col(column) >= cutoff))


def nightly(df: DataFrame, as_of, days: int = 7) -> DataFrame:
    """The table after a maintenance run: merged first, then expired."""
    return drop_expired(merge_latest(df), as_of, days)


def nightly_changes(
    base: DataFrame, landed: DataFrame, as_of, days: int = 7, keys: tuple[str, ...] = KEY
) -> tuple[DataFrame, DataFrame]:
    """Accounts that a maintenance run changes, and all their rows after it.

    ``base`` is the outcome of an earlier run, one row per key, and ``landed`` what has come
    since; neither has rows without an account. Accounts that have neither landed nor expired
    rows are not among the first and need no rewriting. Where ``base`` is partitioned by account,
    the list of accounts prunes its folders: of the others only the time is read.
    """
    cutoff = instant(as_of) - F.expr(f"interval {int(days)} days")
    expired = base.where(F.col("last_seen_at") < cutoff).select("account_id")
    touched = staged(landed.select("account_id").union(expired).distinct(), "accounts")
    # The comparison says that the list is a selection, which makes Spark prune by it.
    rows = base.join(touched.where(F.col("account_id") >= ""), "account_id", "left_semi")
    merged = latest(rows.select(*base.columns).unionByName(landed.select(*base.columns)), keys)
    return touched, drop_expired(merged, as_of, days)


def merge_buckets(base: DataFrame, landed: DataFrame) -> DataFrame:
    """One row per key of ``base``, which has one already, and ``landed``.

    Only what has landed is shuffled, into the buckets of ``base`` (see ``tables.read_buckets``); the
    base is read bucket by bucket where it lies. Keys are never NULL in the table.
    """
    order = [c for c in RECENCY if c in base.columns]
    # Sorted as `latest` sorts: NULLs are the oldest, a hash of the whole row settles ties.
    rank = lambda df: F.struct(*[df[c] for c in order], F.xxhash64(*[df[c] for c in base.columns]))
    newest = latest(landed.select(*base.columns))
    new = newest.select(*[F.col(k) for k in KEY], F.struct(*base.columns).alias("_new"), rank(newest).alias("_rank_new"))
    old = base.select(*[F.col(k) for k in KEY], F.struct(*base.columns).alias("_old"), rank(base).alias("_rank_old"))
    both = old.join(new, list(KEY), "full_outer")
    takes_new = F.col("_old").isNull() | F.coalesce(F.col("_rank_new") > F.col("_rank_old"), F.lit(False))
    return both.select(F.when(takes_new, F.col("_new")).otherwise(F.col("_old")).alias("_row")).select("_row.*")


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: str = "key",
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key.

    Only the new keys travel to the old side, each once; Spark broadcasts few of them.
    """
    fresh = latest(new, (key,), order)
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))


class PrefixRules:
    """Rules by the start of a text, as sorted stretches of texts that one rule decides.

    A rule covers the texts from its prefix to the first text beyond it; a longer prefix cuts its
    stretch out of a shorter one. So there are at most two stretches for each rule, and the one
    that holds a text is found by halving.
    """

    def __init__(self, rules: Iterable[tuple[str, int]]):
        starts: list[str] = [""]
        values: list[int | None] = [None]
        covering: list[tuple[str | None, int | None]] = [(None, None)]

        def begin(start: str, value: int | None) -> None:
            if starts[-1] == start:
                values[-1] = value
            else:
                starts.append(start)
                values.append(value)

        def leave(before: str | None) -> None:
            """Close the stretches that end before a text, innermost first."""
            while len(covering) > 1 and covering[-1][0] is not None and (before is None or covering[-1][0] <= before):
                end, _ = covering.pop()
                begin(end, covering[-1][1])

        for prefix, value in sorted(dict(rules).items()):
            leave(prefix)
            begin(prefix, value)
            covering.append((self._beyond(prefix), value))
        leave(None)
        self.starts, self.values = np.array(starts, np.str_), pd.array(values, dtype="Int32")

    @staticmethod
    def _beyond(prefix: str) -> str | None:
        """The least text after all that begin with ``prefix``; none if there is no such text."""
        kept = prefix.rstrip("\U0010ffff")
        return kept[:-1] + chr(ord(kept[-1]) + 1) if kept else None

    def of(self, texts: pd.Series) -> pd.Series:
        known = texts.fillna("").to_numpy(dtype=np.str_)
        found = pd.Series(self.values[np.searchsorted(self.starts, known, side="right") - 1], index=texts.index)
        return found.where(texts.notna())


def expired_files(files: DataFrame, rules: Iterable[tuple[str, int]], as_of) -> DataFrame:
    """Files past the age their folder allows: ``path, modified_at, days``.

    ``rules`` pairs the start of a path, bucket and prefix without the scheme, with a number
    of days. The longest start that fits decides; files without a rule are kept. The rules go to
    the tasks as a sorted index, so many thousands of them cost no more than a few per file, and files
    are not shuffled.
    """
    index = PrefixRules(rules)

    @F.pandas_udf("int")
    def days(place: pd.Series) -> pd.Series:
        return index.of(place)

    place = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    aged = files.select("path", "modified_at", days(place).alias("days"))
    cutoff = instant(as_of) - F.make_dt_interval(F.col("days"))
    return aged.where(F.col("days").isNotNull() & (F.col("modified_at") < cutoff))
