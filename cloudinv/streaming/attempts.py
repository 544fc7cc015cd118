"""Delivery of files with a bounded number of attempts, as keyed stream state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_ATTEMPTS = 3
READ, DEAD = "read", "dead"

OUTCOME = "path string, version string, attempt int, ok boolean"
TASK = "path string, version string, attempt int, verdict string"


class Attempts(StatefulProcessor):
    """Per file: the number of the running attempt, and whether its outcome is still awaited.

    A file is asked for once, whatever messages repeat. A failed attempt is followed by the next one
    at once; the last failure makes the file a dead letter. A timer stands for an outcome that
    never comes: when the watermark passes it the attempt has failed. A file that is done is
    remembered until then. Outcomes of other attempts than the running one, as a replayed batch writes them, are passed
    over.
    """

    def __init__(self, most: int, patience_ms: int):
        self.most, self.patience_ms = most, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", "attempt int, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = pd.concat(list(rows))
        now = int(facts["arrived_at"].max().timestamp() * 1000)
        if facts["attempt"].isna().any() and not self.state.exists():
            yield self._begin(key, 1, now)
        for attempt, ok in facts.dropna(subset=["attempt"])[["attempt", "ok"]].itertuples(index=False):
            if self.state.exists() and self.state.get() == (int(attempt), True):
                if ok:
                    self.state.update((int(attempt), False))
                else:
                    yield self._failed(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        if self.state.get()[1]:
            yield self._failed(key, expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.state.clear()

    def close(self) -> None:
        pass

    def _begin(self, key, attempt: int, now: int) -> pd.DataFrame:
        self.state.update((attempt, True))
        return self._told(key, attempt, READ, now)

    def _failed(self, key, now: int) -> pd.DataFrame:
        attempt = self.state.get()[0]
        if attempt < self.most:
            return self._begin(key, attempt + 1, now)
        self.state.update((attempt, False))
        return self._told(key, attempt, DEAD, now)

    def _told(self, key, attempt: int, verdict: str, now: int) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.patience_ms)
        return pd.DataFrame({"path": [key[0]], "version": [key[1]], "attempt": [attempt], "verdict": [verdict]})


def attempts(notices: DataFrame, outcomes: DataFrame, most: int = MAX_ATTEMPTS, patience_ms: int = 3_600_000) -> DataFrame:
    """``path, version, attempt, verdict``: files to read now, and files given up.

    ``notices`` has path, version and arrived_at with a watermark, ``outcomes`` what became of the
    attempts so far, with arrived_at. An outcome is awaited for ``patience_ms`` and the delay of the watermark. Both are streams; state is kept by file, so no list of files grows on the driver.
    """
    asked = notices.select(
        "path", "version", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("boolean").alias("ok"), "arrived_at"
    )
    return (
        asked.unionByName(outcomes)
        .groupBy("path", "version")
        .transformWithStateInPandas(
            statefulProcessor=Attempts(most, patience_ms),
            outputStructType=TASK,
            outputMode="append",
            timeMode="eventTime",
        )
    )
