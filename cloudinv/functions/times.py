"""Timestamp parsing and literals that do not depend on the session time zone."""

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of 0001-01-01 and 10000-01-01; epoch numbers outside are not dates.
_MIN_EPOCH = -62135596800
_MAX_EPOCH = 253402300800

_NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
# The usual spelling needs one match and one cast; the others are brought into it.
_USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?"
_OFFSET = r"[+-]\d{2}:\d{2}(:\d{2})?$"
_REWRITES = (
    (r"Z", "+00:00"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})($|[+-])", "$1:00$2"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})($|[+-])", "$1:00$2"),
    (r"(\d),(\d)", "$1.$2"),
    (r"(:\d{2}(?:\.\d+)?)([+-]\d{2})(\d{2})$", "$1$2:$3"),
    (r"(:\d{2}(?:\.\d+)?)([+-]\d{2})$", "$1$2:00"),
)


def instant(value) -> Column:
    """A timestamp column from a datetime (naive means UTC), ISO text or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    delta = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def parse_ts(text: Column) -> Column:
    """Lenient timestamp: epoch seconds or ISO text; anything else is NULL.

    Text without an offset is UTC. Digits are read as epoch seconds, as a JSON
    number and the same digits in quotes look alike once held as text.
    """
    seconds = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    from_epoch = F.when(
        (seconds >= _MIN_EPOCH) & (seconds < _MAX_EPOCH),
        F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")),
    )
    usual = F.when(text.rlike(_USUAL), text.try_cast("timestamp"))
    iso = text
    for pattern, replacement in _REWRITES:
        iso = F.regexp_replace(iso, pattern, replacement)
    with_zone = (
        F.when(iso.rlike(_DATE), F.concat(iso, F.lit("T00:00:00+00:00")))
        .when(iso.rlike(_DATETIME + "$"), F.concat(iso, F.lit("+00:00")))
        .when(iso.rlike(_DATETIME + _OFFSET), iso)
    )
    return F.coalesce(usual, from_epoch, with_zone.try_cast("timestamp"))
