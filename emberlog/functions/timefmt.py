"""Time literals, RFC 3339 text and date keys."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the instant that stands for "no timestamp".
ZERO_TIME = "0001-01-01T00:00:00Z"
# Fixed pattern: RFC 3339 with an upper-case T and an explicit offset.
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def utc(value: datetime | str) -> datetime:
    """An aware UTC datetime; text and naive values are read as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def time_literal(value: datetime | str, dtype: T.DataType) -> Column:
    """A literal of the column's own type, so that comparisons reach the Parquet scan uncast."""
    stamp = utc(value)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(micros(stamp)))


def micros(value: datetime | str) -> int:
    """Whole microseconds since the epoch."""
    delta = utc(value) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of strict RFC 3339 text, else null. Digits beyond microseconds are dropped."""
    return F.when(text.rlike(RFC3339_PATTERN), text.try_cast("timestamp"))


def fill_missing(ts: Column, now: Column) -> Column:
    """Replace a missing or zero timestamp by `now`."""
    zero = F.lit(ZERO_TIME).cast("timestamp")
    return F.when(ts.isNull() | (ts == zero), now).otherwise(ts)


def rfc3339_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def rfc3339_micros(ts: Column) -> Column:
    """RFC 3339 with the shortest fraction, which is how a timestamp casts to text."""
    return F.concat(F.translate(ts.cast("string"), " ", "T"), F.date_format(ts, "XXX"))


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def unix_nanos(ts: Column) -> Column:
    return as_micros(ts) * F.lit(1000)


def object_key(first_ts: Column) -> Column:
    """Archive key of a chunk whose earliest row has this timestamp."""
    return F.concat(F.lit("logs/"), date_key(first_ts), F.lit("/"), unix_nanos(first_ts).cast("string"),
                    F.lit(".json.gz"))


def elapsed_millis(started: Column, ended: Column) -> Column:
    """Whole elapsed milliseconds, fraction dropped, as a double."""
    return F.floor((as_micros(ended) - as_micros(started)) / F.lit(1000)).cast("double")
