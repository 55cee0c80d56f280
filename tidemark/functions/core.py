"""Scalar functions: latency buckets, log lines, intervals and ids."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the request latency histogram, in seconds. Fixed values.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def bucket(seconds: Column, bounds=BOUNDS) -> Column:
    """The histogram bucket of a value: how many bounds it is above; a bound belongs to the bucket below it."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(seconds > F.lit(b), 1).otherwise(0)
    return out


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times, never below 0, in seconds."""
    return F.greatest(F.unix_millis(end) - F.unix_millis(start), F.lit(0).cast("long")) / 1000


def interval_ns(rate: Column) -> Column:
    """Nanoseconds between the events of a rate for a second; the rate counts as 1 at least, the result too."""
    return F.greatest(F.floor(F.lit(10**9) / F.greatest(rate, F.lit(1))), F.lit(1)).cast("long")


def log_time(ts: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "MM-dd|HH:mm:ss.SSS"), F.lit("]"))


def log_message(message: Column, explicit: bool = False) -> Column:
    """Padded on the right to 40, explicit string messages to 60 first; never cut."""
    width = 60 if explicit else 40
    return F.rpad(message, F.greatest(F.length(message), F.lit(width)), F.lit(" "))


def log_field(name: str, value: Column, quoted: bool = False) -> Column:
    return F.concat(F.lit(f"{name}="), F.concat(F.lit('"'), value, F.lit('"')) if quoted else value.cast("string"))


def log_line(level: Column, ts: Column, message: Column, *fields: Column, explicit: bool = False) -> Column:
    when = F.coalesce(log_time(ts), F.lit("[<unknown-timestamp>]"))
    return F.concat_ws(" ", F.concat(F.lit("["), level, F.lit("]")), when, log_message(message, explicit), *fields)


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(millis: int, random: bytes | None = None) -> str:
    """26 characters: 48 bits of time and 80 random ones. A time before 1970 is an error."""
    if not 0 <= millis < 1 << 48:
        raise ValueError("a ULID's time has 48 bits")
    n = millis << 80 | int.from_bytes(random or os.urandom(10), "big")
    return "".join(CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def uuid7(millis: int, random: bytes | None = None) -> str:
    """A time-ordered task id."""
    r = int.from_bytes(random or os.urandom(10), "big")
    n = (millis & (1 << 48) - 1) << 80 | 7 << 76 | (r >> 68 & 0xFFF) << 64 | 0b10 << 62 | r & (1 << 62) - 1
    return str(uuid.UUID(int=n))


def ulid_of(millis: Column, high: Column, low: Column) -> Column:
    """A column of ULIDs: 48 bits of time, then the low 40 bits of two numbers, which random_40() gives."""
    letter = lambda x, i: F.substr(F.lit(CROCKFORD), F.shiftright(x, 5 * i).bitwiseAND(F.lit(31).cast("long")).cast("int") + 1, F.lit(1))
    ok = F.when((millis >= 0) & (millis < 1 << 48), millis).otherwise(F.raise_error(F.lit("a ULID's time has 48 bits")))
    return F.concat(*[letter(ok, i) for i in range(9, -1, -1)], *[letter(x, i) for x in (high, low) for i in range(7, -1, -1)])


def random_40() -> Column:
    return F.floor(F.rand() * float(1 << 40)).cast("long")


def uuid7_of(millis: Column, high: Column, low: Column) -> Column:
    """A column of time-ordered ids: 48 bits of time, 12 bits of high, 62 bits of low."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    long = lambda v: F.lit(v).cast("long")
    head = digits(millis.bitwiseAND(long((1 << 48) - 1)), 12)
    tail = digits(low.bitwiseAND(long((1 << 62) - 1)).bitwiseOR(long(-(1 << 63))), 16)
    return F.concat_ws("-", F.left(head, F.lit(8)), F.right(head, F.lit(4)), F.concat(F.lit("7"), digits(high.bitwiseAND(long(0xFFF)), 3)), F.left(tail, F.lit(4)), F.right(tail, F.lit(12)))


def uuid4() -> Column:
    """Random ids with the bits of version 4."""
    return F.uuid()


#: From the least to the most severe. Fixed values.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")


def at_least(level: Column, least: str = "INFO") -> Column:
    """Whether a log line of this level is kept."""
    return level.isin(*LEVELS[LEVELS.index(least) :])


def log_json(level: Column, ts: Column, message: Column, **fields: Column) -> Column:
    """A log line as one JSON object."""
    return F.to_json(F.struct(level.alias("level"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), message.alias("message"), *[c.alias(k) for k, c in fields.items()]))
