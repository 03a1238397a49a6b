"""Time expressions.

Two readings of one ISO text are kept side by side: the wall clock as written
(``TIMESTAMP_NTZ``; dates, AM/PM and daylight use it) and the instant as a
BIGINT of microseconds since the epoch (ordering, overlaps and differences use
it). Integer microseconds make comparisons exact and independent of the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.settings import MICROS

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
# Fixed value: date text with colons, as cameras write it.
_COLON_DATE = r"^(\d{4}):(\d{2}):(\d{2})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp, whatever the session zone is."""
    value = _col(c)
    fraction = (F.date_part(F.lit("SECOND"), value) * MICROS).cast("bigint") % MICROS
    return F.unix_timestamp(value).cast("bigint") * MICROS + fraction


def micros_ntz(c: Column | str) -> Column:
    """Inverse of :func:`ntz_micros`."""
    value = _col(c)
    return F.timestamp_add("MICROSECOND", value, F.to_timestamp_ntz(F.lit("1970-01-01T00:00:00")))


def clean_time_text(c: Column | str) -> Column:
    """Colon dates become dashes, `` UTC`` becomes ``Z``, the separator becomes ``T``."""
    text = F.regexp_replace(F.trim(_col(c)), r"\s*UTC$", "Z")
    text = F.regexp_replace(text, _COLON_DATE, r"$1-$2-$3")
    return F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}) ", r"$1T")


def local_time(c: Column | str) -> Column:
    """Wall clock as written; the offset is dropped, not applied. Unreadable text is null."""
    text = F.regexp_replace(clean_time_text(c), _OFFSET, "")
    return text.try_cast("timestamp_ntz")


def offset_seconds(c: Column | str) -> Column:
    """Offset east of UTC written at the end of the text; null when there is none."""
    mark = F.regexp_extract(clean_time_text(c), _OFFSET, 1)
    digits = F.regexp_replace(mark, "[^0-9]", "")
    seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    return (
        F.when(mark == "Z", F.lit(0))
        .when(F.startswith(mark, F.lit("-")), -seconds)
        .when(F.startswith(mark, F.lit("+")), seconds)
    )


def instant_micros(c: Column | str, zone: str | None = None) -> Column:
    """Instant of an ISO or camera text. Text without offset is read in ``zone`` (UTC if none)."""
    wall = local_time(c)
    naive = ntz_micros(wall)
    if zone is not None:
        naive = F.unix_timestamp(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)).cast("bigint") * MICROS + (
            ntz_micros(wall) % MICROS
        )
    return F.coalesce(ntz_micros(wall) - offset_seconds(c).cast("bigint") * MICROS, naive)


def iso_in_zone(micros: Column, zone: str) -> Column:
    """ISO text with numeric offset for an instant shown in ``zone``."""
    utc = micros_ntz(micros)
    shown = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    shift = F.unix_timestamp(shown) - F.unix_timestamp(utc)
    size = F.abs(shift)
    sign = F.when(shift < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(
        iso_text(shown), sign,
        F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0"),
    )


def iso_text(ntz: Column) -> Column:
    """ISO text of a wall clock, with microseconds only when they are not zero."""
    micros = (F.date_part(F.lit("SECOND"), ntz) * MICROS).cast("bigint") % MICROS
    base = F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def offset_text(c: Column | str) -> Column:
    """The offset as written, blank if there is none."""
    return F.regexp_extract(clean_time_text(c), _OFFSET, 1)


def shift_iso(c: Column | str, seconds: Column) -> Column:
    """ISO text moved by ``seconds``, keeping the offset that was written."""
    moved = micros_ntz(ntz_micros(local_time(c)) + F.round(seconds * MICROS).cast("bigint"))
    return F.concat(iso_text(moved), offset_text(c))


def with_time_columns(df: DataFrame, zone: str | None = None) -> DataFrame:
    """Add ``start_us``, ``end_us``, ``local_date`` and ``local_hour`` from the text columns."""
    null = F.lit(None)
    start = F.col("start_time") if "start_time" in df.columns else null.cast("string")
    end = F.col("end_time") if "end_time" in df.columns else null.cast("string")
    wall = local_time(start)
    return df.withColumns(
        {
            "start_us": instant_micros(start, zone),
            "end_us": instant_micros(end, zone),
            "local_date": wall.cast("date"),
            "local_hour": F.hour(wall),
        }
    )


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds two intervals share; zero when any bound is missing."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    span = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(known & (span > 0), span / F.lit(float(MICROS))).otherwise(F.lit(0.0))


def seconds_between(start: Column, end: Column, fallback: Column) -> Column:
    return F.coalesce((end - start) / F.lit(float(MICROS)), fallback)


def excel_date(c: Column | str) -> Column:
    """Serial day number (1899-12-30 is day 0) or date text."""
    text = F.trim(_col(c).cast("string"))
    serial = text.try_cast("double")
    return F.coalesce(
        F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")),
        F.try_to_timestamp(text).cast("date"),
    )


def duration_seconds(c: Column | str) -> Column:
    """Seconds from a number, ``h:m:s``, ``m:s``, or the first number inside a text."""
    text = F.trim(_col(c).cast("string"))
    hms = r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    ms = r"^(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    number = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")

    return (
        F.when(text.rlike(hms), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3))
        .when(text.rlike(ms), part(ms, 1) * 60 + part(ms, 2))
        .otherwise(F.nullif(number, F.lit("")).cast("double"))
    )
