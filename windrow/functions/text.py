"""Text expressions: slugs, room ids, warning token lists, path handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: how a room number is written in names and paths.
ROOM_PATTERN = r"(?i)(?<![A-Za-z0-9])room[\s_]*([0-9]+)(?![0-9])"
UNKNOWN_ROOM = "unknown_room"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c: Column | str, empty: str | None = "unknown") -> Column:
    """Lower-case, runs of other characters become one ``_``; ``empty`` replaces a blank result."""
    body = F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "_")
    body = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(body != "", body).otherwise(F.lit(empty)) if empty is not None else F.nullif(body, F.lit(""))


def token(c: Column | str) -> Column:
    """Like :func:`slug`, but blank and null stay null."""
    return slug(c, None)


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, with blank and the text ``nan`` read as missing."""
    value = F.trim(_col(c).cast("string"))
    return F.when((value != "") & (F.lower(value) != "nan"), value)


def room_number(c: Column | str) -> Column:
    found = F.regexp_extract(F.replace(_col(c), F.lit("-"), F.lit(" ")), ROOM_PATTERN, 1)
    return F.when(found != "", found.cast("bigint"))


def room_id(c: Column | str) -> Column:
    """``room_<n>`` from free text, or ``unknown_room``."""
    return F.coalesce(F.concat(F.lit("room_"), room_number(c).cast("string")), F.lit(UNKNOWN_ROOM))


def room_display_name(c: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("Room "), room_number(c).cast("string")), F.lit("Unknown Room"))


def room_warning(room: Column | str) -> Column:
    return F.when(_col(room) == UNKNOWN_ROOM, F.lit("room_id_not_found"))


def room_id_from_path(path: Column | str) -> Column:
    """The deepest path part that names a room decides."""
    parts = F.reverse(F.split(_col(path), "/"))
    hits = F.filter(F.transform(parts, room_id), lambda r: r != UNKNOWN_ROOM)
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(UNKNOWN_ROOM))


def session_id_from_path(path: Column | str, room: Column | str) -> Column:
    """Session slug from the folders below the room folder, prefixed by a known room."""
    parts = F.split(_col(path), "/")
    size = F.size(parts)
    folders = F.slice(parts, F.lit(1), size - 1)
    at = F.array_position(parts, "video")
    below = F.when(size > at + 2, F.slice(parts, (at + 2).cast("int"), F.greatest(size - at - 2, F.lit(0)).cast("int")))
    here = F.slice(parts, (at + 1).cast("int"), F.greatest(size - at - 1, F.lit(0)).cast("int"))
    chosen = F.when(at > 0, F.coalesce(below, here)).otherwise(folders)
    name = slug(F.array_join(chosen, "_"))
    known = (_col(room) != UNKNOWN_ROOM) & ~F.startswith(name, _col(room))
    return F.when(known, F.concat(_col(room), F.lit("_"), name)).otherwise(name)


def path_key(c: Column | str) -> Column:
    """Path text made comparable: forward slashes, lower case."""
    return F.lower(F.replace(_col(c), F.lit("\\"), F.lit("/")))


def path_contains(c: Column | str, part: str) -> Column:
    return F.contains(path_key(c), F.lit(part.replace("\\", "/").lower()))


def file_name(c: Column | str) -> Column:
    return F.element_at(F.split(F.replace(_col(c), F.lit("\\"), F.lit("/")), "/"), -1)


def warning_tokens(*cols: Column | str, sep: str = ";") -> Column:
    """Array of distinct trimmed tokens in first-seen order; missing and ``nan`` texts vanish."""
    texts = F.array(*[F.coalesce(blank_to_null(c), F.lit("")) for c in cols])
    pieces = F.flatten(F.transform(texts, lambda t: F.split(t, "\\" + sep if sep in "|." else sep)))
    return F.array_distinct(F.filter(F.transform(pieces, lambda t: F.trim(t)), lambda t: t != ""))


def combine_warnings(*cols: Column | str, sep: str = ";", glue: str | None = None) -> Column:
    """Merge token lists held as text; order is first seen."""
    return F.array_join(warning_tokens(*cols, sep=sep), glue if glue is not None else sep)


def sorted_warnings(tokens: Column) -> Column:
    """Token array to text, alphabetical (the manifest form)."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))), ";")


def title_from_id(c: Column | str) -> Column:
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))
