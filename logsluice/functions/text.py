"""Column expressions for cleaning one physical line (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import MAX_LINE_BYTES
from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ansi(text) -> Column:
    text = _col(text)
    return F.when(text.contains("\x1b"), F.regexp_replace(text, P.ANSI, "")).otherwise(text)


def console_safe(text) -> Column:
    """Control characters become blanks, terminal escapes disappear."""
    return F.regexp_replace(strip_ansi(text), r"\p{Cc}", " ")


def repair_utf8(text) -> Column:
    """Replace each run of invalid bytes by one replacement character."""
    text = _col(text)
    fixed = F.regexp_replace(F.make_valid_utf8(text), "\ufffd+", "\ufffd")
    return F.when(F.is_valid_utf8(text), text).otherwise(fixed)


def clip_bytes(text, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters; invalid bytes are repaired first."""
    text = repair_utf8(text)
    raw = text.cast("binary")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(4)
    ]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def bounded_line(raw) -> Column:
    """The bytes of a physical line that are kept (its line feed counts toward the cap)."""
    raw = _col(raw)
    cut = F.substring(raw.cast("binary"), 1, MAX_LINE_BYTES).cast("string")
    return F.when(line_overflows(raw), cut).otherwise(raw)


def line_overflows(raw) -> Column:
    return F.octet_length(_col(raw)) >= MAX_LINE_BYTES


def trim_line_end(text) -> Column:
    text = _col(text)
    return F.when(
        text.endswith("\r") | text.endswith("\n"), F.regexp_replace(text, r"[\r\n]+\z", "")
    ).otherwise(text)


def transport_stamp(text) -> Column:
    """The first token when it is a complete RFC 3339 time, else NULL."""
    text = _col(text)
    token = F.substring_index(text, " ", 1)
    return F.when(
        text.contains(" ")
        & token.rlike(P.TRANSPORT_STAMP)
        & F.try_to_date(F.substring(token, 1, 10)).isNotNull(),
        token,
    )


def prefix_stamp(text) -> Column:
    """The loose date-time prefix including its trailing blank, else the empty string."""
    text = _col(text)
    return F.when(
        text.rlike("^[0-9]{4}-"), F.regexp_extract(text, "(" + P.LOOSE_STAMP + ")", 1)
    ).otherwise(F.lit(""))


def _never_null(hashed: Column) -> Column:
    """Joins on a nullable key make Spark test the key below every projection, which would
    compute the hash a second time for each row."""
    return F.coalesce(hashed, F.lit(""))


def event_id(source, ts_raw, line_start, text) -> Column:
    body = F.to_json(
        F.struct(
            _col(source).alias("source"), _col(ts_raw).alias("ts_raw"),
            _col(line_start).alias("line_start"), _col(text).alias("text"),
        ),
        {"ignoreNullFields": "false"},
    )
    return _never_null(F.substring(F.sha2(body, 256), 1, 20))


def group_id(source, text) -> Column:
    body = F.to_json(
        F.struct(_col(source).alias("source"), _col(text).alias("text")),
        {"ignoreNullFields": "false"},
    )
    return _never_null(F.substring(F.sha2(body, 256), 1, 20))


def source_id(source) -> Column:
    return _never_null(F.sha2(F.to_json(_col(source), {"ignoreNullFields": "false"}), 256))


def contract_id(*parts: str) -> str:
    """Opaque name of one scoring configuration; part of every verdict and incident key."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(list(parts)).encode()).hexdigest()
