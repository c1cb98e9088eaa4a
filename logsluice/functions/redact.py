"""Secret scrubbing: built-in expressions for text, one Arrow function for JSON documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..schema import SOURCE
from . import patterns as P
from .text import _col

_MARK = P.REDACTED
_QUOTED_MARK = f'"{_MARK}"'


# One pass decides whether any of the four rewrites can apply at all.
_CANDIDATE = (
    P.any_case("bearer", "basic", "passw", "secret", "token", "key", "authorization", "cookie",
               "credential")
    + "|eyJ|://"
)


def scrub_secrets(text) -> Column:
    """Auth headers, URL logins, web tokens, then ``name: value`` pairs, in that order.

    Pass a plain column: it is used three times, and a nested expression would be repeated.
    """
    text = _col(text)
    out = F.regexp_replace(text, P.AUTH_SCHEME, f"$1 {_MARK}")
    out = F.regexp_replace(out, P.URL_LOGIN, f"$1{_MARK}@")
    out = F.regexp_replace(out, P.WEB_TOKEN, _MARK)
    out = F.regexp_replace(out, P.SECRET_PAIR, f"$1{_QUOTED_MARK}")
    return F.when(text.rlike(_CANDIDATE), out).otherwise(text)


JSON_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def json_shaped(text) -> Column:
    """Cheap test for lines that can be one JSON document worth parsing."""
    return _col(text).rlike(
        r"^[ \t\r\n]*(?:\{[\s\S]*\}|\[[\s\S]*\]|\"[\s\S]*\")[ \t\r\n]*\z"
    )


def json_scalar(text) -> Column:
    """Bare numbers and literals: JSON too, but nothing in them can be secret."""
    return _col(text).rlike(rf"^[ \t\r\n]*(?:true|false|null|{JSON_NUMBER})[ \t\r\n]*\z")


class _Literal(str):
    """A JSON number that keeps its spelling."""


class _TooDeep(Exception):
    pass


def _no_constant(name):
    raise ValueError(name)


def parse_document(text: str):
    """Objects become lists of pairs wrapped in a tuple so repeated members survive."""
    return json.loads(
        text, object_pairs_hook=tuple, parse_int=_Literal, parse_float=_Literal,
        parse_constant=_no_constant,
    )


def _clean_text(value: str) -> str:
    return re.sub("[\ud800-\udfff]", "\ufffd", value)


def quote(value: str) -> str:
    return json.dumps(_clean_text(value), ensure_ascii=False)


_PY = {
    "auth": re.compile(P.AUTH_SCHEME),
    "url": re.compile(P.URL_LOGIN),
    "web": re.compile(P.WEB_TOKEN),
    "pair": re.compile(P.SECRET_PAIR),
    "field": re.compile(P.SECRET_FIELD),
}


def scrub_value(value: str) -> str:
    value = _PY["auth"].sub(rf"\1 {_MARK}", value)
    value = _PY["url"].sub(rf"\1{_MARK}@", value)
    value = _PY["web"].sub(_MARK, value)
    return _PY["pair"].sub(rf"\1{_QUOTED_MARK}", value)


def _has_repeats(node, depth: int) -> bool:
    if depth > 128:
        raise _TooDeep
    if isinstance(node, tuple):
        names = [k for k, _ in node]
        inner = [_has_repeats(v, depth + 1) for _, v in node]
        return len(set(names)) < len(names) or any(inner)
    if isinstance(node, list):
        return any([_has_repeats(v, depth + 1) for v in node])
    return False


def _write(node, hide: bool, in_order: bool) -> str:
    if isinstance(node, tuple):
        members = node if in_order else sorted(dict(node).items())
        return "{" + ",".join(
            quote(k) + ":" + (
                _QUOTED_MARK if hide and _PY["field"].search(k) else _write(v, hide, in_order)
            )
            for k, v in members
        ) + "}"
    if isinstance(node, list):
        return "[" + ",".join(_write(v, hide, in_order) for v in node) + "]"
    if isinstance(node, _Literal):
        return str(node)
    if isinstance(node, str):
        return quote(scrub_value(node) if hide else node)
    return json.dumps(node)


def redact_document(text: str):
    """(text, changed, ambiguous) of one JSON document, or None when it is not JSON."""
    try:
        tree = parse_document(text)
    except RecursionError:
        return P.DEEP_JSON_TEXT, True, True
    except ValueError:
        return None
    try:
        repeats = _has_repeats(tree, 0)
    except _TooDeep:
        return P.DEEP_JSON_TEXT, True, True
    safe = _write(tree, True, repeats)
    return safe, safe != _write(tree, False, repeats), repeats


@pandas_udf(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType()),
    T.StructField("ambiguous", T.BooleanType()),
]))
def _redact_json(texts: pd.Series) -> pd.DataFrame:
    done = [None if t is None else redact_document(t) for t in texts]
    blank = (None, None, None)
    return pd.DataFrame(
        [d or blank for d in done], columns=["text", "changed", "ambiguous"], dtype=object
    )


def with_redaction(df: DataFrame, text: str, with_json: bool = True) -> DataFrame:
    """Add ``safe``, ``changed`` and ``ambiguous`` for a text column free of terminal escapes.

    Only JSON-shaped rows reach Python; all others are NULL in the Arrow batch. Pass
    ``with_json=False`` for sources known to hold no JSON: the plan then has no Python step.
    """
    body = F.col(text)
    df = df.withColumn("_plain", scrub_secrets(body))
    if not with_json:
        return df.select(
            "*", F.col("_plain").alias("safe"),
            (~F.col("_plain").eqNullSafe(body)).alias("changed"), F.lit(False).alias("ambiguous"),
        ).drop("_plain")
    df = df.withColumn("_json", _redact_json(F.when(json_shaped(body), body)))
    parsed = F.col("_json.text").isNotNull()
    scalar = json_scalar(body)
    return df.select(
        "*",
        F.when(parsed, F.col("_json.text"))
        .when(scalar, F.trim(body, F.lit(" \t\r\n"))).otherwise(F.col("_plain")).alias("safe"),
        F.when(parsed, F.col("_json.changed"))
        .otherwise(~scalar & ~F.col("_plain").eqNullSafe(body)).alias("changed"),
        F.when(parsed, F.col("_json.ambiguous")).otherwise(False).alias("ambiguous"),
    ).drop("_plain", "_json")


def safe_source(source) -> Column:
    """The source record with secret-looking values scrubbed, field by field.

    Sources are short and nearly always clean, so one test over all fields guards the rewrite. The scrubbed
    fields are bound to a name: an expression used by each field would scrub all of them again for each.
    """
    source = _col(source)
    texts = [f.name for f in SOURCE.fields if f.dataType.simpleString() == "string"]
    scrubbed = F.transform(F.array(*[source[n] for n in texts]), scrub_secrets)
    rebuilt = F.element_at(F.transform(F.array(scrubbed), lambda done: F.struct(*[
        (done[texts.index(f.name)] if f.name in texts else source[f.name]).alias(f.name)
        for f in SOURCE.fields
    ])), 1)
    suspect = F.concat_ws("\n", *[source[n] for n in texts]).rlike(_CANDIDATE)
    return F.when(suspect, rebuilt).otherwise(source)


def safe_extra(extra) -> Column:
    """Unknown source keys: values under secret names are masked, the others scrubbed."""
    return F.transform_values(
        _col(extra),
        lambda k, v: F.when(k.rlike(P.SECRET_FIELD), F.lit(_MARK)).otherwise(scrub_secrets(v)),
    )
