"""Message templates: mask what varies, keep what decides."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from . import classify as C, patterns as P
from .redact import _Literal, parse_document, quote
from .text import _col

_ID_PAIR = rf"(?<=^|[ ])({P.ID_NAME_BODY})={P.OPAQUE_BODY}(?=[ ]|\z)"
_END = r"(?=[ ]|\z)"
# name=value whose name is free; the name ends at the first equals sign.
# The cheap test for a variable value comes before the search for protected words.
_VALUE_PAIR = (
    rf"(?<=^|[ ])(?=[^ =]*+={P.VARIABLE_BODY}{_END})(?!{P.protected_inside(' =')})"
    rf"([^ =]*)={P.VARIABLE_BODY}{_END}"
)
# A bare value at the start, or after a word that does not decide what it means. Three-digit
# results from 100 to 599 stay.
_BARE_VALUE = (
    rf"(^|(?<=^|[ ])(?=[^ ]++ {P.VARIABLE_BODY}{_END})(?!{P.protected_inside(' ')})"
    rf"(?!HTTP/|Completed )[^ ]+ )"
    rf"(?![1-5][0-9][0-9]{_END}){P.VARIABLE_BODY}{_END}"
)


def protected_field(name) -> Column:
    return F.regexp_replace(_col(name), "[^a-zA-Z0-9]", "").rlike(P.PROTECTED_NAME)


def text_template(text, masking: str = "strict") -> Column:
    """Template of a plain-text message.

    strict masks opaque request/trace/span/correlation/session ids. classic also masks numbers,
    addresses and clocks unless the word before them, or the field name, is protected.
    """
    if masking not in ("strict", "classic"):
        raise ValueError("masking is strict or classic")
    flat = F.trim(F.regexp_replace(_col(text), P.TOKEN_GAP, " "))
    out = F.regexp_replace(flat, _ID_PAIR, "$1=<id>")
    if masking == "classic":
        out = F.regexp_replace(out, _VALUE_PAIR, "$1=<value>")
        # A match consumes the word before it, so neighbours need the second pass.
        out = F.regexp_replace(out, _BARE_VALUE, "$1<value>")
        out = F.regexp_replace(out, _BARE_VALUE, "$1<value>")
    return out


_PY = {
    "protected": re.compile(P.PROTECTED_NAME),
    "id_name": re.compile(P.ID_NAME_BODY),
    "opaque": re.compile(P.OPAQUE_BODY),
    "number": re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?"),
    "address": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "clock": re.compile(r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"),
}


def is_protected(name: str) -> bool:
    return bool(_PY["protected"].search(re.sub("[^a-zA-Z0-9]", "", name)))


def _mask_node(name: str, node, classic: bool) -> str:
    """JSON text of ``node`` with its variable parts masked."""
    free = not is_protected(name)
    if isinstance(node, tuple) and free:
        members = sorted(dict(node).items())
        return "{" + ",".join(quote(k) + ":" + _mask_node(k, v, classic) for k, v in members) + "}"
    if free and isinstance(node, str):
        if isinstance(node, _Literal):
            return '"<number>"' if classic else str(node)
        if _PY["id_name"].fullmatch(name) and _PY["opaque"].fullmatch(node):
            return '"<id>"'
        if classic and any(_PY[p].fullmatch(node) for p in ("number", "address", "clock")):
            return '"<value>"'
    return dump(node)


def dump(node) -> str:
    """Canonical JSON text: sorted members, compact, numbers as written."""
    if isinstance(node, tuple):
        return "{" + ",".join(quote(k) + ":" + dump(v) for k, v in sorted(dict(node).items())) + "}"
    if isinstance(node, list):
        return "[" + ",".join(dump(v) for v in node) + "]"
    if isinstance(node, _Literal):
        return str(node)
    return quote(node) if isinstance(node, str) else json.dumps(node)


def _document(text):
    try:
        return parse_document(text)
    except (ValueError, RecursionError):
        return None


def json_template(masking: str):
    classic = masking == "classic"

    @pandas_udf(T.StringType())
    def mask_json(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            tree = None if t is None else _document(t)
            out.append(_mask_node("", tree, classic) if isinstance(tree, tuple) else None)
        return pd.Series(out, dtype=object)

    return mask_json


_OBJECT = r"^[ \t\r\n]*\{[\s\S]*\}[ \t\r\n]*\z"


def with_template(df: DataFrame, text: str = "text", masking: str = "strict", with_json: bool = True) -> DataFrame:
    """Add ``template``. Only rows shaped like a JSON object reach Python."""
    if not with_json:
        return df.withColumn("template", text_template(text, masking))
    masked = json_template(masking)(F.when(F.col(text).rlike(_OBJECT), F.col(text)))
    return (
        df.withColumn("_jt", masked).withColumn("_tt", text_template(text, masking))
        .withColumn("template", F.coalesce("_jt", "_tt")).drop("_jt", "_tt")
    )


def template_scope(source) -> Column:
    """Source identity shared by all pods of a workload; files keep their full record."""
    source = _col(source)
    kept = ("type", "cluster_id", "context", "namespace", "container", "kind", "previous", "restart_count")
    workload = F.to_json(F.struct(*[source[n] for n in kept]), {"ignoreNullFields": "false"})
    return F.when(source["type"] == "kubernetes", workload).otherwise(
        F.to_json(source, {"ignoreNullFields": "false"})
    )


def version_id(strategy: str, masking: str, template) -> Column:
    parts = (F.lit("template-v1"), F.lit(strategy), F.lit(masking), _col(template))
    return F.coalesce(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(""))


def with_template_key(df: DataFrame, strategy: str = "drain", masking: str = "strict", with_json: bool = True) -> DataFrame:
    """Add ``eligible``, ``version_id`` and ``template_key`` (NULL when not groupable).

    Strategies: off (nothing shares), exact (same text and source), drain (same template and
    workload), semantic (reviewed rules only; see ``operators.rules``).
    """
    if strategy not in ("off", "exact", "drain", "semantic"):
        raise ValueError("unknown grouping strategy")
    ok = C.groupable("text", "truncated", "sensitive", "parse_uncertain")
    df = df.withColumn("eligible", F.lit(False) if strategy in ("off", "semantic") else ok)
    if strategy == "drain":
        df = with_template(df, "text", masking, with_json)
        scope = template_scope("source")
    else:
        df = df.withColumn("template", F.col("text"))
        scope = F.to_json("source", {"ignoreNullFields": "false"})
    df = df.withColumn("version_id", version_id(strategy, masking, "template"))
    key = F.sha2(F.concat_ws(
        "\x1f", F.lit("family-v1"), scope, F.col("version_id"),
        F.col("baseline.important").cast("string"),
    ), 256)
    return df.withColumn("template_key", F.when(F.col("eligible"), key)).drop("template")


def families(events: DataFrame) -> DataFrame:
    """Events that belong to a family, with a key Spark knows to be present.

    Testing ``template_key`` itself would build every template a second time inside the filter,
    and joining on it a third time.
    """
    test = F.col("eligible") if "eligible" in events.columns else F.col("template_key").isNotNull()
    return events.where(test).withColumn("template_key", F.coalesce("template_key", F.lit("")))


def outside_families(events: DataFrame) -> DataFrame:
    test = ~F.col("eligible") if "eligible" in events.columns else F.col("template_key").isNull()
    return events.where(test)


# --- JSON shape -------------------------------------------------------------------------

_TYPE_NAMES = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def flatten_document(text: str):
    """(shape, leaves): JSON pointer to type name, and pointer to canonical scalar text.

    None when the text is not JSON or repeats a member.
    """
    tree = _document(text)
    shape, values = {}, {}
    todo = [("", tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, tuple):
            names = [k for k, _ in node]
            if len(set(names)) < len(names):
                return None
            shape[path] = "object"
            todo += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in node]
        elif isinstance(node, list):
            shape[path] = "array"
            todo += [(f"{path}/{i}", v) for i, v in enumerate(node)]
        else:
            shape[path] = "number" if isinstance(node, _Literal) else _TYPE_NAMES[type(node)]
            values[path] = dump(node)
    if tree is None and text.strip() != "null":
        return None
    return shape, values


_FLAT = T.StructType([
    T.StructField("shape", T.MapType(T.StringType(), T.StringType())),
    T.StructField("leaves", T.MapType(T.StringType(), T.StringType())),
])


@pandas_udf(_FLAT)
def _flatten(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        flat = None if t is None else flatten_document(t)
        rows.append((None, None) if flat is None else flat)
    return pd.DataFrame(rows, columns=["shape", "leaves"], dtype=object)


def flatten_json(text) -> Column:
    """STRUCT<shape MAP, leaves MAP> by JSON pointer; NULL for rows that are not JSON containers."""
    text = _col(text)
    return _flatten(F.when(text.rlike(r"^[ \t\r\n]*[\[{]"), text))


def shape_hash(shape) -> Column:
    """Identity of a shape map: equal for documents with the same paths and types."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(_col(shape)))), 256)
