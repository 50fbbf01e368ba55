"""Typed property values: a property is ``struct<t string, v string>``, so that 443 and "443" stay different.

Tags: s string, i long, f double, b boolean, ts timestamp, j JSON text, n explicit null (as opposed to absent).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPED = "struct<t:string,v:string>"


def typed(tag: str, value: Column) -> Column:
    """One tagged value; a null value is the explicit null."""
    return F.when(value.isNull(), F.struct(F.lit("n").alias("t"), F.lit(None).cast("string").alias("v"))).otherwise(
        F.struct(F.lit(tag).alias("t"), value.cast("string").alias("v"))
    )


def decode_json(json: Column) -> Column:
    """A JSON scalar's text as a tagged value: numbers beyond a long and non-scalars stay JSON, -0.0 becomes 0.0."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    double = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.struct(F.lit("n").alias("t"), F.lit(None).cast("string").alias("v")))
        .when(kind == "BIGINT", F.struct(F.lit("i").alias("t"), text.alias("v")))
        .when(kind == "STRING", F.struct(F.lit("s").alias("t"), text.alias("v")))
        .when(kind == "BOOLEAN", F.struct(F.lit("b").alias("t"), text.alias("v")))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL") & json.rlike(r"[.eE]"), F.struct(F.lit("f").alias("t"), F.when(double == 0, F.lit(0.0)).otherwise(double).cast("string").alias("v")))
        .otherwise(F.struct(F.lit("j").alias("t"), F.to_json(v).alias("v")))
    )


def encode_json(value: Column) -> Column:
    """The JSON text of a tagged value."""
    t, v = value["t"], value["v"]
    quoted = F.regexp_extract(F.to_json(F.struct(v.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(t == "n", F.lit("null")).when(t.isin("i", "f", "b", "j"), v).otherwise(quoted)


def flatten_json(json: Column, depth: int = 10) -> Column:
    """``map<path, tagged value>`` of a JSON object: dotted paths, arrays and empty objects kept whole as JSON.

    Objects deeper than ``depth`` stay JSON.  Every level is one pass over ``map<string,string>``; no Python.
    """
    def entries(text: Column, prefix: Column | None, left: int) -> Column:
        members = F.map_entries(F.from_json(text, "map<string,string>"))
        def one(e: Column) -> Column:
            path = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
            leaf = F.array(F.struct(path.alias("key"), e["value"].alias("value")))
            if left == 0:
                return leaf
            return F.when(e["value"].rlike(r"(?s)^\s*\{\s*[^}\s]"), entries(e["value"], path, left - 1)).otherwise(leaf)
        return F.flatten(F.transform(members, one))

    return entries(json, None, depth - 1)


def framed(*parts: Column) -> Column:
    """Text in which every part is preceded by its UTF-8 length, so different lists never give equal text."""
    return F.concat(*(F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.when(p.isNull(), F.lit("~")).otherwise(F.lit(":")), F.coalesce(p, F.lit(""))) for p in parts))


def digest(*parts: Column) -> Column:
    """SHA-256 (hex) of the framed parts: the identity digest of scope, type and key values."""
    return F.sha2(framed(*parts), 256)


def structural_digest(props: Column, exclude: Column | None = None) -> Column:
    """SHA-256 of a property map: keys sorted, tags and values framed, excluded keys left out."""
    kept = props if exclude is None else F.map_filter(props, lambda k, v: ~F.array_contains(exclude, k))
    entries = F.array_sort(F.transform(F.map_entries(kept), lambda e: framed(e["key"], e["value"]["t"], e["value"]["v"])))
    return F.sha2(F.array_join(entries, ""), 256)


def token(value: Column) -> Column:
    """``tag:text`` of a scalar; null for the explicit null, blank strings and non-finite doubles."""
    t, v = value["t"], value["v"]
    unusable = (t == "n") | v.isNull() | ((t == "s") & (F.trim(v) == "")) | ((t == "f") & v.isin("NaN", "Infinity", "-Infinity")) | (t == "j")
    return F.when(~unusable, F.concat(t, F.lit(":"), v))


def key_tokens(props: Column, groups: Column) -> Column:
    """Sorted distinct tokens of every key group whose properties are all usable."""
    each = F.transform(groups, lambda g: F.transform(g, lambda k: token(F.try_element_at(props, k))))
    return F.array_sort(F.array_distinct(F.flatten(F.filter(each, lambda g: F.forall(g, lambda x: x.isNotNull()) & (F.size(g) > 0)))))


def diff(incoming: Column, stored: Column) -> Column:
    """``map<key, added|changed|removed>`` of two property maps; equal values have no entry."""
    side = F.map_zip_with(incoming, stored, lambda k, a, b: F.when(b.isNull(), "added").when(a.isNull(), "removed").when(~a.eqNullSafe(b), "changed"))
    return F.map_filter(side, lambda k, v: v.isNotNull())


def merge_partial(stored: Column, incoming: Column) -> Column:
    """Stored map overlaid by an incremental one: an incoming path replaces stored ancestors and descendants."""
    paths = F.map_keys(incoming)
    kept = F.map_filter(
        stored,
        lambda k, v: ~F.exists(paths, lambda p: (p == k) | p.startswith(F.concat(k, F.lit("."))) | k.startswith(F.concat(p, F.lit(".")))),
    )
    return F.map_concat(kept, incoming)


def hash_exclusions(exclude: Column, volatile: Column, always: Column) -> Column:
    """Keys that never make a version: (exclude or volatile) without those always versioned."""
    return F.array_sort(F.array_except(F.array_union(exclude, volatile), always))


def overlay_tags(stored: Column, incoming: Column, full: Column) -> Column:
    """Tags after an observation: a full one replaces them, a partial one overlays them."""
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(incoming, k))
    return F.when(full, incoming).otherwise(F.map_concat(kept, incoming))


def tag_conflicts(first: Column, second: Column) -> Column:
    """Sorted keys to which two observations of one instant give different values."""
    both = F.map_zip_with(first, second, lambda k, a, b: a.isNotNull() & b.isNotNull() & (a != b))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, x: x)))


#: Columns of a compact entity; prefix of stored properties, of their type tags, and the tag of JSON text.
COMPACT = ("chain_id", "uuid", "entity_type", "name", "namespace", "version", "is_latest", "deleted_at")
_PROPERTY, _TYPE, _JSON = "prop_", "property_type_", "j"


def compact(df: DataFrame) -> DataFrame:
    """The columns of a compact entity, those that there are."""
    return df.select(*(c for c in COMPACT if c in df.columns))


def typed_record(record: Column) -> Column:
    """``struct<properties, metadata, diagnostics>`` of a stored record ``map<string, string>``.

    Properties lose their prefix; type tags and vectors go; JSON text that does not parse is named in ``diagnostics``.
    """
    own = F.map_filter(record, lambda k, v: k.startswith(_PROPERTY))
    rest = F.map_filter(record, lambda k, v: ~k.startswith(_PROPERTY) & ~k.startswith(_TYPE) & ~k.isin("embedding", "summary_embedding"))
    properties = F.transform_keys(own, lambda k, v: F.substr(k, F.lit(len(_PROPERTY) + 1)))
    tag = lambda k: F.try_element_at(record, F.concat(F.lit(_TYPE), k))
    broken = F.map_filter(properties, lambda k, v: tag(k).eqNullSafe(F.lit(_JSON)) & v.isNotNull() & F.try_parse_json(v).isNull())
    return F.struct(properties.alias("properties"), rest.alias("metadata"), F.array_sort(F.map_keys(broken)).alias("diagnostics"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5, SHA-1) of a name in a namespace UUID, in lower case."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(at(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and no white space; null where the text is no JSON."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            try:
                out.append(json.dumps(json.loads(row), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(row, str) else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def labels(inherited: Column, own: Column) -> Column:
    """Inherited labels first, then new ones, each once."""
    return F.array_union(inherited, own)


def port_to_integer(value: Column) -> Column:
    """A string that is the canonical text of a port number as an integer value; others unchanged."""
    number = value["v"].try_cast("int")
    fits = (value["t"] == "s") & number.between(0, 65535) & (number.cast("string") == value["v"])
    return F.when(fits, F.struct(F.lit("i").alias("t"), value["v"].alias("v"))).otherwise(value)
