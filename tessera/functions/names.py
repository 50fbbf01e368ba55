"""Names and shapes: relationship names, field names that name a type or key, identifiers, value transforms."""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_name(name: Column) -> Column:
    """Upper-case letters and digits, other runs as one underscore, none at the ends."""
    return F.btrim(F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_")), F.lit("_"))


def label_words(label: Column) -> Column:
    """Lower-case runs of letters and digits, for case-insensitive equality of labels."""
    return F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plain_path(path: Column) -> Column:
    """A path without its list indexes."""
    return F.regexp_replace(path, r"\[[0-9]*\]", "")


def excluded(path: Column, paths: list[str]) -> Column:
    """Whether a path is one of ``paths`` or lies under one of them."""
    p, out = plain_path(path), F.lit(False)
    for x in paths:
        out = out | (p == x) | p.startswith(x + ".")
    return out


def slot(entity_type: Column, path: Column) -> Column:
    """The owner of a reference: type and path without indexes."""
    return F.concat_ws(".", entity_type, plain_path(path))


#: Shapes of one identifier without white space.
_SHAPES = {
    "mail": r"@",
    "uri": r"^[A-Za-z]{2,12}:(//|[^:].*[:/]|/)",
    "host and port": r"^(localhost|[^:]*\.[^:]*):\d+$",
    "host of four labels": r"^([A-Za-z0-9-]+\.){3,}[A-Za-z]+$",
    "uuid": r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    "ipv4": r"^\d{1,3}(\.\d{1,3}){3}(/\d*)?$",
    "ipv6": r"(?i)^(?!.*::.*::)[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,}([%/].*)?$",
    "mac": r"(?i)^([0-9a-f]{2}:){5}[0-9a-f]{2}$|^([0-9a-f]{2}-){5}[0-9a-f]{2}$",
    "digest": r"(?i)^[0-9a-f]{16,}$",
    "token in one case": r"^(?=.*\d)([A-Z0-9]{16,}|[a-z0-9]{16,})$",
    "base64": r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[+/=])[A-Za-z0-9+/=._]{20,}$",
    "prefix and digits": r"(?i)^[a-z][a-z0-9]*-(?=[0-9a-f]*\d)[0-9a-f]{6,}$",
}
_DATE = r"^\d{4}-\d{2}-\d{2}($|[Tt ])"


def _one_identifier(v: Column) -> Column:
    out = F.lit(False)
    for shape in _SHAPES.values():
        out = out | v.rlike(shape)
    size, digits = F.length(v), F.length(F.regexp_replace(v, "[^0-9]", ""))
    dense = v.rlike("^[A-Za-z0-9]{8,}$") & (digits * 2 > size)
    dense = dense | v.rlike("^[A-Za-z0-9]{12,}$") & v.rlike("[A-Za-z]") & (digits * 5 >= size * 2)
    dense = dense | v.rlike("^[A-Za-z0-9]{16,}$") & (digits * 4 >= size)
    return out | dense | v.rlike(r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/=._]{20,}$") & (digits * 4 >= size) | v.rlike(_DATE)


def identifier_shaped(text: Column) -> Column:
    """Whether a string looks like an identifier rather than words: an address, digest, token, date, or a list of such."""
    v = F.trim(text)
    parts = F.filter(F.split(v, "[,;]"), lambda x: x != "")
    several = v.rlike("[,;]") & (F.size(parts) > 0) & F.forall(parts, _one_identifier)
    return F.coalesce((v != "") & (v.rlike(_DATE) | ~v.rlike(r"\s") & (_one_identifier(v) | several)), F.lit(False))


#: Key names that say nothing without the type before them, in letters alone.
GENERIC_KEYS = ("id", "name", "arn", "uid")


def name_words(name: Column) -> Column:
    """The lower-case words of a field name: runs of letters and digits, cut where a small letter meets a capital one."""
    cut = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _joined(words: Column) -> Column:
    return F.array_join(words, "")


def _key_words(name: Column) -> Column:
    """Words of a field or key name in which a last word Identifier reads Id."""
    return name_words(F.regexp_replace(name, "^(?i:identifier)$|Identifier$|[_-]identifier$", "Id"))


def structural_reference(location: Column, target_type: Column, keys: Column) -> Column:
    """Whether a payload place names a target: its field or an object around it is the type, or the field's words end in
    those of a key.  Keys of GENERIC_KEYS alone need the type before them.

    A qualified type (a.b, a::b) also goes by its last part; a trailing s of the field may be left out.
    """
    fields = F.transform(F.split(location, r"\."), lambda p: F.substring_index(p, "[", 1))
    field = F.element_at(fields, -1)
    singular = F.regexp_replace(field, "s$", "")
    types = F.filter(F.array(_joined(name_words(target_type)), _joined(name_words(F.regexp_extract(target_type, r"[^:.]*$", 0)))), lambda t: t != "")
    named = F.array_append(F.slice(fields, 1, F.greatest(F.size(fields) - 1, F.lit(0))), field)
    by_type = F.exists(F.array_append(named, singular), lambda f: F.array_contains(types, _joined(name_words(f))))
    wanted = F.filter(F.transform(keys, lambda k: _joined(_key_words(F.substring_index(k, ".", -1)))), lambda k: k != "")
    words = _key_words(singular)
    tails = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
        lambda i: F.struct(_joined(F.slice(words, i, F.size(words))).alias("tail"), _joined(F.slice(words, 1, i - 1)).alias("head")),
    )
    ends = lambda k: F.exists(tails, lambda t: (t["tail"] == k) & ((t["head"] == "") | ~k.isin(*GENERIC_KEYS) | F.array_contains(types, t["head"])))
    by_key = F.exists(wanted, lambda k: (_joined(_key_words(field)) == k) | ends(k))
    return F.coalesce(by_type | by_key, F.lit(False))


def transform_value(value: Column, fold: bool = False, prefix: str = "", suffix: str = "") -> Column:
    """A learned value transform: strip a fixed prefix and suffix (null where absent), then fold case."""
    out = value
    if prefix:
        out = F.when(out.startswith(prefix), F.substr(out, F.lit(len(prefix) + 1)))
    if suffix:
        out = F.when(out.endswith(suffix), F.left(out, F.length(out) - len(suffix)))
    return F.lower(out) if fold else out


def overlap_score(a: Column, b: Column) -> Column:
    """Shared prefix and suffix in bytes of UTF-8 over the longer length, never counting a byte twice; null beside a null."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            if not isinstance(x, str) or not isinstance(y, str):
                out.append(None)
                continue
            pair = (x.encode("utf-8", "surrogatepass"), y.encode("utf-8", "surrogatepass"))
            both = len(commonprefix(pair)) + len(commonprefix([v[::-1] for v in pair]))
            out.append(min(both, *map(len, pair)) / max(1, *map(len, pair)))
        return pd.Series(out, dtype=float)

    return run(a, b)
