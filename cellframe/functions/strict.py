"""JSON as the manifests ask for it: every key once, no number that isn't finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a JSON parser may be lenient about, all refused.
REFUSED = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false", "allowComments": "false", "allowNumericLeadingZeros": "false"}


def _in_object(text: Column) -> Column:
    return F.concat(F.lit('{"x":'), text, F.lit("}"))


def _in_array(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


def json_fault(text: Column) -> Column:
    """``malformed`` or ``duplicate_key`` (at any depth, also where a key is escaped); null for good and for null texts.

    A parser stops behind the first value and would let more text pass, so the text is read as the only
    element of an array and as the only member of an object: what follows a value can't fit both.
    """
    unique = F.try_parse_json(_in_array(text)).isNotNull() & F.try_parse_json(_in_object(text)).isNotNull()
    whole = F.from_json(_in_array(text), "array<string>", REFUSED).isNotNull() & F.from_json(_in_object(text), "x string", REFUSED)["x"].isNotNull()
    return F.when(text.isNull() | unique, None).when(whole, "duplicate_key").otherwise("malformed")


def strict_json(text: Column) -> Column:
    """The text's variant; a fault is an error that names it."""
    fault = json_fault(text)
    return F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("JSON: "), fault)).cast("variant")).otherwise(F.try_parse_json(text))


def finite_text(v: Column) -> Column:
    """A number as JSON, one that isn't finite as text: ``"nan"``, ``"inf"``, ``"-inf"``. Null is null."""
    return F.when(F.isnan(v), '"nan"').when(v == float("inf"), '"inf"').when(v == -float("inf"), '"-inf"').otherwise(v.cast("string"))


def snapshot(attributes: Column, prefixes: tuple[str, ...], names: tuple[str, ...] = ()) -> Column:
    """Entries of a map whose key begins with one of ``prefixes`` or is one of ``names``, as JSON text in order of keys.
    None or a null map: ``{}``; a null value is null."""
    wanted = F.map_filter(attributes, lambda k, _: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: k.startswith(p)) | k.isin(*names))
    sorted_ = F.array_sort(F.map_entries(wanted))
    return F.coalesce(F.to_json(F.map_from_entries(sorted_), {"ignoreNullFields": "false"}), F.lit("{}"))
