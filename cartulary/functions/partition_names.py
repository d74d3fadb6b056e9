"""Partition names such as ``dateint=20240101/hour=3``."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column

# Fixed value: the text that stands for a null partition value.
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"

# Characters Hive-style partition paths escape as %XX.
ESCAPED_CHARACTERS = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""


# A value spelled null does not count as a component at all.
_REAL = r"(?!(?i:null)(?:/|$))"
_DEFAULT = rf"(?i:{DEFAULT_PARTITION})(?=/|$)"


def _after_equals(text: Column) -> Column:
    """``=value`` to ``value``, empty text to null."""
    return F.try_element_at(F.split(text, "=", 2), F.lit(2))


def has_key(name: Column, key: str) -> Column:
    """Does the name carry a usable component for the key?"""
    return name.rlike(rf"(?<![^/]){re.escape(key)}={_REAL}")


def key_value(name: Column, key: str) -> Column:
    """Value of one key, read with one compiled regex so the scan stays in generated code.

    Null when there is no such component, or its value is the default partition.
    The last usable component counts.
    """
    if key.lower() == "null":
        return F.lit(None).cast("string")
    k = re.escape(key)
    # group 1 is "=value", and stays empty for the default partition
    pattern = rf"(?<![^/]){k}(?:={_DEFAULT}|(={_REAL}[^/]*))(?!.*/{k}={_REAL})"
    return _after_equals(F.regexp_extract(name, pattern, 1))


def key_value_or_path(name: Column, uri: Column, key: str) -> Column:
    """Key read from the name, or from the storage path when the name lacks it."""
    return F.when(has_key(name, key), key_value(name, key)).otherwise(key_value(uri, key))


# Any usable component: its key, and "=value" unless that is the default partition.
_COMPONENT = rf"(?<![^/])(?!(?i:null)=)([^/=]*)(?:={_DEFAULT}|(={_REAL}[^/]*))(?=/|$)"
# The same, but only the last component of each key; costs a look at the rest of the name.
_LAST_COMPONENT = rf"{_COMPONENT}(?!.*/\1={_REAL})"


def key_map(name: Column) -> Column:
    """All components as a map; keys whose component is the default partition map to null.

    Components without ``=`` and components spelling ``null`` are left out; of
    repeated keys the last one counts.
    """

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract_all(name, F.lit(pattern), F.lit(i))

    def as_map(pattern: str) -> Column:
        return F.map_from_arrays(group(pattern, 1), F.transform(group(pattern, 2), _after_equals))

    keys = group(_COMPONENT, 1)
    repeats = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeats, as_map(_LAST_COMPONENT)).otherwise(as_map(_COMPONENT))


def ordered_values(name: Column) -> Column:
    """Values of the components in order, default-partition text kept."""
    return F.regexp_extract_all(name, F.lit(r"(?<![^/])[^/=]*=([^/]*)"), F.lit(1))


def is_valid_name(name: Column, keys: list[str]) -> Column:
    """Every component is exactly ``k=v``, with a declared key and a real value."""
    if not keys:
        raise ValueError("the table declares no partition keys")
    declared = "|".join(re.escape(k) for k in keys)
    component = rf"(?:{declared})\s*=\s*(?!(?i:null)\s*(?:/|$))[^/=\s](?:[^/=]*[^/=\s])?"
    return name.rlike(rf"^[/\s]*(?:{component}(?:\s*/[/\s]*{component})*)?[/\s]*$")


def fits_keys(name: Column, keys: Column) -> Column:
    """:func:`is_valid_name` against a column with the row's own declared keys."""
    space = r"^\s+|\s+$"
    parts = F.filter(F.transform(F.split(name, "/"), lambda p: F.regexp_replace(p, space, "")), lambda p: p != "")

    def fits(part: Column) -> Column:
        halves = F.transform(F.split(part, "="), lambda h: F.regexp_replace(h, space, ""))
        value = F.get(halves, F.lit(1))
        return (F.size(halves) == 2) & F.array_contains(keys, F.get(halves, F.lit(0))) & (value != "") & (F.lower(value) != "null")

    return F.forall(parts, fits)


def escape_value(value: Column) -> Column:
    """Escape one key or value for use inside a partition path."""
    characters = F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1))
    escaped = F.array_join(
        F.transform(
            characters,
            lambda c: F.when(
                c.rlike(ESCAPED_CHARACTERS), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))
            ).otherwise(c),
        ),
        "",
    )
    return F.when(value.rlike(ESCAPED_CHARACTERS), escaped).otherwise(value)


def make_name(values: dict[str, Column]) -> Column:
    """Partition name from key values; null and empty values become the default partition."""
    components = []
    for key, value in values.items():
        text = value.cast("string")
        shown = F.when(text.isNull() | (text == ""), F.lit(DEFAULT_PARTITION)).otherwise(
            escape_value(text)
        )
        components.append(F.concat(escape_value(F.lit(key)), F.lit("="), shown))
    return F.concat_ws("/", *components)
