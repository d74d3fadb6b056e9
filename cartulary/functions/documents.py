"""JSON metadata documents kept as text."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column


def text_at(document: Column, *path: str) -> Column:
    """Text found under a path of object keys, null when absent."""
    return F.get_json_object(document, "$" + "".join(f"['{p}']" for p in path))


def has_property_text(document: Column, name: str) -> Column:
    """Is there a property of this name at any depth?  A text test, as stored documents are compact."""
    return document.contains(f'"{name}":')


def as_top_level(document: Column) -> Column:
    """Top-level members as a map of name to VARIANT."""
    return F.from_json(document, "map<string,variant>")


def merge_top_level(base: Column, patch: Column) -> Column:
    """Merge documents whose members are scalars or arrays: members of the patch win.

    Exact for such patches, and never leaves the JVM; nested objects need
    :func:`merging.merge_in_turn`.
    """
    old, new = as_top_level(base), as_top_level(patch)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return (
        F.when(base.isNull(), patch)
        .when(patch.isNull(), base)
        .otherwise(F.to_json(F.map_concat(kept, new)))
    )
