"""The older profiler's reading of calls: more lenient, and told apart by how each body was read.

White space and the two-character escapes of CR, LF and TAB come off both ends until nothing
changes; a tag's body is trimmed. It is not the rule of the audit, which takes off one escape.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, is_object, literal, loads

#: How a body was read.
MODES = ("strict_json", "escaped_boundary_json", "python_literal", "failed")
STRUCTURES = ("normal", "nested_name_repaired", "nested_name_unverifiable", "nested_name_not_in_candidates", "invalid")
_ENDS = re.compile(r"^(?:\s|\\[rnt])+|(?:\s|\\[rnt])+$")
_ESCAPE = re.compile(r"\\[rnt]")


def read(text: str | None) -> tuple[str, str | None]:
    """(mode, canonical object): strict JSON, else a Python dict that JSON can write. A JSON value that is no object fails."""
    if text is None:
        return MODES[3], None
    body = _ENDS.sub("", text)
    at = text.find(body)
    ends = text[:at] + text[at + len(body) :]
    ok, value, _, _ = loads(body)
    if ok:
        if not isinstance(value, dict):
            return MODES[3], None
        return MODES[1] if _ESCAPE.search(ends) else MODES[0], canon(value)
    ok, value = literal(body)
    if ok and isinstance(value, dict):
        try:
            return MODES[2], canon(value)
        except (TypeError, ValueError, RecursionError):
            pass
    return MODES[3], None


@batched("mode string, value string")
def lenient_call(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(b) for b in bodies], columns=["mode", "value"])


def structure(value: Column, names: Column) -> Column:
    """State of a call: normal, nested name repaired, unverifiable (no tools), not a listed tool, or invalid."""
    good = is_object(value, "$.arguments")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant")) == "STRING", F.get_json_object(value, path))
    nested = text("$.arguments.name")
    listed = F.coalesce(F.array_contains(names, nested), F.lit(False))
    return (
        F.when(good & text("$.name").isNotNull(), STRUCTURES[0])
        .when(good & nested.isNotNull() & listed, STRUCTURES[1])
        .when(good & nested.isNotNull() & (F.coalesce(F.size(names), F.lit(0)) <= 0), STRUCTURES[2])
        .when(good & nested.isNotNull(), STRUCTURES[3])
        .otherwise(STRUCTURES[4])
    )
