"""Strict JSON as the data side and the prediction side read it.

VARIANT is not used: it forgets the difference of 1 and 1.0, takes trailing text and
has no equality. A value is parsed once, in an Arrow-batched function, into a kind and a
canonical string (sorted keys, no spaces, no ASCII escapes); all that follows is native.
"""

from __future__ import annotations

import ast
import json
import math
import warnings
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callframe.functions.batched import batched

PARSED = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("canon", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
NODE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("canon", T.StringType()),
    ]
)


def is_object(value: Column, path: str) -> Column:
    """Whether a JSON text has an object at a path, and not a string that reads like one; false for NULL and what is no JSON.

    VARIANT only tells the kind here. Texts beyond its size are taken by their first character.
    """
    at = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))
    return F.coalesce(at.startswith("OBJECT"), (F.length(value) > 1 << 24) & F.get_json_object(value, path).startswith("{"), F.lit(False))


def kind_of(value: Any) -> str:
    """Kind of a parsed value; a boolean is never a number and 1.0 is no integer."""
    if value is None:
        return "null"
    return _KINDS[type(value)]


_KINDS = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}


_CANON = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canon(value: Any) -> str:
    return _CANON.encode(value)


def _no_constant(name: str) -> Any:
    raise ValueError(f"constant {name} is not JSON")


def loads(text: str | None, constants: bool = True) -> tuple[bool, Any, str | None, str | None]:
    """(ok, value, error type, message). With constants NaN and Infinity are taken (data side), else refused.

    Depth beyond the parser's limit and integers beyond Python's digit limit count as failures.
    """
    if not isinstance(text, str):
        return False, None, "TypeError", f"expected text, got {type(text).__name__}"
    try:
        return True, json.loads(text, parse_constant=None if constants else _no_constant), None, None
    except json.JSONDecodeError as e:
        return False, None, "JSONDecodeError", str(e)
    except (ValueError, RecursionError) as e:
        return False, None, type(e).__name__, str(e)


def literal(text: str) -> tuple[bool, Any]:
    """A Python literal, without evaluating anything. What is no literal, or too deep, is (False, None)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return True, ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return False, None


def safe_canon(value: Any) -> str | None:
    """canon of a value that may hold what JSON cannot (Python literals): then its repr."""
    try:
        return canon(value)
    except (TypeError, ValueError, RecursionError):
        return repr(value)


def parse_frame(texts: pd.Series, constants: bool = True) -> pd.DataFrame:
    rows = []
    for t in texts:
        ok, value, kind, message = loads(t if isinstance(t, str) else None, constants)
        rows.append((ok, kind_of(value) if ok else None, safe_canon(value) if ok else None, kind, message))
    return pd.DataFrame(rows, columns=["ok", "kind", "canon", "error_type", "error"])


@batched(PARSED)
def json_strict(texts: pd.Series) -> pd.DataFrame:
    """Parse of the data side: NaN and Infinity are accepted, NULL is a TypeError."""
    return parse_frame(texts)


@batched(PARSED)
def json_strict_finite(texts: pd.Series) -> pd.DataFrame:
    """Parse of the prediction side: NaN and Infinity are refused."""
    return parse_frame(texts, constants=False)


@batched(PARSED)
def py_literal(texts: pd.Series) -> pd.DataFrame:
    """Python literal to a JSON kind; what JSON has no kind for (sets, bytes, complex) is not ok, tuples are arrays."""
    rows = []
    for t in texts:
        ok, value = literal(t) if isinstance(t, str) else (False, None)
        if ok:
            try:
                value = json.loads(json.dumps(value))
                rows.append((True, kind_of(value), canon(value), None, None))
                continue
            except (TypeError, ValueError, RecursionError) as e:
                rows.append((False, None, None, type(e).__name__, str(e)))
                continue
        rows.append((False, None, None, "ValueError", "not a literal"))
    return pd.DataFrame(rows, columns=["ok", "kind", "canon", "error_type", "error"])


def object_nodes(value: Any) -> list[dict]:
    """The root and every member reached through objects only; arrays are leaves."""
    out = [{"path": "", "parent": None, "key": None, "kind": kind_of(value), "canon": canon(value)}]
    todo = [("", value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            for k in sorted(v):
                p = f"{at}.{k}" if at else k
                out.append({"path": p, "parent": at, "key": k, "kind": kind_of(v[k]), "canon": canon(v[k])})
                todo.append((p, v[k]))
    return out


@batched(T.ArrayType(NODE))
def json_nodes(texts: pd.Series) -> pd.Series:
    """Node list of an object (see object_nodes); text that does not parse has none."""
    out = []
    for t in texts:
        ok, value, _, _ = loads(t)
        out.append(object_nodes(value) if ok else [])
    return pd.Series(out)


def leaves(value: Any, path: str = "") -> list[tuple[str, Any]]:
    """Scalars and nulls with their paths (`a.b`, `a[0].b`), in document order; empty containers give none."""
    out: list[tuple[str, Any]] = []
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{at}.{k}" if at else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            todo.extend((f"{at}[{i}]", x) for i, x in reversed([*enumerate(v)]))
        else:
            out.append((at, v))
    return out


def same_number(value: Any) -> Any:
    """Numbers equal in value made equal in form; NaN stays."""
    if isinstance(value, float) and math.isfinite(value) and value.is_integer():
        return int(value)
    return value
