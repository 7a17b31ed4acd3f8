"""Deeply nested records as flat child tables over a store of distinct subtrees.

Every subtree gets a Merkle identity: a 128-bit hash of its kind and, for objects, of the
key-sorted (key, identity of the member) pairs, for arrays of the identities in order. Equal
subtrees thus have equal identities wherever they stand. One narrow pass over the texts
(`shred`) writes three tables, which all results are joined from:

* occurrences: (child, record_id, parent_index, tree), one row per text of a record; `tree`
  is the identity of its root, marked with the kind of text it is;
* trees: every distinct tree once, with its parent-child bridge (node, parent, ordinal, path,
  kind of each place) and its flat paths;
* nodes: every distinct subtree once (identity, kind, body); a container's body names its members
  by identity, so each text can be rebuilt.

A tree that thousands of records hold is parsed once per task and its paths are stored once;
records get them back through their occurrence (`bridge`, `flat_paths`), with a salted join
where one tree has a large share of all rows. Texts that are no JSON are rows of `rejects`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callframe.functions.jsonx import canon, kind_of, leaves, loads
from callframe.functions.skew import lookup_join
from callframe.functions.staging import spread, stage

#: Texts whose tree a task remembers, the longest that is worth remembering, and trees and nodes that it knows to be written.
MEMO_TEXTS, MEMO_CHARS, MEMO_NODES = 4_000, 20_000, 200_000
_ROWS = 5_000


def _digest(kind: str, body: str) -> bytes:
    return hashlib.blake2b(f"{kind}\x00{body}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def identities(value: Any) -> dict[int, tuple[bytes, str, str]]:
    """id() of every subtree -> (identity, kind, body); the body of a container names its members by identity."""
    out: dict[int, tuple[bytes, str, str]] = {}
    todo: list[tuple[Any, bool]] = [(value, False)]
    while todo:
        v, done = todo.pop()
        if isinstance(v, (dict, list)) and not done:
            todo.append((v, True))
            todo.extend((x, False) for x in (v.values() if isinstance(v, dict) else v))
            continue
        kind = kind_of(v)
        if isinstance(v, dict):
            body = canon({k: out[id(x)][0].hex() for k, x in v.items()})
        elif isinstance(v, list):
            body = canon([out[id(x)][0].hex() for x in v])
        else:
            body = canon(v)
        out[id(v)] = (_digest(kind, body), kind, body)
    return out


class Member(NamedTuple):
    """A place of a tree: ordinal among the sorted keys of its object or the elements of its array, path such as `a.b` and `a[0].b`."""

    node: bytes
    parent: bytes | None
    ordinal: int
    path: str
    kind: str


def members(value: Any, ids: dict[int, tuple[bytes, str, str]]) -> list[Member]:
    """Bridge of every subtree, the root (empty path, no parent) included. Places whose paths read the same are rows of their own."""
    out: list[Member] = []
    todo: list[tuple[Any, str, int, bytes | None]] = [(value, "", 0, None)]
    while todo:
        v, at, i, parent = todo.pop()
        n, kind, _ = ids[id(v)]
        out.append(Member(n, parent, i, at, kind))
        if isinstance(v, dict):
            todo.extend((v[k], f"{at}.{k}" if at else k, i, n) for i, k in enumerate(sorted(v)))
        elif isinstance(v, list):
            todo.extend((x, f"{at}[{i}]", i, n) for i, x in enumerate(v))
    return out


Flat = tuple[str, int | None, str]


def schema_paths(value: Any) -> list[Flat]:
    """Each property at any depth of `properties` and `items` of a parameter schema (`a.b`, `a[].b`), once."""
    out: dict[Flat, None] = {}
    todo: list[tuple[Any, str]] = [(value, "")]
    while todo:
        v, at = todo.pop()
        if not isinstance(v, dict):
            continue
        props = v.get("properties")
        if isinstance(props, dict):
            for k, x in props.items():
                path = f"{at}.{k}" if at else k
                out["param", None, path] = None
                todo.append((x, path))
        items = v.get("items")
        for x in items if isinstance(items, list) else [items]:
            todo.append((x, f"{at}[]"))
    return [*out]


def leaf_paths(value: Any) -> list[Flat]:
    """Each scalar or null of a call's arguments (`a.b`, `a[0].b`; a scalar root has the empty path), once."""
    return [*dict.fromkeys(("argument", None, path) for path, _ in leaves(value))]


def audit_paths(value: Any) -> list[Flat]:
    """argument_path of each issue detail and each different schema_path of a detail's errors, with the index of the detail."""
    out: dict[Flat, None] = {}
    details = value.get("issue_details") if isinstance(value, dict) else None
    for i, d in enumerate(details or []):
        if d and d.get("argument_path") is not None:
            out["issue", i, d["argument_path"]] = None
        for e in (d.get("schema_errors") if d else None) or []:
            if e and e.get("schema_path") is not None:
                out["schema_error", i, e["schema_path"]] = None
    return [*out]


_PATHS = {"param": schema_paths, "argument": leaf_paths, "audit": audit_paths}


class Tree(NamedTuple):
    tree: bytes
    ids: list[tuple[bytes, str, str]]
    members: list[Member]
    flat: list[Flat]


def tree_of(child: str, text: str) -> Tree | str:
    """The shredded tree of a text, or why it has none."""
    ok, value, kind, message = loads(text)
    if not ok:
        return f"{kind}: {message}"
    ids = identities(value)
    return Tree(child[:1].encode() + ids[id(value)][0], [*ids.values()], members(value, ids), _PATHS[child](value))


_MEMBER = pa.struct([("node", pa.binary()), ("parent", pa.binary()), ("ordinal", pa.int32()), ("path", pa.string()), ("kind", pa.string())])
_FLAT = pa.struct([("child", pa.string()), ("at", pa.int32()), ("path", pa.string())])
_FIELDS = [
    ("part", pa.string()),
    ("child", pa.string()),
    ("record_id", pa.int64()),
    ("parent_index", pa.int32()),
    ("tree", pa.binary()),
    ("members", pa.list_(_MEMBER)),
    ("flat", pa.list_(_FLAT)),
    ("node", pa.binary()),
    ("kind", pa.string()),
    ("body", pa.string()),
]
_SCHEMA = (
    "part string, child string, record_id bigint, parent_index int, tree binary, "
    "members array<struct<node binary, parent binary, ordinal int, path string, kind string>>, "
    "flat array<struct<child string, at int, path string>>, node binary, kind string, body string"
)


def _clean(text: str | None) -> str | None:
    """Lone surrogates cannot leave as UTF-8; they come out as escapes."""
    return text if text is None else text.encode("utf-8", "backslashreplace").decode("utf-8")


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array(map(_clean, values), pa.string())


def _lists(column: tuple[list[tuple] | None, ...], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, column by column; NULL is an empty list."""
    flat = [x for rows in column if rows for x in rows]
    ends = np.cumsum([0] + [len(rows) if rows else 0 for rows in column])
    cols = [*zip(*flat)] if flat else [()] * kind.num_fields
    parts = [_strings([*c]) if kind.field(i).type == pa.string() else pa.array(c, kind.field(i).type) for i, c in enumerate(cols)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=[*kind]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    made = {"members": lambda c: _lists(c, _MEMBER), "flat": lambda c: _lists(c, _FLAT), "body": lambda c: _strings([*c])}
    return pa.RecordBatch.from_arrays([made[n](c) if n in made else pa.array(c, t) for c, (n, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


class Shredded(NamedTuple):
    occurrences: DataFrame
    trees: DataFrame
    nodes: DataFrame
    rejects: DataFrame


def shred(texts: DataFrame) -> Shredded:
    """The tables of (child, record_id, parent_index, text) rows; child is `param`, `argument` or `audit`.

    NULL texts give no rows, texts that are no JSON (or too deep for the parser) a row of
    `rejects` (child, record_id, parent_index, error). Texts of any length are parsed whole.
    The pass is narrow; what it writes to the shared folder is read by all results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], Tree | str] = {}
        written: set[bytes] = set()
        rows: list[tuple] = []
        held = size = 0
        for batch in batches:
            for child, record, index, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    continue
                t = memo.get((child, text))
                if t is None:
                    t = tree_of(child, text)
                    if len(text) <= MEMO_CHARS:
                        if len(memo) >= MEMO_TEXTS or held >= MEMO_NODES:
                            memo.clear()
                            held = 0
                        memo[child, text] = t
                        held += len(t.members) if isinstance(t, Tree) else 1
                if isinstance(t, str):
                    rows.append(("reject", child, record, index, None, None, None, None, None, t))
                    continue
                rows.append(("occurrence", child, record, index, t.tree, None, None, None, None, None))
                if len(written) >= MEMO_NODES:
                    written.clear()
                if t.tree not in written:
                    written.add(t.tree)
                    rows.append(("tree", child, None, None, t.tree, t.members, t.flat, None, None, None))
                    size += len(t.members)
                    for n, kind, body in t.ids:
                        if n not in written:
                            written.add(n)
                            rows.append(("node", None, None, None, None, None, None, n, kind, body))
                if len(rows) + size >= _ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    parts = spread(texts.select("child", F.col("record_id").cast("bigint"), F.col("parent_index").cast("int"), "text")).mapInArrow(run, _SCHEMA)
    kept = stage(parts, "shredded", by="part")
    part = lambda name: kept.filter(F.col("part") == name)
    return Shredded(
        part("occurrence").select("child", "record_id", "parent_index", "tree"),
        part("tree").groupBy("tree").agg(F.first("members").alias("members"), F.first("flat").alias("flat")),
        part("node").groupBy("node").agg(F.first("kind").alias("kind"), F.first("body").alias("body")),
        part("reject").select("child", "record_id", "parent_index", F.col("body").alias("error")),
    )


def bridge(s: Shredded) -> DataFrame:
    """(child, record_id, parent_index, node, parent, ordinal, path, kind): every occurrence of every subtree."""
    met = lookup_join(s.occurrences, s.trees.select("tree", "members"), "tree")
    return met.select("child", "record_id", "parent_index", F.explode("members").alias("m")).select("child", "record_id", "parent_index", "m.*")


def flat_paths(s: Shredded) -> DataFrame:
    """(child, record_id, parent_index, node_path) of the four child tables: `param`, `argument`, `issue` and `schema_error`."""
    met = lookup_join(s.occurrences, s.trees.select("tree", "flat").filter(F.size("flat") > 0), "tree")
    one = met.select("record_id", "parent_index", F.explode("flat").alias("f"))
    return one.select("f.child", "record_id", F.coalesce("f.at", "parent_index").alias("parent_index"), F.col("f.path").alias("node_path"))


def distinct_nodes(s: Shredded) -> DataFrame:
    """(node, kind, body, occurrences): the store, with how often each subtree occurs in all records.

    Occurrences are counted per tree first, so a subtree that a third of all rows hold is
    counted from its few trees.
    """
    times = s.occurrences.groupBy("tree").agg(F.count("*").alias("n"))
    places = s.trees.select("tree", F.explode("members.node").alias("node")).join(times, "tree")
    return s.nodes.join(places.groupBy("node").agg(F.sum("n").alias("occurrences")), "node")


def occurrences(samples: DataFrame) -> DataFrame:
    """The JSON texts of every sample row: tool parameters and call arguments with their 0-based position."""

    def part(child: str, items: Column, text) -> DataFrame:
        one = samples.select(F.lit(child).alias("child"), F.col("line_number").alias("record_id"), F.posexplode(items).alias("parent_index", "item"))
        return one.select("child", "record_id", "parent_index", text(F.col("item")).alias("text"))

    tools = part("param", F.col("tools"), lambda t: t["function"]["parameters"])
    calls = part("argument", F.col("assistant.tool_calls"), lambda c: c["function"]["arguments"])
    return tools.unionByName(calls)


def audit_occurrences(audits: DataFrame) -> DataFrame:
    """The validation tree of every audit as one JSON text with the same columns as `occurrences`; NULL fields stay, as nulls."""
    text = F.to_json("argument_schema_validation", {"ignoreNullFields": "false"})
    return audits.select(F.lit("audit").alias("child"), F.col("audit_id").alias("record_id"), F.lit(0).alias("parent_index"), text.alias("text"))


def all_texts(samples: DataFrame, audits: DataFrame) -> DataFrame:
    """The texts of all three trees of the records."""
    return occurrences(samples).unionByName(audit_occurrences(audits))
