"""Where the files of a run lie, and the options that name them."""

from __future__ import annotations

import os
from collections.abc import Iterable


def categories(text: str, known: Iterable[str]) -> tuple[str, ...]:
    """Comma-separated categories, each once, in their order; an empty list, blanks and unknown names are errors."""
    names = [c.strip() for c in text.split(",")]
    allowed = {*known}
    if not text.strip() or "" in names:
        raise ValueError("blank category")
    if strange := [c for c in names if c not in allowed]:
        raise ValueError(f"unknown categories: {strange}")
    return tuple(dict.fromkeys(names))


def data_dir(given: str | None, variable: str, sibling: str) -> str:
    """The first that is given: an argument, an environment variable, a sibling folder; it must exist."""
    path = given or os.environ.get(variable) or sibling
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return path


def part(root: str, **keys: str) -> str:
    """Folder of a partition: root/key=value/..., as partitionBy writes it."""
    for k, v in keys.items():
        if not v or "/" in v:
            raise ValueError(f"{k}={v!r} is no folder name")
        root = f"{root}/{k}={v}"
    return root


def shown(path: str, root: str) -> str:
    """Path relative to the project if it lies below it, else as it is."""
    rel = os.path.relpath(path, root)
    return path if rel.startswith("..") else rel


def training_registry(names: Iterable[str]) -> dict:
    """Registry of training files for a trainer: file, format and columns of each set."""
    columns = {"messages": "conversations", "system": "system", "tools": "tools"}
    return {n: {"file_name": f"{n}.jsonl", "formatting": "sharegpt", "columns": columns} for n in names}
