"""JSON documents of any shape as a table of their leaves, and back.

A leaf is a value that holds no other: a text, number, truth value or null, or an empty object or list.
Leaves keep their place, the keys and positions that lead to them, their kind and, for numbers, their
digits, so the documents can be rebuilt from the table alone; keys stay in their order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import quoted

LEAF = "at int, steps array<struct<key:string,index:int>>, path string, kind string, value string"
STEPS = pa.list_(pa.struct([("key", pa.string()), ("index", pa.int32())]))
#: Kinds of leaves whose value is written as it is.
BARE = ("number", "boolean", "null")
SIMPLE_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
ROWS = 5_000
#: Characters that a task holds before it passes them on.
HELD = 1 << 23


class Number(str):
    """A number by its digits."""


def _refuse(name: str) -> Any:
    raise ValueError(f"no JSON value: {name}")


def decoded(text: str) -> Any:
    try:
        return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_refuse)
    except (ValueError, RecursionError) as e:
        raise ValueError(f"no JSON document: {text[:80]}") from e


def walk(value: Any, steps: tuple = ()) -> Iterator[tuple[tuple, str, str]]:
    """(steps, kind, value) of the leaves of a decoded document, in order."""
    todo = [(steps, value)]
    while todo:
        steps, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [((*steps, (k, None)), v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            todo += [((*steps, (None, i)), v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, (dict, list)):
            yield steps, "object" if isinstance(value, dict) else "array", ""
        elif isinstance(value, Number):
            yield steps, "number", str(value)
        elif isinstance(value, str):
            yield steps, "text", value
        else:
            yield steps, "null" if value is None else "boolean", json.dumps(value)


def path_of(steps: tuple) -> str:
    """The steps as text: ``$.key[0]."other key"``."""
    shown = ["$"]
    for key, index in steps:
        shown.append(f"[{index}]" if key is None else f".{key}" if SIMPLE_KEY.fullmatch(key) else f".{json.dumps(key, ensure_ascii=False)}")
    return "".join(shown)


def write(leaves: list[tuple[list[dict], str, str]]) -> str:
    """The document with the given (steps, kind, value), in order."""
    out: list[str] = []
    open_: list[tuple[tuple, str]] = []  # steps to each open container and its closing sign
    before: list[tuple] | None = None
    for steps, kind, value in leaves:
        path = [(s["key"], s["index"]) for s in steps]
        same = 0
        if before is not None:
            while same < len(path) - 1 and same < len(before) - 1 and path[same] == before[same]:
                same += 1
            while len(open_) > same + 1:
                out.append(open_.pop()[1])
            out.append(",")
        for depth in range(same, len(path)):
            key, _ = path[depth]
            if depth > same or before is None:
                out.append("[" if key is None else "{")
                open_.append((tuple(path[:depth]), "]" if key is None else "}"))
            if key is not None:
                out.append(json.dumps(key, ensure_ascii=False) + ":")
        out.append({"object": "{}", "array": "[]"}.get(kind) or (value if kind in BARE else json.dumps(value, ensure_ascii=False)))
        before = path
    while open_:
        out.append(open_.pop()[1])
    return "".join(out)


def json_leaves(documents: DataFrame, keys: list[str], column: str = "document") -> DataFrame:
    """(keys…, at, steps, path, kind, value): one row per leaf of every document, ``keys`` telling documents apart.

    A null document has no leaves; a text that is no JSON is refused.  Of a key that an object repeats the
    last value counts.
    """
    narrow = documents.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], quoted(column).alias("document"))
    narrow = narrow.where("document IS NOT NULL")
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, held = [], [], 0
            for n, text in enumerate(batch.column("document")):
                for at, (steps, kind, value) in enumerate(walk(decoded(text.as_py()))):
                    rows.append((at, [{"key": k, "index": i} for k, i in steps], path_of(steps), kind, value))
                    owners.append(n)
                    held += len(value)
                    if len(rows) >= ROWS or held >= HELD:
                        yield packed(batch, owners, rows)
                        rows, owners, held = [], [], 0
            if rows:
                yield packed(batch, owners, rows)

    def packed(batch: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), STEPS, pa.string(), pa.string(), pa.string()]
        own = [batch.column(k).take(pa.array(owners)) for k in names]
        return pa.RecordBatch.from_arrays(
            own + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=[*names, "at", "steps", "path", "kind", "value"],
        )

    schema = ", ".join(f"k{i} {narrow.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    found = narrow.mapInArrow(run, f"{schema}, {LEAF}" if keys else LEAF)
    return found.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def json_from_leaves(leaves: DataFrame, keys: list[str], column: str = "document") -> DataFrame:
    """(keys…, document) rebuilt from the leaves; a document is one row, as it was."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "steps", "kind", "value")))
    whole = leaves.groupBy(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(ordered.alias("leaves"))
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held = [], 0, 0
            for n, some in enumerate(batch.column("leaves"), 1):
                texts.append(write([(x["steps"], x["kind"], x["value"]) for x in some.as_py()]))
                held += len(texts[-1])
                if held >= HELD or n == len(batch):
                    own = [batch.column(k).slice(first, len(texts)) for k in names]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[*names, "document"])
                    texts, first, held = [], n, 0

    schema = ", ".join(f"k{i} {whole.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    found = whole.mapInArrow(run, f"{schema}, document string")
    return found.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)} | {"document": column})
