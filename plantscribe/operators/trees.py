"""JSON and XML as rows of their leaves: one pass over each text where it lies, no job a level and no shuffle.

A text is parsed by an event reader (XML) or in one go (JSON) and walked with a stack of its own, so depth costs neither jobs nor
recursion. What isn't well-formed is null here; callers fall back to paragraphs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Leaf = tuple[str, str | None]


def _constant(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity are no JSON


class _Pairs(list):
    """An object's members in order, repeated names too."""


def json_walk(text: str) -> list[Leaf] | None:
    """Dotted path and value of every scalar, in the text's order; numbers as they are spelled, null as None."""
    try:
        root = json.loads(text, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=_constant)
    except (ValueError, RecursionError):  # thousands of levels: no document
        return None
    found: list[Leaf] = []
    stack: list[tuple[str, object]] = [("", root)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, list):
            members = value if isinstance(value, _Pairs) else ((str(k), v) for k, v in enumerate(value))
            stack += [(f"{path}.{name}" if path else name, v) for name, v in members][::-1]
        else:
            found.append((path, None if value is None else str(value).lower() if isinstance(value, bool) else value))
    return found


def xml_walk(text: str) -> list[Leaf] | None:
    """Local name and trimmed text before the first child of every element that has any, in order of the start tags."""
    found: list[list] = []
    stack: list[list[str] | None] = []  # an element's text so far, None once a child has begun

    def start(name: str, _: object) -> None:
        close()
        found.append([name.rpartition("}")[2], []])
        stack.append(found[-1][1])

    def close() -> None:
        if stack:
            stack[-1] = None

    def data(part: str) -> None:
        if stack and stack[-1] is not None:
            stack[-1].append(part)

    reader = expat.ParserCreate(namespace_separator="}")
    reader.StartElementHandler, reader.CharacterDataHandler = start, data
    reader.EndElementHandler = lambda _: (stack.pop(), close())
    try:
        reader.Parse(text, True)
    except expat.ExpatError:
        return None
    return [(name, joined) for name, parts in found if (joined := "".join(parts).strip())]


def leaves(rows: DataFrame, keys: list[str], text: str, walk: Callable[[str], list[Leaf] | None]) -> DataFrame:
    """``keys``, the text as ``_text`` and ``_leaves``, an array of ``name, value``; null for a null text and one that ``walk`` refuses."""
    own = rows.select(*keys, F.col(text).cast("string").alias("_text"))
    item = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [None if t is None or (f := walk(t)) is None else [{"name": n, "value": v} for n, v in f] for t in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, item)], [*part.schema.names, "_leaves"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{schema}, _leaves array<struct<name:string,value:string>>")
