"""Deeply nested records to flat, linked tables by adjacency-table shredding.

``shred`` stores every node of a JSON text as ``(doc, node, parent, label, ordinal, kind, scalar)``. Lists do
not become nodes: their entries hang on the object that holds the list, with the list's label and their place.
``entities`` then joins the object nodes with their scalar children and pivots them, one row per object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADJACENCY = "doc {doc}, node int, parent int, label string, ordinal int, kind string, scalar string"
_SPACE = re.compile(r"[ \t\n\r]*")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@lru_cache(10_000)
def snake(name: str) -> str:
    return _HUMP.sub("_", name.strip()).replace("-", "_").replace(" ", "_").lower()


def _strict(word: str):
    raise ValueError(f"{word} is no JSON")


def parse(text: str | None):
    """The value of a JSON text as a 1-tuple, or None if it isn't valid JSON (NaN and Infinity aren't)."""
    if text is None:
        return None
    try:
        return (json.loads(text, parse_constant=_strict, parse_int=_int),)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return (_deep(text),)
    except ValueError:
        return None


def _int(digits: str):
    """An integer; one too long for Python's conversion stays text."""
    return int(digits) if len(digits) < 4_000 else digits


def _deep(text: str):
    """What ``json.loads`` gives, for texts nested too deeply for it: no recursion."""
    scalar, end = json.JSONDecoder(parse_constant=_strict, parse_int=_int).raw_decode, len(text)
    skip = lambda i: _SPACE.match(text, i).end()
    top: list = []
    stack: list[list] = [[top, None]]  # open containers, each with the key that waits for its value

    def put(value):
        into, key = stack[-1]
        if isinstance(into, list):
            into.append(value)
        else:
            into[key] = value

    def key(i):
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        stack[-1][1], i = json.decoder.scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        return skip(i + 1)

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "[" or c == "{":
            new: list | dict = [] if c == "[" else {}
            put(new)
            stack.append([new, None])
            i = skip(i + 1)
            if text[i : i + 1] != ("]" if c == "[" else "}"):
                i = i if c == "[" else key(i)
                continue
        else:
            value, i = scalar(text, i)
            put(value)
            i = skip(i)
        while len(stack) > 1:
            c, inside = text[i : i + 1], isinstance(stack[-1][0], list)
            if c == ("]" if inside else "}"):
                stack.pop()
                i = skip(i + 1)
            elif c == ",":
                i = skip(i + 1)
                i = i if inside else key(i)
                break
            else:
                raise ValueError("no end")
        else:
            if i != end:
                raise ValueError("more than one value")
            return top[0]


def _decoded(value):
    """Lists and objects that were delivered as JSON text count as what they hold."""
    if isinstance(value, str) and (value[:1] in ("[", "{") or (value[:1].isspace() and value.lstrip()[:1] in ("[", "{"))):
        inner = parse(value)
        if inner is not None and isinstance(inner[0], (list, dict)):
            return inner[0]
    return value


def _entries(value):
    """(place, entry) of a list, of an object keyed by places, or of a lone value."""
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict) and value and all(k.isdecimal() for k in value):
        return sorted((int(k), v) for k, v in value.items())
    return [(0, value)]


def nodes_of(root, scalars: frozenset[str] | None = None) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar) of one parsed value, parents first; no recursion."""
    stack, n = [(None, "", place, entry) for place, entry in reversed(_entries(_decoded(root)))], 0
    while stack:
        parent, label, ordinal, value = stack.pop()
        value = _decoded(value)
        if isinstance(value, (dict, list)):
            own, n = n, n + 1
            yield own, parent, label, ordinal, "object" if isinstance(value, dict) else "list", None
            if isinstance(value, list):  # a list in a list
                stack += [(own, label, place, entry) for place, entry in reversed(list(enumerate(value)))]
                continue
            for key, child in reversed(value.items()):
                name = snake(key)
                stack += [(own, name, place, entry) for place, entry in reversed(_entries(_decoded(child)))]
        elif value is not None and (scalars is None or label.replace("_", "") in scalars):
            own, n = n, n + 1
            text = value if isinstance(value, str) else json.dumps(value)
            yield own, parent, label, ordinal, "scalar", text


def shred(df: DataFrame, doc: str, payload: str, scalars: Iterable[str] | None = None) -> DataFrame:
    """The adjacency table of all valid ``payload`` texts.

    ``scalars`` names the scalar labels to keep (underscores don't matter); None keeps all. Texts that are null
    or not valid JSON give no rows, as do JSON nulls; a null entry still keeps its place in its list. Keys are
    written in snake case whatever the producer's style. Other columns of ``df`` are not read. Each text is
    parsed once, in Arrow batches; nothing is gathered, so a huge text costs only its own task.
    """
    keep = None if scalars is None else frozenset(s.replace("_", "").lower() for s in scalars)
    kind = df.schema[doc].dataType.simpleString()
    flush = 200_000

    def run(batches):
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            cols = [[] for _ in range(7)]
            for d, text in zip(docs, texts):
                value = parse(text.as_py())
                if value is None:
                    continue
                for row in nodes_of(value[0], keep):
                    cols[0].append(d)
                    for c, x in zip(cols[1:], row):
                        c.append(x)
                    if len(cols[0]) >= flush:
                        yield _batch(cols, batch.schema.field(0).type)
                        cols = [[] for _ in range(7)]
            if cols[0]:
                yield _batch(cols, batch.schema.field(0).type)

    return df.select(F.col(doc), F.col(payload)).mapInArrow(run, ADJACENCY.format(doc=kind))


def _batch(cols: Sequence[list], doc_type: pa.DataType) -> pa.RecordBatch:
    types = [doc_type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = ["doc", "node", "parent", "label", "ordinal", "kind", "scalar"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def entities(adjacency: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per object node: doc, node, parent, label, ordinal and its scalar children ``fields``.

    The join of object nodes with their scalar children is one aggregate: an object brings itself under its own
    number, a scalar comes under its parent's. The key ``(doc, node)`` spreads even one huge document over all
    tasks. A field that occurs several times gives its first value, a missing one null.
    """
    flat = F.regexp_replace("label", "_", "")
    own = F.col("kind") == "object"
    rows = adjacency.where("kind <> 'list'").select(
        "doc",
        F.when(own, F.col("node")).otherwise(F.col("parent")).alias("node"),
        F.when(own, F.struct("parent", "label", "ordinal")).alias("o"),
        F.when(~own, flat).alias("f"),
        "ordinal",
        "scalar",
    ).where("node IS NOT NULL")
    picks = [F.min(F.when(F.col("f") == x.replace("_", ""), F.struct("ordinal", "scalar"))).alias(x) for x in fields]
    return (
        rows.groupBy("doc", "node")
        .agg(F.max("o").alias("o"), *picks)
        .where("o IS NOT NULL")
        .select("doc", "node", "o.parent", "o.label", F.col("o.ordinal").alias("ordinal"), *[F.col(x)["scalar"].alias(x) for x in fields])
    )


def objects_of(root, fields: dict[str, int], lists: dict[str, int]) -> Iterator[list]:
    """[node, parent, label, ordinal, fields..., lists...] of the objects of one parsed value, parents first.

    The object nodes of ``nodes_of`` joined with their scalar children on the spot: an object's scalars are at hand
    when it is met, so they needn't become rows first. ``fields`` and ``lists`` give the place of each label without
    underscores; a field takes the first scalar of its label, a list all of them in order.
    """
    width = 4 + len(fields) + len(lists)
    stack, n = [(None, "", place, entry) for place, entry in reversed(_entries(_decoded(root)))], 0
    while stack:
        parent, label, ordinal, value = stack.pop()
        value = _decoded(value)
        if isinstance(value, list):  # a list in a list
            own, n = n, n + 1
            stack += [(own, label, place, entry) for place, entry in reversed(list(enumerate(value)))]
            continue
        if not isinstance(value, dict):
            continue
        own, n = n, n + 1
        row = [own, parent, label, ordinal] + [None] * (width - 4)
        below = []
        for key, child in value.items():
            name, child = snake(key), _decoded(child)
            flat = name.replace("_", "")
            at, many = fields.get(flat), lists.get(flat)
            for place, entry in _entries(child):
                inner = _decoded(entry)
                if isinstance(inner, (dict, list)):
                    below.append((own, name, place, inner))
                elif inner is not None and (at is not None or many is not None):
                    text = inner if isinstance(inner, str) else json.dumps(inner)
                    if at is not None and row[at] is None:
                        row[at] = text
                    if many is not None:
                        row[many] = [text] if row[many] is None else [*row[many], text]
        yield row
        stack += reversed(below)


def shred_objects(df: DataFrame, doc: str, payload: str, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """``doc, node, parent, label, ordinal, *fields, *lists``: what ``entities(shred(...), fields)`` gives, in one step.

    Objects are joined with their scalar children where their text is parsed, so scalars aren't shuffled. ``lists``
    are labels whose scalars are kept as an array. Node numbers count objects and lists only. Texts that are null or
    not valid JSON give no rows; nothing is gathered but one text's own objects.
    """
    kind = df.schema[doc].dataType.simpleString()
    at = {f.replace("_", ""): 4 + i for i, f in enumerate(fields)}
    many = {f.replace("_", ""): 4 + len(fields) + i for i, f in enumerate(lists)}
    text_list = pa.list_(pa.string())
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * len(fields), *[text_list] * len(lists)]
    names = ["doc", "node", "parent", "label", "ordinal", *fields, *lists]

    def run(batches):
        for batch in batches:
            rows, docs = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = parse(text.as_py())
                if value is None:
                    continue
                for row in objects_of(value[0], at, many):
                    rows.append(row)
                    docs.append(d)
                    if len(rows) >= 100_000:
                        yield whole(batch, docs, rows)
                        rows, docs = [], []
            if rows:
                yield whole(batch, docs, rows)

    def whole(batch, docs, rows):
        return pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    schema = ", ".join([f"doc {kind}, node int, parent int, label string, ordinal int", *[f"`{f}` string" for f in fields], *[f"`{f}` array<string>" for f in lists]])
    return df.select(F.col(doc), F.col(payload)).mapInArrow(run, schema)
