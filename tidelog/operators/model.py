"""Entry types as dataclasses: their Spark schemas, key columns, order, and what may not be stored."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.sources import serde


class Char(str):
    """One character."""


class Byte(int):
    """An unsigned byte, kept in a short."""


PRIMITIVES = {int: T.LongType(), str: T.StringType(), float: T.DoubleType(), bool: T.BooleanType(), Byte: T.ShortType(), Char: T.StringType()}


def key(cls: type) -> type:
    """Marks a dataclass as a key type."""
    cls.__store_role__ = "key"
    return cls


def value(cls: type) -> type:
    """Marks a dataclass as a value type; it can't be a key too."""
    if "__store_role__" in cls.__dict__:
        raise TypeError(f"{cls.__name__} is marked twice")
    cls.__store_role__ = "value"
    return cls


def classify(kind: type) -> str:
    if kind in PRIMITIVES:
        return "primitive"
    if dataclasses.is_dataclass(kind) and hasattr(kind, "__store_role__"):
        return "annotated"
    if typing.get_origin(kind) is list:
        inner = classify(typing.get_args(kind)[0])
        return f"{inner} collection" if inner in ("primitive", "annotated") else "unsupported"
    return "unsupported"


def spark_type(kind: type) -> T.DataType:
    what = classify(kind)
    if what == "primitive":
        return PRIMITIVES[kind]
    if what == "annotated":
        return schema(kind)
    if what.endswith("collection"):
        return T.ArrayType(spark_type(typing.get_args(kind)[0]), containsNull=False)
    raise TypeError(f"{kind} can't be stored")


def schema(cls: type) -> T.StructType:
    """The fields in their order; those of a key type are not nullable and flagged in the metadata."""
    if not (dataclasses.is_dataclass(cls) and hasattr(cls, "__store_role__")):
        raise TypeError(f"{cls} is not a marked dataclass")
    if not cls.__dataclass_params__.frozen:
        raise TypeError(f"{cls.__name__} must be frozen")
    own = cls.__store_role__ == "key"
    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, spark_type(hints[f.name]), not own, {"key": own}) for f in dataclasses.fields(cls)])


def _hex(kind: type, x: Column) -> Column:
    what = classify(kind)
    if what == "primitive":
        if kind is bool:
            return F.when(x, "01").otherwise("00")
        if kind in (str, Char):
            return serde.le_string(x)
        if kind is float:
            raise TypeError("SQL has no bytes of a float")
        return serde.le_int(x, 1 if kind is Byte else 8)
    if what == "annotated":
        hints = typing.get_type_hints(kind)
        return F.concat(*(_hex(hints[f.name], x[f.name]) for f in dataclasses.fields(kind)))
    inner = typing.get_args(kind)[0]
    return F.concat(serde.le_int(F.size(x), 4), F.array_join(F.transform(x, lambda e: _hex(inner, e)), ""))


def encoded(cls: type, entry: Column) -> Column:
    """Bytes of a struct of the type: its fields in their order, longs little-endian, texts with their byte length, collections with their size."""
    schema(cls)  # refuses what can't be stored
    return F.unhex(_hex(cls, entry))


def _layout(kind: type) -> tuple:
    """What a reader has to know of a type, without the type itself, which workers may not have."""
    what = classify(kind)
    if what == "annotated":
        hints = typing.get_type_hints(kind)
        return "fields", tuple((f.name, _layout(hints[f.name])) for f in dataclasses.fields(kind))
    if what == "primitive":
        return ("text",) if kind in (str, Char) else ("flag",) if kind is bool else ("number", 1 if kind is Byte else 8)
    return "list", _layout(typing.get_args(kind)[0])


def _read(layout: tuple, content: bytes, at: int) -> tuple[typing.Any, int]:
    what, *of = layout
    if what == "text":
        return serde.read_string(content, at)
    if what == "fields":
        out = {}
        for name, inner in of[0]:
            out[name], at = _read(inner, content, at)
        return out, at
    size = {"flag": 1, "list": 4}.get(what) or of[0]
    if at + size > len(content):
        raise ValueError("an entry ends early")
    raw, at = int.from_bytes(content[at : at + size], "little", signed=size == 8), at + size
    if what != "list":
        return (bool(raw) if what == "flag" else raw), at
    items = []
    for _ in range(raw):
        item, at = _read(of[0], content, at)
        items.append(item)
    return items, at


def decoded(entries: DataFrame, column: str, cls: type) -> DataFrame:
    """Rows of the type from a column of ``encoded`` entries, in Arrow batches; an entry that ends early or goes on is an error."""
    own, layout = schema(cls), _layout(cls)
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(0).to_pylist():
                row, at = _read(layout, content, 0)
                if at != len(content):
                    raise ValueError("an entry goes on")
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return entries.select(column).mapInArrow(run, own)


def order_columns(cls: type, prefix: str = "") -> list[Column]:
    """Columns that order entries as the type does: field by field, collections left out."""
    hints, out = typing.get_type_hints(cls), []
    for f in dataclasses.fields(cls):
        what = classify(hints[f.name])
        if what == "annotated":
            out += order_columns(hints[f.name], f"{prefix}{f.name}.")
        elif what == "primitive":
            out.append(F.col(f"{prefix}{f.name}").asc_nulls_first())
    return out
