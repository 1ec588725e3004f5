"""Entries as CSV lines and as little-endian binary records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_field(x: Column) -> Column:
    """Quoted, with quotes doubled, where a text has a comma, a quote or a line break."""
    text = x.cast("string")
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_entry(key: Column, value: Column) -> Column:
    return F.concat(csv_field(key), F.lit(","), csv_field(value))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of exactly the schema's fields; quoted line breaks and a leading byte-order mark are understood."""
    return spark.read.schema(schema).csv(path, multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8", enforceSchema=True)


def write_csv(entries: DataFrame, path: str) -> None:
    entries.write.csv(path, quote='"', escape='"')


def _reversed_hex(h: Column, size: int) -> Column:
    return F.concat(*(F.substring(h, size * 2 - 2 * i - 1, 2) for i in range(size)))


def le_int(x: Column, size: int = 4) -> Column:
    """Little-endian two's complement, as hex."""
    return _reversed_hex(F.substring(F.lpad(F.hex(x.cast("long").bitwiseAND((1 << 63) - 1 if size == 8 else (1 << 8 * size) - 1) if size < 8 else x.cast("long")), 16, "0"), 17 - 2 * size, 2 * size), size)


def varint(n: Column) -> Column:
    """Seven bits a byte, low ones first, of a non-negative int, as hex."""
    byte = lambda k: F.shiftright(n, 7 * k).bitwiseAND(127) + F.when(n >= 1 << 7 * (k + 1), 128).otherwise(0)
    return F.concat(*(F.when(n >= (1 << 7 * k if k else 0), F.lpad(F.hex(byte(k)), 2, "0")).otherwise("") for k in range(5)))


def le_string(x: Column) -> Column:
    raw = F.encode(x, "UTF-8")
    return F.concat(varint(F.length(raw)), F.hex(raw))


def binary_entry(key: Column, value: Column) -> Column:
    """A long key, then a string value with its byte length, as binary."""
    return F.unhex(F.concat(le_int(key, 8), le_string(value)))


#: Type names as in Spark DDL, with what struct reads; strings are length-prefixed.
FIXED = {"int": "<i", "long": "<q", "bigint": "<q", "float": "<f", "double": "<d", "boolean": "<?"}


def read_string(content: bytes, at: int) -> tuple[str, int]:
    """The text that starts with its byte length at a place, and where it ends."""
    n = shift = 0
    while True:
        if at >= len(content):
            raise ValueError("an entry ends early")
        b = content[at]
        at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
        if b < 128:
            break
    if at + n > len(content):
        raise ValueError("an entry ends early")
    return content[at : at + n].decode(), at + n


def read_entries(content: bytes, kinds: list[str]) -> Iterator[tuple]:
    """Rows of one file of concatenated entries; an entry that ends early is an error."""
    at = 0
    while at < len(content):
        row = []
        for kind in kinds:
            if kind == "string":
                text, at = read_string(content, at)
                row.append(text)
            else:
                try:
                    row.append(struct.unpack_from(FIXED[kind], content, at)[0])
                except struct.error as e:
                    raise ValueError("an entry ends early") from e
                at += struct.calcsize(FIXED[kind])
        yield tuple(row)


def read_binary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of binary files; ``schema`` is DDL of flat fields. Each file is read in one task, in batches."""
    fields = spark.createDataFrame([], schema).dtypes
    kinds, names = [k for _, k in fields], [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                rows: list[tuple] = []
                for row in read_entries(content, kinds):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
