"""Avro schemas as Spark schemas, for readers of Avro files and messages."""

from __future__ import annotations

from pyspark.sql import types as T

# The plain Avro types.
PLAIN = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bytes": T.BinaryType(), "fixed": T.BinaryType(), "string": T.StringType(),
    "enum": T.StringType(),
}


def row_schema(avro: dict) -> T.StructType:
    """The columns of a record schema; all are nullable. The top level must be a record."""
    if not isinstance(avro, dict) or avro.get("type") != "record":
        raise ValueError("the top level of a schema must be a record")
    return _record(avro)


def _record(avro: dict) -> T.StructType:
    return T.StructType([T.StructField(f["name"], _type(f["type"]), True) for f in avro["fields"]])


def _type(avro) -> T.DataType:
    if isinstance(avro, list):
        return _union(avro)
    name = avro["type"] if isinstance(avro, dict) else avro
    if name == "record":
        return _record(avro)
    if name == "array":
        return T.ArrayType(_type(avro["items"]), True)
    if name == "map":
        return T.MapType(T.StringType(), _type(avro["values"]), True)
    if isinstance(name, (dict, list)):
        return _type(name)
    if name not in PLAIN:
        raise ValueError(f"unknown type {name}")
    return PLAIN[name]


def _union(branches: list) -> T.DataType:
    """Null and one type: that type. Two other types: the first. More: text."""
    if len(branches) > 2:
        return T.StringType()
    others = [b for b in branches if b != "null"]
    return _type(others[0]) if others else T.NullType()
