"""Field access that reads alike for typed columns and for JSON held as VARIANT."""

from __future__ import annotations

import json
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Field:
    """What the operators ask about one field of a record. Expressions are built when asked for."""

    present: Column  # there and not null
    is_empty_text: Column  # the string ""
    is_empty_list: Column  # the list []
    type_name: Column  # str, int, float, bool, NoneType, list, dict
    number: Column  # the value if numeric (booleans count as 0 and 1), else null
    text: Column  # the value if a string, else null
    as_string: Column  # any value rendered as a string

    @cached_property
    def filled(self) -> Column:
        return self.present & ~self.is_empty_text & ~self.is_empty_list


# Runtime type names of the record model, by Spark type.
_TYPE_NAMES = (
    (T.StringType, "str"),
    (T.BooleanType, "bool"),
    (T.IntegralType, "int"),
    (T.FractionalType, "float"),
    (T.ArrayType, "list"),
    ((T.StructType, T.MapType), "dict"),
    (T.BinaryType, "bytes"),
    ((T.TimestampType, T.TimestampNTZType), "datetime"),
    (T.DateType, "date"),
)


def type_name_of(data_type: T.DataType) -> str:
    for spark_types, name in _TYPE_NAMES:
        if isinstance(data_type, spark_types):
            return name
    return data_type.typeName()


class TypedField(Field):
    """A column of a typed table. Its type is known when the plan is made."""

    def __init__(self, schema: T.StructType, name: str):
        self.known = name in schema.names
        self.kind = type_name_of(schema[name].dataType) if self.known else None
        self.name = name

    @cached_property
    def value(self) -> Column:
        return F.col(f"`{self.name}`") if self.known else F.lit(None).cast("string")

    @cached_property
    def present(self) -> Column:
        return self.value.isNotNull() if self.known else F.lit(False)

    @cached_property
    def is_empty_text(self) -> Column:
        return F.coalesce(self.value == "", F.lit(False)) if self.kind == "str" else F.lit(False)

    @cached_property
    def is_empty_list(self) -> Column:
        if self.kind != "list":
            return F.lit(False)
        return F.coalesce(F.size(self.value) == 0, F.lit(False))

    @cached_property
    def type_name(self) -> Column:
        if not self.known:
            return F.lit(None).cast("string")
        return F.when(self.value.isNull(), "NoneType").otherwise(F.lit(self.kind))

    @cached_property
    def number(self) -> Column:
        if self.kind == "bool":
            return self.value.cast("int")
        return self.value if self.kind in ("int", "float") else F.lit(None).cast("double")

    @cached_property
    def text(self) -> Column:
        return self.value if self.kind == "str" else F.lit(None).cast("string")

    @cached_property
    def as_string(self) -> Column:
        return F.to_json(self.value) if self.kind in ("list", "dict") else self.value.cast("string")


def variant_path(name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def variant_type_name(value: Column) -> Column:
    """Runtime type name of a JSON value held as VARIANT.

    Numbers with a point are stored as decimals. So are integers beyond 64 bits;
    those have no fraction and at least 19 digits.
    """
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "NoneType")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .otherwise(F.lower(kind))
    )


def is_object(record: Column) -> Column:
    return F.schema_of_variant(record).startswith("OBJECT")


class VariantField(Field):
    """A field of a JSON record. Absent and null are told apart by ``type_name``."""

    def __init__(self, record: Column, name: str):
        self.record, self.path = record, variant_path(name)

    def get(self, as_type: str) -> Column:
        return F.try_variant_get(self.record, self.path, as_type)

    @cached_property
    def value(self) -> Column:
        return self.get("variant")

    @cached_property
    def present(self) -> Column:
        return self.value.isNotNull() & ~F.coalesce(F.is_variant_null(self.value), F.lit(False))

    @cached_property
    def type_name(self) -> Column:
        return variant_type_name(self.value)

    @cached_property
    def is_empty_text(self) -> Column:
        return F.coalesce((self.type_name == "str") & (self.get("string") == ""), F.lit(False))

    @cached_property
    def is_empty_list(self) -> Column:
        empty = F.size(self.get("array<variant>")) == 0
        return F.coalesce((self.type_name == "list") & empty, F.lit(False))

    @cached_property
    def number(self) -> Column:
        # The cast alone would accept a number written as a string.
        return F.when(self.type_name.isin("int", "float"), self.get("double")).when(
            self.type_name == "bool", self.get("boolean").cast("double")
        )

    @cached_property
    def text(self) -> Column:
        return F.when(self.type_name == "str", self.get("string"))

    @cached_property
    def as_string(self) -> Column:
        """A number with a fraction keeps it ("1.0"), and booleans are "True" and "False": keys of
        different types stay apart."""
        plain = self.get("string")
        whole = (self.type_name == "float") & ~plain.rlike("[^0-9-]")
        return F.when(
            self.present,
            F.when(self.type_name == "bool", F.initcap(plain))
            .when(whole, F.concat(plain, F.lit(".0")))
            .otherwise(plain),
        )


def strict_json(text: Column) -> Column:
    """Parse a text that is exactly one JSON value, else null.

    The built-in parser stops after the first value and ignores the rest. Inside
    brackets a rest could only pass by opening with "]" or ",", inside braces only
    with "}" or ","; whatever passes both ways as a single value has no rest.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.size(F.try_variant_get(in_list, "$", "array<variant>")) == 1
    return F.when(
        single & in_object.isNotNull(), F.try_variant_get(in_list, "$[0]", "variant")
    )


@F.arrow_udf(T.StringType())
def json_literal(value: pa.Array) -> pa.Array:
    """A string as an ASCII JSON literal. Meant for a few field names, not for rows."""
    return pa.array([None if v is None else json.dumps(v) for v in value.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def redump_json(value: pa.Array) -> pa.Array:
    """JSON text re-serialised with spaced separators and ASCII escapes."""
    return pa.array(
        [None if v is None else json.dumps(json.loads(v)) for v in value.to_pylist()], pa.string()
    )
