"""Contracts: required fields, types and constraints, compiled into column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchsafe.functions.records import Field, TypedField, VariantField, is_object

REASONS = "reasons"
RECORD = "rec"
POSITION = "_pos"
NOT_AN_OBJECT = "record is not an object"

# Runtime types that satisfy a contract type. A boolean is also an integer.
ACCEPTED_TYPES = {
    "str": ("str",),
    "int": ("int", "bool"),
    "float": ("float", "int", "bool"),
    "number": ("int", "float", "bool"),
    "bool": ("bool",),
    "list": ("list",),
    "dict": ("dict",),
}


@dataclass(frozen=True)
class Contract:
    """What a dataset's records must satisfy."""

    required: tuple[str, ...] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    constraints: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, spec: Mapping[str, Any]) -> Contract:
        return cls(
            tuple(spec.get("required", ())),
            dict(spec.get("types", {})),
            dict(spec.get("constraints", {})),
        )


# The bundled contracts.
CONTRACTS = {
    "products": Contract(
        required=("id", "title", "category", "price"),
        types={"id": "str", "title": "str", "category": "str", "price": "number"},
        constraints={"price": {"min": 0}, "title": {"min_length": 2}},
    ),
    "documents": Contract(
        required=("id", "title", "content"),
        types={"id": "str", "title": "str", "content": "str"},
        constraints={"content": {"min_length": 10}},
    ),
}
FALLBACK_CONTRACT = Contract(required=("id",))


def contract_for(dataset: str) -> Contract:
    return CONTRACTS.get(dataset, FALLBACK_CONTRACT)


FieldReader = Callable[[str], Field]


def field_reader(df: DataFrame, record: str | None = None) -> FieldReader:
    """Fields come from a VARIANT column if one is named, else from the table's own columns."""
    if record is not None:
        return cache(lambda name: VariantField(F.col(record), name))
    schema = df.schema
    return cache(lambda name: TypedField(schema, name))


def required_reason(name: str, value: Field) -> Column:
    return F.when(~value.present | value.is_empty_text, F.lit(f"missing required field '{name}'"))


def type_reason(name: str, expected: str, value: Field) -> Column | None:
    accepted = ACCEPTED_TYPES.get(expected)
    if accepted is None:
        return None
    return F.when(
        value.present & ~value.type_name.isin(*accepted),
        F.concat(F.lit(f"field '{name}' expected {expected}, got "), value.type_name),
    )


def min_reason(name: str, bound: Any, value: Field) -> Column:
    return F.when(value.number < F.lit(bound), F.lit(f"field '{name}' below min {bound}"))


def max_reason(name: str, bound: Any, value: Field) -> Column:
    return F.when(value.number > F.lit(bound), F.lit(f"field '{name}' above max {bound}"))


def min_length_reason(name: str, bound: int, value: Field) -> Column:
    return F.when(
        F.char_length(value.text) < F.lit(bound), F.lit(f"field '{name}' shorter than {bound}")
    )


def allowed_reason(name: str, allowed: list[Any], value: Field) -> Column:
    """Values compare as in the record model: numbers and booleans by value, strings as strings."""
    texts = [v for v in allowed if isinstance(v, str)]
    numbers = [float(v) for v in allowed if isinstance(v, (bool, int, float))]
    member = F.lit(False)
    if texts:
        member = member | F.coalesce(value.text.isin(*texts), F.lit(False))
    if numbers:
        member = member | F.coalesce(value.number.cast("double").isin(*numbers), F.lit(False))
    return F.when(value.present & ~member, F.lit(f"field '{name}' not in allowed set"))


# The order in which constraints of one field are reported.
_CONSTRAINTS = (
    ("min", min_reason),
    ("max", max_reason),
    ("min_length", min_length_reason),
    ("allowed", allowed_reason),
)


def reasons(contract: Contract, read: FieldReader) -> Column:
    """All violations of a record, in the order required, types, constraints."""
    checks = [required_reason(name, read(name)) for name in contract.required]
    checks += [type_reason(name, kind, read(name)) for name, kind in contract.types.items()]
    for name, rules in contract.constraints.items():
        checks += [
            check(name, rules[rule], read(name)) for rule, check in _CONSTRAINTS if rule in rules
        ]
    checks = [check for check in checks if check is not None]
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, contract: Contract, record: str | None = None) -> DataFrame:
    """Add the array of reasons; an empty array marks a valid record."""
    found = reasons(contract, field_reader(df, record))
    if record is not None:
        found = F.when(is_object(F.col(record)), found).otherwise(F.array(F.lit(NOT_AN_OBJECT)))
    return df.withColumn(REASONS, found)


def is_valid() -> Column:
    return F.size(REASONS) == 0


def valid_records(validated: DataFrame) -> DataFrame:
    return validated.where(is_valid()).drop(REASONS)


def quarantined(validated: DataFrame) -> DataFrame:
    """Failing records with their reasons joined into one text."""
    return validated.where(~is_valid()).withColumn("reason", F.concat_ws("; ", REASONS)).drop(REASONS)


def pass_rate() -> Column:
    """Aggregate: share of valid records, 0 for an empty batch."""
    return F.coalesce(F.avg(is_valid().cast("double")), F.lit(0.0))


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_valid()).alias("valid"),
        F.count_if(~is_valid()).alias("quarantined"),
        pass_rate().alias("pass_rate"),
    )


def reason_counts(validated: DataFrame) -> DataFrame:
    return (
        validated.select(F.explode(REASONS).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def quarantine_samples(
    validated: DataFrame, order: list[str], key: Column, limit: int = 6
) -> DataFrame:
    """The first failing records in input order; the limit is the report's size."""
    return (
        quarantined(validated)
        .select(*order, F.col("reason"), key.alias("id"))
        .orderBy(*order)
        .limit(limit)
    )


def quarantine_rows(
    validated: DataFrame, version_id: Column, record_key: Column, payload: Column
) -> DataFrame:
    """Rows of the quarantine table: version, key, reason, payload as JSON."""
    failing = validated.where(~is_valid())
    reason = F.coalesce(F.nullif(F.concat_ws("; ", REASONS), F.lit("")), F.lit("unknown"))
    return failing.select(
        version_id.alias("version_id"),
        F.coalesce(record_key.cast("string"), F.lit("")).alias("record_key"),
        reason.alias("reason"),
        payload.alias("payload"),
    )
