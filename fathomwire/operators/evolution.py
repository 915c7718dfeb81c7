"""Schemas as tables: differences between versions, conformance of payloads, and reading with another version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.plans.schema_language import Schema, struct_types
from fathomwire.plans.types import Member, Shape, members

FIELDS = "kind string, record string, number int, name string, type string, required boolean, integer int, signed boolean"


# The changes after which records of the old version can't be read, or read as something else.
BREAKING = ("record_removed", "required_field_added", "required_field_removed", "type_changed", "enum_removed", "enum_value_removed", "enum_value_reused", "interface_type_removed", "interface_id_changed")


def type_name(shape: Shape) -> str:
    star = "*" if shape.pointer else ""
    if shape.kind == "list":
        return f"{star}[{shape.size or ''}]{type_name(shape.item)}"
    if shape.kind == "map":
        return f"{star}map[{type_name(shape.key)}]{type_name(shape.item)}"
    if shape.kind == "record":
        return f"{star}record({', '.join(f'{m.number}:{type_name(m.shape)}' for m in shape.fields)})"
    if shape.kind == "union":
        return f"{star}union({', '.join(f'{i}:{n}' for i, n, _ in shape.branches)})"
    return star + shape.kind


def field_rows(name: str, struct: T.StructType) -> list[tuple]:
    """A row for each field of a record, for FIELDS."""

    def row(m: Member) -> tuple:
        kind = m.shape.kind if not m.shape.pointer else ""
        whole = kind.removeprefix("u").startswith("int")
        return "message", name, m.number, m.name, type_name(m.shape), m.required, int(kind.removeprefix("u")[3:]) if whole else None, not kind.startswith("u") if whole else None

    return [row(m) for m in members(struct)]


def fields_table(spark: SparkSession, records: dict[str, T.StructType]) -> DataFrame:
    return spark.createDataFrame([r for name, struct in records.items() for r in field_rows(name, struct)], FIELDS)


def schema_table(spark: SparkSession, schema: Schema, imported: dict[str, Schema] | None = None) -> DataFrame:
    """FIELDS of all that a schema file declares: fields of messages, values of enums, members of interfaces."""
    rows = [r for name, struct in struct_types(schema, imported).items() for r in field_rows(name, struct)]
    rows += [(e.kind, e.name, f.number, f.name, None, False, None, None) for e in schema.entries if e.kind != "message" for f in e.items]
    return spark.createDataFrame(rows, FIELDS)


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, record, number, change, breaking, detail) between two field tables: a full outer join by record and number.

    Messages: a changed type breaks unless an integer of the same sign gets wider; a new required field and a removed
    required one break; other added or removed fields and new names don't.  Enums: a removed value, and a number that another value
    takes, break.  Interfaces are joined by name: a removed type and a changed type id break.  A removed message or enum breaks.
    """
    key = F.when(F.col("kind") == "interface", F.col("name")).otherwise(F.col("number").cast("string"))
    o, n = (df.withColumn("key", key).select([F.col(c).alias(f"{p}_{c}") for c in ("key", *df.columns)]) for df, p in ((old, "old"), (new, "new")))
    same = (F.col("old_kind") == F.col("new_kind")) & (F.col("old_record") == F.col("new_record")) & (F.col("old_key") == F.col("new_key"))
    both = o.join(n, same, "full_outer")
    in_old, in_new = (df.select(F.col("kind").alias(f"{p}_k"), F.col("record").alias(f"in_{p}")).distinct() for df, p in ((old, "old"), (new, "new")))
    both = both.join(in_old, (F.col("new_kind") == F.col("old_k")) & (F.col("new_record") == F.col("in_old")), "left")
    both = both.join(in_new, (F.col("old_kind") == F.col("new_k")) & (F.col("old_record") == F.col("in_new")), "left")
    wider = (F.col("old_signed") == F.col("new_signed")) & (F.col("new_integer") >= F.col("old_integer"))
    kind = F.coalesce("old_kind", "new_kind")
    whole, part = (F.when(kind == "message", message).otherwise(F.concat(kind, F.lit("_"))) for message in ("record_", "field_"))
    part = F.when(kind == "enum", "enum_value_").when(kind == "interface", "interface_type_").otherwise(part)
    change = (
        F.when(F.col("old_number").isNull() & F.col("in_old").isNull(), F.concat(whole, F.lit("added")))
        .when(F.col("new_number").isNull() & F.col("in_new").isNull(), F.concat(whole, F.lit("removed")))
        .when(F.col("old_number").isNull(), F.concat(F.when(F.col("new_required"), "required_").otherwise(""), part, F.lit("added")))
        .when(F.col("new_number").isNull(), F.concat(F.when(F.col("old_required"), "required_").otherwise(""), part, F.lit("removed")))
        .when((kind == "enum") & (F.col("old_name") != F.col("new_name")), "enum_value_reused")
        .when((kind == "interface") & (F.col("old_number") != F.col("new_number")), "interface_id_changed")
        .when((F.col("old_type") != F.col("new_type")) & F.coalesce(wider, F.lit(False)), "type_widened")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
        .when(F.col("old_required") != F.col("new_required"), "required_changed")
        .when(F.col("old_name") != F.col("new_name"), "renamed")
    )
    breaking = change.isin(*BREAKING)
    side = lambda p: F.concat_ws(" ", f"{p}_type", F.when(kind == "interface", F.col(f"{p}_number")), f"{p}_name")
    detail = F.concat_ws(" -> ", side("old"), side("new"))
    out = both.select(kind.alias("kind"), F.coalesce("old_record", "new_record").alias("record"), F.coalesce("old_number", "new_number").alias("number"), change.alias("change"), breaking.alias("breaking"), detail.alias("detail"))
    return out.filter(F.col("change").isNotNull())


def read_as(value: Column, writer: T.StructType, reader: T.StructType) -> Column:
    """A decoded struct of ``writer`` as ``reader``: fields are matched by number, widened by casts; what the writer lacks is null."""
    by_number = {m.number: m for m in members(writer)}
    wanted = {m.name: m for m in members(reader)}
    out = []
    for f in reader.fields:
        have = by_number.get(wanted[f.name].number)
        if have is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StructType) and isinstance(writer[have.name].dataType, T.StructType) and have.shape.kind == "record":
            inner = read_as(value[have.name], writer[have.name].dataType, f.dataType)
            out.append(F.when(value[have.name].isNotNull(), inner).alias(f.name))
        else:
            out.append(value[have.name].cast(f.dataType).alias(f.name))
    return F.struct(*out)


def conformance(decoded: DataFrame) -> DataFrame:
    """(error, rows): how many payloads decoded, and which faults the others have."""
    return decoded.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("rows"))
