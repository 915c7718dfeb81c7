"""Queries over framed files, streams of them, and schemas, each over whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.operators.encode import is_zero
from fathomwire.operators.evolution import schema_changes, schema_table
from fathomwire.plans import schema_language as L
from fathomwire.plans.queries import EVENT, LINE_SHORT, _events, encoded, query, reread, sql_double, sql_int, sql_text, table
from fathomwire.plans.types import UNLIMITED, member, members
from fathomwire.session import shared_folder
from fathomwire.sources.wireframes import register


def framed_table(spark: SparkSession, rows: DataFrame, label: str) -> str:
    """The folder into which the frames of ``payload`` were written."""
    register(spark)
    path = f"{shared_folder(spark)}/fathomwire-frames/{label}-{uuid.uuid4().hex}"
    rows.select("payload").write.format("wireframes").mode("append").save(path)
    return path


@query(
    """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY 1"""
)
def wireframes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records into framed files, read back by ranges of their indexes, decoded and counted."""
    path = framed_table(spark, encoded(table(spark, sf_dir, "lineitem"), LINE_SHORT), "lineitem")
    frames = spark.read.format("wireframes").option("rangebytes", 1 << 20).load(path)
    back = reread(frames.select("payload"), LINE_SHORT).select("record.*")
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), quantity.alias("quantity"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def wireframes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed files as a stream that stops after half of them and goes on from its checkpoint: each record once."""
    rows = _events(spark, sf_dir)
    path = framed_table(spark, encoded(rows.filter("event_id % 2 = 0"), EVENT), "events")
    out = f"{shared_folder(spark)}/fathomwire-streams/{uuid.uuid4().hex}"

    def drain() -> None:
        stream = spark.readStream.format("wireframes").load(path)
        back = reread(stream.select("payload"), EVENT).select("record.event_type", "record.user_id")
        back.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()

    drain()
    encoded(rows.filter("event_id % 2 <> 0"), EVENT).write.format("wireframes").mode("append").save(path)
    drain()
    seen = spark.read.schema("event_type string, user_id long").parquet(f"{out}/rows")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").cast("long").alias("users"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def wireframes_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed files read without the first three frames of each, and those frames beside them."""
    schema = T.StructType([member("o_orderkey", "int64", 1)])
    path = framed_table(spark, encoded(table(spark, sf_dir, "orders"), schema), "orders")
    rest = spark.read.format("wireframes").option("skip", 3).load(path)
    first = spark.read.format("wireframes").load(path).filter("ordinal < 3")
    back = reread(rest.unionByName(first).select("payload"), schema)
    return back.agg(F.count("*").alias("n"), F.sum("record.o_orderkey").cast("long").alias("keys"))


TABLES = ("customer", "nation", "part", "region", "supplier")
_COLUMNS = {
    "customer": (("c_custkey", sql_int), ("c_name", sql_text), ("c_nationkey", sql_int), ("c_acctbal", sql_double), ("c_mktsegment", sql_text)),
    "nation": (("n_nationkey", sql_int), ("n_name", sql_text), ("n_regionkey", sql_int)),
    "part": (("p_partkey", sql_int), ("p_name", sql_text), ("p_brand", sql_text), ("p_type", sql_text), ("p_size", sql_int), ("p_retailprice", sql_double)),
    "region": (("r_regionkey", sql_int), ("r_name", sql_text)),
    "supplier": (("s_suppkey", sql_int), ("s_name", sql_text), ("s_nationkey", sql_int), ("s_acctbal", sql_double)),
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS record, {len(c)} AS fields, count(*) AS n, CAST(sum(1 + {' + '.join(f(name) for name, f in c)}) AS BIGINT) AS bytes FROM {t}" for t, c in _COLUMNS.items()))
def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of tables, chosen by name, as text; the text read into types; each table encoded by the type of its name."""
    frames = {t: table(spark, sf_dir, t) for t in (*TABLES, "orders", "labels")}
    text = L.write(L.from_tables({t: df.schema for t, df in frames.items()}, "shop", exclude=("ord*", "labels"), interface="Any"))
    types = L.struct_types(L.parse(text))
    return reduce(DataFrame.unionByName, [_sizes(frames[t], t, types[t]) for t in TABLES])


def _sizes(rows: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    own = encoded(rows, schema)
    return own.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("bytes")).select(F.lit(name).alias("record"), F.lit(len(schema.fields)).alias("fields"), "n", "bytes")


OLD = """
package shop;
enum Segment { AUTOMOBILE = 0; BUILDING = 1; FURNITURE = 2; HOUSEHOLD = 3; MACHINERY = 4; }
message customer { int64 c_custkey = 1; string c_name = 2; int32 c_nationkey = 3; float64 c_acctbal = 4; required string c_mktsegment = 5; }
message nation { int32 n_nationkey = 1; string n_name = 2; }
message region { int32 r_regionkey = 1; string r_name = 2; }
interface Place { 128 = nation; 129 = region; }
"""
NEW = """
package shop;
enum Segment { AUTOMOBILE = 0; CONSTRUCTION = 1; FURNITURE = 2; HOUSEHOLD = 3; OTHER = 5; }
message customer { int64 c_custkey = 1; string name = 2; int64 c_nationkey = 3; float32 c_acctbal = 4; required string note = 6; string phone = 7; }
message nation { int32 n_nationkey = 1; }
interface Place { 130 = nation; }
"""
_SEGMENT = lambda n: f"(SELECT count(*) FROM customer WHERE c_mktsegment = '{n}')"
_FILLED = lambda t, c: f"(SELECT count(*) FROM {t} WHERE {c})"


@query(
    f"""SELECT kind, record, CAST(number AS INTEGER) AS number, change, breaking, CAST(rows AS BIGINT) AS rows FROM (VALUES
    ('message', 'customer', 2, 'renamed', false, {_FILLED('customer', "c_name <> ''")}), ('message', 'customer', 3, 'type_widened', false, {_FILLED('customer', 'c_nationkey <> 0')}),
    ('message', 'customer', 4, 'type_changed', true, {_FILLED('customer', 'c_acctbal <> 0')}), ('message', 'customer', 5, 'required_field_removed', true, {_FILLED('customer', "c_mktsegment <> ''")}),
    ('message', 'customer', 6, 'required_field_added', true, (SELECT count(*) FROM customer)), ('message', 'customer', 7, 'field_added', false, 0), ('message', 'nation', 2, 'field_removed', false, {_FILLED('nation', "n_name <> ''")}),
    ('message', 'region', 1, 'record_removed', true, {_FILLED('region', 'r_regionkey <> 0')}), ('message', 'region', 2, 'record_removed', true, {_FILLED('region', "r_name <> ''")}),
    ('enum', 'Segment', 1, 'enum_value_reused', true, {_SEGMENT('BUILDING')}), ('enum', 'Segment', 4, 'enum_value_removed', true, {_SEGMENT('MACHINERY')}), ('enum', 'Segment', 5, 'enum_value_added', false, 0),
    ('interface', 'Place', 128, 'interface_id_changed', true, (SELECT count(*) FROM nation)), ('interface', 'Place', 129, 'interface_type_removed', true, (SELECT count(*) FROM region))
    ) AS t(kind, record, number, change, breaking, rows)"""
)
def compat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two versions of the tables' schema, each with the rows of the tables that it touches."""
    old, new = L.parse(OLD), L.parse(NEW)
    changes = schema_changes(schema_table(spark, old), schema_table(spark, new)).drop("detail")
    used = []
    for name, struct in L.struct_types(old).items():
        filled = [F.sum((~is_zero(F.col(m.name), m.shape)).cast("long")).alias(str(m.number)) for m in members(struct)]
        added = [F.count("*").alias(str(f.number)) for f in L.parse(NEW).of("message")[name].items if "required" in f.modifiers] if name in new.of("message") else []
        counts = table(spark, sf_dir, name).agg(*filled, *added)
        used.append(counts.unpivot([], counts.columns, "number", "rows").select(F.lit("message").alias("kind"), F.lit(name).alias("record"), F.col("number").cast("int"), "rows"))
    number = {f.name: f.number for f in old.of("enum")["Segment"].items}
    named = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("rows"))
    used.append(named.select(F.lit("enum").alias("kind"), F.lit("Segment").alias("record"), F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[F.col("c_mktsegment")].alias("number"), "rows"))
    used += [table(spark, sf_dir, f.name).agg(F.count("*").alias("rows")).select(F.lit("interface").alias("kind"), F.lit("Place").alias("record"), F.lit(f.number).alias("number"), "rows") for f in old.of("interface")["Place"].items]
    rows = reduce(DataFrame.unionByName, used)
    return changes.join(rows, ["kind", "record", "number"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


FAULTY = """package shop;
message customer { int64 c_custkey = 1; string c_name = 1; }
message supplier { required optional int64 s_suppkey = 1; Missing s_name = 2; }
message part { int64 p_partkey = 19500; string p_name = 600000000; map[bytes]int32 sizes = 3; }
enum nation { ALGERIA = 1; ALGERIA = 2; }
interface region { 0 = customer; 5 = nation; }
message customer { int64 c_custkey = 1; }
"""


@query(
    """SELECT record, severity, message, CAST(rows AS BIGINT) AS rows FROM (VALUES
    ('customer', 'error', 'customer: number 1 is used twice', (SELECT count(*) FROM customer)), ('customer', 'error', 'customer is declared twice', (SELECT count(*) FROM customer)),
    ('supplier', 'error', 'supplier.s_suppkey is both required and optional', (SELECT count(*) FROM supplier)), ('supplier', 'error', 'unknown type Missing', (SELECT count(*) FROM supplier)),
    ('part', 'warning', 'part.p_partkey: number 19500 is reserved', (SELECT count(*) FROM part)), ('part', 'error', 'part.p_name: number 600000000 is out of range', (SELECT count(*) FROM part)),
    ('part', 'error', 'bytes can''t be a map key', (SELECT count(*) FROM part)), ('nation', 'error', 'nation.ALGERIA is declared twice', (SELECT count(*) FROM nation)),
    ('nation', 'warning', 'nation has no zero value', (SELECT count(*) FROM nation)), ('region', 'error', 'region: type id 0 must be positive', (SELECT count(*) FROM region)),
    ('region', 'error', 'region: nation is not a message', (SELECT count(*) FROM region))) AS t(record, severity, message, rows)"""
)
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a schema of tables, each with the rows that its record has."""
    s = L.parse(FAULTY)
    lines = spark.createDataFrame(sorted({(e.line, e.name) for e in s.entries}), "line int, record string")
    rows = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("record"), "rows") for t in sorted({e.name for e in s.entries})])
    return L.report(spark, s).join(lines, "line").join(rows, "record").select("record", "severity", "message", "rows")
