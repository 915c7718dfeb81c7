"""Queries that reach each kind of value, limit and fault of the codec, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import values, wire
from fathomwire.operators.decode import decoded
from fathomwire.operators.encode import to_wire, violations, wire_size
from fathomwire.operators.evolution import conformance
from fathomwire.operators.legacy import legacy_fields
from fathomwire.plans.queries import DOCUMENT, PAGE, _union, encoded, of, query, reread, sql_hex, sql_size, sql_zigzag, table
from fathomwire.plans.registry import Registry
from fathomwire.plans.types import STRICT, UNLIMITED, Limits, Options, member
from fathomwire.session import dealt

WIDE = T.StructType(
    [
        member("flag", "bool", 1),
        member("u8", "uint8", 2, "uint8"),
        member("i8", "int8", 3),
        member("u16", "uint16", 4, "uint16"),
        member("i16", "int16", 5),
        member("code", "int32", 16, "enum"),
        member("u32", "uint32", 17, "uint32"),
        member("u64", "uint64", 18),
        member("i64", "int64", 300),
        member("state", "bytes", 20_000),
    ]
)
WIDE_SQL = {
    "flag": "(o_orderkey % 2 = 0)",
    "u8": "(o_orderkey % 256)",
    "i8": "(o_orderkey % 256 - 128)",
    "u16": "(o_orderkey * 7 % 65536)",
    "i16": "(o_orderkey * 7 % 65536 - 32768)",
    "code": "(o_custkey % 3)",
    "u32": "(o_orderkey * 286331 % 4294967296)",
    "u64": "(CAST('18446744073709551615' AS {big}) - o_orderkey)",
    "i64": "(-o_orderkey * 1000003)",
    "state": "o_orderstatus",
}


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    def column(f: T.StructField):
        c = F.expr(WIDE_SQL[f.name].format(big="decimal(20,0)"))
        return (F.encode(c, "UTF-8") if f.name == "state" else c.cast(f.dataType)).alias(f.name)

    return table(spark, sf_dir, "orders").select("o_orderkey", *[column(f) for f in WIDE.fields])


def _wide_sql_hex() -> str:
    parts = []
    for f in WIDE.fields:
        v, kind = WIDE_SQL[f.name].format(big="HUGEINT"), f.metadata.get("kind") or {"flag": "bool", "state": "bytes", "u64": "uint64"}.get(f.name, f"int{f.name[1:]}")
        wire_type = {"bool": 0, "bytes": 2}.get(kind, 0 if kind[0] == "u" else 4)
        tag = wire.compact_tag(f.metadata["field_number"], wire_type).hex().upper()
        if kind == "bool":
            parts.append(f"CASE WHEN {v} THEN '{tag}01' ELSE '' END")
        elif kind == "bytes":
            parts.append(f"'{tag}' || {sql_hex(f'strlen({v})')} || hex(encode({v}))")
        elif kind in ("uint8", "int8"):
            parts.append(f"CASE WHEN {v} = 0 THEN '' ELSE '{tag}' || printf('%02X', CAST(({v} + 256) % 256 AS INTEGER)) END")
        else:
            parts.append(f"CASE WHEN {v} = 0 THEN '' ELSE '{tag}' || {sql_hex(v if kind[0] == 'u' else sql_zigzag(v), 10)} END")
    return " || ".join(f"({p})" for p in parts) + " || '00'"


@query(f"SELECT o_orderkey, {_wide_sql_hex()} AS hex, CAST(length({_wide_sql_hex()}) / 2 AS INTEGER) AS bytes FROM orders")
def orders_scalars_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bool, bytes, enum and whole numbers of every width, behind tags of one to four bytes, and their size."""
    size = wire_size(of(WIDE), WIDE, UNLIMITED).cast("int")
    return _wide(spark, sf_dir).select("o_orderkey", F.hex(to_wire(of(WIDE), WIDE, UNLIMITED)).alias("hex"), size.alias("bytes"))


@query("SELECT o_orderkey, " + ", ".join(f"{'hex(encode(o_orderstatus))' if c == 'state' else v.format(big='HUGEINT') if c == 'flag' else f'CAST({v} AS VARCHAR)'.format(big='HUGEINT')} AS {c}" for c, v in WIDE_SQL.items()) + " FROM orders")
def orders_scalars_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, decoded again."""
    rows = _wide(spark, sf_dir)
    back = reread(rows.select("o_orderkey", to_wire(of(WIDE), WIDE, UNLIMITED).alias("payload")), WIDE).select("o_orderkey", "record.*")
    plain = {"flag": F.col("flag"), "state": F.hex("state")}
    return back.select("o_orderkey", *[plain.get(f.name, F.col(f.name).cast("string")).alias(f.name) for f in WIDE.fields])


def _odd_float(column: str) -> str:
    return f"CASE o_orderkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -CAST(0 AS DOUBLE) WHEN 2 THEN -{column} WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE {column} END"


def _sql_float_hex(v: str, kind: str) -> str:
    """Canonical little-endian hex of a floating number."""
    plain = f"CASE WHEN isnan({v}) THEN CAST('nan' AS {kind}) ELSE CAST({v} AS {kind}) + 0 END"
    return f"list_reduce(list_reverse(regexp_extract_all(CASE WHEN isnan({v}) THEN '{'7FF8000000000000' if kind == 'DOUBLE' else '7FC00000'}' ELSE hex(CAST(CAST({plain} AS BIT) AS BLOB)) END, '..')), lambda x, y: x || y)"


@query(
    f"""SELECT o_orderkey, CASE WHEN v = 0 THEN '' ELSE '12' || {_sql_float_hex('v', 'DOUBLE')} || '26' || {_sql_float_hex('v', 'FLOAT')} END || '00' AS hex
    FROM (SELECT o_orderkey, {_odd_float('o_totalprice')} AS v FROM orders)"""
)
def orders_floats_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats of both widths with NaN, negative zero and infinity: one NaN, no negative zero."""
    schema = T.StructType([member("wide", "float64", 1), member("narrow", "float32", 2)])
    v = F.expr(_odd_float("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("wide"), v.cast("float").alias("narrow"))
    return encoded(rows, schema, "o_orderkey").select("o_orderkey", F.hex("payload").alias("hex"))


@query(
    f"""SELECT CASE WHEN isnan(v) THEN 'nan' WHEN v = 0 AND signbit(v) THEN 'negative zero' WHEN isinf(v) THEN 'infinite' ELSE 'plain' END AS kind, count(*) AS n
    FROM (SELECT {_odd_float('o_totalprice')} AS v FROM orders) GROUP BY 1"""
)
def orders_float_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats that a record writes otherwise than they are, and others."""
    v = F.col("v")
    kind = F.when(F.isnan(v), "nan").when(wire.is_negative_zero(v), "negative zero").when(F.abs(v) == float("inf"), "infinite").otherwise("plain")
    return table(spark, sf_dir, "orders").select(F.expr(_odd_float("o_totalprice")).alias("v")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_RE, _IM = _odd_float("o_totalprice"), "CAST(o_custkey AS DOUBLE)"


@query(
    f"""SELECT o_orderkey, '12' || {_sql_float_hex('re', 'FLOAT')} || {_sql_float_hex('im', 'FLOAT')} || '24' || {_sql_float_hex('re', 'DOUBLE')} || {_sql_float_hex('im', 'DOUBLE')} || '00' AS hex
    FROM (SELECT o_orderkey, {_RE} AS re, {_IM} + 1 AS im FROM orders)"""
)
def orders_complex_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex numbers of both widths."""
    schema = T.StructType([member("narrow", "complex64", 1, "complex64"), member("wide", "complex128", 2, "complex128")])
    both = lambda kind: F.struct(F.expr(_RE).cast(kind).alias("re"), (F.expr(_IM) + 1).cast(kind).alias("im"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", both("float").alias("narrow"), both("double").alias("wide"))
    return rows.select("o_orderkey", F.hex(to_wire(of(schema), schema, UNLIMITED)).alias("hex"))


@query(
    f"""SELECT o_orderkey, '14' || '03' || '0161' || {sql_hex(sql_zigzag('o_custkey'))} || '0162' || {sql_hex(sql_zigzag('o_orderkey'))} || '016D' || {sql_hex(sql_zigzag('length(o_orderpriority)'))} || '00' AS hex,
    o_custkey AS a, o_orderkey AS b, CAST(length(o_orderpriority) AS BIGINT) AS m, 3 AS n, o_orderstatus AS by_number, o_totalprice AS by_float FROM orders"""
)
def orders_maps_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of several keys, given in no order: their bytes by key, and their values decoded; keys of text, whole and floating numbers."""
    schema = T.StructType([member("by_name", "map<string,bigint>", 1)])
    more = T.StructType([member("by_number", "map<int,string>", 1), member("by_float", "map<double,double>", 2)])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    rows = dealt(orders, "o_orderkey").select(
        "o_orderkey",
        F.create_map(F.lit("m"), F.char_length("o_orderpriority").cast("long"), F.lit("a"), F.col("o_custkey"), F.lit("b"), F.col("o_orderkey")).alias("by_name"),
        F.create_map(F.lit(7), F.col("o_orderpriority"), F.lit(-3), F.col("o_orderstatus")).alias("by_number"),
        F.create_map(F.lit(2.5), F.col("o_totalprice"), F.lit(-1.0), F.lit(0.0)).alias("by_float"),
    )
    wires = rows.select("o_orderkey", to_wire(of(schema), schema, UNLIMITED).alias("payload"), to_wire(of(more), more, UNLIMITED).alias("other"))
    one = reread(wires, schema).select("o_orderkey", "other", "record.by_name")
    # decoding puts maps back; the text of the bytes is made anew from what was decoded
    two = reread(one.select("o_orderkey", "by_name", F.col("other").alias("payload")), more).select("o_orderkey", "by_name", "record.*")
    name = F.col("by_name")
    return two.select("o_orderkey", F.hex(to_wire(of(schema), schema, UNLIMITED)).alias("hex"), name["a"].alias("a"), name["b"].alias("b"), name["m"].alias("m"), F.size(name).alias("n"), F.col("by_number")[-3].alias("by_number"), F.col("by_float")[F.lit(2.5)].alias("by_float"))


@query(
    f"""SELECT l_orderkey, l_linenumber, CAST(1 + 1 + 3 * 8 + 1 AS INTEGER) AS bytes, l_quantity AS first, l_tax AS third, CAST(0 AS DOUBLE) AS fourth, 4 AS n,
    '14' || '02' || {sql_hex(sql_zigzag('l_linenumber'))} || {sql_hex(sql_zigzag('l_partkey'))} || '00' AS hex FROM lineitem"""
)
def lineitem_fixed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of fixed size: written with three items, read with four, the last of which is zero."""
    writer = T.StructType([member("money", "array<double>", 1, size=3)])
    reader = T.StructType([member("money", "array<double>", 1, size=4)])
    whole = T.StructType([member("numbers", "array<bigint>", 1, size=2)])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    rows = dealt(lines, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("money"), F.array(F.col("l_linenumber").cast("long"), "l_partkey").alias("numbers"))
    wires = rows.select("l_orderkey", "l_linenumber", F.hex(to_wire(of(whole), whole, UNLIMITED)).alias("hex"), to_wire(of(writer), writer, UNLIMITED).alias("payload"))
    back = reread(wires.withColumn("bytes", F.octet_length("payload")), reader)
    item = lambda i: F.element_at("record.money", i)
    return back.select("l_orderkey", "l_linenumber", "bytes", item(1).alias("first"), item(3).alias("third"), item(4).alias("fourth"), F.size("record.money").alias("n"), "hex")


_NOTE = T.StructType([member("o_orderkey", "int64", 1), member("priority", "string", 2, required=True), member("rank", "int32", 3, pointer=True, required=True)])


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", priority.alias("priority"), F.when(F.col("o_custkey") % 2 == 1, F.lit(5)).alias("rank"))


@query(
    """SELECT missing, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'priority,rank' WHEN o_orderstatus = 'F' THEN 'priority'
    WHEN o_custkey % 2 = 0 THEN 'rank' ELSE '' END AS missing FROM orders) GROUP BY 1"""
)
def orders_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the required fields that hold nothing, before they are written."""
    rows = _notes(spark, sf_dir).select(F.array_join(violations(of(_NOTE), _NOTE), ",").alias("missing"))
    return rows.groupBy("missing").agg(F.count("*").alias("n"))


@query(
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'required_field_missing:priority' WHEN o_custkey % 2 = 0 THEN 'required_field_missing:rank' ELSE 'ok' END AS fault, count(*) AS n FROM orders GROUP BY 1"""
)
def orders_required_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the first required field that a reader misses."""
    rows = _notes(spark, sf_dir).select(to_wire(of(_NOTE), _NOTE).alias("payload"))
    back = decoded(rows, "payload", _NOTE)
    return back.groupBy(F.coalesce(F.concat_ws(":", "error", F.col("error_field")), F.lit("")).alias("f")).agg(F.count("*").alias("n")).select(F.when(F.col("f") == "", "ok").otherwise(F.col("f")).alias("fault"), "n")


@query(
    """SELECT policy, error, rows FROM (SELECT 'skip' AS policy, 'ok' AS error, count(*) AS rows FROM customer
    UNION ALL SELECT 'strict', CASE WHEN length(c_name) = 0 AND c_acctbal = 0 THEN 'ok' ELSE 'unknown_field' END, count(*) FROM customer GROUP BY 2)"""
)
def customer_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that lacks two of the writer's fields: it skips them, or, strict, refuses."""
    writer = T.StructType([member("c_custkey", "int64", 1), member("c_name", "string", 2), member("c_acctbal", "float64", 3)])
    reader = T.StructType([writer["c_custkey"]])
    rows = encoded(table(spark, sf_dir, "customer"), writer)
    seen = [conformance(decoded(rows, "payload", reader, o)).select(F.lit(p).alias("policy"), "error", "rows") for p, o in (("skip", UNLIMITED), ("strict", STRICT))]
    return seen[0].unionByName(seen[1])


_TEXT = T.StructType([member("doc_id", "int64", 1), member("text", "string", 2)])
_LIMIT = 1000


@query(
    f"""SELECT class, error, count(*) AS n, max(error_at) AS last_at FROM (SELECT CASE WHEN b > {_LIMIT} THEN 'limit' ELSE 'ok' END AS class, CASE WHEN b > {_LIMIT} THEN 'max_length_exceeded' ELSE 'ok' END AS error,
    CASE WHEN b > {_LIMIT} THEN CASE WHEN doc_id = 0 THEN 0 ELSE 1 + {sql_size(sql_zigzag('doc_id'))} END + 1 + {sql_size('b')} END AS error_at
    FROM (SELECT doc_id, strlen(coalesce(text, '')) AS b FROM documents)) GROUP BY 1, 2"""
)
def documents_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts above a reader's limit, by class of fault, and the place of the last fault."""
    rows = encoded(table(spark, sf_dir, "documents"), _TEXT)
    back = decoded(rows, "payload", _TEXT, Options(Limits(message=0, string=_LIMIT)))
    kinds = back.groupBy(values.fault_class(F.col("error")).alias("class"), F.coalesce("error", F.lit("ok")).alias("error"))
    return kinds.agg(F.count("*").alias("n"), F.max("error_at").cast("int").alias("last_at"))


@query(
    f"""SELECT doc_id, CASE WHEN odd THEN 'invalid_utf8' END AS error, CASE WHEN odd THEN CAST(1 + {sql_size('b + 1')} + b AS BIGINT) END AS error_at, CASE WHEN odd THEN 'text' END AS error_field,
    CASE WHEN NOT odd THEN CAST(length(text) AS BIGINT) END AS chars FROM (SELECT doc_id, doc_id % 3 = 1 AS odd, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS b FROM documents)"""
)
def documents_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts with a byte at their end that isn't UTF-8: fault, place and field."""
    raw, text = T.StructType([member("text", "bytes", 1)]), T.StructType([member("text", "string", 1)])
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.concat(body, wire.raw(b"\xff"))).otherwise(body).alias("text"))
    back = decoded(encoded(rows, raw, "doc_id"), "payload", text, UNLIMITED)
    return back.select("doc_id", "error", "error_at", "error_field", F.char_length("record.text").cast("long").alias("chars"))


@query(
    f"""SELECT number, wire_type, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT 1 AS number, 0 AS wire_type, {sql_size('p_partkey')} AS bytes FROM part
    UNION ALL SELECT 2, 2, {sql_size('strlen(p_name)')} + strlen(p_name) FROM part UNION ALL SELECT 300, 6, {sql_size(sql_zigzag('p_size'))} FROM part UNION ALL SELECT 4, 1, 8 FROM part) GROUP BY 1, 2"""
)
def part_legacy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields behind older tags, found by skipping from one to the next."""
    tag = lambda number, kind: wire.legacy_tag(F.lit(number), kind)
    run = F.concat(
        tag(1, 0), wire.uvarint(F.col("p_partkey")), tag(2, 2), wire.framed(F.encode("p_name", "UTF-8")), tag(300, 6), wire.svarint(F.col("p_size")), tag(4, 1), wire.fixed_le(wire.double_bits(F.col("p_retailprice")), 8)
    )
    found = legacy_fields(table(spark, sf_dir, "part").select(run.alias("run")), "run")
    sound = found.select(F.when(F.col("error").isNull(), F.col("number")).otherwise(F.raise_error(F.col("error"))).cast("int").alias("number"), F.col("wire_type").cast("int").alias("wire_type"), (F.col("end") - F.col("start")).alias("bytes"))
    return sound.groupBy("number", "wire_type").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query(
    """SELECT l_orderkey, l_linenumber, 12 AS bytes, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey * 1000003 % 4294967296 AS BIGINT) AS supp, CAST(CAST('18446744073709551615' AS HUGEINT) - l_orderkey AS VARCHAR) AS large,
    CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem"""
)
def lineitem_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of whole and floating numbers of four and eight bytes without a count, packed and taken apart."""
    four = F.array("l_partkey", F.col("l_suppkey") * 1_000_003 % (1 << 32), F.lit(7))
    eight = F.array((-1 - F.col("l_orderkey")), F.lit(1).cast("long"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.packed_fixed(four, 4).alias("four"), values.packed_fixed(eight, 8).alias("eight"), values.packed_floats(F.array("l_quantity", "l_tax"), 8).alias("floats"))
    stored = rows.repartition(F.col("l_orderkey"))  # Python functions take stored columns only
    back = stored.select("l_orderkey", "l_linenumber", F.octet_length("four").alias("bytes"), values.unpacked_fixed(F.col("four"), 4).alias("a"), values.unpacked_fixed(F.col("eight"), 8).alias("b"), values.unpacked_floats(F.col("floats"), 8).alias("c"))
    return back.select("l_orderkey", "l_linenumber", "bytes", F.col("a")[0].alias("part"), F.col("a")[1].alias("supp"), F.col("b")[0].cast("string").alias("large"), F.col("c")[0].alias("quantity"))


@query("SELECT 128 AS type_id, 'document' AS name, 'user' AS type_class, 3 AS fields, count(*) AS n FROM documents UNION ALL SELECT 129, 'page', 'user', 2, count(*) FROM pages")
def registered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of a registry beside the records of each type id."""
    from fathomwire.operators.encode import wire_type_id

    known = Registry()
    known.register("document", DOCUMENT)
    known.register_or_get("page", PAGE)
    known.register_or_get("document", DOCUMENT)
    rows, _ = _union(spark, sf_dir)
    counts = rows.groupBy(wire_type_id(F.substring("payload", 2, 10)).cast("int").alias("type_id")).agg(F.count("*").alias("n"))
    return known.listing(spark).join(counts, "type_id").select("type_id", "name", "type_class", "fields", "n")


@query(
    f"""SELECT n_regionkey, string_agg(hex, '' ORDER BY n_nationkey) AS frames FROM (SELECT n_regionkey, n_nationkey, {sql_hex('CAST(length(body) / 2 AS BIGINT)')} || body AS hex
    FROM (SELECT n_regionkey, n_nationkey, (CASE WHEN n_nationkey = 0 THEN '' ELSE '18' || {sql_hex(sql_zigzag('n_nationkey'))} END) || '24' || {sql_hex('strlen(n_name)')} || hex(encode(n_name)) || '00' AS body FROM nation)) GROUP BY 1"""
)
def nation_frames_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-framed records one behind another, each appended to those before it."""
    from fathomwire.operators.frames import gather_frames

    schema = T.StructType([member("n_nationkey", "int32", 1), member("n_name", "string", 2)])
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", to_wire(F.struct("n_nationkey", "n_name"), schema).alias("payload"))
    return gather_frames(rows, ["n_regionkey"], "payload", ["n_nationkey"]).select("n_regionkey", F.hex("frames").alias("frames"))


_FULL = T.StructType([member("o_orderkey", "int64", 1), member("even", "bool", 2), member("state", "string", 3), member("rank", "int32", 4, pointer=True)])


@query(
    f"""SELECT o_orderkey, '18' || {sql_hex(sql_zigzag('o_orderkey'))} || '20' || CASE WHEN o_orderkey % 2 = 0 THEN '01' ELSE '00' END || '34' || CASE WHEN o_orderstatus = 'F' THEN '00' ELSE '01' || hex(encode(o_orderstatus)) END
    || CASE WHEN o_custkey % 2 = 1 THEN '440A' ELSE '' END || '00' AS hex FROM orders"""
)
def orders_every_field_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that write zero values too."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("even"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("state"), F.when(F.col("o_custkey") % 2 == 1, F.lit(5)).alias("rank")
    )
    return rows.select("o_orderkey", F.hex(to_wire(of(_FULL), _FULL, Options(UNLIMITED.limits, omit_empty=False))).alias("hex"))


@query("SELECT nullif(o_orderkey, 0) AS o_orderkey, nullif(o_custkey % 3, 0) AS third, nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, '') AS state FROM orders")
def orders_absent_as_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a record leaves out, read as null."""
    schema = T.StructType([member("o_orderkey", "int64", 1), member("third", "int64", 2), member("state", "string", 3)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("third"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("state"))
    return decoded(encoded(rows, schema), "payload", schema, Options(UNLIMITED.limits, absent="null"), "FAILFAST").select("record.*")


@query(
    f"""SELECT o_orderkey, CAST(1 + 1 + {sql_size('n')} + list_sum(list_transform(range(n), lambda x: {sql_size(sql_zigzag('(x * 1000)'))}))
    + 1 + 1 + 2 + {sql_size(sql_zigzag('o_custkey'))} + 2 + {sql_size(sql_zigzag('o_orderkey'))} + 1 + 1 + 16 AS INTEGER) AS bytes FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 + 1 AS n FROM orders)"""
)
def orders_nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of lists, maps and fixed arrays without encoding them, as long as what encoding makes."""
    schema = T.StructType([member("steps", "array<bigint>", 1), member("keys", "map<string,bigint>", 2), member("pair", "array<double>", 3, size=2)])
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 7), lambda x: x * 1000)
    keys = F.create_map(F.lit("c"), F.col("o_custkey"), F.lit("o"), F.col("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", steps.alias("steps"), keys.alias("keys"), F.array(F.col("o_totalprice"), F.lit(0.0)).alias("pair"))
    made = rows.select("o_orderkey", wire_size(of(schema), schema, UNLIMITED).cast("int").alias("bytes"), F.octet_length(to_wire(of(schema), schema, UNLIMITED)).alias("made"))
    return made.select("o_orderkey", F.when(F.col("bytes") == F.col("made"), F.col("bytes")).alias("bytes"))


@query(
    """SELECT strict, error, CAST(sum(n) AS BIGINT) AS frames FROM (SELECT false AS strict, 'ok' AS error, CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 1 END AS n FROM orders
    UNION ALL SELECT true, 'ok', CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 1 END FROM orders UNION ALL SELECT false, 'unexpected_eof', 1 FROM orders WHERE o_orderkey % 4 IN (1, 2)
    UNION ALL SELECT true, 'unexpected_eof', 1 FROM orders WHERE o_orderkey % 4 > 0) GROUP BY 1, 2"""
)
def orders_frames_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames each, cut short by 0 to 3 bytes: an end behind a length alone is clean, unless reading is strict."""
    from functools import reduce

    from fathomwire.operators.frames import explode_frames

    both = F.concat(wire.framed(F.encode(F.lit("abc"), "UTF-8")), wire.framed(F.encode(F.lit("def"), "UTF-8")))
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", both.alias("run")).select(F.expr("substring(run, 1, octet_length(run) - CAST(o_orderkey % 4 AS INT))").alias("run"))
    seen = [explode_frames(rows, "run", strict=s).groupBy(F.lit(s).alias("strict"), F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("frames")) for s in (False, True)]
    return reduce(DataFrame.unionByName, seen)


@query(f"SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE 1 + {sql_size(sql_zigzag('n_nationkey'))} END + 1 + {sql_size('strlen(n_name)')} + strlen(n_name) + 1 AS BIGINT) AS consumed, n_name FROM nation")
def nation_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a reader gets where other bytes follow the record."""
    schema = T.StructType([member("n_nationkey", "int32", 1), member("n_name", "string", 2)])
    rows = encoded(table(spark, sf_dir, "nation"), schema).select(F.concat("payload", wire.raw(b"\x01\x02\x03")).alias("payload"))
    return decoded(rows, "payload", schema).select("record.n_nationkey", "consumed", "record.n_name")
