"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import values, wire
from fathomwire.operators.decode import decoded
from fathomwire.operators.encode import to_wire, wire_size, wire_type_id
from fathomwire.operators.encode_batches import with_wire
from fathomwire.operators.evolution import conformance, read_as
from fathomwire.operators.frames import chunked, explode_frames, gather_frames
from fathomwire.plans.types import STRICT, UNLIMITED, member, union
from fathomwire.session import shared_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from fathomwire.plans import codec_queries, schema_queries  # noqa: F401  (they put their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




# SQL text of the format's rules, for the oracles


def sql_zigzag(v: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN CAST({v} AS HUGEINT) * 2 ELSE -CAST({v} AS HUGEINT) * 2 - 1 END)"


def sql_size(u: str) -> str:
    return "(CASE " + " ".join(f"WHEN {u} < {1 << 7 * n} THEN {n}" for n in range(1, 10)) + " ELSE 10 END)"


def sql_hex(u: str, most: int = 5) -> str:
    """Hex of a varint of up to ``most`` bytes."""
    kind = "BIGINT" if most < 9 else "HUGEINT"

    def of(n: int) -> str:
        return " || ".join(f"printf('%02X', CAST((CAST({u} AS {kind}) >> {7 * i}) & 127 AS INTEGER) + {128 if i < n - 1 else 0})" for i in range(n))

    return "(CASE " + " ".join(f"WHEN {u} < {1 << 7 * n} THEN {of(n)}" for n in range(1, most)) + f" ELSE {of(most)} END)"


def sql_int(v: str, tag: int = 1) -> str:
    return f"(CASE WHEN {v} = 0 THEN 0 ELSE {tag} + {sql_size(sql_zigzag(v))} END)"


def sql_double(v: str, tag: int = 1) -> str:
    return f"(CASE WHEN {v} = 0 THEN 0 ELSE {tag + 8} END)"


def sql_text(v: str, tag: int = 1) -> str:
    return f"(CASE WHEN strlen({v}) = 0 THEN 0 ELSE {tag} + {sql_size(f'strlen({v})')} + strlen({v}) END)"


LINE = T.StructType(
    [
        member("l_orderkey", "int64", 1),
        member("l_partkey", "int64", 2),
        member("l_suppkey", "int64", 3),
        member("l_linenumber", "int32", 4),
        member("l_quantity", "float64", 5),
        member("l_extendedprice", "float64", 6),
        member("l_discount", "float64", 7),
        member("l_tax", "float64", 8),
        member("l_returnflag", "string", 9),
        member("l_linestatus", "string", 10),
    ]
)
LINE_SHORT = T.StructType([LINE[c] for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")])
NATION = T.StructType([member("n_nationkey", "int32", 1), member("n_name", "string", 2), member("n_regionkey", "int32", 3)])
REGION = T.StructType([member("r_regionkey", "int32", 1), member("r_name", "string", 2)])
EVENT = T.StructType([member("event_id", "int64", 1), member("micros", "int64", 2), member("user_id", "int64", 3), member("event_type", "string", 4), member("value", "float64", 5)])
DOCUMENT = T.StructType([member("doc_id", "int64", 1), member("text", "string", 2), member("lang", "string", 3)])
PAGE = T.StructType([member("page_id", "int64", 1), member("url", "string", 2)])


def of(schema: T.StructType) -> Column:
    """A struct of the columns that a schema names."""
    return F.struct(*schema.fieldNames())


def encoded(df: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    needed = list(dict.fromkeys([*keep, *schema.fieldNames()]))
    rows = df.select(*needed)
    if not df.isStreaming:
        rows = spread(rows)
    return with_wire(rows, schema, "payload", keep, UNLIMITED)


def reread(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with ``payload``, which these queries have encoded themselves, decoded: no limit drops a row, and a fault ends the query."""
    return decoded(df, "payload", schema, UNLIMITED, "FAILFAST")


@query(f"SELECT o_orderkey, CAST({sql_zigzag('(o_orderkey - 5000)')} AS BIGINT) AS zigzag FROM orders")
def zigzag_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zigzag of signed keys, and back."""
    z = wire.zigzag(F.col("o_orderkey") - 5000)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", z.alias("zigzag"))
    return rows.filter(wire.unzigzag(F.col("zigzag")) == F.col("o_orderkey") - 5000)


@query(f"SELECT CAST({sql_size('l_orderkey * l_partkey')} AS INTEGER) AS bytes, count(*) AS n FROM lineitem GROUP BY 1")
def uvarint_size_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many varints have how many bytes."""
    size = wire.uvarint_size(F.col("l_orderkey") * F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy(size.cast("int").alias("bytes")).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, {sql_hex('l_orderkey * 300')} AS hex FROM lineitem")
def uvarint_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varints in hex."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.hex(wire.uvarint(F.col("l_orderkey") * 300)).alias("hex"))


def _sql_int_hex(tag: str, v: str) -> str:
    return f"(CASE WHEN {v} = 0 THEN '' ELSE '{tag}' || {sql_hex(sql_zigzag(v))} END)"


def _sql_text_hex(tag: str, v: str) -> str:
    return f"(CASE WHEN strlen({v}) = 0 THEN '' ELSE '{tag}' || {sql_hex(f'strlen({v})')} || hex(encode({v})) END)"


@query(f"SELECT n_nationkey, {_sql_int_hex('18', 'n_nationkey')} || {_sql_text_hex('24', 'n_name')} || {_sql_int_hex('38', 'n_regionkey')} || '00' AS hex FROM nation")
def nation_wire_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records in hex."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.hex(to_wire(of(NATION), NATION)).alias("hex"))


@query(f"SELECT r_regionkey, sha256(unhex({_sql_int_hex('18', 'r_regionkey')} || {_sql_text_hex('24', 'r_name')} || '00')) AS sha FROM region")
def region_wire_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of canonical bytes."""
    return table(spark, sf_dir, "region").select("r_regionkey", F.sha2(to_wire(of(REGION), REGION), 256).alias("sha"))


_SHORT_SIZE = f"1 + {sql_int('l_orderkey')} + {sql_int('l_linenumber')} + {sql_double('l_quantity')} + {sql_double('l_extendedprice')} + {sql_double('l_discount')} + {sql_text('l_returnflag')}"


@query(
    f"""SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(sum({_SHORT_SIZE}) AS BIGINT) AS bytes FROM lineitem GROUP BY 1"""
)
def lineitem_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, aggregate."""
    rows = encoded(table(spark, sf_dir, "lineitem"), LINE_SHORT).withColumn("bytes", F.octet_length("payload"))
    back = reread(rows, LINE_SHORT).select("record.*", "bytes")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), exact("l_quantity").alias("quantity"), exact("l_extendedprice").alias("price"), F.sum("bytes").cast("long").alias("bytes"))


_LINE_SIZE = "1 + " + " + ".join({"LongType": sql_int, "IntegerType": sql_int, "DoubleType": sql_double, "StringType": sql_text}[type(f.dataType).__name__](f.name) for f in LINE.fields)


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_LINE_SIZE}) AS BIGINT) AS bytes, CAST(max({_LINE_SIZE}) AS INTEGER) AS most FROM lineitem GROUP BY 1, 2")
def lineitem_wire_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded sizes without encoding."""
    size = wire_size(of(LINE), LINE)
    rows = spread(table(spark, sf_dir, "lineitem").select(*LINE.fieldNames())).select("l_returnflag", "l_linestatus", size.alias("size"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"), F.max("size").cast("int").alias("most"))


@query("SELECT o_orderkey, nullif(o_custkey % 5, 0) AS custkey, nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, '') AS priority FROM orders")
def orders_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values behind pointers: a pointer to zero reads as null."""
    schema = T.StructType([member("o_orderkey", "int64", 1), member("custkey", "int64", 2, pointer=True), member("priority", "string", 3, pointer=True)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("custkey"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("priority"))
    return reread(encoded(rows, schema), schema).select("record.*")


@query(
    f"""SELECT vec_id, len(embedding) AS width, CAST(1 + {sql_int('vec_id')} + 1 + {sql_size('len(embedding)')} + 4 * len(embedding) AS INTEGER) AS bytes,
    CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings"""
)
def embeddings_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed arrays of floats."""
    schema = T.StructType([member("vec_id", "int64", 1), member("embedding", "array<float>", 2)])
    rows = encoded(table(spark, sf_dir, "embeddings"), schema).withColumn("bytes", F.octet_length("payload"))
    back = reread(rows, schema).select("record.*", "bytes")
    item = lambda i: F.element_at("embedding", i).cast("double")
    return back.select("vec_id", F.size("embedding").cast("long").alias("width"), "bytes", item(1).alias("first"), item(-1).alias("last"))


@query("SELECT p_partkey, p_size FROM part")
def part_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that knows two of the writer's four fields."""
    writer = T.StructType([member("p_partkey", "int64", 1), member("p_name", "string", 2), member("p_size", "int32", 3), member("p_retailprice", "float64", 4)])
    reader = T.StructType([writer["p_partkey"], writer["p_size"]])
    return reread(encoded(table(spark, sf_dir, "part"), writer), reader).select("record.*")


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS note FROM customer")
def customer_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a 32-bit field, read with a wider, renamed one and one that the writer lacks."""
    writer = T.StructType([member("c_custkey", "int64", 1), member("c_nationkey", "int32", 2)])
    reader = T.StructType([member("c_custkey", "int64", 1), member("nation", "int64", 2), member("note", "string", 3)])
    back = reread(encoded(table(spark, sf_dir, "customer"), writer), writer)
    return back.select(read_as(F.col("record"), writer, reader).alias("r")).select("r.*")


def _union(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, T.StructType]:
    item = union({"document": (128, DOCUMENT), "page": (129, PAGE)})
    wrapped = T.StructType([T.StructField("item", item, True, {"field_number": 1})])
    docs = table(spark, sf_dir, "documents").select(F.struct(of(DOCUMENT).alias("document"), F.lit(None).cast(PAGE).alias("page")).alias("item"))
    pages = table(spark, sf_dir, "pages").select(F.struct(F.lit(None).cast(DOCUMENT).alias("document"), of(PAGE).alias("page")).alias("item"))
    return docs.unionByName(pages).select(to_wire(F.struct("item"), wrapped, UNLIMITED).alias("payload")), wrapped


@query("SELECT 'document' AS kind, doc_id AS id, CAST(length(text) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'page', page_id, CAST(length(url) AS BIGINT) FROM pages")
def union_docs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record types in one column, told apart by type id."""
    rows, schema = _union(spark, sf_dir)
    r = F.col("record.item")
    back = reread(rows, schema)
    chars = F.coalesce(F.char_length(r["document"]["text"]), F.char_length(r["page"]["url"])).cast("long")
    return back.select(F.when(r["document"].isNotNull(), "document").otherwise("page").alias("kind"), F.coalesce(r["document"]["doc_id"], r["page"]["page_id"]).alias("id"), chars.alias("chars"))


@query("SELECT 128 AS type_id, 'user' AS type_class, count(*) AS n FROM documents UNION ALL SELECT 129, 'user', count(*) FROM pages")
def union_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type id, which is read without decoding the rest."""
    rows, _ = _union(spark, sf_dir)
    kind = wire_type_id(F.substring("payload", 2, 10)).cast("int")
    counts = rows.groupBy(kind.alias("type_id")).agg(F.count("*").alias("n"))
    return counts.select("type_id", wire.type_id_class(F.col("type_id")).alias("type_class"), "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def events_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed runs of records by user in chunks, taken apart, decoded and counted."""
    rows = chunked(_events(spark, sf_dir), ["user_id", "event_id", "micros", "event_type", "value"], F.octet_length("event_type"))
    records = rows.select("user_id", "chunk", "event_id", to_wire(of(EVENT), EVENT, UNLIMITED).alias("payload"))
    runs = gather_frames(records, ["user_id", "chunk"], "payload", ["event_id"])
    frames = explode_frames(runs.select("frames"), "frames", limit=0)
    sound = F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.col("error")))
    back = reread(frames.select(sound.alias("payload")), EVENT)
    return back.groupBy(F.col("record.event_type").alias("event_type")).agg(F.count("*").alias("n"), F.sum("record.user_id").cast("long").alias("users"))


@query(f"SELECT event_id, '1401016B' || {sql_hex(sql_zigzag('k'))} || '00' AS hex FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def events_props_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects as maps in canonical bytes."""
    schema = T.StructType([member("props", "map<string,bigint>", 1)])
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("props"))
    return rows.select("event_id", F.hex(to_wire(of(schema), schema, UNLIMITED)).alias("hex"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, min(turn) AS first_turn FROM conversations GROUP BY 1")
def conversations_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a list of records, one for each chunk of a conversation."""
    turn = T.StructType([member("turn", "int64", 1), member("role", "string", 2), member("text", "string", 3)])
    schema = T.StructType([member("conv_id", "int64", 1), T.StructField("turns", T.ArrayType(turn), True, {"field_number": 2})])
    turns = chunked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], F.octet_length("text"))
    rows = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    back = reread(rows.select(to_wire(of(schema), schema, UNLIMITED).alias("payload")), schema).select("record.*")
    each = back.select("conv_id", F.explode("turns").alias("t"))
    return each.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.char_length("t.text")).cast("long").alias("chars"), F.min("t.turn").alias("first_turn"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def dedupe_by_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical bytes as a grouping key."""
    schema = T.StructType([member("o_orderstatus", "string", 1), member("o_orderpriority", "string", 2)])
    groups = encoded(table(spark, sf_dir, "orders"), schema).groupBy("payload").agg(F.count("*").alias("n"))
    return reread(groups, schema).select("record.*", "n")


_WORDS = r"regexp_replace(lower(regexp_replace(p_type || ' ' || p_brand, '[^A-Za-z0-9]+', ' ', 'g')), '^ | $', '', 'g')"


@query(f"SELECT p_partkey, replace({_WORDS}, ' ', '_') AS snake, replace({_WORDS}, ' ', '-') AS kebab, upper(replace({_WORDS}, ' ', '_')) AS upper_snake FROM part")
def part_name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in several spellings."""
    name = F.concat_ws(" ", F.upper("p_type"), F.upper("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    c = F.col("name")
    return rows.select("p_partkey", values.snake_case(c).alias("snake"), values.kebab_case(c).alias("kebab"), values.upper_snake_case(c).alias("upper_snake"))


ACTIONS = {0: "click", 1: "error", 2: "purchase", 3: "signup", 4: "view"}


@query("SELECT event_id, event_type AS name, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS seconds, CAST((epoch_us(ts) % 1000000) * 1000 AS INTEGER) AS nanos FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view')")
def events_enum_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enums by number and time stamps as nested records."""
    clock = T.StructType([member("seconds", "int64", 1), member("nanos", "int32", 2)])
    schema = T.StructType([member("event_id", "int64", 1), member("action", "int32", 2, "enum"), T.StructField("at", clock, True, {"field_number": 3})])
    rows = table(spark, sf_dir, "events").select("event_id", values.enum_number(F.col("event_type"), ACTIONS).alias("action"), values.timestamp_parts(F.col("ts").cast("timestamp")).alias("at"))
    back = reread(encoded(rows.filter("action IS NOT NULL"), schema), schema).select("record.*")
    return back.select("event_id", values.enum_name(F.col("action"), ACTIONS).alias("name"), "at.seconds", "at.nanos")


@query("SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, CAST(list_max(embedding) AS DOUBLE) AS most, CAST(list_min(embedding) AS DOUBLE) AS least FROM embeddings")
def embeddings_raw_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of floats without a count."""
    raw = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", values.packed_floats(F.col("embedding")).alias("payload"))
    schema = T.StructType([member("values", "array<float>", 1)])
    # with a tag, a count and an end the run is a record
    counted = raw.select("vec_id", F.octet_length("payload").alias("bytes"), F.concat(wire.raw(wire.compact_tag(1, 2)), wire.uvarint(F.octet_length("payload") / 4), F.col("payload"), wire.raw(b"\0")).alias("payload"))
    back = reread(counted, schema)
    return back.select("vec_id", "bytes", F.array_max("record.values").cast("double").alias("most"), F.array_min("record.values").cast("double").alias("least"))


@query(
    """SELECT CASE l_orderkey % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'unexpected_eof' WHEN 2 THEN 'trailing_bytes' WHEN 3 THEN 'unknown_field'
    WHEN 4 THEN 'wire_type_mismatch' WHEN 5 THEN 'overflow' WHEN 6 THEN 'varint_too_long' WHEN 7 THEN 'varint_overflow' ELSE 'invalid_utf8' END AS error, count(*) AS rows FROM lineitem GROUP BY 1"""
)
def malformed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads damaged in eight ways, by the fault that strict decoding finds."""
    rows = encoded(table(spark, sf_dir, "lineitem"), LINE, "l_orderkey")
    p, way = F.col("payload"), F.col("l_orderkey") % 9
    cut = F.expr("substring(payload, 1, octet_length(payload) - 1 - CAST(l_orderkey % 11 AS INT))")
    number, text = wire.compact_tag(4, 4), wire.compact_tag(9, 2)
    ahead = {3: b"\xe0\x01", 4: wire.compact_tag(1, 0) + b"\x02", 5: number + b"\xff\xff\xff\xff\xff\x01", 6: number + b"\xff" * 10, 7: number + b"\xff" * 9 + b"\x02", 8: text + b"\x01\xff"}
    damaged = F.when(way == 0, p).when(way == 1, cut).when(way == 2, F.concat(p, wire.raw(b"\x00")))
    for k, data in ahead.items():
        damaged = damaged.when(way == k, F.concat(wire.raw(data), p))
    return conformance(decoded(rows.select(damaged.alias("payload")), "payload", LINE, STRICT))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_stream_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of wire records counted by hour and type."""
    from fathomwire.streaming.windows import drained, windowed_counts

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    root, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(root)
    rows = stream.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "user_id", "event_type", "value")
    counts = windowed_counts(encoded(rows, EVENT), "payload", EVENT, "micros", "event_type", "1 hour", "1 day", UNLIMITED, "FAILFAST")
    return drained(counts, f"{shared_folder(spark)}/fathomwire-streams", ["window_start", "event_type"])
