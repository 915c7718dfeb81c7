"""Queries over tables with rows that the small tables lack, against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fathomwire.operators.frames import chunked, explode_frames, gather_frames
from fathomwire.plans.queries import oracle_sql, queries


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=str)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall(), key=str)


LARGE = "x" * (11 << 20)  # above the default limit of a string


def test_union_of_large_documents(spark, tmp_path):
    docs = pa.table({"doc_id": [1, 2], "text": ["a", LARGE], "lang": ["en", "en"]})
    same_as_sql(spark, tmp_path, "union_docs_pages", {"documents": docs, "pages": pa.table({"page_id": [3], "url": ["http://a.b/"]})})


def test_conversation_of_large_turns(spark, tmp_path):
    turns = pa.table({"conv_id": [1, 1, 2], "turn": [0, 1, 0], "role": ["user", "assistant", "user"], "text": ["a", LARGE, "b"]})
    same_as_sql(spark, tmp_path, "conversations_nested", {"conversations": turns})


def test_chunks_of_one_large_key(spark):
    rows = spark.range(20_000).select((F.col("id") % 50 == 0).cast("int").alias("k"), F.col("id").alias("i"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))
    runs = gather_frames(chunked(rows, ["k", "i"], F.octet_length("payload"), most_rows=100), ["k", "chunk"], "payload", ["i"])
    back = explode_frames(runs, "frames").collect()
    own = {}
    for r in back:
        own.setdefault((r.k, r.chunk), []).append((r.ordinal, int(bytes(r.payload))))
    assert max(map(len, own.values())) <= 100
    for k in (0, 1):  # chunks in their order hold the key's rows in order
        assert [i for key in sorted(x for x in own if x[0] == k) for _, i in sorted(own[key])] == [i for i in range(20_000) if (i % 50 == 0) == k]
    wide = chunked(rows.filter("i < 1000"), ["k", "i"], F.lit(1000), most_bytes=10_000).groupBy("chunk").count().collect()
    assert max(r["count"] for r in wide) <= 11


def test_events_and_turns_of_one_large_key(spark, tmp_path, monkeypatch):
    n, sizes = 30_000, []
    clock = pa.array(range(n), pa.timestamp("us"))
    events = pa.table({"event_id": range(n), "ts": clock, "user_id": [i % 3 and 7 for i in range(n)], "event_type": ["view"] * n, "value": [1.5] * n})
    monkeypatch.setattr("fathomwire.plans.queries.gather_frames", lambda df, keys, *rest: (sizes.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0]), gather_frames(df, keys, *rest))[1])
    same_as_sql(spark, tmp_path, "events_frames", {"events": events})
    assert max(sizes) <= 4096
    turns = pa.table({"conv_id": [i % 3 and 7 for i in range(n)], "turn": range(n), "role": ["user"] * n, "text": ["ab"] * n})
    same_as_sql(spark, tmp_path, "conversations_nested", {"conversations": turns})


def test_one_row_group_is_worked_on_by_all_cores(spark, tmp_path):
    n = 2000
    lines = {"l_orderkey": range(n), "l_linenumber": [1] * n, "l_partkey": range(n), "l_quantity": [1.5] * n, "l_discount": [0.5] * n, "l_tax": [0.25] * n}
    kinds = {"l_orderkey": pa.int64(), "l_linenumber": pa.int32(), "l_partkey": pa.int64()}
    same_as_sql(spark, tmp_path, "lineitem_fixed_arrays", {"lineitem": pa.table({k: pa.array(v, kinds.get(k, pa.float64())) for k, v in lines.items()})})
    orders = pa.table({"o_orderkey": range(n), "o_custkey": range(n), "o_orderstatus": ["F"] * n, "o_totalprice": [2.5] * n, "o_orderpriority": ["1-URGENT"] * n})
    same_as_sql(spark, tmp_path, "orders_maps_roundtrip", {"orders": orders})
    for name in ("lineitem_fixed_arrays", "orders_maps_roundtrip"):
        tasks = queries()[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().count()
        assert tasks >= spark.sparkContext.defaultParallelism
