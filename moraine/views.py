"""The derived views of FIXTURES.md as SQL for both engines.

A text names tables and views freely; `render` puts the views it needs in front as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "kv_log": "select concat('user:', lpad(cast(user_id as {S}), 6, '0'), ':', event_type) as k, cast(value as {S}) as v, event_id + 1 as ts, case when cast({J} as int) % 10 = 0 then 3 else 0 end as meta from events",
    "kv_runs": "select k, v, ts, meta, cast(floor((ts - 1) * 4.0 / (select count(*) from kv_log)) as int) as run_id from kv_log",
    "sst_files": "select run_id * 100 + bucket as file_id, 3 - run_id as level, min(k) as smallest_key, max(k) as largest_key, cast(sum(sz) as bigint) as size, count(*) as key_count, cast(sum(case when meta % 2 = 1 then 1 else 0 end) as bigint) as tombstones, min(ts) as min_ts, max(ts) as max_ts from (select k, ts, meta, run_id, cast(floor(cast(substr(k, 6, 6) as int) / 30.0) as int) as bucket, 17 + length(k) + length(v) as sz from kv_runs) x group by run_id, bucket",
    "manifest_changes": "select file_id as seq, 'add_table' as type, file_id, level from sst_files union all select 100000 + file_id, 'delete_table', file_id, level from sst_files where level = 3",
    "live_files": "select a.file_id, a.level from (select file_id, level from manifest_changes where type = 'add_table') a left join (select file_id as gone from manifest_changes where type = 'delete_table') d on a.file_id = d.gone where d.gone is null",
    "latest": "select k, max_by(v, ts) as v, max(ts) as ts, max_by(meta, ts) as meta from kv_log group by k",
    "sizes": "select doc_id, text, coalesce(cast({OL} as bigint), 0) as n from documents",
    "blobs": "select doc_id, text, n, n >= 1024 as is_external, cast(floor(end_off / 1048576.0) as int) as file_id, end_off - (n + 12) as log_offset from (select doc_id, text, n, cast(sum(n + 12) over (order by doc_id rows between unbounded preceding and current row) as bigint) as end_off from sizes) b",
    "txn_ops": "select cast(floor(event_id / 8.0) as bigint) as txn_id, event_id % 8 as op_seq, case when event_id % 8 < 5 then 'r' else 'w' end as op, l.k, l.v, cast(floor(event_id / 8.0) as bigint) * 10 + 1 as read_ts, cast(floor(event_id / 8.0) as bigint) * 10 + 25 as commit_ts from events e join kv_log l on l.ts = e.event_id + 1",
    "txns": "select txn_id, min(read_ts) as read_ts, min(commit_ts) as commit_ts from txn_ops group by txn_id",
    "level_stats": "select level, count(*) as n_files, cast(sum(size) as bigint) as total_size, avg(size) as avg_size, max(size) as max_size, min(size) as min_size, cast(sum(key_count) as bigint) as n_keys, round(sum(tombstones) * 1.0e0 / sum(key_count), 6) as tombstone_ratio, avg(max_ts) as mean_age_ts from sst_files group by level",
    "budgets": "select level, cast(40000 * power(10.0e0, level) as bigint) as budget from (select distinct level from sst_files) l",
    "blocks": "select file_id, block_no, min(k) as first_key, max(k) as last_key, min(ts) as min_ts, max(ts) as max_ts, count(*) as n from (select k, ts, f.file_id, cast(floor(coalesce(sum(sz) over (partition by f.file_id order by k, ts rows between unbounded preceding and 1 preceding), 0) / 4096.0) as int) as block_no from (select k, ts, run_id * 100 + cast(floor(cast(substr(k, 6, 6) as int) / 30.0) as int) as file_id, 17 + length(k) + length(v) as sz from kv_runs) f) g group by file_id, block_no",
    "error_log": "select event_id, ts as at_ts, concat('E', cast(cast({J} as int) % 6 as {S})) as err from events where event_type = 'error'",
    "items": "select l_orderkey, l_linenumber, l_extendedprice, l_discount from lineitem",
    "bench_runs": "select cast(ts as date) as run_day, count(*) as ops from events group by cast(ts as date)",
}

SPARK = {"S": "string", "J": "get_json_object(props, '$.k')", "OL": "octet_length(text)", "LEN8": "octet_length(v)"}
DUCKDB = {"S": "varchar", "J": "(props->>'$.k')", "OL": "octet_length(encode(text))", "LEN8": "octet_length(encode(v))"}


def needed(body: str, seen: list[str] | None = None) -> list[str]:
    """The views that a text uses, each after those that it uses itself."""
    seen = [] if seen is None else seen
    for name, sql in VIEWS.items():
        if name not in seen and re.search(rf"\b{name}\b", body):
            needed(sql, seen)
            if name not in seen:
                seen.append(name)
    return seen


def fill(text: str, marks: dict[str, str]) -> str:
    for name, value in marks.items():
        text = text.replace("{" + name + "}", value)
    return text


def duckdb_sql(body: str) -> str:
    """The text with its views, for DuckDB with the tables registered as views."""
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed(body))
    return fill(f"with {ctes} {body}" if ctes else body, DUCKDB)


def spark_sql(body: str, sf_dir: str) -> str:
    """The text with its views, for Spark over the Parquet tables of a folder."""
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed(body))
    text = fill(f"with {ctes} {body}" if ctes else body, SPARK)
    return re.sub(r"\b(from|join) (" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql(f"select * from {name}", sf_dir))
