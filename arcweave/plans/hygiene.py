"""Queries of the general data problems (rejects, skewed keys, orphans, small files) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.common import scratch_path
from arcweave.operators.archive import adjacency_records, packed_archive, surplus_copies, write_consolidated
from arcweave.operators.key_chunks import per_key
from arcweave.operators.orphans import orphan_references
from arcweave.operators.structural_parse import rejects, relation_rows, relation_spec, split_records

RELATIONS = {"relation_acct_item": ("node_acct", "node_item"), "relation_item_site": ("node_item", "node_site")}
NODES = ("node_acct", "node_item", "node_site")
CHUNK_ROWS = 100  # p4_key_chunks


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return split_records(_table(spark, sf, "raw_relation"), "line", ["line_id", "file_name"], relation_spec("acct", "item"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(_records(spark, sf), ["line_id"]).select("line_id", "reason")


def p2_relation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return relation_rows(_records(spark, sf), ["line_id"])


def _key_runs(spark: SparkSession, sf: str, chunk_rows: int | None = None) -> DataFrame:
    rows = _table(spark, sf, "relation_acct_item").filter(F.col("from_key").isNotNull())
    return per_key(rows, ["load_no", "from_key"], "ts", ["edge_id"], chunk_rows)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    counted = _key_runs(spark, sf).select("load_no", "from_key", "n_rows").alias("r")
    noted = _table(spark, sf, "idx_arr").select("load_no", "from_key", "length").alias("i")
    same = F.col("r.load_no").eqNullSafe(F.col("i.load_no")) & (F.col("r.from_key") == F.col("i.from_key"))
    both = counted.join(noted, same, "full_outer")
    differs = F.coalesce("n_rows", F.lit(0)) != F.coalesce("length", F.lit(0))
    return both.filter(differs).select(F.coalesce("r.load_no", "i.load_no").alias("load_no"), F.coalesce("r.from_key", "i.from_key").alias("from_key")).distinct()


def p4_key_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _key_runs(spark, sf).drop("n_chunks")


def p4_key_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a stated size, so that their number can be checked; the other queries size them by the number of rows."""
    return _key_runs(spark, sf, CHUNK_ROWS)


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs = None
    for rel, ends in RELATIONS.items():
        for side, node in zip(("from", "to"), ends):
            one = _table(spark, sf, rel).select(F.lit(rel).alias("rel"), "edge_id", F.lit(side).alias("side"), F.lit(node).alias("node_table"), F.col(f"{side}_key").alias("node_key"), "loaded_at")
            refs = one if refs is None else refs.unionByName(one)
    parents = None
    for node in NODES:
        one = _table(spark, sf, node).select(F.lit(node).alias("node_table"), "node_key", "loaded_at", "deleted_at")
        parents = one if parents is None else parents.unionByName(one)
    return orphan_references(refs, ["node_table", "node_key"], "loaded_at", parents, ["node_table", "node_key"], "loaded_at", "deleted_at", carry=["rel", "edge_id", "side", "loaded_at"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("rel", "edge_id", "side", "state", F.date_format("loaded_at", "yyyy-MM").alias("load_month")).distinct()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format("loaded_at", "yyyy-MM").alias("load_month")
    return _orphans(spark, sf).groupBy("rel", "side", month, "state").agg(F.count(F.lit(1)).alias("n_refs"))


def _load_refs(spark: SparkSession, sf: str, match: str) -> DataFrame:
    """Rows of relation_acct_item as references (load_no, from_key) to idx_arr, in which either may be null."""
    refs, noted = _table(spark, sf, "relation_acct_item"), _table(spark, sf, "idx_arr")
    month = F.date_format("loaded_at", "yyyy-MM").alias("load_month")
    key = ["load_no", "from_key"]
    found = orphan_references(refs, key, None, noted, key, None, None, carry=["load_no", "from_key", "loaded_at"], match=match)
    return found.groupBy("load_no", "from_key", month, "state").agg(F.count(F.lit(1)).alias("n_refs"))


def p5_load_refs_simple(spark: SparkSession, sf: str) -> DataFrame:
    return _load_refs(spark, sf, "simple")


def p5_load_refs_partial(spark: SparkSession, sf: str) -> DataFrame:
    return _load_refs(spark, sf, "partial")


def p5_load_refs_full(spark: SparkSession, sf: str) -> DataFrame:
    return _load_refs(spark, sf, "full")


def _end_refs(spark: SparkSession, sf: str, match: str) -> DataFrame:
    """Rows of relation_item_site as references (from_key, to_key) to the rows of the same relation that were loaded up to
    the day before: pairs of nodes that no earlier load knows. Null ends are part of the key."""
    rows = _table(spark, sf, "relation_item_site")
    day = F.date_trunc("DAY", "loaded_at").cast("timestamp_ntz")
    refs = rows.select("edge_id", "from_key", "to_key", day.alias("day"), F.date_format("loaded_at", "yyyy-MM").alias("load_month"))
    known = rows.select("from_key", "to_key", (day + F.expr("INTERVAL 1 DAY")).alias("from_day"), F.lit(None).cast("timestamp_ntz").alias("gone"))
    key = ["from_key", "to_key"]
    found = orphan_references(refs, key, "day", known, key, "from_day", "gone", carry=["edge_id", "load_month"], match=match)
    return found.distinct()


def p5_new_pairs_partial(spark: SparkSession, sf: str) -> DataFrame:
    return _end_refs(spark, sf, "partial")


def p5_new_pairs_full(spark: SparkSession, sf: str) -> DataFrame:
    return _end_refs(spark, sf, "full")


def _archived_records(spark: SparkSession, sf: str) -> DataFrame:
    return adjacency_records(packed_archive(_table(spark, sf, "chunk_file")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return surplus_copies(_archived_records(spark, sf))


def p6_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """The records as they stand in the few large files that take the place of the small ones."""
    return write_consolidated(_archived_records(spark, sf), scratch_path(spark, "consolidated"))


def p6_archive_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file as it comes back out of the archive."""
    files = packed_archive(_table(spark, sf, "chunk_file")).files()
    return files.select("file_id", "path", F.md5("body").alias("body_md5"), F.octet_length("body").cast("long").alias("n_bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p2_found, p2_relation_rows, p4_found, p4_key_runs, p4_key_chunks, p5_found, p5_report, p5_load_refs_simple, p5_load_refs_partial, p5_load_refs_full, p5_new_pairs_partial, p5_new_pairs_full, p6_found, p6_consolidated, p6_archive_files)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    # a field: quoted, or anything without quote and comma
    field = '("([^"]|"")*"|[^",][^",]*|)'
    bare = "regexp_replace(line, '\\r$', '')"
    shape = f"'(?s){field}(,{field})*'"
    fields = f"regexp_extract_all(',' || {bare}, '(?s),(\"(?:[^\"]|\"\")*\"|[^\",]*)', 1)"
    value = lambda i: f"CASE WHEN f[{i}] LIKE '\"%' THEN replace(substr(f[{i}], 2, length(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END"
    ts = "trim(ts0, ' ')"
    parsed = (
        f"SELECT line_id, well, f, CASE WHEN NOT well THEN 'quoting' WHEN len(f) <> 6 THEN 'columns' WHEN NOT regexp_full_match(k1, '[A-Za-z0-9]{{8}}acct') THEN 'from_key'"
        f" WHEN NOT regexp_full_match(k2, '[A-Za-z0-9]{{8}}item') THEN 'to_key' WHEN NOT regexp_full_match({ts}, '[+-]?[0-9]+') OR try_cast({ts} AS INTEGER) IS NULL THEN 'ts' END AS reason, k1, k2, {ts} AS ts, {value(4)} AS a2, {value(5)} AS a3, f[5] AS r3, {value(6)} AS a4, f[6] AS r4"
        f" FROM (SELECT *, {value(1)} AS k1, {value(2)} AS k2, {value(3)} AS ts0 FROM (SELECT line_id, regexp_full_match({bare}, {shape}) AS well, {fields} AS f FROM raw_relation))"
    )
    runs = (
        "SELECT load_no, from_key, count(*) AS n_rows, min(ts) AS first_value, max(ts) AS last_value, max(step) AS largest_step CHUNKS"
        " FROM (SELECT *, ts::BIGINT - lag(ts) OVER (PARTITION BY load_no, from_key ORDER BY ts NULLS FIRST) AS step FROM relation_acct_item WHERE from_key IS NOT NULL) GROUP BY load_no, from_key"
    )
    refs = " UNION ALL ".join(f"SELECT '{rel}' AS rel, edge_id, '{side}' AS side, '{node}' AS node_table, {side}_key AS node_key, loaded_at AS seen_at FROM {rel} WHERE {side}_key IS NOT NULL" for rel, ends in RELATIONS.items() for side, node in zip(("from", "to"), ends))
    nodes = " UNION ALL ".join(f"SELECT '{n}' AS node_table, node_key, loaded_at, deleted_at FROM {n}" for n in NODES)
    orphans = (
        f"WITH r AS ({refs}), p AS ({nodes}), g AS (SELECT node_table, node_key, min(loaded_at) AS born FROM p GROUP BY ALL)"
        " SELECT rel, edge_id, side, strftime(seen_at, '%Y-%m') AS load_month, CASE WHEN g.node_key IS NULL THEN 'missing' WHEN born > seen_at THEN 'late' ELSE 'deleted' END AS state"
        " FROM r LEFT JOIN g USING (node_table, node_key) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.node_table = r.node_table AND p.node_key = r.node_key AND p.loaded_at <= r.seen_at AND (p.deleted_at IS NULL OR p.deleted_at > r.seen_at))"
    )
    # composite keys: which references a match rule checks, and when a parent row answers them
    both, any_ = "a IS NOT NULL AND b IS NOT NULL", "(a IS NOT NULL OR b IS NOT NULL)"
    same = "(r.a IS NULL OR p.a = r.a) AND (r.b IS NULL OR p.b = r.b)"
    load_refs = lambda checked, match: (
        "WITH r AS (SELECT DISTINCT load_no AS a, from_key AS b FROM relation_acct_item), p AS (SELECT load_no AS a, from_key AS b FROM idx_arr),"
        f" o AS (SELECT a, b FROM r WHERE {checked} AND NOT ({match})) SELECT load_no, from_key, strftime(loaded_at, '%Y-%m') AS load_month, 'missing' AS state, count(*) AS n_refs"
        " FROM relation_acct_item JOIN o ON load_no IS NOT DISTINCT FROM a AND from_key IS NOT DISTINCT FROM b GROUP BY ALL"
    )
    exists = f"EXISTS (SELECT 1 FROM p WHERE {same})"
    pairs = lambda partial: (
        "WITH r AS (SELECT edge_id, from_key AS a, to_key AS b, date_trunc('day', loaded_at) AS d, strftime(loaded_at, '%Y-%m') AS load_month FROM relation_item_site),"
        " first_b AS (SELECT a, b, min(d) AS d FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),"
        " first_a AS (SELECT a, min(d) AS d FROM r WHERE a IS NOT NULL GROUP BY ALL), first_to AS (SELECT b, min(d) AS d FROM r WHERE b IS NOT NULL GROUP BY ALL)"
        " SELECT DISTINCT edge_id, load_month, 'late' AS state FROM r JOIN first_b f USING (a, b) WHERE f.d >= r.d"
        + (
            " UNION SELECT edge_id, load_month, 'late' FROM r JOIN first_a f USING (a) WHERE r.b IS NULL AND f.d >= r.d UNION SELECT edge_id, load_month, 'late' FROM r JOIN first_to f USING (b) WHERE r.a IS NULL AND f.d >= r.d"
            if partial
            else " UNION SELECT edge_id, load_month, 'missing' FROM r WHERE (a IS NULL) <> (b IS NULL)"
        )
    )
    num = " *([+-]?[0-9]+) *"
    record = ",".join([num] * 4)
    lines = "SELECT file_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT file_id, regexp_split_to_array(body, '\\r\\n|\\r|\\n') AS l FROM chunk_file)"
    part = lambda i, kind: f"try_cast(regexp_extract(line, '^{record}$', {i}) AS {kind})"
    records = (
        f"SELECT file_id, line_no, {part(1, 'BIGINT')} AS pos, {part(2, 'BIGINT')} AS arr_index, {part(3, 'BIGINT')} AS arr_value, {part(4, 'INTEGER')} AS ts FROM ({lines}) WHERE regexp_full_match(line, '{record}')"
    )
    whole = "pos IS NOT NULL AND arr_index IS NOT NULL AND arr_value IS NOT NULL AND ts IS NOT NULL"
    return {
        "p2_found": f"SELECT line_id, reason FROM ({parsed}) WHERE reason IS NOT NULL",
        "p2_relation_rows": f"SELECT line_id, k1 AS from_key, k2 AS to_key, ts::INTEGER AS ts, try_cast(a2 AS DOUBLE) AS attr2, CASE WHEN r3 = '' THEN NULL ELSE lower(a3) IN ('yes', 'true', 't', '1') END AS attr3, CASE WHEN r4 = '' THEN NULL ELSE a4 END AS attr4 FROM ({parsed}) WHERE reason IS NULL",
        "p4_found": "WITH r AS (SELECT load_no, from_key, count(*) AS n FROM relation_acct_item WHERE from_key IS NOT NULL GROUP BY ALL)"
        " SELECT DISTINCT load_no, from_key FROM r FULL JOIN idx_arr USING (load_no, from_key) WHERE coalesce(n, 0) <> coalesce(length, 0)",
        "p4_key_runs": runs.replace("CHUNKS", ""),
        "p4_key_chunks": runs.replace("CHUNKS", f", ceil(count(*) / {CHUNK_ROWS})::BIGINT AS n_chunks"),
        "p5_found": f"SELECT DISTINCT rel, edge_id, side, state, load_month FROM ({orphans})",
        "p5_report": f"SELECT rel, side, load_month, state, count(*) AS n_refs FROM ({orphans}) GROUP BY ALL",
        "p5_load_refs_simple": load_refs(both, exists),
        "p5_load_refs_partial": load_refs(any_, exists),
        "p5_load_refs_full": load_refs(any_, f"{both} AND {exists}"),
        "p5_new_pairs_partial": pairs(True),
        "p5_new_pairs_full": pairs(False),
        "p6_found": f"WITH r AS (SELECT DISTINCT file_id, pos FROM ({records}) WHERE {whole}) SELECT file_id, pos FROM r QUALIFY file_id > min(file_id) OVER (PARTITION BY pos)",
        "p6_consolidated": f"SELECT pos, arr_index, arr_value, ts FROM ({records}) WHERE {whole} QUALIFY row_number() OVER (PARTITION BY pos ORDER BY file_id, line_no) = 1",
        "p6_archive_files": "SELECT file_id, file_name AS path, md5(body) AS body_md5, strlen(body)::BIGINT AS n_bytes FROM chunk_file",
    }
