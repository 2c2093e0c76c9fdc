"""Queries of the graph operators over the given node and relation tables, with SQL twins.

Node types and ordinals: acct 0, item 1, site 2. Every query reads whole tables. Reads take as their batch of ids a
whole table: the site nodes (neighbourhoods), the noted keys of idx_arr (attributes) or the rows of relation_item_site
(pairs). The reads ``*_all`` take the nodes of all three types, with attributes of every type, or the rows of both relations.

``stored_*`` save the graph, open it again and look up every node (or edge) whose id is divisible by 50 in all of it.
``file_*`` write node tables and raw relation lines as delimited files and load these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.common import scratch_path, shuffle_width
from arcweave.functions.ids import bucket, node_id, node_id_sql, type_ordinal
from arcweave.functions.types import TRUE_WORDS, bool_column
from arcweave.operators import reads, stats
from arcweave.operators.adjacency import both_directions, bucket_histogram, csr_index, degree, edges, last_wins
from arcweave.plans.graph import Graph
from arcweave.sources import delimited
from arcweave.sources.catalog import Catalog, NodeType, Relation

ORDINALS = {"acct": 0, "item": 1, "site": 2}
RELATIONS = {"relation_acct_item": ("acct", "item"), "relation_item_site": ("item", "site")}
DEGREES = (4, 4, 4)
FIRST = 4
ATTRIBUTES = ("attr1", "attr2", "attr3", "attr4")
EDGE_ATTRIBUTES = ("attr2", "attr3", "attr4")
EVERY = 50  # stored_*: ids divisible by it
SAMPLE = 10  # sample_freq_words: one line in so many
NODE_HEADER = "{0}({0}),attr1:int,attr2:float,attr3:bool,attr4:str"
RELATION_HEADER = "acct(acct),item(item),ts:int,attr2:float,attr3:bool,attr4:str"
TOKENS = (("attr1", "int"), ("attr2", "float"), ("attr3", "bool"), ("attr4", "str"))
CATALOG = Catalog.build(
    [NodeType(t, "key", TOKENS) for t in ORDINALS], [Relation(rel.removeprefix("relation_"), a, b, (("ts", "int"), *TOKENS[1:])) for rel, (a, b) in RELATIONS.items()], ORDINALS
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _directed(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for rel, (a, b) in RELATIONS.items():
        one = edges(_table(spark, sf, rel), rel, ORDINALS[a], "from_key", ORDINALS[b], "to_key", "ts")
        out = one if out is None else out.unionByName(one)
    return out


def _adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return both_directions(_directed(spark, sf))


def _nodes(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """One row a key: the one loaded last; of rows loaded at once the one with the larger attributes."""
    rows = _table(spark, sf, f"node_{kind}")
    at = F.struct("loaded_at", *ATTRIBUTES)
    return last_wins(rows.select("node_id", "node_key", *ATTRIBUTES, at.alias("_at")), "node_id", "_at").drop("_at")


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "node_site").select("node_id")


def _all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for kind in ORDINALS:
        one = _table(spark, sf, f"node_{kind}").select("node_id")
        out = one if out is None else out.unionByName(one)
    return out


def _words(spark: SparkSession, sf: str, one_in: int = 1) -> DataFrame:
    out = None
    for rel, (a, b) in RELATIONS.items():
        usable = _table(spark, sf, rel).filter("from_key IS NOT NULL AND to_key IS NOT NULL AND ts IS NOT NULL")
        if one_in > 1:
            usable = stats.sample_rows(usable, "edge_id", one_in)
        one = stats.type_words(usable, [("from_key", a), ("to_key", b)])
        out = one if out is None else out.unionByName(one)
    return out


def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for kind, ordinal in ORDINALS.items():
        ident = node_id(ordinal, F.col("node_key"))
        one = _table(spark, sf, f"node_{kind}").select(F.lit(kind).alias("node_type"), "node_key", ident.alias("node_id")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.select("*", type_ordinal(F.col("node_id")).alias("type_ord"), bucket(F.col("node_id")).alias("bucket"))


def node_attr(spark: SparkSession, sf: str) -> DataFrame:
    ids = _table(spark, sf, "idx_arr").select(node_id(0, F.col("from_key")).alias("node_id"))
    return reads.node_attributes(ids, _nodes(spark, sf, "acct"))


def node_attr_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf, "item")


def prune_str_cols(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "node_acct").select("node_id", *CATALOG.attribute_names("acct", numeric_only=True))


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return _adjacency(spark, sf)


def neighbor_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reads.neighbor_edges(_sites(spark, sf), _adjacency(spark, sf))


def neighbor_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return reads.neighbor_nodes(_sites(spark, sf), _adjacency(spark, sf))


def neighbor_attrs(spark: SparkSession, sf: str) -> DataFrame:
    items = _nodes(spark, sf, "item").select("node_id", "attr1", "attr2")
    return reads.neighbor_attributes(_sites(spark, sf), _adjacency(spark, sf), items).select("src_id", "dst_id", "attr1", "attr2")


def neighbor_edges_all(spark: SparkSession, sf: str) -> DataFrame:
    return reads.neighbor_edges(_all_nodes(spark, sf), _adjacency(spark, sf))


def neighbor_nodes_all(spark: SparkSession, sf: str) -> DataFrame:
    return reads.neighbor_nodes(_all_nodes(spark, sf), _adjacency(spark, sf))


def neighbor_attrs_all(spark: SparkSession, sf: str) -> DataFrame:
    far = None
    for kind in ORDINALS:
        one = _nodes(spark, sf, kind).select("node_id", "attr1", "attr2")
        far = one if far is None else far.unionByName(one)
    return reads.neighbor_attributes(_all_nodes(spark, sf), _adjacency(spark, sf), far).select("src_id", "dst_id", "attr1", "attr2")


def edge_attr(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _directed(spark, sf).filter(F.col("rel") == "relation_item_site").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return reads.edge_entries(pairs, _adjacency(spark, sf))


def edge_attr_all(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _directed(spark, sf).select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return reads.edge_entries(pairs, _adjacency(spark, sf))


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return degree(_adjacency(spark, sf))


def csr(spark: SparkSession, sf: str) -> DataFrame:
    return csr_index(_adjacency(spark, sf))


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return bucket_histogram(_adjacency(spark, sf))


def entry_total(spark: SparkSession, sf: str) -> DataFrame:
    return _adjacency(spark, sf).agg(F.count(F.lit(1)).alias("n_entries"))


def first_k_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reads.first_edges(_adjacency(spark, sf), FIRST)


def sample_first(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sample_first(_sites(spark, sf), _adjacency(spark, sf), FIRST)


def sample_first_all(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sample_first(_all_nodes(spark, sf), _adjacency(spark, sf), FIRST)


def khop_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return reads.expand(_sites(spark, sf), _adjacency(spark, sf), DEGREES)[0]


def khop_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reads.expand(_sites(spark, sf), _adjacency(spark, sf), DEGREES)[1]


def khop_nodes_all(spark: SparkSession, sf: str) -> DataFrame:
    return reads.expand(_all_nodes(spark, sf), _adjacency(spark, sf), DEGREES)[0]


def khop_edges_all(spark: SparkSession, sf: str) -> DataFrame:
    return reads.expand(_all_nodes(spark, sf), _adjacency(spark, sf), DEGREES)[1]


def freq_words(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_words(_words(spark, sf))


def sample_freq_words(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator: frequencies as a sample of the lines shows them."""
    return stats.top_words(_words(spark, sf, SAMPLE))


def heavy_hitters(spark: SparkSession, sf: str) -> DataFrame:
    return stats.heavy_hitters(_words(spark, sf))


def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.line_stats(_words(spark, sf))


def line_stats_plain(spark: SparkSession, sf: str) -> DataFrame:
    return stats.line_stats(_words(spark, sf), without_frequent=True)


def parse_bool(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.split("line", ",", -1)
    return _table(spark, sf, "raw_relation").select("line_id", bool_column(F.get(fields, F.lit(4))).alias("flag"))


def parse_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines split at every comma, without quoting: those of three fields at least with an integer in the third."""
    raw = _table(spark, sf, "raw_relation").select("line_id", "line", delimited.fields_of(F.col("line")).alias("f"))
    good = raw.filter(delimited.reject_reason(F.col("f")).isNull())
    return good.select("line_id", F.get("f", F.lit(0)).alias("from_key"), F.get("f", F.lit(1)).alias("to_key"), delimited.ts_of(F.col("f")).alias("ts"), delimited.line_bytes(F.col("line")).alias("n_bytes"))


# ---- a saved graph


def _graph(spark: SparkSession, sf: str) -> Graph:
    nodes = {t: _nodes(spark, sf, t).withColumnRenamed("node_key", "key") for t in ORDINALS}
    relations = {r.name: edges(_table(spark, sf, f"relation_{r.name}"), r.name, ORDINALS[r.from_type], "from_key", ORDINALS[r.to_type], "to_key", "ts", EDGE_ATTRIBUTES) for r in CATALOG.relations.values()}
    return Graph(spark, CATALOG, nodes, relations)


def _stored(spark: SparkSession, sf: str) -> Graph:
    path = scratch_path(spark, "graph")
    _graph(spark, sf).save(path)
    return Graph.open(spark, path)


def _divisible(spark: SparkSession, sf: str) -> DataFrame:
    return _all_nodes(spark, sf).filter(F.col("node_id") % EVERY == 0)


def _of_every_type(g: Graph, read: Callable[[str], DataFrame]) -> DataFrame:
    out = None
    for t in g.catalog.types:
        out = read(t) if out is None else out.unionByName(read(t))
    return out


def stored_node_attr(spark: SparkSession, sf: str) -> DataFrame:
    g, ids = _stored(spark, sf), _divisible(spark, sf)
    return _of_every_type(g, lambda t: g.node_attr_of(ids, t))


def stored_edge_attr(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of the rows of both relations whose edge_id is divisible by 50, asked for from their far end."""
    pairs = None
    for rel, (a, b) in RELATIONS.items():
        rows = edges(_table(spark, sf, rel).filter(F.col("edge_id") % EVERY == 0), rel, ORDINALS[a], "from_key", ORDINALS[b], "to_key", "ts")
        rows = rows.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
        pairs = rows if pairs is None else pairs.unionByName(rows)
    return _stored(spark, sf).edge_attr_of(pairs)


def stored_neighbor_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).neighbor_edges_of(_divisible(spark, sf))


def stored_neighbor_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).neighbor_nodes_of(_divisible(spark, sf))


def stored_neighbor_attrs(spark: SparkSession, sf: str) -> DataFrame:
    g, ids = _stored(spark, sf), _divisible(spark, sf)
    return _of_every_type(g, lambda t: g.neighbor_attr_of(ids, t)).select("src_id", "dst_id", "attr1", "attr2")


def stored_sample_first(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).sample_nodes_of(_divisible(spark, sf), FIRST)


def stored_khop_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).expand_from(_divisible(spark, sf), DEGREES)[0]


def stored_khop_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).expand_from(_divisible(spark, sf), DEGREES)[1]


def stored_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The edges with their attributes, as they come back from a saved graph."""
    return _of_relations(_stored(spark, sf))


def _of_relations(g: Graph) -> DataFrame:
    out = None
    for df in g.relations.values():
        out = df if out is None else out.unionByName(df)
    return out


# ---- files


def _files(spark: SparkSession, sf: str) -> str:
    """The node tables and the raw lines as a directory of delimited files, several for each table."""
    at = scratch_path(spark, "files")
    width = shuffle_width(spark)
    for t in ORDINALS:
        rows, order = _table(spark, sf, f"node_{t}"), ["loaded_at", *ATTRIBUTES]
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("node_key", *ATTRIBUTES)]
        delimited.write_lines(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).select(F.concat_ws(",", *fields)), NODE_HEADER.format(t), at, f"node_{t}")
    lines = _table(spark, sf, "raw_relation").filter("line IS NOT NULL").repartitionByRange(width, "line_id")
    delimited.write_lines(lines.select("line"), RELATION_HEADER, at, "relation_acct_item")
    return at


def _from_files(spark: SparkSession, sf: str) -> Graph:
    return Graph.from_files(spark, _files(spark, sf), strict=False)


def file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    g = _from_files(spark, sf)
    return _of_every_type(g, lambda t: g.nodes[t])


def file_node_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Without the string attributes, of the nodes whose id is divisible by 50."""
    g, ids = _from_files(spark, sf), _divisible(spark, sf)
    return _of_every_type(g, lambda t: g.node_attr_of(ids, t, numeric_only=True))


def file_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _of_relations(_from_files(spark, sf))


def file_rejects(spark: SparkSession, sf: str) -> DataFrame:
    at = _files(spark, sf)
    return delimited.rejects(spark, delimited.list_files(spark, at, "relation_")).select("reason", "line")


def file_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Files loaded, saved as a graph and opened again."""
    path = scratch_path(spark, "graph")
    _from_files(spark, sf).save(path)
    return Graph.open(spark, path).adjacency


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "node_id": node_ids, "node_attr": node_attr, "node_attr_dedup": node_attr_dedup, "prune_str_cols": prune_str_cols, "adjacency": adjacency,
        "neighbor_edges": neighbor_edges, "neighbor_nodes": neighbor_nodes, "neighbor_attrs": neighbor_attrs, "edge_attr": edge_attr, "degree": degrees,
        "csr_index": csr, "bucket_histogram": buckets, "entry_total": entry_total, "first_k_edges": first_k_edges, "sample_first": sample_first,
        "khop_nodes": khop_nodes, "khop_edges": khop_edges, "freq_words": freq_words, "heavy_hitters": heavy_hitters, "line_stats": line_stats,
        "line_stats_plain": line_stats_plain, "parse_bool": parse_bool, "parse_rows": parse_rows, "edge_attr_all": edge_attr_all,
        "neighbor_edges_all": neighbor_edges_all, "neighbor_nodes_all": neighbor_nodes_all, "neighbor_attrs_all": neighbor_attrs_all,
        "sample_first_all": sample_first_all, "khop_nodes_all": khop_nodes_all, "khop_edges_all": khop_edges_all,
    }
    later = (
        sample_freq_words, stored_node_attr, stored_edge_attr, stored_neighbor_edges, stored_neighbor_nodes, stored_neighbor_attrs, stored_sample_first, stored_khop_nodes,
        stored_khop_edges, stored_relations, file_nodes, file_node_numbers, file_edges, file_rejects, file_adjacency,
    )
    return named | {f.__name__: f for f in later}


def oracle_sql() -> dict[str, str]:
    usable = "from_key IS NOT NULL AND to_key IS NOT NULL AND ts IS NOT NULL"
    e = " UNION ALL ".join(f"SELECT '{rel}' AS rel, {node_id_sql(ORDINALS[a], 'from_key')} AS a, {node_id_sql(ORDINALS[b], 'to_key')} AS b, ts FROM {rel} WHERE {usable}" for rel, (a, b) in RELATIONS.items())
    adj = f"e AS ({e}), adj AS (SELECT a AS src_id, b AS dst_id, ts FROM e UNION ALL SELECT b, a, ts FROM e)"
    sites = "SELECT node_id FROM node_site"
    ranked = "r AS (SELECT src_id, dst_id, ts, row_number() OVER (PARTITION BY src_id ORDER BY ts, dst_id) AS place FROM adj)"
    hops = "n0 AS (SELECT DISTINCT node_id AS seed_id, node_id FROM node_site)"
    for i, d in enumerate(DEGREES, start=1):
        hops += f", e{i} AS (SELECT DISTINCT seed_id, src_id, dst_id, ts FROM n{i - 1} JOIN r ON node_id = src_id WHERE place <= {d}), n{i} AS (SELECT * FROM n{i - 1} UNION SELECT seed_id, dst_id FROM e{i})"
    every = " UNION ALL ".join(f"SELECT node_id FROM node_{t}" for t in ORDINALS)
    all_hops = hops.replace("FROM node_site", f"FROM ({every})")
    last = len(DEGREES)
    words = " UNION ALL ".join(f"SELECT '{t}' AS node_type, {side}_key AS key FROM {rel} WHERE {usable}" for rel, ends in RELATIONS.items() for side, t in zip(("from", "to"), ends))
    counts = f"c AS (SELECT node_type, key, count(*) AS cnt FROM ({words}) GROUP BY ALL), t AS (SELECT node_type, sum(cnt)::BIGINT AS n_entries FROM c GROUP BY ALL), top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node_type ORDER BY cnt DESC, key) <= {stats.TOP_KEEP})"
    heavy = f"h AS (SELECT top.*, n_entries FROM top JOIN t USING (node_type) WHERE cnt * {stats.TOP_SHARE} > n_entries)"
    newest = lambda kind: f"SELECT node_id, node_key, {', '.join(ATTRIBUTES)} FROM node_{kind} QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC, {', '.join(f'{x} DESC NULLS LAST' for x in ATTRIBUTES)}) = 1"
    truth = ", ".join(f"'{w}'" for w in TRUE_WORDS)
    newest_of_all = " UNION ALL ".join(f"SELECT node_id, node_key AS key, {', '.join(ATTRIBUTES)} FROM ({newest(t)})" for t in ORDINALS)
    from_file = newest_of_all.replace("attr3, attr4 FROM (", "coalesce(attr3, false) AS attr3, coalesce(attr4, '') AS attr4 FROM (")
    some = f"SELECT node_id FROM ({every}) WHERE node_id % {EVERY} = 0"
    some_hops = hops.replace("FROM node_site", f"FROM ({some})")
    some_pairs = " UNION ALL ".join(f"SELECT ({node_id_sql(ORDINALS[b], 'to_key')}, {node_id_sql(ORDINALS[a], 'from_key')}) FROM {rel} WHERE {usable} AND edge_id % {EVERY} = 0" for rel, (a, b) in RELATIONS.items())
    ts = "trim(f[3])"
    lines = "SELECT unnest(regexp_split_to_array(regexp_replace(line, '\r$', ''), '\r\n|\r|\n')) AS line FROM raw_relation WHERE line IS NOT NULL"
    lines = f"SELECT line, f, CASE WHEN len(f) < 3 THEN 'columns' WHEN NOT regexp_full_match({ts}, '[+-]?[0-9]+') OR try_cast({ts} AS INTEGER) IS NULL THEN 'ts' END AS reason FROM (SELECT line, string_split(line, ',') AS f FROM ({lines}))"
    file_edge = f"SELECT 'acct_item' AS rel, {node_id_sql(0, 'f[1]')} AS src_id, {node_id_sql(1, 'f[2]')} AS dst_id, try_cast({ts} AS INTEGER) AS ts, try_cast(f[4] AS DOUBLE) AS attr2, coalesce(lower(f[5]) IN ({truth}), false) AS attr3, f[6] AS attr4 FROM ({lines}) WHERE reason IS NULL"
    return {
        "stored_node_attr": f"SELECT * FROM ({newest_of_all}) WHERE node_id % {EVERY} = 0",
        "stored_edge_attr": f"WITH {adj} SELECT * FROM adj WHERE (src_id, dst_id) IN ({some_pairs})",
        "stored_neighbor_edges": f"WITH {adj} SELECT * FROM adj WHERE src_id IN ({some})",
        "stored_neighbor_nodes": f"WITH {adj} SELECT src_id, dst_id FROM adj WHERE src_id IN ({some})",
        "stored_neighbor_attrs": f"WITH {adj}, n AS ({newest_of_all}) SELECT src_id, dst_id, attr1, attr2 FROM adj JOIN n ON dst_id = node_id WHERE src_id IN ({some})",
        "stored_sample_first": f"WITH {adj}, {ranked} SELECT src_id, dst_id, ts FROM r WHERE place <= {FIRST} AND src_id IN ({some})",
        "stored_khop_nodes": f"WITH {adj}, {ranked}, {some_hops} SELECT * FROM n{last}",
        "stored_khop_edges": f"WITH {adj}, {ranked}, {some_hops} SELECT * FROM ({' UNION '.join(f'SELECT * FROM e{i}' for i in range(1, last + 1))})",
        "stored_relations": " UNION ALL ".join(f"SELECT '{rel.removeprefix('relation_')}' AS rel, {node_id_sql(ORDINALS[a], 'from_key')} AS src_id, {node_id_sql(ORDINALS[b], 'to_key')} AS dst_id, ts, {', '.join(EDGE_ATTRIBUTES)} FROM {rel} WHERE {usable}" for rel, (a, b) in RELATIONS.items()),
        "file_nodes": from_file,
        "file_node_numbers": f"SELECT node_id, attr1, attr2, attr3 FROM ({from_file}) WHERE node_id % {EVERY} = 0",
        "file_edges": file_edge,
        "file_rejects": f"SELECT reason, line FROM ({lines}) WHERE reason IS NOT NULL",
        "file_adjacency": f"WITH e AS ({file_edge}) SELECT src_id, dst_id, ts FROM e UNION ALL SELECT dst_id, src_id, ts FROM e",
        "node_id": " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS node_type, node_key, {node_id_sql(o, 'node_key')} AS node_id, {o} AS type_ord, ({node_id_sql(o, 'node_key')} & 63)::INTEGER AS bucket FROM node_{t}" for t, o in ORDINALS.items()),
        "node_attr": f"SELECT * FROM ({newest('acct')}) WHERE node_id IN (SELECT {node_id_sql(0, 'from_key')} FROM idx_arr)",
        "node_attr_dedup": newest("item"),
        "prune_str_cols": "SELECT node_id, attr1, attr2, attr3 FROM node_acct",
        "adjacency": f"WITH {adj} SELECT * FROM adj",
        "neighbor_edges": f"WITH {adj} SELECT * FROM adj WHERE src_id IN ({sites})",
        "neighbor_nodes": f"WITH {adj} SELECT src_id, dst_id FROM adj WHERE src_id IN ({sites})",
        "neighbor_attrs": f"WITH {adj}, n AS ({newest('item')}) SELECT src_id, dst_id, attr1, attr2 FROM adj JOIN n ON dst_id = node_id WHERE src_id IN ({sites})",
        "edge_attr": f"WITH {adj} SELECT * FROM adj WHERE (src_id, dst_id) IN (SELECT (b, a) FROM e WHERE rel = 'relation_item_site')",
        "neighbor_edges_all": f"WITH {adj} SELECT * FROM adj WHERE src_id IN ({every})",
        "neighbor_nodes_all": f"WITH {adj} SELECT src_id, dst_id FROM adj WHERE src_id IN ({every})",
        "neighbor_attrs_all": f"WITH {adj}, n AS ({' UNION ALL '.join(f'SELECT * FROM ({newest(t)})' for t in ORDINALS)}) SELECT src_id, dst_id, attr1, attr2 FROM adj JOIN n ON dst_id = node_id WHERE src_id IN ({every})",
        "sample_first_all": f"WITH {adj}, {ranked} SELECT src_id, dst_id, ts FROM r WHERE place <= {FIRST} AND src_id IN ({every})",
        "khop_nodes_all": f"WITH {adj}, {ranked}, {all_hops} SELECT * FROM n{last}",
        "khop_edges_all": f"WITH {adj}, {ranked}, {all_hops} SELECT * FROM ({' UNION '.join(f'SELECT * FROM e{i}' for i in range(1, last + 1))})",
        "edge_attr_all": f"WITH {adj} SELECT * FROM adj WHERE (src_id, dst_id) IN (SELECT (b, a) FROM e)",
        "degree": f"WITH {adj} SELECT src_id, count(*) AS length FROM adj GROUP BY ALL",
        "csr_index": f'WITH {adj}, d AS (SELECT src_id, count(*) AS length FROM adj GROUP BY ALL) SELECT src_id, (sum(length) OVER (ORDER BY src_id) - length)::BIGINT AS "offset", length FROM d',
        "bucket_histogram": f"WITH {adj} SELECT (src_id & 63)::INTEGER AS bucket, count(*) AS cnt FROM adj GROUP BY ALL",
        "entry_total": f"WITH {adj} SELECT count(*) AS n_entries FROM adj",
        "first_k_edges": f"WITH {adj}, {ranked} SELECT src_id, dst_id, ts, place::INTEGER AS place FROM r WHERE place <= {FIRST}",
        "sample_first": f"WITH {adj}, {ranked} SELECT src_id, dst_id, ts FROM r WHERE place <= {FIRST} AND src_id IN ({sites})",
        "khop_nodes": f"WITH {adj}, {ranked}, {hops} SELECT * FROM n{last}",
        "khop_edges": f"WITH {adj}, {ranked}, {hops} SELECT * FROM ({' UNION '.join(f'SELECT * FROM e{i}' for i in range(1, last + 1))})",
        "freq_words": f"WITH {counts} SELECT * FROM top",
        "sample_freq_words": f"WITH {counts} SELECT * FROM top".replace(usable, f"{usable} AND ('0x' || substr(md5(edge_id::VARCHAR), 1, 15))::BIGINT % {SAMPLE} = 0"),
        "heavy_hitters": f"WITH {counts}, {heavy} SELECT * FROM h",
        "line_stats": f"WITH {counts}, {heavy}, s AS (SELECT node_type, sum(cnt) AS held FROM h GROUP BY ALL) SELECT node_type, n_entries, ((n_entries - coalesce(held, 0)) // {stats.BATCH_ENTRIES})::BIGINT AS n_buckets FROM t LEFT JOIN s USING (node_type)",
        "line_stats_plain": f"WITH {counts} SELECT node_type, n_entries, (n_entries // {stats.BATCH_ENTRIES})::BIGINT AS n_buckets FROM t",
        "parse_bool": f"SELECT line_id, coalesce(lower(string_split(line, ',')[5]) IN ({truth}), false) AS flag FROM raw_relation",
        "parse_rows": "SELECT line_id, f[1] AS from_key, f[2] AS to_key, ts, strlen(line)::BIGINT + 1 AS n_bytes FROM (SELECT line_id, line, string_split(line, ',') AS f, CASE WHEN regexp_full_match(trim(string_split(line, ',')[3]), '[+-]?[0-9]+') THEN try_cast(trim(string_split(line, ',')[3]) AS INTEGER) END AS ts FROM raw_relation) WHERE len(f) >= 3 AND ts IS NOT NULL",
    }
