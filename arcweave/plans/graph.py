"""The Graph: a catalog, one DataFrame per node type, the directed edges and the adjacency, all lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from arcweave.functions.ids import node_id_of
from arcweave.operators import reads
from arcweave.operators.adjacency import ADJACENCY, both_directions, csr_index, degree
from arcweave.sources import delimited, store
from arcweave.sources.catalog import Catalog


class Graph:
    """Nodes and edges, loaded once and read-only; every method returns a lazy DataFrame.

    The reads come in two forms: for a DataFrame of ids (``*_of``) and for one id. Of an opened graph both read only the
    buckets that the ids fall into; the forms for many ids run a small job at once to find out which. ``csr_index``,
    ``expand_from`` and ``sample_node_with_degree`` write intermediate tables when they are called.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, nodes: dict[str, DataFrame], relations: dict[str, DataFrame], adjacency: DataFrame | None = None, stored: store.Stored | None = None):
        """``relations``: edges with their attributes by relation name; ``adjacency``: if it isn't to be made of them;
        ``stored``: the bucketed tables of an opened graph."""
        self.spark, self.catalog, self.nodes, self.relations = spark, catalog, nodes, relations
        self._stored = None if stored is None else stored.adjacency
        self._stored_nodes = stored.nodes if stored is not None and stored.bucketed_nodes else None
        self._buckets = None if stored is None else stored.buckets
        self.directed = spark.createDataFrame([], "rel string, src_id long, dst_id long, ts int")
        for df in relations.values():
            self.directed = self.directed.unionByName(df.select("rel", "src_id", "dst_id", "ts"))
        self.adjacency = both_directions(self.directed) if adjacency is None else adjacency.select(*ADJACENCY)

    @classmethod
    def from_files(cls, spark: SparkSession, directory: str, strict: bool = True, quoted: bool = False, known: dict[str, int] | None = None) -> Graph:
        """Loads ``node_*.csv`` and ``relation_*.csv`` of a directory. ``known``: ordinals of an earlier load to keep."""
        catalog, node_files, relation_files = delimited.discover(spark, directory, known)
        nodes = {t: delimited.read_nodes(spark, f, catalog.types[t], catalog.ordinal(t), strict, quoted) for t, f in node_files.items()}
        relations = {name: delimited.read_relation(spark, files, catalog.relations[name], catalog, quoted) for name, files in relation_files.items()}
        return cls(spark, catalog, nodes, relations)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        found = store.load(spark, path)
        nodes = {t: df.drop("bucket") for t, df in found.nodes.items()}
        return cls(spark, found.catalog, nodes, found.relations, found.adjacency, found)

    def save(self, path: str, buckets: int = store.BUCKETS) -> None:
        store.save(path, self.catalog, self.nodes, self.relations, self.adjacency, buckets)

    def create_views(self, prefix: str = "") -> None:
        """Temporary views ``<prefix>node_<type>`` and ``<prefix>adjacency``, for SQL."""
        for t, df in self.nodes.items():
            df.createOrReplaceTempView(f"{prefix}node_{t}")
        self.adjacency.createOrReplaceTempView(f"{prefix}adjacency")

    # one id

    def fetch_node_id(self, node_type: str, key: object) -> int:
        return node_id_of(self.catalog.ordinal(node_type), key)

    def _one(self, ident: int) -> DataFrame:
        return self.spark.createDataFrame([(ident,)], "node_id long")

    def fetch_node_attr(self, ident: int, numeric_only: bool = False) -> DataFrame:
        t = self.catalog.type_of_id(ident)
        if self._stored_nodes is not None:
            row = store.entries_of(self._stored_nodes[t], ident, self._buckets, "node_id").drop("bucket")
        else:
            row = self.nodes[t].filter(self.nodes[t].node_id == ident)
        return row.select("node_id", *self.catalog.attribute_names(t, True)) if numeric_only else row

    def fetch_node_neighbor_edges(self, ident: int) -> DataFrame:
        if self._stored is not None:
            return store.entries_of(self._stored, ident, self._buckets).select(*ADJACENCY).orderBy("ts", "dst_id")
        return self.adjacency.filter(self.adjacency.src_id == ident).orderBy("ts", "dst_id")

    def fetch_node_neighbor_nodes(self, ident: int) -> DataFrame:
        return self.fetch_node_neighbor_edges(ident).select("dst_id")

    def fetch_edge_attr(self, from_id: int, to_id: int) -> DataFrame:
        return self.fetch_node_neighbor_edges(from_id).filter(f"dst_id = {to_id}")

    def sample_nodes(self, ident: int, size: int = 0) -> DataFrame:
        """The first ``size`` entries of a node, by (ts, dst_id)."""
        return reads.first_edges(self.fetch_node_neighbor_edges(ident), size).drop("place")

    def sample_node_with_degree(self, ident: int, degrees: Sequence[int] = (4, 4, 4)) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.expand_from(self._one(ident), degrees)
        return nodes.select("node_id"), edges.select(*ADJACENCY)

    # many ids

    @property
    def _entries(self) -> tuple[DataFrame, int | None]:
        """The adjacency as it is best read by node, and its buckets."""
        return (self.adjacency, None) if self._stored is None else (self._stored, self._buckets)

    def node_attr_of(self, ids: DataFrame, node_type: str, numeric_only: bool = False) -> DataFrame:
        if self._stored_nodes is not None:
            rows = reads.node_attributes(ids, self._stored_nodes[node_type], self._buckets).drop("bucket")
        else:
            rows = reads.node_attributes(ids, self.nodes[node_type])
        return rows.select("node_id", *self.catalog.attribute_names(node_type, True)) if numeric_only else rows

    def neighbor_edges_of(self, ids: DataFrame) -> DataFrame:
        return reads.neighbor_edges(ids, *self._entries)

    def neighbor_nodes_of(self, ids: DataFrame) -> DataFrame:
        return reads.neighbor_nodes(ids, *self._entries)

    def neighbor_attr_of(self, ids: DataFrame, node_type: str) -> DataFrame:
        if self._stored_nodes is not None:
            return reads.neighbor_attributes(ids, self._stored, self._stored_nodes[node_type], self._buckets)
        adjacency, buckets = self._entries
        return reads.neighbor_nodes(ids, adjacency, buckets).join(self.nodes[node_type].withColumnRenamed("node_id", "dst_id"), "dst_id")

    def edge_attr_of(self, pairs: DataFrame) -> DataFrame:
        return reads.edge_entries(pairs, *self._entries)

    def sample_nodes_of(self, ids: DataFrame, size: int) -> DataFrame:
        adjacency, buckets = self._entries
        return reads.sample_first(ids, adjacency, size, buckets)

    def expand_from(self, ids: DataFrame, degrees: Sequence[int] = (4, 4, 4)) -> tuple[DataFrame, DataFrame]:
        adjacency, buckets = self._entries
        return reads.expand(ids, adjacency, degrees, buckets)

    def degree(self) -> DataFrame:
        return degree(self.adjacency)

    def csr_index(self) -> DataFrame:
        return csr_index(self.adjacency)
