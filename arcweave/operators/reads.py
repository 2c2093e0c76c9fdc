"""The reads of a graph, set at a time: each takes a DataFrame of ids (or id pairs) instead of one id.

``ids`` may hold repeated ids; results are as if each distinct id was asked for once. Unknown ids give no rows.
The order of a node's entries is (ts, dst_id).

Tables of a stored graph are partitioned by ``bucket`` (low bits of the key) and sorted by key inside a bucket. The reads
take ``buckets``, their number, for such tables, and then open only the buckets that the ids fall into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.common import materialize
from arcweave.functions.ids import bucket

#: Ids up to which a look-up names them in the scan, so that file statistics leave out row groups, too.
NAMED_IDS = 1_000
#: Ids up to which an expansion sends its newest nodes to all tasks; beyond, the first entries of all nodes are ranked once.
SENT_IDS = 100_000


def _distinct(ids: DataFrame, *columns: str) -> DataFrame:
    return ids.select(*columns).distinct()


def lookup_by_bucket(ids: DataFrame, stored: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows of a table partitioned by ``bucket`` whose ``key`` is among ``ids`` (a column of the same name).

    Up to NAMED_IDS ids are named in the filter of the scan. More are joined, behind a filter of the buckets in which
    they lie. What comes to the driver is at most so many ids, or one number a bucket.
    """
    wanted = _distinct(ids, key).filter(F.col(key).isNotNull())
    few = [r[0] for r in wanted.limit(NAMED_IDS + 1).collect()]
    if len(few) <= NAMED_IDS:
        return stored.filter(F.col("bucket").isin(sorted({i & (buckets - 1) for i in few})) & F.col(key).isin(sorted(few)))
    wanted = wanted.withColumn("bucket", bucket(F.col(key), buckets))
    hit = [r[0] for r in wanted.select("bucket").distinct().collect()]
    if len(hit) < buckets:
        stored = stored.filter(F.col("bucket").isin(sorted(hit)))
    return stored.join(wanted, ["bucket", key], "left_semi")


def _rows_of(ids: DataFrame, table: DataFrame, key: str, buckets: int | None) -> DataFrame:
    if buckets is not None:
        return lookup_by_bucket(ids, table, key, buckets)
    return table.join(_distinct(ids, key), key, "left_semi")


def node_attributes(ids: DataFrame, nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Attribute rows of the nodes with these ids."""
    return _rows_of(ids, nodes, "node_id", buckets)


def edge_entries(pairs: DataFrame, adjacency: DataFrame, buckets: int | None = None) -> DataFrame:
    """All entries between the two nodes of each (src_id, dst_id), parallel ones included, in either direction."""
    if buckets is not None:
        adjacency = lookup_by_bucket(pairs, adjacency, "src_id", buckets)
    return adjacency.join(_distinct(pairs, "src_id", "dst_id"), ["src_id", "dst_id"], "left_semi").select("src_id", "dst_id", "ts")


def neighbor_edges(ids: DataFrame, adjacency: DataFrame, buckets: int | None = None) -> DataFrame:
    """(src_id, dst_id, ts) of all entries of these nodes."""
    return _rows_of(ids.select(F.col("node_id").alias("src_id")), adjacency, "src_id", buckets).select("src_id", "dst_id", "ts")


def neighbor_nodes(ids: DataFrame, adjacency: DataFrame, buckets: int | None = None) -> DataFrame:
    """(src_id, dst_id) of all entries of these nodes, with repetitions."""
    return neighbor_edges(ids, adjacency, buckets).select("src_id", "dst_id")


def neighbor_attributes(ids: DataFrame, adjacency: DataFrame, nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per entry of these nodes the attributes of its far end, for far ends in ``nodes``."""
    found = neighbor_nodes(ids, adjacency, buckets)
    far = nodes.withColumnRenamed("node_id", "dst_id")
    if buckets is None:
        return found.join(far, "dst_id")
    return found.withColumn("bucket", bucket(F.col("dst_id"), buckets)).join(far, ["bucket", "dst_id"]).drop("bucket")


def first_edges(adjacency: DataFrame, size: int) -> DataFrame:
    """The first ``size`` entries of every node, with their place (from 1); planned as a group limit."""
    if size < 0:
        raise ValueError("size can't be negative")
    place = F.row_number().over(Window.partitionBy("src_id").orderBy("ts", "dst_id"))
    return adjacency.select("src_id", "dst_id", "ts").withColumn("place", place).filter(F.col("place") <= size)


def sample_first(ids: DataFrame, adjacency: DataFrame, size: int, buckets: int | None = None) -> DataFrame:
    """(src_id, dst_id, ts): the first ``size`` entries of these nodes."""
    return first_edges(neighbor_edges(ids, adjacency, buckets), size).drop("place")


def expand(seeds: DataFrame, adjacency: DataFrame, degrees: Sequence[int] = (4, 4, 4), buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reached from each seed: ((seed_id, node_id), (seed_id, src_id, dst_id, ts)), both distinct.

    At each level every node reached so far, not only the newest, gives its first ``degree`` entries. ``seeds`` has
    node_id. In a stored adjacency only nodes that no earlier level asked for are looked up: while these number at most
    SENT_IDS, nothing else of it is ranked or shuffled. Once they are more, the first max(degrees) entries of all nodes
    are ranked and written, for this level and all that follow; the group limit cuts hot nodes before the shuffle. An
    adjacency that isn't stored is made anew from its source by every pass (parsing, two hashes an edge), which costs
    more than ranking; so for more than one level it is ranked at once, in a single pass.

    What is looked up is written, and so are the edges of each level, so that no level computes an earlier one again. A
    level adds at most ``degree`` rows a reached node, whatever the nodes' degrees are, and only such as no earlier
    level gave: ``seen`` is how many entries a node has given.
    """
    if min([0, *degrees]) < 0:
        raise ValueError("a degree can't be negative")
    most = max([0, *degrees])

    def ranked_once(entries: DataFrame) -> DataFrame:  # equal entries are neighbours
        return materialize(first_edges(entries, most).groupBy("src_id", "dst_id", "ts").agg(F.min("place").alias("place")), "first-edges")

    nodes = _distinct(seeds, "node_id").select(F.col("node_id").alias("seed_id"), "node_id", F.lit(0).alias("seen"))
    frontier = _distinct(seeds, "node_id").filter(F.col("node_id").isNotNull())
    ranked = asked = None
    whole = buckets is None and sum(d > 0 for d in degrees) > 1
    if whole:
        ranked = ranked_once(adjacency)
    found = adjacency.select(F.col("src_id").alias("seed_id"), "src_id", "dst_id", "ts").filter(F.lit(False))
    for d in degrees:
        if not d:
            continue
        if not whole:
            frontier = materialize(frontier, "frontier")
            n = frontier.count()  # read from file footers
            if n > SENT_IDS:
                whole, ranked = True, ranked_once(adjacency)
            elif n:
                if buckets is None:
                    entries = adjacency.join(F.broadcast(frontier.withColumnRenamed("node_id", "src_id")), "src_id", "left_semi")  # SENT_IDS at most
                else:
                    entries = neighbor_edges(frontier, adjacency, buckets)
                one = ranked_once(entries)
                ranked = one if ranked is None else ranked.unionByName(one)
                asked = frontier if asked is None else asked.unionByName(frontier)
        if ranked is None:
            break
        new = nodes.filter(F.col("seen") < d).join(ranked, (F.col("node_id") == F.col("src_id")) & (F.col("place") > F.col("seen")) & (F.col("place") <= d))
        new = materialize(new.select("seed_id", "src_id", "dst_id", "ts"), "level")
        found = found.unionByName(new)
        if not whole:
            frontier = new.select(F.col("dst_id").alias("node_id")).distinct().join(asked, "node_id", "left_anti")
        given = nodes.withColumn("seen", F.greatest("seen", F.lit(d)))
        reached = given.unionByName(new.select("seed_id", F.col("dst_id").alias("node_id"), F.lit(0).alias("seen")))
        nodes = reached.groupBy("seed_id", "node_id").agg(F.max("seen").alias("seen"))
    return nodes.select("seed_id", "node_id"), found
