"""Saved graphs keep their relations and edge attributes, and are read bucket by bucket."""

import re

import pytest

from arcweave.functions.ids import node_id_of
from arcweave.operators import reads
from arcweave.operators.adjacency import in_node_order
from arcweave.plans.graph import Graph


def test_edge_attributes_are_saved(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "relation_r.csv").write_text("u(user),i(item),ts:int,w:float,ok:bool\na,x,1,2.5,yes\na,x,1,2.5,yes\nb,y,2,?,\nb,bad\n")
    (tmp_path / "in" / "relation_s.csv").write_text("u(user),i(item),when:int,w:str\na,x,7,text\nb,y,8\n")
    (tmp_path / "in" / "relation_none.csv").write_text("u(user),i(item),ts:int,w:int\n")
    g = Graph.from_files(spark, str(tmp_path / "in"))
    g.save(str(tmp_path / "out"))
    again = Graph.open(spark, str(tmp_path / "out"))
    assert set(again.relations) == {"r", "s", "none"}
    assert all(again.relations[n].dtypes == g.relations[n].dtypes and rows(again.relations[n]) == rows(g.relations[n]) for n in g.relations)
    assert rows(again.relations["r"].select("ts", "w", "ok")) == [(1, 2.5, True), (1, 2.5, True), (2, None, False)]
    assert rows(again.directed) == rows(g.directed) and again.directed.count() == 5
    assert rows(again.adjacency) == rows(g.adjacency)
    again.save(str(tmp_path / "copy"))
    copy = Graph.open(spark, str(tmp_path / "copy"))
    assert rows(copy.relations["s"].filter(copy.relations["s"].src_id == node_id_of(copy.catalog.ordinal("user"), "a")).select("ts", "w")) == [(7, "text")]


def test_graph_saved_without_relations(spark, tmp_path):
    (tmp_path / "relation_r.csv").write_text("u(user),i(item),ts:int\na,x,1\n")
    g = Graph.from_files(spark, str(tmp_path))
    Graph(spark, g.catalog, g.nodes, {}, g.adjacency).save(str(tmp_path / "out"))
    again = Graph.open(spark, str(tmp_path / "out"))
    assert again.relations == {} and again.adjacency.count() == 2


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """(as loaded, as opened again): 400 users, 30 items; one item has a third of all entries."""
    at = tmp_path_factory.mktemp("graph")
    (at / "node_u.csv").write_text("u(u),n:int,s:str\n" + "".join(f"u{i},{i},s{i}\n" for i in range(400)))
    (at / "node_i.csv").write_text("i(i),n:int\n" + "".join(f"i{i},{i}\n" for i in range(30)))
    (at / "relation_r.csv").write_text("u(u),i(i),ts:int\n" + "".join(f"u{i % 400},i{0 if i % 3 else i % 30},{i % 11}\n" for i in range(2000)))
    g = Graph.from_files(spark, str(at))
    g.save(f"{at}/saved", buckets=16)
    return g, Graph.open(spark, f"{at}/saved")


def scans(df):
    """(partition filters, pushed filters) of the scans of bucketed tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)


def seeds(spark, keys, kind="u"):
    return spark.createDataFrame([(node_id_of({"i": 0, "u": 1}[kind], k),) for k in keys], "node_id long")


@pytest.mark.parametrize("named", [1000, 0])
def test_reads_of_a_saved_graph(spark, rows, saved, named, monkeypatch):
    """Ids named in the scan, or joined behind a filter of their buckets: the rows are those of the graph before it was saved."""
    monkeypatch.setattr(reads, "NAMED_IDS", named)
    g, again = saved
    for keys in (["u5", "u5", "u17", "nobody"], []):
        ids = seeds(spark, keys)
        pairs = ids.crossJoin(seeds(spark, ["i0", "i3"], "i").withColumnRenamed("node_id", "dst_id")).withColumnRenamed("node_id", "src_id")
        for read in (lambda x: x.neighbor_edges_of(ids), lambda x: x.neighbor_nodes_of(ids), lambda x: x.node_attr_of(ids, "u"), lambda x: x.node_attr_of(ids, "u", True),
                     lambda x: x.neighbor_attr_of(ids, "i"), lambda x: x.edge_attr_of(pairs), lambda x: x.sample_nodes_of(ids, 2)):
            a, b = read(g), read(again)
            assert a.columns == b.columns and rows(a) == rows(b)
    ident = node_id_of(1, "u7")
    assert rows(again.fetch_node_attr(ident)) == rows(g.fetch_node_attr(ident)) == [(ident, "u7", 7, "s7")]
    assert [tuple(r) for r in again.fetch_node_neighbor_edges(ident).collect()] == [tuple(r) for r in g.fetch_node_neighbor_edges(ident).collect()]
    assert rows(again.adjacency) == rows(g.adjacency) and rows(again.nodes["u"]) == rows(g.nodes["u"])


def test_reads_open_only_the_buckets_asked_for(spark, saved, monkeypatch):
    _, g = saved
    ids = seeds(spark, ["u5", "u17"])
    for df, key in ((g.neighbor_edges_of(ids), "src_id"), (g.node_attr_of(ids, "u"), "node_id"), (g.sample_nodes_of(ids, 2), "src_id")):
        (partition, pushed), *_ = scans(df)
        assert "bucket" in partition and f"In({key}" in pushed
    ident = node_id_of(1, "u5")
    for df, key in ((g.fetch_node_attr(ident), "node_id"), (g.fetch_node_neighbor_edges(ident), "src_id"), (g.fetch_edge_attr(ident, 1), "src_id")):
        (partition, pushed), *_ = scans(df)
        assert "bucket" in partition and f"EqualTo({key},{ident})" in pushed
    monkeypatch.setattr(reads, "NAMED_IDS", 1)
    plan = g.neighbor_edges_of(ids)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1][:30]


@pytest.mark.parametrize(("sent", "degrees"), [(100_000, (1, 2, 3)), (3, (2, 2)), (0, (2, 0, 1))])
def test_expansion_by_frontier(spark, rows, saved, sent, degrees, monkeypatch):
    g, again = saved
    ids = seeds(spark, ["u5", "u17", "nobody"])
    with monkeypatch.context() as m:
        m.setattr(reads, "SENT_IDS", 0)  # ranks the whole adjacency at once
        want = [rows(df) for df in g.expand_from(ids, degrees)]
    monkeypatch.setattr(reads, "SENT_IDS", sent)
    assert [rows(df) for df in again.expand_from(ids, degrees)] == want
    with pytest.raises(ValueError):
        again.expand_from(ids, (1, -1))


def test_expansion_ranks_only_what_it_reaches(spark, saved, monkeypatch):
    kept, asked, ranked = reads.materialize, [], []

    def materialize(df, label):
        made = kept(df, label)
        {"frontier": asked, "first-edges": ranked}.get(label, []).append(made)
        return made

    monkeypatch.setattr(reads, "materialize", materialize)
    nodes, edges = saved[1].expand_from(seeds(spark, ["u5"]), (2, 2, 2))
    edges.collect()
    ids = [r.node_id for df in asked for r in df.collect()]
    assert len(ids) == len(set(ids)) < 20 and {r.src_id for df in ranked for r in df.collect()} <= set(ids)


def test_layout_has_no_fixed_width(spark, saved):
    """A bucket, and also a hot node, is written by as many tasks as its share of the rows asks for."""
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        laid = in_node_order(saved[0].adjacency, 16)
        assert laid.rdd.getNumPartitions() > 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(ValueError):
        saved[0].save("/nowhere", buckets=12)


def test_graph_saved_before_layouts(spark, saved, tmp_path, rows):
    """Without a layout: 64 buckets, node tables as they are."""
    from arcweave.sources import store

    g, _ = saved
    path = str(tmp_path / "old")
    for name, df in g.nodes.items():
        store.write_table(df, f"{path}/nodes/{name}")
    store.write_adjacency(g.adjacency, f"{path}/adjacency")
    g.catalog.save(spark, path)
    old, ids = Graph.open(spark, path), seeds(spark, ["u5", "u6"])
    assert rows(old.node_attr_of(ids, "u")) == rows(g.node_attr_of(ids, "u")) and rows(old.neighbor_edges_of(ids)) == rows(g.neighbor_edges_of(ids))
    assert rows(old.neighbor_attr_of(ids, "i")) == rows(g.neighbor_attr_of(ids, "i"))
    assert rows(old.fetch_node_attr(node_id_of(1, "u5"))) == rows(g.fetch_node_attr(node_id_of(1, "u5")))
