"""Ids, files, catalog, reads, statistics, store: small graphs with known answers."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arcweave.functions import ids
from arcweave.functions.types import bool_column, parse_column, type_of
from arcweave.operators import reads, stats
from arcweave.operators.adjacency import both_directions, bucket_histogram, csr_index, degree, edges, last_wins
from arcweave.plans.graph import Graph
from arcweave.sources import delimited, store
from arcweave.sources.catalog import Catalog, NodeType, Relation, parse_node_header, parse_relation_header
from arcweave.sources.datagen import generate


def graph(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    return Graph.from_files(spark, str(tmp_path))


def test_ids(spark):
    keys = ["", "x", "é", "x" * 5000, "1"]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    got = {r.k: r for r in df.select("k", ids.node_id(2, F.col("k")).alias("i")).select("k", "i", ids.type_ordinal(F.col("i")).alias("t"), ids.bucket(F.col("i")).alias("b")).collect()}
    for k in keys:
        want = 2 << 60 | int(hashlib.md5(k.encode()).hexdigest()[:15], 16)
        assert (got[k].i, got[k].t, got[k].b) == (want, 2, want & 63) and ids.node_id_of(2, k) == want
    assert got[None].i is None
    assert ids.node_id_of(7, "x") < 2**63
    with pytest.raises(ValueError):
        ids.node_id_of(8, "x")


def test_types(spark):
    words = ["yes", "TRUE", "t", "1", "no", "x", "", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(bool_column(F.col("w"))).collect()] == [True] * 4 + [False] * 4
    one = spark.createDataFrame([("abc", "7")], "a string, b string")
    assert one.select(parse_column(F.col("a"), "int", strict=False), parse_column(F.col("b"), "int32")).first()[:] == (None, 7)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one.select(parse_column(F.col("a"), "float")).collect()
    with pytest.raises(KeyError):
        type_of("date")


def test_headers_and_catalog(spark, tmp_path):
    assert parse_node_header("key(user),age:int,name:str") == NodeType("user", "key", (("age", "int"), ("name", "str")))
    assert parse_relation_header("u(user),i(item),t:int,w:float", "buys") == Relation("buys", "user", "item", (("t", "int"), ("w", "float")))
    for bad in ("u(user),i(item)", "u(user),i,ts:int", "a(x),b(y),c(z),ts:int"):
        with pytest.raises(ValueError):
            parse_relation_header(bad, "r")
    with pytest.raises(ValueError):
        parse_node_header("u(user),age")
    with pytest.raises(KeyError):
        parse_node_header("u(user),age:long")
    made = Catalog.build([NodeType("b", "b")], [Relation("r", "c", "a")])
    assert made.ordinals == {"a": 0, "b": 1, "c": 2}
    later = Catalog.build([NodeType("B", "B"), NodeType("b", "b")], [], made.ordinals)
    assert later.ordinals == {"a": 0, "b": 1, "c": 2, "B": 3}
    assert made.type_of_id(ids.node_id_of(1, "x")) == "b"
    made.save(spark, str(tmp_path))
    assert Catalog.load(spark, str(tmp_path)) == made
    with pytest.raises(RuntimeError):
        made.add_type(NodeType("z", "z"))
    with pytest.raises(KeyError):
        made.ordinal("z")
    Catalog.build([NodeType(str(i), "k") for i in range(8)], [])
    with pytest.raises(ValueError):
        Catalog.build([NodeType(str(i), "k") for i in range(9)], [])


def test_relation_lines(spark, tmp_path, rows):
    text = "u(user),i(item),ts:int\na,x,1\nb,y\nc,y,abc\nd,y,1.0\ne,y,\nf,y, 12 \ng,y,+5\nh,y,3000000000\ni,y,7,extra,more\n\"q,1\",z,2\nk,x,9"
    g = graph(spark, tmp_path, relation_r=text)
    name = {g.fetch_node_id("user", k): k for k in ["a", "f", "g", "i", '"q', "k"]}
    got = sorted((name[r.src_id], r.ts) for r in g.directed.collect())
    assert got == [("a", 1), ("f", 12), ("g", 5), ("i", 7), ("k", 9)]
    files = delimited.list_files(spark, str(tmp_path), "relation_")
    assert [r.n_rejected for r in delimited.rejected_lines(spark, files).collect()] == [6]
    assert rows(delimited.rejects(spark, files).select("reason", "line")) == sorted([("columns", "b,y"), ("ts", "c,y,abc"), ("ts", "d,y,1.0"), ("ts", "e,y,"), ("ts", "h,y,3000000000"), ("ts", '"q,1",z,2')])
    quoted = Graph.from_files(spark, str(tmp_path), quoted=True)
    assert quoted.fetch_node_id("user", "q,1") in {r.src_id for r in quoted.directed.collect()}


def test_edge_attributes(spark, tmp_path, rows):
    g = graph(spark, tmp_path, relation_r="u(user),i(item),ts:int,w:float,ok:bool\na,x,1,2.5,yes\nb,y,2,?,", relation_s="u(user),i(item),when:int,w:str\na,x,7,text\nb,y,8")
    assert rows(g.relations["r"].select("ts", "w", "ok")) == [(1, 2.5, True), (2, None, False)]
    assert rows(g.relations["s"].select("ts", "w")) == [(7, "text"), (8, None)]
    assert g.directed.count() == 4 and g.catalog.relation_attributes("s") == (("when", "int"), ("w", "str"))
    (tmp_path / "relation_s.csv").write_text("u(user),i(item),ts:int,rel:str\na,x,7,text\n")
    with pytest.raises(ValueError):
        Graph.from_files(spark, str(tmp_path))


def test_no_files(spark, tmp_path):
    g = Graph.from_files(spark, str(tmp_path))
    assert g.adjacency.count() == 0 and g.nodes == {} and g.csr_index().count() == 0


def test_crlf_and_no_last_newline(spark, tmp_path):
    g = graph(spark, tmp_path, relation_r="u(user),i(item),ts:int\r\na,x,1\r\nb,longname,2")
    assert {(r.src_id, r.dst_id, r.ts) for r in g.directed.collect()} == {(g.fetch_node_id("user", a), g.fetch_node_id("item", b), t) for a, b, t in (("a", "x", 1), ("b", "longname", 2))}


def test_every_line_once(spark, tmp_path):
    (tmp_path / "relation_r.csv").write_text("u(user),i(item),ts:int\n" + "".join(f"u{i},i{i % 7},{i}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        g = Graph.from_files(spark, str(tmp_path))
        assert g.directed.select("ts").distinct().count() == g.directed.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nodes(spark, tmp_path, rows):
    g = graph(spark, tmp_path, node_user="u(user),age:int,score:float,ok:bool,name:str\na,1,1.5,yes,x\nb,2,nan,no\na,3,-1e3,T,last", relation_r="u(user),u(user),ts:int\nb,zz,1")
    got = {r.key: r for r in g.nodes["user"].collect()}
    assert got["a"][2:] == (3, -1000.0, True, "last") and got["b"].age == 2 and got["b"].name is None and not got["b"].ok
    assert g.fetch_node_attr(g.fetch_node_id("user", "a"), numeric_only=True).columns == ["node_id", "age", "score", "ok"]
    assert g.fetch_node_attr(g.fetch_node_id("user", "nobody")).count() == 0
    (tmp_path / "node_user.csv").write_text("u(user),age:int\na,one\nb")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|has no age"):
        Graph.from_files(spark, str(tmp_path)).nodes["user"].collect()
    assert rows(Graph.from_files(spark, str(tmp_path), strict=False).nodes["user"].select("key", "age")) == [("a", None), ("b", None)]


def test_same_type_relation_and_loop(spark, tmp_path):
    g = graph(spark, tmp_path, relation_r="a(user),b(user),ts:int\nx,x,1\nx,y,2\ny,x,3\nx,y,2")
    x, y = g.fetch_node_id("user", "x"), g.fetch_node_id("user", "y")
    assert Counter((r.src_id, r.dst_id, r.ts) for r in g.adjacency.collect()) == Counter({(x, x, 1): 2, (x, y, 2): 2, (y, x, 2): 2, (x, y, 3): 1, (y, x, 3): 1})
    assert [r.ts for r in g.fetch_edge_attr(x, y).collect()] == [2, 2, 3]
    assert [r.dst_id for r in g.fetch_node_neighbor_nodes(y).collect()] == [x, x, x]


def plain_expand(adj, seed, degrees):
    by = {}
    for e in sorted(adj, key=lambda e: (e[0], e[2], e[1])):
        by.setdefault(e[0], []).append(e)
    nodes, found = {seed}, set()
    for d in degrees:
        new = [e for n in nodes for e in by.get(n, [])[:d]]
        found |= set(new)
        nodes |= {e[1] for e in new}
    return nodes, found


@pytest.mark.parametrize("degrees", [(), (0,), (4, 4, 4), (1, 2, 3), (3, 1)])
def test_expand(spark, degrees):
    pairs = [(i % 17, i * 7 % 23 + 100, i % 5) for i in range(120)] + [(1, 101, 0)] * 3
    adj = [*pairs, *((b, a, t) for a, b, t in pairs)]
    df = spark.createDataFrame(adj, "src_id long, dst_id long, ts int")
    seeds = spark.createDataFrame([(1,), (101,), (999,), (1,)], "node_id long")
    nodes, found = reads.expand(seeds, df, degrees)
    want_n, want_e = set(), set()
    for s in (1, 101, 999):
        n, e = plain_expand(adj, s, degrees)
        want_n |= {(s, x) for x in n}
        want_e |= {(s, *x) for x in e}
    got_n, got_e = [tuple(r) for r in nodes.collect()], [tuple(r) for r in found.collect()]
    assert len(got_n) == len(set(got_n)) and set(got_n) == want_n
    assert len(got_e) == len(set(got_e)) and set(got_e) == want_e


def test_batch_reads(spark, rows):
    adj = spark.createDataFrame([(1, 2, 5), (1, 2, 5), (1, 3, 4), (2, 1, 5), (2, 1, 5), (3, 1, 4)], "src_id long, dst_id long, ts int")
    some = spark.createDataFrame([(1,), (1,), (9,), (None,)], "node_id long")
    assert rows(reads.neighbor_edges(some, adj)) == [(1, 2, 5), (1, 2, 5), (1, 3, 4)]
    assert rows(reads.sample_first(some, adj, 2)) == [(1, 2, 5), (1, 3, 4)]
    assert rows(reads.sample_first(some, adj, 0)) == []
    with pytest.raises(ValueError):
        reads.first_edges(adj, -1)
    pairs = spark.createDataFrame([(2, 1), (2, 3)], "src_id long, dst_id long")
    assert rows(reads.edge_entries(pairs, adj)) == [(2, 1, 5), (2, 1, 5)]
    nodes = spark.createDataFrame([(2, "two"), (4, "four")], "node_id long, name string")
    assert rows(reads.neighbor_attributes(some, adj, nodes).select("src_id", "dst_id", "name")) == [(1, 2, "two")] * 2
    assert rows(reads.node_attributes(some, nodes)) == []


def test_adjacency_properties(spark):
    df = spark.createDataFrame([(f"u{i % 9}" if i % 11 else None, f"v{i % 4}", str(i) if i % 7 else "x") for i in range(500)], "a string, b string, t string")
    directed = edges(df, "r", 0, "a", 1, "b", "t")
    for parts in (1, 7):
        adj = both_directions(directed.repartition(parts))
        n = sum(1 for i in range(500) if i % 11 and i % 7)
        assert adj.count() == 2 * n
        all_ = Counter(tuple(r) for r in adj.collect())
        assert all(all_[b, a, t] == c for (a, b, t), c in all_.items())
        assert degree(adj).agg(F.sum("length")).first()[0] == 2 * n == bucket_histogram(adj).agg(F.sum("cnt")).first()[0]
        index = sorted((r.src_id, r.offset, r.length) for r in csr_index(adj).collect())
        at = 0
        for src, offset, length in index:
            assert offset == at
            at += length
    empty = both_directions(directed.filter("false"))
    assert csr_index(empty).count() == 0


def test_last_wins(spark, rows):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (2, 5, "b", "y")], "k int, o int, v string, `odd name` string")
    assert rows(last_wins(df, "k", "o")) == [(1, 2, None, "x"), (2, 5, "b", "y")]


def test_statistics(spark, rows):
    data = [("hot", f"i{i}") for i in range(600)] + [("one", "x")] * 10 + [(f"u{i}", "x") for i in range(390)]
    df = spark.createDataFrame(data, "u string, i string")
    words = stats.type_words(df, [("u", "user"), ("i", "item")])
    assert rows(stats.heavy_hitters(words)) == [("item", "x", 400, 1000), ("user", "hot", 600, 1000)]  # exactly 1 % is not more than 1 %
    assert [r.key for r in stats.top_words(words).filter("node_type = 'user'").orderBy(F.desc("cnt"), "key").collect()] == ["hot", "one", "u0", "u1", "u10", "u100", "u101", "u102", "u103", "u104"]
    assert rows(stats.line_stats(words).drop("n_buckets")) == [("item", 1000), ("user", 1000)]
    assert rows(stats.line_stats(words, batch=100)) == [("item", 1000, 6), ("user", 1000, 4)]
    assert rows(stats.line_stats(words, True, batch=100)) == [("item", 1000, 10), ("user", 1000, 10)]
    assert 0 < stats.sample_words(words, 0.2).count() < 1000
    some = stats.sample_rows(words, "key", 5)
    assert 0 < some.count() < 1000 and rows(some) == rows(stats.sample_rows(words.repartition(7), "key", 5))
    assert stats.sample_rows(words, "key", 1).count() == 2000
    assert stats.partition_counts(df.repartition(3)).agg(F.sum("n_rows")).first()[0] == 1000


def test_store_and_generator(spark, tmp_path, rows):
    names = generate(spark, str(tmp_path / "in"), 3, 50, 200)
    g = Graph.from_files(spark, str(tmp_path / "in"))
    assert len(names) == 3 == len(g.nodes) and all(df.count() == 50 for df in g.nodes.values())
    assert g.adjacency.count() == 2 * 3 * 200
    g.save(str(tmp_path / "out"), buckets=64)
    again = Graph.open(spark, str(tmp_path / "out"))
    assert rows(again.adjacency) == rows(g.adjacency)
    assert all(rows(again.nodes[t]) == rows(g.nodes[t]) for t in names)
    ident = g.adjacency.first()["src_id"]
    assert [tuple(r) for r in again.fetch_node_neighbor_edges(ident).collect()] == [tuple(r) for r in g.fetch_node_neighbor_edges(ident).collect()]
    nodes, found = again.sample_node_with_degree(ident)
    want = plain_expand([tuple(r) for r in g.adjacency.collect()], ident, (4, 4, 4))
    assert ({r.node_id for r in nodes.collect()}, {tuple(r) for r in found.collect()}) == want
    got = store.lookup_by_bucket(spark.createDataFrame([(ident,), (5,)], "src_id long"), again._stored, "src_id", 64)
    assert rows(got.select("src_id", "dst_id", "ts")) == rows(again.fetch_node_neighbor_edges(ident))
    plan = again.fetch_node_neighbor_edges(ident)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1].split("]")[0] and f"EqualTo(src_id,{ident})" in plan
    again.create_views("g_")
    assert spark.sql("SELECT count(*) FROM g_adjacency").first()[0] == 1200
    assert rows(again.degree()) == rows(g.degree())


def test_quoted_files(spark, tmp_path, rows):
    """Commas and line breaks inside quotes, broken quoting with its reason; fields may be missing or too many."""
    g = lambda **how: Graph.from_files(spark, str(tmp_path), quoted=True, **how)
    (tmp_path / "node_u.csv").write_bytes(b'u(u),n:int,s:str\r\n"a,1",1,"x\ny"\r\nb,2\n"a,1",3,"say ""hi"""\n')
    (tmp_path / "relation_r.csv").write_text('u(u),u(u),ts:int,w:float,s:str\n"a,1",b,1,2.5,"x\ny"\nb,b,2\nb,b,3,,,"more",\nb,"b\nc,d",4\nb,b,x\nb,b\nb,"b"x,5\n')
    nodes = g().nodes["u"]
    assert rows(nodes.select("key", "n", "s")) == [("a,1", 3, 'say "hi"'), ("b", 2, None)]
    a, b, c = (ids.node_id_of(0, k) for k in ("a,1", "b", "b\nc,d"))
    assert rows(g().relations["r"].drop("rel")) == sorted([(a, b, 1, 2.5, "x\ny"), (b, b, 2, None, None), (b, b, 3, None, None), (b, c, 4, None, None)], key=str)
    files = delimited.list_files(spark, str(tmp_path), "relation_")
    assert rows(delimited.rejects(spark, files, quoted=True).select("reason", "line")) == [("columns", "b,b"), ("quoting", 'b,"b"x,5'), ("ts", "b,b,x")]
    (tmp_path / "node_u.csv").write_text('u(u),n:int,s:str\n"a"b,1,x\nc,2,y\n')
    assert rows(g(strict=False).nodes["u"].select("key", "n")) == [("c", 2)]
    with pytest.raises(Exception, match="broken quoting"):
        g().nodes["u"].collect()


def test_tables_in_several_files(spark, tmp_path, rows):
    """Parts of a node type and of a relation; the last row of a key by file name and line wins."""
    at = str(tmp_path)
    nodes = spark.createDataFrame([(i, f"k{i % 50},{i}") for i in range(400)], "i int, line string").repartitionByRange(4, "i").sortWithinPartitions("i")
    delimited.write_lines(nodes.select("line"), "u(u),n:int", at, "node_u")
    delimited.write_lines(spark.createDataFrame([(f"k{i},x,{i}",) for i in range(90)], "line string").repartition(3), "u(u),i(i),ts:int", at, "relation_r")
    (tmp_path / "relation_r2.csv").write_text("u(u),i(i),ts:int\nk1,x,7\n")
    g = Graph.from_files(spark, at)
    assert set(g.relations) == {"r", "r2"} and g.relations["r"].count() == 90 and g.relations["r2"].count() == 1
    assert rows(g.nodes["u"].select("key", "n")) == sorted(((f"k{i}", 350 + i) for i in range(50)), key=str)
    assert len(delimited.list_files(spark, at, "node_u")) > 1
    delimited.write_lines(spark.createDataFrame([("k1,x,1",)], "line string").coalesce(1), "u(u),i(i),ts:int", at, "relation_r")
    again = Graph.from_files(spark, at)
    assert again.relations["r"].count() == 1 and again.relations["r2"].count() == 1
    (tmp_path / "relation_r.zz.csv").write_text("u(u),i(i),ts:int,w:int\n")
    with pytest.raises(ValueError):
        Graph.from_files(spark, at)


def test_cli(spark, tmp_path, capsys):
    from arcweave.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "relation_r.csv").write_text("a(u),b(i),ts:int\nx,y,1\n")
    assert main(["load", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    assert main(["neighbors", str(tmp_path / "out"), "u", "x"], spark) == 0
    assert main(["sample", str(tmp_path / "out"), "u", "x", "2", "2"], spark) == 0
    assert str(ids.node_id_of(0, "y")) in capsys.readouterr().out
    (tmp_path / "in" / "relation_r.csv").write_text("a(u),b(i),ts:int\nx,y,1\nx,y\nx,y,z\n")
    assert main(["rejects", str(tmp_path / "in")], spark) == 0
    assert "columns" in (said := capsys.readouterr().out) and "ts" in said
    assert main(["pack", str(tmp_path / "in"), str(tmp_path / "packed")], spark) == 0
    assert main(["extract", str(tmp_path / "packed"), f"file:{tmp_path}/in/relation_r.csv"], spark) == 0
    assert capsys.readouterr().out == (tmp_path / "in" / "relation_r.csv").read_text()


def test_stream(spark, tmp_path, rows):
    from arcweave.streaming.ingest import append_adjacency, stream_edges

    rel = Relation("r", "u", "i", (("ts", "int"),))
    catalog = Catalog.build([], [rel])
    source = tmp_path / "in"
    source.mkdir()
    header = "a(u),b(i),ts:int"
    for k, text in enumerate(["x,y,1\nbad\n", "x,z,2\n"]):
        (source / f"{k}.csv").write_text(f"{header}\n{text}")
        q = append_adjacency(stream_edges(spark, str(source), rel, header, catalog), str(tmp_path / "adj"), str(tmp_path / "cp"))
        q.awaitTermination()
    i = lambda t, k: ids.node_id_of(catalog.ordinal(t), k)
    want = [(i("u", "x"), i("i", "y"), 1), (i("u", "x"), i("i", "z"), 2)]
    got = store.read_adjacency(spark, str(tmp_path / "adj")).select("src_id", "dst_id", "ts")
    assert rows(got) == sorted([*want, *((b, a, t) for a, b, t in want)], key=str)
