"""The reads over whole node and relation tables: small tables with known answers."""

import pytest

from arcweave.functions.ids import node_id_of
from arcweave.plans import graph_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    ac, it, si = ("a1", "a2"), ("i1", "i2"), ("s1",)
    for kind, keys in (("acct", ac), ("item", it), ("site", si)):
        nodes = [(k, node_id_of(graph_queries.ORDINALS[kind], k), 0, n, 0.5, True, k.upper()) for n, k in enumerate(keys)]
        spark.createDataFrame(nodes, "node_key string, node_id long, loaded_at long, attr1 long, attr2 double, attr3 boolean, attr4 string").write.parquet(f"{at}/node_{kind}.parquet")
    for rel, edges in (("acct_item", [("a1", "i1", 1), ("a1", "i1", 1), ("a2", "i2", 2), ("a2", "gone", 3), (None, "i1", 4)]), ("item_site", [("i1", "s1", 5), ("i2", None, 6)])):
        spark.createDataFrame(edges, "from_key string, to_key string, ts int").write.parquet(f"{at}/relation_{rel}.parquet")
    return str(at)


def ident(key):
    return node_id_of({"a": 0, "i": 1, "g": 1, "s": 2}[key[0]], key)


def test_pairs_of_both_relations(spark, rows, tables):
    want = [("i1", "a1", 1), ("i1", "a1", 1), ("i2", "a2", 2), ("gone", "a2", 3), ("s1", "i1", 5)]
    assert rows(graph_queries.queries()["edge_attr_all"](spark, tables)) == sorted([(ident(a), ident(b), t) for a, b, t in want], key=str)


def test_neighbours_of_every_type(spark, rows, tables):
    q = {name: f(spark, tables) for name, f in graph_queries.queries().items() if name.endswith("_all")}
    # a reference to "gone", which is no node, is an entry of a2; it is not asked for and has no attributes
    edges = [("a1", "i1", 1), ("a1", "i1", 1), ("i1", "a1", 1), ("i1", "a1", 1), ("a2", "i2", 2), ("i2", "a2", 2), ("a2", "gone", 3), ("i1", "s1", 5), ("s1", "i1", 5)]
    want = [(ident(a), ident(b), t) for a, b, t in edges]
    assert rows(q["neighbor_edges_all"]) == rows(q["sample_first_all"]) == sorted(want, key=str)
    assert rows(q["neighbor_nodes_all"]) == sorted([x[:2] for x in want], key=str)
    place = {"a1": 0, "a2": 1, "i1": 0, "i2": 1, "s1": 0}
    assert rows(q["neighbor_attrs_all"]) == sorted([(ident(a), ident(b), place[b], 0.5) for a, b, _ in edges if b in place], key=str)
    together = ({"a1", "i1", "s1"}, {"a2", "i2", "gone"})
    assert {tuple(r) for r in q["khop_nodes_all"].collect()} == {(ident(a), ident(b)) for group in together for a in group - {"gone"} for b in group}
    # "gone" is reached and gives its own entry, too
    found = {(ident(s), ident(a), ident(b), t) for group in together for s in group - {"gone"} for a, b, t in [*edges, ("gone", "a2", 3)] if a in group}
    assert {tuple(r) for r in q["khop_edges_all"].collect()} == found
