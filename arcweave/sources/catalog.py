"""The catalog of a graph: node types with ordinals and attribute schemas, relations with their end types."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from arcweave.functions.ids import TYPE_SHIFT, check_ordinal
from arcweave.functions.types import type_of

_IN_PARENTHESES = re.compile(r"\((.+?)\)")


@dataclass(frozen=True)
class NodeType:
    name: str
    key: str
    attributes: tuple[tuple[str, str], ...] = ()  # (name, type token)

    def schema(self, numeric_only: bool = False) -> T.StructType:
        return T.StructType([T.StructField(n, type_of(t)) for n, t in self.attributes if not (numeric_only and t == "str")])


@dataclass(frozen=True)
class Relation:
    name: str
    from_type: str
    to_type: str
    attributes: tuple[tuple[str, str], ...] = ()  # after from and to; the first one is ts, whatever its name


def _attributes(fields: list[str], header: str) -> tuple[tuple[str, str], ...]:
    out = []
    for f in fields:
        name, colon, token = f.strip().partition(":")
        if not colon:
            raise ValueError(f"{f!r} of the header {header!r} has no type (name:type)")
        type_of(token.strip())
        out.append((name.strip(), token.strip()))
    return tuple(out)


def parse_node_header(header: str) -> NodeType:
    """``key(type),attr:token,...``"""
    first, *rest = header.split(",")
    kinds = _IN_PARENTHESES.findall(first)
    if len(kinds) != 1:
        raise ValueError(f"the first column of a node header names its type in parentheses: {header!r}")
    return NodeType(kinds[0].strip(), first.split("(")[0].strip(), _attributes(rest, header))


def parse_relation_header(header: str, name: str) -> Relation:
    """``a(from type),b(to type),ts:token,attr:token,...``"""
    kinds = _IN_PARENTHESES.findall(header)
    if len(kinds) != 2:
        raise ValueError(f"a relation header names exactly two types in parentheses: {header!r}")
    fields = header.split(",")
    if len(fields) < 3:
        raise ValueError(f"a relation needs from, to and ts: {header!r}")
    return Relation(name, kinds[0].strip(), kinds[1].strip(), _attributes(fields[2:], header))


@dataclass
class Catalog:
    """Type ordinals are handed out in name order and never change once they are saved; new types are appended."""

    types: dict[str, NodeType] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    ordinals: dict[str, int] = field(default_factory=dict)
    sealed: bool = False

    @classmethod
    def build(cls, nodes: Iterable[NodeType], relations: Iterable[Relation], known: dict[str, int] | None = None) -> Catalog:
        made = cls(ordinals=dict(known or {}))
        for n in nodes:
            made.types[n.name] = n
        for r in relations:
            made.relations[r.name] = r
        ends = {t for r in made.relations.values() for t in (r.from_type, r.to_type)}
        for name in sorted({*made.types, *ends} - {*made.ordinals}):
            made.ordinals[name] = check_ordinal(len(made.ordinals))
            made.types.setdefault(name, NodeType(name, name))
        made.sealed = True
        return made

    def add_type(self, node: NodeType) -> None:
        if self.sealed:
            raise RuntimeError("the catalog is closed; build a new one from more files")
        self.types[node.name] = node
        self.ordinals.setdefault(node.name, check_ordinal(len(self.ordinals)))

    def ordinal(self, node_type: str) -> int:
        if node_type not in self.ordinals:
            raise KeyError(f"unknown node type {node_type!r}; known: {', '.join(sorted(self.ordinals))}")
        return self.ordinals[node_type]

    def type_name(self, ordinal: int) -> str:
        return next(t for t, o in self.ordinals.items() if o == ordinal)

    def type_of_id(self, ident: int) -> str:
        return self.type_name(ident >> TYPE_SHIFT)

    def attribute_names(self, node_type: str, numeric_only: bool = False) -> list[str]:
        return self.types[node_type].schema(numeric_only).names

    def relation_attributes(self, relation: str) -> tuple[tuple[str, str], ...]:
        return self.relations[relation].attributes

    def to_json(self) -> str:
        return json.dumps({"ordinals": self.ordinals, "types": [asdict(t) for t in self.types.values()], "relations": [asdict(r) for r in self.relations.values()]})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        x = json.loads(text)
        pairs = lambda rows: tuple((a, b) for a, b in rows)
        return cls(
            {t["name"]: NodeType(t["name"], t["key"], pairs(t["attributes"])) for t in x["types"]},
            {r["name"]: Relation(r["name"], r["from_type"], r["to_type"], pairs(r["attributes"])) for r in x["relations"]},
            x["ordinals"],
            True,
        )

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls.from_json(spark.read.text(f"{path}/catalog").first()["value"])
