"""Graph patterns ``(a:Label {key: "value"})-[e:TYPE]->(b:Label)`` compiled to joins.

Chains of any number of hops, single nodes, and ``<-[..]-`` and ``-[..]-`` are read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE = re.compile(r"\(\s*(\w*)((?:\s*:\s*\w+)*)\s*(?:\{([^}]*)\})?\s*\)")
_EDGE = re.compile(r"(<?)-\s*(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*\])?\s*-(>?)")
_PROPERTY = re.compile(r'(\w+)\s*:\s*"([^"]*)"')


def parse(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and the edges between neighbours."""
    nodes, edges, at, text = [], [], 0, text.strip()
    while True:
        m = _NODE.match(text, at)
        if not m:
            raise ValueError(f"a node is missing at {at}: {text!r}")
        nodes.append({"name": m[1] or f"n{len(nodes)}", "labels": re.findall(r"\w+", m[2] or ""), "props": dict(_PROPERTY.findall(m[3] or ""))})
        at = m.end()
        if at == len(text):
            return nodes, edges
        m = _EDGE.match(text, at)
        if not m or (m[1] and m[4]):
            raise ValueError(f"an edge is missing at {at}: {text!r}")
        edges.append({"name": m[2] or f"e{len(edges)}", "type": m[3], "way": "in" if m[1] else "out" if m[4] else "any"})
        at = m.end()


def match(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per binding, with a column of ids for each name.

    nodes: id, labels, props; edges: id, src, dst, type. Node filters come before the joins.
    """
    ns, es = parse(text)

    def node(spec: dict) -> DataFrame:
        tests = [F.array_contains("labels", x) for x in spec["labels"]] + [F.col("props")[k] == v for k, v in spec["props"].items()]
        found = nodes.where(reduce(lambda a, b: a & b, tests)) if tests else nodes
        return found.select(F.col("id").alias(spec["name"]))

    out = node(ns[0])
    for k, e in enumerate(es):
        step = edges.where(F.col("type") == e["type"]) if e["type"] else edges
        a, b = ns[k]["name"], ns[k + 1]["name"]
        ahead = step.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("id").alias(e["name"]))
        back = step.select(F.col("dst").alias(a), F.col("src").alias(b), F.col("id").alias(e["name"]))
        step = {"out": ahead, "in": back, "any": ahead.unionByName(back.where(F.col(a) != F.col(b)))}[e["way"]]
        out = out.join(step, a)
        out = out.join(node(ns[k + 1]), b) if ns[k + 1]["labels"] or ns[k + 1]["props"] or k + 1 == len(es) else out
    return out.select(*[x["name"] for pair in zip(ns, [*es, None], strict=True) for x in pair if x])
