"""Connected components of links between documents.

Tasks first tie what they can among their own links, at most LINKS of them; that settles all links if they are no more.
What spans several tasks is tied by alternating large and small stars, until one task can take the rest or nothing
changes. So no task holds more than a fixed number of links, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, in_arrow, join_hot, materialise

#: Links that one task ties by itself.
LINKS = 1 << 18
#: Kinds of nodes whose order is the same in Python.
_ORDERED = {"binary", "string", "tinyint", "smallint", "int", "bigint"}


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Both ways round, every node's neighbours (large: the greater ones; small: the others and itself) are tied to its least one.

    The least neighbours of hubs are broadcast, so that a hub's links stay where they are.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    total = least.agg(F.sum("n")).first()[0] or 0
    out = join_hot(both.where("v > u") if large else both, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    out = materialise(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    discard(least)
    return out


def _forest(edges: DataFrame, roots: bool) -> DataFrame:
    """Every node of a task's edges with the least one that it reaches among them: u, v; those themselves too, if roots."""

    def tied(of: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        rows = [(x, _root(of, x)) for x in of]
        rows = [r for r in rows if roots or r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = batch.schema.types
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = _root(of, u), _root(of, v)
                of[max(u, v)] = min(u, v)
            if len(of) > 2 * LINKS:
                yield tied(of, kinds)
                of = {}
        if of:
            yield tied(of, kinds)

    kind = dict(edges.dtypes)
    return in_arrow(edges.select("u", "v"), run, f"u {kind['u']}, v {kind['v']}")


def _root(of: dict, x):
    """The least node that x is tied to; the ways there grow shorter."""
    up = of.setdefault(x, x)
    while up != x:
        of[x] = up = of[up]
        x, up = up, of[up]
    return x


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), every node that has any, with the least node that it reaches: node, component. Each is one row.

    Null ends and links of a node to itself tie nothing. The rounds grow with the logarithm of the longest path.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b"))
    alone, before = dict(edges.dtypes)["u"] in _ORDERED, None
    if alone and (n := edges.count()) > LINKS:
        # forests of the tasks' links; at most half of LINKS in each, as partitions differ
        forests = materialise(_forest(edges.coalesce(2 * n // LINKS), False))
        discard(edges)
        edges = forests
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if alone and state[0] <= LINKS:
            return _forest(edges.coalesce(1), True).select(F.col("u").alias("node"), F.col("v").alias("component"))
        if state == before:
            break
        # u > v in every edge, so a small star's neighbours are all that a node has
        tied = _stars(edges, True)
        after = _stars(tied, False)
        discard(edges)
        discard(tied)
        edges, before = after, state
    # stable: every node but a component's least is tied to that one
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
