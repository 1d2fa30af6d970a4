"""Votes of label propagation, counted a block of edges at a time.

A block is a row: the edges of some of the nodes that vote, as sorted numbers. In a round the
labels of these nodes meet it, and its votes go on, added up, to the buckets of the nodes they
are for; Spark deals out blocks, labels and buckets. Functions that run in Python workers
travel by value, so the workers need not have the package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Listed edges of a block, on average, and votes of a bucket at most on average.
EDGES_PER_BLOCK = 1_000_000
#: Blocks of a stored partition at most on average.
BLOCKS_PER_PARTITION = 8

_BLOCK = "block int, sources binary, degrees binary, targets binary"
_VOTES = "bucket int, keys binary, votes binary"
_BEST = "node_id long, best long"


class Ballot:
    """How nodes and labels below ``count`` are written as one number.

    The buckets take the nodes in turn. The place of a node is its bucket and its turn in it, so
    that keys, a place above a label, are in the order of their buckets.
    """

    def __init__(self, count: int, total: int, edges_per_block: int = EDGES_PER_BLOCK):
        self.blocks = max(1, -(-total // edges_per_block))
        self.width = max(1, -(-count // self.blocks))
        self.bits = max(1, count.bit_length())
        self.places = self.width * self.blocks
        self.place_bits = self.places.bit_length()
        self.fits = self.place_bits + self.bits <= 62 and self.bits + (total + count).bit_length() <= 62

    def place(self, node):
        return node % self.blocks * self.width + node // self.blocks

    def place_of(self, node: str):
        blocks = F.lit(self.blocks).cast("long")
        return F.col(node) % blocks * F.lit(self.width).cast("long") + F.expr(f"{node} div {self.blocks}L")

    def node(self, place):
        return place % self.width * self.blocks + place // self.width

    def block_of(self, node: str, split: str):
        return F.pmod(F.xxhash64(node, split), F.lit(self.blocks)).cast("int")


def _table(schema: str, *columns) -> pa.Table:
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column) if len(column) else np.empty(0, np.int64)


def _starts(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(column), 1), bool), column[1:] != column[:-1]]))


def blocks_of(listed: DataFrame, ballot: Ballot, partitions: int) -> DataFrame:
    """The edges ``listed(block, neighbor_id, node_id)`` as a row per block, dealt out by block.

    An edge travels as one number, the node that votes above the place it votes for, to the
    partition that is its block: sorted, these numbers are the block. They reach Python as one
    array, which costs half as much as row by row.
    """
    bits = ballot.place_bits

    def packed(batches):
        for batch in batches:
            for block, listing in zip(batch["block"], batch["edges"]):
                edges = np.sort(_numbers(listing.values))
                sources = edges >> bits
                first = _starts(sources)
                arrays = (sources[first], np.diff(np.append(first, len(sources))), edges & ((1 << bits) - 1))
                made = _table(_BLOCK, [block.as_py()], *[[x.astype(np.int64, copy=False).tobytes()] for x in arrays])
                yield from made.to_batches()

    edge = F.shiftleft(F.col("neighbor_id"), bits).bitwiseOR(ballot.place_of("node_id")).alias("edge")
    ends = listed.select("block", edge).repartitionById(ballot.blocks, F.col("block"))
    ends = ends.groupBy("block").agg(F.collect_list("edge").alias("edges"))
    return ends.mapInArrow(packed, _BLOCK).repartition(partitions, "block")


def best_labels(blocks: DataFrame, labels: DataFrame, ballot: Ballot, hubs: list[int]) -> DataFrame:
    """``(node_id, best)`` of a round: most votes above the smallest label, in one number, see ``label_in``.

    ``labels(block, node_id, label)`` are those of the nodes that vote in a block. Votes for the
    nodes ``hubs`` are dealt to the buckets by their label, so these have a row per bucket.
    """
    wide = np.sort(ballot.place(np.array(hubs, np.int64)))
    bits, mask = ballot.bits, (1 << ballot.bits) - 1

    def summed(keys: np.ndarray, votes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if votes is None:
            keys = np.sort(keys)
        else:
            order = np.argsort(keys, kind="stable")  # Merges the sorted keys of the blocks.
            keys, votes = keys[order], votes[order]
        starts = _starts(keys)
        if votes is None:
            return keys[starts], np.diff(np.append(starts, len(keys)))
        return keys[starts], np.add.reduceat(votes, starts) if len(starts) else votes

    def cast(edges, given):
        if not edges.num_rows:
            return _table(_VOTES, [], [], [])
        sources, degrees, targets = (np.frombuffer(edges[c][0].as_buffer(), np.int64) for c in ("sources", "degrees", "targets"))
        nodes, named = _numbers(given["node_id"]), _numbers(given["label"])
        order = np.argsort(nodes)
        of_source = named[order][np.searchsorted(nodes[order], sources)]
        keys, votes = summed((targets << bits) | np.repeat(of_source, degrees))
        parts = [(keys, votes, (keys >> bits) // ballot.width)]
        if len(wide):
            at = np.isin(keys >> bits, wide)
            dealt = (keys[at] & mask) % ballot.blocks
            order = np.argsort(dealt, kind="stable")
            parts = [tuple(a[~at] for a in parts[0]), (keys[at][order], votes[at][order], dealt[order])]
        out = []
        for keys, votes, bucket in parts:
            starts = _starts(bucket)
            for a, b in zip(starts, np.append(starts[1:], len(bucket))):
                out.append((int(bucket[a]), keys[a:b].tobytes(), votes[a:b].astype(np.int64).tobytes()))
        return _table(_VOTES, *(zip(*out) if out else ([], [], [])))

    def counted(parts):
        def joined(name: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for c in parts[name].chunks for v in c])

        keys, votes = summed(joined("keys"), joined("votes"))
        place = keys >> bits
        starts = _starts(place)
        best = np.maximum.reduceat((votes << bits) | (mask - (keys & mask)), starts)
        return _table(_BEST, ballot.node(place[starts]), best)

    cast_votes = blocks.groupBy("block").cogroup(labels.groupBy("block")).applyInArrow(cast, _VOTES)
    return cast_votes.groupBy("bucket").applyInArrow(counted, _BEST)


def label_in(best, ballot: Ballot):
    """The label of the largest ``best`` of a node."""
    mask = (1 << ballot.bits) - 1
    return F.lit(mask) - best.bitwiseAND(F.lit(mask))
