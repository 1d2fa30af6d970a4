"""Near-duplicate vectors, found with an inverted multi-index and verified by cosine."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.columns import field
from ledgernet.llm.components import components
from ledgernet.llm.shared import handed_out, kept, received


@dataclass
class Index:
    """Two codebooks, for the first and the second half of unit vectors, and how many cells a search visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all codewords of either half; a row's do not depend on the rows beside it."""
        out = []
        for part, book in ((unit[:, : self.half], self.left), (unit[:, self.half :], self.right)):
            made = np.empty((len(unit), len(book)))
            for k, word in enumerate(book):
                made[:, k] = np.square(part - word).sum(axis=1)
            out.append(made)
        return out[0], out[1]

    def cells(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(axis=1) * len(self.right) + d2.argmin(axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.square(vectors).sum(axis=1, keepdims=True))


def nearest_cells(d1: np.ndarray, d2: np.ndarray, visits: int) -> tuple[list[int], float]:
    """Multi-sequence traversal: cells of the grid by rising sum of distances, and the last sum.

    Both lists of codewords are sorted; from each cell that is taken, its two successors
    enter the queue. Cells as far as the last one are taken too.
    """
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    x, y = d1[a].tolist(), d2[b].tolist()
    queue, entered, taken, last = [(x[0] + y[0], 0, 0)], {(0, 0)}, [], -math.inf
    while queue:
        total, i, j = heapq.heappop(queue)
        if len(taken) >= visits and total > last:
            break
        taken.append(int(a[i]) * len(y) + int(b[j]))
        last = total
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in entered:
                entered.add((p, q))
                heapq.heappush(queue, (x[p] + y[q], p, q))
    return taken, last


def codebook(points: np.ndarray, size: int, random: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means codewords of one half."""
    book = points[random.choice(len(points), min(size, len(points)), replace=False)].copy()
    for _ in range(rounds):
        gap = np.square(points).sum(axis=1)[:, None] - 2 * points @ book.T + np.square(book).sum(axis=1)
        nearest = gap.argmin(axis=1)
        for k in range(len(book)):
            own = points[nearest == k]
            if len(own):
                book[k] = own.mean(axis=0)
    return book


def build_index(sample: np.ndarray, n: int, cosine: float, recall: float, per_cell: int, seed: int) -> Index:
    """Fit the codebooks for ``n`` vectors and find how many cells a search has to visit.

    To each of up to 2,000 sampled vectors a partner is made at just the threshold, in a
    random direction; the cells visited are as many as bring ``recall`` of the partners' cells.
    """
    random = np.random.default_rng(seed)
    unit = unit_rows(sample)
    half = (unit.shape[1] + 1) // 2
    size = max(1, round(math.sqrt(n / per_cell)))
    index = Index(codebook(unit[:, :half], size, random), codebook(unit[:, half:], size, random), 1)
    some = unit[random.choice(len(unit), min(2000, len(unit)), replace=False)]
    aside = random.normal(size=some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    norm = np.sqrt(np.square(aside).sum(axis=1, keepdims=True))
    partner = cosine * some + math.sqrt(1 - cosine * cosine) * aside / np.maximum(norm, 1e-12)
    d1, d2 = index.distances(some)
    e1, e2 = index.distances(partner)
    sums = d1[:, :, None] + d2[:, None, :] if size <= 64 else None
    ranks = []
    for i, cell in enumerate(index.cells(e1, e2).tolist()):
        if sums is not None:
            ranks.append(int((sums[i] <= sums[i].ravel()[cell]).sum()))
        else:
            ranks.append(nearest_cells(d1[i], d2[i], len(index.left) * len(index.right))[0].index(cell) + 1)
    index.visits = int(np.quantile(ranks, recall, method="higher"))
    return index


def settle(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and each column of a matrix of links reaches inside it."""
    while True:
        low = np.where(linked, columns[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new_rows = np.minimum(rows, low)
        low = np.where(linked, new_rows[:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
        new_columns = np.minimum(columns, low)
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def near_vectors(
    df: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.95,
    recall: float = 0.999,
    per_cell: int = 500,
    sampled: int = 20_000,
    member_block: int = 2048,
    visitor_block: int = 4096,
    seed: int = 3,
) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors are linked if their cosine, in double precision, is ``cosine`` or more;
    ``component_id`` is the smallest id that links reach, and ``kept`` tells whether it is
    the vector's own.

    1. Equal vectors become one node with a count. Codebooks for both halves of unit
       vectors are fitted on ``sampled`` nodes, in hash order; every node goes to its cell.
    2. Every node visits its nearest cells by multi-sequence traversal, as many as bring
       ``recall`` of partners that lie just at the threshold. A pair is compared if one of
       the two visits the other's cell, so pairs closer than that are hardly ever missed.
    3. Members and visitors of a cell meet in blocks of bounded size, each in a group of its
       own, as one matrix product. A block returns for each node how many links it found
       and the smallest node it reaches there, not the pairs; a pair that both sides find
       is counted once for either.

    Vectors that are null, empty, zero, hold null or non-finite components, or have another
    length than most, link with nothing. A null id is kept and takes part, but a component
    without any other id has none. Repeated rows count as different vectors. Extra columns
    are not read.
    """
    own_id = id + "_" if id in ("n_links", "component_id", "kept") else id
    given = df.select(field(df, id).cast("long").alias("id"), field(df, vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    fine = F.coalesce(~bad & (square > 0) & (square < float("inf")), F.lit(False))
    lengths = given.where(fine).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return given.select(
            F.col("id").alias(own_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    fine = fine & (F.size("v") == lengths["n"])
    nodes = kept(
        given.where(fine)
        .groupBy("v")
        .agg(F.min("id").alias("low"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    n = nodes.count()
    taken = nodes.select("v").orderBy(F.xxhash64(F.lit(seed), "v")).limit(sampled).toArrow()["v"]
    sample = np.array(taken.to_pylist(), float)
    index = handed_out(df.sparkSession, build_index(sample, n, cosine, recall, per_cell, seed))

    def place(batches):
        book = received(index)
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float).reshape(len(batch), lengths["n"])
            d1, d2 = book.distances(unit_rows(x))
            visits, last = zip(*(nearest_cells(a, b, book.visits) for a, b in zip(d1, d2)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("copies"),
                    pa.array([row.tobytes() for row in x], pa.binary()),
                    pa.array(last, pa.float64()),
                    pa.array(book.cells(d1, d2), pa.int64()),
                    pa.array(visits, pa.list_(pa.int64())),
                ],
                ["node", "copies", "x", "last", "cell", "visits"],
            )

    placed = kept(
        nodes.select("node", "copies", "v").mapInArrow(
            place, "node long, copies long, x binary, last double, cell long, visits array<long>"
        ),
        "placed",
    )
    body = ["node", "copies", "x", "last"]
    members = placed.select("cell", *body, F.lit(True).alias("member"))
    visitors = placed.select(F.explode("visits").alias("cell"), *body, F.lit(False).alias("member"))
    n_members = members.groupBy("cell").agg(F.ceil(F.count("*") / member_block).alias("m"))
    n_visitors = visitors.groupBy("cell").agg(F.ceil(F.count("*") / visitor_block).alias("k"))
    blocks = n_members.join(n_visitors, "cell")

    def dealt(rows: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        """Rows in a block of their own side, once for each block of the other side."""
        return rows.join(blocks, "cell").select(
            "cell",
            F.pmod(F.xxhash64("node"), F.col(count)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(other),
            *body,
            "member",
        )

    def compare(table: pa.Table) -> pa.Table:
        book = received(index)
        member = table["member"].to_numpy()
        node, copies, last = (table[c].to_numpy() for c in ("node", "copies", "last"))
        x = unit_rows(np.frombuffer(b"".join(table["x"].to_pylist()), float).reshape(len(node), -1))
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        linked = x[q] @ x[m].T >= cosine
        linked &= node[q][:, None] != node[m][None, :]
        a, b = linked.any(axis=1), linked.any(axis=0)
        q, m, linked = q[a], m[b], linked[a][:, b]
        if not len(q):
            none = np.empty(0, np.int64)
            return pa.table({"node": none, "n": none, "low": none})
        # A member that visits the visitor's cell finds the link there itself.
        d1, d2 = book.distances(x[m])
        cell = book.cells(*book.distances(x[q]))
        far = len(book.right)
        finds = (d1[:, cell // far] + d2[:, cell % far] <= last[m][:, None]).T
        of_q = linked.astype(np.int64) @ copies[m]
        of_m = copies[q] @ (linked & ~finds).astype(np.int64)
        low_q, low_m = settle(linked, node[q], node[m])
        return pa.table(
            {"node": np.concatenate((node[q], node[m])), "n": np.concatenate((of_q, of_m)), "low": np.concatenate((low_q, low_m))}
        )

    met = dealt(members, "mb", "m", "vb", "k").unionByName(dealt(visitors, "vb", "k", "mb", "m"))
    found = kept(met.groupBy("cell", "mb", "vb").applyInArrow(compare, "node long, n long, low long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "node")
    owned = (
        nodes.select("v", "node", "low", "copies")
        .join(counts, "node", "left")
        .join(reached, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    lowest = owned.groupBy("component").agg(F.min("low").alias("component_id"))
    told = owned.join(lowest, "component").select(
        "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    alone = given.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (
        given.where(fine)
        .join(told, "v")
        .select("id", "n_links", "component_id")
        .unionByName(alone)
        .select(
            F.col("id").alias(own_id),
            "n_links",
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
        )
    )
