"""Near-duplicate texts: SuperMinHash signatures, banding, verification on whole sets, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.columns import field
from ledgernet.llm.components import components
from ledgernet.llm.shared import kept
from ledgernet.llm.words import frugal, hashes, mix, pieces, words

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD1342543DE82EF95)


def shingle_sets(text: pa.Array, size: int):
    """For each row its distinct shingles as sorted 64-bit hashes.

    A shingle is ``size`` consecutive words; fewer words form one shingle of their own
    length, no words none.
    """
    distinct, codes, bounds = words(text)
    word = hashes(distinct)[codes]
    n = len(word)
    hashed = np.zeros(n, np.uint64)
    for i in range(size):
        # Words beyond the end only enter shingles that no row uses.
        hashed[: n - i] = mix(hashed[: n - i] * _TURN + word[i:])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(hashed[a : b - size + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for i in range(a, b):
                one = mix(one * _TURN + word[i : i + 1])
            yield one
        else:
            yield hashed[:0]


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a non-empty set, as ``m`` 32-bit values.

    Every element draws a random permutation of the m components and a fraction for each
    rank; its value at a component is rank + fraction, and the signature holds the least
    value of each component. Rank after rank is drawn for all elements at once by
    Fisher-Yates steps, and drawing stops as soon as every component holds a value below
    the next rank: no later rank could lower any.
    """
    n = len(elements)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    places = None
    first = None
    for rank in range(m):
        if int(least.max()) >> 32 < rank:
            break
        draw = mix(elements + np.array([rank + 1], np.uint64) * _STEP)
        # The upper half picks the component, the lower half is the fraction.
        pick = rank + ((draw >> np.uint64(32)) * np.uint64(m - rank) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(rank) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        if rank == 0:
            component = first = pick
        else:
            rows = np.arange(n)
            if places is None:
                places = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                places[rows, first] = 0
                places[:, 0] = first
            component = places[rows, pick]
            places[rows, pick] = places[:, rank]
        np.minimum.at(least, component, value)
    mixed = mix(least + _STEP)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    parts = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) + _STEP
    for i in range(rows):
        key = mix(key * _TURN + parts[:, i])
    return key.view(np.int64)


SIGNED = "n_shingles long, f1 long, f2 long, signature binary, bands array<long>"


def signatures(docs: DataFrame, size: int, m: int, bands: int, rows: int) -> DataFrame:
    """``id`` and ``twin`` of (id, twin, text), with the set's size and fingerprint, signature and band keys.

    Band keys come from whole values; for estimates a byte of each value is kept, in which
    two different values agree once in 256 cases.
    """

    def run(batches):
        for batch in (b for big in batches for b in pieces([big], "text", 4 << 20)):
            out = []
            for found in shingle_sets(batch.column("text"), size):
                if not len(found):
                    out.append((0, 0, 0, None, None))
                    continue
                signature = super_minhash(found, m)
                f1 = int(np.add.reduce(mix(found)).view(np.int64))
                f2 = int(np.add.reduce(mix(found ^ _TURN)).view(np.int64))
                keys = band_keys(signature, bands, rows)
                out.append((len(found), f1, f2, signature.astype(np.uint8).tobytes(), keys))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            made = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("twin"), *made],
                ["id", "twin", "n_shingles", "f1", "f2", "signature", "bands"],
            )

    return docs.select("id", "twin", "text").mapInArrow(frugal(run), f"id long, twin long, {SIGNED}")


def groups(batches, keys: list[str]):
    """Whole groups of rows that follow each other, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Groups:
    """Union-find over the rows of one group."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]

    def others(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Those of the rows that are not yet connected with row ``i``."""
        return rows[self.label[rows] != self.label[i]]

    def join(self, i: int, found: np.ndarray) -> np.ndarray:
        """Connect the rows with row ``i``; returns one row of each group that was not before."""
        labels, first = np.unique(self.label[found], return_index=True)
        first = first[labels != self.label[i]]
        self.label[np.isin(self.label, labels)] = self.label[i]
        return found[first]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _bytes(table: pa.Table, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(table), m)


def _near(i: int, rows: np.ndarray, count: np.ndarray, signature: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Rows whose size and signature leave it possible that they are linked with row ``i``."""
    rows = rows[np.minimum(count[rows], count[i]) * 100 >= percent * np.maximum(count[rows], count[i])]
    return rows[(signature[rows] == signature[i]).mean(axis=1) >= least] if len(rows) else rows


def _edges(a: list, b: list) -> pa.RecordBatch:
    empty = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (a, b)], ["a", "b"])


def alike(members: DataFrame, m: int, percent: int, least: float, block: int) -> DataFrame:
    """Links that connect, in every bucket, the members whose signatures agree in a share of ``least``.

    ``members``: ``key``, ``node``, ``n_shingles``, ``signature``, ``size`` (of the bucket). A bucket
    gives fewer links than it has members, not its pairs. Buckets of more than ``block``
    members are compared block by block, each pair of blocks in a group of its own.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n_shingles", "signature")
    )
    keys = ["key", "low", "high"]

    def run(batches):
        for table in groups(batches, keys):
            node, count, signature = _numbers(table, "node"), _numbers(table, "n_shingles"), _bytes(table, m)
            known, a, b = Groups(node), [], []
            for i in range(len(node) - 1):
                rows = known.others(i, np.arange(i + 1, len(node)))
                found = known.join(i, _near(i, rows, count, signature, percent, least))
                a.append(np.full(len(found), node[i]))
                b.append(node[found])
            yield _edges(a, b)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(run), "a long, b long")


def linked(i: int, rows: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Those of the rows whose whole sets are similar enough to that of row ``i``."""
    if not len(rows):
        return rows
    sizes = np.array([len(sets[r]) for r in rows.tolist()])
    flat = np.concatenate([sets[r] for r in rows.tolist()])
    own = sets[i]
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return rows[100 * common >= percent * (len(own) + sizes - common)]


def verified(rows: DataFrame, keys: list[str], size: int, m: int, percent: int, least: float) -> DataFrame:
    """Links of similarity ``percent`` or more, on whole sets, that connect the rows of each group.

    ``rows``: the ``keys`` of the group, ``node``, ``label`` (equal for rows known to be connected),
    ``asks``, ``n_shingles``, ``signature`` and ``text``. A row that asks is compared with all rows of
    its group that it is not connected with yet and whose signature does not rule it out.
    """

    def run(batches):
        for table in groups(batches, keys):
            node, count, signature = _numbers(table, "node"), _numbers(table, "n_shingles"), _bytes(table, m)
            sets = [s for t in table["text"].chunks for b in pieces([pa.record_batch([t], ["text"])], "text", 4 << 20) for s in shingle_sets(b.column(0), size)]
            asks = np.flatnonzero(table["asks"].to_numpy())
            waiting = np.ones(len(node), bool)
            known, a, b = Groups(_numbers(table, "label")), [], []
            for i in asks.tolist():
                waiting[i] = False
                # Rows that have asked are done with; those that never ask stay to be compared.
                others = known.others(i, np.flatnonzero(waiting))
                found = known.join(i, linked(i, _near(i, others, count, signature, percent, least), sets, percent))
                a.append(np.full(len(found), node[i]))
                b.append(node[found])
            yield _edges(a, b)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInArrow(frugal(run), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    m: int = 128,
    bands: int = 25,
    rows: int = 5,
    least: float = 0.62,
    block: int = 1024,
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id``, ``kept`` and ``text_hash`` (xxhash64).

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles; a component is what links reach, named by its smallest id, and
    the document with that id is kept.

    1. Every text gets a SuperMinHash signature of ``m`` values. Equal sets (size and a
       128-bit fingerprint) are one node from here on: copies cost a partial aggregate.
    2. ``bands`` bands of ``rows`` values give candidate buckets; a pair at the threshold meets
       with a probability of 1 - (1 - 0.8^5)^25 = 0.99995. Members whose signatures agree in
       ``least`` of their values (0.8 minus five standard deviations) hang together.
    3. What hangs together is verified on the whole sets of its texts, which travel once:
       a row asks all rows that it is not yet connected with. Large groups are cut into
       blocks of ``block`` rows; the group's smallest node asks every block, and rows that
       it does not reach then ask all blocks. So no pair is left out but those already
       connected, and groups return links that connect them, not their pairs.

    ids are integers. Empty and null texts have no shingles and link with nothing. Rows
    with a null id link with nothing, have a null component and are kept. Repeated rows are
    copies of one another and are all returned; rows of one id with different texts are
    different documents of that id. Extra columns are not read.
    """
    given = docs.select(field(docs, id).cast("long").alias("id"), field(docs, text).cast("string").alias("text"))
    given = given.withColumn("twin", F.xxhash64("text"))
    signed = kept(signatures(given, size, m, bands, rows), "signatures")
    same_set = ["n_shingles", "f1", "f2"]
    known = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    sets = kept(
        known.groupBy(*same_set)
        .agg(F.min(F.struct("id", "twin")).alias("doc"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "sets",
    )
    banded = sets.select(F.explode("bands").alias("key"), "node")
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    traits = sets.select("node", "n_shingles", "signature")
    members = banded.join(buckets, "key").join(traits, "node")
    coarse = components(alike(members, m, percent, least, block))

    sizes = coarse.groupBy("component").agg(F.count("*").alias("size"))
    owned = sets.select("node", "n_shingles", "signature", "doc.id", "doc.twin")
    placed = kept(
        coarse.withColumnRenamed("id", "node")
        .join(sizes, "component")
        .join(owned, "node")
        .withColumn("blocks", F.ceil(F.col("size") / block))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))),
        "placed",
    )

    def with_text(rows: DataFrame) -> DataFrame:
        """Rows of ``placed``, or a part of them, with the text of their set: one document of the id and hash."""
        # How many documents have candidates is open, so this is a merge join at every size.
        wanted = placed.select("id", "twin", "node").hint("merge")
        texts = given.join(wanted, ["id", "twin"]).groupBy("node").agg(F.first("text").alias("text"))
        return rows.join(texts, "node")

    body = ["component", "node", "n_shingles", "signature"]
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    one = with_text(placed)
    # The smallest node goes to every block, and is the first to ask.
    leads = F.col("node") == F.col("component")
    first = one.withColumn("block", F.explode(F.when(leads, every).otherwise(F.array("own"))))
    first = first.select(
        *body, "text", "block", F.col("node").alias("label"), F.lit(True).alias("asks"), F.when(leads, 0).otherwise(1).alias("rank")
    )
    links = kept(verified(first, ["component", "block"], size, m, percent, least), "verified")
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        reached = components(links).select(F.col("id").alias("node"), F.col("component").alias("label"))
        labelled = kept(
            large.join(reached, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled"
        )
        main = labelled.where(leads).select("component", F.col("label").alias("main"))
        apart = labelled.join(main, "component").where("label != main").drop("main")
        asking = apart.groupBy("component").agg(F.ceil(F.count("*") / block).alias("parts"))
        # Rows apart ask in parts of their own, each against every block.
        kinds = [
            apart.join(asking, "component").select(
                *body, "label", F.explode(every).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), "parts").alias("part"),
                F.lit(True).alias("asks"),
            ),
            labelled.join(asking, "component").select(
                *body, "label", F.col("own").alias("block"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"),
            ),
        ]
        second = with_text(kinds[0].unionByName(kinds[1])).withColumn("rank", F.lit(0))
        links = kept(
            links.unionByName(verified(second, ["component", "block", "part"], size, m, percent, least)), "verified"
        )

    reached = components(links).withColumnRenamed("id", "node")
    named = sets.select(*same_set, "node", F.col("doc.id").alias("low")).join(reached, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select(*same_set, "component_id")
    known = known.select("id", "twin", *same_set).join(named, same_set).select("id", "twin", "n_shingles", "component_id")
    alone = signed.where(F.col("id").isNull() | (F.col("n_shingles") == 0)).select(
        "id", "twin", "n_shingles", F.col("id").alias("component_id")
    )
    return known.unionByName(alone).select(
        F.col("id").alias(id + "_" if id in ("n_shingles", "component_id", "kept", "text_hash") else id),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
        F.col("twin").alias("text_hash"),
    )
