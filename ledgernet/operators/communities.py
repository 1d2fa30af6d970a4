"""Label propagation and community measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.functions.severity import severity_from_isolation
from ledgernet.operators import votes as B
from ledgernet.operators.metrics import both_ends
from ledgernet.operators.numbering import named
from ledgernet.operators.numbering import numbered as _numbered
from ledgernet.sources.workspace import cut_lineage

_ROWS_PER_SPLIT = 1_000_000
_ROWS_PER_PARTITION = 2_000_000


def label_propagation(
    edges: DataFrame,
    nodes: DataFrame,
    max_iter: int = 20,
    self_vote: bool = True,
    weighted: bool = False,
    rows_per_split: int = _ROWS_PER_SPLIT,
    numbers_as_ids: bool = False,
) -> DataFrame:
    """``(node_id, label)`` after synchronous label propagation over undirected edges.

    Every round each node takes the label with most votes among its neighbours, the
    smallest label on a tie. ``nodes(id)`` lists all nodes; one without edges keeps its
    own id as label. Labels stop changing or ``max_iter`` ends the loop.

    The rounds work on numbers, the places of the ids in their order, so that the smallest
    label is the smallest number. The listed edges are partitioned once by (neighbour, split) and kept: a
    round moves only the labels and the counted votes. ``split`` cuts the edges of a hub into pieces
    of about ``rows_per_split`` rows, and the hub's label row is repeated per piece.
    ``numbers_as_ids`` says that the ids are such numbers already; so are the labels then.
    """
    spark = edges.sparkSession
    vote = [F.coalesce(F.col("valor"), F.lit(1.0)).alias("vote")] if weighted else []

    # Only nodes with edges take part in the rounds. A round is one join over all edges;
    # storing its labels, one row per node, keeps plans short and losses cheap.
    ended = [edges.groupBy(F.col(end).alias("node_id")).agg(F.count("*").alias("rows")) for end in ("src", "dst")]
    rows = ended[0].unionByName(ended[1]).where("node_id is not null").groupBy("node_id").agg(F.sum("rows").alias("rows"))
    pieces = F.ceil(F.col("rows") / F.lit(rows_per_split)).cast("int")
    rows = rows.select("node_id", pieces.alias("pieces"), "rows")
    if numbers_as_ids:
        numbers = cut_lineage(rows.withColumn("number", F.col("node_id")))
    else:
        numbers = _numbered(rows, "node_id")
    total, count = numbers.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("number") + 1, F.lit(0))).first()
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(configured, -(-total // _ROWS_PER_PARTITION))

    def number_of(end: str) -> DataFrame:
        return numbers.select(F.col("node_id").alias(end), F.col("number").alias(f"{end}_number")).hint("shuffle_hash")

    carried = ["vote"] if weighted else []
    numbered_edges = edges.select("src", "dst", *vote)
    if numbers_as_ids:
        numbered_edges = numbered_edges.dropna(subset=["src", "dst"])
    else:
        ends = numbered_edges.join(number_of("src"), "src").join(number_of("dst"), "dst")
        numbered_edges = ends.select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"), *carried)
    listed = both_ends(numbered_edges, *carried, near="neighbor_id", far="node_id")
    labels = numbers.select(F.col("number").alias("node_id"), F.col("number").alias("label"), "pieces")

    # At most one hub per ``rows_per_split`` listed edges, so the hubs can be broadcast:
    # the edges move once, already in pieces.
    hubs = labels.where("pieces > 1").select(F.col("node_id").alias("neighbor_id"), "pieces")
    split = F.pmod(F.xxhash64("node_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    ballot = B.Ballot(count, total)
    in_blocks = ballot.fits and not weighted
    if self_vote and in_blocks:
        listed = listed.unionByName(labels.select(F.col("node_id").alias("neighbor_id"), "node_id"))
    wide = [row["neighbor_id"] for row in hubs.collect()]
    if wide:
        listed = listed.join(F.broadcast(hubs), "neighbor_id", "left")
    else:
        split = F.lit(0)
    split_ends = listed.select("neighbor_id", split.alias("split"), "node_id", *carried)
    if in_blocks:
        partitions = max(configured, -(-ballot.blocks // B.BLOCKS_PER_PARTITION))
        placed = B.blocks_of(
            split_ends.withColumn("block", ballot.block_of("neighbor_id", "split")), ballot, partitions
        )
    else:
        placed = split_ends.repartition(partitions, "neighbor_id", "split")
    placed = placed.persist()
    # Votes above, labels below in one number, if they fit.
    bits = count.bit_length()
    if weighted or bits + (total + 1).bit_length() > 62:
        bits = 0
    try:
        for _ in range(max_iter):
            if in_blocks:
                following = cut_lineage(_round_of_blocks(placed, labels, ballot, wide))
            else:
                following = cut_lineage(_round(placed, labels, self_vote, bits))
            settled = following.where("moved").isEmpty()
            labels = following.drop("moved")
            if settled:
                break
    finally:
        placed.unpersist()
    if not numbers_as_ids:
        labels = named(labels, numbers.select("number", F.col("node_id").alias("id")), "label", "node_id")
    own = nodes.select(F.col("id").alias("node_id"))
    return own.join(labels.select("node_id", "label"), "node_id", "left").select(
        "node_id", F.coalesce("label", "node_id").alias("label")
    )


def _sent(labels: DataFrame) -> DataFrame:
    """The label of every node for each piece of its edges."""
    return labels.select(
        F.col("node_id").alias("neighbor_id"),
        "label",
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("split"),
    )


def _moved(labels: DataFrame, best: DataFrame) -> DataFrame:
    """The labels after a round, ``best(node_id, label)``, and whether they differ from those before."""
    old = labels.select("node_id", F.col("label").alias("old"), "pieces")
    return old.join(best, "node_id").select("node_id", "label", "pieces", (F.col("label") != F.col("old")).alias("moved"))


def _round_of_blocks(placed: DataFrame, labels: DataFrame, ballot: B.Ballot, hubs: list[int]) -> DataFrame:
    """Labels after a round over blocks of edges, which hold the nodes' own votes."""
    sent = _sent(labels).select(
        ballot.block_of("neighbor_id", "split").alias("block"), F.col("neighbor_id").alias("node_id"), "label"
    )
    # A hub has a row per bucket, any other node one.
    best = B.best_labels(placed, sent, ballot, hubs).groupBy("node_id").agg(F.max("best").alias("best"))
    return _moved(labels, best.select("node_id", B.label_in(F.col("best"), ballot).alias("label")))


def _round(placed: DataFrame, labels: DataFrame, self_vote: bool, bits: int) -> DataFrame:
    """Labels after a round; those of ``bits`` bits are packed with their votes, none with 0."""
    sent = _sent(labels)
    weighted = "vote" in placed.columns
    vote = F.col("vote") if weighted else F.lit(1).alias("vote")
    votes = placed.join(sent.hint("shuffle_hash"), ["neighbor_id", "split"]).select("node_id", "label", vote)
    if self_vote:
        votes = votes.unionByName(labels.select("node_id", "label", F.lit(1).alias("vote")))
    counted = votes.groupBy("node_id", "label").agg(F.sum("vote").alias("votes"))
    if bits:
        # Spark adds up plain numbers in hash maps, but sorts for structs.
        span = 1 << bits
        packed = F.max(F.col("votes") * span + (span - 1 - F.col("label")))
        label = span - 1 - F.pmod(F.col("best"), F.lit(span))
    else:
        packed = F.min(F.struct((-F.col("votes")).alias("order"), "label"))
        label = F.col("best.label")
    return _moved(labels, counted.groupBy("node_id").agg(packed.alias("best")).select("node_id", label.alias("label")))


def community_profile(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(community, size, node_types)`` of ``labels(node_id, label)``.

    Members stay rows of ``labels``: a community may hold a large part of all nodes.
    """
    typed = labels.join(vertices.select(F.col("id").alias("node_id"), "node_type"), "node_id")
    return typed.groupBy(F.col("label").alias("community")).agg(
        F.count("*").alias("size"), F.sort_array(F.collect_set("node_type")).alias("node_types")
    )


def boundary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(community, internal_edges, external_edges)``: an edge that leaves counts on both sides."""

    def named(end: str, as_: str) -> DataFrame:
        return labels.select(F.col("node_id").alias(end), F.col("label").alias(as_))

    tagged = edges.select("src", "dst").join(named("src", "from"), "src", "left").join(named("dst", "to"), "dst", "left")
    inside = F.coalesce(F.col("from") == F.col("to"), F.lit(False))
    touched = tagged.select(
        inside.alias("inside"),
        F.explode(F.when(inside, F.array("from")).otherwise(F.array("from", "to"))).alias("community"),
    )
    return (
        touched.where("community is not null")
        .groupBy("community")
        .agg(F.count_if("inside").alias("internal_edges"), F.count_if(~F.col("inside")).alias("external_edges"))
    )


def isolation(edges: DataFrame, vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """Profile and isolation of every community.

    Isolation is the share of touching edges that stay inside, 1.0 without any;
    density compares the inside edges with the number of member pairs.
    """
    joined = community_profile(labels, vertices).join(boundary(edges, labels), "community", "left")
    full = joined.fillna(0, ["internal_edges", "external_edges"])
    touching = F.col("internal_edges") + F.col("external_edges")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    score = F.when(touching > 0, 1 - F.col("external_edges") / touching).otherwise(F.lit(1.0))
    return full.select(
        "community",
        "size",
        "node_types",
        score.alias("isolation_score"),
        "internal_edges",
        "external_edges",
        F.when(pairs > 0, F.col("internal_edges") / pairs).otherwise(F.lit(0.0)).alias("edge_density"),
        severity_from_isolation(score).alias("severity"),
    )
