"""Text quality: Bradley-Terry scores learned from preference pairs, cut at a quantile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.shared import handed_out, kept, received
from ledgernet.llm.words import frugal, give_back, pieces, words
from ledgernet.operators.selection import exact_median, order_statistics

#: Texts that are paired among each other, and how many of the rarer class are among them at least, about.
BUCKET, PARTNERS = 2000, 50
#: Tasks that add up the slopes of a step; each sends a megabyte.
TASKS = 48

FEATURES = [
    "log_words", "word_length", "upper", "digit", "symbol", "bar", "beyond_ascii", "blank", "breaks",
    "distinct", "richness", "repeats", "commonest", "bare", "doubled",
]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(text: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, all of them zero for a text without words."""
    distinct, codes, bounds = words(text, lower=False)
    n_texts, n_words = len(bounds) - 1, np.diff(bounds).astype(float)
    owner = np.repeat(np.arange(n_texts), np.diff(bounds))
    raw = pa.concat_arrays([pc.fill_null(text, "").cast(pa.large_binary())])
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n_texts + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)

    def summed(flags: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each text."""
        out = np.zeros(n_texts)
        full = np.diff(offsets) > 0
        if full.any():
            out[full] = np.add.reduceat(flags[: offsets[-1]].astype(np.int64), offsets[:-1][full])
        return out

    size = np.maximum(np.diff(offsets).astype(float), 1)
    per = lambda x: x / np.maximum(n_words, 1)
    count = lambda flags: np.bincount(owner, flags, n_texts)
    symbol_of = pc.count_substring_regex(distinct, r"[!-/:-@\[-`{-~]").to_numpy(zero_copy_only=False)
    bare_of = pc.match_substring_regex(distinct, r"^[!-/:-@\[-`{-~]+$").to_numpy(zero_copy_only=False)
    pair = owner * np.int64(len(distinct) + 1) + codes
    kinds, times = np.unique(pair, return_counts=True)
    kind_owner = kinds // (len(distinct) + 1)
    n_kinds = np.bincount(kind_owner, minlength=n_texts).astype(float)
    most = np.zeros(n_texts)
    np.maximum.at(most, kind_owner, times)
    again = np.concatenate(([False], pair[1:] == pair[:-1])) if len(pair) else np.zeros(0, bool)
    columns = [
        np.log1p(n_words),
        per(size - summed(_BLANK[data])),
        summed(_UPPER[data]) / size,
        summed(_DIGIT[data]) / size,
        summed(_SYMBOL[data]) / size,
        summed(data == 124) / size,
        summed(data >= 128) / size,
        summed(_BLANK[data]) / size,
        per(summed(data == 10)),
        per(n_kinds),
        np.log1p(n_kinds) / np.maximum(np.log1p(n_words), 1e-9),
        per(count(again)),
        per(most) * np.minimum(n_words, 50) / 50,
        per(count(bare_of[codes])),
        per(count(symbol_of[codes] >= 2)),
    ]
    return np.where(n_words[:, None] > 0, np.stack(columns, axis=1), 0.0)


@dataclass
class Model:
    """Edges of the bins of each feature, one weight per bin, and the cut."""

    edges: list[np.ndarray]
    weights: np.ndarray
    cut: float
    scale: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Strengths of texts: differences of them are log odds of being preferred."""
        return spread(values, self.edges) @ self.weights

    def shares(self, values: np.ndarray) -> np.ndarray:
        """Strengths as numbers from 0 to 1, 0.5 at the cut."""
        return 1 / (1 + np.exp(-np.clip((self.scores(values) - self.cut) / self.scale, -50, 50)))


def spread(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Each feature as steps: one 0/1 number per edge that it exceeds, and the place between the outermost."""
    out = []
    for i, edge in enumerate(edges):
        out.append(values[:, i, None] > edge[None, :])
        low, high = edge[0], edge[-1]
        out.append(np.clip((values[:, i, None] - low) / max(high - low, 1e-9), 0, 1))
    return np.concatenate(out, axis=1).astype(float)


def preferences(rows: DataFrame, counts: dict[int, int], seed: int = 5) -> DataFrame:
    """``(better, worse)``: features of texts of label 1 and 0, every text in one pair at least.

    Texts meet within buckets of about ``BUCKET`` by hash. The rarer class is put into as many
    buckets as it takes to have some ``PARTNERS`` in each, and its texts take part again
    until all of the other class have a partner.
    """
    buckets = -(-(counts[0] + counts[1]) // BUCKET)
    rare = int(counts[1] < counts[0])
    copies = min(buckets, -(-buckets * PARTNERS // counts[rare]))
    times = F.when(F.col("label") == rare, F.lit(copies)).otherwise(F.lit(1))
    shift = F.explode(F.sequence(F.lit(0), times - 1))
    dealt = rows.select("*", shift.alias("shift")).withColumn("bucket", F.pmod(F.col("mark") + F.col("shift"), F.lit(buckets)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mark", "ascending")])
        good = table["label"].to_numpy()
        better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
        most = max(len(better), len(worse)) if len(better) and len(worse) else 0
        random = np.random.default_rng([seed, table["bucket"][0].as_py()])

        def often(some: np.ndarray) -> np.ndarray:
            return np.concatenate([random.permutation(some) for _ in range(-(-most // len(some)))])[:most]

        b, c = (often(better), often(worse)) if most else (better[:0], worse[:0])
        return pa.table({"better": table["features"].take(b), "worse": table["features"].take(c)})

    return dealt.groupBy("bucket").applyInArrow(run, "better array<double>, worse array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    """The features of a column, a row each."""
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def _slopes(pairs: DataFrame, edges: list[np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood of all pairs; each task sends one sum."""
    size, (rows, columns) = len(w), np.triu_indices(len(w))

    def run(batches):
        gradient, curvature = np.zeros(size), np.zeros((size, size), np.float32)
        for batch in batches:
            better, worse = _matrix(batch.column("better")), _matrix(batch.column("worse"))
            for at in range(0, len(better), 2000):
                part = slice(at, at + 2000)
                d = (spread(better[part], edges) - spread(worse[part], edges)).astype(np.float32)
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                gradient += d.T @ p
                curvature += (d * (p * (1 - p)).astype(np.float32)[:, None]).T @ d
        upper = curvature[np.triu_indices(size)]
        yield pa.record_batch([pa.array([gradient.tobytes()]), pa.array([upper.tobytes()])], ["gradient", "curvature"])

    gradient, curvature = np.zeros(size), np.zeros((size, size))
    for row in pairs.mapInArrow(frugal(run), "gradient binary, curvature binary").collect():
        gradient += np.frombuffer(row["gradient"])
        curvature[rows, columns] += np.frombuffer(row["curvature"], np.float32)
    return gradient, curvature + np.triu(curvature, 1).T


def train(rows: DataFrame, *, pairs: int = 40_000, bins: int = 24, ridge: float = 3.0, seed: int = 5) -> Model:
    """Bradley-Terry by Newton steps on logistic loss over differences of preferred and other texts.

    ``rows`` is ``(mark, label, features)``, stored; all of them take part in every step, in
    Spark tasks that send sums. All pairs together weigh as much as ``pairs`` against the
    ridge. The edges are quantiles of all rows of a class, by sketches of one part in 10,000.
    The cut is the score quantile at the share of label 0.
    """
    counts = {0: 0, 1: 0, **dict(rows.groupBy("label").count().collect())}
    n = counts[0] + counts[1]
    shares = np.linspace(0, 1, bins + 1)[1:-1].tolist()
    marks = [F.percentile_approx(F.col("features")[i], shares, F.lit(10_000)) for i in range(len(FEATURES))]
    of_class = rows.groupBy("label").agg(*marks).collect()
    edges = [np.unique(np.concatenate([r[1 + i] for r in of_class])) if of_class else np.zeros(1) for i in range(len(FEATURES))]
    w = np.zeros(spread(np.zeros((1, len(FEATURES))), edges).shape[1])
    if counts[0] and counts[1]:
        pairing = kept(preferences(rows, counts, seed), "preferences").coalesce(TASKS)
        each = pairs / pairing.count()
        for _ in range(15):
            gradient, curvature = _slopes(pairing, edges, w)
            step = np.linalg.solve(each * curvature + ridge * np.eye(len(w)), each * gradient - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-3:
                break
    if not n:
        return Model(edges, w, 0.0, 1 / 3)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(spread(_matrix(batch.column("features")), edges) @ w)], ["score"])

    scores = kept(rows.select("features").mapInArrow(frugal(run), "score double").select(F.lit(0).alias("g"), "score"), "scores")
    at = min(counts[0], n - 1)
    found = order_statistics(scores, "g", "score", {"low": lambda n: max(at, 1), "high": lambda n: at + 1}).first()
    cut = (found["low"] + found["high"]) / 2
    away = scores.select("g", F.abs(F.col("score") - F.lit(cut)).alias("away"))
    return Model(edges, w, cut, max(exact_median(away, "g", "away").first()["median"] / 3, 1e-6))


def learn_quality(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", **options
) -> Model:
    """Fit on all documents with a label.

    Features are made where the texts are, 15 numbers a row; those of labelled documents are
    stored. Documents without text, key or label are left out; of documents that share a key
    one is taken.
    """
    read = docs.select(field(docs, key).alias("key"), field(docs, text).alias("text")).where("key is not null and text is not null")

    def run(batches):
        for batch in (b for big in batches for b in pieces([big], "text", 4 << 20)):
            values = features(batch.column("text"))
            listed = pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32), values.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("key"), listed], ["key", "features"])

    schema = T.StructType([T.StructField("key", read.schema["key"].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])
    given = labels.select(field(labels, key).alias("key"), field(labels, label).cast("int").alias("label"))
    given = given.where("key is not null and label in (0, 1)").distinct()
    rows = read.mapInArrow(frugal(run), schema).join(given, "key").dropDuplicates(["key", "label"])
    try:
        return train(kept(rows.select(F.xxhash64(F.lit(37), "key").alias("mark"), "label", "features"), "features"), **options)
    finally:
        give_back()


def score_quality(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows with ``quality_score`` (0 to 1) and ``is_good`` (0.5 or more).

    Every character of a text is read; labels, languages and sources are not. Null and
    empty texts are scored by features of zero. All rows and columns are kept; new columns
    get underscores behind taken names.
    """
    score, flag = free_name(docs, "quality_score"), free_name(docs, "is_good")
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(flag, T.BooleanType())])
    given = handed_out(docs.sparkSession, model)

    def run(batches):
        ranker = received(given)
        for batch in (b for big in batches for b in pieces([big], text, 4 << 20)):
            value = ranker.shares(features(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value, pa.float64()), pa.array(value >= 0.5)], [*batch.schema.names, score, flag]
            )

    return docs.mapInArrow(frugal(run), schema)
