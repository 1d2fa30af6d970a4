"""A bigram language model with interpolated modified Kneser-Ney smoothing.

Counted in Spark, stored as sorted hash arrays in the shared folder, mapped into memory by
the workers that score texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.shared import Maps, kept, model_folder, write_arrays
from ledgernet.llm.words import frugal, hashes, mix, pieces, words

#: Marks before the first and behind the last word of a text.
START, END = np.uint64(0x53), np.uint64(0x45)
_TURN = np.uint64(0xD1342543DE82EF95)
#: Bytes of text that a shard of the counts stands for.
SHARD_BYTES = 9_000_000
#: Files of 2 to this power hold a shard each; more shards share files, 16 at most.
FILE_BITS = 7
#: Files a scorer keeps mapped.
MAPPED = 64
#: Pairs a task adds up before it sends them off.
GATHERED = 1_000_000
#: Bytes of text that are counted or scored together.
BATCH = 2 << 20
#: Texts from which frequent words are told, only to spread them over shards.
SAMPLED = 500
WORD = [("x", np.uint64), ("tokens", np.uint64), ("types", np.uint32), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32)]
#: The arrays of a shard of pairs: keys that came up once, keys that came up more often, how often.
PAIR = [np.uint64, np.uint64, np.uint32]


def packed(*arrays: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes; a sorted first column is kept as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = [a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in (first, *arrays[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(widths)
    out, at = [], 0
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its context and itself, as word hashes, and where texts begin; the last token is the end."""
    distinct, codes, bounds = words(text)
    word = hashes(distinct)
    # Two codes more: the start and the end.
    word = np.concatenate((word, [START, END]))
    this = np.insert(codes.astype(np.int64), bounds[1:], len(word) - 1)
    before = np.insert(codes.astype(np.int64), bounds[:-1], len(word) - 2)
    return word, np.stack((before, this)), bounds + np.arange(len(bounds))


def pairs_of(word: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of distinct pairs (context, word), how often each comes up, and the pair of each token."""
    joint = both[0] * len(word) + both[1]
    kinds, where, n = np.unique(joint, return_inverse=True, return_counts=True)
    return kinds // len(word), kinds % len(word), n, where


@dataclass
class Layout:
    """How pairs and words are dealt to shards; a frequent context is spread over several."""

    bits: int
    hot: np.ndarray
    spread: np.ndarray

    @property
    def shared_bits(self) -> int:
        """A file holds 2 to this power of neighbouring shards."""
        return min(max(self.bits - FILE_BITS, 0), 4)

    def path(self, folder: str, what: str, file: int) -> str:
        return f"{folder}/{what}/{file >> 10}/{file & 1023}"

    def place(self, folder: str, what: str, shard: int, width: int) -> tuple[str, int]:
        """The file with a shard and the place of the first of its ``width`` arrays."""
        within = shard & ((1 << self.shared_bits) - 1)
        return self.path(folder, what, shard >> self.shared_bits), within * width

    def of_words(self, x: np.ndarray) -> np.ndarray:
        return (mix(x) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(x), np.int64)

    def of_pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, context), max(len(self.hot) - 1, 0))
        salt = np.zeros(len(context), np.int64)
        if len(self.hot):
            hot = self.hot[at] == context
            salt[hot] = (mix(word[hot]) % self.spread[at[hot]]).astype(np.int64)
        return (self.of_words(context) + salt) % (1 << self.bits)


def key_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) * _TURN + word)


@dataclass
class Model:
    """Where the arrays are, and the figures of the whole."""

    folder: str
    layout: Layout
    tokens: int
    vocabulary: int
    texts: int
    start: tuple[int, int, int]
    pair_types: int
    discounts: tuple[float, float, float]
    unigram_discounts: tuple[float, float, float]
    unigram_counts: tuple[int, int, int]


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many types came up one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(d, 0.05), k + 1 - 0.05)) for k, d in enumerate(raw))


def summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns added up by key, sorted by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return [keys[head], *(np.add.reduceat(c[order], head) if len(head) else c for c in columns)]


def layout_of(docs: DataFrame, text: str) -> Layout:
    """Shards for the size of the texts; words that fill a shard's share in a sample are spread."""
    size = docs.agg(F.sum(F.octet_length(field(docs, text)))).first()[0] or 0
    bits = max(2, int(size // SHARD_BYTES).bit_length())
    sample = docs.select(field(docs, text).alias("text")).orderBy(F.xxhash64(F.lit(41), "text"), "text").limit(SAMPLED)

    def run(batches):
        for batch in (b for big in batches for b in pieces([big], "text", BATCH)):
            word, both, _ = tokens_of(batch.column("text"))
            n = np.bincount(both[0], minlength=len(word))
            most = np.argsort(-n, kind="stable")[:10_000]
            yield pa.RecordBatch.from_arrays([pa.array(word[most].view(np.int64)), pa.array(n[most])], ["x", "n"])

    found = sample.mapInArrow(frugal(run), "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    rows = found.withColumn("share", F.col("n") / total * (2 << bits)).where("share > 1").collect()
    hot = np.array([r["x"] for r in rows], np.int64).view(np.uint64)
    spread = np.array([min(1 << bits, int(r["share"]) + 1) for r in rows], np.uint64)
    order = np.argsort(hot)
    return Layout(bits, hot[order], spread[order])


def learn_language(docs: DataFrame, *, text: str = "text") -> Model:
    """Count the pairs of all texts and write the model's arrays.

    1. Tasks add up pairs of (context, word) of their texts and send them to shards.
    2. A shard adds up its pairs, writes their hashes and counts, sorted, and sends on what
       each word gathers as context (how many words follow it once, twice, more often) and as
       word (behind how many contexts, how often).
    3. Words are added up and written in the same way.

    Every text and every pair counts. Shards follow the size of the texts and share files
    when they are many; the driver gets their added figures.
    """
    spark = docs.sparkSession
    docs = docs.select(field(docs, text).cast("string").alias("text"))
    layout = layout_of(docs, "text")
    folder = model_folder(spark, "kneser-ney")

    def count(batches):
        held: list = []
        size = 0

        def send():
            context, word, n = (np.concatenate(x) for x in zip(*held))
            shard = layout.of_pairs(context, word)
            order = np.lexsort((word, context, shard))
            shard, context, word, n = shard[order], context[order], word[order], n[order]
            head = np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
            at = np.flatnonzero(head)
            shard, context, word, n = shard[at], context[at], word[at], np.add.reduceat(n, at)
            cuts = np.searchsorted(shard, np.arange((1 << layout.bits) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[i], cuts[i + 1])
                blob = packed(context[part], word[part], n[part].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

        for batch in (b for big in batches for b in pieces([big], "text", BATCH)):
            word, both, _ = tokens_of(batch.column("text"))
            a, b, n, _ = pairs_of(word, both)
            held.append((word[a], word[b], n))
            size += len(held[-1][0])
            if size >= GATHERED:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    def shards_of(table: pa.Table):
        """The shards of a file in order, those without rows too."""
        first = table["shard"][0].as_py() >> layout.shared_bits << layout.shared_bits
        shards = table["shard"].to_numpy()
        for shard in range(first, first + (1 << layout.shared_bits)):
            yield table["blob"].take(np.flatnonzero(shards == shard)).to_pylist()

    def path_of(table: pa.Table, what: str) -> str:
        return layout.path(folder, what, table["shard"][0].as_py() >> layout.shared_bits)

    def merge_pairs(table: pa.Table) -> pa.Table:
        sides = []

        def merged():
            for blobs in shards_of(table):
                parts = [unpacked(b, np.uint64, np.uint64, np.uint32) for b in blobs]
                if not parts:
                    yield from (np.empty(0, k) for k in PAIR)
                    continue
                context, word, n = (np.concatenate(x) for x in zip(*parts))
                del parts
                key = key_of(context, word)
                order = np.argsort(key)
                key, context, word, n = key[order], context[order], word[order], n[order].astype(np.uint64)
                head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                key, context, word, n = key[head], context[head], word[head], np.add.reduceat(n, head)
                # Most pairs come up once: their counts need no room.
                once = n == 1
                yield from (key[once], key[~once], n[~once].astype(np.uint32))
                sides.append(side_of(context, word, n))

        write_arrays(path_of(table, "pairs"), merged())
        return pa.concat_tables(sides)

    def side_of(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.Table:
        """What the words of a shard's pairs gather, for the shards of the words."""
        one = np.ones(len(n), np.uint64)
        zero = np.zeros(len(n), np.uint64)
        side = summed(
            np.concatenate((context, word)),
            np.concatenate((zero, n)),
            np.concatenate((zero, one)),
            *(np.concatenate((c.astype(np.uint64), zero)) for c in (n == 1, n == 2, n >= 3)),
            np.concatenate((n, zero)),
        )
        starts = np.flatnonzero(side[0] == START)
        figures = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int(side[-1][starts].sum())]
        target = layout.of_words(side[0])
        order = np.argsort(target, kind="stable")
        columns = [c[order].astype(k) for c, (_, k) in zip(side[:-1], WORD)]
        cuts = np.searchsorted(target[order], np.arange((1 << layout.bits) + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = [packed(*(c[cuts[i] : cuts[i + 1]] for c in columns)) for i in full]
        return pa.table(
            {
                "shard": pa.array(full, pa.int32()),
                "blob": pa.array(blobs, pa.binary()),
                "figures": pa.array([figures if i == 0 else None for i in range(len(full))], pa.list_(pa.int64())),
            }
        )

    def merge_words(table: pa.Table) -> pa.Table:
        gathered = []

        def merged():
            for blobs in shards_of(table):
                parts = [unpacked(b, *(k for _, k in WORD)) for b in blobs]
                if not parts:
                    yield from (np.empty(0, k) for _, k in WORD)
                    continue
                columns = summed(*(np.concatenate(x).astype(np.uint64) for x in zip(*parts)))
                yield from (c.astype(k) for c, (_, k) in zip(columns, WORD))
                x, tokens, types, *follow = columns
                start = x == START
                figures = [int(tokens.sum()), int((tokens > 0).sum()), int(types.sum())]
                figures += [int((types == k).sum()) for k in (1, 2, 3, 4)] + [int((types >= 3).sum())]
                gathered.append(figures + [int(c[start].sum()) for c in follow])

        write_arrays(path_of(table, "words"), merged())
        return pa.table({"figures": pa.array(gathered, pa.list_(pa.int64()))})

    def by_file(blobs: DataFrame):
        return blobs.groupBy(F.shiftright("shard", layout.shared_bits).alias("file"))

    def totals(figures: DataFrame, n: int) -> list[int]:
        added = figures.select(F.posexplode("figures").alias("i", "figure")).groupBy("i").agg(F.sum("figure").alias("sum"))
        rows = dict(added.collect())
        return [rows.get(i, 0) for i in range(n)]

    counted = docs.mapInArrow(frugal(count), "shard int, blob binary")
    sides = kept(by_file(counted).applyInArrow(merge_pairs, "shard int, blob binary, figures array<long>"), "pairs")
    *of_pairs, texts = totals(sides, 5)
    of_words = totals(by_file(sides.select("shard", "blob")).applyInArrow(merge_words, "figures array<long>"), 11)
    tokens, vocabulary, pair_types, m1, m2, m3, m4, m3plus, *start = of_words
    return Model(
        folder, layout, tokens, vocabulary, texts, tuple(start), pair_types,
        discounts_of(*of_pairs), discounts_of(m1, m2, m3, m4), (m1, m2, m3plus),
    )


class Arrays:
    """The model's files, mapped into memory as shards are asked for; a bounded number stays open."""

    def __init__(self, model: Model):
        self.model = model
        self.maps = Maps(MAPPED)

    def of_shard(self, what: str, shard: int, kinds: list) -> list[np.ndarray]:
        """The arrays of a shard, empty for one without rows."""
        path, first = self.model.layout.place(self.model.folder, what, shard, len(kinds))
        return [self.maps.array(path, first + i, kind) for i, kind in enumerate(kinds)]

    def by_shard(self, shards: np.ndarray, keys: np.ndarray):
        """Which of the keys each shard is asked for, in the order of its array."""
        order = np.lexsort((keys, shards))
        cuts = np.searchsorted(shards[order], np.arange((1 << self.model.layout.bits) + 1))
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            yield shard, order[cuts[shard] : cuts[shard + 1]]

    def words(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out = {name: np.zeros(len(x)) for name, _ in WORD[1:]}
        for shard, rows in self.by_shard(self.model.layout.of_words(x), x):
            keys, *columns = self.of_shard("words", shard, [k for _, k in WORD])
            at, hit = found(keys, x[rows])
            for (name, _), column in zip(WORD[1:], columns):
                out[name][rows[hit]] = column[at[hit]]
        return out

    def pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context))
        keys = key_of(context, word)
        for shard, rows in self.by_shard(self.model.layout.of_pairs(context, word), keys):
            once, more, times = self.of_shard("pairs", shard, PAIR)
            _, hit = found(once, keys[rows])
            out[rows[hit]] = 1
            at, hit = found(more, keys[rows])
            out[rows[hit]] = times[at[hit]]
        return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key would be among sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def score_batch(arrays: Arrays, text: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and model score of each text."""
    model = arrays.model
    word, both, bounds = tokens_of(text)
    of_context, of_word, _, where = pairs_of(word, both)
    known = arrays.words(word)

    def discount(n, d):
        return np.where(n >= 3, d[2], np.where(n >= 2, d[1], np.where(n >= 1, d[0], 0.0)))

    # Words by the contexts they follow, mixed with an even share for every word and one unknown.
    types = known["types"]
    total = max(model.pair_types, 1)
    rest = sum(d * n for d, n in zip(model.unigram_discounts, model.unigram_counts)) / total if model.pair_types else 1.0
    unigram = (types - discount(types, model.unigram_discounts)) / total + rest / (model.vocabulary + 1)
    seen = known["tokens"].copy()
    start = word == START
    seen[start] = model.texts
    left = (model.discounts[0] * known["n1"] + model.discounts[1] * known["n2"] + model.discounts[2] * known["n3"])
    n = arrays.pairs(word[of_context], word[of_word])
    held = seen[of_context]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (n - discount(n, model.discounts)) / held + left[of_context] / held * unigram[of_word]
    log = np.log10(np.where(held > 0, share, unigram[of_word]))
    base = np.log10((known["tokens"] + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
    heads = bounds[:-1]
    return (
        np.diff(bounds),
        np.add.reduceat((known["tokens"] > 0).astype(np.int64)[both[1]], heads),
        np.add.reduceat(base[both[1]], heads),
        np.add.reduceat(log[where], heads),
    )


def score_language(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows with ``lm_tokens``, ``lm_known``, ``lm_base`` and ``lm_score``.

    ``lm_score`` is the log10 probability of the whole text, its end included; the
    perplexity per token is 10 to the power of -``lm_score`` / ``lm_tokens``. A null text is
    empty: its end alone is scored. All rows and columns are kept; new columns get
    underscores behind taken names.
    """
    names = [free_name(docs, n) for n in ("lm_tokens", "lm_known", "lm_base", "lm_score")]
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches):
        arrays = Arrays(model)
        for batch in (b for big in batches for b in pieces([big], text, BATCH)):
            made = score_batch(arrays, batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*batch.schema.names, *names])

    return docs.mapInArrow(frugal(run), schema)
