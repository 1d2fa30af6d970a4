"""Phrases of words that go together, mined with set operations on occurrence relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgernet.llm.columns import field
from ledgernet.llm.kneser_ney import packed, unpacked
from ledgernet.llm.shared import kept
from ledgernet.llm.words import frugal, pieces

#: Bytes of text of one language that a block of occurrences holds, unless one text is longer.
BLOCK_BYTES = 8 << 20
#: Bytes of text that wait for their blocks to fill, over all languages.
WAITING_BYTES = 32 << 20
#: Bits of an id for the code of a group in its block, and of a block's number in its partition.
CODE_BITS, NUMBER_BITS = 26, 14
#: Groups that are sent to Spark at a time.
SENT = 100_000
#: What a byte is: 0 part of a word, 1 between words, 2 between pieces. All of them are ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def occurrences(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and the position and word of each occurrence, sorted by piece and position.

    Positions go on by one within a piece and skip one at least between pieces, so that they
    stand for (piece, position).
    """
    ended = pc.binary_join_element_wise(pc.fill_null(text, ""), "", "\n")
    raw = pa.concat_arrays([pc.ascii_lower(ended).cast(pa.large_binary())])
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)
    letters = np.frombuffer(data, np.uint8)[bounds[raw.offset] : bounds[raw.offset + len(raw)]]
    kind = _KIND[letters]
    inside = kind == 0
    begins = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    piece = np.cumsum(kind == 2, dtype=np.int64)[begins]
    spans = np.concatenate(([0], np.cumsum(ends - begins, dtype=np.int64)))
    buffers = [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(letters[inside].tobytes())]
    coded = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
    return coded.dictionary.cast(pa.string()), np.arange(len(begins)) + piece, coded.indices.to_numpy()


def adjacent(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation merge-joined with itself on the next position: position, group there, group behind."""
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[here], group[here], group[here + 1]


def _relation(at: np.ndarray, group: np.ndarray) -> bytes:
    return packed(at.astype(np.uint32), group.astype(np.uint32))


def _read_relation(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, group = unpacked(blob, np.uint32, np.uint32)
    return at.astype(np.int64), group.astype(np.int64)


def _word_blocks(docs: DataFrame) -> DataFrame:
    """Occurrences of words, a row per block: language, relation, words by code, how often each."""

    def run(batches):
        number = TaskContext.get().partitionId() << NUMBER_BITS
        waiting: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def close(lang):
            nonlocal number
            distinct, at, code = occurrences(pa.concat_arrays(waiting.pop(lang)))
            sizes.pop(lang)
            if not len(at):
                return
            n = np.bincount(code, minlength=len(distinct))
            columns = [[number], [lang], [_relation(at, code)], [len(at)], [distinct], [n]]
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            number += 1
            if len(at) >> CODE_BITS or not number % (1 << NUMBER_BITS):
                raise OverflowError("a text of 2^26 words, or a partition of 2^14 blocks")
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "lang", "relation", "n", "words", "times"]
            )

        for batch in (b for big in batches for b in pieces([big], "text", BLOCK_BYTES)):
            langs = batch.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, i))
                waiting.setdefault(lang, []).append(texts)
                sizes[lang] = sizes.get(lang, 0) + (pc.sum(pc.binary_length(texts)).as_py() or 0)
                if sizes[lang] >= BLOCK_BYTES:
                    yield from close(lang)
            while sum(sizes.values()) > WAITING_BYTES:
                yield from close(max(sizes, key=sizes.get))
        for lang in list(waiting):
            yield from close(lang)

    schema = "block long, lang string, relation binary, n long, words array<string>, times array<long>"
    return docs.mapInArrow(frugal(run), schema)


def _pairs(relation: tuple[np.ndarray, np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of adjacent groups and the code of each pair; the pairs by code and how often each comes up."""
    at, left, right = adjacent(*relation)
    pair, code, n = np.unique(left * groups + right, return_inverse=True, return_counts=True)
    return at, code, pair, n


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """Of each block the pairs of groups at adjacent positions by code, with how often they come up."""

    def run(batches):
        for batch in batches:
            for block, blob, ids in zip(*(batch.column(c) for c in ("block", "relation", "ids"))):
                ids = ids.values.to_numpy()
                _, _, pair, n = _pairs(_read_relation(blob.as_py()), len(ids))
                for i in range(0, len(pair), SENT):
                    some = pair[i : i + SENT]
                    columns = [
                        np.full(len(some), block.as_py()),
                        np.arange(i, i + len(some)),
                        ids[some // len(ids)],
                        ids[some % len(ids)],
                        n[i : i + SENT],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "code", "left", "right", "n"])

    return blocks.mapInArrow(frugal(run), "block long, code long, left long, right long, n long")


def _semi_joined(blocks: DataFrame, seen: DataFrame, words: bool) -> DataFrame:
    """Relations of the frequent groups: of ``words`` themselves, or else of pairs at adjacent positions."""
    arrays = seen.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "id"))).alias("held"))
    names = ["block", "relation"] if words else ["block", "relation", "ids"]
    joined = blocks.select(*names).join(arrays, "block").select(*names, "held")

    def run(batches):
        for batch in batches:
            for i, (block, blob, held) in enumerate(zip(*(batch.column(c) for c in ("block", "relation", "held")))):
                at, code = _read_relation(blob.as_py())
                if not words:
                    at, code, _, _ = _pairs((at, code), len(batch.column("ids")[i]))
                frequent = held.values.field("code").to_numpy()
                group = np.full(max(code.max(initial=0), frequent[-1]) + 1, -1, np.int64)
                group[frequent] = np.arange(len(frequent))
                group = group[code]
                stays = group >= 0
                columns = [
                    pa.array([block.as_py()]),
                    pa.array([_relation(at[stays], group[stays])], pa.binary()),
                    pa.array([held.values.field("id")], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "relation", "ids"])

    return joined.mapInArrow(frugal(run), "block long, relation binary, ids array<long>")


def _frequent(counts: DataFrame, key: list[str], least: int) -> DataFrame:
    """The rows of groups that come up ``least`` times in all blocks together, with that ``total`` and an ``id``.

    The id tells the first block and the code there. A group has a row per block at most, so
    that the rows of the commonest one are few; one shuffle both adds up and semi-joins.
    """
    group = Window.partitionBy(*key)
    own = F.shiftleft("block", CODE_BITS).bitwiseOR(F.col("code"))
    found = counts.withColumns({"total": F.sum("n").over(group), "id": F.min(own).over(group)})
    return found.where(F.col("total") >= least).select("block", "code", "id", *key, "total")


def _groups(seen: DataFrame) -> DataFrame:
    """One row of each frequent group."""
    return seen.where(F.col("id") == F.shiftleft("block", CODE_BITS).bitwiseOR(F.col("code"))).drop("block", "code")


def mine_phrases(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, contained: int = 50
) -> DataFrame:
    """Phrases of 2 to ``longest`` words that come up ``least`` times or more in a language.

    A-Z are lower-cased. Texts are cut into pieces at ``.,;:!?`` and line, form and vertical
    feeds and returns, pieces into words at blanks and tabs. A phrase is a run of words of a
    piece; all its occurrences count, overlapping ones too.

    Returns ``lang``, ``phrase`` (words joined by blanks), ``a`` (how often), ``l`` and ``r``
    (how often the words before and behind the cut of the lowest score come up, of equal
    ones the first cut), ``n`` (words of the language), ``score``: the whole part of
    1000000 a a / (l r), exact in decimals for up to 10^14 words. Phrases that lie in a
    longer one with at least ``contained`` hundredths of their occurrences are left out.

    1. Occurrences of words are kept as blocks, sorted by piece and position.
    2. Groups of a block are counted; Spark adds the counts of all blocks up and semi-joins
       the frequent ones, which restricts the blocks.
    3. Adjacent positions of a block are merge-joined; its pairs are the groups of the next
       length, for which step 2 repeats.

    What one group has to move is a row per block, however common it is. A null text is
    empty, a null language is ``und``. Rows count as often as they are there; other columns
    are not read. An empty table, or one without frequent phrases, gives an empty result. A
    single text of 2^26 words, beyond what a row can reasonably hold, is refused with an error.
    """
    read = docs.select(
        F.coalesce(field(docs, text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(field(docs, lang).cast("string"), F.lit("und")).alias("lang"),
    )
    words = kept(_word_blocks(read), "occurrences")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    told = words.select("block", "lang", F.posexplode(F.arrays_zip("words", "times")).alias("code", "of"))
    told = told.select("block", F.col("code").cast("long").alias("code"), "lang", F.col("of.words").alias("word"), F.col("of.times").alias("n"))
    seen = kept(_frequent(told, ["lang", "word"], least), "frequent-words")
    level = _groups(seen).select(
        "id", "lang", F.array("word").alias("words"), "total", F.array("total").alias("heads"), F.array("total").alias("tails")
    )
    blocks = kept(_semi_joined(words, seen, words=True), "word-relation")
    levels = []
    for size in range(2, longest + 1):
        if size < longest:
            seen = kept(_frequent(_pair_counts(blocks), ["left", "right"], least), "frequent-pairs")
            groups = _groups(seen)
            blocks = kept(_semi_joined(blocks, seen, words=False), "relation")
        else:
            totals = _pair_counts(blocks).groupBy("left", "right").agg(F.sum("n").alias("total"))
            groups = totals.where(F.col("total") >= least).withColumn("id", F.lit(None).cast("long"))
        before = level.select(F.col("id").alias("left"), "lang", F.col("words").alias("start"), "heads")
        behind = level.select(F.col("id").alias("right"), F.element_at("words", -1).alias("word"), "tails")
        level = kept(
            groups.join(before, "left")
            .join(behind, "right")
            .select(
                "id", "left", "right", "lang", F.concat("start", F.array("word")).alias("words"), "total",
                F.concat("heads", F.array("total")).alias("heads"), F.concat("tails", F.array("total")).alias("tails"),
            ),
            "phrases",
        )
        levels.append(level)
    chosen = [levels[-1]]
    for shorter, longer in zip(levels, levels[1:]):
        parts = longer.select(F.explode(F.array("left", "right")).alias("part"), F.col("total").alias("most"))
        parts = parts.groupBy("part").agg(F.max("most").alias("most"))
        left = shorter.join(parts, shorter["id"] == parts["part"], "left")
        chosen.append(left.where(f"most is null or 100 * most < {int(contained)} * total").drop("part", "most"))
    found = chosen[0]
    for part in chosen[1:]:
        found = found.unionByName(part)
    cuts = """transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', 1000000BD * cast(total as decimal(14, 0)) * cast(total as decimal(14, 0))
            div (cast(heads[k - 1] as decimal(14, 0)) * cast(tails[size(words) - k - 1] as decimal(14, 0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1]))"""
    scored = found.select("lang", F.array_join("words", " ").alias("phrase"), F.col("total").alias("a"), F.array_min(F.expr(cuts)).alias("cut"))
    rows = scored.join(sizes, "lang")
    return rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
