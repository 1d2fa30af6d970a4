"""Exact token counts of every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

from array import array
from operator import sub

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.words import frugal, pieces

#: The mark that stands for a blank in a vocabulary.
BLANK = "▁"
#: Units whose steps a task remembers; it starts anew beyond that.
REMEMBERED = 300_000
#: Neighbours of which a task remembers whether they stay apart; it starts anew beyond that.
NEIGHBOURS = 2_000_000
#: A character outside the vocabulary, which is spelt in bytes.
OTHER = -1


class PrefixCounter:
    """Token counts at every prefix of texts, for byte-pair models of the sentencepiece library.

    A list of tokens is the encoding of a text if each two neighbours are the encoding of
    what they spell together. So the last token of a prefix is the one that ends there and
    stays apart from the last token of the prefix before it, and
    ``count(prefix) = count(prefix without its last token) + 1``. No prefix is encoded.

    No piece goes on with a blank after another character, so that counts of a unit (blanks
    and what follows up to the next blank) do not depend on what stands around it; a task
    works each unit out once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        kinds = ModelProto.SentencePiece
        own = [(i, p.piece) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        if (
            trainer.model_type != 2
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or normal.precompiled_charsmap
            or normal.remove_extra_whitespaces
            or not normal.escape_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
            or any(a != BLANK and b == BLANK for _, x in own for a, b in zip(x, x[1:]))
            or max(len(x) for _, x in own) > 30
        ):
            raise ValueError("prefix counts need a byte-pair model with byte fallback that keeps texts as they are")
        self.dummy = normal.add_dummy_prefix
        normal.add_dummy_prefix = False
        self.model = SentencePieceProcessor(model_proto=proto.SerializeToString())
        texts = [x.replace(BLANK, " ") for _, x in own]
        self.alphabet = {c for x in texts for c in x}
        self.spelling: dict[int, str] = {}
        self.automaton = ahocorasick.Automaton()
        for (i, _), text, ids in zip(own, texts, self.model.encode(texts)):
            if ids == [i]:  # Others never come out of an encoding.
                self.spelling[i] = text
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.clear()
        self.apart: dict[int, bool] = {}

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int8)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two tokens next to each other are the encoding of what they spell."""
        if len(self.apart) >= NEIGHBOURS:
            self.apart.clear()
        apart = self.apart[a << 32 | b] = self.model.encode(self.spelling[a] + self.spelling[b]) == [a, b]
        return apart

    def spell(self, unit: str, last: list[int], count: list[int], upto: int) -> None:
        """Go on to the prefix of ``upto`` characters, over characters at which no token ends."""
        for char in unit[len(count) - 1 : upto]:
            if char in self.alphabet:
                raise ValueError(f"no token ends at character {len(count)} of {unit[:100]!r}")
            last.append(OTHER)
            count.append(count[-1] + len(char.encode()))

    def counts(self, unit: str) -> list[int]:
        """The token count of each prefix of a unit, the empty one first."""
        last, count = [OTHER], [0]
        done = 0
        known = self.apart
        for at, (token, size) in self.automaton.iter(unit):
            if done > at:  # The last token of this prefix is known.
                continue
            if done < at:
                self.spell(unit, last, count, at)
            before = at + 1 - size
            left = last[before]
            if left != OTHER:
                apart = known.get(left << 32 | token)
                if apart is None:
                    apart = self.stay_apart(left, token)
                if not apart:
                    continue
            last.append(token)
            count.append(count[before] + 1)
            done = at + 1
        if done < len(unit):
            self.spell(unit, last, count, len(unit))
        return count

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How the count changes with each character, all texts one behind the other, and where texts begin."""
        text = pc.replace_substring(pc.fill_null(text, ""), BLANK, " ")
        full = pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        if self.dummy:
            text = pc.if_else(pa.array(full), pc.binary_join_element_wise(" ", text, ""), "")
        raw = pa.concat_arrays([text.cast(pa.large_binary())])
        _, offsets, data = raw.buffers()
        bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        if bounds[-1] == bounds[0]:
            return np.empty(0, np.int8), np.zeros(len(bounds), np.int64)
        letters = np.frombuffer(data, np.uint8)
        head = letters[bounds[0] : bounds[-1]] == 32
        head[1:] &= letters[bounds[0] : bounds[-1] - 1] != 32
        begin = bounds[:-1][full] - bounds[0]
        head[begin] = True
        cuts = np.concatenate((np.flatnonzero(head), [bounds[-1] - bounds[0]])).astype(np.int64) + bounds[0]
        units = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), data])
        coded = units.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.clear()
        known, fresh, sizes, where = self.known, array("b"), [], []
        for unit in coded.dictionary.to_pylist():
            at = known.get(unit)
            if at is None:
                at = known[unit] = len(known)
                count = self.counts(unit)
                fresh.extend(map(sub, count[1:], count))
                sizes.append(len(unit))
            where.append(at)
        sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.frombuffer(fresh, np.int8)))
        codes = np.array(where, np.int64)[coded.indices.to_numpy()]
        each = self.sizes[codes]
        ends = np.cumsum(each)
        steps = self.flat[np.repeat(self.starts[codes] - (ends - each), each) + np.arange(ends[-1])]
        # Characters before each text: those of the units before its first one.
        first = np.searchsorted(cuts[:-1] - bounds[0], bounds[:-1] - bounds[0])
        starts = np.concatenate(([0], ends))[np.concatenate((first, [len(codes)]))]
        if self.dummy:
            # The blank in front is no character of the text: its count goes to the first one.
            own = starts[:-1][full]
            steps[own + 1] += steps[own]
            steps = np.delete(steps, own)
            starts = starts - np.concatenate(([0], np.cumsum(full)))
        return steps, starts


def count_prefixes(
    docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", limit: int | None = None
) -> DataFrame:
    """Token counts of whole texts and of every prefix of them.

    ``model`` is a file of the sentencepiece library, a byte-pair model with byte fallback
    that does not change texts; workers read it from that path, other models are refused.
    No begin or end token is counted, and the strings of special tokens are ordinary text.

    Returns the key with ``n_bytes`` (UTF-8), ``n_chars``, ``n_tokens`` and ``steps``: one
    signed byte per character, so that the sum of the first p of them is the token count of
    the first p characters (see ``tokens_at`` and ``fitting``). With a ``limit`` also
    ``fit_chars``, the longest prefix that has ``limit`` tokens at most.

    A null text is empty: no characters, no tokens. Every row is counted, those with null or
    repeated keys too; an empty table gives an empty one. Other columns are not read; where
    the key has the name of a result, that gets underscores behind. No step holds more than a
    few megabytes of text or one document.
    """
    names, taken = [], docs.select(field(docs, key))
    for wanted in ("n_bytes", "n_chars", "n_tokens", "steps", *(["fit_chars"] if limit is not None else [])):
        names.append(free_name(taken, wanted))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.LongType()]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *map(T.StructField, names, kinds)])
    read = docs.select(field(docs, key), field(docs, text).cast("string"))

    def run(batches):
        counter = PrefixCounter(model)
        # By place: the key and the text can have any names, also the same one.
        for big in batches:
            for batch in pieces([pa.RecordBatch.from_arrays(big.columns, ["key", "text"])], "text", 4 << 20):
                steps, starts = counter(batch.column(1))
                so_far = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
                raw = steps.tobytes()
                spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                columns = [
                    pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array(np.diff(starts)),
                    pa.array(so_far[starts[1:]] - so_far[starts[:-1]]),
                    pa.array([raw[a:b] for a, b in spans], pa.binary()),
                ]
                if limit is not None:
                    columns.append(pa.array([_longest(so_far[a : b + 1] - so_far[a], limit) for a, b in spans], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    return read.mapInArrow(frugal(run), schema)


def _longest(counts: np.ndarray, limit: int) -> int:
    """The longest prefix with a count of at most ``limit``; counts can fall as a prefix grows."""
    if counts[-1] <= limit:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= limit)[-1]) if limit >= 0 else 0


def tokens_at(steps: Column, chars: Column) -> Column:
    """The token count of the first ``chars`` characters; beyond the text that of the whole, null for nulls."""

    @F.pandas_udf("long")
    def look_up(steps: pd.Series, chars: pd.Series) -> pd.Series:
        def one(x, n):
            if x is None or pd.isna(n):
                return None
            return int(np.frombuffer(x, np.int8)[: max(0, int(n))].sum(dtype=np.int64))

        return pd.Series([one(x, n) for x, n in zip(steps, chars)], dtype="Int64")

    return look_up(steps, chars)


def fitting(steps: Column, budget: Column) -> Column:
    """The most characters from the start that have ``budget`` tokens at most; null for nulls, 0 below zero."""

    @F.pandas_udf("long")
    def look_up(steps: pd.Series, budget: pd.Series) -> pd.Series:
        def one(x, n):
            if x is None or pd.isna(n):
                return None
            return _longest(np.concatenate(([0], np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64))), int(n))

        return pd.Series([one(x, n) for x, n in zip(steps, budget)], dtype="Int64")

    return look_up(steps, budget)
