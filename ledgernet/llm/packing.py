"""Packing of tokenised documents into sequences of one length, in order."""

from __future__ import annotations

import os
from collections import deque
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgernet.llm.columns import field
from ledgernet.llm.words import frugal, give_back, pieces, words

#: Token texts after which a sentence is over, without the mark of a word's end.
ENDINGS = (".", "!", "?")
#: Pieces of letters that stay letters when they are normalised.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Punctuation that never belongs to the letters before it, nor to a special token.
TRAILING = ".,;:!?*%$&#"
#: Pieces of words whose ids a task remembers; it starts anew beyond that.
REMEMBERED = 300_000
#: Pieces that are encoded as one text.
JOINED = 500
#: Texts that pass the library at a time.
TOGETHER = 64
#: Bytes of text that are encoded together.
BATCH = 3 << 20
#: Tokens that are cut into windows at a time; what the last window holds moves on to the next time.
BLOCK = 1 << 19


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that the codes name, one behind the other, and their ends."""
    each = sizes[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)], ends


def listed(texts: pa.Array) -> list[str]:
    """The texts, none with a blank, as a list: one long text is split sooner than each is read by itself."""
    if not len(texts):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


def in_two(distinct: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words without the punctuation that ends them, that punctuation, and which words have both.

    Only punctuation behind a letter is parted. What is left is lower-cased where it is
    ASCII and cannot hold a special token.
    """
    core = pc.ascii_rtrim(distinct, TRAILING)
    shorter = pc.and_(pc.less(pc.binary_length(core), pc.binary_length(distinct)), pc.not_equal(core, ""))
    parted = np.flatnonzero(shorter.to_numpy(zero_copy_only=False))
    last = pc.utf8_slice_codeunits(core.take(pa.array(parted)), -1).dictionary_encode()
    letter = np.array([c.lower().isalpha() for c in last.dictionary.to_pylist()], bool)
    parted = parted[letter[last.indices.to_numpy()]]
    cut = np.zeros(len(distinct), bool)
    cut[parted] = True
    ending = pc.struct_field(pc.extract_regex(distinct.take(pa.array(parted)), f"(?P<e>[{TRAILING}]+)$"), "e")
    core = pc.if_else(pa.array(cut), core, distinct)
    plain = pc.and_(pc.string_is_ascii(core), pc.invert(pc.match_substring(core, "<")))
    return pc.if_else(plain, pc.ascii_lower(core), core), ending, parted


class WordIds:
    """Token ids of whole texts. Pieces of words are encoded once and remembered.

    This is exact for tokenizers that never look across white space, drop it, do not tell
    a from A, and part punctuation from letters before it.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        # What is done to text before the model sees it: as the file says, or, for texts of
        # letters and blanks, without the patterns that they do not need.
        simple = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        blanks = [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.before = {False: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer), True: (simple, pre_tokenizers.Sequence(blanks))}
        suffix = "</w>"
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word = self.ends_sentence.copy()
        for token, number in vocabulary.items():
            self.ends_sentence[number] = token.removesuffix(suffix).endswith(ENDINGS)
            self.ends_word[number] = token.endswith(suffix)
        del vocabulary
        special = {n: t.content for n, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark_id, self.mark = next(iter(sorted(special.items())), (None, None))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and how many each has.

        Many are encoded as one text, which costs less than one call each: pieces of letters
        with blanks between them, others with a special token behind each; those that may
        hold special tokens are encoded by themselves.
        """
        if self.mark is None:
            return self.alone(texts)
        plain = pc.match_substring_regex(pa.array(texts, pa.string()), LETTERS).to_numpy(zero_copy_only=False)
        simple = np.flatnonzero(plain)
        odd = [i for i in np.flatnonzero(~plain).tolist() if "<" in texts[i]]
        apart = set(odd)
        rest = [i for i in np.flatnonzero(~plain).tolist() if i not in apart]
        parts = [
            self.letters([texts[i] for i in simple.tolist()]),
            self.marked([texts[i] for i in rest]),
            self.alone([texts[i] for i in odd]),
        ]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        back = np.argsort(np.concatenate((simple, np.array(rest + odd, np.int64))), kind="stable")
        return gathered(ids, np.cumsum(sizes) - sizes, sizes, back)[0], sizes[back]

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters: each is one word, whose last token bears the mark of a word's end."""
        ids = self.ids_of([" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)], letters=True)
        return ids, np.diff(np.concatenate(([-1], np.flatnonzero(self.ends_word[ids]))))

    def marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any pieces: behind each stands a special token."""
        ids = self.ids_of([self.mark.join([*texts[i : i + JOINED], ""]) for i in range(0, len(texts), JOINED)])
        marks = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, marks), np.diff(np.concatenate(([-1], marks))) - 1

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.ids_of([x]) for x in texts]
        return np.concatenate([np.empty(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)

    def ids_of(self, texts: list[str], letters: bool = False) -> np.ndarray:
        """Ids of all texts one behind the other; the library's bulky results are dropped as they come."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.before[letters]
        out = [np.empty(0, np.uint32)]
        for i in range(0, len(texts), TOGETHER):
            found = self.tokenizer.encode_batch_fast(texts[i : i + TOGETHER], add_special_tokens=False)
            out.extend(np.array(e.ids, np.uint32) for e in found)
        return np.concatenate(out)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one behind the other, the end id behind each, and where rows begin."""
        distinct, codes, bounds = words(text, lower=False)
        if len(self.known) > REMEMBERED:
            self.clear()
        core, ending, parted = in_two(distinct)
        both = pa.concat_arrays([core, ending]).dictionary_encode()
        names = listed(both.dictionary)
        places = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(places < 0)
        fresh = [names[i] for i in unknown.tolist()]
        places[unknown] = np.arange(len(self.known), len(self.known) + len(fresh))
        self.known.update(zip(fresh, places[unknown].tolist()))
        at = places[both.indices.to_numpy()]
        first, second = at[: len(core)], np.full(len(core), -1)
        second[parted] = at[len(core) :]
        more, sizes = self.encoded(fresh)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, more))
        # Two more pieces: one without ids, where a word has no second piece, and the end id.
        flat = np.append(self.flat, np.uint32(self.end_id))
        starts = np.concatenate((self.starts, [0, len(self.flat)]))
        sizes = np.concatenate((self.sizes, [0, 1]))
        nothing, end = len(starts) - 2, len(starts) - 1
        pieces_of = np.stack((first, second), axis=1)
        pieces_of[pieces_of < 0] = nothing
        pieces_of = np.concatenate((pieces_of, [[end, nothing]]))
        # The ids of each distinct word, both pieces one behind the other; the end id is one more word.
        flat, ends = gathered(flat, starts, sizes, pieces_of.ravel())
        starts = np.concatenate(([0], ends[1::2]))
        codes = np.insert(codes, bounds[1:], len(distinct))
        ids, ends = gathered(flat, starts[:-1], np.diff(starts), codes)
        return ids, np.concatenate(([0], ends))[bounds + np.arange(len(bounds))]


def candidates(ids: np.ndarray, bounds: np.ndarray, ends_sentence: np.ndarray, length: int, sentence: float, cut: float):
    """Places where a window may end, in order, with the penalty of ending there.

    Ends of documents cost nothing, ends of sentences ``sentence``, and places inside
    sentences, which are offered only where a gap is longer than an eighth of a window, ``cut``.
    """
    n = len(ids)
    whole = np.zeros(n + 1, bool)
    whole[bounds[1:][bounds[1:] <= n]] = True
    ends = whole.copy()
    ends[1:] |= ends_sentence[ids]
    ends[0] = False
    places = np.flatnonzero(ends)
    gaps = np.diff(np.concatenate(([0], places)))
    wide = np.flatnonzero(gaps > length // 8)
    if len(wide):
        step = max(1, length // 64)
        extra = [np.arange(places[i] - gaps[i] + step, places[i], step) for i in wide]
        inside = np.concatenate(extra)
        all_places = np.concatenate((places, inside))
        penalty = np.concatenate((np.full(len(places), sentence), np.full(len(inside), cut)))
        order = np.argsort(all_places, kind="stable")
        places, penalty = all_places[order], penalty[order]
    else:
        penalty = np.full(len(places), sentence)
    penalty[whole[places]] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int, last: bool) -> list[int]:
    """Window ends with the least sum of padding and penalties; windows hold ``length`` at most.

    With f(j) the least cost of windows that end at place j, f(j) = penalty(j) + length - t(j)
    + min of f(i) + t(i) over the places i at most a window before j. The minimum slides
    along with j, so a queue with rising values holds all that can still become one. Unless
    this is the ``last`` block, tokens behind the last window stay for the next block.
    """
    t = [0, *places.tolist()]
    cost = [0.0, *penalty.tolist()]
    f = [0.0] * len(t)
    back = [0] * len(t)
    queue: deque[int] = deque([0])
    for j in range(1, len(t)):
        tj = t[j]
        while t[queue[0]] < tj - length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = f[i] + t[i]
        f[j] = cost[j] + length - tj + value
        value = f[j] + tj
        while queue and f[queue[-1]] + t[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    j = len(t) - 1
    if not last:
        j = min((k for k in range(len(t) - 1, -1, -1) if t[k] > t[-1] - length), key=lambda k: f[k])
    ends = []
    while j:
        ends.append(t[j])
        j = back[j]
    return ends[::-1]


def powers(size: int) -> list[int]:
    """Powers of two, largest first, that add up to ``size``."""
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = 4096,
    end_id: int = 2,
    sentence: float = 8.0,
    cut: float = 64.0,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, in the order of the input.

    Each partition of the input is a run: its documents stand one behind the other, each
    with ``end_id`` behind, and are cut into windows at ends of documents or sentences so
    that padding plus penalties (``sentence`` tokens for a cut inside a document, ``cut`` for
    one inside a sentence) are least. The last window of a run is cut into sequences whose
    lengths are powers of two, which need no padding.

    Returns one row per piece: the key, ``start`` (ids of the document before), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``
    (of the piece in its sequence). ``tokenizer`` is a file of the tokenizers library that
    drops white space; workers read it from that path.

    A null text is empty and yields its end id alone. Null and repeated keys are kept: each
    row is a document. An empty table gives an empty one; other columns are not read. No
    step gathers more than a document or a block of ``BLOCK`` tokens.
    """
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    names = [n + "_" if n == key else n for n in names]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *map(T.StructField, names, kinds)])
    read = docs.select(field(docs, key), field(docs, text).cast("string"))

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # A task has one core.
        encode = WordIds(tokenizer, end_id)
        made = 0  # sequences so far
        ids = np.empty(0, np.uint32)
        # For each document of the block: key, where it begins in the block, ids before that, ids of the whole.
        keys: list = []
        begin, before, whole = (np.empty(0, np.int64) for _ in range(3))
        kind = None

        def rows(ends: list[int], upto: int):
            """Pieces of the tokens up to ``upto``, in windows with these ends."""
            nonlocal made
            cuts = np.union1d(begin[begin < upto], np.array([0, *ends], np.int64))
            cuts = cuts[cuts <= upto]
            a, b = cuts[:-1], cuts[1:]
            doc = np.searchsorted(begin, a, "right") - 1
            windows = np.array([0, *ends], np.int64)
            number = np.searchsorted(windows, a, "right") - 1
            raw = ids[:upto].astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in doc.tolist()], kind),
                    pa.array(a - begin[doc] + before[doc]),
                    pa.array(b - a),
                    pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
                    pa.array(whole[doc]),
                    pa.array((TaskContext.get().partitionId() << 36) + made + number),
                    pa.array(a - windows[number]),
                ],
                [key, *names],
            )
            made += len(ends)
            return out

        def flush(last: bool):
            nonlocal ids, keys, begin, before, whole
            places, penalty = candidates(ids, np.append(begin, len(ids)), encode.ends_sentence, length, sentence, cut)
            ends = best_cuts(places, penalty, length, last)
            if last:
                # The last window becomes sequences that need no padding.
                start = ends[-2] if len(ends) > 1 else 0
                sizes = powers(ends[-1] - start) if ends[-1] - start < length else [length]
                ends = [*ends[:-1], *(start + np.cumsum(sizes)).tolist()]
            if not ends:
                return
            upto = ends[-1]
            yield rows(ends, upto)
            first = int(np.searchsorted(begin, upto, "right")) - 1
            if upto == len(ids):
                ids, keys, begin, before, whole = ids[:0], [], begin[:0], before[:0], whole[:0]
                return
            ids, keys, whole = ids[upto:], keys[first:], whole[first:]
            before = before[first:].copy()
            before[0] += max(0, upto - begin[first])
            begin = np.maximum(begin[first:] - upto, 0)

        for batch in (b for big in batches for b in pieces([big], text, BATCH)):
            kind = batch.schema.field(0).type
            more, bounds = encode(batch.column(1))
            begin = np.concatenate((begin, bounds[:-1] + len(ids)))
            before = np.concatenate((before, np.zeros(len(bounds) - 1, np.int64)))
            whole = np.concatenate((whole, np.diff(bounds)))
            keys.extend(batch.column(0).to_pylist())
            ids = np.concatenate((ids, more))
            if len(ids) >= BLOCK:
                yield from flush(False)
                give_back()
        if len(ids):
            yield from flush(True)

    return read.mapInArrow(frugal(run), schema)
