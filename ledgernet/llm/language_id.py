"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.shared import kept
from ledgernet.llm.words import frugal, give_back, pieces

#: Bytes that are looked at together; a longer text is read in stretches of this size.
STRETCH = 1 << 20
#: Distinct grams whose costs a task remembers; it starts anew beyond that.
REMEMBERED = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, A-Z lower-cased, and where rows begin."""
    raw = pa.concat_arrays([pc.fill_null(text, "").cast(pa.large_binary())])
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if data is None:
        return np.empty(0, np.uint8), bounds
    return _LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]], bounds - bounds[0]


def grams(text: pa.Array, order: int):
    """Stretches of (where the stretch begins, its last byte grams of ``order`` + 1 bytes), and the bounds.

    A gram holds a byte with the ``order`` bytes before it, the byte itself lowest; bytes
    before the text count as zero.
    """
    data, bounds = _bytes_of(text)

    def stretches():
        for start in range(0, len(data), STRETCH):
            end = min(start + STRETCH, len(data))
            out = data[start:end].astype(np.uint32)
            heads = bounds[np.searchsorted(bounds, start - order, "left") : np.searchsorted(bounds, end, "left")]
            for back in range(1, order + 1):
                low = start - back
                before = data[max(0, low) : max(0, end - back)].astype(np.uint32)
                if low < 0:
                    before = np.concatenate((np.zeros(min(-low, len(out)), np.uint32), before))
                # The first bytes of a text see nothing of the text before.
                for i in range(back):
                    at = heads + i
                    before[at[(at >= start) & (at < end)] - start] = 0
                out |= before << np.uint32(8 * back)
            yield start, out

    return stretches(), bounds


def count_grams(docs: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """(``lang``, ``gram``, ``n``) over all rows; each task adds up its own counts first."""

    def run(batches):
        totals: dict = {}
        for batch in (b for big in batches for b in pieces([big], "text", 2 << 20)):
            langs = batch.column("lang")
            for name in pc.unique(langs).to_pylist():
                part = batch.column("text").filter(pc.equal(langs, name))
                for _, found in grams(part, order)[0]:
                    keys, n = np.unique(found, return_counts=True)
                    old = totals.get(name)
                    if old is not None:
                        both = np.concatenate((old[0], keys))
                        keys, where = np.unique(both, return_inverse=True)
                        n = np.bincount(where, np.concatenate((old[1], n))).astype(np.int64)
                    totals[name] = (keys, n)
        for name, (keys, n) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )

    read = docs.select(field(docs, text).cast("string").alias("text"), field(docs, lang).cast("string").alias("lang"))
    counted = read.where("lang is not null").mapInArrow(frugal(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTree:
    """Frozen statistics of one language, and the cost of a byte behind its context.

    Escape estimates are those of method C, with exclusion: behind a context in which
    ``d`` different bytes came up T times in all, a byte seen c times has c / (T + d) and the
    escape to the context one byte shorter has d / (T + d); there, bytes that the longer
    context offered no longer count. Below the empty context, bytes never seen share alike.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        # By order k: contexts of k bytes with total, different bytes, and what a shorter context loses by exclusion.
        self.grams, self.counts, self.contexts, self.total, self.different, self.excluded = {}, {}, {}, {}, {}, {}
        for k in range(order, -1, -1):
            self.grams[k], self.counts[k] = keys, n
            heads, where = np.unique(keys >> np.uint32(8), return_inverse=True)
            if k == 0:
                heads, where = np.zeros(1, np.uint32), np.zeros(len(keys), np.int64)
            self.contexts[k] = heads
            self.total[k] = np.bincount(where, n, len(heads))
            self.different[k] = np.bincount(where, minlength=len(heads)).astype(float)
            if k:
                short = keys & np.uint32((1 << (8 * k)) - 1)
                lower, back = np.unique(short, return_inverse=True)
                fewer = np.bincount(back, n)
                self.excluded[k] = np.bincount(where, fewer[back], len(heads))
                keys, n = lower, fewer

    def costs(self, wanted: np.ndarray) -> np.ndarray:
        """Nats to code the last byte of each gram."""
        out = np.zeros(len(wanted))
        open_ = np.arange(len(wanted))
        gone = np.zeros(len(wanted))
        fewer = np.zeros(len(wanted))
        for k in range(self.order, -1, -1):
            if not len(open_):
                break
            gram = wanted[open_] & np.uint32((1 << (8 * (k + 1))) - 1)
            head = gram >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[k], head), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == head
            room = np.where(known, self.total[k][at] - gone[open_] + self.different[k][at] - fewer[open_], 0.0)
            spot = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
            hit = known & (self.grams[k][spot] == gram)
            out[open_[hit]] += np.log(room[hit]) - np.log(self.counts[k][spot[hit]])
            miss = known & ~hit & (room > 0)
            out[open_[miss]] += np.log(room[miss]) - np.log(self.different[k][at[miss]] - fewer[open_[miss]])
            moved = open_[known]
            gone[moved] = self.excluded[k][at[known]] if k else 0
            fewer[moved] = self.different[k][at[known]]
            open_ = open_[~hit]
        out[open_] += np.log(np.maximum(256 - fewer[open_], 1))
        return out


def learn_languages(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", order: int = 3, most: int = 40_000_000
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of byte grams per language, from all rows whose language is not null.

    What comes to the driver, and goes to the workers, are distinct grams of ``order`` + 1
    bytes (3 at most, hence at most four bytes a gram), some 100,000 a language and however
    much text they come from. More than ``most`` in all are refused rather than thinned out.
    """
    if not 0 <= order <= 3:
        raise ValueError("order has to be 0 to 3")
    counted = kept(count_grams(docs, text, lang, order), "grams")
    size = counted.count()
    if size > most:
        raise ValueError(f"{size} distinct grams, more than {most}: take a lower order")
    model = {}
    for name in sorted(r["lang"] for r in counted.select("lang").distinct().collect()):
        table = counted.where(F.col("lang") == name).select("gram", "n").orderBy("gram").toArrow()
        model[name] = (table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy().copy())
        del table
    give_back()
    return model


def identify(
    docs: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]], *, text: str = "text", order: int = 3, unknown: str = "und"
) -> DataFrame:
    """The rows with ``lang_pred`` and ``lang_score``: the language that codes the whole text shortest.

    The score is that language's share if all were equally likely before (1 / sum over
    languages of exp of minus the further nats). Ties go to the first name. A null text, one
    without a letter, and every text if no language was learned, gets ``unknown`` and 0. All
    rows and columns are kept; the new columns get underscores behind taken names.
    """
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = sorted(given.value)
        trees = [ContextTree(*given.value[name], order) for name in names]
        known = np.empty(0, np.uint32)
        price = np.empty((len(names), 0))
        for batch in (b for big in batches for b in pieces([big], text, 2 << 20)):
            column = batch.column(text)
            stretches, bounds = grams(column, order)
            total = np.zeros((len(names), len(batch)))
            for start, found in stretches:
                if not names:
                    break
                keys, where = np.unique(found, return_inverse=True)
                fresh = np.setdiff1d(keys, known, assume_unique=True)
                if len(fresh):
                    if len(known) > REMEMBERED:
                        known, price, fresh = known[:0], price[:, :0], keys
                    both = np.concatenate((known, fresh))
                    order_ = np.argsort(both, kind="stable")
                    price = np.concatenate((price, np.stack([t.costs(fresh) for t in trees])), axis=1)[:, order_]
                    known = both[order_]
                at = np.searchsorted(known, keys)[where]
                first = np.searchsorted(bounds, start, "right") - 1
                last = np.searchsorted(bounds, start + len(found), "left")
                heads = np.maximum(bounds[first:last], start) - start
                full = np.diff(np.append(heads, len(found))) > 0
                for i in range(len(names)):
                    total[i, np.arange(first, last)[full]] += np.add.reduceat(price[i][at], heads[full])
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if names:
                best = total.argmin(axis=0)
                share = 1 / np.exp(np.minimum(total.min(axis=0) - total, 0)).sum(axis=0)
            told = [names[best[i]] if names and letters[i] else unknown for i in range(len(batch))]
            sure = [float(share[i]) if names and letters[i] else 0.0 for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(told, pa.string()), pa.array(sure, pa.float64())],
                [*batch.schema.names, pred, score],
            )

    return docs.mapInArrow(frugal(run), schema)
