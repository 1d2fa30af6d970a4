"""Toxic text: a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.labelled import labelled
from ledgernet.llm.shared import handed_out, kept, received
from ledgernet.llm.words import frugal, give_back, hashes, pieces, words

#: Words that pass the network together.
TOGETHER = 200_000
#: Texts that one task passes many times, and the greatest number of tasks that learn side by side.
FEW, TASKS = 6000, 8
#: Bins of log odds in a unit, by which the thresholds are found.
BINS = 1000
#: How much more a false alarm weighs than a miss.
ALARM = 2.0
#: Characters at a word's beginning that are taken for its stem.
STEM = 5
#: What is cut off both ends of a word before it is hashed.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Shape:
    """Sizes of the network: rows of the hashed table, numbers per word and per filter width."""

    rows_log2: int = 18
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8


@dataclass
class Model:
    """Weights of the network, word counts by language, and the thresholds of languages."""

    shape: Shape
    table: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    constant: float
    languages: list[str]
    voices: np.ndarray
    thresholds: np.ndarray
    scale: float


def rows_of(text: pa.Array, rows_log2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two table rows for each distinct word, the word of each position, and where texts begin.

    One row is that of the word without punctuation around it, the other that of how it
    begins, so that forms of a word that were never seen are known by their stem.
    """
    distinct, codes, bounds = words(text)
    bare = pc.utf8_trim(distinct, EDGES)
    stem = pc.utf8_slice_codeunits(bare, 0, STEM).dictionary_encode()
    mask = np.uint64((1 << rows_log2) - 1)
    second = hashes(stem.dictionary, seed=1)[stem.indices.to_numpy()]
    rows = np.stack((hashes(bare) & mask, second & mask), axis=1).astype(np.int64)
    return rows, codes, bounds


def embedded(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers of a word: those of its two rows side by side."""
    return np.concatenate((table[rows[:, 0]], table[rows[:, 1]]), axis=1)


def activations(model: Model, words_in: np.ndarray, codes: np.ndarray, bounds: np.ndarray, where: bool = False):
    """For each text the largest response of each filter, and the position of it if ``where``.

    Positions behind a text's last word count as blank, so every text has at least one.
    Responses are sums of what each distinct word gives at each place of a filter, so the
    products are made once per distinct word.
    """
    n_texts = len(bounds) - 1
    longest = max(model.shape.widths) - 1
    blank = len(words_in)
    # Each text is followed by blanks.
    padded = np.full(len(codes) + n_texts * (longest + 1), blank, np.int64)
    place = np.arange(len(codes)) + np.repeat(np.arange(n_texts), np.diff(bounds)) * (longest + 1)
    padded[place] = codes
    heads = bounds[:-1] + np.arange(n_texts) * (longest + 1)
    stack = np.concatenate((words_in, np.zeros((1, words_in.shape[1]), words_in.dtype)))
    pooled, spots = [], []
    for width, kernel, bias in zip(model.shape.widths, model.kernels, model.bias):
        response = np.zeros((len(padded), model.shape.filters), np.float32)
        for j in range(width):
            given = stack @ kernel[j]
            response[: len(padded) - j] += given[padded[j:]]
        # Windows end inside their text or its blanks: the last positions only see blanks.
        best = np.maximum.reduceat(response, heads, axis=0)
        pooled.append(np.maximum(best + bias, 0))
        if where:
            spot = np.empty((n_texts, model.shape.filters), np.int64)
            ends = np.append(heads[1:], len(padded))
            for i, (a, b) in enumerate(zip(heads.tolist(), ends.tolist())):
                spot[i] = a + response[a:b].argmax(axis=0)
            spots.append(spot)
    return np.concatenate(pooled, axis=1), spots, padded


def voices_of(counts: np.ndarray) -> np.ndarray:
    """Log shares of table rows per language, from counts (language, row)."""
    counts = counts + 0.05
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def spoken(voices: np.ndarray, rows: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of the language whose words are likeliest, for each text; 0 for a text without words."""
    n_texts = len(bounds) - 1
    out = np.zeros((len(voices), n_texts))
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for i, voice in enumerate(voices):
            out[i, full] = np.add.reduceat(voice[rows[:, 0]][codes], bounds[:-1][full])
    return out.argmax(axis=0)


def tokens_of(text: pa.Array, rows_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The two table rows of each word of all texts, and where texts begin."""
    rows, codes, bounds = rows_of(text, rows_log2)
    return rows.astype(np.int32)[codes], bounds


def distinct_words(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of table rows, and the number of each token's pair."""
    kinds = np.empty(0, np.int64)
    codes = np.empty(len(tokens), np.int32)
    joint = lambda at: tokens[at : at + TOGETHER, 0].astype(np.int64) << 32 | tokens[at : at + TOGETHER, 1]
    for at in range(0, len(tokens), TOGETHER):
        kinds = np.union1d(kinds, joint(at))
    for at in range(0, len(tokens), TOGETHER):
        codes[at : at + TOGETHER] = np.searchsorted(kinds, joint(at))
    return np.stack((kinds >> 32, kinds & 0xFFFFFFFF), axis=1), codes


def counted(rows: DataFrame, names: list[str], rows_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold a table row, by side and class, and words with it by language, over all rows.

    Tasks count on their own; what is summed and sent is bounded by the table.
    """
    size = 1 << rows_log2

    def run(batches):
        held, told = np.zeros((2, 2, size), np.int64), np.zeros((len(names), size), np.int64)
        for batch in _some_words(batches):
            tokens, bounds = _stored_tokens(batch)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            label = batch.column("label").to_numpy()
            for side in range(2):
                # A text counts once.
                kinds = np.unique(owner * np.int64(size) + tokens[:, side])
                np.add.at(held[side], (label[kinds // size], kinds % size), 1)
            spoken_in = np.array([names.index(x) if x in names else -1 for x in batch.column("lang").to_pylist()], np.int64)[owner]
            known = spoken_in >= 0
            np.add.at(told, (spoken_in[known], tokens[known, 0]), 1)
        flat = np.concatenate((held.reshape(4, size), told))
        kind, place = np.nonzero(flat)
        yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(flat[kind, place])], ["kind", "place", "n"])

    found = rows.mapInArrow(frugal(run), "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros((4 + len(names), size), np.int64)
    flat[found["kind"].to_numpy(), found["place"].to_numpy()] = found["n"].to_numpy()
    return flat[:4].reshape(2, 2, size), flat[4:]


def train(
    rows: DataFrame, *, shape: Shape, seed: int = 7, epochs: int = 12, rate: float = 0.02, batch: int = 64,
) -> Model:
    """Fit the network to all rows with Adam on the logistic loss, then one threshold per language.

    ``rows`` is ``(mark, label, lang, bare, stem)``, stored. The table starts from small random
    numbers, but for one of a word's numbers: the excess of its row in toxic texts over its
    share elsewhere, in standard deviations beyond those of as many as ``FEW`` texts. Tasks descend
    through their own rows, and their networks are averaged twice. Up to ``FEW`` texts one task
    passes them ``epochs`` times, more texts are passed less often, twice at least. A fifth of
    the texts is held back; on them each language gets the threshold that halves the gap
    between the classes best, drawn towards the common one where texts are few.
    """
    random = np.random.default_rng(seed)
    counts = {0: 0, 1: 0, **dict(rows.groupBy("label").count().collect())}
    n = counts[0] + counts[1]
    names = sorted(r[0] for r in rows.select("lang").where("lang is not null").distinct().collect()) or ["any"]
    tasks = min(TASKS, max(1, n // FEW))
    rows = rows.coalesce(tasks)
    held, told = counted(rows, names, shape.rows_log2)
    size = 1 << shape.rows_log2
    table = random.normal(0, 0.05, (size, shape.size)).astype(np.float32)
    n1, n0 = max(1.0, counts[1]), max(1.0, counts[0])
    for side in range(2):
        c0, c1 = held[side]
        p = (c1 + c0 + 1) / (n + 2)
        z = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) * np.sqrt(min(1.0, FEW / max(1, n)))
        z[c1 + c0 < 2] = 0
        excess = np.sign(z) * np.minimum(np.maximum(np.abs(z) - 2.5, 0), 8) / 4
        # Number ``side`` of a row serves words that use the row on that side.
        table[:, side] = excess
    wide = 2 * shape.size
    model = Model(
        shape, table,
        [random.normal(0, 0.3, (w, wide, shape.filters)).astype(np.float32) for w in shape.widths],
        [np.zeros(shape.filters, np.float32) for _ in shape.widths],
        random.normal(0, 0.3, shape.filters * len(shape.widths)).astype(np.float32),
        -1.0, names, voices_of(told), np.zeros(len(names)), 1.0,
    )
    if not counts[0] or not counts[1]:
        # Nothing to tell apart: every text gets the one class there is, or is not toxic.
        model.out[:] = 0
        model.constant = 1.0 if counts[1] else -1.0
        return model
    for kernel in model.kernels:  # One filter of each width listens to the informed numbers.
        kernel[:, [0, shape.size + 1], 0] = 0.5
    model.out[:: shape.filters] = 1.0

    kept_back = F.pmod("mark", F.lit(5)) == 0
    of_held = dict(rows.where(kept_back).groupBy("label").count().collect())
    judged, learn = rows, rows
    if min(of_held.get(k, 0) for k in (0, 1)) >= 2 and all(counts[k] - of_held[k] >= 2 for k in (0, 1)):
        judged, learn = rows.where(kept_back), rows.where(~kept_back)
    rounds = 2 if tasks > 1 else 1
    passes = max(1, min(epochs, FEW * epochs // n // rounds))
    for turn in range(rounds):
        _average(model, learn, n0 / n1, passes, rate, batch, seed + turn)

    bins = _judgements(model, judged)
    logits, y, times, talk = (bins[c].to_numpy() for c in ("bin", "label", "n", "talk"))
    logits = logits / BINS
    common = threshold(logits, y.astype(float), 0.0, 0.0, times)
    model.thresholds = np.array(
        [threshold(logits[talk == i], y[talk == i].astype(float), common, 10.0, times[talk == i]) for i in range(len(names))]
    )
    away = np.abs(logits - common)
    order = np.argsort(away)
    middle = away[order][np.searchsorted(np.cumsum(times[order]), times.sum() / 2)]
    model.scale = float(max(1e-3, middle / 3))
    return model


def _some_words(batches):
    """Slices of stored texts with about ``TOGETHER`` words, one text at least."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("bare")).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // TOGETHER
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def _stored_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two table rows of each word of stored texts, and where texts begin."""
    sides = [batch.column(c).flatten().to_numpy() for c in ("bare", "stem")]
    lengths = pc.list_value_length(batch.column("bare")).to_numpy(zero_copy_only=False)
    return np.stack(sides, axis=1), np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _average(model: Model, rows: DataFrame, weight: float, passes: int, rate: float, size: int, seed: int) -> None:
    """Descend in each task through its rows, then take the mean of the networks.

    A row of the table is averaged over the tasks that moved it.
    """
    given = handed_out(rows.sparkSession, model)

    def run(batches):
        net = pickle.loads(given.value)  # A copy of its own: it changes.
        before, state, step = net.table.copy(), {}, 0
        random = np.random.default_rng(seed)
        for batch in batches:
            tokens, bounds = _stored_tokens(batch)
            y = batch.column("label").to_numpy().astype(np.float32)
            kinds, codes = distinct_words(tokens)
            del batch, tokens  # The passes need neither.
            order = np.arange(len(y))
            for _ in range(passes):
                random.shuffle(order)
                for at in range(0, len(order), size):
                    step += 1
                    _descend(net, kinds, codes, bounds, order[at : at + size], y, state, step, rate, weight)
        moved = np.flatnonzero((net.table != before).any(axis=1))
        dense = pickle.dumps((net.kernels, net.bias, net.out, net.constant))
        values = [step, moved.tobytes(), (net.table - before)[moved].tobytes(), dense]
        yield pa.record_batch([pa.array([v]) for v in values], ["steps", "moved", "change", "dense"])

    found = [r for r in rows.mapInArrow(frugal(run), "steps long, moved binary, change binary, dense binary").collect() if r["steps"]]
    given.destroy()
    total, touched = np.zeros_like(model.table), np.zeros(len(model.table))
    share = np.array([r["steps"] for r in found], float)
    share /= share.sum()
    for r in found:
        moved = np.frombuffer(r["moved"], np.int64)
        total[moved] += np.frombuffer(r["change"], np.float32).reshape(len(moved), -1)
        touched[moved] += 1
    model.table += total / np.maximum(touched, 1)[:, None].astype(np.float32)
    nets = [pickle.loads(r["dense"]) for r in found]
    mean = lambda some: sum(a * x for a, x in zip(share, some)).astype(np.float32)
    model.kernels = [mean([net[0][k] for net in nets]) for k in range(len(model.kernels))]
    model.bias = [mean([net[1][k] for net in nets]) for k in range(len(model.bias))]
    model.out = mean([net[2] for net in nets])
    model.constant = float(sum(a * net[3] for a, net in zip(share, nets)))


def _judgements(model: Model, rows: DataFrame) -> pa.Table:
    """``(talk, bin, label, n)``: how many of the rows have log odds in each bin, by told language."""
    given = handed_out(rows.sparkSession, model)

    def run(batches):
        net = received(given)
        for batch in _some_words(batches):
            tokens, bounds = _stored_tokens(batch)
            kinds, codes = distinct_words(tokens)
            logits = np.clip(logits_of(net, kinds, codes, bounds), -50, 50)
            talk = spoken(net.voices, kinds, codes, bounds)
            place = np.round(logits * BINS).astype(np.int64)
            yield pa.record_batch([pa.array(talk, pa.int32()), pa.array(place), batch.column("label")], ["talk", "bin", "label"])

    told = rows.mapInArrow(frugal(run), "talk int, bin long, label int")
    return told.groupBy("talk", "bin", "label").agg(F.count("*").alias("n")).toArrow()


def _descend(model, rows, codes, bounds, some, y, state, step, rate, weight) -> None:
    """One Adam step on a few texts; only rows of the table that a maximum touches move."""
    part = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some]) if len(some) else np.empty(0, np.int64)
    used, local = np.unique(codes[part], return_inverse=True)
    local_bounds = np.concatenate(([0], np.cumsum(np.diff(bounds)[some])))
    vectors = embedded(model.table, rows[used])
    pooled, spots, padded = activations(model, vectors, local, local_bounds, where=True)
    logit = pooled @ model.out + model.constant
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    heavy = np.where(y[some] > 0, weight, 1.0)
    error = ((p - y[some]) * heavy / heavy.sum()).astype(np.float32)
    grads = {"out": pooled.T @ error + 1e-4 * model.out, "constant": np.array([error.sum()])}
    back = error[:, None] * model.out[None, :]
    back[pooled <= 0] = 0
    stack = np.concatenate((vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)))
    moved = np.zeros_like(stack)
    for k, width in enumerate(model.shape.widths):
        g = back[:, k * model.shape.filters : (k + 1) * model.shape.filters]
        grads[f"bias{k}"] = g.sum(axis=0)
        kernel = np.zeros_like(model.kernels[k])
        for j in range(width):
            seen = padded[np.minimum(spots[k] + j, len(padded) - 1)]
            for f in range(model.shape.filters):
                kernel[j, :, f] = stack[seen[:, f]].T @ g[:, f]
                np.add.at(moved, seen[:, f], g[:, f, None] * model.kernels[k][j, :, f][None, :])
        grads[f"kernel{k}"] = kernel + 1e-4 * model.kernels[k]

    def adam(name, value, grad):
        m, v = state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        state[name] = (m, v)
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    model.out = adam("out", model.out, grads["out"]).astype(np.float32)
    model.constant = float(adam("constant", np.array([model.constant]), grads["constant"])[0])
    for k in range(len(model.kernels)):
        model.kernels[k] = adam(f"kernel{k}", model.kernels[k], grads[f"kernel{k}"]).astype(np.float32)
        model.bias[k] = adam(f"bias{k}", model.bias[k], grads[f"bias{k}"]).astype(np.float32)
    half = model.shape.size
    touched = np.flatnonzero(np.abs(moved[:-1]).sum(axis=1) > 0)
    np.add.at(model.table, rows[used[touched], 0], -5 * rate * moved[touched, :half])
    np.add.at(model.table, rows[used[touched], 1], -5 * rate * moved[touched, half:])


def logits_of(model: Model, rows: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log odds of all texts, some thousand words at a time."""
    out = []
    part = np.cumsum(np.diff(bounds)) // TOGETHER if len(bounds) > 1 else np.empty(0, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            some = codes[bounds[start] : bounds[end]]
            used, local = np.unique(some, return_inverse=True)
            vectors = embedded(model.table, rows[used])
            pooled, _, _ = activations(model, vectors, local, bounds[start : end + 1] - bounds[start])
            out.append(pooled @ model.out + model.constant)
    return np.concatenate(out) if out else np.empty(0)


def threshold(logits: np.ndarray, y: np.ndarray, prior: float, weight: float, times: np.ndarray | None = None) -> float:
    """The cut with the least weighed share of errors, midway in a gap.

    A share of false alarms counts ``ALARM`` times as much as the same share of misses.
    ``prior`` counts as ``weight`` texts; without texts of both classes it is the answer.
    Entry i stands for ``times[i]`` texts; the cut parts only different log odds.
    """
    if not len(y) or y.min() == y.max():
        return prior if weight else 0.0
    times = np.ones(len(y)) if times is None else times
    s, group = np.unique(logits, return_inverse=True)
    bad, fine = np.bincount(group, times * y, len(s)), np.bincount(group, times * (1 - y), len(s))
    missed = np.concatenate(([0], np.cumsum(bad))) / max(1, bad.sum())
    false = 1 - np.concatenate(([0], np.cumsum(fine))) / max(1, fine.sum())
    wrong = missed + ALARM * false
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    low, high = best[0], best[-1]
    left = s[max(0, low - 1)]
    right = s[min(len(s) - 1, high)]
    cut = (left + right) / 2
    share = bad.sum() / (bad.sum() + weight)
    return float(share * cut + (1 - share) * prior)


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang",
    **options,
) -> Model:
    """Fit on all documents with a label.

    Their hashed words are stored, texts are not. Documents without text, key or label are
    left out; of documents that share a key one is taken.
    """
    shape = options.pop("shape", None) or Shape()
    pairs = labelled(docs, labels, key, text, label)
    read = docs.select(field(docs, key).alias("key"), field(docs, text).alias("text"), field(docs, lang).cast("string").alias("lang"))
    chosen = read.where("text is not null").join(pairs, "key").dropDuplicates(["key", "label"])

    def run(batches):
        for batch in (b for big in batches for b in pieces([big], "text", 1 << 20)):
            tokens, bounds = tokens_of(batch.column("text"), shape.rows_log2)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens[:, side])) for side in range(2)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("mark", "label", "lang")), *lists], ["mark", "label", "lang", "bare", "stem"]
            )

    hashed = chosen.select(F.xxhash64(F.lit(32), "key").alias("mark"), "label", "lang", "text").mapInArrow(
        frugal(run), "mark long, label int, lang string, bare array<int>, stem array<int>"
    )
    try:
        return train(kept(hashed, "tokens"), shape=shape, **options)
    finally:
        give_back()


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows with ``toxicity`` (0 to 1) and ``is_toxic`` (0.5 or more).

    Every word of a text is read. The score is the logistic of the distance of its log odds
    from the threshold of the language its words suggest; labels, languages and sources of
    the rows are not read. Null and empty texts are scored as texts without words. All rows
    and columns are kept; new columns get underscores behind taken names.
    """
    score, flag = free_name(docs, "toxicity"), free_name(docs, "is_toxic")
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(flag, T.BooleanType())])
    given = handed_out(docs.sparkSession, model)

    def run(batches):
        net = received(given)
        for batch in (b for big in batches for b in pieces([big], text, 2 << 20)):
            rows, codes, bounds = rows_of(batch.column(text), net.shape.rows_log2)
            logits = logits_of(net, rows, codes, bounds)
            cut = net.thresholds[spoken(net.voices, rows, codes, bounds)]
            value = 1 / (1 + np.exp(-np.clip((logits - cut) / net.scale, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value, pa.float64()), pa.array(value >= 0.5)], [*batch.schema.names, score, flag]
            )

    return docs.mapInArrow(frugal(run), schema)
