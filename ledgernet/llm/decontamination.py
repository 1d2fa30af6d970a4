"""Passages of benchmark items inside documents, found with an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.words import frugal, pieces

#: Fixed by the contract: what is not part of a word, after A-Z became lower case.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPLIT = str.maketrans({i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)})
LOWER = str.maketrans({i: chr(i).lower() for i in range(128)})

#: First and last word (from 0) and the characters of the original text they span.
PASSAGE = "array<struct<first:int,last:int,start:int,end:int>>"


def normalise(text: str) -> str:
    """The words of the text with single blanks between them."""
    return " ".join(filter(None, text.translate(SPLIT).split(" ")))


def windows(text: str, size: int) -> Iterator[str]:
    """Runs of ``size`` words; all words of a shorter text; nothing of an empty one."""
    found = list(filter(None, text.translate(SPLIT).split(" ")))
    for start in range(max(1, len(found) - size + 1) if found else 0):
        yield " ".join(found[start : start + size])


def automaton_of(items: list[tuple], size: int) -> ahocorasick.Automaton:
    """One automaton over the windows of all items; a window leads to its width and its items."""
    owners: dict[str, set] = {}
    for item, text in items:
        for window in windows(text or "", size):
            owners.setdefault(window, set()).update(() if item is None else (str(item),))
    machine = ahocorasick.Automaton()
    for window, names in owners.items():
        machine.add_word(f" {window} ", (window.count(" ") + 1, names))
    machine.make_automaton()
    return machine


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as disjoint ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def search(machine: ahocorasick.Automaton, text: str, before: list[tuple[int, int]], names: set) -> tuple[int, list[dict]]:
    """Number of words, and the passages that windows cover, with those found ``before``."""
    plain = normalise(text)
    n_words = plain.count(" ") + 1 if plain else 0
    ranges = list(before)
    if plain and len(machine):
        at, word = 0, -1
        for end, (width, owners) in machine.iter(f" {plain} "):
            # The blanks up to a window's closing one count the words up to its end.
            word += plain.count(" ", max(0, at - 1), end - 1) + (at == 0)
            at = end
            ranges.append((word - width + 1, word))
            names.update(owners)
    if not ranges:
        return n_words, []
    ranges = merged(ranges)
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    return n_words, [{"first": a, "last": b, "start": places[a][0], "end": places[b][1]} for a, b in ranges]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    found: str = "found",
    automaton_chars: int = 8_000_000,
) -> DataFrame:
    """The documents with a column of what they share with benchmark items.

    A window is ``size`` consecutive words of an item, or all words of a shorter one; the
    new column, ``found`` or that name with underscores behind if it is taken, holds
    ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (ids, as
    text, of the items whose windows occur, sorted) and ``passages`` (ranges of hit words,
    with their characters in the original text). Every text is read whole, once per automaton.

    An automaton holds items of about ``automaton_chars`` characters, which is what the
    driver gathers and broadcasts at once; a larger benchmark takes several automata, each
    adding to what the former have found.

    Null and empty texts have no words and no hits. An item without words matches nothing;
    one without an id marks words but is not listed. Repeated items count once. All columns
    and rows of ``docs`` are kept, repeated ones too.
    """
    found = free_name(docs, found)
    items = benchmark.select(field(benchmark, item_id).alias("id"), field(benchmark, item_text).alias("body")).distinct()
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, -(-chars // automaton_chars))
    kind = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,passages:{PASSAGE}>"
    out = docs.withColumn(found, F.lit(None).cast(kind))
    for part in range(parts):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("body"), F.lit(parts)) == part).collect()]
        known = docs.sparkSession.sparkContext.broadcast(rows)
        out = out.mapInArrow(frugal(_searching(known, text, found, size)), out.schema)
    return out


def _searching(known, text: str, found: str, size: int):
    def run(batches):
        machine = automaton_of(known.value, size)
        for batch in (b for big in batches for b in pieces([big], text)):
            at = batch.schema.get_field_index(found)
            out = []
            for body, before in zip(batch.column(text).to_pylist(), batch.column(at).to_pylist()):
                names = set(before["items"]) if before else set()
                ranges = [(p["first"], p["last"]) for p in before["passages"]] if before else []
                n_words, passages = search(machine, body or "", ranges, names)
                n_hit = sum(p["last"] - p["first"] + 1 for p in passages)
                out.append({"n_words": n_words, "n_hit": n_hit, "items": sorted(names), "passages": passages})
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run
