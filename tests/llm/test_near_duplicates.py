import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgernet.llm.components import components
from ledgernet.llm.embedding_dedup import near_vectors, nearest_cells
from ledgernet.llm.minhash import near_duplicates, super_minhash


def smallest_reached(nodes, links):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        label[high] = low
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reached({x for pair in links for x in pair}, links)
    assert got == {n: c for n, c in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (4, 60, 2000):
        a, b = values[:n], values[n // 4 : n + n // 4]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        share = (super_minhash(a, 512) == super_minhash(b, 512)).mean()
        assert abs(share - truth) < 4 * math.sqrt(0.25 / 512)
        assert (super_minhash(a, 64) == super_minhash(a[::-1], 64)).all()


def texts():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyz")
    out, base = [], [[word() for _ in range(60)] for _ in range(6)]
    for family, words in enumerate(base):
        for copy in range(14):
            mine = list(words)
            for _ in range(copy % 5):
                mine[rng.randrange(60)] = word()
            out.append((1000 * (family + 1) + copy, " ".join(mine) if copy % 2 else "\n".join(mine).upper()))
    out += [(1, "one two"), (2, "ONE\ttwo"), (3, None), (4, ""), (5, " \n"), (None, "one two"), (6, "one two three"), (1000, out[0][1])]
    out += [(7, "w " * 50_000), (8, "w w w w w")]
    return out


def sets_of(text, size):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@pytest.mark.parametrize("options", [{"size": 4}, {"size": 5, "block": 3}])
def test_groups_match_brute_force(spark, options):
    rows = texts()
    shingles = [(i, sets_of(t, options["size"])) for i, t in rows if i is not None]
    links = [
        (a, b)
        for a, x in shingles
        for b, y in shingles
        if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    want = smallest_reached({i for i, _ in shingles}, links)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("kept", F.lit("x"))
    got = near_duplicates(df, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] == len(dict(shingles)[r["doc_id"]])


def test_no_documents(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_traversal_takes_cells_by_rising_sums():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random(7), rng.random(5)
        cells, last = nearest_cells(a, b, 12)
        sums = np.sort((a[:, None] + b[None, :]).ravel())
        assert [a[c // 5] + b[c % 5] for c in cells] == pytest.approx(sums[:12].tolist()) and last == pytest.approx(sums[11])
    assert len(nearest_cells(np.zeros(3), np.zeros(3), 2)[0]) == 9  # ties all come along


@pytest.mark.parametrize("options", [{}, {"per_cell": 8, "member_block": 4, "visitor_block": 8}])
def test_vector_links_match_brute_force(spark, options):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 9))
    rows = [(i, (base[i % 20] * (1 + i % 3) + rng.normal(size=9) * 0.12 * (i % 4)).tolist()) for i in range(160)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1])]
    bad = [(300, None), (301, []), (302, [0.0] * 9), (303, [float("nan")] * 9), (304, [None] * 9), (305, [1.0, 2.0]), (306, [float("inf")] * 9)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    want = smallest_reached(range(len(rows)), zip(*np.nonzero(linked)))
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("n", F.lit(0)).withColumn("v", F.lit(0))
    got = near_vectors(df, **options).collect()
    assert len(got) == len(rows) + len(bad)
    groups = {}
    for i, top in want.items():
        groups.setdefault(top, []).append(i)
    expected = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[want[i]] if rows[j][0] is not None]
        expected.append((key, int(linked[i].sum()), min(ids) if ids else None))
    expected += [(key, 0, key) for key, _ in bad]
    order = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=order) == sorted(expected, key=order)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(none).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in near_vectors(one).collect()] == [(1, 0, 1, True)]
