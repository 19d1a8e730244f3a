"""Pruned nearest-neighbour searches against brute force, with hot groups of copies."""

import random

import numpy as np
import pytest

from moothall.operators import similarity as sim


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


@pytest.mark.parametrize("block", [2, 256])
def test_nearest_by_edit_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sim, "TEXTS_PER_BLOCK", block)
    rng = random.Random(block)
    words = ["ring", "bolt", "Gear", "żółw", "a", "", "x" * 40, "hot 😀 gear", "ab"]

    def title():
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
        return text[: rng.randint(0, len(text))] + rng.choice(["", "z", "qq"]) if rng.random() < 0.5 else text

    left = [title() for _ in range(60)] + ["hot ring"] * 30 + ["far away " * 12]
    right = [title() for _ in range(60)] + ["hot rings"] * 40
    found = sim.nearest_by_edit(
        spark.createDataFrame(list(enumerate(left)), "lid long, t string"),
        spark.createDataFrame(list(enumerate(right)), "rid long, t string"), "lid", "rid", "t").collect()
    assert len(found) == len(left)
    for row in found:
        expected = min((edit(left[row.lid].lower(), t.lower()), i) for i, t in enumerate(right))
        assert (row.distance, row.nearest_rid) == expected


@pytest.mark.parametrize("few", [16, 0])
def test_nearest_by_cosine_equals_brute_force(spark, monkeypatch, few):
    """Both ways to search, with a third of the keys equal and blocks that are small."""
    monkeypatch.setattr(sim, "KEYS_PER_BLOCK", 16)
    monkeypatch.setattr(sim, "QUERIES_PER_BLOCK", 8)
    rng = np.random.default_rng(few)
    centres = rng.normal(size=(6, 5))
    keys = centres[rng.integers(0, 6, 300)] + 0.1 * rng.normal(size=(300, 5))
    keys[100:200] = keys[100]
    keys[7] = 0
    asked = centres[rng.integers(0, 6, 80)] + 0.1 * rng.normal(size=(80, 5))
    asked[3] = 0

    def frame(rows, name):
        return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rows)], f"{name} long, v array<double>")

    found = {r.q: r.nearest_k for r in sim.nearest_by_cosine(frame(asked, "q"), frame(keys, "k"), "q", "k", "v", few_blocks=few).collect()}
    unit = [rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12) for rows in (asked, keys)]
    product = np.round(unit[0] @ unit[1].T, 12)
    assert found == {i: int(row.argmax()) for i, row in enumerate(product)}


def test_left_rows_without_a_match_stay(spark):
    left = spark.createDataFrame([(1, None), (2, "abc"), (3, "")], "lid long, t string")
    right = spark.createDataFrame([(7, "abd"), (8, None)], "rid long, t string")
    found = {r.lid: (r.distance, r.nearest_rid) for r in sim.nearest_by_edit(left, right, "lid", "rid", "t").collect()}
    assert found == {1: (None, None), 2: (1, 7), 3: (3, 7)}
    alone = sim.nearest_by_edit(left, right.limit(0), "lid", "rid", "t").collect()
    assert sorted((r.lid, r.distance) for r in alone) == [(1, None), (2, None), (3, None)]


def test_approximate_search_means_one_block_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(sim, "KEYS_PER_BLOCK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6))
    keys = centres[rng.integers(0, 8, 400)] + 0.05 * rng.normal(size=(400, 6))
    asked = centres[rng.integers(0, 8, 100)] + 0.05 * rng.normal(size=(100, 6))
    frames = [spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rows)], f"{name} long, v array<double>")
              for rows, name in ((asked, "q"), (keys, "k"))]
    unit = [rows / np.linalg.norm(rows, axis=1, keepdims=True) for rows in (asked, keys)]
    product = unit[0] @ unit[1].T
    answers = [{r.q: (r.nearest_k, r.sim) for r in sim.nearest_by_cosine(*frames, "q", "k", "v", approx=True, few_blocks=few).collect()}
               for few in (0, 16)]
    assert answers[0] == answers[1] and len(answers[0]) == 100
    assert all(abs(product[q, k] - s) < 1e-9 for q, (k, s) in answers[0].items())
    assert np.mean([product[q].max() - s < 0.02 for q, (_, s) in answers[0].items()]) >= 0.9


def test_nearest_by_cosine_without_keys(spark):
    empty = spark.createDataFrame([], "k long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q long, v array<double>")
    assert sim.nearest_by_cosine(asked, empty, "q", "k", "v").count() == 0


def test_soft_align_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sim, "KEYS_PER_BLOCK", 4)
    rng = np.random.default_rng(1)
    refs, cands = rng.normal(size=(3, 9, 4)), rng.normal(size=(3, 12, 4))

    def frame(rows):
        return spark.createDataFrame([(p, i, [float(x) for x in v]) for p, text in enumerate(rows) for i, v in enumerate(text)],
                                     "pair_id long, pos long, vec array<double>")

    found = {r.pair_id: r.score for r in sim.soft_align(frame(refs), frame(cands)).collect()}
    for p in range(3):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (refs[p][1:-1], cands[p][1:-1]))
        assert found[p] == pytest.approx((a @ b.T).max(axis=1).sum() / 9)


@pytest.mark.parametrize("few", [16, 0])
def test_cosine_moves_rows_by_tile_not_by_key(spark, monkeypatch, few):
    """Vectors without clusters: each row moves at most once per tile of the other side."""
    monkeypatch.setattr(sim, "KEYS_PER_BLOCK", 4 if few == 0 else 16)
    monkeypatch.setattr(sim, "QUERIES_PER_BLOCK", 2)
    rng = np.random.default_rng(5)
    keys, asked = rng.normal(size=(400, 12)), rng.normal(size=(150, 12))
    moved, search = [], sim._best_in_tiles

    def watched(queries, held):
        sizes = {r["tile"]: r["count"] for r in held.groupBy("tile").count().collect()}
        moved.append((sum(len(r.tiles) for r in queries.select("tiles").collect()), len(sizes), max(sizes.values()),
                      max(r["count"] for r in queries.groupBy("ask").count().collect())))
        return search(queries, held)

    monkeypatch.setattr(sim, "_best_in_tiles", watched)
    frames = [spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rows)], f"{name} long, v array<double>")
              for rows, name in ((asked, "q"), (keys, "k"))]
    found = {r.q: r.nearest_k for r in sim.nearest_by_cosine(*frames, "q", "k", "v", few_blocks=few).collect()}
    unit = [rows / np.linalg.norm(rows, axis=1, keepdims=True) for rows in (asked, keys)]
    assert found == {i: int(row.argmax()) for i, row in enumerate(unit[0] @ unit[1].T)}
    per_tile = sim.KEY_BLOCKS_PER_TILE * sim.KEYS_PER_BLOCK
    for rows, tiles, fullest, asking in moved:
        assert rows <= 150 * tiles and tiles <= 2 * -(-400 // per_tile) + 2
        assert fullest <= 2 * per_tile and asking <= 2 * sim.QUERY_BLOCKS_PER_TILE * sim.QUERIES_PER_BLOCK
