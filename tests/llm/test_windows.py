"""Hard negatives, fill-in-middle and substring dedup against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from moothall.llm import fill_middle, negatives, substrings

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    good = {}
    for vec, values, label in rows:
        if vec is None or label is None or values is None or any(x is None or not math.isfinite(x) for x in values):
            continue
        row = (label, tuple(values))
        good[vec] = min(good.get(vec, row), row)

    def score(a, b):
        return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))

    out = []
    for anchor, (label, values) in good.items():
        if not is_anchor(anchor):
            continue
        scored = sorted(((-score(values, v), other, lab == label) for other, (lab, v) in good.items() if other != anchor))
        for negated, positive, _ in [s for s in scored if s[2]][:positives]:
            window = [s for s in scored if not s[2] and -30 * negated <= -100 * s[0] <= -90 * negated][:negatives]
            out += [(anchor, positive, k + 1, s[1], -negated, -s[0]) for k, s in enumerate(window)]
    return sorted(out)


def mined(spark, rows, schema=VECTORS, **settings):
    table = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS slot", "1 AS score", "2 AS chunk")
    found = negatives.mine(table, F.col("vec_id") % 10 == 0, **settings)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def random_vectors(seed, n, dims=6, labels=4, steps=8):
    """Coarse values, so that many scores are equal."""
    rng = random.Random(seed)
    return [(k, [rng.randrange(-2, steps) / steps for _ in range(dims)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 300), (2, 90), (3, 12)])
def test_negatives_equal_brute_force(spark, seed, n):
    rows = random_vectors(seed, n)
    assert mined(spark, rows) == brute_negatives(rows, lambda v: v % 10 == 0)


def test_negatives_in_many_chunks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS_PER_CHUNK", 3)
    monkeypatch.setattr(negatives, "ROWS_PER_SLICE", 20)
    monkeypatch.setattr(negatives, "CELLS", 40)
    rows = random_vectors(5, 260)
    assert mined(spark, rows) == brute_negatives(rows, lambda v: v % 10 == 0)


def test_negatives_odd_rows(spark):
    rows = [*random_vectors(7, 60), (10, [9.0] * 6, 3), (20, None, 1), (30, [1.0, None, 1.0], 1), (40, [float("nan")] * 6, 2),
            (50, [float("inf")] * 6, 2), (61, [1.0] * 6, None), (None, [1.0] * 6, 1), (70, [], 1), (80, [0.5, 0.5], 1),
            (90, [-1.0] * 6, 77), (3, [0.5] * 6, 2), (3, [0.5] * 6, 2)]
    expected = brute_negatives(rows, lambda v: v % 10 == 0)
    assert expected and mined(spark, rows) == expected


def test_negatives_of_a_hot_label_and_equal_vectors(spark):
    rows = [(k, [0.5, 0.25], 1) for k in range(40)] + [(100 + k, [0.25, 0.25], 2) for k in range(40)] + [(200, [0.9, 0.1], 3)]
    found = mined(spark, rows)
    assert found == brute_negatives(rows, lambda v: v % 10 == 0)
    assert {r[3] for r in found if r[0] == 0} == set(range(100, 110))  # ties by the smaller id


def test_negatives_of_large_numbers_and_no_rows(spark):
    rows = [(k, [float(10 ** (k % 4 + 4)) + k, 3.0], k % 2) for k in range(30)]
    assert mined(spark, rows) == brute_negatives(rows, lambda v: v % 10 == 0)
    assert mined(spark, []) == []
    assert len(mined(spark, [(k, [1e300, 1e300], k % 2) for k in range(12)])) >= 0  # products wrap, nothing fails


# ---- fill-in-middle ----

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc, text, seed=42, moved=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= moved:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(4)
    texts = [None, "", " ", "\t\n", "a", " a", "a ", "a <P> b", "x<S>", "<M>", "< P > <", "é ü\x1c\x85 漢字　x", "a\0b \0", "<<S", "b " * 40_000]
    return texts + ["".join(rng.choice("ab \n<>SPMé😀") for _ in range(rng.randrange(60))) for _ in range(200)]


@pytest.mark.parametrize(("moved", "spm"), [(50, 80), (100, 0), (100, 100)])
def test_fill_in_middle_equals_brute_force(spark, moved, spm):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(None, "one two three"), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS form", "'b' AS `odd name`", "7 AS n")
    out = fill_middle.fill_in_middle(docs, moved=moved, spm=spm)
    back = fill_middle.restore(out).collect()
    assert "odd name" in out.columns and len(back) == len(rows)
    expected = sorted(map(repr, (brute_middle(d, t, moved=moved, spm=spm) for d, t in rows)))
    assert sorted(map(repr, ((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back))) == expected
    for r in back:
        assert r.restored == (r.text or "")
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
    assert {r.form for r in back} >= ({"plain", "spm", "psm"} if moved == 50 else {"plain"})


def test_pieces_share_the_buffer():
    data = b"one two three four"
    parts = fill_middle.PieceTable.of(data).cut(3, 3, 9)
    assert [p.text() for p in parts] == ["one", "", " two t", "hree four"]
    assert all(buffer is data for p in parts for buffer, _, _ in p.pieces)
    assert [p.text() for p in (parts[3] + parts[0]).cut(4, 11)] == ["hree", " fouron", "e"]


def test_fill_in_middle_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restore(fill_middle.fill_in_middle(docs)).count() == 0


# ---- substring dedup ----

def brute_repeats(rows, length=20):
    """[(doc, text)] -> {(doc, text): (words, removed, kept)}."""
    texts = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    words = {key: re.findall(r"[^\x20\x09-\x0D]+", key[1]) for key in texts}
    seen, gone = set(), {key: set() for key in texts}
    for key in texts:
        for k in range(len(words[key]) - length + 1):
            window = tuple(words[key][k:k + length])
            if window in seen:
                gone[key].update(range(k, k + length))
            seen.add(window)
    out = {(d, None): (0, 0, None) for d, t in rows if t is None}
    return out | {key: (len(words[key]), len(gone[key]), " ".join(w for k, w in enumerate(words[key]) if k not in gone[key])) for key in texts}


def repeats(spark, rows, schema="doc_id long, text string", **settings):
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS body", "1 AS rank", "2 AS places", "3 AS bucket")
    found = substrings.drop_repeats(docs, one_space=True, counted=("words", "gone"), **settings)
    assert found.columns == [*docs.columns, "words", "gone"]
    return found.select("doc_id", "text", "words", "gone").collect()


def shared_passages(seed, n=60):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(15, 45))] for _ in range(12)]
    rows = []
    for doc in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            passage = rng.choice(pool)
            words += passage[rng.randrange(4):len(passage) - rng.randrange(4)] if rng.random() < 0.6 else [
                f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))]
        rows.append((doc * 3 - 20, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 20), (2, 20), (3, 5), (4, 50), (5, 3), (6, 11)])
def test_repeats_equal_brute_force(spark, seed, length):
    rows = [*shared_passages(seed), (500, None), (501, ""), (502, " \n "), (503, "a " * 100), (504, "a b " * 30), (505, "x\0 " * 40)]
    expected = brute_repeats(rows, length)
    found = {r.doc_id: (r.words, r.gone, r.text) for r in repeats(spark, rows, length=length)}
    assert found == {d: expected[d, t] for d, t in rows}
    if length == 20:
        assert sum(v[1] for v in found.values()) > 200


def test_repeats_with_small_flushes_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 50)
    monkeypatch.setattr(substrings, "BUCKET_PLACES", 20)
    rows = shared_passages(8)
    expected = brute_repeats(rows)
    assert {r.doc_id: (r.words, r.gone, r.text) for r in repeats(spark, rows)} == {d: expected[d, t] for d, t in rows}


def test_repeated_rows_null_ids_and_text_ids(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(7, passage), (7, passage), (9, "head " + passage + " tail"), (None, passage), (2, "new"), (None, passage)]
    found = sorted((str(r.doc_id), r.gone) for r in repeats(spark, rows))
    assert found == [("2", 0), ("7", 0), ("7", 0), ("9", 30), ("None", 30), ("None", 30)]
    named = [(f"id{d:02d}" if d is not None else None, t) for d, t in rows]
    assert sorted((str(r.doc_id), r.gone) for r in repeats(spark, named, "doc_id string, text string")) == [
        ("None", 30), ("None", 30), ("id02", 0), ("id07", 0), ("id07", 0), ("id09", 30)]


def test_repeats_keep_spacing_and_empty_tables(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, passage), (2, f"  first\n{passage}\n\nlast  one")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.drop_repeats(docs).collect()} == {1: passage, 2: "  first\nlast  one"}
    assert substrings.drop_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("m", [1, 3, 7, 13, 31])
def test_covers_meet_every_pair_of_residues(m):
    cover = np.array(substrings.COVERS[m])
    for a in range(m):
        for b in range(m):
            assert any((a + s) % m in cover and (b + s) % m in cover for s in range(m))
