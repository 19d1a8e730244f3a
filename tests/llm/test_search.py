"""Decontamination, Jaccard groups and line runs against brute force."""

import random

import brute
import pytest

from moothall.llm import decontaminate, jaccard, line_runs

DOCS = "doc_id long, text string, digest string, node long, n long"


def table(spark, rows, schema="doc_id long, text string"):
    """With extra columns whose names the operators use inside."""
    made = spark.createDataFrame(rows, schema)
    return made.selectExpr("*", "'x' AS digest", "1 AS node", "'y' AS body", "2 AS `at`", "0 AS n", "'z' AS window")


def random_docs(seed, n=60, vocabulary=6, longest=40):
    rng = random.Random(seed)
    rows = []
    for doc in range(n):
        if doc > 5 and rng.random() < 0.5:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice("abcdef")
        else:
            words = [rng.choice("ABCDEFéß"[:vocabulary]) * rng.randrange(1, 3) for _ in range(rng.randrange(1, longest))]
        rows.append((doc * 3, rng.choice([" ", " ", "\n"]).join(words).replace("\n", " \n")))
    return rows


EDGES = [(1, None), (4, ""), (7, " \n\t "), (None, "a b c d e f g h i j k"), (10, "x"), (13, "x"), (13, "x"), (16, "x y " * 3000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_brute_force(spark, seed):
    rows = random_docs(seed) + EDGES
    items = [(k, text) for k, text in random_docs(seed + 10, 12)] + [(90, "a"), (None, "x y x y"), (91, None), (92, "--"), (3, "x y x")]
    expected = brute.hits(rows, items, width=4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 0):  # in the task, and by a join
        found = decontaminate.find_hits(table(spark, rows), bench, width=4, broadcast_bytes=limit).collect()
        assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found))) == sorted(map(repr, expected))


def test_drop_and_cut(spark):
    docs = table(spark, [(1, "keep this: One two  three. and this"), (2, "clean"), (3, None), (4, "one two three")])
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    dropped = decontaminate.decontaminate(docs, bench, width=3)
    assert dropped.columns == docs.columns and {r.doc_id for r in dropped.collect()} == {2, 3}
    joined = decontaminate.decontaminate(docs, bench, width=3, broadcast_bytes=0)
    assert joined.columns == docs.columns and {r.doc_id for r in joined.collect()} == {2, 3}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, width=3, action="cut").collect()}
    assert cut == {1: "keep this: . and this", 2: "clean", 3: None, 4: ""}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_of_one_id_are_judged_apart_at_any_size(spark, limit):
    rows = [(1, "One two three and this"), (1, "clean words"), (None, "x one two three"), (None, "other"), (2, None), (3, "one two three"), (3, "one two three")]
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    docs = table(spark, rows)
    dropped = decontaminate.decontaminate(docs, bench, width=3, broadcast_bytes=limit)
    assert dropped.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in dropped.collect()) == [("1", "clean words"), ("2", "None"), ("None", "other")]
    cut = decontaminate.decontaminate(docs, bench, width=3, action="cut", broadcast_bytes=limit)
    assert cut.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in cut.collect()) == [
        ("1", " and this"), ("1", "clean words"), ("2", "None"), ("3", ""), ("3", ""), ("None", "other"), ("None", "x ")]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find_hits(docs, bench).count() == 0
    assert decontaminate.find_hits(some, bench).first().n_hit == 0
    assert jaccard.group_similar(docs).count() == 0
    assert line_runs.drop_copies(docs).count() == 0


@pytest.mark.parametrize(("seed", "width", "percent"), [(3, 3, 90), (4, 2, 60), (5, 5, 80)])
def test_groups_equal_brute_force(spark, seed, width, percent):
    rows = random_docs(seed, 120) + [e for e in EDGES if e[0] is not None]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.group_similar(table(spark, rows), width=width, percent=percent).collect()}
    assert found == brute.groups(rows, width, percent)


def test_chain_of_near_copies_and_common_passage(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for doc in range(60):  # each differs a little from the one before, the ends do not link
        rows.append((doc, " ".join(words)))
        words = list(words)
        words[(doc * 3) % 200] = f"v{doc}"
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(100 + k, passage + " " + " ".join(f"r{rng.random()}" for _ in range(20))) for k in range(80)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.group_similar(table(spark, rows)).collect()}
    assert found == brute.groups(rows)
    assert {found[k][1] for k in range(60)} == {0}


def test_null_ids_have_no_component(spark):
    found = jaccard.group_similar(table(spark, [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (6, "a b c d")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == [("5", 2, 5), ("6", 2, 5), ("None", 2, None), ("None", 2, None)]


@pytest.mark.parametrize("kind", ["string", "decimal(20,1)"])
def test_groups_of_other_ids(spark, kind):
    """The same groups as for whole numbers of the same order."""
    rows = random_docs(5, 40) + EDGES[:6]
    named = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        f"CAST(lpad(CAST(doc_id AS string), 5, '0') AS {kind}) AS doc_id", "text", "'x' AS digest", "'n' AS number", "3 AS id")
    expected = sorted(map(tuple, jaccard.group_similar(table(spark, rows)).collect()), key=str)
    found = jaccard.group_similar(named).collect()
    plain = [tuple(None if v is None else int(v) for v in r) for r in found]
    assert sorted(plain, key=str) == expected and jaccard.group_similar(named).schema["doc_id"].dataType == named.schema["doc_id"].dataType


def test_nul_bytes_make_other_words(spark):
    rows = [(1, "a b c d"), (2, "a b c d\0"), (3, "a\0 b c\0\0 d"), (4, "\0 \0\0 \0 \0\0 \0"), (5, "a b c d\0")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.group_similar(table(spark, rows), width=2).collect()}
    assert found == brute.groups(rows, 2)


def test_no_pair_table_in_a_large_group(spark, monkeypatch):
    """Near copies of one text are compared with one of them, not with each other."""
    words = [f"w{k}" for k in range(150)]
    rows = []
    for doc in range(300):
        copy = list(words)
        copy[doc % 150] = f"v{doc}"
        rows.append((doc, " ".join(copy)))
    compared = []
    verify = jaccard._verify

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verify", counted)
    found = {r.component_id for r in jaccard.group_similar(table(spark, rows)).collect()}
    assert found == {0} and sum(compared) < 1500


def lines_table(seed, n=25):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    rows = []
    for doc in range(n):
        lines = [rng.choice([*pool, "", "  "]) for _ in range(rng.randrange(1, 14))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            lines[rng.randrange(len(lines)):0] = other[a:a + rng.randrange(1, 8)]
        rows.append((doc * 2, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("seed", "least"), [(1, 4), (2, 9), (3, 20)])
def test_runs_equal_brute_force(spark, seed, least):
    rows = [*lines_table(seed), (1, None), (3, ""), (5, "\n\n")]
    found = line_runs.drop_copies(table(spark, rows), min_words=least)
    assert {r.doc_id: r.text for r in found.select("doc_id", "text").collect()} == brute.line_runs(rows, least)


def test_runs_of_copies_ties_and_null_ids(spark):
    text = "a b c\nd e f\n\ng h i"
    rows = [(7, text), (7, text), (9, text), (None, text), (11, "new\n" + text + "\nend"), (12, "a b c")]
    found = line_runs.drop_copies(table(spark, rows), min_words=6, counted=("lines", "gone")).select("doc_id", "text", "lines", "gone")
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, [
        (7, text, 4, 0), (7, text, 4, 0), (9, "", 4, 4), (None, text, 4, 0), (11, "new\nend", 6, 4), (12, "a b c", 1, 0)]))


def test_overlapping_copies_in_one_text(spark):
    rows = [(1, "\n".join(["a b"] * 9))]
    found = line_runs.drop_copies(table(spark, rows), min_words=4).first().text
    assert found == brute.line_runs(rows, 4)[1] == "a b"
