"""Outlier rules, mixing, language, tokens and the pipeline against plain versions."""

import math
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moothall.llm import language, mixing, outliers, token_counts

SF_DIR = "/root/testdata/sf0.001"
EDGES = [(9001, None, None, None), (9002, "", "en", None), (9003, " \n", None, "s"), (None, "one two", "en", "s"),
         (9004, "a b c d e f g h " * 4000, "en", "s"), (9004, "a b c d e f g h " * 4000, "en", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS unit", "1 AS x", "2 AS place", "3 AS size", "'k' AS `row`", "0 AS slots")


def prose(seed, n=260):
    """Mostly even prose in two languages, with shouted, marked and repeated texts."""
    rng = random.Random(seed)
    rows = []
    for doc in range(n):
        lang = rng.choice(["en", "en", "de"])
        stems = ["lorem", "ipsum", "dolor", "sit", "amet", "erat"] if lang == "en" else ["und", "nicht", "werden", "durch", "gegen"]
        words = [rng.choice(stems) + rng.choice(["", "s", "en", ",", "."]) for _ in range(rng.randrange(12, 120))]
        words = [w.capitalize() if rng.random() < 0.12 else w for w in words]
        if doc % 17 == 3:
            words = [w.upper() + "!!" for w in words]
        elif doc % 17 == 5:
            words = [w + "%%%" for w in words]
        elif doc % 17 == 7:
            words = words[:9] * (len(words) // 9 + 1)
        rows.append((doc, " ".join(words).replace(". ", ".\n"), lang, rng.choice(["s1", "s1", "s2", None])))
    return rows


# ---- outlier rules ----

@pytest.mark.parametrize("few", [outliers.BROADCAST_GROUPS, 0])
def test_outliers_equal_numpy(spark, few):
    rows = prose(1) + EDGES[:3]
    counted = outliers.with_statistics(table(spark, rows))
    judged = outliers.judge(counted, outliers.fit(counted, broadcast_groups=few), broadcast_groups=few)
    expected = brute.outliers(rows)
    found = {r.doc_id: r for r in judged.select("doc_id", "__stat", "__kept").collect()}
    assert {k: r["__kept"] for k, r in found.items()} == expected
    for doc, text, _, _ in rows:
        stat = found[doc]["__stat"]
        assert (stat.n_words, stat.word_chars, stat.n_symbols, stat.n_dup_lines, stat.n_repeat_words) == brute.counts(text)[:5]
    marked = [doc for doc, text, _, _ in rows if text and ("!!" in text or "%%%" in text) and len(text.split()) > 40]
    assert marked and not any(expected[doc] for doc in marked)
    assert sum(expected.values()) > 150


@pytest.mark.parametrize("few", [outliers.BROADCAST_GROUPS, 0])
def test_a_source_with_many_marked_texts(spark, few):
    rng = random.Random(3)
    rows = []
    for doc in range(300):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "erat"]) + rng.choice(["", "s", "en", ",", "."]) for _ in range(rng.randrange(60, 160))]
        share = rng.uniform(0.2, 0.6) if doc < 120 else 0
        words = [w + "%" if rng.random() < share else w.capitalize() if rng.random() < 0.12 else w for w in words]
        rows.append((doc, " ".join(words), "en", "hot"))
    counted = outliers.with_statistics(table(spark, rows))
    kept = {r.doc_id for r in outliers.judge(counted, outliers.fit(counted, broadcast_groups=few), broadcast_groups=few).filter("__kept").collect()}
    assert kept == set(range(120, 300))


def test_outliers_of_edge_rows(spark):
    docs = table(spark, EDGES)
    assert outliers.drop_outliers(docs).columns == docs.columns and outliers.drop_outliers(docs).count() == 0
    assert outliers.drop_outliers(docs.limit(0)).count() == 0
    stat = {r.doc_id: r["__stat"] for r in outliers.with_statistics(docs).collect()}
    assert stat[9004].n_repeat_words == 32000 and stat[9001].base_failed and stat[9003].n_words == 0


def test_few_vectors_reject_nothing(spark):
    rows = [(k, "word " + " ".join(f"w{k * j}" for j in range(30)), "en", f"s{k}") for k in range(1, 21)]
    assert outliers.drop_outliers(table(spark, rows)).count() == 20


# ---- mixing ----

def test_targets_fill_by_weight(spark):
    for sizes in ({"a": 100, "b": 1, "c": 50, "d": 0, None: 7}, {"b": 3}, {"x": 0, "y": 0}, {"a": 10, "B": 1000, "é": 1, "z": 2, "zz": 900}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        expected = brute.targets(sizes)
        assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-6 for s in found), (found, expected)


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 64, 1000):
        at = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(n))
        assert sorted(r[0] for r in spark.range(n).select(at).collect()) == list(range(n))


def test_mix_meets_targets_and_limits(spark):
    rows = [(k, "w " * (k % 90), "en", None if k % 11 == 0 else f"s{min(k % 5, k % 3)}") for k in range(600)] + EDGES
    docs = table(spark, rows)
    found = mixing.mixed_sizes(docs, block_words=16, shard_slots=50).collect()
    again = mixing.mixed_sizes(docs.repartition(5, "doc_id"), block_words=16, shard_slots=50).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(rows)
    sizes, taken = {}, {}
    source_of = {doc: source for doc, _, _, source in rows}
    for r in found:
        assert r.size == len((next(t for d, t, _, _ in rows if d == r.doc_id) or "").split()) and r.taken <= 3 * r.size
        s = source_of[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    expected = brute.targets(sizes)
    for r in found:
        assert r.source_size == sizes[source_of[r.doc_id]] and abs(r.target - expected[source_of[r.doc_id]]) < 1e-6
    assert all(abs(taken[s] - expected[s]) <= 2 * 16 for s in sizes)


def test_shards_vary_and_pieces_cover_blocks(spark):
    rows = [(k, "w " * 40, "en", f"s{k % 2}") for k in range(200)]
    streams, sources, pieces = mixing.mix(table(spark, rows), block_words=16, shard_slots=40)
    per_shard = {(r.shard, r.place): r["count"] for r in pieces.select("shard", "place", "slot").distinct().groupBy("shard", "place").count().collect()}
    shares = {per_shard.get((shard, 0), 0) for shard, _ in per_shard}
    assert len(shares) > 3  # drawn, not fixed
    assert pieces.groupBy("place", "slot").agg(F.sum("n_words").alias("n")).filter("n <> 16").count() == 0
    assert mixing.mixed_sizes(table(spark, rows).limit(0)).count() == 0


# ---- language ----

def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "bab", "▁", "▁a", "▁ab"]
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    lattice = language.Lattice(pieces, p)
    words = ["a", "ab", "abab", "babba", "b", "axb", "x"]
    scores = lattice.log_probabilities(words)

    def splits(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            for rest in splits(text[n:]):
                yield [text[:n], *rest]

    at = {piece: k for k, piece in enumerate(pieces)}
    for k, word in enumerate(words):
        for lang in range(2):
            uses, total = np.zeros(len(pieces)), 0.0
            for split in splits("▁" + word):
                values = [p[at[s], lang] if s in at else language.UNKNOWN if len(s) == 1 else 0.0 for s in split]
                total += math.prod(values)
                for s in split:
                    if s in at:
                        uses[at[s]] += math.prod(values)
            assert abs(scores[k, lang] - math.log(total)) < 1e-9
            assert np.allclose(lattice.expected_uses([word], np.array([3]), lang), 3 * uses / total)


def test_words_of_any_length():
    pieces = ["a", "ab", "b", "ba", "bab", "▁", "▁a", "▁ab"]
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 2).T
    lattice = language.Lattice(pieces, p)
    at = {piece: k for k, piece in enumerate(pieces)}
    word = "".join(np.random.default_rng(3).choice(list("abx"), 5000))
    found = lattice.log_probabilities([word, "ab", word[:-1] + "a"])
    text = "▁" + word
    for lang in range(2):  # a plain pass, one character after the other
        logs = [0.0]
        for j in range(1, len(text) + 1):
            ways = []
            for i in range(max(0, j - 4), j):
                piece = text[i:j]
                chance = p[at[piece], lang] if piece in at else language.UNKNOWN if j == i + 1 else 0.0
                if chance:
                    ways.append(logs[i] + math.log(chance))
            top = max(ways)
            logs.append(top + math.log(math.fsum(math.exp(w - top) for w in ways)))
        assert abs(found[0, lang] - logs[-1]) < 1e-6
        uses = lattice.expected_uses([word], np.array([1]), lang)
        covered = sum(n * len(piece) for n, piece in zip(uses, pieces))
        assert abs(covered + text.count("x") - len(text)) < 1e-4  # every character is in one piece of each segmentation
    assert language.words_of("ab" * 4000) == ["ab" * 4000]
    assert language.words_of("हिन्दी में लिखा") == ["हिन्दी", "में", "लिखा"]


def test_many_languages(spark):
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pieces = sorted([*letters, "▁", *("".join(rng.choice(list(letters), 3)) for _ in range(800))])
    words = {f"l{k:03d}": [pieces[i] + pieces[j] for i, j in rng.integers(0, len(pieces), (8, 2))] for k in range(600)}
    words = {name: [w.replace("▁", "q") for w in found] for name, found in words.items()}
    rows = [(k, " ".join(rng.choice(found, 60)), name, "s") for k, (name, found) in enumerate(words.items())]
    docs = spark.createDataFrame(rows + [(-1, None, "l000", "s"), (-2, "12", "l599", "s")], "doc_id long, text string, lang string, source string")
    model = language.fit(docs, pieces, rounds=1)
    assert len(model[0]) == 600
    found = {r.doc_id: r for r in language.predict(docs, pieces, *model).collect()}
    assert found[-1].lang_pred == found[-2].lang_pred == "und" and found[-1].score == found[-2].score == 0
    assert sum(found[k].lang_pred == name for k, _, name, _ in rows) >= 590
    lattice = language.Lattice(pieces, model[1])
    for k, text, _, _ in rows[::150]:
        total = lattice.log_probabilities(text.split()).sum(axis=0)
        assert found[k].lang_pred == model[0][total.argmax()]
        assert abs(found[k].score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    pieces = language.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))), pieces)
    rows = [(-1, None, "x", "s"), (-2, "", "x", "s"), (-3, "12 %% ½", "x", "s"), (-4, "und " * 50_000 + "schön", "x", "s"), (None, "the", "x", "s")]
    found = language.predict(table(spark, rows).unionByName(docs, allowMissingColumns=True), pieces, *model).collect()
    by = {r.doc_id: r for r in found}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (-1, -2, -3)) and by[None].lang_pred in model[0]
    assert all(0 <= r.score <= 1 for r in found)
    truth = docs.filter(language.is_held_out(F.col("doc_id"))).collect()
    assert sum(by[r.doc_id].lang_pred == r.lang for r in truth) >= 0.95 * len(truth) > 20
    nothing = language.fit(docs.limit(0), pieces)
    assert language.predict(docs.limit(3), pieces, *nothing).filter("lang_pred = 'und' AND score = 0").count() == 3


# ---- token counts ----

def test_counts_and_cache(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    tokenizer = token_counts.load_tokenizer(path)
    texts = ["hello world", "<|endoftext|> here", "  two\n\n", "é漢字 😀", "hello world", "", None, "x" * 200_000]
    docs = table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "hello world", None, None)])
    expected = sorted((-1 if k is None else k, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
                      for k, t in [*enumerate(texts), (None, "hello world")])
    for _ in range(2):
        found = token_counts.count_tokens(docs, path, cache).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in found) == expected
        assert spark.read.parquet(cache).count() == 6  # distinct texts, encoded once
    more = docs.unionByName(table(spark, [(50, "new text", "en", "s")]))
    assert token_counts.count_tokens(more, path, cache).count() == 10 and spark.read.parquet(cache).count() == 7
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


# ---- the pipeline ----

def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = prose(4, 240)
    clean = [r[1] for r in prose(7) if r[2] == "de" and len(r[1].split()) > 70 and "!!" not in r[1] and "%%" not in r[1] and r[0] % 17 != 7]
    passage = " ".join(f"gegen{k}" for k in range(60))
    item = " ".join(f"quorum{k}" for k in range(14))
    for k in range(3):  # passages that repeat, near copies, benchmark text, exact copies
        rows.append((1000 + k, clean[3 + k] + "\n" + passage + "\n" + clean[9 + k], "de", "s2"))
        words = (clean[6] + " " + clean[7] + " " + clean[8]).split()
        words[5 + 40 * k] = "anders"
        rows.append((1100 + k, " ".join(words), "de", "s2"))
        rows.append((1200 + k, clean[k] + " " + item + " Ende.", "de", "s2"))
        rows.append((1300 + k, rows[100][1], "en", "s2"))
    rng.shuffle(rows)
    spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = brute.outliers(rows)
    first = [r for r in rows if kept[r[0]]]
    texts = brute.line_runs([(r[0], r[1]) for r in first])
    second = [(r[0], texts[r[0]], r[3]) for r in first if texts[r[0]].strip()]
    group = brute.groups([(d, t) for d, t, _ in second], corpus_pipeline.NEAR_WIDTH, corpus_pipeline.NEAR_PERCENT)
    third = [r for r in second if group[r[0]][1] == r[0]]
    dirty = {d for d, _, n_hit, _ in brute.hits([(d, t) for d, t, _ in third], [(7, item)]) if n_hit}
    last = {d: (len(t.split()), s) for d, t, s in third if d not in dirty}
    assert len(second) < len(first) < len(rows) and len(last) < len(third) < len(second)

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.size for r in found} == {d: n for d, (n, _) in last.items()}
    sizes = {}
    for n, source in last.values():
        sizes[source] = sizes.get(source, 0) + n
    expected = brute.targets(sizes)
    for r in found:
        assert r.source_size == sizes[last[r.doc_id][1]] and abs(r.target - expected[last[r.doc_id][1]]) < 1e-6 and r.taken <= 3 * r.size
    taken = {s: sum(r.taken for r in found if last[r.doc_id][1] == s) for s in sizes}
    assert all(abs(taken[s] - expected[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    text = " ".join(f"wort{k}" for k in range(80))
    rows = [(1, text, "de", "s"), (1, text, "de", "s"), (2, text + " ende", "de", None), (None, text, None, "s"), (None, text, None, "s"),
            (3, None, "de", "s"), (4, "", "de", "s"), (5, "kurz", None, None)]
    schema = SCHEMA + ", n_chars long, component_id string, `at` int, node long"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2) for r in rows], schema)
    spark.createDataFrame([(1, "ganz anderes")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text is None) for r in kept) == [("1", False), ("3", True), ("4", False), ("5", False), ("None", False)]
    assert corpus_pipeline.mixing_weights(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.mixing_weights(spark, docs.limit(0), str(tmp_path)).count() == 0
