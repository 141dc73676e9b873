"""Hard negatives, source divergence and license scans against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import divergence, hard_negatives, licenses, topk, vectors
from folio.llm import queries as llm

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, rank string, block int"

# --- hard negatives --------------------------------------------------------------------------


def brute_negatives(rows, every=100, n_pos=5, n_neg=10):
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    known = {}
    for i, x, label in rows:
        if None in (i, x, label) or any(c is None or not np.isfinite(c) or not np.isfinite(256.0 * c) for c in x):
            continue
        own = (label, [int(np.floor(256.0 * c)) for c in x])
        known[i] = min(known.get(i, own), own)
    out = []
    for a, (label, x) in known.items():
        if a % every:
            continue
        score = {i: clamp(sum(p * q for p, q in zip(x, y, strict=True))) for i, (_, y) in known.items() if i != a and len(x) == len(y)}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in best(i for i in score if known[i][0] == label)[:n_pos]:
            inside = [i for i in score if known[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(best(inside)[:n_neg], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, x, label, "r", 3) for i, x, label in rows], VECTORS)
    return sorted(map(tuple, hard_negatives.mine(df, **more).collect()))


def vector_rows(n, dims, seed, labels=4, values=None):
    r = random.Random(seed)
    return [(i, [values[r.randrange(len(values))] if values else r.uniform(-1, 1) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = vector_rows(600, 8, 1)
    wanted = brute_negatives(rows, every=20)
    assert len(wanted) > 500 and mined(spark, rows, anchor_every=20) == wanted
    monkeypatch.setattr(hard_negatives, "GATHER", 0)  # every window is refined to a single score
    monkeypatch.setattr(hard_negatives, "DIGIT", 5)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 400)
    assert mined(spark, rows, anchor_every=20) == wanted


def test_hard_negatives_with_ties_nulls_and_repeats(spark):
    rows = vector_rows(300, 3, 2, labels=3, values=[0.0, 0.5, 1.0])  # few scores, so ties everywhere
    rows += [(1000 + i, [0.5, 0.5, 0.5], 1) for i in range(400)]  # one vector, and label, for more than half
    rows += [rows[0], rows[5], (5, [0.25, 0.0, 0.0], 2), (None, [1.0] * 3, 1), (400, None, 1), (500, [1.0, None, 1.0], 1), (600, [1.0, float("nan"), 1.0], 1), (601, [float("inf")] * 3, 1), (602, [1.0] * 3, None), (700, [], 0), (701, [], 0), (800, [1.0], 0), (801, [2.0], 0), (802, [0.5], 1)]
    wanted = brute_negatives(rows)
    assert len(wanted) > 50 and mined(spark, rows) == wanted
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []


@pytest.mark.parametrize("large", [1e9, 1e30, 1e300])
def test_hard_negatives_of_large_components(spark, large):
    rows = vector_rows(60, 2, 3, labels=2) + [(i, [large * (1 + i % 3), 1.0], i % 2) for i in range(100, 130)] + [(200, [-large, 2.0], 0), (300, [large * 0.7, 0.0], 1)]
    assert mined(spark, rows, anchor_every=10) == brute_negatives(rows, every=10)


def test_blocks_are_packed_in_several_tasks_and_lie_few_to_a_file(spark, monkeypatch):
    """What an executor holds at once must not grow with the table: not all rows of one length in one task, nor all blocks in one batch of a file."""
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 40)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame([(i, x, label, "r", 3) for i, x, label in vector_rows(400, 4, 7)], VECTORS)
        blocks = vectors.packed(vectors.scaled(df, "label"))
        files = {r[0]: r[1] for r in blocks.groupBy(F.input_file_name()).count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(files.values()) > 30 and max(files.values()) <= 4
    assert len({re.search(r"/part-(\d+)", f)[1] for f in files}) > 1
    assert all(len(r["x"]) == len(r["ids"]) // 8 * 4 * 2 for r in blocks.collect())  # two bytes hold floor(256 * x) of these


def test_blocks_hold_their_numbers_in_as_few_bytes_as_they_need():
    for most, size in ((127.0, 1), (-129.0, 2), (40_000.0, 4), (2.0**31, 8), (-(2.0**70), 8), (1e300, 8)):
        x = np.array([[0.0, 1.0], [most, -3.0]])
        data = vectors._narrow(x).tobytes()
        own = {"dim": 2, "ids": np.array([3, 5]).tobytes(), "labels": np.array([0, 1]).tobytes(), "x": data}
        assert len(data) == 4 * size and vectors.unpacked(own)[2].tolist() == x.tolist()


def test_groups_of_long_queries_have_fewer(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 400)
    asked = vectors.asked(spark.createDataFrame([(i, [float(i)] * (40 if i % 2 else 2)) for i in range(200)], "anchor_id long, x array<double>"), "anchor_id")
    groups = {r["dim"]: r["asks"] for r in asked.groupBy("dim").agg((F.max("ask") + 1).alias("asks")).collect()}
    assert groups == {2: 1, 40: 10}


def test_a_vector_meets_the_blocks_once_whatever_its_windows(spark):
    anchors = spark.createDataFrame([(100, 1, [1.0, 2.0], 2, 0), (200, 2, [3.0, 4.0], 2, 0), (300, 2, [5.0, 6.0], 2, 1)], "anchor_id long, label long, x array<double>, dim int, ask int")
    wide = "anchor_id long, positive_id long, positive_score long, label long, dim int, ask int, lo long, hi long, base long, shift int, need long, upto long, open boolean"
    windows = spark.createDataFrame([(a, p, 9, 1, 2, 0, 3, 8, 0, 0, 10, 0, True) for a in (100, 200) for p in range(5)], wide)
    met = hard_negatives._met(anchors, windows).collect()
    assert sorted(r["anchor_id"] for r in met if r["x"]) == [100, 200] and sum(r["window"] for r in met) == 10 == len(met) - 2


def test_scores_are_exact_and_clamped():
    rows, queries = np.array([[3.0, -2.0], [2.0**40, 1.0], [-(2.0**70), 5.0]]), np.array([[7.0, 1.0], [2.0**30, 3.0], [2.0**60, 0.0]])
    wanted = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), vectors.LEAST), vectors.MOST) for y in queries] for x in rows]
    assert vectors.scores(rows, queries).tolist() == wanted


def test_a_query_alone_in_its_block_finds_nothing():
    for dims in (0, 2):
        alone = topk.SortedLists(np.array([100]), np.array([1]), np.ones((1, dims)), np.zeros((1, dims), "int32"))
        assert alone.top(np.ones(dims), 100, 5) == ([], 0)


@pytest.mark.parametrize("large", [1e9, 1e30, 1e300])
def test_top_k_of_large_components(spark, large):
    rows = [(i, x) for i, x, _ in vector_rows(80, 3, 5)] + [(i, [large * (1 + i % 3), -large, 1.0]) for i in range(100, 104)] + [(150, [-large, large, 0.5]), (200, [0.25, large, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256.0 * c)) for c in x] for i, x in rows if all(np.isfinite(256.0 * c) for c in x)}
    clamp = lambda s: min(max(s, vectors.LEAST), vectors.MOST)
    wanted = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-clamp(sum(a * b for a, b in zip(whole[q], x, strict=True))), i) for i, x in whole.items() if i != q)[:5]
        wanted += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.top_k(df, vector_block=16, query_block=2).collect())) == sorted(wanted)


def test_the_kth_score_found_first_shortens_later_walks(spark):
    """Vectors whose length falls off quickly: few rows of a block can be among the best."""
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * 0.8 ** (i % 40) for _ in range(2)]) for i in range(4000)]
    walks = topk.walks(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=200, vector_block=500)
    scored = {k["query_id"]: k["n"] for k in walks.select("query_id", "vec_id", "scored").groupBy("query_id").agg({"scored": "max"}).withColumnRenamed("max(scored)", "n").collect()}
    assert len(scored) == 20 and max(scored.values()) < 500


# --- source divergence -----------------------------------------------------------------------


def brute_audit(rows, least, terms_each=50):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    read = [((lang or ""), (source or ""), word.findall((text or "").translate(lower))) for text, lang, source in rows]
    for lang, source, words in read:
        groups.add((lang, source))
        df[lang].update(set(words))
    kept = {lang: {w for w, n in c.items() if n >= least} for lang, c in df.items()}
    for lang, source, words in read:
        counts[lang, source].update(w for w in words if w in kept[lang])
        counts[lang, None].update(w for w in words if w in kept[lang])
    p = lambda g, w: 1 + 10**9 * (counts[g][w] + 5) // (sum(counts[g].values()) + 5 * len(kept[g[0]]))
    out = []
    for g in groups:
        lang = g[0]
        pairs = [(s, sum(abs(p(g, w) - p((lang, s), w)) for w in kept[lang])) for x, s in groups if x == lang and s != g[1]]
        terms = [(w, p(g, w) - p((lang, None), w)) for w in kept[lang] if counts[g][w] and p(g, w) > p((lang, None), w)]
        for part, found, most in (("pair", pairs, None), ("term", terms, terms_each)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(*g, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, item string")
    return sorted(map(tuple, divergence.audit(df, **more).collect()))


def prose(n, seed):
    r = random.Random(seed)
    known = [f"{a}{b}" for a in ("Ab", "é", "zu", "Żo", "日本", "X", "𝒳") for b in ("", "a", "q", "ö", "ZZ")]
    text = lambda: "".join(r.choice(known) + r.choice([" ", ". ", "-", "7", "\n\n", "\x00", " @["]) for _ in range(r.randrange(30)))
    return [(text(), r.choice(["en", "en", "en", "fr", None, ""]), r.choice(["a", "a", "a", "b", None, "", "Ä", "c"])) for _ in range(n)]


def test_audit_equals_brute_force(spark):
    rows = prose(400, 1)
    rows += rows[:40] + [(None, "en", "lonely"), ("", "xx", "one"), ("rare words here", "xx", "two"), ("the " * 9000, "en", "a")]
    for least, shard in ((3, divergence.SHARD), (12, 7)):  # many automata too
        wanted = brute_audit(rows, least)
        assert {"pair", "term"} == {r[2] for r in wanted} and audited(spark, rows, least=least, shard=shard) == wanted
    assert audited(spark, rows, least=5, terms_each=2) == brute_audit(rows, 5, 2)


def test_audit_in_small_blocks_and_of_nothing(spark, monkeypatch):
    rows = prose(200, 2)
    monkeypatch.setattr(divergence, "BLOCK_LEAST", 3)
    monkeypatch.setattr(divergence, "BLOCK_MOST", 3)
    monkeypatch.setattr(divergence, "HELD", 1)
    assert audited(spark, rows, least=4) == brute_audit(rows, 4)
    assert audited(spark, []) == [] and audited(spark, [(None, None, None)]) == []
    assert audited(spark, rows[:5]) == brute_audit(rows[:5], 30)  # no term is kept: pairs of value 0


# --- licenses --------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    found = [(n, label) for label, phrase in licenses.PHRASES for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((n for n, _ in found), default=None), max((n for n, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def scanned(spark, texts):
    df = spark.createDataFrame([(n, t, 1, "x", 2) for n, t in enumerate(texts)], "doc_id long, text string, n_words int, label string, place int")
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def check_base(found, texts):
    for n, t in enumerate(texts):
        r = found[n]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_base_places_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = "under the mit license apache version 2 cc by nc Under MIT LICENSE x é 2.0 by-nc".split()
    texts = [r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += [None, "", "...", "mit", "under the", "CC-BY-NC", "cc by nc cc by nc by nc", "under the mit license " * 2000, "Apache License, Version 2.0; \x00Apache/License\x7fVersion@2", "under the mit licenſe", "under the mıt license", "cc by ncé", "K" + "under the mit license"]
    texts += ["Under the MIT License"] * 40
    found = scanned(spark, texts)
    assert len(found) == len(texts) and sum(x["n_base"] for x in found.values()) > 2000
    check_base(found, texts)


NOTICE = dict((x, y) for x, y in reversed(licenses.NOTICES))


def test_notices_are_found_with_words_changed_left_out_and_put_in(spark):
    isc = NOTICE["isc"].split()
    texts = [
        " ".join(isc), " ".join(isc[:20] + isc[21:]), " ".join(isc[:10] + ["really"] + isc[10:]), " ".join(isc[:15] + ["other"] + isc[16:]), " ".join(["x"] * 5000 + isc + ["y"] * 5000),
        " ".join(isc[:20]), " ".join(w for w in isc for _ in range(2)), " ".join(reversed(isc)), " ".join(random.Random(1).sample(isc, len(isc))),
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 4.", "It is licensed under the GNU Lesser General Public License, Version 2.1",
        "Licensed under the terms of the ZZZ license", "Licensed under the terms of the MIT license", "Permission is hereby granted", "licensed under the GNU General Public License version 2 and licensed under the GNU Affero General Public License version 3",
    ]
    found = scanned(spark, texts)
    check_base(found, texts)
    assert [found[n]["labels"] for n in range(len(texts))] == [*["isc"] * 5, *[""] * 4, "gpl-3", "", "lgpl-2", "", "mit", "", "agpl-3,gpl-2"]
    assert found[0]["score"] == 1.0 and 0.8 <= found[2]["score"] < 1.0 and found[5]["score"] == 0.0


def test_spans_templates_of_ones_own_and_odd_tables(spark, monkeypatch):
    own = licenses.templates(spark, [("a", "one two three")], [("b", "red green blue {white} black grey")])
    df = spark.createDataFrame([(1, "x ONE two three y"), (None, "red green blue white black"), (3, None), (3, "red green blue wheat black grey")], "doc_id long, text string")
    for places in (licenses.BROADCAST_PLACES, 0):  # sent, and joined by a shuffle
        monkeypatch.setattr(licenses, "BROADCAST_PLACES", places)
        assert sorted((r["label"], r["first_word"], r["end_word"], r["covered"]) for r in licenses.spans(df, own).collect()) == [("a", 1, 4, 3), ("b", 0, 5, 5)]
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in licenses.scan(df, own).collect()) == [(0, "b"), (1, "a"), (3, ""), (3, "")]
    assert licenses.scan(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="needs 3 words"):
        licenses.templates(spark, [("a", "one two")], [])


def test_the_licenses_plan_has_no_python(spark):
    plan = llm.queries()["op13_licenses"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Join" in plan


def test_a_plain_scan_finds_no_more_labels_than_lines_bear(spark):
    rows = {r["doc_id"]: r for r in llm.queries()["op13_licenses"](spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for i, t in texts.items():
        assert (rows[i]["n_words"], rows[i]["n_base"], rows[i]["first_word"], rows[i]["last_word"], rows[i]["base_labels"]) == brute_base(t)
        assert bool(rows[i]["labels"]) == bool(re.search(r"(?i)licen[sc]ed?\b", t or ""))
