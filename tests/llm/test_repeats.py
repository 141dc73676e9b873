"""Repeated passages in odd tables, against brute force."""

import random

import numpy as np

from folio.llm import suffix_repeats


def words(n, seed, kinds=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def brute(rows):
    """rows (doc_id, text): a document is all rows of its id."""
    seen, out = {}, {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, t in rows:
        w = (t or "").split()
        out.setdefault(i, set()).update(k for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1)
    found = {}
    for i, starts in out.items():
        spans = []
        for k in sorted(starts):
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + 50
            else:
                spans.append([k, k + 50])
        if spans:
            found[i] = ",".join(f"{b}:{e}" for b, e in spans)
    return found


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, h long, at int, words string")
    result = suffix_repeats.repeats(df).collect()
    assert all(r["n_spans"] == len(r["spans"].split(",")) and r["repeated_words"] == sum(int(e) - int(b) for b, e in (x.split(":") for x in r["spans"].split(","))) for r in result)
    return {r["doc_id"]: r["spans"] for r in result}


def test_copies_quotes_and_repeated_ids(spark):
    base, other = words(400, 1), words(300, 2)
    rows = [(n, " ".join(base)) for n in (5, 3, 9)] + [(4, "\n".join(base))]  # the same words, another text
    rows += [(10, " ".join(words(60, 3) + base[100:170] + words(40, 4))), (11, " ".join(other)), (11, " ".join(other)), (12, " ".join(words(20, 5) + other[10:80]))]
    rows += [(13, " ".join(base)), (13, " ".join(words(120, 6))), (14, " ".join(words(49, 7))), (15, " ".join(words(49, 7))), (16, " ".join(words(50, 8))), (17, " ".join(words(50, 8)))]
    rows += [(18, None), (18, ""), (19, ""), (None, None)]
    wanted = brute([r for r in rows if r[0] is not None])
    assert found(spark, [*rows, (None, " ".join(base)), (None, " ".join(words(90, 9))), (20, " ".join(words(90, 9)))]) == wanted
    assert wanted[5] == "0:400" and wanted[13].startswith("0:400") and 14 not in wanted and wanted[16] == "0:50"


def test_groups_of_copies_and_long_texts(spark):
    long = words(30_000, 11)
    rows = [(1, " ".join(long)), (2, " ".join(words(9, 12) + long[12_000:27_000])), (3, " ".join(long[29_940:] + words(9, 13)))]
    rows += [(100 + n, " ".join(words(200, 14))) for n in range(300)] + [(500, " ".join(words(5, 15) + words(200, 14)[40:111])), (501, " ".join(words(200, 14)[:149] + words(200, 16)))]
    assert found(spark, rows) == brute(rows)


def test_both_hashes_count():
    w = suffix_repeats.word_hashes(" ".join(words(200, 17)))
    one, two = suffix_repeats.window_hashes(w, 50), suffix_repeats.window_hashes(suffix_repeats.word_hashes(" ".join(words(200, 17)), 1), 50, suffix_repeats._BASE_2)
    assert len(one) == len(two) == 151 and not np.any(one == two)
    assert len(set(one[:100].tolist())) == 100
