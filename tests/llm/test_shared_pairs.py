"""Preference pairs of conversations that begin alike, against the SQL and against brute force."""

import random

import duckdb

from folio.llm import preference


def conversations():
    r = random.Random(4)
    rows, begin = [], {}
    for c in range(2, 90):
        turns = [("system", "be kind")] if c % 3 else []
        if c > 10 and r.random() < 0.6:
            other = begin[r.randrange(2, c)]
            turns = list(other[: r.randrange(len(other) + 1)])
        turns += [(r.choice(["user", "assistant", None]), r.choice(["yes", "no", None, "long " * 300, f"t{c}"])) for _ in range(r.randrange(1, 5))]
        begin[c] = turns
        rows += [(c, n, role, text) for n, (role, text) in enumerate(turns)]
    return rows + rows[:9] + [(None, 0, "user", "x"), (500, None, "user", "only"), (501, None, "user", "only")]


def test_shared_pairs_equal_the_sql_and_take_the_longest_beginning(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, pair_id int, chosen boolean")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    found = preference.table_pairs(df)
    columns = found.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({preference.ORACLE})").fetchall()))
    own = {}
    for c, n, role, text in {r for r in rows if r[0] is not None}:
        own.setdefault(c, []).append((-1 if n is None else n, role or "unknown", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    wanted = {}
    for c, t in own.items():
        n, other = max((common(t, u), -d) for d, u in own.items() if d != c)
        if n:
            wanted[c] = (-other, n)
    shared = {r["rejected_id"]: (r["chosen_id"], r["prompt_turns"]) for r in found.where("kind = 'shared'").collect()}
    assert shared == wanted and max(n for _, n in wanted.values()) > 2 and (500 in wanted)


def test_a_table_without_shared_beginnings(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert preference.shared_pairs(df).count() == 0 and preference.shared_pairs(df.where("false")).count() == 0
