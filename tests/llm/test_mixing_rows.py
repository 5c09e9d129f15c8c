"""The mix takes rows, not groups of equal ids: against the queue written out, and where one id repeats."""
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing


def brute(docs, share=1.5, weights=(5, 2, 1), most=2):
    """Every entry in one sorted list; targets by handing out shares until none is above its limit."""
    size = {s: 0 for _, s, _ in docs}
    for _, s, t in docs:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, free = share * sum(size.values()), {}, list(order)
    left = budget
    while free:
        full = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * size[s]]
        if not full:
            target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        for s in full:
            target[s] = float(most * size[s])
        left -= sum(most * size[s] for s in full)
        free = [s for s in free if s not in full]
    rows = []
    for i, s, t in docs:
        rows.append((s, hashlib.md5(str("" if i is None else i).encode()).hexdigest(), len((t or "").split()), hashlib.md5((t or "").encode()).hexdigest(), i))
    entries = []
    for s in order:
        done = 0
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1:4])
        for p in range(most):
            for k, r in enumerate(own):
                done += r[2]
                if target[s]:
                    entries.append((done / target[s], order.index(s), p, k, r))
    run, copies = 0, Counter()
    for e in sorted(entries, key=lambda e: e[:4]):
        run += e[4][2]
        if run > budget:
            break
        copies[(e[1], e[3])] += 1
    out = []
    for s in order:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1:4])
        out += [(r[4], r[2], size[s], copies[(order.index(s), k)] * r[2]) for k, r in enumerate(own) if r[2]]
    return out, target


def check(spark, docs):
    want, target = brute(docs)
    df = spark.createDataFrame([(i, s, t, "x") for i, s, t in docs], "doc_id long, source string, text string, each string")
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(docs) and all(r["each"] == "x" for r in rows)
    got = sorted(str((r["doc_id"], r["size"], r["source_size"], r["taken"])) for r in rows if r["size"])
    assert got == sorted(map(str, want))
    arrow = df.drop("each").toArrow()  # noqa: F841 - read by the query
    con = duckdb.connect()
    con.register("documents", arrow)
    sql = con.sql(mixing.SQL).fetchall()
    assert sorted(str((i, n, z, k)) for i, n, z, _, k in sql if n) == got
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
    return rows


def test_one_id_ten_times(spark):
    """Three sources of 1,000 words; the second is one id ten times over."""
    docs = [(i, "a", "w " * 100) for i in range(10)] + [(500, "b", "w " * 100)] * 10 + [(900 + i, "c", "w " * 100) for i in range(10)]
    rows = check(spark, docs)
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - {"a": 2000, "b": 1666.67, "c": 833.33}[r["source"]]) < 1
    assert taken["a"] == 2000 and abs(taken["b"] - 1666.67) <= 100 and abs(taken["c"] - 833.33) <= 100


def test_random_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST_ROWS", 3)
    monkeypatch.setattr(mixing, "STEPS", 5)
    monkeypatch.setattr(mixing, "DEAL_ROWS", 4)
    rnd = random.Random(6)
    for _ in range(6):
        docs = []
        for _ in range(rnd.randint(3, 60)):
            i = rnd.choice([None, 1, 2, rnd.randint(3, 500)])
            docs += [(i, rnd.choice(["a", "b", None, "ü"]), rnd.choice([None, "", "x y", "x z", "w " * rnd.randint(1, 40)]))] * rnd.choice([1, 1, 1, 2, 13])
        if any((t or "").split() for _, _, t in docs):
            check(spark, docs)


def test_hot_group_and_many_empty_rows(spark):
    hot = [(None, "a", "one two three")] * 3000 + [(i, "b", "w " * (i % 7)) for i in range(2000)] + [(i, "c", "") for i in range(3000)] + [(1, "c", "w " * 40)]
    rows = check(spark, hot)
    assert len({r["taken"] for r in rows if r["doc_id"] is None}) == 2  # the mix ends inside the hot group
    assert mixing.take_mix(spark.createDataFrame(hot, "doc_id long, source string, text string")).agg(F.count("*")).first()[0] > 0
