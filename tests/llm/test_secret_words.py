"""Guess cost against every segmentation; words learned from a corpus; the pipeline of both."""
import itertools
import random
import string
from math import log2

from leafmill.llm import secret_scan, tree_forest

RANKS = {"aba": 3, "bab": 9, "aaia": 2, "abba": 40}


def brute_segment(value, i, j, per_char):
    """Least cost of one segment, kind by kind."""
    part, low = value[i:j], value[i:j].lower()
    costs = []
    if j - i == 1:
        costs.append(3.0 if part in "_-./" else per_char)
    for text, extra in ((low, 0), (low.translate(secret_scan.LEET), 1)):
        if text in RANKS:
            costs.append(2 + log2(RANKS[text]) + (part != low) + extra)
    m = secret_scan.DATE.match(value, i)
    if m and m.end() == j or (m and j == i + 4 and value[i:j].isdigit() and value[i : i + 2] in ("19", "20")):
        costs.append(2 + (log2(366 * 120) + 1 if j - i > 4 else log2(120)))
    for p in (1, 2, 3, 4):
        if j - i >= max(3, 2 * p) and all(part[k] == part[k + p] for k in range(len(part) - p)):
            costs.append(2 + p * per_char + log2((j - i) / p))
    if j - i >= 3 and all((a, b) in secret_scan.NEXT_KEY for a, b in zip(low, low[1:])):
        costs.append(2 + log2(40) + log2(j - i))
    return min(costs, default=float("inf"))


def brute_bits(value):
    per_char = secret_scan._char_bits(value)
    n, best = len(value), float("inf")
    for cuts in itertools.product((0, 1), repeat=n - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
        best = min(best, sum(brute_segment(value, i, j, per_char) for i, j in zip(at, at[1:])))
    return best


def test_guess_bits_is_the_least_of_all_segmentations():
    rnd = random.Random(2)
    values = ["".join(c) for n in range(1, 7) for c in itertools.product("ab4", repeat=n)]
    values += ["".join(rnd.choice("aAbB41_q") for _ in range(rnd.randint(5, 11))) for _ in range(150)]
    values += ["".join(rnd.choice(["qwe", "rty", "ab", "1999", "12", "aaa", "b"]) for _ in range(3))[:12] for _ in range(80)]
    for v in values:
        assert abs(secret_scan.guess_bits(v, RANKS) - brute_bits(v)) < 1e-9, v


def test_words_are_learned_and_secrets_are_not(spark):
    rnd = random.Random(4)
    words = ["authentication", "documentation", "southwestern", "necessary", "ridge", "recommended", "follows", "the"]
    key = "".join(rnd.choice(string.ascii_lowercase) for _ in range(12))
    rows = [(i, f"{' '.join(rnd.sample(words, 6))}. password = {key}") for i in range(40)]
    rows += [(90, "auth: documentation follows, bypass = recommended"), (91, "The compass: southwestern ridge"), (92, "dbPass = zq8!kfw93#xp and PASS: zq8!kfw93#xp"), (93, None), (93, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = secret_scan.learn_ranks(docs)
    assert key not in ranks and ranks["the"] <= len(words)
    for word in ("authentication", "documentation", "southwestern", "necessary"):
        assert secret_scan.guess_bits(word, ranks) < 40 < secret_scan.guess_bits(word)
    for _ in range(50):
        assert secret_scan.guess_bits("".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(12)), ranks) > 40
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan_documents(docs).collect()}
    assert spans[90] == spans[91] == spans[93] == ""
    assert spans[92] == "guess:9:21,guess:32:44"
    assert all("guess" in spans[i] for i in range(40))
    assert secret_scan.learn_ranks(docs.limit(0)) == secret_scan.RANK
    few = secret_scan.learn_ranks(docs, most_words=3)
    assert len(set(few) - set(secret_scan.RANK)) <= 3
    rows = [(i, f"alpha {'beta' if i < 8 else ''} {'gamma' if i < 8 else ''} {'delta' if i < 6 else ''}") for i in range(9)]
    greek = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda n: {w: r for w, r in secret_scan.learn_ranks(greek, most_words=n).items() if w not in secret_scan.RANK}
    assert found(10) == found(4) == {"alpha": 1, "beta": 2, "gamma": 3, "delta": 4}
    assert found(3) == {"alpha": 1, "beta": 2, "gamma": 3} and found(2) == {"alpha": 1} and found(0) == {}


def test_compass_and_bypass_are_no_context():
    secret = "x9K!q7Zr#2Lm5v"
    for text in ("The compass: {}", "bypass = {}", "COMPASS: {}", "author: {}", "oauthor={}"):
        assert secret_scan.scan(text.format(secret), 40.0) == []
    for text in ("pass: {}", "db_pass={}", "dbPass: {}", "PASS: {}", "auth={}", "mypassword={}", "x-auth: {}", "userPasscode: {}"):
        assert [k for k, _, _ in secret_scan.scan(text.format(secret), 40.0)] == ["guess"], text


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], 1.2, "a:b", -0.0), (2, [1.0, 0.01], 1.7, "a:b", 0.0), (3, [1.0, 0.02], 1.2, "a", 0.0), (4, [1.0, 0.0], None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d double, s string, z double")
    got = lambda label: {r["vec_id"]: (r["n_links"], r["component_id"]) for r in tree_forest.link_vectors(df, label=label).collect()}
    assert got("d") == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}
    assert got("s") == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
    assert got("z") == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
