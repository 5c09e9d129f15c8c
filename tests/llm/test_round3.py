"""Whitening, URL rules and importance resampling against brute force, and their edge rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import importance, queries, url_rules, whitening


def brute_products(digits):
    rows = [[*map(int, r), 1] for r in digits]
    d = len(rows[0])
    return [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("reach", [0, 1, 7, 100, 1 << 20, 1 << 40, 1 << 62])
def test_cross_products_are_exact(reach):
    rnd = random.Random(reach)
    for rows in (1, 63, 64, 65, 200):
        digits = np.array([[rnd.randint(-reach, reach) for _ in range(5)] for _ in range(rows)], dtype=np.int64)
        assert whitening.cross_products(digits).tolist() == brute_products(digits)
        for r in digits:
            assert whitening.unpack_row(whitening.pack_row(r)).tolist() == r.tolist()


def test_limbs():
    for v in (0, 1, -1, 1 << 39, 1 << 40, -(1 << 40), 3**90, -(3**90)):
        assert whitening.from_limbs(whitening.to_limbs(v)) == v


def check_whitened(rows, vectors):
    """``rows`` of the query against exact integers; ``vectors`` by id."""
    x = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in vectors}
    fit = [list(v) for v in dict.fromkeys(x.values())]
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    cov = np.array([[float(Fraction(n * sum(v[i] * v[j] for v in fit) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(cov)[::-1]
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-6)
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
    assert set(by_id) == set(x)
    first = {v: i for i, v in reversed(x.items())}
    white = np.array([[by_id[first[tuple(v)]][k]["whitened"] for k in sorted(by_id[first[tuple(v)]])] for v in fit])
    assert np.abs(white.mean(axis=0)).max() < 1e-9
    assert np.abs(white.T @ white / n - np.eye(white.shape[1])).max() < 1e-9
    # a projection on eigenvectors: the cross-covariance with x is axis times root of eigenvalue
    away = (np.array(fit, dtype=object) * n - np.array(s, dtype=object)).astype(float) / n
    axes = away.T @ white / n / np.sqrt(values[: white.shape[1]])
    assert np.abs(cov @ axes - axes * values[: white.shape[1]]).max() < 1e-8 * values[0]


def test_whitening_of_the_table(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert len(rows) == 16 * len(vectors)
    check_whitened(rows, vectors)


def test_whitening_edges(spark):
    rnd = random.Random(2)
    good = [(i, [rnd.gauss(0, 1), rnd.gauss(0, 30), rnd.gauss(0, 0.5)]) for i in range(40)] + [(40, [1e5, -3e4, 0.0])]
    good += [(41, good[0][1]), (41, good[0][1]), (None, good[1][1])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [1.0, float("inf"), 2.0]), (55, [1.0, 2.0]), (56, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in good + bad], "vec_id long, embedding array<double>, n string, component int")
    rows = whitening.whiten_vectors(df).collect()
    assert len(rows) == 3 * len(good)
    check_whitened([r for r in rows if r["vec_id"] is not None], [(i, v) for i, v in good if i is not None])
    assert {r["whitened"] for r in rows if r["vec_id"] is None and r["component"] == 1} == {r["whitened"] for r in rows if r["vec_id"] == 1 and r["component"] == 1}
    empty = whitening.whiten_vectors(df.limit(0))
    assert empty.columns == whitening.whiten_vectors(df).columns and empty.collect() == []
    assert whitening.whiten_vectors(df.where("vec_id between 50 and 54")).collect() == []


def test_whitening_without_variance_and_out_of_range(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "vec_id string, embedding array<float>")
    rows = whitening.whiten_vectors(df).collect()
    assert len(rows) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["identity_error"] is None for r in rows)
    flat = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten_vectors(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-12 for r in rows)
    wide = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten_vectors(wide).collect()
    assert len(rows) == 6 and all(math.isfinite(r["whitened"]) for r in rows if r["component"] == 1)
    assert {r["deviation"] for r in rows if r["vec_id"] == 1} == {None}


def test_small_eigenvalues_stay_right():
    """Spreads from 1e8 down to 1e-3: every eigenvalue keeps its relative accuracy."""
    rnd = random.Random(3)
    rows = [[rnd.randint(-(10**8), 10**8), rnd.randint(-(10**4), 10**4), rnd.randint(-3, 3)] for _ in range(60)]
    n = len(rows)
    s = [sum(r[k] for r in rows) for k in range(3)]
    exact = [[Fraction(n * sum(r[i] * r[j] for r in rows) - s[i] * s[j], n * n) for j in range(3)] for i in range(3)]
    v = whitening._extended(np.array([[int(x * n * n) for x in r] for r in exact], dtype=object), n * n)
    values, axes = whitening.eigen(v)
    det = exact[0][0] * (exact[1][1] * exact[2][2] - exact[1][2] ** 2) - exact[0][1] * (exact[0][1] * exact[2][2] - exact[1][2] * exact[0][2])
    det += exact[0][2] * (exact[0][1] * exact[1][2] - exact[1][1] * exact[0][2])
    assert float(np.prod(values)) == pytest.approx(float(det), rel=1e-9)
    white = axes / np.sqrt(values)
    assert np.abs(white.T @ v @ white - np.eye(3)).max() < 1e-9


WORDS = ["ads", "ad", "img", "news", "net", "org", "shop", "x1", "track", "de"]


def random_url(rnd):
    host = ".".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3)))
    path = "".join(rnd.choice("/-_.") + rnd.choice(WORDS) for _ in range(rnd.randint(0, 4)))
    url = rnd.choice(["http://", "https://", "x://", ""]) + host + (("/" + path) if rnd.random() < 0.8 else "") + rnd.choice(["", "?ads=1", "#top", "?a=b/news/"])
    return rnd.choice([url, url.upper(), url.title()])


def random_pattern(rnd):
    body = "".join(rnd.choice(["*", "^", "/", "-", "."]) + rnd.choice(WORDS) for _ in range(rnd.randint(1, 3)))
    return rnd.choice(["", "@@"]) + rnd.choice(["", "||", "|"]) + body.lstrip(rnd.choice(["*^/-.", ""])) + rnd.choice(["", "^", "|", "*", "/"])


def brute_judge(rules, url):
    """Every rule on the URL, read off the definition of each rule."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    path = tail[:end]
    fits = []
    for r in rules:
        if r.is_site:
            h, _, p = r.name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append(r)
    if fits:
        best = min(fits, key=lambda r: (-len(r.name), r.name))
        return host, path, best.name, best.verdict
    address = f"//{host}{tail}".lower()
    verdicts = {r.verdict for r in rules if not r.is_site and re.search(r.regex, address)}
    return host, path, None, "allow" if "allow" in verdicts else "block" if verdicts else "allow"


def test_rules_against_trying_all():
    rnd = random.Random(5)
    for _ in range(60):
        rules = [url_rules.pattern_rule(random_pattern(rnd)) for _ in range(12)]
        names = {rnd.choice(WORDS) + rnd.choice(["", ".net", ".org"]) + "/" + rnd.choice(["", "ads/", "ne", "news"]) for _ in range(6)}
        rules += [url_rules.site_rule(n, rnd.choice(["allow", "block"])) for n in sorted(names)]
        seen = Counter(t for _ in range(50) for t in url_rules.tokens_of(*url_rules.split_url(random_url(rnd))[::2]))
        index = url_rules.RuleIndex(rules, seen)
        for _ in range(200):
            url = random_url(rnd)
            assert index.judge(url)[:4] == brute_judge(rules, url)


def test_rarest_token_fetches_few():
    rules = [url_rules.pattern_rule(f"||site{i}.com^") for i in range(1000)] + [url_rules.pattern_rule("banner")]
    index = url_rules.RuleIndex(rules, {"com": 10_000, **{f"site{i}": 1 for i in range(1000)}})
    assert len(index.candidates("www.site7.com", "/a/b")) == 2  # its own and the one without a whole token
    assert index.judge("http://www.site7.com/a")[3] == "block"
    assert index.judge("http://www.site7.com.org/banners/")[4] == "banner"


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (None, ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        ("no scheme.net/", ("", "", None, "allow")),
        ("http://A.NET/x", ("a.net", "/x", "net/", "block")),
        ("http://a.net", ("a.net", "", None, "allow")),
        ("http://a.net?x=/", ("a.net", "", None, "allow")),
        ("http://subnet/", ("subnet", "/", None, "allow")),
        ("http://www.Example.net/en/a?b", ("www.example.net", "/en/a", "example.net/en/", "allow")),
        ("http://example.net/EN/", ("example.net", "/EN/", "net/", "block")),
        ("http://myexample.net/en/", ("myexample.net", "/en/", "net/", "block")),
        ("http://example.com/de/", ("example.com", "/de/", "example.com/de/", "block")),
        ("http://example.com/de", ("example.com", "/de", None, "allow")),
        ("x://x.org/fr/http://a.net/", ("x.org", "/fr/http://a.net/", "org/fr/", "allow")),
        ("http://a.net:80/", ("a.net:80", "/", None, "allow")),
        ("http://m.ads-track.example.com/en/1", ("m.ads-track.example.com", "/en/1", None, "block")),
        ("http://loads-tracker.example.com/en/1", ("loads-tracker.example.com", "/en/1", None, "allow")),
        ("http://news.org/login", ("news.org", "/login", None, "block")),
        ("http://news.org/login-help\nmore", ("news.org", "/login-help\nmore", None, "allow")),
        ("http://news.org/logins", ("news.org", "/logins", None, "allow")),
        ("http://archive.org/search?q", ("archive.org", "/search", None, "allow")),
    ],
)
def test_rules_of_the_query(url, expected):
    index = url_rules.RuleIndex(queries.RULES, {})
    assert index.judge(url)[:4] == expected == brute_judge(queries.RULES, url)


def test_filter_urls_edges(spark):
    rows = [(1, "http://a.net/", "x"), (1, "http://a.net/", "x"), (None, None, None), (2, "http://b.org/" + "long/" * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, `Rule` string").withColumn("judged", F.lit(1))
    out = url_rules.filter_urls(df, queries.RULES)
    assert out.columns == ["page_id", "url", "judged", "host", "path", "rule", "verdict", "pattern"]
    assert sorted((r["verdict"], len(r["path"])) for r in out.collect()) == [("allow", 0), ("allow", 250_001), ("block", 1), ("block", 1)]
    assert url_rules.filter_urls(df.limit(0), queries.RULES).collect() == []
    assert {r["verdict"] for r in url_rules.filter_urls(df, []).collect()} == {"allow"}


def brute_resample(docs, target, percent, least, buckets, ngrams=1):
    word = re.compile("[0-9a-z\u0080-\U0010ffff]+")
    fold = str.maketrans(url_rules.UPPER, url_rules.LOWER)

    def features(text):
        words = word.findall((text or "").translate(fold))
        grams = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    found = [(i, *features(t)) for i, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for i, n, f in found:
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: len(able) * percent // 100]
    return sorted(map(str, [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in list((Counter(rows) - Counter(drawn)).elements())]))


@pytest.mark.parametrize("ngrams", [1, 2])
def test_resample_against_brute_force(spark, ngrams):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("Alpha beta GAMMA 7 été naïve ſ x-y ß 日本".split()) for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    docs = [(rnd.choice([i, i, 5, None]), t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "word " * 100_000), (903, texts[0]), (903, texts[0])]
    target = ["alpha alpha beta", None, "ÉTÉ 日本 gamma"]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, _row string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 30, 100):
        out = importance.resample(df, wanted, percent, 3, ngrams, 50)
        assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(str(tuple(r)) for r in out.collect()) == brute_resample(docs, target, percent, 3, 50, ngrams)
    assert importance.resample(df.limit(0), wanted).collect() == []
    assert all(r["weight"] == 0 for r in importance.resample(df.where("text is null"), wanted.limit(0)).collect())


def test_kth_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 5), rnd.randint(0, 3), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    ordered = sorted(rows)
    for k in (1, 2, 350, 699, 700):
        assert importance.kth_key(df, ["a", "b", "c"], k, pivots=5) == ordered[k - 1]
    short = sorted(r[:2] for r in rows)  # keys that a third of the rows share
    for k in (1, 200, 700):
        assert importance.kth_key(df, ["a", "b"], k, pivots=3) == short[k - 1]
    assert importance.kth_key(df, ["a"], 701) is None and importance.kth_key(df, ["a"], 0) is None
    placed = importance.ranked(df.repartition(7), ["a", "b", "c"], "nth").collect()
    assert [tuple(r)[:3] for r in sorted(placed, key=lambda r: r["nth"])] == ordered and {r["nth"] for r in placed} == set(range(1, 701))
