"""Each registered corpus query against SQL, the public libraries or a brute-force version on the given tables."""
import base64
import hashlib
import html
import os
import re
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from leafmill.llm import queries as corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings", "benchmark"):
        con.sql(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("select doc_id, text from documents").fetchall()}


def result(spark, sf_dir, name):
    return corpus.QUERIES[name](spark, sf_dir).collect()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.QUERIES) == list(range(1, 14))
    assert set(corpus.SQL) <= set(corpus.QUERIES)


@pytest.mark.parametrize("name", sorted(corpus.SQL))
def test_sql(spark, sf_dir, duck, name):
    df = corpus.QUERIES[name](spark, sf_dir)
    rel = duck.sql(corpus.SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize(("name", "target", "least"), [("op1_toxicity", "toxic", 0.7), ("op9_quality", "quality", 0.95)])
def test_held_out(spark, duck, name, target, least):
    """Ranks held-out labels well; learned from the middle-sized table, which has labels enough."""
    sf = "/root/testdata/sf0.01"
    rows = corpus.QUERIES[name](spark, sf).collect()
    label = dict(duckdb.sql(f"select doc_id, {target} from '{sf}/labels.parquet'").fetchall())
    assert len(rows) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0
        assert r["predicted"] == int(r["score"] >= (0.5 if name.startswith("op1_") else 0.3))
    held = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good = np.array([s for s, y in held if y])
    bad = np.array([s for s, y in held if not y])
    wins = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert wins >= least


def test_byte_bpe(spark, sf_dir, texts):
    import tiktoken

    with open(public_tokenizers.path(corpus.BYTE_RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = result(spark, sf_dir, "op2_byte_bpe")
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_secret_scan(spark, sf_dir, texts):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in result(spark, sf_dir, "op3_secret_scan"):
        t = texts[r["doc_id"]]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def test_token_counts(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(corpus.COUNT_TOKENIZER))
    for r in result(spark, sf_dir, "op4_token_counts"):
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(tok.encode(t, add_special_tokens=False))
        assert (r["n_bytes"], r["over_limit"]) == (len(t.encode()), r["n_tokens"] > 2048)


def test_mixing_targets(spark, sf_dir, duck):
    rows = result(spark, sf_dir, "op6_mixing")
    source = dict(duck.sql("select doc_id, source from documents").fetchall())
    groups = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        groups.setdefault(source[r["doc_id"]], []).append(r)
    assert sum(g[0]["target"] for g in groups.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for g in groups.values():
        assert g[0]["target"] <= 2 * g[0]["source_size"]
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= 2 * max(r["size"] for r in g)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, result(spark, sf_dir, "op6_mixing")))


def brute_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(nodes, linked):
    """Smallest id that links reach, for ids given in any order."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_simhash(spark, sf_dir, texts):
    rows = result(spark, sf_dir, "op7_simhash")
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = brute_classes(ids, linked)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{fps[i]:016x}", root[i]) for i in ids}
    assert len(rows) == len(ids)


def test_html(spark, sf_dir, duck):
    pages = {i: (u, h) for i, u, h in duck.sql("select page_id, url, html from pages").fetchall()}
    rows = result(spark, sf_dir, "op8_html_wrappers")
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]][1], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]][0], len(r["text"]))


def test_tree_forest(spark):
    """Recall against brute force on a table with links (the smaller ones have none)."""
    sf = "/root/testdata/sf0.1"
    rows = {r["vec_id"]: r for r in corpus.op10_tree_forest(spark, sf).collect()}
    table = duckdb.sql(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'").fetchall()
    assert len(rows) == len(table)
    x = np.array([r[1] for r in table], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in table])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    found = np.array([rows[r[0]]["n_links"] for r in table])
    assert (found <= linked.sum(axis=1)).all()
    assert found.sum() >= 0.9 * linked.sum()
    for r in rows.values():
        assert r["kept"] == (r["vec_id"] == r["component_id"])
