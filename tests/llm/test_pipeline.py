"""The pipeline, stage by stage on its own input, against brute-force versions; and run() as a whole."""
import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_contracts import brute_classes, brute_fingerprint

from leafmill.llm import mixing, quality, queries, secret_scan
from leafmill.llm.common import stored


def test_stages(spark, sf_dir):
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(stored(stage(spark, outputs[-1], sf_dir), f"test-{name}"))
    assert all(o.columns == docs.columns for o in outputs[:-1])
    rows = [[r.asDict() for r in o.collect()] for o in outputs]
    first, kept, single, clean, mixed, encoded = rows

    # quality: what the model scores below the limit goes
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r["doc_id"] for r in first if model.score(np.array([quality.statistics(r["text"] or "")]))[0] >= corpus_pipeline.LEAST_SCORE]
    assert sorted(r["doc_id"] for r in kept) == sorted(want) and len(kept) < len(first)

    # near-duplicates: the smallest id of each class of fingerprints
    fps = {r["doc_id"]: brute_fingerprint(r["text"] or "") for r in kept}
    ids = sorted(fps)
    root = brute_classes(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert sorted(r["doc_id"] for r in single) == sorted(i for i in ids if root[i] == i) and len(single) < len(kept)

    # secrets: every span of the scan is gone, all else stays
    before = {r["doc_id"]: r for r in single}
    assert sorted(before) == sorted(r["doc_id"] for r in clean)
    for r in clean:
        old = before[r["doc_id"]]
        hidden = set()
        for _, a, b in secret_scan.scan(old["text"], 40.0):
            hidden.update(range(a, b))
        shown = "".join("\0" if i in hidden else c for i, c in enumerate(old["text"]))
        assert r["text"] == re.sub("\0+", "[secret]", shown)
        assert r["n_chars"] == len(r["text"]) and (r["source"], r["lang"]) == (old["source"], old["lang"])

    # mix: as often as the SQL twin takes each document of the cleaned table
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(clean))
    taken = {i: t // s for i, s, _, _, t in con.sql(mixing.SQL).fetchall() if s}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: n for i, n in taken.items() if n})
    text = {r["doc_id"]: r["text"] for r in clean}
    assert all(r["text"] == text[r["doc_id"]] for r in mixed)

    # tokens
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, queries.byte_ranks().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed)
    for r in encoded:
        ids = np.array(enc.encode_ordinary(text[r["doc_id"]]), dtype="<u4").tobytes()
        assert bytes(r["token_ids"]) == ids and r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()

    # run() is the stages in order
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, whole)) == Counter((r["doc_id"], r["ids_sha256"]) for r in encoded)


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empty and repeated rows, an empty table and extra columns pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, words, "en", "a", 9), (1, words, "en", "a", 9), (2, None, None, None, None), (None, words + " more", "en", None, 1), (3, "", "en", "b", 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).selectExpr("*", "'x' as score", "1 as fp", "2 as size")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, sf_dir), "test-odd")
            assert out.columns == docs.columns
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
