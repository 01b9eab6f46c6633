"""Each stage of the pipeline against brute force on what its predecessor kept."""

import base64
import hashlib
import re

import numpy as np
import tiktoken
from test_minhash import brute as near_brute

import corpus_pipeline as p
from tarnwood.llm import toxicity
from tarnwood.llm.bpe import public_vocabulary
from tarnwood.llm.decontaminate import ANSWER, COPY, PARAPHRASE, SHORT, items_of, lcs, words_of

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def contaminated(text, items):
    """Every item at every place of the text."""
    w = words_of(text)
    for x in items:
        n = len(x.words)
        if n < SHORT:
            if any(w[i : i + n] == x.words for i in range(len(w) - n + 1)):
                return True
            continue
        for i in range(0, max(1, len(w) - 2 * n + n // 2), max(1, n // 4)):
            some = w[i : i + 2 * n]
            share = lcs(x.masks, n, some) / n
            if share >= COPY or share >= PARAPHRASE and len(x.answer & set(some)) >= ANSWER * len(x.answer):
                return True
    return False


def test_stages(spark):
    assert [name for name, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "encoding"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, rows(docs)
    after = []
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.persist()
        after.append(rows(docs))
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert after[0] == [r for r in seen if model.score(r[1]) < 0.7]
    first = {}
    for i, t in after[0]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert after[1] == sorted((i, t) for i, t in after[0] if i in first.values())
    keep = {i for i, _, _, kept in near_brute([t for _, t in after[1]], [i for i, _ in after[1]], 5) if kept}
    assert after[2] == [r for r in after[1] if r[0] in keep]
    items = items_of(sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert after[3] == [r for r in after[2] if not contaminated(r[1], items)]
    path, pattern = public_vocabulary()
    truth = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = sorted((i, len(ids := truth.encode_ordinary(t)), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in after[3])
    assert sorted(tuple(r) for r in p.STAGES[-1][1](spark, docs, SF).collect()) == want
    assert len(after[3]) > 100


def odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties and columns with the operators' own names; labels and benchmark beside them."""
    long = " ".join(f"w{i}" for i in range(40_000))
    base = " ".join(f"near{i}" for i in range(60))
    texts = [None, "", " \n\t", "plain words that stand alone", "plain  words that\nstand alone", base + " one", base + " two", long, long, "Vile word, number here", "zero " + " ".join(f"bench{i}" for i in range(20)) + " end", "é ß İ 日本 😀"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "words of no id", None, None, None), (3, "plain words that stand alone", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS digest", "1 AS kept", "CAST(NULL AS DOUBLE) AS score", "'row' AS row", "0 AS component_id", "'t' AS part")
    more = spark.createDataFrame([(100 + i, f"vile word number w{i}" if i % 2 else f"kind word number w{i}", "en", "s", 1) for i in range(300)], schema)
    docs = docs.unionByName(more, allowMissingColumns=True)
    spark.createDataFrame([(100 + i, i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20))), (2, None), (3, ""), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs


def test_each_stage_on_odd_rows(spark, tmp_path):
    docs, sf = odd_rows(spark, tmp_path).persist(), str(tmp_path)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    lost = {"toxicity": {9, *range(101, 400, 2)}, "exact_dedup": {4, 8, 1, 2}, "near_dedup": {4, 6, 8}, "decontamination": {10}}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert set(got) <= text and (None, "words of no id") in got, name
        gone = {i for i, _ in text} - {i for i, _ in got}
        if name == "exact_dedup":
            assert gone == {1, 4, 8}, gone  # null and the empty text are equal, white space alone is one space
            assert got.count((3, "plain words that stand alone")) == 1
        else:
            assert gone == lost[name], (name, gone)
    rows = p.STAGES[-1][1](spark, docs, sf).collect()
    assert len(rows) == docs.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() in {r.decoded_sha256 for r in rows if r.doc_id == i} for i, t in text)


def test_each_stage_on_an_empty_table(spark, tmp_path):
    docs = odd_rows(spark, tmp_path).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
