import hashlib
import re

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from test_texts import brute_classes, contained

from vecengine.llm import byte_bpe, common, secrets

DIR = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """Each stage's effect on its own input, from plain Python."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.written(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        rows = [(i, r.text) for i, r in before.items()]
        if name == "language":
            assert set(after) == {i for i, t in rows if re.search(r"[^\W\d_]", t or "")}
        elif name == "near_duplicates":
            assert set(after) == {d for d, c in brute_classes(rows) if d == c}
        elif name == "decontamination":
            assert set(after) == set(before) - {r[0] for r in contained(rows, items, 0.8)}
        else:
            spans = {r.row.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(list(before.values()))).collect()}
            for i, t in rows:
                want, end = "", 0
                for s in spans[i]:
                    if s.start >= end:
                        want += t[end : s.start] + "[SECRET]"
                    end = max(end, s.end)
                want += t[end:]
                assert after[i].text == want and after[i].n_chars == len(want)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect():
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256


def test_odd_rows_pass_through(spark, odd, nothing):
    for start in (odd, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, DIR), name)
        assert (docs.count() == 0) == (start is nothing)
