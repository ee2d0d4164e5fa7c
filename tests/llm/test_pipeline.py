import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noisemill.llm import secrets, toxicity
from noisemill.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Every stage's input and output, each written and read again."""
    out, docs = [], spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, small).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out, strict=True))


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.schema == before.schema, name
        kept, had = rows(after), rows(before)
        assert 0 < len(kept) <= len(had) and kept.keys() <= had.keys()
        if name != "secret_scan":
            assert all(kept[k] == had[k] for k in kept)


def test_toxic_documents_go(spark, small, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(before, model).where("score < 0.3").collect()}
    assert rows(after).keys() == want and len(want) < before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash_near_dedup"]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    s = {k: shingles(r.text) for k, r in rows(before).items()}
    kept = rows(after).keys()
    like = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in itertools.combinations(sorted(s), 2) if s[a] & s[b]}
    assert not [p for p, j in like.items() if j >= 0.9 and p[0] in kept and p[1] in kept]
    near = {x for p, j in like.items() if j >= 0.7 for x in p}
    assert s.keys() - kept <= near
    copies = {}
    for k, r in sorted(rows(before).items()):
        copies.setdefault(r.text, k)
    assert kept <= set(copies.values())


def test_benchmark_items_are_gone(spark, small, stages):
    before, after = stages["benchmark_decontamination"]
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {k for k, r in rows(before).items() if any(f" {i} " in f" {flat(r.text)} " for i in items)}
    assert bad and rows(after).keys() == rows(before).keys() - bad


def test_secrets_are_hidden(stages):
    before, after = stages["secret_scan"]
    spans = {r.doc_id: r.spans for r in secrets.scan(before).select("doc_id", "spans").collect()}
    old = rows(before)
    for k, r in rows(after).items():
        assert (r.text == old[k].text) == (not spans[k]) and r.n_chars == len(r.text)
    assert secrets.scan(after).where(F.size("spans") > 0).count() == 0


def test_packed_tokens_are_the_texts(stages):
    from tokenizers import Tokenizer

    before, pieces = stages["packing"]
    tokenizer, by_doc = Tokenizer.from_file(tokenizer_path()), {}
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.start)):
        by_doc[r.doc_id] = by_doc.get(r.doc_id, b"") + bytes(r.ids)
    for k, r in rows(before).items():
        assert by_doc.pop(k) == np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert not by_doc


def test_run_is_the_stages(spark, small, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in df.collect())
    assert key(corpus_pipeline.run(spark, small)) == key(stages["packing"][1])
