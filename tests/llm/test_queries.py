"""The registered queries on the smallest tables, against their contracts in plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from noisemill.llm import queries


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows_of(spark, small, name):
    return queries.QUERIES[name](spark, small).collect()


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_op1(spark, small, texts):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    sequences, seen = {}, Counter()
    for r in rows_of(spark, small, "op1_bm25_packing"):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen.values()) == {1} and len(seen) == sum(map(len, ids.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_op3(spark, small, texts):
    rows = rows_of(spark, small, "op3_byte_cnn_langid")
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id])))


def test_op6(spark, small, texts):
    words = {k: [w.lower() for w in t.encode().split()] for k, t in texts.items()}
    counts = Counter(w for k, ws in words.items() if not held_out(k, 7, 2) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    rows = rows_of(spark, small, "op6_elias_fano_lm")
    assert len(rows) == len(texts)
    for r in rows:
        s = [*words[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7, 2), len(s), sum(counts[w] > 0 for w in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in s), rel=1e-6)
        assert r.score < 0


def test_op7(spark, small, texts):
    rows = {r.doc_id: r for r in rows_of(spark, small, "op7_locally_consistent_parsing")}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(order)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) >= (t == edited)
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_op8(spark, small, texts):
    rows = rows_of(spark, small, "op8_nnpu_toxicity")
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_op10(spark, small, texts):
    rows = {r.doc_id: r for r in rows_of(spark, small, "op10_simhash_near_dedup")}
    assert rows.keys() == texts.keys()
    value = {k: int(r.fingerprint, 16) for k, r in rows.items()}
    label = {k: k for k in value}
    changed = True
    while changed:
        changed = False
        for a in value:
            for b in value:
                if label[b] < label[a] and (value[a] ^ value[b]).bit_count() <= 4:
                    label[a], changed = label[b], True
    assert {k: r.component_id for k, r in rows.items()} == label
    assert all(len(r.fingerprint) == 16 for r in rows.values())
