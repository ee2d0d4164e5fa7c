import functools
import itertools
import os
import subprocess
import sys

import numpy as np
import pytest
import xxhash

from noisemill.llm import _support, components, simhash

DOCS = "doc_id long, text string, source string, node long, label long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "s", 1, 2) for k, t in enumerate(texts)], DOCS)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    label = dict.fromkeys(ids)
    for i in sorted(ids):
        if label[i] is None:
            stack = [i]
            while stack:
                x = stack.pop()
                if label[x] is None:
                    label[x] = i
                    stack += [y for y in ids if label[y] is None and linked(x, y)]
    return label


def test_near_duplicates_equal_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in rows] + [None, "", "one", "ONE", "a b c", "a b c", "É x y z w", "x\x0by\x1fz"]
    texts += [texts[0] + " tail", texts[0][:-3]]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r.fp & (1 << 64) - 1 for k, r in found.items()} == fps
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {k: r.component_id for k, r in found.items()} == want


@pytest.mark.parametrize("distance, segments", [(1, 2), (4, 3), (3, 4), (7, 3)])
def test_links_lose_nothing(spark, distance, segments):
    r = np.random.default_rng(distance)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = {int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 9), replace=False)) for b in base for _ in range(8)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(signed)], "node long, fp long")
    got = {tuple(sorted((x.u, x.v))) for x in simhash.links(df, distance, segments).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a, b in itertools.combinations(range(len(signed)), 2) if ((signed[a] ^ signed[b]) & mask).bit_count() <= distance}
    assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (500, None)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}
    for per_task in (1 << 20, 7):  # in one task, and in rounds
        assert {r.node: r.component for r in components.connected_components(df, per_task).collect()} == want
    assert components.connected_components(df.where("false")).count() == 0


def test_dense_group_is_one(spark):
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 120, 2)] + ["something else entirely " * 9]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs_of(spark, texts)).collect()}
    assert {got[k] for k in range(60)} == {0} and got[60] == 60


def test_near_copies_reach_the_similarity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    s = {k: shingles(t) for k, t in texts.items()}
    like = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in itertools.combinations(s, 2) if s[a] & s[b]}
    assert all(got[a] == got[b] for (a, b), j in like.items() if j >= 0.9)
    best = {}
    for (a, b), j in like.items():
        for x, y in ((a, b), (b, a)):
            if got[x] == got[y]:
                best[x] = max(best.get(x, 0), j)
    assert all(best[k] >= 0.7 for k, c in got.items() if c != k)


@functools.cache
def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def likeness(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_the_similarity_is_counted(spark):
    texts, r = [], np.random.default_rng(5)
    for k in range(24):  # a text of 204 words and its copy with some words changed, next to 0.8 from both sides
        words = [f"g{k}n{i}" for i in range(204)]
        copy = list(words)
        for i in r.choice(np.arange(10, 194, 8), 4 + k % 2, replace=False):
            copy[i] = f"other{i}"
        if k % 3:
            copy += [f"tail{i}" for i in range(k % 3 * (2 - k % 2))]
        texts += [" ".join(words), " ".join(copy)]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs_of(spark, texts)).collect()}
    like = [likeness(texts[k], texts[k + 1]) for k in range(0, 48, 2)]
    assert min(like) > 0.74 and max(like) < 0.86 and {j >= 0.8 for j in like} == {True, False}
    assert [got[k] == got[k + 1] for k in range(0, 48, 2)] == [j >= 0.8 for j in like]


def test_every_shape_of_edit_is_found(spark):
    r, pairs = np.random.default_rng(9), []
    draw = lambda n: [f"w{i}" for i in r.zipf(1.3, n) % 5000]
    for k in range(60):
        long, short, other = draw(300), draw(14 + k % 15), draw(60)
        pairs += [(long, long + other[: 20 + k // 2]), (long, long[: 280 + k // 10] + other[:16]), (long, other[:40] + long)]
        pairs += [(short, [*short, "more"]), (short, [*short[:-1], "changed"])]
    texts = [" ".join(t) for p in pairs for t in p]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs_of(spark, texts)).collect()}
    label = brute_components(range(len(texts)), lambda a, b: likeness(texts[a], texts[b]) >= 0.8)
    assert sum(label[k] == label[k + 1] for k in range(0, len(texts), 2)) > 200 and got == label


def test_deduplicate_keeps_rows_and_columns(spark):
    texts = ["the same words here again and again", "the same words here again and again", None, "", "other words of another kind altogether"]
    df = docs_of(spark, texts).unionByName(spark.createDataFrame([(None, "no id", "s", 1, 2)], DOCS))
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 0), (False, 2), (False, 4), (True, None)]
    assert simhash.deduplicate(df.where("false")).count() == 0 and simhash.near_duplicates(df.where("false")).count() == 0


def test_filtered_joins_equal_plain_ones(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, f"t{k}", k) for k in range(300)], "id long, word string, bits long")
    keys = spark.createDataFrame([(k,) for k in (1, 2, 2, 5, 6, 100, 999, None)], "id long")
    for words in (1, 1 << 17):
        for got, how in ((_support.semi_join(rows, keys, "id", words), "left_semi"), (_support.anti_join(rows, keys, "id", words), "left_anti")):
            assert sorted(r.bits for r in got.collect()) == sorted(r.bits for r in rows.join(keys, "id", how).collect())
    some, others = _support.split_by(rows, keys, "id")
    assert some.columns == others.columns == rows.columns and some.count() < 20 and some.count() + others.count() == 300
    assert _support.anti_join(rows, keys.where("false"), "id").count() == 300 and _support.semi_join(rows, keys.where("false"), "id").count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        each = context.statusStore().executorList(True)
        return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))

    r, old = np.random.default_rng(3), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    texts = ["".join(map(chr, r.integers(97, 123, 20000))) + f" w{k}" for k in range(400)]
    path = _support.shared_dir(spark, "texts")
    docs_of(spark, [*texts, texts[0], None, ""]).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled()
        kept = {x.doc_id for x in simhash.deduplicate(spark.read.parquet(path)).collect()}
        assert kept == {*range(400), 401} and shuffled() - before < sum(map(len, texts)) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


_WORKER = """
import re
import numpy as np, pyarrow as pa
from noisemill.llm import _support, simhash

def held():
    return int(re.search(r"\\nPss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n):
    r = np.random.default_rng(1)
    for _ in range(n):
        texts = [" ".join(map(str, r.integers(0, 9999, r.integers(1, 800)))) for _ in range(1500)]
        yield pa.record_batch([np.arange(1500), texts], ["doc_id", "text"])

for _ in batches(1):
    pass
before, rows = held(), 0
for x in _support.slices(batches(3)):
    rows += simhash._sketch(x, 5, 8).num_rows
print(rows, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_workers_give_memory_back():
    out = subprocess.run([sys.executable, "-c", _WORKER], check=True, capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    rows, mb = out.stdout.split()
    assert int(rows) == 4500 and float(mb) < 30
