import math
import zlib
from collections import Counter

import numpy as np
import pytest

from noisemill.llm import langid, ngram, toxicity
from noisemill.llm._support import fold
from noisemill.llm.eliasfano import EliasFano


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


ODD = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "A" * 50_000), (-5, "x\x0by É é"), (None, "no id"), (-1, "again")]


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (1000, 1 << 64), (5000, 5001), (3000, 10**7)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    values = np.unique(r.integers(0, universe, n, dtype=np.uint64))
    e = EliasFano.encode(values, universe)
    assert (e[np.arange(len(values))] == values).all()
    asked = np.unique(np.concatenate([values, r.integers(0, universe, 300, dtype=np.uint64)]))
    place = {int(v): k for k, v in enumerate(values)}
    assert [place.get(int(x), -1) for x in asked] == e.find(asked).tolist()


def test_ngram_scores_equal_brute_force(spark, docs):
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in every.collect()]
    seen = fold("doc_id", 7) != 2
    model = ngram.train(every.where(seen), order=3, rows_per_shard=32)
    assert len(model.least[0]) > 1
    tokens = lambda t: t.encode().lower().split() + [None]
    n = [Counter() for _ in range(3)]
    total, distinct = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            s = [None, *tokens(t)]
            for k in range(1, len(s)):
                for order in range(min(k + 1, 3)):
                    n[order][tuple(s[k - order : k + 1])] += 1
    for order in (1, 2):
        for g, c in n[order].items():
            total[order][g[:-1]] += c
            distinct[order][g[:-1]] += 1
    size, v = sum(n[0].values()), len(n[0])
    assert (model.tokens, model.distinct) == (size, v)
    want = []
    for i, t in rows:
        s, base, score = [None, *tokens(t)], 0.0, 0.0
        for k in range(1, len(s)):
            c = n[0][(s[k],)]
            base += math.log10((c + 1) / (size + v + 1))
            p = (max(c - 0.75, 0) + 0.75 * v / (v + 1)) / size
            for order in range(1, min(k + 1, 3)):
                h = tuple(s[k - order : k])
                if total[order][h]:
                    p = max(n[order][(*h, s[k])] - 0.75, 0) / total[order][h] + 0.75 * distinct[order][h] / total[order][h] * p
            score += math.log10(p)
        want.append((i, len(s) - 1, sum(n[0][(x,)] > 0 for x in s[1:]), round(base, 6), score))
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in ngram.score(every, model).collect()]
    by = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) <= 0.03 * a[1]


def test_ngram_model_is_normalised(spark):
    text = "a b a c a b b c"
    model = ngram.train(spark.createDataFrame([(1, text)], "doc_id long, text string"), order=2)
    words = ["a", "b", "c"]
    # after "a": every word, the end, and what is left for unseen words
    df = spark.createDataFrame([(k, f"a {w}") for k, w in enumerate([*words, "unseen"])] + [(9, "a")], "doc_id long, text string")
    s = {r.doc_id: r for r in ngram.score(df, model).collect()}
    assert s[9].n_tokens == 2 and s[3].n_known == 2
    assert s[0].score < 0


def test_ngram_without_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ngram.train(none)
    r = ngram.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)
    assert ngram.score(none, model).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, hold_out=(3, 1))
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 3) == 1).collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([*ODD, (-6, "12 34 --"), (-7, "“—” 12"), (-8, "é")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert len(got) == len(ODD) + 3 and all(0 <= s <= 1 for _, _, s in got)
    assert {i for i, lang, _ in got if lang == "und"} == {-1, -2, -3, -6, -7}
    assert langid.predict(odd.where("false"), model).count() == 0
    empty = odd.selectExpr("doc_id", "'' as text", "'x' as lang").unionByName(odd.selectExpr("doc_id", "cast(null as string) as text", "'y' as lang"))
    for nothing in (langid.train(docs.where("false")), langid.train(empty)):
        assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_language_is_learned_from_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(50)
    model = langid.fit_cnn(np.zeros((4, langid.WINDOW), np.uint8) + 65, np.array([0, 1, 0, 1]), ["x", "y"], epochs=1)
    a = langid.predict(docs, model).collect()
    b = langid.predict(docs.selectExpr("doc_id", "text", "'zz' lang", "'q' source"), model).collect()
    assert a == b


def one_window(model, window):
    """The network on one window, a value after the other."""
    pooled = []
    for width, f, b in zip(langid.WIDTHS, model.filters, model.biases, strict=True):
        best = np.full(langid.FILTERS, -np.inf)
        for at in range(langid.WINDOW - width + 1):
            z = np.zeros(langid.FILTERS)
            for k in range(width):
                for d in range(langid.DEPTH):
                    z += float(model.bytes_[window[at + k], d]) * f[k * langid.DEPTH + d]
            best = np.maximum(best, z)
        pooled.append(np.maximum(best + b, 0))
    logits = np.concatenate(pooled) @ model.dense + model.offset
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_network_equals_loops(spark):
    r = np.random.default_rng(1)
    x, y = r.integers(97, 123, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    model = langid.fit_cnn(x, y, ["p", "q", "s"], epochs=2)
    assert np.allclose(model.probabilities(x[:2]), [one_window(model, w) for w in x[:2]], atol=1e-4)
    text = "".join(map(chr, x.ravel()[:700])) + " 12"
    windows = [np.frombuffer(text.encode()[k : k + 256].ljust(256, b"\0"), np.uint8) for k in range(0, len(text), 256)]
    letters = np.array([sum(chr(v).isalpha() for v in w) for w in windows])
    share = (np.array([one_window(model, w) for w in windows]) * letters[:, None]).sum(0) / letters.sum()
    got = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got.lang_pred == model.langs[share.argmax()] and abs(got.score - share.max()) < 1e-4


def test_first_step_follows_the_gradient():
    """Adam's first step has the rate's size against the sign of the gradient, here from differences."""
    r = np.random.default_rng(2)
    x, y = r.integers(97, 110, (8, langid.WINDOW)).astype(np.uint8), r.integers(0, 2, 8)
    start, after = (langid.fit_cnn(x, y, ["p", "q"], epochs=1, size=8, rate=k, seed=5) for k in (0.0, 1e-3))

    def loss(m):
        return -np.log(m.probabilities(x)[np.arange(8), y]).mean()

    checked = 0
    for part in (lambda m: m.dense, lambda m: m.filters[1], lambda m: m.bytes_, lambda m: m.offset):
        a, b = part(start), part(after)
        for at in r.permutation(a.size)[:60]:
            at = np.unravel_index(at, a.shape)
            old = a[at]
            ends = []
            for step in (3e-3, -3e-3):
                a[at] = old + step
                ends.append(loss(start))
            a[at] = old
            slope = (ends[0] - ends[1]) / 6e-3
            if abs(slope) > 5e-3:
                checked += 1
                assert np.sign(b[at] - old) == -np.sign(slope)
    assert checked > 20


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels, hold_out=(4, 2))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 4) == 2).collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([s >= 0.3 for s in toxic]) > 0.85 and np.mean([s >= 0.3 for s in clean]) < 0.05
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0
    low = toxicity.score(docs, model).where("score < 0.3").count()
    assert kept.count() == low


def test_nnpu_undoes_a_negative_risk():
    r = np.random.default_rng(0)
    x = (r.random((400, 30)) < 0.2).astype(np.float32)
    positive = np.arange(400) < 60
    x[positive, 0] = 1
    x[60:100, 0] = 1  # positives among the unlabelled
    x[100:, 0] = 0
    w, b = toxicity.fit_nnpu(x, positive, 40 / 340)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert p[60:100].min() > p[100:].max() and p[60:100].mean() > 0.3 > p[100:].mean()


def test_toxicity_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    scores = {r.score for r in toxicity.score(odd, model).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.3
    assert toxicity.remove_toxic(odd, model).count() == len(ODD)
    marks = spark.createDataFrame([(0, None), (None, 1), (1, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(docs.where("false"), marks)).count() == len(ODD)


def test_nnpu_first_step_follows_the_risk():
    """The first step goes against the gradient of the risk, here from differences of its definition."""
    r = np.random.default_rng(3)
    x = (r.random((60, 6)) < 0.4).astype(np.float32)
    positive, prior = np.arange(60) < 20, 0.3

    def risk(w, b):
        g = x @ w + b
        plus = lambda z: np.logaddexp(0, -z).mean()
        negative = np.logaddexp(0, g[~positive]).mean() - prior * np.logaddexp(0, g[positive]).mean()
        return prior * plus(g[positive]) + max(0.0, negative)

    start = float(np.log(prior / (1 - prior)))
    w, b = toxicity.fit_nnpu(x, positive, prior, steps=1, rate=1e-3, decay=0.0)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-5
        slope = (risk(step, start) - risk(-step, start)) / 2e-5
        assert abs(slope) < 1e-4 or np.sign(w[k]) == -np.sign(slope)
    slope = (risk(np.zeros(6), start + 1e-5) - risk(np.zeros(6), start - 1e-5)) / 2e-5
    assert abs(slope) < 1e-4 or np.sign(b - start) == -np.sign(slope)
