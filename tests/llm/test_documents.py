import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noisemill.llm import decontaminate, packing, phrases
from noisemill.llm.queries import op2_template_decontamination, tokenizer_path

DDL = "doc_id long, text string, item_id long, shard long, ids string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, 5, 6, "x") for k, t in enumerate(texts)], DDL)


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["Don't we'LL 'S 've x²½ é× ÷ ſ İ", "a<|endoftext|>b", "1234 ÀÉ_ß\x85z\xa0q", "", "it's 'tis\r\n\tfoo", "''s'll ... '' 12'3", "日本語 text", "é café", " \n "]


def test_word_tokenizer_is_the_tokenizer(spark, small, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + ODD
    r = random.Random(4)
    signs = [*"aBst'1 -$_\n", "re", "ve", "ll", "'s", "'LL", "É", "ß", "×", "÷", "Ā", "漢", "́", "<|ENDOFTEXT|>", "x" * 600, "\x0b", "\xa0"]
    texts += ["".join(r.choice(signs) for _ in range(r.randrange(25))) for _ in range(800)]
    want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    for own in (packing.WordTokenizer(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), places=64, most_ids=1000)):
        for size in (len(texts), 3):
            got = []
            for at in range(0, len(texts), size):
                ids, bounds = own(pa.array(texts[at : at + size]), 2)
                got += [ids[x:y].tobytes() for x, y in itertools.pairwise(bounds)]
            assert got == want


def held(pieces, window):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return by_doc


def test_pieces_hold_each_id_once(spark, small, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()] + ODD + [None, "word " * 3000]
    pieces = packing.pack(docs_of(spark, texts), tokenizer_path(), window=256, rows_per_shard=16).collect()
    by_doc = held(pieces, 256)
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        rows = sorted(by_doc[k], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in rows) == ids
        assert [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        assert {r.doc_tokens for r in rows} == {len(ids) // 4}
    assert packing.pack(docs_of(spark, ["a"]).where("false"), tokenizer_path()).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "same text")] * 5 + [(None, None)], "doc_id long, text string")
    rows = packing.pack(df, tokenizer_path()).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 5 * 3 and sum(r.length for r in rows if r.doc_id is None) == 1


def test_bm25_and_neighbours():
    r = np.random.default_rng(0)
    ids = [np.concatenate([r.integers(0, 40, 30) + 1000 * (k % 3), r.integers(5000, 5200, 5)]).astype(np.uint16) for k in range(30)]
    lengths = np.array([len(x) for x in ids])
    index = packing._Bm25(np.concatenate(ids), np.append(0, np.cumsum(lengths)))
    own = index.scores(0)
    terms = set(ids[0].tolist())
    df = {t: sum(t in x for x in ids) for t in terms}
    want = np.zeros(30)
    parts = {}
    for t in terms:
        idf = np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5))
        for d, x in enumerate(ids):
            tf = int((x == t).sum())
            if tf:
                parts[t, d] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / lengths.mean()))
    for t in terms:
        want += [parts.get((t, d), 0.0) for d in range(30)]
    assert np.allclose(own, want, rtol=1e-4)
    pieces = packing.pack_shard(lengths, index.scores, 128)
    first = [d for d, _, _, s, _ in pieces if s == 0]
    assert first[0] == 0 and all(d % 3 == 0 for d in first)


def test_lists_are_rid_of_used_documents():
    r = np.random.default_rng(4)
    lengths = r.integers(1, 60, 300)
    ids, bounds = r.zipf(1.4, lengths.sum()).clip(0, 900).astype(np.uint16), np.append(0, np.cumsum(lengths))
    index, plain = packing._Bm25(ids, bounds), packing._Bm25(ids, bounds)
    unused, read = np.ones(300, bool), []
    for seed in r.permutation(300).tolist():
        unused[seed] = False
        assert np.array_equal(index.scores(seed, unused)[unused], plain.scores(seed)[unused])
        read.append(len(index.doc))
    assert np.mean(read) < 0.7 * len(plain.doc)
    index = packing._Bm25(ids, bounds)
    assert packing.pack_shard(lengths, index.scores, 128) == packing.pack_shard(lengths, lambda seed, unused: plain.scores(seed), 128)


def test_shards_hold_neighbours_and_weights_are_the_corpus(spark, tokenizer):
    r = np.random.default_rng(1)
    vocabulary = sorted(t[:-4] for t in tokenizer.get_vocab() if re.fullmatch("[a-z]{6,}</w>", t))
    words = r.choice(vocabulary, 206, replace=False).tolist()
    themes, words = words[:6], words[6:]
    texts = [" ".join([*[themes[k % 6]] * 3, *r.choice(words, 15)]) for k in range(480)]
    pieces = packing.pack(docs_of(spark, texts), tokenizer_path(), window=256, rows_per_shard=40).collect()
    shards = {}
    for p in pieces:
        shards.setdefault(p.sequence_id >> 40, {})[p.doc_id] = p.doc_id % 6
    assert 10 <= len(shards) <= 12 and sum(map(len, shards.values())) == 480
    most = [max(list(s.values()).count(t) for t in range(6)) / len(s) for s in shards.values()]
    assert np.mean(most) > 0.8  # dealt by a hash: about 0.3
    corpus = packing.corpus_of(packing.tokenized(docs_of(spark, texts).repartition(3), tokenizer_path(), 2))
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=1 << 16)
    assert corpus.n == 480 and corpus.mean == pytest.approx(np.mean([len(x) for x in ids])) and (corpus.df == df).all()


def test_content_keys_are_the_weightiest_tokens():
    r = np.random.default_rng(2)
    ids = [r.integers(0, 60, r.integers(1, 40)).astype(np.uint16) for _ in range(400)]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=1 << 16)
    corpus = packing.Corpus(400, float(np.mean([len(x) for x in ids])), df)
    idf = corpus.idf()
    got = packing.content_keys(np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids])), corpus, idf)
    assert got.shape == (400, 3)  # 133, 44, then 2 documents or more
    for x, row in zip(ids, got.tolist(), strict=True):
        for least, key in zip((400 / 3, 400 / 9, 2), (row[0], row[1], row[-1]), strict=True):
            part = {int(t): idf[t] * n / (n + corpus.norm(np.array([len(x)]))[0]) for t, n in zip(*np.unique(x, return_counts=True), strict=True) if df[t] >= least}
            assert key == (0 if not part else 1 + min(t for t in part if part[t] == max(part.values())))


def test_a_topic_shares_windows_with_many_shards(spark, tokenizer):
    r = np.random.default_rng(3)
    vocabulary = r.permutation(sorted(t[:-4] for t in tokenizer.get_vocab() if re.fullmatch("[a-z]{6,}</w>", t)))
    texts = [" ".join([*r.choice(vocabulary[5000:8000], 20), *r.choice(vocabulary[40 * (k % 30) : 40 * (k % 30) + 40], 12)]) for k in range(900)]
    pieces = packing.pack(docs_of(spark, texts), tokenizer_path(), window=256, rows_per_shard=64).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, set()).add(p.doc_id % 30)
    mixed = np.mean([len(v) for v in windows.values()])
    assert mixed < 5.5  # about 7 of 30 topics in a window dealt at random


# ---- decontamination

ITEMS = [
    "A train leaves Boston at 45 km and meets Alice after 3 hours near the old stone bridge over the river",
    "If Bob has 12 apples and gives 5 apples to Carol how many apples does Bob keep for the long winter",
    "Short one",
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Intro words here. " + ITEMS[0] + " and more words follow.", "exact"),
        (ITEMS[1].replace("Bob", "Dave").replace("12", "77").replace(" 5 ", " 9 "), "reparameterised"),
        (ITEMS[1].replace("gives 5", "gives 8"), "reparameterised"),
        (ITEMS[0].upper(), "exact"),
        ("It was a SHORT ONE indeed", "exact"),
        ("the old stone bridge over the road", None),
        ("", None),
        (None, None),
        ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", None),
    ],
)
def test_templates(spark, benchmark, text, kind):
    rows = decontaminate.contaminated(docs_of(spark, [text]), benchmark).collect()
    assert [r.kind for r in rows] == ([kind] if kind else [])


DENSE = [*ITEMS, "Compute 12 * 7 + 5 / 3 - 8", "Élan für Åsa: Zoë trägt 3 Äpfel über die Brücke"]


@pytest.mark.parametrize(
    "text, items",
    [
        ("Before. " + ITEMS[0].upper() + " after", {0}),
        (ITEMS[1].title(), {1}),
        ("so Compute 12 * 7 + 5 / 3 - 8 then", {3}),
        ("compute 13 * 9 + 4 / 2 - 6", set()),
        ("It was a SHORT ONE indeed", {2}),
        ("a short and one", set()),
        (DENSE[4].upper(), {4}),
        ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", set()),
    ],
)
def test_verbatim_copies_whatever_their_case(spark, text, items):
    benchmark = spark.createDataFrame(list(enumerate(DENSE)), "item_id long, text string")
    rows = decontaminate.contaminated(docs_of(spark, [text]), benchmark).collect()
    assert {r.item_id for r in rows} == items and {r.kind for r in rows} <= {"exact"}
    assert decontaminate.decontaminate(docs_of(spark, [text]), benchmark).count() == (not items)


def test_slots_must_be_a_renaming(spark, benchmark):
    text = ITEMS[1].replace("does Bob", "does Erin")  # one name stands for two
    rows = decontaminate.contaminated(docs_of(spark, [text]), benchmark, coverage=0.99, run=99).collect()
    assert rows == []
    rows = decontaminate.contaminated(docs_of(spark, [text]), benchmark).collect()
    assert [r.kind for r in rows] == ["quoted"] and 13 <= rows[0].matched_tokens < rows[0].item_tokens


SLOTTED = "Take 3 pens and 4 cups to Mia then 5 mugs and 6 bowls to Leo before 7 forks and 8 knives reach Ann at 9 or Tom at 10 today"


@pytest.mark.parametrize(
    "text, kind",
    [
        (SLOTTED.replace("5", "15") + ". Other words. " + SLOTTED.replace("5", "25").replace("Mia", "Eva"), "reparameterised"),
        (SLOTTED + ". Other words. " + SLOTTED.replace("5", "25"), "exact"),
        (" ".join(SLOTTED.split()[:13]) + " stop. Later we Take 13 pens and 14 cups there", "exact"),
        (" ".join(SLOTTED.split()[:13]) + " bowls to Leo before 3 forks and 3 knives", "quoted"),
        (re.sub(r"[0-9]+", "4", SLOTTED), None),
        ("Take 13 pens and 14 cups there. Take 23 pens and 24 cups there", None),
    ],
)
def test_other_variants_hide_none(spark, text, kind):
    item = SLOTTED + " while nobody else in the whole street has noticed anything of what was going on there that day"
    benchmark = spark.createDataFrame([(1, SLOTTED if "Other" in text else item)], "item_id long, text string")
    rows = decontaminate.contaminated(docs_of(spark, [text]), benchmark).collect()
    assert [r.kind for r in rows] == ([kind] if kind else [])
    assert "Other" not in text or rows[0].matched_tokens == rows[0].item_tokens


def test_contradictory_copies_do_not_add_up(spark):
    """Each copy has its own words for most of the item, so that only together they would hold half of it."""
    item = "Mia 3 sells eleven red clay pots daily while Tom 4 paints fourteen old wooden doors near the quiet harbour"
    words = item.split()
    copies = []
    for k in range(50):
        other = [f"w{k}x{j}" for j in range(len(words))]
        at = 2 if k % 2 else 11
        copies.append(" ".join([*other[:at], *words[at : at + 6], *other[at + 6 :], "and so on it went with them all for long"]))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(docs_of(spark, [" ".join(copies)]), benchmark, run=99).count() == 0
    both = " ".join(words[2:8]) + " but then " + " ".join(words[11:17])
    assert [r.kind for r in decontaminate.contaminated(docs_of(spark, [both]), benchmark, run=99).collect()] == ["exact"]
    far = " ".join(words[2:8]) + " but then" * 30 + " " + " ".join(words[11:17])
    assert decontaminate.contaminated(docs_of(spark, [far]), benchmark, run=99).count() == 0


def test_many_variants_in_one_text_take_linear_time(spark):
    """A text with 8,000 variants of an item: one pair, found in seconds."""
    made = [SLOTTED.replace("3", str(k)).replace("Mia", f"Mia{k}") for k in range(1000, 9000)]
    benchmark = spark.createDataFrame([(1, SLOTTED)], "item_id long, text string")
    start = time.monotonic()
    rows = decontaminate.contaminated(docs_of(spark, [". ".join(made)]), benchmark).collect()
    assert [(r.item_id, r.kind) for r in rows] == [(1, "reparameterised")] and rows[0].matched_tokens == rows[0].item_tokens
    bad = [SLOTTED.replace("and", f"and{k}").replace("cups to", f"cups{k} to") for k in range(1000, 9000)]
    contradicting = [re.sub(r"[0-9]+", "4", x) for x in bad]
    assert decontaminate.contaminated(docs_of(spark, [". ".join(contradicting)]), benchmark, coverage=0.95, run=99).count() == 0
    assert time.monotonic() - start < 40


def test_span_is_in_code_points(spark, benchmark):
    text = "é😀 ü. " + ITEMS[0] + " fin"
    r = decontaminate.contaminated(docs_of(spark, [text]), benchmark).first()
    assert text[r.start : r.end] == ITEMS[0]


def test_leaks_equal_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d, i) for d, t in docs for i, x in items if f" {flat(x)} " in f" {flat(t)} "}
    got = {(r.doc_id, r.item_id) for r in op2_template_decontamination(spark, small).collect()}
    assert want and got == want


def test_decontaminate_keeps_the_rest(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), items).count() == 0
    nulls = docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    more = docs.unionByName(nulls).withColumns({"key": F.lit(3), "row": F.lit("r"), "kind": F.lit("k"), "item": F.lit(1)})
    kept = decontaminate.decontaminate(more, items)
    bad = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    rows = kept.collect()
    assert bad and kept.columns == more.columns and {(r.key, r.row, r.kind, r.item) for r in rows} == {(3, "r", "k", 1)}
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - bad | {None}
    twice = decontaminate.contaminated(docs.unionByName(docs), items.unionByName(items))
    assert twice.count() == 4 * decontaminate.contaminated(docs, items).count()


def test_reparameterised_copies_equal_brute_force(spark):
    """Items of words and numbers; texts with copies whose numbers are renamed, or contradict each other."""
    r = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("nal", "bet", "dorf", "kim", "pas", "wen")]

    def item(k):
        n = 3 + k % 3
        parts = []
        for j in range(n):
            parts += [r.choice(words) for _ in range(4)] + [str(10 + j)]
        return [*parts, *(r.choice(words) for _ in range(3))]

    items = [item(k) for k in range(12)]

    def copy(x, kind):
        numbers = [t for t in x if t.isdigit()]
        if kind == "renamed":
            to = dict(zip(numbers, map(str, r.sample(range(100, 999), len(numbers))), strict=True))
        elif kind == "collapsed":
            to = dict.fromkeys(numbers, "77")
        else:
            to = {t: t for t in numbers}
        return [to.get(t, t) for t in x]

    texts, want = [], set()
    for k in range(80):
        filler = lambda: [f"filler{r.randrange(10**6)}" for _ in range(r.randrange(4))]
        text = filler()
        for _ in range(r.randrange(4)):
            i, kind = r.randrange(len(items)), r.choice(["renamed", "renamed", "collapsed", "exact"])
            text += copy(items[i], kind) + filler()
            if kind != "collapsed":
                want.add((k, i))
        texts.append(" ".join(text))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(docs_of(spark, texts), benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and {x.kind for x in rows} == {"exact", "reparameterised"}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_items_are_found_whole(spark, n):
    words = ["Zeugma", "kvasir", "42", "oblique"][:n]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "item_id long, text string")
    texts = ["so " + " ".join(words).upper() + "!", " ".join(words[:-1]), "zeugmas " + " ".join(words[1:]), None]
    rows = decontaminate.contaminated(docs_of(spark, texts), benchmark).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in rows] == [(0, 1, "exact")]


# ---- fingerprints


def test_phrases_do_not_depend_on_the_offset():
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(4000))
    rows, _ = phrases.fingerprints([text, "xyzq" + text, text[:2600] + "".join(r.choice("abcdefgh ") for _ in range(1400)), "".join(r.choice("abcdefgh ") for _ in range(4000)), text, "", "a", "a" * 500])
    like = [float(phrases.likeness(rows[:1], rows[k : k + 1])[0]) for k in range(8)]
    assert like[4] == 1 and like[1] > 0.9 and 0.3 < like[2] < 0.75 and like[3] < 0.1 and like[5] == 0
    alone, _ = phrases.fingerprints([text])
    assert (alone == rows[:1]).all()


def test_phrase_borders_are_local():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    b = np.concatenate([r.integers(0, 1 << 62, 37).astype(np.uint64), a])
    names = [set(phrases._phrases(x, np.array([0]), 1)[0].tolist()) for x in (a, b)]
    assert len(names[0] & names[1]) > 0.98 * len(names[0]) and len(names[0]) < 0.6 * len(a)


MASK = (1 << 64) - 1


def one_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & MASK
    return x


def one_span(names):
    """The hash of a sequence of names: a polynomial, then the length, mixed."""
    total = sum(v * pow(0xD6E8FEB86659FD93, k, 1 << 64) for k, v in enumerate(names))
    return one_mix((total + len(names) * 0x9E3779B97F4A7C15) & MASK)


def one_level(symbols, level):
    runs = [(v, len(list(g))) for v, g in itertools.groupby(symbols)]
    names = [v if n == 1 else one_mix((v + n * 0x9E3779B97F4A7C15) & MASK) for v, n in runs]
    label = list(names)
    for _ in range(4):
        new = []
        for k, v in enumerate(label):
            differ = v ^ (label[k - 1] if k else v ^ 1)
            low = (differ & -differ).bit_length() - 1
            new.append(2 * low + (v >> low & 1))
        label = new
    begins = [k for k in range(len(names)) if k == 0 or k + 1 < len(names) and label[k - 1] < label[k] > label[k + 1]]
    out = []
    for a, b in zip(begins, [*begins[1:], len(names)], strict=True):
        out.append(one_mix((names[a] + level + 1) & MASK) if b - a == 1 else one_span(names[a:b]))
    return out


def one_fingerprint(text):
    symbols = [one_mix(ord(c) + 1) for c in text]
    names = []
    for level in range(1, phrases._LEVELS):
        if not symbols:
            break
        symbols = one_level(symbols, level)
        if level >= phrases.LEVEL or len(symbols) == 1:
            names += symbols
        if len(symbols) == 1:
            break
    bins = [[] for _ in range(phrases.BINS)]
    for x in map(one_mix, names):
        bins[x >> 58].append(x & (1 << 58) - 1)
    return [min(0xFFFE, min(b) & 0xFFFF) if b else 0xFFFF for b in bins]


def one_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x != 0xFFFF or y != 0xFFFF]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_compared_with_next_equals_brute_force(spark, small):
    """Against a parser that takes one symbol after the other."""
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.substring("text", 1, 900).alias("text")).limit(60)
    odd = [(1000, None), (1001, ""), (1002, "é😀 z"), (1003, "x" * 20_000), (-5, "ab"), (None, "no id"), (None, None), (7, "seven"), (7, "again")]
    both = df.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "", r.h) for r in both.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]), reverse=True)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = []
    for k, (i, t, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        a, b, c = map(one_fingerprint, (t, edited, after))
        text = lambda x: "".join(f"{v:04x}" for v in x)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), one_likeness(a, b), one_likeness(a, c)))
    for size in (4000, 1 << 23):
        out = phrases.compare_with_next(both, size).drop("n_phrases")
        assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_compare_few_rows(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = phrases.compare_with_next(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert phrases.compare_with_next(df.where("false")).count() == 0
    many = spark.createDataFrame([(k % 3 or None, f"text number {k}") for k in range(60)], "doc_id long, text string")
    got = phrases.compare_with_next(many, 64).collect()  # each doc_id's rows, and those without, over several ranges
    assert len(got) == 60 and sum(r.doc_id is None for r in got) == 20
    assert phrases.fingerprint_documents(many).count() == 60
