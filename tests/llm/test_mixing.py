"""Collocations, mixing and conversation repair: against SQL, brute force and the rules of their contracts."""

import itertools
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noisemill.llm import collocations, curriculum, dialogue, queries

DOCS = "doc_id long, text string, lang string, source string, word string, words string, n long, position double"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", ["op11_setm_collocations", "op12_curriculum_mixing", "op13_grammar_repair"])
def test_same_rows_as_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda rows, at: sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in at) for r in rows), key=str)
    assert sorted(df.columns) == sorted(names)
    assert clean(df.collect(), sorted(df.columns)) == clean(found.fetchall(), order)


# ---- collocations


def brute_phrases(texts, longest, least, inside, most):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\v\f\r":
            lowered = lowered.replace(end, "\0")
        for piece in lowered.split("\0"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in candidates.items():
            holds = [c for q, c in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= inside * a for c in holds):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, k + 1, p, -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(rows[:most])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "block"), [(2, 2, 1 << 22), (3, 3, 64), (4, 2, 200), (5, 3, 1 << 22)])
def test_phrases_equal_brute_force(spark, longest, least, block):
    rng = random.Random(longest)
    vocabulary = ["red", "Red", "tea", "é", "ÉT", "of", "the", "x", "日本", "end"]
    texts = [(" ".join(rng.choices(vocabulary, [5, 3, 2, 1, 1, 5, 5, 1, 1, 1], k=rng.randint(0, 30))).replace(" end", rng.choice([". ", ",", "\n", "\t ", " "])), rng.choice(["en", "EN", None])) for _ in range(150)]
    texts += [(None, "en"), ("", None), (" \t.,;", "fr"), ("one", "fr"), (texts[0][0], "en"), ("red tea " * 3000, "en")]
    docs = spark.createDataFrame([(k // 2, t, lang, None, "w", None, 1, 0.0) for k, (t, lang) in enumerate(texts)], DOCS).repartition(3)
    rows = collocations.mine(docs, longest, least, 50, 40, block_bytes=block, bucket_keys=50).collect()
    want = brute_phrases(texts, longest, least, 50, 40)
    assert sorted(map(tuple, rows)) == want and len(want) > 20


def test_two_words_of_one_name_are_named_anew(spark, monkeypatch):
    docs = spark.createDataFrame([("to be or not to be " * 20, "en")], "text string, lang string")
    real = collocations.occurrences

    def clash(docs, block_bytes, salt):
        ones = real(docs, block_bytes, salt)
        return ones if salt else ones.withColumn("names", F.transform("names", lambda _: F.lit(1).cast("long")))

    monkeypatch.setattr(collocations, "occurrences", clash)
    rows = collocations.mine(docs).collect()
    assert {r.phrase for r in rows} == {"to be or", "be or not", "or not to", "not to be", "to be to", "be to be"}


def test_no_documents_no_phrases(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_a_block_is_scanned_in_parts(monkeypatch):
    """Two workers beside a JVM each took 150 MB and more for a block of 4 MB."""
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 5)))
    rng = random.Random(3)
    words = ["".join(rng.choices("aAbeé", k=rng.randint(1, 7))) for _ in range(30_000)]
    texts = [rng.choice([". ", " "]).join(rng.choices(words, k=rng.choice([0, 1, 300]))) for _ in range(8000)]
    rows = pa.record_batch({"text": texts, "lang": [rng.choice(["en", "EN", "und"]) for _ in texts]})
    tracemalloc.start()
    try:
        blocks = list(collocations._ones(iter([rows]), 7, 1 << 22))
        assert len(blocks) == 2 and tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
    for parts in (1, 1000, 1 << 30):
        assert [x.equals(y) for x, y in zip(collocations._ones(iter([rows]), 7, 1 << 22, parts), blocks, strict=True)] == [True, True]


# ---- mixing


def test_streams_meet_their_targets(spark):
    rng = random.Random(5)
    sources = ["b", None, "a", "B", "é", "tiny", "none"]
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40])), None, rng.choice(sources[:5]), "w", None, 2, 0.5) for k in range(3000)]
    rows += [(7, "one two three", None, "tiny", "w", None, 2, 0.5), (7, "one two three", None, "tiny", None, None, 2, 0.5), (None, None, None, "none", "w", None, 2, 0.5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    plan = curriculum.assign(docs, docs.columns, part_rows=50).collect()
    assert len(plan) == len(rows)
    by = defaultdict(list)
    for r in plan:
        by[r.doc.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and r.size == len((r.doc.text or "").split())
        assert r.taken == sum(p.words for p in r.places) and all(0 <= p.position <= 1 for p in r.places)
    total = sum(r.size for r in plan)
    targets = {}
    for source, found in by.items():
        assert {r.source_size for r in found} == {sum(r.size for r in found)}
        targets[source] = found[0].target
        assert sum(r.taken for r in found) == int(found[0].target)
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    size = {s: found[0].source_size for s, found in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    level = max(targets[s] / weight[s] for s in order if targets[s] < 2 * size[s])
    assert all(targets[s] == pytest.approx(min(2 * size[s], level * weight[s])) for s in order)
    again = curriculum.assign(docs.repartition(2), docs.columns, part_rows=700).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_documents_come_when_their_source_is_asked_for(spark):
    docs = spark.createDataFrame([(k, "w " * 10, s) for k in range(1200) for s in ("early", "even", "late")], "doc_id long, text string, source string")
    steps = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 1.0)))
    rows = curriculum.arrange(docs, weights=(1,), share=1.0, schedules=steps).collect()
    assert len(rows) == 3600 and [r.position for r in rows] == sorted(r.position for r in rows)
    first = Counter(r.source for r in rows if r.position < 0.5)
    assert first["early"] == pytest.approx(900, abs=2) and first["even"] == pytest.approx(600, abs=2) and first["late"] == pytest.approx(400, abs=2)


def test_names_that_clash_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, copy long, words long")
    rows = curriculum.arrange(docs, share=2.0)
    assert rows.columns == ["doc_id", "text", "source", "copy", "words", "_copy", "_words", "position"] and rows.count() == 2
    assert curriculum.arrange(docs.where("doc_id > 1")).count() == 0
    with pytest.raises(ValueError):
        curriculum.area(((0.0, 0.0), (1.0, 0.0)))


# ---- conversations


def brute_repair(symbols):
    """All edits with up to two new rows anywhere, the cheapest, ties by letters."""
    best = {(0, ""): (0, "")}
    frontier = {0: {(0, "")}}
    order = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def widen(states):
        for _ in range(3):
            for st, ways in list(states.items()):
                for (i, r), j in order.items():
                    if i == st and r != "s":
                        states.setdefault(j, set()).update({(c + 5, a + "I") for c, a in ways if a[-3:] != "III"})
        return states

    frontier = widen(frontier)
    for s in symbols:
        after = {}
        for st, ways in frontier.items():
            after.setdefault(st, set()).update((c + 2, a + "D") for c, a in ways)
            if s != "x":
                more = 5 if s.isupper() else 0
                for (i, r), j in order.items():
                    if i == st:
                        if r == s.lower():
                            after.setdefault(j, set()).update((c + more, a + "K") for c, a in ways)
                        if r != "s":
                            after.setdefault(j, set()).update((c + more + 1, a + "R") for c, a in ways)
        frontier = widen(after)
    best = min(w for st in (0, 3) for w in frontier.get(st, ()))
    return best


def test_rules_give_the_cheapest_edits():
    rng = random.Random(3)
    rounds = [{"ua": chr(300), "xx": chr(301), "AU": chr(302)}, {chr(300) * 2: chr(303), "s" + "x": chr(304)}, {chr(303) + "u": chr(305)}]
    grammar = dialogue.Grammar(rounds)
    for n in range(6):
        for _ in range(25):
            symbols = "".join(rng.choices(dialogue.SYMBOLS, k=n))
            assert grammar.repair(symbols) == brute_repair(symbols), symbols
            assert dialogue.Grammar([]).repair(symbols) == grammar.repair(symbols)
    long = "su" + "au" * 3000 + "x" + "ua" * 3000
    assert grammar.repair(long)[0] == dialogue.Grammar([]).repair(long)[0]


def test_learnt_rules_rewrite_all_strings(spark):
    strings = ["uauauaua", "suauaua", "uuuuuuu", "uax", "s", "", "uuuxuuu"]
    table = spark.createDataFrame([(s, k + 1) for k, s in enumerate(strings)], "symbols string, n long")
    grammar = dialogue.learn(table, rounds=8, a_round=4)
    assert grammar.rounds and all(len(grammar.parse(s)) <= max(1, len(s) // 2) for s in strings if len(s) > 6)
    for s in strings:
        assert grammar.repair(s) == dialogue.Grammar([]).repair(s)


def test_faults_and_edge_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there?"), (1, 2, "user", "Hi there?"), (1, 4, "assistant", "no end"), (1, 5, "tool", "So.\t\n"), (1, None, "", "Null turn!"),
        (2, 3, "user", " \t\n"), (None, 1, "user", "Who?"), (None, 2, "assistant", "Nobody."),
    ]
    table = spark.createDataFrame([(*r, r[0] == 2 and r[1] == 9) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    table = table.unionByName(spark.createDataFrame([(3, 1, "user", "Gone.", True)], table.schema))
    found = {r.conv_id: r for r in dialogue.repair(table).collect()}
    assert set(found) == {1, 2, 3, None}
    one = found[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated) == (1, 0, 1, 1)
    assert (one.cost, one.audit) == brute_repair("osuxAo")
    assert one.illegal == 3
    assert found[2].audit == "D" and found[2].repaired == [] and found[2].blank == 1
    assert found[3].cost == 0 and found[3].audit == "" and found[3].repaired == []
    assert [tuple(r) for r in found[None].repaired] == [("user", "Who?"), ("assistant", "Nobody.")] and found[None].cost == 0


def test_damage_follows_the_hash(spark):
    rows = [(k, t, "assistant" if t % 2 else None, "A. b! c?" if t % 3 else None) for k in range(20) for t in range(12)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.gone) for r in dialogue.damage(table).collect())
    want = Counter()
    for k, t, role, text in rows:
        h = zlib.crc32(f"{k}:{t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(h, text)
        want[k, t, "user" if h == 4 else role, text, h == 0] += 2 if h == 3 else 1
    assert got == want


def test_no_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair(dialogue.damage(table)).count() == 0
    assert list(itertools.chain(*dialogue.actions(""))) == []
