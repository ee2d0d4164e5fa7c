"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, curriculum, decontaminate, dialogue, langid, ngram, packing, phrases, secrets, simhash, toxicity, warc
from ._support import fold, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer lies; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, hold_out=(3, 1))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op5_schema_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are one layout. Its conversations are dealt into payloads of the others, which are
    told apart by their fingerprints again; those too large for a payload keep their typed turns."""
    long = lambda c: F.col(c).cast("long").alias(c)  # noqa: E731
    rows = _table(spark, sf_dir, "conversations").select(long("conv_id"), long("turn"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    said = F.lit(r"\### Assistant: </turn> ok").alias("text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, said)
    typed = chat.turns_from_columns(rows.unionByName(planted)).withColumnRenamed("turns", "typed").drop("layout")
    mixed = chat.payloads(typed.withColumn("turns", F.col("typed"))).drop("turns")
    turns = F.when(F.col("payload").isNull(), F.col("typed")).otherwise(F.col("turns"))
    known = chat.turns_from_json(mixed).select("conv_id", turns.alias("turns"))
    done = chat.format_turns(known).select("conv_id", "formatted", "loss_spans")
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ngram.train(docs.where(fold("doc_id", 7) != 2))
    scored = ngram.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_next(_table(spark, sf_dir, "documents"))


def op8_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), hold_out=(4, 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_boundary_chain_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), archives)
    return warc.read(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.assign(_table(spark, sf_dir, "documents"), ["doc_id"])
    position = F.get(F.col("places"), F.lit(0))["position"]
    rows = plan.select("doc.doc_id", "size", "source_size", "target", "taken", position.alias("position"))
    return rows.sort(F.col("position").asc_nulls_last(), "doc_id")


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dialogue.repair(dialogue.damage(_table(spark, sf_dir, "conversations")))
    whole = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return done.withColumn("repaired_sha256", F.sha2(whole, 256)).drop("repaired")


QUERIES = {
    "op1_bm25_packing": op1_bm25_packing,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_byte_cnn_langid": op3_byte_cnn_langid,
    "op4_trigram_secret_scan": op4_trigram_secret_scan,
    "op5_schema_chat_format": op5_schema_chat_format,
    "op6_elias_fano_lm": op6_elias_fano_lm,
    "op7_locally_consistent_parsing": op7_locally_consistent_parsing,
    "op8_nnpu_toxicity": op8_nnpu_toxicity,
    "op9_boundary_chain_warc": op9_boundary_chain_warc,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_setm_collocations": op11_setm_collocations,
    "op12_curriculum_mixing": op12_curriculum_mixing,
    "op13_grammar_repair": op13_grammar_repair,
}


def _scan_sql() -> str:
    """Spans from matches and the gaps between them, rule by rule, as the operator has them."""
    spans = []
    for k, rule in enumerate(secrets.RULES):
        p = rule.pattern.replace("'", "''")
        parts = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))", f"list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x))", f"list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x))"
        spans.append((k, rule, *parts))
    base = ", ".join(f"{g} AS g{k}, {m} AS m{k}, {c} AS c{k}" for k, _, g, m, c in spans)
    start = "CAST(list_sum(g{k}[1:i]) + coalesce(list_sum(m{k}[1:i-1]), 0) AS BIGINT)"
    each = ", ".join(f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': {start.format(k=k)}, 'o': {k}, 'e': {start.format(k=k)} + m{k}[i], 'k': '{r.kind}', 'c': c{k}[i]}}), lambda x: x.c >= {r.least}) AS s{k}" for k, r, *_ in spans)
    joined = lambda x: f"array_to_string(list_transform({x}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"  # noqa: E731
    whole = "list_sort(" + " || ".join(f"s{k}" for k, *_ in spans) + ")"
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {base} FROM d), s AS (SELECT doc_id, {each} FROM p) SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex, sha256({joined('list_sort(s0 || s1 || s2)')}) AS base_sha256, {joined(whole)} AS spans FROM s"


def _chat_sql() -> str:
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + (length({c}) - length(replace({c}, '<|', ''))) // 2"  # noqa: E731
    marks = sum(map(len, (chat.START, chat.SEP, chat.END)))
    said = "'\\### Assistant: </turn> ok'"
    return f"WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}) SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({marks} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id"


_COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= 10),
inside AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
above AS (SELECT lang, phrase, max(a) AS more FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN above USING (lang, phrase) WHERE coalesce(100 * more, 0) < 50 * a),
cuts AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, ws FROM kept),
scored AS (SELECT x.lang, x.phrase, x.a, x.cut, lf.c AS l, rf.c AS r, CAST((1000000::HUGEINT * x.a * x.a) // (lf.c::HUGEINT * rf.c) AS BIGINT) AS score
  FROM cuts x JOIN f lf ON lf.lang = x.lang AND lf.phrase = array_to_string(ws[1:cut], ' ') JOIN f rf ON rf.lang = x.lang AND rf.phrase = array_to_string(ws[cut + 1:], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least JOIN n USING (lang) QUALIFY rank <= 2000
"""

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS place FROM s),
w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM o),
q AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free FROM w WINDOW before AS (ORDER BY 2.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min(CASE WHEN (wanted - held) / free * weight <= 2 * source_size THEN struct_pack(at := 2.0 * source_size / weight, level := (wanted - held) / free) END).level AS level FROM q),
t AS (SELECT source, source_size, place, least(level * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM w, v),
r AS (SELECT d.doc_id, size, source_size, target, place, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(size, floor(target) - start)) AS one, greatest(0, least(size, floor(target) - start - source_size)) AS two FROM r),
m AS (SELECT *, (CASE WHEN one > 0 THEN start + one / 2.0 ELSE start + source_size + two / 2.0 END)::DOUBLE / target AS met FROM c)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one + two > 0 THEN CASE place % 3
    WHEN 0 THEN least(1.0, 2.0 * met / (1.5 + sqrt(greatest(2.25 - 2.0 * met, 0))))
    WHEN 1 THEN least(1.0, 2.0 * met / (0.5 + sqrt(greatest(0.25 + 2.0 * met, 0))))
    ELSE least(1.0, 2.0 * met / 2.0) END::DOUBLE END AS position FROM m
"""


def _repair_sql() -> str:
    """The same edits row by row: a recursive query over the rows of a conversation and the states of the order."""
    ways = {(i, i): "" for i in dialogue.STATES} | {(0, 2): "u", (0, 3): "ua", (1, 2): "u", (1, 3): "ua", (2, 3): "a", (3, 2): "u"}
    new = {k: (5 * len(v), "I" * len(v)) for k, v in ways.items()}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    rows = []
    for (i, k), (cost, audit) in new.items():
        rows += [(i, c, k, cost + 2, audit + "D") for c in "suaox"]
        for (a, role), j in steps.items():
            if a == k:
                rows.append((i, role, j, cost, audit + "K"))
                rows += [(i, c, j, cost + 1, audit + "R") for c in "suao" if role != "s"]
    moves = ", ".join(map(str, rows))
    ends = ", ".join(str((i, j, *new[i, j])) for i, j in new if j in (0, 3))
    edits = "list_filter(string_split(audit, ''), lambda e: e <> 'D')"
    return rf"""
WITH RECURSIVE moves(i, c, j, cost, letters) AS (VALUES {moves}), ends(i, j, cost, letters) AS (VALUES {ends}),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
h AS (SELECT *, {_crc_sql('id')} % 20 AS h FROM k),
dm AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE h WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last FROM dm),
fa AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial FROM o),
walk AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS st, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, st, best.c, best.a FROM (SELECT w.conv_id, f.pos, m.j AS st, min(struct_pack(c := w.cost + m.cost + CASE WHEN f.fault = 't' AND m.letters NOT LIKE '%D' THEN 5 ELSE 0 END, a := w.audit || m.letters)) AS best
    FROM walk w JOIN fa f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN moves m ON m.i = w.st AND m.c = CASE WHEN f.fault IN ('b', 'd') THEN 'x' ELSE f.initial END GROUP BY ALL)),
z AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, list(struct_pack(role := role, text := text) ORDER BY pos) AS rows, string_agg(initial, '' ORDER BY pos) AS initials FROM fa GROUP BY 1),
e AS (SELECT w.conv_id, min(struct_pack(c := w.cost + ends.cost, a := w.audit || ends.letters)) AS best FROM walk w LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ends ON ends.i = w.st WHERE w.pos = coalesce(z.n, 0) GROUP BY 1),
r AS (SELECT e.conv_id, z.* EXCLUDE conv_id, best.c AS cost, best.a AS audit, len({edits.replace('audit', 'best.a')}) AS kept FROM e LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM e.conv_id),
x AS (SELECT *, CASE WHEN audit = '' THEN [] ELSE list_filter(list_transform(range(1, length(audit) + 1), lambda i: CASE WHEN audit[i] = 'D' THEN NULL ELSE
    (CASE audit[i] WHEN 'K' THEN rows[len(replace(audit[1:i], 'I', ''))].role ELSE ['user', 'assistant'][(len(replace(audit[1:i], 'D', '')) - 1 - kept % 2) % 2 + 1] END) || ':' || CASE audit[i] WHEN 'I' THEN '' ELSE rows[len(replace(audit[1:i], 'I', ''))].text END END), lambda y: y IS NOT NULL) END AS out FROM r)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  CAST(coalesce(len(list_filter(range(1, length(initials)), lambda i: initials[i:i + 1] NOT IN ('su', 'ua', 'au'))), 0) AS BIGINT) AS illegal, cost, audit, sha256(array_to_string(out, chr(10))) AS repaired_sha256 FROM x
"""


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda c, x: list_reduce([xor(c, x)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({codes}, {byte}), 4294967295)"


ORACLES: dict[str, str] = {
    "op11_setm_collocations": _COLLOCATIONS_SQL,
    "op12_curriculum_mixing": _MIX_SQL,
    "op13_grammar_repair": _repair_sql(),
    "op4_trigram_secret_scan": _scan_sql(),
    "op5_schema_chat_format": _chat_sql(),
    "op9_boundary_chain_warc": "WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p), d AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM f) SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM d",
}
