"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bytepairs, collocations, importance, langid, mixing, near_dedup, packing, pieces, pii, quality_rules, repeats, topk, variants
from fieldloom.llm.shared import table


#: Where the public tokenizers' files are; a parameter of the operators.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings")).withColumn("weights", topk.quantized(256.0))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


def op4_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", length=2048)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, share = importance.target_of(table(spark, sf_dir, "labels"))
    return importance.resample(table(spark, sf_dir, "documents"), target, share)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language_model(documents.where(~langid.held_out()))
    return langid.identify(documents, model, langid.held_out().alias("held_out"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "parity", "round_trip")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), delete_one_in=97)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digest(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_packed_tokens": op4_packed_tokens,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_repeated_strings": op9_repeated_strings,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

#: Links of documents by exact shingle sets, and the components they make.
OP5_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
root AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n_shingles, coalesce(root.component_id, n.doc_id) AS component_id, n.doc_id = coalesce(root.component_id, n.doc_id) AS kept
FROM n LEFT JOIN root USING (doc_id)
"""

OP2_SQL = r"""
WITH
good AS (SELECT doc_id, CASE WHEN min(quality) > 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(weight, 1.0) AS weight, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents LEFT JOIN good USING (doc_id)),
k AS (SELECT doc_id, source, size, -ln((CAST(concat('0x', substr(md5(concat(name, '|17')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS key FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
rated AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS rate, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM per),
level AS (SELECT *, (budget - coalesce(CAST(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)) / CAST(sum(rate) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM rated WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / rate, source NULLS LAST)),
goal AS (SELECT source, source_size, CASE WHEN CAST(cap AS DOUBLE) / rate <= level THEN CAST(cap AS DOUBLE) ELSE rate * max(CASE WHEN CAST(cap AS DOUBLE) / rate > level THEN level END) OVER () END AS target FROM level),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal),
run AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before FROM k)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run JOIN whole ON run.source IS NOT DISTINCT FROM whole.source
"""


#: CRC-32 from its polynomial, byte by byte; near words by what is left without a character, or with one masked.
OP11_SQL = r"""
WITH RECURSIVE
codes AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS code),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS bytes FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, length(bytes) // 2 + 1), lambda i: CAST(concat('0x', substr(bytes, 2 * i - 1, 2)) AS BIGINT)),
  lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM each, codes),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
masks AS (SELECT DISTINCT word, concat(substr(word, 1, i), '*', substr(word, i + 2)) AS mask FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
less AS (SELECT DISTINCT word, concat(substr(word, 1, i), substr(word, i + 2)) AS other FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT DISTINCT a.word, b.word AS other FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT less.word, less.other FROM less JOIN v ON v.word = less.other UNION SELECT less.other, less.word FROM less JOIN v ON v.word = less.other),
near AS (SELECT p.word, count(*) AS n_near, first(v.word ORDER BY v.n DESC, v.word) AS form, max(v.n) AS form_n FROM pairs p JOIN v ON v.word = p.other GROUP BY p.word),
found AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN near ON near.word = v.word),
walk(word, root) AS (SELECT word, form FROM found WHERE form IS NOT NULL UNION ALL SELECT walk.word, found.form FROM walk JOIN found ON found.word = walk.root AND found.form IS NOT NULL),
last AS (SELECT walk.word, walk.root FROM walk JOIN found ON found.word = walk.root AND found.form IS NULL)
SELECT found.word, form, coalesce(root, found.word) AS root, n, n_near, form_n FROM found LEFT JOIN last ON last.word = found.word
"""


OP12_SQL = r"""
WITH
d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (SELECT lang, part AS phrase, max(a) AS longer FROM (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS part FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT lang, phrase, a, w, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _op7_sql() -> str:
    """Matches and the gaps between them give positions; the checks are list expressions."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b",
        "idnumber": pii.PATTERNS["idnumber"],
        "secret": r"[A-Za-z0-9+/_-]{32,}",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (CAST(substr(reverse({digits}), i, 1) AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) // 10 + (CAST(substr(reverse({digits}), i, 1) AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 10)) % 10 = 0"
    turned = "replace(concat(substr(v, 5), substr(v, 1, 4)), ' ', '')"
    value = f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({turned}, i, 1)) - 1)"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})'))) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_transform(range(1, length({turned}) + 1), lambda i: {value}), lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97, 0) = 1",
        "idnumber": "true",
        "secret": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')",
    }
    parts = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        score = f"{pii.SCORES[kind]} + CASE WHEN regexp_matches(lower(around), '{pii.CONTEXT[kind]}') THEN {pii.BOOST} ELSE 0 END"
        parts.append(f"""SELECT doc, {order} AS kind_order, '{kind}' AS kind, s, s + length(v) AS e, {score} AS score FROM (
  SELECT doc, v, s, concat_ws(' ', substr(text, greatest(s - {pii.BEFORE}, 0) + 1, s - greatest(s - {pii.BEFORE}, 0)), substr(text, s + length(v) + 1, {pii.AFTER})) AS around FROM (
  SELECT doc, text, found[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS s FROM (
    SELECT doc, text, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc, text, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM t)))) WHERE {checks[kind]}""")
    union = "\nUNION ALL\n".join(parts)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
every AS ({union}),
spans AS (SELECT * FROM every WHERE kind_order < {len(pii.BASE)} OR score >= {pii.LEAST_SCORE}),
per AS (SELECT doc, {counts}, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, kind_order) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, kind_order) AS scores,
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, kind_order) FILTER (WHERE kind_order < 4) AS base FROM spans GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN per USING (doc)
"""


ORACLE_SQL: dict[str, str] = {"op2_source_mixing": OP2_SQL, "op3_exact_top_k": OP3_SQL, "op5_minhash_near_dedup": OP5_SQL, "op7_pii": _op7_sql(), "op11_spelling_variants": OP11_SQL, "op12_collocations": OP12_SQL}
