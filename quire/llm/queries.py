"""One query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, dedup, divergence, edits, fingerprints, langid, licences, packing, quality, resampling, simhash, warc

#: The public vocabularies; a deployment may keep them elsewhere.
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The conversation that the formatting query adds.
SPELLED = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity_audit(_table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", SPELLED), (-1, 1, "assistant", SPELLED)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(turns.unionByName(more)).drop("error")


def op4_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op6_pack_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edited_counts(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def op10_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.grace_dedup(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_audit(_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_quality_rules, op2_warc_fixity, op3_chat_format, op4_simhash_mih, op5_bpe_replay, op6_pack_lexical, op7_language_ppm, op8_edit_counts, op9_licence_digests, op10_grace_dedup,
    op11_source_divergence, op12_importance_resample, op13_winnow_fingerprints,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM t),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS p FROM w WHERE len(ws) >= 5),
counted AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[p:p+4], ' ')) AS c FROM starts),
gaps AS (SELECT doc_id, least(5, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 5)) AS g FROM counted WHERE c > 1),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(ls) AS n_lines, length(regexp_replace(x, '[^\p{L}]+', '', 'g')) AS n_letters,
             length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS n_upper,
             length(x) - length(regexp_replace(x, '[!?]', '', 'g')) AS n_shouts
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
          + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
          + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
          + CASE WHEN 10 * n_letters < 6 * word_chars THEN 32 ELSE 0 END + CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END
          + CASE WHEN 4 * n_shouts > n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

_OP2 = r"""
WITH r AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, 'part-' || (page_id // 512) || '.0.warc' AS file,
                  ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 1000 AS draw FROM pages),
s AS (SELECT *, strlen('WARC/1.1') + 2 + strlen('WARC-Type: resource') + 2 + strlen('WARC-Target-URI: ') + strlen(u) + 2
             + strlen('WARC-Record-ID: <urn:sha1:') + 40 + 1 + 2 + strlen('Content-Type: text/html') + 2
             + strlen('Content-Length: ') + strlen(strlen(h)::VARCHAR) + 4 + strlen(h) + 4 AS n FROM r),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s)
SELECT file, off AS "offset", page_id, CASE WHEN draw < 20 THEN 'corrupt' ELSE 'missing' END AS status FROM o WHERE draw < 25
"""

_OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next,
             CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11
                       ELSE 20 + length(role) + len(regexp_extract_all(role, '\\|\[/?ROLE\]|\[/?INST\]|\[/?SYS\]|\[/?ANS\]|\[/TURN\]|</?s>')) END
             + length(x) + len(regexp_extract_all(x, '\\|\[/?ROLE\]|\[/?INST\]|\[/?SYS\]|\[/?ANS\]|\[/TURN\]|</?s>')) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, x)),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x) AS said,
             coalesce(string_agg(x, '' ORDER BY turn, x) FILTER (WHERE role = 'assistant'), '') AS answers, (sum(n) + 7)::BIGINT AS formatted_chars,
             bool_and(coalesce(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
                                    WHEN prev = 'user' THEN role = 'assistant' ELSE false END, false) AND (next IS NOT NULL OR role = 'assistant')) AS valid
      FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(answers)::BIGINT AS loss_chars, sha256(answers) AS loss_sha256, formatted_chars, valid FROM g
"""

_OP10 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
g AS (SELECT doc_id, sha256(x) AS text_sha256, first_value(doc_id) OVER (PARTITION BY x ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    def lines(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), {_quoted(licences.NOTICE_LINE)}, ' ', 'g')"
        out = f"regexp_replace({out}, {_quoted(licences.NOTICE_PARAGRAPH)}, '\\1\\2', 'g')"
        for old, new in licences.SPELLINGS:
            out = f"regexp_replace({out}, {_quoted(old)}, {_quoted(new)}, 'g')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def flat(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    def blocks(x: str) -> str:
        return f"list_distinct(list_concat(list_transform(string_split({x}, chr(10)), lambda v: trim(v)), list_transform(regexp_split_to_array({x}, '\\n(?: *\\n)+'), lambda v: {flat('v')})))"

    given = ", ".join(f"('{kind}', {_quoted(name)}, {_quoted(t)})" for kind, table in (("text", licences.TEXTS), ("notice", licences.NOTICES)) for name, own in sorted(table.items()) for t in own)
    digests = ", ".join(f"('text', '{d}', {_quoted(name)})" for name, own in sorted(licences.DIGESTS.items()) for d in own)
    return f"""
WITH given AS (SELECT kind, licence, {lines("t")} AS x FROM (VALUES {given}) AS v(kind, licence, t)),
forms AS (SELECT kind, licence, {flat("x")} AS form FROM given
          UNION ALL SELECT * FROM (SELECT 'block', licence, unnest({blocks("x")}) AS form FROM given WHERE kind = 'text') WHERE len(string_split(form, ' ')) >= {licences.MIN_WORDS}),
known AS (SELECT DISTINCT CASE kind WHEN 'text' THEN 'text' ELSE 'block' END AS kind, sha256(form) AS d, min(licence) AS licence FROM forms WHERE form <> '' GROUP BY forms.kind, form HAVING forms.kind <> 'block' OR count(DISTINCT licence) = 1
          UNION ALL SELECT * FROM (VALUES {digests})),
docs AS (SELECT doc_id, {lines("text")} AS x FROM documents),
units AS (SELECT doc_id, unnest({blocks("x")}) AS form FROM docs),
met AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, min(licence) AS one, count(DISTINCT licence) AS n FROM units JOIN known ON kind = 'block' AND d = sha256(form) GROUP BY doc_id),
texts AS (SELECT doc_id, sha256({flat("x")}) AS text_digest FROM docs)
SELECT doc_id, text_digest, coalesce(known.licence, CASE WHEN n = 1 THEN one END) AS licence, known.licence IS NOT NULL AS whole, coalesce(notices, '') AS notices
FROM texts LEFT JOIN known ON kind = 'text' AND text_digest = d LEFT JOIN met USING (doc_id)
"""


_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS x FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER o + 5 * count(*) OVER o)::HUGEINT AS p FROM f WINDOW o AS (PARTITION BY lang, source)),
w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER o + 5 * count(*) OVER o)::HUGEINT AS q FROM w WINDOW o AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""

#: CRC-32 is folded over a list in which a byte is given as itself + 256 and followed by its eight shifts.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT 0 AS side, r, x FROM d UNION ALL SELECT 1, row_number() OVER (), coalesce(text, '') FROM benchmark),
w AS (SELECT side, r, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM a),
f AS (SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w),
c AS (SELECT side, r, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM c)),
k AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(x) // 2), lambda i: [256 + ('0x' || substr(x, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
             lambda acc, y: CASE WHEN y >= 256 THEN xor(acc, y - 256) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 10000 AS bucket FROM h),
b AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM c JOIN k USING (feature) GROUP BY bucket),
z AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM b),
m AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS mean FROM c JOIN k USING (feature) JOIN z USING (bucket) WHERE side = 0 GROUP BY r),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(mean, 0) AS weight, len(ws) AS n_words,
             coalesce(mean, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d JOIN w ON w.side = 0 AND w.r = d.r LEFT JOIN m ON m.r = d.r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM o
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents),
l AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS y FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT row_number() OVER () AS r, doc_id, n, x, y, substr(x, 1, n - n // 2) || substr(y, 1, n // 2) AS z FROM l),
u AS (SELECT r, 'x' AS side, x AS v FROM e UNION ALL SELECT r, 'y', y FROM e UNION ALL SELECT r, 'z', z FROM e),
c AS (SELECT r, side, list_transform(regexp_extract_all(v, '[^\x20\x09-\x0D]{1,16}'), lambda t: ('0x' || substr(md5(t), 1, 10))::BIGINT) AS c FROM u),
p AS (SELECT r, side, CASE WHEN len(c) BETWEEN 1 AND 3 THEN list_concat(c, list_transform(range(0, 4 - len(c)), lambda i: 0::BIGINT)) ELSE c END AS c FROM c),
g AS (SELECT r, side, list_transform(range(1, len(c) - 2), lambda i: ((c[i] * 2048383 + c[i + 1] * 16129 + c[i + 2] * 127 + c[i + 3]) % 1099511627689) * 8388608 + (8388607 - (i - 1) % 8388608)) AS g FROM p),
m AS (SELECT r, side, CASE WHEN len(g) = 0 THEN [] WHEN len(g) < 12 THEN [list_min(g)] ELSE list_transform(range(1, len(g) - 10), lambda i: list_min(g[i:i + 11])) END AS m FROM g),
k AS (SELECT r, side, m, list_filter(range(1, len(m) + 1), lambda i: i = 1 OR m[i] <> m[i - 1]) AS i FROM m),
s AS (SELECT r, side, list_transform(i, lambda j: m[j] // 8388608) AS h, list_transform(i, lambda j: 8388607 - m[j] % 8388608) AS pos FROM k),
f AS (SELECT r, side, h, array_to_string(list_transform(h, lambda v: printf('%010x', v)), ' ') AS text, array_to_string(pos, ' ') AS pos FROM s)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.z) AS edited_sha256, a.text AS fingerprint, b.text AS edited_fingerprint,
       CASE WHEN len(list_concat(a.h, b.h)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.h, b.h))::DOUBLE / len(list_distinct(list_concat(a.h, b.h))) END AS near_edited,
       CASE WHEN len(list_concat(a.h, q.h)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.h, q.h))::DOUBLE / len(list_distinct(list_concat(a.h, q.h))) END AS near_next,
       a.pos AS positions, b.pos AS edited_positions
FROM e JOIN f a ON a.r = e.r AND a.side = 'x' JOIN f b ON b.r = e.r AND b.side = 'z' JOIN f q ON q.r = e.r AND q.side = 'y'
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _OP1, "op2_warc_fixity": _OP2, "op3_chat_format": _OP3, "op9_licence_digests": _licence_sql(), "op10_grace_dedup": _OP10,
        "op11_source_divergence": _OP11, "op12_importance_resample": _OP12, "op13_winnow_fingerprints": _OP13,
    }
