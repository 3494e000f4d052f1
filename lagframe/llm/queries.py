"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from . import quality as rules
from .ann import nearest
from .chat import mask_text, preference_format, stale_reply_pairs
from .conversation_repair import damage, parse, repaired_digests
from .language_id import language_id
from .media import media_digest
from .ngram_join import ngram_jaccard_join
from .packing import packing
from .scratch import store
from .substring_dedup import substring_dedup
from .token_counts import context_limits, length_histogram
from .toxicity import toxicity
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, threshold="0.9")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, {"good": 0.85, "low": 0.10, "toxic": 0.05})


def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_format(stale_reply_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: mask_text(c) for c in ("chosen_mask", "rejected_mask")})


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations"))
    parsed = store(parse(rows))
    return parsed.join(repaired_digests(rows, parsed).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_media_jpeg": op3_media_jpeg,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_preference": op9_chat_preference,
    "op10_ann": op10_ann,
    "op11_whitening": op11_whitening,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Lower-cases A-Z only, as the operator does.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD = r"[^\x20\x09-\x0D]+"


def _character_classes() -> list[str]:
    """Patterns of the classes' characters, in order."""
    marks = "".join("\\" + c for c in rules.PUNCTUATION.decode())
    own = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", marks.replace("'", "''")]
    return [*own, r"\x00-\x7F", r"\x{80}-\x{10FFFF}"]


def _quality_sql() -> str:
    """Histograms and distances in SQL: a bin is a character class or a common word, the last word bin has all other words."""
    counts = [f"length(regexp_replace(text, '[^{c}]', '', 'g'))" for c in _character_classes()]
    counts[5] = " - ".join([counts[5], *counts[:5]])
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, text IS NOT NULL AND lang IS NOT NULL AS teaches FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, [{", ".join(counts)}] AS cs FROM d),
        l AS (SELECT r, lang, teaches, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS word FROM d),
        total AS (SELECT lang, sum(len(ws)) AS total FROM w WHERE teaches GROUP BY lang HAVING total >= {rules.REFERENCE_WORDS}),
        cr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS share
               FROM (SELECT lang, bin, sum(cs[bin]) AS n FROM w JOIN total USING (lang), range(1, 8) b(bin) WHERE teaches GROUP BY ALL)),
        wr AS (SELECT lang, word, count(*) / any_value(total) AS share FROM l JOIN total USING (lang) WHERE teaches GROUP BY lang, word
               HAVING count(*) * {rules.COMMON} >= any_value(total)),
        qr AS (SELECT total.lang, greatest(0, 1 - coalesce(sum(share), 0)) AS share FROM total LEFT JOIN wr ON wr.lang = total.lang GROUP BY total.lang),
        pair AS (SELECT r, total.lang AS ref, len(ws) AS n, length(text) AS chars, cs FROM w JOIN total
                 ON w.lang = total.lang OR coalesce(w.lang NOT IN (SELECT lang FROM total), TRUE)),
        cp AS (SELECT r, ref, CASE WHEN cs[bin] > 0 THEN cs[bin] / chars ELSE 0.0 END AS p, share AS q
               FROM pair JOIN cr ON cr.lang = ref WHERE chars >= {rules.LEAST_CHARS}),
        hits AS (SELECT pair.r, ref, l.word, any_value(n) AS n, count(*) AS k, any_value(share) AS q
                 FROM pair JOIN l ON l.r = pair.r JOIN wr ON wr.lang = ref AND wr.word = l.word WHERE n >= {rules.LEAST_JUDGED} GROUP BY ALL),
        rest AS (SELECT pair.r, pair.ref, (any_value(pair.n) - coalesce(sum(k), 0)) / any_value(pair.n) AS p, any_value(qr.share) AS q, coalesce(sum(q), 0) AS seen
                 FROM pair JOIN qr ON qr.lang = ref LEFT JOIN hits ON hits.r = pair.r AND hits.ref = pair.ref WHERE pair.n >= {rules.LEAST_JUDGED} GROUP BY ALL),
        wp AS (SELECT r, ref, k / n AS p, q FROM hits UNION ALL SELECT r, ref, p, q FROM rest
               UNION ALL SELECT r, rest.ref, 0.0, 1 - rest.q - seen FROM rest),
        far AS (SELECT 'c' AS kind, * FROM cp UNION ALL SELECT 'w', * FROM wp),
        js AS (SELECT r, ref, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist
               FROM far GROUP BY ALL),
        good AS (SELECT pair.r, bool_or(coalesce(c.dist, 0) <= {rules.CHAR_DISTANCE} AND coalesce(j.dist, 0) <= {rules.WORD_DISTANCE}) AS near
                 FROM pair LEFT JOIN js c ON c.r = pair.r AND c.ref = pair.ref AND c.kind = 'c' LEFT JOIN js j ON j.r = pair.r AND j.ref = pair.ref AND j.kind = 'w'
                 GROUP BY pair.r),
        win AS (SELECT r, i, md5(array_to_string(ws[i:i+{rules.WINDOW - 1}], ' ')) AS g
                FROM (SELECT r, ws, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {rules.WINDOW})),
        rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + {rules.WINDOW})) AS pos
                FROM win JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) USING (r, g)) GROUP BY r),
        base AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(rep.n, 0) AS n_repeat_words
                 FROM w LEFT JOIN rep ON rep.r = w.r)
        SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
               n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed,
               NOT (n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words) AND coalesce(near, TRUE) AS kept
        FROM base LEFT JOIN good ON good.r = base.r"""


def _repair_sql() -> str:
    """The same edits turn by turn: s0 to s3 have the least (cost, audit) after nothing, a system, a user and an assistant turn."""
    add = lambda s, cost, edit: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}} END"
    states = ["s0", "s1", "s2", "s3"]
    to = {1: ["s0"], 2: ["s0", "s1", "s3"], 3: ["s2"]}
    own = {1: "s", 2: "u", 3: "a"}
    turn = []
    for q in range(4):
        ways = [add(states[q], 4, "D")]
        for s in to.get(q, []):
            ways.append(f"CASE WHEN NOT gone AND c = '{own[q]}' THEN {add(s, 'extra', 'K')} END")
            if q > 1:
                ways.append(f"CASE WHEN NOT gone THEN {add(s, '3 + extra', 'R')} END")
        turn.append(f"least({', '.join(ways)}) AS t{q}" if len(ways) > 1 else f"{ways[0]} AS t{q}")
    return rf"""
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS k FROM conversations),
        h AS (SELECT src.*, xor(list_reduce(list_concat([4294967295], k), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM src, tab),
        d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                     CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
        o AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                     NOT regexp_matches(text, '{_WORD}') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM d),
        f AS (SELECT *, blank OR seen AS gone, CASE WHEN cut AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS extra,
                     lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS step FROM o),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        m AS (SELECT ids.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
                     count(*) FILTER (WHERE seen AND NOT blank) AS duplicate, count(*) FILTER (WHERE extra > 0) AS truncated,
                     count(*) FILTER (WHERE i > 1 AND step NOT IN ('su', 'ua', 'au')) AS illegal
              FROM ids LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
        p AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, CASE WHEN FALSE THEN {{'c': 0::BIGINT, 'a': ''}} END AS s1,
                     {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3 FROM m
              UNION ALL
              SELECT conv_id, i, t0, t1, t2, least(t3, {add("t2", 3, "I")})
              FROM (SELECT conv_id, i, t0, t1, t3, least(t2, {add("t0", 3, "I")}, {add("t1", 3, "I")}, {add("t3", 3, "I")}) AS t2
                    FROM (SELECT p.conv_id, f.i, {", ".join(turn)} FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))),
        b AS (SELECT m.*, least(s0, s3) AS best FROM p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.i),
        e AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS pos FROM b),
        x AS (SELECT *, audit[pos] AS edit, length(replace(audit[1:pos], 'I', '')) AS i, length(replace(audit[1:pos], 'D', '')) AS place FROM e),
        y AS (SELECT x.conv_id, x.place, x.edit, f.role, CASE WHEN x.edit = 'I' THEN '' ELSE f.text END AS text,
                     max(CASE WHEN x.place = 1 AND x.edit = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS head
              FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE x.edit <> 'D'),
        z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS lines
              FROM y GROUP BY conv_id)
        SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM b LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id"""


SQL = {
    "op1_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS sh FROM w),
        cls AS (SELECT sh, min(doc_id) AS class_id, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
        e AS (SELECT class_id, n, unnest(sh) AS g FROM cls),
        pairs AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
                  FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * same >= 90 * (na + nb - same)),
        reach(x, y) AS (SELECT class_id, class_id FROM cls UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
        comp AS (SELECT x AS class_id, min(y) AS component_id FROM reach GROUP BY x)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
               CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE comp.component_id END AS component_id,
               CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE cls.class_id END AS class_id
        FROM s LEFT JOIN cls ON list_sort(s.sh) = cls.sh LEFT JOIN comp ON comp.class_id = cls.class_id""",
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
        g2 AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM g),
        o AS (SELECT h, min(doc_id) AS first FROM g2 GROUP BY h),
        c AS (SELECT DISTINCT g2.doc_id, unnest(range(g2.i, g2.i + 50)) AS p FROM g2 JOIN o ON g2.h = o.h AND o.first < g2.doc_id),
        d AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN ps IS NULL THEN ws
                   ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN d ON w.doc_id = d.doc_id""",
    "op9_chat_preference": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
        l AS (SELECT conv_id, max(i) AS final FROM n WHERE role = 'assistant' GROUP BY conv_id),
        r AS (SELECT l.conv_id, final, max(text) FILTER (WHERE i = final) AS good,
                     coalesce(max_by(text, i) FILTER (WHERE i < final AND role = 'assistant'), '') AS bad
              FROM l JOIN n ON l.conv_id = n.conv_id GROUP BY ALL),
        p AS (SELECT *, CAST(CASE WHEN good = bad THEN final ELSE final - 1 END AS INTEGER) AS prompt_turns FROM r)
        SELECT p.conv_id AS pair_id, prompt_turns,
               coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY i) FILTER (WHERE i <= prompt_turns), '') AS prompt,
               CASE WHEN good = bad THEN '' ELSE '<|assistant|>' || chr(10) || good || chr(10) END AS chosen,
               CASE WHEN good = bad THEN '' ELSE '14-' || (14 + length(good)) END AS chosen_mask,
               CASE WHEN good = bad THEN '' ELSE '<|assistant|>' || chr(10) || bad || chr(10) END AS rejected,
               CASE WHEN good = bad THEN '' ELSE '14-' || (14 + length(bad)) END AS rejected_mask
        FROM p JOIN n ON p.conv_id = n.conv_id GROUP BY p.conv_id, prompt_turns, good, bad""",
    "op12_quality_rules": _quality_sql(),
    "op13_conversation_repair": _repair_sql(),
}
