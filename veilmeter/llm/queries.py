"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from veilmeter.llm import ann, audio, bpe, chat, langid, linededup, ngramjoin, packing, phrases, quality, resample, simhash, warc
from veilmeter.llm.common import table

QUERIES = {
    "op1_ann": lambda spark, d: ann.search(table(spark, d, "embeddings")),
    "op2_language_id": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op3_media_audio": lambda spark, d: audio.op3(table(spark, d, "documents")),
    "op4_quality": lambda spark, d: quality.classify(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op6_bpe": lambda spark, d: bpe.round_trip(table(spark, d, "documents")),
    "op7_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op8_chat_format": lambda spark, d: chat.op8(table(spark, d, "conversations")),
    "op9_line_dedup": lambda spark, d: linededup.line_report(table(spark, d, "documents")),
    "op10_warc": lambda spark, d: warc.op10(table(spark, d, "pages")),
    "op11_phrases": lambda spark, d: phrases.mine(table(spark, d, "documents")),
    "op12_ngram_join": lambda spark, d: ngramjoin.components(table(spark, d, "documents")),
    "op13_resample": lambda spark, d: resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, pos, line, list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda x: x <> '')) AS s FROM l),
        gone AS (SELECT DISTINCT y.doc_id, y.pos FROM w x JOIN w y ON (x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.pos < y.pos)) AND len(x.s) > 0
                 AND len(x.s) * 5 >= len(y.s) * 4 AND len(y.s) * 5 >= len(x.s) * 4 AND len(list_intersect(x.s, y.s)) * 9 >= (len(x.s) + len(y.s)) * 4),
        k AS (SELECT w.doc_id, w.pos, w.line, gone.pos IS NULL AS kept FROM w LEFT JOIN gone USING (doc_id, pos)),
        d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '') AS text FROM k GROUP BY doc_id)
        SELECT o.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept, d.text FROM documents o LEFT JOIN d USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM r""",
    "op11_phrases": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m)),
        f AS (SELECT lang, m, w[i : i + m - 1] AS p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        s AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
              FROM c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.m]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        h AS (SELECT lang, p[1 : m - 1] AS p, f FROM f WHERE m > 2 UNION ALL SELECT lang, p[2 : m], f FROM f WHERE m > 2),
        o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.p = b.p AND h.f >= b.a)),
        t AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM o)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op12_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT row, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        e AS (SELECT row, len(s) AS n, unnest(s) AS t FROM s),
        l AS (SELECT x.row AS a, y.row AS b FROM e x JOIN e y ON x.t = y.t AND x.row <> y.row GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
        r AS (SELECT row AS a, row AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT r.a AS row, min(s.doc_id) AS component_id FROM r JOIN s ON s.row = r.b GROUP BY r.a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (row)""",
}
