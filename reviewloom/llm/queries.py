"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm import (ball_tree, content_sort, divergence, language, log_bilinear, mixing, packing, page_diff,
                            personal, repeats, sharding, simhash, vector_codes)
from reviewloom.sources.tables import table


#: The vocabulary file that token counts and packing use.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return content_sort.mark_copies(docs).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return log_bilinear.score(table(spark, folder, "documents"))


def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.document_languages(table(spark, folder, "documents"))


def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.page_languages(table(spark, folder, "pages"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"), width=50).drop("kept_text")


#: Weights of the mixture; names that are not listed weigh one.
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.select_prefixes(table(spark, folder, "documents"), WEIGHTS).drop("digest")


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_diff.main_texts(table(spark, folder, "pages"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), width=3, radius=2)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.report(table(spark, folder, "embeddings"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"), least_docs=30, top=50)


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal.report(table(spark, folder, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_language_id": op5_language_id,
    "page_languages": page_languages,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": op9_sharding,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_divergence": op12_source_divergence,
    "op13_pii": op13_pii,
}

#: Kinds of personal data that a pattern finds and a rule on the match (m) decides.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "len(list_filter(string_split(m, '.'), lambda x: NOT regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])'))) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+",
             "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: "
             "CASE WHEN i % 2 = 1 THEN d[-i]::INTEGER ELSE d[-i]::INTEGER * 2 // 10 + d[-i]::INTEGER * 2 % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
}
_MATCHES = " UNION ALL ".join(
    f"SELECT place, {order} AS kind_order, '{kind}' AS kind, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, ms, gaps "
    f"FROM (SELECT place, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM t)"
    for order, (kind, (pattern, _)) in enumerate(_KINDS.items()))
_RULE = " ".join(f"WHEN '{kind}' THEN {rule}" for kind, (_, rule) in _KINDS.items())

#: One round of the codebooks: every part's entry (b), then the means (c).
_ROUND = """
        b{n} AS MATERIALIZED (SELECT p.id, p.part, p.e, min((p.size + c.size - 2 * list_inner_product(p.e, c.e))::BIGINT * 256 + c.entry) AS best
               FROM p JOIN c{n} c USING (part) GROUP BY p.id, p.part, p.e),"""
_MEANS = """
        u{m} AS (SELECT part, best % 256 AS entry, unnest(e)::BIGINT AS x, unnest(range(1, len(e) + 1)) AS i FROM b{n}),
        m{m} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM u{m} GROUP BY part, entry, i),
        l{m} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM m{m} GROUP BY part, entry),
        c{m} AS MATERIALIZED (SELECT part, entry, coalesce(l{m}.e, c{n}.e) AS e,
               list_inner_product(coalesce(l{m}.e, c{n}.e), coalesce(l{m}.e, c{n}.e)) AS size FROM c{n} LEFT JOIN l{m} USING (part, entry)),"""

SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(c) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY c ORDER BY length(t) DESC, doc_id)""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
              FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id,
                     score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS place, unnest(list_transform(range(1, len(words) - 48),
                  lambda i: md5(array_to_string(list_slice(words, i, i + 49), ' ')))) AS passage
              FROM d WHERE len(words) >= 50),
        seen AS (SELECT passage, min(doc_id) AS least FROM w GROUP BY passage),
        gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS place
                 FROM w JOIN seen USING (passage) WHERE least < doc_id),
        placed AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
                 FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # the main text of the generated pages is what their article element holds
    "op8_html_extraction": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS inside FROM pages),
        b AS (SELECT page_id, url, list_transform(regexp_split_to_array(inside, '</?(p|h1)>'),
                  lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
                      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
        t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    # CRC-32 bit by bit; shards by the middle of each document among all bytes
    "op9_sharding": r"""
        WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
                       xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                           lambda x: ('0x' || x)::BIGINT), lambda crc, x: list_reduce(range(8),
                           lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, x)), 4294967295)) AS text_crc32
                   FROM documents),
        s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                     sum(size) OVER () AS total FROM d),
        p AS (SELECT *, ((2 * before + size) * 24 // (2 * total))::INTEGER AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
               NULL::INTEGER AS grown_shard FROM p""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) = '' THEN 'domain'
                            ELSE 'domain' || (regexp_extract(source, '([0-9]{1,9})', 1)::BIGINT % 4)::VARCHAR END AS domain,
                       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY domain, lang, source),
        b0 AS (SELECT least(sum(tokens), sum(tokens * 4))::DOUBLE AS budget FROM leaves),
        n1 AS (SELECT domain, sum(tokens * 4)::DOUBLE AS capacity, CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END::DOUBLE AS weight FROM leaves GROUP BY domain),
        v1 AS (SELECT *, (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
                 FROM n1 CROSS JOIN b0 WINDOW w AS (ORDER BY capacity / weight, domain)),
        b1 AS (SELECT domain, least(capacity, max(level) OVER () * weight) AS budget FROM v1),
        n2 AS (SELECT domain, lang, sum(tokens * 4)::DOUBLE AS capacity, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::DOUBLE AS weight FROM leaves GROUP BY domain, lang),
        v2 AS (SELECT *, (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
                 FROM n2 JOIN b1 USING (domain) WINDOW w AS (PARTITION BY domain ORDER BY capacity / weight, lang)),
        b2 AS (SELECT domain, lang, least(capacity, max(level) OVER (PARTITION BY domain) * weight) AS budget FROM v2),
        n3 AS (SELECT domain, lang, source, sum(tokens * 4)::DOUBLE AS capacity, 1::DOUBLE AS weight FROM leaves GROUP BY domain, lang, source),
        v3 AS (SELECT *, (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
                 FROM n3 JOIN b2 USING (domain, lang) WINDOW w AS (PARTITION BY domain, lang ORDER BY capacity / weight, source)),
        b3 AS (SELECT domain, lang, source, least(capacity, max(level) OVER (PARTITION BY domain, lang) * weight) AS budget FROM v3),
        x AS (SELECT d.*, e.epoch, l.tokens AS leaf_tokens, budget, md5('7:' || e.epoch || ':' || doc_id) AS digest
              FROM d JOIN leaves l USING (domain, lang, source) JOIN b3 USING (domain, lang, source)
              CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS epoch) e WHERE l.tokens > 0),
        s AS (SELECT *, (epoch * leaf_tokens + coalesce(sum(tokens) OVER (
                  PARTITION BY domain, lang, source, epoch ORDER BY digest, doc_id, tokens
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM x)
        SELECT doc_id, domain, lang, source, epoch, start, tokens,
               least(tokens, ceil(budget - start)::BIGINT) AS taken FROM s WHERE start < budget""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        t AS (SELECT place, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT place) >= 30),
        l AS (SELECT lang, sum(n)::BIGINT AS total, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        z AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n,
                     1 + 1000000000 * (coalesce(c.n, 0) + 5) // (z.total + 5 * l.v) AS p,
                     1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) AS q
              FROM z JOIN k USING (lang) JOIN l USING (lang)
              LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50""",
    # the documents hold no schemes and no words for an account, so all spans are of the base kinds
    "op13_pii": f"""
        WITH t AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text FROM documents),
        f AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM ({_MATCHES})),
        s AS (SELECT place, kind, kind_order, length(m) AS size,
                     list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS start
              FROM f WHERE CASE kind {_RULE} END),
        a AS (SELECT place, string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, kind_order) AS spans,
                     {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _KINDS)} FROM s GROUP BY place)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _KINDS)},
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (place)""",
    "op11_vector_codes": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
                       list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT id, part, e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4] AS e FROM v CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS part)),
        p AS MATERIALIZED (SELECT *, list_inner_product(e, e) AS size FROM s),
        c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, e, size FROM p WHERE id <= 256),"""
    + "".join(_ROUND.format(n=n) + (_MEANS.format(n=n, m=n + 1) if n < 4 else "") for n in range(5)) + """
        r AS (SELECT id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
              FROM b4 GROUP BY id),
        h AS (SELECT sha256(string_agg(list_aggregate(list_transform(e, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, entry)) AS books FROM c4)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, books AS codebooks_sha256
        FROM v JOIN r USING (id) CROSS JOIN h""",
}
