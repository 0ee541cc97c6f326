"""Registered queries of the training-data operators, and their DuckDB SQL.

Every query applies its operator with production parameters to the whole of its
table. ``ORACLES`` holds SQL where SQL can express the result; the other queries
are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from . import (chat, filteraudit, htmltext, langid, merkle, mixing, quality, rules, simhash, spiece, tokens, topk,
               warc)
from .common import F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register(fn) if fn else register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark, sf_dir):
    """SimHash classes of all documents: 4-word shingles, at most 4 differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op2_tokens(spark, sf_dir):
    """All texts as token ids in shards, read back: place, length and checksum."""
    return tokens.tokenize_documents(table(spark, sf_dir, "documents"), end_id=2)


_OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat('7|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
src AS (SELECT no_source, src, CAST(sum(size) AS BIGINT) AS s,
               1 + (row_number() OVER (ORDER BY no_source, src) - 1) % 3 AS w
        FROM sized GROUP BY no_source, src),
tot AS (SELECT CAST(sum(s) AS BIGINT) AS t, CAST(sum(w) AS BIGINT) AS tw FROM src),
ordered AS (SELECT *, row_number() OVER (ORDER BY 3 * s / w, no_source, src) AS k,
                   coalesce(sum(3 * s) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
            FROM src WINDOW o AS (ORDER BY 3 * s / w, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(t - cap_before AS DOUBLE) / CAST(tw - w_before AS DOUBLE) AS level FROM ordered, tot),
lvl AS (SELECT coalesce(min_by(level, k), 0) AS level FROM levels WHERE level * w <= 3 * s),
aim AS (SELECT no_source, src, s, least(CAST(3 * s AS DOUBLE), lvl.level * w) AS target FROM src, lvl),
parts AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole FROM aim),
goal AS (SELECT *, greatest(0, least(s, CAST(floor(target + 0.5) AS BIGINT) - whole * s)) AS rest FROM parts),
hashes AS (SELECT no_source, src, h, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
upto AS (SELECT *, CAST(sum(words) OVER (PARTITION BY no_source, src ORDER BY h) AS BIGINT) AS upto FROM hashes)
SELECT z.doc_id, CAST(z.size AS BIGINT) AS size, g.s AS source_size, g.target,
       CAST(g.whole * z.size + CASE WHEN u.upto <= g.rest THEN z.size WHEN u.upto - u.words >= g.rest THEN 0
         ELSE z.size * (g.rest - u.upto + u.words) // u.words END AS BIGINT) AS taken
FROM sized z JOIN goal g USING (no_source, src) JOIN upto u USING (no_source, src, h)
"""


@query(sql=_OP3_SQL)
def op3_mixing(spark, sf_dir):
    """Words taken of every document: weights 1, 2, 3 repeating, at most 3 epochs."""
    return mixing.mix(table(spark, sf_dir, "documents"), epochs=3, weights=(1, 2, 3), seed=7)


@query
def op4_language(spark, sf_dir):
    """Language of every document, by the dictionary that compresses it best."""
    return langid.identify_documents(table(spark, sf_dir, "documents"))


@query
def op5_sentencepiece(spark, sf_dir):
    """Every text encoded and decoded again with the 32k SentencePiece model."""
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", spiece.round_trip(F.col("text"), spiece.default_model()).alias("r"))
    return got.select("doc_id", "r.n_tokens", "r.ids_crc32", "r.n_chars", F.col("r.same").alias("round_trip"))


_OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
wd AS (SELECT r, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM d),
win AS (SELECT r, p, w, lag(w) OVER o AS w0, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM wd
        WINDOW o AS (PARTITION BY r ORDER BY p)),
same AS (SELECT r, count(*) AS n_same FROM win WHERE w = w0 GROUP BY r),
keyed AS (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM win WHERE w3 IS NOT NULL),
hit AS (SELECT r, count(DISTINCT p + k) AS n_repeat FROM keyed, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
        length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
        length(text) - length(replace(text, '!', '')) AS n_bangs,
        coalesce(n_same, 0) AS n_same
      FROM d LEFT JOIN hit USING (r) LEFT JOIN same USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
       OR word_chars > 15 * n_words OR (n_upper > n_lower AND n_upper > 20) OR 5 * n_bangs > n_words
       OR 5 * n_same > n_words) AS kept
FROM b
"""


@query(sql=_OP6_SQL)
def op6_rules(spark, sf_dir):
    """The rule ledger of all documents under the production policy."""
    led = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), rules.PRODUCTION)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~rules.passes(rules.BASE)).alias("base_failed"), "kept")


_OP7_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query(sql=_OP7_SQL)
def op7_top_k(spark, sf_dir):
    """The 10 largest integer inner products of every 100th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query
def op8_main_text(spark, sf_dir):
    """Main text of every page."""
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query
def op9_quality(spark, sf_dir):
    """Quality score of every document, learnt from the labels outside the held-out part."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


_OP10_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id != page_id THEN first_id END AS refers_to FROM g
"""


@query(sql=_OP10_SQL)
def op10_warc(spark, sf_dir):
    """All pages as WARC records in seekable bundles, read back."""
    got = warc.archive_pages(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t
           FROM conversations
           UNION ALL SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]', x.role, '</s>[INST] ok [/INST]'
           FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST,
                                   sha256(t) NULLS FIRST) AS pos FROM c),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|AS\])', '\1\2\\\3', 'g')) AS body,
             length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|AS\])', '\1\2\\\3', 'g')) AS head
      FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 9
                       ELSE 21 + head END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(sql=_OP11_SQL)
def op11_chat(spark, sf_dir):
    """All conversations, and conversation -1 whose texts hold control strings,
    formatted as reply trees of one branch and read back."""
    said = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                     "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionByName(said))


_OP12_SQL = r"""
WITH RECURSIVE
f AS (SELECT doc_id, source, text,
        coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
        || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
        || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
        replace(text, chr(10), '') AS cut,
        -- lowest bit of the crc32 of the id as text, bit by bit
        xor(list_reduce(list_concat([4294967295::BIGINT],
              list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: ord(ch)::BIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT for i in range(8)]),
                                     lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) & 1 AS odd
      FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, source,
        sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(octet_length(encode(CASE WHEN odd = 0 THEN cut ELSE text END)) || ':'
               || CASE WHEN odd = 0 THEN cut ELSE text END, '-')) AS changed FROM f),
g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS gid, count(*) AS n FROM d GROUP BY source),
placed AS (SELECT r, doc_id, leaf, changed, gid, n,
             row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
           FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
tree AS (SELECT 0 AS lev, gid, idx, leaf AS digest, n FROM placed
         UNION ALL
         SELECT lev + 1, gid, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
         FROM tree WHERE n > 1 GROUP BY lev, gid, idx // 3, n),
sub AS (SELECT gid, digest AS subroot, lev AS height FROM tree WHERE n = 1),
top AS (SELECT 0 AS lev, gid AS idx, subroot AS digest, (SELECT count(*) FROM sub) AS n FROM sub
        UNION ALL
        SELECT lev + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
        FROM top WHERE n > 1 GROUP BY lev, idx // 3, n),
lower AS (SELECT p.r, t.lev, t.digest, t.idx, p.idx // CAST(3 ** t.lev AS BIGINT) AS own
          FROM placed p JOIN tree t ON t.gid = p.gid AND t.n > 1
           AND t.idx // 3 = p.idx // CAST(3 ** (t.lev + 1) AS BIGINT)),
upper AS (SELECT p.r, s.height + t.lev AS lev, t.digest, t.idx, p.gid // CAST(3 ** t.lev AS BIGINT) AS own
          FROM placed p JOIN sub s USING (gid) JOIN top t ON t.n > 1
           AND t.idx // 3 = p.gid // CAST(3 ** (t.lev + 1) AS BIGINT)),
steps AS (SELECT r, lev, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx < own), '') AS b,
                 coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx > own), '') AS a
          FROM (SELECT * FROM lower UNION ALL SELECT * FROM upper) GROUP BY r, lev),
paths AS (SELECT r, list({'b': b, 'a': a} ORDER BY lev) AS path, string_agg(b || a, '' ORDER BY lev) AS proof
          FROM steps GROUP BY r),
done AS (SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256,
           list_reduce(list_concat([{'b': '', 'a': p.changed}], coalesce(path, [])),
                       lambda x, y: {'b': '', 'a': sha256(y.b || x.a || y.a)}).a AS folded_root
         FROM placed p JOIN sub s USING (gid) JOIN (SELECT digest FROM top WHERE n = 1) t ON true LEFT JOIN paths USING (r))
SELECT *, folded_root = root AS verified FROM done
"""


@query(sql=_OP12_SQL)
def op12_merkle(spark, sf_dir):
    """Merkle manifest of all documents: proofs, and roots folded after tampering."""
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text)
               THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
walk AS (SELECT '' AS filter_order, 0 AS applied
         UNION ALL SELECT filter_order || letter, applied | bit FROM walk JOIN letters ON applied & bit = 0),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS letter,
                 CAST(1 << (ord(filter_order[k]) - 65) AS INTEGER) AS bit,
                 CAST(list_sum([0] || [1 << (ord(filter_order[j]) - 65) for j in range(1, k)]) AS INTEGER) AS before
          FROM (SELECT filter_order, unnest(range(1, 6)) AS k FROM walk WHERE length(filter_order) = 5)),
r AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit != 0 AND mask & before != 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit != 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


@query(sql=_OP13_SQL)
def op13_filter_audit(spark, sf_dir):
    """Counts of five filters in all 120 orders, per source."""
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
