"""The registered queries of this subpackage: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, decontaminate, html_text, minhash, pii, substring_dedup, token_fst, toxicity
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"), k=13).drop("removed")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fst.counts(table(spark, sf_dir, "documents"), token_fst.load(public_tokenizers.path("piece_bpe_32k.model")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select -1L conv_id, t turn, r role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_toxicity, op3_minhash_dedup, op4_additive_ann, op5_byte_bpe, op6_decontamination, op7_substring_dedup, op8_html_text, op9_token_counts, op10_chat_format)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TERMS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '\p{{L}}'))"

#: The patterns as the base definition has them, and the whole method: entities, contexts, counts, disclosure, spans of terms.
_OP1 = rf"""
WITH m AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(kind, ord, pat) AS (VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), ('card', 3, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]')),
g AS (SELECT doc_id, kind, ord, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS gs FROM m, k),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS n FROM g WHERE len(ms) > 0),
p AS (SELECT doc_id, kind, ord, ms[n] AS x, CAST(list_sum(list_transform(gs[1:n], lambda a: length(a))) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda a: length(a))), 0) AS BIGINT) AS s, gs[n] AS l, gs[n + 1] AS r, regexp_replace(ms[n], '[^0-9]', '', 'g') AS d FROM i),
b AS (SELECT doc_id, kind, ord, s, s + length(x) AS e, kind || ':' || CASE kind WHEN 'email' THEN lower(x) WHEN 'ip' THEN x ELSE d END AS entity,
    lower(CASE WHEN length(l) > {pii.REACH} THEN regexp_replace(right(l, {pii.REACH}), '^[\p{{L}}\p{{N}}]+', '') ELSE l END || ' ' || CASE WHEN length(r) > {pii.REACH} THEN regexp_replace(left(r, {pii.REACH}), '[\p{{L}}\p{{N}}]+$', '') ELSE r END) AS around
    FROM p WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
        WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda a: length(ltrim(a, '0')) > 3 OR coalesce(try_cast(right(a, 3) AS INTEGER), 0) > 255)) = 0
        ELSE length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(d[-j] AS INTEGER) ELSE ([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[CAST(d[-j] AS INTEGER) + 1] END)) % 10 = 0 END),
c AS (SELECT entity, around, unnest({_TERMS.format('around')}) AS term FROM b),
ct AS (SELECT entity, term, count(*)::DOUBLE AS n_ct, count(DISTINCT around) AS contexts FROM c GROUP BY ALL),
nc AS (SELECT entity, sum(n_ct) AS n_c FROM ct GROUP BY entity),
w AS (SELECT term, count(*)::DOUBLE AS n_t FROM (SELECT unnest({_TERMS.format('t')}) AS term FROM m) GROUP BY term),
q AS (SELECT term, max(CASE WHEN -log2(n_c / total) > 0 THEN 1 + log2(least(n_ct / n_t, 1)) / -log2(n_c / total) ELSE 0 END) AS disclosure FROM ct JOIN nc USING (entity) JOIN w USING (term), (SELECT sum(n_t) AS total FROM w) WHERE contexts >= {pii.MIN_CONTEXTS} GROUP BY term),
h AS (SELECT term, CASE WHEN disclosure >= {pii.REMOVE} THEN 'removed' ELSE 'term' END AS kind FROM q WHERE disclosure >= {pii.GENERALISE}),
tg AS (SELECT doc_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS ms, string_split_regex(t, '[\p{{L}}\p{{N}}]+') AS gs FROM m WHERE EXISTS (SELECT 1 FROM h WHERE contains(lower(t), term))),
ti AS (SELECT *, unnest(range(1, len(ms) + 1)) AS n FROM tg),
ts AS (SELECT doc_id, h.kind, CAST(list_sum(list_transform(gs[1:n], lambda a: length(a))) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda a: length(a))), 0) AS BIGINT) AS s, length(ms[n]) AS z FROM ti JOIN h ON h.term = lower(ms[n])),
ad AS (SELECT * FROM ts WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = ts.doc_id AND b.s < ts.s + z AND b.e > ts.s)),
x AS (SELECT doc_id, kind || ':' || s || ':' || e AS span, ord, kind, s FROM b UNION ALL SELECT doc_id, kind || ':' || s || ':' || (s + z), CASE kind WHEN 'removed' THEN 5 ELSE 6 END, kind, s FROM ad),
y AS (SELECT doc_id, string_agg(span, ',' ORDER BY ord, s) AS spans, coalesce(string_agg(span, ',' ORDER BY ord, s) FILTER (ord < 5), '') AS base, {', '.join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in pii.KINDS)}, count(*) FILTER (ord > 4) AS n_terms FROM x GROUP BY doc_id)
SELECT m.doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms FROM m LEFT JOIN y ON m.doc_id = y.doc_id
"""

_OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
links AS (SELECT i.doc_id AS a, j.doc_id AS b FROM x i JOIN x j ON i.h = j.h AND i.doc_id <> j.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(i.n) + any_value(j.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT b, root FROM reach JOIN links ON node = a),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
"""

_OP4 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM w),
k AS (SELECT doc_id, pos, ws[pos:pos + 12] AS key FROM p),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS gone FROM k JOIN f USING (key) WHERE first < doc_id),
g AS (SELECT doc_id, list(gone) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

_OP10 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\[\]<\\]', '', 'g')) AS n,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 13 ELSE 16 + length(role) + length(regexp_replace(role, '[^\[\]<\\]', '', 'g')) END AS marks FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, 3 + sum(n + marks) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it: the others are tested against brute force, libraries, round trips or held-out rows in tests/llm."""
    return {"op1_pii": _OP1, "op3_minhash_dedup": _OP3, "op4_additive_ann": _OP4, "op7_substring_dedup": _OP7, "op10_chat_format": _OP10}
