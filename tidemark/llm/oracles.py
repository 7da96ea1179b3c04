"""DuckDB SQL for the queries that SQL can express: plain statements of the results, not of the methods."""

from __future__ import annotations

from .quality import HIGH_RULES, LEAST_WORDS, LOW_RULES, MOST_REPEATED_PERCENT, ONCE_IN, PRIOR_ROWS, RULES, SHARE, START, STEPS, STRONG

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _counted(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


def _ratio(what: str) -> str:
    top, _, bottom = what.partition(" / ")
    return f"{top} / nullif({bottom}, 0)" if bottom else top


def _posterior() -> str:
    votes = " + ".join(f"CASE v_{n} WHEN 1 THEN ln(g_{n} / b_{n}) WHEN -1 THEN ln((1 - g_{n}) / (1 - b_{n})) ELSE 0 END" for n in RULES)
    return f"1 / (1 + exp(-(ln(share / (1 - share)) + {votes})))"


def _step(name: str) -> str:
    """Of one rule: the chances of its good vote on a good and on a bad document."""
    good, bad = (f"(coalesce(sum(CASE WHEN v_{name} = 1 THEN n * {p} END), 0) + {first}::DOUBLE * {PRIOR_ROWS}) / (coalesce(sum(CASE WHEN v_{name} <> 0 THEN n * {p} END), 0) + {PRIOR_ROWS})" for p, first in zip(("q", "(1 - q)"), START[name in STRONG], strict=True))
    if name in STRONG:
        good = f"greatest({good}, 1 - 1::DOUBLE / {ONCE_IN})"
    return f"{good} AS g_{name}, least({good}, {bad}) AS b_{name}"


def _quality() -> str:
    bad = [f"CASE WHEN {_ratio(w)} >= {high}::DOUBLE THEN -1 WHEN {_ratio(w)} <= {low}::DOUBLE THEN 1 ELSE 0 END AS v_{n}" for n, (w, low, high) in HIGH_RULES.items()]
    bad += [f"CASE WHEN {_ratio(w)} < {low}::DOUBLE THEN -1 WHEN {_ratio(w)} >= {high}::DOUBLE THEN 1 ELSE 0 END AS v_{n}" for n, (w, high, low) in LOW_RULES.items()]
    steps = [f"e0 AS (SELECT {SHARE}::DOUBLE AS share, " + ", ".join(f"{START[n in STRONG][0]}::DOUBLE AS g_{n}, {START[n in STRONG][1]}::DOUBLE AS b_{n}" for n in RULES) + ")"]
    for k in range(STEPS):
        new = f"(coalesce(sum(n * q), 0) + {SHARE}::DOUBLE * {PRIOR_ROWS}) / (coalesce(sum(n), 0) + {PRIOR_ROWS}) AS share, " + ", ".join(map(_step, RULES))
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT {new} FROM (SELECT patterns.*, {_posterior()} AS q FROM patterns, e{k}))")
    return f"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM w),
g AS (SELECT *, CASE WHEN lead(pos, 2) OVER o IS NOT NULL THEN [word, lead(word) OVER o, lead(word, 2) OVER o] END AS gram FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, pos, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM m),
r AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM c GROUP BY 1),
counts AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, {_counted('[#*$%&|<>]')} AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, {_counted('[A-Z]')} AS n_capitals, {_counted('!')} AS n_shouts
  FROM documents d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
votes AS MATERIALIZED (SELECT *, {', '.join(bad)} FROM counts),
patterns AS MATERIALIZED (SELECT {', '.join('v_' + n for n in RULES)}, count(*) AS n FROM votes GROUP BY ALL),
{', '.join(steps)},
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, {_posterior()} AS q FROM votes, e{STEPS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS quality FROM judged"""


WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS request_uri, 1::BIGINT AS n_requests, 1::BIGINT AS n_metadatas
FROM p"""

#: The reflected polynomial of CRC-32.
CRC_POLYNOMIAL = 0xEDB88320

REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
half AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), {REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def sharding(shards: int) -> str:
    """The search runs as a machine of one row: each step fills one more shard at the capacity tried, or halves the interval."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size FROM documents),
g AS (SELECT t, min(doc_id) AS key, sum(size)::BIGINT AS size FROM d GROUP BY 1),
o AS MATERIALIZED (SELECT t, key, size, sum(size) OVER (ORDER BY key)::BIGINT AS upto FROM g),
k AS MATERIALIZED (SELECT list(upto ORDER BY upto) AS ends, max(size) AS largest, max(upto) AS total FROM o),
s(low, high, place, used) AS (SELECT greatest(largest, -(-total // {shards}))::BIGINT, total::BIGINT, 0::BIGINT, 0 FROM k UNION ALL
  SELECT CASE WHEN used = {shards} AND place < total THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN place = total THEN (low + high) // 2 ELSE high END,
    CASE WHEN place = total OR used = {shards} THEN 0 ELSE list_max(list_filter(ends, lambda x: x <= place + (low + high) // 2)) END, CASE WHEN place = total OR used = {shards} THEN 0 ELSE used + 1 END
  FROM s, k WHERE low < high),
best AS MATERIALIZED (SELECT min(high) AS capacity FROM s),
cut(shard, start, stop) AS (SELECT 0, 0::BIGINT, list_max(list_filter(ends, lambda x: x <= capacity)) FROM k, best UNION ALL
  SELECT shard + 1, stop, list_max(list_filter(ends, lambda x: x <= stop + capacity)) FROM cut, k, best WHERE stop < total),
bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLYNOMIAL}::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
h AS (SELECT t, list_transform(range(0, 2 * strlen(t), 2), lambda i: ('0x' || substr(hex(encode(t)), i + 1, 2))::BIGINT) AS bytes FROM o),
crc AS (SELECT t, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM h, tab),
placed AS (SELECT d.doc_id, d.size, crc.crc, cut.shard, o.key FROM d JOIN o USING (t) JOIN crc USING (t) JOIN cut ON o.upto > cut.start AND o.upto <= cut.stop)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed"""


def near(percent: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [md5(array_to_string(ws, ' '))] ELSE list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i : i + 4], ' '))) END) AS shingle FROM w)),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '' ORDER BY shingle)) AS h FROM s GROUP BY 1),
k AS MATERIALIZED (SELECT h, min(doc_id) AS a, min(n) AS n FROM z GROUP BY 1),
f AS MATERIALIZED (SELECT s.* FROM s JOIN k ON k.a = s.doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM f x JOIN f y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
half AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN k x ON x.a = i.a JOIN k y ON y.a = i.b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), {REACH},
c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(least(k.a, coalesce(c.least, k.a)), d.doc_id) AS component_id, d.doc_id = coalesce(least(k.a, coalesce(c.least, k.a)), d.doc_id) AS kept
FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN k ON k.h = z.h LEFT JOIN c ON c.a = k.a"""


SPANS = f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word, unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i : i + 49], ' ')) END)) AS h FROM w),
m AS (SELECT *, coalesce(min(doc_id) OVER (PARTITION BY h) < doc_id AND h IS NOT NULL, false) AS bad FROM p),
c AS (SELECT doc_id, pos, word, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)"""


def oracles(shards: int, percent: int) -> dict[str, str]:
    return {
        "op1_quality_rules": _quality(),
        "op3_warc": WARC,
        "op5_embedding_dedup": EMBEDDINGS,
        "op6_sharding": sharding(shards),
        "op7_minhash_dedup": near(percent),
        "op10_substring_dedup": SPANS,
    }
