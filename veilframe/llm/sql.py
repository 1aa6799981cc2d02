"""DuckDB statements of the queries whose results SQL can express."""

from . import weak_rules as rules

OP1 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP5 = """
WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
d AS (SELECT a.vec_id AS query_id, b.vec_id,
             sqrt(list_sum([(a.e[i] - b.e[i]) * (a.e[i] - b.e[i]) for i in range(1, len(a.e) + 1)])) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+') if x <> ''] AS words FROM documents),
n AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                          ELSE list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM n),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.j FROM reached r JOIN links l ON r.other = l.i)
SELECT n.doc_id, len(any_value(shingles)) AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept
FROM n JOIN reached USING (doc_id) GROUP BY n.doc_id
"""


def _weak_rules() -> str:
    """Counts by unnested windows, and the estimate as a recursive table with a row for each round."""
    kinds, m = range(rules.KINDS + 1), len(rules.RULES)
    start = [rules.ON_GOOD] * m + [rules.ON_KIND if r.kind == k else rules.ON_OTHER for k in range(rules.KINDS) for r in rules.RULES]
    log = lambda k: f"ln(shares[{k + 1}])" + "".join(
        f" + CASE v{j} WHEN 0 THEN ln(bad[{k * m + j + 1}]) WHEN 1 THEN ln(1 - bad[{k * m + j + 1}]) ELSE 0 END" for j in range(m))

    def learnt(k: int, j: int) -> str:
        low, high = (rules.CERTAIN, rules.MOST_ON_GOOD) if k == 0 else (
            rules.LEAST_ON_KIND if rules.RULES[j].kind == k - 1 else rules.CERTAIN, 1 - rules.CERTAIN)
        prior = f"{rules.PRIOR_WEIGHT} * sum(n)"
        return (f"least({high}, greatest({low}, (coalesce(sum(p{k}) FILTER (v{j} = 0), 0) + {prior} * {start[k * m + j]}) / "
                f"(coalesce(sum(p{k}) FILTER (v{j} IS NOT NULL), 0) + {prior})))")

    shares = ", ".join(f"(sum(p{k}) + {rules.PRIOR_WEIGHT} * sum(n) * {rules.SHARES[k]}) / (sum(n) * (1 + {rules.PRIOR_WEIGHT}))" for k in kinds)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END AS v{j}" for j, r in enumerate(rules.RULES))
    names = ", ".join(f"v{j}" for j in range(m))
    logs = ", ".join(f"{log(k)} AS l{k}" for k in kinds)
    each = ", ".join(f"n / ({' + '.join(f'exp(l{o} - l{k})' for o in kinds)}) AS p{k}" for k in kinds)
    return rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] AS words,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
g AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, unnest([words[i:i + 4] for i in range(1, len(words) - 3)]) AS gram FROM w),
twice AS (SELECT r, unnest(range(i, i + 5)) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT place) AS n FROM twice GROUP BY r),
c AS (SELECT r, doc_id, len(words) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_replace(text, '[^{rules.SYMBOLS}]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_replace(text, '[^{rules.UPPER}]+', '', 'g')) AS n_upper,
             len(list_distinct(words)) AS n_distinct, len([i for i in range(2, len(words) + 1) if words[i] = words[i - 1]]) AS n_stutter,
             len(regexp_replace(text, '[^{rules.STOPS}]+', '', 'g')) AS n_stops,
             len(regexp_extract_all(text, '{rules.MARKS}')) AS n_marks FROM w LEFT JOIN repeated USING (r)),
v AS (SELECT *, {votes} FROM c),
table_of_votes AS (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),
em AS (SELECT 0 AS round, {[float(x) for x in rules.SHARES]}::DOUBLE[] AS shares, {start}::DOUBLE[] AS bad
       UNION ALL
       SELECT round + 1, [{shares}], [{', '.join(learnt(k, j) for k in kinds for j in range(m))}]
       FROM (SELECT *, {each} FROM (SELECT *, {logs} FROM em, table_of_votes WHERE round < {rules.ROUNDS})) GROUP BY round)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({rules.BASE_FAILED}) AS base_failed,
       NOT ({rules.BASE_FAILED}) AND 1 / (1 + exp(l1 - l0) + exp(l2 - l0)) >= 0.5 AS kept
FROM (SELECT *, {logs} FROM v, em WHERE round = {rules.ROUNDS})
"""


OP12 = _weak_rules()

OP13 = r"""
WITH t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                  len([x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']) AS words
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(digest ORDER BY turn NULLS FIRST, digest) AS d, list(words ORDER BY turn NULLS FIRST, digest) AS w FROM t GROUP BY c),
h AS (SELECT *, (xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(c::VARCHAR, '')],
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
        4294967295) % 4)::BIGINT AS h FROM own),
r AS (SELECT a.c, coalesce(b.d[1:a.h], []) || a.d[a.h + 1:] AS d, coalesce(b.w[1:a.h], []) || a.w[a.h + 1:] AS w
      FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 20),
p AS (SELECT c, len(d) AS length, unnest(range(0, len(d) + 1)) AS depth, unnest([d[1:i] for i in range(0, len(d) + 1)]) AS path,
             unnest([coalesce(w[i], 0) for i in range(0, len(d) + 1)]) AS words FROM r),
n AS (SELECT path, min(depth) AS depth, min(c) AS c, count(*) AS n, min(words) AS words,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = depth), '')) AS ends FROM p GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT unnest([n.path[1:i] for i in range(0, n.depth + 1)]) AS path, (n.n - 1) * n.words AS saved, (k.path IS NULL)::BIGINT AS leaf
      FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT path, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM a GROUP BY path)
SELECT n.c AS conv_id, n.depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0) AS n_children, s.leaves AS n_leaves,
       s.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]
"""
