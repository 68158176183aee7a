"""DuckDB SQL for the operators that SQL can express, over the given tables."""

from __future__ import annotations

# crc32 (unsigned) of the UTF-8 bytes of a string: a table of 256 by the polynomial's rule, then a step a byte.
_CRC = """
crc_steps AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                                       ORDER BY i) AS step FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    """crc32 of a string column; needs ``_CRC`` in the WITH clause and crc_steps in FROM."""
    # Two hexadecimal digits a byte: their values stand in '0123456789ABCDEF'.
    byte = f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + 2, 1)) - 1"
    bytes_ = f"list_transform(range(strlen({text})), lambda k: ({byte})::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(source: str) -> str:
    """One row per run of one to three words of the rows of ``source`` (no, words)."""
    parts = [f"SELECT no, array_to_string(list_slice(words, i, i + {n - 1}), ' ') AS f FROM {source}, LATERAL (SELECT unnest(range(1, len(words) - {n - 2})) AS i)"
             for n in (1, 2, 3)]
    return " UNION ALL ".join(parts)


OP11 = f"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
b AS (SELECT row_number() OVER () AS no, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM benchmark),
df AS MATERIALIZED ({_runs('d')}),
bf AS MATERIALIZED ({_runs('b')}),
hashed AS MATERIALIZED (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_steps),
s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s, (SELECT count(*) FROM bf)::DOUBLE AS t),
gain AS (SELECT g.i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (total.s + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (total.t + 10000))))::BIGINT AS gain
         FROM range(10000) g(i) CROSS JOIN total LEFT JOIN s ON s.bucket = g.i LEFT JOIN t ON t.bucket = g.i),
w AS (SELECT no, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY no),
h AS (SELECT no, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM d LEFT JOIN w USING (no)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM h),
ranked AS (SELECT no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (no)
"""


def _merkle(levels: int = 9, top_levels: int = 3) -> str:
    """Op 12: ``levels`` of eight children hold 8 ** levels documents a language, ``top_levels`` 8 ** top_levels languages."""
    part = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    changed = "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", low)) + ")"
    ctes = [_CRC, f"""
rows_ AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf} AS leaf, {changed} AS changed,
                              {_crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 AS altered FROM documents, crc_steps),
l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM rows_)"""]

    def climb(name: str, keep: str, count: int) -> str:
        """A level is (g, idx, n, h); a side table holds the joined digests before and after each node in its run."""
        for k in range(count):
            ctes.append(f"""
{name}s{k} AS MATERIALIZED (SELECT g, idx, n, h, coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {name}{k} WHERE n > 1),
{name}{k + 1} AS MATERIALIZED (SELECT g, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, idx // 8)""")
        done = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(count + 1))
        ctes.append(f"\n{name}done AS MATERIALIZED ({done})")
        return f"{name}done"

    climb("l", "", levels)
    ctes.append("\nt0 AS MATERIALIZED (SELECT '' AS g, g AS member, row_number() OVER (ORDER BY g) - 1 AS idx, h, count(*) OVER () AS n FROM ldone)")
    climb("t", "", top_levels)
    # The siblings on the way up of a leaf: its own languages' levels, then those above.
    up = "".join(f" LEFT JOIN ls{k} ON ls{k}.g = l0.g AND ls{k}.idx = l0.idx // {8 ** k}" for k in range(levels))
    up += " JOIN ldone ON ldone.g = l0.g JOIN t0 ON t0.member = l0.g JOIN tdone ON true"
    up += "".join(f" LEFT JOIN ts{k} ON ts{k}.idx = t0.idx // {8 ** k}" for k in range(top_levels))
    steps = [f"ls{k}" for k in range(levels)] + [f"ts{k}" for k in range(top_levels)]
    proof = " || ".join(f"coalesce({s}.lo || {s}.hi, '')" for s in steps)
    pairs = ", ".join(f"[{s}.lo, {s}.hi]" for s in steps)
    return f"""
WITH {','.join(ctes)},
found AS (SELECT doc_id, leaf, CASE WHEN altered THEN changed ELSE leaf END AS start, ldone.h AS subroot, tdone.h AS root, sha256({proof}) AS proof_sha256,
                 list_filter([{pairs}], lambda s: s[1] IS NOT NULL) AS way FROM l0{up}),
folded AS (SELECT *, list_reduce(list_concat([['', start]], way), lambda a, s: ['', sha256(s[1] || a[2] || s[2])])[2] AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


OP13 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item, least(len(words), 10) AS width, list_slice(words, i, i + least(len(words), 10) - 1) AS w
             FROM b, LATERAL (SELECT unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i) WHERE len(words) > 0),
places AS (SELECT no, i, width, list_slice(words, i, i + width - 1) AS w
           FROM d, (SELECT DISTINCT width FROM windows), LATERAL (SELECT unnest(range(1, len(words) - width + 2)) AS i)),
found AS MATERIALIZED (SELECT no, i, width, item FROM places JOIN windows USING (width, w)),
hits AS (SELECT no, count(DISTINCT p) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + width)) AS p) GROUP BY no),
items AS (SELECT no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY no)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (no) LEFT JOIN items USING (no)
"""

OP12 = _merkle()


# Every shingle is spelt out and every pair that shares one is counted, so this is for small tables.
OP5 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + least(len(words), 5) - 1), ' ') AS s, len(words) < 5 AS short
  FROM d, LATERAL (SELECT unnest(range(1, len(words) - least(len(words), 5) + 2)) AS i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.root < e.b),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
