"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, language_model, lines, merkle, mixing, near_dedup, neighbours, rules, secrets, spans, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_language_model": language_model.op1_language_model,
        "op2_mixing": mixing.op2_mixing,
        "op3_secrets": secrets.op3_secrets,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_quality": rules.op6_quality,
        "op7_spans": spans.op7_spans,
        "op8_warc": warc.op8_warc,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_whitening": whitening.op11_whitening,
        "op12_lines": lines.op12_lines,
        "op13_manifest": merkle.op13_manifest,
    }


#: A-Z alone in lower case.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 1) + 1)) AS i FROM w WHERE len(a) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 3], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS r FROM w UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.d),
m AS (SELECT d, min(r) AS component_id FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN h IS NULL THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY h) END AS class_id, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN m ON w.doc_id = d"""

ARCHIVED = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""

LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents),
t AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM benchmark WHERE item_id IS NOT NULL),
u AS (SELECT item, a, least(10, len(a)) AS n, unnest(range(1, len(a) - least(10, len(a)) + 2)) AS i FROM t WHERE len(a) > 0),
w AS (SELECT DISTINCT item, n, array_to_string(a[i:i + n - 1], ' ') AS s FROM u),
v AS (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(a) >= n),
h AS (SELECT doc_id, i, v.n, item FROM v JOIN w ON v.n = w.n AND array_to_string(a[i:i + v.n - 1], ' ') = s),
g AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(a) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""


def _cleaned() -> str:
    """Line-first cleaning: windows by position, lines by rule, sums by document."""
    word = "[^\\x20\\x09-\\x0D]+"
    n = lambda pattern: f"len(regexp_extract_all(line, '{pattern}'))"
    bare = lambda text: f"regexp_replace({text}, '[\\x20\\x09-\\x0D]', '', 'g')"
    rules = f"""CASE WHEN {n(lines.SEPARATOR)} >= 2 AND {n(lines.SEPARATOR)} * 4 >= {n(word)} THEN 'navigation'
  WHEN {n(lines.SYMBOL)} >= 3 AND {n(lines.SYMBOL)} * 12 >= length(line) THEN 'symbols'
  WHEN {n(lines.SHOUT)} >= 3 AND {n(lines.SHOUT)} * 4 >= {n(word)} THEN 'shouting'
  WHEN length(line) <= 200 AND regexp_matches(line, '{lines.PHRASE}') THEN 'boilerplate'
  WHEN NOT regexp_matches(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), '{lines.ENDS.replace("'", "''")}') AND NOT regexp_matches(line, '{lines.STOPS.replace("'", "''")}') THEN 'punctuation' END"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS a FROM d),
x AS (SELECT doc_id, i, a || ' ' || lead(a) OVER p || ' ' || lead(a, 2) OVER p || ' ' || lead(a, 3) OVER p || ' ' || lead(a, 4) OVER p AS v FROM o WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM x WHERE v IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM v WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, {rules} AS fails, length({bare("line")}) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}')),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(fails) AS n_failed_lines, CAST(coalesce(sum(chars) FILTER (fails IS NOT NULL), 0) AS BIGINT) AS lost_chars, coalesce(string_agg(DISTINCT fails, ',' ORDER BY fails), '') AS failures FROM l GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length({bare("t")}) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars, coalesce(failures, '') AS failures FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_chars <= word_chars AS kept FROM b"""


def _merkle(levels: int = 10, over: int = 4) -> str:
    """Trees of 3^levels documents a source and 3^over sources at most, a level at a time."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(said, ("doc_id", "source", "lang", "n_chars")), said(text)]) + ")"
    # DuckDB has no crc32: the ids' checksums by its bits, an id's digits at a time.
    ctes = [f"""crc AS (WITH RECURSIVE b AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, CAST(4294967295 AS UBIGINT) AS c, 0 AS k FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
 UNION ALL SELECT doc_id, s, CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(s[k // 9 + 1]) AS UBIGINT)) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END, k + 1 FROM b WHERE k < 9 * length(s))
 SELECT doc_id, c % 2 = 1 AS tampered FROM b WHERE k = 9 * length(s))""",
        f"y AS (SELECT *, coalesce('=' || source, '') AS g, CASE WHEN coalesce((SELECT tampered FROM crc WHERE crc.doc_id = documents.doc_id), true) THEN replace(text, chr(10), '') ELSE text END AS now FROM documents)",
        f"z AS (SELECT doc_id, g, {leaf('text')} AS leaf, {leaf('now')} AS f FROM y)",
        "a0 AS (SELECT doc_id, g, f, leaf, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM z)",
        "t0 AS (SELECT g, i, n, d FROM a0)", "p0 AS (SELECT doc_id, g, leaf, f, i AS pos, '' AS proof FROM a0)"]
    for k in range(levels + over):
        if k == levels:  # sources are leaves now
            ctes += [f"s AS (SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t{k})", f"u{k} AS (SELECT '' AS g, i, n, d FROM s)", f"q{k} AS (SELECT doc_id, '' AS g, leaf, s.d AS subroot, f, s.i AS pos, proof FROM p{k} JOIN s ON p{k}.g = s.g)"]
        t, p, extra = (f"t{k}", f"p{k}", "") if k < levels else (f"u{k}", f"q{k}", "subroot, ")
        new = (f"t{k + 1}", f"p{k + 1}") if k < levels else (f"u{k + 1}", f"q{k + 1}")
        up = "(SELECT string_agg(y.d, '' ORDER BY y.i) FROM {t} y WHERE y.g = x.g AND y.i // 3 = x.i // 3 AND y.i {op} x.i)"
        sides = f"w{k} AS (SELECT x.g, x.i, x.n, coalesce({up.format(t=t, op='<')}, '') AS l, coalesce({up.format(t=t, op='>')}, '') AS r FROM {t} x)"
        ctes += [sides, f"{new[1]} AS (SELECT doc_id, x.g, leaf, {extra}CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, pos // 3 AS pos, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof FROM {p} x JOIN w{k} ON x.g = w{k}.g AND x.pos = w{k}.i)",
                 f"{new[0]} AS (SELECT g, i // 3 AS i, any_value((n + 2) // 3) AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {t} GROUP BY g, i // 3)"]
    k = levels + over
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM q{k} JOIN u{k} ON pos = i"


def oracle_sql() -> dict[str, str]:
    """For the queries whose rows follow from the tables alone, whatever the method."""
    return {"op4_near_dedup": NEAR, "op8_warc": ARCHIVED, "op9_decontaminate": LEAKS, "op12_lines": _cleaned(), "op13_manifest": _merkle()}
