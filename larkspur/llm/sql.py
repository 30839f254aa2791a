"""DuckDB's SQL for the queries whose rows it can tell."""

from __future__ import annotations

from larkspur.llm import quality


def divergence() -> str:
    """The rows of op2: histograms as rows (doc, kind, k, share), references as means of what lies near the medians, distances as sums."""
    languages = ", ".join(f"('{lang}', {k}, '{word}')" for lang, ws in quality.COMMON.items() for k, word in enumerate(ws, 1))
    kinds = ", ".join("(" + ", ".join([str(k), "'[^" + x.replace("'", "''") + "]+'"]) + ")" for k, x in enumerate(quality.CLASSES.values()))
    refs = "SELECT shares.lang, kind, k, avg(share) AS share FROM shares JOIN base USING (doc_id) WHERE NOT base_failed"
    apart = """SELECT s.doc_id, s.kind, sqrt(greatest(0, sum(
        CASE WHEN s.share > 0 THEN s.share * log2(s.share / ((s.share + r.share) / 2)) ELSE 0 END
        + CASE WHEN r.share > 0 THEN r.share * log2(r.share / ((s.share + r.share) / 2)) ELSE 0 END) / 2)) AS distance
        FROM shares s JOIN {} r USING (lang, kind, k) GROUP BY ALL"""
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
common(lang, k, word) AS (VALUES {languages}),
kinds(k, others) AS (VALUES {kinds}),
listed AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
word AS (SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM listed),
three AS (SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS w FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM three WHERE w IS NOT NULL) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
figures AS (SELECT doc_id, lang, text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(line.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM listed LEFT JOIN line USING (doc_id) LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures),
parts AS (SELECT doc_id, lang, k, length(regexp_replace(text, others, '', 'g')) AS n, length(text) AS total FROM d, kinds WHERE length(text) >= {quality.LEAST_CHARS}),
hits AS (SELECT doc_id, f.lang, c.k, f.n_words AS total, count(w.word) AS n FROM figures f JOIN common c USING (lang) LEFT JOIN word w USING (doc_id, word) WHERE f.n_words >= {quality.LEAST_WORDS} GROUP BY ALL),
shares AS (
    SELECT doc_id, lang, 'class' AS kind, k, n / total AS share FROM parts
    UNION ALL SELECT doc_id, lang, 'class', 99, (total - sum(n)) / total FROM parts GROUP BY doc_id, lang, total
    UNION ALL SELECT doc_id, lang, 'word', k, n / total FROM hits
    UNION ALL SELECT doc_id, lang, 'word', 99, (total - sum(n)) / total FROM hits GROUP BY doc_id, lang, total),
known AS (SELECT DISTINCT lang FROM common),
steps AS (SELECT shares.lang, kind, k, floor(share * {quality.STEPS})::INT AS step, count(*) AS c FROM shares JOIN base USING (doc_id) WHERE NOT base_failed AND shares.lang IN (FROM known) GROUP BY ALL),
upto AS (SELECT *, sum(c) OVER (PARTITION BY lang, kind, k ORDER BY step) AS upto, sum(c) OVER (PARTITION BY lang, kind, k) AS every FROM steps),
middle AS (SELECT lang, kind, k, (min(step) + 0.5) / {quality.STEPS} AS share FROM upto WHERE upto * 2 >= every GROUP BY ALL),
first_refs AS (SELECT lang, kind, k, share / sum(share) OVER (PARTITION BY lang, kind) AS share FROM middle),
first_apart AS ({apart.format("first_refs")}),
refs AS ({refs} AND shares.lang IN (FROM known) AND doc_id IN (SELECT doc_id FROM first_apart WHERE kind = 'class' AND distance <= {quality.CLASS_LIMIT}) AND doc_id NOT IN (SELECT doc_id FROM first_apart WHERE kind = 'word' AND distance > {quality.WORD_LIMIT}) GROUP BY ALL),
apart AS ({apart.format("refs")}),
far AS (SELECT DISTINCT doc_id FROM apart WHERE distance > CASE kind WHEN 'class' THEN {quality.CLASS_LIMIT} ELSE {quality.WORD_LIMIT} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (FROM far) AS kept FROM base
"""


def near_duplicates(k: int = 5, percent: int = 75) -> str:
    """The rows of op9: all pairs that share a shingle, then everything that can be reached from a document."""
    return rf"""
WITH RECURSIVE listed AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) END AS s FROM listed),
single AS (SELECT DISTINCT doc_id, unnest(s) AS sh FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM single GROUP BY doc_id),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM single x JOIN single y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_in JOIN sizes sa ON a = sa.doc_id JOIN sizes sb ON b = sb.doc_id WHERE 100 * i >= {percent} * (sa.n + sb.n - i)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, root FROM reach JOIN ways ON reach.doc_id = ways.a),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _placed(kind: int, name: str, pattern: str) -> str:
    """Matches of a pattern with their places: what lies before a match is the pieces and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e
FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, regexp_split_to_array(text, '{quoted}') AS gs FROM d))"""


def _tail(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    return f"least(1.0::DOUBLE, {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{x} * {x}))"


def randomness() -> str:
    """The rows of op3."""
    from larkspur.llm import secrets as own

    letters = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
    keys = "|".join([*map(letters, ("password", "passwd", "secret", "token")), f"{letters('api')}_?{letters('key')}"])
    assign = rf"""(?:{keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [assign, "AKIA[A-Z0-9]+", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{20,}={0,2}"]
    found = " UNION ALL ".join(_placed(k, n, p) for k, (n, p) in enumerate(zip(own.KINDS, patterns, strict=True)))
    group = assign.replace("'", "''")
    ways = [("bare" if k < own.CASED else "body", k, a.replace("-", chr(92) + "-")) for k, a in enumerate(own.ALPHABETS)]
    coded = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({x}, '^[{a}]{{20,}}$') THEN {{{{'x': {x}, 'code': {k}}}}} END" for x, k, a in ways) + ")"
    coded = coded.replace("{{", "{").replace("}}", "}")
    place = "CASE " + " ".join(f"WHEN n >= {n} THEN {i}" for i, n in reversed(list(enumerate(own.LENGTHS, 1)))) + " END"
    table = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in own.bounds()) + "]"
    alphabets = "[" + ", ".join(f"'{a}'" for a in own.ALPHABETS) + "]"
    log = lambda p: f"ln(greatest({p}, 1e-12::DOUBLE))"
    said = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}), spans AS (SELECT *, e - length(m) AS s FROM found),
base AS (SELECT * FROM spans WHERE kind = 0 AND length(regexp_extract(m, '{group}', 1)) >= 6 OR kind = 1 AND length(m) >= 20 OR kind = 2),
token AS (SELECT row_number() OVER () AS id, * FROM spans t WHERE kind = 3 AND regexp_matches(m, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.s < t.e AND t.s < b.e)),
body AS (SELECT id, regexp_replace(m, '=+$', '') AS body, regexp_replace(regexp_replace(m, '=+$', ''), '[-_]', '', 'g') AS bare FROM token), coded AS (SELECT id, {coded} AS w FROM body),
coded_as AS (SELECT id, w.x AS x, w.code AS code, {alphabets}[w.code + 1] AS alphabet, length(w.x)::DOUBLE AS n FROM coded WHERE w IS NOT NULL),
chars AS (SELECT id, code, alphabet, n, unnest(string_split(x, '')) AS c, generate_subscripts(string_split(x, ''), 1) AS i FROM coded_as),
place AS (SELECT id, code, n, length(alphabet)::DOUBLE AS k, i, c, instr(alphabet, c)::DOUBLE AS x, avg(instr(alphabet, c)::DOUBLE) OVER (PARTITION BY id) AS mean FROM chars),
pair AS (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY i) AS y FROM place), sq AS (SELECT id, sum(q) AS squares FROM (SELECT id, c, count(*)::DOUBLE ** 2 AS q FROM chars GROUP BY id, c) GROUP BY id),
sums AS (SELECT id, code, n, k, squares, sum((x > k / 2)::INT)::DOUBLE AS up, 1 + sum(((x > k / 2) <> (y > k / 2))::INT)::DOUBLE AS runs, sum((x - mean) ** 2) AS spread, sum((x - mean) * (y - mean)) AS joint FROM pair JOIN sq USING (id) GROUP BY ALL),
z AS (SELECT id, code, n, (squares * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / n)) AS chi, CASE WHEN up > 0 AND up < n AND 2 * up * (n - up) > n THEN (runs - 2 * up * (n - up) / n - 1) / sqrt(2 * up * (n - up) * (2 * up * (n - up) - n) / (n * n * (n - 1))) ELSE 9 END AS r, CASE WHEN spread > 0 THEN (joint / spread + 1 / n) * sqrt(n) ELSE 9 END AS c FROM sums),
passed AS (SELECT id FROM z WHERE -({log(f"CASE WHEN chi > 0 THEN {_tail('chi')} / 2 ELSE 1 - {_tail('chi')} / 2 END")} + {log(_tail("r"))} + {log(_tail("c"))}) <= {table}[code + 1][{place}]),
every AS (SELECT doc_id, kind, name, s, e FROM base UNION ALL SELECT doc_id, kind, name, s, e FROM token JOIN passed USING (id))
SELECT doc_id, count(name) FILTER (kind = 0) AS n_assign, count(name) FILTER (kind = 1) AS n_access, count(name) FILTER (kind = 2) AS n_hex,
sha256(coalesce({said} FILTER (kind < 3), '')) AS base_sha256, coalesce({said}, '') AS spans FROM d LEFT JOIN every USING (doc_id) GROUP BY doc_id
"""


def lookup_proofs() -> str:
    """The rows of op11: trees by recursion over levels, then every leaf climbs with what lies beside it. CRC-32 is told byte by
    byte from a table that its polynomial gives."""
    item = lambda x, c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR END"
    leaf = lambda add: "sha256(" + " || ".join(item(f"{c} + {add}" if c == "n_chars" else c, c) for c in ["doc_id", "source", "lang", "n_chars", "text"]) + ")"
    return f"""
WITH RECURSIVE table_of AS (SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
tagged AS (SELECT *, {leaf(0)} AS leaf, {leaf(1)} AS forged,
    coalesce(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) % 7 = 0, false) AS tampered
    FROM documents, table_of),
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, leaf, CASE WHEN tampered THEN forged ELSE leaf END AS used,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM tagged),
node(grp, level, idx, h, n) AS (
    SELECT grp, 0, idx, leaf, count(*) OVER (PARTITION BY grp) FROM leaves
    UNION ALL SELECT grp, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY grp, level, idx // 2, n),
sub AS (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx FROM node WHERE n = 1),
top(level, idx, h, n) AS (
    SELECT 0, idx, h, count(*) OVER () FROM sub
    UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
every AS (SELECT grp, level, idx, h FROM node WHERE n > 1 UNION ALL SELECT '', level, idx, h FROM top WHERE n > 1),
heights AS (SELECT grp, max(level) AS height FROM node GROUP BY grp),
up AS (
    SELECT l.doc_id, l.grp AS own, l.idx AS own_idx, s.h AS subroot, l.grp, 0 AS level, l.idx, l.leaf, l.used AS h, '' AS proof FROM leaves l JOIN sub s USING (grp)
    UNION ALL
    SELECT doc_id, own, own_idx, subroot, CASE WHEN done THEN '' ELSE grp END, CASE WHEN done THEN 0 ELSE level + 1 END, CASE WHEN done THEN root_idx ELSE idx // 2 END, leaf,
        CASE WHEN done THEN h WHEN other IS NULL THEN sha256(h) WHEN idx % 2 = 0 THEN sha256(h || other) ELSE sha256(other || h) END, CASE WHEN done THEN proof ELSE proof || coalesce(other, '') END
    FROM (SELECT u.*, u.level = hs.height AS done, s.idx AS root_idx, e.h AS other FROM up u JOIN heights hs ON u.own = hs.grp JOIN sub s ON u.own = s.grp
        LEFT JOIN every e ON e.grp = u.grp AND e.level = u.level AND e.idx = xor(u.idx, 1)
        WHERE u.grp <> '' OR u.level < (SELECT max(level) FROM top)))
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified
FROM up WHERE grp = '' AND level = (SELECT max(level) FROM top)
"""


def contamination(size: int = 10) -> str:
    """The rows of op12: every run of words of a document that is as long as some window, met with windows by its words."""
    ws = lambda t: f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {t}"
    return f"""
WITH d AS (SELECT doc_id, {ws("documents")}), b AS (SELECT item_id, {ws("benchmark")}),
win AS (SELECT DISTINCT item_id, least(len(ws), {size}) AS l, array_to_string(ws[i:i + {size - 1}], ' ') AS w FROM b, unnest(range(1, greatest(1, len(ws) - {size - 1}) + 1)) r(i) WHERE len(ws) > 0),
here AS (SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS w FROM d, (SELECT DISTINCT l FROM win) k, unnest(range(1, len(ws) - l + 2)) r(i)),
met AS (SELECT DISTINCT doc_id, i, l, item_id FROM here JOIN win USING (l, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, i, l FROM met), unnest(range(i, i + l)) r(p) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_divergence": divergence(), "op3_randomness": randomness(), "op9_circulant_minhash": near_duplicates(), "op11_lookup_proofs": lookup_proofs(), "op12_wu_manber": contamination()}
