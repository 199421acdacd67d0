"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from skein.llm import infill, licenses, merkle, rules

_BLANK = r"[\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_rules() -> str:
    """Operator 10, from word positions, unpivoted histograms and one row for each text, language and bin."""
    langs = ", ".join(f"({_text(lang)})" for lang in rules.COMMON)
    listed = ", ".join(_text(w) for w in sorted({w for ws in rules.COMMON.values() for w in ws.split()}))
    classes = " UNION ALL ".join(f"SELECT doc_id, lang, {_text(name)} AS bin, length(regexp_replace(t, {_text(f'[^{chars}]+')}, '', 'g')) AS n FROM d" for name, chars in rules.CLASSES.items())
    divergence = "CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') AS ws FROM d),
 pos AS (SELECT doc_id, i, array_to_string(ws[i:i+{rules.WINDOW - 1}], chr(1)) AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - {rules.WINDOW - 2}))) AS i)),
 dup AS (SELECT doc_id, g FROM pos GROUP BY ALL HAVING count(*) > 1),
 hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM pos JOIN dup USING (doc_id, g)),
 rep AS (SELECT doc_id, sum(least({rules.WINDOW}, coalesce(following - i, {rules.WINDOW}))) AS n FROM hit GROUP BY 1),
 ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 base AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
   FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
 c0 AS ({classes}), c1 AS (SELECT * FROM c0 UNION ALL SELECT doc_id, lang, 'symbol', any_value(length(t)) - sum(n) FROM c0 JOIN d USING (doc_id, lang) GROUP BY 1, 2),
 cr AS (SELECT lang AS of_lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS r FROM c1 WHERE lang IN (SELECT * FROM (VALUES {langs})) GROUP BY 1, 2),
 cd AS (SELECT doc_id, of_lang, sum({divergence}) AS s FROM (SELECT c1.doc_id, of_lang, c1.n / length(t) AS p, r FROM c1 JOIN cr USING (bin) JOIN d USING (doc_id) WHERE length(t) > 0) GROUP BY 1, 2),
 cm AS (SELECT doc_id, sqrt(greatest(0, min(s) / 2)) AS class_distance FROM cd GROUP BY 1),
 x AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(list_transform(ws, lambda v: CASE WHEN v IN ({listed}) THEN v ELSE '' END)) AS word FROM w) GROUP BY ALL),
 wr AS (SELECT lang AS of_lang, word, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS r FROM x WHERE lang IN (SELECT * FROM (VALUES {langs})) GROUP BY 1, 2),
 bins AS (SELECT doc_id, of_lang, word FROM (SELECT doc_id FROM w WHERE len(ws) > 0), (SELECT DISTINCT of_lang FROM wr), (SELECT unnest([{listed}, '']) AS word)),
 wd AS (SELECT doc_id, of_lang, sum({divergence}) AS s FROM (SELECT bins.doc_id, of_lang, coalesce(x.n, 0) / len(ws) AS p, coalesce(wr.r, 0) AS r FROM bins JOIN w USING (doc_id) LEFT JOIN wr USING (of_lang, word) LEFT JOIN x ON x.doc_id = bins.doc_id AND x.word = bins.word) GROUP BY 1, 2),
 wm AS (SELECT doc_id, sqrt(greatest(0, min(s) / 2)) AS word_distance FROM wd GROUP BY 1),
 f AS (SELECT base.*, class_distance, word_distance, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM base LEFT JOIN cm USING (doc_id) LEFT JOIN wm USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce((word_chars >= {rules.GUARD_CHARS} AND class_distance > {rules.CLASS_LIMIT}) OR (n_words >= {rules.GUARD_WORDS} AND word_distance > {rules.WORD_LIMIT}), false) AS kept,
 round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM f"""


def license_scan() -> str:
    """Operator 6, from all word positions."""
    common = set(licenses.COMMON.split())
    postings, must = [], []
    for k, (label, text, phrases) in enumerate(licenses.TEMPLATES):
        kept = [(w, i) for i, w in enumerate(text.split()) if w not in common]
        top = min(licenses.RAREST, len({w for w, _ in kept}))
        postings += [f"({k}, {_text(label)}, {_text(w)}, {i}, {top})" for w, i in kept]
        must += [f"({k}, {_text(p)})" for p in phrases]
    base = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, {_text(label)} AS label FROM p WHERE " + " AND ".join(f"ws[i + {j}] = {_text(part)}" for j, part in enumerate(phrase.split())) for phrase, label in licenses.PHRASES.items()
    )
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{licenses.CAPITALS}', '{licenses.SMALL}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
 p AS (SELECT doc_id, ws, i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
 b AS ({base}),
 bs AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM b GROUP BY 1),
 t AS (SELECT * FROM (VALUES {', '.join(postings)}) v(template, label, word, place, top)), m AS (SELECT * FROM (VALUES {', '.join(must)}) v(template, phrase)),
 held AS (SELECT DISTINCT doc_id, word FROM p WHERE word IN (SELECT word FROM t)),
 idf AS (SELECT word, ln((SELECT count(*) FROM documents) / count(*) + 1) AS idf FROM held GROUP BY 1),
 rare AS (SELECT doc_id, template, word FROM (SELECT doc_id, template, word, row_number() OVER (PARTITION BY doc_id, template ORDER BY idf DESC, word) AS k FROM held JOIN idf USING (word) JOIN (SELECT DISTINCT template, word FROM t) USING (word)) WHERE k <= {licenses.RAREST}),
 lined AS (SELECT doc_id, template, label, top, i - 1 - place AS shift, count(DISTINCT word) AS n FROM p JOIN rare USING (doc_id, word) JOIN t USING (template, word) GROUP BY 1, 2, 3, 4, 5),
 sure AS (SELECT l.* FROM lined l JOIN w USING (doc_id) WHERE n >= ceil({licenses.SHARE} * top) AND NOT EXISTS (SELECT 1 FROM m WHERE m.template = l.template AND NOT contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' '))),
 f AS (SELECT doc_id, list(DISTINCT label) AS more, max(least(1.0, n / top)) AS score FROM sure GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(ls, [])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(more, [])))), ',') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN f USING (doc_id)"""


def infill_ropes() -> str:
    """Operator 11, from lists of units."""
    drawn = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    p, s, m = (_text(x.decode()) for x in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, {drawn} FROM d),
 c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
   CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= {infill.RATE} THEN 'plain' WHEN h4 % 100 < {infill.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
 x AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid ELSE {s} || suf || {p} || pre || {m} || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, four bits at a time; the table follows from the polynomial."""
    entries = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    table = f"CAST([{', '.join(map(str, entries))}] AS BIGINT[])"
    half = lambda c: f"xor({c} >> 4, {table}[({c} & 15) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda z: CAST(unicode(z) AS BIGINT))), lambda c, z: {half(half('xor(c, z)'))}), 4294967295)"


#: Levels that the SQL of operator 12 writes out: enough for FAN ** LEVELS rows a source.
LEVELS = 5


def merkle_manifest() -> str:
    """Operator 12, level by level by grouping; a tree that has grown to one node stays as it is."""
    fields = lambda text: "sha256(" + " || ".join("coalesce(" + f"strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in [text if f == "text" else f for f in merkle.FIELDS]) + ")"
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"

    def level(name: str, k: int, groups: str) -> str:
        joined, here = "string_agg(digest, '' ORDER BY place)", f"{name}{k - 1}"
        return f"{name}{k} AS (SELECT {groups}, place // {merkle.FAN} AS place, CASE WHEN any_value(size) > 1 THEN sha256({joined}) ELSE any_value(digest) END AS digest, (any_value(size) + {merkle.FAN - 1}) // {merkle.FAN} AS size FROM {here} GROUP BY {groups}, place // {merkle.FAN})"

    def runs(name: str, k: int, groups: str) -> str:
        own = f"PARTITION BY {groups}, place // {merkle.FAN} ORDER BY place ROWS BETWEEN"
        before, after = (f"coalesce(string_agg(digest, '') OVER ({own} {part}), '')" for part in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        return f"{name}r{k} AS (SELECT *, {before} AS l, {after} AS r, size > 1 AS grown FROM {name}{k})"

    ctes = [
        f"leaf AS (SELECT doc_id, source, {fields('text')} AS digest, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {fields(lower)} END AS tampered FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaf)",
        *[level("n", k, "source") for k in range(1, LEVELS + 1)],
        f"t0 AS (SELECT source, 0 AS every, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM n{LEVELS})",
        *[level("t", k, "every") for k in range(1, LEVELS + 1)],
        *[runs("n", k, "source") for k in range(LEVELS)],
        *[runs("t", k, "every") for k in range(LEVELS)],
    ]
    joins, proof, sides = "", "", []
    for name, of, same in (("n", "n", "x.source IS NOT DISTINCT FROM n.source"), ("t", "s", "true")):
        for k in range(LEVELS):
            x = f"{name}x{k}"
            joins += f" JOIN {name}r{k} {x} ON {same.replace('x.', x + '.')} AND {x}.place = {of}.place // {merkle.FAN**k}"
            proof += f" || CASE WHEN {x}.grown THEN {x}.l || {x}.r ELSE '' END"
            sides.append(f"CASE WHEN {x}.grown THEN [{x}.l, {x}.r] END")
        if name == "n":
            joins += " JOIN t0 s ON s.source IS NOT DISTINCT FROM n.source"
    fold = f"list_reduce(list_concat([[coalesce(n.tampered, n.digest), '']], list_filter([{', '.join(sides)}], lambda z: z IS NOT NULL)), lambda c, z: [sha256(z[1] || c[1] || z[2]), ''])[1]"
    return "WITH " + ",\n ".join(ctes) + f""",
 v AS (SELECT n.doc_id, n.digest AS leaf, s.digest AS subroot, (SELECT digest FROM t{LEVELS}) AS root, sha256(''{proof}) AS proof_sha256, {fold} AS folded_root FROM n0 n{joins})
SELECT *, folded_root = root AS verified FROM v"""


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": license_scan(), "op10_quality_rules": quality_rules(), "op11_infill_ropes": infill_ropes(), "op12_merkle_manifest": merkle_manifest()}
