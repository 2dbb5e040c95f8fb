"""SQL that states the registered queries over the given tables, for DuckDB."""

from __future__ import annotations

from tachado import constants as K

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- shared parts

DOC_PAGES = "pg AS (SELECT doc_id, 1 AS page, text, source AS user_id FROM documents)"
SPLIT_PAGES = """pl AS (
  SELECT doc_id, source AS user_id, string_split(text, chr(10)) AS l FROM documents),
pg AS (
  SELECT doc_id, user_id, CAST(p AS INTEGER) + 1 AS page, array_to_string(list_slice(l, p * 20 + 1, p * 20 + 20), chr(10)) AS text
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(l) / 20.0) AS BIGINT))) AS p FROM pl))"""

_W = r"\p{L}\p{N}_"
# Rules with look-around, or whose edges may touch letters outside ASCII: what may not stand before, and the match
# with the one character after it.  Texts get a blank before and after so both always exist.
_SPACED = r"(?:\d[ \-]?)"
_EDGED = {
    "TELEFONO": (r"\d\-", r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{2,4}\)?[\s.\-]?)\d{3,4}[\s.\-]?\d{4}[^\d\-]"),
    "CELULAR": (r"\d\-", r"(?:\+?\d{1,3}[\s.\-]?)?(?:9[\s.\-]?)?(?:\(?\d{2,4}\)?[\s.\-]?)?(?:15[\s.\-]?)?\d{3,4}[\s.\-]?\d{4}[^\d\-]"),
    "TELEFONO_CHILE": (r"\d", r"(?:\+?56[\s.\-]?)?(?:9|2|\d{1,2})[\s.\-]?\d{3,4}[\s.\-]?\d{4}[^\d]"),
    "TARJETA_CREDITO": (_W, "(?:" + "|".join(
        f"{_SPACED}{{{n}}}\\d[ \\-][{_W}]|{_SPACED}{{{n}}}\\d[^{_W}]" for n in (15, 14, 13, 12)) + ")"),
    "NOMBRE": (_W, r"(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+,\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*|[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,2})[^" + _W + "]"),
}


def edged_cte(name: str, pages: str, before: str, body: str) -> str:
    """Matches one after the other: each step looks at what is left from the last match's last character on."""
    rx = _str(f"[^{before}]{body}")
    return f"""{name} AS (
  SELECT doc_id, page, text, 0 AS k, -1 AS base, ' ' || text || ' ' AS rest, CAST(0 AS INTEGER) AS start_offset, '' AS ent FROM {pages} WHERE regexp_matches(' ' || text || ' ', {rx})
  UNION ALL
  SELECT doc_id, page, text, k + 1, base + cut + len(hit) - 2 AS base, substring(text || ' ', base + cut + len(hit) - 1) AS rest, CAST(base + cut + 1 AS INTEGER), substring(hit, 2, len(hit) - 2)
  FROM (SELECT *, len(string_split_regex(rest, {rx})[1]) AS cut, regexp_extract(rest, {rx}) AS hit FROM {name} WHERE regexp_matches(rest, {rx})))"""


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules(every: bool, only: tuple = ()) -> list[tuple[int, str, str]]:
    """(place, type, pattern) of the rules in play."""
    kept = [(t, p) for t, p, on in K.DEFAULT_RULES if (on or every) and (not only or t in only)]
    return [(i, t, p) for i, (t, p) in enumerate(kept)]


def found_ctes(every: bool, pages: str = "pg", only: tuple = ()) -> str:
    """CTE ``found``: doc_id, page, ord, type, start_offset, end_offset, text, source, confidence."""
    plain, edged = [], []
    for i, t, p in rules(every, only):
        (edged if t in _EDGED else plain).append((i, t, p))
    out = []
    values = ", ".join(f"({i}, {_str(t)}, {_str(p)})" for i, t, p in plain)
    # Pieces between matches give exact offsets.
    unions = " UNION ALL ".join(
        f"SELECT doc_id, page, {i} AS rule, {_str(t)} AS type, regexp_extract_all(text, {_str(p)}) AS m, "
        f"string_split_regex(text, {_str(p)}) AS s FROM {pages} WHERE regexp_matches(text, {_str(p)})" for i, t, p in plain)
    out.append(f"""plain_hits AS ({unions}),
plain AS (SELECT doc_id, page, rule, type, k,
    CAST(list_sum(list_transform(s[:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: len(x))), 0) AS INTEGER) AS start_offset,
    m[k] AS text FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM plain_hits))""")
    names = ["SELECT doc_id, page, rule, type, k, start_offset, text FROM plain"]
    for i, t, _ in edged:
        out.append(edged_cte(f"e{i}", pages, *_EDGED[t]))
        names.append(f"SELECT doc_id, page, {i} AS rule, {_str(t)} AS type, k, start_offset, ent AS text FROM e{i} WHERE k > 0")
    out.append("every_hit AS (" + " UNION ALL ".join(names) + ")")
    out.append("""found AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY rule, k) - 1 AS INTEGER) AS ord, type,
  start_offset, CAST(start_offset + len(text) AS INTEGER) AS end_offset, text, 'regex' AS source, 0.95::DOUBLE AS confidence FROM every_hit)""")
    return ",\n".join(out)


def settled_ctes(source: str, name: str = "settled", clash: str | None = None, beats: str | None = None) -> str:
    """Survivors of ``source`` by the ordered fold, page by page."""
    def both(a, b):
        return f"greatest(c[{a}].start_offset, c[{b}].start_offset) < least(c[{a}].end_offset, c[{b}].end_offset)"
    span = "(c[{0}].end_offset - c[{0}].start_offset)"
    prio = "(CASE c[{0}].source WHEN 'regex' THEN 3 WHEN 'bedrock' THEN 2 ELSE 0 END)"

    def stronger(b, a):
        sb, sa, pb, pa = span.format(b), span.format(a), prio.format(b), prio.format(a)
        tail = f" OR (c[{b}].confidence = c[{a}].confidence AND {pb} > {pa})" if beats is None else ""
        return f"({sb} > {sa} OR ({sb} = {sa} AND (c[{b}].confidence > c[{a}].confidence{tail})))"

    def meets(a, b):
        return both(a, b) if clash is None else clash.format(a=a, b=b)
    return f"""{name}_p AS (
  SELECT doc_id, page, list({{'ord': ord, 'type': type, 'start_offset': start_offset, 'end_offset': end_offset, 'text': text, 'source': source, 'confidence': confidence}} ORDER BY ord) AS c
  FROM {source} GROUP BY doc_id, page),
{name}_w AS (
  SELECT doc_id, page, c, CAST(1 AS BIGINT) AS i, list_transform(c, lambda x: true) AS alive FROM {name}_p
  UNION ALL
  SELECT doc_id, page, c, i + 1, CASE WHEN alive[i] THEN
      list_transform(range(1, len(c) + 1), lambda k: alive[k] AND NOT ((k = i AND j IS NOT NULL) OR (k > i AND {meets('i', 'k')} AND (j IS NULL OR k < j))))
    ELSE alive END
  FROM (SELECT *, list_min(list_filter(range(i + 1, len(c) + 1), lambda j: alive[j] AND {meets('i', 'j')} AND {stronger('j', 'i')})) AS j FROM {name}_w WHERE i <= len(c))),
{name} AS (
  SELECT doc_id, page, e.ord, e.type, e.start_offset, e.end_offset, e.text, e.source, e.confidence
  FROM (SELECT doc_id, page, unnest(c) AS e, unnest(alive) AS a FROM {name}_w WHERE i = len(c) + 1) WHERE a)"""


def masked_ctes(source: str, pages: str = "pg", name: str = "masked") -> str:
    """Pages with labels in the place of ``source``'s entities, which do not overlap."""
    suffix = "CASE source WHEN 'regex' THEN '-R' WHEN 'bedrock' THEN '-IA' ELSE '' END"
    return f"""{name}_g AS (
  SELECT doc_id, page, start_offset, end_offset, '[' || type || {suffix} || ']' AS label,
    coalesce(lag(end_offset) OVER w, 0) AS from_offset FROM {source} WINDOW w AS (PARTITION BY doc_id, page ORDER BY start_offset)),
{name}_j AS (
  SELECT g.doc_id, g.page, string_agg(substring(p.text, from_offset + 1, start_offset - from_offset) || label, '' ORDER BY start_offset) AS head,
    max(end_offset) AS last, count(*) AS n FROM {name}_g g JOIN {pages} p USING (doc_id, page) GROUP BY 1, 2),
{name} AS (
  SELECT p.doc_id, p.page, p.user_id, CAST(coalesce(n, 0) AS INTEGER) AS n_entities, CASE WHEN n IS NULL THEN p.text ELSE head || substring(p.text, last + 1) END AS masked_text
  FROM {pages} p LEFT JOIN {name}_j j USING (doc_id, page))"""


_ENTITY = "doc_id, page, ord, type, start_offset, end_offset, text, source, confidence"

# Names a model is said to have found, with rough offsets; answers without brackets give nothing.
MODEL = """names AS (
  SELECT doc_id, page, text, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS name,
    unnest(range(0, len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')))) AS i FROM pg WHERE len(text) % 5 <> 0),
spots AS (
  SELECT doc_id, page, text, name, i, CAST(instr(text, name) AS BIGINT) AS pos FROM names WHERE contains(text, name)
  UNION ALL
  SELECT doc_id, page, text, name, i, pos + instr(substring(text, pos + 1), name) FROM spots WHERE instr(substring(text, pos + 1), name) > 0),
placed AS (SELECT doc_id, page, name, i, arg_min(pos - 1, (abs(pos - 1 - i * 50), pos)) AS s FROM spots GROUP BY ALL),
by_model AS (
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS INTEGER) AS ord, 'NOMBRE' AS type,
    CAST(s AS INTEGER) AS start_offset, CAST(s + len(name) AS INTEGER) AS end_offset, name AS text, 'bedrock' AS source, 0.85::DOUBLE AS confidence FROM placed)"""

BOTH = """joined AS (
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY b, ord) - 1 AS INTEGER) AS ord, type, start_offset, end_offset, text, source, confidence
  FROM (SELECT 0 AS b, * FROM by_model UNION ALL SELECT 1 AS b, * FROM found))"""


def sql(name: str, ctes: list[str], select: str) -> None:
    ORACLE[name] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + select


# ---------------------------------------------------------------- detection

sql("detect_default_rules", [DOC_PAGES, found_ctes(False)], f"SELECT {_ENTITY} FROM found")
sql("detect_every_rule", [DOC_PAGES, found_ctes(True)], f"SELECT {_ENTITY} FROM found")
sql("page_html_rules", ["pg AS (SELECT page_id AS doc_id, 1 AS page, html AS text FROM pages)",
                        found_ctes(True)], f"SELECT {_ENTITY} FROM found")
sql("detect_user_rules", [DOC_PAGES, found_ctes(False, only=("EMAIL",)),
    """rep AS (SELECT doc_id, page, regexp_extract_all(text, rx) AS m, string_split_regex(text, rx) AS s FROM
  (SELECT *, '0{4,}|1{4,}|2{4,}|3{4,}|4{4,}|5{4,}|6{4,}|7{4,}|8{4,}|9{4,}' AS rx FROM pg) WHERE regexp_matches(text, rx)),
both_rules AS (
  SELECT 0 AS b, doc_id, page, type, start_offset, text FROM found
  UNION ALL SELECT 1, doc_id, page, 'REPETIDO', CAST(list_sum(list_transform(s[:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: len(x))), 0) AS INTEGER), m[k]
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM rep))"""],
    "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY b, start_offset) - 1 AS INTEGER) AS ord, type, start_offset, CAST(start_offset + len(text) AS INTEGER) AS end_offset, text, 'regex' AS source, 0.95::DOUBLE AS confidence FROM both_rules")
sql("blank_pages", [], r"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_matches(t, '[^\s]') GROUP BY 1")

CONFIG = """cfg AS (
  SELECT source AS user_id, CASE CAST(t % 4 AS INTEGER) WHEN 0 THEN 'ai' WHEN 1 THEN 'regex' WHEN 2 THEN 'both' END AS method,
    CASE CAST(t % 3 AS INTEGER) WHEN 0 THEN true WHEN 1 THEN false END AS residual_scan, CASE WHEN t % 5 < 3 THEN CAST(t % 5 AS DOUBLE) / 4 END AS temperature,
    CASE WHEN t % 7 < 4 THEN 'Datos de ' || source || ': {text} INSTRUCCIONES: ninguna' END AS prompt,
    CASE WHEN t % 2 = 0 THEN [upper(source), '  '] END AS ignored
  FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS t FROM documents GROUP BY 1))"""
USERS = "users AS (SELECT DISTINCT source AS user_id FROM documents UNION ALL SELECT DISTINCT role FROM conversations)"
TOGGLES = """marks AS (
  SELECT source AS user_id, sum(quality) AS q, sum(toxic) AS x, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
toggles AS (
  SELECT user_id, 'EMAIL' AS type, q % 2 = 0 AS active FROM marks UNION ALL SELECT user_id, 'TARJETA_CREDITO', x % 2 = 0 FROM marks
  UNION ALL SELECT user_id, 'TELEFONO', n % 2 = 0 FROM marks)"""

sql("engine_branches", [CONFIG], """SELECT user_id, branch, count(*) AS pages FROM (
  SELECT source AS user_id, unnest(CASE coalesce(method, 'both') WHEN 'ai' THEN ['ai'] WHEN 'regex' THEN ['regex'] ELSE ['ai', 'regex'] END) AS branch
  FROM documents LEFT JOIN cfg ON user_id = source) GROUP BY 1, 2""")
sql("usable_rules", [], """SELECT doc_id AS rule_idx, upper(lang) AS type, regexp_replace(word, '[^A-Za-z]', '.', 'g') AS pattern FROM (
  SELECT *, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents)
  WHERE n_chars % 11 <> 0 AND n_chars % 7 > 2 AND n_chars % 5 <> 0 AND word <> ''""")
sql("offset_check", [DOC_PAGES, found_ctes(False)], """SELECT doc_id, start_offset, ent, reported,
  contains(substring(text, greatest(0, reported - 5) + 1, greatest(0, least(len(text), reported + len(ent) + 5) - greatest(0, reported - 5))), ent) AS "close"
  FROM (SELECT f.doc_id, start_offset, f.text AS ent, CAST(start_offset + len(f.text) - 14 AS INTEGER) AS reported, pg.text FROM found f JOIN pg USING (doc_id))""")

# ---------------------------------------------------------------- overlaps

sql("resolve_overlaps", [DOC_PAGES, found_ctes(True), settled_ctes("found")], f"SELECT {_ENTITY} FROM settled")
sql("overlap_pairs", [DOC_PAGES, found_ctes(True)], """SELECT a.doc_id, a.page, a.ord AS ord_a, b.ord AS ord_b, a.type AS type_a, b.type AS type_b,
  round((least(a.end_offset, b.end_offset) - greatest(a.start_offset, b.start_offset))::DOUBLE / least(a.end_offset - a.start_offset, b.end_offset - b.start_offset), 9) AS ratio
  FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord < b.ord AND greatest(a.start_offset, b.start_offset) < least(a.end_offset, b.end_offset)""")
sql("dedup_same_type", [DOC_PAGES, found_ctes(True),
    "kinds AS (SELECT * REPLACE (CASE WHEN type IN ('TELEFONO', 'CELULAR', 'TELEFONO_CHILE', 'TARJETA_CREDITO') THEN 'NUMERO' ELSE type END AS type) FROM found)",
    settled_ctes("kinds", clash="(c[{a}].type = c[{b}].type AND greatest(0, least(c[{a}].end_offset, c[{b}].end_offset) - greatest(c[{a}].start_offset, c[{b}].start_offset))::DOUBLE "
                                "/ least(c[{a}].end_offset - c[{a}].start_offset, c[{b}].end_offset - c[{b}].start_offset) > 0.8)", beats="plain")],
    f"SELECT {_ENTITY} FROM settled")
sql("candidate_order", [DOC_PAGES, found_ctes(False), MODEL, BOTH], "SELECT doc_id, page, ord, type, start_offset, source FROM joined")
sql("reading_order", [DOC_PAGES, found_ctes(True)], "SELECT doc_id, page, start_offset, ord, type FROM found ORDER BY 1, 2, 3, 4")

# ---------------------------------------------------------------- model

# Windows of 10 000 characters, each 500 characters into the one before.
WINDOWS = """win AS (SELECT doc_id, text AS whole, CAST(unnest(range(0, greatest(len(text) - 500, 1), 9500)) AS INTEGER) AS a FROM documents),
pg AS (SELECT doc_id, CAST(a // 9500 AS INTEGER) AS page, a, len(whole) AS n, substring(whole, a + 1, 10000) AS text FROM win)"""
sql("model_prompts", [WINDOWS], """SELECT doc_id, page AS "window", CAST(len(prompt) AS INTEGER) AS length, md5(prompt) AS digest, prompt IS NULL AS failed FROM (
  SELECT doc_id, page, CASE WHEN source = 'src0' THEN NULL WHEN source LIKE '%1' THEN 'Sin marca' || chr(10) || chr(10) || 'TEXTO A ANALIZAR:' || chr(10) || '---' || chr(10) || pg.text || chr(10) || '---'
    ELSE 'Ver ' || pg.text || ' y ' || pg.text || '.' END AS prompt FROM pg JOIN documents USING (doc_id))""")
sql("model_elements", [], """SELECT doc_id, CAST(pos AS INTEGER) AS pos, text, CASE WHEN text IS NULL THEN NULL ELSE 'NOMBRE' END AS type, hint, failed FROM (
  SELECT doc_id, unnest(range(0, len(n) + 1)) AS pos, unnest(list_append(n, 'Nadie Aqui Zzz')) AS text,
    unnest(list_append(list_transform(range(0, len(n)), lambda i: i * 50), 3)) AS hint, false AS failed
  FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS n FROM documents WHERE len(text) % 5 <> 0)
  UNION ALL SELECT doc_id, NULL, NULL, NULL, true FROM documents WHERE len(text) % 5 = 0)""")
sql("model_entities", [DOC_PAGES, MODEL], f"SELECT {_ENTITY} FROM by_model")
sql("scored_pages", [WINDOWS, edged_cte("named", "pg", _W, f"[A-Z][a-z]+ [A-Z][a-z]+[^{_W}]"),
    """whole AS (SELECT named.doc_id, page, k, start_offset + pg.a AS s, start_offset + len(ent) + pg.a AS e, ent FROM named JOIN pg USING (doc_id, page)
  WHERE k > 0 AND (start_offset > 0 OR pg.a = 0) AND (start_offset + len(ent) < len(pg.text) OR pg.a + len(pg.text) >= pg.n)),
once AS (SELECT doc_id, s, e, ent, min((page, k)) AS first FROM whole GROUP BY ALL)"""],
    """SELECT doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS ord, 'NOMBRE' AS type, CAST(s AS INTEGER) AS start_offset,
  CAST(e AS INTEGER) AS end_offset, ent AS text, 'bedrock' AS source, 0.85::DOUBLE AS confidence FROM once""")
sql("find_all", ["""spots AS (
  SELECT doc_id, text, CAST(1 AS BIGINT) AS pos FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, pos + instr(substring(text, pos + 1), left(text, 4)) FROM spots WHERE instr(substring(text, pos + 1), left(text, 4)) > 0)"""],
    "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos FROM spots")
sql("map_types", [], """SELECT event_id, CASE event_type WHEN 'view' THEN 'NOMBRE' WHEN 'signup' THEN 'EMAIL' WHEN 'click' THEN 'TELEFONO' WHEN 'purchase' THEN 'FECHA' END AS type
  FROM events WHERE event_type <> 'error'""")

# ---------------------------------------------------------------- masking and reports

sql("mask_documents", [DOC_PAGES, found_ctes(False), settled_ctes("found"), masked_ctes("settled")], "SELECT doc_id, n_entities, masked_text FROM masked")
ORACLE["stream_masked"] = ORACLE["mask_documents"]
sql("mask_with_model_and_config", [DOC_PAGES, CONFIG, TOGGLES, found_ctes(False), MODEL,
    """m AS (SELECT pg.doc_id, pg.user_id, coalesce(method, 'both') AS method, ignored FROM pg LEFT JOIN cfg USING (user_id)),
joined AS (
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY b, ord) - 1 AS INTEGER) AS ord, type, start_offset, end_offset, text, source, confidence
  FROM (SELECT 0 AS b, by_model.* FROM by_model JOIN m USING (doc_id) WHERE method <> 'regex' UNION ALL SELECT 1 AS b, found.* FROM found JOIN m USING (doc_id) WHERE method <> 'ai'))""",
    settled_ctes("joined"),
    """kept AS (SELECT s.* FROM settled s JOIN m USING (doc_id) LEFT JOIN toggles t ON t.user_id = m.user_id AND t.type = s.type
  WHERE coalesce(active, true) AND NOT coalesce(list_contains(list_transform(ignored, lambda v: lower(trim(v))), lower(trim(s.text))), false))""",
    masked_ctes("kept")], "SELECT doc_id, user_id, n_entities, masked_text FROM masked")
sql("report_sections", [SPLIT_PAGES, found_ctes(False), settled_ctes("found"), masked_ctes("settled")],
    """SELECT doc_id, CAST(page AS INTEGER) AS section, '## Página ' || page || chr(10) || chr(10) || masked_text || chr(10) AS body FROM masked
  UNION ALL SELECT doc_id, 0, '# Informe de Ofuscación: doc-' || doc_id || '.pdf' || chr(10) || chr(10) || '**Archivo original:** doc-' || doc_id || '.pdf' || chr(10) || chr(10) || '---' || chr(10) FROM documents""")
# Offsets that miss replace the first literal occurrence, right to left.
sql("mask_text", [SPLIT_PAGES, found_ctes(False),
    """odd AS (SELECT doc_id, page, list({'s': CASE WHEN end_offset % 3 = 0 THEN -1 ELSE start_offset END, 'e': end_offset, 't': text, 'l': '[' || type || '-R]'}
    ORDER BY CASE WHEN end_offset % 3 = 0 THEN -1 ELSE start_offset END DESC, ord) AS c FROM found GROUP BY 1, 2),
steps AS (
  SELECT pg.doc_id, pg.page, c, CAST(1 AS BIGINT) AS i, text AS t FROM pg JOIN odd USING (doc_id, page)
  UNION ALL
  SELECT doc_id, page, c, i + 1, CASE WHEN c[i].s >= 0 AND c[i].e > c[i].s AND c[i].e <= len(t) THEN substring(t, 1, c[i].s) || c[i].l || substring(t, c[i].e + 1)
    WHEN contains(t, c[i].t) THEN substring(t, 1, instr(t, c[i].t) - 1) || c[i].l || substring(t, instr(t, c[i].t) + len(c[i].t)) ELSE t END
  FROM steps WHERE i <= len(c))"""],
    """SELECT doc_id, page, coalesce(len(c), 0) AS n_entities, coalesce(t, pg.text) AS masked_text FROM pg LEFT JOIN (SELECT * FROM steps WHERE i = len(c) + 1) USING (doc_id, page)""")


def _channel(i: int) -> str:
    cases = " ".join(f"WHEN {_str(k)} THEN {v[i]}" for k, v in K.HIGHLIGHTS.items())
    return f"CAST(CASE type {cases} ELSE 0.9 END AS DOUBLE)"


sql("labels_and_colours", [DOC_PAGES, found_ctes(True)], f"""SELECT doc_id, ord, '[' || CASE WHEN start_offset % 9 = 0 THEN 'PII' ELSE type END ||
  CASE start_offset % 4 WHEN 0 THEN '-IA' WHEN 1 THEN '-C' WHEN 2 THEN '-R' ELSE '' END || ']' AS label, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM found""")
sql("ignore_list", [DOC_PAGES, found_ctes(False), r"""ign AS (SELECT DISTINCT source AS user_id, upper(v) AS v FROM (
  SELECT source, unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+\.[a-z]+')) AS v FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))"""],
    f"""SELECT pg.user_id, f.doc_id, f.page, f.ord, f.type, f.start_offset, f.end_offset, f.text, f.source, f.confidence FROM found f JOIN pg USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM ign WHERE ign.user_id = pg.user_id AND ign.v = upper(trim(f.text)))""")
sql("type_switches", [DOC_PAGES, TOGGLES, found_ctes(True)], """SELECT pg.user_id, f.type, count(*) AS n FROM found f JOIN pg USING (doc_id)
  LEFT JOIN toggles t ON t.user_id = pg.user_id AND t.type = f.type WHERE coalesce(active, true) GROUP BY 1, 2""")
sql("redaction_counts", [DOC_PAGES, found_ctes(True), settled_ctes("found")], """SELECT doc_id, type, n, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total,
  CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS types FROM (SELECT doc_id, type, count(*) AS n FROM settled GROUP BY 1, 2)""")
sql("nothing_to_mask", [DOC_PAGES, TOGGLES, found_ctes(False)], """SELECT doc_id, CASE WHEN doc_id IN (
  SELECT f.doc_id FROM found f JOIN pg USING (doc_id) LEFT JOIN toggles t ON t.user_id = pg.user_id AND t.type = f.type WHERE coalesce(active, true)) THEN 'MASK' ELSE 'COMPLETED' END AS state FROM documents""")
_AFTER = [DOC_PAGES, found_ctes(False), settled_ctes("found"), masked_ctes("settled"), "mp AS (SELECT doc_id, page, masked_text AS text FROM masked)"]


def _renamed(ctes: str, tag: str) -> str:
    for name in ["plain_hits", "every_hit"]:
        ctes = ctes.replace(name, f"{tag}_{name}")
    ctes = ctes.replace("plain AS (SELECT", f"{tag}_plain AS (SELECT").replace("FROM plain", f"FROM {tag}_plain").replace("found AS", f"{tag}_found AS")
    for i in range(len(K.DEFAULT_RULES)):
        ctes = ctes.replace(f"e{i} AS (", f"{tag}_e{i} AS (").replace(f"FROM e{i} ", f"FROM {tag}_e{i} ")
    return ctes


_LEFT = [*_AFTER, _renamed(found_ctes(True, "mp"), "left"),
         """labs AS (SELECT doc_id, len(label) AS n, start_offset + coalesce(sum(len(label) - (end_offset - start_offset))
  OVER (PARTITION BY doc_id, page ORDER BY start_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM masked_g),
remains AS (SELECT * FROM left_found f WHERE NOT EXISTS (SELECT 1 FROM labs l WHERE l.doc_id = f.doc_id AND f.start_offset >= l.a AND f.end_offset <= l.a + l.n))"""]
sql("residual_scan", _LEFT, "SELECT doc_id, type, start_offset, end_offset, text FROM remains")
ORACLE["stream_residual"] = ORACLE["residual_scan"]
sql("scan_scopes", [*_LEFT, _renamed(found_ctes(True), "orig")], """SELECT scope, type, count(*) AS findings FROM (
  SELECT 'ORIGINALES' AS scope, type FROM orig_found UNION ALL SELECT 'OFUSCADOS', type FROM remains) GROUP BY 1, 2""")
sql("scan_status", [CONFIG], "SELECT source AS user_id, doc_id, CASE WHEN residual_scan THEN 'REQUESTED' ELSE 'DISABLED' END AS scan_status FROM documents LEFT JOIN cfg ON user_id = source")
sql("scan_jobs", [CONFIG], """SELECT user_id, 'ORIGINALES' AS scope, 'originales/' || user_id || '/' AS prefix, CASE WHEN residual_scan THEN 'CREATED' ELSE 'FAILED' END AS status FROM cfg
  UNION ALL SELECT user_id, 'OFUSCADOS', 'ofuscados/' || user_id || '/', CASE WHEN temperature > 0.3 THEN 'CREATED' ELSE 'FAILED' END FROM cfg""")
FILES = """files AS (SELECT *, root || '/' || source || '/' || name AS key FROM (
  SELECT doc_id, source, source AS user_id, CASE lang WHEN 'en' THEN 'originales' WHEN 'fr' THEN 'ofuscados' WHEN 'de' THEN 'procesamiento' ELSE 'errores' END AS root,
    'Doc ' || doc_id || CASE WHEN n_chars % 3 = 0 THEN '.md' ELSE '.pdf' END AS name, n_chars * 65536 AS size, TIMESTAMP '2024-01-01' + to_minutes(n_chars) AS modified FROM documents))"""
sql("output_names", [FILES], """SELECT doc_id, stem || '_ofuscado.pdf' AS masked, stem || '_informe.md' AS report FROM (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.oculto' || doc_id WHEN 1 THEN name || '.v2' ELSE 'Doc ' || doc_id END AS stem FROM files)""")

# ---------------------------------------------------------------- aggregates

_FOUND = [DOC_PAGES, found_ctes(False), MODEL, BOTH, settled_ctes("joined")]
sql("source_contributions", _FOUND, "SELECT doc_id, count(*) FILTER (source = 'bedrock') AS bedrock, count(*) FILTER (source = 'regex') AS regex FROM settled GROUP BY 1")
sql("entity_counts", _FOUND, "SELECT doc_id, count(s.ord) AS entities_found FROM documents LEFT JOIN settled s USING (doc_id) GROUP BY 1")
_ENGINE = "CASE WHEN m = 0 AND r > 0 THEN 'Regex' WHEN r > 0 THEN 'IA (Claude Haiku 4.5) + Regex' ELSE 'IA (Claude Haiku 4.5)' END AS engine"
sql("engine_label", _FOUND, f"SELECT doc_id, {_ENGINE} FROM (SELECT doc_id, count(*) FILTER (s.source = 'bedrock') AS m, count(*) FILTER (s.source = 'regex') AS r FROM documents LEFT JOIN settled s USING (doc_id) GROUP BY 1)")
sql("document_summary", [SPLIT_PAGES, found_ctes(False), MODEL, BOTH, settled_ctes("joined")], f"""SELECT doc_id, pages, m + r AS entities_found, m AS from_model, r AS from_rules, {_ENGINE} FROM (
  SELECT pg.doc_id, count(DISTINCT pg.page) AS pages, count(*) FILTER (s.source = 'bedrock') AS m, count(*) FILTER (s.source = 'regex') AS r FROM pg LEFT JOIN settled s USING (doc_id, page) GROUP BY 1)""")
sql("entities_document", [SPLIT_PAGES, found_ctes(False), settled_ctes("found")], """SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS regex,
  CAST(0 AS INTEGER) AS bedrock, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY start_offset, ord) - 1 AS INTEGER) AS place, start_offset, type FROM settled""")

# ---------------------------------------------------------------- recognition results

LINES = """ln AS (SELECT doc_id, n AS line, CAST(n // 20 AS INTEGER) + 1 AS page, l[n + 1] AS text, (n * 7 % 20) / 20.0::DOUBLE AS top, (n * 3 % 5) / 5.0::DOUBLE AS "left"
  FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
sql("ocr_pages", [LINES], """SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top, "left", line) - 1 AS INTEGER) AS place, 'L' || line AS id, top, "left" FROM ln""")
sql("page_text", [LINES], """SELECT doc_id, page, string_agg(text, chr(10) ORDER BY top, "left", line) AS text FROM ln GROUP BY 1, 2""")
_OFFSETS = """SELECT doc_id, page, CAST(coalesce(sum(len(text) + 1) OVER w, 0) AS BIGINT) AS start_offset, CAST(coalesce(sum(len(text) + 1) OVER w, 0) + len(text) AS BIGINT) AS end_offset FROM pg
  WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
sql("page_offsets", [SPLIT_PAGES], _OFFSETS)
sql("conversation_offsets", ["pg AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations)"], _OFFSETS)
WORDS = "wd AS (SELECT doc_id, page, line, top, \"left\", unnest(w) AS text, unnest(range(0, len(w))) AS i FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM ln))"
sql("attach_words", [LINES, WORDS], """SELECT doc_id, page, 'L' || line AS line_id, count(*) AS words, CAST(sum(len(text) * (i + 1)) AS BIGINT) AS weight, max(round("left" + i / 100.0, 6)) AS rightmost FROM wd GROUP BY 1, 2, line""")
sql("ocr_words", [LINES, WORDS], """SELECT doc_id, CASE WHEN p % 3 <> 0 THEN p END AS page, CAST(1 AS INTEGER) AS page_at, CAST(sum(n) AS BIGINT) AS words, CAST(max(n) - 1 AS INTEGER) AS last
  FROM (SELECT doc_id, page AS p, count(*) AS n FROM wd GROUP BY 1, 2) GROUP BY 1, 2""")
sql("page_lookup", [], """SELECT doc_id, page, CAST(coalesce(min(n.pos), min(a.pos)) AS INTEGER) AS pos FROM (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page FROM conversations) w
  LEFT JOIN (SELECT conv_id AS doc_id, CAST(turn + conv_id % 2 + 1 AS INTEGER) AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) n USING (doc_id, page)
  LEFT JOIN (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) a USING (doc_id, page) GROUP BY 1, 2""")
sql("scale_boxes", [LINES, WORDS], """SELECT doc_id, page, 'L' || line AS line_id, round(min("left" + i / 100.0) * 595, 6) AS x0, round(min(top) * 842, 6) AS y0,
  round(max("left" + i / 100.0 + 0.01) * 595, 6) AS x1, round(max(top + 0.04) * 842, 6) AS y1 FROM wd GROUP BY 1, 2, line""")
LAID = """lw AS (SELECT doc_id, page, unnest(range(0, len(w))) AS word_ord, unnest(w) AS text FROM (SELECT doc_id, page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM pg)),
laid AS (SELECT *, (word_ord % 8) * 60.0 AS x0, (word_ord // 8) * 12.0 AS y0, (word_ord % 8) * 60.0 + least(len(text), 9) * 6.0 AS x1, (word_ord // 8) * 12.0 + 10 AS y1, word_ord // 8 AS line FROM lw)"""
sql("font_sizes", ["pg AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations)", LAID],
    """SELECT b.doc_id, b.page, CAST(b.word_ord AS INTEGER) AS word_ord, CAST(s.n + 6 AS DOUBLE) AS font_size FROM laid b
  JOIN (SELECT doc_id, page, line, count(*) AS n FROM laid GROUP BY 1, 2, 3) s USING (doc_id, page, line)""")
# Two neighbouring words of each page as a model would spell them, and where their letters run in the page's words.
_NORMAL = "regexp_replace(lower(strip_accents({0})), '[' || chr(9) || chr(10) || chr(13) || ' \\-–—.,;:()\\[\\]{{}}/\\\\|+*°#''\"]', '', 'g')"
sql("normalized_words", [], f"""SELECT text, {_NORMAL.format('text')} AS normal FROM (
  SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS text FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) WHERE text <> ''""")
SPOKEN = f"""tok AS (SELECT doc_id, page, w, len(w) AS n FROM (SELECT doc_id, page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM pg)),
spoken AS (SELECT doc_id, page, 0 AS ord, lower(w[n - 2]) || ' - ' || lower(w[n - 1]) AS text FROM tok WHERE n > 2
  UNION ALL SELECT doc_id, page, 1, w[1] FROM tok WHERE n > 0 UNION ALL SELECT doc_id, page, ord + 2, text FROM found),
targets AS (SELECT doc_id, page, ord, {_NORMAL.format('text')} AS t FROM spoken)"""
RUNS = f"""nw AS (SELECT *, {_NORMAL.format('text')} AS norm FROM laid),
full_words AS (SELECT *, sum(len(norm)) OVER (PARTITION BY doc_id, page ORDER BY word_ord) - len(norm) AS s FROM nw WHERE norm <> ''),
whole AS (SELECT doc_id, page, string_agg(norm, '' ORDER BY word_ord) AS nn FROM full_words GROUP BY 1, 2),
starts AS (SELECT t.doc_id, t.page, t.ord, t.t, f.word_ord AS first_word, f.s + len(t.t) AS until FROM targets t JOIN whole USING (doc_id, page)
  JOIN full_words f ON f.doc_id = t.doc_id AND f.page = t.page AND f.norm[1] = t.t[1] WHERE t.t <> '' AND substring(nn, CAST(f.s AS BIGINT) + 1, len(t.t)) = t.t),
spans AS (SELECT a.doc_id, a.page, a.ord, a.first_word, f.word_ord AS last_word FROM starts a JOIN full_words f ON f.doc_id = a.doc_id AND f.page = a.page AND f.s < a.until AND f.s + len(f.norm) >= a.until),
lists AS (SELECT doc_id, page, ord, list({{'a': first_word, 'b': last_word}} ORDER BY first_word) AS c FROM spans GROUP BY 1, 2, 3),
going AS (SELECT doc_id, page, ord, c, CAST(1 AS BIGINT) AS i, c[:0] AS kept FROM lists
  UNION ALL SELECT doc_id, page, ord, c, i + 1, CASE WHEN len(kept) > 0 AND c[i].a <= kept[len(kept)].b THEN kept ELSE list_append(kept, c[i]) END FROM going WHERE i <= len(c)),
runs AS (SELECT doc_id, page, ord, CAST(k - 1 AS INTEGER) AS occurrence, CAST(kept[k].a AS INTEGER) AS first_word, CAST(kept[k].b AS INTEGER) AS last_word
  FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS k FROM going WHERE i = len(c) + 1)),
boxed AS (SELECT doc_id, page, ord, occurrence, CAST(row_number() OVER (PARTITION BY doc_id, page, ord, occurrence ORDER BY line) - 1 AS INTEGER) AS box, x0, y0, x1, y1 FROM (
  SELECT r.doc_id, r.page, ord, occurrence, line, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1
  FROM runs r JOIN laid l ON l.doc_id = r.doc_id AND l.page = r.page AND l.word_ord BETWEEN first_word AND last_word GROUP BY 1, 2, 3, 4, 5))"""
_RUN_CTES = [SPLIT_PAGES, found_ctes(False), LAID, SPOKEN, RUNS]
sql("locate_tolerant", _RUN_CTES, "SELECT doc_id, page, CAST(ord AS INTEGER) AS ord, occurrence, first_word, last_word FROM runs")
# Every literal occurrence in any case of each text in turn, then the runs of words that spell it; a place that is taken stays taken.
_TARGETS = f"targets AS (SELECT doc_id, page, ord, {_NORMAL.format('text')} AS t FROM ent)"
_OCCURRENCES = """texts AS (SELECT s.doc_id, s.page, s.ord, s.type, s.source, s.text AS needle, string_split(lower(pg.text), lower(s.text)) AS parts FROM ent s JOIN pg USING (doc_id, page)),
pieces AS (SELECT doc_id, page, ord, type, source, needle, unnest(range(1, len(parts) + 1)) AS k, unnest(list_transform(parts, lambda x: len(x))) AS n, len(parts) AS of FROM texts),
places AS (SELECT doc_id, page, ord, type, source, needle, s FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id, page, ord ORDER BY k) + (k - 1) * len(needle) AS BIGINT) AS s FROM pieces) WHERE k < of),
cut AS (SELECT doc_id, page, string_split_regex(text, '\\s+') AS w, list_append(regexp_extract_all(text, '\\s+'), '') AS gap FROM pg),
cutw AS (SELECT doc_id, page, unnest(w) AS word, unnest(list_transform(w, lambda x: len(x))) AS n, unnest(list_transform(gap, lambda x: len(x))) AS g, unnest(range(0, len(w))) AS k FROM cut),
worded AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS word_ord, a, a + n AS b FROM (
  SELECT *, CAST(coalesce(sum(n + g) OVER (PARTITION BY doc_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM cutw) WHERE word <> ''),
every AS (SELECT doc_id, page, 0 AS step, ord, s, s + len(needle) AS e, type, source FROM places
  UNION ALL SELECT doc_id, page, 1, ord, list_extract(a, first_word + 1), list_extract(b, last_word + 1), type, source FROM runs JOIN ent USING (doc_id, page, ord)
  JOIN (SELECT doc_id, page, list(a ORDER BY word_ord) AS a, list(b ORDER BY word_ord) AS b FROM worded GROUP BY 1, 2) USING (doc_id, page)),
of_one AS (SELECT doc_id, page, step, ord, list({'s': s, 'e': e, 't': type, 'o': source} ORDER BY s) AS items FROM every GROUP BY 1, 2, 3, 4),
lined AS (SELECT doc_id, page, list(items ORDER BY step, ord) AS c FROM of_one GROUP BY 1, 2),
taking AS (
  SELECT doc_id, page, c, CAST(1 AS BIGINT) AS i, c[1][:0] AS kept FROM lined
  UNION ALL SELECT doc_id, page, c, i + 1, list_concat(kept, list_filter(c[i], lambda x: len(list_filter(kept, lambda k: greatest(k.s, x.s) < least(k.e, x.e))) = 0)) FROM taking WHERE i <= len(c)),
occ AS (SELECT doc_id, page, e.t AS type, CAST(e.s AS INTEGER) AS start_offset, CAST(e.e AS INTEGER) AS end_offset, e.o AS source FROM (SELECT doc_id, page, unnest(kept) AS e FROM taking WHERE i = len(c) + 1))"""
sql("mask_occurrences", [DOC_PAGES, found_ctes(False), settled_ctes("found"), "ent AS (SELECT doc_id, page, ord, type, text, source FROM settled)", LAID, _TARGETS, RUNS, _OCCURRENCES, masked_ctes("occ")],
    "SELECT doc_id, CAST(n_entities AS BIGINT) AS occurrences_masked, masked_text FROM masked")
sql("mask_spelled", [SPLIT_PAGES, found_ctes(False), LAID, SPOKEN.partition("targets AS")[0] + "ent AS (SELECT *, 'NOMBRE' AS type, 'bedrock' AS source FROM spoken)", _TARGETS, RUNS, _OCCURRENCES, masked_ctes("occ")],
    "SELECT doc_id, page, CAST(n_entities AS BIGINT) AS occurrences_masked, masked_text FROM masked")
sql("boxes_per_line", _RUN_CTES, "SELECT doc_id, page, CAST(ord AS INTEGER) AS ord, occurrence, box, x0, y0, x1, y1 FROM boxed")
# In turn, a box goes if one that stayed shares half of the smaller of both.
KEEPING = """lined AS (SELECT doc_id, page, list({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY ord, occurrence, box) AS c FROM boxed GROUP BY 1, 2),
keeping AS (SELECT doc_id, page, c, CAST(1 AS BIGINT) AS i, c[:0] AS kept FROM lined
  UNION ALL SELECT doc_id, page, c, i + 1, CASE WHEN len(list_filter(kept, lambda k:
    greatest(0, least(c[i].x1, k.x1) - greatest(c[i].x0, k.x0)) * greatest(0, least(c[i].y1, k.y1) - greatest(c[i].y0, k.y0))
      >= 0.5 * least((c[i].x1 - c[i].x0) * (c[i].y1 - c[i].y0), (k.x1 - k.x0) * (k.y1 - k.y0)))) = 0 THEN list_append(kept, c[i]) ELSE kept END FROM keeping WHERE i <= len(c))"""
sql("dedup_boxes", [*_RUN_CTES, KEEPING], """SELECT doc_id, page, count(*) AS boxes, sum(k.x0) AS x0, sum(k.y1) AS y1 FROM (
  SELECT doc_id, page, unnest(kept) AS k FROM keeping WHERE i = len(c) + 1) GROUP BY 1, 2""")
STRAYS = """strays AS (SELECT doc_id, CAST(page + start_offset % 2 AS INTEGER) AS page, ord, start_offset, CASE WHEN start_offset % 7 = 0 THEN text || '@@' ELSE text END AS text FROM found)"""
# Brute force: every page of the document against every text, as it is and by its letters from a word's start.
ANYWHERE = f"""need AS (SELECT DISTINCT doc_id, text, {_NORMAL.format('text')} AS t FROM strays),
pw AS (SELECT doc_id, page, text, list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: {_NORMAL.format('x')}), lambda x: x <> '') AS w
  FROM pg WHERE doc_id IN (SELECT doc_id FROM strays)),
pn AS (SELECT doc_id, page, text, ' ' || array_to_string(w, ' ') AS joined FROM pw),
hits AS (SELECT n.doc_id, n.text, p.page FROM need n JOIN pn p USING (doc_id) WHERE contains(p.text, n.text)
  OR (n.t <> '' AND regexp_matches(p.joined, ' ' || array_to_string(list_transform(string_split(n.t, ''), lambda c: regexp_escape(c)), ' ?')))),
first_page AS (SELECT doc_id, text, min(page) AS found_page FROM hits GROUP BY 1, 2)"""
_STRAY = [SPLIT_PAGES, found_ctes(True), STRAYS, ANYWHERE]
sql("locate_any_page", _STRAY, "SELECT doc_id, page, ord, text, found_page FROM strays JOIN first_page USING (doc_id, text)")
sql("locate_cascade", _STRAY, """SELECT s.doc_id, s.page, start_offset || '/' || ord AS ord,
  CASE WHEN contains(p.text, s.text) THEN 'exact' WHEN h.page IS NOT NULL THEN 'tolerant' WHEN found_page IS NOT NULL THEN 'other_page' ELSE 'missing' END AS how,
  CASE WHEN h.page IS NOT NULL THEN s.page ELSE found_page END AS found_page
  FROM strays s LEFT JOIN pg p USING (doc_id, page) LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.page = s.page AND h.text = s.text LEFT JOIN first_page f ON f.doc_id = s.doc_id AND f.text = s.text""")
# Half a minute up is the binary value's, so seconds are rounded on 2^52 parts.
sql("display_texts", ["v AS (SELECT event_id, value, CASE WHEN value > 1 THEN CAST(floor(value * value * 10) AS BIGINT) END AS ms, CAST(floor(value * value * 997) AS BIGINT) AS size, CAST(round(value, 1) AS DECIMAL(12, 2)) AS n FROM events)"],
    """SELECT event_id, CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN ms || ' ms'
    WHEN ms < 60000 THEN (CAST(ms / 1000.0::DOUBLE * 4503599627370496 AS HUGEINT) * 20 + 4503599627370496) // 9007199254740992 // 10 || '.' || (CAST(ms / 1000.0::DOUBLE * 4503599627370496 AS HUGEINT) * 20 + 4503599627370496) // 9007199254740992 % 10 || ' s'
    ELSE ms // 60000 || 'm ' || (ms % 60000 + 500) // 1000 || 's' END AS took,
  CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN (size * 10 + 512) // 1024 // 10 || '.' || (size * 10 + 512) // 1024 % 10 || ' KB'
    ELSE (size * 100 + 524288) // 1048576 // 100 || '.' || lpad(CAST((size * 100 + 524288) // 1048576 % 100 AS VARCHAR), 2, '0') || ' MB' END AS size,
  greatest(0.0, least(1.0, value / 50)) AS clamped, CASE WHEN n % 1 = 0 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(CAST(n AS DOUBLE) AS VARCHAR) END AS compact FROM v""")

# Strays that are on no page of their own: masked on the first page that has them; a place is masked once.
sql("mask_strays", [SPLIT_PAGES, found_ctes(False), "strays AS (SELECT doc_id, CAST(page + start_offset % 2 AS INTEGER) AS page, ord, start_offset, text FROM found)", ANYWHERE,
    """homes AS (SELECT DISTINCT s.doc_id, s.text, CASE WHEN h.page IS NOT NULL THEN s.page ELSE f.found_page END AS page FROM strays s
  LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.page = s.page AND h.text = s.text LEFT JOIN first_page f ON f.doc_id = s.doc_id AND f.text = s.text),
cuts AS (SELECT h.doc_id, h.page, h.text, unnest(range(1, len(p) + 1)) AS k, unnest(list_transform(p, lambda x: len(x))) AS n, len(p) AS of FROM (
  SELECT homes.doc_id, homes.page, homes.text, string_split(pg.text, homes.text) AS p FROM homes JOIN pg USING (doc_id, page)) h),
spots AS (SELECT doc_id, page, sum(n) OVER (PARTITION BY doc_id, page, text ORDER BY k) + (k - 1) * len(text) AS s, len(text) AS n, k, of FROM cuts),
marks AS (SELECT doc_id, page, s, s + n AS e, max(s + n) OVER (PARTITION BY doc_id, page ORDER BY s, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spots WHERE k < of)"""],
    """SELECT doc_id, page, count(m) AS occurrences_masked FROM pg LEFT JOIN (SELECT doc_id, page, 1 AS m FROM marks WHERE before IS NULL OR s >= before) USING (doc_id, page) GROUP BY 1, 2""")
ORACLE["completed_status"] = ORACLE["mask_documents"].replace("SELECT doc_id, n_entities, masked_text FROM masked",
    "SELECT user_id, CAST(doc_id AS VARCHAR) AS document_id, 'COMPLETED' AS status, CAST(n_entities AS BIGINT) AS entities_found, "
    "CASE WHEN n_entities > 0 THEN 'Regex' ELSE 'IA (Claude Haiku 4.5)' END AS engine, TIMESTAMP '2024-02-01' AS completed_at FROM masked")
sql("stored_entities", [SPLIT_PAGES, found_ctes(False), settled_ctes("found")], "SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, type, start_offset, end_offset, text, source, confidence FROM settled")
ORACLE["stored_reports"] = "SELECT r.*, d.source AS user_id FROM (" + ORACLE["report_sections"] + ") r JOIN documents d USING (doc_id)"

# ---------------------------------------------------------------- settings

_PROMPT = _str(K.DEFAULT_PROMPT)
sql("resolved_config", [USERS, CONFIG], f"""SELECT user_id, coalesce(method, 'both') AS method, coalesce(residual_scan, false) AS residual_scan, true AS alerts, {_str(K.DEFAULT_MODEL_ID)} AS model_id,
  coalesce(temperature, 0.0) AS temperature, CAST(len(coalesce(prompt, {_PROMPT})) AS INTEGER) AS prompt_length, CAST({len(K.DEFAULT_RULES)} AS INTEGER) AS n_rules, CAST(coalesce(len(ignored), 0) AS INTEGER) AS n_ignored
  FROM users LEFT JOIN cfg USING (user_id)""")
sql("documents_with_config", [CONFIG], "SELECT doc_id, source AS user_id, coalesce(method, 'both') AS method, coalesce(residual_scan, false) AS residual_scan, coalesce(temperature, 0.0) AS temperature FROM documents LEFT JOIN cfg ON user_id = source")
sql("default_config", [USERS], "SELECT user_id, 'both' AS method, type, pattern, enabled FROM users, (VALUES " +
    ", ".join(f"({_str(t)}, {_str(p)}, {str(e).lower()})" for t, p, e in K.DEFAULT_RULES) + ") r(type, pattern, enabled)")
sql("added_rules", [USERS, CONFIG, f"p AS (SELECT user_id, coalesce(prompt, {_PROMPT}) AS p FROM users LEFT JOIN cfg USING (user_id))"],
    f"""SELECT user_id, CAST({len(K.DEFAULT_RULES) + 1} AS INTEGER) AS n_rules, 'LEGAJO' AS last,
  md5(substring(p, 1, instr(p, 'INSTRUCCIONES:') - 1) || '- LEGAJO: número de legajo' || chr(10) || chr(10) || substring(p, instr(p, 'INSTRUCCIONES:'))) AS prompt FROM p""")
sql("config_problems", [], """SELECT doc_id, m = '' AS valid, m AS message FROM (SELECT doc_id, CASE
  WHEN n % 43 = 0 THEN 'unknown_method' WHEN n % 47 = 0 THEN 'residual_scan_not_boolean' WHEN n % 53 = 0 THEN 'alerts_not_boolean' WHEN n % 59 = 0 THEN 'model_missing'
  WHEN n % 61 = 0 THEN 'temperature_not_a_number' WHEN n % 67 = 0 OR n % 71 = 0 THEN 'temperature_out_of_range' WHEN n % 13 = 0 THEN 'prompt_blank'
  WHEN n % 17 = 0 THEN 'prompt_without_slot' WHEN n % 19 = 0 THEN 'prompt_too_long' WHEN n % 73 = 0 THEN 'too_many_rules'
  WHEN n % 23 = 0 THEN 'rule_without_type' WHEN n % 29 = 0 THEN 'pattern_does_not_compile' WHEN n % 31 = 0 THEN 'pattern_too_long' WHEN n % 37 = 0 THEN 'rule_without_pattern'
  WHEN n % 41 = 0 AND n % 2 <> 0 THEN 'no_active_rule' WHEN n % 83 = 0 THEN 'too_many_ignored' WHEN n % 79 = 0 THEN 'ignored_too_long' ELSE '' END AS m FROM (SELECT doc_id, n_chars AS n FROM documents))""")
sql("residual_users", [CONFIG], "SELECT user_id FROM cfg WHERE residual_scan")

# ---------------------------------------------------------------- intake

sql("file_events", [FILES], """SELECT doc_id, CASE WHEN r THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE 'docs' END AS bucket, CASE WHEN r THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE key END AS key,
  CASE WHEN r THEN 0 ELSE size END AS size, CASE WHEN r THEN 'no_records' WHEN doc_id % 11 = 0 THEN 'no_bucket' WHEN doc_id % 13 = 0 THEN 'no_key' END AS error_reason FROM (SELECT *, doc_id % 17 = 0 AS r FROM files)""")
sql("object_keys", [FILES], """SELECT doc_id, key, CASE WHEN e IS NULL THEN source END AS user_id, CASE WHEN e IS NULL THEN f END AS file_name, CASE WHEN e IS NULL THEN f END AS document_id, e AS error_reason FROM (
  SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN 'originales/solo.pdf' WHEN 1 THEN 'originales//x.pdf' WHEN 2 THEN 'originales/' || source || '/' WHEN 3 THEN 'originales/' || source || '/sub/' || name ELSE key END AS key,
    CASE doc_id % 7 WHEN 3 THEN 'sub/' || name ELSE name END AS f,
    CASE doc_id % 7 WHEN 0 THEN 'wrong_pattern' WHEN 1 THEN 'no_user' WHEN 2 THEN 'no_file' WHEN 3 THEN NULL ELSE CASE WHEN root <> 'originales' THEN 'wrong_prefix' END END AS e FROM files)""")
sql("url_keys", [], r"""SELECT page_id, regexp_replace(url, '[^/]*$', '') AS parent, CASE WHEN url LIKE '%/' THEN url ELSE regexp_extract(url, '[^/]*$') END AS name, 'originales/u1/' AS scoped, left(regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g'), 64) AS safe FROM pages""")
CHECKED = """chk AS (SELECT doc_id, source, n_chars * 65536 AS length, CASE WHEN n_chars * 65536 >= 524288000 THEN 'too_large: ' || format('{:.1f}', n_chars / 16.0) || 'MB (max 500MB)' WHEN lang <> 'en' THEN 'no_pdf_header' END AS error_reason FROM documents)"""
sql("validated_files", [CHECKED], "SELECT doc_id, length, error_reason FROM chk")
sql("quarantine", [CHECKED], """SELECT CASE WHEN error_reason IS NOT NULL THEN 'errores/' || source || '/' || doc_id || '/' || doc_id END AS error_key, error_reason, CAST(doc_id AS VARCHAR) AS original_filename,
  'originales/' || source || '/' || doc_id AS original_key, error_reason IS NULL AS kept FROM chk""")
sql("upload_batches", [FILES], """SELECT doc_id, source || '/' || root AS batch_id, CASE WHEN count(*) OVER (PARTITION BY source, root) > 30 THEN 'too_many_files' WHEN doc_id % 9 = 0 THEN 'no_name'
  WHEN name LIKE '%.md' THEN 'not_a_pdf' WHEN size // 4 > 52428800 THEN 'too_large' END AS error_reason FROM files""")
sql("scoped_prefixes", [FILES], """SELECT doc_id, asked, CASE doc_id % 6 WHEN 0 THEN 'originales/' || source || '/' WHEN 1 THEN root || '/' || source || '/' WHEN 2 THEN key WHEN 3 THEN 'originales/' || source || '/'
  WHEN 4 THEN CASE WHEN source = 'ajeno' THEN asked END ELSE key END AS scoped, doc_id % 6 = 5 AS owned FROM (
  SELECT *, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN root || '/' WHEN 2 THEN '/' || key WHEN 3 THEN 'otros/x/' WHEN 4 THEN 'ofuscados/ajeno/' || name ELSE key END AS asked FROM files)""")
REPROCESS = """req AS (SELECT doc_id, k AS key, CASE WHEN doc_id % 5 > 1 THEN size END AS size, CASE WHEN k NOT LIKE 'originales/%' THEN 'not_an_original' WHEN doc_id % 5 = 1 THEN 'not_owned' WHEN doc_id % 5 = 0 THEN 'no_longer_exists' END AS reason
  FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN key || '.gone' WHEN 1 THEN 'originales/ajeno/' || name ELSE key END AS k FROM files))"""
sql("reprocess_requests", [FILES, REPROCESS], "SELECT doc_id, key, size, reason, reason IS NULL AS queued FROM req")
sql("named_files", [FILES], "SELECT key, name, size FROM files WHERE name LIKE 'Doc 1%' AND name LIKE '%.pdf'")

# ---------------------------------------------------------------- status

EVENTS = """ev AS (SELECT user_id, 'doc-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 10) AS document_id, ts, event_id AS seq, event_type AS kind, value FROM events),
se AS (SELECT user_id, document_id, ts, seq, kind, kind IN ('signup', 'view') AS put, value,
    CASE kind WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status FROM ev),
lastput AS (SELECT user_id, document_id, max((ts, seq)) AS p FROM se WHERE put GROUP BY 1, 2),
live AS (SELECT se.*, row_number() OVER (PARTITION BY se.user_id, se.document_id ORDER BY ts DESC, seq DESC) AS newest FROM se LEFT JOIN lastput l ON l.user_id = se.user_id AND l.document_id = se.document_id WHERE p IS NULL OR (ts, seq) >= p)"""


def _last(value: str, where: str) -> str:
    return f"arg_max({value}, (ts, seq)) FILTER ({where})"


_DONE, _FAIL, _PUT = "kind = 'purchase'", "kind = 'error'", "put"
STATUS = f"""st AS (SELECT user_id, document_id,
  {_last("document_id || '.pdf'", _PUT)} AS file_name, {_last('CAST(floor(value * 100) AS BIGINT)', _PUT)} AS file_size, {_last("'originales/' || user_id || '/' || document_id || '.pdf'", _PUT)} AS key_original,
  {_last("CASE WHEN value >= 5 THEN 'ofuscados/' || user_id || '/' || document_id || '_ofuscado.pdf' ELSE '' END", _DONE)} AS key_masked,
  {_last("CASE WHEN value >= 5 THEN 'ofuscados/' || user_id || '/' || document_id || '_informe.md' ELSE '' END", _DONE)} AS key_report,
  {_last('status', 'status IS NOT NULL')} AS status, {_last("'could not mask'", _FAIL)} AS error_message, {_last("'REDACTION'", _FAIL)} AS error_step,
  {_last('CAST(floor(value) AS BIGINT)', _DONE)} AS entities_found, {_last('CAST(floor(value * 1000) AS BIGINT)', f'{_DONE} OR {_FAIL}')} AS processing_ms,
  {_last('ts', _PUT)} AS uploaded_at, {_last('ts', f'{_DONE} OR {_FAIL}')} AS completed_at, {_last("CASE kind WHEN 'click' THEN 'Regex' ELSE 'IA + Regex' END", f"kind = 'click' OR {_DONE}")} AS engine,
  {_last("'DISABLED'", _DONE)} AS scan_status, {_last("'STATUS#' || status || '#TIMESTAMP#' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", f'put OR {_FAIL}')} AS index_key
  FROM live GROUP BY 1, 2)"""
_ST = [EVENTS, STATUS]
sql("latest_status", _ST, "SELECT * FROM st")
ORACLE["stored_status_update"] = ORACLE["latest_status"]
_STATE = "CASE upper(coalesce({0}, '')) WHEN 'COMPLETED' THEN 'COMPLETED' WHEN 'FAILED' THEN 'FAILED' WHEN 'ERROR' THEN 'FAILED' WHEN 'PROCESSING' THEN 'PROCESSING' ELSE 'PENDING' END"
_MASKED = "CASE {0} WHEN 'COMPLETED' THEN CASE WHEN coalesce(key_masked, '') = '' AND coalesce(entities_found = 0, false) THEN 'NONE' ELSE 'CREATED' END WHEN 'FAILED' THEN 'NONE' WHEN 'PROCESSING' THEN 'CREATING' ELSE 'PENDING' END"
TRACKED = f"""tr AS (SELECT r.user_id, r.document_id, coalesce(s.state, 'PENDING') AS state, CASE WHEN s.state IS NOT NULL THEN {_MASKED.format('s.state')} END AS masked_state, entities_found, s.state IS NOT NULL AS known
  FROM (SELECT DISTINCT user_id, 'doc-' || json_extract_string(props, '$.k') AS document_id FROM events) r LEFT JOIN (SELECT *, {_STATE.format('status')} AS state FROM st) s USING (user_id, document_id))"""
sql("tracked_documents", [*_ST, TRACKED], "SELECT * FROM tr")
sql("progress", [*_ST, TRACKED], """SELECT user_id, f AS finished, n AS total, CAST(floor(f * 100.0 / n + 0.5) AS BIGINT) AS percent FROM (
  SELECT user_id, count(*) FILTER (state IN ('COMPLETED', 'FAILED')) AS f, count(*) AS n FROM tr GROUP BY 1)""")
sql("all_terminal", [*_ST, TRACKED], "SELECT user_id, bool_and(known AND state IN ('COMPLETED', 'FAILED')) AS all_terminal FROM tr GROUP BY 1")
sql("batch_outcome", [FILES, REPROCESS], "SELECT string_split(key, '/')[1] AS folder, count(*) FILTER (reason IS NULL) AS successes, count(reason) AS failures, count(DISTINCT reason) AS reasons FROM req GROUP BY 1")
sql("failure_reasons", [FILES, REPROCESS], "SELECT DISTINCT reason FROM req WHERE reason IS NOT NULL")
sql("listed_documents", _ST, "SELECT document_id, status, uploaded_at FROM st WHERE user_id = 8 ORDER BY uploaded_at DESC NULLS LAST, document_id DESC LIMIT 100")
sql("listed_by_index", _ST, "SELECT document_id, status, index_key FROM st WHERE user_id = 8 ORDER BY index_key DESC NULLS LAST, document_id DESC LIMIT 5")
sql("next_page", [], """SELECT * FROM (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders) WHERE o_orderdate < TIMESTAMP '1997-05-28' OR (o_orderdate = TIMESTAMP '1997-05-28' AND o_orderkey < 1) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
sql("third_page", [], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
sql("page_count", [FILES], "SELECT count(*) AS rows, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM files WHERE contains(name, '1')")
sql("sorted_files", [FILES], "SELECT key, size, modified FROM files ORDER BY size DESC, key")
sql("one_document", _ST, "SELECT user_id, document_id, status, entities_found FROM st WHERE user_id = 8 AND document_id = 'doc-3'")
sql("downloads", _ST, """SELECT user_id, document_id, key_masked AS key, 'pdf' AS kind FROM st WHERE status = 'COMPLETED' AND key_masked <> '' AND key_masked NOT LIKE '%3_ofuscado.pdf'
  UNION ALL SELECT user_id, document_id, key_report, 'markdown' FROM st WHERE status = 'COMPLETED' AND key_report <> ''""")
sql("purge_counts", [FILES], "SELECT root AS folder, count(*) AS deleted FROM files WHERE root <> 'errores' GROUP BY 1")
sql("purged_files", [FILES], "SELECT key, CASE WHEN source = 'src3' AND root IN ('procesamiento', 'ofuscados') THEN 'gone' ELSE 'kept' END AS state FROM files")
sql("purged_audit", _ST, "SELECT CASE WHEN user_id = 8 THEN -1 ELSE user_id END AS user_id, count(*) AS rows FROM st GROUP BY 1")
sql("deleted_document", _ST, """SELECT user_id || '/' || document_id AS what FROM st WHERE NOT (user_id = 8 AND document_id = 'doc-3')
  UNION ALL SELECT k FROM (SELECT user_id, document_id, unnest([key_original, key_masked, key_report]) AS k FROM st) WHERE k <> '' AND NOT (user_id = 8 AND document_id = 'doc-3')""")
sql("retention", [FILES], "SELECT key, modified FROM files WHERE root NOT IN ('procesamiento', 'errores') OR TIMESTAMP '2024-02-01' - modified <= INTERVAL 30 DAYS")

# ---------------------------------------------------------------- observation

BAD = """bad AS (SELECT event_id, user_id, ts, value, CASE WHEN value < 20 THEN 'DETECTION' ELSE 'REDACTION' END AS step FROM events WHERE event_type = 'error')"""
sql("dead_letters", [BAD], """SELECT 'doc-' || event_id AS document_id, step AS error_step, ts, CAST(least(2048, len(repeat('failed at ' || event_id || ' ', 200))) AS INTEGER) AS length, step, CAST(user_id AS VARCHAR) AS user_id FROM bad""")
sql("metric_points", [BAD], """SELECT ts, name, dim, dim_value, 1.0::DOUBLE AS value, 'Count' AS unit FROM (
  SELECT ts, 'PipelineError' AS name, 'ErrorStep' AS dim, step AS dim_value FROM bad WHERE value < 20
  UNION ALL SELECT ts, 'ServiceInvocationError', 'ServiceName', CASE WHEN value >= 30 THEN 'recognition' ELSE 'scanner' END FROM bad WHERE value >= 20
  UNION ALL SELECT ts, 'ServiceInvocationError', 'ErrorType', 'Throttled' FROM bad WHERE value >= 40)""")
sql("error_alarms", [], """SELECT window_start, name, round(t, 4) AS total, t > CASE name WHEN 'error' THEN 60 WHEN 'view' THEN 100 ELSE 5 END AS breaching FROM (
  SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS name, sum(value) AS t FROM events GROUP BY 1, 2)""")
sql("latency_p99", [], """SELECT window_start, name, round(p, 6) AS p99, p > 100 AS breaching FROM (
  SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type AS name, quantile_cont(value, 0.99) AS p FROM events GROUP BY 1, 2)""")
FINDINGS = """fi AS (SELECT 'f-' || doc_id AS id, source, root, key, name, CASE WHEN size < 50000000 THEN 'Baja' WHEN size < 200000000 THEN 'Media' WHEN size < 400000000 THEN 'Alta' WHEN size < 500000000 THEN '—' ELSE 'Critical' END AS severity,
  size // 65536 AS count, CASE root WHEN 'originales' THEN 'ORIGINALES' WHEN 'ofuscados' THEN 'OFUSCADOS' END AS scope, modified AS updated_at, name LIKE '%.pdf' AS own FROM files)"""
sql("scoped_findings", [FILES, FINDINGS], "SELECT id, scope, severity, count, key FROM fi WHERE own AND scope IS NOT NULL")
sql("top_findings", [FILES, FINDINGS], "SELECT id, scope, severity, updated_at FROM fi WHERE own AND scope IS NOT NULL AND source = 'src1' ORDER BY updated_at DESC, id LIMIT 50")
sql("finding_summary", [FILES, FINDINGS], "SELECT count(*) AS findings, count(*) > 0 AS residual FROM fi WHERE scope IS NOT NULL AND source = 'src1'")

# ---------------------------------------------------------------- scalar functions

sql("folded_lines", [], r"""SELECT doc_id, CAST(n AS INTEGER) AS line, md5(replace(lower(regexp_replace(l[n + 1], '^\s+|\s+$', '', 'g')), 'ß', 'ss')) AS folded
  FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
sql("identities", [], """SELECT event_id, CASE event_type WHEN 'view' THEN 'user' || user_id WHEN 'click' THEN 'u.' || user_id ELSE CASE user_id % 3 WHEN 0 THEN 'sub-' || user_id WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE 'p' || user_id END END AS owner,
  left(sha256('sub-' || user_id), 8) AS session FROM events""")
sql("model_labels", [], r"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'Claude Haiku 4.5' WHEN 2 THEN o_orderpriority ELSE
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Claude 1 Urgent 5' WHEN '2-HIGH' THEN 'Claude 2 High 5' WHEN '3-MEDIUM' THEN 'Claude 3 Medium 5' WHEN '4-NOT SPECIFIED' THEN 'Claude 4 Notspecified 5' WHEN '5-LOW' THEN 'Claude 5 Low 5' END END AS label FROM orders""")
sql("text_cuts", [], "SELECT doc_id, " + ", ".join(f"md5(left(text, {n})) AS cut_{n}" for n in (100, 1000, 1024, 2048)) + " FROM documents")
sql("bucket_accounts", [FILES], "SELECT 'f-' || doc_id AS id, CASE WHEN name LIKE '%.md' THEN '' ELSE '123' END AS account, left(regexp_replace(key, '[^A-Za-z0-9_-]', '-', 'g'), 64) AS job FROM files")
sql("status_labels", [*_ST, f"sh AS (SELECT *, {_STATE.format('status')} AS state FROM st)"], f"""SELECT user_id, document_id, state, {_MASKED.format('state')} AS masked,
  CASE status WHEN 'COMPLETED' THEN 'Éxito' WHEN 'FAILED' THEN 'Error' WHEN 'PROCESSING' THEN 'En proceso' WHEN 'UPLOADED' THEN 'En proceso' ELSE '—' END AS result, coalesce(completed_at, uploaded_at) AS at FROM sh""")

# ---------------------------------------------------------------- streams

# Windows close when the newest event is ten minutes past their end.
sql("stream_alarms", [], """SELECT window_start, name, round(t, 4) AS total FROM (
  SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS name, sum(value) AS t FROM events GROUP BY 1, 2)
  WHERE t > CASE name WHEN 'purchase' THEN 30 WHEN 'error' THEN 90 ELSE 60 END AND window_start + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
# A document's timer runs a day past its last event and fires once the watermark (a minute behind) has passed it.
sql("stream_stuck", [], """SELECT CAST(user_id AS VARCHAR) AS user_id, document_id, status, date_trunc('milliseconds', ts) AS since FROM (
  SELECT user_id, 'doc-' || json_extract_string(props, '$.k') AS document_id, arg_max(CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END, (ts, event_id)) AS status, max(ts) AS ts
  FROM events GROUP BY 1, 2) WHERE status = 'PROCESSING' AND ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
sql("stream_deduplicated", [], "SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS document_id FROM events")
ORACLE["stream_last_status"] = ORACLE["latest_status"]
ORACLE["stored_status_buckets"] = ORACLE["latest_status"]
ORACLE["stream_sinks"] = ORACLE["stream_masked"]
sql("stream_arrivals", [], "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
sql("stream_latency", [], """SELECT window_start, name, p99 FROM (
  SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type AS name, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1, 2)
  WHERE p99 > 60 AND window_start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
sql("saved_config", [], """SELECT user_id, CASE WHEN length(user_id) % 2 = 0 THEN 'regex' ELSE 'ai' END AS method, CASE WHEN length(user_id) % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS temperature,
  CAST(1 AS INTEGER) AS n_rules, user_id AS ignored FROM (SELECT DISTINCT source AS user_id FROM documents UNION ALL SELECT DISTINCT role FROM conversations)""")
sql("stored_recognition", [], "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations")
sql("listed_files", [], """SELECT CAST(item_id AS VARCHAR) AS item, true AS json, CAST(length('{"documentId":"","totalPages":1}') + length(CAST(item_id AS VARCHAR)) + 1 AS BIGINT) AS size FROM benchmark WHERE item_id IS NOT NULL""")
