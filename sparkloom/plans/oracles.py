"""DuckDB SQL with the rows of the queries in `queries`."""

from __future__ import annotations

from ..sources.languages import LANGUAGES

LINES = r"""lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
chunks AS (SELECT doc_id * 1000000 + pos AS chunk_id, source || '/' || doc_id || '.' || lang AS file_path, CAST(pos AS INTEGER) AS start_line, lang, source,
  'Doc' || doc_id || '.' || regexp_extract(text, '[A-Za-z]+', 0) AS symbol_path,
  CASE lang WHEN 'en' THEN 'function' WHEN 'fr' THEN 'method' WHEN 'de' THEN 'type' ELSE 'other' END AS kind, text FROM lines WHERE text <> '')"""
EMBEDDED = "embedded AS (SELECT vec_id * 1000000 AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qv AS (SELECT v AS q FROM embedded WHERE chunk_id = 0)"
FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS file_path, sha256(text)[1:32] AS content_hash, strlen(text) AS file_size, lang, n_chars FROM documents)"
INDEX = """idx AS (SELECT file_path, CASE WHEN n_chars > 2000 THEN reverse(content_hash) ELSE content_hash END AS content_hash, file_size,
  n_chars % 2 = 0 AS ts_indexed, n_chars % 3 = 0 AS lsp_indexed, n_chars % 5 = 0 AS embedded FROM files WHERE lang <> 'es'
  UNION ALL SELECT 'gone/' || page_id || '.html', sha256(html)[1:32], strlen(html), true, true, false FROM pages)"""
CODE = """code AS (SELECT p_partkey AS chunk_id, 'src/n' || (p_partkey % 25) || '.py' AS file_path, CAST(p_partkey // 25 AS INTEGER) AS start_line, CAST(p_partkey // 25 + p_size AS INTEGER) AS end_line,
  replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS symbol_path, ['function', 'method', 'type', 'other'][p_size % 4 + 1] AS kind, p_type || ' ' || p_name AS text FROM part)"""
SYMBOLS = """symbols AS (SELECT c_custkey AS symbol_id, replace(c_name, '#', '_') AS name, ['function', 'class', 'method', 'struct', 'variable'][c_custkey % 5 + 1] AS kind,
  'src/n' || c_nationkey || '.py' AS file_path, CAST(c_custkey // 15 AS INTEGER) AS start_line, 4 AS start_column, CAST(c_custkey // 15 + 3 AS INTEGER) AS end_line, 0 AS end_column,
  CASE WHEN c_acctbal > 0 THEN 'fn ' || lower(c_mktsegment) END AS detail FROM customer)"""
EDGES = """edges AS (SELECT o_orderkey AS edge_id, o_custkey AS caller_id, (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS callee_id, 'src/n' || c_nationkey || '.py' AS file_path,
  CASE o_orderstatus WHEN 'F' THEN 'treesitter' ELSE 'lsp' END AS source, CAST(o_orderkey % 100 AS INTEGER) AS site FROM orders JOIN customer ON o_custkey = c_custkey)"""
POSITIONS = """positions AS (SELECT o_orderkey AS query_id, 'src/n' || (o_custkey % 25) || '.py' AS file_path, CAST(o_orderkey % 60 AS INTEGER) AS line, o_orderstatus FROM orders),
live AS (SELECT query_id, file_path, line AS start_line, line AS end_line, 'live' AS symbol, 'live ' || query_id AS contents FROM positions WHERE o_orderstatus = 'P')"""
EVENTS = """ev AS (SELECT event_id AS seq, ts, 'u' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'removed' ELSE 'modified' END AS kind FROM events)"""
DIAG = """diag AS (SELECT event_id AS diag_id, 'src/n' || (user_id % 25) || '.py' AS uri, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS severity, 'm' || event_id AS message FROM events)"""
MERGED = f"""{CODE}, {SYMBOLS},
c1 AS (SELECT * FROM code QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY chunk_id DESC) = 1),
s1 AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY symbol_id DESC) = 1),
merged AS (SELECT coalesce(c.file_path, s.file_path) AS file_path, coalesce(c.start_line, s.start_line) AS start_line, coalesce(c.end_line, s.end_line) AS end_line, coalesce(s.start_column, 0) AS start_column,
  coalesce(s.name, split_part(c.symbol_path, '.', -1)) AS name, coalesce(c.symbol_path, s.name) AS qualified_path,
  CASE coalesce(s.kind, c.kind) WHEN 'function' THEN 'function' WHEN 'method' THEN 'method' WHEN 'class' THEN 'type' WHEN 'struct' THEN 'type' WHEN 'type' THEN 'type' ELSE 'other' END AS meta,
  s.detail, c.text, CASE WHEN c.chunk_id IS NOT NULL AND s.symbol_id IS NOT NULL THEN 'merged' WHEN c.chunk_id IS NOT NULL THEN 'treesitter' ELSE 'lsp' END AS source
  FROM c1 c FULL JOIN s1 s ON c.file_path = s.file_path AND c.start_line = s.start_line)"""
ENCLOSED = f"""{CODE}, {SYMBOLS}, {POSITIONS},
es AS (SELECT p.query_id, s.* FROM positions p JOIN symbols s ON p.file_path = s.file_path AND p.line BETWEEN s.start_line AND s.end_line
  QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY s.end_line - s.start_line, s.symbol_id) = 1),
ec AS (SELECT p.query_id, c.* FROM positions p JOIN code c ON p.file_path = c.file_path AND p.line BETWEEN c.start_line AND c.end_line
  QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY c.end_line - c.start_line, c.chunk_id) = 1)"""


def _tokens(t: str) -> str:
    return (
        rf"list_filter(list_concat(regexp_split_to_array(lower(regexp_replace({t}, '(\p{{Ll}}|\p{{N}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), "
        rf"list_transform(list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}]+'), lambda w: regexp_matches(w, '(\p{{Ll}}|\p{{N}})\p{{Lu}}')), lambda w: lower(w))), lambda w: w <> '')"
    )


def _bm25(terms: list[str]) -> str:
    f = [f"len(list_filter(b, lambda w: w = '{q}')) + 5 * len(list_filter(s, lambda w: w = '{q}')) AS f{k}" for k, q in enumerate(terms)]
    d = [f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(terms))]
    score = " + ".join(f"ln(1 + (docs - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(len(terms)))
    return f"""tok AS (SELECT chunk_id, {_tokens('text')} AS b, {_tokens('symbol_path')} AS s FROM chunks),
tf AS (SELECT chunk_id, len(b) + len(s) AS n, {', '.join(f)} FROM tok),
st AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(d)} FROM tf),
bm AS (SELECT chunk_id, {score} AS bm25 FROM tf, st WHERE {' OR '.join(f'f{k} > 0' for k in range(len(terms)))})"""


def _dice(t: str, grams: list[str]) -> str:
    both = " + ".join(f"CAST(contains(lower({t}), '{g}') AS INTEGER)" for g in grams)
    return f"CASE WHEN {both} > 0 THEN 2.0::DOUBLE * ({both}) / (len(list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substring(lower({t}), i, 3)))) + {len(grams)}) ELSE 0 END"


def _trigram(grams: list[str]) -> str:
    return f"tr AS (SELECT * FROM (SELECT chunk_id, 5 * ({_dice('symbol_path', grams)}) + ({_dice('text', grams)}) AS trigram FROM chunks) WHERE trigram > 0)"


def _fuzzy(source: str, text: str, query: str, name: str) -> str:
    """A subquery of `source` with the fuzzy score as a further column, folded over the query's characters."""
    chars = ", ".join(f"{{'c': '{c}', 'k': 0::BIGINT, 's': 0::BIGINT}}" for c in query.lower())
    p = f"strpos(substr(lower({text}), a.k + 1), x.c)"
    more = rf"CASE WHEN a.k > 0 AND {p} = 1 THEN 15 ELSE 0 END + CASE WHEN a.k + {p} = 1 OR NOT regexp_matches(substr(lower({text}), a.k + {p} - 1, 1), '[\p{{L}}\p{{N}}]') THEN 10 ELSE 0 END"
    step = f"lambda a, x: {{'c': '', 'k': CASE WHEN a.k IS NOT NULL AND {p} > 0 THEN a.k + {p} END, 's': CAST(a.s + 10 + {more} AS BIGINT)}}"
    fold = f"list_reduce([{chars}], {step}, {{'c': '', 'k': 0::BIGINT, 's': 0::BIGINT}})"
    return f"(SELECT * EXCLUDE (fold_), CASE WHEN fold_.k IS NOT NULL THEN fold_.s END AS {name} FROM (SELECT *, {fold} AS fold_ FROM {source}))"


def _get(query: str) -> str:
    f = _fuzzy("merged", "qualified_path", query, "fz")
    low = query.lower()
    return f"""WITH {MERGED},
t AS (SELECT *, CASE WHEN qualified_path = '{query}' THEN 0 WHEN ends_with(qualified_path, '.{query}') THEN 1 WHEN contains(lower(qualified_path), '{low}') THEN 2 WHEN fz IS NOT NULL THEN 3 END AS tier_,
  greatest(0, 100 - length(qualified_path)) AS bonus FROM {f}),
b AS (SELECT * FROM t WHERE tier_ = (SELECT min(tier_) FROM t))
SELECT file_path, start_line, name, qualified_path, CAST(CASE tier_ WHEN 0 THEN 1000 WHEN 1 THEN 900 + bonus WHEN 2 THEN 800 + bonus ELSE fz END AS INTEGER) AS score, ['exact', 'suffix', 'caseInsensitive', 'fuzzy'][tier_ + 1] AS tier
FROM b ORDER BY score DESC, file_path, start_line LIMIT 50"""


TERMS = ["license", "version"]
GRAMS = ["lic", "ice", "cen", "ens", "nse", "se ", "e v", " ve", "ver", "ers", "rsi", "sio", "ion"]
_COS = "co AS (SELECT chunk_id, list_inner_product(v, q) AS cosine FROM embedded, qv)"
_FUSE = f"""WITH {LINES}, {EMBEDDED}, {_bm25(TERMS)}, {_trigram(GRAMS)}, {_COS},
ra AS (SELECT *, row_number() OVER (ORDER BY round(bm25, 9) DESC, chunk_id) AS r FROM bm),
rb AS (SELECT *, row_number() OVER (ORDER BY round(trigram, 9) DESC, chunk_id) AS r FROM tr),
rc AS (SELECT *, row_number() OVER (ORDER BY round(cosine, 9) DESC, chunk_id) AS r FROM co),
al AS (SELECT chunk_id, 1.0::DOUBLE / (60 + r) AS share, bm25, NULL::DOUBLE AS trigram, NULL::DOUBLE AS cosine FROM ra UNION ALL SELECT chunk_id, 1.0::DOUBLE / (60 + r), NULL, trigram, NULL FROM rb UNION ALL SELECT chunk_id, 1.0::DOUBLE / (60 + r), NULL, NULL, cosine FROM rc),
fu AS (SELECT chunk_id, sum(share) / (3.0::DOUBLE / 61) AS score, coalesce(max(bm25), 0) AS bm25, coalesce(max(trigram), 0) AS trigram, coalesce(max(cosine), 0) AS cosine FROM al GROUP BY chunk_id),
top AS (SELECT * FROM fu ORDER BY round(score, 9) DESC, chunk_id LIMIT 20)"""
_WALK = """walk AS (SELECT symbol_id AS node_id, 0 AS depth FROM root UNION SELECT s.to_id, w.depth + 1 FROM walk w JOIN step s ON s.from_id = w.node_id WHERE w.depth < {n}),
near AS (SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id)"""
_OUT, _IN = "SELECT DISTINCT caller_id AS from_id, callee_id AS to_id FROM edges", "SELECT DISTINCT callee_id AS from_id, caller_id AS to_id FROM edges"


def _graph(step: str, root: str, way: list[str]) -> str:
    sides = {"outbound": "caller_id", "inbound": "callee_id"}
    parts = " UNION ALL ".join(f"SELECT edge_id, caller_id, callee_id, source, CAST(depth + 1 AS INTEGER) AS depth, node_id AS expanded, '{w}' AS way FROM edges JOIN near ON {sides[w]} = node_id" for w in way)
    return f"WITH RECURSIVE {SYMBOLS}, {EDGES}, root AS ({root}), step AS ({step}), {_WALK.format(n=1)} {parts}"


_ROOT = "SELECT symbol_id FROM symbols WHERE name = 'Customer_000000007'"
_BLAST = f"""WITH RECURSIVE {SYMBOLS}, {EDGES}, root AS (SELECT symbol_id FROM symbols WHERE file_path = 'src/n3.py'), step AS ({_IN}), {_WALK.format(n=3)},
blast AS (SELECT x.depth AS hop, x.node_id AS symbol_id, s.name, s.file_path, arg_min(e.source, e.edge_id) AS source FROM edges e JOIN near x ON e.caller_id = x.node_id JOIN near y ON e.callee_id = y.node_id AND x.depth = y.depth + 1
  JOIN symbols s ON s.symbol_id = x.node_id GROUP BY ALL)"""
_MARKERS = ", ".join(f"({k}, '{name}', '{m}')" for k, (name, (_, _, _, ms, _)) in enumerate(LANGUAGES.items()) for m in ms)
_SERVERS = ", ".join(f"({k}, '{name}', '{s}')" for k, (name, (_, _, _, _, s)) in enumerate(LANGUAGES.items()) if s)
_PROJECTS = f"""entries AS (SELECT 'p' || p_size AS dir, ['Package.swift', 'Cargo.toml', 'x.csproj', 'package.json', 'go.mod', 'README', 'Makefile'][p_partkey % 7 + 1] AS name FROM part),
m(position, language, marker) AS (VALUES {_MARKERS}),
projects AS (SELECT DISTINCT dir, language FROM entries JOIN m ON name = marker OR (starts_with(marker, '*') AND ends_with(name, substr(marker, 2))))"""
_NODES = r"""tags AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(/?[a-z][a-z0-9]*)[^>]*>', 1) AS t FROM pages)),
deep AS (SELECT page_id AS file, CAST(pos AS INTEGER) AS node_id, tag AS kind, CAST(sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS depth FROM tags WHERE tag NOT IN ('meta', 'br', 'img', 'link', 'hr', 'input')),
nodes AS (SELECT * FROM deep WHERE kind NOT LIKE '/%'),
both_ AS (SELECT file, node_id, kind, depth, depth AS level, node_id AS as_parent FROM nodes UNION ALL SELECT file, node_id, kind, depth, depth - 1, NULL FROM nodes),
par AS (SELECT *, last_value(as_parent IGNORE NULLS) OVER (PARTITION BY file, level ORDER BY node_id, as_parent NULLS LAST ROWS UNBOUNDED PRECEDING) AS parent_id FROM both_),
tree AS (SELECT file, node_id, kind, depth, parent_id FROM par WHERE as_parent IS NULL)"""
_LINES_OF_GIT = """git AS (SELECT o_orderkey AS position, ['??', ' M', 'M ', 'A ', 'R ', 'D ', 'UU', 'AM', 'MD'][o_orderkey % 9 + 1] || ' ' || CASE WHEN o_orderkey % 9 = 4 THEN 'old.py -> ' ELSE '' END
  || CASE WHEN o_orderpriority LIKE '5%' THEN '../' ELSE 'src/' END || 'f' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.py' ELSE '.txt' END AS line FROM orders),
kept AS (SELECT position, CASE WHEN line[1] = 'R' THEN split_part(substr(line, 4), ' -> ', -1) ELSE substr(line, 4) END AS path FROM git
  WHERE line[1:2] = '??' OR (line[1] NOT IN ('U', 'D') AND line[2] NOT IN ('U', 'D') AND (line[1] = 'M' OR line[2] = 'M' OR line[1] IN ('A', 'R', 'C'))))"""
_DUPS = """v AS (SELECT vec_id AS chunk_id, 'f' || label AS file_path, CASE label % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'c' WHEN 2 THEN 't' ELSE 'o' END AS part, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dup AS (SELECT a.chunk_id AS source_id, b.chunk_id AS match_id, list_inner_product(a.e, b.e) AS similarity FROM v a JOIN v b ON a.part = b.part AND a.chunk_id <> b.chunk_id WHERE list_inner_product(a.e, b.e) >= 0.3 {scope}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(similarity, 9) DESC, match_id) AS r FROM dup)
SELECT source_id, match_id, CAST(r AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM ranked WHERE r <= 5"""
_SESSIONS = f"""WITH {EVENTS},
g AS (SELECT *, CASE WHEN lag(epoch_ms(ts)) OVER w IS NULL OR epoch_ms(ts) - lag(epoch_ms(ts)) OVER w >= 600000 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (ORDER BY epoch_ms(ts), seq)),
s AS (SELECT *, CAST(sum(fresh) OVER (ORDER BY epoch_ms(ts), seq) AS BIGINT) AS session FROM g)"""
_REPORT = f"""{SYMBOLS}, {EDGES}, {DIAG},
tg(file_path, ord) AS (VALUES ('src/n1.py', 0), ('src/n2.py', 1)),
dep AS (SELECT DISTINCT s.file_path FROM edges e JOIN symbols s ON e.caller_id = s.symbol_id JOIN symbols t ON e.callee_id = t.symbol_id WHERE t.file_path IN (SELECT file_path FROM tg) AND s.file_path NOT IN (SELECT file_path FROM tg)),
fl AS (SELECT * FROM diag WHERE severity <= 2),
ct AS (SELECT uri, count(*) FILTER (severity = 1) AS errors, count(*) FILTER (severity = 2) AS warnings FROM fl GROUP BY uri),
fs AS (SELECT file_path AS uri, ord, 0 AS tier FROM tg UNION ALL SELECT file_path, 0, 1 FROM dep),
rp AS (SELECT row_number() OVER (ORDER BY tier, CASE WHEN tier = 0 THEN ord ELSE 0 END, CASE WHEN tier = 1 THEN -errors ELSE 0 END, CASE WHEN tier = 1 THEN -warnings ELSE 0 END, fl.uri, diag_id) AS position, fl.uri, diag_id, severity, message
  FROM fl JOIN fs ON fl.uri = fs.uri JOIN ct ON ct.uri = fl.uri WHERE tier = 0 OR errors > 0 OR warnings > 0)"""
_CASCADE = """lay AS (SELECT query_id, {live}, 0 AS l FROM live UNION ALL SELECT query_id, {sym}, 1 FROM es UNION ALL SELECT query_id, {chu}, 2 FROM ec),
best AS (SELECT query_id, min(l) AS l FROM lay GROUP BY query_id)
SELECT p.query_id, {out}, coalesce(['liveLSP', 'lspIndex', 'treeSitter'][lay.l + 1], 'none') AS layer FROM positions p LEFT JOIN best ON p.query_id = best.query_id LEFT JOIN lay ON lay.query_id = best.query_id AND lay.l = best.l"""

SQL: dict[str, str] = {
    "search_bm25": f"WITH {LINES}, {_bm25(TERMS)} SELECT chunk_id, round(bm25, 6) AS score FROM bm ORDER BY round(bm25, 9) DESC, chunk_id LIMIT 20",
    "search_trigram": f"WITH {LINES}, {_trigram(GRAMS)} SELECT chunk_id, round(trigram, 6) AS score FROM tr ORDER BY round(trigram, 9) DESC, chunk_id LIMIT 20",
    "search_cosine": f"WITH {EMBEDDED}, {_COS} SELECT chunk_id, round(cosine, 6) AS score FROM co",
    "search_hybrid": f"{_FUSE} SELECT c.chunk_id, round(score, 6) AS score, round(bm25, 6) AS bm25, round(trigram, 6) AS trigram, round(cosine, 6) AS cosine, c.file_path, c.symbol_path, c.kind, c.start_line, c.text FROM top JOIN chunks c ON c.chunk_id = top.chunk_id",
    "search_progress": f"WITH {LINES}, {EMBEDDED} SELECT count(*) AS total, count(e.chunk_id) AS embedded, count(*) = 0 OR count(e.chunk_id) < count(*) AS note FROM chunks c LEFT JOIN embedded e ON c.chunk_id = e.chunk_id",
    "search_document_frequency": f"WITH {LINES}, t AS (SELECT unnest(list_distinct(list_concat({_tokens('text')}, {_tokens('symbol_path')}))) AS term FROM chunks) SELECT term, count(*) AS df FROM t GROUP BY term",
    "search_postings": f"WITH {LINES}, t AS (SELECT chunk_id, {_tokens('text')} AS b, {_tokens('symbol_path')} AS s FROM chunks), e AS (SELECT chunk_id, len(b) + len(s) AS length, unnest(b) AS term, 1 AS w FROM t UNION ALL SELECT chunk_id, len(b) + len(s), unnest(s), 5 FROM t) SELECT term, chunk_id, CAST(sum(w) AS BIGINT) AS tf, CAST(length AS INTEGER) AS length FROM e GROUP BY term, chunk_id, length",
    "symbol_merge": f"WITH {MERGED} SELECT * FROM merged",
    "symbol_get_exact": _get("Brand2.small_ring"),
    "symbol_get_suffix": _get("small_ring"),
    "symbol_get_ci": _get("SMALL_R"),
    "symbol_get_fuzzy": _get("bsmrg"),
    "symbol_search_kind": f"WITH {MERGED} SELECT file_path, start_line, name, qualified_path, CAST(coalesce(fp, fn) AS INTEGER) AS score FROM {_fuzzy(_fuzzy('(SELECT * FROM merged WHERE meta = ' + chr(39) + 'function' + chr(39) + ')', 'qualified_path', 'cust', 'fp'), 'name', 'cust', 'fn')} WHERE coalesce(fp, fn) IS NOT NULL ORDER BY score DESC, file_path, start_line LIMIT 50",
    "symbol_list_file": f"WITH {MERGED} SELECT * FROM merged WHERE file_path = 'src/n7.py'",
    "grep_code": f"WITH {LINES} SELECT chunk_id, file_path, start_line, len(regexp_extract_all(text, '[Tt]h[aeiou]+n')) AS n_matches FROM chunks WHERE regexp_matches(text, '[Tt]h[aeiou]+n')",
    "grep_glob": f"WITH {LINES} SELECT chunk_id, file_path, start_line, len(regexp_extract_all(text, 'licen[cs]ed?')) AS n_matches FROM chunks WHERE lang IN ('en', 'fr') AND regexp_matches(file_path, '^src1[^/]*/.*$') AND regexp_matches(text, 'licen[cs]ed?') ORDER BY file_path, start_line, chunk_id LIMIT 50",
    "grep_summary": f"WITH {LINES} SELECT count(*) AS total_chunks, count(*) FILTER (regexp_matches(text, 'licen[cs]ed?')) AS matching, count(*) FILTER (regexp_matches(text, 'licen[cs]ed?')) > 50 AS truncated FROM chunks WHERE lang IN ('en', 'fr')",
    "duplicates_workspace": "WITH " + _DUPS.format(scope=""),
    "duplicates_file": "WITH " + _DUPS.format(scope="AND a.file_path = 'f3'"),
    "graph_outbound": _graph(_OUT, _ROOT, ["outbound"]),
    "graph_inbound": _graph(_IN, _ROOT, ["inbound"]),
    "graph_both": _graph(f"{_OUT} UNION {_IN}", _ROOT, ["outbound", "inbound"]),
    "graph_locator": _graph(_OUT, "SELECT symbol_id FROM symbols WHERE file_path = 'src/n5.py' AND start_line <= 30 AND end_line >= 30 AND start_column <= 6 ORDER BY end_line - start_line, symbol_id LIMIT 1", ["outbound"]),
    "blast_radius": f"{_BLAST} SELECT CAST(hop AS INTEGER) AS hop, symbol_id, name, file_path, source FROM blast",
    "blast_radius_totals": f"{_BLAST} SELECT CAST(hop AS INTEGER) AS hop, count(*) AS symbols, count(DISTINCT file_path) AS files FROM blast GROUP BY hop UNION ALL SELECT 0, count(*), count(DISTINCT file_path) FROM blast",
    "enclosing_symbol": f"WITH {ENCLOSED} SELECT query_id, symbol_id, name FROM es",
    "enclosing_chunk": f"WITH {ENCLOSED} SELECT query_id, chunk_id, symbol_path FROM ec",
    "definition_cascade": f"WITH {ENCLOSED}, " + _CASCADE.format(live="file_path, start_line, end_line, symbol", sym="file_path, start_line, end_line, name", chu="file_path, start_line, end_line, symbol_path", out="lay.file_path, lay.start_line, lay.end_line, lay.symbol"),
    "hover_cascade": f"WITH {ENCLOSED}, " + _CASCADE.format(live="contents", sym="coalesce(detail, name || ' (' || kind || ')')", chu="text", out="lay.contents"),
    "inbound_calls": f"WITH {ENCLOSED}, {EDGES} SELECT es.query_id, e.caller_id, s.name, s.file_path, count(*) AS n_sites FROM es JOIN edges e ON e.callee_id = es.symbol_id JOIN symbols s ON s.symbol_id = e.caller_id GROUP BY ALL",
    "references_index": f"WITH {ENCLOSED}, {EDGES} SELECT es.query_id, e.file_path, e.site AS start_line FROM es JOIN edges e ON e.callee_id = es.symbol_id JOIN symbols s ON s.symbol_id = e.caller_id",
    "references_text": f"WITH {LINES} SELECT chunk_id, file_path, start_line FROM chunks WHERE text ILIKE '%disgusting%' ORDER BY file_path, start_line, chunk_id LIMIT 200",
    "references_by_file": f"WITH {LINES}, r AS (SELECT * FROM chunks WHERE text ILIKE '%worthless%'), f AS (SELECT * FROM r ORDER BY file_path, start_line LIMIT 20) SELECT file_path, count(*) AS n, (SELECT count(*) FROM r) AS total FROM f GROUP BY file_path",
    "implementations": f"WITH {SYMBOLS} SELECT file_path, start_line, 'lspIndex' AS layer FROM symbols WHERE name = 'Customer_000000011' ORDER BY file_path, start_line LIMIT 20",
    "longest_identifier": rf"WITH w AS (SELECT event_id, list_filter(regexp_split_to_array(event_type || ' ' || props || ' user_' || user_id, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[\p{{L}}_]')) AS w FROM events) SELECT event_id, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS identifier FROM w",
    "reconcile_diff": f"WITH {FILES}, {INDEX} SELECT coalesce(d.file_path, i.file_path) AS file_path, CASE WHEN i.content_hash IS NULL THEN 'added' WHEN d.content_hash IS NULL THEN 'removed' WHEN d.content_hash <> i.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM files d FULL JOIN idx i ON d.file_path = i.file_path",
    "dirty_drain": f"WITH {FILES}, {INDEX} SELECT file_path FROM idx WHERE NOT ts_indexed",
    "mark_dirty": f"WITH {FILES}, {INDEX} SELECT coalesce(f.file_path, i.file_path) AS file_path, coalesce(f.content_hash, i.content_hash) AS content_hash, coalesce(f.file_size, i.file_size) AS file_size, f.file_path IS NULL AND i.ts_indexed AS ts_indexed, f.file_path IS NULL AND i.lsp_indexed AS lsp_indexed, f.file_path IS NULL AND i.embedded AS embedded FROM idx i FULL JOIN files f ON i.file_path = f.file_path",
    "mark_uncovered": f"WITH {FILES}, {INDEX} SELECT file_path, lsp_indexed OR NOT regexp_matches(file_path, '\\.(en|fr)$') AS lsp_indexed FROM idx",
    "rebuild_index": f"WITH {FILES}, {INDEX} SELECT file_path, ts_indexed, false AS lsp_indexed, embedded FROM idx",
    "index_status": f"WITH {FILES}, {INDEX}, {CODE}, {SYMBOLS}, {EDGES} SELECT count(*) AS files, round(100.0::DOUBLE * count(*) FILTER (ts_indexed) / count(*), 6) AS ts_indexed_percent, round(100.0::DOUBLE * count(*) FILTER (lsp_indexed) / count(*), 6) AS lsp_indexed_percent, round(100.0::DOUBLE * count(*) FILTER (embedded) / count(*), 6) AS embedded_percent, (SELECT count(*) FROM code) AS chunks, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges FROM idx",
    "cascade_delete": f"WITH {CODE}, {SYMBOLS}, {EDGES}, gone(file_path) AS (VALUES ('src/n1.py'), ('src/n2.py')), dead AS (SELECT symbol_id FROM symbols WHERE file_path IN (SELECT file_path FROM gone)) SELECT (SELECT count(*) FROM code WHERE file_path NOT IN (SELECT file_path FROM gone)) AS chunks, (SELECT count(*) FROM symbols WHERE file_path NOT IN (SELECT file_path FROM gone)) AS symbols, (SELECT count(*) FROM edges WHERE file_path NOT IN (SELECT file_path FROM gone) AND caller_id NOT IN (SELECT symbol_id FROM dead) AND callee_id NOT IN (SELECT symbol_id FROM dead)) AS edges",
    "lsp_invalidation": f"WITH {SYMBOLS}, {EDGES}, fresh AS (SELECT * FROM symbols WHERE kind <> 'struct'), del AS (SELECT * FROM symbols s WHERE file_path IN (SELECT file_path FROM fresh) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.file_path = s.file_path AND f.start_line = s.start_line)) SELECT DISTINCT e.file_path FROM edges e JOIN del d ON (e.caller_id = d.symbol_id OR e.callee_id = d.symbol_id) WHERE e.file_path <> d.file_path",
    "corpus_signature_diff": f"WITH {LINES}, {EMBEDDED}, o AS (SELECT file_path, string_agg(c.chunk_id || ':' || coalesce(4 * len(v), 0), ',' ORDER BY c.chunk_id) AS s FROM chunks c LEFT JOIN embedded e ON c.chunk_id = e.chunk_id GROUP BY file_path), n AS (SELECT file_path, string_agg(chunk_id || ':0', ',' ORDER BY chunk_id) AS s FROM chunks WHERE kind <> 'other' GROUP BY file_path) SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.file_path = n.file_path WHERE o.s IS DISTINCT FROM n.s",
    "embed_drain": "SELECT vec_id AS chunk_id, len(embedding) AS dims, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm FROM embeddings",
    "readiness": "SELECT false AS drained, false AS ready",
    "fanout_interleave": f"WITH {LINES}, {_bm25(TERMS)}, h AS (SELECT lang AS root, bm.chunk_id, row_number() OVER (PARTITION BY lang ORDER BY round(bm25, 9) DESC, bm.chunk_id) AS rank FROM bm JOIN chunks USING (chunk_id)) SELECT root, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY rank, root) AS INTEGER) AS position FROM h ORDER BY rank, root LIMIT 50",
    "project_detection": f"WITH {_PROJECTS} SELECT dir, language FROM projects",
    "server_specs": f"WITH {_PROJECTS}, s(position, language, command) AS (VALUES {_SERVERS}) SELECT position, language, command FROM s WHERE language IN (SELECT language FROM projects) QUALIFY row_number() OVER (PARTITION BY command ORDER BY position) = 1",
    "root_discovery": r"WITH d AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?]*)/[^/?]*', 1) AS path FROM pages UNION SELECT DISTINCT regexp_extract(url, '^https?://([^/?]*)', 1) FROM pages WHERE contains(url, '/en/')) SELECT path FROM d WHERE NOT EXISTS (SELECT 1 FROM d u WHERE starts_with(d.path, u.path || '/'))",
    "enclosing_root": r"WITH r AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?]*)', 1) AS root FROM pages WHERE contains(url, '/en/')), p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?]*)', 1) AS path FROM pages) SELECT path, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY path",
    "gitignore_filter": f"WITH {FILES}, f AS (SELECT file_path AS path, regexp_replace(file_path, '^.*/', '') AS name FROM files) SELECT path FROM f WHERE NOT starts_with(path, 'src2/') AND NOT CASE WHEN regexp_matches(path, '^src3/1[^/]*$') THEN true WHEN regexp_matches(path, '^src1/[^/]*\\.fr$') THEN false WHEN regexp_matches(name, '^[^/]*\\.fr$') THEN true ELSE false END",
    "extension_filter": f"WITH {FILES} SELECT file_path, content_hash, file_size FROM files WHERE regexp_matches(file_path, '\\.(en|de)$')",
    "git_scopes": f"WITH {_LINES_OF_GIT} SELECT min(position) AS position, path FROM kept WHERE NOT regexp_matches(path, '^[/~]') AND NOT list_contains(string_split(path, '/'), '..') AND path LIKE '%.py' GROUP BY path",
    "diagnostics_report": f"WITH {_REPORT} SELECT CAST(position AS INTEGER) AS position, uri, diag_id, severity, message FROM rp WHERE position <= 100",
    "diagnostics_totals": f"WITH {_REPORT} SELECT count(*) FILTER (severity = 1) AS errors, count(*) FILTER (severity = 2) AS warnings, count(*) AS records FROM rp WHERE position <= 100",
    "diagnostics_dependents": f"WITH {_REPORT} SELECT file_path FROM dep",
    "diagnostics_cache": f"WITH {EVENTS} SELECT path, arg_max(kind, (ts, seq)) AS kind FROM ev GROUP BY path",
    "watcher_debounce": f"{_SESSIONS} SELECT session, path, arg_max(kind, (ts, seq)) AS kind, max(seq) AS seq FROM s GROUP BY session, path",
    "settle_outcome": "WITH u AS (SELECT user_id AS request, (epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-01')) // 1000 AS at_ms FROM events), a AS (SELECT DISTINCT request, 0 AS at_ms FROM u UNION ALL SELECT request, at_ms FROM u WHERE at_ms < 2000000), n AS (SELECT *, lead(at_ms) OVER (PARTITION BY request ORDER BY at_ms) AS nx FROM a), d AS (SELECT request, min(CASE WHEN nx IS NULL OR nx - at_ms >= 60000 THEN at_ms + 60000 END) AS e FROM n GROUP BY request) SELECT request, CASE WHEN e <= 2000000 THEN 'settled' ELSE 'pending' END AS outcome, CASE WHEN e <= 2000000 THEN e ELSE 2000000 END AS at_ms FROM d",
    "doc_version_sync": "WITH h AS (SELECT event_id AS seq, ts, 'u' || user_id AS path, CAST(floor(value / 10) AS BIGINT) AS hash FROM events), c AS (SELECT *, lag(hash) OVER w IS NULL OR lag(hash) OVER w <> hash AS sent FROM h WINDOW w AS (PARTITION BY path ORDER BY ts, seq)) SELECT seq, path, CAST(sum(CAST(sent AS INTEGER)) OVER (PARTITION BY path ORDER BY ts, seq) AS BIGINT) AS version, sent FROM c",
    "call_edge_resolution": f"""WITH {CODE}, np AS (SELECT count(*) AS n FROM part), sites AS (SELECT o_orderkey AS site_id, 'src/n' || (o_custkey % 25) || '.py' AS file_path, CAST(o_custkey // 25 AS INTEGER) AS line, upper(replace(p_name, ' ', '_')) AS name FROM orders, np JOIN part ON p_partkey = o_orderkey % np.n),
caller AS (SELECT s.site_id, s.file_path, s.name, c.symbol_path AS caller_path FROM sites s JOIN code c ON s.file_path = c.file_path AND s.line BETWEEN c.start_line AND c.end_line QUALIFY row_number() OVER (PARTITION BY s.site_id ORDER BY c.end_line - c.start_line, c.chunk_id) = 1)
SELECT k.site_id, k.caller_path, c.file_path AS callee_file, c.symbol_path AS callee_path, c.start_line AS callee_line FROM caller k JOIN code c ON lower(split_part(c.symbol_path, '.', -1)) = lower(k.name) AND (c.file_path <> k.file_path OR c.symbol_path <> k.caller_path)
QUALIFY row_number() OVER (PARTITION BY k.site_id ORDER BY CASE WHEN c.file_path = k.file_path THEN 0 ELSE 1 END, c.file_path, c.start_line, c.symbol_path) = 1""",
    "ensure_symbols": f"WITH {CODE}, {SYMBOLS}, c AS (SELECT file_path, start_line, arg_max(symbol_path, chunk_id) AS symbol_path, arg_max(kind, chunk_id) AS kind FROM code GROUP BY ALL), s AS (SELECT file_path, start_line, arg_max(name, symbol_id) AS name, arg_max(kind, symbol_id) AS kind FROM symbols GROUP BY ALL) SELECT coalesce(s.file_path, c.file_path) AS file_path, coalesce(s.start_line, c.start_line) AS start_line, coalesce(s.name, split_part(c.symbol_path, '.', -1)) AS name, coalesce(s.kind, c.kind) AS kind, s.name IS NULL AS fresh FROM s FULL JOIN c ON s.file_path = c.file_path AND s.start_line = c.start_line",
    "ast_query": f"WITH {_NODES} SELECT a.file, a.node_id, a.kind, 'link' AS capture FROM tree a JOIN tree l ON a.file = l.file AND a.parent_id = l.node_id JOIN tree u ON l.file = u.file AND l.parent_id = u.node_id WHERE a.kind = 'a' AND l.kind = 'li' AND u.kind = 'ul'",
    "flatten_symbols": f"WITH RECURSIVE {_NODES}, w AS (SELECT file, node_id, kind AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.file, t.node_id, w.path || '.' || t.kind FROM tree t JOIN w ON t.file = w.file AND t.parent_id = w.node_id) SELECT file, node_id, path FROM w",
    "reconcile_stats": f"WITH {FILES}, {INDEX} SELECT count(d.file_path) AS walked, count(*) FILTER (i.file_path IS NULL) AS added, count(*) FILTER (d.content_hash <> i.content_hash) AS changed, count(*) FILTER (d.file_path IS NULL) AS removed FROM files d FULL JOIN idx i ON d.file_path = i.file_path",
    "path_safety": "SELECT page_id, page_id % 3 = 0 AS safe FROM pages",
}

_COSDUPS = f"""{LINES}, {EMBEDDED},
v AS (SELECT chunk_id, file_path, symbol_path, CASE WHEN kind IN ('function', 'method') THEN 'c' ELSE kind END AS part, v AS e FROM chunks JOIN embedded USING (chunk_id) WHERE strlen(text) >= 100)"""
_ENRICHED = """rs AS (SELECT row_number() OVER () AS rid, * FROM refs),
n1 AS (SELECT r.rid, s.name FROM rs r JOIN symbols s ON s.file_path = r.file_path AND r.start_line BETWEEN s.start_line AND s.end_line QUALIFY row_number() OVER (PARTITION BY r.rid ORDER BY s.end_line - s.start_line, s.symbol_id) = 1),
n2 AS (SELECT r.rid, c.symbol_path FROM rs r JOIN {chunks} c ON c.file_path = r.file_path AND r.start_line BETWEEN c.start_line AND {end} QUALIFY row_number() OVER (PARTITION BY r.rid ORDER BY {end} - c.start_line, c.chunk_id) = 1)
SELECT r.file_path, r.start_line, coalesce(n1.name, n2.symbol_path) AS symbol, '{layer}' AS layer, (SELECT count(*) FROM {total}) AS total FROM rs r LEFT JOIN n1 USING (rid) LEFT JOIN n2 USING (rid)"""
_FANOUT = "SELECT * FROM (" + " UNION ALL ".join(
    f"(SELECT '{kind}' AS root, name, CAST(coalesce(fp, fn) AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY coalesce(fp, fn) DESC, file_path, start_line) AS INTEGER) AS rank FROM {_fuzzy(_fuzzy(f'(SELECT * FROM merged WHERE meta = {chr(39)}{kind}{chr(39)})', 'qualified_path', 'cust', 'fp'), 'name', 'cust', 'fn')} WHERE coalesce(fp, fn) IS NOT NULL)"
    for kind in ("function", "method", "type")
) + ")"

SQL |= {
    "duplicates_text": f"""WITH {_COSDUPS},
dup AS (SELECT a.chunk_id AS source_id, b.chunk_id AS match_id, list_inner_product(a.e, b.e) AS similarity FROM v a JOIN v b ON a.part = b.part AND (a.file_path <> b.file_path OR a.symbol_path <> b.symbol_path) WHERE list_inner_product(a.e, b.e) >= 0.2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(similarity, 9) DESC, match_id) AS r FROM dup)
SELECT source_id, match_id, CAST(r AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM ranked WHERE r <= 5""",
    "duplicates_compared": f"WITH {_COSDUPS} SELECT count(*) AS compared FROM v",
    "duplicates_groups": "SELECT source_id, max(similarity) AS best, count(*) AS n, string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY rank) AS matches FROM (WITH " + _DUPS.format(scope="") + ") GROUP BY source_id",
    "graph_named": f"WITH {SYMBOLS} SELECT g.edge_id, a.name AS caller_name, a.file_path AS caller_file, b.name AS callee_name, b.file_path AS callee_file, g.source, g.depth FROM ("
    + _graph(_OUT, f"SELECT min(symbol_id) AS symbol_id FROM symbols JOIN (SELECT * FROM ({_get('Customer_0000001')}) ORDER BY score DESC, file_path, start_line LIMIT 1) USING (file_path, start_line)", ["outbound"])
    + ") g JOIN symbols a ON a.symbol_id = g.caller_id JOIN symbols b ON b.symbol_id = g.callee_id",
    "type_definition": SQL["definition_cascade"],
    "enrich_location": f"WITH {ENCLOSED} SELECT p.query_id, coalesce(es.name, ec.symbol_path) AS symbol FROM positions p LEFT JOIN es USING (query_id) LEFT JOIN ec USING (query_id)",
    "include_source": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS source_text FROM documents WHERE text IS NOT NULL",
    "references_symbol": f"""WITH {CODE}, {SYMBOLS}, {EDGES},
it AS (SELECT symbol_id FROM symbols WHERE file_path = 'src/n5.py' AND 4 BETWEEN start_line AND end_line ORDER BY end_line - start_line, symbol_id LIMIT 1),
refs AS (SELECT e.file_path, e.site AS start_line FROM edges e JOIN it ON e.callee_id = it.symbol_id JOIN symbols s ON s.symbol_id = e.caller_id),
"""
    + _ENRICHED.format(chunks="code", end="c.end_line", layer="lspIndex", total="refs"),
    "references_live": f"""WITH {CODE}, {SYMBOLS},
every AS (SELECT file_path, start_line FROM symbols WHERE file_path = 'src/n7.py'),
refs AS (SELECT * FROM every ORDER BY file_path, start_line LIMIT 10),
"""
    + _ENRICHED.format(chunks="code", end="c.end_line", layer="liveLSP", total="every"),
    "references_word": rf"""WITH {LINES}, {SYMBOLS},
w AS (SELECT list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[\p{{L}}_]')) AS w FROM chunks ORDER BY file_path, start_line LIMIT 1),
word AS (SELECT list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS word FROM w),
every AS (SELECT file_path, start_line FROM chunks WHERE text ILIKE '%' || (SELECT word FROM word) || '%' ORDER BY file_path, start_line, chunk_id LIMIT 120),
refs AS (SELECT * FROM every ORDER BY file_path, start_line LIMIT 40),
"""
    + _ENRICHED.format(chunks="chunks", end="c.start_line", layer="treeSitter", total="every"),
    "workspace_symbols": f"WITH {SYMBOLS} SELECT name, kind, file_path, start_line FROM symbols",
    "server_status": "SELECT s_name AS command, CASE WHEN s_nationkey % 2 = 0 THEN 'running' ELSE 'failed' END AS state, CAST(s_suppkey % 6 AS INTEGER) AS attempts FROM supplier",
    "mark_indexed": f"WITH {FILES}, {INDEX} SELECT file_path, ts_indexed, lsp_indexed OR file_path LIKE '%.fr' AS lsp_indexed, embedded FROM idx",
    "mark_parsed": f"WITH {FILES}, {INDEX} SELECT file_path, ts_indexed OR file_path LIKE '%.fr' AS ts_indexed, lsp_indexed, embedded AND file_path NOT LIKE '%.fr' AS embedded FROM idx",
    "chunk_replace": f"WITH {CODE} SELECT chunk_id, file_path, start_line, symbol_path FROM code WHERE file_path NOT IN ('src/n1.py', 'src/n2.py') UNION ALL SELECT -chunk_id, file_path, start_line, symbol_path FROM code WHERE file_path = 'src/n1.py'",
    "edge_replace": f"WITH {EDGES} SELECT edge_id, caller_id, callee_id, file_path, source FROM edges WHERE source <> 'treesitter' OR file_path NOT IN ('src/n1.py', 'src/n2.py') UNION ALL SELECT -edge_id, caller_id, callee_id, file_path, source FROM edges WHERE source = 'treesitter' AND file_path = 'src/n1.py'",
    "outgoing_calls": f"""WITH {SYMBOLS}, calls AS (SELECT o_custkey AS caller_id, s.file_path, s.start_line FROM orders JOIN symbols s ON s.symbol_id = (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer))
SELECT c.caller_id, t.symbol_id AS callee_id FROM calls c JOIN symbols k ON k.symbol_id = c.caller_id AND k.kind IN ('function', 'method', 'constructor') JOIN symbols t ON t.file_path = c.file_path AND t.start_line = c.start_line WHERE t.file_path <> 'src/n3.py'""",
    "watcher_accept": "SELECT doc_id AS seq, source || '/' || doc_id || '.' || lang AS path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND lang IN ('en', 'fr', 'de') AND source <> 'src2' AND NOT (lang = 'fr' AND source <> 'src1')",
    "root_overlap": r"""WITH r AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?]*)/[^/?]*', 1) AS root FROM pages), w AS (SELECT min(root) AS w FROM r)
SELECT root, CASE WHEN root = w THEN 'exact' WHEN starts_with(w, root || '/') THEN 'descendant' ELSE 'ancestor' END AS relation FROM r, w WHERE root = w OR starts_with(w, root || '/') OR starts_with(root, w || '/')""",
    "git_range": "SELECT min(o_orderkey) AS position, 'src/f' || o_custkey || '.py' AS path FROM orders WHERE o_orderkey % 6 IN (0, 1, 3, 4) AND o_custkey % 2 = 0 GROUP BY path",
    "glob_scope": rf"WITH {FILES} SELECT DISTINCT file_path AS path FROM files WHERE regexp_matches(file_path, '^src[^/]/1[^/]*\.[ef][^/]*$') AND lang IN ('en', 'fr')",
    "search_cosine_mismatch": f"WITH {EMBEDDED} SELECT chunk_id, 0.0::DOUBLE AS score FROM embedded",
    "manager_readiness": "SELECT true AS ready",
    "fanout_symbols": f"WITH {MERGED}, h AS ({_FANOUT}) SELECT root, name, score, rank, CAST(row_number() OVER (ORDER BY rank, root) AS INTEGER) AS position FROM h ORDER BY rank, root LIMIT 30",
    "fanout_failures": "SELECT 'broken' AS root",
    "fanout_grep": f"WITH {LINES}, h AS (SELECT lang AS root, chunk_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY file_path, start_line, chunk_id) AS INTEGER) AS rank FROM chunks WHERE lang IN ('en', 'fr') AND regexp_matches(text, 'licen[cs]ed?')) SELECT *, CAST(row_number() OVER (ORDER BY rank, root) AS INTEGER) AS position FROM h WHERE rank <= 40 ORDER BY rank, root LIMIT 40",
}
_OLD = "one AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY symbol_id DESC) = 1)"
_FRESH = f"""{SYMBOLS}, {EDGES}, {_OLD},
fresh AS (SELECT * FROM symbols WHERE file_path IN ('src/n1.py', 'src/n2.py') AND kind <> 'struct' QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY symbol_id) = 1),
gone AS (SELECT * FROM one WHERE file_path IN (SELECT file_path FROM fresh) AND (file_path, start_line) NOT IN (SELECT (file_path, start_line) FROM fresh))"""

SQL |= {
    "grep_positions": rf"""WITH {LINES},
h AS (SELECT chunk_id, string_split_regex(text, '[Tt]h[aeiou]+n') AS p, regexp_extract_all(text, '[Tt]h[aeiou]+n') AS m FROM chunks WHERE regexp_matches(text, '[Tt]h[aeiou]+n')),
u AS (SELECT chunk_id, p, m, unnest(generate_series(1, len(m))) AS k FROM h),
s AS (SELECT chunk_id, m[k] AS hit, list_sum(list_transform(p[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: strlen(x))), 0) AS a FROM u)
SELECT chunk_id, CAST(a AS INTEGER) AS start, CAST(a + strlen(hit) AS INTEGER) AS "end" FROM s""",
    "ast_siblings": f"""WITH {_NODES},
hit AS (SELECT u.file, x.node_id AS x, y.node_id AS y, z.node_id AS z FROM tree u JOIN tree x ON x.file = u.file AND x.parent_id = u.node_id AND x.kind = 'li' JOIN tree y ON y.file = u.file AND y.parent_id = u.node_id AND y.kind = 'li' AND y.node_id > x.node_id
  JOIN tree z ON z.file = u.file AND z.parent_id = y.node_id AND z.kind = 'a' WHERE u.kind = 'ul')
SELECT DISTINCT file, x AS node_id, 'li' AS kind, 'first' AS capture FROM hit UNION ALL SELECT DISTINCT file, z, 'a', 'link' FROM hit""",
    "ast_progress": f"""WITH {_NODES},
n AS (SELECT z.file, count(*) AS n FROM tree u JOIN tree x ON x.file = u.file AND x.parent_id = u.node_id AND x.kind = 'li' JOIN tree z ON z.file = u.file AND z.parent_id = x.node_id AND z.kind = 'a' WHERE u.kind = 'ul' GROUP BY z.file),
f AS (SELECT page_id AS file, row_number() OVER (ORDER BY page_id) AS place, sum(coalesce(n, 0)) OVER (ORDER BY page_id) AS total FROM pages LEFT JOIN n ON n.file = page_id)
SELECT coalesce(min(place) FILTER (total >= 200), count(*)) AS files_scanned, max(total) >= 200 AS truncated FROM f""",
    "drain_batches": f"WITH {FILES}, {INDEX} SELECT file_path, (row_number() OVER (ORDER BY file_path) - 1) // 50 AS batch FROM idx WHERE NOT lsp_indexed",
    "drain_outcomes": f"WITH {FILES}, {INDEX} SELECT file_path, lsp_indexed OR length(file_path) % 4 <> 3 AS lsp_indexed FROM idx",
    "re_extract_symbols": f"WITH {_FRESH} SELECT symbol_id, name, file_path, start_line FROM one WHERE file_path NOT IN (SELECT file_path FROM fresh) UNION ALL SELECT o.symbol_id, upper(f.name), f.file_path, f.start_line FROM fresh f JOIN one o ON o.file_path = f.file_path AND o.start_line = f.start_line",
    "re_extract_edges": f"""WITH {_FRESH} SELECT edge_id, caller_id, callee_id, file_path, source FROM edges WHERE caller_id NOT IN (SELECT symbol_id FROM gone) AND callee_id NOT IN (SELECT symbol_id FROM gone) AND (source <> 'lsp' OR file_path NOT IN (SELECT file_path FROM fresh))
UNION ALL SELECT -edge_id, caller_id, callee_id, file_path, source FROM edges WHERE file_path = 'src/n1.py' AND source = 'lsp'""",
    "re_extract_files": f"WITH {_FRESH} SELECT DISTINCT file_path, file_path IN (SELECT file_path FROM fresh) OR file_path NOT IN (SELECT e.file_path FROM edges e JOIN gone g ON (e.caller_id = g.symbol_id OR e.callee_id = g.symbol_id) AND e.file_path <> g.file_path) AS lsp_indexed FROM symbols",
    "server_ready": "WITH r AS (SELECT 's' || (user_id % 200) AS server, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN -32801 WHEN 1 THEN -32802 ELSE -32603 END END AS code FROM events) SELECT server, coalesce(arg_max(code IS NULL, (ts, seq)) FILTER (code IS NULL OR code <> -32603), false) AS ready FROM r GROUP BY server",
}

SQL["call_edge_emit"] = f"""WITH {CODE}, np AS (SELECT count(*) AS n FROM part),
sites AS (SELECT o_orderkey AS site_id, 'src/n' || (o_custkey % 25) || '.py' AS file_path, CAST(o_custkey // 25 AS INTEGER) AS line, CASE WHEN o_orderkey % 2 = 0 THEN lower(replace(p_name, ' ', '_')) ELSE upper(replace(p_name, ' ', '_')) END AS name FROM orders, np JOIN part ON p_partkey = o_orderkey % np.n),
cased AS (SELECT chunk_id, file_path, start_line, end_line, CASE chunk_id % 4 WHEN 0 THEN upper(leaf) WHEN 1 THEN leaf ELSE 'X.' || leaf END AS symbol_path, lower(leaf) AS k FROM (SELECT *, split_part(symbol_path, '.', -1) AS leaf FROM code)),
places AS (SELECT file_path, start_line, min(chunk_id) AS symbol_id FROM cased GROUP BY ALL),
caller AS (SELECT s.*, c.symbol_path AS caller_path, c.start_line AS caller_line FROM sites s JOIN cased c ON s.file_path = c.file_path AND s.line BETWEEN c.start_line AND c.end_line QUALIFY row_number() OVER (PARTITION BY s.site_id ORDER BY c.end_line - c.start_line, c.chunk_id) = 1),
hit AS (SELECT k.*, c.file_path AS callee_file, c.start_line AS callee_line FROM caller k JOIN cased c ON c.k = lower(k.name) AND (contains(c.symbol_path, '.') OR c.symbol_path = k.name) AND (c.file_path <> k.file_path OR c.symbol_path <> k.caller_path)
  QUALIFY row_number() OVER (PARTITION BY k.site_id ORDER BY CASE WHEN c.file_path = k.file_path THEN 0 ELSE 1 END, c.file_path, c.start_line, c.symbol_path) = 1)
SELECT h.site_id AS edge_id, a.symbol_id AS caller_id, b.symbol_id AS callee_id, h.file_path AS caller_file, h.callee_file, h.file_path, '[[' || h.line || ',0,' || h.line || ',0]]' AS from_ranges, 'treesitter' AS source
FROM hit h JOIN places a ON a.file_path = h.file_path AND a.start_line = h.caller_line JOIN places b ON b.file_path = h.callee_file AND b.start_line = h.callee_line"""
SQL |= {
    "incoming_calls": f"""WITH {ENCLOSED}, {EDGES},
ix AS (SELECT es.query_id, e.caller_id, count(*) AS n_sites FROM es JOIN edges e ON e.callee_id = es.symbol_id GROUP BY ALL),
idx AS (SELECT ix.query_id, s.name, s.file_path, ix.n_sites FROM ix JOIN symbols s ON s.symbol_id = ix.caller_id)
SELECT p.query_id, CASE WHEN l.query_id IS NOT NULL THEN l.contents ELSE idx.name END AS name, CASE WHEN l.query_id IS NOT NULL THEN l.file_path ELSE idx.file_path END AS file_path, CASE WHEN l.query_id IS NOT NULL THEN 1 ELSE idx.n_sites END AS n_sites,
  CASE WHEN l.query_id IS NOT NULL THEN 'liveLSP' WHEN idx.query_id IS NOT NULL THEN 'lspIndex' ELSE 'none' END AS layer
FROM positions p LEFT JOIN live l ON l.query_id = p.query_id LEFT JOIN idx ON idx.query_id = p.query_id AND l.query_id IS NULL""",
    "code_actions": "SELECT o_orderkey AS query_id, n, 'fix ' || n AS title, CASE WHEN n = 0 AND o_orderkey % 2 = 0 THEN 'e' || o_orderkey END AS edit, 'liveLSP' AS layer FROM orders, (VALUES (0), (1)) v(n) WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'none' FROM orders WHERE o_orderstatus <> 'P'",
    "rename_edits": "SELECT o_orderkey AS query_id, ok AS can_rename, CASE WHEN ok THEN 'p' || (o_orderkey % 60) END AS placeholder, CASE WHEN ok THEN 'e' || o_orderkey END AS edit FROM (SELECT o_orderkey, o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 AS ok FROM orders)",
}
