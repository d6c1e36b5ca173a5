"""The catalogue's expected results in DuckDB SQL over the same tables."""

_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
_AMOUNTS = r"""
s AS (SELECT doc_id, regexp_replace(' ' || text || ' ', '([^\d.,])(\d)', '\1¤\2', 'g') AS y FROM documents),
e AS (SELECT doc_id, regexp_replace(y, '(\d)([^\d])', '\1‡\2', 'g') AS z FROM s),
raw AS (SELECT doc_id, unnest(regexp_extract_all(z, '¤\d{1,3}‡(?:[ .\x{00a0}]¤?\d{3}‡)+[,.]\d{2}‡|¤\d+‡[,.]\d{2}‡')) AS v FROM e),
plain AS (SELECT doc_id, regexp_replace(v, '[¤‡ \x{00a0}]', '', 'g') AS v FROM raw),
amounts AS (SELECT doc_id, CASE WHEN contains(v, ',') THEN replace(v, '.', '') ELSE replace(v, '.', ',') END AS amount FROM plain)"""
_DROPPED = f"""
w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM documents),
r AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM w GROUP BY ALL),
f AS (SELECT doc_id, word, count(*) AS n FROM w WHERE pos % 17 <> 0 GROUP BY ALL),
c AS (SELECT r.doc_id, r.word, r.first_pos, r.n, coalesce(f.n, 0) AS m, r.n - coalesce(f.n, 0) AS missing FROM r LEFT JOIN f USING (doc_id, word))"""
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"
_NUMERIC = r"(len(list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')) > 0 AND len(list_filter(regexp_split_to_array({0}, '\s+'), lambda t: regexp_matches(t, '\p{{Nd}}'))) > 0.4 * len(list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')))"
_SHORT = (
    "length(array_to_string(list_filter(string_split(line, ' | '), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')) < 10 OR "
    + _NUMERIC.format("x")
    + "), ' | ')) <= 600"
)
_LONG = f"""
p AS (SELECT doc_id, trim(line, E' \\t\\r\\n') AS line, i FROM ({_LINES}) WHERE trim(line, E' \\t\\r\\n') <> ''),
o AS (SELECT *, row_number() OVER d AS paragraph, coalesce(lag(line) OVER d, '') AS b4, coalesce(lead(line) OVER d, '') AS af FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
long_ AS (SELECT doc_id, paragraph::INTEGER AS paragraph, length(line)::INTEGER AS chars FROM o
  WHERE length(line) > 600 AND (contains(line, ' | ') OR {_NUMERIC.format("line")})
    AND NOT (contains(line, ' | ') AND ((contains(b4, ' | ') AND len(string_split(b4, ' | ')) = len(string_split(line, ' | ')))
      OR (contains(af, ' | ') AND len(string_split(af, ' | ')) = len(string_split(line, ' | '))) OR {_SHORT})))"""
_REVERSED = "length(word) >= 4 AND regexp_matches(word, '^[a-zà-ÿ]{2,}[A-ZÀ-Ý]$')"
_FINDINGS = f"""
found AS (SELECT doc_id, 'AMOUNTS' AS rule, 'error' AS severity, 2 AS rank FROM amounts
  UNION ALL SELECT doc_id, 'LONG_LINE', 'warning', 1 FROM long_
  UNION ALL SELECT doc_id, 'REVERSED', 'info', 0 FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) WHERE {_REVERSED})"""
_GATES = f"""{_FINDINGS},
g AS (SELECT d.doc_id, d.source, coalesce(max(f.rank), 0) AS worst, count(f.rule) AS findings FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY ALL)"""
_CODES = "['CCT','CCT-ALT','ACTV','ACT-RECT','ACEP','AE-ALT-RECT','DA','PE','PCT','PRT','AVISO','AV','AA','ST','']"
_FAMILY = """CASE WHEN {0} LIKE 'CCT%' OR {0} LIKE 'ACT%' OR {0} LIKE 'ACEP%' OR {0} LIKE 'AE%' OR {0} LIKE 'DA%' THEN 'convencao'
 WHEN {0} LIKE 'PE%' OR {0} LIKE 'PCT%' OR {0} LIKE 'PRT%' THEN 'extensao' WHEN {0} LIKE 'AV%' THEN 'aviso' WHEN {0} LIKE 'AA%' THEN 'adesao' END"""
_DECISIONS = f"""
i AS (SELECT o_orderkey, {_CODES}[1 + o_orderkey % 15] AS tipo, o_custkey % 9 = 0 AS no_url, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS same FROM orders),
k AS (SELECT *, {_FAMILY.format("tipo")} AS familia FROM i),
s AS (SELECT *, CASE WHEN familia IS NULL OR familia = 'aviso' THEN 'ignorado' WHEN no_url THEN 'falhado' WHEN same THEN 'ja_existente' ELSE 'descarregar' END AS st FROM k),
x AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY o_orderkey) AS rn FROM s),
d AS (SELECT o_orderkey::VARCHAR AS chave, tipo, CASE WHEN st = 'descarregar' AND rn > 100 THEN 'por_descarregar' ELSE st END AS estado,
  CASE WHEN familia IS NULL THEN 'tipo desconhecido: ' || CASE WHEN tipo = '' THEN '(sem tipo)' ELSE tipo END WHEN familia = 'aviso' THEN 'família fora do âmbito: aviso' WHEN no_url THEN 'sem URL' END AS motivo FROM x)"""
_TREE = """
ch AS (SELECT r_regionkey::BIGINT AS doc_id, 'CAPÍTULO ' || (r_regionkey + 1) || ' - ' || r_name AS label FROM region),
se AS (SELECT n_nationkey, n_regionkey::BIGINT AS doc_id, 'SECÇÃO ' || (n_nationkey + 1) || ' - ' || n_name AS label FROM nation),
cl AS (SELECT c_custkey, se.doc_id, 'Cláusula ' || (c_custkey + 1) || '.ª - ' || c_mktsegment AS label, se.label AS parent FROM customer JOIN se ON c_nationkey = n_nationkey)"""
_SUPPLIER = "r AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, s_name, s_suppkey FROM supplier)"
_MD_ROW = r"'| ' || s_name || ' | ' || s_suppkey || '\. x | a\|b\*c\_ |'"

ORACLES = {
    "q01_word_bag_by_lang": f"""
WITH b AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)::INTEGER AS rank FROM b)
SELECT lang, rank, word, n FROM k WHERE rank <= 25""",
    "q02_coverage_excess_verdict": f"""
WITH {_DROPPED}, m AS (SELECT doc_id, 1 - sum(missing) / sum(n) AS cov FROM c GROUP BY doc_id)
SELECT doc_id, round(cov, 6) AS coverage, 0.0::DOUBLE AS excess, CASE WHEN cov < 0.97 THEN 'FALHA' WHEN cov < 0.995 THEN 'ATENÇÃO' ELSE 'OK' END AS verdict FROM m""",
    "q03_page_loss": f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, word, count(*) AS total FROM w WHERE pos % 11 <> 0 GROUP BY ALL),
c AS (SELECT doc_id, i AS page_no, word, count(*) AS c FROM (SELECT doc_id, i, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM ({_LINES})) GROUP BY ALL),
b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY doc_id, word ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
f AS (SELECT b.doc_id, page_no, c, greatest(0, least(c, coalesce(total, 0) - before)) AS found FROM b LEFT JOIN h USING (doc_id, word))
SELECT doc_id, page_no, round(1 - sum(found) / sum(c), 6) AS loss FROM f GROUP BY ALL HAVING sum(found) < sum(c)""",
    "q04_missing_top_words": f"""
WITH {_DROPPED}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY missing DESC, first_pos, word)::INTEGER AS rank, word, missing AS n FROM c WHERE missing > 0)
SELECT * FROM k WHERE rank <= 25""",
    "q05_amounts_bag": f"WITH {_AMOUNTS} SELECT doc_id, amount, count(*) AS n FROM amounts GROUP BY ALL",
    "q06_amounts_roundtrip": "SELECT l_orderkey, replace(l_extendedprice::DECIMAL(18,2)::VARCHAR, '.', ',') AS amount, count(*) AS n FROM lineitem GROUP BY ALL",
    "q07_amounts_reconciliation": """
WITH a AS (SELECT l_orderkey, l_extendedprice::DECIMAL(18,2) AS v, l_extendedprice::DECIMAL(18,2) + CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN 1 ELSE 0 END AS w FROM lineitem),
l AS (SELECT l_orderkey, v FROM a EXCEPT ALL SELECT l_orderkey, w FROM a),
m AS (SELECT l_orderkey, w FROM a EXCEPT ALL SELECT l_orderkey, v FROM a)
SELECT l_orderkey, (SELECT count(*) FROM l WHERE l.l_orderkey = k.l_orderkey) AS missing, (SELECT count(*) FROM m WHERE m.l_orderkey = k.l_orderkey) AS extra
FROM (SELECT l_orderkey FROM l UNION SELECT l_orderkey FROM m) k""",
    "q08_repeated_margins": """
WITH p AS (SELECT lang, doc_id, string_split('Acme ' || lang || chr(10) || text || chr(10) || 'fim ' || (doc_id % 3), chr(10)) AS ls FROM documents),
l AS (SELECT lang, doc_id, trim(unnest(ls), E' \\t\\r') AS line, generate_subscripts(ls, 1) AS i FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS down, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE line <> ''),
m AS (SELECT DISTINCT lang, doc_id, line FROM f WHERE least(up, down) <= greatest(1, least(3, n // 4))),
t AS (SELECT lang, count(DISTINCT doc_id) AS pages FROM documents GROUP BY lang)
SELECT lang, line AS text, count(*) AS pages FROM m JOIN t USING (lang) GROUP BY lang, line, t.pages HAVING count(*) >= greatest(3, ceil(t.pages / 2))""",
    "q09_furniture_strip": "SELECT doc_id, 3::BIGINT AS removed, sha256(text) AS sha256 FROM documents",
    "q10_long_lines": f"WITH {_LONG} SELECT * FROM long_",
    "q11_table_blocks": """
WITH o AS (SELECT s_nationkey, s_suppkey, sum(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS run FROM supplier),
b AS (SELECT s_nationkey, run FROM o GROUP BY ALL HAVING count(*) >= 2)
SELECT s_nationkey, count(*) AS blocks FROM b GROUP BY ALL""",
    "q12_inverted_words": f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, word, CASE WHEN pos % 50 = 0 AND regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}{{3,}}$') THEN reverse(word) ELSE word END AS turned FROM w),
a AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT doc_id, turned AS word, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.word, b.word) AS word, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS f FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.word = b.word)
SELECT x.doc_id, x.word AS found, reverse(x.word) AS expected FROM c x
WHERE f > r AND length(x.word) >= 4 AND (regexp_matches(x.word, '^[a-zà-ÿ]{{2,}}[A-ZÀ-Ý]$') OR EXISTS (SELECT 1 FROM c y WHERE y.doc_id = x.doc_id AND y.word = reverse(x.word) AND y.r > y.f))""",
    "q13_char_classes": r"""
SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS digits,
  length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, '.', '')) AS dots, length(regexp_replace(lower(text), '[^a]', '', 'g')) AS a FROM documents""",
    "q14_exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1",
    "q15_cache_check": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'valid' END AS state FROM documents",
    "q16_families": f"WITH c AS (SELECT {_CODES}[1 + o_orderkey % 15] AS code FROM orders) SELECT code, {_FAMILY.format('code')} AS family, count(*) AS n FROM c GROUP BY ALL",
    "q17_url_policy": """
SELECT page_id, CASE page_id % 8 WHEN 1 THEN NULL WHEN 2 THEN 'authority' WHEN 3 THEN 'authority' WHEN 4 THEN 'host' WHEN 5 THEN 'scheme' WHEN 6 THEN NULL WHEN 7 THEN 'scheme'
  ELSE CASE WHEN url LIKE 'https:%' THEN 'host' ELSE 'scheme' END END AS problem FROM pages""",
    "q18_index_projection": f"""
WITH c AS (SELECT c_custkey AS k, {_CODES}[1 + c_custkey % 15] AS tipo FROM customer),
f AS (SELECT k, {_FAMILY.format("tipo")} AS familia, CASE WHEN k % 4 <> 0 THEN 1995 + k % 30 WHEN k % 2 = 0 THEN 2025 END AS ano, k % 40 AS num_bte,
   CASE WHEN k % 3 = 0 THEN k || '.pdf' WHEN k % 2 = 0 THEN 'f' || k || '.pdf' END AS ficheiro, k % 2 = 0 AS has_url FROM c),
u AS (SELECT *, CASE WHEN has_url THEN 'https://bte.dgcp.mtsss.gov.pt/documentos/2025/7/f' || k || '.pdf'
   WHEN ficheiro IS NOT NULL AND ano <> 0 AND num_bte <> 0 THEN 'https://bte.dgcp.mtsss.gov.pt/documentos/' || ano || '/' || num_bte || '/' || ficheiro ELSE '' END AS url,
   CASE WHEN ano IS NULL OR num_bte < 1 THEN 'ano ou número BTE ausente ou inválido' WHEN ficheiro IS NULL THEN 'nome de PDF ausente ou inválido' END AS problem FROM f)
SELECT k AS c_custkey, ano, num_bte, ficheiro, url, familia, CASE WHEN k % 5 = 0 THEN 'A1' ELSE 'A1; A2' END AS altera, problem,
  CASE WHEN problem IS NULL THEN ano || '/' || num_bte || '/' || regexp_replace(ficheiro, '\\.pdf$', '') END AS chave FROM u""",
    "q19_registry_last_wins": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q20_collect_decisions": f"WITH {_DECISIONS} SELECT chave, estado, motivo FROM d",
    "q21_structure_roundtrip": f"""
WITH {_TREE} SELECT doc_id, 'capitulo' AS tipo, label, NULL::VARCHAR AS parent FROM ch UNION ALL SELECT se.doc_id, 'seccao', se.label, ch.label FROM se JOIN ch USING (doc_id)
UNION ALL SELECT doc_id, 'clausula', label, parent FROM cl""",
    "q22_zero_loss": f"""
WITH {_TREE}, l AS (SELECT doc_id, length(label) + 1 AS n FROM ch UNION ALL SELECT doc_id, length(label) + 1 FROM se UNION ALL SELECT doc_id, length(label) + 1 + length('O saldo fica em conta.') + 1 FROM cl)
SELECT doc_id, count(*) AS leaves, true AS whole, sum(n)::BIGINT AS chars FROM l GROUP BY doc_id""",
    "q23_paragraph_nodes": """
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_partkey FROM lineitem),
t AS (SELECT *, k || '- item ' || l_partkey AS label FROM r),
o AS (SELECT *, sum(length(label) + 1) OVER (PARTITION BY l_orderkey ORDER BY k) AS e, max(k) OVER (PARTITION BY l_orderkey) AS top FROM t)
SELECT l_orderkey, k::INTEGER AS paragraph_no, label, (e - length(label) - 1)::BIGINT AS char_start, (CASE WHEN k = top THEN e - 1 ELSE e END)::BIGINT AS char_end FROM o""",
    "q24_node_levels": f"""
WITH {_TREE} SELECT doc_id, 'capitulo' AS tipo, 2::INTEGER AS level, count(*) AS n FROM ch GROUP BY ALL UNION ALL SELECT doc_id, 'seccao', 3, count(*) FROM se GROUP BY ALL
UNION ALL SELECT doc_id, 'clausula', 4, count(*) FROM cl GROUP BY ALL""",
    "q25_signatures": "SELECT s_suppkey, (s_suppkey % 5 + 1 + CASE WHEN s_suppkey % 4 = 2 THEN 2 ELSE 1 END)::BIGINT AS line_no FROM supplier WHERE s_suppkey % 4 <> 1",
    "q26_line_joining": f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^\\p{{Ll}}{{2,}}$')) AS w FROM documents)
SELECT doc_id, 1::BIGINT AS lines, sha256(array_to_string(w, ' ')) AS sha256 FROM w WHERE len(w) > 0""",
    "q27_reading_order": """
WITH b AS (SELECT p_size AS doc_id, p_partkey AS item_seq, (p_partkey % 3 + 1)::INTEGER AS page_no, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 37 % 500 END AS l,
  p_partkey * 37 % 500 + 40 + CASE WHEN p_partkey % 13 = 0 THEN 250 ELSE 0 END AS r, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 91 % 800 ELSE 842 - p_partkey * 91 % 800 END AS top FROM part),
t AS (SELECT doc_id, page_no, count(*) >= 8 AND count(*) FILTER (l < 285.6 AND r > 309.4) / count(*) < 0.05 AND count(*) FILTER (r <= 309.4) / count(*) > 0.25 AND count(*) FILTER (l >= 285.6) / count(*) > 0.25 AS two FROM b WHERE l IS NOT NULL GROUP BY ALL),
k AS (SELECT b.*, CASE WHEN l IS NOT NULL THEN {'p': b.page_no, 'c': CASE WHEN coalesce(two, false) AND l >= 285.6 THEN 1 ELSE 0 END, 't': top} END AS key FROM b LEFT JOIN t USING (doc_id, page_no)),
f AS (SELECT *, coalesce(last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {'p': 0, 'c': 0, 't': 0}) AS key2 FROM k),
o AS (SELECT doc_id, item_seq, row_number() OVER (PARTITION BY doc_id ORDER BY key2.p, key2.c, key2.t, item_seq) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY item_seq) AS was FROM f)
SELECT doc_id, item_seq, place, max(place <> was) OVER (PARTITION BY doc_id) AS moved FROM o""",
    "q28_two_columns": """
WITH w AS (SELECT l_suppkey % 10 AS doc_id, l_orderkey % 50 AS page_no, l_partkey * 7 % 560 AS x0, l_partkey * 7 % 560 + CASE WHEN l_quantity < 3 THEN 60 ELSE 5 END AS x1 FROM lineitem),
k AS (SELECT * FROM w WHERE NOT (x0 < 297.5 AND x1 > 297.5 AND page_no % 2 = 0))
SELECT doc_id, page_no, CASE WHEN count(*) >= 40 AND count(*) FILTER (x0 < 292.5 AND x1 > 302.5) / count(*) < 0.02 AND count(*) FILTER (x1 <= 297.5) / count(*) > 0.25
  AND count(*) FILTER (x0 >= 297.5) / count(*) > 0.25 THEN 297.5::DOUBLE END AS gutter FROM k GROUP BY ALL""",
    "q29_table_checks": """
WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS r, l_partkey % 3 AS c, l_suppkey % 5 = 0 AS tall, l_suppkey % 7 = 0 AS wide FROM lineitem),
p AS (SELECT l_orderkey, r + dr AS r, c + dc AS c FROM c, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc) WHERE (dr = 0 OR tall) AND (dc = 0 OR wide)),
t AS (SELECT l_orderkey, r, c FROM p GROUP BY ALL HAVING count(*) > 1), o AS (SELECT l_orderkey, count(*) AS n FROM t GROUP BY ALL)
SELECT c.l_orderkey, bool_or(tall OR wide) AS has_span, coalesce(max(o.n), 0) AS overlaps FROM c LEFT JOIN o USING (l_orderkey) GROUP BY ALL""",
    "q30_table_markdown": f"""
WITH {_SUPPLIER} SELECT s_nationkey, string_agg({_MD_ROW} || CASE WHEN k = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY k) AS markdown FROM r GROUP BY ALL""",
    "q31_lint_tables": f"WITH {_SUPPLIER} SELECT s_nationkey, 'MD056' AS rule, (k + 1)::INTEGER AS line, 'error' AS severity FROM r WHERE k % 5 = 0",
    "q32_heading_jumps": """
WITH l AS (SELECT p_brand, p_size % 4 + 1 AS level, row_number() OVER d AS k, coalesce(lag(p_size % 4 + 1) OVER d, 0) AS before FROM part WINDOW d AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_brand, 'MD001' AS rule, k::INTEGER AS line FROM l WHERE level > before + 1""",
    "q33_findings_by_rule": f"WITH {_AMOUNTS}, {_LONG}, {_FINDINGS} SELECT rule, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM found GROUP BY ALL",
    "q34_quality_gate": f"""
WITH {_AMOUNTS}, {_LONG}, {_GATES}
SELECT ['passed', 'review', 'blocked'][worst + 1] AS gate, CASE WHEN worst > 0 THEN 'rever' ELSE 'sem_alertas_automaticos' END AS state, quality, count(*) AS n, sum(findings)::BIGINT AS findings
FROM g LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "q35_exit_codes": f"""
WITH {_AMOUNTS}, {_LONG}, {_GATES}
SELECT source, (CASE WHEN max(worst) >= 2 THEN 1 WHEN length(source) % 2 = 0 AND max(worst) >= 1 THEN 2 ELSE 0 END)::INTEGER AS code FROM g GROUP BY source""",
    "q36_wrapped_repair": f"SELECT doc_id, sha256(array_to_string({_WORDS}, ' ')) AS sha256 FROM documents",
    "q37_passages_in_documents": "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "q38_bodies_missing": f"""
WITH {_TREE} SELECT doc_id, label || CASE WHEN c_custkey % 7 = 0 THEN ': sem conteúdo' ELSE ': corpo sem frase terminada em ponto' END AS notice FROM cl WHERE c_custkey % 7 IN (0, 1)""",
    "q39_deposit_note": """
SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'sem nota de depósito (art. 494.º CT) — documento truncado?'
  WHEN s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 4 = 2 THEN '1 linha(s) depois da nota de depósito — ordem de leitura suspeita (a primeira: «Mais uma.»)'
  ELSE '1 linha(s) depois da nota de depósito — ordem de leitura suspeita (a primeira: «Tabela | fora»)' END AS notice FROM supplier""",
    "q40_annex_tables": """
WITH n AS (SELECT n_regionkey AS doc_id, n_nationkey, 'ANEXO ' || (n_nationkey + 1) || ' - Tabela salarial ' || n_name AS label, max(n_nationkey % 4 = 0) OVER (PARTITION BY n_regionkey) AS t FROM nation)
SELECT doc_id, label || ': anexo de remuneração/mapa' || CASE WHEN t THEN ' com a tabela fora do corpo do nó — as linhas existem no documento mas não ficaram ancoradas ao anexo (ordem de leitura)'
  ELSE ' sem nenhuma tabela no documento — tabela perdida na extração?' END AS notice FROM n WHERE n_nationkey % 4 IN (2, 3)""",
    "q41_ordinal_keys": "SELECT range AS number, 'cl' || range AS label_key, range AS value FROM range(1, 200)",
    "q42_page_titles": r"SELECT page_id, replace(replace(replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages",
    "q44_run_summary": f"""
WITH {_DECISIONS}, u AS (SELECT estado, CASE WHEN motivo LIKE 'tipo desconhecido%' THEN CASE WHEN tipo = '' THEN '(sem tipo)' ELSE tipo END END AS unknown FROM d)
SELECT estado, unknown, grouping(estado, unknown)::BIGINT AS level, count(*) AS n FROM u GROUP BY GROUPING SETS ((estado), (unknown), ())""",
    "q45_page_join_words": r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[-\s]+$', '') AS t, lag(turn) OVER w IS NULL AS first_, lead(turn) OVER w IS NULL AS last_ FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sha256(CASE WHEN first_ THEN '' ELSE ' ' END || t || CASE WHEN last_ THEN '' ELSE ' trabalhador' END) AS sha256 FROM t""",
}
