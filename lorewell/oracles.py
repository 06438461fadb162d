"""DuckDB SQL for the queries of ``lorewell.queries``; those that SQL can't express have none."""

from __future__ import annotations

from lorewell.functions.text import NO_HEADER_ENDS, SENTENCE_ENDS
from lorewell.operators.metrics import HISTOGRAMS
from lorewell.operators.quality import CONJUNCTIONS, CUT_OFF, PRONOUNS
from lorewell.operators.split import CHINESE, NO_HEADER, NUMBERED, PREAMBLE, SEPARATORS

_listed = lambda marks: ", ".join(f"'{m}'" for m in marks)
WHITE = r"E' \t\n\r\x0b\f'"
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ATOMS = rf"list_filter(list_transform(regexp_split_to_array(coalesce({{0}}, ''), '[。！？.!?\n]+'), lambda x: trim(x, {WHITE})), lambda x: x <> '')"
CHUNKS = """
c0 AS (SELECT doc_id, source, text, unnest(range(0, (length(text) - 1) // 400 + 1)) AS i FROM documents WHERE text <> ''),
chunks AS (SELECT doc_id, source, i AS chunk_index, substr(text, i * 400 + 1, 400) AS content FROM c0)
"""

SQL: dict[str, str] = {}

SQL["sc_text"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, length(trim(text, {WHITE})) AS trimmed, round(length(regexp_replace(text, '\s', '', 'g')) / nullif(length(text), 0), 6) AS density,
  strlen(text) // 4 AS estimate, len({TOKENS.format("text")}) AS n_tokens, len({ATOMS.format("text")}) AS n_sentences, substr(trim(text, {WHITE}), 1, 20) AS title,
  (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the, 'chunk-' || md5(text || '-' || doc_id) AS chunk_id,
  length(trim(regexp_replace(regexp_replace(text, 'https?://\S+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '', 'g'), '\s+', ' ', 'g'), {WHITE})) AS n_clean
FROM t
"""

SQL["sc_names"] = """
WITH m AS (SELECT *, c_nationkey::varchar AS kb FROM customer)
SELECT c_custkey, c_name AS model, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'Local' END AS factory,
  CASE WHEN strlen(c_name) <= 8 THEN '****' ELSE left(c_name, 4) || '****' || right(c_name, 4) END AS masked, 'kg_' || kb || '_a_b' AS space,
  'entity_' || md5(kb || c_name) AS entity_id, 'relation_' || md5(kb || c_name || c_mktsegment) AS relation_id, (30 * 2 ** (c_custkey % 4))::bigint AS wait,
  regexp_matches(lower(replace(c_name, '#', '.')) || '@mail.example', '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$') AS email
FROM m
"""

SQL["src2_urls"] = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '\.[^./]+$')) AS ext FROM pages)
SELECT page_id, coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) AS is_url,
  CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^https?://([^/]*)', 1) ELSE url END AS host, ext IN ('.md', '.markdown') AS is_markdown, ext = '.pdf' AS is_pdf
FROM p
"""

SQL["sc13_json"] = "SELECT event_id, (props->>'k')::bigint AS k, coalesce(try_cast(props->>'k' AS double), 0) AS as_double FROM events"

LINES = rf"""
l0 AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l1 AS (SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(list_transform(lines, lambda x: trim(x, {WHITE}))) AS s FROM l0),
l2 AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY line), '') AS next FROM l1),
l3 AS (SELECT *, CASE WHEN regexp_matches(s, '{NUMBERED}') THEN 'numbered' WHEN regexp_matches(s, '{CHINESE}') THEN 'chinese'
  WHEN s <> '' AND length(s) < 50 AND right(s, 1) NOT IN ({_listed(NO_HEADER_ENDS)}) AND next = '' THEN 'heuristic' END AS kind FROM l2),
h AS (SELECT doc_id, line, CASE kind WHEN 'numbered' THEN greatest(1, length(split_part(s, ' ', 1)) - length(replace(split_part(s, ' ', 1), '.', ''))) WHEN 'chinese' THEN 1 ELSE 2 END AS level,
  CASE kind WHEN 'numbered' THEN regexp_extract(s, '{NUMBERED}', 2) ELSE s END AS title, kind FROM l3 WHERE kind IS NOT NULL)
"""

SQL["c3_headers"] = f"WITH {LINES} SELECT * FROM h"

SECTIONS = f"""{LINES},
ends AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS stop, min(line) OVER (PARTITION BY doc_id) AS first FROM h),
parts AS (
  SELECT doc_id, -1 AS line, '{NO_HEADER}' AS header_context, 0 AS header_level, 'implicit' AS header_type, text AS content FROM l0 WHERE doc_id NOT IN (SELECT doc_id FROM h)
  UNION ALL
  SELECT e.doc_id, -1, '{PREAMBLE}', 0, 'implicit', array_to_string(lines[1:first], chr(10)) FROM ends e JOIN l0 USING (doc_id)
  WHERE e.line = first AND first > 0 AND trim(array_to_string(lines[1:first], chr(10)), {WHITE}) <> ''
  UNION ALL
  SELECT e.doc_id, line, title, level, kind, trim(array_to_string(lines[line + 1:coalesce(stop, len(lines))], chr(10)), {WHITE}) FROM ends e JOIN l0 USING (doc_id)
),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS section_index, header_context, header_level, header_type, content FROM parts)
"""
SQL["c4_sections"] = f"WITH {SECTIONS} SELECT * EXCLUDE content, md5(content) AS content FROM sections"


def pieces(source: str, size: int, overlap: int, name: str = "piece") -> str:
    """Recursive CTE ``pieces``, or of another ``name`` (source's columns but content, path, piece): texts of ``source`` of more than ``size`` characters, cut by ever finer separators."""
    marks = ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in SEPARATORS)
    none = "[]::STRUCT(t VARCHAR, long BOOLEAN)[]"
    whole = "CASE WHEN {0} <> '' THEN [{{'t': {0}, 'long': false}}] ELSE " + none + " END"
    parts = f"list_filter(string_split(t, mark), lambda x: trim(x, {WHITE}) <> '')"
    fold = f"""list_reduce(list_transform({parts}, lambda x: {{'out': {none}, 'held': x}}), lambda s, x: CASE
        WHEN length(x.held) > {size} THEN {{'out': list_concat(s.out, {whole.format("s.held")}, [{{'t': x.held, 'long': true}}]), 'held': ''}}
        WHEN s.held = '' THEN {{'out': s.out, 'held': x.held}}
        WHEN length(s.held) + length(mark) + length(x.held) <= {size} THEN {{'out': s.out, 'held': s.held || mark || x.held}}
        ELSE {{'out': list_append(s.out, {{'t': s.held, 'long': false}}), 'held': CASE WHEN least({overlap}, length(s.held)) + length(x.held) <= {size} THEN right(s.held, {overlap}) ELSE '' END || x.held}}
      END, {{'out': {none}, 'held': ''}})"""
    step = max(1, size - overlap)
    slices = f"list_transform(range(0, greatest(1, length(t) - {overlap}), {step}), lambda i: {{'t': substr(t, i + 1, {size}), 'long': false}})"
    return f"""
{name}0 AS (SELECT * EXCLUDE content, []::BIGINT[] AS path, content AS t, 0 AS lvl, length(content) > {size} AS long FROM {source}
  UNION ALL
  SELECT * EXCLUDE (path, t, lvl, long, out, i), list_append(path, i) AS path, out[i].t AS t, lvl + 1 AS lvl, out[i].long AS long
  FROM (SELECT *, unnest(range(1, len(out) + 1)) AS i FROM (
    SELECT * EXCLUDE (mark, f), CASE WHEN lvl < {len(SEPARATORS)} THEN list_concat(f.out, {whole.format("f.held")}) ELSE {slices} END AS out
    FROM (SELECT *, {fold} AS f FROM (SELECT *, coalesce(([{marks}])[lvl + 1], ' ') AS mark FROM {name}0 WHERE long))))),
{name}s AS (SELECT * EXCLUDE (t, lvl, long), t AS piece FROM {name}0 WHERE NOT long)
"""


SQL["c6_structure_split"] = f"""WITH RECURSIVE {SECTIONS}, {pieces("sections", 500, 50)}
SELECT doc_id, section_index, header_context, header_level, header_type, piece AS content, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, path) - 1 AS chunk_index FROM pieces"""

SQL["c7_sentence_windows"] = f"""
WITH s AS (SELECT doc_id, {ATOMS.format("text")} AS s FROM documents),
w AS (SELECT doc_id, s, unnest(range(0, greatest(len(s) - 2, 0) // 19 + 1)) AS window_index FROM s WHERE len(s) > 0)
SELECT doc_id, window_index, window_index * 19 AS first, len(s[window_index * 19 + 1:window_index * 19 + 20]) AS n, md5(array_to_string(s[window_index * 19 + 1:window_index * 19 + 20], '|')) AS digest FROM w
"""

def markdown(text: str) -> str:
    """CTE ``md`` (doc_id, section_index, content, h1 to h4): a text of ``documents`` by its headers."""
    return rf"""
t AS (SELECT doc_id, string_split({text}, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM t),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l),
m AS (SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(line, '^#{{1,4}}\s+\S') THEN length(regexp_extract(line, '^(#+)', 1)) END AS mark FROM f),
n AS (SELECT *, sum(CASE WHEN mark IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS section_index, trim(regexp_replace(line, '^#+\s+', ''), {WHITE}) AS name FROM m),
g AS (SELECT doc_id, section_index, trim(string_agg(line, chr(10) ORDER BY i), {WHITE}) AS content, max(CASE WHEN mark IS NOT NULL THEN mark END) AS mark, max(CASE WHEN mark IS NOT NULL THEN name END) AS name FROM n GROUP BY ALL),
k AS (SELECT *, {", ".join(f"max(CASE WHEN mark = {x} THEN section_index END) OVER w AS p{x}" for x in (1, 2, 3, 4))} FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY section_index)),
md AS (SELECT k.doc_id, k.section_index::int AS section_index, k.content AS content, {", ".join(f"g{x}.name AS h{x}" for x in (1, 2, 3, 4))} FROM k
{" ".join(f"LEFT JOIN g g{x} ON g{x}.doc_id = k.doc_id AND g{x}.section_index = k.p{x} AND k.p{x} > greatest(-1, {', '.join([f'coalesce(k.p{y}, -1)' for y in range(1, x)] or ['-1'])})" for x in (1, 2, 3, 4))}
WHERE k.content <> '' OR k.section_index = 0)
"""


_MARKED = r"regexp_replace(coalesce(text, ''), '(?m)^([A-Za-z]{4}) ', '## \1 ', 'g')"
SQL["c2_markdown"] = f"WITH {markdown(_MARKED)} SELECT * EXCLUDE content, md5(content) AS content FROM md"

_CONJ, _PRON = "|".join(CONJUNCTIONS), "|".join(PRONOUNS)
SCORES = rf"""
p AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev, length(content) AS n, trim(content, {WHITE}) AS bare FROM chunks),
o AS (SELECT *, coalesce(length(regexp_replace(content, '\s', '', 'g')) / nullif(n, 0) * 10, 0) AS density,
  coalesce(list_max(list_filter(range(0, least(n, length(prev)) + 1), lambda i: right(prev, i) = left(content, i))) / nullif(least(n, length(prev)), 0), 0) AS ratio FROM p),
v AS (SELECT *, CASE WHEN n BETWEEN 300 AND 800 THEN 20.0 WHEN n BETWEEN 100 AND 299 THEN 12.0 WHEN n BETWEEN 801 AND 1000 THEN 16.0 WHEN n < 100 THEN 6.0 ELSE 10.0 END::double AS length_score,
  CASE WHEN bare = '' THEN 0 ELSE CASE WHEN right(bare, 1) IN ({_listed(SENTENCE_ENDS)}) THEN 10 ELSE 5 END
    + CASE WHEN regexp_matches(bare, '^({_CONJ})') THEN 0 ELSE 5 END + CASE WHEN regexp_matches(bare, '^({_PRON})') THEN 0 ELSE 5 END END::double AS structure,
  density + (1 - ratio) * 10 AS content_score,
  greatest(0, 20 - 2 * least(5, len(regexp_extract_all(content, '{_PRON}'))) - 3 * least(3, len(regexp_extract_all(content, '{_CONJ}'))))::double AS semantic,
  array_to_string(list_filter([CASE WHEN n < 100 THEN 'merge_with_prev' END, CASE WHEN n > 1000 THEN 'split_further' END, CASE WHEN right(bare, 1) IN ({_listed(CUT_OFF)}) THEN 'extend_boundary' END, 'generate_qa'], lambda x: x IS NOT NULL), ',') AS suggestions,
  array_to_string(list_filter([CASE WHEN n < 100 THEN 'chunk_too_short' END, CASE WHEN n > 1000 THEN 'chunk_too_long' END,
    CASE WHEN right(bare, 1) IN ({_listed(CUT_OFF)}) THEN 'truncated_end' END, CASE WHEN regexp_matches(bare, '^({_PRON})') THEN 'dangling_reference' END,
    CASE WHEN density < 5 THEN 'low_info_density' END, CASE WHEN ratio > 0.5 THEN 'high_overlap' END, 'low_qa_coverage'], lambda x: x IS NOT NULL), ',') AS issues FROM o),
scores AS (SELECT doc_id, chunk_index, length_score AS length, structure, round(content_score, 6) AS content_score, semantic, 0.0::double AS qa,
  round(length_score + structure + content_score + semantic, 6) AS total, issues, suggestions FROM v)
"""
SQL["c11_ingest"] = f"""WITH RECURSIVE {markdown("coalesce(text, '')")}, {SECTIONS},
even AS (SELECT doc_id, source IS NOT NULL AND doc_id % 2 = 0 AS md FROM documents),
md_in AS (SELECT md.doc_id, section_index, content FROM md JOIN even USING (doc_id) WHERE even.md), {pieces("md_in", 500, 0, "md_piece")},
plain_in AS (SELECT s.doc_id, section_index, content FROM sections s JOIN even USING (doc_id) WHERE NOT even.md), {pieces("plain_in", 500, 0, "plain_piece")},
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, path) - 1 AS chunk_index, piece AS content FROM (SELECT * FROM md_pieces UNION ALL SELECT * FROM plain_pieces)), {SCORES},
x AS (SELECT *, md5(content || '1') AS q1, md5(content || '2') AS q2 FROM v),
y AS (SELECT doc_id, chunk_index, content, q1, q2, n >= 100 AS asked, length_score + structure + content_score + semantic + CASE WHEN n >= 100 THEN 20 / 3 + CASE WHEN left(q1, 4) = left(q2, 4) THEN 2.5 ELSE 5 END ELSE 0 END AS total,
  CASE WHEN n >= 100 THEN regexp_replace(suggestions, ',?generate_qa$', '') ELSE suggestions END AS suggestions FROM x),
r AS (SELECT 'chunk-' || md5(content || '-' || doc_id) AS id, doc_id, chunk_index, content, round(total, 6) AS total, suggestions FROM y
  UNION ALL SELECT 'qa-' || md5(q || 'a-' || doc_id), doc_id, chunk_index, 'Question: ' || q || chr(10) || 'Answer: a', NULL, NULL FROM (SELECT *, unnest([q1, q2]) AS q FROM y WHERE asked))
SELECT id, doc_id::VARCHAR AS doc_id, chunk_index, content, 1 AS available_int, total, suggestions FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_index) = 1"""
SQL["q1_chunk_scores"] = f"WITH {CHUNKS}, {SCORES} SELECT * FROM scores"
SQL["q6_qa_scores"] = f"""WITH {CHUNKS}, k AS (SELECT *, chunk_index % 4 AS n FROM chunks)
SELECT doc_id, chunk_index, round(CASE n WHEN 0 THEN 0 ELSE least(n, 3) / 3 * 10 + (1 - greatest(0, n - 2) / n) * 5 END, 6)::double AS qa, n < 2 AS low FROM k"""
SQL["q7_needs_questions"] = f"WITH {CHUNKS} SELECT doc_id, chunk_index, (chunk_index % 4)::INT AS n FROM chunks WHERE chunk_index % 4 < 2 AND length(content) >= 100"
SQL["q10_statistics"] = f"""WITH {CHUNKS}, {SCORES} SELECT count(*) AS chunks, count_if(total >= 80) AS high, count_if(total >= 60 AND total < 80) AS mid, count_if(total < 60) AS low, round(avg(total), 6) AS mean FROM scores"""

BM25 = rf"""
d AS (SELECT doc_id AS id, {TOKENS.format("text")} AS t FROM documents),
x AS (SELECT id, len(t) AS length, unnest(t) AS term FROM d),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT term, id, length, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
bm AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY query_id, id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm),
a AS (SELECT query_id, id, score, rank FROM top WHERE rank <= 30),
qs AS (SELECT item_id AS query_id, list_distinct({TOKENS.format("text")}) AS asked FROM benchmark),
b AS (SELECT query_id, id, coalesce(len(list_intersect(asked, t)) / nullif(len(asked), 0), 0) AS score FROM a JOIN d USING (id) JOIN qs USING (query_id)),
b6 AS (SELECT query_id, id, round(score, 6) AS score FROM b)
"""
SQL["v2_bm25"] = f"WITH {BM25} SELECT * FROM top WHERE rank <= 10"
SQL["v2_bm25_index"] = SQL["v2_bm25_merged"] = SQL["v2_bm25"]
SQL["v11_retrieve"] = f"WITH {BM25}, r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE score >= 0.6) SELECT * FROM r WHERE rank <= 10"
SQL["v9_rerank"] = f"WITH {BM25} SELECT * FROM b6"
HYBRID = f"""{BM25},
kn AS (SELECT item_id AS query_id, e.vec_id AS id, round((1 + list_cosine_similarity(e.embedding::double[], v.embedding::double[])) / 2, 6) AS score
  FROM embeddings e JOIN documents ON doc_id = e.vec_id, benchmark JOIN embeddings v ON item_id = v.vec_id),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kn)
"""
_SUMMED = "s AS (SELECT query_id, id, round(sum(score), 6) AS score FROM (SELECT query_id, id, score FROM {0} UNION ALL SELECT query_id, id, score FROM kr WHERE rank <= 30) GROUP BY ALL)"
_BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {0})"
SQL["v3_hybrid_sum"] = f"WITH {HYBRID}, {_SUMMED.format('a')}, {_BEST.format('s')} SELECT * FROM r WHERE rank <= 10"
SQL["v6_rrf"] = f"""WITH {HYBRID}, u AS (SELECT query_id, id, 1 / (60 + rank) AS s FROM a UNION ALL
SELECT query_id, id, 1 / (60 + rank) FROM kr WHERE rank <= 30) SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY ALL"""
SQL["v13_weighted"] = f"""WITH {HYBRID}, k30 AS (SELECT * FROM kr WHERE rank <= 30), u AS (SELECT query_id, id, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0) * 0.3, 0) AS s FROM a UNION ALL
SELECT query_id, id, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0) * 0.7, 0) FROM k30) SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY ALL"""
_RERANKED = "z AS (SELECT query_id, id, round(coalesce(len(list_intersect(asked, t)) / nullif(len(asked), 0), 0), 6) AS score FROM {0} JOIN d USING (id) JOIN qs USING (query_id))"
_HYBRID_RUN = f"""WITH {HYBRID}, {_SUMMED.format('bm')}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s), c30 AS (SELECT query_id, id FROM c WHERE place <= 30),
{_RERANKED.format('c30')}, {_BEST.format('z WHERE score >= 0.4')} SELECT * FROM r WHERE rank <= 10"""
SQL["v7_hybrid"] = SQL["v7_vector"] = _HYBRID_RUN
SQL["v14_doc_ids"] = f"""WITH {BM25}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM bm WHERE id IN (SELECT unnest(range(0, 60, 3)))), c15 AS (SELECT query_id, id FROM own WHERE place <= 15),
{_RERANKED.format('c15')}, {_BEST.format('z WHERE score >= 0.1')} SELECT * FROM r WHERE rank <= 5"""
SQL["v12_bases"] = f"""WITH {HYBRID}, kb AS (SELECT doc_id AS id, source AS kb_id FROM documents WHERE source IN ('src0', 'src1', 'src2')),
kk AS (SELECT kb_id, query_id, id, score, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, id) AS rank FROM kn JOIN kb USING (id)),
s AS (SELECT kb_id, query_id, id, sum(score) AS score FROM (SELECT kb_id, query_id, id, score FROM bm JOIN kb USING (id) UNION ALL SELECT kb_id, query_id, id, score FROM kk WHERE rank <= 15) GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY kb_id, query_id ORDER BY score DESC, id) AS place FROM s), c15 AS (SELECT kb_id, query_id, id FROM c WHERE place <= 15),
z AS (SELECT kb_id, query_id, id, round(coalesce(len(list_intersect(asked, t)) / nullif(len(asked), 0), 0), 6) AS score FROM c15 JOIN d USING (id) JOIN qs USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY kb_id, query_id ORDER BY score DESC, id) AS rank FROM z WHERE score >= 0.2) SELECT * FROM r WHERE rank <= 5"""
SQL["v5_postings"] = rf"""
WITH d AS (SELECT doc_id AS id, {TOKENS.format("text")} AS t FROM documents), x AS (SELECT id, len(t) AS length, unnest(t) AS term FROM d),
p AS (SELECT term, id, length, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::bigint AS cf, max(length) AS longest FROM p GROUP BY term
"""
SQL["v16_doc_chunks"] = f"""WITH {CHUNKS} SELECT doc_id, count(*) AS hits, min(chunk_index) AS first_hit FROM chunks WHERE list_has_any({TOKENS.format("content")}, ['the', 'of']) GROUP BY doc_id"""

_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS v, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round((1 + list_cosine_similarity(e.embedding::double[], q.v::double[])) / 2, 6) AS score FROM embeddings e, q{where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10
"""
SQL["v1_knn"] = _KNN.format(where="")
SQL["v1_knn_filtered"] = _KNN.format(where=" WHERE e.label = q.label")

REL = """
r AS (SELECT l_orderkey AS c, l_linenumber AS n, l_orderkey::varchar AS source_id, 'part-' || l_partkey AS src_id, 'supp-' || l_suppkey AS dst_id, l_returnflag AS type,
  l_linestatus AS description, l_quantity::int::double AS weight, 'x' || repeat(l_linestatus, l_linenumber::int) AS about FROM lineitem)
"""
SQL["g2_parse"] = f"WITH {REL} SELECT source_id, src_id, dst_id, type, description, weight FROM r"
SQL["g4_entities"] = f"""WITH {REL}, s AS (SELECT src_id, source_id, min((c, n)) AS pos FROM r GROUP BY ALL), t AS (SELECT src_id, string_agg(source_id, ',' ORDER BY pos) AS source_id FROM s GROUP BY src_id)
SELECT src_id AS name, arg_min(type, (c, n)) AS type, arg_max(about, (strlen(about), -c, -n)) AS description, any_value(t.source_id) AS source_id FROM r JOIN t USING (src_id) GROUP BY src_id"""
SQL["g4_relations"] = f"""WITH {REL}, s AS (SELECT src_id, dst_id, source_id, min((c, n)) AS pos FROM r GROUP BY ALL), t AS (SELECT src_id, dst_id, string_agg(source_id, ',' ORDER BY pos) AS source_id FROM s GROUP BY ALL),
u AS (SELECT src_id, dst_id, description, min((c, n)) AS pos FROM r GROUP BY ALL), v AS (SELECT src_id, dst_id, string_agg(description, chr(10) ORDER BY pos) AS description FROM u GROUP BY ALL),
w AS (SELECT src_id, dst_id, arg_min(type, (c, n)) AS type, round(list_reduce(list(weight ORDER BY c, n), lambda a, x: (a + x) / 2), 6) AS weight FROM r GROUP BY ALL)
SELECT src_id, dst_id, type, description, weight, source_id FROM w JOIN t USING (src_id, dst_id) JOIN v USING (src_id, dst_id)"""
SQL["g6_upsert"] = f"""WITH RECURSIVE {REL}, g AS (SELECT src_id AS id, CASE type WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS updated_at, avg(weight) AS weight, max(description) AS description, list_sort(list_distinct(list(dst_id))) AS s FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at) AS n FROM g),
f AS (SELECT * FROM k WHERE n = 1 UNION ALL
  SELECT k.id, k.updated_at, CASE WHEN right(k.id, 1)::int % 2 = 0 THEN f.weight ELSE (f.weight + k.weight) / 2 END,
    CASE WHEN contains(f.description, k.description) THEN f.description ELSE f.description || chr(10) || k.description END, list_concat(f.s, list_filter(k.s, lambda x: NOT list_contains(f.s, x))), k.n
  FROM f JOIN k ON k.id = f.id AND k.n = f.n + 1)
SELECT id, CASE WHEN right(id, 1)::int % 2 = 0 THEN 'entity' ELSE 'relation' END AS graph_type, round(weight, 6) AS weight, description, array_to_string(s, ',') AS source_ids, updated_at
FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1"""

EDGES = """
e AS (SELECT 'part-' || l_partkey AS src_id, 'supp-' || l_suppkey AS dst_id, max(l_quantity) AS weight FROM lineitem GROUP BY ALL),
nodes AS (SELECT 'part-' || p_partkey AS name, p_brand AS type FROM part UNION ALL SELECT 'supp-' || s_suppkey, 'supplier' FROM supplier)
"""
SQL["g9_graph_view"] = f"""WITH {EDGES}, k AS (SELECT * FROM e WHERE src_id IN (SELECT name FROM nodes) AND dst_id IN (SELECT name FROM nodes) ORDER BY src_id, dst_id LIMIT 500),
z AS (SELECT name, count(*) AS val FROM (SELECT src_id AS name FROM k UNION ALL SELECT dst_id FROM k) GROUP BY name) SELECT name, type, val FROM nodes JOIN z USING (name)"""
SQL["a7_degrees"] = f"WITH {EDGES} SELECT name, count(*) AS degree FROM (SELECT src_id AS name FROM e UNION ALL SELECT dst_id FROM e) GROUP BY name"
SQL["j11_neighbours"] = f"WITH {EDGES} SELECT DISTINCT src_id AS name FROM e WHERE dst_id = 'supp-1'"
SQL["g10_search_nodes"] = f"WITH {EDGES} SELECT name, type, 5 AS val FROM nodes WHERE contains(name, 'pp-1') ORDER BY name LIMIT 20"
SQL["g15_reachable"] = f"""WITH {EDGES}, one AS (SELECT DISTINCT src_id AS name FROM e WHERE dst_id = 'supp-1'), two AS (SELECT DISTINCT dst_id AS name FROM e WHERE src_id IN (SELECT name FROM one) AND dst_id <> 'supp-1')
SELECT 'supp-1' AS name, 0 AS hops UNION ALL SELECT name, 1 FROM one UNION ALL SELECT name, 2 FROM two"""
SQL["snk3_keep_last"] = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type"

TENANTS = """
bases AS (SELECT c_custkey AS kb_id, c_nationkey AS tenant_id, c_custkey % 50 AS created_by, CASE WHEN c_mktsegment = 'BUILDING' THEN 'team' ELSE 'me' END AS permission,
  CASE WHEN c_custkey % 5 > 0 THEN 1 ELSE 0 END AS status, c_name AS name, c_mktsegment || '@' || (c_nationkey % 3) AS embedding FROM customer),
members AS (SELECT s_suppkey % 50 AS user_id, s_nationkey AS tenant_id, CASE WHEN s_suppkey % 4 > 0 THEN 1 ELSE 0 END AS status, CASE WHEN s_suppkey % 2 > 0 THEN 'owner' ELSE 'normal' END AS role FROM supplier),
own AS (SELECT DISTINCT tenant_id FROM members WHERE user_id = 7 AND status = 1)
"""
SQL["f1_filter_page"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25"
SQL["a1_count"] = "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'"
SQL["f3_visible"] = f"WITH {TENANTS} SELECT * FROM bases WHERE status = 1 AND EXISTS (SELECT 1 FROM own) AND (created_by = 7 OR (permission = 'team' AND tenant_id IN (SELECT tenant_id FROM own)))"
SQL["f4_keyword"] = "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%12%' OR c_custkey::varchar = '12'"
SQL["f5_in_base"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 1 AND o_orderstatus <> 'P'"
SQL["f17_may_list"] = f"WITH {TENANTS} SELECT o_custkey AS kb_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT kb_id FROM bases WHERE tenant_id IN (SELECT tenant_id FROM own) AND (permission <> 'me' OR created_by = 7))"
SQL["f19_patch"] = "SELECT n_nationkey, CASE WHEN n_nationkey < 10 AND n_nationkey % 2 = 0 THEN 'new-' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation"
SQL["j1_names"] = "SELECT c_custkey, c_nationkey * 2 AS nation, coalesce(n_name, '') AS name FROM customer LEFT JOIN nation ON c_nationkey * 2 = n_nationkey"
SQL["j3_owners"] = f"WITH {TENANTS}, o AS (SELECT tenant_id, min(user_id) AS user_id FROM members WHERE role = 'owner' AND status = 1 GROUP BY tenant_id) SELECT tenant_id, user_id, coalesce(c_name, '') AS name FROM o LEFT JOIN customer ON c_custkey = user_id"
SQL["j6_models"] = f"WITH {TENANTS} SELECT kb_id, tenant_id, 'BUILDING' AS llm_name, (tenant_id % 3)::varchar AS llm_factory, n_name AS api_key FROM bases JOIN nation ON n_nationkey = tenant_id WHERE embedding = 'BUILDING@' || (n_nationkey % 3)"
SQL["a3_grouped"] = "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, min(n_name) FILTER (n_nationkey % 2 > 0) AS base FROM nation GROUP BY n_regionkey"
SQL["a12_histogram"] = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count_if(value <= 1) AS le_0, count_if(value <= 5) AS le_1, count_if(value <= 10) AS le_2, count_if(value <= 50) AS le_3 FROM events GROUP BY event_type"
SQL["a13_seq_ids"] = rf"SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq_id, substr(trim(coalesce(text, ''), {WHITE}), 1, 20) AS title FROM conversations"
SQL["sc30_parts"] = "SELECT l_orderkey, l_linenumber, ntile(3) OVER w AS part, (row_number() OVER w - 1) // 2 AS batch FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)"
SQL["a15_counters"] = f"WITH {CHUNKS} SELECT source, count(DISTINCT doc_id) AS doc_num, count(*) AS chunk_num, sum(strlen(content) // 4)::bigint AS token_num FROM chunks GROUP BY source"
SQL["t4_latest"] = "SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 3"
SQL["snk8_insert_ignore"] = "SELECT c_custkey AS o_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS added FROM customer"
_TASKS = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'init' WHEN 'click' THEN 'retrying' ELSE 'success' END"
SQL["f10_retryable"] = f"""WITH t AS (SELECT event_id AS id, {_TASKS} AS status, event_id % 5 AS retry_times, ts FROM events)
SELECT id, status, retry_times FROM t WHERE (status = 'fail' AND ts <= TIMESTAMP '2024-01-15' AND retry_times < 3) OR (status = 'init' AND ts < TIMESTAMP '2024-01-14 23:55:00') ORDER BY ts, id LIMIT 100"""
SQL["st4_failed"] = f"""SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'fail' ELSE {_TASKS} END AS status, event_id % 5 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS retry_times,
CASE WHEN event_type = 'click' THEN 1705276800 + (30 * 2 ** (event_id % 5))::bigint ELSE floor(epoch(ts))::bigint END AS next_retry FROM events"""
SQL["w3_default"] = "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 AND c_custkey <> 10 THEN 0 ELSE 1 END AS is_default FROM customer"
SQL["w2_compare_and_set"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"
SQL["w4_cascade"] = """SELECT 'bases' AS name, c_custkey AS kb_id, c_name AS key FROM customer WHERE c_custkey <> 1 UNION ALL SELECT 'documents', o_custkey, o_orderkey::VARCHAR FROM orders WHERE o_custkey <> 1
UNION ALL SELECT 'chunks', o_custkey, o_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> 1"""
SQL["st1_messages"] = "SELECT event_id::VARCHAR AS document_id, event_type AS tenant_id FROM events WHERE event_type <> 'error'"
SQL["snk1_put_chunks"] = f"""WITH {CHUNKS} SELECT source AS kb_id, 'chunk-' || md5(content || '-' || doc_id) AS id, length(content) AS chars, max(chunk_index)::DOUBLE AS create_timestamp_flt FROM chunks GROUP BY source, doc_id, content"""

# the library as a table of documents, and their chunks
LIB = """
lib AS (SELECT o_orderkey AS id, o_custkey % 20 AS kb_id, 'file' || o_orderkey || '.md' AS doc_name, CASE WHEN o_orderkey % 3 > 0 THEN 'p/' || o_orderkey END AS storage_path, CASE WHEN o_orderkey % 5 > 0 THEN 'local' ELSE 'web' END AS source_type,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'indexing' END AS run_status FROM orders),
ch AS (SELECT l_orderkey AS doc_id, kb_id, l_linenumber AS chunk_index, l_orderkey || '-' || l_linenumber AS id, l_returnflag || ' ' || l_linestatus AS content FROM lineitem JOIN lib ON lib.id = l_orderkey)
"""
SQL["f5_in_list"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT unnest(range(1, 400, 7))) AND o_orderstatus = 'F'"
SQL["f18_name_contains"] = "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000000')"
SQL["f20_own"] = "SELECT c_custkey, c_nationkey, CASE WHEN (c_custkey <= 10 AND c_nationkey = c_custkey) OR (c_custkey <= 100 AND c_custkey % 10 = 0 AND c_nationkey = 3) THEN 'new' ELSE 'old' END AS status FROM customer"
SQL["j5_by_factory"] = """WITH m AS (SELECT c_mktsegment AS f, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'chat' ELSE 'embedding' END AS kind, c_name || c_mktsegment AS key, CASE WHEN c_custkey % 3 = 0 THEN 'host' || c_custkey END AS base FROM customer)
SELECT f AS llm_factory, CASE WHEN f = 'BUILDING' THEN '' ELSE lower(f) END AS logo, coalesce(min_by(base, name) FILTER (base IS NOT NULL), '') AS api_base,
  md5(string_agg(name || ':' || kind || ':' || left(key, 4) || '****' || right(key, 4), ',' ORDER BY name, kind)) AS models FROM m GROUP BY f"""
SQL["j8_positions"] = SQL["v1_knn"].replace("SELECT * FROM r WHERE rank <= 10", "SELECT query_id, id, CASE rank WHEN 1 THEN 0.1 ELSE 0.2 END::double AS score FROM r WHERE rank IN (1, 6)")
SQL["a14_graph_size"] = f"WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e) AS edges"
SQL["g12_name_vectors"] = f"WITH {EDGES} SELECT name, CASE WHEN name NOT LIKE '%7' THEN 2 ELSE 0 END AS n, CASE WHEN name NOT LIKE '%7' THEN length(name) ELSE 0 END::double AS first FROM nodes"
SQL["f16_listed"] = f"WITH {LIB} SELECT id, kb_id, doc_name, coalesce(storage_path, '') AS storage_path, '' AS parser_config, run_status FROM lib WHERE kb_id = 3 AND id < 2000 AND id % 2 = 1"
SQL["v16_chunk_page"] = f"WITH {LIB} SELECT id, chunk_index, content FROM ch WHERE doc_id = 7 AND (content LIKE '%R%' OR content LIKE '%N%') ORDER BY chunk_index LIMIT 3"
SQL["v17_deleted_chunks"] = f"WITH {LIB} SELECT kb_id, id FROM ch WHERE NOT (kb_id = 3 AND doc_id % 2 = 0)"
SQL["w5_cleared"] = f"""WITH {LIB} SELECT 'documents' AS name, id::VARCHAR AS key FROM lib WHERE NOT (kb_id = 3 AND run_status <> 'indexing')
UNION ALL SELECT 'chunks', ch.id FROM ch JOIN lib ON lib.id = ch.doc_id WHERE NOT (lib.kb_id = 3 AND run_status <> 'indexing')
UNION ALL SELECT 'paths', storage_path FROM lib WHERE kb_id = 3 AND run_status <> 'indexing' AND source_type = 'local' AND storage_path IS NOT NULL"""
SQL["w6_uploads"] = """WITH f AS (SELECT l_orderkey AS u, l_linenumber AS n, (l_quantity * 600000)::bigint AS size FROM lineitem), t AS (SELECT u, count(*) AS files, sum(size) AS bytes FROM f GROUP BY u),
j AS (SELECT n, size, CASE WHEN files > 10 THEN 'too many files' WHEN bytes > 104857600 THEN 'too large' WHEN n = 5 THEN 'no name' ELSE '' END AS reason, CASE WHEN n % 2 = 0 THEN 'pdf' ELSE 'b' || n || 'x' END AS kind FROM f JOIN t USING (u))
SELECT CASE WHEN reason = '' THEN kind ELSE '' END AS doc_type, reason, count(*) AS n, sum(size)::bigint AS bytes FROM j GROUP BY ALL"""
SQL["w7_to_parse"] = f"""WITH {LIB}, c AS (SELECT *, kb_id = 3 AND id < 2000 AND id % 2 = 1 AS chosen FROM lib)
SELECT id, CASE WHEN chosen THEN 'pending' ELSE run_status END AS run_status, CASE WHEN chosen THEN 0.0 ELSE 1.0 END::double AS progress, CASE WHEN chosen THEN 1 ELSE 0 END AS sent FROM c"""
SQL["st5_to_index"] = f"WITH {LIB} SELECT id, run_status FROM lib WHERE run_status = 'pending' AND id IN (SELECT l_orderkey FROM lineitem)"
SQL["st3_republished"] = f"""WITH t AS (SELECT event_id AS id, {_TASKS} AS status, event_id % 5 AS retry_times, ts FROM events),
due AS (SELECT id FROM t WHERE (status = 'fail' AND ts <= TIMESTAMP '2024-01-15' AND retry_times < 3) OR (status = 'init' AND ts < TIMESTAMP '2024-01-14 23:55:00') ORDER BY ts, id LIMIT 100),
o AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'document_index' ELSE 'graph_generate' END AS topic FROM due WHERE id % 3 < 2 AND id % 11 > 0)
SELECT t.id, CASE WHEN o.id IS NULL THEN status ELSE 'retrying' END AS status, topic, o.id::varchar AS message_id FROM t LEFT JOIN o ON o.id = t.id"""
SQL["sc23_register"] = """WITH r AS (SELECT c_custkey, c_custkey % 60 AS n, c_custkey % 7 > 0 AS mail, left(c_name, (c_custkey % 12)::int) AS word, c_custkey % 5 > 0 AS same FROM customer)
SELECT c_custkey, CASE WHEN n NOT BETWEEN 1 AND 50 THEN 'nickname' WHEN NOT mail THEN 'email' WHEN strlen(word) < 6 THEN 'password' WHEN NOT same THEN 'repeated' END AS broken, strlen(word) >= 10 AS strong FROM r"""
SQL["sc25_times"] = "SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc FROM events"
SQL["sc28_prompts"] = """SELECT doc_id, md5('Base: ' || coalesce(source, '') || chr(10) || 'Write 3 questions that this text answers, and their answers, as a JSON list of {"question", "answer"}.' || chr(10) || 'Text:' || chr(10) || coalesce(text, '')) AS prompt,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(replace(text, ' ', ','), ',')) END AS n_tags FROM documents"""
SQL["c10_preview"] = f"SELECT doc_id, section_index AS chunk_index, content FROM ({SQL['c2_markdown']})"

# sentences joined up to topic boundaries, one sentence a step
_TOPICS = """
WITH RECURSIVE d AS (SELECT doc_id, {atoms} AS s FROM documents),
b AS (SELECT doc_id, s, {cuts} AS b FROM d WHERE len(s) > {least}),
f AS (SELECT doc_id, s, b, 1::bigint AS k, s[1] AS held, '' AS header, NULL::varchar AS chunk FROM b
  UNION ALL
  SELECT doc_id, s, b, k + 1,
    CASE WHEN k = len(s) THEN NULL WHEN NOT b[k].topic AND length(held) + length(s[k + 1]) + 1 <= 300 THEN held || ' ' || s[k + 1]
      ELSE CASE WHEN {overlap} > 0 AND length(held) > {overlap} AND NOT b[k].topic THEN right(s[k], {overlap}) || ' ' ELSE '' END || s[k + 1] END,
    CASE WHEN k < len(s) AND b[k].topic THEN b[k].name ELSE header END,
    CASE WHEN k < len(s) AND NOT b[k].topic AND length(held) + length(s[k + 1]) + 1 <= 300 THEN NULL WHEN header = '' THEN held ELSE '【' || header || '】' || chr(10) || held END
  FROM f WHERE k <= len(s)),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::int AS chunk_index, chunk AS content FROM f WHERE chunk IS NOT NULL)
SELECT doc_id, chunk_index, doc_id || '_chunk_' || (chunk_index + 1) AS chunk_id, content FROM c
"""
_NEXT = "list_transform(range(1, len(s)), lambda g: {{'topic': length(s[g + 1]) % 7 = 0, 'name': left(s[g + 1], 8)}})".replace("{{", "{").replace("}}", "}")
SQL["c8_topic_split"] = _TOPICS.format(atoms=ATOMS.format("text"), cuts=_NEXT, least=0, overlap=20)
_FOUND = "list_transform(range(1, len(s)), lambda g: {'topic': CASE WHEN least(20, len(s) - (g - 1) // 19 * 19) % 5 = 4 THEN true ELSE length(s[g]) % 7 = 0 END, 'name': ''})"
SQL["c9_agentic_split"] = _TOPICS.format(atoms=ATOMS.format("text"), cuts=_FOUND, least=1, overlap=0) + "UNION ALL SELECT d.doc_id, 0, d.doc_id::varchar, coalesce(text, '') FROM d JOIN documents USING (doc_id) WHERE len(s) <= 1"
SQL["st2_task_states"] = """WITH o AS (SELECT user_id AS id, floor(epoch(ts))::bigint AS sec, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'success' ELSE 'retrying' END AS outcome FROM events WHERE event_type IN ('error', 'signup', 'click')),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sec, outcome) AS k FROM o), e AS (SELECT id, min(k) FILTER (outcome = 'success') AS last FROM n GROUP BY id),
u AS (SELECT n.* FROM n JOIN e USING (id) WHERE last IS NULL OR k <= last),
g AS (SELECT id, arg_max(outcome, k) AS status, count_if(outcome = 'fail')::int AS retry_times, arg_max(sec, k) FILTER (outcome = 'fail') AS sec FROM u GROUP BY id)
SELECT id, status, retry_times, coalesce(sec + (30 * 2 ** least(retry_times - 1, 30))::bigint, 0) AS next_retry FROM g"""

SQL["v1_ann_recall"] = """
SELECT count_if(vec_id % 100 = 0) AS queries, 10 * count_if(vec_id % 100 = 0) AS wanted, true AS recall_reached, count(*) AS vectors, 100::BIGINT AS compared FROM embeddings
"""

NAMES = r"""
m0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, concat_ws(' ', lower(p_type), p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
m1 AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' ', '-') ELSE name END AS spelt FROM m0),
mentions AS (SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN substr(spelt, 2) ELSE spelt END AS src_id FROM m1),
said AS (SELECT src_id AS name, count(*) AS n, trim(lower(regexp_replace(src_id, '[^\p{L}\p{N}]+', ' ', 'g'))) AS form FROM mentions GROUP BY src_id),
forms AS (SELECT form, list_distinct(list_transform(range(1, length(form) + 1), lambda i: substr(' ' || form || ' ', i, 3))) AS g FROM (SELECT DISTINCT form FROM said)),
gram AS (SELECT form, len(g) AS size, unnest(g) AS gram FROM forms),
shared AS (SELECT a.form AS a, b.form AS b, a.size AS sa, b.size AS sb, count(*) AS n FROM gram a JOIN gram b ON a.gram = b.gram AND a.form <> b.form GROUP BY ALL),
pairs AS (SELECT a, b FROM shared WHERE 100 * n >= 80 * (sa + sb - n)),
reach AS (SELECT form AS node, form AS label FROM forms UNION SELECT p.a, r.label FROM reach r JOIN pairs p ON p.b = r.node),
label AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
best AS (SELECT label, arg_min(name, {'n': -n, 'name': name}) AS canonical FROM said JOIN label ON form = node GROUP BY label),
names AS (SELECT name, canonical FROM said JOIN label ON form = node JOIN best USING (label))
"""
SQL["g14_names"] = f"WITH RECURSIVE {NAMES} SELECT * FROM names"
SQL["g14_resolved"] = f"""WITH RECURSIVE {NAMES},
r AS (SELECT canonical AS src_id, 'supp-' || l_suppkey AS dst_id, l_returnflag, l_orderkey, l_linenumber FROM mentions JOIN names ON src_id = names.name),
s AS (SELECT src_id, dst_id, l_orderkey FROM r GROUP BY ALL)
SELECT r.src_id, r.dst_id, arg_min(l_returnflag, {{'a': l_orderkey, 'b': l_linenumber}}) AS type, count(DISTINCT l_orderkey)::INT AS n_sources,
  (SELECT md5(string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey)) FROM s WHERE s.src_id = r.src_id AND s.dst_id = r.dst_id) AS sources
FROM r GROUP BY r.src_id, r.dst_id"""

SQL["snk2_graph_docs"] = SQL["g6_upsert"] + " UNION ALL SELECT 'supp-' || s_suppkey, 'entity', round(s_acctbal, 6), s_name, '', 0 FROM supplier"

SQL["st2_task_timers"] = """WITH o AS (SELECT user_id * 1000 + dayofyear(ts) AS id, floor(epoch(ts))::bigint AS sec,
  CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 'success' WHEN event_type = 'click' AND user_id % 3 = 1 THEN 'retrying' END AS outcome FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sec, outcome) AS k FROM o WHERE outcome IS NOT NULL), e AS (SELECT id, min(k) FILTER (outcome = 'success') AS last FROM n GROUP BY id),
u AS (SELECT n.* FROM n JOIN e USING (id) WHERE last IS NULL OR k <= last),
g AS (SELECT id, arg_max(outcome, k) AS status, count_if(outcome = 'fail')::int AS retry_times, max(sec) FILTER (outcome = 'fail') AS sec FROM u GROUP BY id),
t AS (SELECT *, status = 'fail' AND retry_times < 3 AS due FROM g)
SELECT id, CASE WHEN due THEN 'retrying' ELSE status END AS status, retry_times, coalesce(sec + (30 * 2 ** least(retry_times - 1, 30))::bigint, 0) AS next_retry, due FROM t"""
SQL["st3_scan"] = f"""WITH t AS (SELECT event_id AS id, {_TASKS} AS status, event_id % 5 AS retry_times, ts FROM events),
d AS (SELECT id, ts, id % 3 < 2 AND id % 11 > 0 AS known FROM t WHERE (status = 'fail' AND ts <= TIMESTAMP '2024-01-15' AND retry_times < 3) OR (status = 'init' AND ts < TIMESTAMP '2024-01-14 23:55:00')),
s0 AS (SELECT * FROM (SELECT * FROM d ORDER BY ts, id LIMIT 100) WHERE known),
s1 AS (SELECT * FROM (SELECT * FROM d WHERE id NOT IN (SELECT id FROM s0) ORDER BY ts, id LIMIT 100) WHERE known),
s2 AS (SELECT * FROM (SELECT * FROM d WHERE id NOT IN (SELECT id FROM s0 UNION ALL SELECT id FROM s1) ORDER BY ts, id LIMIT 100) WHERE known)
SELECT id, CASE WHEN id % 3 = 0 THEN 'document_index' ELSE 'graph_generate' END AS topic, 1::BIGINT AS times, 'retrying' AS status FROM (SELECT id FROM s0 UNION ALL SELECT id FROM s1 UNION ALL SELECT id FROM s2)"""
SQL["st6_batches"] = """WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), b AS (SELECT event_type, n, unnest(range(0, (n + 399) // 400)) AS batch FROM n)
SELECT event_type, batch::INT AS batch, n >= 400 * (batch + 1) AS full, least(400, n - 400 * batch)::INT AS n, least(400, n - 400 * batch) AS different FROM b"""
SQL["st5_pending_once"] = f"WITH {LIB} SELECT DISTINCT user_id::VARCHAR AS document_id, 1::BIGINT AS times FROM events WHERE user_id IN (SELECT id FROM lib WHERE run_status = 'pending')"

SQL["v15_embedding"] = f"""WITH {CHUNKS} SELECT doc_id, chunk_index, md5(content) AS content, length(content)::DOUBLE AS x0,
  (length(content) - length(regexp_replace(content, '[aeiou]', '', 'g')))::DOUBLE AS x1, (length(content) - length(replace(content, ' ', '')))::DOUBLE AS x2, NULL::VARCHAR AS embed_error FROM chunks"""

# the small letters of the documents as Han characters
_HAN = "".join(chr(0x4E00 + 37 * i) for i in range(26))
HAN = f"{CHUNKS}, han AS (SELECT doc_id, chunk_index, translate(content, 'abcdefghijklmnopqrstuvwxyz', '{_HAN}') AS content FROM chunks), runs AS (SELECT *, regexp_extract_all(content, '\\p{{Han}}{{2,}}') AS r FROM han)"
SQL["sc7_han"] = rf"""WITH {HAN} SELECT doc_id, chunk_index, len(r)::INT AS n_runs, md5(array_to_string(r, '|')) AS runs,
  md5(array_to_string(list_sort(list_concat({TOKENS.format("content")}, flatten(list_transform(r, lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))))), '|')) AS tokens FROM runs"""
SQL["q6_han"] = f"""WITH {HAN}, n AS (SELECT *, CASE WHEN chunk_index % 2 = 0 THEN r[1] ELSE reverse(r[1] || '{_HAN[:3]}') END AS named FROM runs WHERE len(r) > 0),
a AS (SELECT *, len(list_distinct([left('0 ' || named, 4), left('1 ' || named, 4)])) AS kinds, CASE WHEN regexp_matches(named, '^\\p{{Han}}{{2,}}$') AND contains(content, named) THEN 2 ELSE 0 END AS matched FROM n)
SELECT doc_id, chunk_index, round(2 / 3 * 10 + (1 - (2 - kinds) / 2) * 5 + matched / 2 * 5, 6)::DOUBLE AS qa FROM a"""

SQL["g11_links"] = f"WITH {EDGES} SELECT src_id, dst_id, weight FROM e WHERE src_id IN (SELECT name FROM nodes) AND dst_id IN (SELECT name FROM nodes) ORDER BY src_id, dst_id LIMIT 500"
SQL["g1_gleaned"] = """WITH t AS (SELECT doc_id, coalesce(text, '') AS content FROM documents)
SELECT doc_id AS source_id, 0 AS record_index, md5(content || '1') AS name, 'T' AS type, 'd' AS description FROM t UNION ALL SELECT doc_id, 1, md5(content || '2'), 'T', 'd' FROM t WHERE length(content) > 200"""
SQL["g5_search_docs"] = SQL["g4_entities"].replace("SELECT src_id AS name,", "SELECT 'entity_' || md5('kb' || name) AS id, 'kb' AS kb_id, 'entity' AS graph_type, name AS entity_name, description, source_id AS source_ids, name || ': ' || description AS content_with_weight FROM (SELECT src_id AS name,") + ")"
SQL["snk4_single"] = "SELECT o_orderkey, (o_totalprice / 3)::FLOAT::DOUBLE AS x, 0.1::FLOAT::DOUBLE AS y FROM orders"
SQL["snk7_appended"] = "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN upper(n_name) ELSE n_name END AS n_name, CASE WHEN n_nationkey < 10 THEN 100 ELSE 200 END AS created_time, CASE WHEN n_nationkey < 10 THEN 100 ELSE 200 END AS updated_time FROM nation"
SQL["t8_point"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7"
SQL["sc21_object_keys"] = r"SELECT page_id, 'tenant_' || page_id % 7 || '/kb_' || page_id % 3 || '/' || md5(url) || regexp_extract(regexp_replace(url, '\?.*$', ''), '\.[^./]+$') AS key FROM pages"


def _seen() -> str:
    mode, model, failed, kb = "CASE WHEN event_id % 2 = 0 THEN 'hybrid' ELSE 'vector' END", "'m' || user_id % 2", "'e' || event_id % 2", "user_id % 3"
    show = lambda **labels: " || ',' || ".join(f"""'{n}="' || {x} || '"'""" for n, x in labels.items())
    rows = [
        ("rag_retrieval_duration_seconds", "click view", "value / 16", show(mode=mode, kb_id=kb)), ("rag_retrieval_total", "click view", "1", show(mode=mode, kb_id=kb)),
        ("rag_retrieval_errors_total", "error", "1", show(mode=mode, kb_id=kb, error_type=failed)), ("rag_rerank_duration_seconds", "click", "value / 16", show(model=model)),
        ("rag_embedding_duration_seconds", "purchase", "value / 16", show(model=model)), ("rag_chunks_returned", "view", "floor(value)", show(mode=mode)),
        ("rag_indexing_duration_seconds", "signup purchase", "value", show(kb_id=kb, status="event_type")), ("rag_indexing_total", "signup", "1", show(kb_id=kb)),
        ("rag_indexing_errors_total", "error", "1", show(kb_id=kb, error_type=failed)), ("rag_chunks_indexed", "signup", "floor(value * 4)", show(kb_id=kb)),
    ]
    kinds = lambda x: ", ".join(f"'{k}'" for k in x.split())
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {labels} AS labels, ({value})::DOUBLE AS value FROM events WHERE event_type IN ({kinds(of)})" for m, of, value, labels in rows)


_BOUNDS = " UNION ALL ".join(f"SELECT '{m}' AS metric, unnest({[float(x) for x in b]}::DOUBLE[]) AS le" for m, (_, b) in HISTOGRAMS.items())
SQL["a12_families"] = f"""WITH seen AS ({_seen()}), whole AS (SELECT metric, labels, count(*) AS n, round(sum(value), 6) AS total FROM seen GROUP BY ALL), bounds AS ({_BOUNDS})
SELECT metric, labels, NULL::DOUBLE AS le, n, total FROM whole
UNION ALL SELECT w.metric, w.labels, le, (SELECT count(*) FROM seen s WHERE s.metric = w.metric AND s.labels = w.labels AND value <= le), total FROM whole w JOIN bounds USING (metric)"""

SQL["v11_stored"], SQL["v7_stored"] = SQL["v11_retrieve"], SQL["v7_hybrid"]
SQL["src1_files"] = "SELECT n_nationkey, n_name AS name, true AS own_id FROM nation"
SQL["snk5_messages"] = "SELECT 'document_index' AS topic, o_orderkey::VARCHAR AS document_id, o_custkey::VARCHAR AS base FROM orders WHERE o_orderkey % 5 > 0"
SQL["src7_folder"] = "SELECT event_id::VARCHAR AS document_id, event_type AS tenant_id FROM events WHERE event_id % 10 > 0"
SQL["snk6_marked"] = f"WITH {LIB} SELECT id, CASE WHEN kb_id = 3 AND id % 2 = 1 AND id < 2000 THEN 'pending' ELSE run_status END AS run_status, CASE WHEN kb_id = 3 AND id % 2 = 1 AND id < 2000 THEN 0.0 ELSE 1.0 END::DOUBLE AS progress FROM lib"
