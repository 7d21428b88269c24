"""DuckDB statements for the queries of this subpackage that SQL can express."""

from .lookalike import form_sql

SITE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?//', ''), '[/?#\\].*$', ''), '^.*@', ''), ':\d*$', ''), '^www\.', '')"

REPEATED = f"""d AS (SELECT DISTINCT ref_id, {SITE} AS site, body FROM source_documents WHERE url IS NOT NULL AND url <> '' AND body IS NOT NULL),
s AS (SELECT site, count(DISTINCT ref_id) AS docs FROM d WHERE site <> '' GROUP BY site),
l AS (SELECT ref_id, site, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no FROM d WHERE site <> ''),
n AS (SELECT ref_id, site, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS k FROM l),
c AS (SELECT site, k, count(DISTINCT ref_id) AS df FROM n WHERE k <> '' GROUP BY site, k),
f AS (SELECT DISTINCT ref_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN c USING (site, k) JOIN s USING (site) WHERE df >= 5 AND df * 10 >= docs)"""

SQL = {
    "p3_found": f"WITH {REPEATED} SELECT ref_id, line_no FROM f",
    "p3_clean": f"""WITH {REPEATED}, b AS (SELECT DISTINCT ref_id, body FROM source_documents), g AS (SELECT ref_id, list(line_no) AS cut FROM f GROUP BY ref_id), k AS (SELECT b.ref_id, body, coalesce(cut, []) AS cut, string_split(body, chr(10)) AS lines FROM b LEFT JOIN g USING (ref_id))
SELECT DISTINCT ref_id, CASE WHEN body IS NOT NULL THEN array_to_string(list_transform(list_filter(list_zip(lines, range(1, len(lines) + 1)), lambda x: NOT list_contains(cut, x[2])), lambda x: x[1]), chr(10)) END AS body FROM k""",
    "p5_found": """
SELECT DISTINCT field, rec_id, chunk_id FROM (
SELECT 'SourceDocument.body' AS field, CAST(ref_id AS BIGINT) AS rec_id, -1 AS chunk_id, body AS t FROM source_documents
UNION ALL SELECT 'EvidenceChunk.text', CAST(ref_id AS BIGINT), chunk_id, text FROM evidence_chunks
UNION ALL SELECT 'Document.text', doc_id, -1, text FROM documents) JOIN size_limits USING (field) WHERE unit = 'char' AND length(t) > max_size
""",
    "p10_canonical": f"SELECT doc_id, {form_sql('text')} AS canonical FROM documents",
    "p10_classes": f"""
WITH f AS (SELECT DISTINCT doc_id, text, {form_sql('text')} AS form FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, md5(form) AS look, md5(text) AS spelling FROM f WHERE regexp_matches(form, '[^\\s]'))
SELECT DISTINCT doc_id, look, spelling FROM k WHERE look IN (SELECT look FROM k GROUP BY look HAVING count(DISTINCT spelling) > 1)
""",
    "p10_found": f"""
WITH f AS (SELECT DISTINCT doc_id, text, {form_sql('text')} AS look FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.look, '[^\\s]')
""",
}
