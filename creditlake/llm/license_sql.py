"""The licence scan of lines, runs of lines, whole short texts and directories in DuckDB SQL, over the query's own paths.

Whole licences (license_texts) are left to tests: none of their texts is in the tables."""

from __future__ import annotations

from .licenses import FILE_COSINE, LINE_COSINE, TEMPLATES, python_terms

_SPLIT = "list_filter(string_split_regex(lower({}), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_ROWS = ", ".join(
    f"('{license_}', {nth}, '{term}', {python_terms(text).count(term)})"
    for nth, (license_, text) in enumerate((n, x) for n, texts in sorted(TEMPLATES.items()) for x in texts)
    for term in sorted(set(python_terms(text)))
)
SQL = f"""WITH tf0 AS (SELECT * FROM (VALUES {_ROWS}) AS v(license, template, term, tf)),
docs AS (SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', replace(replace(coalesce(source, 'none'), '%', '%25'), '/', '%2F'), cast(doc_id // 10000 AS varchar), cast(doc_id // 100 AS varchar), cast(doc_id AS varchar)) END AS path, row_number() OVER () AS nr FROM documents),
texts AS (SELECT text, min(nr) AS doc FROM docs WHERE text IS NOT NULL GROUP BY text),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT nr, unnest({_SPLIT.format("text")}) AS term FROM docs WHERE text IS NOT NULL) x WHERE term IN (SELECT term FROM tf0) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tf0) t LEFT JOIN df USING (term)),
other AS (SELECT avg(idf) AS other FROM idf),
weights AS (SELECT license, template, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS w, sum(tf) OVER (PARTITION BY template) AS size FROM tf0 JOIN idf USING (term)),
lines AS (SELECT doc, line, nth FROM (SELECT doc, string_split(text, chr(10)) AS ls FROM texts) t, unnest(ls) WITH ORDINALITY AS u(line, nth)),
line_terms AS (SELECT doc, nth, line, {_SPLIT.format("line")} AS terms FROM lines),
starts AS (SELECT DISTINCT doc, cast(sum(len(terms)) OVER (PARTITION BY doc ORDER BY nth) - len(terms) AS bigint) AS start FROM line_terms),
whole AS (SELECT doc, text, {_SPLIT.format("text")} AS terms FROM texts),
occurs AS (SELECT doc, nth - 1 AS pos, term FROM whole, unnest(terms) WITH ORDINALITY AS u(term, nth) WHERE term IN (SELECT term FROM tf0)),
covered AS (SELECT doc, start, template, size FROM (SELECT DISTINCT s.doc, s.start, w.template, w.size, w.term, w.w FROM starts s JOIN occurs o ON o.doc = s.doc JOIN weights w ON w.term = o.term AND o.pos >= s.start AND o.pos < s.start + w.size) x GROUP BY doc, start, template, size HAVING sum(w * w) >= {LINE_COSINE**2} - 1e-9),
units AS (SELECT doc, 'header' AS kind, terms FROM line_terms UNION ALL SELECT doc, 'file', terms FROM whole
    UNION ALL SELECT DISTINCT c.doc, 'header', list_slice(h.terms, c.start + 1, cast(c.start + c.size AS bigint)) FROM covered c JOIN whole h ON h.doc = c.doc),
numbered AS (SELECT row_number() OVER () AS u, * FROM units WHERE len(list_intersect(terms, (SELECT list(DISTINCT term) FROM tf0))) > 0),
counted AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(terms) AS term FROM numbered) x GROUP BY u, term),
weighed AS (SELECT u, term, tf * coalesce(idf, other) AS x FROM counted LEFT JOIN idf USING (term) CROSS JOIN other),
norms AS (SELECT u, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY u),
cosines AS (SELECT u, license, round(sum(x * w) / any_value(norm), 9) AS cosine FROM weighed JOIN weights USING (term) JOIN norms USING (u) GROUP BY u, license, template),
best AS (SELECT u, first(license ORDER BY cosine DESC, license) AS license, max(cosine) AS cosine FROM cosines GROUP BY u),
found AS (SELECT doc, kind, license, cosine FROM best JOIN numbered USING (u) WHERE cosine >= CASE kind WHEN 'header' THEN {LINE_COSINE} ELSE {FILE_COSINE} END),
own AS (SELECT t.text, kind, license, cosine FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc ORDER BY kind, cosine DESC, license) = 1) f JOIN texts t ON t.doc = f.doc),
placed AS (SELECT d.doc_id, d.path, o.license, o.kind, o.cosine, regexp_replace(d.path, '/[^/]*$', '') AS dir FROM docs d LEFT JOIN own o ON d.text = o.text),
holders AS (SELECT dir AS above, path AS from_path, license AS got, cosine AS got_cosine FROM placed WHERE kind = 'file' AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, license) = 1),
near AS (SELECT p.dir, h.* FROM (SELECT DISTINCT dir FROM placed WHERE dir IS NOT NULL) p JOIN holders h ON p.dir = h.above OR starts_with(p.dir, h.above || '/') QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(h.above) DESC) = 1)
SELECT doc_id, path, coalesce(license, got) AS license, CASE WHEN license IS NOT NULL THEN kind WHEN got IS NOT NULL THEN 'inherited' END AS origin, coalesce(cosine, got_cosine) AS cosine, CASE WHEN license IS NULL THEN from_path END AS from_path FROM placed LEFT JOIN near USING (dir)"""
