"""DuckDB SQL for those of the nine problems' queries that SQL can express over whole tables."""

from __future__ import annotations


_GRAMS = """
            t AS (SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS ts FROM chunks),
            s AS (
                SELECT DISTINCT chunk_id, unnest([array_to_string(ts[i : i + 2], ' ') FOR i IN range(1, len(ts) - 1)]) AS gram
                FROM t WHERE len(ts) >= 40
            )"""
_USABLE = """
            v AS (
                SELECT 'vector' AS field, chunk_id, vector::DOUBLE[] AS v FROM chunks
                UNION ALL SELECT 'summary_vector', chunk_id, summary_vector::DOUBLE[] FROM chunks
            ), u AS (
                SELECT * FROM v WHERE len(v) = 64 AND len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
                AND len([x FOR x IN v IF x <> 0]) > 0
            )"""
_BACKSLASHED = "length(t) - length(regexp_replace(t, '[\\n\\r\\t\"\\\\]', '', 'g'))"
_ANGLE = "4 * (length(t) - length(replace(t, '&', ''))) + 3 * (length(t) - length(regexp_replace(t, '[<>]', '', 'g')))"
_QUOTES = "5 * (length(t) - length(replace(t, '\"', '')))"


def llm_oracle_sql() -> dict[str, str]:
    return {
        "p2_contained": r"""
            WITH d AS (SELECT DISTINCT file_path, language, repo, id, content, start_line, end_line FROM chunks),
            f AS (
                SELECT file_path, language, any_value(repo) AS repo,
                    md5(string_agg(content, chr(10) ORDER BY start_line, end_line, id, content)) AS h,
                    string_agg(content, chr(10) ORDER BY start_line, end_line, id, content) AS text FROM d GROUP BY 1, 2
            ), x AS (SELECT h, unnest(string_split(any_value(text), chr(10))) AS line FROM f GROUP BY h),
            l AS (
                SELECT DISTINCT h, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM x
                WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) >= 12 AND regexp_matches(line, '([\p{L}\p{N}_].*){6}')
            ), df AS (SELECT line, count(*) AS texts FROM l GROUP BY 1),
            n AS (SELECT h, count(*) AS lines, count(*) FILTER (WHERE texts <= 50) AS size FROM l JOIN df USING (line) GROUP BY 1),
            rare AS (
                SELECT x.h AS a, y.h AS b, count(*) AS common FROM l x JOIN df USING (line) JOIN l y USING (line)
                WHERE texts BETWEEN 2 AND 50 AND x.h <> y.h GROUP BY 1, 2
            ), every AS (
                SELECT x.h AS a, y.h AS b, count(*) AS common, any_value(lines) AS lines
                FROM (SELECT l.*, lines FROM l JOIN n USING (h) WHERE 2 * size < lines) x JOIN l y USING (line) WHERE x.h <> y.h GROUP BY 1, 2
            ), share AS (
                SELECT a, b, common / size AS share FROM rare JOIN n ON h = a WHERE 2 * size >= lines AND common / size >= 0.8
                UNION ALL SELECT a, b, common / lines FROM every WHERE common / lines >= 0.8
                UNION ALL SELECT DISTINCT h, h, 1.0::DOUBLE FROM l
            )
            SELECT f.file_path, f.language, round(max(share), 6) AS contained
            FROM f JOIN share ON a = f.h JOIN f g ON g.h = b AND g.repo IS DISTINCT FROM f.repo GROUP BY 1, 2""".replace("\\\\", "\\"),
        "p3_groups": f"""
            WITH RECURSIVE {_GRAMS}, k AS (SELECT chunk_id, md5(string_agg(gram, '|' ORDER BY gram)) AS key FROM s GROUP BY 1),
            c AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS rows FROM k),
            g AS (SELECT * FROM s WHERE chunk_id IN (SELECT class_id FROM c)), n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
            p AS (
                SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS common
                FROM g x JOIN g y ON x.gram = y.gram AND x.chunk_id <> y.chunk_id GROUP BY 1, 2
            ), e AS (
                SELECT a, b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE common >= 0.6 * (x.n + y.n - common)
            ), r AS (
                SELECT DISTINCT class_id AS a, class_id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
            ), m AS (SELECT a, min(b) AS group_id FROM r GROUP BY 1),
            o AS (SELECT e.a, sum(q.rows) AS others FROM e JOIN (SELECT DISTINCT class_id, rows FROM c) q ON q.class_id = e.b GROUP BY 1)
            SELECT c.chunk_id, c.class_id, (coalesce(others, 0) + c.rows - 1)::BIGINT AS links, group_id
            FROM c JOIN m ON m.a = c.class_id LEFT JOIN o ON o.a = c.class_id""",
        "p4_queries": f"""
            WITH {_USABLE}, c AS (
                SELECT a.field, a.chunk_id, b.chunk_id AS other, list_cosine_similarity(a.v, b.v) AS s
                FROM u a JOIN u b ON a.field = b.field AND a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0
            ), r AS (SELECT *, row_number() OVER (PARTITION BY field, chunk_id ORDER BY s DESC, other)::INT AS rank FROM c)
            SELECT field, chunk_id, other AS chunk_id_b, round(s, 6) AS cosine, rank FROM r WHERE rank <= 10""",
        "p6_found": r"""
            WITH RECURSIVE c AS (
                SELECT chunk_id, coalesce(start_line, 0) AS base, string_split(content, chr(10)) AS ls FROM chunks WHERE length(content) > 4000
            ), p AS (
                SELECT chunk_id, base, len(ls) AS n, [regexp_full_match(x, '\s*') FOR x IN ls] AS blank,
                    list_concat([0::BIGINT], [list_sum([length(y) + 1 FOR y IN ls[1 : i]])::BIGINT FOR i IN range(1, len(ls) + 1)]) AS upto
                FROM c WHERE list_max([length(x) FOR x IN ls]) <= 4000
            ), r AS (
                SELECT chunk_id, 0 AS piece_no, 0::BIGINT AS s, -1::BIGINT AS before FROM p
                UNION ALL
                SELECT chunk_id, piece_no + 1,
                    list_min([t FOR t IN range(greatest(fin - 2, s + 1), fin + 2) IF t = fin + 1 OR upto[fin + 3] - upto[t + 1] - 1 <= 4000]), fin
                FROM (
                    SELECT *, CASE WHEN e = n - 1 THEN e ELSE
                        coalesce(list_max([i FOR i IN range(s, e + 1) IF i > before AND NOT blank[i + 1] AND blank[i + 2]]), e) END AS fin
                    FROM (SELECT *, list_max([b FOR b IN range(s, n) IF upto[b + 2] - upto[s + 1] - 1 <= 4000]) AS e FROM r JOIN p USING (chunk_id))
                ) WHERE fin < n - 1
            ), f AS (
                SELECT *, CASE WHEN e = n - 1 THEN e ELSE
                    coalesce(list_max([i FOR i IN range(s, e + 1) IF i > before AND NOT blank[i + 1] AND blank[i + 2]]), e) END AS fin
                FROM (SELECT *, list_max([b FOR b IN range(s, n) IF upto[b + 2] - upto[s + 1] - 1 <= 4000]) AS e FROM r JOIN p USING (chunk_id))
            )
            SELECT DISTINCT chunk_id, piece_no::INT AS piece_no, (base + s)::INT AS start_line, (base + fin)::INT AS end_line FROM f""".replace("\\\\", "\\"),
        "p7_items": """
            WITH w AS (
                SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents
                UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM eval_items
            ), g AS (
                SELECT side, id, i, array_to_string(ws[i : i + 11], ' ') AS gram
                FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12)
            ), h AS (
                SELECT d.id AS doc_id, m.id AS item_id, d.i, d.i - m.i AS shift FROM g d JOIN g m USING (gram) WHERE d.side = 'd' AND m.side = 'i'
            ), o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS island FROM h),
            q AS (SELECT *, i - min(i) OVER (PARTITION BY doc_id, item_id, shift, island) + 12 AS run FROM o),
            m AS (SELECT doc_id, i, max(run) AS run FROM q GROUP BY 1, 2),
            f AS (SELECT doc_id, item_id, max(m.run) AS longest FROM (SELECT DISTINCT doc_id, item_id, i FROM h) JOIN m USING (doc_id, i) GROUP BY 1, 2)
            SELECT item_id, count(*) AS documents, max(longest)::INT AS longest FROM f GROUP BY 1""",
        "p9_limits": f"""
            WITH d AS (
                SELECT DISTINCT source, CASE WHEN regexp_matches(text[-12:], '(\\[(\\.\\.\\.|…)\\]|\\((\\.\\.\\.|…)\\)|\\.\\.\\.|…)\\s*$')
                    THEN regexp_replace(text, '\\s*(\\[(\\.\\.\\.|…)\\]|\\((\\.\\.\\.|…)\\)|\\.\\.\\.|…)\\s*$', '')
                    ELSE rtrim(text, chr(65533)) END AS t
                FROM documents WHERE text IS NOT NULL
            ), n AS (
                SELECT source, t, length(t) AS chars, octet_length(encode(t)) AS octets, length(t) - length(replace(t, chr(10), '')) AS ends,
                    2 * length(t) - length(regexp_replace(t, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS wide,
                    length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) AS others,
                    {_ANGLE} AS angle, {_QUOTES} AS quotes, {_BACKSLASHED} AS slashed FROM d
            ), u AS (
                SELECT source, t, unnest([
                    {{'counting': 'chars', 'length': chars}}, {{'counting': 'utf8', 'length': octets}}, {{'counting': 'utf16', 'length': wide}},
                    {{'counting': 'html', 'length': chars + angle}}, {{'counting': 'html_quotes', 'length': chars + angle + quotes}},
                    {{'counting': 'html_utf8', 'length': octets + angle}}, {{'counting': 'html_quotes_utf8', 'length': octets + angle + quotes}},
                    {{'counting': 'json', 'length': chars + slashed}}, {{'counting': 'json_utf8', 'length': octets + slashed}},
                    {{'counting': 'json_ascii', 'length': wide + 5 * (others + wide - chars) + slashed}},
                    {{'counting': 'crlf', 'length': chars + ends}}, {{'counting': 'crlf_utf8', 'length': octets + ends}}
                ], recursive := true) FROM n
            ), l AS (SELECT source, counting, length::INT AS length, count(*) AS texts FROM u WHERE length > 0 GROUP BY 1, 2, 3),
            f AS (
                SELECT *, sum(texts) OVER (PARTITION BY source, counting ORDER BY ln(length) RANGE BETWEEN 0.10536051565782628::DOUBLE PRECEDING AND UNBOUNDED FOLLOWING) AS near,
                    coalesce(sum(texts) OVER (PARTITION BY source, counting ORDER BY length RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beyond FROM l
            )
            SELECT source, counting, length, texts FROM f WHERE texts >= 5 AND beyond * 10 <= texts AND texts >= near * 0.3""",
        "p3_found": """
            WITH t AS (
                SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS ts FROM chunks
            ), s AS (
                SELECT DISTINCT chunk_id, unnest([array_to_string(ts[i : i + 2], ' ') FOR i IN range(1, len(ts) - 1)]) AS gram
                FROM t WHERE len(ts) >= 40
            ), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
            p AS (
                SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS common
                FROM s a JOIN s b ON a.gram = b.gram AND a.chunk_id < b.chunk_id GROUP BY 1, 2
            )
            SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b
            WHERE common >= 0.6 * (x.n + y.n - common)""",
        "p4_found": """
            WITH v AS (
                SELECT 'vector' AS field, chunk_id, vector::DOUBLE[] AS v FROM chunks
                UNION ALL SELECT 'summary_vector', chunk_id, summary_vector::DOUBLE[] FROM chunks
            ), u AS (
                SELECT * FROM v WHERE len(v) = 64 AND len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
                AND len([x FOR x IN v IF x <> 0]) > 0
            ), c AS (
                SELECT a.field, a.chunk_id AS id, b.chunk_id AS other, list_cosine_similarity(a.v, b.v) AS s
                FROM u a JOIN u b ON a.field = b.field AND a.chunk_id <> b.chunk_id
            ), r AS (
                SELECT field, id, other, row_number() OVER (PARTITION BY field, id ORDER BY s DESC, other) AS n
                FROM c WHERE s >= 0.9
            )
            SELECT DISTINCT field, least(id, other) AS chunk_id_a, greatest(id, other) AS chunk_id_b FROM r WHERE n <= 10""",
        "p7_found": """
            WITH w AS (
                SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents
                UNION ALL
                SELECT 'i', item_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM eval_items
            ), g AS (
                SELECT side, id, array_to_string(ws[i : i + 11], ' ') AS gram
                FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12)
            )
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id
            FROM g d JOIN g i USING (gram) WHERE d.side = 'd' AND i.side = 'i'""",
        "p8_found": """
            WITH t AS (SELECT sum(length(text)) AS total FROM documents),
                 s AS (SELECT source, sum(length(text)) AS own FROM documents GROUP BY source)
            SELECT m.source FROM mix_targets m LEFT JOIN s USING (source), t
            WHERE coalesce(own, 0) * max_repeat < target_share * total""",
    }
