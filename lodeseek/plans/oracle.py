"""DuckDB SQL for the core's queries."""

from __future__ import annotations

_USABLE = "len({0}) = 64 AND len([x FOR x IN {0} IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN {0} IF x <> 0]) > 0"
_V, _S = _USABLE.format("vector"), _USABLE.format("summary_vector")

_QUERY = f"q AS (SELECT vector::DOUBLE[] AS q FROM chunks WHERE {_V} ORDER BY chunk_id LIMIT 1)"
_CONTENT = f"""
    content AS (
        SELECT c.*, list_distance(vector::DOUBLE[], q) AS score FROM (SELECT * FROM chunks WHERE {_V}) c, q
    )"""
_SUMMARY = f"""
    summaries AS (
        SELECT c.*, list_distance(summary_vector::DOUBLE[], q) AS score
        FROM (SELECT * FROM chunks WHERE summary IS NOT NULL AND {_S}) c, q
    )"""
_FUSED = f"""
    {_QUERY}, {_CONTENT}, {_SUMMARY},
    lists AS (
        SELECT 0 AS list, row_number() OVER (ORDER BY score, chunk_id) AS r, * FROM content QUALIFY r <= 10
        UNION ALL
        SELECT 1, row_number() OVER (ORDER BY score, chunk_id) AS r, * FROM summaries QUALIFY r <= 10
    ), fused AS (
        SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score, arg_min(chunk_id, list * 1000 + r) AS chunk_id,
            arg_min(file_path, list * 1000 + r) AS file_path, arg_min(start_line, list * 1000 + r) AS start_line,
            arg_min(end_line, list * 1000 + r) AS end_line, arg_min(symbol, list * 1000 + r) AS symbol,
            arg_min(content, list * 1000 + r) AS content, arg_min(struct_pack(s := summary), list * 1000 + r).s AS summary
        FROM lists GROUP BY id ORDER BY score DESC, id LIMIT 10
    )"""

_LISTED = r"regexp_matches(rel_path, '\.(py|rs|go|java)$') AND NOT regexp_matches(rel_path, '(^|/)\.[^/]+/')"
_STORED = f"""
    stored AS (
        SELECT *, CASE WHEN ('0x' || file_hash[1:4])::INT % 7 = 0 THEN 'old' || file_hash ELSE file_hash END AS stored_hash
        FROM chunks WHERE ('0x' || file_hash[1:4])::INT % 10 <> 0
    ), listing AS (
        SELECT rel_path AS file_path, bytes, sha256(bytes) AS file_hash FROM source_files WHERE {_LISTED}
    ), status AS (
        SELECT coalesce(l.file_path, s.file_path) AS file_path, l.bytes,
            CASE WHEN l.file_path IS NULL THEN 'removed' WHEN l.file_hash IS NULL THEN 'unreadable'
                 WHEN s.stored_hash IS NULL THEN 'new' WHEN s.stored_hash = l.file_hash THEN 'unchanged' ELSE 'changed' END AS status
        FROM listing l FULL JOIN (SELECT file_path, min(stored_hash) AS stored_hash FROM stored GROUP BY 1) s USING (file_path)
    )"""
_TEXT_OK = "(octet_length(bytes) > 0 AND TRY(decode(bytes)) IS NOT NULL)"
_LINES = r"string_split(regexp_replace(regexp_replace({0}, '\r?\n\z', ''), '\r\n', chr(10), 'g'), chr(10))"


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _windows(source: str, key: str, text: str, size: int) -> str:
    """Windows of the lines of ``text``: key, id, start_line, end_line, content."""
    return f"""
        SELECT {key} || ':' || s AS id, {key}, s AS start_line, least(s + {size}, len(ls)) - 1 AS end_line,
            array_to_string(ls[s + 1 : s + {size}], chr(10)) AS content
        FROM (
            SELECT {key}, ls, unnest(range(0, len(ls), {size}))::INT AS s
            FROM (SELECT {key}, {_LINES.format(text)} AS ls FROM {source} WHERE {text} <> '')
        )"""


_EXTENSION = r"regexp_extract(rel_path, '[^/]\.([^./]+)$', 1)"


def core_oracle_sql() -> dict[str, str]:
    status = {
        f"{s}_files": f"WITH {_STORED} SELECT file_path FROM status WHERE status = '{s}'"
        for s in ("new", "changed", "unchanged", "removed")
    }
    return status | {
        "knn_embeddings": """
            WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
            SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS score
            FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10""",
        "knn_content": f"""
            WITH {_QUERY}, {_CONTENT} SELECT chunk_id, file_path, round(score, 6) AS score
            FROM content ORDER BY content.score, chunk_id LIMIT 10""",
        "knn_prefiltered": f"""
            WITH {_QUERY}, {_SUMMARY} SELECT chunk_id, file_path, round(score, 6) AS score
            FROM summaries ORDER BY summaries.score, chunk_id LIMIT 10""",
        "knn_squared": f"""
            WITH {_QUERY}, {_CONTENT} SELECT chunk_id, round(score * score, 6) AS score
            FROM content ORDER BY content.score, chunk_id LIMIT 10""",
        "rrf_fused": f"WITH {_FUSED} SELECT id, chunk_id, round(score, 8) AS score FROM fused",
        "find_min_score": f"""
            WITH {_QUERY}, {_CONTENT}, top AS (SELECT * FROM content ORDER BY score, chunk_id LIMIT 50)
            SELECT chunk_id, round(score, 6) AS score FROM top WHERE top.score >= 1.0""",
        "find_max_distance": f"""
            WITH {_QUERY}, {_CONTENT}, top AS (SELECT * FROM content ORDER BY score, chunk_id LIMIT 50)
            SELECT chunk_id, round(score, 6) AS score FROM top WHERE top.score <= 1.1""",
        "query_min_score": f"WITH {_FUSED} SELECT id, round(score, 8) AS score FROM fused WHERE fused.score >= 0.0155",
        "ranked_results": f"""
            WITH {_FUSED} SELECT row_number() OVER (ORDER BY fused.score DESC, id)::INT AS rank, id, file_path, start_line, end_line,
                round(score, 8) AS score FROM fused WHERE fused.score >= 0.0145""",
        "render_text_line": f"""
            WITH {_FUSED}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM fused)
            SELECT rank, printf('[%d] rrf:%.4f  %s:%d-%d', rank, score, file_path, start_line, end_line)
                || CASE WHEN coalesce(symbol, '') = '' THEN '' ELSE '  ' || symbol END AS line FROM n""",
        "render_json": f"""
            WITH {_FUSED}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM fused)
            SELECT rank, to_json(struct_pack(rank := rank, file_path := file_path, start_line := start_line, end_line := end_line,
                symbol := symbol, score := score, content := content, summary := summary))::VARCHAR AS json FROM n""",
        "render_text_block": f"""
            WITH {_QUERY}, {_CONTENT}, top AS (SELECT * FROM content ORDER BY score, chunk_id LIMIT 10),
            n AS (SELECT *, row_number() OVER (ORDER BY score, chunk_id)::INT AS rank FROM top)
            SELECT rank, printf('[%d] dist:%.4f  %s:%d-%d', rank, score, file_path, start_line, end_line)
                || CASE WHEN coalesce(symbol, '') = '' THEN '' ELSE '  ' || symbol END
                || CASE WHEN coalesce(summary, '') = '' THEN '' ELSE chr(10) || '  ' || summary END
                || chr(10) || array_to_string(['  ' || x FOR x IN ({_LINES.format('content')})[1:3]], chr(10)) AS block
            FROM n""",
        "render_query_block": f"""
            WITH {_FUSED}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM fused)
            SELECT rank, printf('[%d] rrf:%.4f  %s:%d-%d', rank, score, file_path, start_line, end_line)
                || CASE WHEN coalesce(symbol, '') = '' THEN '' ELSE '  ' || symbol END
                || CASE WHEN coalesce(summary, '') = '' THEN '' ELSE chr(10) || '  ' || summary END
                || chr(10) || array_to_string(['  ' || x FOR x IN ({_LINES.format('content')})[1:3]], chr(10)) AS block
            FROM n""",
        "preview_lines": f"""
            SELECT chunk_id, CASE WHEN content = '' THEN '' ELSE array_to_string(['  ' || x FOR x IN ({_LINES.format('content')})[1:3]], chr(10)) END AS preview
            FROM chunks""",
        "vector_l2_normalize": f"""
            WITH n AS (
                SELECT chunk_id, vector::DOUBLE[] AS v, sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AS norm
                FROM (SELECT * FROM chunks WHERE {_V})
            )
            SELECT chunk_id, round(norm, 5) AS norm, round(v[1] / n.norm, 5) AS first, round(v[64] / n.norm, 5) AS last FROM n""",
        "vector_dim_check": f"""
            WITH f AS (
                SELECT 'vector' AS field, len(vector)::INT AS dim, coalesce({_V}, false) AS ok FROM chunks WHERE vector IS NOT NULL
                UNION ALL SELECT 'summary_vector', len(summary_vector)::INT, coalesce({_S}, false) FROM chunks WHERE summary_vector IS NOT NULL
            )
            SELECT field, dim, count(*) AS vectors, count(*) FILTER (WHERE ok) AS usable FROM f GROUP BY 1, 2""",
        "file_status": f"WITH {_STORED} SELECT file_path, status FROM status",
        "refresh_counters": f"""
            WITH {_STORED} SELECT CASE WHEN status = 'removed' THEN 'purged' WHEN status = 'unreadable' THEN 'unreadable'
                WHEN status = 'unchanged' OR NOT {_TEXT_OK} THEN 'skipped' ELSE 'indexed' END AS outcome, count(*) AS files
            FROM status GROUP BY 1""",
        "upsert_snapshot": f"""
            WITH {_STORED}, anew AS (
                SELECT file_path, decode(bytes) AS text FROM status WHERE status IN ('new', 'changed') AND {_TEXT_OK}
            ), fresh AS ({_windows("anew", "file_path", "text", 150)}),
            touched AS (SELECT file_path FROM status WHERE status IN ('removed', 'changed') UNION SELECT file_path FROM fresh),
            rows AS (
                SELECT file_path, start_line FROM stored WHERE file_path NOT IN (SELECT file_path FROM touched)
                UNION ALL SELECT file_path, start_line FROM fresh
            )
            SELECT file_path, count(*) AS rows, max(start_line) AS last_start FROM rows GROUP BY 1""",
        "delete_file_rows": """
            SELECT language, count(*) AS rows, count(DISTINCT file_path) AS files FROM chunks
            WHERE NOT contains(file_path, '''') GROUP BY 1""",
        "escape_free_lookup": """
            SELECT file_path, min(file_hash) AS stored_hash FROM chunks WHERE contains(file_path, '''') GROUP BY 1""",
        "content_hash": "SELECT rel_path, sha256(bytes) AS hash FROM source_files",
        "index_stats": "SELECT count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks",
        "valid_utf8_filter": "SELECT rel_path, TRY(decode(bytes)) IS NOT NULL AS valid FROM source_files WHERE bytes IS NOT NULL",
        "list_files": "SELECT DISTINCT file_path FROM chunks",
        "glob_include": r"""
            SELECT rel_path FROM source_files WHERE regexp_matches(rel_path, '(?s)^(.*/)?core/(.*/)?.*\.py$')
            OR regexp_matches(rel_path, '(?s)^.*/src/.*_0[0-9].*\.rs$') OR regexp_matches(rel_path, '(?s)^.*\.tsx$')""",
        "glob_exclude": r"""
            SELECT rel_path FROM source_files WHERE NOT regexp_matches(rel_path,
                '(?s)^(.*/)?(target|node_modules|dist|out|\.next|\.nuxt|__pycache__|build|bin/Debug|bin/Release|obj|tests|vendor)/.*$')
            AND NOT regexp_matches(rel_path,
                '(?s)^(\.venv|venv|env|vendor|dist-newstyle|\.stack-work|\.bundle|\.gradle|\.sbt)/.*$')""",
        "extension_filter": f"""
            SELECT rel_path, {_EXTENSION} AS extension FROM source_files WHERE {_EXTENSION} IN ('rs', 'go', 'kt')""",
        "default_listing": rf"""
            SELECT rel_path FROM source_files WHERE {_EXTENSION} IN ('rs', 'py', 'js', 'cjs', 'mjs', 'jsx', 'ts', 'tsx', 'go', 'java',
                'cs', 'fs', 'fsx', 'scala', 'sc', 'hs', 'rb', 'kt', 'kts')
            AND NOT regexp_matches(rel_path, '(^|/)\.[^/]+/')
            AND NOT regexp_matches(rel_path,
                '(?s)^(.*/)?(target|node_modules|dist|out|\.next|\.nuxt|__pycache__|build|bin/Debug|bin/Release|obj)/.*$')
            AND NOT regexp_matches(rel_path,
                '(?s)^(\.venv|venv|env|vendor|dist-newstyle|\.stack-work|\.bundle|\.gradle|\.sbt)/.*$')""",
        "language_dispatch": f"""
            SELECT CASE WHEN e IN ('js', 'cjs', 'mjs', 'jsx') THEN 'javascript' WHEN e = 'rs' THEN 'rust' WHEN e = 'py' THEN 'python'
                WHEN e = 'ts' THEN 'typescript' WHEN e = 'cs' THEN 'csharp' WHEN e IN ('fs', 'fsx') THEN 'fsharp'
                WHEN e IN ('scala', 'sc') THEN 'scala' WHEN e = 'hs' THEN 'haskell' WHEN e = 'rb' THEN 'ruby'
                WHEN e IN ('kt', 'kts') THEN 'kotlin' WHEN e IN ('tsx', 'go', 'java') THEN e END AS language, count(*) AS files
            FROM (SELECT {_EXTENSION} AS e FROM source_files) GROUP BY 1""",
        "line_windows": f"""
            WITH w AS ({_windows("documents", "doc_id", "text", 20)})
            SELECT id, doc_id, start_line, end_line, md5(content) AS content_md5 FROM w""",
        "file_windows": f"""
            WITH f AS (SELECT rel_path, decode(bytes) AS text FROM source_files WHERE bytes IS NOT NULL AND {_TEXT_OK}),
                w AS ({_windows("f", "rel_path", "text", 150)})
            SELECT id, start_line, end_line, length(content)::INT AS length FROM w""",
        "oversize_split": """
            WITH p AS (SELECT parse_id, symbol, start_line, string_split(content, chr(10)) AS ls FROM parsed_chunks),
                s AS (SELECT *, unnest(CASE WHEN len(ls) > 40 THEN range(0, len(ls), 40) ELSE [0] END)::INT AS o FROM p)
            SELECT parse_id, symbol, start_line + o AS start_line, start_line + least(o + 40, len(ls))::INT - 1 AS end_line,
                md5(array_to_string(ls[o + 1 : o + 40], chr(10))) AS content_md5 FROM s""",
        "strip_xml_tags": """
            SELECT chunk_id, array_to_string([y FOR y IN [trim(regexp_replace(x, '<[^>]*(>|$)|>', '', 'g'))
                FOR x IN string_split(content, chr(10))] IF y <> ''], chr(10)) AS text
            FROM chunks WHERE language = 'csharp'""",
        "strip_comment_markers": rf"""
            WITH m AS (
                SELECT chunk_id, language, content,
                    CASE WHEN language IN ('python', 'ruby') THEN '#' WHEN language = 'haskell' THEN '--' ELSE '//' END AS mark
                FROM chunks WHERE language IS NOT NULL
            ), r AS (
                SELECT chunk_id, language, mark, [{_TRIM.format('x')} FOR x IN string_split(content, chr(10)) IF starts_with({_TRIM.format('x')}, mark)] AS ls FROM m
            ), l AS (SELECT chunk_id, language, mark, unnest(ls) AS line, unnest(range(0, len(ls))) AS no FROM r),
            s AS (
                SELECT chunk_id, language, no, {_TRIM.format("""
                    CASE WHEN language IN ('rust', 'csharp', 'fsharp') AND starts_with(line, '///') THEN line[4:]
                         WHEN language = 'haskell' AND starts_with(line, '-- |') THEN line[5:] ELSE line[length(mark) + 1 :] END""")} AS bare FROM l
            )
            SELECT chunk_id, string_agg(CASE WHEN language = 'csharp'
                THEN trim(regexp_replace(bare, '<[^>]*(>|$)|>', '', 'g')) ELSE bare END, chr(10) ORDER BY no) AS text FROM s GROUP BY 1""",
        "strip_block_comments": rf"""
            WITH b AS (
                SELECT chunk_id, regexp_extract_all(content, '(?s)/\*.*?\*/') AS bs FROM chunks
                WHERE language IN ('rust', 'java', 'csharp', 'javascript', 'typescript', 'tsx', 'go', 'scala', 'fsharp', 'kotlin')
            ), u AS (SELECT chunk_id, unnest(bs) AS b, unnest(range(0, len(bs)))::INT AS no FROM b),
            i AS (SELECT chunk_id, no, CASE WHEN starts_with(b, '/**') THEN b[4:] ELSE b[3:] END AS t FROM u),
            e AS (SELECT chunk_id, no, CASE WHEN ends_with(t, '*/') THEN t[: length(t) - 2] ELSE t END AS t FROM i)
            SELECT chunk_id, no, array_to_string([y FOR y IN [{_TRIM.format(f"regexp_replace({_TRIM.format('x')}, '^[*]', '')")}
                FOR x IN string_split(t, chr(10))] IF y <> ''], chr(10)) AS text FROM e""",
        "dedent_docstring": rf"""
            WITH b AS (
                SELECT chunk_id, regexp_extract_all(content, '(?s)\"\"\".*?\"\"\"|''''''.*?''''''') AS ds FROM chunks WHERE language = 'python'
            ), u AS (SELECT chunk_id, unnest(ds) AS d, unnest(range(0, len(ds)))::INT AS no FROM b),
            d AS (SELECT chunk_id, no, string_split(d[4 : length(d) - 3], chr(10)) AS ls FROM u),
            i AS (SELECT *, coalesce(list_min([length(x) - length(ltrim(x)) FOR x IN ls[2:] IF trim(x) <> '']), 0) AS n FROM d)
            SELECT chunk_id, no, {_TRIM.format("""array_to_string(list_concat([trim(ls[1])],
                [CASE WHEN trim(x) = '' THEN '' ELSE x[n + 1 :] END FOR x IN ls[2:]]), chr(10))""")} AS text
            FROM i""".replace('\\"', '"'),
        "doc_comment_runs": r"""
            WITH l AS (
                SELECT chunk_id, unnest(range(0, len(ls)))::INT AS no, unnest(ls) AS line,
                    CASE WHEN language = 'go' THEN '//' WHEN language IN ('rust', 'fsharp') THEN '///' ELSE '#' END AS mark
                FROM (SELECT chunk_id, language, string_split(content, chr(10)) AS ls FROM chunks WHERE language IN ('go', 'rust', 'fsharp', 'python', 'ruby'))
            ), r AS (SELECT *, starts_with(ltrim(line), mark) AS remark FROM l),
            o AS (
                SELECT *, lag(remark) OVER w AS before,
                    CASE WHEN remark AND NOT coalesce(lag(remark) OVER w, false) THEN no END AS opens
                FROM r WINDOW w AS (PARTITION BY chunk_id ORDER BY no)
            ), m AS (SELECT *, max(opens) OVER (PARTITION BY chunk_id ORDER BY no) AS run FROM o)
            SELECT chunk_id, no AS function_line, run AS first_line, no - run AS lines
            FROM m WHERE regexp_matches(line, '^\s*(pub(\([a-z]+\))? )?(async )?(fn|func|def|let) ') AND before""",
        "function_heads": rf"""
            WITH f AS (
                SELECT rel_path AS file_path, regexp_extract(rel_path, '[.](\w+)$', 1) AS e, {_LINES.format('decode(bytes)')} AS ls
                FROM source_files WHERE bytes IS NOT NULL AND {_TEXT_OK} AND regexp_matches(rel_path, '[^/][.](go|rs|rb)$')
            ), l AS (SELECT file_path, e, unnest(ls) AS line, unnest(range(0, len(ls)))::INT AS start_line FROM f),
            h AS (
                SELECT file_path, start_line, regexp_extract(line, CASE e WHEN 'go' THEN '^func\s+(?:\([^)]*\)\s*)?(\w+)' WHEN 'rb' THEN '^def\s+(?:self[.])?([\w?!]+)'
                    ELSE '^(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*fn\s+(\w+)' END, 1) AS symbol FROM l
            )
            SELECT file_path, symbol, start_line FROM h WHERE symbol <> ''""",
        "event_kinds": """
            SELECT kind, count(*) AS events, count(DISTINCT path) AS files FROM change_event
            WHERE kind IN ('create', 'modify', 'remove') AND path IS NOT NULL AND ts IS NOT NULL GROUP BY 1""",
        "debounce_bursts": """
            WITH RECURSIVE e AS (
                SELECT split_part(path, '/', 1) AS root, epoch_us(ts) AS t,
                    row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY ts) AS n
                FROM change_event WHERE kind IN ('create', 'modify', 'remove') AND path IS NOT NULL AND ts IS NOT NULL
            ), f AS (
                SELECT root, n, t, t AS start FROM e WHERE n = 1
                UNION ALL
                SELECT e.root, e.n, e.t, CASE WHEN e.t > f.start + 500000 THEN e.t ELSE f.start END
                FROM f JOIN e ON e.root = f.root AND e.n = f.n + 1
            )
            SELECT root, start, max(t) AS last, count(*) AS events FROM f GROUP BY 1, 2""",
    }
