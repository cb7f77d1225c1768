"""The same results as plain SQL for DuckDB, written without looking at the Spark plans.

``CTES`` holds named building blocks; ``_sql`` puts the ones a statement needs,
with everything they need in turn, in front of it.
"""

from __future__ import annotations

import re

from codelantern import fixed_values as fv
from codelantern.operators.prompting import PROMPT_REMINDER
from codelantern.plans import corpus
from codelantern.plans.registry import CLEARED, FILE_CAP, HASH_DIM, INVENTORY_CAP, REPO_CAP


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _chars(value: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in value) + ")"


_SPACE_RE = "".join(f"\\x{{{ord(c):04X}}}" for c in fv.SPACE_CHARS)
_SPACES = _chars(fv.SPACE_CHARS)


def _trim(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def _pick(values, n: str) -> str:
    return f"{_list(values)}[(({n}) % {len(values)} + 1)::INT]"


def _ext(path: str) -> str:
    return rf"lower(regexp_extract(string_split({path}, '/')[-1], '^.+(\.[^.]*)$', 1))"


def _base(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def _language(path: str) -> str:
    cases = " ".join(f"WHEN {_text(e)} THEN {_text(n)}" for e, n in fv.LANGUAGE_BY_EXTENSION.items())
    return f"CASE {_ext(path)} {cases} END"


def _raw_tokens(x: str) -> str:
    whole = rf"string_split_regex(lower({x}), '[{_SPACE_RE},;(){{}}\[\]\"'']+')"
    parts = f"string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_$]+')"
    return (
        f"list_concat(list_filter({whole}, lambda w: length(w) > 1 OR strlen(w) > 3), "
        f"list_filter({parts}, lambda w: length(w) > 1))"
    )


def _lines(x: str) -> str:
    return f"string_split_regex({x}, '\\r?\\n')"


def _truncate(x: str) -> str:
    n = fv.MAX_CHUNK_CHARS
    return (
        f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || chr(10) || '... [truncated ' || "
        f"(length({x}) - {n}) || ' characters]' ELSE {x} END"
    )


def _block(rank: str) -> str:
    return (
        f"'--- CONTEXT CHUNK #' || {rank} || ' ---' || chr(10) || '[Source: ' || file_path || ', ' || symbol_type "
        f"|| ': ' || symbol_name || ', lines ' || start_line || '-' || end_line || ']' || chr(10) || '```' || language "
        f"|| chr(10) || {_truncate('content')} || chr(10) || '```'"
    )


def _path() -> str:
    name = f"lang || '_' || doc_id || {_pick(corpus.EXTENSIONS, 'doc_id')}"
    for divisor, special in corpus.SPECIAL_NAMES.items():
        name = f"CASE WHEN doc_id % {divisor} = 0 THEN {_text(special)} ELSE {name} END"
    return f"{_pick(corpus.DIRECTORIES, 'doc_id // 3')} || '/d' || doc_id || '/' || {name}"


def _reason() -> str:
    ext, base = _ext("path"), _base("path")
    return f"""CASE
      WHEN list_contains({_list(fv.IGNORED_FILENAMES)}, {base}) THEN '{fv.REASON_FILENAME}'
      WHEN contains(path, '.min.') THEN '{fv.REASON_MINIFIED}'
      WHEN list_contains({_list(fv.IGNORED_EXTENSIONS)}, {ext}) THEN '{fv.REASON_EXTENSION}'
      WHEN size_bytes > {{cap}} THEN printf('File size exceeds cap (%.1f MB)', size_bytes / 1048576.0)
      WHEN list_contains({_list(fv.ALLOWED_CODE_EXTENSIONS)}, {ext})
        OR list_contains({_list(fv.ALLOWED_DOC_FILENAMES)}, {base})
        OR list_contains({_list(fv.ALLOWED_DOC_EXTENSIONS)}, {ext}) THEN NULL
      ELSE '{fv.REASON_NOT_ALLOWED}' END"""


_PRUNED = f"list_has_any(string_split(path, '/')[:-2], {_list(fv.IGNORED_DIRECTORIES)})"
_HEADER = rf"^#{{1,6}}[{_SPACE_RE}]+([^\n\r]+)$"
_IS_DOC = f"({_ext('path')} IN ('.md', '.mdx') OR lower({_base('path')}) = 'readme')"

CTES: dict[str, str] = {
    "files": f"SELECT doc_id, source AS repo_id, {_path()} AS path, n_chars AS size_bytes, text AS content FROM documents",
    "chunks": f"""SELECT doc_id, doc_id::VARCHAR AS id, repo_id, path AS file_path, 'text' AS language, content,
        1::BIGINT AS start_line, len({_lines('content')})::BIGINT AS end_line, 'doc_' || doc_id AS symbol_name,
        {_pick(corpus.KINDS, 'doc_id')} AS symbol_type, doc_id AS ord FROM files""",
    "questions": f"""SELECT item_id AS query_id,
        CASE WHEN item_id % 10 = 7 THEN 'none/such' ELSE 'src' || (item_id % {corpus.N_REPOS}) END AS repo_id,
        CASE WHEN item_id % 5 = 3 OR item_id % 20 = 17 THEN 'How many files say ' || text ELSE text END AS text FROM benchmark""",
    # -- lexical
    "doc_terms": f"""SELECT id, repo_id, ord, tok, max(c) + max(p) + max(s) AS tf FROM (
        SELECT id, repo_id, ord, unnest({_raw_tokens('content')}) AS tok, 1 AS c, 0 AS p, 0 AS s FROM chunks
        UNION ALL SELECT id, repo_id, ord, unnest({_raw_tokens('file_path')}), 0, 2, 0 FROM chunks
        UNION ALL SELECT id, repo_id, ord, unnest({_raw_tokens('symbol_name')}), 0, 0, 4 FROM chunks)
        GROUP BY id, repo_id, ord, tok""",
    "doc_len": """SELECT c.id, c.repo_id, count(t.tok) AS dl FROM chunks c
        LEFT JOIN doc_terms t USING (id) GROUP BY c.id, c.repo_id""",
    "term_df": "SELECT repo_id, tok, count(*) AS df FROM doc_terms GROUP BY repo_id, tok",
    "repo_stats": "SELECT repo_id, count(*) AS n_docs, avg(dl) AS avg_dl FROM doc_len GROUP BY repo_id",
    "asked_terms": f"""SELECT query_id, repo_id, tok, min(i) AS pos FROM (
        SELECT query_id, repo_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i
        FROM (SELECT query_id, repo_id, {_raw_tokens('text')} AS l FROM questions)) GROUP BY query_id, repo_id, tok""",
    "lexical": """SELECT query_id, repo_id, id, raw, row_number() OVER (
          PARTITION BY query_id ORDER BY round(raw, 9) DESC, first_pos, ord) AS bm25_rank FROM (
        SELECT query_id, repo_id, id, ord, min(pos) AS first_pos,
          sum(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE
              / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS raw
        FROM asked_terms JOIN doc_terms USING (repo_id, tok) JOIN term_df USING (repo_id, tok)
        JOIN doc_len USING (repo_id, id) JOIN repo_stats USING (repo_id)
        GROUP BY query_id, repo_id, id, ord) QUALIFY bm25_rank <= 20""",
    # -- vectors and fusion
    "semantic": """SELECT query_id, repo_id, id, cos, row_number() OVER (
          PARTITION BY query_id ORDER BY round(cos, 9) DESC, ord) AS semantic_rank FROM (
        SELECT q.query_id, c.repo_id, c.id, c.ord,
          list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cos
        FROM questions q JOIN embeddings v ON v.vec_id = q.query_id
        JOIN chunks c ON c.repo_id = q.repo_id JOIN embeddings e ON e.vec_id = c.doc_id)
        QUALIFY semantic_rank <= 20""",
    "fused": """SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY rrf_score DESC, semantic_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM (
        SELECT query_id, repo_id, id, semantic_rank, bm25_rank,
          round(coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 5) AS rrf_score,
          CASE WHEN semantic_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN 'hybrid'
               WHEN bm25_rank IS NOT NULL THEN 'bm25' ELSE 'semantic' END AS source
        FROM semantic FULL JOIN lexical USING (query_id, repo_id, id))""",
    "hits": "SELECT query_id, id, rank, rrf_score, source, semantic_rank, bm25_rank FROM fused WHERE rank <= 8",
    "signal": f"""SELECT query_id, CASE WHEN a.id IS NULL THEN 0.0::DOUBLE WHEN a.rrf_score < 0.01 THEN round(a.rrf_score, 4)
          WHEN a.source = 'hybrid' THEN round(least(1.0::DOUBLE, a.rrf_score * 30), 4)
          ELSE round(least(1.0::DOUBLE, a.rrf_score * 25), 4) END AS score,
        a.id IS NULL OR a.rrf_score < 0.01 AS low_confidence,
        CASE WHEN a.id IS NULL THEN '{fv.REASON_NO_CHUNKS}'
          WHEN a.rrf_score < 0.01 THEN printf('Top retrieval score (%.4f) is below threshold (0.01). Context may be weak.', a.rrf_score)
          WHEN a.source = 'hybrid' THEN 'High confidence: Top candidate "' || c.file_path || ':' || c.start_line
            || '" matched by both semantic vectors and BM25 keywords.'
          WHEN a.rrf_score - coalesce(b.rrf_score, 0) > 0.003 THEN 'Good confidence: Clear top match in ' || a.source || ' search.'
          ELSE 'Moderate confidence: Candidate found via ' || a.source || ' search.' END AS reason
        FROM questions q LEFT JOIN (SELECT * FROM hits WHERE rank = 1) a USING (query_id)
        LEFT JOIN (SELECT * FROM hits WHERE rank = 2) b USING (query_id) LEFT JOIN chunks c ON c.id = a.id""",
    # -- citations and references in derived answers
    "told": f"""SELECT doc_id AS answer_id, content || chr(10) || 'Uses [' || path || ':1-3] and [d' || doc_id || '/x.ts:4] then 【'
        || upper(path) || ':' || (doc_id % 7) || '-' || (doc_id % 11) || '】 or [' || right(path, 4) || ':2], again [' || path
        || ':1-3] [missing.go:' || doc_id || ']. See doc_' || doc_id || '() before doc_' || (doc_id * 13 % 1000)
        || '() Note: helper_fn () return: doc_' || doc_id || '()' AS text FROM files""",
    "given": """SELECT ord AS answer_id, 1 AS rank, * FROM chunks
        UNION ALL SELECT ord - 1, 2, * FROM chunks WHERE ord >= 1""",
    "cited": rf"""SELECT answer_id, ord, tag, file_path, a::BIGINT AS start_line,
          coalesce(nullif(b, ''), a)::BIGINT AS end_line FROM (
        SELECT answer_id, ord, tag, regexp_extract(tag, '{fv.CITATION}', 1) AS file_path,
          regexp_extract(tag, '{fv.CITATION}', 2) AS a, regexp_extract(tag, '{fv.CITATION}', 3) AS b
        FROM (SELECT answer_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS ord
              FROM (SELECT answer_id, regexp_extract_all(text, '{fv.CITATION}') AS l FROM told)))
        QUALIFY row_number() OVER (PARTITION BY answer_id, file_path, start_line, end_line ORDER BY ord) = 1""",
    "audited": f"""SELECT c.answer_id, c.ord, c.tag, coalesce(g.file_path, c.file_path) AS file_path, c.start_line, c.end_line,
          g.id IS NOT NULL AS valid,
          coalesce(nullif({_trim(f"array_to_string({_lines('g.content')}[greatest(0, c.start_line - g.start_line) + 1 : c.end_line - g.start_line + 1], chr(10))")}, ''),
                   substr(g.content, 1, 150)) AS snippet
        FROM cited c LEFT JOIN given g ON g.answer_id = c.answer_id
          AND ends_with(lower(g.file_path), lower(c.file_path))
          AND c.start_line <= g.end_line AND c.end_line >= g.start_line
        QUALIFY row_number() OVER (PARTITION BY c.answer_id, c.ord ORDER BY g.rank) = 1""",
    "named": rf"""SELECT answer_id, symbol, min(i) - 1 AS ord FROM (
          SELECT answer_id, unnest(l) AS symbol, generate_subscripts(l, 1) AS i FROM (
            SELECT answer_id, regexp_extract_all(text, '\b({fv.SYMBOL_NAME})[{_SPACE_RE}]*(?:\(\)|:)', 1) AS l FROM told))
        WHERE NOT list_contains({_list(fv.SYMBOL_STOP_WORDS)}, lower(symbol)) GROUP BY answer_id, symbol""",
    "known": """SELECT DISTINCT answer_id, symbol FROM (
          SELECT answer_id, lower(unnest(string_split_regex(file_path, '[^a-zA-Z0-9_$]+'))) AS symbol, 2 AS least_length FROM given
          UNION ALL SELECT answer_id, lower(symbol_name), 0 FROM given) WHERE length(symbol) > least_length""",
    # -- reference lookup
    "refs": f"""SELECT item_id AS query_id, 'src' || (item_id % {corpus.N_REPOS}) AS repo_id,
        CASE item_id % 4 WHEN 0 THEN 'DOC_' || item_id WHEN 1 THEN 'd' || item_id
          WHEN 2 THEN string_split(text, ' ')[1] ELSE 'ts' END AS symbol FROM benchmark""",
}


def _bm25_for(source: str, text: str, k: int) -> str:
    """The lexical ranking for another batch of queries."""
    terms = CTES["asked_terms"].replace("FROM questions", f"FROM {source}").replace(
        _raw_tokens("text"), _raw_tokens(text))
    return CTES["lexical"].replace("FROM asked_terms", f"FROM ({terms}) AS a").replace("<= 20", f"<= {k}")


def _lookup(source: str, k: int) -> tuple[str, str]:
    exact = f"""SELECT h.query_id, h.repo_id, h.id, round(h.raw, 4) AS score, h.bm25_rank, h.bm25_rank AS position
        FROM ({_bm25_for(source, 'symbol', k)}) h JOIN {source} r USING (query_id) JOIN chunks c ON c.id = h.id
        WHERE lower(c.symbol_name) = lower(r.symbol) OR contains(lower(c.file_path), lower(r.symbol))"""
    both = f"""SELECT * FROM {source}_exact UNION ALL
        SELECT query_id, repo_id, id, round(1.0::DOUBLE / position, 4), NULL, position FROM (
          SELECT r.query_id, r.repo_id, c.id, row_number() OVER (PARTITION BY r.query_id ORDER BY c.ord) AS position
          FROM {source} r JOIN chunks c ON c.repo_id = r.repo_id
            AND (contains(lower(c.symbol_name), lower(r.symbol)) OR contains(lower(c.file_path), lower(r.symbol)))
          WHERE r.query_id NOT IN (SELECT query_id FROM {source}_exact)) WHERE position <= {k}"""
    return exact, both


def _append(hits: str, extra: str) -> str:
    return f"""SELECT query_id, id, rank FROM {hits} UNION ALL
        SELECT e.query_id, e.id, coalesce(n, 0) + row_number() OVER (PARTITION BY e.query_id ORDER BY e.position)
        FROM {extra} e LEFT JOIN (SELECT query_id, max(rank) AS n FROM {hits} GROUP BY query_id) s USING (query_id)
        WHERE NOT EXISTS (SELECT 1 FROM {hits} h WHERE h.query_id = e.query_id AND h.id = e.id)"""


def _prompts(hits: str) -> tuple[str, str]:
    blocks = f"""SELECT query_id, rank, block, sum(length(block)) OVER (
          PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_chars
        FROM (SELECT query_id, rank, {_block('rank')} AS block FROM {hits} JOIN chunks USING (id)) QUALIFY cum_chars <= 12000"""
    prompt = f"""SELECT q.query_id, 'USER QUESTION:' || chr(10) || q.text || chr(10) || chr(10) || coalesce(inventory, '')
          || 'CONTEXT CHUNKS (' || coalesce(n, 0) || ' relevant snippet(s) from repository):' || chr(10) || coalesce(blocks, '')
          || chr(10) || chr(10) || {_text(PROMPT_REMINDER)} AS user_prompt
        FROM questions q LEFT JOIN listed USING (repo_id) LEFT JOIN (
          SELECT query_id, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS blocks
          FROM {hits}_blocks GROUP BY query_id) b USING (query_id)"""
    return blocks, prompt


def _said(prompts: str) -> str:
    line = r"\[Source: ([^,\n]+)[^\n]*, lines (\d+-\d+)\]\n"
    return f"""SELECT query_id, CASE WHEN regexp_matches(user_prompt, '{line}') THEN 'Relevant code is in ' || array_to_string(list_transform(
          list_zip(regexp_extract_all(user_prompt, '{line}', 1), regexp_extract_all(user_prompt, '{line}', 2)),
          lambda z: '[' || z[1] || ':' || z[2] || ']'), ' ') ELSE 'I don''t know based on the provided codebase context.' END
          || ' calls doc_' || (query_id * 37 % 500) || '()' AS text
        FROM {prompts}"""


CTES["refs_exact"], CTES["found"] = _lookup("refs", 5)
CTES["stored_chunks"] = f"""SELECT id, repo_id, ord, file_path, symbol_name, content || coalesce(' q=' || quality, '') AS content
    FROM chunks LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'b' || item_id, 'src' || (item_id % {corpus.N_REPOS}), 1000000000 + item_id, 'notes/n' || item_id || '.md', NULL, text
    FROM benchmark"""
for _name in ("doc_terms", "doc_len", "term_df", "repo_stats", "lexical"):
    CTES[f"stored_{_name}"] = re.sub(r"\b(chunks|doc_terms|doc_len|term_df|repo_stats)\b", r"stored_\1", CTES[_name])
CTES["lexical_hits"] = "SELECT query_id, id, bm25_rank AS rank FROM lexical WHERE bm25_rank <= 8"
CTES["listed"] = f"""SELECT repo_id, '--- REPOSITORY FILE INVENTORY (' || repo_id || ') ---' || chr(10) || 'Total Ingested Files ('
      || any_value(total) || ' files):' || chr(10) || string_agg('- ' || file_path, chr(10) ORDER BY file_path)
      || CASE WHEN any_value(total) > 100 THEN chr(10) || '... [truncated ' || (any_value(total) - 100) || ' files]' ELSE '' END
      || chr(10) || chr(10) AS inventory
    FROM (SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS i,
            count(*) OVER (PARTITION BY repo_id) AS total
          FROM (SELECT DISTINCT repo_id, file_path FROM chunks)) WHERE i <= 100 GROUP BY repo_id"""
CTES["hits_blocks"], CTES["hits_prompts"] = _prompts("hits")
CTES["first_told"] = _said("hits_prompts")
CTES["hop_refs"] = """SELECT query_id, repo_id, 'doc_' || (query_id * 37 % 500) AS symbol FROM questions q
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.id = (q.query_id * 37 % 500)::VARCHAR)
      AND query_id IN (SELECT query_id FROM signal WHERE NOT low_confidence) AND NOT regexp_matches(lower(text), 'how many')"""
CTES["hop_refs_exact"], CTES["hop_found"] = _lookup("hop_refs", 3)
CTES["active"] = _append("hits", "hop_found")
CTES["active_blocks"], CTES["active_prompts"] = _prompts("active")
CTES["final_told"] = _said("active_prompts")
CTES["answered"] = f"""SELECT query_id, f.text, contains(lower(f.text), {_text(fv.DECLINED_PHRASE)}) AS low_confidence,
      CASE WHEN contains(lower(f.text), {_text(fv.DECLINED_PHRASE)}) THEN {_text(fv.DECLINED_REASON)} ELSE s.reason END AS reason,
      query_id IN (SELECT query_id FROM hop_found) AS multi_hop, 'extractive' AS model
    FROM final_told f JOIN signal s USING (query_id) JOIN questions q USING (query_id)
    WHERE NOT s.low_confidence OR regexp_matches(lower(q.text), 'how many')
    UNION ALL SELECT query_id, {_text(fv.REFUSAL_TEXT)}, true, s.reason, false, '{fv.ANSWER_MODEL}'
    FROM signal s JOIN questions q USING (query_id) WHERE s.low_confidence AND NOT regexp_matches(lower(q.text), 'how many')"""
CTES["active_full"] = """SELECT a.query_id, a.rank, c.*, CASE WHEN h.id IS NOT NULL THEN h.rrf_score
        WHEN e.bm25_rank IS NULL THEN 1.0::DOUBLE / e.position ELSE e.score END AS score, coalesce(h.source, 'bm25') AS source,
      h.semantic_rank, CASE WHEN h.id IS NOT NULL THEN h.bm25_rank ELSE e.bm25_rank END AS bm25_rank
    FROM active a JOIN chunks c USING (id) LEFT JOIN hits h ON h.query_id = a.query_id AND h.id = a.id
    LEFT JOIN hop_found e ON e.query_id = a.query_id AND e.id = a.id"""

CTES["final_cited"] = CTES["cited"].replace("FROM told", "FROM (SELECT query_id AS answer_id, text FROM answered)")
CTES["final_given"] = "SELECT a.query_id AS answer_id, a.rank, c.* FROM active a JOIN chunks c USING (id)"
CTES["final_audited"] = CTES["audited"].replace("FROM cited c LEFT JOIN given g", "FROM final_cited c LEFT JOIN final_given g")


def _sql(statement: str) -> str:
    needed: list[str] = []

    def add(text: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in CTES and word not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{word}\b", text):
                add(CTES[word])
                needed.append(word)

    add(statement)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in dict.fromkeys(needed))
    return f"WITH {head}\n{statement}" if head else statement


_SECTIONS = rf"""
    SELECT doc_id, repo_id, path, start_line, end_line, title, {_trim('body')} AS content FROM (
      SELECT doc_id, repo_id, path, min(i) AS start_line, max(i) AS end_line,
        coalesce({_trim(f"nullif(regexp_extract(min_by(line, i), '{_HEADER}', 1), '')")}, 'Documentation') AS title,
        string_agg(line, chr(10) ORDER BY i) AS body
      FROM (SELECT *, sum(regexp_matches(line, '{_HEADER}')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (
        SELECT doc_id, repo_id, path, i, CASE WHEN i % 4 = 3 THEN '# ' || line ELSE line END AS line
        FROM (SELECT doc_id, repo_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS i
              FROM (SELECT *, string_split(content, chr(10)) AS l FROM files))))
      GROUP BY doc_id, repo_id, path, part) WHERE length({_trim('body')}) > 0"""
_HEADED = """array_to_string(list_transform(string_split(content, chr(10)),
    lambda line, i: CASE WHEN i % 4 = 3 THEN '# ' || line ELSE line END), chr(10))"""


def _chunk_row(start: str, end: str, language: str, name: str, kind: str, content: str) -> str:
    return (
        f"repo_id || ':' || path || ':' || {start} AS id, repo_id, path AS file_path, {language} AS language, "
        f"{content} AS content, ({start})::BIGINT AS start_line, ({end})::BIGINT AS end_line, {name} AS symbol_name, "
        f"{kind} AS symbol_type"
    )


def _module(content: str) -> str:
    return _chunk_row("1", f"len({_lines(content)})", f"coalesce({_language('path')}, 'text')", _base("path"),
                      "'module'", _trim(content))


_DOC_ROW = _chunk_row("start_line", "end_line", "'markdown'", "title", "'doc'", "content")


def _routed(files: str) -> str:
    """Chunks of the files: sections of Markdown, symbols of generated code, modules of the rest."""
    ext = _ext("path")
    return f"""SELECT {_DOC_ROW} FROM ({_SECTIONS}) WHERE {_IS_DOC} AND doc_id IN (SELECT doc_id FROM {files})
    UNION ALL SELECT {_module('content')} FROM (SELECT doc_id, repo_id, path, {_HEADED} AS content FROM {files})
    WHERE NOT {_IS_DOC} AND {ext} NOT IN ('.py', '.ts') AND length({_trim('content')}) > 0
    UNION ALL {_python(f"SELECT repo_id, path, content FROM {files} WHERE {ext} = '.py'")}
    UNION ALL {_script(f"SELECT repo_id, path, content FROM {files} WHERE {ext} = '.ts'")}"""


def _built_code(source: str, language: str, pieces: str) -> str:
    """Symbols of the generated sources, from the way they are generated."""
    lines = f"""SELECT repo_id, path, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS i
        FROM (SELECT *, string_split(content, chr(10)) AS l FROM ({source}))"""
    clean = f"SELECT repo_id, path, i, regexp_replace(raw, '[^a-zA-Z0-9 ,.]+', ' ', 'g') AS t FROM ({lines})"
    return f"""SELECT repo_id || ':' || path || ':' || start_line AS id, repo_id, path AS file_path, '{language}' AS language,
        content, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, name AS symbol_name, kind AS symbol_type
      FROM (SELECT repo_id, path, unnest(CASE {pieces} END, recursive := true) FROM ({clean}))"""


def _piece(name: str, kind: str, first: str, last: str, content: str) -> str:
    return f"{{name: {name}, kind: '{kind}', start_line: {first}, end_line: {last}, content: {content}}}"


def _renamed(suffix: str) -> str:
    return f"SELECT repo_id, 'd' || doc_id || '{suffix}' AS path, content FROM files"


def _python(source: str) -> str:
    method = "'def m' || i || '(self):' || chr(10) || '        return ''' || t || ''''"
    return _built_code(source, "python", f"""
  WHEN i = {corpus.DAMAGED} THEN [{_piece("'broken' || i", 'function', '3 * i + 1', '3 * i + 3',
        "'def broken' || i || '(x):' || chr(10) || '    y = [(' || chr(10) || '    ''' || t || ''''")}]
  WHEN i % 5 = 0 THEN [
    {_piece("'m' || i", 'method', '3 * i + 2', '3 * i + 3', method)},
    {_piece("'C' || i", 'class', '3 * i + 1', '3 * i + 3', f"'class C' || i || ':' || chr(10) || '    ' || {method}")}]
  WHEN i % 5 = 1 THEN [{_piece("'g' || i", 'function', '3 * i + 2', '3 * i + 3',
        "'async def g' || i || '(x=(1, [2])): # (' || chr(10) || '    return ''' || t || ''''")}]
  ELSE [{_piece("'f' || i", 'function', '3 * i + 1', '3 * i + 3',
        "'def f' || i || '(x):' || chr(10) || '    y = ''' || t || '''' || chr(10) || '    return y'")}]""")


def _script(source: str) -> str:
    method = "'m' || i || '(a) { return ''' || t || '''; }'"
    named = "'static ''k ' || i || '''<T>(a: T): { b: T } { return ''' || t || '''; }'"
    return _built_code(source, "typescript", f"""
  WHEN i = {corpus.DAMAGED} THEN []
  WHEN i % 5 = 0 THEN [
    {_piece("'m' || i", 'method', '3 * i + 2', '3 * i + 2', method)},
    {_piece("'C' || i", 'class', '3 * i + 1', '3 * i + 3', f"'class C' || i || ' {{' || chr(10) || '  ' || {method} || chr(10) || '}}'")}]
  WHEN i % 5 = 1 THEN [{_piece("'f' || i", 'function', '3 * i + 1', '3 * i + 3',
        "'function f' || i || '(x) {' || chr(10) || '  return `' || t || ' ${x}`; // }' || chr(10) || '}'")}]
  WHEN i % 5 = 2 THEN [{_piece("'h' || i", 'function', '3 * i + 1', '3 * i + 3',
        "'const a = ''' || t || ''', h' || i || ' = async (x = f(g([{}]))) => {' || chr(10) || '  return a;' || chr(10) || '}, b = 1;'")}]
  WHEN i % 5 = 3 THEN [
    {_piece("'''k ' || i || ''''", 'method', '3 * i + 2', '3 * i + 2', named)},
    {_piece("'S' || i", 'class', '3 * i + 1', '3 * i + 3', f"'class S' || i || ' {{' || chr(10) || '  ' || {named} || chr(10) || '}}'")}]
  ELSE [{_piece("'g' || i", 'function', '3 * i + 1', '3 * i + 3',
        "'const g' || i || ' = (x) => {' || chr(10) || '  return \"' || t || ' {\";' || chr(10) || '};'")}]""")


_COUNTS = {"function": "functions", "class": "classes", "method": "methods", "module": "modules", "doc": "docs"}
_ENRICHED = "'File: ' || file_path || ' | ' || symbol_type || ': ' || symbol_name || chr(10) || chr(10) || content"


def _counts(kinds: str = "symbol_type") -> str:
    return ", ".join(f"count(*) FILTER ({kinds} = '{k}') AS {c}" for k, c in _COUNTS.items())


STATEMENTS: dict[str, str] = {
    "url_parse": rf"""SELECT page_id, host, CASE WHEN status = 'ok' THEN owner END AS owner,
        CASE WHEN status = 'ok' THEN repo END AS repo, CASE WHEN status = 'ok' THEN owner || '/' || repo END AS repo_id, status
      FROM (SELECT *, CASE WHEN short THEN 'ok' WHEN host IS NULL THEN 'invalid_url'
          WHEN host NOT IN ('github.com', 'www.github.com') THEN 'invalid_host'
          WHEN len(parts) < 2 THEN 'invalid_url' ELSE 'ok' END AS status,
          CASE WHEN short THEN string_split(t, '/')[1] ELSE parts[1] END AS owner,
          CASE WHEN short THEN string_split(t, '/')[2] ELSE parts[2] END AS repo
        FROM (SELECT page_id, t, regexp_full_match(t, '[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+') AS short,
            nullif(lower(regexp_extract(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
            list_filter(string_split(regexp_extract(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '') AS parts
          FROM (SELECT page_id, regexp_replace(regexp_replace({_trim('a')}, '\.git$', ''), '/$', '') AS t FROM (
            SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://github.com' || rest
              WHEN 2 THEN ' https://www.GitHub.com/o' || page_id || '/r' || page_id || '.git' || chr(10)
              WHEN 3 THEN 'o' || page_id || '/r.' || page_id || '.git/'
              WHEN 4 THEN 'github.com' || rest ELSE 'https://me@github.com:443' || rest || '/' END AS a
            FROM (SELECT page_id, url, regexp_replace(url, '^https?://[^/]+', '') AS rest FROM pages)))))""",
    "file_filter": f"SELECT doc_id, path, {_reason().format(cap=FILE_CAP)} AS reason FROM files",
    "selected_files": f"""SELECT doc_id, repo_id, path FROM (
        SELECT *, {_reason().format(cap=FILE_CAP)} AS reason FROM files) WHERE reason IS NULL AND NOT {_PRUNED}""",
    "dir_prune": f"SELECT doc_id, path, {_PRUNED} AS pruned FROM files",
    "file_ext": f"SELECT doc_id, path, {_ext('path')} AS ext FROM files",
    "detect_language": f"SELECT doc_id, path, {_language('path')} AS language FROM files",
    "corpus_size": "SELECT source AS repo_id, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY 1",
    "repo_size_guard": f"""SELECT source AS repo_id, sum(n_chars)::BIGINT AS total_bytes, sum(n_chars) > {REPO_CAP} AS over_cap
        FROM documents GROUP BY 1""",
    "repo_scan": f"SELECT doc_id, repo_id, path, content FROM files WHERE repo_id = '{CLEARED}'",
    "repo_count": "SELECT source AS repo_id, count(*) AS n FROM documents GROUP BY 1",
    "chunk_summary": f"SELECT repo_id, {_counts()} FROM chunks GROUP BY 1",
    "chunk_pct": "SELECT repo_id, " + ", ".join(
        f"floor(100.0::DOUBLE * count(*) FILTER (symbol_type = '{k}') / count(*) + 0.5)::BIGINT AS {k}_pct" for k in _COUNTS
    ) + " FROM chunks GROUP BY 1",
    "languages": f"""SELECT repo_id, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages
        FROM (SELECT repo_id, {_language('path')} AS language FROM files) GROUP BY 1""",
    "file_inventory": "SELECT DISTINCT repo_id, file_path FROM chunks",
    "inventory_cap": f"""SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS position,
        count(*) OVER (PARTITION BY repo_id) AS total FROM (SELECT DISTINCT repo_id, file_path FROM chunks)
        QUALIFY position <= {INVENTORY_CAP}""",
    "tokenize": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, token FROM (
        SELECT doc_id, token, min(i) AS i FROM (
          SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, {_raw_tokens('text')} AS l FROM documents)) GROUP BY doc_id, token)""",
    "truncate_chunk": f"SELECT doc_id, {_truncate('text')} AS content FROM documents",
    "enrich_text": f"SELECT doc_id, {_ENRICHED} AS text FROM chunks",
    "citation_link": """SELECT doc_id, 'https://github.com/' || repo_id || '/blob/main/' || file_path || '#L' || start_line
        || CASE WHEN end_line <> start_line THEN '-L' || end_line ELSE '' END AS link FROM chunks""",
    "context_block": f"SELECT doc_id, {_block('(ord + 1)')} AS block FROM chunks",
    "inventory_question": f"""SELECT conv_id, turn, regexp_matches(lower(text || {_list(
        ("", " How MANY?", " list all files", " What files", " file  count", " File Count"))}[(conv_id % 6 + 1)::INT]),
        'how many|list all files|what files|file count') AS flag FROM conversations""",
    "declined_answer": f"""SELECT conv_id, turn, contains(lower(text || CASE WHEN conv_id % 3 = 0
        THEN ' I DON''T know based on the provided codebase context.' ELSE ' I don''t know.' END), {_text(fv.DECLINED_PHRASE)}) AS flag
        FROM conversations""",
    "conversation_log": "SELECT conv_id, turn, role, text, role = 'user' AS is_user FROM conversations",
    "health_rollup": """SELECT source || '/' || lang AS group_id, CASE WHEN min(toxic = 0) THEN 'healthy'
        WHEN max(toxic = 0) THEN 'degraded' ELSE 'unhealthy' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "markdown_sections": f"SELECT {_DOC_ROW} FROM ({_SECTIONS})",
    "module_chunk": f"SELECT {_module('content')} FROM files WHERE length({_trim('content')}) > 0",
    "chunk_router": _routed("files"),
    "ast_python": _python(_renamed(".py")),
    "ast_js": _script(_renamed(".ts")),
    "ingest_summary": f"""SELECT repo_id, file_count, count(*) AS chunk_count,
        string_agg(DISTINCT language, ',' ORDER BY language) AS languages, {_counts()}
      FROM ({_routed("files")}) JOIN (SELECT repo_id, path AS file_path, count(*) OVER (PARTITION BY repo_id) AS file_count FROM (
        SELECT *, {_reason().format(cap=fv.MAX_FILE_SIZE_BYTES)} AS reason FROM files) WHERE reason IS NULL AND NOT {_PRUNED})
        USING (repo_id, file_path) GROUP BY repo_id, file_count""",
    "cosine": """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], model::DOUBLE[]), 6) AS cosine
        FROM embeddings JOIN (SELECT label, min_by(embedding, vec_id) AS model FROM embeddings GROUP BY label) USING (label)""",
    "hash_embed": f"""SELECT doc_id, slot, round((coalesce(weight, 0) / norm)::FLOAT::DOUBLE, 4) AS weight FROM (
        SELECT doc_id, slot, weight, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS norm
        FROM (SELECT doc_id, unnest(range({HASH_DIM})) AS slot FROM documents) LEFT JOIN (
          SELECT doc_id, h // 2 AS slot, sum(1 - 2 * (h % 2))::DOUBLE AS weight FROM (
            SELECT doc_id, ('0x' || left(md5(token), 8))::BIGINT % {2 * HASH_DIM} AS h FROM (
              SELECT DISTINCT doc_id, unnest({_raw_tokens(f'({_ENRICHED})')}) AS token FROM chunks))
          GROUP BY doc_id, slot) USING (doc_id, slot))""",
    "bm25_postings": "SELECT id::BIGINT AS doc_id, tok AS token, tf::BIGINT AS tf FROM doc_terms",
    "bm25_doc_len": "SELECT id::BIGINT AS doc_id, dl FROM doc_len",
    "bm25_df": "SELECT repo_id, tok AS token, df FROM term_df",
    "bm25_stats": "SELECT repo_id, n_docs, round(avg_dl, 6) AS avg_dl FROM repo_stats",
    "stored_topk": "SELECT query_id, repo_id, id, round(raw, 4) AS score, bm25_rank FROM stored_lexical",
    "chunk_coverage": f"""SELECT repo_id, file_path, sum(n_lines)::BIGINT AS n_lines, sum(covered)::BIGINT AS covered,
        sum(overlapping)::BIGINT AS overlapping, sum(n_lines - covered)::BIGINT AS dropped FROM (
        SELECT repo_id, path AS file_path, any_value(n_lines) AS n_lines, count(c.line) AS covered, count(c.line) FILTER (n > 1) AS overlapping
        FROM (SELECT repo_id, path, CASE WHEN NOT {_IS_DOC} AND {_ext('path')} IN ('.py', '.ts') THEN 3 * len(string_split(content, chr(10)))
              ELSE len({_lines('content')}) END AS n_lines FROM files) f
        LEFT JOIN (SELECT repo_id AS r, file_path AS p, line, count(*) AS n FROM (
            SELECT repo_id, file_path, unnest(range(start_line, end_line + 1)) AS line FROM ({_routed('files')})) GROUP BY ALL) c
          ON c.r = f.repo_id AND c.p = f.path
        GROUP BY repo_id, path)
      GROUP BY GROUPING SETS ((repo_id, file_path), (repo_id))""",
    "bm25_topk": "SELECT query_id, repo_id, id, round(raw, 4) AS score, bm25_rank FROM lexical",
    "semantic_topk": """SELECT query_id, id, round(cos, 6) AS cosine, round(1.0::DOUBLE / semantic_rank, 6) AS score,
        semantic_rank FROM semantic""",
    "rrf_fusion": "SELECT query_id, id, rank, rrf_score, source, semantic_rank, bm25_rank FROM fused",
    "hybrid_search": """SELECT h.*, repo_id, file_path, symbol_name, start_line, end_line, content
        FROM hits h JOIN chunks USING (id)""",
    "confidence": "SELECT query_id, score, low_confidence, reason FROM signal",
    "retrieval_stats": """SELECT q.query_id, count(semantic_rank) AS semantic_candidates, count(bm25_rank) AS bm25_candidates,
        count(f.id) AS merged FROM questions q LEFT JOIN fused f USING (query_id) GROUP BY q.query_id""",
    "citation_extract": "SELECT answer_id, ord, tag, file_path, start_line, end_line FROM cited",
    "citation_audit": "SELECT answer_id, ord, tag, file_path, start_line, end_line, valid FROM audited",
    "citation_snippet": "SELECT answer_id, ord, file_path, snippet FROM audited WHERE valid",
    "symbol_refs": "SELECT answer_id, symbol, ord FROM named",
    "known_symbols": "SELECT answer_id, symbol FROM known",
    "unretrieved_refs": """SELECT answer_id, symbol, ord FROM named n WHERE NOT EXISTS (
        SELECT 1 FROM known k WHERE k.answer_id = n.answer_id AND k.symbol = lower(n.symbol))""",
    "reference_lookup": "SELECT query_id, repo_id, id, score, bm25_rank, position FROM found",
    "multihop_merge": _append("lexical_hits", "found"),
    "context_budget": "SELECT query_id, rank, cum_chars, block FROM hits_blocks",
    "prompt_assemble": "SELECT query_id, user_prompt FROM hits_prompts",
    "grounded_answers": "SELECT query_id, text, low_confidence, reason, multi_hop, model FROM answered",
    "answer_citations": "SELECT answer_id, ord, tag, file_path, start_line, end_line, valid, "
        "CASE WHEN valid THEN snippet END AS snippet FROM final_audited",
    "answer_json": """SELECT query_id, json_object('success', true, 'answer', json_object('text', text,
        'citations', coalesce(cited, []), 'invalidCitations', coalesce(wrong, []),
        'retrievedChunks', coalesce(given, []), 'lowConfidence', low_confidence, 'confidenceReason', reason, 'multiHopTriggered', multi_hop, 'model', model))::VARCHAR AS body
      FROM answered LEFT JOIN (
        SELECT answer_id AS query_id, list({filePath: file_path, startLine: start_line, endLine: end_line, snippet: snippet}
            ORDER BY ord) FILTER (valid) AS cited, list(tag ORDER BY ord) FILTER (NOT valid) AS wrong
        FROM final_audited GROUP BY answer_id) USING (query_id) LEFT JOIN (
        SELECT query_id, list({chunk: {id: id, repoId: repo_id, filePath: file_path, language: language, content: content,
              startLine: start_line, endLine: end_line, symbolName: symbol_name, symbolType: symbol_type},
            score: score, source: source, semanticRank: semantic_rank, bm25Rank: bm25_rank} ORDER BY rank) AS given
        FROM active_full GROUP BY query_id) USING (query_id)""",
    "upsert": f"""WITH incoming AS (
        SELECT d.doc_id::VARCHAR AS id, d.source AS repo_id, d.text || ' q=' || l.quality AS content
        FROM documents d JOIN labels l USING (doc_id)
        UNION ALL SELECT 'b' || item_id, 'src' || (item_id % {corpus.N_REPOS}), text FROM benchmark)
      SELECT id, repo_id, content FROM incoming UNION ALL
      SELECT doc_id::VARCHAR, source, text FROM documents
      WHERE source IN (SELECT repo_id FROM incoming) AND doc_id::VARCHAR NOT IN (SELECT id FROM incoming)""",
    "clear_repo": f"SELECT source = '{CLEARED}' AS removed, count(*) AS n FROM documents GROUP BY 1",
}

def oracle_sql() -> dict[str, str]:
    return {name: _sql(statement) for name, statement in STATEMENTS.items()}
