"""One SQL statement per query."""

from __future__ import annotations

from nameshift.functions.names import TYPE_WORDS
from nameshift.functions.reserved import RESERVED, reserved_words
from nameshift.oracles import context_tables  # noqa: F401  (adds its tables)
from nameshift.oracles.tables import (
    BLANK,
    COMMENT,
    CTES,
    LINE_STRING,
    NUMBER,
    PIECE,
    SEGMENT,
    TOKEN,
    WORD,
    draw,
    lex,
    prob_of,
    q,
    query,
    reserved_list,
    result,
    sigmoid,
    margin,
    valid,
    words_in,
)

C_SEGMENT = rf"{COMMENT}|'(?:[^\\']|\\[\s\S])*'" + r'|"(?:[^\\"]|\\[\s\S])*"' + r"""|[^/'"]+|[\s\S]"""
TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
PY_SEGMENT = rf"\n[ \t]*(?:{TRIPLE}|{LINE_STRING})|{TRIPLE}|{LINE_STRING}|#[^\n]*|" + r"""[^\n#"']+|[\s\S]"""

SPOKEN = "CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'python' ELSE 'javascript' END"
RAW = "documents d JOIN labels l ON d.doc_id = l.doc_id"


def no_blank_lines(text: str) -> str:
    return f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, {q(f'[^{BLANK}]')})), chr(10))"


def digest(values: str, sep: str = " ") -> str:
    return f"md5(array_to_string({values}, {q(sep)}))"


def names_of(tokens: str) -> str:
    return f"first_seen({tokens})"


# distinct names of a token list, first occurrence kept
CTES["conv_named"] = f"""SELECT sample_id, any_value(tokens) AS tokens, list(tok ORDER BY pos) AS names FROM (
    SELECT sample_id, tok, min(pos) AS pos, any_value(tokens) AS tokens FROM conv_rows WHERE {valid('tok')} GROUP BY sample_id, tok) GROUP BY sample_id"""
CTES["conv_occ"] = f"SELECT sample_id, tokens, pos, tok AS name FROM conv_rows WHERE {valid('tok')}"
CTES["doc_named"] = f"""SELECT sample_id, list(tok ORDER BY pos) AS names FROM (
    SELECT sample_id, tok, min(pos) AS pos FROM doc_rows WHERE {valid('tok')} GROUP BY sample_id, tok) GROUP BY sample_id"""
CTES["doc_first"] = """SELECT l.sample_id, l.code, l.tokens, coalesce(n.names[1], 'nothing') AS a, coalesce(n.names[2], 'other') AS b
    FROM doc_lexed l LEFT JOIN doc_named n ON l.sample_id = n.sample_id"""
_not_types = words_in([w for w in reserved_words("c") if w not in TYPE_WORDS])
CTES["doc_declared"] = f"""SELECT sample_id, tok, min(pos) AS pos FROM (
    SELECT *, lag(tok) OVER w AS before, lead(tok) OVER w AS behind FROM doc_rows WINDOW w AS (PARTITION BY sample_id ORDER BY pos))
    WHERE {valid('tok')} AND (before = '*' OR (regexp_full_match(before, {q(WORD)}) AND before NOT IN ({_not_types})))
    AND behind IN ('=', ';', ',', ')', '[') GROUP BY sample_id, tok"""
CTES["offsets"] = f"""SELECT sample_id, pos, word, stop - k AS start, stop FROM (
    SELECT *, sum(k) OVER (PARTITION BY sample_id ORDER BY pos)::BIGINT AS stop FROM (
      SELECT sample_id, pos, word, len(regexp_extract_all(word, {q(PIECE)})) AS k FROM (
        SELECT doc_id AS sample_id, unnest(string_split(replace(text, chr(10), ''), ' ')) AS word,
          generate_subscripts(string_split(replace(text, chr(10), ''), ' '), 1) - 1 AS pos FROM documents)))"""
CTES["spoken_words"] = f"""SELECT DISTINCT {SPOKEN} AS lang, unnest(regexp_split_to_array(text, '[ \\n]')) AS name FROM documents"""
CTES["reserved"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(lang)}, {q(kind)}, {q(w)})" for (lang, kind), ws in RESERVED.items() for w in dict.fromkeys(ws)
) + ") t(lang, kind, word)"

CTES["page_rows"] = f"""SELECT *, sum((tok IN (';', chr(10)))::INT) OVER (PARTITION BY sample_id ORDER BY pos)::BIGINT AS stmt,
    coalesce(lead(tok) OVER (PARTITION BY sample_id ORDER BY pos) = '=', FALSE) AS is_def FROM (
      SELECT sample_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id AS sample_id, {lex('html', r'\n|' + TOKEN)} AS t FROM pages))"""
CTES["page_names"] = f"SELECT sample_id, stmt, pos, tok AS name, is_def FROM page_rows WHERE {valid('tok')}"
CTES["edges"] = """SELECT sample_id, name, pos, 'comesFrom' AS rel, CASE WHEN d IS NULL THEN []::VARCHAR[] ELSE [name] END AS src_names,
    CASE WHEN d IS NULL THEN []::BIGINT[] ELSE [d] END AS src_pos FROM (
      SELECT *, max(CASE WHEN is_def THEN pos END) OVER (PARTITION BY sample_id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM page_names)
    WHERE d IS NOT NULL OR is_def
    UNION ALL
    SELECT u.sample_id, t.name, u.t, 'computedFrom', [u.name], [u.pos] FROM (
      SELECT *, max(CASE WHEN is_def THEN pos END) OVER (PARTITION BY sample_id, stmt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM page_names) u
    JOIN page_names t ON t.sample_id = u.sample_id AND t.pos = u.t"""

# branches and loops, pair by pair: a definition reaches a use if no other one between them hides it
CTES["page_flow"] = """SELECT sample_id, pos, tok, lag(tok) OVER w AS prev, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos,
    sum(CASE tok WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER w AS brace, sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS paren
    FROM page_rows WHERE tok <> chr(10) WINDOW w AS (PARTITION BY sample_id ORDER BY pos)"""
CTES["page_heads"] = """SELECT h.sample_id, h.pos, h.tok, h.prev,
    max(CASE WHEN h.tok = 'if' AND h.prev IS DISTINCT FROM 'else' THEN h.pos END) OVER (PARTITION BY h.sample_id, h.brace ORDER BY h.pos) AS chain,
    CASE WHEN h.tok IN ('else', 'do') THEN h.pos WHEN h.nxt = '(' THEN c.pos END AS anchor
    FROM (SELECT * FROM page_flow WHERE tok IN ('if', 'else', 'do', 'while', 'for')) h
    ASOF LEFT JOIN (SELECT sample_id, pos, paren FROM page_flow WHERE tok = ')') c ON c.sample_id = h.sample_id AND c.paren = h.paren AND c.pos > h.pos"""
CTES["page_blocks"] = """SELECT sample_id, CASE WHEN arm THEN coalesce(chain, pos) END AS chain, CASE WHEN tok IN ('while', 'for') OR prev = 'else' THEN pos ELSE start END AS start, stop FROM (
      SELECT h.*, h.tok IN ('if', 'else') AS arm, a.npos AS start, a.nxt, CASE WHEN a.nxt = '{' THEN b.pos ELSE s.pos END AS stop
      FROM page_heads h JOIN page_flow a ON a.sample_id = h.sample_id AND a.pos = h.anchor
      ASOF LEFT JOIN (SELECT sample_id, pos, brace FROM page_flow WHERE tok = '}') b ON b.sample_id = a.sample_id AND b.brace = a.brace AND b.pos > a.pos
      ASOF LEFT JOIN (SELECT sample_id, pos, brace, paren FROM page_flow WHERE tok = ';') s ON s.sample_id = a.sample_id AND s.brace = a.brace AND s.paren = a.paren AND s.pos > a.pos)
    WHERE stop IS NOT NULL AND NOT (tok = 'else' AND nxt = 'if') AND (arm OR nxt <> ';')"""
CTES["page_inner"] = """SELECT n.sample_id, n.name, n.pos, n.is_def, max_by(b.start, b.start) AS s, max_by(b.stop, b.start) AS e
    FROM page_names n LEFT JOIN page_blocks b ON b.sample_id = n.sample_id AND b.chain IS NOT NULL AND n.pos BETWEEN b.start AND b.stop
    WHERE (n.sample_id, n.name) IN (SELECT (sample_id, name) FROM page_names WHERE is_def) GROUP BY n.sample_id, n.name, n.pos, n.is_def"""
CTES["page_defs"] = "SELECT * FROM page_inner WHERE is_def"
CTES["page_reach"] = """SELECT d.sample_id, d.name, u.pos, d.pos AS src FROM page_defs d JOIN page_inner u ON u.sample_id = d.sample_id AND u.name = d.name AND d.pos < u.pos
    WHERE NOT EXISTS (SELECT 1 FROM page_defs k WHERE k.sample_id = d.sample_id AND k.name = d.name AND k.pos > d.pos AND k.pos < u.pos
        AND (k.s IS NULL OR d.pos BETWEEN k.s AND k.e OR u.pos BETWEEN k.s AND k.e))
      AND NOT EXISTS (SELECT 1 FROM page_blocks x JOIN page_blocks y ON x.sample_id = y.sample_id AND x.chain = y.chain AND x.start <> y.start
        WHERE x.sample_id = d.sample_id AND d.pos BETWEEN x.start AND x.stop AND u.pos BETWEEN y.start AND y.stop)
    UNION
    SELECT d.sample_id, d.name, u.pos, d.pos FROM (SELECT * FROM page_blocks WHERE chain IS NULL) l
    JOIN page_defs d ON d.sample_id = l.sample_id AND d.pos BETWEEN l.start AND l.stop
    JOIN page_inner u ON u.sample_id = d.sample_id AND u.name = d.name AND u.pos BETWEEN l.start AND l.stop
    WHERE NOT EXISTS (SELECT 1 FROM page_defs k WHERE k.sample_id = d.sample_id AND k.name = d.name AND k.pos > d.pos AND k.pos <= l.stop AND (k.s IS NULL OR d.pos BETWEEN k.s AND k.e))
      AND NOT EXISTS (SELECT 1 FROM page_defs k WHERE k.sample_id = u.sample_id AND k.name = u.name AND k.pos >= l.start AND k.pos < u.pos AND (k.s IS NULL OR u.pos BETWEEN k.s AND k.e))"""
_edge_columns = "sample_id, name, pos, rel, array_to_string(src_names, ' ') AS src_names, array_to_string(src_pos, ' ') AS src_pos"

CTES["conv_kept"] = "SELECT * FROM conv_similar WHERE place <= floor(n_fills / 2)"
CTES["conv_union"] = """SELECT g.sample_id, g.name, k.cand, max(k.score) AS score FROM conv_gaps g
    JOIN conv_kept k ON g.name = k.name AND g.prev = k.prev AND g.next = k.next GROUP BY g.sample_id, g.name, k.cand"""
CTES["conv_own"] = f"SELECT DISTINCT sample_id, tok AS cand FROM conv_rows WHERE {valid('tok')}"

CTES["vec_pairs"] = """SELECT e.vec_id // 10 AS occurrence, e.vec_id, round(list_dot_product(o.v, e.v) / (greatest(sqrt(list_dot_product(o.v, o.v)), 1e-6) * greatest(sqrt(list_dot_product(e.v, e.v)), 1e-6)), 6) AS sim
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e
    JOIN (SELECT vec_id // 10 AS occurrence, min(vec_id) AS first_id, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1) o
    ON o.occurrence = e.vec_id // 10 WHERE e.vec_id > o.first_id"""

CTES["bench_rows"] = f"""SELECT sample_id, tokens, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM (
    SELECT item_id AS sample_id, {lex('text')} AS tokens FROM benchmark)"""
CTES["bench_scored"] = f"""SELECT m.sample_id, m.pos, m.name, sum(coalesce(w.w, u.w))::BIGINT AS total, count(*) AS n FROM (
    SELECT sample_id, pos, tok AS name, unnest(list_transform(tokens[:510], lambda t, i: CASE WHEN i = pos + 1 THEN '<unk>' ELSE t END)) AS t FROM bench_rows WHERE {valid('tok')}) m
    LEFT JOIN weights w ON w.tok = m.t, unseen u GROUP BY m.sample_id, m.pos, m.name"""


def variant(token: str) -> str:
    return f"""SELECT sample_id, pos, name, {digest(f"list_transform(tokens, lambda t, i: CASE WHEN i = pos + 1 THEN {q(token)} ELSE t END)")} AS digest FROM conv_occ"""


def occurrence_query(kind: str) -> str:
    return f"SELECT sample_id, name, count(*) AS n_occ, round(max(score), 6) + 0::DOUBLE AS max_score, round(min(score), 6) + 0::DOUBLE AS min_score FROM occ_{kind} GROUP BY sample_id, name"


def composed_query(out: str) -> str:
    return f"SELECT name, prev, next, count(*) AS n_cands, md5(string_agg(cand, ' ' ORDER BY nll, cand_no)) AS digest, min(nll) AS best_nll FROM {out}_composed GROUP BY name, prev, next"


def space_query(space: str) -> str:
    return f"SELECT sample_id, name, count(*) AS n_cands, md5(string_agg(cand, ' ' ORDER BY idx)) AS digest FROM {space} GROUP BY sample_id, name"


def genes_query(prefix: str) -> str:
    pairs = "list_sort(list_transform(list_filter(map_values(genes), lambda g: g.name <> g.cand), lambda g: g.name || '>' || g.cand))"
    return f"SELECT sample_id, array_to_string({pairs}, ' ') AS child, change FROM {prefix}_child1"


_c_text = "text || ' // ' || source || chr(10) || '/* ' || lang || chr(10) || '*/ \"http://a/' || lang || '\" a/**/b'"
_c_clean = no_blank_lines(
    f"array_to_string(list_transform(regexp_extract_all({_c_text}, {q(C_SEGMENT)}), lambda s: CASE WHEN s LIKE '//%' OR s LIKE '/*%' THEN ' ' ELSE s END), '')"
)
_py_text = "'\"\"\"' || source || chr(10) || '\"\"\"' || chr(10) || text || ' # ' || lang || chr(10) || 's = \"a # b\"' || chr(10) || '  ''doc ' || lang || '''' || chr(10) || chr(10) || 'x = ''''''y'''''''"


def py_clean(text: str) -> str:
    return no_blank_lines(
        f"array_to_string(list_transform(regexp_extract_all(chr(10) || {text}, {q(PY_SEGMENT)}), lambda s: CASE WHEN s LIKE '#%' THEN '' WHEN regexp_matches(s, {q(chr(92) + 'A' + chr(92) + 'n[ ' + chr(92) + 't]*[' + chr(34) + chr(39) + ']')}) THEN chr(10) ELSE s END), '')"
    )


_py_clean = py_clean(_py_text)
_py_dressed = "('\"\"\"' || source || chr(10) || 'text' || chr(10) || '\"\"\"' || chr(10) || 'x = total // ' || lang || '  # ratio of ' || lang || chr(10) || text || chr(10) || 'y **= 2 # end')"
PY_OPERATOR = r"\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|->|:=|<<|>>|<=|>=|==|!=|[-+*/%&|^@]="
PY_TOKEN = f"#[^\\n]*|{TRIPLE}|{LINE_STRING}|{WORD}|{NUMBER}|{PY_OPERATOR}|[^{BLANK}]"

STATEMENTS = {
    "src_test_split": f"SELECT sample_id, CASE WHEN {draw('sample_id', q('split'))}::DOUBLE / 4294967296::DOUBLE < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split, label FROM samples",
    "run_params": "SELECT 'documents' AS test_set, count(*) AS test_size, 'lexical' AS tokenizer, 'linear' AS model, 510::BIGINT AS block_size, 'c' AS language, 'greedy' AS attack, 'max_iter=100 top_k=60' AS params FROM samples",
    "reserved_counts": "SELECT r.lang, r.kind, count(DISTINCT r.word) AS n_words, count(*) AS n_tokens FROM doc_rows t JOIN reserved r ON t.tok = r.word GROUP BY r.lang, r.kind",
    "harmonise": f"SELECT d.doc_id, length(d.text) AS code_len, l.quality::BIGINT AS label, d.lang FROM {RAW}",
    "label_clamp": f"SELECT d.doc_id, least(l.quality * 3, 1)::BIGINT AS label, (l.toxic = 1)::BIGINT AS toxic FROM {RAW}",
    "lang_check": "SELECT lang, lang IN ('java', 'c', 'python', 'javascript') AS lang_ok, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'python' ELSE 'ruby' END AS lang FROM documents) GROUP BY lang",
    "attack_gate": "SELECT sample_id, label, predict_label FROM predictions WHERE predict_label = label",
    "outcome_notes": f"SELECT sample_id, note FROM ({result('greedy_outcome', 'greedy')})",
    "valid_names": "SELECT lang, name FROM spoken_words WHERE " + " OR ".join(f"(lang = {q(l)} AND {valid('name', l)})" for l in ("c", "java", "python")),
    "valid_candidates": f"SELECT DISTINCT cand FROM (SELECT trim(name, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS cand FROM spoken_words) WHERE {valid('cand', 'java')}",
    "uid_filter": f"""SELECT * FROM (SELECT DISTINCT name, regexp_full_match(name, '[A-Za-z_][0-9A-Za-z_]*') AND name NOT IN ({reserved_list('c', True)}) AS strict,
        regexp_full_match(name, {q('[A-Za-z_](?:[0-9A-Za-z_]*[^' + chr(39) + chr(34) + ' ' + chr(92) + 'n' + chr(92) + 'r])?')}) AND name NOT IN ({reserved_list('c', True)}) AS compat FROM spoken_words) WHERE strict OR compat""",
    "candidate_not_own": "SELECT sample_id, name, count(*) AS n_cands FROM conv_union WHERE (sample_id, cand) NOT IN (SELECT (sample_id, cand) FROM conv_own) GROUP BY sample_id, name",
    "importance_threshold": "SELECT sample_id, name, importance + 0::DOUBLE AS importance FROM imp_delete WHERE importance >= 0.001",
    "fill_score_cut": """SELECT name, prev, next, sum(keep::INT)::BIGINT AS n_kept, md5(coalesce(string_agg(cand, ' ' ORDER BY place) FILTER (WHERE keep), '')) AS digest FROM (
        SELECT d.name, d.prev, d.next, k.cand, k.place, coalesce(NOT bool_or(k.score < 3000000) OVER (PARTITION BY d.name, d.prev, d.next ORDER BY k.place), FALSE) AS keep
        FROM conv_distinct d LEFT JOIN conv_kept k ON k.name = d.name AND k.prev = d.prev AND k.next = d.next) GROUP BY name, prev, next""",
    "in_window": "SELECT sample_id, count(*) AS n_words, max(start) AS last_start FROM offsets WHERE start < 510 GROUP BY sample_id",
    "positions": f"SELECT sample_id, count(*) AS n_positions, count(DISTINCT tok) AS n_names, sum(pos)::BIGINT AS pos_sum FROM doc_rows WHERE {valid('tok')} GROUP BY sample_id",
    "uid_positions": f"""SELECT sample_id, count(*) AS n_positions, count(DISTINCT tok) AS n_names, sum(pos)::BIGINT AS pos_sum FROM doc_rows
        WHERE {valid('tok')} AND regexp_full_match(tok, '[A-Za-z_][0-9A-Za-z_]*') AND tok NOT IN ({reserved_list('c', True)}) GROUP BY sample_id""",
    "space_in_text": f"""SELECT n.sample_id, count(*) AS n_names, md5(string_agg(n.tok, ' ' ORDER BY n.tok)) AS digest FROM (
        SELECT DISTINCT conv_id || ':' || (turn - 1) AS sample_id, tok FROM conv_rows WHERE {valid('tok')}) n
        WHERE (n.sample_id, n.tok) IN (SELECT (sample_id, tok) FROM conv_rows) GROUP BY n.sample_id""",
    "strip_comments_c": f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_c_clean} AS t FROM documents)",
    "strip_comments_py": f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_py_clean} AS t FROM documents)",
    "drop_blank_lines": f"SELECT doc_id, len(string_split(t, chr(10))) AS n_lines, md5(t) AS digest FROM (SELECT doc_id, {no_blank_lines('text')} AS t FROM documents)",
    "unescape_newlines": r"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, text || chr(10) || replace(text, '\n', chr(10)) AS t FROM documents)",
    "line_tokens": r"""SELECT sample_id, len(ls) AS n_lines, md5(array_to_string(ls, '|')) AS digest FROM (
        SELECT sample_id, list_transform(list_filter(string_split(code, chr(10)), lambda x: x <> ''), lambda x: x || '\n') AS ls FROM conv_lexed)""",
    "tokens": f"SELECT sample_id, len(tokens) AS n_tokens, {digest('tokens')} AS digest FROM doc_lexed",
    "tokens_python": f"""SELECT sample_id, len(t) AS n_tokens, {digest('t')} AS digest FROM (
        SELECT doc_id AS sample_id, list_filter(regexp_extract_all({py_clean(_py_dressed)}, {q(PY_TOKEN)}), lambda t: NOT (t LIKE '#%')) AS t FROM documents)""",
    "span_text": """SELECT sample_id, CASE WHEN last = 0 THEN substring(ls[1], 4, 4)
        ELSE substring(ls[1], 4) || CASE WHEN last > 1 THEN ls[2] ELSE '' END || substring(ls[least(2, last) + 1], 1, 7) END AS span
        FROM (SELECT sample_id, string_split(code, chr(10)) AS ls, len(string_split(code, chr(10))) - 1 AS last FROM doc_lexed)""",
    "subword_offsets": "SELECT sample_id, count(*) AS n_words, max(stop) AS n_pieces, sum(start * (pos + 1))::BIGINT AS start_sum, sum(stop * (pos + 1))::BIGINT AS end_sum FROM offsets GROUP BY sample_id",
    "truncate": f"SELECT sample_id, len(tokens[:510]) AS n_kept, {digest('tokens[:510]')} AS digest FROM doc_lexed",
    "rename_one": f"""SELECT sample_id, a, {digest("list_transform(tokens, lambda t: CASE WHEN t = a THEN 'renamed' ELSE t END)")} AS digest FROM doc_first""",
    "rename_many": f"""SELECT sample_id, {digest("list_transform(tokens, lambda t: CASE t WHEN a THEN b WHEN b THEN a ELSE t END)")} AS digest,
        md5(array_to_string(list_transform(regexp_extract_all(code, {q(SEGMENT)}), lambda t: CASE t WHEN a THEN b WHEN b THEN a ELSE t END), '')) AS text_digest FROM doc_first""",
    "first_seen_distinct": f"""SELECT l.sample_id, coalesce(n, 0) AS n_distinct, coalesce(d, md5('')) AS digest FROM doc_lexed l LEFT JOIN (
        SELECT sample_id, count(*) AS n, md5(string_agg(tok, ' ' ORDER BY pos)) AS d FROM (SELECT sample_id, tok, min(pos) AS pos FROM doc_rows GROUP BY sample_id, tok) GROUP BY sample_id) x
        ON l.sample_id = x.sample_id""",
    "identifiers": """SELECT l.sample_id, coalesce(len(n.names), 0) AS n_all, md5(coalesce(array_to_string(n.names, ' '), '')) AS all_digest,
        coalesce(d.k, 0) AS n_declared, coalesce(d.h, md5('')) AS declared_digest FROM doc_lexed l LEFT JOIN doc_named n ON l.sample_id = n.sample_id
        LEFT JOIN (SELECT sample_id, count(*) AS k, md5(string_agg(tok, ' ' ORDER BY pos)) AS h FROM doc_declared GROUP BY sample_id) d ON d.sample_id = l.sample_id""",
    "def_use_edges": f"SELECT {_edge_columns} FROM edges",
    "merge_edges": """SELECT sample_id, name, pos, rel, array_to_string(list_sort(list_distinct(flatten(list(src_names)))), ' ') AS src_names,
        array_to_string(list_sort(list_distinct(flatten(list(src_pos)))), ' ') AS src_pos FROM edges GROUP BY sample_id, name, pos, rel""",
    "flow_edges": """SELECT n.sample_id, n.name, n.pos, 'comesFrom' AS rel, CASE WHEN count(r.src) > 0 THEN n.name ELSE '' END AS src_names, coalesce(string_agg(r.src::VARCHAR, ' ' ORDER BY r.src), '') AS src_pos
        FROM page_names n LEFT JOIN page_reach r ON r.sample_id = n.sample_id AND r.name = n.name AND r.pos = n.pos GROUP BY n.sample_id, n.name, n.pos, n.is_def HAVING n.is_def OR count(r.src) > 0
        UNION ALL SELECT sample_id, name, pos, rel, array_to_string(list_sort(list_distinct(flatten(list(src_names)))), ' '), array_to_string(list_sort(list_distinct(flatten(list(src_pos)))), ' ')
        FROM edges WHERE rel = 'computedFrom' GROUP BY sample_id, name, pos, rel""",
    "merge_defs": "SELECT sample_id, name, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS def_pos FROM page_names WHERE is_def GROUP BY sample_id, name",
    "changed_positions": """SELECT sample_id, a, (length(code) - length(replace(code, a, ''))) // length(a) AS n_substring,
        len(list_filter(tokens, lambda t: t = a)) AS n_token FROM doc_first""",
    "variants_unk": variant("<unk>"),
    "variants_mask": variant("<mask>"),
    "variants_delete": f"SELECT sample_id, pos, name, {digest('list_concat(tokens[:pos], tokens[pos + 2:])')} AS digest FROM conv_occ",
    "variants_unk_all": f"""SELECT sample_id, name, {digest("list_transform(tokens, lambda t: CASE WHEN t = name THEN '<unk>' ELSE t END)")} AS digest
        FROM (SELECT DISTINCT sample_id, name, tokens FROM conv_occ)""",
    "variants_rename": f"""SELECT sample_id, name, cand, {digest("list_transform(tokens, lambda t: CASE WHEN t = name THEN cand ELSE t END)")} AS digest
        FROM (SELECT DISTINCT sample_id, name, unnest(['v_' || name, name || '_2']) AS cand, tokens FROM conv_occ)""",
    "predict": "SELECT sample_id, label, predict_label, round(predict_probability, 6) AS predict_probability FROM predictions",
    "label_prob": f"SELECT sample_id, label, round({prob_of('label', 'total', 'n')}, 6) AS label_prob, predict_label AS pred_label FROM predictions",
    "train_weights": "SELECT tok, w, n FROM weights",
    "score_variants": f"SELECT sample_id, pos, name, round({sigmoid(margin('total', 'n'))}, 6) AS prob, (total > 0)::BIGINT AS pred_label FROM bench_scored",
    "fill_topk": """SELECT d.name, d.prev, d.next, d.n, coalesce(f.k, 0) AS n_fills, coalesce(f.h, md5('')) AS digest FROM conv_distinct d LEFT JOIN (
        SELECT name, prev, next, count(*) AS k, md5(string_agg(cand, ' ' ORDER BY idx)) AS h FROM conv_fills WHERE idx < 60 GROUP BY name, prev, next) f
        ON d.name = f.name AND d.prev = f.prev AND d.next = f.next""",
    "cosine_pairs": "SELECT occurrence, count(*) AS n, round(avg(sim), 6) AS mean_sim FROM vec_pairs GROUP BY occurrence",
    "similar_top_half": "SELECT occurrence, vec_id, r, sim FROM (SELECT *, row_number() OVER (PARTITION BY occurrence ORDER BY sim DESC, vec_id) AS r, count(*) OVER (PARTITION BY occurrence) AS k FROM vec_pairs) WHERE r <= floor(k / 2)",
    "similar_threshold_topn": "SELECT occurrence, vec_id, r, sim FROM (SELECT *, row_number() OVER (PARTITION BY occurrence ORDER BY sim DESC, vec_id) AS r FROM vec_pairs WHERE sim >= 0) WHERE r <= 3",
    "compose_beam": "SELECT name, count(*) AS n_cands, md5(string_agg(cand, ' ' ORDER BY nll, cand_no)) AS digest, min(nll) AS best_nll FROM all_composed GROUP BY name",
    "compose_context": composed_query("joined"),
    "compose_context_threshold": composed_query("strict"),
    "search_space_exact": space_query("exact_space"),
    "search_space_exact_near": space_query("exact_near_space"),
    "candidate_union": "SELECT sample_id, name, count(*) AS n_cands, md5(string_agg(cand, ' ' ORDER BY score DESC, cand)) AS digest FROM conv_union GROUP BY sample_id, name",
    "search_space": "SELECT sample_id, name, count(*) AS n_cands, md5(string_agg(cand, ' ' ORDER BY idx)) AS digest FROM space GROUP BY sample_id, name",
    "importance_unk": occurrence_query("unk"),
    "importance_mask": occurrence_query("unk"),
    "importance_delete": occurrence_query("delete"),
    "importance_by_name": "SELECT sample_id, name, importance + 0::DOUBLE AS importance FROM imp_unk",
    "importance_compat": """SELECT sample_id, name, round(sum(shifted), 9) + 0::DOUBLE AS importance FROM (
        SELECT sample_id, name, coalesce(lag(score) OVER (PARTITION BY sample_id ORDER BY first_pos, pos), 0) AS shifted FROM occ_unk) GROUP BY sample_id, name""",
    "importance_rank": "SELECT sample_id, name, row_number() OVER (PARTITION BY sample_id ORDER BY importance DESC, first_pos) AS rank FROM imp_unk",
    "query_count": "SELECT sample_id, count(*) + 1 AS query_count FROM occ_unk GROUP BY sample_id",
    "best_candidate": "SELECT sample_id, name, rank, CASE WHEN delta < 0 THEN cand ELSE name END AS best, least(delta, 0)::BIGINT AS delta FROM free_best",
    "first_flip": "SELECT sample_id, f.rank, f.idx, f.name, f.cand FROM free_flip",
    "budget": "SELECT sample_id, name, rank, used::BIGINT AS used, evaluated::BIGINT AS evaluated FROM wide_budget WHERE idx = 1",
    "attack_greedy": result("greedy_outcome", "greedy"),
    "attack_fooler": result("fooler_outcome", "codefooler", "near_space"),
    "attack_mask_greedy": result("free_outcome", "codeattack"),
    "ga_init": "SELECT sample_id, rank AS member, coalesce(cand, '') AS cand, delta::BIGINT AS change, queries::BIGINT AS queries FROM ga_init",
    "ga_fitness": f"SELECT sample_id, rank AS member, round({sigmoid(margin('margin', 'n'))} - {sigmoid(margin('margin + delta', 'n'))}, 6) + 0::DOUBLE AS fitness FROM ga_init",
    "ga_parents": f"""SELECT sample_id, step, {draw('sample_id', 'step', q('parent1'))} % (n_names + 1) AS parent1, {draw('sample_id', 'step', q('parent2'))} % (n_names + 1) AS parent2
        FROM (SELECT sample_id, count(*) AS n_names FROM ga_init GROUP BY sample_id), (SELECT unnest(range(1, 6)) AS step)""",
    "ga_crossover": genes_query("cross"),
    "ga_mutate": genes_query("mut"),
    "ga_replace": """SELECT sample_id, count(*) AS n_members, sum(c)::BIGINT AS change_sum, min(c)::BIGINT AS best FROM (
        SELECT sample_id, coalesce(list_sum(list_transform(map_values(genes), lambda g: g.delta)), 0) AS c FROM ga_members1) GROUP BY sample_id""",
    "attack_ga": result("ga_outcome", "ga"),
    "attack_cascade": result("cascade_outcome", "alert"),
    "mhm_proposals": "SELECT sample_id, iteration, name, n_proposed, digest FROM mhm_rows",
    "mhm_choice": "SELECT sample_id, iteration, flip_pos, best_cand, round(min_prob, 6) AS min_prob, queries FROM mhm_rows",
    "mhm_accept": f"""SELECT sample_id, iteration, round(alpha, 6) AS alpha, CASE WHEN flip_pos > 0 THEN 's'
        WHEN {draw('sample_id', 'iteration', q('accept'))}::DOUBLE / 4294967296::DOUBLE > alpha OR alpha < 1 THEN 'r' ELSE 'a' END AS status
        FROM (SELECT *, (1 - min_prob + 1e-10) / (1 - prob_before + 1e-10) AS alpha FROM mhm_rows)""",
    "attack_mhm": result("mhm_outcome", "mhm"),
    "accuracy": "SELECT d.source, count(*) AS n_samples, round(avg((predict_label = label)::INT), 6) AS accuracy FROM predictions p JOIN documents d ON p.sample_id = d.doc_id GROUP BY d.source",
    "robustness": """SELECT attack, 'linear' AS model, sum(is_attack::INT)::BIGINT AS attacked, sum(is_success::INT)::BIGINT AS flipped,
        round(1 - sum(is_success::INT) / nullif(sum(is_attack::INT), 0), 6) AS robustness FROM matrix GROUP BY attack""",
    "robustness_table": "SELECT 'linear' AS model, "
    + ", ".join(f"max(r) FILTER (WHERE attack = {q(a)}) AS {a}" for a in ("greedy", "ga", "alert", "codefooler", "codeattack", "mhm"))
    + " FROM (SELECT attack, round(1 - sum(is_success::INT) / nullif(sum(is_attack::INT), 0), 6) AS r FROM matrix GROUP BY attack)",
    "query_cost": "SELECT attack, round(avg(query_time), 6) AS avg_queries, max(query_time) AS max_queries FROM matrix WHERE is_attack GROUP BY attack",
    "attack_matrix": "SELECT * FROM matrix",
}

ORACLES = {name: query(body) for name, body in STATEMENTS.items()}
