"""Shared common table expressions of the SQL counterparts.

``query(body)`` puts every expression that ``body`` mentions, directly or through others, in front of it.
"""

from __future__ import annotations

import re

from nameshift.functions.reserved import NAME_RULE_LANGUAGES, RESERVED

BLOCK = 510
TOP_K = 60
WIDE_K = 150
SEED = 42

BLANK = r" \t\n\r\f\x0B"
WORD = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"
NUMBER = r"\p{Nd}[\p{L}\p{N}_.]*"
OPERATOR = r"\.\.\.|>>=|<<=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]="
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
LINE_STRING = r'"(?:[^"\\\n]|\\[^\n])*"' + r"|'(?:[^'\\\n]|\\[^\n])*'"
TOKEN = f"{COMMENT}|{LINE_STRING}|{WORD}|{NUMBER}|{OPERATOR}|[^{BLANK}]"
SEGMENT = f"{TOKEN}|[{BLANK}]+"
PIECE = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}+|_|\p{L}"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words_in(values: list[str]) -> str:
    return ", ".join(q(v) for v in values)


def reserved_list(lang: str, operators: bool = False) -> str:
    return words_in(sorted({w for (l, k), ws in RESERVED.items() if l == lang and (operators or k != "operator") for w in ws}))


def valid(column: str, lang: str = "c") -> str:
    """Identifier form and no reserved word."""
    if lang not in NAME_RULE_LANGUAGES:
        return "FALSE"
    return f"(regexp_full_match({column}, {q(WORD)}) AND {column} NOT IN ({reserved_list(lang)}))"


def lex(column: str, pattern: str = TOKEN) -> str:
    return f"list_filter(regexp_extract_all({column}, {q(pattern)}), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%'))"


def hash32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::UBIGINT::BIGINT"


def draw(*parts: str) -> str:
    return hash32("concat_ws('|', " + ", ".join([q(str(SEED)), *[f"({p})::VARCHAR" for p in parts]]) + ")")


def sigmoid(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


def margin(total: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN ({total})::DOUBLE / (({n})::DOUBLE * 1000000) ELSE 0 END)"


def prob_of(label: str, total: str, n: str) -> str:
    z = margin(total, n)
    return sigmoid(f"CASE WHEN {label} = 1 THEN {z} ELSE -{z} END")


def flips(label: str, value: str) -> str:
    return f"(({value}) < 0 OR (({value}) = 0 AND {label} = 1))"


def micro_odds(c1: str, c0: str) -> str:
    def ln(c, n):
        return f"ln((({c})::DOUBLE + 10) / ({n}::DOUBLE + 10::DOUBLE * v))"

    return f"round(({ln(c1, 'n1')} - {ln(c0, 'n0')}) * 1000000::DOUBLE)::BIGINT"


_votes = " + ".join(f"(CASE WHEN sum(c * (1 - 2 * ((h >> {i}) & 1))) >= 0 THEN {1 << i} ELSE 0 END)" for i in range(32))

CTES: dict[str, str] = {
    "samples": "SELECT d.doc_id AS sample_id, d.text AS code, least(l.quality, 1)::BIGINT AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "lexed": f"SELECT sample_id, code, label, {lex('code')} AS tokens FROM samples",
    "tok_rows": "SELECT sample_id, label, len(tokens) AS n_tokens, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM lexed",
    "doc_lexed": f"SELECT doc_id AS sample_id, text AS code, {lex('text')} AS tokens FROM documents",
    "doc_rows": "SELECT sample_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM doc_lexed",
    "conv_lexed": f"SELECT conv_id || ':' || turn AS sample_id, conv_id, turn, text AS code, {lex('text')} AS tokens FROM conversations",
    "conv_rows": "SELECT sample_id, conv_id, turn, tokens, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM conv_lexed",
    # scorer
    "counts": "SELECT tok, sum((label = 1)::INT)::BIGINT AS c1, sum((label = 0)::INT)::BIGINT AS c0 FROM tok_rows GROUP BY tok",
    "totals": "SELECT sum(c1)::BIGINT AS n1, sum(c0)::BIGINT AS n0, count(*) AS v FROM counts",
    "weights": f"SELECT tok, {micro_odds('c1', 'c0')} AS w, (c1 + c0)::BIGINT AS n FROM counts, totals",
    "unseen": f"SELECT {micro_odds('0', '0')} AS w FROM totals",
    "terms": f"""SELECT t.*, sum(n_win * w) OVER (PARTITION BY sample_id)::BIGINT AS total,
        coalesce(max(CASE WHEN enters THEN w END) OVER (PARTITION BY sample_id), 0) AS enter_w, least(n_tokens, {BLOCK})::BIGINT AS n
        FROM (SELECT g.*, weights.w FROM (SELECT sample_id, label, n_tokens, tok, min(pos) AS first_pos, count(*) AS n_occ,
          count(*) FILTER (WHERE pos < {BLOCK}) AS n_win, bool_or(pos = {BLOCK}) AS enters
          FROM tok_rows GROUP BY sample_id, label, n_tokens, tok) g JOIN weights ON g.tok = weights.tok) t""",
    "predictions": f"""SELECT *, {prob_of('predict_label', 'total', 'n')} AS predict_probability FROM (
        SELECT s.sample_id, s.label, coalesce(t.total, 0) AS total, coalesce(t.n, 0) AS n, (coalesce(t.total, 0) > 0)::BIGINT AS predict_label
        FROM samples s LEFT JOIN (SELECT sample_id, max(total) AS total, max(n) AS n FROM terms GROUP BY sample_id) t ON s.sample_id = t.sample_id)""",
    "all_names": f"SELECT tok AS name, * EXCLUDE (tok) FROM terms WHERE {valid('tok')}",
    "names": "SELECT *, CASE WHEN label = 1 THEN 1 ELSE -1 END AS sign FROM all_names WHERE (total > 0)::BIGINT = label",
    # fill model
    "bigrams": "SELECT a, b, count(*) AS c FROM (SELECT unnest(list_concat([''], tokens)) AS a, unnest(list_concat(tokens, [''])) AS b FROM doc_lexed) GROUP BY a, b",
    "neighbours": f"""SELECT *, {hash32('u')} AS h FROM (SELECT a AS tok, 'R' || b AS u, c, c AS k FROM bigrams
        UNION ALL SELECT b, 'L' || a, c, 0 FROM bigrams) WHERE tok <> ''""",
    "words": f"SELECT tok, sum(k)::BIGINT AS n, ({_votes})::BIGINT AS sig FROM neighbours GROUP BY tok",
    "after_top": f"SELECT * FROM (SELECT a AS key, b AS tok, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM bigrams WHERE b <> '') WHERE r <= {WIDE_K}",
    "before_top": f"SELECT * FROM (SELECT b AS key, a AS tok, c, row_number() OVER (PARTITION BY b ORDER BY c DESC, a) AS r FROM bigrams WHERE a <> '') WHERE r <= {WIDE_K}",
    # gaps of gated samples and of conversations
    "gaps": f"""SELECT DISTINCT sample_id, tok AS name, prev, next FROM (
        SELECT sample_id, label, tok, pos, coalesce(lag(tok) OVER w, '') AS prev, coalesce(lead(tok) OVER w, '') AS next
        FROM tok_rows WINDOW w AS (PARTITION BY sample_id ORDER BY pos))
        WHERE pos < {BLOCK} AND {valid('tok')} AND sample_id IN (SELECT sample_id FROM predictions WHERE predict_label = label)""",
    "conv_gaps": f"""SELECT DISTINCT sample_id, tok AS name, prev, next FROM (
        SELECT sample_id, tok, pos, coalesce(lag(tok) OVER w, '') AS prev, coalesce(lead(tok) OVER w, '') AS next
        FROM conv_rows WINDOW w AS (PARTITION BY sample_id ORDER BY pos)) WHERE pos < {BLOCK} AND {valid('tok')}""",
    "own_names": f"SELECT DISTINCT sample_id, tok AS name FROM tok_rows WHERE {valid('tok')}",
    # word composition
    "piece_words": f"SELECT tok, n, regexp_extract_all(tok, {q(PIECE)}) AS ps FROM words",
    "piece_pairs": "SELECT p, q, sum(n)::BIGINT AS c FROM (SELECT n, unnest(list_concat([''], ps[:-2])) AS p, unnest(ps) AS q FROM piece_words WHERE len(ps) > 0) GROUP BY p, q",
    "piece_totals": "SELECT p, sum(c)::BIGINT AS t FROM piece_pairs GROUP BY p",
    "piece_vocab": "SELECT count(DISTINCT q) AS v FROM piece_pairs",
    "piece_top": "SELECT * FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY c DESC, q) AS r FROM piece_pairs) WHERE r <= 4",
}


def _fills(gaps: str, out: str, top_k: int = TOP_K) -> dict[str, str]:
    """Fills of the distinct gaps, in order, and in similarity order."""
    return {
        f"{out}_distinct": f"SELECT name, prev, next, count(*) AS n FROM {gaps} GROUP BY name, prev, next",
        f"{out}_fills": f"""SELECT *, row_number() OVER (PARTITION BY name, prev, next ORDER BY score DESC, cand) - 1 AS idx FROM (
            SELECT f.name, f.prev, f.next, f.cand, (round(ln(1 + coalesce(x.c, 0)::DOUBLE) * 1000000)::BIGINT + round(ln(1 + coalesce(y.c, 0)::DOUBLE) * 1000000)::BIGINT) AS score FROM (
              SELECT d.name, d.prev, d.next, t.tok AS cand FROM {out}_distinct d JOIN after_top t ON d.prev = t.key AND t.r <= {top_k}
              UNION
              SELECT d.name, d.prev, d.next, t.tok FROM {out}_distinct d JOIN before_top t ON d.next = t.key AND t.r <= {top_k}) f
            LEFT JOIN bigrams x ON x.a = f.prev AND x.b = f.cand LEFT JOIN bigrams y ON y.a = f.cand AND y.b = f.next )""",
        f"{out}_similar": f"""SELECT *, row_number() OVER (PARTITION BY name, prev, next ORDER BY dist, idx) AS place,
            count(*) OVER (PARTITION BY name, prev, next) AS n_fills FROM (
              SELECT f.*, bit_count(xor(coalesce(x.sig, 0), y.sig)) AS dist FROM {out}_fills f
              LEFT JOIN words x ON f.name = x.tok JOIN words y ON f.cand = y.tok WHERE f.idx < {top_k})""",
    }


CTES |= _fills("gaps", "doc")
CTES |= _fills("conv_gaps", "conv")
CTES |= _fills("gaps", "near", WIDE_K)


def _space(out: str, similar: str, kept: str) -> dict[str, str]:
    single = f"len(regexp_extract_all(g.name, {q(PIECE)})) = 1"
    multi = f"len(regexp_extract_all(g.name, {q(PIECE)})) > 1"
    return {
        out: f"""SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY score DESC, cand) AS idx FROM (
            SELECT sample_id, name, cand, max(score) AS score FROM (
              SELECT g.sample_id, g.name, k.cand, k.score FROM gaps g JOIN {similar} k ON g.name = k.name AND g.prev = k.prev AND g.next = k.next
              WHERE {single} AND {kept}
              UNION ALL
              SELECT g.sample_id, g.name, c.cand, c.score FROM gaps g JOIN doc_composed c ON g.name = c.name WHERE {multi})
            WHERE {valid('cand')} AND (sample_id, cand) NOT IN (SELECT (sample_id, name) FROM own_names)
            GROUP BY sample_id, name, cand)""",
    }


def _composed(out: str, names: str) -> dict[str, str]:
    """Beam over the piece options of multi-piece names."""
    return {
        f"{out}_multi": f"SELECT DISTINCT name, regexp_extract_all(name, {q(PIECE)}) AS ps FROM ({names}) WHERE len(regexp_extract_all(name, {q(PIECE)})) > 1",
        f"{out}_slots": f"SELECT name, unnest(list_concat([''], ps[:-2])[:12]) AS p, generate_subscripts(list_concat([''], ps[:-2])[:12], 1) AS slot FROM {out}_multi",
        f"{out}_options": f"SELECT s.name, s.slot, t.r, t.q FROM {out}_slots s JOIN piece_top t ON s.p = t.p",
        f"{out}_beam": f"""SELECT name, 1::BIGINT AS slot, r::BIGINT AS ord, [q] AS parts FROM {out}_options WHERE slot = 1
            UNION ALL
            SELECT b.name, b.slot + 1, row_number() OVER (PARTITION BY b.name ORDER BY b.ord, o.r), list_append(b.parts, o.q)
            FROM {out}_beam b JOIN {out}_options o ON o.name = b.name AND o.slot = b.slot + 1 WHERE b.ord <= 24""",
        f"{out}_built": f"""SELECT b.name, b.ord - 1 AS cand_no, b.parts FROM {out}_beam b
            JOIN (SELECT name, max(slot) AS last FROM {out}_slots GROUP BY name) m ON m.name = b.name AND m.last = b.slot WHERE b.ord <= 24""",
        f"{out}_composed": f"""SELECT name, cand_no, cand, sum(nll)::BIGINT AS nll, -floor(sum(nll)::DOUBLE / count(*))::BIGINT AS score FROM (
            SELECT x.*, round(-ln((coalesce(pp.c, 0)::DOUBLE + 1) / (coalesce(pt.t, 0) + v)::DOUBLE) * 1000000)::BIGINT AS nll FROM (
              SELECT name, cand_no, array_to_string(parts, '') AS cand, unnest(list_concat([''], parts[:-2])) AS p, unnest(parts) AS q FROM {out}_built) x
            LEFT JOIN piece_pairs pp ON x.p = pp.p AND x.q = pp.q LEFT JOIN piece_totals pt ON x.p = pt.p, piece_vocab)
            GROUP BY name, cand_no, cand""",
    }


CTES |= _composed("doc", "SELECT name FROM gaps")
CTES |= _composed("all", f"SELECT tok AS name FROM words WHERE {valid('tok')}")
CTES |= _space("space", "doc_similar", "k.place <= floor(k.n_fills / 2)")
CTES |= _space(
    "near_space",
    "near_similar",
    "k.place <= 50 AND cos(0.09817477042468103::DOUBLE * k.dist) >= 0.7",
)

RECURSIVE = {"doc_beam", "all_beam"}


def occurrence_score(kind: str) -> str:
    """Importance of one occurrence inside the window."""
    before = prob_of("label", "total", "n")
    if kind == "unk":
        return f"({before} - {prob_of('label', 'total - w + (SELECT w FROM unseen)', 'n')})"
    total = "(total - w + CASE WHEN n_tokens > n THEN enter_w ELSE 0 END)"
    n = "(CASE WHEN n_tokens > n THEN n ELSE n - 1 END)"
    new = f"(({total}) > 0)::BIGINT"
    drop = f"({before} - {prob_of('label', total, n)})"
    turned = f"({prob_of(new, total, n)} - {prob_of(new, 'total', 'n')})"
    return f"(CASE WHEN {new} = label THEN {drop} ELSE {drop} + {turned} END)"


for _kind in ("unk", "delete"):
    CTES[f"occ_{_kind}"] = f"""SELECT r.sample_id, r.tok AS name, n.first_pos, r.pos, CASE WHEN r.pos < {BLOCK} THEN n.score ELSE 0 END AS score
        FROM tok_rows r JOIN (SELECT *, {occurrence_score(_kind)} AS score FROM names) n ON r.sample_id = n.sample_id AND r.tok = n.name"""
    CTES[f"imp_{_kind}"] = f"SELECT sample_id, name, round(sum(score), 9) AS importance, min(pos) AS first_pos FROM occ_{_kind} GROUP BY sample_id, name"


def _search(out: str, space: str, imp: str | None) -> dict[str, str]:
    """Search rows of one space and ranking."""
    importance = "i.importance" if imp else "0"
    join = f"JOIN {imp} i ON i.sample_id = s.sample_id AND i.name = s.name" if imp else ""
    return {
        out: f"""SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY importance DESC, first_pos) AS rank,
            count(*) OVER (PARTITION BY sample_id, name) AS m,
            1 + sum(CASE WHEN idx = 1 THEN n_occ ELSE 0 END) OVER (PARTITION BY sample_id) AS spent FROM (
              SELECT s.sample_id, s.name, s.idx, s.cand, n.label, n.n, n.n_occ, n.first_pos, {importance} AS importance, n.sign * n.total AS margin,
                n.sign * n.n_win * (coalesce(w.w, (SELECT w FROM unseen)) - n.w) AS delta
              FROM {space} s JOIN names n ON s.sample_id = n.sample_id AND s.name = n.name {join} LEFT JOIN weights w ON w.tok = s.cand)""",
    }


CTES |= _search("rows_unk", "space", "imp_unk")
CTES |= _search("rows_text", "space", None)
CTES |= _search("rows_near", "near_space", "imp_delete")

EARLIER = "(PARTITION BY sample_id ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _greedy(out: str, rows: str, max_iter: int | None, q0: str = "spent") -> dict[str, str]:
    """Budget, best rename, first flip, and one outcome row per sample."""
    limit = str(max_iter) if max_iter is not None else "9223372036854775807"
    return {
        f"{out}_before": f"SELECT *, {q0} AS q0, {q0} + coalesce(count(*) OVER {EARLIER}, 0) AS before FROM {rows}",
        f"{out}_past": f"SELECT *, min(CASE WHEN before >= {limit} THEN rank END) OVER (PARTITION BY sample_id) AS first_past FROM {out}_before",
        f"{out}_budget": f"""SELECT * FROM (SELECT *, CASE WHEN before >= {limit} THEN greatest(q0, {limit}) + rank - first_past ELSE before END AS used,
            CASE WHEN before >= {limit} THEN 1 ELSE least(m, {limit} - before) END AS evaluated FROM {out}_past) WHERE idx <= evaluated""",
        f"{out}_best": f"""SELECT sample_id, name, rank, arg_min(cand, struct_pack(d := delta, i := idx)) AS cand, min(delta) AS delta
            FROM {out}_budget GROUP BY sample_id, name, rank""",
        f"{out}_gain": f"SELECT *, coalesce(sum(least(delta, 0)) OVER {EARLIER}, 0) AS earlier FROM {out}_best",
        f"{out}_flip": f"""SELECT sample_id, arg_min(struct_pack(rank := rank, idx := idx, name := name, cand := cand), struct_pack(rank := rank, idx := idx)) AS f FROM (
            SELECT b.*, g.earlier FROM {out}_budget b JOIN {out}_gain g ON b.sample_id = g.sample_id AND b.name = g.name)
            WHERE {flips('label', 'margin + earlier + delta')} GROUP BY sample_id""",
        f"{out}_done": f"""SELECT b.sample_id, b.label, b.rank, b.name, b.used, b.evaluated, f.f,
            CASE WHEN f.f IS NOT NULL AND b.rank = f.f.rank THEN f.f.cand WHEN g.delta < 0 THEN g.cand ELSE b.name END AS to_name,
            CASE WHEN f.f IS NOT NULL AND b.rank = f.f.rank THEN b.used + f.f.idx ELSE b.used + b.evaluated END AS q
            FROM {out}_budget b JOIN {out}_best g ON b.sample_id = g.sample_id AND b.name = g.name LEFT JOIN {out}_flip f ON f.sample_id = b.sample_id
            WHERE b.idx = 1 AND (f.f IS NULL OR b.rank <= f.f.rank)""",
        f"{out}_outcome": f"""SELECT sample_id, TRUE AS is_attack, bool_or(f IS NOT NULL) AS is_success, max(q)::BIGINT AS query_time,
            map_from_entries(list(struct_pack(k := name, v := to_name))) AS replaced FROM {out}_done GROUP BY sample_id""",
    }


CTES |= _greedy("greedy", "rows_unk", 100)
CTES |= _greedy("half", "rows_unk", 50)
CTES |= _greedy("free", "rows_unk", None)
CTES |= _greedy("wide", "rows_unk", 1000)
CTES["rows_kept"] = "SELECT * FROM rows_near WHERE importance >= -1"
CTES |= _greedy("near", "rows_kept", 100)
CTES["fooler_outcome"] = """SELECT * FROM near_outcome UNION ALL
    SELECT sample_id, TRUE, FALSE, max(spent)::BIGINT, map_from_entries(list(struct_pack(k := name, v := name)) FILTER (WHERE FALSE)) FROM rows_near
    WHERE sample_id NOT IN (SELECT sample_id FROM near_outcome) GROUP BY sample_id"""


def result(outcome: str, attack: str, space: str = "space") -> str:
    """Result rows of one attack, in the comparable form."""
    seg = f"regexp_extract_all(s.code, {q(SEGMENT)})"
    renamed = f"array_to_string(list_transform({seg}, lambda t: coalesce(o.replaced[t], t)), '')"
    return f"""SELECT s.sample_id, {q(attack)} AS attack, p.label, p.predict_label, round(p.predict_probability, 6) AS predict_probability,
        coalesce(o.is_attack, FALSE) AS is_attack, coalesce(o.is_success, FALSE) AS is_success, coalesce(o.query_time, 0)::BIGINT AS query_time,
        CASE WHEN p.predict_label <> p.label THEN 'This code is wrongly predicted by the model.'
             WHEN coalesce(a.n_names, 0) = 0 THEN 'This code does not include any variable.'
             WHEN coalesce(c.n_subst, 0) = 0 THEN 'Variables do not have substitutes.' ELSE '' END AS note,
        coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(o.replaced), lambda e: e.key <> e.value), lambda e: e.key || '>' || e.value)), ' '), '') AS replaced,
        CASE WHEN coalesce(o.is_success, FALSE) THEN 1 - p.label ELSE -1 END AS adv_label,
        CASE WHEN coalesce(o.is_success, FALSE) THEN md5({renamed}) ELSE '' END AS adv_digest
        FROM samples s JOIN predictions p ON p.sample_id = s.sample_id
        LEFT JOIN (SELECT sample_id, count(*) AS n_names FROM all_names GROUP BY sample_id) a ON a.sample_id = s.sample_id
        LEFT JOIN (SELECT sample_id, count(*) AS n_subst FROM {space} GROUP BY sample_id) c ON c.sample_id = s.sample_id
        LEFT JOIN {outcome} o ON o.sample_id = s.sample_id"""


# sampling strategy
CTES["mhm_names"] = "SELECT sample_id, max(rank) AS n_names FROM rows_text GROUP BY sample_id"
CTES["mhm_steps"] = f"""SELECT sample_id, it AS iteration, {draw('sample_id', 'it', "'variable'")} % n_names + 1 AS rank
    FROM mhm_names, (SELECT unnest(range(1, 101)) AS it)"""
CTES["mhm_sampled"] = f"""SELECT * FROM (SELECT r.*, s.iteration,
    row_number() OVER (PARTITION BY r.sample_id, s.iteration ORDER BY {draw('r.sample_id', 's.iteration', 'r.cand', "'proposal'")}, r.cand) AS place
    FROM mhm_steps s JOIN rows_text r ON s.sample_id = r.sample_id AND s.rank = r.rank) WHERE place <= 30"""
CTES["mhm_proposed"] = f"""SELECT *, row_number() OVER (PARTITION BY sample_id, iteration ORDER BY place) AS i, {flips('label', 'margin + delta')} AS hit
    FROM mhm_sampled WHERE regexp_full_match(cand, '[A-Za-z_][0-9A-Za-z_]*') AND cand NOT IN ({reserved_list('c', True)})"""
CTES["mhm_heads"] = "SELECT s.sample_id, s.iteration, r.name, r.label, r.margin, r.n FROM mhm_steps s JOIN rows_text r ON s.sample_id = r.sample_id AND s.rank = r.rank AND r.idx = 1"
CTES["mhm_rows"] = f"""SELECT h.*, coalesce(p.n_proposed, 0) AS n_proposed, coalesce(p.digest, md5('')) AS digest, coalesce(p.flip_pos, 0) AS flip_pos, p.flip_cand,
    CASE WHEN coalesce(p.min_delta, 0) < 0 THEN p.min_cand ELSE h.name END AS best_cand,
    {sigmoid(margin('h.margin + least(coalesce(p.min_delta, 0), 0)', 'h.n'))} AS min_prob,
    {sigmoid(margin('h.margin', 'h.n'))} AS prob_before,
    1 + CASE WHEN coalesce(p.flip_pos, 0) > 0 THEN p.flip_pos ELSE coalesce(p.n_proposed, 0) END AS queries
    FROM mhm_heads h LEFT JOIN (SELECT sample_id, iteration, count(*) AS n_proposed, md5(string_agg(cand, ' ' ORDER BY i)) AS digest,
      min(CASE WHEN hit THEN i END) AS flip_pos, arg_min(cand, i) FILTER (WHERE hit) AS flip_cand, min(delta) AS min_delta,
      arg_min(cand, struct_pack(d := delta, i := i)) AS min_cand FROM mhm_proposed GROUP BY sample_id, iteration) p
    ON p.sample_id = h.sample_id AND p.iteration = h.iteration"""
CTES["mhm_outcome"] = """SELECT r.sample_id, TRUE AS is_attack, bool_or(f.it IS NOT NULL) AS is_success, sum(queries)::BIGINT AS query_time,
    map_from_entries(list(struct_pack(k := name, v := flip_cand)) FILTER (WHERE iteration = f.it)) AS replaced
    FROM mhm_rows r LEFT JOIN (SELECT sample_id, min(iteration) AS it FROM mhm_rows WHERE flip_pos > 0 GROUP BY sample_id) f ON f.sample_id = r.sample_id
    WHERE f.it IS NULL OR iteration <= f.it GROUP BY r.sample_id"""


def _genetic(out: str, init: str, steps: int, cross: str) -> dict[str, str]:
    """Generations, unrolled. An assignment is a map name number -> struct(name, cand, delta)."""
    genes = "MAP(BIGINT, STRUCT(name VARCHAR, cand VARCHAR, delta BIGINT))"
    flat = "list_sort(list_transform(map_entries({g}), lambda e: struct_pack(k := e.key, c := e.value.cand)))"
    same = lambda a, b: f"({flat.format(g=a)} = {flat.format(g=b)})"
    total = lambda g: f"coalesce(list_sum(list_transform(map_values({g}), lambda x: x.delta)), 0)::BIGINT"
    d: dict[str, str] = {}
    d[f"{out}_state0"] = f"""SELECT sample_id, label, margin, n, count(*) AS n_names, max(queries)::BIGINT AS queries, 0 AS evaluated, FALSE AS flipped,
        MAP {{}}::{genes} AS adv FROM {init} GROUP BY sample_id, label, margin, n"""
    d[f"{out}_members0"] = f"""SELECT sample_id, 0::BIGINT AS member, MAP {{}}::{genes} AS genes FROM {out}_state0
        UNION ALL SELECT sample_id, rank, CASE WHEN cand IS NULL THEN MAP {{}}::{genes} ELSE map_from_entries([struct_pack(k := rank::BIGINT, v := struct_pack(name := name, cand := cand, delta := delta::BIGINT))])::{genes} END FROM {init}"""
    for k in range(1, steps + 1):
        prev_s, prev_m = f"{out}_state{k - 1}", f"{out}_members{k - 1}"
        step = str(k)
        d[f"{out}_drawn{k}"] = f"""SELECT s.*, {draw('s.sample_id', step, "'parent1'")} % (n_names + 1) AS i1, {draw('s.sample_id', step, "'parent2'")} % (n_names + 1) AS i2,
            {draw('s.sample_id', step, "'point'")} % n_names AS point, {draw('s.sample_id', step, "'gene'")} % n_names + 1 AS gene,
            {draw('s.sample_id', step, "'cross'")}::DOUBLE / 4294967296::DOUBLE < {cross} AS crosses FROM {prev_s} s WHERE NOT flipped"""
        d[f"{out}_bred{k}"] = f"""SELECT d.*, a.genes AS g1, b.genes AS g2,
            map_from_entries(list_concat(list_filter(map_entries(b.genes), lambda e: e.key <= d.point), list_filter(map_entries(a.genes), lambda e: e.key > d.point)))::{genes} AS crossed,
            map_from_entries(list_concat(list_filter(map_entries(a.genes), lambda e: e.key <> d.gene), [struct_pack(key := c.rank::BIGINT, value := struct_pack(name := c.name, cand := c.cand, delta := c.delta::BIGINT))]))::{genes} AS mutated
            FROM {out}_drawn{k} d JOIN {prev_m} a ON a.sample_id = d.sample_id AND a.member = d.i1 JOIN {prev_m} b ON b.sample_id = d.sample_id AND b.member = d.i2
            JOIN rows_text c ON c.sample_id = d.sample_id AND c.rank = d.gene AND c.idx = {draw('d.sample_id', step, "'candidate'")} % c.m + 1"""
        d[f"{out}_child{k}"] = f"""SELECT *, {total('genes')} AS change, {flips('label', 'margin + ' + total('genes'))} AS hit FROM (
            SELECT sample_id, label, margin, n, CASE WHEN crosses AND NOT {same('crossed', 'g1')} AND NOT {same('crossed', 'g2')} THEN crossed ELSE mutated END AS genes
            FROM {out}_bred{k} WHERE NOT (crosses AND {same('g1', 'g2')}))"""
        d[f"{out}_worst{k}"] = f"SELECT sample_id, arg_min(member, struct_pack(g := -{total('genes')}, m := member)) AS member, max({total('genes')}) AS change FROM {prev_m} GROUP BY sample_id"
        d[f"{out}_members{k}"] = f"""SELECT m.sample_id, m.member, CASE WHEN u.sample_id IS NOT NULL THEN u.genes ELSE m.genes END AS genes FROM {prev_m} m
            LEFT JOIN (SELECT c.sample_id, c.genes, w.member FROM {out}_child{k} c JOIN {out}_worst{k} w ON c.sample_id = w.sample_id WHERE NOT c.hit AND c.change < w.change) u
            ON u.sample_id = m.sample_id AND u.member = m.member"""
        d[f"{out}_state{k}"] = f"""SELECT s.sample_id, s.label, s.margin, s.n, s.n_names, s.queries + (c.hit IS NOT NULL)::BIGINT AS queries, s.evaluated + (c.hit IS NOT NULL)::INT AS evaluated,
            s.flipped OR coalesce(c.hit, FALSE) AS flipped, CASE WHEN c.hit THEN c.genes ELSE s.adv END AS adv FROM {prev_s} s LEFT JOIN {out}_child{k} c ON c.sample_id = s.sample_id"""
    d[f"{out}_outcome"] = f"""SELECT sample_id, evaluated > 0 AS is_attack, flipped AS is_success, queries AS query_time,
        map_from_entries(list_transform(map_values(adv), lambda g: struct_pack(k := g.name, v := g.cand))) AS replaced FROM {out}_state{steps}"""
    return d


CTES |= {k: v for k, v in _greedy("ga_first", "rows_text", 100, "0::BIGINT").items() if k.endswith(("before", "past", "budget", "best"))}
CTES["ga_init"] = """SELECT b.sample_id, b.label, b.margin, b.n, b.rank, b.name, CASE WHEN g.delta < 0 THEN g.cand END AS cand, least(g.delta, 0) AS delta,
    b.used + b.evaluated AS queries FROM ga_first_budget b JOIN ga_first_best g ON b.sample_id = g.sample_id AND b.name = g.name WHERE b.idx = 1"""
CTES["seed_init"] = """SELECT r.sample_id, r.label, r.margin, r.n, r.rank, r.name, c.cand, c.delta, 0::BIGINT AS queries
    FROM (SELECT r.*, o.replaced[r.name] AS to_name FROM rows_text r JOIN half_outcome o ON o.sample_id = r.sample_id AND NOT o.is_success WHERE r.idx = 1) r
    LEFT JOIN rows_text c ON c.sample_id = r.sample_id AND c.name = r.name AND c.cand = r.to_name"""
CTES |= _genetic("ga", "ga_init", 5, "0.7::DOUBLE")
CTES |= _genetic("cross", "ga_init", 1, "1.0::DOUBLE")
CTES |= _genetic("mut", "ga_init", 1, "0.0::DOUBLE")
CTES |= _genetic("seeded", "seed_init", 5, "0.7::DOUBLE")
CTES["cascade_outcome"] = """SELECT sample_id, is_attack, is_success, query_time, replaced FROM half_outcome WHERE is_success
    UNION ALL SELECT s.sample_id, s.is_attack, s.is_success, s.query_time + h.query_time, s.replaced FROM seeded_outcome s JOIN half_outcome h ON h.sample_id = s.sample_id"""

ATTACK_OUTCOMES = [
    ("greedy", "greedy_outcome", "space"),
    ("ga", "ga_outcome", "space"),
    ("alert", "cascade_outcome", "space"),
    ("codefooler", "fooler_outcome", "near_space"),
    ("codeattack", "free_outcome", "space"),
    ("mhm", "mhm_outcome", "space"),
]
CTES["matrix"] = " UNION ALL ".join(f"SELECT * FROM ({result(outcome, name, space)})" for name, outcome, space in ATTACK_OUTCOMES)


def query(body: str) -> str:
    """``body`` with the expressions it needs, in dependency order."""
    order: list[str] = []

    def need(text: str, own: str | None = None) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+[0-9]*\b", re.sub(r"'(?:[^']|'')*'", "''", text))):
            if word in CTES and word != own and word not in order:
                need(CTES[word], word)
                order.append(word)

    need(body)
    if not order:
        return body
    parts = [f"{name} AS ({CTES[name]})" if name in RECURSIVE else f"{name} AS MATERIALIZED ({CTES[name]})" for name in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
