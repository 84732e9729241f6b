"""Common table expressions of candidates in context: vectors, fills, and composed names."""

from __future__ import annotations

from nameshift.oracles.tables import BLOCK, CTES, PIECE, RECURSIVE, TOP_K, WIDE_K, hash32, lex, q, valid

_votes = ", ".join(f"sum(c * (1 - 2 * ((h{i // 32} >> {i % 32}) & 1)))" for i in range(64))

#: Pairs of small words of a document, joined as names are in programs.
JOINED = "regexp_replace(text, '(\\p{Ll}+) (\\p{Ll}+)', '\\1_\\2', 'g')"


def _vectors(out: str, pairs: str, which: str) -> dict[str, str]:
    """Context vectors of 64 whole numbers from -127 to 127, of the neighbours in ``pairs``."""
    return {
        f"{out}_near": f"""SELECT tok, c, k, {hash32('u')} AS h0, ('0x' || substr(md5(u), 9, 8))::UBIGINT::BIGINT AS h1 FROM (SELECT a AS tok, 'R' || b AS u, c, c AS k FROM {pairs}
            UNION ALL SELECT b, 'L' || a, c, 0 FROM {pairs}) WHERE {which}""",
        f"{out}_votes": f"SELECT tok, sum(k)::BIGINT AS n, [{_votes}]::BIGINT[] AS votes FROM {out}_near GROUP BY tok",
        out: f"""SELECT tok, n, vec, greatest(sqrt(list_dot_product(vec, vec)), 1e-6::DOUBLE) AS norm FROM (
            SELECT tok, n, list_transform(votes, lambda v: sign(v)::BIGINT * ((254 * abs(v) + top) // (2 * top)))::DOUBLE[] AS vec
            FROM (SELECT *, greatest(list_max(list_transform(votes, lambda v: abs(v))), 1) AS top FROM {out}_votes))""",
    }


def _lists(prefix: str, pairs: str, after: str, before: str) -> dict[str, str]:
    return {
        f"{prefix}after_top": f"SELECT * FROM (SELECT a AS key, b AS tok, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM {pairs} WHERE {after}) WHERE r <= {WIDE_K}",
        f"{prefix}before_top": f"SELECT * FROM (SELECT b AS key, a AS tok, c, row_number() OVER (PARTITION BY b ORDER BY c DESC, a) AS r FROM {pairs} WHERE {before}) WHERE r <= {WIDE_K}",
    }


def _model(prefix: str, lexed: str) -> dict[str, str]:
    """Counts of a corpus: of tokens, and of the stream of their pieces (P) with whole tokens (T) at the ends of words."""
    pairs, links = f"{prefix}bigrams", f"{prefix}links"
    parts = lambda c: f"regexp_extract_all({c}, {q(PIECE)})"
    return {
        pairs: f"SELECT a, b, count(*) AS c FROM (SELECT unnest(list_concat([''], tokens)) AS a, unnest(list_concat(tokens, [''])) AS b FROM {lexed}) GROUP BY a, b",
        **_vectors(f"{prefix}words", pairs, "tok <> ''"),
        **_lists(prefix, pairs, "b <> ''", "a <> ''"),
        f"{prefix}piece_words": f"SELECT tok, n, {parts('tok')} AS ps FROM {prefix}words",
        f"{prefix}piece_pairs": f"SELECT p, q, sum(n)::BIGINT AS c FROM (SELECT n, unnest(list_concat([''], ps[:-2])) AS p, unnest(ps) AS q FROM {prefix}piece_words WHERE len(ps) > 0) GROUP BY p, q",
        f"{prefix}piece_totals": f"SELECT p, sum(c)::BIGINT AS t FROM {prefix}piece_pairs GROUP BY p",
        f"{prefix}piece_vocab": f"SELECT count(DISTINCT q) AS v FROM {prefix}piece_pairs",
        f"{prefix}ends": f"SELECT a, b, c, {parts('a')} AS pa, {parts('b')} AS pb FROM {pairs}",
        links: f"""SELECT a, b, sum(c)::BIGINT AS c FROM (
            SELECT 'P' || unnest(ps[:-2]) AS a, 'P' || unnest(ps[2:]) AS b, n AS c FROM {prefix}piece_words WHERE len(ps) > 1
            UNION ALL SELECT 'T' || a, 'P' || pb[1], c FROM {prefix}ends WHERE len(pb) > 0
            UNION ALL SELECT 'P' || pa[-1], 'T' || b, c FROM {prefix}ends WHERE len(pa) > 0) GROUP BY a, b""",
        **_vectors(f"{prefix}pieces", links, "tok LIKE 'P%'"),
        **_lists(f"{prefix}piece_", links, "b LIKE 'P%'", "a LIKE 'P%'"),
    }


def _fills(gaps: str, out: str, top_k: int = TOP_K, model: str = "", pairs: str = "bigrams", words: str = "words") -> dict[str, str]:
    """Fills of the distinct gaps, in order, and in similarity order."""
    return {
        f"{out}_distinct": f"SELECT name, prev, next, count(*) AS n FROM {gaps} GROUP BY name, prev, next",
        f"{out}_fills": f"""SELECT *, row_number() OVER (PARTITION BY name, prev, next ORDER BY score DESC, cand) - 1 AS idx FROM (
            SELECT f.name, f.prev, f.next, f.cand, (round(ln(1 + coalesce(x.c, 0)::DOUBLE) * 1000000)::BIGINT + round(ln(1 + coalesce(y.c, 0)::DOUBLE) * 1000000)::BIGINT) AS score FROM (
              SELECT d.name, d.prev, d.next, t.tok AS cand FROM {out}_distinct d JOIN {model}after_top t ON d.prev = t.key AND t.r <= {top_k}
              UNION
              SELECT d.name, d.prev, d.next, t.tok FROM {out}_distinct d JOIN {model}before_top t ON d.next = t.key AND t.r <= {top_k}) f
            LEFT JOIN {pairs} x ON x.a = f.prev AND x.b = f.cand LEFT JOIN {pairs} y ON y.a = f.cand AND y.b = f.next )""",
        f"{out}_similar": f"""SELECT *, row_number() OVER (PARTITION BY name, prev, next ORDER BY sim DESC, idx) AS place,
            count(*) OVER (PARTITION BY name, prev, next) AS n_fills FROM (
              SELECT f.*, coalesce(list_dot_product(x.vec, y.vec) / (x.norm * y.norm), 0) AS sim FROM {out}_fills f
              LEFT JOIN {words} x ON f.name = x.tok JOIN {words} y ON f.cand = y.tok WHERE f.idx < {top_k})""",
    }


def _several(c: str) -> str:
    return f"len(regexp_extract_all({c}, {q(PIECE)})) > 1"


def _space(out: str, similar: str, kept: str, composed: str) -> dict[str, str]:
    return {
        out: f"""SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY score DESC, cand) AS idx FROM (
            SELECT sample_id, name, cand, max(score) AS score FROM (
              SELECT g.sample_id, g.name, k.cand, k.score FROM gaps g JOIN {similar} k ON g.name = k.name AND g.prev = k.prev AND g.next = k.next
              WHERE NOT ({_several('g.name')}) AND {kept}
              UNION ALL
              SELECT g.sample_id, g.name, c.cand, c.score FROM gaps g JOIN {composed} c ON g.name = c.name AND g.prev = c.prev AND g.next = c.next)
            WHERE {valid('cand')} AND (sample_id, cand) NOT IN (SELECT (sample_id, name) FROM own_names)
            GROUP BY sample_id, name, cand)""",
    }


def _composed(out: str, gaps: str, top_k: int, kept: str, model: str = "") -> dict[str, str]:
    """Names of several pieces: fills of every piece in the stream, columns of them by mean similarity, and a beam over the best columns."""
    gap = "gid, name, prev, next"
    RECURSIVE.add(f"{out}_beam")
    return {
        f"{out}_multi": f"SELECT row_number() OVER (ORDER BY name, prev, next) AS gid, name, prev, next, regexp_extract_all(name, {q(PIECE)}) AS ps FROM (SELECT DISTINCT name, prev, next FROM {gaps} WHERE {_several('name')})",
        f"{out}_slots": f"""SELECT gid, len(ps) AS size, i, 'P' || ps[i] AS piece, CASE WHEN i = 1 THEN 'T' || prev ELSE 'P' || ps[i - 1] END AS l,
            CASE WHEN i = len(ps) THEN 'T' || next ELSE 'P' || ps[i + 1] END AS r FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM {out}_multi)""",
        f"{out}_piece_gaps": f"SELECT piece AS name, l AS prev, r AS next FROM {out}_slots",
        **_fills(f"{out}_piece_gaps", f"{out}_piece", top_k, f"{model}piece_", f"{model}links", f"{model}pieces"),
        f"{out}_cells": f"SELECT s.gid, s.size, s.i, f.idx, substr(f.cand, 2) AS q, f.sim FROM {out}_slots s JOIN {out}_piece_similar f ON f.name = s.piece AND f.prev = s.l AND f.next = s.r",
        f"{out}_sizes": f"SELECT gid, i, size, count(*) AS k FROM {out}_cells GROUP BY gid, i, size",
        f"{out}_widths": f"SELECT gid, unnest(range(max(k))) AS idx FROM {out}_sizes GROUP BY gid, size HAVING count(*) = size",
        f"{out}_grid": f"""SELECT w.gid, w.idx, s.i, s.size, c.q, c.sim FROM {out}_widths w JOIN {out}_sizes s ON s.gid = w.gid
            JOIN {out}_cells c ON c.gid = w.gid AND c.i = s.i AND c.idx = least(w.idx, s.k - 1)""",
        f"{out}_columns": f"SELECT gid, idx, round(sum(sim ORDER BY i) / size, 9) AS sim FROM {out}_grid GROUP BY gid, idx, size",
        f"{out}_top": f"""SELECT gid, idx, place FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY sim DESC, idx) AS place, count(*) OVER (PARTITION BY gid) AS n_fills
            FROM {out}_columns) k WHERE {kept} AND place <= 4""",
        f"{out}_options": f"SELECT c.gid, c.i AS slot, min(t.place) AS r, c.q FROM {out}_grid c JOIN {out}_top t ON t.gid = c.gid AND t.idx = c.idx WHERE c.i <= 12 GROUP BY c.gid, c.i, c.q",
        f"{out}_beam": f"""SELECT gid, 1::BIGINT AS slot, r::BIGINT AS ord, [q] AS parts FROM {out}_options WHERE slot = 1
            UNION ALL
            SELECT b.gid, b.slot + 1, row_number() OVER (PARTITION BY b.gid ORDER BY b.ord, o.r), list_append(b.parts, o.q)
            FROM {out}_beam b JOIN {out}_options o ON o.gid = b.gid AND o.slot = b.slot + 1 WHERE b.ord <= 24""",
        f"{out}_built": f"SELECT b.gid, b.ord - 1 AS cand_no, b.parts FROM {out}_beam b JOIN {out}_multi m ON m.gid = b.gid AND least(len(m.ps), 12) = b.slot WHERE b.ord <= 24",
        f"{out}_nll": f"""SELECT parts, sum(nll)::BIGINT AS nll, -floor(sum(nll)::DOUBLE / count(*))::BIGINT AS score FROM (
            SELECT x.*, round(-ln((coalesce(pp.c, 0)::DOUBLE + 1) / (coalesce(pt.t, 0) + v)::DOUBLE) * 1000000)::BIGINT AS nll FROM (
              SELECT parts, unnest(list_concat([''], parts[:-2])) AS p, unnest(parts) AS q FROM (SELECT DISTINCT parts FROM {out}_built)) x
            LEFT JOIN {model}piece_pairs pp ON x.p = pp.p AND x.q = pp.q LEFT JOIN {model}piece_totals pt ON x.p = pt.p, {model}piece_vocab)
            GROUP BY parts""",
        f"{out}_composed": f"""SELECT {gap}, cand_no, array_to_string(b.parts, '') AS cand, nll, score
            FROM {out}_built b JOIN {out}_nll n ON n.parts = b.parts JOIN {out}_multi m USING (gid)""",
    }


_HALF, _NEAR = "k.place <= floor(k.n_fills / 2)", "k.place <= 50 AND k.sim >= 0.7"

CTES.update(
    {
        "joined_lexed": f"SELECT doc_id AS sample_id, {lex(JOINED)} AS tokens FROM documents",
        "joined_rows": "SELECT sample_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM joined_lexed",
        "joined_gaps": f"""SELECT DISTINCT sample_id, tok AS name, prev, next FROM (
        SELECT sample_id, tok, pos, coalesce(lag(tok) OVER w, '') AS prev, coalesce(lead(tok) OVER w, '') AS next
        FROM joined_rows WINDOW w AS (PARTITION BY sample_id ORDER BY pos)) WHERE pos < {BLOCK} AND {valid('tok')}""",
    }
)
CTES.update(_model("exact_", "doc_lexed"))
CTES.update(_model("joined_", "joined_lexed"))
CTES.update(_fills("gaps", "ctx", TOP_K, "exact_", "exact_bigrams", "exact_words"))
CTES.update(_fills("gaps", "ctxnear", WIDE_K, "exact_", "exact_bigrams", "exact_words"))
CTES.update(_composed("ctxdoc", "gaps", TOP_K, _HALF, "exact_"))
CTES.update(_composed("ctxclose", "gaps", WIDE_K, _NEAR, "exact_"))
CTES.update(_composed("joined", "joined_gaps", TOP_K, _HALF, "joined_"))
CTES.update(_composed("strict", "joined_gaps", TOP_K, "k.place <= 6 AND k.sim >= 0.2", "joined_"))
CTES.update(_space("exact_space", "ctx_similar", _HALF, "ctxdoc_composed"))
CTES.update(_space("exact_near_space", "ctxnear_similar", _NEAR, "ctxclose_composed"))
