"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The kinds once more, as RE2 has them: (kind, pattern, group of the value, group before the match or none, least length, base).
_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (
    ("assign", _ASSIGN, 2, 0, 6, True),
    ("access", "AKIA[A-Z0-9]+", 0, 0, 20, True),
    ("hex", "[0-9a-f]{24,}", 0, 0, 24, True),
    ("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\n\r ]{16,}", 0, 0, 44, False),
    ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 2, 1, 29, False),
    ("vendor", "(?:ghp_|gho_|ghs_|sk_live_|rk_live_|xoxb-|xoxp-|AIza)[A-Za-z0-9_-]{16,}", 0, 0, 20, False),
    ("blob", "[A-Za-z0-9+/_-]{32,}", 0, 0, 32, False),
)


def _secrets() -> str:
    """Matches per kind by explode; ownership by distinct counts; overlaps by comparing all spans of a text."""
    parts = []
    for k, (kind, pattern, group, before, least, base) in enumerate(_KINDS):
        p = _quoted(pattern)
        mixed = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if kind == "blob" else ""
        pre = f"length(regexp_extract(m, {p}, {before}))" if before else "0"
        parts.append(
            f"""SELECT doc_id, source, t, {k} AS k, '{kind}' AS kind, e - length(m) + {pre} AS b, e, sha256(v) AS secret FROM (
              SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (
                SELECT doc_id, source, t, i, ms[i] AS m, vs[i] AS v, gs[i] AS g FROM (
                  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
                    SELECT doc_id, source, t, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p})))))
            WHERE length(v) >= {least}{mixed}"""
        )
    n_base = sum(1 for *_, b in _KINDS if b)
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    c AS ({' UNION ALL '.join(parts)}),
    o AS (SELECT secret, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT t) AS repos FROM c GROUP BY secret),
    j AS (SELECT c.*, owners = 1 OR (owners <= 2 AND repos <= 8) AS live FROM c JOIN o USING (secret)),
    s AS (SELECT * FROM j WHERE k < {n_base} OR (live AND NOT EXISTS (SELECT 1 FROM j x WHERE x.doc_id = j.doc_id AND x.k < {n_base} AND x.b < j.e AND j.b < x.e)))
    SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < {n_base}), '')) AS base_sha256,
      coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k IS NOT NULL), '') AS spans,
      count(*) FILTER (live) AS n_live
    FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


# The rules of the url query, once more.
_RULES = "('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')"


def _urls() -> str:
    lower = _LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    return f"""
    WITH rules(verdict, rh, rp) AS (VALUES {_RULES}),
    u AS (SELECT page_id, {lower} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    f AS (SELECT page_id, arg_max(rh || rp, (length(rh) + length(rp)) * 1000 + length(rh)) AS rule, arg_max(verdict, (length(rh) + length(rp)) * 1000 + length(rh)) AS verdict
      FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)"""


def _exact() -> str:
    return f"""
    WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def _chat() -> str:
    """Conversations as running texts; every prefix is compared as text."""
    cell = "coalesce(len(role) || 'r' || role, 'n') || coalesce(len(text) || 't' || text, 'n')"
    safe = lambda c: f"replace(replace({c}, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"
    shown = f"'<|im_start|>' || coalesce({safe('role')}, 'user') || chr(10) || coalesce({safe('text')}, '') || '<|im_end|>' || chr(10)"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST"
    return f"""
    WITH t AS (SELECT *, row_number() OVER w AS pos, string_agg({cell}, '') OVER (PARTITION BY conv_id {order} ROWS UNBOUNDED PRECEDING) AS upto
      FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) WINDOW w AS (PARTITION BY conv_id {order})),
    w AS (SELECT conv_id, max(pos) AS n_turns, arg_max(upto, pos) AS whole FROM t GROUP BY conv_id),
    p AS (SELECT DISTINCT t.pos, t.upto FROM t JOIN w USING (conv_id) WHERE t.pos < w.n_turns),
    k AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = w.n_turns AND p.upto = w.whole) GROUP BY n_turns, whole)
    SELECT t.conv_id, (t.pos - 1) // 256 AS part, k.n_turns, k.copies, string_agg({shown}, '' ORDER BY t.pos) AS text FROM t JOIN k USING (conv_id) GROUP BY ALL"""


# CRC-32 bit by bit; trees by recursion, a level at a time; a proof's steps from the level's other nodes.
_MERKLE = """WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda r, i: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS crc FROM documents),
leaves AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, sha256(concat(head, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), tail)) AS leaf,
    CASE WHEN coalesce(crc % 7 = 0, false) THEN sha256(concat(head, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-'), tail)) END AS other FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, level + 1, idx, n, digest FROM (SELECT tree, level, idx // 2 AS idx, (max(n) + 1) // 2 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM low WHERE n > 1 GROUP BY tree, level, idx // 2)),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, rank AS idx, n, subroot AS digest FROM subroots
    UNION ALL SELECT level + 1, idx, n, digest FROM (SELECT level, idx // 2 AS idx, (max(n) + 1) // 2 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM high WHERE n > 1 GROUP BY level, idx // 2)),
steps AS (SELECT p.tree, p.idx, l.level, (p.idx >> l.level) % 2 = 1 AS on_left, s.digest AS sib
      FROM placed p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) l USING (tree) LEFT JOIN low s ON s.tree = p.tree AND s.level = l.level AND s.idx = xor(p.idx >> l.level, 1)
    UNION ALL SELECT p.tree, p.idx, 100 + l.level, (r.rank >> l.level) % 2 = 1, s.digest
      FROM placed p JOIN subroots r USING (tree) JOIN (SELECT DISTINCT level FROM high WHERE n > 1) l ON true LEFT JOIN high s ON s.level = l.level AND s.idx = xor(r.rank >> l.level, 1)),
proofs AS (SELECT tree, idx, list(CASE WHEN on_left THEN 'L' ELSE 'R' END || coalesce(sib, '') ORDER BY level) AS proof FROM steps GROUP BY ALL),
folds AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE n = 1) AS root, coalesce(proof, []) AS proof,
    list_reduce(list_prepend(coalesce(other, leaf), coalesce(proof, [])), lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root
    FROM placed JOIN subroots USING (tree) LEFT JOIN proofs USING (tree, idx))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds"""


ORACLES = {"op2_secrets": _secrets(), "op4_urls": _urls(), "op8_exact_dedup": _exact(), "op10_chat": _chat(), "op13_merkle": _MERKLE}
