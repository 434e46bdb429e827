"""SQL of the conversation trie and the Merkle manifest, for an engine with recursive queries, SHA-256 and lists."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, by the bits of the reflected polynomial 0xEDB88320."""
    byte = "list_reduce([xor(c, b)] || [0,0,0,0,0,0,0,0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)"
    return f"xor(list_reduce([4294967295]::UBIGINT[] || {codes}, lambda c, b: {byte}), 4294967295)"


def _field(value: str) -> str:
    text = f"({value})::VARCHAR"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, source: str) -> str:
    """CTEs: all nodes of the trees over ``source (g, pos, digest)``, and the path of each leaf."""
    return f"""
        {name}(g, lvl, pos, digest, n) AS (
            SELECT g, 0, pos, digest, count(*) OVER (PARTITION BY g) FROM {source}
            UNION ALL
            SELECT g, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
            FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
        {name}_path AS (
            SELECT l.g, l.pos, list(coalesce(CASE WHEN (l.pos >> h.lvl) & 1 = 1 THEN 'L' ELSE 'R' END || s.digest, '') ORDER BY h.lvl) AS path
            FROM {source} l JOIN (SELECT DISTINCT g, lvl FROM {name} WHERE n > 1) h ON h.g = l.g
            LEFT JOIN {name} s ON s.g = l.g AND s.lvl = h.lvl AND s.pos = xor(l.pos >> h.lvl, 1)
            GROUP BY l.g, l.pos)"""


MERKLE = f"""
    WITH RECURSIVE
        leaf AS (SELECT coalesce('=' || lang, '') AS g, doc_id, {_leaf("n_chars")} AS digest,
            CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaf),
        {_tree("low", "leaves")},
        subroots AS (SELECT 'all' AS g, g AS lang, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM low WHERE n = 1),
        {_tree("up", "subroots")},
        whole AS (SELECT l.*, s.digest AS subroot, (SELECT digest FROM up WHERE n = 1) AS root,
            list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
            FROM leaves l JOIN subroots s ON s.lang = l.g LEFT JOIN low_path p ON p.g = l.g AND p.pos = l.pos
            LEFT JOIN up_path q ON q.pos = s.pos),
        folded AS (SELECT *, list_reduce([coalesce(changed, digest)] || path, lambda a, s: sha256(
            CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM whole)
    SELECT doc_id, digest AS leaf, subroot, root, sha256(list_reduce([''] || path, lambda a, s: a || s[2:])) AS proof_sha256,
        folded_root, folded_root = root AS verified FROM folded"""


_WORDS = "len(regexp_extract_all(coalesce({}, ''), '[^ \t\n\x0b\f\r]+'))"
TRIE = f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {crc32("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS first FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.first AND t.pos <= c.h
            UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
        u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, {_WORDS.format("text")} AS words,
            sha256(octet_length(encode(role)) || ':' || role || text) AS turn FROM r),
        p AS (SELECT conv_id, depth, words, string_agg(turn, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM u
            UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY prefix, depth),
        ends AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
            FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) m USING (conv_id, depth) GROUP BY prefix),
        kids AS (SELECT left(prefix, -64) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (prefix)),
        sub AS (SELECT p.prefix, sum((f.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens
            FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.prefix)
    SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
        sha256(coalesce(ids, '')) AS ends_sha256
    FROM f JOIN sub USING (prefix) LEFT JOIN ends USING (prefix) LEFT JOIN f AS up ON f.depth > 0 AND up.prefix = left(f.prefix, -64)"""
