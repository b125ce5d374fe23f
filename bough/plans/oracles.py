"""The queries of ``bough.plans.queries`` in DuckDB's SQL."""

from __future__ import annotations

_FILES = """
f AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, doc_id, text, strlen(text) AS size,
             sha1('blob ' || strlen(text) || chr(0) || text) AS oid
      FROM documents WHERE text IS NOT NULL)"""
_TREE = (
    _FILES
    + """,
e AS (SELECT path, 'blob' AS kind, oid, size, path AS sort_key FROM f
      UNION ALL
      SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path, 'tree', NULL, NULL, array_to_string(string_split(path, '/')[1:n], '/') || '/'
      FROM f, range(1, 9) t(n) WHERE n < len(string_split(path, '/'))),
t AS (SELECT *, len(string_split(path, '/'))::INT AS depth FROM e)"""
)
_SPEC = r"(regexp_full_match(path, 'src1[^/]/(.*/)?[^/]*1[^/]\.txt') OR path = 'src2' OR starts_with(path, 'src2/') OR regexp_full_match(path, 'src3/de/[^/]*'))"
_LINES = (
    _FILES
    + """,
b AS (SELECT DISTINCT oid, text FROM f WHERE position(chr(0) IN text) = 0 AND size <= 4194304),
s AS (SELECT oid, CASE WHEN text = '' THEN [] WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM b),
l AS (SELECT oid, lines, unnest(lines) AS said, unnest(range(1, len(lines) + 1)) AS line FROM s)"""
)
_SIDES = """
d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS name, text AS t FROM documents WHERE text IS NOT NULL),
base AS (SELECT name AS path, 33188 AS mode, t AS data, sha1('blob ' || strlen(t) || chr(0) || t) AS oid FROM d WHERE doc_id % 7 <> 0),
h0 AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || name ELSE name END AS path, CASE WHEN doc_id % 13 = 0 THEN 40960 ELSE 33188 END AS mode,
              CASE WHEN doc_id % 3 = 0 THEN t || chr(10) || 'appended line' ELSE t END AS data FROM d WHERE doc_id % 5 <> 0),
head AS (SELECT *, sha1('blob ' || strlen(data) || chr(0) || data) AS oid FROM h0),
c AS (SELECT CASE WHEN base.path IS NULL THEN 'added' WHEN head.path IS NULL THEN 'deleted' WHEN base.mode <> head.mode THEN 'type_changed' ELSE 'modified' END AS status,
             base.path AS old_path, head.path AS new_path, base.oid AS old_oid, head.oid AS new_oid, base.mode AS old_mode, head.mode AS new_mode, base.data AS old, head.data AS new
      FROM base FULL JOIN head ON base.path = head.path
      WHERE base.oid IS DISTINCT FROM head.oid OR base.mode IS DISTINCT FROM head.mode)"""
_COUNT = "(len(x) - len(replace(x, chr(10), '')) + (x <> '' AND NOT suffix(x, chr(10)))::INT)"
_lines = lambda column: _COUNT.replace("x,", column + ",").replace("(x)", f"({column})").replace("(x <>", f"({column} <>").replace("suffix(x", f"suffix({column}")
_EDGES = """
e AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent, 0 AS idx FROM orders WHERE o_orderkey > 0
      UNION ALL SELECT o_orderkey, o_orderkey // 3, 1 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 2 = 0 AND o_orderkey // 3 <> o_orderkey // 2)"""


_LAST = "(SELECT max(o_orderkey) FROM orders)"


def _reach(name: str, start: object, edges: str = "e") -> str:
    return f"{name}(oid) AS (SELECT ({start})::BIGINT UNION SELECT parent FROM {name} JOIN {edges} ON child = oid)"


_REFS = """
fi AS (SELECT n_regionkey, min(n_name) AS first FROM nation GROUP BY 1),
r AS (SELECT 'refs/heads/' || n_name AS name, 'direct' AS kind, (n_nationkey * 37)::BIGINT AS oid, NULL::VARCHAR AS symbolic_target FROM nation
      UNION ALL SELECT 'refs/remotes/' || r_name, 'symbolic', NULL, 'refs/heads/' || first FROM region JOIN fi ON r_regionkey = n_regionkey
      UNION ALL SELECT 'HEAD', 'symbolic', NULL, 'refs/remotes/' || min(r_name) FROM region HAVING count(*) > 0)"""
_VERSIONS = """
v AS (SELECT conv_id AS path, turn AS version, regexp_replace(coalesce(text, ''), chr(10), ' ', 'g') AS line FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ver AS (SELECT DISTINCT path, version FROM v),
bl AS (SELECT ver.path, ver.version, row_number() OVER (PARTITION BY ver.path, ver.version ORDER BY v.version) AS line_no, v.version AS origin
       FROM ver JOIN v ON v.path = ver.path AND v.version <= ver.version)"""


def _log(reach: str, where: str = "true") -> str:
    return f"SELECT oid, oid AS time, (row_number() OVER (ORDER BY oid DESC) - 1)::BIGINT AS ordinal FROM {reach} WHERE {where}"


_NAME = "('refs/' || regexp_replace(url, '^https?://', ''))"
ORACLES: dict[str, str] = {
    "tree_list_recursive": f"WITH {_TREE} SELECT path, depth, kind, sort_key, oid FROM t",
    "tree_list_depth": f"WITH {_TREE} SELECT path, depth, kind FROM t WHERE depth <= 2 AND kind = 'tree'",
    "tree_scope": f"WITH {_TREE} SELECT path, (depth - 1)::INT AS depth, kind FROM t WHERE starts_with(path, 'src1/') AND depth = 2",
    "tree_pathspec": f"WITH {_TREE} SELECT path, oid FROM t WHERE kind = 'blob' AND {_SPEC}",
    "tree_sizes": f"WITH {_FILES} SELECT path, size FROM f",
    "tree_page_keyset": f"WITH {_TREE} SELECT path, kind FROM t WHERE sort_key > 'src12/' ORDER BY sort_key LIMIT 50",
    "read_file_slice": f"""WITH {_FILES}, s AS (SELECT path, text, CASE WHEN text = '' THEN [] WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM f)
        SELECT path, CASE WHEN len(l) < 2 THEN '' WHEN len(l) <= 4 AND NOT suffix(text, chr(10)) THEN array_to_string(l[2:4], chr(10)) ELSE array_to_string(l[2:4], chr(10)) || chr(10) END AS data,
               CASE WHEN len(l) >= 2 THEN 2 END::INT AS start_line, CASE WHEN len(l) >= 2 THEN least(4, len(l)) END::INT AS end_line, len(l)::BIGINT AS total_lines, false AS truncated, 'text' AS kind FROM s""",
    "read_file_capped": f"""WITH {_FILES}, k AS (SELECT path, text, size, encode(text)[1:300] AS cut FROM f),
        c AS (SELECT path, size, text, (SELECT max(i) FROM range(1, 301) r(i) WHERE cut[i:i] = '\\x0A'::BLOB) AS last FROM k)
        SELECT path, (CASE WHEN size <= 300 THEN size WHEN last IS NULL THEN 300 ELSE last END)::INT AS bytes, (CASE WHEN size <= 300 THEN {_lines("text")} END)::BIGINT AS total_lines, size > 300 AS truncated FROM c""",
    "object_ids": f"WITH {_FILES} SELECT path, oid, size FROM f",
    "object_headers": f"WITH {_FILES} SELECT 'blob' AS kind, count(DISTINCT oid) AS objects, sum(size)::BIGINT AS bytes FROM f",
    "read_many": f"""WITH {_FILES}, o AS (SELECT DISTINCT oid, size FROM f)
        SELECT oid, true AS found, 'blob' AS kind, size FROM o UNION ALL SELECT DISTINCT sha1(o_orderkey::VARCHAR), false, NULL, NULL FROM orders""",
    "verify_objects": f"""WITH {_FILES}, v AS (SELECT oid, CASE WHEN size % 17 = 0 THEN text || '!' ELSE text END AS t FROM f)
        SELECT sha1('blob ' || strlen(t) || chr(0) || t) = oid AS intact, count(*) AS objects FROM v GROUP BY 1""",
    "layered_first_hit": """WITH l AS (SELECT doc_id AS oid, i AS layer, 'layer ' || i || ': ' || source AS payload FROM documents, range(3) t(i) WHERE doc_id % 3 = i OR doc_id % 10 = 0)
        SELECT oid, arg_min(payload, layer) AS payload, min(layer)::INT AS layer FROM l WHERE oid IS NOT NULL GROUP BY oid""",
    "tree_expand": f"WITH {_TREE} SELECT path, depth, kind, sort_key, oid FROM t",
    "search_page": f"""WITH {_LINES}, h AS (SELECT oid, line FROM l WHERE contains(said, 'the')), r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY line) AS ordinal, line FROM f JOIN h ON f.oid = h.oid)
        SELECT path, ordinal, line FROM r WHERE path > 'src5' OR (path = 'src5' AND ordinal > 1) ORDER BY path, ordinal LIMIT 200""",
    "search_oversize": f"WITH {_FILES} SELECT path, size FROM f WHERE size > 2000",
    "search_literal": f"""WITH {_LINES}, h AS (SELECT oid, line, strlen(said[:position('the' IN said) - 1]) AS col FROM l WHERE contains(said, 'the'))
        SELECT path, f.oid, row_number() OVER (PARTITION BY path ORDER BY line) AS ordinal, line, col AS column FROM f JOIN h ON f.oid = h.oid""",
    "search_icase": f"""WITH {_LINES}, h AS (SELECT oid, line, said, regexp_extract(said, '(?i)^(.*?)[t][h][e]', 1) AS before FROM l WHERE regexp_matches(said, '[tT][hH][eE]'))
        SELECT path, line, strlen(regexp_extract(said, '^(.*?)[tT][hH][eE]', 1)) AS column FROM f JOIN h ON f.oid = h.oid""",
    "search_regex": f"""WITH {_LINES}, h AS (SELECT oid, line, strlen(regexp_extract(said, '^(.*?)([0-9]+[a-z]|[A-Z]{{3,}})', 1)) AS col FROM l WHERE regexp_matches(said, '[0-9]+[a-z]|[A-Z]{{3,}}'))
        SELECT path, line, col AS column FROM f JOIN h ON f.oid = h.oid""",
    "search_pathspec": f"WITH {_LINES} SELECT path, line, strlen(said[:position('the' IN said) - 1]) AS column FROM f JOIN l ON f.oid = l.oid WHERE contains(said, 'the') AND {_SPEC}",
    "search_context": f"""WITH {_LINES} SELECT path, line, CASE WHEN line > 1 THEN lines[line - 1] || '|' ELSE '' END AS context_before, CASE WHEN line < len(lines) THEN lines[line + 1] || '|' ELSE '' END AS context_after
        FROM f JOIN l ON f.oid = l.oid WHERE contains(said, 'license') AND coalesce(strlen(lines[line - 1]), 0) <= 1024 AND coalesce(strlen(lines[line + 1]), 0) <= 1024""",
    "search_submatches": f"""WITH {_LINES}, p AS (SELECT oid, line, string_split(said, 'the') AS x FROM l WHERE contains(said, 'the')),
        o AS (SELECT oid, line, len(x) - 1 AS n, list_transform(range(1, len(x)), lambda i: strlen(array_to_string(x[1:i], 'the'))) AS starts FROM p),
        k AS (SELECT oid, line, n, list_filter(starts, lambda s: s < 1024)[1:256] AS s FROM o)
        SELECT path, line, len(s) AS hits, coalesce(list_sum(s), 0)::BIGINT AS starts, n > len(s) AS submatches_truncated FROM f JOIN k ON f.oid = k.oid""",
    "search_dedup_stats": f"""WITH {_FILES}, x AS (SELECT oid, position(chr(0) IN text) > 0 AS nul, size <= 4194304 AS fits FROM f)
        SELECT count(*) AS files, count(DISTINCT oid) FILTER (fits AND NOT nul) AS blobs_scanned, count(*) FILTER (fits AND NOT nul) - count(DISTINCT oid) FILTER (fits AND NOT nul) AS blobs_deduped,
               count(*) FILTER (fits AND nul) AS binary_skipped, count(*) FILTER (NOT fits) AS oversize_skipped FROM x""",
    "diff_summary": f"WITH {_SIDES} SELECT status, old_path, new_path, old_oid, new_oid FROM c",
    "diff_pathspec": f"WITH {_SIDES} SELECT status, count(*) AS paths FROM c WHERE split_part(coalesce(old_path, new_path), '/', 1) IN ('src1', 'moved') GROUP BY status",
    "diff_exact_renames": f"""WITH {_SIDES}, a AS (SELECT old_path, old_oid, row_number() OVER (PARTITION BY old_oid ORDER BY old_path) AS n, old_mode FROM c WHERE status = 'deleted'),
        b AS (SELECT new_path, new_oid, row_number() OVER (PARTITION BY new_oid ORDER BY new_path) AS n, new_mode FROM c WHERE status = 'added')
        SELECT old_path, new_path, old_oid, 100 AS similarity FROM a JOIN b ON old_oid = new_oid AND a.n = b.n AND old_mode = new_mode""",
    "diff_patch": f"""WITH {_SIDES}, m AS (SELECT new_path, string_split(old, chr(10)) AS l, old = '' OR suffix(old, chr(10)) AS ended FROM c WHERE status = 'modified' AND position(chr(0) IN new) = 0),
        p AS (SELECT new_path, len(l) - 1 AS old_start, 0 AS old_lines, len(l) AS new_start, unnest([0, 1]) AS "at", 'addition' AS origin, unnest(['', 'appended line']) AS content, NULL::BIGINT AS old_line, unnest([len(l), len(l) + 1]) AS new_line, unnest([false, true]) AS no_newline FROM m WHERE ended
              UNION ALL SELECT new_path, len(l), 1, len(l), unnest([0, 1, 2]), unnest(['deletion', 'addition', 'addition']), unnest([l[-1], l[-1], 'appended line']), unnest([len(l), NULL, NULL]), unnest([NULL, len(l), len(l) + 1]), unnest([true, false, true]) FROM m WHERE NOT ended)
        SELECT new_path, 0::BIGINT AS hunk, old_start, old_lines, new_start, 2::BIGINT AS new_lines, "at", origin, content, old_line, new_line, no_newline FROM p""",
    "diff_line_stats": f"""WITH {_SIDES} SELECT status, old_path, new_path, (CASE status WHEN 'added' THEN {_lines("new")} WHEN 'deleted' THEN 0 WHEN 'modified' THEN CASE WHEN old = '' OR suffix(old, chr(10)) THEN 1 + (old = '' OR suffix(old, chr(10)))::INT ELSE 2 END END)::BIGINT AS additions,
        (CASE status WHEN 'added' THEN 0 WHEN 'deleted' THEN {_lines("old")} ELSE CASE WHEN old = '' OR suffix(old, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS deletions, false AS binary FROM c WHERE status IN ('modified', 'added', 'deleted')""",
    "ancestor_shallow": f"""WITH RECURSIVE {_EDGES}, a(oid) AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT parent FROM e) UNION SELECT parent FROM a JOIN e ON child = oid WHERE child % 10 <> 0)
        SELECT oid FROM a""",
    "ancestor_set": f"WITH RECURSIVE {_EDGES}, {_reach('a', '(SELECT max(o_orderkey) FROM orders)')} SELECT oid FROM a",
    "is_ancestor": f"""WITH RECURSIVE {_EDGES}, m AS (SELECT max(o_orderkey) AS z FROM orders), q(ancestor, descendant) AS (SELECT unnest([0, z, 3, z, z // 4, z // 5]), unnest([z, z, z, 3, z, z]) FROM m),
        a(s, oid) AS (SELECT DISTINCT descendant, descendant FROM q UNION SELECT s, parent FROM a JOIN e ON child = oid)
        SELECT ancestor, descendant, EXISTS (SELECT 1 FROM a WHERE s = descendant AND oid = ancestor) AS answer FROM q""",
    "merge_bases": f"""WITH RECURSIVE {_EDGES}, {_reach("a", _LAST)}, {_reach("b", _LAST + " - 4")}, c AS (SELECT oid FROM a INTERSECT SELECT oid FROM b)
        SELECT oid, row_number() OVER (ORDER BY oid DESC)::INT AS ordinal FROM c WHERE oid NOT IN (SELECT parent FROM e JOIN c ON child = oid)""",
    "commit_child_counts": f"WITH {_EDGES} SELECT parent AS oid, count(*) AS children FROM e GROUP BY parent",
    "topo_levels": f"WITH RECURSIVE {_EDGES}, w(oid, level) AS (SELECT o_orderkey::BIGINT, 0 FROM orders WHERE o_orderkey NOT IN (SELECT parent FROM e) UNION SELECT parent, level + 1 FROM w JOIN e ON child = oid) SELECT oid, max(level)::INT AS level FROM w GROUP BY oid",
    "log_chronological": f"WITH RECURSIVE {_EDGES}, {_reach('a', _LAST)} {_log('a')}",
    "log_monotone": f"WITH RECURSIVE {_EDGES}, {_reach('a', _LAST)} {_log('a')}",
    "log_since_until": f"WITH RECURSIVE {_EDGES}, y AS (SELECT * FROM e WHERE child >= 20), {_reach('a', _LAST, 'y')} {_log('a', 'oid BETWEEN 20 AND 700')}",
    "log_first_parent": f"WITH RECURSIVE {_EDGES}, y AS (SELECT * FROM e WHERE idx = 0), {_reach('a', _LAST, 'y')} {_log('a')}",
    "path_history_first_parent": """WITH k AS (SELECT o_orderkey AS commit, j FROM orders, range(4) t(j)),
        s AS (SELECT commit, j, 'file-' || j AS path, (commit // (j + 2) % 7)::VARCHAR AS oid FROM k WHERE commit % (j + 3) <> 0),
        x AS (SELECT k.commit, k.j, n.oid AS now, o.oid AS was FROM k LEFT JOIN s n ON n.commit = k.commit AND n.j = k.j LEFT JOIN s o ON k.commit > 0 AND o.commit = k.commit // 2 AND o.j = k.j)
        SELECT commit, 'file-' || j AS path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'modified' END AS action, now AS oid FROM x WHERE now IS DISTINCT FROM was""",
    "blame_append_only": f"WITH {_VERSIONS} SELECT path, version, line_no, origin, line_no AS origin_line FROM bl",
    "blame_hunks": f"WITH {_VERSIONS} SELECT path, version, origin, line_no AS final_start, line_no AS final_end, line_no AS original_start FROM bl",
    "blame_boundary": f"""WITH {_VERSIONS}, vs AS (SELECT DISTINCT path, version FROM bl), p AS (SELECT DISTINCT version FROM (SELECT version, lag(version) OVER (PARTITION BY path ORDER BY version) AS before FROM vs) WHERE before IS NOT NULL)
        SELECT path, version, origin, origin NOT IN (SELECT version FROM p) AS boundary FROM bl""",
    "refs_peel": """WITH RECURSIVE k AS (SELECT c_custkey AS o, CASE WHEN c_custkey % 2 = 0 THEN 'tag' WHEN c_custkey % 5 = 0 THEN 'tree' ELSE 'commit' END AS kind FROM customer WHERE c_custkey > 0),
        t AS (SELECT o, CASE WHEN o % 11 = 0 THEN -o ELSE o // 2 END AS target, CASE WHEN o % 7 = 0 THEN 'blob' WHEN o // 2 % 2 = 0 THEN 'tag' WHEN o // 2 % 5 = 0 THEN 'tree' ELSE 'commit' END AS claim FROM k WHERE o % 2 = 0),
        w AS (SELECT o AS start, o AS oid, NULL::VARCHAR AS claimed FROM k UNION ALL SELECT start, target, claim FROM w JOIN k ON k.o = w.oid JOIN t ON t.o = w.oid WHERE coalesce(claimed, 'tag') = 'tag')
        SELECT start, oid, kind, CASE WHEN k.o IS NULL THEN 'not_found' WHEN claimed <> kind THEN 'kind_mismatch' WHEN kind = 'commit' THEN 'resolved' ELSE 'wrong_kind' END AS status
        FROM w LEFT JOIN k ON k.o = oid WHERE k.o IS NULL OR kind <> 'tag' OR claimed <> kind""",
    "refs_list_prefix": f"WITH {_REFS} SELECT name, kind, oid, symbolic_target FROM r WHERE starts_with(name, 'refs/heads/') AND name > 'refs/heads/NATION_15'",
    "refs_resolve": f"""WITH RECURSIVE {_REFS}, w AS (SELECT name, name AS target, 0 AS hops FROM r UNION ALL SELECT w.name, r.symbolic_target, w.hops + 1 FROM w JOIN r ON r.name = w.target WHERE r.kind = 'symbolic')
        SELECT w.name, target, r.oid, hops::INT AS hops, 'resolved' AS status FROM w JOIN r ON r.name = w.target WHERE r.kind = 'direct'""",
    "refs_update": """WITH c AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'refs/tags/' ELSE 'refs/heads/' END || c_custkey AS name, c_custkey AS k, c_custkey // 2 AS half, c_nationkey % 2 = 0 AS force,
               c_custkey % 4 <> 0 AS has, CASE WHEN c_custkey % 5 = 0 THEN c_custkey // 2 WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS new_oid FROM customer),
        x AS (SELECT *, CASE WHEN has THEN half END AS old_oid, has AND EXISTS (SELECT 1 FROM c b WHERE b.k = c.new_oid AND b.half = c.half) AS ahead, k % 9 = 0 AS tag FROM c),
        y AS (SELECT *, CASE WHEN old_oid IS NULL THEN NULL WHEN k % 31 = 0 THEN 'currently_checked_out' WHEN tag AND NOT force THEN 'tag_update' WHEN NOT ahead AND NOT force THEN 'non_fast_forward' END AS reason FROM x WHERE old_oid IS DISTINCT FROM new_oid)
        SELECT name, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN old_oid IS NULL THEN 'created' WHEN ahead AND NOT tag THEN 'fast_forward' ELSE 'forced' END AS action, reason, old_oid, new_oid FROM y""",
    "refs_prune": f"WITH {_REFS} SELECT name FROM r WHERE starts_with(name, 'refs/heads/') AND name LIKE '%2' AND name <> 'refs/heads/NATION_12'",
    "tips_digest": f"""WITH {_REFS}, l AS (SELECT name || ' ' || sha1(oid::VARCHAR) || chr(10) AS line FROM r WHERE kind = 'direct' UNION ALL SELECT 'HEAD -> refs/heads/main' || chr(10))
        SELECT sha256(string_agg(line, '' ORDER BY line)) AS digest FROM l""",
    "submodules_correlate": """WITH s AS (SELECT s_name AS name, 'modules/' || s_nationkey AS path, 'https://' || s_name AS url, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS claim FROM supplier WHERE s_nationkey <= 20),
        g AS (SELECT 'modules/' || n_nationkey AS path, n_name AS oid FROM nation WHERE n_nationkey >= 5)
        SELECT name, coalesce(s.path, g.path) AS path, url, NULL::VARCHAR AS branch, oid AS commit_oid, CASE WHEN s.path IS NULL THEN 'undeclared' WHEN g.path IS NULL THEN 'orphaned' ELSE 'active' END AS status
        FROM s FULL JOIN g ON s.path = g.path AND claim = 1""",
    "binary_probe": "SELECT c_custkey, 7998 + c_custkey % 4 < 8000 AS is_binary, 1::BIGINT AS lines FROM customer",
    "tz_offsets": """WITH z AS (SELECT c_custkey, c_custkey % 27 AS h, c_custkey * 7 % 70 AS m, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS sign FROM customer)
        SELECT c_custkey, CASE sign WHEN 1 THEN '+' ELSE '-' END || lpad(h::VARCHAR, 2, '0') || lpad(m::VARCHAR, 2, '0') AS tz, CASE WHEN h < 24 AND m < 60 THEN sign * (h * 60 + m) END AS minutes FROM z""",
    "lfs_pointers": "SELECT p_partkey, sha256(p_name) AS oid, p_size::BIGINT AS size FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
    "ref_names": f"""SELECT page_id, NOT regexp_matches({_NAME}, '(^|/)\\.|\\.\\.|[\\x00-\\x20\\x7f~^:?*\\[\\\\]|@\\{{|//|/$|\\.$|\\.lock(/|$)') AS valid,
        NOT regexp_matches({_NAME}, '(^|/)\\.{{0,2}}(/|$)') AS is_path FROM pages WHERE url IS NOT NULL""",
    "pack_manifest_missing": "SELECT 'pack-' || sha1(p_partkey::VARCHAR) AS id, p_size::BIGINT AS pack_size, 8::BIGINT AS index_size FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 10 = 0 AND p_size <> 0)",
}
