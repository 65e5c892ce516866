"""DuckDB SQL of the Merkle manifest: the levels written out one after the other."""

#: Levels of the SQL: 3 to this power rows in a source at most.
LEVELS = 14


def _part(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(map(_part, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs: ``name``_0.. hold (tree, p, d, n) of each level, ``name``_root the tops, ``name``_path siblings of p = leaf."""
    out = [f"{name}_0 AS ({leaves})"]
    for i in range(1, LEVELS + 1):
        out.append(
            f"{name}_{i} AS (SELECT tree, p // 3 AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, (any_value(n) + 2) // 3 AS n"
            f" FROM {name}_{i - 1} WHERE n > 1 GROUP BY tree, p // 3)"
        )
    tops = " UNION ALL ".join(f"SELECT tree, d FROM {name}_{i} WHERE n = 1" for i in range(LEVELS + 1))
    out.append(f"{name}_root AS ({tops})")
    steps = " UNION ALL ".join(
        f"SELECT f.tree, f.p AS leaf, {i} AS level, coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p < f.p // {3**i}), '') AS l,"
        f" coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p > f.p // {3**i}), '') AS r"
        f" FROM {name}_0 f JOIN {name}_{i} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.p // 3 = f.p // {3 ** (i + 1)}"
        f" WHERE s.n > 1 GROUP BY f.tree, f.p"
        for i in range(LEVELS)
    )
    out.append(f"{name}_steps AS ({steps})")
    out.append(
        f"{name}_path AS (SELECT tree, leaf, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM {name}_steps GROUP BY tree, leaf)"
    )
    return ",\n".join(out)


def _crc_odd() -> str:
    """Whether 2 divides the checksum of the decimal id: the last bit of its register before the final inversion."""
    step = (
        "list_reduce(list_prepend(4294967295::BIGINT, range(length(doc_id::VARCHAR)::BIGINT)), lambda c, i: "
        "list_reduce(list_prepend(xor(c, ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::BIGINT), range(8::BIGINT)), lambda x, j:"
        " xor(x >> 1, (x & 1) * 3988292384::BIGINT)))"
    )
    return f"({step}) % 2 = 1"


MERKLE_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, {_row('text')} AS leaf,
         CASE WHEN {_crc_odd()} THEN {_row("replace(text, chr(10), '')")} ELSE {_row('text')} END AS found
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves
),
{_tree("t", "SELECT source AS tree, p, leaf AS d, n FROM placed")},
{_tree("s", "SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p, d, count(*) OVER () AS n FROM t_root")},
places AS (SELECT tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, d AS subroot FROM t_root),
whole AS (
  SELECT q.doc_id, q.leaf, q.found, o.subroot, (SELECT d FROM s_root) AS root,
         list_concat(coalesce(t.path, []), coalesce(u.path, [])) AS path
  FROM placed q JOIN places o ON o.tree IS NOT DISTINCT FROM q.source
  LEFT JOIN t_path t ON t.tree IS NOT DISTINCT FROM q.source AND t.leaf = q.p
  LEFT JOIN s_path u ON u.leaf = o.place
),
folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256,
         list_reduce(list_prepend(found, list_transform(path, lambda x: x.l || '/' || x.r)),
                     lambda acc, x: sha256(split_part(x, '/', 1) || acc || split_part(x, '/', 2))) AS folded_root
  FROM whole
)
SELECT *, folded_root = root AS verified FROM folded
"""
