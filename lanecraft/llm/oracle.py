"""DuckDB SQL for the operators that SQL can express."""

SQL: dict[str, str] = {}

# integer inner products of every query with every other row
SQL["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# turns in order, their windows and repeats (span 768, history 192), and digests of the plain texts
SQL["op4_chat_format"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), cost AS (
  SELECT *, len(regexp_extract_all(text, '\w+|[^\w\s]')) + 1 AS cost,
         length(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g'))
         + length(regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g')) + 23 AS chars
  FROM rows_
), placed AS (
  SELECT *, (coalesce(sum(cost) OVER w, 0) // 768)::BIGINT AS win, coalesce(sum(cost) OVER w, 0)::BIGINT AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth
  FROM cost
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), used AS (SELECT conv_id, win, max(before + cost) AS fin, max(before + cost) // 768 AS nxt FROM placed GROUP BY conv_id, win),
again AS (
  SELECT p.conv_id, p.chars FROM placed p JOIN used u ON u.conv_id IS NOT DISTINCT FROM p.conv_id AND u.win > p.win
  WHERE p.nth = 0 AND p.role = 'system'
  UNION ALL
  SELECT p.conv_id, p.chars FROM placed p JOIN used o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.win = p.win
    JOIN used u ON u.conv_id IS NOT DISTINCT FROM p.conv_id AND u.win = o.nxt AND u.win > p.win
  WHERE NOT (p.nth = 0 AND p.role = 'system') AND (p.before + p.cost = o.fin OR p.before + 192 >= (p.win + 1) * 768)
), extra AS (SELECT conv_id, sum(chars) AS chars FROM again GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns,
       sha256(string_agg(p.role || chr(10) || p.text || chr(10), '' ORDER BY p.nth)) AS turns_sha256,
       coalesce(sum(length(p.text)) FILTER (WHERE p.role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(p.text, '' ORDER BY p.nth) FILTER (WHERE p.role = 'assistant'), '')) AS loss_sha256,
       (sum(p.chars) + coalesce(any_value(e.chars), 0))::BIGINT AS formatted_chars
FROM placed p LEFT JOIN extra e ON e.conv_id IS NOT DISTINCT FROM p.conv_id
GROUP BY p.conv_id
"""

# all pairs of sets by their common shingles, components by reachability
SQL["op10_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON b.x = r.y),
root AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, root.component_id, d.doc_id = root.component_id AS kept
FROM documents d JOIN root ON root.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

# all pairs by cosine in double precision
SQL["op2_rp_forest"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
root AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, root.component_id, e.vec_id = root.component_id AS kept
FROM embeddings e JOIN root ON root.vec_id = e.vec_id
"""


def _manifest_sql(levels: int = 9, top: int = 4) -> str:
    """Trees of up to 8 ** levels rows a language and 8 ** top languages, level by level; a tree of one node keeps it.

    ``n{k}``: nodes of level k; ``r{k}``: their runs, each the list of its digests; ``p{k}``: per leaf its place, the
    siblings so far and the digest folded so far."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of the decimal id: its table, then a fold over the bytes
    table = "list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda z: 0::UBIGINT)), " \
        "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), " \
        "lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"
    ctes = [f"crc AS (SELECT {table} AS t)",
            "langs AS (SELECT own, row_number() OVER (ORDER BY encode(own) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang AS own FROM documents))",
            f"""leaves AS (SELECT l.tree, doc_id, {leaf('text')} AS leaf,
  CASE WHEN coalesce({crc} % 3 = 0, false) THEN {leaf(lower)} ELSE {leaf('text')} END AS now
FROM documents d JOIN langs l ON l.own IS NOT DISTINCT FROM d.lang, crc)""",
            "n0 AS (SELECT tree, doc_id, leaf, now, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves)",
            "p0 AS (SELECT tree, doc_id, leaf, now, idx, '' AS proof FROM n0)"]

    def level(k: int, tree: str, nodes: str, path: str) -> None:
        ctes.append(f"r{k} AS (SELECT {tree} AS tree, idx // 8 AS idx, list(digest ORDER BY idx) AS run, any_value(n) AS n FROM "
                    f"(SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {nodes}) GROUP BY 1, 2)")
        ctes.append(f"n{k} AS (SELECT tree, idx, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM r{k})")
        own = "list_transform(run, lambda x, i: CASE WHEN i - 1 = p.idx % 8 THEN now ELSE x END)"
        ctes.append(f"""p{k} AS (SELECT p.tree, p.doc_id, p.leaf, p.idx // 8 AS idx, {', p.subroot' if 'subroot' in path else 'NULL AS subroot'}
  , CASE WHEN n = 1 THEN now ELSE sha256(array_to_string({own}, '')) END AS now
  , proof || array_to_string(list_filter(run, lambda x, i: i - 1 <> p.idx % 8), '') AS proof
FROM {path.split()[0]} p JOIN r{k} r ON r.tree = {'-1' if 'subroot' in path else 'p.tree'} AND r.idx = p.idx // 8)""".replace("idx, , p.subroot", "idx, p.subroot"))

    for k in range(1, levels + 1):
        level(k, "tree", f"n{k - 1}", f"p{k - 1}")
    ctes.append(f"top AS (SELECT -1 AS tree, tree AS idx, digest FROM n{levels})")
    ctes.append(f"ptop AS (SELECT p.tree, p.doc_id, p.leaf, p.tree AS idx, n.digest AS subroot, now, proof FROM p{levels} p JOIN n{levels} n USING (tree))")
    for k in range(levels + 1, levels + top + 1):
        first = k == levels + 1
        level(k, "tree", "top" if first else f"n{k - 1}", ("ptop" if first else f"p{k - 1}") + " subroot")
    last = levels + top
    return "WITH " + ",\n".join(ctes) + f"""
SELECT p.doc_id, p.leaf, p.subroot, n.digest AS root, sha256(p.proof) AS proof_sha256, p.now AS folded_root, p.now = n.digest AS verified
FROM p{last} p, n{last} n"""


SQL["op13_merkle_manifest"] = _manifest_sql()
