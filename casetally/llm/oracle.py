"""SQL counterparts, in DuckDB's dialect, of those queries that SQL can express."""

from __future__ import annotations

from .sharding import Feistel

MIX = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS part,
    CAST(coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM {docs}
), one AS (
  SELECT part, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY part
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY part) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS room FROM one
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - (CAST(sum(room) OVER (ORDER BY room / w, part ROWS UNBOUNDED PRECEDING) AS BIGINT) - room))::DOUBLE
    / CAST(sum(w) OVER (ORDER BY room / w, part ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed
), per_source AS (
  SELECT part, n, source_size, least(room::DOUBLE, w * max(CASE WHEN level <= room / w THEN level END) OVER ()) AS target FROM levels
), shares AS (
  SELECT s.*, n, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS share FROM sized s JOIN per_source USING (part)
), odds AS (
  SELECT *, floor(share) AS whole, target - floor(share) * source_size AS budget, share - floor(share) AS frac FROM shares
), ranked AS (
  SELECT *, CASE WHEN frac > 0 AND size > 0 THEN u / (1 - u) / (frac / (1 - frac) * (size * n / source_size)) END AS rank FROM odds
), sampled AS (
  SELECT *, CASE WHEN rank IS NULL THEN 0 WHEN sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER
    (PARTITION BY part ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= budget THEN 1 ELSE 0 END AS extra FROM ranked
), gaps AS (
  SELECT part, any_value(budget) - sum(size * extra) AS gap FROM sampled WHERE rank IS NOT NULL GROUP BY part
), closing AS (
  SELECT s.part, s.doc_id, s.size FROM sampled s JOIN gaps USING (part) WHERE rank IS NOT NULL AND extra = 0 AND size < 2 * gap
  QUALIFY row_number() OVER (PARTITION BY s.part ORDER BY abs(gap - size), rank, doc_id NULLS FIRST, size) = 1
), mixed AS (
  SELECT s.doc_id, s.size, source_size, target, CAST(whole + extra + CASE WHEN c.part IS NOT NULL AND extra = 0 AND rank IS NOT NULL
    AND row_number() OVER (PARTITION BY s.part, s.doc_id, s.size, extra) = 1 THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM sampled s LEFT JOIN closing c ON s.part = c.part AND s.doc_id IS NOT DISTINCT FROM c.doc_id AND s.size = c.size
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed
"""

ORACLE: dict[str, str] = {"op7_mixing": MIX.format(text="text", docs="documents")}

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 20
"""

ORACLE["op1_topk"] = TOPK

#: CRC-32 in two parts: the table, one row with a list, and the value of a text; {tab} is the list.
CRC_TABLE = """
  SELECT list(list_reduce(list_prepend(n, list_transform(range(8), lambda i: 0::BIGINT)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY n) AS tab FROM (SELECT range AS n FROM range(256))
"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295::BIGINT)"""


def _rounds(source: str) -> str:
    """The rounds of the network over rows (doc, l, r, k) of ``source``."""
    for factor, offset in Feistel(1).keys:
        t = f"((r * {factor} + {offset}) % 2147483647)"
        t = f"(({t} * {t} % 2147483647 * {factor} + {offset}) % 2147483647)"
        source = f"(SELECT doc, r AS l, xor(l, ({t} // 128) % (1::BIGINT << k)) AS r, k FROM {source})"
    return source


ORACLE["op12_sharding"] = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), sizes AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {CRC.format(text="coalesce(text, '')")} AS text_crc32,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS row
  FROM documents, crc
), domain AS (SELECT count(*) AS n, CAST(greatest(1, ceil(len(bin(count(*) - 1)) / 2.0)) AS INTEGER) AS k FROM documents
), walk AS (
  SELECT doc, (l << k) + r AS p, k FROM {_rounds("(SELECT row AS doc, row >> k AS l, row % (1::BIGINT << k) AS r, k FROM sizes, domain)")}
  UNION ALL
  SELECT doc, (l << k) + r AS p, k FROM {_rounds("(SELECT doc, p >> w.k AS l, p % (1::BIGINT << w.k) AS r, w.k FROM walk w, domain d WHERE p >= n)")}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 16 AS INTEGER) AS shard, p // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard, row
FROM sizes JOIN walk ON doc = row JOIN domain ON p < n
"""

ORACLE["op13_trie"] = f"""
WITH crc AS ({CRC_TABLE}), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS j FROM conversations
  WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, count(*) AS n, {CRC.format(text="CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT conv_id FROM turns), crc GROUP BY conv_id, tab
), plan AS (
  SELECT o.conv_id, o.h, o.conv_id - o.conv_id % 20 AS base, least(o.h, coalesce(b.n, 0)) AS m, o.n FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), rebuilt AS (
  SELECT p.conv_id, j AS d, role, text FROM plan p JOIN turns t ON t.conv_id = p.base AND j <= m
  UNION ALL SELECT p.conv_id, j - h + m, role, text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND j > h
), prefixes AS (
  SELECT conv_id, d, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', [] FROM plan
), keyed AS (
  SELECT conv_id, d, sha256(CAST(d AS VARCHAR) || to_json(path)) AS k, text, m + greatest(0, n - h) AS length FROM prefixes JOIN plan USING (conv_id)
), parts AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM keyed
), node AS (
  SELECT k, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
    sha256(coalesce(string_agg(CASE WHEN d = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM parts GROUP BY k, d
), child AS (SELECT up AS k, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up
), full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN child USING (k)
), sums AS (
  SELECT a.k, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM full_node b JOIN parts a ON a.conv_id = b.conv_id AND a.d <= b.d GROUP BY a.k
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN sums USING (k) LEFT JOIN node u ON u.k = n.up
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op11_search"] = f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents
), doc AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0
), total AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM doc
), asked AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), posting AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM posting, total GROUP BY term
), scored AS (
  SELECT a.item, a.item_id, d.doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM asked a JOIN posting p USING (term) JOIN weight USING (term) JOIN doc d USING (row), total GROUP BY a.item, a.item_id, d.row, d.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
