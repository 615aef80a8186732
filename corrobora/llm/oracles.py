"""DuckDB texts for the operators that SQL can state, written from their definitions.

They enumerate what the operators avoid: all pairs that share a shingle, every
quotient, every window of every document.
"""

from __future__ import annotations

from corrobora.llm import decontaminate, mixing
from corrobora.llm.sharding import Leaf, balanced_tree, with_new_region

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(words: int = 4, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{mixing.WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)"""


def top_k(k: int = 20, scale: int = 64, every: int = 20) -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
      FROM v q JOIN v x ON q.r <> x.r AND len(q.v) = len(x.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY rank <= {k}"""


def contamination(window: int = decontaminate.WINDOW) -> str:
    words = rf"regexp_extract_all({_LOW}, '{decontaminate.WORD}')"
    return rf"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[p:p + {window - 1}], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, p.n, p.p, item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
k AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


def source_mixing(spec: mixing.MixSpec = mixing.MixSpec()) -> str:
    draw = lambda *parts: f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) AS BIGINT)"
    seed, name = f"'{spec.seed}'", "coalesce(CAST(doc_id AS VARCHAR), '')"
    return rf"""
WITH z AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS BIGINT) AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM z GROUP BY source),
b AS (SELECT *, (source_no - 1) % 3 + 1 AS weight, {spec.most_repeats} * source_size AS bound FROM a),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(bound) OVER o, 0)) / (CAST(sum(weight) OVER () AS DOUBLE) - coalesce(sum(weight) OVER o, 0)) AS level
      FROM b WINDOW o AS (ORDER BY CAST(bound AS DOUBLE) / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(CAST(bound AS DOUBLE), weight * max(level) OVER ()) AS target FROM c),
u AS (SELECT *, CAST(greatest(1, least({spec.most_block}, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 1000))) AS BIGINT) AS block, count(*) OVER () AS n FROM t),
f AS (SELECT source_no, target / (2 * s + 1) AS quotient, s, CAST(floor(CAST(total AS DOUBLE) / block + 0.5) AS BIGINT) AS seats
      FROM (SELECT *, unnest(range(0, CAST(target / block + n + 2 AS BIGINT))) AS s FROM u WHERE target > 0)),
g AS (SELECT source_no, count(*) AS source_seats FROM (SELECT * FROM f QUALIFY row_number() OVER (ORDER BY quotient DESC, source_no, s) <= seats) GROUP BY source_no),
p AS (SELECT z.*, u.source_no, u.source_size, u.target, u.block, {draw(seed, "'order'", name)} AS order_key,
        {draw(seed, "'shard'", name)} % CAST(least({spec.most_shards}, greatest(1, ceil(CAST(source_size AS DOUBLE) / {spec.shard_words}))) AS BIGINT) AS shard
      FROM z JOIN u ON z.source IS NOT DISTINCT FROM u.source),
h AS (SELECT source_no, shard, block, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(CAST(sum(size) AS DOUBLE) / block) AS BIGINT) AS blocks FROM p GROUP BY source_no, shard, block),
i AS (SELECT source_no, shard, CAST(words AS DOUBLE) / (2 * s + 1) AS quotient, s, source_seats
      FROM (SELECT h.*, source_seats, unnest(range(0, {spec.most_repeats} * blocks + 2)) AS s FROM h JOIN g USING (source_no) WHERE words > 0)),
j AS (SELECT source_no, shard, count(*) AS quota FROM (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY source_no ORDER BY quotient DESC, shard, s) <= source_seats) GROUP BY ALL),
k AS (SELECT h.source_no, h.shard, words, blocks, least(coalesce(quota, 0), {spec.most_repeats} * blocks) AS quota,
        CASE WHEN blocks > 0 THEN {draw(seed, "'start'", "CAST(h.source_no AS VARCHAR)", "CAST(h.shard AS VARCHAR)")} % blocks ELSE 0 END AS start
      FROM h LEFT JOIN j USING (source_no, shard)),
l AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_no, shard ORDER BY order_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM p),
m AS (SELECT l.*, words, blocks, quota, start, stop - size AS begin, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS copies,
        start + CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS until FROM l JOIN k USING (source_no, shard))
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(stop, least(words, until * block)) - greatest(begin, start * block))
         + greatest(0, least(stop, greatest(0, until - blocks) * block) - begin) AS BIGINT) AS taken FROM m"""


def crc_table() -> list[int]:
    """The 256 steps of the reflected CRC-32 polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sharding(shards: int = 8, buckets: int = 1_024) -> str:
    name = "coalesce(CAST(doc_id AS VARCHAR), '')"

    def draw(level: str, child: int, weight: float) -> str:
        digits = f"substr(md5(concat_ws('|', '{level}', '{child}', {name})), 1, 13)"
        return f"-ln((CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({2 ** 52} AS DOUBLE)) / CAST({weight} AS DOUBLE)"

    def winner(level: str, children: dict[int, float]) -> str:
        return "list_sort([" + ", ".join(f"{{'d': {draw(level, c, w)}, 'c': {c}}}" for c, w in sorted(children.items())) + "])[1].c"

    def placed(tree: tuple[Leaf, ...]) -> str:
        region, rack, shard = {}, {}, {}
        for x in tree:
            region[x.region] = region.get(x.region, 0) + x.weight
            rack.setdefault(x.region, {})[x.rack] = rack.get(x.region, {}).get(x.rack, 0) + x.weight
            shard.setdefault(x.rack, {})[x.shard] = x.weight
        below = lambda level, column, groups: f"CASE {column} " + " ".join(f"WHEN {g} THEN {winner(level, c)}" for g, c in groups.items()) + " END"
        return (f"SELECT doc_id, {below('shard', 'rack', shard)} AS shard FROM (SELECT doc_id, {below('rack', 'region', rack)} AS rack "
                f"FROM (SELECT doc_id, {winner('region', region)} AS region FROM ids))")

    return rf"""
WITH ids AS (SELECT DISTINCT doc_id FROM documents),
now AS ({placed(balanced_tree(shards))}), grown AS ({placed(with_new_region(balanced_tree(shards)))}),
b AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, CAST('0x' || substr(md5(concat_ws('|', 'slot', {name})), 1, 8) AS BIGINT) % {buckets} AS bucket,
        xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
            lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32
      FROM documents, (SELECT CAST({crc_table()} AS BIGINT[]) AS t))
SELECT b.doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(now.shard AS INT) AS shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY bucket, b.doc_id, text_crc32, size) - 1 AS slot, CAST(grown.shard AS INT) AS grown_shard
FROM b JOIN now ON b.doc_id IS NOT DISTINCT FROM now.doc_id JOIN grown ON b.doc_id IS NOT DISTINCT FROM grown.doc_id"""
