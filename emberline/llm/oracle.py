"""DuckDB SQL for the text queries that SQL can say."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight FROM r),
l AS (
  SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (2 * sum(weight) OVER (ORDER BY 2 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM w),
t AS (
  SELECT *, least(CAST(2 * source_size AS DOUBLE), max(CASE WHEN level <= 2 * source_size / weight THEN level END) OVER () * weight) AS target,
    CAST(floor(3 * sum(source_size) OVER () / 2 / 16 + 0.5) AS BIGINT) AS blocks, CAST(least(greatest(ceil((source_size + n) / 100000), 1), 65536) AS BIGINT) AS shards
  FROM l),
q AS (
  SELECT place, count(*) AS seats
  FROM (SELECT place, blocks, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, place, j) AS k FROM (SELECT place, blocks, target, unnest(range(1, CAST(ceil(target / 16) AS BIGINT) + 3)) AS j FROM t WHERE target > 0))
  WHERE k <= blocks GROUP BY place),
e AS (SELECT d.*, t.place, t.source_size, t.target, h % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY place, shard HAVING sum(size) > 0),
p AS (
  SELECT place, shard, count(*) FILTER (WHERE k <= seats) AS quota
  FROM (SELECT place, shard, coalesce(seats, 0) AS seats, row_number() OVER (PARTITION BY place ORDER BY words / (2 * j - 1) DESC, shard, j) AS k
    FROM (SELECT place, shard, words, unnest(range(1, CAST(ceil(words / 8) AS BIGINT) + 3)) AS j FROM o) LEFT JOIN q USING (place))
  GROUP BY place, shard),
c AS (
  SELECT place, shard, words, passes, CAST(floor((wanted - passes * words) / 16 + 0.5) AS BIGINT) AS chosen
  FROM (SELECT *, wanted // words AS passes FROM (SELECT place, shard, words, least(quota * 16, 2 * words) AS wanted FROM o JOIN p USING (place, shard)))),
b AS (
  SELECT place, shard, block, passes + CAST(row_number() OVER (PARTITION BY place, shard ORDER BY md5('12:' || place || ':' || shard || ':' || block)) <= chosen AS BIGINT) AS times
  FROM (SELECT place, shard, passes, chosen, unnest(range(0, CAST(ceil(words / 16) AS BIGINT))) AS block FROM c)),
x AS (
  SELECT row_number() OVER () AS row_no, doc_id, size, source_size, target, place, shard, sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM e),
y AS (SELECT row_no, place, shard, stop - size AS start, stop, unnest(range(CAST((stop - size) // 16 AS BIGINT), CAST((stop - 1) // 16 + 1 AS BIGINT))) AS block FROM x WHERE size > 0),
z AS (SELECT row_no, sum((least((block + 1) * 16, stop) - greatest(block * 16, start)) * times) AS taken FROM y JOIN b USING (place, shard, block) GROUP BY row_no)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM x LEFT JOIN z USING (row_no)
"""

SEARCH = r"""
WITH t AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM t WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_no, item_id, term
  FROM (SELECT row_number() OVER () AS item_no, item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)),
p AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY row_no, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
r AS (
  SELECT item_no, item_id, row_no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_no, item_id, row_no, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
