"""SQL for the phrase query: all phrases of up to five words, counted one by one."""

SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))
  GROUP BY lang, k, phrase HAVING count(*) >= 100
), spelled AS (SELECT *, string_split(phrase, ' ') AS w FROM grams),
parts AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS most, count(*) FILTER (WHERE i = 2 AND j = k) AS left_extensions, count(*) FILTER (WHERE i = 1 AND j = k - 1) AS right_extensions
  FROM (SELECT lang, k, w, f, i, unnest(range(i, k + 1)) AS j FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM spelled WHERE k > 2))
  WHERE j - i + 1 BETWEEN 2 AND k - 1
  GROUP BY ALL
), candidates AS (
  SELECT s.lang, s.k, s.phrase, s.w, s.f AS a, coalesce(left_extensions, 0) AS left_extensions, coalesce(right_extensions, 0) AS right_extensions
  FROM spelled s LEFT JOIN parts p ON s.lang = p.lang AND s.phrase = p.phrase
  WHERE s.k > 1 AND (p.most IS NULL OR 100 * p.most < 100 * s.f)
), cuts AS (
  SELECT c.*, h.f AS l, t.f AS r, n, cut, ((1000 * a::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN grams h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:cut], ' ')
  JOIN grams t ON t.lang = c.lang AND t.phrase = array_to_string(w[cut + 1:c.k], ' ')
  JOIN totals ON totals.lang = c.lang
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, left_extensions, right_extensions
FROM lowest QUALIFY rank <= 2000
"""
