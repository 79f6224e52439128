"""Finite parameter universes, exact aliases, and text operators over a catalogue."""

#: Axes from what the tables hold, each value at its place: line numbers, small quantities, those by threes (so that values repeat),
#: discounts.
AXES = ("axes", """
SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY place) - 1 AS k, v FROM (
  SELECT DISTINCT 'expiry' AS axis, CAST(l_linenumber AS BIGINT) AS place, CAST(l_linenumber AS BIGINT) AS v FROM lineitem
  UNION ALL SELECT DISTINCT 'fast', CAST(l_quantity AS BIGINT), CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_quantity <= 10
  UNION ALL SELECT DISTINCT 'slow', CAST(l_quantity AS BIGINT), CAST(l_quantity AS BIGINT) ~div~ 3 * 3 FROM lineitem WHERE l_quantity BETWEEN 3 AND 14
  UNION ALL SELECT DISTINCT 'stop', CAST(round(l_discount * 100) AS BIGINT), 50 * (CAST(round(l_discount * 100) AS BIGINT) + 1) FROM lineitem)""")
SIZES = ("sizes", "SELECT count_if(axis = 'expiry') AS ne, count_if(axis = 'fast') AS nf, count_if(axis = 'slow') AS ns, count_if(axis = 'stop') AS nt FROM axes")
#: Births count through the axes, the last one fastest; each is decoded by its own number, so any range of them can be.
DECODED = ("decoded", """
SELECT b.birth, e.v AS expiry, f.v AS fast, s.v AS slow, t.v AS stop FROM (
  SELECT birth, birth ~div~ (nf * ns * nt) AS ke, birth ~div~ (ns * nt) % nf AS kf, birth ~div~ nt % ns AS ks, birth % nt AS kt FROM (SELECT nf, ns, nt, SPAN(zero, last) AS birth FROM (SELECT nf, ns, nt, 0 AS zero, ne * nf * ns * nt - 1 AS last FROM sizes WHERE ne * nf * ns * nt > 0))) b
JOIN axes e ON e.axis = 'expiry' AND e.k = b.ke JOIN axes f ON f.axis = 'fast' AND f.k = b.kf JOIN axes s ON s.axis = 'slow' AND s.k = b.ks JOIN axes t ON t.axis = 'stop' AND t.k = b.kt""")
UNIVERSE = (AXES, SIZES, DECODED)
STATUS = ("status", """
SELECT birth, expiry, fast, slow, stop, identity, first_birth, CASE WHEN fast >= slow THEN 'EXCLUDED' WHEN birth > first_birth THEN 'ALIAS' ELSE 'EXECUTED' END AS state FROM (
  SELECT birth, expiry, fast, slow, stop, identity, min(birth) OVER (PARTITION BY identity) AS first_birth FROM (
    SELECT birth, expiry, fast, slow, stop, 'expiry=' || CAST(expiry AS VARCHAR(9)) || ',fast=' || CAST(fast AS VARCHAR(9)) || ',slow=' || CAST(slow AS VARCHAR(9)) || ',stop=' || CAST(stop AS VARCHAR(9)) AS identity FROM decoded))""")
ALIASES = "SELECT birth, identity_sha, first_birth, state FROM (SELECT birth, SHA(identity) AS identity_sha, first_birth, state FROM status)"
ACCOUNT = "SELECT state, count(*) AS births, min(birth) AS first_one FROM status GROUP BY state"
PAIRS = "SELECT a.stop AS stop, a.fast AS fast_a, b.fast AS fast_b, count(*) AS n FROM status a JOIN status b ON a.stop = b.stop AND a.expiry = b.expiry AND a.slow = b.slow AND a.fast < b.fast GROUP BY a.stop, a.fast, b.fast"
#: A stretch of births as a run would take it up again: the second tenth of them.
SLICE = "SELECT d.birth, d.expiry, d.fast, d.slow, d.stop FROM decoded d JOIN (SELECT ne * nf * ns * nt AS n FROM sizes) z ON d.birth >= z.n ~div~ 10 AND d.birth < 2 * z.n ~div~ 10"

TOKENS = ("tokens", "SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, WORDS(text) AS token FROM documents) WHERE length(token) > 2 GROUP BY doc_id, token")
TOKEN_STATS = "SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tokens GROUP BY token HAVING count(*) >= 5"
#: What separates words, as WORDS reads them.
APART = "[^a-z0-9À-ɏͰ-῿]+"
PRIORS = ("priors", "SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, WORDS(text) AS token FROM benchmark) WHERE length(token) > 2 GROUP BY item_id, token")
IDF = ("idf", """
SELECT token, ln((1.0 + max(n)) / (1.0 + count(*))) + 1 AS idf FROM (SELECT token FROM tokens UNION ALL SELECT token FROM priors)
CROSS JOIN (SELECT (SELECT count(DISTINCT doc_id) FROM tokens) + (SELECT count(DISTINCT item_id) FROM priors) AS n) c GROUP BY token""")
#: Cosine through shared tokens only; checks what `matching.nearest` finds without shuffling pairs.
NEAREST = """
SELECT doc_id, item_id, round(score, 6) AS score FROM (
  SELECT d.doc_id, d.item_id, d.score, row_number() OVER (PARTITION BY d.doc_id ORDER BY round(d.score, 9) DESC, d.item_id) AS n FROM (
    SELECT a.doc_id, b.item_id, sum(a.w * b.w) AS score FROM
      (SELECT t.doc_id, t.token, t.tf * i.idf / sqrt(sum(t.tf * i.idf * t.tf * i.idf) OVER (PARTITION BY t.doc_id)) AS w FROM tokens t JOIN idf i ON i.token = t.token) a
    JOIN (SELECT t.item_id, t.token, t.tf * i.idf / sqrt(sum(t.tf * i.idf * t.tf * i.idf) OVER (PARTITION BY t.item_id)) AS w FROM priors t JOIN idf i ON i.token = t.token) b ON a.token = b.token
    GROUP BY a.doc_id, b.item_id) d) WHERE n = 1"""
TAGS = """
SELECT family, count(*) AS n FROM (SELECT CASE WHEN MATCHES(text, '[Ll]icen[sc]e') THEN 'licence' WHEN MATCHES(text, '[0-9][0-9][0-9]-[0-9][0-9]') THEN 'number' WHEN MATCHES(text, '[|]') THEN 'table' ELSE 'prose' END AS family FROM documents) GROUP BY family"""
URLS = "SELECT host, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS host FROM pages) GROUP BY host"
