"""The named queries as SQL for DuckDB, written from their meaning."""

from __future__ import annotations

from blogindex.functions.stemming import stem_steps
from blogindex.functions.stopwords import ENGLISH_STOP_WORDS

W = r"[\p{L}\p{N}_]+"
C = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"

# ---- shared table expressions

DOCS = r"""docs AS (
  SELECT doc_id, lang, source, n_chars,
         'https://' || source || '.example.com/' || lang || '/' || doc_id AS location,
         string_split(text, chr(10))[1] AS title,
         list_filter(string_split(text, chr(10)), lambda x: x <> '') AS content,
         array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ') AS body,
         1704067200 + doc_id AS created_at
  FROM documents)"""


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{C}+', ''), '{C}+$', '')"


def word_count(x: str) -> str:
    return rf"len(string_split(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\x0b]', ' ', 'g'), ' '))"


def content_hash(title: str, body: str) -> str:
    return f"sha256({strip(f'lower({title})')} || ' ' || {strip(f'lower({body})')})"


def uuid(h: str) -> str:
    return (f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||"
            f"substr({h},17,4)||'-'||substr({h},21,12)")


def accepted(body: str = "body", title: str = "title") -> str:
    return (f"length({body}) BETWEEN 100 AND 50000 AND NOT ({title} = '' AND "
            f"regexp_full_match({body}, '{C}*'))")


IDX = rf"""{DOCS}, idx AS (
  SELECT doc_id, location AS url, {uuid('sha256(location)')} AS id, title, body AS content,
         [lang, source] AS keywords, source || '.example.com' AS domain,
         {content_hash('title', 'body')} AS content_hash, {word_count('body')} AS word_count, created_at
  FROM docs WHERE {accepted()})"""

LIMITED = rf"""{IDX}, fields AS (
  SELECT url, 'A' AS w, regexp_extract_all(lower(title), '{W}') AS l, 0 AS shift FROM idx
  UNION ALL
  SELECT url, 'C', regexp_extract_all(lower(content), '{W}'), len(regexp_extract_all(lower(title), '{W}')) FROM idx
  UNION ALL
  SELECT url, 'D', regexp_extract_all(lower(array_to_string(keywords, ' ')), '{W}'),
         len(regexp_extract_all(lower(title), '{W}')) + len(regexp_extract_all(lower(content), '{W}')) FROM idx),
vec AS (
  SELECT url, unnest(l) AS lexeme, least(generate_subscripts(l, 1) + shift, 16383) AS pos, w AS weight FROM fields),
post AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, lexeme ORDER BY pos) AS nth
                 FROM (SELECT url, lexeme, pos, min(weight) AS weight FROM vec GROUP BY ALL)) WHERE nth <= 256)"""

# Each item's words as one query, and each two of them in turn as another.
# Every position, none pressed together and none left out.
VEC = LIMITED.replace("least(generate_subscripts(l, 1) + shift, 16383)", "generate_subscripts(l, 1) + shift") \
    .replace(" WHERE nth <= 256", "")

QRY = rf"""items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS ws FROM benchmark),
qs AS (
  SELECT item_id * 1000000 AS query_id, array_to_string(ws, ' ') AS q FROM items
  UNION ALL SELECT item_id * 1000000 + k, array_to_string(ws[2 * k - 1:2 * k], ' ')
  FROM (SELECT *, unnest(range(1, greatest((len(ws) + 1) // 2, 1) + 1)) AS k FROM items))"""

TERMS = """terms AS (
  SELECT query_id, lexeme, count(*) OVER (PARTITION BY query_id) AS n
  FROM (SELECT DISTINCT query_id, unnest(string_split(q, ' ')) AS lexeme FROM qs) WHERE lexeme <> '')"""

HITS = f"""{VEC}, {QRY}, {TERMS}, hits AS (
  SELECT t.query_id, p.url, t.n FROM terms t JOIN (SELECT DISTINCT url, lexeme FROM post) p USING (lexeme)
  GROUP BY ALL HAVING count(*) = t.n)"""


def ranks(source: str) -> str:
    """source names a frame (query_id, url, n) and terms the lexemes of its queries."""
    return f"""occ AS (
  SELECT h.query_id, h.url, h.n, p.lexeme, p.pos,
         CASE p.weight WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END::DOUBLE AS w
  FROM {source} h JOIN terms t USING (query_id) JOIN post p ON p.url = h.url AND p.lexeme = t.lexeme),
ends AS (
  SELECT a.query_id, a.url, a.n, a.pos AS q, b.lexeme, max(b.pos) AS last
  FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.url = b.url AND b.pos <= a.pos
  WHERE a.n > 1 GROUP BY ALL),
spans AS (
  SELECT query_id, url, p, min(q) AS q FROM (
    SELECT query_id, url, q, min(last) AS p FROM ends GROUP BY query_id, url, n, q HAVING count(*) = n)
  GROUP BY ALL),
scores AS (
  SELECT s.query_id, s.url, s.p,
         (count(*) / sum(1 / o.w)) / (1 + CASE WHEN (q - p) - (count(*) - 1) < 0 THEN (count(*) - 1) // 2
                                               ELSE (q - p) - (count(*) - 1) END) AS score
  FROM spans s JOIN occ o ON o.query_id = s.query_id AND o.url = s.url AND o.pos BETWEEN s.p AND s.q
  GROUP BY s.query_id, s.url, s.p, s.q),
ranked AS (
  SELECT query_id, url, sum(score) AS rank FROM scores GROUP BY ALL
  UNION ALL SELECT query_id, url, sum(w) FROM occ WHERE n = 1 GROUP BY ALL)"""


SNIPPET = rf"""words AS (
  SELECT url, w, pos, sum(length(w) + 1) OVER (PARTITION BY url ORDER BY pos) AS upto
  FROM (SELECT url, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
        FROM (SELECT url, regexp_extract_all(content, '[^\s\p{{Z}}\x0b\x1c-\x1f\x85]+') AS ws FROM idx))),
snip AS (
  SELECT i.url, CASE WHEN length({strip('content')}) <= 200 THEN {strip('content')}
                     ELSE coalesce(h.head, '') || '...' END AS snippet
  FROM idx i LEFT JOIN (SELECT url, string_agg(w, ' ' ORDER BY pos) AS head FROM words
                        WHERE upto <= 200 GROUP BY url) h USING (url))"""

RANKED = f"{HITS}, {ranks('hits')}"


def results(page: int, per_page: int, where: str = "true") -> str:
    return f"""{RANKED}, {SNIPPET}, shown AS (
  SELECT r.query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, created_at DESC, url) AS position,
         url, title, snippet AS content_summary, domain, word_count, created_at, rank
  FROM ranked r JOIN idx USING (url) JOIN snip USING (url) WHERE {where}),
paged AS (SELECT * FROM shown WHERE position > {(page - 1) * per_page} AND position <= {page * per_page})"""


RESULT_SELECT = ("SELECT query_id, position, url, title, content_summary, domain, word_count, created_at, "
                 "round(rank, 6) AS rank FROM paged")

TOTALS = f"""{HITS}, totals AS (
  SELECT qs.query_id, count(h.url) AS total FROM qs LEFT JOIN hits h USING (query_id) GROUP BY ALL)"""

ONE = rf"""{VEC}, terms AS (SELECT 0 AS query_id, lexeme FROM (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS lexeme FROM benchmark)
  GROUP BY lexeme ORDER BY count(*) DESC, lexeme LIMIT 2),
one AS (SELECT 0 AS query_id, url, 2 AS n FROM (SELECT DISTINCT url, lexeme FROM post WHERE lexeme IN (SELECT lexeme FROM terms))
        GROUP BY url HAVING count(*) = 2),
{ranks('one')}, listed AS (
  SELECT url, title, domain, rank, row_number() OVER (ORDER BY round(rank, 9) DESC, created_at DESC, url) AS nth
  FROM ranked JOIN idx USING (url))"""

HTML = rf"""tok AS (
  SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM (
    SELECT page_id, regexp_extract_all(html,
      '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title>.*?</title>|<[^>]+>|[^<]+') AS l
    FROM pages)),
kind AS (
  SELECT *, CASE WHEN t LIKE '<!%' OR t LIKE '</%' THEN NULL
                 WHEN t LIKE '<%' THEN regexp_extract(t, '^<([a-z0-9]+)', 1) END AS tag FROM tok),
stated AS (
  SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k) AS state FROM kind),
texts AS (
  SELECT page_id, k, state, {strip('''replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')''')} AS txt
  FROM (SELECT *, CASE WHEN tag IN ('title', 'script') THEN regexp_extract(t, '(?s)^<[^>]*>(.*)</', 1)
                       WHEN tag IS NULL AND t NOT LIKE '<%' THEN t END AS raw FROM stated)
  WHERE raw IS NOT NULL),
texts2 AS (SELECT * FROM texts WHERE txt <> '' AND state IS NOT NULL)"""

CONTENT_TAGS = ("'p','span','pre','code','em','strong','b','i','mark','small','abbr','cite','q','blockquote',"
                "'kbd','samp','var','li','dt','dd','th','td','caption'")


def html_list(states: str, name: str) -> str:
    return (f"WITH {HTML} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, "
            f"txt AS {name} FROM texts2 WHERE state IN ({states})")


LINKS = r"""links AS (
  SELECT page_id, generate_subscripts(hs, 1) - 1 AS pos,
         regexp_extract(url, '^https?://[^/?#]+', 0) || rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/')
           || array_to_string(list_transform(string_split(unnest(hs), '/'), lambda s:
                replace(replace(replace(url_encode(s), '%2C', ','), '%3B', ';'), '%3A', ':')), '/')
           || regexp_extract(url, '[?#].*$', 0) AS links
  FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a href="[^"]*"'),
               lambda h: h[10:-2]) AS hs FROM pages))"""

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"

FRONT = r"""front AS (
  SELECT CASE WHEN copy = 2 THEN url || '%zz' ELSE url END AS location, (page_id % 6)::INT AS retries,
         page_id * 3 + copy AS seq,
         (CASE WHEN copy = 2 THEN url || '%zz' ELSE url END) LIKE '%ref=x' AS check_failed, url, copy
  FROM pages, (VALUES (0), (1), (2)) v(copy))"""

BLACK = f"black AS (SELECT DISTINCT {HOST} AS host FROM pages WHERE url LIKE '%.html%')"

ADMIT = f"""{FRONT}, live AS (SELECT * FROM front WHERE retries <= 3),
visited AS (SELECT url AS location FROM pages WHERE url LIKE '%utm_source%')"""

GRAPH = f"""{DOCS}, n AS (SELECT count(*) AS n FROM documents), graph AS (
  SELECT d.doc_id, d.location, k AS pos, t.location AS link, t.doc_id AS target
  FROM docs d, n, (VALUES (0), (1)) v(k), docs t WHERE t.doc_id = (2 * d.doc_id + 1 + k) % n.n)"""

TOK = rf"""{DOCS}, texts AS (
  SELECT doc_id, title || ' ' || lang || ' ' || source || ' ' || body AS raw FROM docs WHERE title <> ''
  UNION ALL SELECT doc_id, lang || ' ' || source || ' ' || body FROM docs WHERE title = ''),
toks AS (
  SELECT * FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(raw), '{W}'),
                   lambda x: regexp_full_match(x, '[a-z]{{4,}}')) AS l FROM texts) WHERE len(l) > 0),
occ AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token FROM toks)"""

WORDS = rf"""words AS (
  SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark)
  WHERE regexp_full_match(w, '[a-z]{{4,}}'))"""


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def _gram_sql() -> str:
    return f"""{TOK}, kept AS (
  SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos
  FROM occ WHERE token NOT IN ({_stop_list()})),
grams AS (
  SELECT doc_id, token AS term FROM kept
  UNION ALL SELECT a.doc_id, a.token || ' ' || b.token FROM kept a JOIN kept b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
  UNION ALL SELECT a.doc_id, a.token || ' ' || b.token || ' ' || c.token
    FROM kept a JOIN kept b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN kept c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM toks),
vocab AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM nd) ORDER BY total DESC, term LIMIT 10000),
raww AS (SELECT doc_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), nd),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raww),
scored AS (
  SELECT doc_id, round(1 - 1 / (1 + exp(-m)), 6) AS p_not, round(1 / (1 + exp(-m)), 6) AS p_dev
  FROM (SELECT doc_id, sum(weight * (length(term) % 7 - 3) / 2.0) + 0.1 AS m FROM tfidf GROUP BY doc_id)),
routed AS (
  SELECT d.doc_id, d.location, s.p_not, CASE WHEN p_not >= 0.55 THEN 'blacklist' WHEN p_not <= 0.5 THEN 'index' ELSE 'follow' END AS route
  FROM docs d JOIN scored s USING (doc_id))"""


GRAMS = _gram_sql()

VISITS = f"""{DOCS}, visits AS (
  SELECT doc_id::DOUBLE AS seq, 'https://' || source || '.example.com/' || doc_id % 7 AS url, title, body, created_at FROM docs
  UNION ALL
  SELECT doc_id + 0.5, 'https://' || source || '.example.com/' || doc_id % 7, title, body, created_at FROM docs WHERE doc_id % 5 = 0),
hashed AS (
  SELECT *, sha256(url) AS url_hash, {content_hash('title', 'body')} AS content_hash, ({accepted()}) AS fine FROM visits),
judged AS (
  SELECT seq, url_hash, CASE WHEN b IS NULL THEN 'inserted' WHEN b = content_hash THEN 'skipped' ELSE 'updated' END AS status
  FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url_hash ORDER BY seq) AS b FROM hashed WHERE fine)
  UNION ALL SELECT seq, url_hash, 'skipped' FROM hashed WHERE NOT fine)"""

BATCH = """ev AS (
  SELECT event_id // 100 AS batch, ts, value::DECIMAL(10,2) AS v,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'inserted' WHEN event_type = 'view' THEN 'updated'
              WHEN event_type = 'signup' THEN 'skipped' ELSE 'error' END AS s FROM events),
bt AS (
  SELECT batch, min(ts)::DATE AS date, sum(v) AS ms, count(*) AS processed,
         count(*) FILTER (s = 'inserted') AS inserted, count(*) FILTER (s = 'updated') AS updated,
         count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'error') AS errors
  FROM ev GROUP BY batch),
daily AS (
  SELECT date, sum(processed)::BIGINT AS pages_processed, sum(inserted)::BIGINT AS pages_inserted,
         sum(updated)::BIGINT AS pages_updated, sum(skipped)::BIGINT AS pages_skipped,
         sum(errors)::BIGINT AS processing_errors,
         list_reduce(list((ms * 100)::BIGINT ORDER BY batch), lambda a, x: (a + x + 1) // 2) / 100.0 AS avg_processing_time_ms
  FROM bt GROUP BY date)"""

SHAPES = r"""seeds AS (
  SELECT DISTINCT unnest([url, regexp_replace(url, '^https?://', ''), regexp_extract(url, '^https?://[^/]+', 0),
         'https://' || upper(regexp_extract(url, '^https?://([^/]+)', 1)) || ':8443/a;v=1?x#y']) AS seed FROM pages),
cut AS (
  SELECT seed, lower(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1)) AS host, split_part(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';', 1) AS path,
         CASE WHEN u LIKE 'https:%' THEN ['https://', 'http://'] ELSE ['http://', 'https://'] END AS schemes
  FROM (SELECT seed, CASE WHEN seed LIKE '%://%' THEN seed ELSE 'http://' || seed END AS u FROM seeds)),
cand AS (
  SELECT seed, i, 0 AS k, schemes[i] || host || path AS candidate FROM cut, (VALUES (1), (2)) v(i) WHERE path NOT IN ('', '/')
  UNION ALL SELECT seed, i, 1, schemes[i] || host FROM cut, (VALUES (1), (2)) v(i)
  UNION ALL SELECT seed, i, 2, schemes[i] || regexp_extract(host, '[^.]+\.[^.]+$', 0) FROM cut, (VALUES (1), (2)) v(i)
    WHERE regexp_matches(host, '\..*\.')),
numbered AS (SELECT seed, candidate, row_number() OVER (PARTITION BY seed ORDER BY i, k) - 1 AS ord FROM cand)"""

JSON_BAD = "lang = 'fr'"


def doc_digest(author: str) -> str:
    return (f"WITH {DOCS} SELECT doc_id, title, {author} AS author, len(content) AS lines, 0::BIGINT AS links, "
            f"md5(body) AS digest, created_at FROM docs WHERE NOT {JSON_BAD}")


ORACLES: dict[str, str] = {
    "parse_frontier": "SELECT page_id, url AS location, (page_id % 5)::INT AS retries FROM pages WHERE url NOT LIKE '%/fr/%'",
    "parse_pages": doc_digest("'<null>'"),
    "parse_pages_router": doc_digest("''"),
    "rejected_pages": f"""WITH {DOCS} SELECT doc_id, substr('"title":' || to_json(title) || ',"keywords":["fr","' || source
        || '"],"headings":[],"content":[', 1, 40) AS value FROM docs WHERE {JSON_BAD}""",
    "typed_pages": f"""WITH {DOCS} SELECT doc_id, location, array_to_string(content, chr(10)) AS content,
        CASE WHEN source = 'src1' THEN '' ELSE lang || '|' || source END AS keywords, 0::BIGINT AS links,
        source = 'src1' AS type_error FROM docs""",
    "pages_json": f"""WITH {DOCS} SELECT location, '' AS author, created_at * 1000 AS created_at, 11::BIGINT AS fields,
        md5(array_to_string([title, '', '', lang || ',' || source, '', array_to_string(content, ','), '', '', '', location], '|')) AS digest FROM docs""",
    "store_lookup": f"""WITH {DOCS} SELECT {uuid('sha256(location)')} AS id, source || '.example.com' AS host, location
        FROM docs WHERE lang = 'en'""",
    "read_seeds": "SELECT url AS location FROM pages WHERE url NOT LIKE '%#%'",
    "read_corpus": f"WITH {DOCS} SELECT location, quality::DOUBLE AS label, len(content) AS lines FROM docs JOIN labels USING (doc_id)",
    "seed_candidates": f"WITH {SHAPES} SELECT seed, ord, candidate FROM numbered",
    "resolve_seeds": f"""WITH {SHAPES}, tried AS (
        SELECT *, candidate IN (SELECT url FROM pages) AS ok FROM numbered)
        SELECT seed, arg_min(candidate, ord) FILTER (ok) AS working,
               CASE WHEN bool_or(ok) THEN NULL ELSE 'HTTP ' || (400 + length(arg_max(candidate, ord)) % 20) END AS error
        FROM tried GROUP BY seed""",
    "hostname": f"SELECT page_id, split_part({HOST}, ':', 1) AS hostname FROM pages",
    "domain": "SELECT page_id, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS domain FROM pages",
    "netloc": f"SELECT page_id, 'u:p@' || {HOST} AS netloc FROM pages",
    "valid_location": """SELECT page_id, location, location LIKE 'http://%' OR location LIKE 'https://%' AS valid FROM (
        SELECT page_id, unnest([url, upper(url), 'ftp' || substr(url, 5)]) AS location FROM pages)""",
    "normalize_link": r"""WITH b AS (
        SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) AS o,
               rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS p, regexp_extract(url, '[?#].*$', 0) AS q FROM pages)
        SELECT page_id, k AS shape, CASE k
            WHEN 0 THEN o || p || '/c' || q WHEN 1 THEN o || regexp_replace(p, '/[^/]*$', '') || '/c' || q
            WHEN 2 THEN o || p || '/c/' || q WHEN 3 THEN o || p || q WHEN 4 THEN o || p || '/%23top' || q
            WHEN 5 THEN o || p || '/%3Fp=2' || q WHEN 6 THEN '//cdn.org/j.js' ELSE 'http://O.org/Z' END AS link
        FROM b, (SELECT unnest(range(8)) AS k)""",
    "block_domains": f"""SELECT page_id, url FROM pages WHERE NOT regexp_matches({HOST},
        '(^|\\.)(cheap-pills\\.example\\.com|spam-farm\\.example\\.org)$')""",
    "drop_blacklisted": f"WITH {BLACK} SELECT page_id, url FROM pages WHERE {HOST} NOT IN (SELECT host FROM black)",
    "gate_documents": """SELECT * FROM (SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'text/plain' WHEN url LIKE '%#%' THEN 'application/pdf'
            WHEN url LIKE '%.html%' THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS content_type,
        CASE WHEN url LIKE '%?%' THEN 0 ELSE length(html) END AS chars FROM pages) WHERE content_type LIKE 'text/%'""",
    "extract_title": f"""WITH {HTML} SELECT page_id, (SELECT arg_max(txt, k) FROM texts2 t WHERE t.page_id = p.page_id AND state = 'title') AS title
        FROM pages p""",
    "extract_headings": html_list("'h1','h2','h3','h4','h5','h6'", "headings"),
    "extract_content": html_list(CONTENT_TAGS, "content"),
    "extract_script_text": html_list("'script'", "script_content"),
    "extract_links": f"WITH {LINKS} SELECT page_id, pos, links FROM links",
    "extract_meta": r"""WITH b AS (
        SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+', 0) AS o,
               rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS p, regexp_extract(url, '[?#].*$', 0) AS q FROM pages)
        SELECT page_id, 'About ' || host AS description, host AS author, 'k1| ' || page_id || '|z' AS keywords, o || p || '/c' || q AS script_link FROM b""",
    "sql_page_columns": f"""WITH {DOCS} SELECT doc_id, {content_hash('title', 'body')} AS content_hash,
        CASE WHEN body = '' THEN 0 ELSE {word_count('body')} END AS word_count, source || '.example.com' AS hostname,
        source || '.example.com' AS netloc, source || '.example.com' AS domain FROM docs""",
    "assemble_page": f"""WITH {HTML} SELECT p.page_id, any_value(p.url) AS location, 1706745600000 AS created_at,
        count(*) FILTER (state IN ('h1','h2','h3','h4','h5','h6')) AS headings, count(*) FILTER (state IN ({CONTENT_TAGS})) AS content,
        any_value(len(regexp_extract_all(p.html, '<a href='))) AS links, count(*) FILTER (state = 'script') AS script_content
        FROM pages p LEFT JOIN texts2 t USING (page_id) GROUP BY p.page_id""",
    "seed_frontier": "SELECT url AS location, 0 AS retries FROM pages",
    "frontier_size": "SELECT 2 * count(*) AS size FROM documents",
    "admission_report": f"""WITH {ADMIT}, {BLACK}, f AS (
        SELECT *, min(seq) FILTER (retries <= 3 AND NOT check_failed) OVER (PARTITION BY location) AS first FROM front)
        SELECT seq, location, CASE WHEN retries > 3 THEN 'retries' WHEN check_failed THEN 'requeued'
            WHEN location IN (SELECT location FROM visited) OR seq > first THEN 'visited'
            WHEN copy = 2 AND url NOT LIKE '%?%' THEN 'malformed'
            WHEN regexp_matches({HOST}, '(^|\\.)(cheap-pills\\.example\\.com|spam-farm\\.example\\.org)$') THEN 'blocked'
            WHEN {HOST} IN (SELECT host FROM black) THEN 'blacklisted' ELSE 'admitted' END AS reason FROM f""",
    "admit": f"""WITH {ADMIT} SELECT location, min(seq) AS seq FROM live
        WHERE location NOT IN (SELECT location FROM visited) GROUP BY location""",
    "requeue_failed": f"WITH {FRONT} SELECT location, retries + 1 AS retries, seq FROM front WHERE check_failed",
    "expand_links": f"WITH {GRAPH} SELECT doc_id, pos, link AS location, 0 AS retries FROM graph",
    "crawl_waves": f"""WITH RECURSIVE {GRAPH}, w(doc_id, wave) AS (
        SELECT 0::BIGINT, 0 UNION SELECT g.target, w.wave + 1 FROM w JOIN graph g USING (doc_id) WHERE w.wave < 24)
        SELECT d.location, min(w.wave) AS wave, d.doc_id AS seq FROM w JOIN docs d USING (doc_id) GROUP BY ALL""",
    "page_text_serve": f"""WITH {DOCS}, t AS (SELECT doc_id, array_to_string(list_filter([title, lang, source, body, location], lambda x: x <> ''), ' ') AS t FROM docs)
        SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM t""",
    "page_text_train": f"""WITH {DOCS}, t AS (SELECT doc_id, array_to_string(list_filter([title, lang, source, body], lambda x: x <> ''), ' ') AS t FROM docs)
        SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM t""",
    "tokens": f"WITH {TOK} SELECT doc_id, array_to_string(l, ' ') AS tokens FROM toks",
    "filter_dictionary": f"""WITH {TOK}, {WORDS} SELECT doc_id, pos, token FROM occ WHERE token IN (
        SELECT o.token FROM (SELECT DISTINCT token FROM occ) o JOIN words w
          ON length(w.word) < length(o.token) AND starts_with(o.token, w.word))""",
    "lemmatize": f"""WITH {TOK}, {WORDS} SELECT doc_id, pos,
        CASE WHEN length(token) > 5 AND token IN (SELECT word FROM words) THEN token[1:5] ELSE token END AS token FROM occ""",
    "remove_stop_words": f"""WITH {TOK} SELECT doc_id, array_to_string(list_filter(l, lambda x: x NOT IN ({_stop_list()})), ' ') AS tokens FROM toks""",
    "ngrams": f"""WITH {TOK}, g AS (
        SELECT doc_id, list_concat(l, list_concat(
            list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]),
            list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]))) AS g FROM toks)
        SELECT doc_id, len(g) AS terms, md5(array_to_string(g, '|')) AS digest FROM g""",
    "vocabulary": f"WITH {GRAMS} SELECT term, df, total FROM vocab",
    "tfidf": f"WITH {GRAMS} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf",
    "split_md5": "SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 100 < 20 AS is_test FROM labels",
    "training_set": "SELECT doc_id, quality::DOUBLE AS label FROM labels",
    "class_weights": """SELECT quality, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight
        FROM labels GROUP BY quality""",
    "score_linear": f"WITH {GRAMS} SELECT doc_id, p_not, p_dev FROM scored",
    "predict": f"WITH {GRAMS} SELECT doc_id, (p_dev > 0.5)::BIGINT AS prediction FROM scored",
    "classification_report": """WITH p AS (SELECT quality AS a, (n_chars >= 600)::INT AS p FROM labels JOIN documents USING (doc_id)),
        c AS (SELECT k, count(*) FILTER (a = k AND p = k) AS hit, count(*) FILTER (p = k) AS claimed, count(*) FILTER (a = k) AS support
              FROM p, (VALUES (0), (1)) v(k) GROUP BY k),
        m AS (SELECT *, CASE WHEN claimed = 0 THEN 0 ELSE hit / claimed END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re FROM c),
        f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f FROM m)
        SELECT k::VARCHAR AS name, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, support FROM f
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f
        UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(support)::BIGINT FROM f
        UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
            round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM f""",
    "route": f"WITH {GRAMS} SELECT doc_id, p_not, route FROM routed",
    "blacklist_domains": f"WITH {GRAMS} SELECT DISTINCT split_part(location, '/', 3) AS domain FROM routed WHERE route = 'blacklist'",
    "route_index": f"WITH {GRAMS} SELECT doc_id, location FROM routed WHERE route = 'index'",
    "route_outlinks": f"""WITH {GRAMS}, n AS (SELECT count(*) AS n FROM documents)
        SELECT r.doc_id, k AS pos, t.location, 0 AS retries FROM routed r, n, (VALUES (0), (1)) v(k), docs t
        WHERE r.route <> 'blacklist' AND t.doc_id = (2 * r.doc_id + 1 + k) % n.n""",
    "route_counts": f"WITH {GRAMS} SELECT route, floor(p_not * 100)::BIGINT AS percent, count(*) AS pages FROM routed GROUP BY ALL",
    "validate": f"""WITH {DOCS} SELECT doc_id, shape, CASE WHEN shape = 'foreign' THEN 'error' WHEN NOT ({accepted()}) THEN 'skipped'
        WHEN shape = 'wide' AND length(location) * 14 > 512 THEN 'error' ELSE 'accepted' END AS status
        FROM docs, (VALUES ('plain'), ('foreign'), ('wide')) v(shape)""",
    "url_hash": f"WITH {DOCS} SELECT doc_id, sha256(location) AS url_hash FROM docs",
    "content_hash": f"WITH {DOCS} SELECT doc_id, {content_hash('title', 'body')} AS content_hash FROM docs",
    "word_count": f"WITH {DOCS} SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE {word_count('body')} END AS word_count FROM docs",
    "indexed_pages": f"WITH {IDX} SELECT id, url, domain, content_hash, word_count, created_at FROM idx",
    "upsert_status": f"WITH {VISITS} SELECT seq, url_hash, status FROM judged",
    "apply_upsert": f"""WITH {VISITS} SELECT {uuid('h.url_hash')} AS id, h.url, h.url_hash, h.title, split_part(h.url, '/', 3) AS domain,
        h.content_hash, {word_count('h.body')} AS word_count, h.created_at
        FROM hashed h JOIN (SELECT url_hash, max(seq) AS seq FROM judged WHERE status <> 'skipped' GROUP BY url_hash) USING (url_hash, seq)""",
    "batch_counts": f"""WITH {VISITS} SELECT floor(seq / 100)::BIGINT AS batch, count(*) AS processed, count(*) FILTER (status = 'inserted') AS inserted,
        count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped, 0::BIGINT AS errors FROM judged GROUP BY 1""",
    "daily_stats": f"WITH {BATCH} SELECT * FROM daily",
    "stats_for": f"WITH {BATCH} SELECT * FROM daily WHERE date = DATE '2024-01-15'",
    "session_totals": f"""WITH {BATCH} SELECT batch, {', '.join(f'(sum({c}) OVER (ORDER BY batch))::BIGINT AS {c}'
        for c in ('processed', 'inserted', 'updated', 'skipped', 'errors'))} FROM bt""",
    "page_count": f"WITH {IDX} SELECT count(*) AS pages FROM idx",
    "content_duplicates": f"""WITH {IDX} SELECT content_hash, count(*) AS pages, min(url) AS first_url FROM idx
        GROUP BY content_hash HAVING count(*) > 1""",
    "document_vectors": f"WITH {LIMITED} SELECT url, lexeme, pos, weight FROM vec",
    "postings": f"""WITH {LIMITED} SELECT lexeme, url, string_agg(pos || weight, ' ' ORDER BY pos) AS positions
        FROM post GROUP BY ALL""",
    "postings_without_limits": f"""WITH {VEC} SELECT lexeme, url, string_agg(pos || weight, ' ' ORDER BY pos) AS positions FROM post GROUP BY ALL""",
    "parse_queries": f"WITH {QRY}, {TERMS} SELECT query_id, lexeme, n FROM terms",
    "match": f"WITH {HITS} SELECT query_id, url FROM hits",
    "rank": f"WITH {RANKED} SELECT query_id, url, round(rank, 6) AS rank FROM ranked",
    "search_ranked": f"WITH {results(1, 10)} {RESULT_SELECT}",
    "search_second_page": f"WITH {results(2, 5)} {RESULT_SELECT}",
    "search_filtered": f"WITH {results(2, 3, chr(39).join(['domain = ', 'src3.example.com', ' AND word_count >= 100']))} {RESULT_SELECT}",
    "search_totals": f"WITH {TOTALS} SELECT query_id, total FROM totals",
    "paging": f"WITH {TOTALS} SELECT query_id, total, total > 20 AS has_next, true AS has_prev, 11::BIGINT AS shown_from, least(20, total) AS shown_to FROM totals",
    "page_window": f"""WITH {TOTALS}, g AS (SELECT query_id, p AS page, total, (total + 1) // 2 AS pages,
            greatest(1, p - 2) AS lo, least((total + 1) // 2, p + 2) AS hi FROM totals, (SELECT unnest(range(1, 6))::INT AS p))
        SELECT query_id, page, CASE WHEN total > 2 THEN pages END AS pages,
            CASE WHEN total > 2 THEN array_to_string(range(lo, hi + 1), ' ') END AS window,
            CASE WHEN total > 2 THEN lo > 1 END AS first, CASE WHEN total > 2 THEN lo > 2 END AS gap_before,
            CASE WHEN total > 2 THEN hi < pages END AS last, CASE WHEN total > 2 THEN hi < pages - 1 END AS gap_after FROM g""",
    "snippet": f"WITH {IDX}, {SNIPPET} SELECT url, snippet FROM snip",
    "search_pages": f"""WITH {ONE} SELECT nth AS position, url, title, NULL::VARCHAR AS author, domain, round(rank, 6) AS rank
        FROM listed WHERE nth BETWEEN 6 AND 25""",
    "terminal_listing": f"""WITH {ONE} SELECT nth AS position, CASE WHEN title = '' THEN 'No title' ELSE title END AS title, url, domain, 'Unknown' AS author,
        NULL::VARCHAR AS description, printf('%.4f', rank) AS rank FROM listed WHERE nth <= 20""",
    "search_results": f"WITH {IDX} SELECT id, url, title, domain, word_count, created_at, 0.0::DOUBLE AS rank FROM idx",
    "result_cards": f"""WITH {results(1, 10)} SELECT query_id, url, domain, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title,
        content_summary AS description, (to_timestamp(created_at) AT TIME ZONE 'UTC')::DATE AS created, word_count, round(rank, 3) AS score FROM paged""",
    "corpus_summary": f"""WITH {IDX}, s AS (SELECT count(*) AS total_pages, round(coalesce(avg(word_count), 0), 2) AS average_word_count,
        count(DISTINCT domain) AS unique_domains, max(created_at) AS latest_page_timestamp FROM idx)
        SELECT *, floor(average_word_count + 0.5)::BIGINT AS shown_words FROM s""",
    "summary_change": f"""WITH {IDX}, r AS (SELECT domain, doc_id // 100 AS snapshot FROM idx),
        s AS (SELECT DISTINCT snapshot FROM r),
        t AS (SELECT s.snapshot, count(*) AS total_pages, count(DISTINCT r.domain) AS unique_domains FROM s JOIN r ON r.snapshot <= s.snapshot GROUP BY 1)
        SELECT *, greatest(total_pages - lag(total_pages, 1, total_pages) OVER (ORDER BY snapshot), 0) AS total_pages_growth,
            greatest(unique_domains - lag(unique_domains, 1, unique_domains) OVER (ORDER BY snapshot), 0) AS unique_domains_growth FROM t""",
    "stream_route": f"""WITH {DOCS}, r AS (SELECT location, source, length(title) % 100 AS p FROM docs)
        SELECT 'index' AS output, location AS value FROM r WHERE p <= 50
        UNION ALL SELECT 'frontier', unnest([location, location || '/next']) FROM r WHERE p < 80
        UNION ALL SELECT DISTINCT 'blacklist', source || '.example.com' FROM r WHERE p >= 80""",
}
# Every pass of every item: those of some addresses fail until their second retry, and come
# back behind all that was there. The first of a location is that of the earliest pass.
_PASSES = f"""{ADMIT}, {BLACK}, passes AS (
    SELECT * REPLACE (retries + pass AS retries), pass, location LIKE '%ref=x' AND retries + pass < 2 AS failed
    FROM front, (SELECT unnest(range(0, 3)) AS pass)
    WHERE pass = 0 OR (location LIKE '%ref=x' AND retries + pass <= 2)),
  decided AS (SELECT *, row_number() OVER (PARTITION BY location, retries > 3 OR failed ORDER BY pass, seq) AS nth FROM passes),
  report AS (SELECT seq, location, retries, CASE WHEN retries > 3 THEN 'retries' WHEN failed THEN 'requeued'
        WHEN location IN (SELECT location FROM visited) OR nth > 1 THEN 'visited'
        WHEN copy = 2 AND url NOT LIKE '%?%' THEN 'malformed'
        WHEN regexp_matches({HOST}, '(^|\\.)(cheap-pills\\.example\\.com|spam-farm\\.example\\.org)$') THEN 'blocked'
        WHEN {HOST} IN (SELECT host FROM black) THEN 'blacklisted' ELSE 'admitted' END AS reason FROM decided)"""
ORACLES["stream_admission_report"] = f"WITH {_PASSES} SELECT seq, location, retries, reason FROM report"
ORACLES["stream_admission"] = f"WITH {_PASSES} SELECT seq, location, retries FROM report WHERE reason = 'admitted'"
ORACLES["sql_normalize_link"] = ORACLES["normalize_link"]
ORACLES["stream_index"] = ORACLES["apply_upsert"]

ORACLES["working_seeds"] = f"SELECT working AS location FROM ({ORACLES['resolve_seeds']}) WHERE working IS NOT NULL"
# Admitted by retries and the list, indexed by the score, accepted by the validation.
ORACLES["stream_chain"] = f"""WITH {IDX} SELECT id, url, sha256(url) AS url_hash, title, domain, content_hash, word_count, created_at
    FROM idx WHERE doc_id % 6 <= 3 AND domain NOT IN ('src3.example.com', 'src5.example.com') AND length(title) % 100 <= 50"""

# Search over the visits' final table: the same SQL with that table for the documents.
_VISITED = f"""{VISITS}, idx AS (
  SELECT h.url, h.title, h.body AS content, [d.lang, d.source] AS keywords, h.created_at
  FROM hashed h JOIN docs d ON d.doc_id = floor(h.seq)
  JOIN (SELECT url_hash, max(seq) AS seq FROM judged WHERE status <> 'skipped' GROUP BY url_hash) USING (url_hash, seq))"""
ORACLES["stream_search"] = f"WITH {RANKED.replace(IDX, _VISITED)}" + """
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, created_at DESC, url) AS position,
                        url, round(rank, 6) AS rank FROM ranked JOIN idx USING (url)) WHERE position <= 10"""

ORACLES["stream_counts"] = f"""WITH {VISITS} SELECT 4::BIGINT AS batches, count(*) AS processed, count(*) FILTER (status = 'inserted') AS inserted,
    count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped, 0::BIGINT AS errors FROM judged"""
ORACLES["stream_daily_stats"] = f"""WITH {VISITS} SELECT DATE '2024-02-01' AS date, count(*) AS pages_processed,
    count(*) FILTER (status = 'inserted') AS pages_inserted, count(*) FILTER (status = 'updated') AS pages_updated,
    count(*) FILTER (status = 'skipped') AS pages_skipped, 0::BIGINT AS processing_errors FROM judged"""

# The visits' final table and every accepted document at its own address.
_BOTH = f"""{_VISITED.replace("idx AS", "visited AS")}, idx AS (
  SELECT * FROM visited UNION ALL
  SELECT location, title, body, [lang, source], created_at FROM docs WHERE {accepted()} AND location NOT IN (SELECT url FROM visited))"""
ORACLES["stream_replay"] = ORACLES["stream_search"].replace(_VISITED, _BOTH)


def stems(source: str) -> str:
    """stems (word, stem) of the words in source."""
    steps = stem_steps("word", "duckdb")
    out = f"SELECT DISTINCT word FROM ({source})"
    for name, rule in steps:
        out = f"SELECT *, {rule} AS {name} FROM ({out})"
    return f"stems AS (SELECT word, stem FROM ({out}))"


ORACLES["stem"] = f"""WITH {stems(f"SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")}
    SELECT word, stem FROM stems"""

# English: stop words keep their numbers, the rest is stemmed; a field goes on behind the last kept word.
_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
_ENGLISH = rf"""{IDX}, {QRY}, lists AS (
  SELECT url, 1 AS f, 'A' AS w, regexp_extract_all(lower(title), '{W}') AS l FROM idx
  UNION ALL SELECT url, 2, 'C', regexp_extract_all(lower(content), '{W}') FROM idx
  UNION ALL SELECT url, 3, 'D', regexp_extract_all(lower(array_to_string(keywords, ' ')), '{W}') FROM idx),
kept AS (SELECT * FROM (SELECT url, f, w, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM lists) WHERE word NOT IN ({_STOP})),
qwords AS (SELECT DISTINCT query_id, unnest(string_split(q, ' ')) AS word FROM qs),
{stems("SELECT word FROM kept UNION ALL SELECT word FROM qwords")},
ends_ AS (SELECT url, coalesce(max(pos) FILTER (f = 1), 0) AS e1, coalesce(max(pos) FILTER (f = 2), 0) AS e2 FROM kept GROUP BY url),
vec AS (SELECT url, stem AS lexeme, pos + CASE f WHEN 1 THEN 0 WHEN 2 THEN e1 ELSE e1 + e2 END AS pos, w AS weight
  FROM kept JOIN ends_ USING (url) JOIN stems USING (word)),
post AS (SELECT url, lexeme, pos, min(weight) AS weight FROM vec GROUP BY ALL),
terms AS (SELECT query_id, lexeme, count(*) OVER (PARTITION BY query_id) AS n FROM (
  SELECT DISTINCT query_id, stem AS lexeme FROM qwords JOIN stems USING (word) WHERE word <> '' AND word NOT IN ({_STOP}))),
hits AS (SELECT t.query_id, p.url, t.n FROM terms t JOIN (SELECT DISTINCT url, lexeme FROM post) p USING (lexeme)
  GROUP BY ALL HAVING count(*) = t.n)"""
ORACLES["search_english"] = f"WITH {results(1, 10).replace(HITS, _ENGLISH)} {RESULT_SELECT}"
