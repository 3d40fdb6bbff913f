"""What each query must give, as SQL for DuckDB over the same tables.

Written apart from the operators: set-based SQL, no shared expressions.
``{name}`` stands for a table or a view of :mod:`workload.views`.
"""

from __future__ import annotations

from workload.views import oracle

# Letters and digits, lower-cased, single spaces.
NORMAL = "lower(trim(regexp_replace(title, '[^\\p{L}\\p{Nd}]+', ' ', 'g')))"

# Address parts by plain string functions on the text before '#'.
URL_PARTS = """
    SELECT *,
        CASE WHEN scheme <> '' AND rest NOT LIKE '/%' AND rest NOT LIKE '//%' THEN ''
             WHEN rest LIKE '//%' THEN regexp_replace(rest, '^//[^/]*', '') ELSE rest END
            AS raw_path,
        CASE WHEN rest LIKE '//%' THEN regexp_extract(rest, '^//([^/]*)', 1) ELSE '' END AS auth
    FROM (SELECT *, split_part(CASE WHEN scheme = '' THEN bare
                                    ELSE substr(bare, length(scheme) + 2) END, '?', 1) AS rest
          FROM (SELECT *, regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme
                FROM (SELECT *, split_part(url, '#', 1) AS bare,
                             substr(url, length(split_part(url, '#', 1)) + 1) AS frag
                      FROM (SELECT * REPLACE (
                              regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS url)
                            FROM (SELECT *, url AS given FROM SOURCE) q0) q1) q2) q3) q4"""

# The whole address is well-formed.
URL_OK = """(
    (scheme <> '' OR NOT contains(split_part(rest, '/', 1), ':'))
    AND NOT contains(regexp_replace(raw_path || frag, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '%')
    AND NOT contains(auth, ' ')
    AND (NOT regexp_matches(regexp_replace(auth, '^.*@', ''), ':[^:\\]]*$')
         OR regexp_matches(auth, ':[0-9]*$')))"""

HOST = "regexp_replace(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', ''), '[\\[\\]]', '', 'g')"
NAME = "regexp_extract(url_decode(raw_path), '([^/]*)$', 1)"
STEM = "regexp_replace(" + NAME + ", '\\.[^.]*$', '')"


def _urls(source: str) -> str:
    return "(" + URL_PARTS.replace("SOURCE", source) + ")"


ANCHOR = "'<a href=\"([^\"]*)\">([^<]*)</a>'"
TEXT_URL = """'(?i)https?://[^<"'' (\\r\\n)\\t]+'"""

ANCHOR_ROWS = f"""
    SELECT page_id, generate_subscripts(u, 1) - 1 AS pos, unnest(t) AS title, unnest(u) AS url
    FROM (SELECT page_id, regexp_extract_all(html, {ANCHOR}, 2) AS t,
                 regexp_extract_all(html, {ANCHOR}, 1) AS u FROM {{SOURCE}}) q"""

LOOSE_ANCHORS = f"""
    SELECT page_id, pos + 2 AS pos, title, url FROM ({ANCHOR_ROWS.replace("{SOURCE}", "{pages}")}) a
    UNION ALL SELECT page_id, 0, 'caf' || chr(233) || ' ' || chr(233), '/p' || page_id FROM {{pages}}
    UNION ALL SELECT page_id, 1, 'two & a half', '/q' || page_id || '?a=1&b=2' FROM {{pages}}"""

# The planted addresses as a browser sees them; places 0 and 1 of the text are those of the anchors.
_PLANTED = (
    (0, 0, "'plain'", "'http://e.com/u' || page_id"),
    (0, 1, "'ref'", "'http://e.com/caf' || chr(233) || page_id || '?a=1&b=2'"),
    (1, 2, None, "'http://q.com/' || page_id || '\"!'"),
    (1, 3, None, "'http://r.com/' || page_id || 'x'"),
    (1, 4, None, "'http://c.com/' || page_id"),
    (1, 5, None, "'http://s.com/' || page_id"),
    (1, 6, None, "'http://f.com/' || page_id"),
    (1, 7, None, "'http://t.com/' || page_id"),
)
LOOSE_URLS = f"""
    SELECT page_id, src, pos, title, url FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY src, pos) AS rn FROM (
            SELECT page_id, 0 AS src, pos + 2 AS pos, title, url
            FROM ({ANCHOR_ROWS.replace("{SOURCE}", "{pages}")}) a""" + "".join(
    f"\n            UNION ALL SELECT page_id, {src}, {pos}, {title or url}, {url} FROM {{pages}}"
    for src, pos, title, url in _PLANTED
) + """) b) c WHERE rn = 1"""

TEXT_ROWS = f"""
    SELECT page_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS title, unnest(u) AS url
    FROM (SELECT page_id, regexp_extract_all(html, {TEXT_URL}) AS u FROM {{SOURCE}}) q"""


def _from(rows: str, source: str) -> str:
    return rows.replace("{SOURCE}", source)


PAGE_LINKS = f"""
    SELECT page_id, src, pos, title, url FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY src, pos) AS rn FROM (
            SELECT 0 AS src, * FROM ({_from(ANCHOR_ROWS, '{v_text}')}) a
            UNION ALL SELECT 1 AS src, * FROM ({_from(TEXT_ROWS, '{v_text}')}) b) q) q2
    WHERE rn = 1"""

# Pages by the level at which they are asked for, and all their anchors in order.
REACHED = """WITH RECURSIVE reached AS (
        SELECT page_id, 0 AS depth FROM {pages} WHERE page_id IN (0, 2)
        UNION ALL
        SELECT p.page_id, depth + 1 FROM reached r JOIN {pages} p
        ON p.page_id IN (2 * r.page_id + 1, 2 * r.page_id + 2) AND p.page_id <> 2),
    tags AS (
        SELECT q.url AS src, r.depth, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') AS t
        FROM reached r JOIN {v_asking} q ON q.page_id = r.page_id),
    anchors AS (SELECT src, depth, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM tags),
    emitted AS (
        SELECT src, depth, i, k, CASE WHEN k = 0 THEN 'follow' ELSE 'link' END AS kind,
               CASE WHEN k = 0 THEN '' ELSE regexp_extract(a, '>([^<]*)<', 1) END AS title,
               regexp_extract(a, 'href="([^"]*)"', 1) AS url
        FROM anchors, (SELECT unnest([0, 1]) AS k) WHERE k = 1 OR contains(a, 'rel='))"""

ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
MAIL_DATE = "strftime({0}, '%a, %d %b %Y %H:%M:%S +0000')"


def _window_dedup(rows: str, size: int, parts: str = "ALL") -> str:
    """The accepted positions of each sequence, by a left fold over the ordered list."""
    return f"""
        SELECT r.* FROM ({rows}) r JOIN (
            SELECT unnest(s.kept) AS ord FROM (
                SELECT list_reduce(xs, lambda s, x:
                    CASE WHEN list_contains(s.mem, x.url) THEN s
                         ELSE {{'mem': list_append(s.mem, x.url)[-{size}:],
                               'kept': list_append(s.kept, x.ord)}} END,
                    {{'mem': []::VARCHAR[], 'kept': []::BIGINT[]}}) AS s
                FROM (SELECT list({{'ord': ord, 'url': url}} ORDER BY ord) AS xs
                      FROM ({rows}) q0 GROUP BY {parts}) q1) q2) k ON k.ord = r.ord"""


def _fib_due(hours: int) -> str:
    return f"""last + ([0, 1, 1, 2, 3, 5, 8])[CAST(attempts AS INTEGER) + 1]
                      * INTERVAL '{hours}' HOUR"""


STATE = "SELECT url, count(*) AS attempts, max(ts) AS last FROM {v_attempts} GROUP BY url"
AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


def _state_after_cleanups(log: str, every_hours: int, age_hours: int) -> str:
    """Attempts since the last cleanup that forgot the URL, of URLs not forgotten yet."""
    hour = 3_600_000_000

    def forgets(ts: str) -> str:
        return f"make_timestamp(((epoch_us({ts}) + {age_hours * hour}) // {every_hours * hour} + 1) * {every_hours * hour})"

    return f"""
    SELECT url, attempts, last FROM (
        SELECT url, spell, CAST(sum(n) AS BIGINT) AS attempts, max(ts) AS last,
               row_number() OVER (PARTITION BY url ORDER BY spell DESC) AS rn
        FROM (SELECT url, ts, n, sum(CASE WHEN {forgets('prev')} <= ts THEN 1 ELSE 0 END)
                         OVER (PARTITION BY url ORDER BY ts) AS spell
              FROM (SELECT url, ts, n, lag(ts) OVER (PARTITION BY url ORDER BY ts) AS prev
                    FROM (SELECT url, ts, count(*) AS n FROM ({log}) l GROUP BY url, ts) a) b) c
        GROUP BY url, spell) d
    WHERE rn = 1 AND {forgets('last')} > {AS_OF}"""



CANDIDATES = f"""
    SELECT c.url, coalesce(s.attempts, 0) AS attempts, s.last
    FROM (SELECT url FROM {{pages}} UNION ALL SELECT DISTINCT url FROM {{v_attempts}}) c
    LEFT JOIN ({STATE}) s ON s.url = c.url"""

NEW_LINKS = """
    SELECT ord, title, url FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM {v_link_batch}) q
    WHERE rn = 1 AND url NOT IN (SELECT url FROM {v_link_store})"""

ITEM_STORE = "SELECT title, url, pub_date, pub_date + INTERVAL '1' DAY AS added FROM {v_items}"
LINK_STORE = """
    SELECT title, url, ts AS added FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn FROM {v_visits}) q
    WHERE rn = 1"""
ITEM_CUTOFF = "TIMESTAMP '2024-01-02 00:25:00'"
LINK_CUTOFF = "TIMESTAMP '2024-01-15 00:00:00'"

DOMAINS = (
    "('ul.to', 'uploaded.net', 'h2.example.com', 'h10.example.com', 'h18.example.com',"
    " 'h3.example.com')"
)

# The domain filter looks at the address as it is given: leading space means no host.
DOMAIN_FILTERED = f"""
    SELECT ord, title, url FROM {{v_mixed}}
    WHERE lower(regexp_extract(url, '^[a-z]+://([^/:]*)', 1)) IN {DOMAINS}"""


def _expanded(source: str) -> str:
    return f"""
        SELECT m.ord, m.title,
               CASE WHEN short THEN base || split_part(l.body, chr(10), 1) ELSE m.url END AS url
        FROM (SELECT *, regexp_matches(trim(url), '^http://(ul.to|uploaded.net)/') AS short,
                     regexp_replace(rtrim(trim(url), '/'), '(ul.to|uploaded.net)/(?:file/)?(.*)$',
                                    '\\1/file/\\2/') AS base
              FROM ({source}) s) m
        LEFT JOIN {{v_lookups}} l ON m.short AND l.status_url = m.base || 'status'
        WHERE NOT short OR split_part(l.body, chr(10), 1) <> ''"""


CHAINED = _expanded(_window_dedup(DOMAIN_FILTERED, 200))

FEED_KINDS = ("rss", "atom", "rdf")


def _new_links(kept: str, stored: str, tail: str) -> str:
    """New links of the pages of kept items, less those stored."""
    return f"""
    WITH kept AS ({kept}),
    links AS (
        SELECT page_id, 0 AS src, pos, title, url, row_number() OVER (
                   PARTITION BY url ORDER BY page_id, pos) AS rn
        FROM ({_from(ANCHOR_ROWS, '(SELECT p.* FROM {pages} p JOIN kept k ON k.url = p.url)')}) a
        WHERE regexp_matches(url, '^/[a-zA-Z]+$'))
    SELECT substr(url, 2) AS title, url{tail} FROM links
    WHERE rn = 1 AND url NOT IN ({stored})"""


NEW_ITEMS = f"SELECT url FROM {{v_items}} WHERE contains({NORMAL}, 'the')"
FEEDS_TO_LINKS = _new_links(
    f"""{NEW_ITEMS} AND page_id % 3 <> 0 AND page_id % 9 <> 0
        UNION SELECT url FROM {{v_items}} WHERE page_id % 6 = 0 AND page_id % 9 <> 0""",
    f"SELECT url FROM ({_from(ANCHOR_ROWS, '(SELECT * FROM {pages} WHERE page_id % 5 = 0)')}) s",
    ", TIMESTAMP '2024-01-20 01:00:00' AS pub_date",
)

# Items of feeds that came whole, on pages that came.
GOOD_FEED = "(page_id // 20) % 5 <> 4 AND (page_id // 20) % 7 <> 3"
DOCUMENT_FAILURES = """
    SELECT DISTINCT 'http://feeds.example.com/' || page_id // 20 AS url, 'fetch' AS stage, 'status 404' AS reason
    FROM {pages} WHERE (page_id // 20) % 5 = 4
    UNION ALL SELECT DISTINCT 'http://feeds.example.com/' || page_id // 20, 'scan', 'malformed document'
    FROM {pages} WHERE (page_id // 20) % 7 = 3 AND (page_id // 20) % 5 <> 4
    UNION ALL """

FEED_ITEMS = "SELECT page_id // 20 AS feed_id, page_id % 20 AS pos, trim(title) AS title, url"

RULES_JOINED = f"""
    SELECT i.page_id, i.title, i.url
    FROM (SELECT *, {NORMAL} AS n FROM {{v_titles}}) i
    WHERE EXISTS (
        SELECT 1 FROM (SELECT DISTINCT {NORMAL} AS rule FROM {{v_rules}}) r
        WHERE list_bool_and(list_transform(string_split(r.rule, ' '),
                                           lambda w: contains(i.n, w))))"""

_TEMPLATES: dict[str, str] = {
    "rss_items": FEED_ITEMS + f", {AS_OF} AS pub_date FROM {{v_items}}",
    "rss_items_feed_dates": "SELECT trim(title) AS title, url, pub_date FROM {v_items}",
    "atom_items": FEED_ITEMS + " FROM {v_items}",
    "rdf_items": FEED_ITEMS + " FROM {v_items}",
    "feed_kind_counts": """
        SELECT source, count(DISTINCT page_id // 20) AS documents, count(*) AS items
        FROM {pages}, (VALUES ('rss'), ('atom'), ('rdf')) AS k(source) GROUP BY source""",
    "feed_failures": """
        SELECT DISTINCT source || ' cut' AS source, page_id // 20 AS feed_id,
               'malformed document' AS reason
        FROM {pages}, (VALUES ('rss'), ('atom'), ('rdf')) AS k(source)
        UNION ALL SELECT 'page', page_id, 'not a feed' FROM {pages}""",
    "feed_documents_fan_in": """
        SELECT kind || page_id // 20 AS feed, page_id % 20 AS pos, trim(title) AS title, url
        FROM {v_items}, (VALUES ('r'), ('a'), ('d')) AS k(kind)""",
    "feed_fan_in": "SELECT title, url FROM {v_items} UNION ALL SELECT title, url FROM {v_stream}",
    "decode_bodies_md5": """
        SELECT page_id, length(html) AS n_chars, md5(html) AS md5 FROM {pages}
        WHERE page_id % 11 <> 0""",
    "items_to_pages_join": f"""
        SELECT p.page_id, i.title, p.url, length(p.html) AS n_chars
        FROM (SELECT * FROM {{v_items}} WHERE contains({NORMAL}, 'the')) i
        JOIN {{pages}} p ON p.url = i.url""",
    "fetch_failure_log": """
        SELECT DISTINCT url, 'fetch' AS stage, 'not fetched' AS reason FROM {v_stream}
        UNION ALL SELECT url, 'fetch', 'status 404' FROM {pages} WHERE page_id % 11 = 0
        UNION ALL SELECT url, 'scan', 'page is cut short' FROM {pages}
                  WHERE NOT contains(html, '</html>')""",
    "follow_frontier_levels": """
        WITH RECURSIVE walk(url, depth) AS (
            SELECT url, 0 FROM {pages} WHERE page_id = 0
            UNION SELECT f.dst, w.depth + 1 FROM walk w JOIN {v_follow} f ON f.src = w.url)
        SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
    "html_anchor_links": _from(ANCHOR_ROWS, "{pages}"),
    "html_anchor_links_native": _from(ANCHOR_ROWS, "{pages}"),
    "html_anchor_links_loose": LOOSE_ANCHORS,
    "html_anchor_links_loose_native": LOOSE_ANCHORS,
    "text_url_links": _from(TEXT_ROWS, "{v_text}"),
    "text_url_links_native": _from(TEXT_ROWS, "{v_text}"),
    "page_links_serialised": LOOSE_URLS,
    "follow_scan_emissions": REACHED + """
        SELECT src, depth, (row_number() OVER (PARTITION BY src ORDER BY i, k) - 1)::INT AS pos, kind, title, url
        FROM emitted""",
    "follow_scan_missing": REACHED + """
        SELECT DISTINCT url, 'fetch' AS stage, 'not fetched' AS reason FROM emitted
        WHERE kind = 'follow' AND url NOT IN (SELECT url FROM {pages})""",
    "page_links_parser": PAGE_LINKS,
    "page_links_native": PAGE_LINKS,
    "emission_split": f"""
        SELECT page_id, 'item' AS kind, title, url FROM {{v_items}}
        UNION ALL SELECT page_id, 'link', title, url FROM ({_from(ANCHOR_ROWS, '{pages}')}) a
        UNION ALL SELECT page_id, 'follow', '', url FROM ({_from(ANCHOR_ROWS, '{pages}')}) b
                  WHERE length(url) > 10""",
    "custom_scanner": """
        SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, 'item' AS kind, unnest(h) AS title,
               url
        FROM (SELECT page_id, url, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h
              FROM {pages}) q""",
    "feed_render": f"""
        SELECT page_id, '<item><title>' || {ESCAPED.format('title')} || '</title><guid>'
               || {ESCAPED.format('url')} || '</guid><link>' || {ESCAPED.format('url')}
               || '</link><description>' || {ESCAPED.format('title')} || '</description><pubDate>'
               || {MAIL_DATE.format('pub_date')} || '</pubDate></item>' AS xml
        FROM {{v_items}}""",
    "feed_round_trip": f"""
        SELECT trim(title) AS title, url AS guid, url AS link, trim(title) AS description,
               {MAIL_DATE.format('pub_date')} AS "pubDate" FROM {{v_items}}""",
    "custom_source": "SELECT url, md5(html) AS md5 FROM {pages}",
    "stream_custom_source": "SELECT url, md5(html) AS md5 FROM {pages}",
    "feed_publish": """
        SELECT row_number() OVER (ORDER BY encode(url)) - 1 AS pos, trim(title) AS title, url FROM {v_items}""",
    "sanitize_titles": f"SELECT page_id, {NORMAL} AS normal FROM {{v_items}}",
    "url_hostnames": f"SELECT page_id, CASE WHEN {URL_OK} THEN {HOST} END AS host"
                     f" FROM {_urls('{v_urls}')} u",
    "url_paths": f"SELECT page_id, CASE WHEN {URL_OK} THEN url_decode(raw_path) END AS path"
                 f" FROM {_urls('{v_urls}')} u",
    "url_validity": f"SELECT page_id, given AS url, {URL_OK} AS ok FROM {_urls('{v_urls}')} u",
    "url_basenames": f"""
        SELECT page_id, CASE WHEN {URL_OK} THEN {NAME} END AS name,
               CASE WHEN {URL_OK} THEN {STEM} END AS stem FROM {_urls('{v_urls}')} u""",
    "rfc1123_dates": f"SELECT event_id, {MAIL_DATE.format('ts')} AS date FROM {{events}}",
    "filename_titles": f"""
        SELECT page_id, given AS url,
               CASE WHEN {URL_OK} AND {NAME} NOT IN ('', '.') THEN {NAME} ELSE '-' END AS title
        FROM {_urls('{v_urls}')} u""",
    "filename_titles_trim": f"""
        SELECT ord, given AS url,
               CASE WHEN {URL_OK} AND {NAME} NOT IN ('', '.') THEN {STEM} ELSE title END AS title
        FROM {_urls('{v_mixed}')} u""",
    "item_title_filter": f"""
        SELECT * FROM {{v_items}}
        WHERE (contains({NORMAL}, 'the') AND contains({NORMAL}, 'and'))
           OR (contains({NORMAL}, 'über') AND contains({NORMAL}, 'der'))
           OR contains({NORMAL}, 'la')""",
    "item_title_filter_rules_join": RULES_JOINED,
    "item_title_filter_rules_shuffled": RULES_JOINED,
    "item_title_filter_many_rules": f"""
        SELECT i.page_id, i.title, i.url
        FROM (SELECT *, {NORMAL} AS n FROM {{v_titles}}) i
        WHERE n IN (
            SELECT n FROM (SELECT DISTINCT {NORMAL} AS n FROM {{v_titles}}) t, (
                SELECT DISTINCT split_part(rule, ' ', 1) AS a, string_split(rule, ' ') AS words
                FROM (SELECT {NORMAL} AS rule FROM {{v_many_rules}}) m) r
            WHERE contains(n, a) AND list_bool_and(list_transform(words, lambda w: contains(n, w))))""",
    "link_regex_filter_linear": """
        SELECT ord, url FROM {v_stream}
        WHERE regexp_matches(url, '(a*)(a*)(a*)b')
           OR regexp_matches(url, '(?i)/VIEW/[[:digit:]]+$')""",
    "link_domain_filter": DOMAIN_FILTERED,
    "link_domain_filter_table": """
        SELECT ord, title, url FROM {v_stream}
        WHERE host IN (SELECT 'h' || n_regionkey FROM {nation})""",
    "link_regex_filter": """
        SELECT ord, url FROM {v_stream}
        WHERE regexp_matches(url, '/(click|view)/[0-3]$')
           OR regexp_matches(url, '^http://h1[05].*/purchase/')""",
    "item_filter_chain": f"""
        SELECT * FROM {{v_items}}
        WHERE ((contains({NORMAL}, 'er') AND contains({NORMAL}, 'th')) OR contains({NORMAL}, 'la'))
          AND (contains({NORMAL}, 'the') OR contains({NORMAL}, 'des'))""",
    "link_filter_chain": f"""
        SELECT ord, regexp_extract(url, '([^/]*)\\.mkv$', 1) AS title, url FROM ({CHAINED}) c
        WHERE regexp_matches(url, '.*\\.(mkv|mp4)$')""",
    "filter_description": """
        SELECT doc_id AS seq, 'ITEM_TITLE:' || title || chr(10) AS line FROM {v_rules}""",
    "custom_link_filter": """
        SELECT ord, title, url FROM {v_stream}
        WHERE title NOT LIKE 'error %' AND title NOT LIKE 'purchase %'
        UNION ALL SELECT ord, 'purchase', url FROM {v_stream} WHERE title LIKE 'purchase %'
        UNION ALL SELECT ord, substr(title, 10), url FROM {v_stream}
                  WHERE title LIKE 'purchase %'""",
    "expand_short_link_names": _expanded("SELECT * FROM {v_mixed}"),
    "attempt_lookup": CANDIDATES,
    "attempt_states": STATE,
    "attempt_states_after_cleanups": _state_after_cleanups(
        f"SELECT * FROM {{v_attempts}} a WHERE ts < {AS_OF}", 6, 120
    ),
    "schedule_periodic": f"""
        SELECT url, attempts, last, true AS should_continue,
               last + CASE WHEN attempts % 3 = 1 THEN INTERVAL '90' MINUTE
                           ELSE INTERVAL '65' MINUTE END AS due
        FROM ({STATE}) s""",
    "schedule_fibonacci": f"""
        SELECT url, attempts, last, attempts < 7 AS should_continue,
               CASE WHEN attempts < 7 THEN {_fib_due(12)} END AS due FROM ({STATE}) s""",
    "due_fetch_set": f"""
        SELECT * FROM (
            SELECT url, attempts, last, true AS should_continue,
                   coalesce({_fib_due(12)}, {AS_OF}) AS due
            FROM ({CANDIDATES}) c WHERE attempts < 7) q
        WHERE due <= {AS_OF}""",
    "custom_schedule": f"""
        SELECT url, attempts, last, attempts < 5 AS should_continue,
               CASE WHEN attempts < 5 THEN last + attempts * INTERVAL '1' HOUR END AS due
        FROM ({STATE}) s""",
    "dedup_window": _window_dedup("SELECT ord, title, url FROM {v_stream}", 100),
    "dedup_window_chunks": _window_dedup("SELECT ord, title, url FROM {v_visits}", 300),
    "dedup_window_by_host": _window_dedup("SELECT ord, host, title, url FROM {v_stream}", 10, "host"),
    "dedup_window_size1": """
        SELECT ord, host, title, url FROM (
            SELECT *, lag(url) OVER (PARTITION BY host ORDER BY ord) AS before
            FROM {v_stream}) q
        WHERE url IS DISTINCT FROM before""",
    "dedup_window_large": """
        SELECT ord, host, title, url FROM (
            SELECT *, row_number() OVER (PARTITION BY host, url ORDER BY ord) AS rn
            FROM {v_stream}) q
        WHERE rn = 1""",
    # A cleanup is due at each full hour; the one at the hour of ``free`` drops the URL.
    "first_seen_expiring": """
        SELECT r.ord, r.ts, r.title, r.url FROM {v_stream} r JOIN (
            SELECT unnest(s.kept) AS ord FROM (
                SELECT list_reduce(xs, lambda s, x:
                    CASE WHEN x.ts < s.free THEN s
                         ELSE {'free': date_trunc('hour', x.ts + INTERVAL '24' HOUR)
                                       + INTERVAL '1' HOUR,
                               'kept': list_append(s.kept, x.ord)} END,
                    {'free': TIMESTAMP '2000-01-01 00:00:00', 'kept': []::BIGINT[]}) AS s
                FROM (SELECT list({'ord': ord, 'ts': ts} ORDER BY ts, ord) AS xs
                      FROM {v_stream} GROUP BY url) q1) q2) k ON k.ord = r.ord""",
    "store_items": f"""
        SELECT title, url, added AS pub_date, added FROM {{v_link_store}}
        UNION ALL
        SELECT n.title, n.url, b.ts, {AS_OF} FROM ({NEW_LINKS}) n
        JOIN {{v_link_batch}} b ON b.ord = n.ord""",
    "store_items_exists_flag": f"""
        SELECT ord, title, url, ord NOT IN (SELECT ord FROM ({NEW_LINKS}) n) AS existed
        FROM {{v_link_batch}}""",
    "store_links": NEW_LINKS,
    "recent_items": f"SELECT * FROM ({ITEM_STORE}) s WHERE added > {ITEM_CUTOFF}",
    "recent_links": f"SELECT * FROM ({LINK_STORE}) s WHERE added > {LINK_CUTOFF}",
    "cleanup_items": f"SELECT * FROM ({ITEM_STORE}) s WHERE added >= {ITEM_CUTOFF}",
    "cleanup_links": f"SELECT * FROM ({LINK_STORE}) s WHERE added >= {LINK_CUTOFF}",
    "cleanup_attempts": f"SELECT * FROM ({STATE}) s WHERE last >= {LINK_CUTOFF}",
    # Batches of six days from the first one, stamped with their end; the cleanup leaves 10 days before the 20th.
    "store_table_lifecycle": f"""
        SELECT title, url, added FROM (
            SELECT title, url, first_day + (date_diff('day', first_day, added) // 6 + 1) * INTERVAL '6' DAY AS added
            FROM ({LINK_STORE}) s, (SELECT date_trunc('day', min(ts))::TIMESTAMP AS first_day FROM {{v_visits}}) f) q
        WHERE added >= TIMESTAMP '2024-01-10 00:00:00'""",
    "store_table_summaries": """
        SELECT title, url, TIMESTAMP '2024-01-08 00:00:00' + week * INTERVAL '7' DAY AS added FROM (
            SELECT *, datediff('day', DATE '2024-01-01', ts::DATE) // 7 AS week,
                   row_number() OVER (PARTITION BY url ORDER BY datediff('day', DATE '2024-01-01', ts::DATE) // 7, ord) AS rn
            FROM {v_visits} WHERE ts < TIMESTAMP '2024-02-05 00:00:00') v
        WHERE rn = 1""",
    "resume_item_urls": f"""
        SELECT url FROM ({ITEM_STORE}) s WHERE added > {ITEM_CUTOFF}
        UNION SELECT url FROM {{v_visits}}""",
    "due_page_set": f"""
        SELECT * FROM (
            SELECT c.url, coalesce(s.attempts, 0) AS attempts, s.last, true AS should_continue,
                   coalesce({_fib_due(12)}, {AS_OF}) AS due
            FROM (SELECT url FROM ({LINK_STORE}) l WHERE added > {LINK_CUTOFF}
                  UNION SELECT url FROM {{v_attempts}}) c
            LEFT JOIN ({_state_after_cleanups("SELECT * FROM {v_attempts}", 1, 120)}) s ON s.url = c.url
            WHERE coalesce(s.attempts, 0) < 7) q
        WHERE due <= {AS_OF}""",
    "output_feed_items": f"""
        SELECT title, url, {AS_OF} AS pub_date FROM ({LINK_STORE}) s
        WHERE added > {LINK_CUTOFF}""",
    "stream_links": f"""
        SELECT title, url FROM ({LINK_STORE}) s WHERE regexp_matches(url, '/(click|purchase)/')""",
    "stream_attempt_states": STATE,
    "stream_window_dedup_by_host": _window_dedup(
        "SELECT ord, host, title, url FROM {v_stream}", 10, "host"
    ),
    "stream_window_dedup_table_rows": _window_dedup("SELECT ord, title, url FROM {v_stream}", 100),
    "stream_pages_to_links": _new_links(NEW_ITEMS, "SELECT NULL WHERE false", ""),
    "stream_first_seen_urls": "SELECT DISTINCT url FROM {v_stream}",
    "feeds_to_links": FEEDS_TO_LINKS,
    "feeds_to_links_native": FEEDS_TO_LINKS,
    "documents_to_feed": _new_links(
        f"{NEW_ITEMS} AND page_id % 3 <> 0 AND page_id % 11 <> 0 AND {GOOD_FEED}",
        f"SELECT url FROM ({_from(ANCHOR_ROWS, '(SELECT * FROM {pages} WHERE page_id % 5 = 0)')}) s",
        ", TIMESTAMP '2024-01-20 01:00:00' AS pub_date",
    ),
    "documents_failures": DOCUMENT_FAILURES
    + f"""SELECT url, 'fetch', 'status 404' FROM ({NEW_ITEMS} AND page_id % 3 <> 0 AND page_id % 11 = 0 AND {GOOD_FEED}) p
    UNION ALL SELECT 'http://feeds.example.com/none', 'fetch', 'not fetched'""",
    "stream_documents": DOCUMENT_FAILURES
    + f"""SELECT url, 'fetch', 'status 404' FROM ({NEW_ITEMS} AND page_id % 11 = 0 AND {GOOD_FEED}) p
    UNION ALL SELECT url, 'stored', title FROM ("""
    + _new_links(f"{NEW_ITEMS} AND page_id % 11 <> 0 AND {GOOD_FEED}", "SELECT NULL WHERE false", "")
    + ") l",
    "stream_due_url_ticks": """
        WITH RECURSIVE known AS (SELECT url, min(ts) AS ts FROM {v_attempts} GROUP BY url),
        due AS (
            SELECT url, 1::BIGINT AS attempt, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (5 * ceil(
                       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 18000000000.0)::BIGINT) AS tick
            FROM known
            UNION ALL
            SELECT url, attempt + 1, tick + INTERVAL '1' HOUR * (5 * ceil([1, 1, 2, 3, 5, 8][attempt] * 12 / 5.0)::BIGINT)
            FROM due WHERE attempt < 7)
        SELECT url, tick, attempt FROM due""",
    "chain_from_spec": f"""
        SELECT ord, host, regexp_extract(url, '([^/]*)$', 1) AS title, url FROM ("""
    + _window_dedup(
        "SELECT ord, host, title, url FROM {v_stream} WHERE regexp_matches(url, '/(view|click)/')",
        15,
        "host",
    )
    + ") d",
}

_TEMPLATES["scanner_udtf"] = _TEMPLATES["custom_scanner"]
# Streams that must give what the batch operator gives.
for _name in ("stream_first_seen_exact_urls", "stream_first_seen_resumed"):
    _TEMPLATES[_name] = _TEMPLATES["first_seen_expiring"]

ORACLES: dict[str, str] = {name: oracle(sql).strip() for name, sql in _TEMPLATES.items()}
