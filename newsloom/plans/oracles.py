"""SQL for DuckDB that gives the same rows as the queries of the catalogue.

RE2 has no look-around and its \\b is ASCII; patterns are written for it.
"""

from __future__ import annotations

from html.entities import html5

from ..functions.classify import CATEGORY_TOPIC, DISPOSABLE, TOPIC_WORDS, topic_patterns
from ..functions.text import PAGE_BOILERPLATE
from ..functions.url import TRACKING
from ..schemas import TOPICS

AS_OF = 1_780_142_400
WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(c: str) -> str:
    return trim(f"regexp_replace({c}, '[{WS}]+', ' ', 'g')")


def secs(c: str) -> str:
    return f"CAST(epoch_us({c}) // 1000000 AS BIGINT)"


def lits(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


A = f"(SELECT *, {secs('published_at')} AS at_s FROM articles)"
SCORE = f"""round(log2(coalesce(coverage_count, 1) + 1.0) * 40.0 + coalesce(credibility, 5) * 3.0
  + pow(0.5, greatest(0.0, ({AS_OF} - at_s) / 3600.0) / 12.0) * 45.0 + CASE WHEN topic = 'breaking' THEN 20.0 ELSE 0.0 END, 6)"""
SCORED = f"(SELECT *, {SCORE} AS score FROM {A} WHERE at_s IS NOT NULL)"
DIGEST = f"""(SELECT *, CASE WHEN bucket = 'national' THEN 'national' ELSE 'international' END AS section FROM {A}
  WHERE at_s BETWEEN {AS_OF - 86400} AND {AS_OF + 3600} ORDER BY coverage_count DESC, at_s DESC, id LIMIT 25)"""

# ------------------------------------------------------------------ text helpers


#: Entities that are read as the Unicode character of their name, and those that are read as something plainer.
NAMED = (
    "amp lt gt quot zwj zwnj lrm rlm hellip laquo raquo bull middot deg copy reg trade euro pound yen cent sect para dagger permil prime Prime "
    "times divide minus plusmn frac12 frac14 frac34 hearts rarr larr harr eacute egrave agrave ccedil uuml ouml auml szlig ntilde aacute iacute oacute uacute"
).split()
PLAIN = {"apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "", "wj": chr(0x2060), "ndash": "-", "mdash": " - ", "lsquo": "'", "rsquo": "'", "sbquo": "'", "ldquo": '"', "rdquo": '"', "bdquo": '"'}
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def decode_once(c: str) -> str:
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in ({n: html5[n + ";"] for n in NAMED} | PLAIN).items()) + "}"
    code = "CAST(CASE WHEN lower(p[3]) = 'x' THEN '0x' || p[4:-2] ELSE p[3:-2] END AS BIGINT)"
    shown = f"CASE WHEN {code} <= 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 OR ({code} < 32 AND {code} NOT IN (9, 10)) THEN ' ' ELSE chr(CAST({code} AS INT)) END"
    piece = f"CASE WHEN length(p) < 3 OR p[1] <> '&' THEN p WHEN p[2] = '#' THEN {shown} ELSE coalesce(map_extract({names}, p[2:-2])[1], map_extract({names}, lower(p[2:-2]))[1], p) END"
    return f"array_to_string(list_transform(regexp_extract_all({c}, '{ENTITY}|[^&]+|&'), lambda p: {piece}), '')"


def decode(c: str) -> str:
    """Entities read twice; texts without an ampersand as they are."""
    return f"(CASE WHEN contains({c}, '&') THEN {decode_once(decode_once(c))} ELSE {c} END)"


def strip_tags(c: str) -> str:
    for p in ("(?is)<style[^>]*>.*?</style>", "(?is)<script[^>]*>.*?</script>", "(?s)<!--.*?-->", r"(?i)<br\s*/?>", "(?i)</(?:p|div|li|h[1-6])>", "<[^>]+>"):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return c


def to_text(c: str) -> str:
    return squeeze(decode(strip_tags(f"coalesce({c}, '')")))


def truncate(c: str, n: int) -> str:
    return f"CASE WHEN length(coalesce({c}, '')) = 0 THEN '' WHEN length({c}) <= {n} THEN {c} ELSE {trim(f'left({c}, {n})')} || '…' END"


def strip_letters(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def echo(t: str, c: str) -> str:
    a, b = strip_letters(t), strip_letters(c)
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (starts_with({b}, {a}) AND length({b}) - length({a}) < 12)))"


FEED_BOILERPLATE = [
    r"(?i)(?:account\s+)?subscription benefits[\s\S]*?unlock these with subscription",
    r"(?i)\bunlock these with subscription\b",
    r"(?i)\b(?:to continue reading|continue reading|read more at|sign up (?:to|for)|subscribe (?:to|now)|already a subscriber)\b[^.]*\.?",
    r"(?i)\bthis (?:article|story) (?:first )?appeared (?:first )?on\b[^.]*\.?",
    r"(?i)\bpublished\s*[-–—]\s*\w+\s+\d{1,2},\s*\d{4}\s*[\d:]*\s*(?:am|pm|ist|utc|npt)?\b",
    r"(?i)(?:©|\bcopyright)\s*\d{4}[^.]*\.?",
    r"(?i)\ball rights reserved\.?",
    r"(?i)^\s*(?:shorts news|video|watch|live|premium|exclusive)\s*:\s*",
]


def strip_boilerplate(c: str) -> str:
    for p in FEED_BOILERPLATE:
        c = f"regexp_replace({c}, {q(p)}, ' ', 'g')"
    return squeeze(c)


def unaccent_counts(c: str) -> tuple[str, str, str]:
    return tuple(f"len(regexp_extract_all({c}, '{p}'))" for p in (r"[\x{0900}-\x{097F}]", "[A-Za-z]", r"\p{L}"))


def normal_breaks(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace({trim(c)}, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')"


def words_of(t: str) -> str:
    """The distinct words of a headline, as a list."""
    plain = f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}{WS}]', ' ', 'g')"
    return f"list_distinct(list_filter(regexp_split_to_array({plain}, '[{WS}]+'), lambda w: length(w) >= 3))"


URL = r"^[A-Za-z][A-Za-z0-9+.-]*://"
HOST = f"regexp_replace(lower(regexp_extract(trim(url), '{URL}(?:[^/?#@]*@)?([^/?#]+)', 1)), ':443$', '')"
PATH = f"regexp_replace(regexp_extract(trim(url), '{URL}[^/?#]+([^?#]*)', 1), '/$', '')"
PAIRS = f"list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {lits(TRACKING)})"
NORMAL_URL = f"CASE WHEN {HOST} = '' THEN url ELSE {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN len({PAIRS}) > 0 THEN '?' || array_to_string({PAIRS}, '&') ELSE '' END END"
FINGERPRINT = f"substr(sha256({NORMAL_URL}), 1, 12)"
PUB = """CAST(coalesce(
  epoch_us(try_strptime(regexp_replace(regexp_replace(trim(pub_date), '^[A-Za-z]{3,9},?\\s+', ''), '\\s(GMT|UTC|UT|Z)$', ' +0000'), '%d %b %Y %H:%M:%S %z')),
  epoch_us(try_strptime(regexp_replace(trim(pub_date), 'Z$', '+00:00'), '%Y-%m-%dT%H:%M:%S%z'))) // 1000000 AS BIGINT)"""
URL_DATE = r"""CASE WHEN regexp_matches(url, '/20\d{2}/\d{1,2}/\d{1,2}(?:/|$|-)') THEN
  CAST(epoch_us(make_date(CAST(regexp_extract(url, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$|-)', 1) AS INT), 1, 1)
    + to_months(CAST(regexp_extract(url, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$|-)', 2) AS INT) - 1)
    + to_days(CAST(regexp_extract(url, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$|-)', 3) AS INT) - 1)) // 1000000 + 43200 AS BIGINT) END"""

PAIRS_SQL = f"""
  t AS (SELECT id, at_s, source_id, image_url, {words_of("coalesce(title, '')")} AS words FROM {A} WHERE at_s IS NOT NULL),
  u AS (SELECT * FROM t WHERE len(words) > 0),
  pairs AS (SELECT a.id AS a, b.id AS b, a.at_s AS at_a, b.at_s AS at_b,
      len(list_intersect(a.words, b.words)) * 1.0 / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) AS similarity
    FROM u a JOIN u b ON a.id < b.id AND abs(a.at_s - b.at_s) <= 7200),
  alike AS (SELECT * FROM pairs WHERE similarity >= 0.45)"""
GREEDY_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
  touched AS (SELECT a AS id, at_a AS at_s FROM alike UNION SELECT b, at_b FROM alike),
  numbered AS (SELECT id, row_number() OVER (ORDER BY -at_s, id) AS n FROM touched),
  edges AS (SELECT greatest(x.n, y.n) AS late, list(least(x.n, y.n)) AS early FROM alike JOIN numbered x ON x.id = a JOIN numbered y ON y.id = b GROUP BY 1),
  steps AS (SELECT n, coalesce(early, []) AS early FROM numbered LEFT JOIN edges ON late = n),
  walk(n, kept) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
    UNION ALL
    SELECT steps.n, CASE WHEN list_has_any(early, kept) THEN kept ELSE list_append(kept, steps.n) END FROM walk JOIN steps ON steps.n = walk.n + 1),
  kept AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)),
  owners AS (SELECT p.id, coalesce(o.id, p.id) AS owner FROM numbered p LEFT JOIN (
      SELECT late, min(e) AS first FROM (SELECT late, unnest(early) AS e FROM edges) WHERE e IN (SELECT n FROM kept) AND late NOT IN (SELECT n FROM kept) GROUP BY late) f ON f.late = p.n
    LEFT JOIN numbered o ON o.n = f.first)"""

D_, L_, N_ = unaccent_counts("x")


def _audit(text: str = "summary", least: int = 60, terminal: bool = True) -> str:
    """One row for each finding: id, code, severity. A headline's own text is not held against itself."""
    head = f"regexp_replace(regexp_replace(lower(coalesce(title, '')), '[{WS}]+', ' ', 'g'), '[.!?।…{WS}]+$', '')"
    body = f"regexp_replace(regexp_replace(lower(x), '[{WS}]+', ' ', 'g'), '[.!?।…{WS}]+$', '')"
    dr, lr = f"(CASE WHEN {N_} > 0 THEN {D_} * 1.0 / {N_} ELSE 0.0 END)", f"(CASE WHEN {N_} > 0 THEN {L_} * 1.0 / {N_} ELSE 0.0 END)"
    np_ = "original_lang = 'np'"
    clean = f"regexp_matches(x, '[.!?।…][\"''”’)\\]]?[{WS}]*$')"
    dangling = rf"(?i)\b(?:and|or|but|the|a|an|of|to|in|on|at|for|with|from|by|as|that|which|who|while|after|before|because|however)[{WS}]*[.…]?[{WS}]*$|(?:र|तर|वा|को|का|की|मा|ले|लाई|बाट|सँग|तथा|अनि|जुन|जसले|भन्ने|पछि|अघि)[{WS}]*[।…]?[{WS}]*$"
    preamble = rf"(?i)^[{WS}]*(?:here(?:'s| is| are)\b|sure[,!.]|okay[,!.]|certainly[,!.]|below is\b|the following\b|summary\s*:|translation\s*:|translated text\s*:|output\s*:|\*\*summary\*\*|यहाँ छ|सारांश\s*:|अनुवाद\s*:)"
    refusal = r"(?i)\b(?:i(?:'m| am) (?:sorry|unable|an ai)|as an ai\b|i cannot\b|i can(?:'|no)t (?:provide|translate|summar)|unable to (?:provide|process|translate)|no content (?:was )?provided|insufficient (?:context|information) to)"
    # sentences: a mark before each end, then split at it
    split = f"string_split(regexp_replace(x, '([.!?।])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    long_ = f"list_filter(list_transform({split}, lambda s: regexp_replace(lower({trim('s')}), '[{WS}]+', ' ', 'g')), lambda s: length(s) >= 40)"
    checks = [
        ("x = ''", "'empty'", "fatal"),
        (f"x <> '' AND length(x) < {least}", "'too-short'", "fatal"),
        (f"x <> '' AND NOT {np_} AND {dr} > 0.02", f"CASE WHEN {dr} > 0.5 THEN 'wrong-script' ELSE 'script-mixed' END", "fatal"),
        (f"x <> '' AND {np_} AND {lr} > 0.35", f"CASE WHEN {lr} > 0.7 THEN 'wrong-script' ELSE 'script-mixed' END", "fatal"),
        (f"x <> '' AND {np_} AND {D_} = 0", "'wrong-script'", "fatal"),
        (r"x <> '' AND regexp_matches(x, '\x{FFFD}|[Â-Ã][\x{80}-¿]|â€[“”]|Ã[ -¿]')", "'encoding-artifact'", "fatal"),
        (r"regexp_matches(x, '<\s*/?\s*[a-zA-Z][^>]{0,200}>')", "'markup-leak'", "fatal"),
        (r"regexp_matches(x, '&(?:[a-zA-Z]{2,8}|#\d{1,7}|#x[0-9a-fA-F]{1,6});')", "'entity-leak'", "fatal"),
        (f"regexp_matches(x, {q(preamble)})", "'model-preamble'", "fatal"),
        (f"regexp_matches(x, {q(refusal)})", "'model-refusal'", "fatal"),
        (f"x <> '' AND ({f'NOT {clean}' if terminal else 'false'} OR regexp_matches(x, {q(dangling)}))", "'truncated'", "fatal"),
        (f"len({long_}) <> len(list_distinct({long_}))", "'repetition'", "warn"),
        (f"x <> '' AND {trim(head)} <> '' AND ({trim(body)} = {trim(head)} OR (length({trim(body)}) < length({trim(head)}) * 1.3 AND starts_with({trim(body)}, {trim(head)})))", "'headline-echo'", "fatal"),
    ]
    if text == "title":
        checks.pop()
    src = f"(SELECT *, {trim(f'coalesce({text}, ' + q('') + ')')} AS x FROM articles)"
    return " UNION ALL ".join(f"SELECT id, source_id, {code} AS code, '{sev}' AS severity FROM {src} WHERE {cond}" for cond, code, sev in checks)


def _topic(source: str = "(SELECT id, source_id, lower(coalesce(title, '')) AS t, lower(coalesce(summary, '')) AS b FROM articles)") -> str:
    """(id, found) of rows (id, source_id, t, b) with headline and summary in lower case."""
    cols, order = [], list(TOPIC_WORDS)
    for t, (en, np_) in topic_patterns().items():
        one = lambda c, en=en, np_=np_: f"(CASE WHEN regexp_matches({c}, {q(chr(92) + 'b(?:' + en + ')' + chr(92) + 'b')}) THEN 2 ELSE 0 END + CASE WHEN regexp_matches({c}, {q(np_)}) THEN 2 ELSE 0 END)"
        cols.append(f"{one('t')} * 2 + {one('b')} AS {t}")
    high = f"greatest({', '.join(order)})"
    best = "CASE " + " ".join(f"WHEN {t} = {high} THEN '{t}'" for t in order) + " END"
    mapping = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in CATEGORY_TOPIC.items()) + "}"
    mapped = f"list_filter(list_transform(coalesce(categories, []), lambda c: {mapping}[lower(c)]), lambda m: m IS NOT NULL)[1]"
    inner = f"SELECT a.id, s.categories, {', '.join(cols)} FROM {source} a LEFT JOIN sources s ON s.id = a.source_id"
    return f"SELECT id, CASE WHEN {high} >= 4 THEN {best} ELSE coalesce({mapped}, CASE WHEN {high} > 0 THEN {best} END, 'world') END AS found FROM ({inner})"


AUD, BIL, VER = (f"coalesce(quality.{x}, false)" for x in ("audited", "bilingual", "verified"))
BODY = "coalesce(summary, '') <> ''"
P = {"all": "true", "audited": f"({BODY} AND {AUD})", "bilingual": f"({BODY} AND {AUD} AND {BIL})", "verified": f"({BODY} AND {AUD} AND {BIL} AND {VER})"}
BATCHED = f"(SELECT id, at_s, (row_number() OVER (ORDER BY at_s DESC, id) - 1) // 3 AS batch_no, (row_number() OVER (ORDER BY at_s DESC, id) - 1) % 3 AS place FROM {A} WHERE at_s IS NOT NULL AND enrichment_key IS NULL)"
LAST_BATCH = "(SELECT * FROM article_batches WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC, row_id DESC) = 1)"
EVENTS = f"(SELECT *, {secs('ts')} AS at_s FROM events)"

SQL: dict[str, str] = {
    "rank_stories": f"SELECT id, source_id, topic, at_s, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {SCORED}",
    "trending_top6": f"SELECT id, source_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS rn FROM {SCORED}) ORDER BY CASE WHEN rn > 2 THEN 1 ELSE 0 END, score DESC, id LIMIT 6",
    "ticker_top8": f"SELECT id, topic, coverage_count, at_s FROM {A} WHERE at_s <= {AS_OF} AND {AS_OF} - at_s < 43200 ORDER BY CASE WHEN coalesce(topic = 'breaking' OR coverage_count > 1, false) THEN 0 ELSE 1 END, at_s DESC, id LIMIT 8",
    "digest_pick": f"SELECT id, section, CAST(coverage_count AS BIGINT) AS coverage_count, at_s FROM {DIGEST}",
    "digest_section_counts": f"SELECT section, count(*) AS n FROM {DIGEST} GROUP BY section",
    "related_stories": f"SELECT id, topic FROM {A} WHERE id <> (SELECT id FROM {A} WHERE topic = 'health' ORDER BY at_s DESC NULLS LAST, id LIMIT 1) ORDER BY CASE WHEN topic IS NOT DISTINCT FROM 'health' THEN 0 ELSE 1 END, at_s DESC NULLS LAST, id LIMIT 6",
    "per_source_limit": "SELECT raw_id, source_id FROM raw_stories QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY raw_id) <= 30",
    "diversify_by_source": f"""WITH RECURSIVE best AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS n, id, source_id FROM {SCORED} ORDER BY score DESC, id LIMIT 60),
      walk(pos, pool, id, source_id) AS (
        SELECT CAST(0 AS BIGINT), (SELECT list(struct_pack(n := n, id := id, source_id := source_id) ORDER BY n) FROM best), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
        UNION ALL
        SELECT pos + 1, list_filter(pool, lambda x: x.n <> pick.n), pick.id, pick.source_id FROM (
          SELECT pos, pool, CASE WHEN source_id IS NULL OR pool[1].source_id <> source_id THEN pool[1] ELSE coalesce(list_filter(pool[1:14], lambda x: x.source_id <> source_id)[1], pool[1]) END AS pick FROM walk WHERE len(pool) > 0))
      SELECT pos, id, source_id FROM walk WHERE pos > 0""",
    "feed_page": f"SELECT id, at_s FROM {A} WHERE bucket = 'national' AND at_s IS NOT NULL ORDER BY at_s DESC, id LIMIT 12 OFFSET 24",
    "longest_summary_by_source": "SELECT source_id, id, coalesce(length(summary), 0) AS length FROM articles QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY coalesce(length(summary), 0) DESC, id) = 1",
    "feed_range_bucket": f"SELECT id, at_s, bucket FROM {A} WHERE at_s >= {AS_OF - 30 * 86400} AND bucket = 'international'",
    "feed_search": "SELECT id, source_id FROM articles WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(source_name, '')), 'hospital')",
    "topic_counts": f"SELECT topic, count(*) AS n FROM {A} WHERE at_s >= {AS_OF - 30 * 86400} GROUP BY topic",
    "available_topics": f"SELECT topic, count(*) AS n, CAST(list_position([{', '.join(q(t) for t in TOPICS)}], topic) AS BIGINT) AS place FROM articles WHERE topic IN {lits(TOPICS)} GROUP BY topic",
    "client_items": f"SELECT id, title, source_name, at_s FROM {A} WHERE at_s IS NOT NULL ORDER BY at_s DESC, id LIMIT 1500",
    "source_status": """SELECT s.id AS source_id, CAST(coalesce(f.n, 0) AS BIGINT) AS fetched, CAST(coalesce(k.n, 0) AS BIGINT) AS kept, coalesce(f.n, 0) > 0 AS ok FROM sources s
      LEFT JOIN (SELECT source_id, count(*) AS n FROM raw_stories GROUP BY 1) f ON f.source_id = s.id
      LEFT JOIN (SELECT r.source_id, count(*) AS n FROM raw_stories r JOIN sources x ON x.id = r.source_id WHERE length(title) > 2 AND length(url) > 5 AND (coalesce(url_prefix, '') = '' OR starts_with(url, url_prefix)) GROUP BY 1) k ON k.source_id = s.id
      WHERE s.active AND s.rss_url IS NOT NULL""",
    "source_dim_join": "SELECT country, CAST(priority AS BIGINT) AS priority, count(*) AS n FROM articles a JOIN sources s ON s.id = a.source_id WHERE s.active AND s.rss_url IS NOT NULL GROUP BY 1, 2",
    "valid_stories": "SELECT raw_id, source_id FROM raw_stories r JOIN sources s ON s.id = r.source_id WHERE length(title) > 2 AND length(url) > 5 AND (coalesce(url_prefix, '') = '' OR starts_with(url, url_prefix))",
    "normalized_times": f"SELECT raw_id, CAST(least(coalesce({PUB}, {URL_DATE}, {secs('fetched_at')}), {secs('fetched_at')}) AS BIGINT) AS at_s FROM raw_stories",
    "union_feeds": "SELECT source_id, count(*) AS n, count(DISTINCT u) AS urls FROM (SELECT source_id, url AS u FROM raw_stories UNION ALL SELECT source_id, source_url FROM articles) GROUP BY source_id",
    "dedup_exact": f"SELECT id, raw_id, source_id FROM (SELECT *, {FINGERPRINT} AS id FROM raw_stories) QUALIFY row_number() OVER (PARTITION BY id ORDER BY raw_id) = 1",
    "title_pairs_jaccard": f"WITH {PAIRS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM alike",
    "dedup_greedy": f"{GREEDY_SQL} SELECT t.id FROM t LEFT JOIN owners o ON o.id = t.id WHERE coalesce(o.owner, t.id) = t.id",
    "coverage": f"""{GREEDY_SQL}, own AS (SELECT t.*, coalesce(o.owner, t.id) AS owner FROM t LEFT JOIN owners o ON o.id = t.id),
      firsts AS (SELECT owner, source_id, min((-at_s, id)) AS k FROM own GROUP BY 1, 2),
      outlets AS (SELECT owner, list(source_id ORDER BY k) AS xs FROM firsts GROUP BY 1),
      pics AS (SELECT owner, image_url FROM own WHERE coalesce(image_url, '') <> '' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN id = owner THEN 0 ELSE 1 END, -at_s, id) = 1)
      SELECT t.id, CAST(len(xs) AS BIGINT) AS coverage_count, array_to_string(list_filter(xs, lambda s: s <> t.source_id), ',') AS alternates, pics.image_url
      FROM outlets JOIN t ON t.id = outlets.owner LEFT JOIN pics ON pics.owner = t.id WHERE len(xs) > 1""",
    "excerpts": f"""SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN length(upto) >= 220 THEN {trim('upto')} ELSE {trim('CASE WHEN space > 220 THEN left(head, space) ELSE head END')} || '…' END AS excerpt, length(t) > 400 AS longer FROM (
      SELECT *, regexp_extract(head, '(?s)^(.*[.!?।])[{WS}]', 1) AS upto, CASE WHEN contains(head, ' ') THEN length(head) - instr(reverse(head), ' ') ELSE -1 END AS space FROM (
        SELECT doc_id, {trim('text')} AS t, left({trim('text')}, 400) AS head FROM documents))""",
    "hard_truncate": f"""SELECT doc_id, CASE WHEN length(t) <= 1100 THEN t WHEN length(upto) >= 550 THEN {trim('upto')} ELSE regexp_replace({trim('CASE WHEN space > 550 THEN left(head, space) ELSE head END')}, '[,;:\\-–—]+$', '') || '…' END AS cut FROM (
      SELECT *, regexp_extract(head, '(?s)^(.*[.!?।])(?:[{WS}]|$)', 1) AS upto, CASE WHEN contains(head, ' ') THEN length(head) - instr(reverse(head), ' ') ELSE -1 END AS space FROM (
        SELECT doc_id, {normal_breaks('text')} AS t, left({normal_breaks('text')}, 1100) AS head FROM documents))""",
    "truncate_card": f"SELECT id, {truncate('summary', 155)} AS card FROM articles",
    "word_counts": f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS words,
      CAST(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE greatest(1, floor(len(regexp_split_to_array({trim('text')}, '[{WS}]+')) / 200.0 + 0.5)) END AS BIGINT) AS minutes FROM documents""",
    "paragraph_split": f"""WITH s AS (SELECT doc_id, {trim('text')} AS t, list_filter(list_transform(string_split(regexp_replace({trim('text')}, '([.!?।])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim('x')}), lambda x: x <> '') AS xs FROM documents),
      g AS (SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN [] WHEN length(t) < 280 OR len(xs) <= 1 THEN [t] WHEN len(xs) <= 3 THEN xs ELSE
        list_filter([array_to_string(xs[1:CAST(ceil(len(xs) / 3.0) AS INT)], ' '), array_to_string(xs[CAST(ceil(len(xs) / 3.0) AS INT) + 1:2 * CAST(ceil(len(xs) / 3.0) AS INT)], ' '), array_to_string(xs[2 * CAST(ceil(len(xs) / 3.0) AS INT) + 1:3 * CAST(ceil(len(xs) / 3.0) AS INT)], ' ')], lambda p: p <> '') END AS ps FROM s)
      SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS pos, unnest(ps) AS paragraph FROM g""",
    "html_to_text": f"SELECT raw_id, {to_text('description')} AS text FROM raw_stories",
    "standfirsts": f"""SELECT raw_id, CASE WHEN length(rest) < 40 OR {echo('t', 'rest')} THEN '' ELSE rest END AS standfirst FROM (
      SELECT raw_id, t, CASE WHEN t <> '' AND starts_with(lower(body), lower(t)) THEN regexp_replace(substr(body, length(t) + 1), '^[{WS}.:;,–—-]+', '') ELSE body END AS rest FROM (
        SELECT raw_id, {trim("coalesce(title, '')")} AS t, {strip_boilerplate(trim(to_text('description')))} AS body FROM raw_stories))""",
    "strip_boilerplate": f"SELECT id, {strip_boilerplate('summary')} AS text, regexp_matches(summary, {q(PAGE_BOILERPLATE)}) AS pitch FROM articles WHERE summary IS NOT NULL",
    "title_echo": f"SELECT raw_id, {echo('title', 'd')} AS echo FROM (SELECT raw_id, title, {to_text('description')} AS d FROM raw_stories)",
    "navigation_text": f"SELECT doc_id, (n = 0 OR len(regexp_split_to_array(text, '[{WS}]+')) * 1.0 / greatest(1, n) > 40) AS navigation FROM (SELECT *, len(regexp_extract_all(text, '[.!?।]')) AS n FROM documents)",
    "shown_text": "SELECT id, CASE WHEN original_lang = 'en' OR coalesce(title_translated, '') = '' THEN title ELSE title_translated END AS title, CASE WHEN original_lang = 'en' OR coalesce(title_translated, '') = '' THEN summary ELSE coalesce(summary_translated, '') END AS summary FROM articles",
    "source_monograms": f"""SELECT id, CASE WHEN w[1] IS NULL THEN '?' WHEN w[2] IS NULL THEN upper(left(w[1], 2)) ELSE upper(left(w[1], 1) || left(w[2], 1)) END AS monogram FROM (
      SELECT id, CASE WHEN regexp_matches(w[1], '(?i)^(the|la|le|el)$') THEN w[2:] ELSE w END AS w FROM (
        SELECT id, list_filter(regexp_split_to_array(regexp_replace(name, '[^\\p{{L}}\\p{{N}}{WS}]', ' ', 'g'), '[{WS}]+'), lambda x: x <> '') AS w FROM sources))""",
    "relative_times": f"""SELECT id, CASE WHEN original_lang = 'np' THEN CASE WHEN m < 1 THEN 'भर्खरै' WHEN m < 60 THEN m || ' मिनेट अघि' WHEN m // 60 < 24 THEN m // 60 || ' घण्टा अघि' ELSE m // 1440 || ' दिन अघि' END
      ELSE CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || ' min ago' WHEN m // 60 = 1 THEN '1 hour ago' WHEN m // 60 < 24 THEN m // 60 || ' hours ago' WHEN m // 1440 = 1 THEN 'Yesterday' ELSE m // 1440 || ' days ago' END END AS said
      FROM (SELECT id, original_lang, greatest(0, CAST(floor(({AS_OF} - at_s) / 60.0) AS BIGINT)) AS m FROM {A} WHERE at_s IS NOT NULL)""",
    "published_labels": f"SELECT id, strftime(l, '%b %-d, %Y') || ' • ' || strftime(l, '%H:%M') AS label, strftime(l, '%Y-%m-%d') AS day FROM (SELECT id, make_timestamp((at_s + 20700) * 1000000) AS l FROM {A} WHERE at_s IS NOT NULL)",
    "escaped_titles": "SELECT id, " + ", ".join(f"replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '{a}') AS {n}" for a, n in (("&#39;", "html"), ("&apos;", "xml"))) + " FROM articles",
    "summary_bounds": "SELECT id, length(summary) BETWEEN CASE WHEN original_lang = 'np' THEN 840 ELSE 760 END AND CASE WHEN original_lang = 'np' THEN 1210 ELSE 1100 END AS verbatim FROM articles WHERE summary IS NOT NULL",
    "audit_findings": f"SELECT id, code, severity FROM ({_audit()})",
    "audit_summary": f"SELECT a.source_id, count(*) FILTER (WHERE f.id IS NULL) AS ok, count(*) AS n FROM articles a LEFT JOIN (SELECT DISTINCT id FROM ({_audit()}) WHERE severity = 'fatal') f ON f.id = a.id GROUP BY 1",
    "script_ratio": f"SELECT doc_id, round({D_.replace('(x,', '(text,')} * 1.0 / nullif({N_.replace('(x,', '(text,')}, 0), 6) AS devanagari, round({L_.replace('(x,', '(text,')} * 1.0 / nullif({N_.replace('(x,', '(text,')}, 0), 6) AS latin FROM documents WHERE {N_.replace('(x,', '(text,')} > 0",
    "in_language": f"SELECT doc_id, (length(x) >= 8 AND {D_} + {L_} > 0 AND CASE WHEN lang = 'np' THEN {D_} > {L_} ELSE {L_} > {D_} END) AS ok FROM (SELECT doc_id, lang, {normal_breaks('text')} AS x FROM documents WHERE lang IS NOT NULL)",
    "classify_topic": _topic(),
    "breaking_flag": r"SELECT id, coalesce(regexp_matches(title, '(?i)\b(?:breaking|just in|live updates?|developing)\b|ताजा अपडेट|भर्खरै'), false) AS breaking FROM articles",
    "email_check": f"""SELECT id, CASE WHEN coalesce(e, '') = '' THEN 'empty' WHEN length(e) > 254 THEN 'too-long' WHEN NOT regexp_matches(e, '^[^\\s@,;:<>()\\[\\]\\\\"]+@[^\\s@,;:<>()\\[\\]\\\\".]+(\\.[^\\s@,;:<>()\\[\\]\\\\".]+)+$') THEN 'shape'
      WHEN regexp_extract(e, '@([^@]*)$', 1) IN {lits(DISPOSABLE)} THEN 'disposable' END AS problem, e AS address FROM (SELECT id, lower(trim(email)) AS e FROM subscribers)""",
    "mask_email": "SELECT id, CASE WHEN instr(email, '@') = 0 OR k < 2 THEN '•••' ELSE left(email, 1) || repeat('•', least(k - 2, 5)) || substr(email, k) END AS masked FROM (SELECT id, email, CAST(length(email) - length(regexp_extract(email, '([^@]*)$', 1)) AS INT) AS k FROM subscribers WHERE email IS NOT NULL)",
    "translation_fidelity": f"""WITH t AS (SELECT source_id, summary AS s, summary_translated AS x, CASE WHEN original_lang = 'en' THEN 'np' ELSE 'en' END AS lang,
        list_distinct(regexp_extract_all(translate(summary, '०१२३४५६७८९', '0123456789'), '\\d+(?:[.,]\\d+)*')) AS have, list_distinct(regexp_extract_all(translate(summary_translated, '०१२३४५६७८९', '0123456789'), '\\d+(?:[.,]\\d+)*')) AS got
        FROM articles WHERE summary IS NOT NULL AND summary_translated IS NOT NULL)
      SELECT source_id, count(*) AS n, round(avg(CASE WHEN len(have) = 0 THEN 1.0 ELSE len(list_intersect(have, got)) * 1.0 / len(have) END), 6) AS numbers_kept,
        round(avg(CASE WHEN {N_} = 0 THEN 0.0 ELSE CASE WHEN lang = 'np' THEN {D_} ELSE {L_} END * 1.0 / {N_} END), 6) AS script_share, round(avg(CASE WHEN length(s) > 0 THEN length(x) * 1.0 / length(s) END), 6) AS length_ratio FROM t GROUP BY 1""",
    "normalize_url": f"SELECT raw_id, {NORMAL_URL} AS u FROM raw_stories",
    "fingerprint_url": f"SELECT raw_id, {FINGERPRINT} AS fingerprint FROM raw_stories",
    "parsed_dates": f"SELECT raw_id, {PUB} AS at_s FROM raw_stories",
    "url_dates": f"SELECT raw_id, {URL_DATE} AS at_s FROM raw_stories",
    "clean_images": r"SELECT raw_id, CASE WHEN regexp_matches(trim(image_url), '(?i)^https://[^/?#\s]+') AND NOT regexp_matches(regexp_extract(trim(image_url), '^https://[^/?#]+([^?#]*)', 1), '(?i)\b(?:1x1|pixel|spacer|blank)\b') THEN trim(image_url) END AS image_url FROM raw_stories",
    "image_host_allowed": "SELECT raw_id, (h <> '' AND (ends_with(h, '.kelor-wire.example') OR h = 'img.sulek-times.example')) AS ok FROM (SELECT raw_id, lower(regexp_extract(image_url, '^https://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM raw_stories WHERE image_url IS NOT NULL)",
    "publish_gate": "SELECT id, " + ", ".join(f"{v} AS p_{k}" for k, v in P.items()) + " FROM articles",
    "gate_reasons": f"SELECT CASE WHEN NOT {BODY} THEN 'no body text' WHEN NOT {AUD} THEN 'not audited' WHEN NOT {BIL} THEN 'not bilingual' WHEN quality.verified IS NOT DISTINCT FROM false THEN 'failed verification' ELSE 'not yet verified' END AS reason, count(*) AS n FROM articles WHERE NOT {P['verified']} GROUP BY 1",
    "preview_policies": " UNION ALL ".join(f"SELECT '{k}' AS policy, count(*) FILTER (WHERE {v}) AS n FROM articles" for k, v in P.items()),
    "archive_upsert": f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.title ELSE a.title END AS title, a.title_translated, a.enrichment_key, CAST(CASE WHEN b.id IS NOT NULL THEN b.coverage_count ELSE a.coverage_count END AS BIGINT) AS coverage_count,
      CASE WHEN a.id IS NULL THEN {secs('b.arrived_at')} ELSE {secs('a.first_seen_at')} END AS first_s, CASE WHEN b.id IS NOT NULL THEN {secs('b.arrived_at')} ELSE {secs('a.last_seen_at')} END AS last_s FROM articles a FULL JOIN {LAST_BATCH} b ON a.id = b.id""",
    "split_for_write": "SELECT CASE WHEN coalesce(enrichment_key, '') <> '' THEN 'enriched' ELSE 'core' END AS kind, count(*) AS n FROM articles GROUP BY 1",
    "read_stories": f"""SELECT id, CASE WHEN bucket = 'international' THEN bucket ELSE 'national' END AS bucket, CASE WHEN original_lang = 'en' THEN 'en' ELSE 'np' END AS original_lang, CASE WHEN topic IN {lits(TOPICS)} THEN topic ELSE 'society' END AS topic,
      CAST(coalesce(credibility, 5) AS BIGINT) AS credibility, CAST(greatest(1, coalesce(coverage_count, 1)) AS BIGINT) AS coverage_count, coalesce({secs('published_at')}, {secs('first_seen_at')}, 0) AS at_s, CASE WHEN len(alternate_source_ids) > 0 THEN array_to_string(alternate_source_ids, ',') END AS alternates FROM articles""",
    "hydrate_hits": """WITH p AS (SELECT b.row_id, b.id, CASE WHEN b.row_id % 3 = 0 THEN a.enrichment_key || 'x' ELSE a.enrichment_key END AS k FROM article_batches b JOIN articles a ON a.id = b.id)
      SELECT row_id, CASE WHEN a.id IS NULL THEN 'pending' ELSE 'hit' END AS kind FROM p LEFT JOIN articles a ON a.id = p.id AND a.enrichment_key = p.k""",
    "live_or_archive": """SELECT origin, source_id, count(*) AS n FROM (SELECT id, min(source_id) AS source_id, 'live' AS origin FROM article_batches WHERE id IS NOT NULL GROUP BY id
      UNION ALL SELECT id, source_id, 'archive' FROM articles WHERE id NOT IN (SELECT id FROM article_batches WHERE id IS NOT NULL)) GROUP BY 1, 2""",
    "by_ids": "SELECT id, source_id FROM articles WHERE id IN (SELECT id FROM article_batches WHERE regexp_matches(id, '(?i)^[0-9a-f]{6,64}$'))",
    "archive_shares": " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER (WHERE {v}) AS n, CAST(floor(count(*) FILTER (WHERE {v}) * 100.0 / count(*) + 0.5) AS BIGINT) AS share FROM articles" for k, v in {"rows": "true", "summary": "coalesce(summary, '') <> ''", "image": "coalesce(image_url, '') <> ''", "translated": "coalesce(title_translated, '') <> '' AND coalesce(summary_translated, '') <> ''", "dated": "published_at IS NOT NULL", "covered twice": "coalesce(coverage_count, 1) > 1"}.items()),
    "sample_for_trial": "SELECT id FROM articles WHERE original_lang = 'np' AND length(summary) > 400 AND length(summary) < 1600 ORDER BY last_seen_at DESC, id LIMIT 50",
    "enrich_route": f"""SELECT CASE WHEN coalesce(summary, '') = '' OR regexp_matches(summary, {q(PAGE_BOILERPLATE)}) THEN 'blank' WHEN coalesce(enrichment_key, id || ':new') IN (SELECT enrichment_key FROM articles WHERE quality IS NOT NULL AND enrichment_key IS NOT NULL) THEN 'cached' ELSE 'pending' END AS route, count(*) AS n FROM articles GROUP BY 1""",
    "batch_assign": f"SELECT id, batch_no, place FROM {BATCHED}",
    "batch_cap": f"SELECT batch_no, count(*) AS n FROM {BATCHED} WHERE batch_no < least(40, 200000 // 8500) GROUP BY 1",
    "reply_pairing": """WITH b AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 3 AS batch_no, (row_number() OVER (ORDER BY id) - 1) % 3 AS place FROM articles WHERE original_lang = 'np')
      SELECT batch_no, id, CASE WHEN place = 0 AND batch_no % 5 = 0 THEN NULL ELSE 'reply to ' || id END AS reply FROM b""",
    "merge_verdicts": """SELECT id, CASE WHEN coverage_count > 1 THEN (length(title) % 2 = 0) AND length(title) % 3 <> 0 ELSE quality.verified END AS verified, CASE WHEN coverage_count > 1 AND length(title) % 3 = 0 THEN false ELSE quality.bilingual END AS bilingual,
      (NOT (coalesce(coverage_count, 0) > 1 AND length(title) % 3 = 0) AND coalesce(title_translated, '') <> '') AS translated FROM articles WHERE quality IS NOT NULL""",
    "pages_joined": f"""SELECT raw_id, length(CASE WHEN length(p.text) > length(coalesce(description, '')) AND NOT regexp_matches(p.text, {q(PAGE_BOILERPLATE)}) THEN p.text ELSE description END) AS length, coalesce(r.image_url, p.image_url) AS image_url
      FROM raw_stories r LEFT JOIN (SELECT source_url, summary AS text, image_url FROM articles QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY id) = 1) p ON p.source_url = r.url""",
    "archive_violations": f"""SELECT rule, key, count(*) AS n FROM (
      SELECT 'not_null:title' AS rule, id AS key FROM articles WHERE title IS NULL UNION ALL SELECT 'not_null:published_at', id FROM articles WHERE published_at IS NULL UNION ALL SELECT 'not_null:topic', id FROM articles WHERE topic IS NULL
      UNION ALL SELECT 'one_of:topic', id FROM articles WHERE topic NOT IN {lits(TOPICS)} UNION ALL SELECT 'one_of:bucket', id FROM articles WHERE bucket NOT IN ('national', 'international') UNION ALL SELECT 'one_of:original_lang', id FROM articles WHERE original_lang NOT IN ('en', 'np')
      UNION ALL SELECT 'refers:source_id', id FROM articles WHERE source_id NOT IN (SELECT id FROM sources)) GROUP BY 1, 2
      UNION ALL SELECT 'unique', id, count(*) FROM articles GROUP BY id HAVING count(*) > 1""",
    "subscriber_lookup": "SELECT id, status FROM subscribers WHERE lower(trim(email)) IN (SELECT lower(trim(upper(email))) FROM subscribers WHERE id % 7 = 0)",
    "subscriber_state": "WITH e AS (SELECT * FROM subscription_events QUALIFY row_number() OVER (PARTITION BY subscriber_id, event, \"at\" ORDER BY id) = 1) SELECT subscriber_id, max_by(event, (\"at\", id)) AS event, count(*) AS n FROM e GROUP BY 1",
    "event_details": "SELECT event, detail ->> '$.lang' AS detail_lang, detail ->> '$.via' AS detail_via, count(*) AS n FROM subscription_events GROUP BY 1, 2, 3",
    "claim_recipients": "SELECT id, language FROM subscribers s WHERE status = 'confirmed' AND NOT EXISTS (SELECT 1 FROM digest_deliveries d WHERE d.subscriber_id = s.id AND digest_date = DATE '2026-05-20' AND (d.status = 'sent' OR (d.status = 'sending' AND epoch_us(attempted_at) > epoch_us(TIMESTAMP '2026-05-20 00:45:00'))))",
    "delivery_counts": "SELECT CAST(digest_date AS VARCHAR) AS day, status, count(*) AS n FROM digest_deliveries GROUP BY 1, 2",
    "mark_delivery": "SELECT CASE WHEN status = 'sending' THEN 'failed' ELSE status END AS status, count(*) AS n FROM digest_deliveries GROUP BY 1",
    "sliding_rate": f"""SELECT event_id, n AS in_window, CASE WHEN n > 2 THEN 3600 - (at_s - first) ELSE 0 END AS wait_s FROM (SELECT event_id, at_s, count(*) OVER w AS n, min(at_s) OVER w AS first FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW))""",
    "fixed_window_limit": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, at_s, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS k FROM {EVENTS}),
      walk AS (SELECT user_id, event_id, at_s, k, at_s AS start, CAST(1 AS BIGINT) AS n FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.at_s, e.k, CASE WHEN e.at_s - start >= 21600 THEN e.at_s ELSE start END, CASE WHEN e.at_s - start >= 21600 THEN 1 ELSE n + 1 END FROM walk JOIN e ON e.user_id = walk.user_id AND e.k = walk.k + 1)
      SELECT user_id, event_id, n, n <= 2 AS allowed, CASE WHEN n > 2 THEN greatest(1, start + 21600 - at_s) ELSE 0 END AS retry_s FROM walk""",
    "daily_ledger": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(coalesce(value, 0.0)), 4) AS spent, round(greatest(0.0, 20000.0 - sum(coalesce(value, 0.0))), 4) AS \"left\" FROM events GROUP BY 1, 2",
    "running_spend": "SELECT event_id, round(sum(coalesce(value, 0.0)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent_so_far FROM events",
    "ewma_cost": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list_reduce(list_prepend(CAST(8500.0 AS DOUBLE), list(CAST(round(value * 100) AS DOUBLE) ORDER BY event_id)), lambda a, x: floor(a * CAST(0.7 AS DOUBLE) + x * CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE)))::BIGINT AS cost, count(*) AS n FROM events WHERE round(value * 100) > 0 GROUP BY 1",
    "local_day_counts": f"SELECT strftime(make_timestamp((at_s + 20700) * 1000000), '%Y-%m-%d') AS day, count(*) AS n FROM {EVENTS} GROUP BY 1",
    "refusal_cooldowns": """SELECT event_id, CAST(CASE WHEN event_id % 4 = 2 AND event_id % 90 > 0 THEN greatest(30.0, event_id % 90) WHEN event_id % 4 = 1 THEN 1800.0 WHEN event_id % 4 = 0 THEN greatest(30.0, (event_id % 7) * 60 + 20) ELSE 30.0 END AS DOUBLE) AS wait_s,
      CASE WHEN event_id % 4 = 0 THEN event_id END AS used FROM events""",
    "stream_tumbling_counts": "SELECT CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding_counts": f"SELECT CAST(start_s AS BIGINT) AS start_s, count(*) AS n FROM (SELECT unnest([(at_s // 21600) * 21600, (at_s // 21600) * 21600 - 21600]) AS start_s FROM {EVENTS}) GROUP BY 1",
    "stream_dedup_ids": "SELECT DISTINCT event_id FROM events",
    "stream_upsert": f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.title ELSE a.title END AS title, a.title_translated,
      CASE WHEN a.id IS NULL THEN {secs('b.arrived_at')} ELSE {secs('a.first_seen_at')} END AS first_s, CASE WHEN b.id IS NOT NULL THEN {secs('b.arrived_at')} ELSE {secs('a.last_seen_at')} END AS last_s FROM articles a FULL JOIN {LAST_BATCH} b ON a.id = b.id""",
    "news_sitemap": f"""SELECT id, '<url><loc>https://news.example/story/' || id || '</loc><news:news><news:publication><news:name>News</news:name><news:language>' || CASE WHEN original_lang = 'np' THEN 'ne' ELSE original_lang END || '</news:language></news:publication><news:publication_date>' || strftime(make_timestamp(at_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') || '</news:publication_date><news:title>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</news:title></news:news></url>' AS entry
      FROM {A} WHERE at_s <= {AS_OF} AND at_s >= {AS_OF - 48 * 3600} ORDER BY at_s DESC, id LIMIT 1000""",
    "sitemap": f"SELECT 'https://news.example/story/' || id AS loc, at_s AS changed_s FROM {A} WHERE at_s IS NOT NULL ORDER BY at_s DESC, id LIMIT 2000",
    "structured_data": "SELECT id, title AS headline, source_name AS publisher FROM articles",
    "digest_lines": f"SELECT section, id, title || ' — ' || source_name || CASE WHEN coverage_count > 1 THEN ' (' || coverage_count || ' outlets)' ELSE '' END || chr(10) || {truncate(chr(39) * 2 + ' || coalesce(summary, ' + chr(39) * 2 + ')', 220)} || chr(10) || 'https://news.example/story/' || id AS line FROM {DIGEST}",
    "stream_first_hits": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, at_s, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS k FROM {EVENTS}),
      walk AS (SELECT user_id, at_s, k, at_s AS start, 1 AS n FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.at_s, e.k, CASE WHEN e.at_s - start >= 21600 THEN e.at_s ELSE start END, CASE WHEN e.at_s - start >= 21600 THEN 1 ELSE n + 1 END FROM walk JOIN e ON e.user_id = walk.user_id AND e.k = walk.k + 1)
      SELECT user_id, CAST(count(*) FILTER (WHERE n <= 2) AS BIGINT) AS allowed, CAST(count(*) FILTER (WHERE n > 2) AS BIGINT) AS denied FROM walk GROUP BY 1""",
    "xml_feed_parse": f"SELECT raw_id, {to_text('title')} AS title, trim(url) AS url, substr({to_text('description')}, 1, 2200) AS description FROM raw_stories WHERE length({to_text('title')}) > 2 AND length(trim(url)) > 5",
    "token_checks": """SELECT id, id % 4 = 3 AS ok, CASE WHEN id % 4 = 3 THEN lower(trim(email)) END AS email, CASE id % 4 WHEN 0 THEN 'signature' WHEN 1 THEN 'malformed' WHEN 2 THEN 'expired' END AS reason FROM subscribers WHERE email IS NOT NULL AND requested_at IS NOT NULL""",
    "recent_stories": f"SELECT id, at_s FROM {A} WHERE at_s BETWEEN {AS_OF - 72 * 3600} AND {AS_OF + 3600} ORDER BY at_s DESC, id LIMIT 300",
    "page_meta": f"SELECT id, CAST(2 + CASE WHEN coalesce(image_url, '') <> '' THEN 1 ELSE 0 END - CASE WHEN coalesce(title, '') = '' THEN 1 ELSE 0 END AS BIGINT) AS tags, {squeeze("coalesce(title, '')")} AS title FROM articles WHERE summary <> ''",
}

_IN, _OUT = (b"secret".ljust(64, b"\0") for _ in range(2))


def _blob(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


_PAYLOAD = """translate(rtrim(base64(encode('{"e":"' || lower(trim(email)) || '","k":"confirm","t":' || t || '}')), '='), '+/', '-_')"""
SQL["signed_tokens"] = f"""SELECT id, p || '.' || translate(rtrim(base64(unhex(sha256({_blob(bytes(x ^ 0x5C for x in _OUT))} || unhex(sha256({_blob(bytes(x ^ 0x36 for x in _IN))} || encode(p)))))), '='), '+/', '-_') AS token
  FROM (SELECT id, {_PAYLOAD} AS p FROM (SELECT id, email, {secs('requested_at')} AS t FROM subscribers WHERE email IS NOT NULL AND requested_at IS NOT NULL))"""

_STANDFIRST = f"""(SELECT *, CASE WHEN length(rest) < 40 OR {echo('t', 'rest')} THEN '' ELSE rest END AS summary FROM (
  SELECT *, CASE WHEN t <> '' AND starts_with(lower(b), lower(t)) THEN regexp_replace(substr(b, length(t) + 1), '^[{WS}.:;,–—-]+', '') ELSE b END AS rest FROM (
    SELECT *, {trim('title')} AS t, {strip_boilerplate(trim('body'))} AS b FROM (SELECT raw_id, source_id, url, image_url, fetched_at, pub_date, {to_text('title')} AS title, {to_text('description')} AS body FROM raw_stories))))"""
SQL["normalize_stories"] = f"""WITH n AS (SELECT *, {secs('fetched_at')} AS now_s, CAST(least(coalesce({PUB}, {URL_DATE}, {secs('fetched_at')}), {secs('fetched_at')}) AS BIGINT) AS at_s FROM {_STANDFIRST}),
  k AS ({_topic('(SELECT raw_id AS id, source_id, lower(title) AS t, lower(summary) AS b FROM n)')})
  SELECT n.raw_id, {FINGERPRINT.replace('url', 'n.url')} AS id, s.bucket, n.title, n.summary,
    CASE WHEN now_s - at_s < 10800 AND regexp_matches(n.title, '(?i)\\b(?:breaking|just in|live updates?|developing)\\b|ताजा अपडेट|भर्खरै') THEN 'breaking' ELSE k.found END AS topic,
    {SQL["clean_images"].removeprefix("SELECT raw_id, ").removesuffix(" AS image_url FROM raw_stories").replace("image_url", "n.image_url")} AS image_url, at_s, CAST(coalesce(s.credibility_score, 5) AS BIGINT) AS credibility
  FROM n JOIN sources s ON s.id = n.source_id JOIN k ON k.id = n.raw_id"""


def _cap(most: int) -> str:
    t = normal_breaks("summary")
    upto = f"regexp_extract(left({t}, {most}), '(?s)^(.*[.!?।])(?:[{WS}]|$)', 1)"
    head = f"left({t}, {most})"
    space = f"(CASE WHEN contains({head}, ' ') THEN length({head}) - instr(reverse({head}), ' ') ELSE -1 END)"
    safe = trim(f"CASE WHEN {space} > {most // 2} THEN left({head}, {space}) ELSE {head} END")
    return f"CASE WHEN length({t}) <= {most} THEN {t} WHEN length({upto}) >= {most // 2} THEN {trim(upto)} ELSE regexp_replace({safe}, '[,;:\\-–—]+$', '') || '…' END"


SQL["cap_summaries"] = f"SELECT id, CASE WHEN coalesce(enrichment_key, '') <> '' THEN summary WHEN original_lang = 'np' THEN {_cap(1210)} ELSE {_cap(1100)} END AS summary FROM articles"
SQL["audit_stories"] = f"""SELECT a.id, count(*) FILTER (WHERE severity = 'fatal') = 0 AS ok, count(code) AS n FROM articles a
  LEFT JOIN (SELECT * FROM ({_audit()}) UNION ALL SELECT * FROM ({_audit("title", 10, False)})) f ON f.id = a.id GROUP BY 1"""

# FNV-1a over UTF-16 units
SQL["content_keys"] = """WITH h AS (SELECT id, list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(flatten(list_transform(string_split(title, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN [55296 + (unicode(x) - 65536) // 1024, 56320 + (unicode(x) - 65536) % 1024] ELSE [unicode(x)] END)), lambda c: CAST(c AS UBIGINT))), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM articles WHERE title IS NOT NULL)
  SELECT id, id || ':' || lower(to_base(CAST(h AS BIGINT), 36)) AS key FROM h"""
SQL["page_paragraphs"] = f"""SELECT id, CASE WHEN length(p) >= 120 AND n > 0 AND len(regexp_split_to_array(p, '[{WS}]+')) * 1.0 / greatest(1, n) <= 40 AND NOT regexp_matches(p, {q(PAGE_BOILERPLATE)}) THEN p ELSE '' END AS text FROM (
  SELECT id, p, len(regexp_extract_all(p, '[.!?।]')) AS n FROM (
    SELECT id, regexp_replace({squeeze(decode_once("summary"))}, '(?i)^(?:shares?|tweet|share this|follow us|advertisement|listen to this article)[{WS}]+', '') AS p FROM articles WHERE summary <> ''))"""

_ONE_READER = "(SELECT * FROM subscribers WHERE email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY id) = 1)"
SQL["subscriber_upsert"] = f"""WITH r AS (SELECT *, lower(trim(email)) AS e, {secs('requested_at')} AS s FROM {_ONE_READER}),
  raw AS (SELECT *, {secs('requested_at')} AS s FROM subscribers WHERE email IS NOT NULL AND requested_at IS NOT NULL),
  q AS (SELECT lower(trim(email)) AS e, id, 'np' AS lang, s FROM raw WHERE id % 5 = 0
    UNION ALL SELECT lower(trim(email)), id, 'en', s + 3600 FROM raw WHERE id % 10 = 0
    UNION ALL SELECT lower(trim('New.' || email)), id + 1000000000, CASE WHEN language = 'np' THEN 'np' ELSE 'en' END, s FROM raw WHERE id % 5 = 1),
  last AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY e ORDER BY s DESC, id DESC) = 1),
  first AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY e ORDER BY s, id) = 1)
  SELECT r.id, r.e AS email, coalesce(l.lang, r.language) AS language, r.status, coalesce(l.s, r.s) AS at_s FROM r LEFT JOIN last l ON l.e = r.e
  UNION ALL SELECT f.id, f.e, l.lang, 'pending', l.s FROM first f JOIN last l ON l.e = f.e WHERE f.e NOT IN (SELECT e FROM r)"""
SQL["confirm_subscribers"] = f"""SELECT id, lower(trim(email)) AS email, CASE WHEN id % 3 = 0 THEN 'confirmed' ELSE status END AS status,
    CASE WHEN id % 3 = 0 AND status IS DISTINCT FROM 'confirmed' THEN {AS_OF} ELSE {secs('confirmed_at')} END AS confirmed_s,
    CASE WHEN id % 3 = 0 AND status IS DISTINCT FROM 'confirmed' THEN NULL ELSE {secs('unsubscribed_at')} END AS left_s FROM {_ONE_READER}
  UNION ALL SELECT id + 1000000000, lower(trim('late.' || email)), 'confirmed', {AS_OF}, NULL FROM {_ONE_READER} WHERE id % 7 = 0"""
SQL["unsubscribe_readers"] = f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'unsubscribed' ELSE status END AS status, CASE WHEN id % 4 = 0 AND status IS DISTINCT FROM 'unsubscribed' THEN {AS_OF} ELSE {secs('unsubscribed_at')} END AS left_s FROM {_ONE_READER}"""
SQL["event_log"] = f"""SELECT id, subscriber_id, event, {secs('"at"')} AS at_s, detail FROM subscription_events
  UNION ALL SELECT (SELECT max(id) FROM subscription_events) + row_number() OVER (ORDER BY i), i, 'confirmed', {AS_OF}, d FROM (
    SELECT id AS i, '{{}}' AS d FROM {_ONE_READER} WHERE id % 3 = 0 AND status IS DISTINCT FROM 'confirmed' UNION ALL SELECT id + 1000000000, '{{"backfilled":true}}' FROM {_ONE_READER} WHERE id % 7 = 0)"""
_CLAIMED = f"(SELECT s.* FROM subscribers s JOIN ({SQL['claim_recipients']}) c ON c.id = s.id WHERE s.id % 11 <> 0 ORDER BY s.id LIMIT 25)"
SQL["claim_lease"] = f"SELECT id, email, language FROM {_CLAIMED}"
SQL["claim_ledger"] = f"""SELECT CAST(digest_date AS VARCHAR) AS day, subscriber_id, status, {secs('attempted_at')} AS at_s, error FROM digest_deliveries
    WHERE NOT (digest_date = DATE '2026-05-20' AND subscriber_id IN (SELECT id FROM {_CLAIMED}))
  UNION ALL SELECT '2026-05-20', id, 'sending', CAST(epoch(TIMESTAMP '2026-05-20 01:00:00') AS BIGINT), NULL FROM {_CLAIMED}"""
SQL["delivered_to"] = "SELECT d.status, s.language, count(*) AS n, count(DISTINCT s.email) AS readers FROM digest_deliveries d JOIN subscribers s ON s.id = d.subscriber_id GROUP BY 1, 2"
SQL["ok_sources"] = "SELECT count(*) FILTER (WHERE id IN (SELECT source_id FROM raw_stories)) AS ok, count(*) AS n FROM sources WHERE active AND rss_url IS NOT NULL"
SQL["sources_by_priority"] = "SELECT id, CAST(priority AS BIGINT) AS priority, row_number() OVER (ORDER BY priority DESC NULLS LAST, id) - 1 AS place FROM sources WHERE active AND rss_url IS NOT NULL"
SQL["topic_filter"] = "SELECT t AS topic, count(*) FILTER (WHERE t = 'all' OR topic = t) AS n FROM articles, (VALUES ('all'), ('sports'), ('weather')) v(t) GROUP BY 1"
SQL["with_summary"] = "SELECT id, bucket FROM articles WHERE length(summary) > 0"
_NAMES = [("breaking", "Breaking", "ताजा"), ("politics", "Politics", "राजनीति"), ("world", "World", "विश्व"), ("business", "Business", "अर्थतन्त्र"), ("sports", "Sports", "खेलकुद"), ("technology", "Tech", "प्रविधि"), ("health", "Health", "स्वास्थ्य"), ("environment", "Environment", "वातावरण"), ("society", "Society", "समाज")]
SQL["topic_labels"] = "SELECT id, CASE topic " + " ".join(f"WHEN '{t}' THEN '{e}'" for t, e, _ in _NAMES) + " END AS en, CASE topic " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, _, n in _NAMES) + " END AS np, CASE WHEN original_lang = 'np' THEN 'ne' ELSE 'en' END AS attr, CASE WHEN original_lang = 'np' THEN 'Nepali' ELSE 'English' END AS lang FROM articles"
SQL["reader_languages"] = "SELECT CASE WHEN language = 'np' THEN 'np' ELSE 'en' END AS lang, count(*) AS n FROM subscribers GROUP BY 1"
SQL["publish_share"] = f"SELECT p.policy, t.n, p.n AS kept, t.n > 0 AND p.n < t.n * 0.25 AS warn FROM ({SQL['preview_policies']}) p, (SELECT count(*) AS n FROM articles) t"
SQL["verify_candidates"] = "SELECT id FROM articles WHERE quality.bilingual AND summary_translated <> '' AND quality.verified IS NULL"
SQL["carry_verdicts"] = "SELECT id, CASE WHEN quality.audited THEN true END AS audited, CASE WHEN quality.audited THEN quality.verified END AS verified, CASE WHEN quality.audited AND quality.verified IS NOT NULL THEN quality.note END AS note FROM articles"
SQL["default_verdicts"] = "SELECT id, CASE WHEN quality IS NULL THEN true ELSE quality.audited END AS audited, CASE WHEN quality IS NULL THEN coalesce(summary_translated, '') <> '' ELSE quality.bilingual END AS bilingual, quality.verified AS verified FROM articles"
SQL["names_kept"] = """SELECT id, CASE WHEN original_lang = 'en' THEN CASE WHEN len(w) = 0 THEN 1.0 ELSE round(len(list_filter(w, lambda x: contains(summary_translated, x))) * 1.0 / len(w), 6) END END AS kept
  FROM (SELECT *, list_distinct(regexp_extract_all(summary, '\\b([A-Z][a-z]{2,})\\b', 1)) AS w FROM articles WHERE summary IS NOT NULL AND summary_translated IS NOT NULL)"""
SQL["write_counters"] = "SELECT count(*) AS rows, count(*) FILTER (WHERE summary_translated <> '') AS translated, count(image_url) AS pictured FROM articles"
SQL["never_lower"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, greatest(count(*), coalesce(max(event_id) FILTER (WHERE event_id % 50 = 0), 0)) AS spent FROM events GROUP BY 1"
SQL["stream_without_alike"] = SQL["dedup_greedy"].replace("ORDER BY -at_s, id", "ORDER BY at_s, id")
# which account of a page is taken: structured data if there is any, the page's paragraphs, its description
_PAGE = f"""(SELECT a.id, CASE WHEN coverage_count > 1 THEN 2 * length(summary) + 1 ELSE 0 END AS ld, length({squeeze(decode(strip_tags(decode_once("left(summary, 140)"))))}) AS m, length(p.text) AS p,
    coalesce(regexp_matches(trim(image_url), '^(?:https:)?//[^/]+'), false) AS image FROM articles a JOIN ({SQL['page_paragraphs']}) p ON p.id = a.id WHERE summary <> '')"""
SQL["parse_pages"] = f"""SELECT CASE WHEN ld >= 600 THEN 'jsonld' WHEN p >= 120 AND p > CASE WHEN ld >= 120 THEN ld WHEN m >= 120 THEN m ELSE 0 END THEN 'paragraphs' WHEN ld >= 120 THEN 'jsonld' WHEN m >= 120 THEN 'meta' ELSE 'og' END AS via,
    count(*) AS n, count(*) FILTER (WHERE image) AS images FROM {_PAGE} WHERE greatest(ld, m, p) >= 60 OR image GROUP BY 1"""
# the stand-in gives the text back as its own translation, which is in the wrong script and never passes
SQL["enrich_stub"] = "SELECT source_id, CAST(0 AS BIGINT) AS translated, count(*) AS n FROM articles WHERE original_lang = 'en' GROUP BY 1"
