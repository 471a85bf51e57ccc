"""SQL for DuckDB that cuts texts as the chunkers do: a recursive CTE takes the parts of all texts one after the other."""

from __future__ import annotations

from .views import oracle


def recursive(sql: str) -> str:
    """The query for DuckDB, with views; its CTEs may read themselves."""
    return oracle("WITH " + sql).replace("WITH ", "WITH RECURSIVE ", 1)


#: Stands in the SQL where a text is cut.
CUT = "chr(1)"
NAME = r"[A-Z][A-Za-z\s]+:"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def flat(text: str) -> str:
    return stripped(rf"regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g')")


def sentences(text: str, more: str = "") -> str:
    """A list: cut after . ! ? where blanks and a capital (or one of `more`) follow."""
    return rf"list_filter(string_split(regexp_replace({stripped(text)}, '([.!?])\s+([A-Z{more}])', '\1' || {CUT} || '\2', 'g'), {CUT}), lambda x: x <> '')"


def by_sentence(text: str) -> str:
    """A list: cut after . ! ? and blanks."""
    return rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || {CUT}, 'g'), {CUT})"


def numbered(name: str, source: str, parts: str, key: str = "id") -> str:
    """CTE `name` (key, k from 1, p): the parts of each row's list."""
    return f"{name} AS (SELECT {key}, CAST(k AS BIGINT) AS k, p FROM (SELECT {key}, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT {key}, {parts} AS l FROM {source})))"


def packed(name: str, parts: str, size: str, head: str = "''", counted: int = 1, key: str = "id") -> str:
    """CTE `name` (key, k, c): chunks of the parts of `parts` in their order (k grows). head: what a chunk repeats of `cur`, the one before; counted: what a blank counts for; size may use the key."""
    on = " AND ".join(f"t.{c} = s.{c}" for c in key.split(", "))
    keys = ", ".join(f"s.{c}" for c in key.split(", "))
    begun = f"CASE WHEN h = '' THEN p ELSE h || ' ' || p END"
    length = f"length(p) + CASE WHEN h = '' THEN 0 ELSE length(h) + {counted} END"
    return f"""{name}_s AS (SELECT {key}, k, p AS cur, CAST(length(p) AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS c FROM {parts} WHERE k = 1
UNION ALL SELECT {key}, k, CASE WHEN fits THEN cur || ' ' || p ELSE {begun} END, CAST(CASE WHEN fits THEN n + length(p) + {counted} ELSE {length} END AS BIGINT), CASE WHEN NOT fits THEN cur END
FROM (SELECT {keys}, t.k, t.p, s.cur, s.n, s.n + length(t.p) + {counted} <= {size} AS fits, {head} AS h FROM {name}_s s JOIN {parts} t ON {on} AND t.k = s.k + 1)),
{name} AS (SELECT {key}, 2 * k - 1 AS k, c FROM {name}_s WHERE c IS NOT NULL UNION ALL SELECT {key}, 2 * max(k), max_by(cur, k) FROM {name}_s GROUP BY {key})"""


def distinct(name: str, source: str, size: int = 800) -> str:
    """CTE `name`: the first chunk of each first 100 characters, then those of 20 characters to 1.2 times the size."""
    return f"{name} AS (SELECT id, k, c FROM (SELECT *, row_number() OVER (PARTITION BY id, lower({flat('substr(c, 1, 100)')}) ORDER BY k) AS first FROM {source}) WHERE first = 1 AND length(c) BETWEEN 20 AND {int(size * 1.2)})"


def result(source: str, id_col: str = "id") -> str:
    return f"SELECT id AS {id_col}, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS seq, CAST(length(c) AS INT) AS n_chars, md5(c) AS text_md5 FROM {source}"


def _last_words(n: int) -> str:
    """The last n characters of `cur`, from the first blank among them on."""
    end = stripped(f"right(s.cur, {n})")
    return f"CASE WHEN position(' ' IN {end}) > 0 THEN {stripped(f'substr({end}, position({chr(39)} {chr(39)} IN {end}) + 1)')} ELSE {end} END"


_LONG = "list_filter(list_transform({}, lambda x: " + stripped("x") + "), lambda x: length(x) > 10)"
SENTENCES = recursive(f"{numbered('pieces', 'chunk', _LONG.format(sentences(flat('content'))))}, {packed('made', 'pieces', '800', _last_words(150))}, {distinct('kept', 'made')} {result('kept')}")
MICRO = recursive(f"{numbered('pieces', '(SELECT id, content FROM chunk WHERE length(content) > 350)', sentences('content', '0-9'))}, {packed('made', 'pieces', '300', 'right(s.cur, 60)', 0)} {result('made')}")

# paragraphs of over 1200 characters by sentences; runs of shorter ones filled up to 800, a chunk under 400 with a piece of what comes next
def paragraphs(content: str, source: str = "chunk") -> str:
    """CTE `ordered` (id, k, c)."""
    return f"""{numbered("pieces", f"(SELECT id, {content} AS content FROM {source})", f"list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: {stripped('x')}), lambda x: x <> '')")},
{numbered("cuts", "(SELECT id, k AS place, p AS whole FROM pieces WHERE length(p) > 1200)", by_sentence("whole"), "id, place")}, {packed("long", "cuts", "1200", key="id, place")},
short_s AS (SELECT id, k, p AS cur, CAST(length(p) AS BIGINT) AS n, length(p) > 1200 AS far, CAST(NULL AS VARCHAR) AS c FROM pieces WHERE k = 1
UNION ALL SELECT id, k, CASE WHEN far OR was THEN p WHEN n + length(p) <= 800 THEN cur || chr(10) || chr(10) || p WHEN fill THEN {stripped("substr(p, room + 1)")} ELSE p END, CAST(CASE WHEN far OR was THEN length(p) WHEN n + length(p) <= 800 THEN n + length(p) + 2 WHEN fill THEN length({stripped("substr(p, room + 1)")}) ELSE length(p) END AS BIGINT), far,
CASE WHEN was THEN NULL WHEN far THEN cur WHEN n + length(p) <= 800 THEN NULL WHEN fill THEN cur || chr(10) || chr(10) || substr(p, 1, room) ELSE cur END
FROM (SELECT t.id, t.k, t.p, s.cur, s.n, s.far AS was, length(t.p) > 1200 AS far, CAST(799 - s.n AS INT) AS room, s.n < 400 AND 799 - s.n > 50 AS fill FROM short_s s JOIN pieces t ON t.id = s.id AND t.k = s.k + 1)),
made AS (SELECT id, 2 * k - 1 AS a, 0 AS b, c FROM short_s WHERE c IS NOT NULL UNION ALL SELECT id, 2 * max(k), 0, max_by(cur, k) FROM short_s GROUP BY id HAVING NOT max_by(far, k) UNION ALL SELECT id, 2 * place, k, c FROM long),
ordered AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, b) AS k, c FROM made)"""


PARAGRAPHS = recursive(f"{paragraphs('content')} {result('ordered')}")
LINES = recursive(f"{paragraphs('replace(content, chr(10), chr(10) || chr(10))')} {result('ordered')}")


def of_index(files: str) -> str:
    """Chunks of the index of filings by batch, grain and company; files: SQL with path, batch, ticker, status, and id, the document. A text that an earlier batch has isn't indexed again, of equal ones of a batch the one of the smallest id of row stays."""
    return recursive(f"""files AS ({files}), body AS (SELECT id, content FROM chunk JOIN (SELECT id FROM files WHERE status = 'indexed') USING (id)), {paragraphs("content", "body")},
macro AS (SELECT id, k - 1 AS seq, c FROM ordered), {numbered("sentence", "(SELECT id, seq, c FROM macro WHERE length(c) > 350)", sentences("c", "0-9"), "id, seq")}, {packed("small", "sentence", "300", "right(s.cur, 60)", 0, "id, seq")},
every AS (SELECT id, 'macro' AS granularity, seq, 0 AS part, c FROM macro UNION ALL SELECT id, 'micro', seq, row_number() OVER (PARTITION BY id, seq ORDER BY k) - 1, c FROM small),
fresh AS (SELECT batch, granularity, ticker, c, row_number() OVER (PARTITION BY md5(c) ORDER BY batch, concat_ws('_', path, granularity, seq, part)) AS first FROM every JOIN files USING (id))
SELECT batch, granularity, ticker, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS n_chars, count(DISTINCT md5(c)) AS texts FROM fresh WHERE first = 1 GROUP BY batch, granularity, ticker""")


# a call is one text; its turns begin at a name and a colon
_SAID = "string_agg(upper(speaker[1]) || substr(speaker, 2) || ': ' || content, chr(10) ORDER BY seq)"
_CALLS = f"calls AS (SELECT conv_id AS id, {flat(f"replace({_SAID}, ':', ': ')")} AS text FROM entry GROUP BY conv_id)"
_NAMED = rf"string_split(regexp_replace(text, '{NAME}', {CUT} || '\0', 'g'), {CUT})"
_TURNS = f"""{numbered("spoken", "calls", f"{_NAMED}[2:]")}, turns AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, who, said FROM (SELECT id, k, {stripped("split_part(p, ':', 1)")} AS who, {stripped("substr(p, position(':' IN p) + 1)")} AS said FROM spoken) WHERE said <> '')"""
TURNS = recursive(f"{_CALLS}, {_TURNS}, pieces AS (SELECT id, k, who || ': ' || said AS p FROM turns), {packed('made', 'pieces', '800')} {result('made', 'conv_id')}")
REMARKS = recursive(f"""{_CALLS}, {_TURNS}, {numbered("pieces", "(SELECT id, k AS place, who, said FROM turns WHERE length(who) + 2 + length(said) > 800)", by_sentence("said"), "id, place, who")}, {packed("cut", "pieces", "800 - length(s.who) - 3", key="id, place, who")},
made AS (SELECT id, k AS a, 0 AS b, who || ': ' || said AS c FROM turns WHERE length(who) + 2 + length(said) <= 800 UNION ALL SELECT id, place, k, who || ': ' || c FROM cut), ordered AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, b) AS k, c FROM made) {result("ordered", "conv_id")}""")

_SPACED = r"spaced AS (SELECT id, regexp_replace(text, '([.!?])([A-Z])', '\1 \2', 'g') AS text FROM calls)"
_END = stripped("right(s.cur, 150)")
_FROM_NAME = rf"string_split(regexp_replace({_END}, '{NAME}', {CUT} || '\0', 'g'), {CUT})"
_HEAD = f"CASE WHEN len({_FROM_NAME}) > 1 THEN {_FROM_NAME}[-1] ELSE {by_sentence(_END)}[-1] END"
CALLS = recursive(f"""{_CALLS}, {_SPACED}, {numbered("spoken", "spaced", _NAMED)},
said AS (SELECT id, k AS turn, unnest(l) AS p, generate_subscripts(l, 1) AS place, who FROM (SELECT id, k, CASE WHEN k > 1 THEN split_part(p, ':', 1) || ': ' ELSE '' END AS who, {sentences("CASE WHEN k > 1 THEN substr(p, position(':' IN p) + 1) ELSE p END")} AS l FROM spoken)),
pieces AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn, place) AS k, p FROM (SELECT id, turn, place, {stripped("CASE WHEN place = 1 THEN who || p ELSE p END")} AS p FROM said) WHERE length(p) > 10), {packed("made", "pieces", "800", _HEAD)}, {distinct("kept", "made")} {result("kept", "conv_id")}""")

SPEAKERS = oracle(r"""WITH g AS (SELECT *, sum(is_analyst) OVER (PARTITION BY conv_id ORDER BY seq) AS g FROM entry), t AS (SELECT conv_id, g, string_agg(upper(speaker[1]) || substr(speaker, 2) || ': ' || content, chr(10) || chr(10) ORDER BY seq) AS text FROM g WHERE g > 0 GROUP BY conv_id, g),
n AS (SELECT regexp_extract_all(text, '(?m)^([A-Z][\w.'' -]{1,60}):', 1) AS l FROM t), s AS (SELECT array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS speakers FROM n) SELECT speakers, count(*) AS n FROM s WHERE speakers <> '' GROUP BY speakers""")

# a page without comments, what isn't shown, and tags; tags that break a line are line ends
_PAGE = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)\b.*?</(script|style)\s*>', '', 'gis'), '<head\b.*?</head\s*>', '', 'gis')"
_PAGE = rf"regexp_replace(regexp_replace({_PAGE}, '<nav\b.*?</nav\s*>', chr(10), 'gis'), '</?(p|br|div|li|tr|h1|h2|h3|h4|table|article|section)\b[^>]*>', chr(10), 'gi')"
_PAGE = rf"regexp_replace({_PAGE}, '</?[a-z][^>]*>|<![^>]*>', '', 'gi')"
for _name, _mark in {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}.items():
    _PAGE = f"regexp_replace({_PAGE}, '&{_name};?', '{_mark}', 'g')"
_SHOWN = r"length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) >= 0.4 * length(x) AND len(list_filter(list_distinct(string_split(x, '')), lambda c: contains(x, repeat(c, 11)))) = 0"
PAGES = f"SELECT page_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: {flat('x')}), lambda x: x <> '' AND {_SHOWN}), chr(10)) AS t FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"
