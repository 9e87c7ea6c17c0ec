"""SQL fragments for the DuckDB side of the checks.

Written independently of the Spark expressions, in the other dialect, so that
agreement means something.
"""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({x}, chr(8203), ''), chr(65279), ''), '{WS}+', ' ', 'g'))"


def entities(x: str) -> str:
    out = x
    for name, char in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"),
                       ("&apos;", "chr(39)"), ("&ldquo;", "chr(8220)"), ("&rdquo;", "chr(8221)")):
        out = f"replace({out}, '{name}', {char})"
    piece = (
        "CASE WHEN regexp_matches(p, '^&#[0-9]+;') THEN chr(CAST(regexp_extract(p, '^&#([0-9]+);', 1) AS INT)) || regexp_replace(p, '^&#[0-9]+;', '') "
        "WHEN regexp_matches(p, '^&#x[0-9a-fA-F]+;') THEN chr(CAST('0x' || regexp_extract(p, '^&#x([0-9a-fA-F]+);', 1) AS INT)) "
        "|| regexp_replace(p, '^&#x[0-9a-fA-F]+;', '') ELSE p END")
    return f"array_to_string(list_transform(string_split(replace({out}, '&#', chr(1) || '&#'), chr(1)), lambda p: {piece}), '')"


def parsed(x: str) -> str:
    """Character references of the given pages as an HTML parser reads them: each
    once, and the old ones also without their semicolon."""
    out = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    for name, char in (("&quot;", 34), ("&copy;", 169), ("&middot;", 183)):
        out = f"replace({out}, '{name}', chr({char}))"
    return out


def html_text(x: str) -> str:
    out = x
    for tag in ("</p>", "</div>", "</li>", "<br>", "<br/>", "<br />"):
        out = f"replace({out}, '{tag}', chr(10))"
    out = entities(f"regexp_replace({out}, '<[^>]*>', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10))"


def readable(x: str) -> str:
    out = x
    for tag in "script style noscript template svg iframe form nav aside header footer".split():
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    bare = html_text(out)
    return f"CASE WHEN length({bare}) < 20 THEN {html_text(x)} ELSE {bare} END"


def encode(x: str) -> str:
    """Percent-encode what may not stand raw in a path or query."""
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]|[\"<>`{{}}]') "
        f"THEN url_encode(c) ELSE c END), '')")


def fold(path: str) -> str:
    """Dot segments of an absolute path, folded from the left."""
    step = (
        "CASE WHEN s[1] = '..' THEN (CASE WHEN len(a) > 1 THEN a[1:len(a)-1] ELSE a END) WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END")
    folded = f"list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda a, s: {step})"
    return f"(array_to_string({folded}, '/') || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END)"


def origin(base: str) -> str:
    """Enough for the given pages: lower-case http(s) hosts without ports."""
    return f"lower(regexp_extract({base}, '^https?://[^/?#]*'))"


LAST = "'[^/]*$', ''"


def absolute(h: str, base: str) -> str:
    o = origin(base)
    path = f"CASE WHEN regexp_extract({base}, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({base}, '^https?://[^/?#]*([^?#]*)', 1) END"
    rest = encode(f"regexp_extract({h}, '^[^?#]*(.*)$', 1)")
    hp = encode(f"regexp_extract({h}, '^([^?#]*)', 1)")
    return (
        f"CASE WHEN {h} = '' THEN '' WHEN {h} LIKE '//%' THEN regexp_extract({base}, '^[a-z]+') || ':' || {h} "
        f"WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} "
        f"WHEN {h} LIKE '#%' THEN {o} || {path} || regexp_extract({base}, '^[^?#]*(\\?[^#]*)', 1) || {rest} "
        f"WHEN {h} LIKE '?%' THEN {o} || {path} || {rest} "
        f"WHEN {h} LIKE '/%' THEN {o} || {fold(hp)} || {rest} "
        f"ELSE {o} || {fold(f'(regexp_replace({path}, {LAST}) || {hp})')} || {rest} END")


def plausible(v: str) -> str:
    return (
        f"(length({v}) > 0 AND strlen({v}) <= 2000 AND NOT regexp_matches({v}, '[\\s()<]') AND NOT regexp_matches(lower({v}), '^(javascript|data):') "
        f"AND (regexp_matches({v}, '^#?[0-9]+$') OR regexp_matches({v}, '^https?://') OR {v} LIKE '/%' OR {v} LIKE '%.%'))")


def resolve(v: str, base: str) -> str:
    return (
        f"CASE WHEN NOT {plausible(v)} THEN '' WHEN regexp_matches({v}, '^#?[0-9]+$') THEN {origin(base)} || '/' || ltrim({v}, '#') "
        f"ELSE {absolute(v, base)} END")


def kind(title: str, link: str) -> str:
    path = f"lower(regexp_replace(regexp_replace({link}, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''))"
    t = f"lower({title})"
    return (
        f"CASE WHEN regexp_matches({path}, '\\.(mp3|flac|m4a|aac|wav|ogg|opus)$') OR regexp_matches({t}, '音乐|歌单|歌曲|music|audio') THEN 'music' "
        f"WHEN regexp_matches({path}, '\\.(m3u8|mp4|webm|mov|mkv)$') OR regexp_matches({t}, '视频|video|影视|动漫|movie|play') THEN 'video' "
        f"WHEN regexp_matches({t}, '图片|图集|套图|美图|gallery|photo') THEN 'image' "
        f"WHEN regexp_matches({t}, '小说|章节|阅读|txt|novel|book') THEN 'novel' ELSE 'article' END")


# The links of the given pages: every anchor is written <a href="…">…</a>.
ANCHORS = """anchors AS (
  SELECT page_id, url, i AS ix, regexp_extract(a, '^<a href="([^"]*)">', 1) AS href, regexp_replace(a, '<[^>]*>', '', 'g') AS title
  FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i
        FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages) p) q)"""
