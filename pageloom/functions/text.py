"""Text clean-up expressions."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Named entities in decoding order. "&amp;" comes early, so "&amp;lt;" ends as "<".
NAMED_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
]
LINE_BREAK_TAGS = ["</p>", "</div>", "</li>", "<br>", "<br/>", "<br />"]
CHROME_TAGS = [
    "script", "style", "noscript", "template", "svg", "iframe", "form", "nav", "aside", "header", "footer",
]
UNSAFE_TAGS = ["script", "style", "link", "meta", "iframe", "object", "embed", "form", "noscript"]
WALL_MARKERS = [
    "请验证密码", "验证密码", "密码访问", "安全验证", "请稍候", "just a moment", "cloudflare", "ray id",
    "enable javascript and cookies", "藏起来了", "access denied", "too many requests",
]
MIN_READABLE_CHARS = 20
# Unicode White_Space, spelled out so the regex does not depend on flags.
SPACE = r"\t\n\x0B\f\r \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# ---------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(c: Column) -> Column:
    """Drop zero-width marks, squeeze white space, trim."""
    bare = F.translate(c, "\u200b\ufeff", "")
    return F.trim(F.regexp_replace(bare, rf"[{SPACE}]+", " "))


def decode_entities(c: Column) -> Column:
    """Nine named entities in order, then numeric ones, decimal and hex.

    The text is cut in front of every ``&#`` so each piece carries at most one
    numeric entity at its head; code points that are no character become U+FFFD.
    """
    out = c
    for entity, char in NAMED_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    head = r"^&#(x?)([0-9a-fA-F]+);"

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, head, 2)
        hexed = F.regexp_extract(piece, head, 1) == "x"
        # conv() saturates instead of raising; a decimal entity with hex digits is no number.
        code = F.when(hexed, F.conv(digits, 16, 10)).when(digits.rlike("^[0-9]+$"), F.conv(digits, 10, 10))
        code = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 9, code.cast("bigint"))
        valid = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        safe = F.when(valid, code).otherwise(F.lit(0xFFFD))
        # UTF-32 decoding would take a lone U+FEFF for a byte order mark.
        char = F.when(safe == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))
        return F.when(piece.rlike(head), F.concat(char, F.regexp_replace(piece, head, ""))).otherwise(piece)

    decoded = F.array_join(F.transform(F.split(out, r"(?=&#x?[0-9a-fA-F]+;)"), one), "")
    return F.when(out.contains("&#"), decoded).otherwise(out)


def html_to_text(c: Column) -> Column:
    """Markup to plain text, one trimmed non-empty line per block."""
    out = c
    for tag in LINE_BREAK_TAGS:
        out = F.replace(out, F.lit(tag), F.lit("\n"))
    out = decode_entities(F.regexp_replace(out, r"(?s)<[^>]*>", " "))
    lines = F.transform(F.split(out, r"\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def readable_text(html: Column) -> Column:
    """text without page chrome, or with it when next to nothing remains."""
    out = html
    for tag in CHROME_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    bare = html_to_text(out)
    return F.when(F.length(bare) < MIN_READABLE_CHARS, html_to_text(html)).otherwise(bare)


def sanitize_html(html: Column) -> Column:
    """drop unsafe elements, event handlers and script addresses.

    A clean-up for display tables, not a security boundary.
    """
    out = html
    for tag in UNSAFE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
        out = F.regexp_replace(out, rf"(?is)</?{tag}\b[^>]*>", "")
    value = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    # One pass over the attributes of each tag: handlers anywhere, addresses by scheme.
    out = F.regexp_replace(out, rf"(?is)(?<=[\s\"'])on[a-z0-9_:-]*{value}(?=[^<>]*>)", "")
    script = r"""\s*=\s*("\s*javascript:[^"]*"|'\s*javascript:[^']*'|javascript:[^\s>"']*)"""
    return F.regexp_replace(out, rf"(?is)(?<=[\s\"'])(href|src){script}(?=[^<>]*>)", "")


def block_wall(html: Column, markers: list[str] = WALL_MARKERS) -> Column:
    """the first marker of a password wall or bot challenge, else null."""
    low = F.lower(html)
    return F.coalesce(*[F.when(low.contains(m.lower()), F.lit(m)) for m in markers])


def page_title_tag(html: Column) -> Column:
    """The ``<title>`` of a page, cleaned; null when missing or empty."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(clean_text(decode_entities(raw)), F.lit(""))


def meta_refresh(html: Column) -> Column:
    """The target of a ``<meta http-equiv=refresh>``, null when there is none."""
    pattern = r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["'][^"']*url=([^"'>]+)"""
    return F.nullif(strip(F.regexp_extract(html, pattern, 1)), F.lit(""))


# --- E16 ---------------------------------------------------------------------


def b64_encode(c: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")


def b64_decode(c: Column) -> Column:
    """Decode; text that is no Base64 gives the empty string."""
    return F.coalesce(F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8"), F.lit(""))


def url_quote(c: Column) -> Column:
    """Percent-encode everything but ``A-Z a-z 0-9 - _ . ! ~ * ' ( )``."""
    out = F.url_encode(c)
    for code, char in [("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")]:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url_unquote(c: Column) -> Column:
    """Percent-decode; a plus sign stays a plus sign, bad input stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def first_match(c: Column, pattern: str) -> Column:
    """The first match of ``pattern`` and its groups, joined by new lines; a pattern that does not compile matches nothing."""
    found = executable(pattern)
    if found is None:
        return F.lit("")
    pattern, groups, _ = found
    parts = [F.regexp_extract(c, pattern, i) for i in range(groups + 1)]
    return F.when(c.rlike(pattern), F.concat_ws("\n", *parts)).otherwise(F.lit(""))


def executable(pattern: str) -> tuple[str, int, dict[str, str]] | None:
    """A pattern as executors take it, its number of groups, their names there by the given ones; ``None`` if it does not compile.

    ``(?P<name>`` is accepted; names lose their underscores, which executors do not allow.
    """
    named = re.compile(r"(?<!\\)\(\?P?<([A-Za-z_]\w*)>")
    names = {name: f"n{i}{name.replace('_', '')}" for i, name in enumerate(named.findall(pattern))}
    pattern = named.sub(lambda m: f"(?<{names[m.group(1)]}>", pattern)
    try:
        compiled = SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return None
    return pattern, compiled.matcher("").groupCount(), names


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


# --- E17 ---------------------------------------------------------------------


def short_text(c: Column, n: int) -> Column:
    """Head and tail around an ellipsis when longer than ``n`` characters."""
    s = strip(c)
    keep = max(n - 1, 0) // 2
    tail = F.when(F.lit(keep) > 0, F.right(s, F.lit(keep))).otherwise(F.lit(""))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, keep), F.lit("…"), tail))


def preview(c: Column, n: int = 90) -> Column:
    """A one-line beginning of a passage for a list row."""
    s = F.trim(F.regexp_replace(c, rf"[{SPACE}\uFEFF]+", " "))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def size_label(size: Column) -> Column:
    """Bytes in words: ``812 B``, ``12.3 KB``, ``4.0 MB``; exact halves round to even."""

    def tenths(unit: int, name: str) -> Column:
        whole = F.floor(size * 10 / unit).cast("bigint")
        rest = F.pmod(size.cast("bigint") * 10, F.lit(unit))
        up = F.when(rest * 2 > unit, 1).when(rest * 2 == unit, whole % 2).otherwise(0)
        n = whole + up
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(f" {name}"))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1048576, tenths(1024, "KB")).otherwise(tenths(1048576, "MB"))
    )
