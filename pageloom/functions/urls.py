"""Address expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import SPACE, strip

# --- fixed values -----------------------------------------------------------
AUDIO_EXTENSIONS = [".mp3", ".flac", ".m4a", ".aac", ".wav", ".ogg", ".opus"]
VIDEO_EXTENSIONS = [".m3u8", ".mp4", ".webm", ".mov", ".mkv"]
AUDIO_WORDS = ["音乐", "歌单", "歌曲", "music", "audio"]
VIDEO_WORDS = ["视频", "video", "影视", "动漫", "movie", "play"]
IMAGE_WORDS = ["图片", "图集", "套图", "美图", "gallery", "photo"]
NOVEL_WORDS = ["小说", "章节", "阅读", "txt", "novel", "book"]
ASSET_EXTENSIONS = [
    ".json", ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".zip", ".rar", ".apk",
    ".txt", ".xml",
]
MAX_LINK_BYTES = 2000
PAGE_SLOT = r"\{\{\s*(page|bookPage)\s*(?:<\s*(\d+)\s*>)?\s*\}\}"
# ---------------------------------------------------------------------------

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _ends_with_any(c: Column, endings: list[str]) -> Column:
    return c.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def _contains_any(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def _percent_encode(c: Column) -> Column:
    """Encode what may not stand raw in a path or query."""
    unsafe = r"""[^\x21-\x7e]|["<>`{}]"""
    chars = F.transform(
        F.split(c, ""),
        lambda x: F.when(x.rlike(unsafe), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x),
    )
    return F.when(c.rlike(unsafe), F.array_join(chars, "")).otherwise(c)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")

    def step(acc: Column, seg: Column) -> Column:
        popped = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(seg == "..", popped).when(seg == ".", acc).otherwise(F.array_append(acc, seg))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    # A path that ends in a dot segment names a folder.
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(folded, "/"), tail)
    return F.when(path.rlike(r"/\.\.?(/|$)"), joined).otherwise(path)


def origin_of(base: Column) -> Column:
    """``scheme://host[:port]`` in normal form, the empty string when there is no host."""
    scheme = F.lower(F.regexp_extract(base, _SCHEME, 1))
    host = F.lower(F.regexp_extract(base, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))\
        .when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host)).otherwise(F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base``; what cannot be resolved stays as written."""

    def against(p: Column) -> Column:
        """A reference with no scheme against the parts of a usable base."""
        h, origin, path = p["h"], p["origin"], p["path"]
        h_path = _percent_encode(F.regexp_extract(h, r"^([^?#]*)", 1))
        rest = _percent_encode(F.regexp_extract(h, r"^[^?#]*(.*)$", 1))
        folder = F.regexp_replace(path, r"[^/]*$", "")
        query = _percent_encode(F.regexp_extract(p["b"], r"^[^#?]*(\?[^#]*)", 1))
        target = F.when(h.startswith("#"), F.concat(path, query)).when(h.startswith("?"), path).otherwise(
            _fold_dots(F.concat(F.when(h.startswith("/"), F.lit("")).otherwise(folder), h_path)))
        return F.when(origin == "", h).otherwise(F.concat(origin, target, rest))

    def resolve(p: Column) -> Column:
        h, b = p["h"], p["b"]
        b_path = F.regexp_extract(b, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
        b_path = _fold_dots(_percent_encode(F.when(b_path == "", F.lit("/")).otherwise(b_path)))
        parts = F.struct(h.alias("h"), b.alias("b"), origin_of(b).alias("origin"), b_path.alias("path"))
        scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(b, _SCHEME, 1)), F.lit("")), F.lit("https"))
        return (
            F.when((h == "") | h.startswith("http://") | h.startswith("https://"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.rlike(_SCHEME), h)
            .otherwise(_let(parts, against))
        )

    return _let(F.struct(strip(href).alias("h"), strip(base).alias("b")), resolve)


def is_plausible_link(value: Column) -> Column:
    """Could this extracted value be an address?"""
    return _let(strip(value), _plausible)


def _plausible(v: Column) -> Column:
    refused = (
        (v == "")
        | (F.octet_length(v) > MAX_LINK_BYTES)
        | v.rlike(rf"[{SPACE}()<]")
        | v.rlike(r"(?i)^(javascript|data):")
    )
    shaped = v.rlike(r"^(#?[0-9]+$|https?://|/)") | v.contains(".")
    return F.coalesce(~refused & shaped, F.lit(False))


def resolve_link(value: Column, base: Column) -> Column:
    """The address an item opens; bare numeric ids hang off the host root."""

    def resolve(p: Column) -> Column:
        v, origin = p["v"], origin_of(p["b"])
        number = F.regexp_extract(v, r"^#?([0-9]+)$", 1)
        return (
            F.when(~_plausible(v), F.lit(""))
            .when(number != "", F.concat(origin, F.lit("/"), number))
            .otherwise(absolute_url(v, p["b"]))
        )

    return _let(F.struct(strip(value).alias("v"), strip(base).alias("b")), resolve)


def link_path(link: Column) -> Column:
    """The lower-case path of a link, host and query left out."""
    s = strip(link)
    parsed = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.when(s.rlike(_SCHEME), parsed).otherwise(F.regexp_extract(s, r"^([^?#]*)", 1)))


def is_audio_url(url: Column) -> Column:
    return _ends_with_any(F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)), AUDIO_EXTENSIONS)


def classify_kind(title: Column, link: Column) -> Column:
    """Music, video, image, novel or article, audio before video."""
    path = link_path(link)
    text = F.lower(title)
    return (
        F.when(_ends_with_any(path, AUDIO_EXTENSIONS) | _contains_any(text, AUDIO_WORDS), F.lit("music"))
        .when(_ends_with_any(path, VIDEO_EXTENSIONS) | _contains_any(text, VIDEO_WORDS), F.lit("video"))
        .when(_contains_any(text, IMAGE_WORDS), F.lit("image"))
        .when(_contains_any(text, NOVEL_WORDS), F.lit("novel"))
        .otherwise(F.lit("article"))
    )


def numeric_id(url: Column) -> Column:
    """A5: leading digits of the last path segment, null when there are none."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.nullif(F.regexp_extract(last, r"^[0-9]+", 0), F.lit(""))


def is_detail_link(href: Column) -> Column:
    """A5: does this link look like the page of one numbered collection?"""
    h = strip(href)
    last = F.element_at(F.split(F.regexp_replace(F.regexp_extract(h, r"^([^?#]*)", 1), "/+$", ""), "/"), -1)
    refused = (
        (h == "")
        | h.rlike(r"^(#|javascript:|mailto:|tel:)")
        | h.rlike(rf"[{SPACE}]")
        | _ends_with_any(F.lower(last), ASSET_EXTENSIONS)
    )
    return F.coalesce(~refused & last.rlike(r"^[0-9]"), F.lit(False))


def expand_page(template: Column, page: Column) -> Column:
    """Fill ``{{page}}``, ``{{bookPage}}`` and ``{{page<k>}}`` slots."""
    pieces = F.split(template, rf"(?={PAGE_SLOT})")

    def fill(piece: Column) -> Column:
        written = F.nullif(F.regexp_extract(piece, "^" + PAGE_SLOT, 2), F.lit(""))
        start = F.coalesce(written.try_cast("bigint"), F.lit(1))
        value = (page.cast("bigint") + start - 1).cast("string")
        return F.when(piece.rlike("^" + PAGE_SLOT),
                      F.concat(value, F.regexp_replace(piece, "^" + PAGE_SLOT, ""))).otherwise(piece)

    return F.array_join(F.transform(pieces, fill), "")


def valid_article_url(url: Column) -> Column:
    """Struct of ``ok`` and a reason code for addresses a reader may open."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    host = F.regexp_extract(u, r"^[^:/?#]+://([^/?#]+)", 1)
    web = scheme.isin("http", "https")
    reason = (
        F.when(u == "", F.lit("empty"))
        .when(scheme == "", F.lit("malformed"))
        .when(web & (host == ""), F.lit("malformed"))
        .when(web | (scheme == "file"), F.lit(""))
        .otherwise(F.concat(F.lit("scheme:"), scheme))
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))
