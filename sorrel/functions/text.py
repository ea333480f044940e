"""Text: normal forms for matching and hashing, HTML to text, links and URLs. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named HTML entities that are decoded; fixed values of the format.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "", "mdash": "—", "ndash": "–", "minus": "−",
    "hellip": "…", "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "bull": "•", "middot": "·", "laquo": "«", "raquo": "»",
    "deg": "°", "cent": "¢", "pound": "£", "euro": "€", "copy": "©", "reg": "®", "trade": "™", "times": "×",
    "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ocirc": "ô", "uuml": "ü",
}
#: Query parameters that only say where a visit came from, and beginnings of such names; fixed values.
TRACKING = (
    "gclid", "gbraid", "wbraid", "gad_source", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "twclid", "igshid", "mkt_tok", "mc_cid", "mc_eid", "ref_src",
    "vero_id", "oly_enc_id", "oly_anon_id", "_ga", "_gl", "_hsenc", "_hsmi", "s_kwcid",
)
TRACKING_FAMILIES = ("utm_", "hsa_", "pk_", "piwik_", "matomo_")
#: Parameters that name what a page is about; fixed values. They stay even within such a family.
IDENTITY = (
    "activity", "activityid", "camp", "campid", "class", "classid", "course", "courseid", "event", "eventid", "id", "location", "offering", "program", "programid",
    "reg", "registration", "session", "sessionid", "session_id", "site", "sku", "term", "week",
)
#: Tags whose edges end a line; fixed values of the format.
BLOCKS = (
    "p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "th", "td",
    "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "figure", "figcaption", "blockquote", "form", "fieldset", "legend", "label", "option", "address",
)
_FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fold_accents(text: Column) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(text), *_FOLD)


def match_key(text: Column) -> Column:
    """For comparing names: folded, & as and, other marks as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_accents(text), "&", " and "), r"\([^)]*\)", " "), r"[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.replace(match_key(text), F.lit(" "), F.lit("-"))


def hash_form(text: Column) -> Column:
    """For content hashes: line ends as LF, lines without trailing blanks, three and more line ends as two, trimmed."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(t, r"^[ \t\n]+|[ \t\n]+$", ""))


def content_hash(text: Column) -> Column:
    return F.sha2(hash_form(text).cast("binary"), 256)


def let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def decode_entities(text: Column) -> Column:
    """Numeric entities and those named in ENTITIES, in one pass, so that nothing is decoded twice; others stay."""
    pattern = r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def plain(e: Column) -> Column:
        hexadecimal, decimal = F.regexp_extract(e, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1), F.regexp_extract(e, r"^&#0*([0-9]{1,7});$", 1)
        number = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(decimal).try_cast("long")
        fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(fine, char).otherwise(F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(e, "^&([a-zA-Z0-9]+);$", 1))), e))

    def joined(found: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, pattern, -1).alias("text"), F.transform(found, plain).alias("entity"))
        return F.array_join(F.flatten(F.transform(pairs, lambda x: F.array(x["text"], F.coalesce(x["entity"], F.lit(""))))), "")

    return F.when(text.contains("&"), let(F.regexp_extract_all(text, F.lit(pattern), 0), joined)).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: comments and what isn't content go, edges of block tags end lines, other tags are spaces, white space collapses, blank lines go."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|template|svg|iframe)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, rf"(?i)<\s*/?\s*(?:{'|'.join(BLOCKS)})\b[^>]*>", "\x01")
    t = F.regexp_replace(decode_entities(F.regexp_replace(t, r"<[^>]*>", " ")), r"[\s\u00a0]+", " ")
    return F.array_join(F.filter(F.transform(F.split(t, "\x01"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def html_links(html: Column) -> Column:
    """All href values of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a [^>]*href=["']([^"']*)["']"""), 1)


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))


def host(url: Column) -> Column:
    """Lower-case host without www., null if the URL isn't http(s)."""
    found = F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"^www\.|:(80|443)$", ""))


def _parameters(query: Column) -> Column:
    """array<struct<key, value>> of a query string, in order of key and value, without those that only track visits."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.regexp_replace(p, "^[^=]*=?", "").alias("value")))

    def tracks(key: Column) -> Column:
        family = reduce(lambda a, f: a | key.startswith(f), TRACKING_FAMILIES, F.lit(False))
        return ~key.isin(*IDENTITY) & (key.isin(*TRACKING) | family)

    return F.array_sort(F.filter(pairs, lambda p: ~tracks(F.lower(p["key"]))))


def canonical_url(url: Column) -> Column:
    """One form of a page's address; null if it isn't a URL.

    Scheme and host in lower case, no default port, no fragment, no slashes twice or at the end of a
    path, no tracking parameters, the others in order. Whatever may name a page stays: http, www.
    and ref. Of a scheme other than http(s), only the scheme's case and the fragment change.
    """
    t = F.trim(url)
    scheme = F.lower(F.regexp_extract(t, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    parts = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#@]+)([^?#]*)(?:\?([^#]*))?"
    place = F.lower(F.regexp_extract(t, parts, 1))
    place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).otherwise(F.regexp_replace(place, ":443$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, parts, 2), "/{2,}", "/"), "(.)/$", "$1")
    query = F.array_join(F.transform(_parameters(F.regexp_extract(t, parts, 3)), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    web = F.concat(scheme, F.lit("://"), place, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    other = F.concat(scheme, F.regexp_replace(F.regexp_replace(t, "#.*$", ""), "^[^:]*", ""))
    return F.when(scheme.isin("http", "https"), F.when(place != "", web)).when(scheme != "", other)


def _common_start(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts, by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= most) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n))


def changed_span(old: Column, new: Column) -> Column:
    """Characters of both texts outside their common beginning and, after it, their common end."""
    def rest(head: Column) -> Column:
        a, b = (F.reverse(F.substring(t, head + 1, F.lit(2**31 - 1))) for t in (old, new))
        return F.char_length(a) + F.char_length(b) - 2 * _common_start(a, b)

    return let(_common_start(old, new), rest)
