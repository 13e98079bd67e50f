"""URL columns: splitting, resolving, normalising, classifying, naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split of RFC 3986, appendix B.
RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# File endings of documents and of skipped assets, ignored parameters, language segments.
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp", ".rtf", ".zip", ".rar", ".7z", ".csv", ".txt")
ASSET_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".mp4", ".mp3", ".avi", ".mov", ".webm", ".wav", ".css", ".js", ".json", ".xml", ".woff", ".woff2", ".ttf", ".eot", ".exe", ".dmg")
IGNORED_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "_ga", "sessionid", "jsessionid", "phpsessid")
NOT_FOLLOWED = ("mailto:", "tel:", "javascript:", "data:", "sms:", "#")
LANGUAGES = ("en", "tr", "de", "fr", "ar", "ru", "az", "fa")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ends_with_any(c: Column, endings) -> Column:
    return any_of(c.endswith(e) for e in endings)


def part(url: Column, k: int) -> Column:
    """Scheme 1, authority 2, path 3, query 4, fragment 5; empty where missing."""
    return F.regexp_extract(url, RFC3986, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def host(url: Column) -> Column:
    """Lower-case host without user or port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def _without_dots(p: Column) -> Column:
    """An absolute path with . and .. resolved; .. above the root is dropped."""
    segments = F.split(p, "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), authority(url).alias("net"), path(url).alias("path"), query(url).alias("query"), url.rlike(r"^[^#]*\?").alias("asks"))


def resolved(href: Column, base: Column) -> Column:
    """(scheme, net, path, query) of href on a page at base."""
    return let(F.struct(split(href).alias("h"), split(base).alias("b")), lambda x: _join(x["h"], x["b"]))


def _join(h: Column, b: Column) -> Column:
    same, rooted = (h["scheme"] == "") | (h["scheme"] == b["scheme"]), h["net"] != ""
    base_dir = F.when((b["path"] == "") & (b["net"] != ""), F.lit("/")).otherwise(F.regexp_replace(b["path"], "[^/]*$", ""))
    p = F.when(rooted | h["path"].startswith("/"), h["path"]).when(h["path"] == "", b["path"]).otherwise(F.concat(base_dir, h["path"]))
    p = let(p, lambda v: F.when(v.contains("/."), _without_dots(v)).otherwise(v))
    q = F.when((h["path"] == "") & ~rooted & ~h["asks"], b["query"]).otherwise(h["query"])
    return F.struct(
        F.when(same, b["scheme"]).otherwise(h["scheme"]).alias("scheme"),
        F.when(same & ~rooted, b["net"]).otherwise(h["net"]).alias("net"),
        F.when(same, p).otherwise(h["path"]).alias("path"),
        F.when(same, q).otherwise(h["query"]).alias("query"),
    )


def resolve(href: Column, base: Column) -> Column:
    """The absolute URL of href on a page at base, without its fragment."""
    return let(resolved(href, base), lambda u: F.concat(u["scheme"], F.lit("://"), u["net"], u["path"], _asked(u["query"])))


def _asked(q: Column) -> Column:
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))


def encode_parameter(c: Column) -> Column:
    """Form encoding: ~ stays, * is escaped, a space is +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(q: Column, ignore=IGNORED_PARAMETERS) -> Column:
    """Parameters without the ignored ones, sorted by name and value; blank values stay."""
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(F.filter(F.split(q, "&"), lambda s: s != ""), lambda s: F.struct(decode(F.substring_index(s, "=", 1)).alias("k"), F.when(s.contains("="), decode(F.substring(s, F.instr(s, "=") + 1, F.length(s)))).otherwise(F.lit("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*[i.lower() for i in ignore]) & ~F.lower(p["k"]).startswith("utm_"))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encode_parameter(p["k"]), F.lit("="), encode_parameter(p["v"]))), "&")


def normalize_url(href: Column, base: Column, ignore_params=IGNORED_PARAMETERS, no_query: bool = False) -> Column:
    """Absolute http(s) URL of an href: host in lower case, no fragment, no double slashes, known parameters dropped, the rest sorted. Null if it isn't followed."""
    raw = F.trim(F.coalesce(href, F.lit("")))
    dropped = (raw == "") | any_of(raw.startswith(s) for s in NOT_FOLLOWED)

    def put(u: Column) -> Column:
        p = F.regexp_replace(F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]), "/{2,}", "/")
        q = F.lit("") if no_query else F.when(u["query"] == "", F.lit("")).otherwise(clean_query(u["query"], ignore_params))
        return F.when(u["scheme"].isin("http", "https"), F.concat(u["scheme"], F.lit("://"), F.lower(u["net"]), p, let(q, _asked)))

    return F.when(~dropped, let(resolved(raw, base), put))


def in_site(h: Column, hosts, root: str | None = None) -> Column:
    """Whether a host is one of the site's, or a subdomain of root."""
    inside = F.lower(h).isin(*[x.lower() for x in hosts])
    return inside | F.regexp_replace(F.lower(h), ":.*$", "").endswith("." + root.lower().split(":")[0]) if root else inside


def classify_url(url: Column, inside: Column, exclude=(), include=()) -> Column:
    """Class of a normalised URL (null: not followed): sema, dis, belge, dosya, haric or sayfa, in this order."""
    p = F.lower(path(url))
    out = F.when(url.isNull(), "sema").when(~inside, "dis").when(ends_with_any(p, DOCUMENT_ENDINGS), "belge").when(ends_with_any(p, ASSET_ENDINGS), "dosya")
    if exclude:
        out = out.when(any_of(url.rlike(r) for r in exclude), "haric")
    if include:
        out = out.when(~any_of(url.rlike(r) for r in include), "haric")
    return out.otherwise("sayfa")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def language(url: Column) -> Column:
    first = F.lower(F.get(segments(url), F.lit(0)))
    return F.when(first.isin(*LANGUAGES), first).otherwise(F.lit(""))


def leaf_of(url: Column) -> Column:
    """(first, last, depth) of the path after its language; segments with a digit become *."""
    fold = lambda s: F.when(s.rlike("[0-9]") | s.rlike("^[0-9a-f]{8,}$"), F.lit("*")).otherwise(s)
    rest = let(segments(url), lambda s: F.when(F.lower(F.get(s, F.lit(0))).isin(*LANGUAGES), F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))).otherwise(s))
    get = lambda s, k: F.coalesce(let(F.lower(F.get(s, k)), fold), F.lit(""))
    return let(rest, lambda s: F.struct(get(s, F.lit(0)).alias("first"), get(s, F.size(s) - 1).alias("last"), F.size(s).alias("depth")))


def query_keys(url: Column) -> Column:
    keys = F.regexp_replace(query(url), "=[^&]*", "")
    return F.when(query(url) != "", F.concat(F.lit("?"), F.substring(F.regexp_replace(F.lower(keys), "[^a-z0-9&]+", ""), 1, 30))).otherwise(F.lit(""))


def safe_name(url: Column, maxlen: int = 110) -> Column:
    """A stable file name: the slug of path and query, and eight digits of the URL's md5."""
    slug = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9]+", "-")
    q = F.when(query(url) != "", F.concat(F.lit("_"), slug(query(url)))).otherwise(F.lit(""))
    name = F.regexp_replace(F.concat(slug(F.regexp_replace(path(url), "^/+|/+$", "")), q), "^-+|-+$", "")
    name = F.when(name == "", F.lit("anasayfa")).otherwise(name)
    return F.concat(F.substring(name, 1, maxlen), F.lit("-"), F.substring(F.md5(url.cast("binary")), 1, 8))


def parent_url(url: Column) -> Column:
    """The URL without its last path segment."""
    return F.concat(part(url, 1), F.lit("://"), authority(url), F.regexp_replace(F.regexp_replace(path(url), "/+$", ""), "/[^/]*$", ""))


def clean_url(url: Column) -> Column:
    """Whether a URL starts with http and holds only printable ASCII and the twelve Turkish letters."""
    return url.rlike(r"^http[\x21-\x7eçÇğĞıİöÖşŞüÜ]*$")
