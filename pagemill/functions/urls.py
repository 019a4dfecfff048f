"""URL admission and canonicalisation as Column expressions.

Everything here is a pure Column → Column function: it stays inside
whole-stage codegen, needs no shuffle, and is applied as a projection over
request / capture tables of any size.

URL anatomy follows the WHATWG "special scheme" parse for http(s) with a
regex (``parse_url`` follows java.net.URI and disagrees with browsers on
hosts, case and ports).  Deliberate differences from the browser parser:
numeric shorthand IPv4 hosts (``0x7f.1``) and IDNA are not expanded — a host
whose last label is numeric must be a dotted quad or the URL is rejected as
unparseable; bracketed IPv6 literals and trailing-dot hosts are checked for
private ranges at admission time instead of failing later at DNS time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
# Host suffixes that are never fetched.
BLOCKED_HOST_SUFFIXES = [".internal", ".local", ".localhost"]
# Exact request paths answered 404 as known vulnerability scanners.
SCANNER_PATHS = [
    "/.claude.json",
    "/.claude/settings.json",
    "/_next/build-manifest.json",
    "/ngsw.json",
    "/public/admin.json",
    "/webpack-stats.json",
]
# Browser beacon allow-lists.
BROWSER_EVENTS = [
    "browser_page_view",
    "conversion_submit",
    "copy_markdown",
    "download_markdown",
    "example_click",
    "input_engaged",
    "new_conversion",
    "share_link",
]
BROWSER_PAGES = ["home", "other", "url-guide", "webpage-guide", "x-guide"]
# Encyclopedia namespaces that are not articles.
WIKI_NAMESPACES = ["Special", "File", "Image", "Media", "Wikipedia", "Help",
                   "Template", "Category", "Portal", "Draft", "User", "Talk"]
# Post hosts.
POST_HOSTS = ["x.com", "www.x.com", "twitter.com", "www.twitter.com"]
# ---------------------------------------------------------------------------

# JavaScript String.prototype.trim() whitespace (Java's \s is ASCII only).
JS_WS = "\\x{09}-\\x{0D}\\x{20}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"

_URL_RE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(.*)$"
_SPECIAL_RE = r"(?s)^[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTH_RE = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::(.*))?$"
_DOTTED_QUAD = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
_FORBIDDEN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"


def js_trim(c: Column) -> Column:
    """String.prototype.trim(): strip Unicode whitespace at both ends."""
    return F.regexp_replace(c, f"^[{JS_WS}]+|[{JS_WS}]+$", "")


def js_trim_end(c: Column) -> Column:
    return F.regexp_replace(c, f"[{JS_WS}]+$", "")


def url_parts(raw: Column) -> Column:
    """Split a raw URL into a struct of WHATWG-style parts.

    Fields: input (trimmed, tabs/newlines removed), scheme (lower case),
    userinfo, host (lower case, brackets kept), port (as typed), path,
    query (with '?', or NULL), valid (parses as an absolute special URL or
    any other absolute URL).
    """
    s = F.regexp_replace(js_trim(raw), "[\\t\\n\\r]", "")
    s = F.regexp_replace(s, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    scheme = F.lower(F.regexp_extract(s, _URL_RE, 1))
    rest = F.regexp_extract(s, _URL_RE, 2)
    special = scheme.isin("http", "https")
    authority = F.regexp_extract(rest, _SPECIAL_RE, 1)
    path = F.regexp_replace(F.regexp_extract(rest, _SPECIAL_RE, 2), r"\\", "/")
    query = F.when(F.regexp_extract(rest, _SPECIAL_RE, 3) != "",
                   F.regexp_extract(rest, _SPECIAL_RE, 3))
    userinfo = F.regexp_extract(authority, _AUTH_RE, 1)
    host = F.lower(F.regexp_extract(authority, _AUTH_RE, 2))
    port = F.regexp_extract(authority, _AUTH_RE, 3)
    bare = F.regexp_replace(host, r"\.$", "")
    last_label_numeric = F.regexp_extract(bare, r"([^.]*)$", 1).rlike(r"^(0[xX][0-9a-fA-F]*|[0-9]+)$")
    host_ok = (
        (host != "")
        & ~(host.rlike(_FORBIDDEN_HOST) & ~host.rlike(r"^\[[0-9a-f:.]+\]$"))
        & (~last_label_numeric | bare.rlike(_DOTTED_QUAD))
    )
    port_ok = (port == "") | (port.rlike("^[0-9]{1,5}$") & (port.cast("int") <= 65535))
    has_scheme = s.rlike(_URL_RE)
    valid = F.when(~has_scheme, F.lit(False)).when(special, host_ok & port_ok).otherwise(F.lit(True))
    return F.struct(
        s.alias("input"), scheme.alias("scheme"), userinfo.alias("userinfo"),
        host.alias("host"), port.alias("port"), path.alias("path"), query.alias("query"),
        valid.alias("valid"), blocked_host(host).alias("blocked"),
    )


def is_ipv4(addr: Column) -> Column:
    return addr.rlike(_DOTTED_QUAD)


def is_ipv6(addr: Column) -> Column:
    return addr.contains(":") & addr.rlike(r"^[0-9A-Fa-f:.]+$")


def private_ipv4(addr: Column) -> Column:
    """The 13 reserved IPv4 ranges; malformed input counts as private."""
    o = F.split(addr, r"\.", -1)
    a, b, c = (F.try_element_at(o, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    malformed = (F.size(o) != 4) | ~F.forall(o, lambda x: x.rlike("^[0-9]+$"))
    return F.when(malformed, F.lit(True)).otherwise(
        (a == 0) | (a == 10) | (a == 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 0) & (c == 0))
        | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 224)
    )


def private_ipv6(addr: Column) -> Column:
    """Loopback, unspecified, ULA, link-local, documentation, mapped v4."""
    n = F.lower(addr)
    mapped = F.regexp_extract(n, r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    return F.when(mapped != "", private_ipv4(mapped)).otherwise(
        n.isin("::", "::1") | n.startswith("fc") | n.startswith("fd")
        | n.rlike("^fe[89ab]") | n.startswith("2001:db8:")
    )


def address_kind(addr: Column) -> Column:
    return F.when(is_ipv4(addr), F.lit(4)).when(is_ipv6(addr), F.lit(6)).otherwise(F.lit(0))


def private_address(addr: Column) -> Column:
    """v4 → P07, v6 → P08, anything that is not an IP literal → unsafe."""
    return (F.when(is_ipv4(addr), private_ipv4(addr))
            .when(is_ipv6(addr), private_ipv6(addr))
            .otherwise(F.lit(True)))


def blocked_host(host: Column) -> Column:
    """P06 + the IP-literal part of P10 on a lower-case host."""
    h = F.regexp_replace(host, r"\.$", "")
    inner = F.regexp_replace(h, r"^\[|\]$", "")
    suffix = F.lit(False)
    for sfx in BLOCKED_HOST_SUFFIXES:
        suffix = suffix | h.endswith(sfx)
    ip = is_ipv4(inner) | (h.startswith("[") & is_ipv6(inner))
    return (h == "localhost") | suffix | (ip & private_address(inner))


def reason_p(p: Column, raw: Column) -> Column:
    """P01–P10 on precomputed parts ``p`` (see :func:`url_parts`)."""
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("missing_url"))
        .when(~p["valid"], F.lit("unparseable"))
        .when(~p["scheme"].isin("http", "https"), F.lit("scheme"))
        .when(~p["userinfo"].isin("", ":"), F.lit("credentials"))
        .when((p["port"] != "") & ~p["port"].try_cast("int").isin(80, 443), F.lit("port"))
        .when(p["blocked"], F.lit("private"))
    )


def rejection_reason(raw: Column) -> Column:
    """The first failing admission check, NULL when the URL is admitted.

    Convenience form; DataFrame operators should stage ``url_parts`` in its
    own projection (:func:`with_url_parts`) and call :func:`reason_p`.
    """
    return reason_p(url_parts(raw), raw)


def _encode_set(c: Column, chars: dict[str, str]) -> Column:
    for ch, enc in chars.items():
        c = F.replace(c, F.lit(ch), F.lit(enc))
    return c


def _encoded(raw: Column, chars: dict[str, str]) -> Column:
    """``raw`` with the given characters and all beyond ASCII percent-encoded.

    The conditions read ``raw`` itself, so that a part without such characters
    is passed on and nothing is computed twice.
    """
    some = _encode_set(raw, chars)
    pieces = F.regexp_extract_all(some, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[^\x00-\x7F]"), F.url_encode(p)).otherwise(p)), "")
    return (F.when(raw.rlike(r"[^\x00-\x7F]"), whole)
            .when(raw.rlike("[" + "".join(chars) + "]"), some).otherwise(raw))


_PATH_ENC = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D"}
_QUERY_ENC = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "'": "%27"}


_DOTS_RE = r"(^|/)(\.|%2[eE]){1,2}(/|$)"


def _dot_segments(path: Column) -> Column:
    """Remove '.' and '..' segments of a path that has some (as the WHATWG path parser does)."""
    parts = F.split(path, "/", -1)
    segs = F.slice(parts, 2, F.size(parts))
    n = F.size(segs)
    dots = [".", "%2e"]
    dotdots = ["..", "%2e%2e", ".%2e", "%2e."]

    def step(acc, e):
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        last = e["i"] == n
        return (F.when(F.lower(e["s"]).isin(*dotdots),
                       F.when(last, F.concat(popped, F.array(F.lit("")))).otherwise(popped))
                .when(F.lower(e["s"]).isin(*dots),
                      F.when(last, F.concat(acc, F.array(F.lit("")))).otherwise(acc))
                .otherwise(F.concat(acc, F.array(e["s"]))))

    idx = F.zip_with(segs, F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                     lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    out = F.aggregate(F.filter(idx, lambda e: e["s"].isNotNull()), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(out, "/"))


def _no_dots(path: Column) -> Column:
    """``path`` without '.' and '..' segments; one that has none is passed on."""
    return F.when(path.rlike(_DOTS_RE), _dot_segments(path)).otherwise(path)


def canonical_bits(p: Column) -> dict[str, Column]:
    """Port (with ``:``; empty if it is the default), path and query of the canonical form."""
    port_num = p["port"].try_cast("int")
    default = ((p["scheme"] == "http") & (port_num == 80)) | ((p["scheme"] == "https") & (port_num == 443))
    path = _encoded(p["path"], _PATH_ENC)
    return {
        "port": F.when((p["port"] == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port_num.cast("string"))),
        "path": F.when(p["path"] == "", F.lit("/")).when(p["path"].rlike(_DOTS_RE), _dot_segments(path)).otherwise(path),
        "query": F.coalesce(_encoded(p["query"], _QUERY_ENC), F.lit("")),
    }


def canonical_p(p: Column, reason: Column) -> Column:
    """U01 on precomputed parts: NULL when ``reason`` is not NULL."""
    bits = canonical_bits(p)
    url = F.concat(p["scheme"], F.lit("://"), p["host"], bits["port"], bits["path"], bits["query"])
    return F.when(reason.isNull(), url)


def canonical_url(raw: Column) -> Column:
    """Canonical form of an admitted URL (NULL when rejected).

    trim, lower-case scheme and host, drop the fragment and a default port,
    '/' for an empty path, keep the query.
    """
    p = url_parts(raw)
    return canonical_p(p, reason_p(p, raw))


def with_url_parts(df, url_col: str, out: str = "_u"):
    """Add the URL anatomy of ``url_col`` as struct column ``out``.

    Staged over three projections (input → scheme/rest → authority parts)
    so each regex runs once per row and later expressions read attributes
    instead of re-inlining the regex tree (Catalyst does not collapse a
    projection whose non-cheap output is referenced more than once).
    """
    raw = F.col(url_col)
    s = F.regexp_replace(F.regexp_replace(js_trim(raw), "[\\t\\n\\r]", ""),
                         "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    t = f"{out}_t"
    df = df.withColumn(f"{t}s", s)
    ts = F.col(f"{t}s")
    df = (df.withColumn(f"{t}scheme", F.lower(F.regexp_extract(ts, _URL_RE, 1)))
            .withColumn(f"{t}rest", F.regexp_extract(ts, _URL_RE, 2))
            .withColumn(f"{t}has", ts.rlike(_URL_RE)))
    rest = F.col(f"{t}rest")
    df = (df.withColumn(f"{t}auth", F.regexp_extract(rest, _SPECIAL_RE, 1))
            .withColumn(f"{t}path", F.regexp_replace(F.regexp_extract(rest, _SPECIAL_RE, 2), r"\\", "/"))
            .withColumn(f"{t}query", F.regexp_extract(rest, _SPECIAL_RE, 3)))
    auth = F.col(f"{t}auth")
    df = (df.withColumn(f"{t}user", F.regexp_extract(auth, _AUTH_RE, 1))
            .withColumn(f"{t}host", F.lower(F.regexp_extract(auth, _AUTH_RE, 2)))
            .withColumn(f"{t}port", F.regexp_extract(auth, _AUTH_RE, 3)))
    host, port, scheme = F.col(f"{t}host"), F.col(f"{t}port"), F.col(f"{t}scheme")
    bare = F.regexp_replace(host, r"\.$", "")
    last_numeric = F.regexp_extract(bare, r"([^.]*)$", 1).rlike(r"^(0[xX][0-9a-fA-F]*|[0-9]+)$")
    host_ok = ((host != "") & ~(host.rlike(_FORBIDDEN_HOST) & ~host.rlike(r"^\[[0-9a-f:.]+\]$"))
               & (~last_numeric | bare.rlike(_DOTTED_QUAD)))
    port_ok = (port == "") | (port.rlike("^[0-9]{1,5}$") & (port.try_cast("int") <= 65535))
    valid = (F.when(~F.col(f"{t}has"), F.lit(False))
             .when(scheme.isin("http", "https"), host_ok & port_ok).otherwise(F.lit(True)))
    q = F.col(f"{t}query")
    # The struct is emitted by a one-row generator: Catalyst pushes filters
    # through projections by re-inlining their expressions, but it cannot push
    # a predicate on a generated column below the Generate, so a later
    # ``where(verdict == 'ok')`` does not copy the regex tree into the scan or
    # the join condition.
    df = df.select("*", F.explode(F.array(F.struct(
        ts.alias("input"), scheme.alias("scheme"), F.col(f"{t}user").alias("userinfo"), host.alias("host"),
        port.alias("port"), F.col(f"{t}path").alias("path"), F.when(q != "", q).alias("query"),
        valid.alias("valid"), blocked_host(host).alias("blocked")))).alias(out))
    return df.drop(*[f"{t}{x}" for x in ("s", "scheme", "rest", "has", "auth", "path", "query", "user", "host", "port")])


def path_p(p: Column) -> Column:
    return F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])


def url_host(url: Column) -> Column:
    """Lower-case hostname of an absolute URL (brackets kept for IPv6)."""
    return url_parts(url)["host"]


def url_path(url: Column) -> Column:
    return path_p(url_parts(url))


def cache_key(url: Column) -> Column:
    """``results/v2/<sha256 hex>.json`` of the canonical URL."""
    return F.concat(F.lit("results/v2/"), F.sha2(url, 256), F.lit(".json"))


def is_post_p(p: Column) -> Column:
    """X.com / twitter.com (± www) with /user/(status|article)/digits."""
    return (p["valid"] & p["host"].isin(*POST_HOSTS)
            & path_p(p).rlike(r"^/[^/]+/(?:status|article)/[0-9]+"))


def is_post_url(url: Column) -> Column:
    return is_post_p(url_parts(url))


def post_ref_p(p: Column) -> Column:
    """struct(id, username, error) — username 'i' and foreign hosts rejected."""
    host = F.regexp_replace(p["host"], r"^www\.", "")
    path = path_p(p)
    rx = r"(?i)^/([^/]+)/(?:status|article)/([0-9]+)"
    user = F.regexp_extract(path, rx, 1)
    pid = F.regexp_extract(path, rx, 2)
    err = (F.when(~p["valid"], F.lit("Enter a complete X or Twitter URL."))
           .when(~host.isin("x.com", "twitter.com"), F.lit("Only x.com and twitter.com URLs are supported."))
           .when((pid == "") | (F.lower(user) == "i"),
                 F.lit("Use the post URL (x.com/user/status/…) or author article URL (x.com/user/article/…).")))
    return F.struct(F.when(err.isNull(), pid).alias("id"), F.when(err.isNull(), user).alias("username"),
                    err.alias("error"))


def post_ref(url: Column) -> Column:
    return post_ref_p(url_parts(url))


def url_decode_component(c: Column) -> Column:
    """decodeURIComponent: '+' stays literal; invalid escapes → NULL."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def encode_uri_component(c: Column) -> Column:
    """encodeURIComponent on top of url_encode (form encoding)."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("*", "*")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def wiki_title_p(p: Column) -> Column:
    """Article title of a /wiki/<Title> URL on wikipedia.org, else NULL."""
    seg = F.regexp_extract(path_p(p), r"^/wiki/([^/]+)$", 1)
    title = url_decode_component(seg)
    ns = "|".join(WIKI_NAMESPACES)
    return F.when(
        p["valid"] & p["host"].rlike(r"(?i)(^|\.)wikipedia\.org$") & (seg != "")
        & title.isNotNull() & (title != "") & (title != "Main_Page")
        & ~title.rlike(f"(?i)^({ns}):"),
        title,
    )


def wiki_title(url: Column) -> Column:
    return wiki_title_p(url_parts(url))


def route_p(p: Column) -> Column:
    """Provider route — post API, encyclopedia API, or direct fetch."""
    return (F.when(is_post_p(p), F.lit("x-fxtwitter"))
            .when(wiki_title_p(p).isNotNull(), F.lit("mediawiki"))
            .otherwise(F.lit("direct")))


def route(url: Column) -> Column:
    return route_p(url_parts(url))


def resolve_location(base: Column, loc: Column) -> Column:
    """``new URL(location, base)`` for absolute, scheme-relative,
    root-relative, query-only, fragment-only and path-relative locations;
    ``.`` and ``..`` segments are resolved."""
    return resolve_location_p(url_parts(base), loc)


def is_scanner_path(path: Column) -> Column:
    """Known vulnerability-scanner paths (case-insensitive)."""
    p = F.lower(path)
    return (
        p.isin(*SCANNER_PATHS)
        | p.isin("/.env", "/.git", "/.hg", "/.svn")
        | p.startswith("/.env.") | p.startswith("/.git/") | p.startswith("/.hg/") | p.startswith("/.svn/")
        | p.startswith("/wp-") | p.startswith("/wordpress/") | p.endswith(".php")
    )


def resolve_location_p(p: Column, loc: Column) -> Column:
    """U11 with the base URL given as staged parts ``p`` (an attribute), for
    use inside per-node lambdas where the base is constant per page."""
    port = F.when(p["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    origin = F.concat(p["scheme"], F.lit("://"), p["host"], port)
    base_path = path_p(p)
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    query = F.coalesce(p["query"], F.lit(""))
    l = js_trim(loc)
    path = F.regexp_extract(l, r"(?s)^([^?#]*)", 1)
    rest = F.substring(l, F.length(path) + 1, F.length(l))
    absolute = F.when(l.startswith("//"), F.concat(p["scheme"], F.lit(":"), l)).otherwise(l)
    head = F.regexp_extract(absolute, r"(?is)^(https?://[^/?#]*)", 1)
    tail = F.substring(absolute, F.length(head) + 1, F.length(absolute))
    tail_path = F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)
    return (
        F.when(l.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | l.startswith("//"),
               F.when(head == "", absolute).otherwise(
                   F.concat(head, _no_dots(tail_path), F.substring(tail, F.length(tail_path) + 1, F.length(tail)))))
        .when(l.startswith("/"), F.concat(origin, _no_dots(path), rest))
        .when(l.startswith("?"), F.concat(origin, base_path, l))
        .when(l.startswith("#"), F.concat(origin, base_path, query, l))
        .when(l == "", F.concat(origin, base_path, query))
        .otherwise(F.concat(origin, _no_dots(F.concat(base_dir, path)), rest))
    )
