"""DuckDB SQL expression builders for the oracle side of each query.

The oracle SQL is written independently of the Spark plans; these helpers
only keep the DuckDB text readable (``url_parts`` etc. are long regexes).
Each takes SQL text and returns SQL text.
"""

from __future__ import annotations

from pagemill.functions import urls as U

JS_WS = U.JS_WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def js_trim(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^[{JS_WS}]+|[{JS_WS}]+$')}, '', 'g')"


def trimmed_input(e: str) -> str:
    s = f"regexp_replace({js_trim(e)}, '[\\t\\n\\r]', '', 'g')"
    return f"regexp_replace({s}, '^[\\x{{00}}-\\x{{20}}]+|[\\x{{00}}-\\x{{20}}]+$', '', 'g')"


URL_RE = U._URL_RE
SPECIAL_RE = U._SPECIAL_RE
AUTH_RE = U._AUTH_RE
DOTTED_QUAD = U._DOTTED_QUAD


def rx(e: str, pattern: str, g: int) -> str:
    return f"regexp_extract({e}, {q(pattern)}, {g})"


def parts_cte(src: str, raw: str, extra: str = "*") -> str:
    """A SELECT adding URL anatomy columns (u_*) over ``src`` for column ``raw``."""
    s = trimmed_input(raw)
    return f"""
    select {extra}, u_input, u_scheme, u_userinfo, u_host, u_port, u_path, u_query,
      (case when not regexp_matches(u_input, {q(URL_RE)}) then false
            when u_scheme in ('http','https') then
              u_host <> ''
              and not (regexp_matches(u_host, {q(U._FORBIDDEN_HOST)}) and not regexp_matches(u_host, '^\\[[0-9a-f:.]+\\]$'))
              and (not regexp_matches(regexp_extract(regexp_replace(u_host, '\\.$', ''), '([^.]*)$', 1), '^(0[xX][0-9a-fA-F]*|[0-9]+)$')
                   or regexp_matches(regexp_replace(u_host, '\\.$', ''), {q(DOTTED_QUAD)}))
              and (u_port = '' or (regexp_matches(u_port, '^[0-9]{{1,5}}$') and try_cast(u_port as integer) <= 65535))
            else true end) as u_valid
    from (
      select *,
        lower({rx('u_auth', AUTH_RE, 2)}) as u_host,
        {rx('u_auth', AUTH_RE, 1)} as u_userinfo,
        {rx('u_auth', AUTH_RE, 3)} as u_port
      from (
        select *,
          {rx('u_rest', SPECIAL_RE, 1)} as u_auth,
          replace({rx('u_rest', SPECIAL_RE, 2)}, '\\', '/') as u_path,
          nullif({rx('u_rest', SPECIAL_RE, 3)}, '') as u_query
        from (
          select *, lower({rx('u_input', URL_RE, 1)}) as u_scheme, {rx('u_input', URL_RE, 2)} as u_rest
          from (select *, {s} as u_input from {src})
        )
      )
    )"""


def private_ipv4(a: str) -> str:
    o = f"string_split({a}, '.')"
    oc = lambda i: f"try_cast({o}[{i}] as integer)"
    A, B, C = oc(1), oc(2), oc(3)
    return f"""(case when len({o}) <> 4 or not list_bool_and(list_transform({o}, lambda x: regexp_matches(x, '^[0-9]+$'))) then true
      else ({A} = 0 or {A} = 10 or {A} = 127 or ({A} = 100 and {B} between 64 and 127)
        or ({A} = 169 and {B} = 254) or ({A} = 172 and {B} between 16 and 31)
        or ({A} = 192 and {B} = 0 and {C} = 0) or ({A} = 192 and {B} = 0 and {C} = 2)
        or ({A} = 192 and {B} = 168) or ({A} = 198 and {B} in (18, 19))
        or ({A} = 198 and {B} = 51 and {C} = 100) or ({A} = 203 and {B} = 0 and {C} = 113)
        or {A} >= 224) end)"""


def private_ipv6(a: str) -> str:
    n = f"lower({a})"
    m = f"regexp_extract({n}, '^::ffff:([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)$', 1)"
    return f"""(case when {m} <> '' then {private_ipv4(m)}
      else ({n} in ('::', '::1') or starts_with({n}, 'fc') or starts_with({n}, 'fd')
            or regexp_matches({n}, '^fe[89ab]') or starts_with({n}, '2001:db8:')) end)"""


def is_ipv4(a: str) -> str:
    return f"regexp_matches({a}, {q(DOTTED_QUAD)})"


def is_ipv6(a: str) -> str:
    return f"(contains({a}, ':') and regexp_matches({a}, '^[0-9A-Fa-f:.]+$'))"


def private_address(a: str) -> str:
    return f"(case when {is_ipv4(a)} then {private_ipv4(a)} when {is_ipv6(a)} then {private_ipv6(a)} else true end)"


def blocked_host(host: str) -> str:
    h = f"regexp_replace({host}, '\\.$', '')"
    inner = f"regexp_replace({h}, '^\\[|\\]$', '', 'g')"
    sfx = " or ".join(f"ends_with({h}, {q(s)})" for s in U.BLOCKED_HOST_SUFFIXES)
    ip = f"({is_ipv4(inner)} or (starts_with({h}, '[') and {is_ipv6(inner)}))"
    return f"({h} = 'localhost' or {sfx} or ({ip} and {private_address(inner)}))"


def rejection_reason(raw: str) -> str:
    """Requires the u_* columns of ``parts_cte`` in scope."""
    return f"""(case when {raw} is null or {raw} = '' then 'missing_url'
      when not u_valid then 'unparseable'
      when u_scheme not in ('http','https') then 'scheme'
      when u_userinfo not in ('', ':') then 'credentials'
      when u_port <> '' and try_cast(u_port as integer) not in (80, 443) then 'port'
      when {blocked_host('u_host')} then 'private' end)"""


def encode_set(e: str, chars: dict[str, str]) -> str:
    for a, b in chars.items():
        e = f"replace({e}, {q(a)}, {q(b)})"
    return e


def encode_non_ascii(e: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({e}, '[\\x00-\\x7F]+|[^\\x00-\\x7F]+'), "
            "lambda x: case when regexp_matches(x, '^[^\\x00-\\x7F]') then url_encode(x) else x end), '')")


def canonical_url(raw: str) -> str:
    """Requires u_* columns. Dot segments are not removed here: the base
    tables carry none (hand rows in pytest cover them)."""
    default = "((u_scheme = 'http' and try_cast(u_port as integer) = 80) or (u_scheme = 'https' and try_cast(u_port as integer) = 443))"
    port = f"(case when u_port = '' or {default} then '' else ':' || cast(try_cast(u_port as integer) as varchar) end)"
    path = f"(case when u_path = '' then '/' else {encode_non_ascii(encode_set('u_path', U._PATH_ENC))} end)"
    query = f"coalesce({encode_non_ascii(encode_set('u_query', U._QUERY_ENC))}, '')"
    return f"(case when {rejection_reason(raw)} is null then u_scheme || '://' || u_host || {port} || {path} || {query} end)"


def cache_key(url: str) -> str:
    return f"('results/v2/' || sha256({url}) || '.json')"


def url_path() -> str:
    return "(case when u_path = '' then '/' else u_path end)"


def is_post_url() -> str:
    hosts = ", ".join(q(h) for h in U.POST_HOSTS)
    return f"(u_valid and u_host in ({hosts}) and regexp_matches({url_path()}, '^/[^/]+/(?:status|article)/[0-9]+'))"


def url_decode_component(e: str) -> str:
    return f"try(url_decode(replace({e}, '+', '%2B')))"


def wiki_title() -> str:
    seg = f"regexp_extract({url_path()}, '^/wiki/([^/]+)$', 1)"
    t = url_decode_component(seg)
    ns = "|".join(U.WIKI_NAMESPACES)
    return f"""(case when u_valid and regexp_matches(u_host, '(?i)(^|\\.)wikipedia\\.org$') and {seg} <> ''
      and {t} is not null and {t} <> '' and {t} <> 'Main_Page'
      and not regexp_matches({t}, '(?i)^({ns}):') then {t} end)"""


def route() -> str:
    return f"(case when {is_post_url()} then 'x-fxtwitter' when {wiki_title()} is not null then 'mediawiki' else 'direct' end)"


def is_scanner_path(path: str) -> str:
    p = f"lower({path})"
    exact = ", ".join(q(s) for s in U.SCANNER_PATHS)
    return (f"({p} in ({exact}) or {p} in ('/.env','/.git','/.hg','/.svn') or starts_with({p}, '/.env.')"
            f" or starts_with({p}, '/.git/') or starts_with({p}, '/.hg/') or starts_with({p}, '/.svn/')"
            f" or starts_with({p}, '/wp-') or starts_with({p}, '/wordpress/') or ends_with({p}, '.php'))")


def encode_uri_component(e: str) -> str:
    """encodeURIComponent from DuckDB's url_encode (which keeps - _ . ~)."""
    x = f"url_encode({e})"
    for a, b in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def form_encode(e: str) -> str:
    """application/x-www-form-urlencoded (URLSearchParams / URLEncoder)."""
    x = f"url_encode({e})"
    for a, b in (("%2A", "*"), ("~", "%7E"), ("%20", "+")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x
