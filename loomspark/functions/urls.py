"""URL algebra as Column expressions: everything stays in the JVM.

A URL is taken apart with one pattern per part and put together in the form that the WHATWG
serialisation gives: scheme and host in lower case, hosts in their ASCII and address forms
(``hosts``), default ports dropped, dot segments resolved, blanks and other than ASCII
percent-encoded. What doesn't parse is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hosts
from .hosts import let as _let

#: A port is a number up to 65535, or nothing.
_PORT = r"0*(\d{1,4}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5])"
_HEAD = rf"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@\s]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\s]+)(?::(?:{_PORT})?)?(?=[/?#]|\s*$)"
_NONE: Sequence[str] = ()

# What takes part in the public-address policy and the search categories.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")
RESEARCH_SITES = ("arxiv.org", "pubmed.ncbi.nlm.nih.gov", "nature.com")
BLOCKED_KINDS = ("image", "media", "font")


def _percent(part: Column, more: str = "") -> Column:
    """Percent-encodes all but printable ASCII, and the characters in ``more``."""
    unsafe = rf"[^\x21-\x7E]|[{re.escape(more)}]" if more else r"[^\x21-\x7E]"
    one = lambda c: F.when(c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).otherwise(c)
    return _let(part, lambda p: F.when(p.rlike(unsafe), F.array_join(F.transform(F.split(p, ""), one), "")).otherwise(p))


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _HEAD, 1)), F.lit(""))


def host(url: Column) -> Column:
    """The host in its canonical form (ASCII; addresses dotted or in brackets); null if it is none."""
    return _let(F.lower(F.regexp_extract(url, _HEAD, 2)), lambda h: F.when(h.startswith("["), hosts.address6(h)).when(h != "", hosts.domain(h)))


def _canonical_host(url: Column) -> Column:
    """The host of a URL that is in canonical form already."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1), F.lit(""))


def port(url: Column) -> Column:
    """The port as text, null if it is none or the scheme's own."""
    p = F.nullif(F.regexp_extract(url, _HEAD, 3), F.lit(""))
    own = ((scheme(url) == "http") & (p == "80")) | ((scheme(url) == "https") & (p == "443"))
    return F.when(~own, p)


def _dots(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments with one fold over the segments."""
    fold = F.aggregate(
        F.split(F.substr(path, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(F.lower(s).isin("..", "%2e%2e", ".%2e", "%2e."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(F.lower(s).isin(".", "%2e"), done).otherwise(F.concat(done, F.array(s))),
    )
    open_end = path.rlike(r"/(?:\.|%2[eE]){1,2}$")
    return F.when(path.rlike(r"/(?:\.|%2[eE]){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(fold, "/"), F.when(open_end & (F.size(fold) > 0), F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def path(url: Column) -> Column:
    p = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    plain = lambda v: ~v.rlike(r"""[^\x21-\x7E]|["<>`{}]|/(?:\.|%2[eE]){1,2}(?:/|$)""")
    return _let(F.coalesce(F.nullif(p, F.lit("")), F.when(p.isNotNull(), F.lit("/"))), lambda v: F.when(plain(v), v).otherwise(_let(_percent(v, '"<>`{}'), _dots)))


def query(url: Column) -> Column:
    """Without the question mark; null if there's none."""
    q = F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)
    return F.when(F.trim(url).rlike(r"^[^?#]*\?"), _percent(q, "\"<>'"))


def fragment(url: Column) -> Column:
    f = F.regexp_extract(F.trim(url), r"#(.*)$", 1)
    return F.when(F.trim(url).contains("#"), _percent(f, '"<>`'))


def _built(url: Column, scheme_: Column, host_: Column, path_: Column, query_: Column, fragment_: Column) -> Column:
    some = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c), F.lit(""))
    return F.concat(scheme_, F.lit("://"), host_, some(":", port(url)), path_, some("?", query_), some("#", fragment_))


def parsed(url: Column) -> Column:
    """The normal form of an http or https URL; null for anything else."""
    return F.when(scheme(url).isin("http", "https"), _built(url, scheme(url), host(url), path(url), query(url), fragment(url)))


def canonical(url: Column, ignore_query: bool = False) -> Column:
    """URL1: fragments go unless they are routes (``#/`` or ``#!/``); the query goes on demand."""
    f = fragment(url)
    kept = F.when(f.startswith("/") | f.startswith("!/"), f)
    return F.when(scheme(url).isin("http", "https"), _built(url, scheme(url), host(url), path(url), F.lit(None).cast("string") if ignore_query else query(url), kept))


def similarity_key(url: Column, similar: bool = True) -> Column:
    """URL2: one leading ``www.``, index pages, trailing slashes and https don't tell URLs apart;
    query and fragment do. What doesn't parse is its own key."""
    if not similar:
        return url
    p = F.regexp_replace(path(url), r"/index\.(?:html|php)$", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.coalesce(_built(url, F.lit("http"), F.regexp_replace(host(url), r"^www\.", ""), p, query(url), fragment(url)), url)


def robots_url(url: Column) -> Column:
    """URL6."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(url)), F.lit("")), F.lit("/robots.txt"))


def sitemap_url(url: Column) -> Column:
    """SRC7: the port is dropped."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/sitemap.xml"))


def _bare(h: Column) -> Column:
    return F.regexp_replace(h, r"^(?:www\.)+", "")


def _scope_base(base: Column) -> Column:
    """What the scope takes of a base: host, its bare form and path."""
    return _let(host(base), lambda h: F.struct(h.alias("host"), F.coalesce(_bare(h), F.lit("")).alias("bare"), path(base).alias("path")))


def _in_scope(link: Column, base: Column, include_subdomains: bool, allow_external: bool, entire_domain: bool) -> Column:
    h, b = F.coalesce(_bare(_canonical_host(link)), F.lit("")), base["bare"]
    same = (h == b) | (h.endswith(F.concat(F.lit("."), b)) if include_subdomains else F.lit(False))
    below = F.lit(True) if entire_domain else ~same | path(link).startswith(base["path"])
    return (F.lit(allow_external) | same) & below


def in_scope(link: Column, base: Column, include_subdomains: bool = False, allow_external: bool = False, entire_domain: bool = False) -> Column:
    """FIL3, for a canonical link: same site (or its subdomains), and below the base's path by
    plain prefix unless the whole domain is asked for; external links skip the path test."""
    return _let(_scope_base(base), lambda b: _in_scope(link, b, include_subdomains, allow_external, entire_domain))


def scoped_links(links: Column, base: Column, search: str | None = None, ignore_query: bool = False, **scope: bool) -> Column:
    """FIL3 and FIL4 over an array: canonical, in scope, holding the search words; first of each."""
    wanted = {"include_subdomains": False, "allow_external": False, "entire_domain": False} | scope

    def kept(b: Column) -> Column:
        found = F.filter(F.transform(links, lambda u: canonical(u, ignore_query)), lambda u: u.isNotNull() & _in_scope(u, b, **wanted))
        if search is not None:
            found = F.filter(found, lambda u: F.lower(u).contains(search.lower()))
        return F.when(b["host"].isNull(), links).otherwise(F.array_distinct(found))

    return _let(_scope_base(base), kept)


def site_map(sitemap: Column, anchors: Column, base: Column, limit: int | Column = 100, mode: str = "include", ignore_sitemap: bool = False, **options) -> Column:
    """URL3, URL4, SET1, LIM1: a struct (links, provider). Each source is cut to the limit before
    the scope filter, the union after it; with nothing left, the start URL stands alone."""
    mode = "skip" if ignore_sitemap else mode
    if mode not in ("skip", "include", "only"):
        raise ValueError(f"sitemap must be skip, include or only, not {mode}")
    empty = F.array().cast("array<string>")
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = lambda x: F.slice(F.coalesce(x, empty), 1, limit)
    a = cut(sitemap) if mode != "skip" else empty
    b = cut(anchors) if mode != "only" else empty
    kept = scoped_links(F.concat(a, b), base, **options)
    names = F.array_compact(F.array(F.when(F.size(a) > 0, F.lit("sitemap")), F.when(F.size(b) > 0, F.lit("html_links"))))
    return F.struct(
        F.slice(F.when(F.size(kept) > 0, kept).otherwise(F.array(base)), 1, limit).alias("links"),
        F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(F.lit("html_links")).alias("provider"),
    )


def link_objects(links: Column) -> Column:
    """URL5."""
    return F.transform(links, lambda u: F.struct(u.alias("url")))


def valid_patterns(patterns: Sequence[str]) -> None:
    """FIL6: an invalid pattern is an error, and so is what only some dialects know (look-around,
    back-references)."""
    for p in patterns:
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", p):
            raise ValueError(f"look-around and back-references aren't supported: {p}")
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"invalid pattern {p}: {e}") from e


def allowed_by_patterns(url: Column, include: Sequence[str] = _NONE, exclude: Sequence[str] = _NONE, full_url: bool = False) -> Column:
    """FIL5: exclude beats include; no include allows all; not anchored; what doesn't parse is out."""
    valid_patterns([*include, *exclude])
    target = url if full_url else path(url)
    hit = lambda patterns: F.coalesce(F.greatest(F.lit(False), F.lit(False), *[target.rlike(p) for p in patterns]), F.lit(False))
    return host(url).isNotNull() & ~hit(exclude) & (hit(include) if include else F.lit(True))


def _on_domain(h: Column, domain: str) -> Column:
    domain = re.sub(r"^(?:www\.)+", "", domain).lower()
    return (h == domain) | h.endswith(f".{domain}")


def _any(found: Sequence[Column]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *found)


def domain_allowed(url: Column, include: Sequence[str] = _NONE, exclude: Sequence[str] = _NONE) -> Column:
    """FIL7: exact host or subdomain; ``www.`` goes from the filter, not from the host."""
    judged = lambda h: (_any([_on_domain(h, d) for d in include]) if include else F.lit(True)) & ~_any([_on_domain(h, d) for d in exclude])
    return _let(F.coalesce(host(url), F.lit("")), judged)


def category(url: Column, categories: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """FIL8: the first of (name, sites) that fits, in the order given. Research sites match by
    plain suffix, without a dot before."""
    def first(h: Column) -> Column:
        out = []
        for name, sites in categories:
            if name == "pdf":
                out.append(F.when(F.lower(path(url)).endswith(".pdf"), F.lit("pdf")))
            elif name == "github":
                out.append(F.when(_on_domain(h, "github.com"), F.lit("github")))
            elif name == "research":
                out.append(F.when(_any([h.endswith(s) for s in (*sites, *RESEARCH_SITES)]), F.lit("research")))
        return F.when(h.isNotNull(), F.coalesce(*out, F.lit(None).cast("string")))

    return _let(host(url), first)


def unwrapped(href: Column) -> Column:
    """SRC12: the target of a search provider's redirect link, decoded; else the link itself."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1)
    ours = F.coalesce(host(href).endswith("duckduckgo.com") | path(href).startswith("/l/"), F.lit(False))
    return F.when(ours & (target != ""), F.try_url_decode(target)).otherwise(href)


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    octet = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("bigint")
    return F.when(ok, octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4))


def public_ipv4(ip: Column) -> Column:
    """FIL12 for IPv4: not private, loopback, link-local, documentation, shared, benchmark,
    multicast, reserved or broadcast. Null if it isn't an address."""
    nets = []
    for net in PRIVATE_V4:
        address, bits = net.split("/")
        a = int.from_bytes(bytes(map(int, address.split("."))), "big")
        nets.append((a, a + (1 << (32 - int(bits))) - 1))
    return _let(ipv4_number(ip), lambda n: F.when(n.isNotNull(), ~_any([n.between(a, b) for a, b in nets])))


def public_ipv6(ip: Column) -> Column:
    """FIL12 for IPv6: not loopback, unique local, link-local, unspecified, multicast or a mapped
    IPv4 address that isn't public. Null if it isn't an address."""

    def judged(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        mapped = zeros(5) & (at(5) == 65535)
        dotted = F.concat_ws(".", *[x.cast("string") for i in (6, 7) for x in (F.shiftright(at(i), 8), at(i).bitwiseAND(255))])
        bad = (zeros(7) & at(7).isin(0, 1)) | (at(0).bitwiseAND(0xFE00) == 0xFC00) | (at(0).bitwiseAND(0xFFC0) == 0xFE80) | (at(0).bitwiseAND(0xFF00) == 0xFF00) | (mapped & ~public_ipv4(dotted))
        return F.when(g.isNotNull(), ~bad)

    return _let(hosts.groups6(ip), judged)


def public_ip(ip: Column) -> Column:
    """FIL12: for either kind of address; null for what is none."""
    return F.coalesce(public_ipv4(ip), public_ipv6(ip))


def admitted(url: Column) -> Column:
    """FIL13: a struct (url, error, message). Blanks around go; what begins with neither http:// nor
    https:// is given https://, other schemes too; local names and private IPv4 addresses are
    blocked (an address in brackets is judged where names are resolved). The URL stays as it was
    written."""

    def judged(raw: Column) -> Column:
        def error(h: Column) -> Column:
            return (
                F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.struct(F.lit("invalid_url").alias("e"), F.lit("URL is required").alias("m")))
                .when(h.isNull(), F.struct(F.lit("invalid_url").alias("e"), F.lit("Only http and https URLs are supported").alias("m")))
                .when((h == "localhost") | h.endswith(".localhost"), F.struct(F.lit("blocked_by_policy").alias("e"), F.lit("Localhost URLs are not allowed").alias("m")))
                .when(~F.coalesce(public_ipv4(h), F.lit(True)), F.struct(F.lit("blocked_by_policy").alias("e"), F.lit("Private network URLs are not allowed").alias("m")))
            )

        return _let(_let(host(raw), error), lambda x: F.struct(F.when(x.isNull(), raw).alias("url"), x["e"].alias("error"), x["m"].alias("message")))

    raw = F.trim(url)
    return _let(F.when(raw.rlike(r"^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw)), judged)


def blocked_resource(kind: Column, url: Column, ad_hosts: Sequence[str], block_media: bool = True) -> Column:
    """FIL11: the reason for which a page's resource is blocked, null if it isn't."""
    def reason(h: Column) -> Column:
        private = (h == "localhost") | h.endswith(".localhost") | F.coalesce(~public_ipv4(h), F.lit(False))
        return F.when(private, F.lit("private_host")).when(F.lit(block_media) & F.lower(kind).isin(*BLOCKED_KINDS), F.lit("media")).when(_any([h.contains(a) for a in ad_hosts]), F.lit("ad"))

    return _let(F.coalesce(host(url), F.lit("")), reason)
