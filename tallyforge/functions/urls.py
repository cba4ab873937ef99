"""URL scalars: normal form, domain, bucket, trust tier and candidate scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.fixed import BLOCKED_FRAGMENTS, BLOCKED_SUFFIXES, BUCKET_SCORES, NAME_STOP_WORDS, NEWS_FRAGMENTS, SOCIAL_FRAGMENTS, TIER_BASE, TRUSTED_PATH_WORDS
from tallyforge.functions.text import bound, has_any, strings


def normalize(url: Column) -> Column:
    """Without fragment and closing slashes, lower case, https."""
    bare = F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")), r"/+$", ""))
    return F.regexp_replace(bare, r"^http://", "https://")


def domain(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    full = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(u == "", "").otherwise(F.replace(F.lower(F.regexp_extract(full, r"^[A-Za-z]+://([^/?#]*)", 1)), F.lit("www."), F.lit("")))


def root_home(url: Column) -> Column:
    return F.concat(F.lit("https://"), domain(url))


def bucket(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))

    def any_of(*words: str) -> Column:
        return has_any(u, words)

    return (
        F.when(any_of("/contact", "/reach", "get-in-touch", "/submit", "/pitch", "/apply"), "contact")
        .when(any_of("/team", "/people", "/leadership", "/partners", "/staff"), "team")
        .when(any_of("/portfolio", "/companies", "/investments", "/portfolio-companies"), "portfolio")
        .when(any_of("/careers", "/jobs", "/join", "/hiring"), "careers")
        .when(any_of("/news", "/press", "/media", "/blog"), "news")
        .otherwise("general")
    )


def bucket_score(b: Column) -> Column:
    out = F.lit(None)
    for name, score in BUCKET_SCORES.items():
        out = F.when(b == name, float(score)).otherwise(out)
    return out


def blocked(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    ends = F.lit(False)
    for s in BLOCKED_SUFFIXES:
        ends = ends | u.endswith(s)
    return (u == "") | ends | has_any(u, BLOCKED_FRAGMENTS)


def tier(url: Column, official: Column) -> Column:
    d = domain(url)
    own = (official != "") & ((d == official) | d.endswith(F.concat(F.lit("."), official)))
    return F.when(own, "official").when(has_any(d, NEWS_FRAGMENTS), "news").otherwise("other")


def tier_base(t: Column) -> Column:
    return F.when(t == "official", TIER_BASE["official"]).when(t == "news", TIER_BASE["news"]).otherwise(TIER_BASE["other"])


def candidate_score(url: Column, title: Column, body: Column, name: Column, official: Column) -> Column:
    """Tier base, bucket, bonuses for name, official domain and path words, less all penalties that apply."""
    u = F.lower(F.coalesce(url, F.lit("")))
    named = F.contains(F.lower(F.concat_ws(" ", title, body)), F.lower(name)) & (name != "")
    return (
        tier_base(tier(url, official))
        + bucket_score(bucket(url))
        + F.when(named, 18.0).otherwise(0.0)
        + F.when((official != "") & F.contains(u, official), 25.0).otherwise(0.0)
        + F.when(has_any(u, TRUSTED_PATH_WORDS), 5.0).otherwise(0.0)
        - F.when(u.endswith(".pdf"), 80.0).otherwise(0.0)
        - F.when(F.contains(u, F.lit("linkedin.com/in/")), 25.0).otherwise(0.0)
        - F.when(has_any(u, SOCIAL_FRAGMENTS), 18.0).otherwise(0.0)
        - F.when(has_any(u, BLOCKED_FRAGMENTS), 10.0).otherwise(0.0)
    )


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def name_tokens(name: Column) -> Column:
    """Words of a name that carry meaning; all of them where none does."""
    every = F.filter(F.split(phrase(name), " "), lambda t: F.length(t) > 1)
    own = F.filter(every, lambda t: ~F.array_contains(strings(NAME_STOP_WORDS), t))
    return F.when(F.size(own) > 0, own).otherwise(every)


def entity_matches(name: Column, website: Column, text: Column, url: Column) -> Column:
    """Whether a page is about a named entity: phrase, own domain, short compact name, enough tokens, or the URL."""
    body, where, own, short = F.lower(F.coalesce(text, F.lit(""))), domain(url), domain(website), compact(name)
    words = F.array_distinct(name_tokens(name))
    n = F.size(words)
    need = F.least(F.lit(2), n)
    got = F.size(F.filter(words, lambda t: F.contains(body, t)))
    link = F.lower(F.coalesce(url, F.lit("")))
    in_url = F.size(F.filter(words, lambda t: F.contains(link, t)))
    same_site = (own != "") & (where != "") & ((where == own) | where.endswith(F.concat(F.lit("."), own)))
    brief = (short != "") & (F.length(short) <= 6) & (F.contains(compact(text), short) | F.contains(F.replace(where, F.lit(".")), short))
    enough = (got >= need) & (got >= 0.6 * n)
    mentioned = ((short != "") & F.contains(compact(url), short)) | (in_url >= need)
    return ((phrase(name) != "") & F.contains(body, phrase(name))) | same_site | brief | ((n > 0) & (enough | mentioned))


# ---- references of pages, after RFC 3986 ------------------------------------------------

#: Schemes whose references may be relative (fixed values that Python's urljoin has, of those that pages use).
RELATIVE_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss")


def url_parts(url: Column) -> Column:
    """whole, scheme (small), host with what stands beside it (null: none), path, query and fragment (empty: none) of a reference.
    Blanks before it, and line breaks and tabs within, do not count."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    schemed = bound(clean, lambda u: F.struct(u.alias("whole"), F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", "").alias("rest")))

    def parts(x: Column) -> Column:
        tail = F.regexp_replace(x.rest, r"^//[^/?#]*", "")
        return F.struct(
            x.whole.alias("whole"), x.scheme.alias("scheme"), F.when(x.rest.startswith("//"), F.regexp_extract(x.rest, r"^//([^/?#]*)", 1)).alias("host"),
            F.regexp_extract(tail, r"^([^?#]*)", 1).alias("path"), F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1).alias("query"), F.regexp_extract(tail, r"(?s)^[^#]*#(.*)", 1).alias("fragment"),
        )

    return bound(schemed, parts)


def without_dots(segments: Column) -> Column:
    """Segments of a path with "." left out and ".." taking away the one before, as a fold over a stack; a path that ends in
    one of them ends in a slash."""
    stack = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))),
    )
    return F.concat(stack, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))


def _merged(base: Column, path: Column) -> Column:
    """A path that is not empty, on the page with the path `base`."""
    above = F.split(base, "/", -1)
    # the base's last segment is the page itself, but for the empty one behind a slash
    folder = F.slice(above, 1, F.size(above) - F.when(F.element_at(above, -1) == "", 0).otherwise(1))
    # empty segments within a joined path do not count
    both = bound(F.concat(folder, F.split(path, "/", -1)), lambda raw: F.filter(raw, lambda s, i: (i == 0) | (i == F.size(raw) - 1) | (s != "")))
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(both)
    return bound(F.array_join(bound(segments, without_dots), "/"), lambda p: F.when(p == "", "/").otherwise(p))


def joined(base: Column, href: Column) -> Column:
    """The absolute URL of a reference that stands on the page `base`, as browsers and Python's urljoin have it."""
    def text(b: Column, host: Column, path: Column, query: Column, fragment: Column) -> Column:
        rooted = bound(path, lambda p: F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p))
        return F.concat(b.scheme, F.lit("://"), F.coalesce(host, F.lit("")), rooted, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))

    def both(b: Column, r: Column) -> Column:
        own = ((r.scheme == "") | (r.scheme == b.scheme)) & r.scheme.isin("", *RELATIVE_SCHEMES)
        hosted = r.host.isNotNull() & (r.host != "")
        path = F.when(hosted, r.path).when(r.path == "", b.path).otherwise(_merged(b.path, r.path))
        query = F.when(~hosted & (r.path == "") & (r.query == ""), b.query).otherwise(r.query)
        made = text(b, F.when(hosted, r.host).otherwise(b.host), path, query, r.fragment)
        return F.when(r.whole == "", b.whole).when(~own, r.whole).otherwise(made)

    given = bound(F.struct(url_parts(base).alias("b"), url_parts(href).alias("r")), lambda x: both(x.b, x.r))
    return F.when(F.coalesce(base, F.lit("")) == "", F.coalesce(href, F.lit(""))).otherwise(given)


def anchors(html: Column) -> Column:
    """pos, href and text (without tags, blanks as one) of the links of a page, in order."""
    tag = r"(?is)(<a\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)[^>]*>.*?(?:</a\s*>|(?=<a\s)|$))"
    value = r"(?is)^<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*))"

    def plain(t: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))

    def one(t: Column, i: Column) -> Column:
        href = F.concat(*[F.regexp_extract(t, value, k) for k in (1, 2, 3)])
        body = F.regexp_replace(F.regexp_replace(t, r"(?s)^<[^>]*>", ""), r"<[^>]*>", " ")
        return F.struct(i.alias("pos"), F.trim(plain(href)).alias("href"), F.trim(F.regexp_replace(plain(body), r"\s+", " ")).alias("text"))

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(tag), F.lit(1)), one)
