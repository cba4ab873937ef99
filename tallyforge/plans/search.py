"""Queries over search and crawl relations. Suppliers stand for investors, pages for results and crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import urls as U
from tallyforge.functions.fixed import DISCOVERY_WORDS, NEWS_FRAGMENTS, QUERY_TEMPLATES, TEXT_BUCKETS, TRUSTED_PATH_WORDS
from tallyforge.operators import search as S
from tallyforge.plans.book import Book, quoted, sql_any, sql_hits, table
from tallyforge.plans.text import BUCKET

book = Book()


def _variants(bias: bool) -> str:
    out = []
    for k, t in QUERY_TEMPLATES.items():
        plain = quoted([t.replace("{year}", "2002")])
        site = "CASE WHEN s_suppkey % 2 = 0 THEN 'site:x' || s_suppkey || '.com' ELSE '' END" if bias else "''"
        out.append(f"{{'key': '{k}', 'label': '{'primary' if bias else 'fallback_no_site_bias'}', 'query': trim(replace(replace({plain}, '{{name}}', s_name), '{{site_bias}}', {site}))}}")
    return "[" + ", ".join(out) + "]"


@book.query(f"WITH v AS (SELECT s_suppkey, unnest({_variants(True)}) AS p, unnest({_variants(False)}) AS f FROM supplier) SELECT s_suppkey, p.key AS key, p.label AS label, p.query AS query FROM v UNION ALL SELECT s_suppkey, f.key, f.label, f.query FROM v WHERE f.query <> p.query")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches to try for each investor."""
    k = F.col("s_suppkey")
    domain = F.when(k % 2 == 0, F.concat(F.lit("x"), k, F.lit(".com"))).otherwise("")
    return table(spark, sf_dir, "supplier").select(k, F.inline(S.query_variants(F.col("s_name"), domain, 2002)))


@book.query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'http://a.com' WHEN 1 THEN 'https://a.com,http://a.com' WHEN 2 THEN '' ELSE 'https://nan.org,http://nan.org' END AS homes FROM supplier")
def home_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    website = F.when(k % 4 == 0, " http://a.com ").when(k % 4 == 1, "a.com").when(k % 4 == 2, "nan").otherwise("nan.org")
    return table(spark, sf_dir, "supplier").select(k, F.array_join(S.home_urls(website), ",").alias("homes"))


TAILS = ["", "#top", "/", "/Team", "/portfolio", "/x.pdf", "/tag/a"]
OWN = "'https://acme' || (page_id % 20) || [{t}][(page_id % 7 + 1)::INT]".format(t=quoted([".com", ".com/", ".com/Team", ".com/portfolio", ".com/x.pdf", ".com/tag/a", ".org/blog"]))
NEWS = "'http://Reuters.com/n' || (page_id % 30)"
HREF = f"CASE page_id % 4 WHEN 0 THEN {NEWS} WHEN 3 THEN 'ftp://x.com/a' ELSE {OWN} END"
FOUND = f"""h AS (SELECT page_id, page_id % 10 AS g, {HREF} AS href, CASE WHEN page_id % 3 = 0 THEN 'Acme ' || (page_id % 10) || ' Capital' ELSE 'listing' END AS title, repeat('b', (page_id % 5)::INT) AS body FROM pages WHERE page_id % 4 <> 3),
z AS (SELECT *, regexp_replace(regexp_replace(lower(href), '/+$', ''), '^http://', 'https://') AS u FROM h), w AS (SELECT * FROM z WHERE NOT ends_with(u, '.pdf') AND NOT contains(u, '/tag/')),
b AS (SELECT g, u, title, body FROM w QUALIFY row_number() OVER (PARTITION BY g, u ORDER BY length(title) + length(body) DESC, page_id) = 1)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers: pages' made-up links, with repeats of one URL in several writings, blocked ones and other schemes."""
    k = F.col("page_id")
    tail = F.get(F.array(*map(F.lit, (".com#top", ".com/", ".com/Team", ".com/portfolio", ".com/x.pdf", ".com/tag/a", ".org/blog"))), (k % 7).cast("int"))
    href = F.when(k % 4 == 0, F.concat(F.lit("http://Reuters.com/n"), k % 30)).when(k % 4 == 3, "ftp://x.com/a.pdf").otherwise(F.concat(F.lit("https://acme"), k % 20, tail))
    return table(spark, sf_dir, "pages").select(k, (k % 10).alias("g"), href.alias("href"), F.when(k % 3 == 0, F.concat(F.lit("Acme "), k % 10, F.lit(" Capital"))).otherwise("listing").alias("title"), F.expr("repeat('b', cast(page_id % 5 as int))").alias("body"))


@book.query(f"WITH {FOUND} SELECT g, u AS url, title, body FROM b")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each URL that a search found, the entry with most text."""
    return S.result_urls(entries(spark, sf_dir), ["g"], "page_id")


DOMAIN = "regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)"
RANKED = f"""{FOUND}, t AS (SELECT g, u, title, CASE WHEN {DOMAIN} = 'acme' || g || '.com' THEN 'official' WHEN {sql_any(DOMAIN, NEWS_FRAGMENTS)} THEN 'news' ELSE 'other' END AS tier FROM b ANTI JOIN (SELECT DISTINCT page_id % 10 AS g, 'https://reuters.com/n' || (page_id % 30) AS u FROM pages WHERE page_id % 8 = 0) USING (g, u)),
s AS (SELECT *, (CASE tier WHEN 'official' THEN 120 WHEN 'news' THEN 55 ELSE 8 END + CASE {BUCKET} WHEN 'portfolio' THEN 14 WHEN 'team' THEN 14 WHEN 'contact' THEN 12 WHEN 'careers' THEN 10 WHEN 'news' THEN 9 ELSE 2 END + CASE WHEN contains(lower(title), 'acme ' || g) THEN 18 ELSE 0 END
  + CASE WHEN contains(u, 'acme' || g || '.com') THEN 25 ELSE 0 END + CASE WHEN {sql_any('u', TRUSTED_PATH_WORDS)} THEN 5 ELSE 0 END)::DOUBLE AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, u)::INT AS rank FROM s)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled = table(spark, sf_dir, "pages").filter("page_id % 8 = 0").select((F.col("page_id") % 10).alias("g"), F.concat(F.lit("http://REUTERS.com/n"), F.col("page_id") % 30, F.lit("#a")).alias("url"))
    name, official = F.concat(F.lit("Acme "), "g"), F.concat(F.lit("acme"), "g", F.lit(".com"))
    return S.ranked_urls(search_results(spark, sf_dir), ["g"], crawled, name, official)


@book.query(f"WITH {RANKED} SELECT g, u AS url, tier, round(score, 2) AS score, rank FROM r WHERE rank <= 12")
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best URLs of each investor that were not crawled already."""
    return S.shown(ranked(spark, sf_dir)).select("g", "url", "tier", "score", "rank")


TEXT = "CASE rank % 3 WHEN 0 THEN NULL WHEN 1 THEN 'acme ' || g || ' invests ' || rank ELSE 'of other things' END"


@book.query(
    f"""WITH {RANKED}, x AS (SELECT *, {TEXT} AS body FROM r), k AS (SELECT * FROM x WHERE body IS NOT NULL AND (tier = 'official' OR tier = 'news' AND score >= 35) AND (rank % 3 = 1 OR tier = 'official')),
q AS (SELECT *, row_number() OVER (PARTITION BY g, tier ORDER BY rank) AS n FROM k), y AS (SELECT * FROM q WHERE n <= CASE tier WHEN 'official' THEN 4 ELSE 2 END)
SELECT g, coalesce(string_agg(body, ' ' ORDER BY rank) FILTER (tier = 'official'), '') AS official_text, coalesce(string_agg(body, ' ' ORDER BY rank) FILTER (tier = 'news'), '') AS news_text, coalesce(string_agg(u, ',' ORDER BY rank) FILTER (tier = 'news'), '') AS news_urls,
  coalesce(string_agg(body, ' ' ORDER BY rank) FILTER (tier = 'official' AND {BUCKET} = 'team'), '') AS team_text FROM y GROUP BY g"""
)
def scraped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the ranked pages: only pages about the investor count, up to the quota of their tier."""
    rank = F.col("rank")
    text = F.when(rank % 3 == 1, F.concat(F.lit("Acme "), "g", F.lit(" invests "), rank)).when(rank % 3 == 2, "of other things")
    rows = S.scraped(ranked(spark, sf_dir).withColumn("text", text), ["g"], F.concat(F.lit("Acme "), "g"), F.concat(F.lit("acme"), "g", F.lit(".com")))
    return rows.select("g", "official_text", "news_text", F.array_join("news_urls", ",").alias("news_urls"), F.try_element_at("by_bucket", F.lit("team")).alias("team_text"))


@book.query(
    f"""WITH p AS (SELECT page_id, page_id // 7 AS g, (page_id % 7 + 1)::INT AS rank, CASE page_id % 7 WHEN 0 THEN 'https://acme.com' WHEN 1 THEN 'https://acme.com/team' WHEN 2 THEN 'https://other.org/team' ELSE 'https://acme.com/n' || (page_id % 7) END AS u, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'page ' || page_id END AS body FROM pages),
k AS (SELECT * FROM p WHERE rank <= 4 AND body IS NOT NULL AND rank <> 3)
SELECT g, string_agg(body, ' ' ORDER BY rank) AS combined_text, string_agg(u, ',' ORDER BY rank) AS urls, coalesce(string_agg(body, ' ' ORDER BY rank) FILTER (rank = 2), '') AS team_text, {len(TEXT_BUCKETS)} AS n_buckets FROM k GROUP BY g"""
)
def site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the first pages of each investor's site that are on it or about it."""
    k, at = F.col("page_id"), F.col("page_id") % 7
    url = F.when(at == 0, "https://acme.com").when(at == 1, "https://acme.com/team").when(at == 2, "https://other.org/team").otherwise(F.concat(F.lit("https://acme.com/n"), at))
    pages = table(spark, sf_dir, "pages").select(F.floor(k / 7).alias("g"), (at + 1).cast("int").alias("rank"), url.alias("url"), F.when(k % 5 != 0, F.concat(F.lit("Page "), k)).alias("text"))
    rows = S.site_evidence(pages, ["g"], F.lit("Acme Ventures"), F.lit("www.acme.com"))
    return rows.select("g", "combined_text", F.array_join("combined_urls", ",").alias("urls"), F.try_element_at("by_bucket", F.lit("team")).alias("team_text"), F.size("by_bucket").alias("n_buckets"))


LINKS = [("/about", "About us"), ("team/people?x=1", "who"), ("https://acme.com/portfolio", "x"), ("https://other.org/team", "team"), ("#team", "team"), ("mailto:a@b.c", "contact"), ("/a/b/c/d/e/news", "n"), ("/plain", "nothing"), ("/press/x.pdf", "press"), ("/about", "About the team")]
_L = "[" + ", ".join(f"{{'pos': {i}, 'href': {quoted([h])}, 'label': {quoted([t])}}}" for i, (h, t) in enumerate(LINKS)) + "]"


@book.query(
    f"""WITH l AS (SELECT page_id, unnest({_L}) AS x FROM pages), a AS (SELECT page_id, x.pos AS pos, x.href AS href, lower(x.label || ' ' || x.href) AS blob FROM l WHERE x.pos NOT IN (3, 4, 5, 8)),
s AS (SELECT page_id, pos, CASE href WHEN 'team/people?x=1' THEN 'https://acme.com/' || page_id || '/team/people?x=1' WHEN 'https://acme.com/portfolio' THEN href ELSE 'https://acme.com' || href END AS u, blob FROM a WHERE {sql_any('blob', DISCOVERY_WORDS)}),
c AS (SELECT page_id, pos, u, (10 + CASE {BUCKET} WHEN 'portfolio' THEN 14 WHEN 'team' THEN 14 WHEN 'contact' THEN 12 WHEN 'careers' THEN 10 WHEN 'news' THEN 9 ELSE 2 END + 2 * {sql_hits('blob', DISCOVERY_WORDS)} - CASE WHEN contains(u, '?') THEN 3 ELSE 0 END - CASE WHEN contains(u, '/a/b/c/') THEN 2 ELSE 0 END)::DOUBLE AS score FROM s
  UNION ALL SELECT page_id, -1, 'https://acme.com/' || page_id || '/', 100.0 FROM pages),
d AS (SELECT page_id, u, max(score) AS score, arg_max(pos, score) AS pos FROM c GROUP BY 1, 2), r AS (SELECT page_id, u AS url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::INT AS rank FROM d) SELECT * FROM r WHERE rank <= 4"""
)
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a site to read: its home first, then links of the same host by bucket and words."""
    links = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(h).alias("href"), F.lit(t).alias("text")) for i, (h, t) in enumerate(LINKS)])
    rows = table(spark, sf_dir, "pages").select("page_id", F.inline(links))
    return S.site_pages(rows, ["page_id"], F.concat(F.lit("https://acme.com/"), "page_id", F.lit("/"))).select("page_id", "url", "score", "rank")


@book.query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://acme' || s_suppkey || '.com' ELSE '' END AS website, CASE s_suppkey % 3 WHEN 0 THEN 'https://acme' || s_suppkey || '.com' ELSE '' END AS source_url FROM supplier")
def official_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best home page among search results, where it scores enough."""
    from tallyforge.operators.profile import site_score

    k = F.col("s_suppkey")
    own = F.concat(F.lit("https://acme"), k, F.lit(".com"))
    urls = F.array(own, F.concat(own, F.lit("/team/a/b")), F.lit("https://twitter.com/acme"), F.lit("https://other.org/x"))
    rows = table(spark, sf_dir, "supplier").select(k, F.explode(F.when(k % 3 == 0, urls).otherwise(F.slice(urls, 3, 2))).alias("url"))
    scored = rows.withColumn("score", site_score(F.col("url"), F.lit("listing"), F.lit(""), F.concat(F.lit("Acme"), k, F.lit(" Partners"))))
    return S.official_site(scored, ["s_suppkey"]).select("s_suppkey", "website", "source_url")


@book.query()
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of pages by a parser, in Arrow batches; tests compare it with hand-made pages."""
    from tallyforge.functions.html import page_text

    rows = table(spark, sf_dir, "pages").select("page_id", "url", page_text(F.col("html")).alias("body"))
    return rows.select("page_id", U.bucket(F.col("url")).alias("bucket"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


# ---- the links that pages really have

REAL = """a AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, unnest(range(len(t))) AS pos, unnest(t) AS tag FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">.*?</a>', 0, 's') AS t FROM pages)),
l AS (SELECT page_id, url, root, pos::INT AS pos, trim(replace(regexp_extract(tag, '<a href="([^"]*)"', 1), '&amp;', '&')) AS href, trim(regexp_replace(replace(regexp_replace(regexp_extract(tag, '^<a href="[^"]*">(.*)</a>$', 1, 's'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM a),
j AS (SELECT *, CASE WHEN href ~ '^[a-z]+:' THEN href WHEN href = '/' OR href LIKE '/%' THEN root || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href WHEN href LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || href WHEN href = '' THEN url ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM l)"""


@book.query(f"WITH {REAL} SELECT page_id, pos, href, text, target FROM j")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, with its text and where it leads."""
    return S.page_links(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "pos", "href", "text", "target")


@book.query(
    f"""WITH {REAL}, b AS (SELECT page_id, url AS home, pos, target AS u, lower(text || ' ' || href) AS blob FROM j WHERE href <> '' AND href NOT LIKE '#%' AND href NOT LIKE 'mailto:%' AND starts_with(target, root)),
s AS (SELECT page_id, home, pos, u, (10 + CASE {BUCKET} WHEN 'portfolio' THEN 14 WHEN 'team' THEN 14 WHEN 'contact' THEN 12 WHEN 'careers' THEN 10 WHEN 'news' THEN 9 ELSE 2 END + 2 * {sql_hits('blob', DISCOVERY_WORDS)})::DOUBLE AS score FROM b WHERE {sql_any('blob', DISCOVERY_WORDS)}),
c AS (SELECT page_id, pos, u, score FROM s UNION ALL SELECT page_id, -1, url, 100.0 FROM pages WHERE page_id IN (SELECT page_id FROM j)),
d AS (SELECT page_id, u, max(score) AS score, arg_max(pos, score) AS pos FROM c GROUP BY 1, 2), r AS (SELECT page_id, u AS url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::INT AS rank FROM d) SELECT * FROM r WHERE rank <= 4"""
)
def site_pages_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to read of the site that each page is the home of, by its own links."""
    links = S.page_links(table(spark, sf_dir, "pages"), ["page_id"])
    return S.site_pages(links, ["page_id"], F.col("url")).select("page_id", "url", "score", "rank")
