"""Search and crawl relations: query variants, result URLs, ranked candidates, scraped evidence, pages of a site.

Search answers and fetched pages come in as tables; nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions import urls as U
from tallyforge.functions.fixed import DISCOVERY_WORDS, PAGE_CHARS, PAGES_A_SITE, QUERY_TEMPLATES, RANKED_SHOWN, TEXT_BUCKETS, TIER_QUOTA
from tallyforge.functions.text import clean_text, has_any, hits, strings


def query_variants(name: Column, domain: Column, year: int) -> Column:
    """key, label, query of each search to try: with the site's domain where there is one, and without it."""
    bias = F.when(domain != "", F.concat(F.lit("site:"), domain)).otherwise("")
    out = []
    for key, template in QUERY_TEMPLATES.items():
        plain = F.replace(F.lit(template.replace("{year}", str(year))), F.lit("{name}"), name)
        first, second = F.trim(F.replace(plain, F.lit("{site_bias}"), bias)), F.trim(F.replace(plain, F.lit("{site_bias}"), F.lit("")))

        def variant(label: str, query: Column, key: str = key) -> Column:
            return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), query.alias("query"))

        out += [variant("primary", first), F.when(first != second, variant("fallback_no_site_bias", second))]
    return F.array_compact(F.array(*out))


def home_urls(website: Column) -> Column:
    """URLs to try for a website: itself where it has a scheme, else with both."""
    w = clean_text(website)
    return F.when(w == "", strings([])).when(w.startswith("http://") | w.startswith("https://"), F.array(w)).otherwise(F.array(F.concat(F.lit("https://"), w), F.concat(F.lit("http://"), w)))


def result_urls(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, url (normal form), title, body: of the entries (href, title, body) of one URL, the one with most text; the first among equals.

    Blocked URLs and other schemes than http are left out.
    """
    href = clean_text(F.col("href"))
    scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rows = entries.filter((href != "") & ~U.blocked(U.normalize(href)) & (~href.startswith("http") | scheme.isin("http", "https")))
    rows = rows.select(*keys, order, U.normalize(href).alias("url"), clean_text(F.col("title")).alias("title"), clean_text(F.col("body")).alias("body"))
    size = F.length("title") + F.length("body")
    best = F.max_by(F.struct("title", "body"), F.struct(size.alias("n"), (-F.col(order)).alias("o")))
    return rows.groupBy(*keys, "url").agg(best.alias("b")).select(*keys, "url", "b.title", "b.body")


def ranked_urls(found: DataFrame, keys: list[str], crawled: DataFrame, name: Column, official: Column) -> DataFrame:
    """found (keys, url, title, body) without URLs crawled already (keys, url), with tier, score and rank."""
    seen = crawled.select(*keys, U.normalize(F.col("url")).alias("url")).distinct()
    rows = found.join(seen, [*keys, "url"], "left_anti").filter(~U.blocked(F.col("url")))
    rows = rows.withColumns({"tier": U.tier(F.col("url"), official), "score": U.candidate_score(F.col("url"), F.col("title"), F.col("body"), name, official)})
    return rows.withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("score"), "url")))


def shown(ranked: DataFrame, most: int = RANKED_SHOWN) -> DataFrame:
    """The best candidates of each, as a report shows them."""
    return ranked.filter(F.col("rank") <= most).withColumn("score", F.round("score", 2))


def scraped(pages: DataFrame, keys: list[str], name: Column, website: Column) -> DataFrame:
    """Evidence of ranked pages that were fetched (keys, url, tier, score, rank, text; text null: not fetched).

    Official pages and news of enough score; a page counts where it is about the name, and only such pages use up
    the quota of their tier. One row for each keys: official, news, by bucket a text, and the URLs, in rank order.
    """
    rows = pages.filter(F.col("text").isNotNull() & ((F.col("tier") == "official") | ((F.col("tier") == "news") & (F.col("score") >= 35))) & U.entity_matches(name, website, F.col("text"), F.col("url")))
    most = F.when(F.col("tier") == "official", TIER_QUOTA["official"]).otherwise(TIER_QUOTA["news"])
    kept = rows.withColumn("_n", F.row_number().over(W.Window.partitionBy(*keys, "tier").orderBy("rank"))).filter(F.col("_n") <= most)
    kept = kept.select(*keys, "rank", "url", "tier", F.substring("text", 1, PAGE_CHARS).alias("text"), U.bucket(F.col("url")).alias("bucket"))
    return _by_keys(kept, keys, "rank", {"official": F.col("tier") == "official", "news": F.col("tier") == "news"}, F.col("tier") == "official")


def site_evidence(pages: DataFrame, keys: list[str], name: Column, website: Column, order: str = "rank", most: int = PAGES_A_SITE) -> DataFrame:
    """Evidence of a site's pages (keys, rank, url, text; text null: not fetched): the first so many that are about the name."""
    kept = pages.filter((F.col(order) <= most) & F.col("text").isNotNull() & U.entity_matches(name, website, F.col("text"), F.col("url")))
    kept = kept.select(*keys, F.col(order).alias("rank"), "url", F.substring("text", 1, PAGE_CHARS).alias("text"), U.bucket(F.col("url")).alias("bucket"))
    return _by_keys(kept, keys, "rank", {"combined": F.lit(True)}, F.lit(True))


def _by_keys(kept: DataFrame, keys: list[str], order: str, groups: dict[str, Column], bucketed: Column) -> DataFrame:
    """Texts and URLs of each group, and texts of each bucket, in order. A key has few pages: each group has a quota."""
    def listed(which: Column, what: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(F.col(order).alias("o"), F.col(what).alias("x"))))), lambda x: x.x)

    texts = [F.lower(F.array_join(listed(which, "text"), " ")).alias(f"{g}_text") for g, which in groups.items()]
    urls = [F.array_distinct(listed(which, "url")).alias(f"{g}_urls") for g, which in groups.items()]
    buckets = F.create_map(*[x for b in TEXT_BUCKETS for x in (F.lit(b), F.lower(F.array_join(listed(bucketed & (F.col("bucket") == b), "text"), " ")))])
    return kept.groupBy(*keys).agg(*texts, *urls, buckets.alias("by_bucket"))


def page_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """keys, url, pos, href, text, target: the links of each page, with the absolute URL that each leads to."""
    rows = pages.select(*keys, F.col(url).alias("url"), F.inline(U.anchors(F.col(html))))
    return rows.withColumn("target", U.joined(F.col("url"), F.col("href")))


def site_pages(links: DataFrame, keys: list[str], home: Column, most: int = PAGES_A_SITE) -> DataFrame:
    """keys, url, score, rank: the pages of a site to read. links: keys, pos, href, text of the links on its home page.

    The home page comes first (100); links of the same host whose text or URL has a discovery word score by bucket and words,
    less for a query and for depth. The best score of a URL counts; links of equal score keep their order.
    """
    href = F.trim(F.coalesce("href", F.lit("")))
    rows = links.filter((href != "") & ~href.startswith("#") & ~href.startswith("mailto:")).select(*keys, "pos", href.alias("href"), F.col("text").alias("label"), home.alias("home")).withColumn("url", U.joined(F.col("home"), F.col("href")))
    blob = F.lower(F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.col("href")))
    rows = rows.withColumn("blob", blob).filter(F.col("url").rlike("^https?://") & (U.domain(F.col("url")) == U.domain(F.col("home"))) & ~U.blocked(U.normalize(F.col("url"))) & has_any(F.col("blob"), DISCOVERY_WORDS))
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    score = 10.0 + U.bucket_score(U.bucket(F.col("url"))) + 2.0 * hits(F.col("blob"), DISCOVERY_WORDS) - F.when(F.col("url").rlike(r"\?[^#]"), 3.0).otherwise(0.0) - F.when(F.size(F.split(path, "/")) > 5, 2.0).otherwise(0.0)
    own = links.select(*keys, home.alias("url")).distinct().select(*keys, F.lit(-1).alias("pos"), "url", F.lit(100.0).alias("score"))
    every = rows.select(*keys, F.col("pos").cast("int").alias("pos"), "url", score.cast("double").alias("score")).unionByName(own)
    best = every.groupBy(*keys, "url").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("score"), "pos"))).filter(F.col("rank") <= most).drop("pos")


def official_site(scored: DataFrame, keys: list[str], least: float = 20.0) -> DataFrame:
    """keys, website, source_url, score: the best home of each, where its best page scores enough. scored: keys, url, score."""
    rows = scored.withColumn("home", U.root_home(U.normalize(F.col("url")))).filter("home <> 'https://'")
    homes = rows.groupBy(*keys, "home").agg(F.max_by("url", F.struct("score", F.col("url"))).alias("source_url"), F.max("score").alias("score"))
    best = homes.groupBy(*keys).agg(F.max_by(F.struct("home", "source_url", "score"), F.struct("score", "home")).alias("b"))
    return best.select(*keys, F.when(F.col("b.score") >= least, F.col("b.home")).otherwise("").alias("website"), F.when(F.col("b.score") >= least, F.col("b.source_url")).otherwise("").alias("source_url"), F.round("b.score", 2).alias("score"))
