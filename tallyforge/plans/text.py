"""Queries over text, date, amount and URL scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions import urls as U
from tallyforge.functions.dates import any_date, check_range, dates_in_text, parse_date, to_amount
from tallyforge.functions.fixed import BLOCKED_FRAGMENTS, BLOCKED_SUFFIXES, DISCOVERY_WORDS, NEWS_FRAGMENTS, SECTOR_TERMS, SOCIAL_FRAGMENTS, TIER_QUOTA, TRUSTED_PATH_WORDS
from tallyforge.functions.text import normalize_stage, safe_text, slugify, stage_from_raise, summarize, tiered_merge
from tallyforge.operators.tables import first_wins
from tallyforge.plans.book import Book, quoted, sql_any, sql_hits, table

book = Book()


@book.query("SELECT o_orderkey, CASE WHEN a <= 1500000 THEN 'seed' WHEN a <= 5000000 THEN 'series_a' WHEN a <= 15000000 THEN 'series_b' ELSE 'growth' END AS stage FROM (SELECT o_orderkey, o_totalprice * 40 AS a FROM orders)")
def stage_from_raise_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", stage_from_raise(F.col("o_totalprice") * 40).alias("stage"))


@book.query(
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Pre-Seed' WHEN 1 THEN ' Series A' WHEN 2 THEN 'series-b' WHEN 3 THEN 'GROWTH' WHEN 4 THEN 'Buyout ' ELSE 'angel' END AS label FROM part),
n AS (SELECT p_partkey, replace(replace(lower(trim(label)), '-', '_'), ' ', '_') AS s FROM x)
SELECT p_partkey, CASE WHEN s = 'preseed' THEN 'pre_seed' WHEN s IN ('pre_seed', 'seed', 'series_a', 'series_b', 'series_c', 'growth', 'buyout') THEN s END AS stage FROM n"""
)
def stage_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    label = F.when(k == 0, "Pre-Seed").when(k == 1, " Series A").when(k == 2, "series-b").when(k == 3, "GROWTH").when(k == 4, "Buyout ").otherwise("angel")
    return table(spark, sf_dir, "part").select("p_partkey", normalize_stage(label).alias("stage"))


MONEY = "CASE {k} % 4 WHEN 0 THEN '$' || {n} || 'K-$' || ({n} + 3) || 'M' WHEN 1 THEN '$' || {n} || 'M' WHEN 2 THEN '$' || {n} || ',500k' ELSE '' END"


@book.query(
    f"""WITH x AS (SELECT o_orderkey, {MONEY.format(k='o_orderkey', n='(o_orderkey % 90 + 1)')} AS t FROM orders),
p AS (SELECT o_orderkey, t, list_transform(list_filter(string_split(replace(replace(replace(lower(t), ',', ''), '$', ' '), '-', ' '), ' '), lambda p: regexp_matches(p, '^\\d+(\\.\\d+)?[km]$')),
  lambda p: (regexp_replace(p, '[km]$', '')::DOUBLE * CASE WHEN ends_with(p, 'k') THEN 1e3 ELSE 1e6 END)::BIGINT) AS a FROM x)
SELECT o_orderkey, t AS check_text, CASE WHEN len(a) >= 1 THEN list_min(a) ELSE 250000 END::BIGINT AS low, CASE WHEN len(a) >= 2 THEN list_max(a) WHEN len(a) = 1 THEN a[1] * 2 ELSE 3000000 END::BIGINT AS high,
  regexp_extract(replace(t, ',', ''), '\\d+(\\.\\d+)?')::VARCHAR AS number,
  TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '\\d+(\\.\\d+)?'), '') AS DOUBLE) * CASE WHEN contains(lower(t), 'b') THEN 1e9 WHEN contains(lower(t), 'm') THEN 1e6 WHEN contains(lower(t), 'k') THEN 1e3 ELSE 1.0 END AS amount FROM p"""
)
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 90 + 1)
    text = F.when(k == 0, F.concat(F.lit("$"), n, F.lit("K-$"), n + 3, F.lit("M"))).when(k == 1, F.concat(F.lit("$"), n, F.lit("M"))).when(k == 2, F.concat(F.lit("$"), n, F.lit(",500k"))).otherwise("")
    low, high = check_range(F.col("check_text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("check_text")).select("o_orderkey", "check_text", low.alias("low"), high.alias("high"), F.regexp_extract(F.replace("check_text", F.lit(",")), r"(\d+(\.\d+)?)", 1).alias("number"), to_amount(F.col("check_text")).alias("amount"))


@book.query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders")
def date_parse_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd-MMM-yyyy")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "MM/dd/yyyy")).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text).alias("parsed"))



@book.query("SELECT o_orderkey, CASE o_orderkey % 9 WHEN 2 THEN date_trunc('month', o_orderdate)::DATE WHEN 6 THEN date_trunc('quarter', o_orderdate)::DATE WHEN 7 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def date_writings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in nine writings, one of which names none."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    forms = {0: "MMMM d, yyyy", 1: "d MMM yyyy", 2: "MMM yyyy", 3: "yyyyMMdd", 4: "EEE, d MMM yyyy", 5: "M/d/yyyy 'at' h:mm a", 6: "yyyy-QQQ", 8: "yyyy-MM-dd'T'HH:mm:ss'Z'"}
    text = F.lit("to be announced")
    for i, form in forms.items():
        text = F.when(k == i, F.date_format(d, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", any_date(text).alias("day"))


@book.query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN make_date(2023, 4, doc_id % 28 + 1) WHEN 1 THEN make_date(2022, 3, doc_id % 28 + 1) WHEN 2 THEN make_date(2021, 9, doc_id % 28 + 1)
  WHEN 3 THEN DATE '2020-06-01' WHEN 4 THEN make_date(2024, 12, doc_id % 28 + 1) END AS newest, CASE doc_id % 6 WHEN 5 THEN 0 WHEN 2 THEN 2 ELSE 1 END::INT AS n FROM documents"""
)
def dates_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a day, month and year the pattern of month and year alone finds the first of the month as well."""
    k, d = F.col("doc_id") % 6, F.col("doc_id") % 28 + 1
    tail = (
        F.when(k == 0, F.concat(F.lit(" on 2023-4-"), d, F.lit("."))).when(k == 1, F.concat(F.lit(" March "), d, F.lit(", 2022 "))).when(k == 2, F.concat(F.lit(" "), d, F.lit(" sept 2021 ")))
        .when(k == 3, " in June 2020.").when(k == 4, F.concat(F.lit(" 12/"), d, F.lit("/2024 and 2019-01-01"))).otherwise("")
    )
    found = dates_in_text(F.concat(F.coalesce("text", F.lit("")), tail), F.lit("2024-06-01").cast("date"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("d")).select("doc_id", F.array_max("d").alias("newest"), F.size("d").alias("n"))


NORMAL = "regexp_replace(lower(regexp_replace(trim(regexp_replace(url, '#.*$', '')), '/+$', '')), '^http://', 'https://')"
DOMAIN = "replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)), 'www.', '')"


@book.query(f"SELECT page_id, {NORMAL} AS normal FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normal"))


@book.query(f"SELECT page_id, {DOMAIN.format(u='url')} AS domain, 'https://' || {DOMAIN.format(u='url')} AS home FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"), U.root_home(F.col("url")).alias("home"))


TAILS = ["/Team", "/portfolio/x", "/careers?x=1", "/blog/post.pdf", "/get-in-touch", "/tag/a", ""]
TAILED = "url || [" + quoted(TAILS) + "][(page_id % 7 + 1)::INT]"
BUCKET = (
    "CASE WHEN {c} THEN 'contact' WHEN {t} THEN 'team' WHEN {p} THEN 'portfolio' WHEN {j} THEN 'careers' WHEN {n} THEN 'news' ELSE 'general' END"
).format(
    c=sql_any("lower(u)", ["/contact", "/reach", "get-in-touch", "/submit", "/pitch", "/apply"]), t=sql_any("lower(u)", ["/team", "/people", "/leadership", "/partners", "/staff"]),
    p=sql_any("lower(u)", ["/portfolio", "/companies", "/investments", "/portfolio-companies"]), j=sql_any("lower(u)", ["/careers", "/jobs", "/join", "/hiring"]), n=sql_any("lower(u)", ["/news", "/press", "/media", "/blog"]),
)
BLOCKED = "(" + " OR ".join(f"ends_with(lower(u), '{s}')" for s in BLOCKED_SUFFIXES) + " OR " + sql_any("lower(u)", BLOCKED_FRAGMENTS) + " OR u = '')"


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.get(F.array(*map(F.lit, TAILS)), (F.col("page_id") % 7).cast("int"))).alias("u"), "html")


@book.query(f"SELECT page_id, {BUCKET} AS bucket, {BLOCKED} AS blocked FROM (SELECT page_id, {TAILED} AS u FROM pages)")
def page_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tailed(spark, sf_dir).select("page_id", U.bucket(F.col("u")).alias("bucket"), U.blocked(F.col("u")).alias("blocked"))


OFFICIAL = "example.com"
D = DOMAIN.format(u="u")
TIER = f"CASE WHEN {D} = '{OFFICIAL}' OR ends_with({D}, '.{OFFICIAL}') THEN 'official' WHEN {sql_any(D, NEWS_FRAGMENTS)} THEN 'news' ELSE 'other' END"
# every third page is moved to a news host, so that all tiers occur
HOSTED = f"CASE WHEN page_id % 3 = 1 THEN 'https://reuters.com/x' || page_id || [{quoted(TAILS)}][(page_id % 7 + 1)::INT] ELSE {TAILED} END"
SCORE = f"""(CASE {TIER} WHEN 'official' THEN 120.0 WHEN 'news' THEN 55.0 ELSE 8.0 END + CASE {BUCKET} WHEN 'portfolio' THEN 14 WHEN 'team' THEN 14 WHEN 'contact' THEN 12 WHEN 'careers' THEN 10 WHEN 'news' THEN 9 ELSE 2 END
 + CASE WHEN contains(lower(title || ' '), 'the') THEN 18 ELSE 0 END + CASE WHEN contains(lower(u), '{OFFICIAL}') THEN 25 ELSE 0 END + CASE WHEN {sql_any('lower(u)', TRUSTED_PATH_WORDS)} THEN 5 ELSE 0 END
 - CASE WHEN ends_with(lower(u), '.pdf') THEN 80 ELSE 0 END - CASE WHEN contains(lower(u), 'linkedin.com/in/') THEN 25 ELSE 0 END - CASE WHEN {sql_any('lower(u)', SOCIAL_FRAGMENTS)} THEN 18 ELSE 0 END - CASE WHEN {sql_any('lower(u)', BLOCKED_FRAGMENTS)} THEN 10 ELSE 0 END)::DOUBLE"""
RANKED = f"h AS (SELECT page_id, {HOSTED} AS u, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), r AS (SELECT page_id, u, {TIER} AS tier, {SCORE} AS score, {BLOCKED} AS blocked FROM h)"


def scored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("page_id") % 7).cast("int"))
    hosted = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://reuters.com/x"), F.col("page_id"), tail)).otherwise(F.concat("url", tail))
    rows = table(spark, sf_dir, "pages").select("page_id", hosted.alias("u"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    official = F.lit(OFFICIAL)
    return rows.select("page_id", "u", U.tier(F.col("u"), official).alias("tier"), U.candidate_score(F.col("u"), F.col("title"), F.lit(""), F.lit("the"), official).alias("score"), U.blocked(F.col("u")).alias("blocked"))


@book.query(f"WITH {RANKED} SELECT page_id, u, tier, score, row_number() OVER (ORDER BY score DESC, page_id)::INT AS rank FROM r WHERE NOT blocked ORDER BY score DESC, page_id LIMIT 50")
def url_trust_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scored_urls(spark, sf_dir).filter("NOT blocked").select("page_id", "u", "tier", "score").orderBy(F.desc("score"), "page_id").limit(50)
    return best.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("score"), "page_id")))


@book.query(f"WITH {RANKED}, q AS (SELECT page_id, tier, score, row_number() OVER (PARTITION BY tier ORDER BY score DESC, page_id) AS n FROM r WHERE NOT blocked AND (tier = 'official' OR tier = 'news' AND score >= 35)) SELECT page_id, tier, score FROM q WHERE n <= CASE tier WHEN 'official' THEN 4 ELSE 2 END")
def tier_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official pages up to their quota, news pages of enough score up to theirs; only pages that count use it up."""
    rows = scored_urls(spark, sf_dir).filter("NOT blocked AND (tier = 'official' OR tier = 'news' AND score >= 35)")
    w = W.Window.partitionBy("tier").orderBy(F.desc("score"), "page_id")
    most = F.when(F.col("tier") == "official", TIER_QUOTA["official"]).otherwise(TIER_QUOTA["news"])
    return rows.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= TIER_QUOTA["official"]) & (F.col("n") <= most)).select("page_id", "tier", "score")


@book.query(f"WITH x AS (SELECT page_id, {DOMAIN.format(u='url')} AS domain, length(html) AS size FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY size DESC, page_id) AS n FROM x) SELECT domain, page_id, size FROM r WHERE n = 1")
def argmax_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"), F.length("html").cast("long").alias("size")).withColumn("less", -F.col("size"))
    return first_wins(rows, F.col("domain"), "less", "page_id").select("domain", "page_id", "size")


LINK = '<a href="([^"#]+)">([^<]*)</a>'


@book.query(
    f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"#]+">[^<]*</a>')) AS tag FROM pages),
b AS (SELECT page_id, lower(regexp_extract(tag, '<a href="([^"#]+)">', 1)) AS u, lower(regexp_extract(tag, '>([^<]*)</a>', 1)) AS t FROM a),
s AS (SELECT DISTINCT page_id, u, (10 + CASE {BUCKET} WHEN 'portfolio' THEN 14 WHEN 'team' THEN 14 WHEN 'contact' THEN 12 WHEN 'careers' THEN 10 WHEN 'news' THEN 9 ELSE 2 END + 2 * {sql_hits("(t || ' ' || u)", DISCOVERY_WORDS)} - CASE WHEN contains(u, '?') THEN 3 ELSE 0 END)::DOUBLE AS score FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, u)::INT AS rank FROM s) SELECT page_id, u, score, rank FROM r WHERE rank <= 4"""
)
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best links of each page, by bucket and discovery words."""
    from tallyforge.functions.text import hits

    tags = F.regexp_extract_all("html", F.lit('(<a href="[^"#]+">[^<]*</a>)'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).select("page_id", F.lower(F.regexp_extract("tag", LINK, 1)).alias("u"), F.lower(F.regexp_extract("tag", LINK, 2)).alias("t"))
    score = 10.0 + U.bucket_score(U.bucket(F.col("u"))) + 2.0 * hits(F.concat("t", F.lit(" "), "u"), DISCOVERY_WORDS) - F.when(F.contains("u", F.lit("?")), 3.0).otherwise(0.0)
    w = W.Window.partitionBy("page_id").orderBy(F.desc("score"), "u")
    return links.select("page_id", "u", score.cast("double").alias("score")).distinct().withColumn("rank", F.row_number().over(w)).filter("rank <= 4")


MAIN = "regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"


@book.query(f"SELECT page_id, trim(lower({MAIN})) AS body FROM pages WHERE contains(html, '<article>')")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of a page without tags, white space squeezed, in lower case."""
    from tallyforge.functions.html import article_text

    return table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<article>"))).select("page_id", article_text(F.col("html")).alias("body"))


@book.query(
    """WITH n AS (SELECT count(*) AS n FROM supplier),
p AS (SELECT page_id, page_id % n AS s_suppkey, CASE page_id % 5 WHEN 0 THEN 'We met acme ' || ((page_id % n) % 7) || ' today' WHEN 1 THEN 'acme and others' WHEN 2 THEN 'northern notes' ELSE 'nothing' END AS body FROM pages, n)
SELECT page_id, s_suppkey, contains(body, 'acme') AS matches FROM p JOIN supplier USING (s_suppkey)"""
)
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the name of the entity that it was found for."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    k = F.col("page_id") % 5
    pages = table(spark, sf_dir, "pages").select("page_id").crossJoin(F.broadcast(n)).withColumn("s_suppkey", F.col("page_id") % F.col("n"))  # one row
    body = F.when(k == 0, F.concat(F.lit("We met acme "), F.col("s_suppkey") % 7, F.lit(" today"))).when(k == 1, "acme and others").when(k == 2, "northern notes").otherwise("nothing")
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Acme "), F.col("s_suppkey") % 7, F.lit(" Capital")).alias("name"))
    return pages.join(names, "s_suppkey").select("page_id", "s_suppkey", U.entity_matches(F.col("name"), F.lit(""), body, F.lit("")).alias("matches"))


T = list(SECTOR_TERMS["fintech"])
SO_FAR = "array_to_string(list_filter([s, o, n], lambda x: x <> ''), ' ')"


@book.query(
    f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(trim(text)) ELSE '' END AS s, CASE WHEN doc_id % 3 = 0 THEN 'payments desk' ELSE '' END AS o, CASE WHEN doc_id % 5 = 0 THEN 'press note' ELSE '' END AS n,
  CASE WHEN doc_id % 7 = 0 THEN 'banking and lending finance' WHEN doc_id % 7 = 1 THEN '' ELSE 'snippet' END AS q FROM documents), y AS (SELECT *, {SO_FAR} AS m FROM x)
SELECT doc_id, CASE WHEN q <> '' AND (length(m) < 12 OR {sql_hits('m', T)} = 0 OR {sql_hits('q', T)} > {sql_hits('m', T)}) THEN trim(CASE WHEN m <> '' THEN m || ' ' ELSE '' END || q) ELSE m END AS merged FROM y"""
)
def merge_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    sheet = F.when(k % 2 == 0, F.col("text")).otherwise("")
    snippet = F.when(k % 7 == 0, "banking and lending finance").when(k % 7 == 1, "").otherwise("snippet")
    return table(spark, sf_dir, "documents").select("doc_id", tiered_merge(sheet, F.when(k % 3 == 0, "payments desk"), F.when(k % 5 == 0, "press note"), snippet, T, 12).alias("merged"))


@book.query(
    """WITH t AS (SELECT doc_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS s, text FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 77)) || '...' END AS summary,
  CASE WHEN k = '' THEN 'item' ELSE k END AS slug, length(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))::BIGINT AS safe_chars
FROM (SELECT *, lower(regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS k FROM t)"""
)
def summarize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", summarize(F.col("text"), 80).alias("summary"), slugify(F.col("text")).alias("slug"), F.length(safe_text(F.col("text"))).cast("long").alias("safe_chars"))
