"""Queries over candidates and records: raw rows and people answers become candidates; wires, caches and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.fixed import FOCUS_LABELS, NAMESPACES, RAISED_STAGES
from tallyforge.functions.text import strings
from tallyforge.operators import cache as K
from tallyforge.operators import candidates as C
from tallyforge.operators import profile as P
from tallyforge.operators import vectors as V
from tallyforge.plans.book import Book, quoted, spread, sql_any, table
from tallyforge.plans.profile import DEALS, MONEY, deals

book = Book()

THESES = ["Pre-seed AI and developer tools", "series a banking", "Climate growth", ""]
FIRMS = ["Sequoia North", "GT Securities", "plain capital", "khosla securities"]
RANGES = ["$250K-$2M", "500k", "$1.5M - 3M", "open"]
TITLES = ["Principal", "Managing Partner", "General Partner ", "Analyst"]


def _pick(values: list[str], by: str) -> str:
    return f"[{quoted(values)}][({by} + 1)::INT]"


def _choice(values: list[str], by: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), by.cast("int"))


FOCUS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {sql_any('lower(t)', words)} THEN '{label}' END" for label, words in FOCUS_LABELS.items()) + "], lambda x: x IS NOT NULL)"
STAGE_SQL = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(thesis), '{s}') THEN '{s.replace(' ', '_')}' END" for s in RAISED_STAGES) + "], lambda x: x IS NOT NULL)"


@book.query(
    f"""WITH r AS (SELECT s_suppkey AS idx, s_name, {_pick(THESES, 's_suppkey % 4')} AS thesis, {_pick(FIRMS, 's_suppkey % 4')} AS firm, s_suppkey % 5 AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'a@b.c' ELSE '' END AS email, CASE WHEN s_suppkey % 3 = 0 THEN 'in/x' END AS linkedin FROM supplier),
u AS (SELECT *, thesis || ' ' || CASE WHEN c = 0 THEN 'health' ELSE '' END AS t FROM r), x AS (SELECT *, {FOCUS_SQL} AS focus, {STAGE_SQL} AS stages FROM u)
SELECT 'seed_' || idx AS investor_id, s_name AS full_name, firm, 'Partner' AS title, array_to_string(CASE WHEN len(focus) > 0 THEN focus ELSE ['Technology'] END, ',') AS industry_focus, array_to_string(CASE WHEN len(stages) > 0 THEN stages ELSE ['seed', 'series_a'] END, ',') AS stage_focus,
  [250000, 500000, 1500000, 250000][(idx % 4 + 1)::INT]::BIGINT AS check_min, [2000000, 1000000, 3000000, 3000000][(idx % 4 + 1)::INT]::BIGINT AS check_max, (6 + idx % 4)::INT AS count_12m, CASE WHEN email <> '' AND linkedin IS NOT NULL THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence,
  CASE idx % 4 WHEN 1 THEN 1 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n_warm, 'sample_dataset:' || CASE WHEN c = 0 THEN 'health' ELSE '' END || ';portfolio_summary:' || CASE WHEN c = 1 THEN 'A; B' ELSE '' END AS signals FROM x"""
)
def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw list of investors as candidates, with what their texts, firms and ranges let guess."""
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(
        k.alias("idx"), F.col("s_name").alias("full_name"), _choice(FIRMS, k % 4).alias("firm"), F.lit(None).cast("string").alias("title"), F.when(k % 2 == 0, "a@b.c").otherwise("").alias("email"), F.when(k % 3 == 0, "in/x").alias("linkedin_url"),
        *[F.lit(None).cast("string").alias(n) for n in ("phone", "twitter_handle", "website")], _choice(RANGES, k % 4).alias("check_size_range"), _choice(THESES, k % 4).alias("investment_thesis"), F.when(k % 5 == 0, "health").alias("why_good_fit"), F.when(k % 5 == 1, strings(["A", "B"])).alias("portfolio_companies"),
    )
    c = C.from_raw(raw, "mock_seed_dataset")
    signals = F.array_join(F.transform("signals", lambda s: F.concat(s.source_type, F.lit(":"), s.text)), ";")
    return c.select("investor_id", "full_name", "firm", "title", F.array_join("fund.industry_focus", ",").alias("industry_focus"), F.array_join("fund.stage_focus", ",").alias("stage_focus"), F.col("fund.check_size_min").alias("check_min"), F.col("fund.check_size_max").alias("check_max"), F.col("fund.recent_investment_count_12m").alias("count_12m"), F.col("data_quality_confidence").alias("confidence"), F.size("warm_intro_paths").alias("n_warm"), signals.alias("signals"))


@book.query(
    f"""WITH p AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, s_suppkey % 4 AS m FROM supplier),
f AS (SELECT *, CASE m WHEN 0 THEN 'Acme Ventures' WHEN 1 THEN 'Deep Blue Capital' WHEN 2 THEN 'Other' ELSE 'Unknown Vc' END AS firm FROM p)
SELECT 'apollo_' || idx AS investor_id, coalesce(name, 'Apollo Contact ' || idx) AS full_name, firm, {_pick(TITLES, 'm')} AS title, 'Fintech,Technology' AS industry_focus, [250000, 500000, 500000, 250000][(m + 1)::INT]::BIGINT AS check_min, [3000000, 10000000, 10000000, 5000000][(m + 1)::INT]::BIGINT AS check_max,
  ['$250K - $3M', '$500K - $10M', '$500K - $10M', '$250K - $5M'][(m + 1)::INT] AS check_range, (4 + idx % 5)::INT AS count_12m, 'Profile indicates ' || {_pick(TITLES, 'm')} || ' at ' || firm || ' with fintech focus.' AS first_signal, 'Fintech Co ' || idx || ',Enterprise Tool ' || idx AS companies FROM f"""
)
def people_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People-search answers as candidates for a deal."""
    k = F.col("s_suppkey")
    people = table(spark, sf_dir, "supplier").select(
        k.alias("idx"), F.when(k % 3 != 0, F.col("s_name")).alias("name"), F.when(k % 4 == 0, "acme-VENTURES").when(k % 4 == 2, "other").otherwise("").alias("firm"), F.when(k % 4 == 1, "https://www.deep-blue  capital.com").when(k % 4 == 2, "x").alias("website"),
        _choice(TITLES, k % 4).alias("title"), *[F.lit(None).cast("string").alias(n) for n in ("email", "phone", "linkedin", "twitter")],
    )
    c = C.from_people(people, "fintech", "2002-06-01")
    return c.select("investor_id", "full_name", "firm", "title", F.array_join("fund.industry_focus", ",").alias("industry_focus"), F.col("fund.check_size_min").alias("check_min"), F.col("fund.check_size_max").alias("check_max"), F.col("check_size_range").alias("check_range"), F.col("fund.recent_investment_count_12m").alias("count_12m"), F.get("signals", F.lit(0)).text.alias("first_signal"), F.array_join("portfolio_companies", ",").alias("companies"))


@book.query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'pb_' ELSE 'zi_' END || c_custkey AS investor_id, c_name FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_custkey LIMIT 30")
def imported_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first investors of one origin."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "pb_").otherwise("zi_"), "c_custkey").alias("investor_id"), "c_name")
    return C.imported(rows, "pb_", 30, "c_custkey").select("investor_id", "c_name")


@book.query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own@x.com' WHEN c_custkey % 2 = 0 THEN 'found' || c_custkey ELSE '' END AS email, CASE WHEN c_custkey % 2 = 0 THEN '555' ELSE '' END AS phone FROM customer"""
)
def enriched_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the contact fields of saved enrichment answers, where they have none."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("firm"), F.when(k % 4 == 0, "own@x.com").alias("email"), F.lit("").alias("phone"), F.lit("").alias("linkedin_url"))
    people = c.filter(k % 2 == 0).select(F.upper("full_name").alias("name"), F.concat(F.lit(" "), F.lower("firm")).alias("company"), F.concat(F.lit("found"), k).alias("email"), F.lit("555").alias("phone"), F.lit(None).cast("string").alias("linkedin_url"))
    return C.enriched(c, people).select("c_custkey", "email", "phone")


@book.query("SELECT o_orderkey, '' AS investor_name, 'pending' AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END::DOUBLE AS wire_amount, '' AS notes, o_orderkey % 3 = 0 AS waits FROM orders")
def wire_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wires with what they lack filled in."""
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    w = F.struct(*[null.alias(n) for n in ("investor_name", "firm", "status", "client_confirmed_at", "investor_confirmed_at", "dock_walls_approved_at", "notes")], F.when(k % 2 == 0, F.col("o_totalprice")).alias("wire_amount"))
    made = table(spark, sf_dir, "orders").select(k, w.alias("w")).select(k, C.wire(F.col("w")).alias("w"))
    status = F.when(k % 3 == 0, "investor_confirmed").when(k % 3 == 1, "completed")
    return made.select(k, "w.investor_name", "w.status", "w.wire_amount", "w.notes", C.needs_approval(status).alias("waits"))


@book.query(
    """SELECT s_suppkey, '{"fund_id":"f' || s_suppkey || '","name":"' || s_name || '","stage_focus":[],"check_size_min":100000,"check_size_max":' || CASE WHEN s_suppkey % 2 = 0 THEN '5000000' ELSE '2000000' END || ',"geography":["United States"],"industry_focus":[],"sector_exclusions":[],"lead_preference":"either","status":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'closed' ELSE 'active' END || '","recent_investment_count_12m":0,"thesis_text":"","aum_millions":null,"dry_powder_millions":null,"preferred_verticals":[]}' AS fund,
  '{"source_type":"news","text":"t' || s_suppkey || '","source_url":"","date":"","confidence":0.7,"visibility":"public"}' AS signal, '{"investor_id":"' || s_suppkey || '","full_name":"' || s_name || '","firm":"","title":"","email":"","phone":"","linkedin_url":"","twitter_handle":"","website":"","investment_thesis":"","check_size_range":"","last_verified_at":"","investor_type":"","pitchbook_id":"","hq_location":"","hq_state":"","portfolio_companies":["P' || s_suppkey || '"],"source_tags":[],"warm_intro_paths":[],"data_quality_confidence":0.8,"fund":' || fund || ',"signals":[' || signal || '],"metadata":{}}' AS record FROM supplier"""
)
def fund_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funds, signals and the public records of candidates as JSON with every field."""
    k = F.col("s_suppkey")
    fund = C.fund(fund_id=F.concat(F.lit("f"), k), name=F.col("s_name"), check_size_max=F.when(k % 2 == 0, F.lit(5_000_000).cast("long")), status=F.when(k % 3 == 0, "closed"))
    rows = table(spark, sf_dir, "supplier")
    record = C.candidate(rows, investor_id=k.cast("string"), full_name=F.col("s_name"), portfolio_companies=F.array(F.concat(F.lit("P"), k)), fund=fund, signals=F.array(C.signal("news", F.concat(F.lit("t"), k))))
    one = F.get("signals", F.lit(0))
    return record.select(F.col("investor_id").cast("long").alias("s_suppkey"), C.as_json(F.col("fund")).alias("fund"), C.as_json(one).alias("signal"), C.as_json(F.struct(*record.columns)).alias("record"))


@book.query(
    """WITH m AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank, s_acctbal FROM supplier QUALIFY rank <= 5)
SELECT 'deal 1' AS deal, count(*)::INT AS n_results, string_agg(s_suppkey::VARCHAR, ',' ORDER BY rank) AS ids, 'pending_phil_team_review' AS status, 5 AS n_controls, 7 AS n_weights, 11 AS n_features FROM m"""
)
def match_run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as one record: its results in rank order, each with features, weights and explanation."""
    from tallyforge.operators import matching as M
    from tallyforge.plans.matching import NAMES

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("score"))
    best = M.ranked(rows, "s_suppkey", 5)
    full = best.withColumns({n: F.lit(0.5) for n in (*NAMES, "keyword_score")} | {"explanation": F.struct(strings(["r"]).alias("reasons"))})
    results = full.select(C.match_record(F.struct(F.col("s_suppkey").cast("string").alias("investor_id"))).alias("result"))
    run = C.run_record(results, F.lit("deal 1"), F.struct(F.lit(5).alias("top_k")), F.struct(F.lit(5).alias("final_ranked")), F.struct(F.lit("weighted-rules-v1").alias("reranker")), "2002-06-01")
    first = F.get("results", F.lit(0))
    return run.select("deal", F.size("results").alias("n_results"), F.array_join(F.transform("results", lambda r: r.investor.investor_id), ",").alias("ids"), F.col("approval_queue.status").alias("status"), F.size("approval_queue.human_in_loop_controls").alias("n_controls"), F.size("score_weights").alias("n_weights"), F.size(F.from_json(F.to_json(first.features), "map<string,double>")).alias("n_features"))


# ---- the cache of embeddings: vectors by customer and namespace, some of another model, some without a hash

ENTRIES = """e AS (SELECT c_custkey::VARCHAR AS investor_id, ['fund_thesis', 'partner_bio', 'portfolio', 'activity'][(ns + 1)::INT] AS namespace, CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE c_custkey END AS v, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE md5(c_name || ns) END AS h, CASE WHEN c_custkey % 7 = 0 AND ns = 3 THEN 'old' ELSE 'm' END AS model, c_custkey, ns, c_name
  FROM customer, (SELECT unnest([0, 1, 2, 3]) AS ns)), l AS (SELECT investor_id, namespace, v, coalesce(h, '') AS h, c_custkey, ns FROM e WHERE model = 'm' AND v IS NOT NULL)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*[F.struct(F.lit(i).alias("ns"), F.lit(n).alias("namespace")) for i, n in enumerate(NAMESPACES)])
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.explode(names).alias("x")).select("c_custkey", "c_name", "x.*")
    return rows.select(k.cast("string").alias("investor_id"), "namespace", F.when(k % 5 != 1, F.array(k.cast("double"))).alias("vector"), F.when(k % 3 != 0, F.md5(F.concat("c_name", "ns"))).alias("text_hash"), F.when((k % 7 == 0) & (F.col("ns") == 3), "old").otherwise("m").alias("model"), F.concat("c_name", "ns").alias("text"), k)


@book.query(f"WITH {ENTRIES} SELECT investor_id, count(*) = 4 AS has_all, (SELECT count(DISTINCT investor_id) FROM l) AS n_investors, 0::BIGINT AS after_invalidation FROM l GROUP BY investor_id")
def cache_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which investors have a vector in each namespace, how many have any, and what an invalidated cache holds."""
    c = K.load(entries(spark, sf_dir).drop("text", "c_custkey"), "m")
    gone = K.size(K.invalidated(c)).withColumnRenamed("n_investors", "after_invalidation")
    return K.complete(c).crossJoin(F.broadcast(K.size(c))).crossJoin(F.broadcast(gone))  # one row each


@book.query(
    f"""WITH {ENTRIES}, n AS (SELECT * FROM l WHERE c_custkey % 10 <> 0 OR ns <> 1)
SELECT investor_id, namespace, CASE WHEN c_custkey % 10 = 0 AND ns = 1 THEN -1.0 ELSE v END::DOUBLE AS x, CASE WHEN c_custkey % 10 = 0 AND ns = 2 THEN 'new' ELSE h END AS text_hash FROM l WHERE NOT (c_custkey % 10 = 0 AND ns = 0)
UNION ALL SELECT investor_id, namespace, -2.0, 'first' FROM e WHERE c_custkey % 10 = 0 AND ns = 0"""
)
def cache_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors without a hash keep the one that is there; with one they replace it; new keys are added."""
    every = entries(spark, sf_dir)
    c = K.load(every.drop("text", "c_custkey"), "m").filter("NOT (CAST(investor_id AS LONG) % 10 = 0 AND namespace = 'fund_thesis')")
    tenth = every.filter("c_custkey % 10 = 0 AND c_custkey % 5 <> 1")
    plain = tenth.filter("namespace = 'partner_bio' AND model = 'm'").select("investor_id", "namespace", F.array(F.lit(-1.0)).alias("vector"), F.lit(None).cast("string").alias("text_hash"), F.lit("m").alias("model"))
    hashed = tenth.filter("namespace = 'portfolio' AND model = 'm'").select("investor_id", "namespace", "vector", F.lit("new").alias("text_hash"), F.lit("m").alias("model"))
    added = tenth.filter("namespace = 'fund_thesis'").select("investor_id", "namespace", F.array(F.lit(-2.0)).alias("vector"), F.lit("first").alias("text_hash"), F.lit("m").alias("model"))
    return K.put(c, plain.unionByName(hashed).unionByName(added)).select("investor_id", "namespace", F.get("vector", F.lit(0)).alias("x"), "text_hash")


@book.query(
    f"""WITH {ENTRIES}, t AS (SELECT investor_id, namespace, md5(CASE WHEN e.c_custkey % 4 = 0 AND ns = 2 THEN 'x' ELSE '' END || c_name || ns) AS nh FROM e),
r AS (SELECT t.*, CASE WHEN l.investor_id IS NULL THEN 'missing_vector' WHEN l.h = '' THEN 'v1_no_hash' WHEN l.h <> nh THEN 'text_changed' ELSE 'up_to_date' END AS reason FROM t LEFT JOIN l USING (investor_id, namespace)),
w AS (SELECT count(*) AS n FROM (SELECT investor_id FROM r GROUP BY 1 HAVING bool_and(reason = 'up_to_date')))
SELECT namespace, 0::BIGINT AS force, count(*) FILTER (reason = 'missing_vector') AS missing_vector, count(*) FILTER (reason = 'v1_no_hash') AS v1_no_hash, count(*) FILTER (reason = 'text_changed') AS text_changed, count(*) FILTER (reason = 'up_to_date') AS up_to_date, any_value(w.n) AS fully_cached FROM r, w GROUP BY namespace"""
)
def embedding_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to embed by namespace, and how many investors need nothing."""
    every = entries(spark, sf_dir)
    changed = (F.col("c_custkey") % 4 == 0) & (F.col("namespace") == "portfolio")
    texts = every.select("investor_id", "namespace", F.concat(F.when(changed, "x").otherwise(""), "text").alias("text"))
    return K.requirements(texts, K.load(every.drop("text", "c_custkey"), "m"))[1]


@book.query(f"WITH {ENTRIES} SELECT investor_id || ':' || namespace AS record_id, v::DOUBLE AS x, length(c_name) + 1 AS n_chars FROM e JOIN l USING (investor_id, namespace, v, c_custkey, ns)")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for a vector table: texts with the vectors that the cache has for them."""
    every = entries(spark, sf_dir)
    rows = K.index_records(every.select("investor_id", "namespace", "text"), K.load(every.drop("text", "c_custkey"), "m"))
    return rows.select("record_id", F.get("vector", F.lit(0)).alias("x"), F.length("text").alias("n_chars"))


@book.query("SELECT p_partkey, round(length(p_name)::DOUBLE, 6) AS x, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE round(p_partkey::DOUBLE, 6) END AS y FROM part")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a function that embeds batches; where a batch fails, text by text, and a text that fails has no vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any(t.endswith("#bad") for t in texts):
            raise ValueError("a text that the model does not take")
        return [[float(len(t.rsplit("#", 1)[0])), float(t.rsplit("#", 1)[1])] for t in texts]

    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, "p_name", F.concat("p_name", F.lit("#"), F.when(k % 50 == 0, "bad").otherwise(k.cast("string"))).alias("text"))
    out = K.embedded(rows, embed, ["p_partkey", "p_name"])
    return out.select(k, F.coalesce(F.get("vector", F.lit(0)), F.length("p_name").cast("double")).alias("x"), F.get("vector", F.lit(1)).alias("y"))


@book.query("SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS a, 0 AS meta FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, NULL, 1, 9 FROM embeddings WHERE vec_id % 10 = 0")
def vector_upsert_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector column set by key: what else a row has stays, and new keys come in with what they have."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    old = e.filter("vec_id % 10 <> 0").withColumns({"a": F.lit(0), "meta": F.lit(0)})
    return V.upsert_columns(old, e.filter("vec_id % 5 = 0").select("vec_id", F.lit(1).alias("a"), F.lit(9).alias("meta")), "vec_id", "a")


@book.query("SELECT label, max(vec_id) AS vec_id, min(vec_id) AS place FROM embeddings GROUP BY label")
def vector_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key, at the place where the key came in."""
    return V.in_place(table(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], "vec_id").select("label", "vec_id", "place")


@book.query(
    """WITH q AS (SELECT vec_id AS ns, embedding AS q FROM embeddings WHERE vec_id < 4),
s AS (SELECT vec_id // 4 AS record, vec_id % 4 AS ns, round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)))), 6) AS score FROM embeddings JOIN q ON ns = vec_id % 4),
r AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY score DESC, record) AS n FROM s)
SELECT record, round(0.35 * coalesce(max(score) FILTER (ns = 0 AND n <= 60), 0)::DOUBLE + 0.30 * coalesce(max(score) FILTER (ns = 1 AND n <= 60), 0)::DOUBLE + 0.15 * coalesce(max(score) FILTER (ns = 2 AND n <= 60), 0)::DOUBLE + 0.20 * coalesce(max(score) FILTER (ns = 3 AND n <= 60), 0)::DOUBLE, 6) AS vector_score FROM r GROUP BY record"""
)
def vector_fusion_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late fusion with a query vector of its own for each namespace."""
    names = F.array(*map(F.lit, NAMESPACES))
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("record"), F.get(names, (F.col("vec_id") % 4).cast("int")).alias("namespace"), "embedding", "vec_id")
    q = e.filter("vec_id < 4").select("namespace", F.col("embedding").alias("q"))
    hits = V.top_k_by(V.scored_by_namespace(e.drop("vec_id"), q), 60, ["namespace"], "record")
    return V.late_fusion(hits, e.select("record").distinct(), "record").select("record", "vector_score")


@book.query(
    f"""WITH {DEALS}, p AS (SELECT deal_id, unnest(['company_core', 'problem', 'industry_market', 'traction', 'raise_thesis']) AS part, unnest([company_name || ' is a ' || industry || ' company raising ' || {MONEY.format(x='raise_amount')} || '.',
    coalesce(problem, company_name || ' addresses a core problem in ' || industry || '.'), industry || ' market opportunity. ' || industry || ' market opportunity.', {quoted([P.NO_TRACTION])},
    'Raising ' || {MONEY.format(x='raise_amount')} || ' over a 90-day process to fund growth milestones, investor outreach, and execution.' || CASE WHEN funds <> '' THEN ' Use of funds: ' || funds ELSE '' END || CASE WHEN valuation IS NOT NULL THEN ' Valuation: ' || {MONEY.format(x='valuation')} ELSE '' END]) AS text FROM d),
t AS (SELECT deal_id, part, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_#+.-]+')) AS token FROM p), u AS (SELECT deal_id, part, token, count(*) AS n, sha256(token) AS h FROM t GROUP BY ALL),
e AS (SELECT deal_id, part, (('0x' || h[1:8])::BIGINT % 96) AS i, (CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) * (1.0 + length(token) / 20.0) * n AS x FROM u),
c AS (SELECT deal_id, part, i, sum(x::DECIMAL(20, 6))::DOUBLE AS x FROM e GROUP BY ALL), v AS (SELECT deal_id, part, i, round(1000000 * (x / sqrt(sum(x * x) OVER (PARTITION BY deal_id, part))))::BIGINT AS m FROM c)
SELECT deal_id, part, count(*) FILTER (m <> 0)::INT AS n_cells, sum(m * (i + 1))::BIGINT AS cell_sum, sum(m * m)::BIGINT BETWEEN 999000000000 AND 1001000000000 AS is_unit FROM v GROUP BY ALL"""
)
def profile_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five texts of deals' profiles as hashed unit vectors: their cells in millionths, weighted by place."""
    made = P.profile_artifacts(P.deal_profile(spread(deals(spark, sf_dir))), lambda rows: V.hash_vectors(rows, F.col("text")))
    cells = made.select("deal_id", "part", F.posexplode("embedding").alias("i", "x")).select("deal_id", "part", "i", F.round(F.col("x").cast("double") * 1_000_000).cast("long").alias("m"))
    return cells.groupBy("deal_id", "part").agg(F.count_if(F.col("m") != 0).cast("int").alias("n_cells"), F.sum(F.col("m") * (F.col("i") + 1)).alias("cell_sum"), F.sum(F.col("m") * F.col("m")).between(999_000_000_000, 1_001_000_000_000).alias("is_unit"))


NO_WORDS = ",".join(f'"{n}":null' for n in ("stage_label", "geography", "problem", "solution", "market_size"))
NO_MORE = ",".join(f'"{n}":null' for n in ("team_bios", "traction_metrics", "competitors", "use_of_funds_breakdown"))


@book.query(
    f"""WITH d AS (SELECT s_suppkey, s_name, '{{"tear_sheet":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'approved' ELSE 'missing' END || '","pitch_deck":"missing","financial_projections":"missing","nda":"draft","ppm":"missing","subscription_agreement":"missing","wiring_instructions":"missing","use_of_funds":"missing"}}' AS documents FROM supplier)
SELECT s_suppkey, documents, '{{"deal_id":"d' || s_suppkey || '","company_name":"' || s_name || '","company_website":"","industry":"","raise_amount":' || CASE WHEN s_suppkey % 3 = 0 THEN '250000.0' ELSE '0.0' END || ',"founder_name":"","founder_email":"","founder_linkedin":"","stage":"onboarded","documents":' || documents || ',{NO_WORDS},"valuation":null,{NO_MORE},"investors_contacted":[{{"id":"' || s_suppkey || '"}}],"investors_responded":[],"investors_committed":[],"disqualified_investors":[],"nda_signed_by":[],"wire_verifications":[],"outreach_week":' || CASE WHEN s_suppkey % 5 = 0 THEN '3' ELSE '0' END || ',"campaign_active":false,"meetalfred_approved":false,"meetalfred_campaign_id":null,"box_folder_id":null,"created_at":null,"last_updated":null,"step_log":[],"errors":[],"skipped_steps":[]}}' AS deal,
  '{{"deal_id":"d' || s_suppkey || '","company_name":"' || s_name || '","industry":"","company_website":"","raise_amount":0.0,"stage":"seed","geography":["United States"],"subindustry":null,"business_model":null,"traction_metrics":{{"arr":"' || s_suppkey || '"}},"text_fields":{{}},"generated_at":null}}' AS company FROM d"""
)
def deal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public records of deals, their documents and companies as JSON with every field."""
    k = F.col("s_suppkey")
    papers = F.create_map(F.lit("nda"), F.lit("draft"), F.lit("tear_sheet"), F.when(k % 2 == 0, "approved"))
    key = F.concat(F.lit("d"), k)
    deal = C.deal_record(deal_id=key, company_name=F.col("s_name"), raise_amount=F.when(k % 3 == 0, 250_000.0), documents=papers, investors_contacted=F.array(F.create_map(F.lit("id"), k.cast("string"))), outreach_week=F.when(k % 5 == 0, 3))
    company = C.company_record(deal_id=key, company_name=F.col("s_name"), stage=F.lit("seed"), traction_metrics=F.create_map(F.lit("arr"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k, C.as_json(C.documents_record(papers)).alias("documents"), C.as_json(deal).alias("deal"), C.as_json(company).alias("company"))
