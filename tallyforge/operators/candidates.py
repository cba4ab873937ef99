"""Candidates out of raw rows and people-search answers, their guesses, and the records that leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import check_range
from tallyforge.functions.fixed import DOCUMENT_NAMES, FINAL_WEIGHTS, FOCUS_LABELS, RAISED_STAGES, WARM_FIRMS
from tallyforge.functions.text import has_any, strings


def _or(name: str | Column, other) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c, other if isinstance(other, Column) else F.lit(other))


def focus_labels(text: Column) -> Column:
    """Labels of which a key word is a substring of the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(has_any(t, keys), label) for label, keys in FOCUS_LABELS.items()]))


def stages_in(text: Column) -> Column:
    """Stages that a text names; seed and series a where it names none. (A text that says "pre-seed" says "seed", too.)"""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(s)), s.replace(" ", "_")) for s in RAISED_STAGES]))
    return F.when(F.size(found) > 0, found).otherwise(strings(["seed", "series_a"]))


def check_by_title(title: Column) -> tuple[Column, Column]:
    t = F.lower(F.coalesce(title, F.lit("")))
    lead = has_any(t, ("managing partner", "general partner"))
    low = F.when(F.contains(t, F.lit("principal")), 250_000).when(lead, 500_000).otherwise(250_000)
    high = F.when(F.contains(t, F.lit("principal")), 3_000_000).when(lead, 10_000_000).otherwise(5_000_000)
    return low.cast("long"), high.cast("long")


def firm_name(raw: Column) -> Column:
    """A firm's or a site's name as words with capitals: without ".com", scheme, "www." and hyphens."""
    bare = F.coalesce(raw, F.lit(""))
    for part in (".com", "https://", "www."):
        bare = F.replace(bare, F.lit(part), F.lit(""))
    words = F.filter(F.split(F.replace(bare, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    capital = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.when(capital == "", "Unknown VC").otherwise(capital)


def signal(kind: Column | str, text: Column, url: Column | str = "", date: Column | str = "", confidence: float | Column = 0.7) -> Column:
    def c(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(c(kind).alias("source_type"), text.alias("text"), c(url).alias("source_url"), c(date).alias("date"), c(confidence).alias("confidence"), F.lit("public").alias("visibility"))


def fund(**given: Column) -> Column:
    """A fund with every field, those not given at their defaults."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("double")
    fields = {
        "fund_id": F.lit(""), "name": F.lit(""), "stage_focus": none, "check_size_min": F.lit(100_000).cast("long"), "check_size_max": F.lit(2_000_000).cast("long"), "geography": strings(["United States"]), "industry_focus": none, "sector_exclusions": none,
        "lead_preference": F.lit("either"), "status": F.lit("active"), "recent_investment_count_12m": F.lit(0), "thesis_text": F.lit(""), "aum_millions": null, "dry_powder_millions": null, "preferred_verticals": none,
    }
    return F.struct(*[F.coalesce(given[k], v).alias(k) if k in given else v.alias(k) for k, v in fields.items()])


def candidate(rows: DataFrame, **given: Column) -> DataFrame:
    """One candidate a row, with every field of a public record; those not given at their defaults."""
    none = F.array().cast("array<string>")
    text = ("investor_id", "full_name", "firm", "title", "email", "phone", "linkedin_url", "twitter_handle", "website", "investment_thesis", "check_size_range", "last_verified_at", "investor_type", "pitchbook_id", "hq_location", "hq_state")
    fields = {n: F.lit("") for n in text} | {
        "portfolio_companies": none, "source_tags": none, "warm_intro_paths": none, "data_quality_confidence": F.lit(0.8), "fund": fund(), "signals": F.array().cast("array<struct<source_type:string,text:string,source_url:string,date:string,confidence:double,visibility:string>>"),
        "metadata": F.create_map().cast("map<string,string>"),
    }
    return rows.select(*[F.coalesce(given[k], v).alias(k) if k in given else v.alias(k) for k, v in fields.items()])


def from_raw(rows: DataFrame, tag: str, verified: str = "2026-02-24") -> DataFrame:
    """Candidates out of a raw list: idx (from 1) and text columns, portfolio_companies an array; thesis and firm give the guesses."""
    thesis, good, firm = _or("investment_thesis", ""), _or("why_good_fit", ""), F.lower(_or("firm", ""))
    low, high = check_range(F.col("check_size_range"))
    focus = focus_labels(F.concat(thesis, F.lit(" "), good))
    companies = _or("portfolio_companies", strings([]))
    own = fund(
        fund_id=F.concat(F.lit("fund_seed_"), "idx"), name=_or("firm", "Unknown Fund"), stage_focus=stages_in(thesis), check_size_min=low, check_size_max=high, geography=strings(["United States", "Canada"]),
        industry_focus=F.when(F.size(focus) > 0, focus).otherwise(strings(["Technology"])), recent_investment_count_12m=(6 + F.col("idx") % 4).cast("int"), thesis_text=thesis,
    )
    signals = F.array(signal("sample_dataset", good, _or("linkedin_url", ""), verified, 0.8), signal("portfolio_summary", F.array_join(companies, "; "), _or("website", ""), verified, 0.7))
    warm = F.array_compact(F.array(F.when(F.contains(firm, F.lit("securities")), "Warm path via GT Securities colleague"), F.when(has_any(firm, WARM_FIRMS), "Warm path via Millenia network (prior target list)")))
    same = {n: F.col(n) for n in ("title", "email", "phone", "linkedin_url", "twitter_handle", "website", "check_size_range")}
    return candidate(
        rows, **same | {"title": _or("title", "Partner")}, investor_id=F.concat(F.lit("seed_"), "idx"), full_name=_or("full_name", F.concat(F.lit("Investor "), "idx")), firm=_or("firm", "Unknown Firm"), fund=own, investment_thesis=thesis,
        portfolio_companies=companies, signals=signals, source_tags=strings([tag]), warm_intro_paths=warm, data_quality_confidence=F.when((_or("email", "") != "") & (_or("linkedin_url", "") != ""), 0.9).otherwise(0.7), last_verified_at=F.lit(verified),
    )


def from_people(rows: DataFrame, industry: str, today: str) -> DataFrame:
    """Candidates out of people-search answers (idx from 1, name, firm, website, title, ...) for a deal of that industry."""
    titled = F.initcap(F.lit(industry))
    firm = firm_name(F.when(_or("firm", "") != "", F.col("firm")).otherwise(_or("website", "Unknown VC")))
    title = _or("title", "Partner")
    low, high = check_by_title(title)
    thesis = F.concat(titled, F.lit(" and technology investments with focus on early-stage opportunities."))
    own = fund(
        fund_id=F.concat(F.lit("fund_apollo_"), "idx"), name=firm, stage_focus=strings(["seed", "series_a"]), check_size_min=low, check_size_max=high, geography=strings(["United States", "Canada"]), industry_focus=F.array(titled, F.lit("Technology")),
        recent_investment_count_12m=(4 + F.col("idx") % 5).cast("int"), thesis_text=thesis,
    )
    signals = F.array(
        signal("apollo_stub", F.concat(F.lit("Profile indicates "), title, F.lit(" at "), firm, F.lit(f" with {industry} focus.")), _or("linkedin", ""), today, 0.65),
        signal("public_post", F.lit(f"Interested in seed-stage {industry} founders with strong GTM discipline."), "", today, 0.55),
    )
    spread = F.concat(F.lit("$"), F.format_string("%.0f", low / 1000), F.lit("K - $"), F.format_string("%.0f", high / 1_000_000), F.lit("M"))
    return candidate(
        rows, investor_id=F.concat(F.lit("apollo_"), "idx"), full_name=_or("name", F.concat(F.lit("Apollo Contact "), "idx")), firm=firm, title=title, email=F.col("email"), phone=F.col("phone"), linkedin_url=F.col("linkedin"),
        twitter_handle=F.col("twitter"), website=F.col("website"), fund=own, investment_thesis=thesis, portfolio_companies=F.array(F.concat(titled, F.lit(" Co "), "idx"), F.concat(F.lit("Enterprise Tool "), "idx")), check_size_range=spread,
        signals=signals, source_tags=strings(["apollo_stub"]), data_quality_confidence=F.lit(0.72), last_verified_at=F.lit(today), metadata=F.create_map(F.lit("lead_preference"), F.lit("either")),
    )


def imported(rows: DataFrame, prefix: str = "pb_", most: int | None = None, *order: str) -> DataFrame:
    """Investors of one origin, by their ids' prefix; the first so many in order where a limit is given."""
    out = rows.filter(F.col("investor_id").startswith(prefix))
    return out.orderBy(*order).limit(most) if most is not None else out


def enriched(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """candidates (full_name, firm, ...) with the contact fields of a saved enrichment answer of the same name and firm,
    where they have none. people: name, company, email, phone, linkedin_url, one row a name and firm."""
    found = people.select(F.lower(F.trim("name")).alias("_name"), F.lower(F.trim("company")).alias("_firm"), *[F.col(n).alias(f"_{n}") for n in ("email", "phone", "linkedin_url")]).dropDuplicates(["_name", "_firm"])
    both = candidates.join(found, (F.lower(F.trim("full_name")) == F.col("_name")) & (F.lower(F.trim("firm")) == F.col("_firm")), "left")
    own = {n: F.when(F.coalesce(n, F.lit("")) != "", F.col(n)).otherwise(F.coalesce(f"_{n}", F.lit(""))) for n in ("email", "phone", "linkedin_url")}
    return both.select(*[own[c].alias(c) if c in own else F.col(c) for c in candidates.columns])


# ---- records ---------------------------------------------------------------------------


def wire(w: Column) -> Column:
    """A wire with its defaults: status pending, amount 0, texts empty, times as they are."""
    return F.struct(
        F.coalesce(w.investor_name, F.lit("")).alias("investor_name"), F.coalesce(w.firm, F.lit("")).alias("firm"), F.coalesce(w.wire_amount.cast("double"), F.lit(0.0)).alias("wire_amount"), F.coalesce(w.status, F.lit("pending")).alias("status"),
        w.client_confirmed_at.alias("client_confirmed_at"), w.investor_confirmed_at.alias("investor_confirmed_at"), w.dock_walls_approved_at.alias("dock_walls_approved_at"), F.coalesce(w.notes, F.lit("")).alias("notes"),
    )


def needs_approval(status: Column) -> Column:
    """A wire that one side has confirmed waits for the approval."""
    return F.coalesce(status.isin("client_confirmed", "investor_confirmed"), F.lit(False))


def feature_record() -> Column:
    """The features of a match as a struct, with those that no rule fills yet at their defaults."""
    names = ("semantic_fit", "stage_compatibility", "check_size_compatibility", "recent_activity", "portfolio_adjacency", "geography_fit", "warm_intro_score", "data_quality_confidence")
    own = ("semantic_fit", "stage_fit", "check_fit", "recent_activity", "portfolio_adjacency", "geography_fit", "warm_intro_score", "data_quality_confidence")
    return F.struct(*[F.col(c).alias(n) for n, c in zip(names, own, strict=True)], F.col("keyword_score").alias("keyword_overlap"), F.lit(0.0).alias("style_affinity"), F.lit(0.5).alias("response_likelihood_prior"))


def weights_record() -> Column:
    return F.create_map(*[F.lit(x) for k, v in FINAL_WEIGHTS.items() for x in (k, v)])


def match_record(investor: Column) -> Column:
    """rank, final_score, weights, features, explanation (columns explanation, score, rank) and the investor of a match."""
    return F.struct(F.col("rank"), F.col("score").alias("final_score"), weights_record().alias("score_weights"), feature_record().alias("features"), F.col("explanation"), investor.alias("investor"))


def run_record(results: DataFrame, deal: Column, inputs: Column, counts: Column, models: Column, at: str) -> DataFrame:
    """One row: a run with its inputs, counts and results (a column result with rank) in rank order, waiting for review."""
    listed = results.agg(F.array_sort(F.collect_list("result"), lambda a, b: a["rank"] - b["rank"]).alias("results"))
    queue = F.struct(F.lit("pending_phil_team_review").alias("status"), strings(["editable_exclusions", "override_rank", "pin_investor", "mark_do_not_contact", "save_approval_rationale"]).alias("human_in_loop_controls"))
    return listed.select(deal.alias("deal"), inputs.alias("query_inputs"), models.alias("model_versions"), weights_record().alias("score_weights"), counts.alias("candidate_counts"), "results", queue.alias("approval_queue"), F.lit(at).alias("generated_at"))


def _record(fields: dict[str, Column], given: dict[str, Column]) -> Column:
    if unknown := set(given) - set(fields):
        raise ValueError(f"no fields of the record: {sorted(unknown)}")
    return F.struct(*[F.coalesce(given[k], v).alias(k) if k in given else v.alias(k) for k, v in fields.items()])


def company_record(**given: Column) -> Column:
    """A company's profile with every field in order; those not given, and nulls, at their defaults."""
    texts = F.create_map().cast("map<string,string>")
    null = F.lit(None).cast("string")
    fields = {n: F.lit("") for n in ("deal_id", "company_name", "industry", "company_website")} | {"raise_amount": F.lit(0.0), "stage": F.lit(""), "geography": strings(["United States"]), "subindustry": null, "business_model": null, "traction_metrics": texts, "text_fields": texts, "generated_at": null}
    return _record(fields, given)


def documents_record(documents: Column) -> Column:
    """The status of each of the eight documents from a map of statuses; missing where there is none."""
    return F.struct(*[F.coalesce(F.try_element_at(documents, F.lit(n)), F.lit("missing")).alias(n) for n in DOCUMENT_NAMES])


def deal_record(**given: Column) -> Column:
    """A deal with every field in order; those not given, and nulls, at their defaults. documents: a map of statuses."""
    null = F.lit(None)
    people = F.array().cast("array<map<string,string>>")
    none = F.array().cast("array<string>")
    no_wires = F.array().cast("array<struct<investor_name:string,firm:string,wire_amount:double,status:string,client_confirmed_at:string,investor_confirmed_at:string,dock_walls_approved_at:string,notes:string>>")
    fields = {
        "deal_id": F.lit(""), "company_name": F.lit(""), "company_website": F.lit(""), "industry": F.lit(""), "raise_amount": F.lit(0.0), "founder_name": F.lit(""), "founder_email": F.lit(""), "founder_linkedin": F.lit(""), "stage": F.lit("onboarded"),
        "documents": documents_record(given.get("documents", F.create_map().cast("map<string,string>"))), **{n: null.cast("string") for n in ("stage_label", "geography", "problem", "solution", "market_size")}, "valuation": null.cast("double"),
        **{n: null.cast("string") for n in ("team_bios", "traction_metrics", "competitors", "use_of_funds_breakdown")}, **{n: people for n in ("investors_contacted", "investors_responded", "investors_committed", "disqualified_investors")}, "nda_signed_by": none, "wire_verifications": no_wires,
        "outreach_week": F.lit(0), "campaign_active": F.lit(False), "meetalfred_approved": F.lit(False), "meetalfred_campaign_id": null.cast("string"), "box_folder_id": null.cast("string"), "created_at": null.cast("string"), "last_updated": null.cast("string"),
        "step_log": people, "errors": none, "skipped_steps": none,
    }
    return _record(fields, {k: v for k, v in given.items() if k != "documents"})


def as_json(record: Column) -> Column:
    """A record as JSON text, nulls kept."""
    return F.to_json(record, {"ignoreNullFields": "false"})
