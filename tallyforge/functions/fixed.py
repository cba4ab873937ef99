"""Word lists, weights and limits that results depend on."""

from __future__ import annotations

FINAL_WEIGHTS = {
    "semantic_fit": 0.35,
    "stage_and_check": 0.20,
    "recent_activity": 0.20,
    "portfolio_adjacency": 0.10,
    "geography_fit": 0.05,
    "warm_intro_score": 0.05,
    "data_quality_confidence": 0.05,
}
FUSION_WEIGHTS = {"fund_thesis": 0.35, "partner_bio": 0.30, "portfolio": 0.15, "activity": 0.20}
NAMESPACES = ("fund_thesis", "partner_bio", "portfolio", "activity")

STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "into", "are", "is", "in", "of", "to", "a", "an")

INDUSTRY_NEEDLES = {
    "ai": ["artificial intelligence", "machine learning", " ai ", " ai-", "ai infrastructure", "genai", "deep learning", "large language", "llm", "nlp", "computer vision", "generative ai", "foundation model"],
    "fintech": ["fintech", "financial technology", "payments", "banking", "lending", "credit", "insurance", "insurtech", "wealth management", "capital markets", "financial services", "other financial services", "financial software", "payment processing", "neobank", "regtech"],
    "healthcare": [
        "healthcare", "health tech", "healthtech", "clinical", "medical", "pharmaceutical", "pharmaceuticals", "biotechnology", "biotech", "biopharma", "life sciences", "health services", "surgical devices", "surgical", "diagnostic", "diagnostics", "patient", "hospital", "pharma", "therapeutics", "drug discovery",
        "medical devices", "medical supplies", "other healthcare", "digital health", "m-health", "consumer health",
    ],
    "real_estate": ["real estate", "proptech", "property", "commercial real estate", "residential"],
    "manufacturing": ["manufacturing", "industrial", "factory", "supply chain", "logistics"],
    "energy": ["energy", "clean energy", "climate", "renewable", "battery", "nuclear", "solar", "wind", "decarbonization", "cleantech", "power generation", "chemicals and gases", "chemicals", "gases", "metals", "geothermal", "carbon capture"],
    "consumer": ["consumer", "restaurant", "retail", "cpg", "hospitality", "food and beverage", "direct to consumer", "e-commerce", "consumer products and services"],
    "robotics": ["robotics", "drone", "drones", "automation", "agriculture", "agtech", "autonomous systems", "autonomous vehicles"],
    "enterprise_software": ["enterprise software", "b2b", "saas", "workflow", "software", "developer tools", "information technology", "it services", "other information technology", "devtools", "productivity software"],
    "defense": ["aerospace", "defense", "defence", "dual-use", "military", "national security", "government tech", "govtech", "aerospace and defense", "communications and networking"],
    "crypto": ["crypto", "blockchain", "nft", "web3", "defi", "digital assets", "dao", "token", "decentralized finance", "cryptocurrency"],
    "hardware": ["hardware", "semiconductor", "chip", "electronic equipment", "electronic equipment and instruments", "instruments", "sensors", "devices", "medical devices", "diagnostic equipment", "other devices and supplies"],
}
TERM_EXPANSION = {"ai": "enterprise_software", "fintech": "enterprise_software", "healthcare": "hardware"}

GEO_ALIASES = {
    "u.s.": "united states",
    "u.s": "united states",
    "usa": "united states",
    "us": "united states",
    "southeast us": "southeast",
    "southeast united states": "southeast",
    "southwest us": "southwest",
    "northeast us": "northeast",
    "midwest us": "midwest",
}
GEO_DERIVED = ("united states", "texas", "southeast", "north america")
GEO_BROAD = ("global", "north america", "americas", "united states", "usa", "us")

STAGE_ALIASES = {"preseed": "pre_seed", "pre_seed": "pre_seed", "seed": "seed", "series_a": "series_a", "series_b": "series_b", "series_c": "series_c", "growth": "growth", "buyout": "buyout"}

NEWS_FRAGMENTS = ("bloomberg.com", "reuters.com", "wsj.com", "ft.com", "techcrunch.com", "axios.com", "forbes.com", "cnbc.com", "venturebeat.com", "prnewswire.com", "businesswire.com", "nytimes.com", "theinformation.com", "pitchbook.com", "sifted.eu")
TIER_BASE = {"official": 120.0, "news": 55.0, "other": 8.0}
TIER_QUOTA = {"official": 4, "news": 2}
BUCKET_SCORES = {"portfolio": 14, "team": 14, "contact": 12, "careers": 10, "news": 9, "general": 2}
DISCOVERY_WORDS = ("about", "team", "portfolio", "news", "press", "blog", "careers", "jobs", "contact", "pitch", "submit", "founders", "apply", "people", "leadership")
TRUSTED_PATH_WORDS = ("portfolio", "invest", "investment", "team", "partner", "principal", "contact", "careers", "founder", "submit")
BLOCKED_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
BLOCKED_FRAGMENTS = ("/feed", "/tag/", "/category/", "/wp-content/", "/wp-json/", "utm_", "share=", "javascript:")
SOCIAL_FRAGMENTS = ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "tiktok.com")
NAME_STOP_WORDS = ("capital", "ventures", "venture", "management", "group", "partners", "partner", "investments", "investment", "holdings", "fund", "funds", "equity", "vc", "lp", "llc", "co", "company")

TARGET_CHECK = 1_000_000.0
TARGET_SECTOR, TARGET_STAGE, TARGET_GEOGRAPHY = "fintech", "seed", "U.S."
SECTOR_TERMS = {
    "ai": ["artificial intelligence", "ai", "machine learning", "ml", "data science", "software"],
    "fintech": ["fintech", "financial", "finance", "payments", "banking", "insurtech", "lending"],
    "real estate": ["real estate", "office", "industrial", "multifamily", "commercial", "retail", "proptech"],
    "hospitality": ["hospitality", "hotel", "travel", "leisure"],
    "sports": ["sports", "fitness", "athletic"],
    "entertainment": ["entertainment", "media", "consumer internet", "digital media"],
}
STAGE_TERMS = {
    "pre-seed": ["pre-seed", "angel", "incubator", "accelerator", "early stage"],
    "seed": ["seed", "startup", "startups", "early stage", "venture capital", "vc"],
    "series a": ["series a", "a round", "institutional seed", "venture capital", "vc"],
    "growth": ["growth", "expansion", "late stage", "series b", "series c", "scale"],
    "private equity": ["private equity", "pe", "buyout", "acquisition"],
}
TARGET_US = ("u.s.", "us", "usa", "united states")
TARGET_US_PLACES = ("united states", "u.s.", "usa", "texas", "california", "new york")
MERGE_THIN, MERGE_THIN_GEO = 12, 8
LEAST_SITE_CHARS = LEAST_SEARCH_CHARS = 120
FINTECH_EXPLICIT = ("fintech", "payments", "payment", "banking", "insurtech", "lending", "financial services", "credit", "credit card", "embedded finance", "wealthtech", "debt financing")
FINTECH_WEAK = ("financial", "finance", "financing", "insurance", "capital markets")
INSTITUTIONAL_MARKERS = ("endowment", "foundation", "university", "nonprofit", "philanthrop", "charitable", "pension")
VENTURE_MARKERS = ("venture", "vc", "seed", "early stage", "angel", "accelerator", "fund", "startup")
ACTIVITY_TERMS = ("investment", "invested", "funding", "round", "led", "backed", "portfolio")
PUBLIC_STRONG = ("announced investment", "led round", "portfolio announcement", "investment thesis", "funding announcement", "invested in", "led the round")
PUBLIC_MEDIUM = ("press release", "portfolio", "newsroom", "investment update", "backed by", "announced")
ROUND_TERMS = ("led", "funding", "round", "invested in", "announced investment")
US_TOKENS = ("united states", "u.s.", "us", "usa", "texas", "california", "new york")

FUND_TOPICS = ("new fund", "closed fund", "fundraise", "fundraising", "fund close")
FUND_ACTIONS = ("announced", "closed", "launch", "raise", "raises", "closes")
HIRING_TERMS = ("we are hiring", "hiring", "open role", "open position", "join our team", "careers", "job opening")
HIRING_ROLES = ("investment team", "venture associate", "investment associate", "principal", "analyst", "investor relations")
WARM_PLACES = ("u.s.", "united states", "usa", "texas", "california", "new york")
PORTFOLIO_MARKERS = ("portfolio", "invested in", "backed", "led round", "co-invest")
PUBLIC_ACTIVITY = ("investment thesis", "blog", "press", "announcement", "conference")
SITE_WORDS = ("official", "about", "team", "portfolio", "contact", "partners", "venture")
SITE_ACTIVITY_TERMS = ("investment", "invested", "funding", "fund", "portfolio", "announced", "press release", "news", "hiring", "careers", "launch", "closed")
RECENT_VERBS = ("announced", "invested", "led", "launch", "closed", "hiring")
TEXT_BUCKETS = ("team", "contact", "portfolio", "careers", "news", "general")
BENIGN_STATUSES = (401, 403, 404, 410)
PAGE_CHARS, PAGES_A_SITE, RANKED_SHOWN, DEBUG_CHARS = 8000, 4, 12, 400
ACTIVE_INTENT = 5
QUERY_TEMPLATES = {
    "recent_deal_text": '"{name}" investment funding round led {year} {site_bias}',
    "new_fund_text": '"{name}" new fund raised closes {site_bias}',
    "hiring_text": '"{name}" careers hiring investment team associate {site_bias}',
    "public_signal_text": '"{name}" portfolio press announcement investment',
    "outreach_text": '"{name}" partner principal contact pitch founders submit deck {site_bias}',
}
GENERATED_SIGNALS = ("pitchbook_activity", "pitchbook_activity_count", "fundraising_status")
FIT_KEYS = ("Sector Match", "Stage Match", "Check Size Match", "Geography Match", "Strategic Alignment")
INTENT_KEYS = ("Recent Investment", "New Fund", "Hiring", "Public Signals", "Warm Intro")
QUERY_KEYS = ("recent_deal_text", "new_fund_text", "hiring_text", "public_signal_text", "outreach_text")
ACTIVITY_SOURCES = ("news_rss", "google_news", "news_mention", "linkedin_post", "twitter_post", "press_release", "portfolio_announcement", "crunchbase_deal", "pitchbook_activity", "pitchbook_activity_count", "fundraising_status", "pitchbook_deal")

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_PATTERN = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"

REPORT_COLUMNS = ("Investor", "Signal Score", "Investment Probability (%)", "Signal Type", "Sector Relevance", "Check Size Fit", "Warm Intro Signal", "Recency", "Confidence", "Reason", "Recommended Action", "Signal Bucket", "Urgency / Timing", "Data Source", "Last Updated")
DOCUMENT_NAMES = ("tear_sheet", "pitch_deck", "financial_projections", "nda", "ppm", "subscription_agreement", "wiring_instructions", "use_of_funds")

FOCUS_LABELS = {
    "Artificial Intelligence": ["ai", "machine learning", "ml"],
    "Fintech": ["fintech", "payments", "banking"],
    "Healthtech": ["health", "medtech", "digital health"],
    "Climate Tech": ["climate", "cleantech", "sustainability"],
    "Enterprise Software": ["enterprise", "software", "developer"],
}
RAISED_STAGES = ("pre-seed", "seed", "series a", "series b", "growth")
WARM_FIRMS = ("sequoia", "a16z", "khosla")

DOSSIER_FIELDS = (
    "company_name", "legal_company_name", "website", "industry_or_sector", "company_stage_or_company_idea", "headquarters_location", "incorporation_location", "year_founded", "legal_entity_structure", "one_line_description",
    "company_problem", "company_solution", "business_model", "target_customers", "competitive_advantage", "product_status", "revenue", "mrr", "arr", "growth_rate", "gross_margin", "burn_rate", "runway_months", "cash_on_hand",
    "ltv", "cac", "ltv_cac_ratio", "payback_period", "amount_raised_to_date", "cap_table_summary", "previous_investors", "valuation_last_round", "target_raise_amount", "minimum_investment", "valuation_current_ask",
    "pre_money_valuation", "post_money_valuation", "current_round", "instrument", "use_of_funds", "funding_milestones", "users_total", "users_active", "dau", "mau", "sales_pipeline", "conversion_rates", "average_order_value",
    "retention_rates", "churn_rate", "engagement_metrics", "partnerships", "contracts_signed", "lois", "key_milestones", "key_hires", "incorporation_documents", "ip_ownership", "trademarks_patents", "regulatory_exposure",
    "risk_disclosures", "market_size",
)
