"""Rule tables and settings. Every operator takes its table as a parameter; these are the defaults.

All tables of this module are fixed values: results depend on them word for word.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

#: Term, weight.
TERM_WEIGHTS = {
    "default": 6, "distress": 6, "refinancing": 5, "credit spread": 5, "downgrade": 5, "impairment": 5, "write-down": 5, "writedown": 5,
    "covenant": 4, "private credit": 4, "secured debt": 4, "syndicated loan": 4, "bond issuance": 3, "guarantee": 4, "vendor financing": 5,
    "special purpose vehicle": 4, "spv": 3, "gpu-backed": 5, "401(k)": 5, "pension": 4, "target-date": 5, "retirement": 4,
    "index inclusion": 5, "nasdaq-100": 4, "s&p 500": 4, "ipo": 3, "price cut": 4, "margin compression": 5, "cannibal": 5,
    "overcapacity": 5, "utilization": 3, "lease cancellation": 6, "capex": 2, "free cash flow": 3,
}
#: Any of these adds STRESS_BONUS once.
STRESS_TERMS = ("default", "distress", "downgrade", "impairment", "write-down", "writedown", "covenant breach", "canceled", "cancelled", "overcapacity", "margin compression", "refinancing risk", "credit spreads widened", "lease cancellation")
STRESS_BONUS = 4
#: Category, terms; the first category with a term in the text wins.
CATEGORY_RULES = (
    ("distribution", ("401(k)", "pension", "retirement", "target-date", "index inclusion", "nasdaq-100", "s&p 500")),
    ("credit", ("debt", "loan", "credit", "refinancing", "bond", "guarantee", "gpu-backed", "private credit")),
    ("ipo", ("ipo", "public offering", "listing")),
    ("cannibalization", ("price cut", "margin", "cannibal", "overcapacity", "utilization", "inference cost")),
)
OTHER_CATEGORY = "general"
#: Alias, canonical name.
ALIASES = {
    "NVIDIA Corporation": "Nvidia", "NVIDIA": "Nvidia", "NVDA": "Nvidia", "Microsoft Corporation": "Microsoft", "MSFT": "Microsoft",
    "Amazon Web Services": "Amazon", "AWS": "Amazon", "Amazon.com": "Amazon", "Alphabet Inc.": "Alphabet", "Google LLC": "Alphabet",
    "Google": "Alphabet", "Meta Platforms": "Meta", "Oracle Corporation": "Oracle", "CoreWeave, Inc.": "CoreWeave",
    "BlackRock, Inc.": "BlackRock", "OpenAI Global": "OpenAI", "OpenAI Group": "OpenAI", "Anthropic PBC": "Anthropic", "Claude": "Anthropic",
    "Alibaba Cloud": "Alibaba", "Qwen": "Alibaba", "ERNIE": "Baidu", "Doubao": "ByteDance", "Hunyuan": "Tencent", "Kimi": "Moonshot AI",
    "GLM": "Zhipu AI", "Twitter": "X (Twitter)", "Twitter, Inc.": "X (Twitter)", "X Corp.": "X (Twitter)", "X Holdings": "X (Twitter)",
    "X Holdings Corp.": "X (Twitter)", "X.AI Holdings Corp.": "xAI", "X.AI Corp.": "xAI",
}
#: Event type, phrases, confidence, instrument.
EVENT_RULES = (
    ("INVESTS_IN", ("invests in", "invested in", "investment in"), 0.86, "equity"),
    ("LENDS_TO", ("lends to", "loan to", "credit facility"), 0.82, "debt"),
    ("GUARANTEES", ("guarantees", "guarantee for", "backstops"), 0.88, "guarantee"),
    ("SUPPLIES", ("supplies", "supplier to", "provides chips to"), 0.78, None),
    ("PURCHASES_FROM", ("purchases from", "buys from", "orders from"), 0.78, None),
    ("LEASES_FROM", ("leases from", "lease with", "leasing from"), 0.80, "lease"),
    ("ALLOCATES_TO", ("allocates to", "allocation to"), 0.80, None),
    ("REFINANCES", ("refinances", "refinancing"), 0.82, "debt"),
    ("ISSUES_DEBT", ("issues debt", "bond issuance", "issues bonds"), 0.86, "debt"),
    ("FILES_FOR_IPO", ("files for ipo", "filed for ipo", "confidentially filed"), 0.90, None),
    ("ENTERS_INDEX", ("enters the nasdaq-100", "joins the nasdaq-100", "enters the s&p 500"), 0.92, None),
    ("PRICE_CUT", ("price cut", "cuts prices", "reduced prices"), 0.82, None),
    ("CAPEX_COMMITMENT", ("capital expenditure", "capex", "infrastructure commitment"), 0.76, None),
    ("DOWNGRADE", ("downgraded", "credit rating downgrade", "rating lowered"), 0.88, "credit"),
    ("IMPAIRMENT", ("impairment charge", "write-down", "writedown"), 0.86, None),
    ("CANCELS_PROJECT", ("cancels project", "cancelled project", "lease cancellation", "scrapped plans"), 0.84, None),
    ("REVENUE_REPORT", ("ai revenue", "artificial intelligence revenue"), 0.72, None),
    ("FREE_CASH_FLOW", ("free cash flow",), 0.80, None),
    ("MODEL_RELEASE", ("released model", "launches model", "new frontier model"), 0.72, None),
    ("BENCHMARK_GAIN", ("benchmark", "outperforms", "beats"), 0.62, None),
)
EXTRACTOR = "deterministic-rules-v1"
FEED_BRAND = "google news"
#: Event type, variable, fallback value, polarity.
EVENT_VARIABLES = (
    ("ASSUMES_DEBT", "ai_related_debt", 1.0, "risk"),
    ("GUARANTEES", "vendor_financing", 1.0, "risk"),
    ("LENDS_TO", "ai_related_debt", 1.0, "risk"),
    ("ISSUES_DEBT", "ai_related_debt", 1.0, "risk"),
    ("REFINANCES", "refinancing_stress", 1.0, "risk"),
    ("INVESTS_IN", "ai_capital_commitments", 1.0, "risk"),
    ("CAPEX_COMMITMENT", "ai_capital_commitments", 1.0, "risk"),
    ("COMPLETES_IPO", "public_market_transmission_stage", 1.0, "risk"),
    ("ENTERS_INDEX", "public_market_transmission_stage", 2.0, "risk"),
    ("ALLOCATES_TO", "retirement_exposure", 1.0, "risk"),
    ("PRICE_CUT", "model_price_pressure", 1.0, "risk"),
    ("DOWNGRADE", "refinancing_stress", 2.0, "risk"),
    ("IMPAIRMENT", "refinancing_stress", 2.0, "risk"),
    ("CANCELS_PROJECT", "refinancing_stress", 1.5, "risk"),
    ("REVENUE_REPORT", "ai_external_revenue", 1.0, "safety"),
    ("FREE_CASH_FLOW", "free_cash_flow_strength", 1.0, "safety"),
    ("MODEL_RELEASE", "external_capability_pressure", 1.0, "risk"),
    ("BENCHMARK_GAIN", "external_capability_pressure", 1.0, "risk"),
)
#: Key, label, dimension, unit, direction, weight, minimum points, evidence basis.
VARIABLES = (
    ("ai_capital_commitments", "AI capital commitments", "capital", "USD", "higher_is_riskier", 1.3, 5, "aggregate"),
    ("ai_external_revenue", "External AI revenue", "monetization", "USD", "higher_is_safer", 1.5, 5, "aggregate"),
    ("vendor_financing", "Vendor financing", "circularity", "USD", "higher_is_riskier", 1.4, 5, "aggregate"),
    ("ai_related_debt", "AI-related debt", "fragility", "USD", "higher_is_riskier", 1.4, 5, "aggregate"),
    ("refinancing_stress", "Refinancing stress", "stress", "score", "higher_is_riskier", 1.7, 5, "aggregate"),
    ("public_index_exposure", "Public index exposure", "transmission", "percent", "higher_is_riskier", 1.2, 5, "aggregate"),
    ("public_market_transmission_stage", "Public-market transmission stage", "transmission", "score", "higher_is_riskier", 1.0, 1, "confirmed_trigger"),
    ("retirement_exposure", "Retirement exposure", "transmission", "USD", "higher_is_riskier", 1.5, 5, "aggregate"),
    ("model_price_pressure", "Model price pressure", "cannibalization", "percent", "higher_is_riskier", 1.0, 5, "aggregate"),
    ("external_capability_pressure", "External capability pressure", "external_pressure", "score", "higher_is_riskier", 1.3, 5, "aggregate"),
    ("external_price_performance_pressure", "External price-performance pressure", "external_pressure", "score", "higher_is_riskier", 1.5, 5, "aggregate"),
    ("free_cash_flow_strength", "Free cash flow strength", "counter_evidence", "USD", "higher_is_safer", 1.5, 5, "aggregate"),
    ("deleveraging", "Deleveraging", "counter_evidence", "score", "higher_is_safer", 1.2, 5, "aggregate"),
)
VARIABLE_SCHEMA = "key string, label string, dimension string, unit string, direction string, weight double, minimum_points int, evidence_basis string"
#: Dimensions in the order in which the gate names them.
RISK_DIMENSIONS = ("capital", "circularity", "monetization", "cannibalization", "fragility", "transmission", "stress", "external_pressure")
PROPAGATION = ("fragility", "stress", "transmission")
ECONOMICS = ("monetization", "capital", "circularity")
COUNTER = "counter_evidence"
#: Fixed values of the evidence preflight.
PLACEHOLDERS = ("review for debt, guarantees, capital expenditure", "review this filing for debt, guarantees, capital expenditure")
HYPOTHETICAL = ("may adversely", "may not be able", "may not produce", "might adversely", "could adversely", "could result in", "would adversely", "we may incur")
TRANSACTIONS = ("ACQUIRES", "ALLOCATES_TO", "ASSUMES_DEBT", "CAPEX_COMMITMENT", "CANCELS_PROJECT", "COMPLETES_IPO", "ENTERS_INDEX", "FILES_FOR_IPO", "GUARANTEES", "IMPAIRMENT", "INVESTS_IN", "ISSUES_DEBT", "LEASES_FROM", "LENDS_TO", "PURCHASES_FROM", "REFINANCES", "SUPPLIES")
REASONS = (
    "The extracted event has no quoted source evidence.",
    "The text is a filing-review placeholder, not evidence that an event occurred.",
    "The extracted amount exceeds the plausibility threshold and needs source checking.",
    "The excerpt is hypothetical risk language, not evidence of a completed event.",
)
#: Filing forms.
FORMS = ("8-K", "10-Q", "10-K", "S-1", "S-1/A", "424B4", "6-K", "20-F")
CORE_FORMS = ("10-Q", "10-K", "S-1", "S-1/A", "424B4", "20-F")
INDEX_ENTITIES = ("Nasdaq", "Nasdaq-100")
#: Search terms added to each company's name.
COMPANY_TERMS = "earnings OR revenue OR debt OR financing OR investment OR capex OR acquisition OR valuation OR IPO OR layoffs OR partnership"
PRESSURE_TOPICS = ('"frontier model" China benchmark price', '"open weight" frontier model benchmark', '"AI model" China cheaper than OpenAI', '"AI model" price performance China', '"frontier model" inference cost China', '"open source" AI model beats benchmark')
PRESSURE_MODELS = ("DeepSeek", "Qwen", "Claude", "ERNIE", "Doubao", "Hunyuan", "Kimi", "GLM", "MiniMax")
NEWS_QUERIES = (
    '"OpenAI" IPO', '"Anthropic" IPO', '"SpaceX" Nasdaq 100', '"SpaceX" xAI debt acquisition', '"xAI" "X" acquisition debt', '"Twitter" acquisition debt SpaceX',
    '"Nasdaq-100" "fast entry"', '"index inclusion" AI IPO', '"AI data center" debt', '"data center" private credit AI', '"GPU-backed" loan', '"GPU financing"',
    '"vendor financing" Nvidia AI', '"Nvidia" guarantee OpenAI', '"Broadcom" financing Anthropic', '"CoreWeave" debt', '"Oracle" AI debt financing',
    '"AI infrastructure" refinancing', '"AI infrastructure" credit spreads', '"401(k)" private markets AI', '"target-date fund" private markets',
    '"pension" AI infrastructure', '"pension fund" data center investment', '"retirement" private credit AI', '"AI" software cannibalization',
    '"AI model" price cuts', '"AI inference" price decline', '"AI margins" OpenAI Anthropic', '"AI capex" revenue gap', '"AI overcapacity" data center',
    '"data center" lease cancellation AI',
)
COMPANIES = (
    "OpenAI", "Anthropic", "Claude", "DeepSeek", "Alibaba", "Qwen", "Baidu", "ERNIE", "ByteDance", "Doubao", "Tencent", "Hunyuan", "Moonshot AI",
    "Kimi", "Zhipu AI", "GLM", "MiniMax", "Nvidia", "Microsoft", "Amazon", "AWS", "Alphabet", "Google", "Oracle", "CoreWeave", "Broadcom", "AMD",
    "SoftBank", "Apollo", "Blackstone", "BlackRock", "Meta", "SpaceX", "xAI", "X (Twitter)",
)
FILERS = (("NVIDIA", 1045810), ("Microsoft", 789019), ("Amazon", 1018724), ("Alphabet", 1652044), ("Oracle", 1341439), ("Meta", 1326801), ("CoreWeave", 1769628))


@dataclass(frozen=True)
class Indicators:
    """Constants of the indicator operators."""

    window_days: int = 90
    min_points: int = 5
    min_directional: int = 1
    prior: int = 5
    max_deviation: float = 25.0
    max_usd: float = 5e12
    usd_scale: float = 1e10
    score_step: float = 5.0  # raw scores up to this are steps of 20
    min_known: int = 3
    material: float = 55.0
    counter_weight: float = 0.25
    bands: tuple[tuple[float, str], ...] = ((25.0, "DISPERSED"), (45.0, "FORMING"), (65.0, "BUILDING PRESSURE"), (80.0, "FRAGILE"))
    top: str = "HIGH CONVERGENCE"


@dataclass(frozen=True)
class Settings:
    """What a run needs to know; :func:`load_settings` reads it from a TOML file."""

    queries: tuple[str, ...] = NEWS_QUERIES
    companies: tuple[str, ...] = COMPANIES
    filers: tuple[tuple[str, int], ...] = FILERS
    request_delay_seconds: float = 0.4
    high_signal_threshold: int = 7
    report_limit: int = 500
    poll_interval_minutes: int = 60
    max_chars: int = 400_000
    agent: str = "riskloom/1.0 contact@example.com"
    indicators: Indicators = field(default_factory=Indicators)


ENVIRONMENT = "RISKLOOM_"


def load_settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings from a TOML file with the tables monitor, news, entities and sec, and from the environment; what both lack keeps
    its default.

    RISKLOOM_CONFIG_PATH names the file if ``path`` doesn't. RISKLOOM_<FIELD> sets a number or text of Settings and
    goes before the file.
    """
    import os
    import tomllib

    env = os.environ if environment is None else environment
    path, given, fields = path or env.get(f"{ENVIRONMENT}CONFIG_PATH"), {}, Settings.__dataclass_fields__
    if path:
        with open(path, "rb") as f:
            c = tomllib.load(f)
        given = {k: v for k, v in c.get("monitor", {}).items() if k in fields}
        if "queries" in c.get("news", {}):
            given["queries"] = tuple(c["news"]["queries"])
        if "companies" in c.get("entities", {}):
            given["companies"] = tuple(c["entities"]["companies"])
        if "companies" in c.get("sec", {}):
            given["filers"] = tuple((x["name"], int(x["cik"])) for x in c["sec"]["companies"])
    for name, f in fields.items():
        text = env.get(f"{ENVIRONMENT}{name.upper()}")
        if text is not None and isinstance(f.default, (int, float, str)):
            given[name] = type(f.default)(text)
    return Settings(**given)


def company_queries(companies: tuple[str, ...] = COMPANIES) -> list[str]:
    """A search for each company, in order, each once."""
    return [f'"{c}" ({COMPANY_TERMS})' for c in dict.fromkeys(companies)]


def pressure_queries() -> list[str]:
    return [*PRESSURE_TOPICS, *(f'"{m}" model pricing benchmark' for m in PRESSURE_MODELS)]
