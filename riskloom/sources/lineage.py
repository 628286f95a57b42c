"""Curated facts with their primary sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import stable_id

PROSPECTUS = "https://content.spacex.com/cms-assets/FINAL_Documents%20and%20Updates/SpaceX%20-%20EU%20Prospectus%20%28Approved%20by%20Bafin%29%20-%20June%205%2C%202026.pdf"
#: Title, url, source, date, event type, source entity, target entity, evidence, amount, currency.
FACTS = (
    ("X Holdings completes $44 billion acquisition of Twitter", "https://www.sec.gov/Archives/edgar/data/1418091/000119312522272772/d411753d8k.htm", "Twitter SEC filing", "2022-10-27", "ACQUIRES", "X Holdings", "X (Twitter)", "Twitter reported that the merger was completed on October 27, 2022 and Twitter became a wholly owned subsidiary of X Holdings. The transaction valued Twitter at approximately $44 billion.", 44e9, "USD"),
    ("Twitter acquisition financed with $13 billion of company debt", "https://www.sec.gov/Archives/edgar/data/1418091/000119312522195126/d283119dprer14a.htm", "Twitter SEC proxy", "2022-10-27", "ASSUMES_DEBT", "X (Twitter)", "X Holdings", "Twitter's proxy disclosed $13 billion in secured and unsecured debt financing commitments for the acquisition.", 13e9, "USD"),
    ("xAI acquires X Holdings in a share exchange", PROSPECTUS, "SpaceX 2026 prospectus", "2025-03-28", "ACQUIRES", "xAI", "X (Twitter)", "SpaceX's prospectus states that xAI acquired X Holdings effective March 28, 2025 and X became a wholly owned subsidiary of xAI.", None, None),
    ("SpaceX acquires xAI, including X", PROSPECTUS, "SpaceX 2026 prospectus", "2026-02-02", "ACQUIRES", "SpaceX", "xAI", "SpaceX's prospectus states that SpaceX acquired xAI, including X, effective February 2, 2026 and recast its financial statements to include their historical results.", None, None),
    ("SpaceX assumes debt through the xAI acquisition", PROSPECTUS, "SpaceX 2026 prospectus", "2026-02-02", "ASSUMES_DEBT", "SpaceX", "xAI", "SpaceX's prospectus states that the company had a technical default when it acquired xAI because of the amount of debt assumed at the subsidiary level.", None, None),
    ("SpaceX uses $20 billion bridge loan to refinance X and xAI debt", PROSPECTUS, "SpaceX 2026 prospectus", "2026-03-02", "REFINANCES", "SpaceX", "xAI", "SpaceX entered a $20 billion bridge loan whose proceeds repaid X term loans and xAI loans and secured notes.", 20e9, "USD"),
    ("SpaceX completes initial public offering and begins trading as SPCX", "https://content.spacex.com/cms-assets/FINAL_Documents%20and%20Updates/SpaceX_PricingAnnouncement.pdf?embed=true", "SpaceX pricing announcement", "2026-06-12", "COMPLETES_IPO", "SpaceX", "Nasdaq", "SpaceX announced that 555,555,555 Class A shares were priced at $135 per share and would begin trading on Nasdaq on June 12, 2026 under SPCX.", 75e9, "USD"),
    ("SpaceX joins the Nasdaq-100 Index", "https://ir.nasdaq.com/news-releases/news-release-details/space-exploration-technologies-corporation-join-nasdaq-100", "Nasdaq index announcement", "2026-07-07", "ENTERS_INDEX", "SpaceX", "Nasdaq-100", "Nasdaq announced that SpaceX (SPCX) would become a Nasdaq-100 component before market open on July 7, 2026. Nasdaq states that more than 200 investment products with over $800 billion in assets track the index.", None, None),
    ("OpenAI cuts GPT-5.6 Luna and Terra API prices", "https://openai.com/index/advancing-the-price-performance-frontier-with-gpt-5-6/", "OpenAI pricing announcement", "2026-07-30", "PRICE_CUT", "OpenAI", None, "OpenAI announced that GPT-5.6 Luna would cost 80 percent less and GPT-5.6 Terra would cost 20 percent less starting July 30, 2026.", None, None),
)
SCORE, CONFIDENCE, EXTRACTOR = 20, 0.99, "curated-primary-source-v1"
REASONING = "Verified against the cited primary filing or prospectus."


def curated(spark: SparkSession, facts=FACTS) -> DataFrame:
    """Facts with their item id, category, companies and event id. A missing value prints as None in the event id."""
    d = spark.createDataFrame(list(facts), "title string, url string, source string, published_at string, event_type string, source_entity string, target_entity string, evidence_text string, amount double, currency string")
    kind = F.col("event_type")
    category = F.when(kind.isin("COMPLETES_IPO", "ENTERS_INDEX"), "ipo").when(kind == "PRICE_CUT", "cannibalization").when(kind.isin("ASSUMES_DEBT", "ISSUES_DEBT", "REFINANCES"), "credit").otherwise("general")
    # whole amounts of the fixed table print without a fraction
    amount = F.coalesce(F.col("amount").cast("decimal(20,0)").cast("string"), F.lit("None"))
    key = F.concat_ws("|", F.lit("verified"), kind, "source_entity", F.coalesce("target_entity", F.lit("None")), "published_at", amount)
    return d.withColumns({"id": stable_id(F.col("url"), F.col("title")), "category": category, "companies": F.filter(F.array("source_entity", "target_entity"), lambda c: c.isNotNull()), "event_id": F.sha2(key, 256)})
