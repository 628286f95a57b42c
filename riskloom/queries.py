"""The engine's operators applied to the test tables, with rule tables that fit their vocabulary, and their DuckDB counterparts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import dictionary as D
from riskloom.functions import text as T
from riskloom.operators import events as E
from riskloom.operators import graph as G
from riskloom.operators import indicators as I
from riskloom.operators import reads as R
from riskloom.operators import review as V
from riskloom.operators import sessions as X
from riskloom.operators import state as S
from riskloom.plans.presets import Indicators
from riskloom.sources import feeds, filings
from riskloom.streaming import mentions as L

AS_OF, DAYS = datetime(2024, 2, 1), 3
HISTORY, HISTORY_DAYS = datetime(2024, 1, 1), 60
EVIDENCE = ("variable", "entity", "value", "unit", "role", "effect", "confidence", "date", "event_type", "title", "source", "url", "evidence")
P = Indicators(max_usd=450.0, usd_scale=100.0)
REGISTRY = (
    ("purchase", "Purchases", "capital", "USD", "higher_is_riskier", 1.3, 5, "aggregate"),
    ("signup", "Signups", "monetization", "USD", "higher_is_safer", 1.5, 5, "aggregate"),
    ("error", "Errors", "stress", "score", "higher_is_riskier", 1.7, 5, "aggregate"),
    ("view", "Views", "transmission", "percent", "higher_is_riskier", 1.2, 1_000_000, "aggregate"),
    ("click", "Clicks", "circularity", "USD", "higher_is_riskier", 1.4, 5, "aggregate"),
    ("refund", "Refunds", "fragility", "USD", "higher_is_riskier", 1.0, 5, "aggregate"),
)
WEIGHTS = {"license": 4, "apache": 5, "token": 3, "all rights": 6, "mit ": 2, "with ": 1, "@": 2}
STRESS = ("apache", "all rights")
CATEGORIES = (("legal", ("license", "all rights")), ("code", ("token", "@")), ("prose", ("that", "this")))
NAMES = ("This", "That", "From", "With", "Das", "Los", "Les")
ALIASES = {"That": "This", "Los": "Les"}
RULES = (("SAYS_THAT", ("that",), 0.8, "that"), ("SAYS_FROM", ("from ", "von "), 0.7, None), ("SAYS_WITH", ("with", "los "), 0.6, "with"))
MAPPING = (("purchase", "purchase", 1.0, "risk"), ("signup", "signup", 1.0, "safety"), ("error", "error", 2.0, "risk"), ("view", "view", 1.0, "risk"))


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- roles of the test tables -------------------------------------------------------------------------------------------


def observations(spark: SparkSession, d: str, polarity: str = "CASE WHEN event_type = 'signup' THEN 'safety' ELSE 'risk' END") -> DataFrame:
    unit = "CASE WHEN event_id % 7 = 0 THEN 'signal' WHEN event_type = 'error' THEN 'score' WHEN event_type = 'view' THEN 'percent' ELSE 'USD' END"
    value = "CASE event_type WHEN 'error' THEN value / 100 WHEN 'view' THEN value / 5 ELSE value END"
    return load(spark, d, "events").selectExpr("event_id", "event_type AS variable_key", "CAST(user_id AS STRING) AS entity", f"{value} AS value", f"{unit} AS unit", "CAST(ts AS TIMESTAMP) AS observed_at", "(event_id % 10 + 1) / 10.0D AS confidence", f"{polarity} AS polarity", "event_id AS seq")


OBS_SQL = """o AS (SELECT event_id, event_type AS variable_key, CAST(user_id AS VARCHAR) AS entity, CASE event_type WHEN 'error' THEN value / 100 WHEN 'view' THEN value / 5 ELSE value END AS value,
  CASE WHEN event_id % 7 = 0 THEN 'signal' WHEN event_type = 'error' THEN 'score' WHEN event_type = 'view' THEN 'percent' ELSE 'USD' END AS unit, ts AS observed_at, (event_id % 10 + 1) / 10.0::DOUBLE AS confidence, {polarity} AS polarity FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variable_key, entity ORDER BY observed_at DESC, event_id) AS rk FROM o WHERE observed_at BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-02-01') x WHERE rk = 1)"""
BY_TYPE = "CASE WHEN event_type = 'signup' THEN 'safety' ELSE 'risk' END"
BY_USER = "CASE WHEN user_id % 3 = 0 THEN 'safety' ELSE 'risk' END"
REG_SQL = "r(variable_key, dimension, vunit, safer, weight, needed) AS (VALUES ('purchase','capital','USD',false,1.3::DOUBLE,5),('signup','monetization','USD',true,1.5,5),('error','stress','score',false,1.7,5),('view','transmission','percent',false,1.2,1000000),('click','circularity','USD',false,1.4,5),('refund','fragility','USD',false,1.0,5))"
POINT_SQL = """p AS (SELECT l.*, r.dimension, r.needed, r.weight, CASE WHEN r.vunit = 'USD' THEN CASE WHEN l.unit = 'USD' AND value > 0 AND value <= 450 THEN 100.0 * (1.0 - 1.0 / (1.0 + value / 100.0)) END
  WHEN r.vunit = 'percent' THEN CASE WHEN l.unit = 'percent' THEN least(100.0, greatest(0.0, value)) END ELSE CASE WHEN l.unit IN ('score', 'signal') THEN least(100.0, greatest(0.0, CASE WHEN value <= 5 THEN value * 20.0 ELSE value END)) END END AS n, r.safer FROM l JOIN r USING (variable_key)),
q AS (SELECT *, (CASE WHEN safer THEN 100.0 - n ELSE n END) * confidence * weight AS point, CASE WHEN confidence > 0 THEN CASE WHEN polarity = 'safety' THEN -confidence ELSE confidence END END AS signed FROM p),
a AS (SELECT dimension, count(point) AS np, min(needed) FILTER (point IS NOT NULL) AS needed, avg(point) AS mp, count(signed) AS ns, sum(signed) AS ss, sum(abs(signed)) AS sa FROM q GROUP BY dimension),
t AS (SELECT d.dimension, coalesce(np, 0) AS np, coalesce(needed, 5) AS needed, mp, coalesce(ns, 0) AS ns, ss, sa FROM (SELECT DISTINCT dimension FROM r) d LEFT JOIN a USING (dimension)),
s AS (SELECT *, CASE WHEN np > 0 AND np >= needed THEN least(100.0, mp) WHEN ns >= 1 THEN round_even(50.0 + 25.0 * (ss / sa) * (ns / (ns + 5.0)), 1) END AS score FROM t)"""


def indicator_sql(select: str, polarity: str = BY_TYPE) -> str:
    return f"WITH {OBS_SQL.format(polarity=polarity)}, {REG_SQL}, {POINT_SQL} {select}"


def dimensions(spark: SparkSession, d: str, polarity: str = BY_TYPE) -> DataFrame:
    return I.dimension_table(observations(spark, d, polarity), I.registry(spark, REGISTRY), AS_OF, DAYS, P)


def items(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "doc_id", "text", "source", "CONCAT('http://doc/', doc_id) AS url", "text AS title", "text AS summary", "CONCAT('2024-01-', LPAD(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) AS published_at", "TIMESTAMP'2024-02-01' + MAKE_DT_INTERVAL(0, 0, 0, doc_id % 1000) AS discovered_at")
    lower = F.lower(F.col("text"))
    return docs.withColumns({"companies": T.matched_companies(lower, NAMES, ALIASES)}).withColumns({"score": T.term_score(lower, WEIGHTS, STRESS) + F.size("companies"), "category": T.classify(lower, CATEGORIES, "other")})


def _has(terms, text="lower(text)"):
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_COMPANIES = "list_distinct(list_transform(list_filter(['Das','From','Les','Los','That','This','With'], lambda n: contains(lower(text), lower(n))), lambda n: CASE n WHEN 'That' THEN 'This' WHEN 'Los' THEN 'Les' ELSE n END))"
_SCORE = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END" for t, w in WEIGHTS.items()) + f" + CASE WHEN {_has(STRESS)} THEN 4 ELSE 0 END"
_CATEGORY = "CASE " + " ".join(f"WHEN {_has(ts)} THEN '{n}'" for n, ts in CATEGORIES) + " ELSE 'other' END"
ITEM_SQL = f"""i AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, source, 'http://doc/' || doc_id AS url, text AS title, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS published_at, doc_id % 1000 AS disc,
  {_COMPANIES} AS companies, {_SCORE} + len({_COMPANIES}) AS score, {_CATEGORY} AS category FROM documents)"""


def fin_events(spark: SparkSession, d: str) -> DataFrame:
    """Mentions: events between a user and another, about a document."""
    n = load(spark, d, "documents").count()
    target = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CONCAT('u', user_id % 7) END"
    return load(spark, d, "events").selectExpr("CAST(event_id AS STRING) AS event_id", "event_id AS seq", f"CAST(event_id % {2 * n} AS STRING) AS document_id", "event_type", "CONCAT('u', user_id % 40) AS source_entity", f"{target} AS target_entity", "value AS amount", "CASE WHEN event_id % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency", "DATE_FORMAT(ts, 'yyyy-MM-dd') AS effective_date", "(event_id % 10 + 1) / 10.0D AS confidence", "CAST(ts AS TIMESTAMP) AS processed_at", "CONCAT('event ', event_id, ' could adversely') AS evidence_text", "'x' AS extractor").withColumn("fingerprint", E.fingerprint(*(F.col(c) for c in ("event_type", "source_entity", "target_entity", "amount", "effective_date")), to=-2))


FIN_SQL = """e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, CAST(event_id % (SELECT 2 * count(*) FROM documents) AS VARCHAR) AS document_id, event_type, 'u' || (user_id % 40) AS source_entity, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'u' || (user_id % 7) END AS target_entity,
  value AS amount, CASE WHEN event_id % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency, strftime(ts, '%Y-%m-%d') AS effective_date, (event_id % 10 + 1) / 10.0::DOUBLE AS confidence, ts AS processed_at, 'event ' || event_id || ' could adversely' AS evidence_text,
  sha256(concat_ws('|', event_type, 'u' || (user_id % 40), CASE WHEN event_id % 11 = 0 THEN '' ELSE 'u' || (user_id % 7) END, CAST(CAST(round_even(value, -2) AS DECIMAL(38,1)) AS VARCHAR), strftime(ts, '%Y-%m'))) AS fingerprint FROM events)"""
STATUS = "CASE WHEN mention_count % 4 = 0 THEN 'merged' WHEN CAST(canonical_event_id AS BIGINT) % 3 = 0 THEN 'confirmed' WHEN CAST(canonical_event_id AS BIGINT) % 3 = 1 THEN 'flagged' ELSE 'provisional' END"


def facts(spark: SparkSession, d: str) -> DataFrame:
    m = fin_events(spark, d).select("fingerprint", "event_id", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "seq")
    return S.summarize_mentions(m).withColumns({"review_status": F.expr(STATUS), "reviewed_at": F.lit(None).cast("string"), "reviewer_model": F.lit(None).cast("string"), "merged_into": F.lit(None).cast("string")})


FACT_SQL = f"""{FIN_SQL}, f0 AS (SELECT fingerprint, arg_min(event_id, seq) AS canonical_event_id, strftime(arg_min(processed_at, seq), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(arg_max(processed_at, seq), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS mention_count FROM e GROUP BY fingerprint),
f AS (SELECT *, {STATUS} AS review_status FROM f0)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return fin_events(spark, d).selectExpr("seq AS review_id", "CASE WHEN seq % 3 = 0 THEN fingerprint ELSE CONCAT('of another ', seq) END AS fingerprint", "CONCAT('reason ', seq) AS reasoning")


LEDGER_SQL = "v AS (SELECT fingerprint, count(*) AS n, arg_max('reason ' || seq, seq) AS reasoning FROM (SELECT CASE WHEN seq % 3 = 0 THEN fingerprint ELSE 'of another ' || seq END AS fingerprint, seq FROM e) x GROUP BY fingerprint)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").selectExpr("CAST(CASE WHEN doc_id % 4 = 0 THEN -1 - doc_id ELSE doc_id END AS STRING) AS item_id", "text")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Two decisions of some customers: about their own fact and a neighbour's."""
    return load(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS fingerprint", "CASE o_orderstatus WHEN 'F' THEN 'confirm' WHEN 'O' THEN 'merge' ELSE 'flag' END AS decision", "CAST(o_custkey + 1 AS STRING) AS canonical_fingerprint", "0.9D AS confidence", "o_orderpriority AS reasoning", "o_orderkey AS seq")


def customer_facts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").selectExpr("CAST(CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS STRING) AS fingerprint", "CONCAT('e', c_custkey) AS canonical_event_id", "'2024' AS first_seen", "'2024' AS last_seen", "CAST(c_custkey % 9 + 1 AS BIGINT) AS mention_count", "'provisional' AS review_status", "CAST(NULL AS STRING) AS reviewed_at", "CAST(NULL AS STRING) AS reviewer_model", "CAST(NULL AS STRING) AS merged_into")


DECIDE_SQL = """cf AS (SELECT CAST(CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS VARCHAR) AS fingerprint, c_custkey % 9 + 1 AS mention_count, c_custkey FROM customer),
dl AS (SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS fingerprint, CASE o_orderstatus WHEN 'F' THEN 'confirm' WHEN 'O' THEN 'merge' ELSE 'flag' END AS decision, CAST(o_custkey + 1 AS VARCHAR) AS target, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rk, o_orderkey FROM orders) x WHERE rk = 1 AND fingerprint IN (SELECT fingerprint FROM cf)),
dv AS (SELECT * FROM dl WHERE decision <> 'merge' OR target IN (SELECT fingerprint FROM dl WHERE decision = 'confirm'))"""


def net_events(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    li, o = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber"), load(spark, d, "orders").select("o_orderkey", "o_custkey")
    s, c = load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), load(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(n.toDF("sk", "source_entity"), F.col("s_nationkey") == F.col("sk")).join(n.toDF("ck", "target_entity"), F.col("c_nationkey") == F.col("ck"))
    return j.select("source_entity", "target_entity", F.col("l_returnflag").alias("event_type"), F.col("l_linenumber").cast("long").alias("mention_count"))


NET_SQL = "ne AS (SELECT a.n_name AS s, b.n_name AS t, l_returnflag AS ty, l_linenumber AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)"


def fact_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return facts(spark, d), fin_events(spark, d).drop("fingerprint"), items(spark, d).drop("text")


EV_ITEM = "f JOIN e ON f.canonical_event_id = e.event_id JOIN i ON e.document_id = i.id"
def space_sql(text: str) -> str:
    """SQL of collapse."""
    return rf"trim(regexp_replace({text}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def strip_sql(text: str) -> str:
    """SQL of strip_tags."""
    text = rf"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, c in T.ENTITIES.items():
        text = "replace({}, '&{};', '{}')".format(text, name, c.replace("'", "''"))
    return space_sql(text)


def broken(pages: DataFrame) -> DataFrame:
    """Each page with broken markup: no nav is closed, stray ends and an open script after the page, or no footer is closed."""
    kind, html = F.pmod("page_id", F.lit(3)), F.col("html")
    stray = F.concat(F.lit("</section></nav>"), html, F.lit("</div></footer><script>var a = '<nav>';<p>never closed"))
    return pages.withColumn("html", F.when(kind == 0, F.replace(html, F.lit("</nav>"), F.lit(""))).when(kind == 1, stray).otherwise(F.replace(html, F.lit("</footer>"), F.lit(""))))


def html_sql(html: str, unclosed: str = "") -> str:
    """SQL of html_to_text for pages whose hidden elements are closed; ``unclosed``: one that lasts until the body ends."""
    text = rf"regexp_replace({html}, '(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script[^>]*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style[^>]*>|\z)', ' ', 'g')"
    for name in ("nav", "footer", "noscript"):
        text = rf"regexp_replace({text}, '(?is)<{name}(?:[\s/][^>]*)?>.*?{'(?:</body>|$)' if name == unclosed else f'</{name}[^>]*>'}', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?s)<[a-zA-Z/!?][^>]*(?:>|\z)', ' ', 'g')"
    for name, c in T.ENTITIES.items():
        text = "replace({}, '&{};', '{}')".format(text, name, c.replace("'", "''"))
    return space_sql(text)


_HTML = html_sql("html")
SENT_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x{0B}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\x{0B}]+|[\s\x{0B}]+$', '', 'g')), lambda x: x <> '')"


def mentions_state(spark: SparkSession, d: str) -> DataFrame:
    m = fin_events(spark, d).select("fingerprint", "event_id", F.date_format("processed_at", "yyyy-MM-dd").alias("seen_at"), "seq")
    empty = facts(spark, d).limit(0)
    first = S.register_mentions(empty, m.filter("seq % 2 = 0"))
    return S.register_mentions(first, m.filter("seq % 2 = 1")).select("fingerprint", "canonical_event_id", "first_seen", "last_seen", "mention_count", "review_status")


def fed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").selectExpr("source AS query", "CAST(SUBSTRING(source, 4) AS INT) AS query_pos", "CAST(doc_id AS INT) AS entry_pos", "CONCAT('<b>', text, '</b>') AS title", "CONCAT('http://x/', doc_id % 150) AS link", "text AS summary", "'2024' AS published", "CASE WHEN doc_id % 2 = 0 THEN lang END AS source_title")


def filed(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.selectExpr("CONCAT('c', o_custkey) AS name", "o_custkey AS cik", "0 AS file_pos", "CAST(o_orderkey AS INT) AS pos", "CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '8-K' WHEN '3-MEDIUM' THEN '10-Q' ELSE 'X' END AS form", "CONCAT('a-', o_orderkey % 5000) AS accession", "DATE_FORMAT(o_orderdate, 'yyyy-MM-dd') AS filing_date", "'d.htm' AS document")


def _q_sentences(s, d):
    x = load(s, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("parts"))


def _q_events(s, d):
    docs = load(s, d, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "'2024-01-05' AS published_at", "text AS full_text", "CAST(NULL AS STRING) AS title", "'' AS summary")
    return E.extract_events(docs, NAMES, RULES, ALIASES).select("event_id", "document_id", "event_type", "source_entity", "target_entity", F.md5("evidence_text").alias("evidence"), "instrument", "confidence")


def _q_observations(s, d):
    m = E.variable_map(s, MAPPING)
    return E.to_observations(fin_events(s, d), m, I.registry(s, REGISTRY)).select("event_id", "variable_key", "entity", F.round("value", 6).alias("value"), "unit", "polarity")


def _q_apply(s, d):
    f = customer_facts(s, d)
    v = V.valid_decisions(decisions(s, d), f)
    return V.apply_decisions(f, v, "m", "now").select("fingerprint", "mention_count", "review_status", "merged_into", "reviewer_model")


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """A table with the place of each row in an order, by its own columns."""
    return R.placed(df, *[F.expr(c.removesuffix(" DESC")).desc() if c.endswith(" DESC") else F.expr(c).asc() for c in order])


def evidence(s: SparkSession, d: str) -> DataFrame:
    ev = fin_events(s, d).withColumns({"title": F.lit(None).cast("string"), "published_at": F.lit(None).cast("string"), "source": F.lit("s"), "url": F.lit("u")})
    o = observations(s, d).withColumns({"event_id": F.col("event_id").cast("string"), "effective_date": F.lit(None).cast("string"), "evidence_text": F.concat(F.lit("ev"), "event_id")})
    return G.evidence_rows(o, ev, I.registry(s, REGISTRY), AS_OF, DAYS)


def _q_evidence(s, d):
    x = G.ranked_evidence(evidence(s, d))
    return x.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("place") == 0, F.col("date"))).alias("newest"), F.count_if(F.col("role") == "directional signal").alias("signals"))


def _q_evidence_lists(s, d):
    x = G.evidence_lists(evidence(s, d).withColumn("value", F.round("value", 6)), 300)
    x = x.select("dimension", F.posexplode("evidence").alias("place", "r"))
    return x.select("dimension", "place", *[F.col(f"r.{c}").alias(c) for c in EVIDENCE])


def _q_ranked(s, d):
    x = G.ranked_evidence(evidence(s, d).withColumn("value", F.round("value", 6)))
    return x.select("dimension", "place", *EVIDENCE)


def history(s, d):
    return I.dimension_history(observations(s, d), I.registry(s, REGISTRY), HISTORY, HISTORY_DAYS, DAYS, P)


def _q_replay(s, d):
    """Customers as facts: of 32 in a row each is merged into the one before, the last first; some are confirmed or flagged before."""
    c = load(s, d, "customer")
    f = c.selectExpr("CAST(c_custkey AS STRING) AS fingerprint", "CAST(c_custkey % 9 + 1 AS BIGINT) AS mention_count", "'provisional' AS review_status", "CAST(NULL AS STRING) AS reviewed_at", "CAST(NULL AS STRING) AS reviewer_model", "CAST(NULL AS STRING) AS merged_into")
    merges = c.filter("c_custkey % 32 <> 0").selectExpr("10000000000 - c_custkey AS review_id", "CAST(c_custkey AS STRING) AS fingerprint", "'merge' AS decision", "CAST(c_custkey - 1 AS STRING) AS canonical_fingerprint", "'m' AS model", "'t2' AS reviewed_at")
    others = load(s, d, "orders").selectExpr("o_orderkey AS review_id", "CAST(o_custkey AS STRING) AS fingerprint", "CASE o_orderstatus WHEN 'F' THEN 'flag' ELSE 'confirm' END AS decision", "CAST(NULL AS STRING) AS canonical_fingerprint", "'m' AS model", "'t1' AS reviewed_at")
    return V.replay(f, others.unionByName(merges)).select("fingerprint", "mention_count", "review_status", "merged_into", "reviewed_at", "root")


def _q_filing_records(s, d):
    o = load(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))).alias("o"))
    four = F.struct(F.transform("o", lambda x: x["o_orderpriority"]).alias("form"), F.transform("o", lambda x: F.concat(F.lit("a-"), x["o_orderkey"])).alias("accessionNumber"), F.transform("o", lambda x: x["day"]).alias("filingDate"), F.transform("o", lambda x: F.lit("d.htm")).alias("primaryDocument"))
    # every second company has its arrays on top; of every third the last document is missing
    short = F.struct("four.form", "four.accessionNumber", "four.filingDate", F.slice("four.primaryDocument", 1, F.size("o") - F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).alias("primaryDocument"))
    o = o.withColumn("four", four).withColumn("four", short)
    text = F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.struct(F.col("four").alias("recent")).alias("filings")))).otherwise(F.to_json("four"))
    raw = o.select(F.lit("c").alias("name"), F.col("o_custkey").cast("long").alias("cik"), text.alias("json"))
    return filings.records(raw).select("cik", F.col("pos").cast("long").alias("pos"), "form", "accession", "filing_date", "document")


def _q_document_text(s, d):
    kind = F.expr("CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN NULL WHEN 2 THEN 'text/plain' WHEN 3 THEN 'Application/JSON' ELSE 'image/png' END")
    x = load(s, d, "pages").select("page_id", T.document_text(F.expr("CASE WHEN page_id % 7 <> 0 THEN html END"), kind).alias("x"))
    return x.select("page_id", "x.status", F.md5("x.text").alias("text_md5"))


def _q_network(s, d):
    nodes, _ = G.network(net_events(s, d), items(s, d).filter("text IS NOT NULL"), {"FRANCE": "GERMANY", **ALIASES}, ("CHINA", "This"), 12)
    return nodes.select("id", "kind", F.col("weight").cast("long").alias("weight"), F.md5("label").alias("label"), F.col("date"))


def _q_runs(s, d):
    log = load(s, d, "events").selectExpr("event_id AS id", "event_type AS collector", "CAST(NULL AS STRING) AS completed_at", "'running' AS status", "0L AS items_seen", "0L AS items_new")
    end = load(s, d, "events").selectExpr("event_id AS id", "event_type AS collector", "'t' AS completed_at", "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('view', 'click') AND event_id % 2 = 0 THEN 'degraded' ELSE 'ok' END AS status", "9L AS items_seen", "event_id % 5 AS items_new")
    out = S.run_summary(S.current_runs(log.unionByName(end)))
    return out.select("new_items", F.size("degraded").cast("long").alias("degraded"), F.size("failed").cast("long").alias("failed"))


def _q_review(s, d):
    f = customer_facts(s, d)
    v = V.valid_decisions(decisions(s, d), f)
    after = V.apply_decisions(f, v, "m", "now")
    noted = V.append_ledger(s.createDataFrame([], "review_id long"), v, "m", "now", 1)
    o = f.select(F.col("canonical_event_id").alias("event_id"))
    left = V.drop_merged_observations(o, f, v)
    counts = R.review_counts(after, noted)
    return counts.join(after.agg(F.count_if(F.col("review_status") == "merged").alias("merged"), F.sum("mention_count").alias("mentions"))).join(noted.agg(F.count(F.lit(1)).alias("reviews"), F.max("review_id").alias("last_review"))).join(left.agg(F.count(F.lit(1)).alias("observations")))


def lag_items(s, d):
    """Events as items: published some hours before they were found."""
    return load(s, d, "events").selectExpr("event_type AS source", "CAST(ts AS TIMESTAMP) AS discovered_at", "DATE_FORMAT(ts - MAKE_DT_INTERVAL(0, 0, 0, CAST(value * 100 AS BIGINT) - 500), 'yyyy-MM-dd HH:mm:ss') AS published_at")


def _q_lags(s, d):
    q = L.lag_quantiles(L.lag_sketch(lag_items(s, d)))
    return q.select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), "items", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


def _q_names(s, d):
    docs = load(s, d, "documents")
    names = docs.filter("length(text) > 40").selectExpr("substring(text, 8, 14) AS name")
    return D.contained(docs.selectExpr("doc_id AS id", "text"), names).select("id", F.md5("name").alias("name"), F.col("at").cast("long").alias("at"))


def _q_sessions(s, d):
    e = fin_events(s, d).withColumn("amount", F.lit(None).cast("double"))
    # as in the SQL, an undated mention is near no other and stays alone, and a source that is missing stays null
    alone = e.filter("processed_at IS NULL").selectExpr("event_type", "source_entity", "COALESCE(target_entity, '') AS target_entity", "CAST(NULL AS DATE) AS first", "CAST(NULL AS DATE) AS last", "1L AS mentions")
    m = X.merge_spans(X.spans(e.filter("processed_at IS NOT NULL")), 2).withColumn("source_entity", F.nullif("source_entity", F.lit("")))
    return m.select(alone.columns).unionAll(alone).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


QUERIES = {
    "lag_quantiles": _q_lags,
    "name_index": _q_names,
    "gap_facts": _q_sessions,
    "latest_observations": lambda s, d: I.latest_observations(observations(s, d), AS_OF, DAYS).select("event_id", "variable_key", "entity", F.round("value", 6).alias("value"), "unit"),
    "dimension_scores": lambda s, d: dimensions(s, d).select("dimension", F.round("score", 6).alias("score")),
    "evidence_counts": lambda s, d: I.evidence_counts(dimensions(s, d)),
    "evidence_basis": lambda s, d: I.evidence_basis(dimensions(s, d)),
    "direction_readings": lambda s, d: I.direction_readings(dimensions(s, d, BY_USER)),
    "overall_direction": lambda s, d: I.overall_direction(I.direction_readings(dimensions(s, d, BY_USER))),
    "convergence": lambda s, d: I.convergence(dimensions(s, d).select("dimension", "score"), P),
    "term_score": lambda s, d: items(s, d).select("doc_id", F.col("score").cast("long").alias("score")),
    "classify": lambda s, d: items(s, d).select("doc_id", "category"),
    "company_match": lambda s, d: items(s, d).select("doc_id", F.array_join("companies", ",").alias("companies")),
    "stable_ids": lambda s, d: items(s, d).select("doc_id", T.stable_id(F.col("url"), F.col("title")).alias("id")),
    "sentence_split": _q_sentences,
    "entity_search": lambda s, d: load(s, d, "documents").select("doc_id", F.array_join(T.find_entities(F.col("text"), NAMES, "is the"), ",").alias("names")),
    "amount_extract": lambda s, d: load(s, d, "orders").select("o_orderkey", T.extract_amount(F.expr("CONCAT(CASE o_orderkey % 4 WHEN 0 THEN 'paid 12 of $' WHEN 1 THEN 'about €' ELSE 'sum ' END, CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' billion' WHEN 1 THEN ' Mn' ELSE '' END)")).alias("x")).select("o_orderkey", F.round("x.value", -3).alias("value"), "x.currency"),
    "event_extract": _q_events,
    "fingerprints": lambda s, d: fin_events(s, d).select("event_id", "fingerprint"),
    "facts": lambda s, d: facts(s, d).select("fingerprint", "canonical_event_id", "first_seen", "last_seen", "mention_count", "review_status"),
    "register_mentions": mentions_state,
    "insert_ignore": lambda s, d: S.insert_ignore(load(s, d, "labels").select("doc_id"), load(s, d, "documents").withColumn("seq", -F.col("doc_id")).withColumn("doc_id", F.col("doc_id") % 700), "doc_id").select("doc_id", "source", "seq"),
    "upsert_last_wins": lambda s, d: S.upsert(load(s, d, "customer").select("c_custkey", F.lit("none").alias("v")), load(s, d, "orders").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 10000000 + o_custkey END").alias("c_custkey"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("seq")), "c_custkey"),
    "event_to_observation": _q_observations,
    "top_items": lambda s, d: R.top_items(items(s, d), 50).select("id", F.col("score").cast("long").alias("score")),
    "recent_events": lambda s, d: R.recent_events(*fact_events(s, d)[1:], 60).select("event_id", "document_id", "title"),
    "canonical_events": lambda s, d: R.canonical_events(*fact_events(s, d), 80).select("fingerprint", "event_id", "first_seen", "mention_count", "url"),
    "canonical_count": lambda s, d: facts(s, d).filter("review_status <> 'merged'").agg(F.count(F.lit(1)).alias("n")),
    "provisional_queue": lambda s, d: R.provisional_events(*fact_events(s, d), documents(s, d), 40).select("fingerprint", "event_id", "first_seen", F.coalesce(F.length("source_text"), F.lit(-1)).cast("long").alias("source_chars")).transform(ordered, "first_seen", "fingerprint").drop("first_seen"),
    "flagged_queue": lambda s, d: R.flagged_events(*fact_events(s, d), documents(s, d), ledger(s, d), 40, 2).select("fingerprint", "event_id", "first_seen", "review_count", "prior_reasoning").transform(ordered, "first_seen", "fingerprint").drop("first_seen"),
    "review_counts": lambda s, d: R.review_counts(facts(s, d), ledger(s, d)),
    "confirmed_observations": lambda s, d: R.confirmed_observations(observations(s, d).withColumns({"event_id": F.col("event_id").cast("string"), "observation_id": F.col("event_id")}), facts(s, d), 100).select("event_id", "variable_key"),
    "latest_runs": lambda s, d: S.latest_runs(load(s, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id") % 20).alias("collector"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("status"))).select("collector", "id", "status"),
    "decision_validation": lambda s, d: V.valid_decisions(decisions(s, d), customer_facts(s, d)).select("fingerprint", "decision", "canonical_fingerprint", "seq"),
    "apply_review": _q_apply,
    "preflight": lambda s, d: fin_events(s, d).select("event_id", T.preflight_reason(F.expr("CASE WHEN seq % 13 = 0 THEN ' ' WHEN seq % 17 = 0 THEN CONCAT('Review  for debt, guarantees, capital expenditure ', evidence_text) ELSE evidence_text END"), F.col("amount"), F.col("event_type"), 480.0, transactions=("purchase", "error"), reasons=("empty", "placeholder", "amount", "hypothetical")).alias("reason")),
    "context_window": lambda s, d: load(s, d, "documents").select("doc_id", F.md5(T.context_window(F.col("text"), F.lit("OF  THE"), 50)).alias("context")),
    "broken_markup": lambda s, d: broken(load(s, d, "pages")).select("page_id", T.html_to_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5")),
    "html_to_text": lambda s, d: load(s, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5")),
    "network_edges": lambda s, d: G.edge_weights(net_events(s, d), {"FRANCE": "GERMANY"}).withColumn("weight", F.col("weight").cast("long")),
    "network_nodes": lambda s, d: G.node_weights(net_events(s, d), None, {"FRANCE": "GERMANY"}, ("CHINA",), 10).select("id", "kind", F.col("weight").cast("long").alias("weight")),
    "evidence_edges": lambda s, d: G.network(fin_events(s, d).withColumn("mention_count", F.lit(1)).withColumn("source_entity", F.expr("CASE WHEN seq % 9 = 0 THEN 'This' ELSE source_entity END")), items(s, d), ALIASES, (), 12)[1].filter("type = 'EVIDENCE'").select("source", "target"),
    "timeline": lambda s, d: G.timeline(fin_events(s, d).withColumns({"published_at": F.lit("2023-12-31"), "review_status": F.lit(""), "mention_count": F.lit(0), "effective_date": F.expr("CASE WHEN seq % 6 = 0 THEN '' WHEN seq % 6 = 1 THEN NULL ELSE effective_date END")}), {}).select("date", "event_type", "source_entity", "mentions", "review_status", "evidence_text").transform(ordered, "date", "CAST(split(evidence_text, ' ')[1] AS BIGINT)"),
    "evidence_lists": _q_evidence_lists,
    "filing_records": _q_filing_records,
    "document_text": _q_document_text,
    "network": _q_network,
    "recent_snapshots": lambda s, d: R.recent_snapshots(load(s, d, "events").selectExpr("CONCAT(DATE_FORMAT(ts, 'yyyy-MM-dd HH:mm'), ' ', event_id) AS captured_at", "ROUND(value, 6) AS score", "event_type AS label")).transform(ordered, "captured_at DESC"),
    "rebuild_observations": lambda s, d: S.rebuild_observations(fin_events(s, d), E.variable_map(s, MAPPING), I.registry(s, REGISTRY)).select("event_id", "variable_key", "entity", F.round("value", 6).alias("value"), "unit", "polarity"),
    "all_events": lambda s, d: R.all_events(fin_events(s, d)).select("event_id", "event_type", "processed_at").transform(ordered, "processed_at", "event_id").drop("processed_at"),
    "ranked_evidence": _q_ranked,
    "score_history": lambda s, d: history(s, d).select("day", "dimension", F.round("score", 6).alias("score"), "basis", "direction"),
    "convergence_history": lambda s, d: I.convergence(history(s, d).select("day", "dimension", "score"), P, by=["day"]).select("day", "score", "label", "known_dimensions", "gate_passed"),
    "ledger_replay": _q_replay,
    "run_summary": _q_runs,
    "review": _q_review,
    "dimension_evidence": _q_evidence,
    "feed_history": lambda s, d: feeds.historical(fed(s, d), 20, 140).select("title", "url", "source"),
    "feed_current": lambda s, d: feeds.current(fed(s, d), 12).select("title", "url", "source"),
    "filings_recent": lambda s, d: filings.recent_filings(filed(s, d), "1994-01-01", 3).select("cik", "form", "accession"),
    "filings_history": lambda s, d: filings.filing_items(filings.historical_filings(filed(s, d), "1994-01-01", 4)).select("title", "url"),
}

_AMOUNT = "CASE o_orderkey % 3 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 ELSE 1.0 END"
ORACLE = {
    "latest_observations": f"WITH {OBS_SQL.format(polarity=BY_TYPE)} SELECT event_id, variable_key, entity, round(value, 6) AS value, unit FROM l",
    "dimension_scores": indicator_sql("SELECT dimension, round(score, 6) AS score FROM s"),
    "evidence_counts": indicator_sql("SELECT dimension, np AS evidence_count FROM s WHERE np > 0"),
    "evidence_basis": indicator_sql("SELECT dimension, CASE WHEN np >= needed THEN 'aggregate' WHEN ns >= 1 THEN 'directional_estimate' ELSE 'aggregate' END AS basis FROM s WHERE np > 0 OR ns > 0"),
    "direction_readings": indicator_sql("SELECT dimension, CASE WHEN ss / ns > 0.2 THEN 'higher_pressure' WHEN ss / ns < -0.2 THEN 'lower_pressure' ELSE 'mixed' END AS direction, ns AS evidence_count FROM s WHERE ns > 0", BY_USER),
    "overall_direction": indicator_sql("SELECT CASE WHEN b > 0 THEN 'higher_pressure' WHEN b < 0 THEN 'lower_pressure' WHEN n > 0 THEN 'mixed' ELSE 'unknown' END AS overall FROM (SELECT sum(CASE WHEN ss / ns > 0.2 THEN ns WHEN ss / ns < -0.2 THEN -ns ELSE 0 END) AS b, count(*) AS n FROM s WHERE ns > 0) x", BY_USER),
    "convergence": indicator_sql("""SELECT CASE WHEN k >= 3 THEN round_even(m, 1) END AS score, CASE WHEN k < 3 THEN 'INSUFFICIENT EVIDENCE' WHEN m < 25 THEN 'DISPERSED' WHEN m < 45 THEN 'FORMING' WHEN m < 65 THEN 'BUILDING PRESSURE' WHEN m < 80 OR pr IS NULL OR ec IS NULL THEN 'FRAGILE' ELSE 'HIGH CONVERGENCE' END AS label, 'unknown' AS direction, k AS known_dimensions, k >= 3 AND pr IS NOT NULL AND ec IS NOT NULL AS gate_passed,
      CASE WHEN k < 3 THEN k || ' of 3 required dimensions measured' WHEN pr IS NOT NULL AND ec IS NOT NULL THEN 'material evidence in ' || pr || ' and ' || ec WHEN pr IS NULL THEN 'no material evidence in fragility/stress/transmission' ELSE 'no material evidence in monetization/capital/circularity' END AS gate_reason
      FROM (SELECT count(score) AS k, avg(score) AS m, arg_min(dimension, CASE dimension WHEN 'fragility' THEN 1 WHEN 'stress' THEN 2 ELSE 3 END) FILTER (dimension IN ('fragility','stress','transmission') AND score >= 55) AS pr, arg_min(dimension, CASE dimension WHEN 'monetization' THEN 1 WHEN 'capital' THEN 2 ELSE 3 END) FILTER (dimension IN ('monetization','capital','circularity') AND score >= 55) AS ec FROM s) x"""),
    "term_score": f"WITH {ITEM_SQL} SELECT doc_id, CAST(score AS BIGINT) AS score FROM i",
    "classify": f"WITH {ITEM_SQL} SELECT doc_id, category FROM i",
    "company_match": "SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'das') THEN 'Das' END, CASE WHEN contains(t, 'from') THEN 'From' END, CASE WHEN contains(t, 'les') OR contains(t, 'los') THEN 'Les' END, CASE WHEN contains(t, 'that') OR contains(t, 'this') THEN 'This' END, CASE WHEN contains(t, 'with') THEN 'With' END) AS companies FROM (SELECT doc_id, lower(text) AS t FROM documents) x",
    "stable_ids": f"WITH {ITEM_SQL} SELECT doc_id, sha256(url || '|' || title) AS id FROM i",
    "sentence_split": f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS parts FROM (SELECT doc_id, {SENT_SQL} AS x FROM documents) y",
    "entity_search": "WITH b AS (SELECT doc_id, replace(lower(text), 'is the', '') AS t FROM documents), n AS (SELECT unnest(['Das','From','Les','Los','That','This','With']) AS n), m AS (SELECT doc_id, n, strpos(t, lower(n)) AS p FROM b, n) SELECT b.doc_id, coalesce((SELECT string_agg(n, ',' ORDER BY p, n) FROM m WHERE m.doc_id = b.doc_id AND p > 0), '') AS names FROM b",
    "amount_extract": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 2 AND o_orderkey % 3 = 2 THEN NULL ELSE round(CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS DOUBLE) * {_AMOUNT}, -3) END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency FROM orders",
    "event_extract": f"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({SENT_SQL}) AS s FROM documents),
      k AS (SELECT id, s, replace(lower(s), 'google news', '') AS l, unnest(list_filter([CASE WHEN contains(lower(s), 'that') THEN {{'ty': 'SAYS_THAT', 'confidence': 0.8::DOUBLE, 'instrument': 'that'}} END,
        CASE WHEN contains(lower(s), 'from ') OR contains(lower(s), 'von ') THEN {{'ty': 'SAYS_FROM', 'confidence': 0.7::DOUBLE, 'instrument': NULL}} END,
        CASE WHEN contains(lower(s), 'with') OR contains(lower(s), 'los ') THEN {{'ty': 'SAYS_WITH', 'confidence': 0.6::DOUBLE, 'instrument': 'with'}} END], lambda r: r IS NOT NULL)) AS r FROM x),
      z AS (SELECT id, s, r, list_transform(list_sort(list_filter(list_transform(['Das','From','Les','Los','That','This','With'], lambda n: {{'p': strpos(l, lower(n)), 'n': n}}), lambda y: y.p > 0)), lambda y: CASE y.n WHEN 'That' THEN 'This' WHEN 'Los' THEN 'Les' ELSE y.n END) AS ns FROM k)
      SELECT sha256(concat_ws('|', id, r.ty, coalesce(ns[1], ''), coalesce(ns[2], ''), s)) AS event_id, id AS document_id, r.ty AS event_type, ns[1] AS source_entity, ns[2] AS target_entity, md5(s) AS evidence, r.instrument AS instrument, r.confidence AS confidence FROM z""",
    "fingerprints": f"WITH {FIN_SQL} SELECT event_id, fingerprint FROM e",
    "facts": f"WITH {FACT_SQL} SELECT fingerprint, canonical_event_id, first_seen, last_seen, mention_count, review_status FROM f",
    "register_mentions": f"WITH {FIN_SQL} SELECT fingerprint, arg_min(event_id, (seq % 2) * 1000000000 + seq) AS canonical_event_id, strftime(arg_min(processed_at, (seq % 2) * 1000000000 + seq), '%Y-%m-%d') AS first_seen, strftime(arg_max(processed_at, (seq % 2) * 1000000000 + seq), '%Y-%m-%d') AS last_seen, count(*) AS mention_count, 'provisional' AS review_status FROM e GROUP BY fingerprint",
    "insert_ignore": "SELECT k AS doc_id, arg_max(source, doc_id) AS source, -max(doc_id) AS seq FROM (SELECT *, doc_id % 700 AS k FROM documents) x WHERE k NOT IN (SELECT doc_id FROM labels) GROUP BY k",
    "upsert_last_wins": "WITH n AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 10000000 + o_custkey END AS o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) SELECT coalesce(o_custkey, c_custkey) AS c_custkey, coalesce(v, 'none') AS v FROM customer FULL JOIN n ON c_custkey = o_custkey",
    "event_to_observation": f"WITH {FIN_SQL} SELECT event_id, event_type AS variable_key, source_entity AS entity, round(CASE WHEN event_type IN ('purchase', 'signup') AND currency = 'USD' THEN amount WHEN event_type = 'error' THEN 2.0 ELSE 1.0 END, 6) AS value, CASE WHEN event_type IN ('purchase', 'signup') AND currency = 'USD' THEN 'USD' WHEN event_type = 'error' THEN 'score' ELSE 'signal' END AS unit, CASE WHEN event_type = 'signup' THEN 'safety' ELSE 'risk' END AS polarity FROM e WHERE event_type IN ('purchase', 'signup', 'error', 'view')",
    "top_items": f"WITH {ITEM_SQL} SELECT id, CAST(score AS BIGINT) AS score FROM i ORDER BY score DESC, disc DESC, id LIMIT 50",
    "recent_events": f"WITH {FIN_SQL}, {ITEM_SQL} SELECT event_id, document_id, title FROM e JOIN i ON document_id = id ORDER BY processed_at DESC, event_id LIMIT 60",
    "canonical_events": f"WITH {FACT_SQL}, {ITEM_SQL} SELECT f.fingerprint, event_id, first_seen, mention_count, url FROM {EV_ITEM} WHERE review_status <> 'merged' ORDER BY first_seen DESC, f.fingerprint LIMIT 80",
    "canonical_count": f"WITH {FACT_SQL} SELECT count(*) AS n FROM f WHERE review_status <> 'merged'",
    "provisional_queue": f"WITH {FACT_SQL}, {ITEM_SQL} SELECT f.fingerprint, event_id, CAST(coalesce(length(dd.text), -1) AS BIGINT) AS source_chars, row_number() OVER (ORDER BY first_seen, f.fingerprint) - 1 AS place FROM {EV_ITEM} LEFT JOIN (SELECT CASE WHEN doc_id % 4 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, text FROM documents) dd ON CAST(dd.doc_id AS VARCHAR) = document_id WHERE review_status = 'provisional' ORDER BY first_seen, f.fingerprint LIMIT 40",
    "flagged_queue": f"WITH {FACT_SQL}, {ITEM_SQL}, {LEDGER_SQL} SELECT f.fingerprint, event_id, coalesce(n, 0) AS review_count, v.reasoning AS prior_reasoning, row_number() OVER (ORDER BY first_seen, f.fingerprint) - 1 AS place FROM {EV_ITEM} LEFT JOIN v ON v.fingerprint = f.fingerprint WHERE review_status = 'flagged' AND coalesce(n, 0) < 2 ORDER BY first_seen, f.fingerprint LIMIT 40",
    "review_counts": f"WITH {FACT_SQL}, {LEDGER_SQL} SELECT count(*) FILTER (review_status = 'provisional') AS provisional, count(*) FILTER (review_status = 'confirmed') AS confirmed, count(*) FILTER (review_status = 'flagged') AS flagged, count(*) FILTER (review_status = 'flagged' AND coalesce(n, 0) < 2) AS retry_pending FROM f LEFT JOIN v USING (fingerprint)",
    "confirmed_observations": f"WITH {FACT_SQL} SELECT event_id, event_type AS variable_key FROM e WHERE event_id IN (SELECT canonical_event_id FROM f WHERE review_status = 'confirmed') ORDER BY processed_at DESC, seq LIMIT 100",
    "latest_runs": "SELECT 'c' || (conv_id % 20) AS collector, max(conv_id * 100 + turn) AS id, arg_max(role, conv_id * 100 + turn) AS status FROM conversations GROUP BY 1",
    "decision_validation": f"WITH {DECIDE_SQL} SELECT fingerprint, decision, target AS canonical_fingerprint, o_orderkey AS seq FROM dv",
    "apply_review": f"WITH {DECIDE_SQL}, g AS (SELECT target, sum(mention_count) AS n FROM dv JOIN cf USING (fingerprint) WHERE decision = 'merge' GROUP BY target) SELECT cf.fingerprint, CAST(cf.mention_count + coalesce(n, 0) AS BIGINT) AS mention_count, CASE decision WHEN 'merge' THEN 'merged' WHEN 'confirm' THEN 'confirmed' WHEN 'flag' THEN 'flagged' ELSE 'provisional' END AS review_status, CASE WHEN decision = 'merge' THEN dv.target END AS merged_into, CASE WHEN decision IS NOT NULL THEN 'm' END AS reviewer_model FROM cf LEFT JOIN dv ON cf.fingerprint = dv.fingerprint LEFT JOIN g ON g.target = cf.fingerprint",
    "preflight": f"WITH {FIN_SQL} SELECT event_id, CASE WHEN seq % 13 = 0 THEN 'empty' WHEN seq % 17 = 0 THEN 'placeholder' WHEN amount > 480 THEN 'amount' WHEN event_type IN ('purchase', 'error') THEN 'hypothetical' END AS reason FROM e",
    "context_window": r"WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{A0}]+', ' ', 'g')) AS t FROM documents), y AS (SELECT *, strpos(lower(t), 'of the') AS p FROM x) SELECT doc_id, md5(CASE WHEN p > 0 THEN substring(t, greatest(1, p - 50), least(length(t), p - 1 + 6 + 50) - greatest(1, p - 50) + 1) ELSE substring(t, 1, 100) END) AS context FROM y",
    "broken_markup": f"SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, substring(CASE page_id % 3 WHEN 0 THEN {html_sql("replace(html, '</nav>', '')", "nav")} WHEN 1 THEN {html_sql("html")} ELSE {html_sql("replace(html, '</footer>', '')", "footer")} END, 1, 400000) AS t FROM pages) x",
    "html_to_text": f"SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, substring({_HTML}, 1, 400000) AS t FROM pages) x",
    "network_edges": f"WITH {NET_SQL}, m AS (SELECT CASE s WHEN 'FRANCE' THEN 'GERMANY' ELSE s END AS s, CASE t WHEN 'FRANCE' THEN 'GERMANY' ELSE t END AS t, ty, m FROM ne) SELECT s AS source, t AS target, ty AS type, count(*) AS weight, CAST(sum(m) AS BIGINT) AS mentions FROM m WHERE s <> t GROUP BY ALL",
    "network_nodes": f"WITH {NET_SQL}, m AS (SELECT unnest([s, t]) AS n FROM ne) SELECT id, CASE id WHEN 'CHINA' THEN 'index' ELSE 'company' END AS kind, count(*) AS weight FROM (SELECT CASE n WHEN 'FRANCE' THEN 'GERMANY' ELSE n END AS id FROM m) x GROUP BY id ORDER BY weight DESC, id LIMIT 10",
    "evidence_edges": f"WITH {FIN_SQL}, {ITEM_SQL}, n AS (SELECT id, sum(w) AS w FROM (SELECT CASE WHEN seq % 9 = 0 THEN 'This' ELSE source_entity END AS id, 1 AS w FROM e UNION ALL SELECT target_entity, 1 FROM e UNION ALL SELECT unnest(companies), 0 FROM i) x WHERE id IS NOT NULL GROUP BY id ORDER BY w DESC, id LIMIT 12) SELECT c AS source, 'evidence:' || id AS target FROM (SELECT id, unnest(companies) AS c FROM i) y WHERE c IN (SELECT id FROM n)",
    "timeline": f"WITH {FIN_SQL}, x AS (SELECT CASE WHEN seq % 6 < 2 THEN '2023-12-31' ELSE effective_date END AS date, * EXCLUDE (effective_date) FROM e) SELECT date, event_type, source_entity, 1 AS mentions, 'provisional' AS review_status, evidence_text, row_number() OVER (ORDER BY date, seq) - 1 AS place FROM x",
    "evidence_lists": indicator_sql("""SELECT * FROM (SELECT dimension, CASE variable_key WHEN 'purchase' THEN 'Purchases' WHEN 'signup' THEN 'Signups' WHEN 'error' THEN 'Errors' WHEN 'view' THEN 'Views' WHEN 'click' THEN 'Clicks' ELSE 'Refunds' END AS variable, entity, round(value, 6) AS value, unit,
      CASE WHEN unit = 'signal' THEN 'directional signal' ELSE 'measured value' END AS role, CASE WHEN polarity = 'risk' THEN 'raises the warning' ELSE 'lowers the warning' END AS effect, confidence, strftime(observed_at, '%Y-%m-%d') AS date, variable_key AS event_type, 'ev' || event_id AS title, 's' AS source, 'u' AS url, 'ev' || event_id AS evidence,
      row_number() OVER (PARTITION BY dimension ORDER BY strftime(observed_at, '%Y-%m-%d') DESC, variable_key DESC, entity DESC) - 1 AS place FROM q) x WHERE place < 300"""),
    "filing_records": "SELECT cik, pos, form, accession, filing_date, document FROM (SELECT o_custkey AS cik, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS form, 'a-' || o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, 'd.htm' AS document FROM orders) x WHERE pos < n - CASE WHEN cik % 3 = 0 THEN 1 ELSE 0 END",
    "document_text": f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'error' WHEN page_id % 5 = 4 THEN 'unsupported' ELSE 'ok' END AS status, md5(CASE WHEN page_id % 7 = 0 OR page_id % 5 = 4 THEN '' WHEN page_id % 5 < 2 THEN substring({_HTML}, 1, 400000) ELSE substring({space_sql('html')}, 1, 400000) END) AS text_md5 FROM pages",
    "network": f"WITH {NET_SQL}, {ITEM_SQL}, m AS (SELECT unnest([s, t]) AS n, 1 AS w FROM ne UNION ALL SELECT unnest(companies), 0 FROM i), g AS (SELECT id, sum(w) AS weight FROM (SELECT CASE n WHEN 'FRANCE' THEN 'GERMANY' ELSE n END AS id, w FROM m) x GROUP BY id ORDER BY weight DESC, id LIMIT 12) SELECT id, CASE WHEN id IN ('CHINA', 'This') THEN 'index' ELSE 'company' END AS kind, CAST(weight AS BIGINT) AS weight, md5(id) AS label, NULL AS date FROM g UNION ALL SELECT 'evidence:' || id, 'evidence', 1, md5(title), published_at FROM i WHERE text IS NOT NULL",
    "recent_snapshots": "SELECT strftime(ts, '%Y-%m-%d %H:%M') || ' ' || event_id AS captured_at, round(value, 6) AS score, event_type AS label, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d %H:%M') || ' ' || event_id DESC) - 1 AS place FROM events ORDER BY captured_at DESC LIMIT 365",
    "all_events": "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS place FROM events",
    "run_summary": "SELECT CAST(sum(event_id % 5) FILTER (event_type <> 'error') AS BIGINT) AS new_items, count(*) FILTER (event_type IN ('view', 'click') AND event_id % 2 = 0) AS degraded, count(*) FILTER (event_type = 'error') AS failed FROM events",
    "dimension_evidence": indicator_sql("SELECT dimension, count(*) AS n, max(strftime(observed_at, '%Y-%m-%d')) AS newest, count(*) FILTER (unit = 'signal') AS signals FROM q GROUP BY dimension"),
    "feed_history": f"WITH e AS (SELECT CAST(substring(source, 4) AS INT) AS q, doc_id, text, lang FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS n FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 150 ORDER BY q, doc_id) AS u FROM f WHERE n <= 7) SELECT {strip_sql('text')} AS title, 'http://x/' || (doc_id % 150) AS url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Google News' END AS source FROM g WHERE u = 1 ORDER BY q, doc_id LIMIT 140",
    "feed_current": f"SELECT {strip_sql('text')} AS title, 'http://x/' || (doc_id % 150) AS url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Google News' END AS source FROM documents ORDER BY CAST(substring(source, 4) AS INT), doc_id LIMIT 12",
    "filings_recent": "SELECT cik, form, accession FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY o_orderkey) AS n FROM (SELECT o_custkey AS cik, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '8-K' WHEN '3-MEDIUM' THEN '10-Q' ELSE 'X' END AS form, 'a-' || (o_orderkey % 5000) AS accession, o_orderdate FROM orders) x WHERE form <> 'X' AND o_orderdate >= TIMESTAMP '1994-01-01') y WHERE n <= 3",
    "filings_history": "WITH x AS (SELECT o_custkey AS cik, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '8-K' WHEN '3-MEDIUM' THEN '10-Q' ELSE 'X' END AS form, o_orderkey % 5000 AS acc, strftime(o_orderdate, '%Y-%m-%d') AS fd FROM orders), y AS (SELECT cik, acc, arg_max(form, k) AS form, arg_max(fd, k) AS fd, min(k) AS k FROM x WHERE form <> 'X' AND fd >= '1994-01-01' GROUP BY cik, acc), z AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY CASE WHEN form = '8-K' THEN 1 ELSE 0 END, fd DESC, k) AS n FROM y) SELECT 'c' || cik || ' SEC filing: ' || form || ' (' || fd || ')' AS title, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/a' || acc || '/d.htm' AS url FROM z WHERE n <= 4",
}
ORACLE["ranked_evidence"] = ORACLE["evidence_lists"].replace(" WHERE place < 300", "")
#: Every day by itself: the latest observations of its window.
_DAILY = OBS_SQL.format(polarity=BY_TYPE).replace("l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variable_key", "l AS (SELECT * FROM (SELECT o.*, day, row_number() OVER (PARTITION BY day, variable_key").replace("FROM o WHERE observed_at BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-02-01')", "FROM o JOIN range(0, 60) r(day) ON observed_at BETWEEN TIMESTAMP '2024-01-01' + to_days(CAST(day - 3 AS INT)) AND TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT)))")
_DAILY_POINTS = POINT_SQL.replace("SELECT dimension, count(point)", "SELECT day, dimension, count(point)").replace("FROM q GROUP BY dimension", "FROM q GROUP BY day, dimension").replace("SELECT d.dimension,", "SELECT d.day, d.dimension,").replace("(SELECT DISTINCT dimension FROM r) d LEFT JOIN a USING (dimension)", "(SELECT DISTINCT dimension, CAST(day AS INT) AS day FROM r, range(0, 60) x(day)) d LEFT JOIN a USING (dimension, day)")
_BASIS = "CASE WHEN np > 0 AND np >= needed THEN 'aggregate' WHEN ns >= 1 THEN 'directional_estimate' WHEN np > 0 THEN 'aggregate' END"
_DIRECTION = "CASE WHEN ns >= 1 THEN CASE WHEN ss / ns > 0.2 THEN 'higher_pressure' WHEN ss / ns < -0.2 THEN 'lower_pressure' ELSE 'mixed' END END"
ORACLE["score_history"] = f"WITH {_DAILY}, {REG_SQL}, {_DAILY_POINTS} SELECT day, dimension, round(score, 6) AS score, {_BASIS} AS basis, {_DIRECTION} AS direction FROM s"
ORACLE["convergence_history"] = f"""WITH {_DAILY}, {REG_SQL}, {_DAILY_POINTS} SELECT day, CASE WHEN k >= 3 THEN round_even(m, 1) END AS score, CASE WHEN k < 3 THEN 'INSUFFICIENT EVIDENCE' WHEN m < 25 THEN 'DISPERSED' WHEN m < 45 THEN 'FORMING' WHEN m < 65 THEN 'BUILDING PRESSURE' WHEN m < 80 OR pr IS NULL OR ec IS NULL THEN 'FRAGILE' ELSE 'HIGH CONVERGENCE' END AS label, k AS known_dimensions, k >= 3 AND pr IS NOT NULL AND ec IS NOT NULL AS gate_passed
  FROM (SELECT day, count(score) AS k, avg(score) AS m, max(dimension) FILTER (dimension IN ('fragility','stress','transmission') AND score >= 55) AS pr, max(dimension) FILTER (dimension IN ('monetization','capital','circularity') AND score >= 55) AS ec FROM s GROUP BY day) x"""
ORACLE["ledger_replay"] = """WITH l AS (SELECT o_custkey AS c, arg_max(CASE o_orderstatus WHEN 'F' THEN 'flagged' ELSE 'confirmed' END, o_orderkey) AS status FROM orders GROUP BY 1),
  m AS (SELECT c_custkey AS c, c_custkey % 32 <> 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) AS merged, c_custkey % 9 + 1 AS n FROM customer)
  SELECT CAST(m.c AS VARCHAR) AS fingerprint, CAST(sum(n) OVER (PARTITION BY m.c // 32 ORDER BY m.c DESC) AS BIGINT) AS mention_count, CASE WHEN merged THEN 'merged' WHEN m.c % 32 <> 0 THEN 'provisional' ELSE coalesce(status, 'provisional') END AS review_status,
    CASE WHEN merged THEN CAST(m.c - 1 AS VARCHAR) END AS merged_into, CASE WHEN merged THEN 't2' WHEN m.c % 32 = 0 AND status IS NOT NULL THEN 't1' END AS reviewed_at, CAST(min(m.c) OVER (PARTITION BY m.c // 32) AS VARCHAR) AS root FROM m LEFT JOIN l ON l.c = m.c"""
_G = 1.01 / 0.99
ORACLE["lag_quantiles"] = f"""WITH x AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', ts - to_microseconds(1000000 * (CAST(trunc(value * 100) AS BIGINT) - 500)))) AS lag FROM events),
  b AS (SELECT source, day, CASE WHEN lag > 0 THEN ceil(ln(lag) / ln({_G!r}) - 1e-9) END AS b, count(*) AS n FROM x GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER (PARTITION BY source, day ORDER BY b NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY source, day) AS total, CASE WHEN b IS NULL THEN 0.0 ELSE 2 * pow({_G!r}, b) / (1 + {_G!r}) END AS v FROM b)
  SELECT source, day, CAST(sum(n) AS BIGINT) AS items, round(min(v) FILTER (upto >= ceil(0.5::DOUBLE * total)), 4) AS p50, round(min(v) FILTER (upto >= ceil(0.95::DOUBLE * total)), 4) AS p95, round(min(v) FILTER (upto >= ceil(0.99::DOUBLE * total)), 4) AS p99 FROM c GROUP BY source, day"""
ORACLE["name_index"] = "WITH n AS (SELECT DISTINCT substring(text, 8, 14) AS name FROM documents WHERE length(text) > 40) SELECT doc_id AS id, md5(name) AS name, strpos(lower(text), lower(name)) AS at FROM documents JOIN n ON contains(lower(text), lower(name)) WHERE name <> ''"
ORACLE["gap_facts"] = f"""WITH {FIN_SQL}, d AS (SELECT event_type, source_entity, coalesce(target_entity, '') AS target_entity, CAST(effective_date AS DATE) AS day FROM e),
  g AS (SELECT *, sum(CASE WHEN day - before <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type, source_entity, target_entity ORDER BY day ROWS UNBOUNDED PRECEDING) AS span FROM (SELECT *, lag(day) OVER (PARTITION BY event_type, source_entity, target_entity ORDER BY day) AS before FROM d) x)
  SELECT event_type, source_entity, target_entity, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, count(*) AS mentions FROM g GROUP BY event_type, source_entity, target_entity, span"""
ORACLE["rebuild_observations"] = ORACLE["event_to_observation"]
ORACLE["review"] = f"""SELECT count(*) FILTER (review_status = 'provisional') AS provisional, count(*) FILTER (review_status = 'confirmed') AS confirmed, count(*) FILTER (review_status = 'flagged') AS flagged, count(*) FILTER (review_status = 'flagged') AS retry_pending,
  count(*) FILTER (review_status = 'merged') AS merged, CAST(sum(mention_count) AS BIGINT) AS mentions, count(reviewer_model) AS reviews, count(reviewer_model) AS last_review, count(*) FILTER (review_status <> 'merged') AS observations FROM ({ORACLE['apply_review']}) x"""
