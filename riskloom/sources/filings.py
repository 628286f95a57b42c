"""Company filings: JSON of parallel arrays to items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans import presets

_FOUR = "form: array<string>, accessionNumber: array<string>, filingDate: array<string>, primaryDocument: array<string>"
JSON = f"filings struct<recent: struct<{_FOUR}>, files: array<struct<name: string, filingFrom: string, filingTo: string>>>, {_FOUR.replace(': ', ' ')}"


def padded(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def records(raw: DataFrame) -> DataFrame:
    """(name, cik, file_pos, pos, form, accession, filing_date, document) of JSON text: the nested arrays, else those on top; cut to the shortest.

    ``raw`` has name, cik, json and, if there are archives, file_pos.
    """
    d = raw if "file_pos" in raw.columns else raw.withColumn("file_pos", F.lit(0))
    d = d.withColumn("j", F.from_json("json", JSON))
    pick = {c: F.coalesce(F.col(f"j.filings.recent.{c}"), F.when(F.col("j.filings.recent").isNull(), F.col(f"j.{c}")), F.array().cast("array<string>")) for c in ("form", "accessionNumber", "filingDate", "primaryDocument")}
    d = d.withColumns({f"_{k}": v for k, v in pick.items()})
    n = F.least(*[F.size(f"_{k}") for k in pick])
    zipped = F.slice(F.arrays_zip(*[f"_{k}" for k in pick]), F.lit(1), n)
    return d.select("name", "cik", "file_pos", F.posexplode(zipped).alias("pos", "r")).select("name", "cik", "file_pos", "pos", F.col("r._form").alias("form"), F.col("r._accessionNumber").alias("accession"), F.col("r._filingDate").alias("filing_date"), F.col("r._primaryDocument").alias("document"))


def archives(raw: DataFrame, since: str | None = None) -> DataFrame:
    """(name, cik, file, filing_to) of the archive files that reach past ``since``; the others needn't be read."""
    d = raw.select("name", "cik", F.posexplode(F.from_json("json", JSON)["filings"]["files"]).alias("file_pos", "f")).select("name", "cik", "file_pos", F.col("f.name").alias("file"), F.coalesce("f.filingTo", F.lit("")).alias("filing_to"))
    return d if since is None else d.filter(F.col("filing_to") >= since)


def recent_filings(rows: DataFrame, since: str | None = None, limit: int = 3, forms: Sequence[str] = presets.FORMS) -> DataFrame:
    """The first filings of each company in the order of its list."""
    d = rows.filter(F.col("form").isin(*forms))
    d = d if since is None else d.filter(F.col("filing_date") >= since)
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("cik").orderBy("file_pos", "pos"))).filter(F.col("_n") <= limit).drop("_n")


def historical_filings(rows: DataFrame, since: str = "", limit: int = 24, forms: Sequence[str] = presets.FORMS, core: Sequence[str] = presets.CORE_FORMS) -> DataFrame:
    """Core forms first, then others, each newest first; a repeated accession takes its last values and its first place."""
    d = rows.filter(F.col("form").isin(*forms) & (F.col("filing_date") >= since)).withColumn("at", F.struct("file_pos", "pos"))
    rest = ("name", "form", "filing_date", "document")
    d = d.groupBy("cik", "accession").agg(F.max_by(F.struct(*rest), "at").alias("r"), F.min("at").alias("first")).select("cik", "accession", "r.*", "first")
    order = Window.partitionBy("cik").orderBy(F.col("form").isin(*core).desc(), F.desc("filing_date"), "first")
    return d.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def filing_items(filings: DataFrame, seq: Column | None = None) -> DataFrame:
    """Items of filings, with ``seq``, their order, if it is given."""
    text = lambda *parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    d = filings.withColumns({"_cik": F.col("cik").cast("string"), "_folder": F.replace("accession", F.lit("-"), F.lit(""))})
    return d.select(
        text("$name", " SEC filing: ", "$form", " (", "$filing_date", ")").alias("title"),
        text("https://www.sec.gov/Archives/edgar/data/", "$_cik", "/", "$_folder", "/", "$document").alias("url"),
        # fixed value: the preflight knows this text
        text("SEC filing ", "$form", " for ", "$name", ". Review for debt, guarantees, capital expenditure, customer concentration, refinancing, AI infrastructure commitments, or IPO information.").alias("summary"),
        F.col("filing_date").alias("published_at"),
        F.lit("SEC EDGAR").alias("source"),
        *([] if seq is None else [seq.alias("seq")]),
    )
