"""Text functions as column expressions. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.plans import presets

UNITS = {"million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}
MONEY = r"(?i)(?:[$€£])?\s*\d+(?:\.\d+)?\s*(?:billion|million|trillion|bn|mn|b|m|t)?"
HIDDEN = ("script", "style", "nav", "footer", "noscript")
RAW = ("script", "style")  # what lies in them is no markup
CONTAINERS = ("html", "body", "main", "header", "section", "article", "aside", "div", "table", "ul", "ol", "form")
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "copy": "©", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "apos": "'", "#39": "'", "#x27": "'", "amp": "&"}


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lookup(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def stable_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.coalesce(title, F.lit(""))), 256)


def canonicalize(name: Column, aliases: Mapping[str, str] = presets.ALIASES) -> Column:
    """The canonical name; null for null and empty, the cleaned name where no alias fits."""
    clean = collapse(name)
    known = F.try_element_at(lookup(aliases), clean) if aliases else F.lit(None).cast("string")
    return F.when(name.isNull() | (name == ""), F.lit(None)).otherwise(F.coalesce(known, clean))


def canonicalize_many(names: Column, aliases: Mapping[str, str] = presets.ALIASES) -> Column:
    """Canonical names, each once, in order; nulls and empties go."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: canonicalize(n, aliases)), lambda n: n.isNotNull() & (n != "")))


def any_of(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def matched_companies(lower: Column, companies: Sequence[str], aliases: Mapping[str, str] = presets.ALIASES) -> Column:
    """Canonical names of the companies that the lower-cased text contains, in order of their raw names."""
    names = F.array(*[F.lit(c) for c in sorted(companies)]) if companies else F.array().cast("array<string>")
    return canonicalize_many(F.filter(names, lambda n: F.contains(lower, F.lower(n))), aliases)


def term_score(lower: Column, weights: Mapping[str, int] = presets.TERM_WEIGHTS, stress: Sequence[str] = presets.STRESS_TERMS, bonus: int = presets.STRESS_BONUS) -> Column:
    """Each weighted term that occurs counts once; any stress term adds the bonus once."""
    out = F.lit(0)
    for term, w in weights.items():
        out = out + F.when(F.contains(lower, F.lit(term.lower())), w).otherwise(0)
    return (out + F.when(any_of(lower, stress), bonus).otherwise(0)).cast("long")


def classify(lower: Column, rules=presets.CATEGORY_RULES, other: str = presets.OTHER_CATEGORY) -> Column:
    out = None
    for name, terms in rules:
        out = F.when(any_of(lower, terms), name) if out is None else out.when(any_of(lower, terms), name)
    return F.lit(other) if out is None else out.otherwise(other)


def sentences(text: Column) -> Column:
    """Parts after a full stop, question or exclamation mark and white space; trimmed, none empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def find_entities(text: Column, names: Sequence[str], brand: str = presets.FEED_BRAND) -> Column:
    """Known names in the text by first position, equal positions by name; the feed's brand doesn't count as a name."""
    if not names:
        return F.array().cast("array<string>")
    lower = F.replace(F.lower(text), F.lit(brand), F.lit("")) if brand else F.lower(text)
    known = F.array(*[F.lit(n) for n in sorted(set(names))])
    placed = F.transform(known, lambda n: F.struct(F.position(F.lower(n), lower).alias("at"), n.alias("name")))
    return F.transform(F.array_sort(F.filter(placed, lambda p: p["at"] > 0)), lambda p: p["name"])


def extract_amount(text: Column) -> Column:
    """struct(value, currency) of the first number with a currency sign or a unit; nulls if there is none.

    The unit needs no word boundary and thousands separators end a number.
    """
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(0)), lambda m: m.rlike(r"(?i)[$€£]|[a-z]"))
    first = F.get(found, F.lit(0))
    number = F.regexp_extract(first, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.try_element_at(lookup(UNITS), F.lower(F.regexp_extract(first, r"(?i)([a-z]+)\s*$", 1)))
    sign = F.regexp_extract(first, r"^([$€£])", 1)
    return F.struct((number * F.coalesce(unit, F.lit(1.0))).alias("value"), F.try_element_at(lookup(CURRENCIES), sign).alias("currency"))


def unescape(text: Column) -> Column:
    """Common HTML entities; the ampersand last."""
    for name, c in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return text


def strip_tags(html: Column) -> Column:
    """Text of markup: comments and tags become spaces, entities their characters, white space collapses."""
    return collapse(unescape(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")))


def shown(html: Column, hidden: Sequence[str], containers: Sequence[str] = CONTAINERS) -> Column:
    """Markup without what lies in hidden elements, by one fold over the tags of these and of containers.

    The fold keeps the names that are open, a letter each. A closing tag closes all up to the last open one of its name, and
    does nothing if none is open. So a hidden element lasts until its own closing tag or, where that is missing, to the end of
    the container around it, else to the end of the page; those in each other are counted. ``<nav/>`` hides nothing.
    """
    code = {n: chr(ord("A") + i) for i, n in enumerate(hidden)} | {n: chr(ord("a") + i) for i, n in enumerate(containers)}
    names = "|".join(code)
    pieces = F.split(html, rf"(?i)(?=</?(?:{names})(?![^\s/>]))")
    part = lambda p, i: F.regexp_extract(p, rf"(?i)^<(/?)({names})(?![^\s/>])(?![^>]*/>)", i)
    tags = F.transform(pieces, lambda p: F.struct(part(p, 1).alias("end"), F.coalesce(F.try_element_at(lookup(code), F.lower(part(p, 2))), F.lit("")).alias("c")))

    def step(acc: Column, tag: Column) -> Column:
        popped = F.left(acc["open"], F.length(acc["open"]) - F.length(F.call_function("substring_index", acc["open"], tag["c"], F.lit(-1))) - 1)
        closed = F.when(F.contains(acc["open"], tag["c"]), popped).otherwise(acc["open"])
        now = F.when(tag["c"] == "", acc["open"]).when(tag["end"] == "", F.concat(acc["open"], tag["c"])).otherwise(closed)
        starts = (tag["end"] == "") & tag["c"].between("A", "Z")
        # where the outermost hidden element stands among the open ones; 0 outside of any
        top = F.when(acc["top"] > 0, F.when(F.length(now) < acc["top"], 0).otherwise(acc["top"])).when(starts, F.length(now)).otherwise(0)
        return F.struct(now.alias("open"), top.alias("top"), F.concat(acc["flags"], F.when(top > 0, "0").otherwise("1")).alias("flags"))

    flags = F.aggregate(tags, F.struct(F.lit("").alias("open"), F.lit(0).alias("top"), F.lit("").alias("flags")), step, lambda acc: acc["flags"])
    return F.array_join(F.zip_with(pieces, F.split(flags, ""), lambda p, f: F.when(f == "1", p).otherwise(" ")), "")


def html_to_text(html: Column, hidden: Sequence[str] = HIDDEN, max_chars: int = 400_000) -> Column:
    """Visible text of a page: hidden elements go whole (``shown``), tags and comments become spaces.

    Broken markup has a defined reading: a comment, script or style that is never closed lasts to the end of the page, as does a
    tag without its ``>``; tags in a comment or script are no tags; ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text. Each
    step goes over the page once. Null and empty pages give an empty text.
    """
    raw = "|".join(n for n in hidden if n in RAW)
    comments = r"<!--.*?(?:-->|\z)" + (rf"|<({raw})(?![^\s/>])[^>]*(?<!/)(?:>|\z).*?(?:</\1(?![^\s/>])[^>]*>|\z)" if raw else "")
    out = F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is){comments}", " ")
    rest = [n for n in hidden if n not in RAW]
    out = shown(out, rest) if rest else out
    return F.substring(collapse(unescape(F.regexp_replace(out, r"(?s)<[a-zA-Z/!?][^>]*(?:>|\z)", " "))), 1, max_chars)


def document_text(body: Column, content_type: Column, max_chars: int = 400_000) -> Column:
    """struct(text, status) by content type: html or none is stripped, text and json are collapsed, others are unsupported; a null body is an error."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    page, plain = (kind == "") | F.contains(kind, F.lit("html")), F.contains(kind, F.lit("text")) | F.contains(kind, F.lit("json"))
    text = F.when(body.isNull(), "").when(page, html_to_text(body, max_chars=max_chars)).when(plain, F.substring(collapse(body), 1, max_chars)).otherwise("")
    return F.struct(text.alias("text"), F.when(body.isNull(), "error").when(page | plain, "ok").otherwise("unsupported").alias("status"))


def preflight_reason(evidence: Column, amount: Column, event_type: Column, max_usd: float = 5e12, placeholders=presets.PLACEHOLDERS, markers=presets.HYPOTHETICAL, transactions=presets.TRANSACTIONS, reasons=presets.REASONS) -> Column:
    """Why evidence is to be set aside before any review; null if it may pass."""
    text = F.lower(collapse(F.coalesce(evidence, F.lit(""))))
    placeholder = F.lit(False)
    for p in placeholders:
        placeholder = placeholder | F.startswith(text, F.lit(p))
    return F.when(text == "", reasons[0]).when(placeholder, reasons[1]).when(F.abs(amount) > max_usd, reasons[2]).when(event_type.isin(*transactions) & any_of(text, markers), reasons[3])


def context_window(source_text: Column, evidence: Column, around: int = 1_250) -> Column:
    """The source text near the evidence, else its head; null without source text."""
    text, quote = collapse(F.coalesce(source_text, F.lit(""))), collapse(F.coalesce(evidence, F.lit("")))
    at = F.when(quote == "", 0).otherwise(F.position(F.lower(quote), F.lower(text)))
    start = F.greatest(F.lit(1), at - around)
    near = F.substring(text, start, F.least(F.length(text), at - 1 + F.length(quote) + around) - start + 1)
    return F.when(text == "", F.lit(None).cast("string")).when(at > 0, near).otherwise(F.substring(text, 1, 2 * around))


def redact_keys(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"sk-[A-Za-z0-9_-]+", "[redacted]"), 1, 500)


def rounded_text(x: Column, to: int = -6) -> Column:
    """A double rounded half to even, as text with one decimal."""
    return F.bround(x, to).cast("decimal(38,1)").cast("string")
