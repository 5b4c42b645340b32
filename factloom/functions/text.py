"""Text functions on Columns: names, links, boilerplate predicates, chunks, tokens and citations.

Each function takes and returns Columns, so Catalyst sees through it; only inverted_of() runs Python on the executors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: phrases, patterns, units and tags that decide results -------------------------------------------
BOILERPLATE_PHRASES = (
    "javascript is disabled",
    "please enable javascript",
    "enable it to continue",
    "doesn't work properly without javascript",
    "you need to enable javascript",
    "validate user",
    "could not validate captcha",
    "experiencing unusual traffic",
    "cookies are disabled",
    "requires cookies for authentication",
    "making sure you're not a bot",
    "please verify you are a human",
    "site protection: verifying your request",
    "dear visitor",
    "fight cybercrime",
    "connection timed out error code",
    "the page isn't redirecting properly",
)
HTML_LEAK_PREFIXES = ('<iframe title="google tag manager"', "<iframe title='google tag manager'")
MIN_EXTRACTED_LENGTH = 200
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/")
ROUTING_TAGS = ("free", "nitro", "beta", "on-demand", "fp8")
NUMERIC_TOKEN = r"\d+(?:[.,]\d+)?%?(?:\s*(?:kg|kcal|g|mg|ml|l|mmol|µg|ug|ng|lb|in|cm|mm|m|km|h|min|s|ms|kpa|pa)?)"
UNIT_ALIASES = {
    "kg": ("kilogram", "kilograms"),
    "g": ("gram", "grams"),
    "mg": ("milligram", "milligrams"),
    "µg": ("microgram", "micrograms"),
    "ug": ("microgram", "micrograms"),
    "ng": ("nanogram", "nanograms"),
    "ml": ("milliliter", "milliliters", "millilitre", "millilitres"),
    "l": ("liter", "liters", "litre", "litres"),
    "kcal": ("calorie", "calories", "kilocalorie", "kilocalories"),
    "mmol": ("millimole", "millimoles"),
    "cm": ("centimeter", "centimeters", "centimetre", "centimetres"),
    "mm": ("millimeter", "millimeters", "millimetre", "millimetres"),
    "km": ("kilometer", "kilometers", "kilometre", "kilometres"),
    "h": ("hour", "hours"),
    "min": ("minute", "minutes"),
    "s": ("second", "seconds"),
    "ms": ("millisecond", "milliseconds"),
    "lb": ("pound", "pounds"),
    "in": ("inch", "inches"),
    "pa": ("pascal", "pascals"),
    "kpa": ("kilopascal", "kilopascals"),
}
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Ordered CASE of silent failures: (name, any of these ILIKE patterns, longest text or None).
SILENT_FAILURES = (
    ("oup_validate_user_captcha", ("%please help us confirm that you are not a robot%", "%could not validate captcha%"), None),
    ("bot_challenge_js", ("%making sure you're not a bot%",), None),
    ("captcha_landing", ("%dear visitor%to continue browsing%fight cybercrime%",), None),
    ("site_protection_verify", ("%site protection%verifying your request%",), None),
    ("wiley_cookies_disabled", ("%cookies are disabled%requires cookies for authentication%",), None),
    ("js_required", ("%enable javascript%required%", "%enable it to continue%"), None),
    ("cdn_5xx_landing", ("%connection timed out%error code%",), None),
    ("redirect_broken", ("%the page isn't redirecting properly%",), None),
    ("page_not_found_short", ("%page not found%",), 500),
    ("access_denied_landing", ("%access denied%",), None),
    ("human_check", ("%please verify you are a human%", "%are you a robot%"), None),
    ("perimeterx_iframe_leak", ('<iframe title="Google Tag Manager"%',), None),
)
BACKFILL_PATTERNS = (
    "%please help us confirm that you are not a robot%",
    "%could not validate captcha%",
    "%experiencing unusual traffic%",
    "%validate user%",
    "%cookies are disabled%",
    "%requires cookies for authentication%",
    "%making sure you're not a bot%",
    "%please verify you are a human%",
    "%site protection%verifying your request%",
    "%dear visitor%fight cybercrime%",
    "%connection timed out%error code%",
    "%the page isn't redirecting properly%",
    '<iframe title="Google Tag Manager"%',
    "<iframe title='Google Tag Manager'%",
)
#: Per attempt, ILIKE: (name, any of these).
ATTEMPT_ERRORS = (
    ("tls_fetch_403", ("%upstream returned status 403%",)),
    ("tls_fetch_401", ("%upstream returned status 401%",)),
    ("tls_fetch_404", ("%upstream returned status 404%",)),
    ("tls_fetch_429", ("%upstream returned status 429%",)),
    ("tls_fetch_5xx", ("%upstream returned status 5%",)),
    ("insufficient_content", ("%extracted content below minimum length%",)),
    ("timeout", ("%context deadline exceeded%",)),
    ("dns_timeout", ("%i/o timeout%", "%dial tcp%lookup%")),
    ("tls_cert_invalid", ("%failed to verify certificate%", "%x509%")),
    ("http2_stream", ("%stream error%", "%INTERNAL_ERROR%")),
    ("body_too_large", ("%response body exceeds max bytes%",)),
    ("redirect_loop", ("%stopped after 10 redirects%",)),
    ("flares_pdf_skip", ("%non-HTML content type%pdf%",)),
    ("unpaywall_oa_403", ("%OA location returned status 403%",)),
    ("unpaywall_closed", ("%no open-access location%",)),
    ("flares_500", ("%sidecar returned status 500%",)),
    ("ssrf_rejected", ("%unsafe URL rejected%",)),
)
#: Per source, LIKE: (name, groups of alternatives that must all match, patterns that must not).
SOURCE_ERRORS = (
    ("A_flare_timeout_403_chain", (("%status 403%",), ("%context deadline exceeded%",), ("%flaresolverr%",)), ()),
    ("B_insufficient_content_all_tiers", (("%extracted content below minimum length%",),), ("%status 4%", "%context deadline%")),
    ("C_pdf_403_flares_pdf_skip", (("%status 403%",), ("%flaresolverr%non-HTML content type%pdf%",)), ()),
    ("D_403_challenge_pages", (("%status 403%",), ("%flaresolverr%extracted content%",)), ()),
    ("E_403_flares_timeout", (("%status 403%",), ("%context deadline exceeded%flaresolverr%",)), ()),
    ("F_rate_limited", (("%status 429%",),), ()),
    ("G_unauthorized", (("%status 401%",),), ()),
    ("H_not_found", (("%status 404%",),), ()),
    ("I_timeout_network", (("%context deadline exceeded%",),), ("%status 4%", "%extracted content%")),
    ("J_tls_cert_invalid", (("%tls: failed to verify certificate%", "%x509%"),), ()),
    ("K_ssrf_dns_fail", (("%unsafe URL rejected by SSRF%",),), ()),
    ("L_http2_stream_error", (("%stream error%", "%INTERNAL_ERROR%"),), ()),
    ("M_body_too_large", (("%response body exceeds max bytes%",),), ()),
    ("N_unpaywall_closed", (("%unpaywall: no open-access location%",),), ()),
    ("O_unpaywall_oa_403", (("%OA location returned status 403%",),), ()),
    ("P_pdf_via_flares_skipped", (("%non-HTML content type%pdf%",),), ()),
    ("Q_insufficient_content_partial", (("%extracted content below minimum length%",),), ()),
    ("R_403_other", (("%status 403%",),), ()),
    ("S_timeout_other", (("%context deadline exceeded%",),), ()),
    ("T_dns_timeout", (("%dial tcp%lookup%i/o timeout%",),), ()),
    ("U_flares_500", (("%flaresolverr: sidecar returned status 500%",),), ()),
    ("V_redirect_loop", (("%stopped after 10 redirects%",),), ()),
)
BACKFILLED_ERROR = "silent boilerplate detected on backfill"
# ---------------------------------------------------------------------------------------------------------------------


def any_of(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def all_of(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """An ordered CASE: the name of the first condition that holds."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, name in cases[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


# links


def is_doi(raw: Column) -> Column:
    return raw.startswith("10.") | raw.contains("doi.org/")


def classify_url(raw: Column) -> Column:
    """struct(kind, value, doi): a DOI loses its resolver prefixes, one after another; anything else is a url."""
    trimmed = F.trim(raw)
    doi = trimmed
    for prefix in DOI_PREFIXES:
        doi = F.when(doi.startswith(prefix), F.substr(doi, F.lit(len(prefix) + 1))).otherwise(doi)
    doi, yes = F.trim(doi), is_doi(trimmed)
    return F.struct(F.when(yes, "doi").otherwise("url").alias("kind"), F.when(yes, doi).otherwise(trimmed).alias("value"), F.when(yes, doi).alias("doi"))


def host_raw(url: Column) -> Column:
    """Host with port and case as written; null where there is none."""
    return F.nullif(F.regexp_extract(url, "https?://([^/]+)", 1), F.lit(""))


def host_normal(url: Column) -> Column:
    """Lower-cased host of a link, or the lower-cased trimmed link itself."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(F.trim(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit("")), F.trim(url)))


def resolve_url(link: Column, base: Column) -> Column:
    """`//x` takes https, an absolute link stays, all else is resolved on its base."""
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(://[^/]+.*/)[^/]*$", "$1")
    folder = F.when(F.substr(folder, F.length(root) + 1) == "", F.concat(root, F.lit("/"))).otherwise(folder)
    joined = F.when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))
    for _ in range(8):  # `./` and `name/../`, innermost first
        joined = F.regexp_replace(F.regexp_replace(joined, r"(?<=[^:/])/\./", "/"), r"(?<=[^:/])/(?!\.\./)[^/]+/\.\./", "/")
    joined = F.regexp_replace(joined, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)/(?:\.\./)+", "$1/")
    return (
        F.when(link.isNull() | (F.trim(link) == ""), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(joined)
    )


def safe_url(url: Column) -> Column:
    """P10: http or https, a host, and no private, loopback or link-local IPv4 address."""
    host = F.regexp_replace(F.coalesce(host_raw(F.lower(url)), F.lit("")), r"^[^@]*@|:\d+$", "")
    private = host.rlike(r"^(10|127|0)\.\d+\.\d+\.\d+$|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^localhost$")
    return F.lower(url).rlike("^https?://[^/]") & (host != "") & ~private


def snippet(text: Column, most: int) -> Column:
    """Longer than `most` bytes is cut there and ends in dots (whole characters only)."""
    return F.when(F.octet_length(text) > most, F.concat(F.decode(F.substring(F.encode(text, "utf-8"), 1, most), "utf-8"), F.lit("..."))).otherwise(text)


def strip_prefix(value: Column, *prefixes: str) -> Column:
    for p in prefixes:
        value = F.when(value.startswith(p), F.substr(value, F.lit(len(p) + 1))).otherwise(value)
    return value


def partial_date(text: Column) -> Column:
    """Y-m-d, Y-m or Y, else null."""
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd")),
    )


# Boilerplate and failures


def is_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(any_of(low.contains(p) for p in BOILERPLATE_PHRASES), F.lit(False))


def is_html_leak(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 200))
    return F.coalesce(any_of(head.startswith(p) for p in HTML_LEAK_PREFIXES), F.lit(False))


def is_insufficient(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) < MIN_EXTRACTED_LENGTH


def silent_failure(text: Column) -> Column:
    cases = []
    for name, patterns, most in SILENT_FAILURES:
        condition = any_of(text.ilike(p) for p in patterns)
        cases.append((condition & (F.length(text) < most) if most else condition, name))
    return first_match(cases, "other_short")


def backfill_failed(text: Column) -> Column:
    return F.coalesce(any_of(text.ilike(p) for p in BACKFILL_PATTERNS), F.lit(False))


def attempt_error(error: Column) -> Column:
    cases = [(any_of(error.ilike(p) for p in patterns), name) for name, patterns in ATTEMPT_ERRORS]
    return first_match([*cases, (error.isNull() | (error == ""), "no_error_field")], "other")


def source_error(error: Column) -> Column:
    cases = [(error == BACKFILLED_ERROR, "AA_backfilled_silent_failure")]
    for name, groups, never in SOURCE_ERRORS:
        condition = all_of(any_of(error.like(p) for p in group) for group in groups)
        cases.append((all_of([condition, *(~error.like(p) for p in never)]), name))
    return first_match(cases, "Z_other")


# Names and markup


def normal_model(model: Column) -> Column:
    """Lower-cased, without a routing tag and the first path segment."""
    low = F.lower(F.trim(model))
    return F.regexp_replace(F.regexp_replace(low, f":(?:{'|'.join(ROUTING_TAGS)})$", ""), "^[^/]*/", "")


def looks_like_markdown(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the index as what to trim
    return F.exists(F.slice(lines, 1, 20), lambda x: x.rlike(r"^(#|- |\* |> |\| |1\. |```)"))


def band(weight: Column, minimum: int = 3, stable: int = 6) -> Column:
    """How much a relation's weight says."""
    return F.when(weight < minimum, "insignificant").when(weight >= stable, "stable").otherwise("weak")


# Sentences and chunks


def rough_sentences(text: Column) -> Column:
    """Pieces that end in `.`, `!` or `?` before white space: the part of sentence splitting that SQL expresses."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the index as what to trim


def hard_split(text: Column, most: int) -> Column:
    """Consecutive slices of `most` characters."""
    n = F.ceil(F.length(text) / F.lit(most)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substr(text, i * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))


def sliding_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """array<struct<idx,start,text>>: windows of `size` characters; the first that reaches the end is the last."""
    size = size if size > 0 else 2000
    overlap = size // 10 if overlap >= size else max(0, overlap)
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("idx"), (i * step).alias("start"), F.substr(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, chunks).otherwise(F.array().cast("array<struct<idx:int,start:int,text:string>>"))


def passages(text: Column, tokens: int = 512, overlap: int = 50) -> Column:
    """Windows of white-space tokens, each joined by one space."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    step = tokens - overlap
    n = F.size(words)
    last = F.when(n <= tokens, 0).otherwise(F.ceil((n - tokens) / F.lit(step))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, tokens), " "))).otherwise(F.array().cast("array<string>"))


def encode_offsets(spans: Column) -> Column:
    """array<struct<start,end>> as one flat array."""
    return F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))


def decode_offsets(flat: Column) -> Column:
    """The other way; an odd number of offsets gives none."""
    n = F.size(flat)
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 2).cast("int"), F.lit(1)) - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("start"), F.get(flat, 2 * i + 1).alias("end")))
    return F.when((n % 2 == 0) & (n > 0), some).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def token_count(text: Column) -> Column:
    """White-space tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


# Citations and numbers


def numeric_tokens(sentence: Column) -> Column:
    """Numbers with the unit that follows, lower-cased, each once in order of appearance."""
    found = F.regexp_extract_all(sentence, F.lit(f"({NUMERIC_TOKEN})"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def numeric_query(sentence: Column) -> Column:
    """The AND of number tokens; a unit after white space is an OR of its spellings; empty without a number."""
    aliases = F.create_map(*[x for u, names in UNIT_ALIASES.items() for x in (F.lit(u), F.lit(" | ".join(f'"{n}"' for n in (u, *names))))])

    def clause(token: Column) -> Column:
        at = F.regexp_instr(token, F.lit("[ \t]"))
        number, unit = F.substr(token, F.lit(1), at - 1), F.trim(F.substr(token, at))
        spelled = F.coalesce(F.concat(F.lit("( "), F.try_element_at(aliases, unit), F.lit(" )")), F.concat(F.lit('"'), unit, F.lit('"')))
        return F.when(at > 0, F.concat(F.lit('"'), number, F.lit('" & '), spelled)).otherwise(F.concat(F.lit('"'), token, F.lit('"')))

    return F.array_join(F.transform(numeric_tokens(sentence), clause), " & ")


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)```.*?```", "")


def direct_citations(sentence: Column) -> Column:
    """Ids cited as `fact:id`, `concept:id` or `<id>` outside code fences, lower-cased, each once in order."""
    plain = strip_fences(sentence)
    found = F.regexp_extract_all(plain, F.lit(rf"((?:fact|concept)\s*:\s*{UUID}|<\s*{UUID}\s*>)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_extract(x, f"({UUID})", 1))))


def is_bare_image_citation(sentence: Column) -> Column:
    return sentence.rlike(r"^\s*!\[[^\]]*\]\(<\s*(?:fact\s*:\s*)?[0-9a-fA-F-]{36}\s*>\)\s*$")


def embedded_images(body: Column) -> Column:
    """Ids of images embedded as `![alt](<fact:id>)`, each once in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(rf"!\[[^\]]*\]\(<?\s*(?:fact\s*:\s*)?({UUID})\s*>?\)"), 1))


def bounded_citations(indexes: Column, sentences: Column) -> Column:
    """Sentence numbers outside the text go."""
    return F.filter(indexes, lambda i: (i >= 0) & (i < sentences))


def abstract_of(inverted: Column) -> Column:
    """Map word -> positions back to running text."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "-+", "-"))


def inverted_of(words: Column) -> Column:
    """The other way, within a row: map word -> its positions."""

    @F.pandas_udf("map<string,array<int>>")
    def invert(rows: pd.Series) -> pd.Series:
        def one(row):
            at: dict = {}
            for i, word in enumerate(row):
                at.setdefault(word, []).append(i)
            return at

        return rows.map(one, na_action="ignore")

    return invert(words)
