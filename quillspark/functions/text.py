"""Scalar text functions: Column to Column, all JVM-side.

An empty string means "unknown" in this data model, so functions treat null and '' alike and return ''
where the result is unknown, unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- identifiers

# The patterns of a DOI in running text, in brackets and in a table cell.
DOI = r'''10\.\d{4,9}/[^\s"'<>]+'''
DOI_IN_BRACKETS = r'''10\.\d{4,9}/[^\s"'<>)\]}]+'''
DOI_IN_CELL = r"10\.\d{4,9}/\S+"


def known(c: Column) -> Column:
    """null for unknown."""
    return F.nullif(c, F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def doi_without_resolver(c: Column) -> Column:
    """Trim, drop a resolver prefix, lower."""
    return or_empty(F.lower(F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))


def doi_without_dots(c: Column) -> Column:
    """Trim, drop trailing full stops, lower."""
    return or_empty(F.lower(F.regexp_replace(F.trim(c), r"\.+$", "")))


def doi_as_url(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), F.lower(c))


def first_doi(c: Column) -> Column:
    """The first DOI in running text without the punctuation that follows it; null if none."""
    return F.rtrim(known(F.regexp_extract(c, "(?i)" + DOI, 0)), F.lit(".,;:)>]}\u201d\"'"))


def first_doi_in_brackets(c: Column) -> Column:
    return F.rtrim(known(F.regexp_extract(c, "(?i)" + DOI_IN_BRACKETS, 0)), F.lit("."))


def first_doi_in_cell(c: Column) -> Column:
    return doi_without_resolver(F.rtrim(F.regexp_extract(c, DOI_IN_CELL, 0), F.lit(").]")))


def identifier_kind(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^(?i:PMC)\d+$"), "pmcid").when(t.rlike(r"^\d+$"), "pmid").when(F.lower(t).startswith("10.") & t.contains("/"), "doi").otherwise("title")


def identifier_value(c: Column) -> Column:
    t = F.trim(c)
    return F.when(identifier_kind(c) == "pmcid", F.upper(t)).otherwise(t)


def literature_query(kind: Column, value: Column) -> Column:
    """The search expression of a literature index for an identifier."""
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    return (
        F.when(kind == "doi", F.concat(F.lit("DOI:"), quoted))
        .when(kind == "pmid", F.concat(F.lit("EXT_ID:"), value, F.lit(" AND SRC:MED")))
        .when(kind == "pmcid", F.concat(F.lit("PMCID:"), value))
        .otherwise(F.concat(F.lit("TITLE:"), quoted))
    )


# ---- names and keys


def base_key(authors: Column, year: Column) -> Column:
    """Citation key before suffixes: ASCII letters and digits of the first author's first word, then the year."""
    first = F.split(F.split(F.coalesce(known(authors), F.lit("anon")), ",")[0], " ")[0]
    word = F.regexp_replace(F.lower(first), "[^a-z0-9]", "")
    return F.concat(F.coalesce(known(word), F.lit("anon")), F.coalesce(known(year), F.lit("0000")))


def last_word(c: Column) -> Column:
    return or_empty(F.element_at(F.split(known(F.trim(c)), r"\s+"), -1))


def author_label(surname: Column, key: Column) -> Column:
    """The surname, else the key's leading letters, capitalised, else the key."""
    alpha = known(F.regexp_extract(key, "^[a-zA-Z]+", 0))
    return F.coalesce(known(surname), F.concat(F.upper(F.substring(alpha, 1, 1)), F.lower(F.substring(alpha, 2, 1 << 20))), key)


def author_year(c: Column) -> Column:
    """struct(author, year) of an author-year token; both '' if it is none."""
    pattern = "^\\s*([A-Za-z\u00c0-\u024f][A-Za-z\u00c0-\u024f'\u2019.\\-]*(?:\\s+(?:and|&|et\\s+al\\.?|[A-Za-z\u00c0-\u024f][A-Za-z\u00c0-\u024f'\u2019.\\-]*))*?)\\s+(\\d{4})[a-z]?\\s*$"
    return F.struct(F.regexp_extract(c, pattern, 1).alias("author"), F.regexp_extract(c, pattern, 2).alias("year"))


# ---- tokens


def title_tokens(c: Column) -> Column:
    """Distinct runs of four or more ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(or_empty(c)), F.lit("[a-z]{4,}"), F.lit(0)))


def word_tokens(c: Column) -> Column:
    """Distinct runs of three or more ASCII letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2))


def phrase_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"[a-z][a-z\-]+"), F.lit(0))


# Words that never take part in a phrase.
STOP_WORDS = (
    "the a an and or of to in on for with by from as is are was were be been being this that these those "
    "it its their our we you they he she his her them at into than then thus also can may might will would could should "
    "not no nor but which who whom whose where when while how what why all any both each few more most other some such only "
    "own same so too very s t just over under above below up down out off again further here there once during between within "
    "without across about against among through per via using used use model models result results method methods figure "
    "figures show shows shown found find data set sets value values number numbers paper study studies based across given "
    "information missing analysis approach effect effects role roles"
).split()


def containment(part: Column, whole: Column) -> Column:
    """Share of ``part``'s tokens that ``whole`` has; 0 for no tokens."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


# ---- running text


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(or_empty(c), r"\s+", " "))


def first_sentences(c: Column, n: int = 3) -> Column:
    return F.trim(F.array_join(F.slice(F.split(or_empty(c), r"(?<=[.!?])\s+"), 1, n), " "))


def short_title(c: Column, size: int = 70) -> Column:
    """Cut at a word boundary."""
    t = F.regexp_replace(or_empty(c), r"[. ]+$", "")
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, size), " [^ ]*$", ""), F.lit("\u2026")))


def hard_cut(c: Column, size: int) -> Column:
    return F.concat(F.substring(c, 1, size), F.when(F.length(c) > size, F.lit("\u2026")).otherwise(F.lit("")))


def table_cell(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(or_empty(c.cast("string")), r"\s+", " "), F.lit("|"), F.lit("\\|")))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(or_empty(c), F.lit('"'), F.lit('\\"')), F.lit('"'))


def unquoted(c: Column) -> Column:
    t = F.trim(c)
    inner = F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit('\\"'), F.lit('"'))
    return F.when((F.length(t) >= 2) & t.startswith('"') & t.endswith('"'), inner).otherwise(t)


def without_tex(c: Column) -> Column:
    """Text without accents' commands, emphasis, other commands and braces."""
    s = F.regexp_replace(or_empty(c), "\\\\[`'^\"~=.]\\{?([A-Za-z])\\}?", "$1")
    s = F.regexp_replace(s, r"\\emph\{([^}]*)\}", "$1")
    s = F.regexp_replace(s, r"\\[A-Za-z]+\*?", " ")
    return squeeze(F.translate(F.replace(s, F.lit("~"), F.lit(" ")), "{}", ""))


def tex_first_author(c: Column) -> Column:
    """First author of a TeX author list without leading initials."""
    first = without_tex(F.split(c, ",")[0])
    kept = F.filter(F.split(first, " "), lambda t: ~t.rlike(r"^[A-Z]\.?(?:[A-Z]\.?)*$"))
    return F.when(F.size(F.filter(kept, lambda t: t != "")) > 0, F.array_join(kept, " ")).otherwise(first)


def cites_something(content: Column) -> Column:
    """Does a bracket's content hold an author-year token or a DOI?"""
    return F.exists(F.split(content, ";"), lambda p: (author_year(F.rtrim(p, F.lit(" \u26a0")))["year"] != "") | p.rlike("(?i)" + DOI_IN_BRACKETS))


def looks_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


# ---- bibliography entries

# Entities and symbols with the TeX that typesets them.
ENTITIES = {"&amp;": "\\&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " "}
SYMBOLS = {
    "“": '"', "”": '"', "‘": "'", "’": "'", "‐": "-", "‑": "-", "–": "--", "—": "---",
    "α": "$\\alpha$", "β": "$\\beta$", "γ": "$\\gamma$", "δ": "$\\delta$", "ε": "$\\epsilon$", "κ": "$\\kappa$", "λ": "$\\lambda$",
    "μ": "$\\mu$", "σ": "$\\sigma$", "τ": "$\\tau$", "ω": "$\\omega$", "Δ": "$\\Delta$", "Ω": "$\\Omega$",
    "°": "$^\\circ$", "±": "$\\pm$", "×": "$\\times$", "⋅": "$\\cdot$",
}
# Names whose only capital is the first letter.
PROPER_NOUNS = (
    "alzheimer parkinson huntington rett creutzfeldt jakob purkinje bergmann schwann hodgkin huxley hopf markov "
    "gaussian poisson bayesian fourier brownian drosophila xenopus caenorhabditis escherichia"
).split()


def with_key(entry: Column, key: Column) -> Column:
    """The entry under another citation key."""
    head = F.regexp_extract(entry, r"^(?s:.*?)(@\w+\s*\{)[^,]*,", 0)
    opened = F.regexp_extract(entry, r"^((?s:.*?)@\w+\s*\{)[^,]*,", 1)
    return F.when(head == "", entry).otherwise(F.concat(opened, key, F.lit(","), F.substr(entry, F.length(head) + 1)))


def with_venue(entry: Column, venue: Column, note: str = "Preprint") -> Column:
    """Journal and note inside the closing brace."""
    head = F.rtrim(F.rtrim(F.regexp_extract(entry, r"(?s)^(.*)\}", 1), F.lit(" \n\t")), F.lit(","))
    return F.when(~entry.contains("}"), entry).otherwise(F.concat(head, F.lit(", journal={"), venue, F.lit("}, note={" + note + "} }")))


def has_venue(entry: Column) -> Column:
    return entry.rlike(r"(?i)\b(?:journal|booktitle)\s*=\s*\{")


def typesettable(entry: Column) -> Column:
    """No tags, url or doi fields, entities or symbols that plain TeX cannot set."""
    # fixed values: the patterns of a tag, and of a url or doi field
    s = F.regexp_replace(F.regexp_replace(entry, "<[^>]+>", " "), r"(?i),?\s*(?:url|doi)\s*=\s*\{[^}]*\}", "")
    for a, b in [*ENTITIES.items(), *SYMBOLS.items()]:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, "[ \t]{2,}", " ")


def needs_braces(token: Column, following: Column) -> Column:
    """Would a lower-casing style spoil the token?"""
    core = F.regexp_replace(token, r"^[.,;:()\[\]\x22\x27]+|[.,;:()\[\]\x22\x27]+$", "")
    capitals = F.length(F.regexp_replace(core, r"\P{Lu}", ""))
    symbol = core.rlike(r"^\p{Lu}\p{L}?$") & F.coalesce(following.rlike(r"^\d"), F.lit(False))
    noun = F.regexp_replace(F.lower(core), "[\\x27s]+$", "").isin(PROPER_NOUNS)
    return ~token.rlike(r"[${}\\]") & (core != "") & ((capitals >= 2) | ((capitals >= 1) & core.rlike(r"\d")) | symbol | noun)


def protect_capitals(title: Column) -> Column:
    """Braces around the tokens that need them."""
    words = F.split(title, " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(needs_braces(w, F.coalesce(F.get(words, i + 1), F.lit(""))), F.concat(F.lit("{"), w, F.lit("}"))).otherwise(w)), " ")


def plain_entry(key: Column, title: Column, author: Column, year: Column, journal: Column) -> Column:
    field = lambda name, v: F.concat(F.lit(f"  {name} = {{"), F.trim(or_empty(v)), F.lit("},"))
    return F.concat_ws("\n", F.concat(F.lit("@article{"), key, F.lit(",")), field("title", title), field("author", author), field("year", year), field("journal", journal), F.lit("}"))


# ---- note files


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^---\n.*?\n---", 0)


def after_frontmatter(text: Column) -> Column:
    return F.substr(text, F.length(frontmatter(text)) + 1)


def front_value(text: Column, key: str) -> Column:
    return unquoted(F.regexp_extract(frontmatter(text), rf"(?m)^{key}:[ \t]*(.*)$", 1))


def front_list(text: Column, key: str) -> Column:
    block = F.regexp_extract(frontmatter(text), rf"(?m)^{key}:[ \t]*\n((?:[ \t]+-[ \t]+.*\n?)+)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+-[ \t]+(.*)$"), F.lit(1)), unquoted)


def render_frontmatter(**fields: Column) -> Column:
    """Scalars quoted, arrays as block lists, in the order given; a null field is left out."""
    lines = []
    for name, (kind, c) in fields.items():
        if kind == "list":
            lines.append(F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n"))).otherwise(F.lit(f"{name}: []")))
        else:
            lines.append(F.concat(F.lit(f"{name}: "), quoted(c) if kind == "quoted" else c))
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def set_front_value(block: Column, key: str, value: Column, after: str) -> Column:
    """Replace a line; else add it below another; else before the fence."""
    line = F.concat(F.lit(f"{key}: "), value)
    fill = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    body = F.regexp_replace(block, r"\n---$", "")
    return (
        F.when(block.rlike(rf"(?m)^{key}:.*$"), F.regexp_replace(block, F.lit(rf"(?m)^{key}:.*$"), fill))
        .when(block.rlike(rf"(?m)^{after}:.*$"), F.regexp_replace(block, F.lit(rf"(?m)^({after}:.*)$"), F.concat(F.lit("$1\n"), fill)))
        .otherwise(F.concat(body, F.lit("\n"), line, F.lit("\n---")))
    )


def replace_between(text: Column, start: str, end: str, body: Column) -> Column:
    """The part from one marker line to another, with a new body; unchanged if the markers are not there."""
    pattern = rf"(?s)^(.*?){start}\n.*?\n{end}(.*)$"
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.lit(start + "\n"), body, F.lit("\n\n" + end), F.regexp_extract(text, pattern, 2))).otherwise(text)


def replace_to_end(text: Column, start: str, section: Column) -> Column:
    """Everything from a marker line on, or appended."""
    pattern = rf"(?s)^(.*?\n){start}.*$"
    gap = F.when(text.endswith("\n"), F.lit("\n")).otherwise(F.lit("\n\n"))
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), section)).otherwise(F.concat(text, gap, section))


def body_and_references(text: Column) -> Column:
    """struct(body, refs): split at the last references heading."""
    pattern = r"(?s)^(.*)(?<![^\n])#{1,6}\s*(?i:references)\b(.*)$"
    found = text.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("body"), F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(F.lit("")).alias("refs"))


def before_bibliography(text: Column) -> Column:
    """Without image data, and cut at the first bibliography heading."""
    # fixed values: the patterns of an image definition and of the heading
    clean = F.regexp_replace(text, r"(?m)^\[image\d+\]:.*$", "")
    pattern = r"(?s)^(.*?)(?<![^\n])\s*(?:#+\s*|\*\*)?(?i:references)\b.*$"
    return F.when(clean.rlike(pattern), F.regexp_extract(clean, pattern, 1)).otherwise(clean)
