"""Column expressions over text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, longest: int = 40) -> Column:
    """Lower-case runs of letters and digits, in order; those of `longest` bytes or more are left out."""
    parts = F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) < longest))


def count_tokens(text: Column | str) -> Column:
    """The default token counter: words between white space."""
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+", -1), lambda t: t != "")).cast("long")


def word_set(text: Column | str) -> Column:
    """Distinct lower-case words of more than two characters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\W+", " "), " ", -1)
    return F.array_distinct(F.filter(words, lambda t: F.length(t) > 2))


def slug(text: Column | str, longest: int, word_boundary: bool = False) -> Column:
    """Lower-case ASCII words joined by hyphens, cut to a length (at a word's end, if asked)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(unaccented(text)), r"['’]", ""), r"[^a-z0-9]+", "-"), F.lit("-"))
    short = F.substring(plain, 1, longest)
    if word_boundary:
        cut = F.regexp_replace(short, r"-[^-]*$", "")
        short = F.when((F.length(plain) > longest) & (F.substring(plain, longest + 1, 1) != "-"), cut).otherwise(short)
    return F.trim(short, F.lit("-"))


#: Accented Latin letters and what they become; longer spellings follow.
_ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťțùúûüūůűųýÿžźżÀÁÂÃÄÅĀĂĄÇĆČĎĐÈÉÊËĒĖĘĚÌÍÎÏĪĮŁÑŃŇÒÓÔÕÖØŌŐŔŘŚŠŞŤȚÙÚÛÜŪŮŰŲÝŸŽŹŻ"
_UNACCENTED = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorrssstt" + "uuuuuuuuyyzzz" + "AAAAAAAAACCCDDEEEEEEEEIIIIIILNNNOOOOOOOORRSSSTT" + "UUUUUUUUYYZZZ"


def unaccented(text: Column | str) -> Column:
    plain = F.translate(col(text), _ACCENTED, _UNACCENTED)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def clean_paragraph(text: Column | str) -> Column:
    """Joined hyphenations, no soft hyphens, single blanks, at most one blank line, trimmed."""
    # A pattern is tried only on texts that hold what it looks for: trying it at each character takes far longer.
    def where(held: Column, pattern: str, by: str, c: Column) -> Column:
        return F.when(held, F.regexp_replace(c, pattern, by)).otherwise(c)

    joined = F.replace(where(F.contains(col(text), F.lit("-")) & F.contains(col(text), F.lit("\n")), r"(?U)(\w)-\s*\n\s*(\w)", "$1$2", col(text)), F.lit("­"), F.lit(""))
    single = where(F.contains(joined, F.lit("  ")) | F.contains(joined, F.lit("\t")), r"[ \t]+", " ", joined)
    return F.trim(where(F.contains(single, F.lit("\n\n\n")), r"\n{3,}", "\n\n", single), F.lit(" \n\t\r"))


def stripped(text: Column | str) -> Column:
    """text without white space at its ends."""
    return F.btrim(col(text), F.lit(" \t\n\x0b\x0c\r"))


# --- URLs ---------------------------------------------------------------------------------------------------------

# Hosts that browsers reach only, and hosts whose files need a signed-in reader.
BROWSER_HOSTS = ("papers.ssrn.com", "www.sec.gov", "www.researchgate.net", "dl.acm.org", "www.sciencedirect.com", "www.nature.com", "core.ac.uk")
GATED_HOSTS = ("dl.acm.org", "www.nature.com", "www.sciencedirect.com", "www.researchgate.net", "core.ac.uk")
# Parts of hosts, in the order in which they are tried, and the class of each.
HOST_CLASSES = (("arxiv.org", "arxiv"), ("eprint.iacr.org", "iacr"), ("ssrn.com", "ssrn"), ("sec.gov", "sec"), ("researchgate.net", "researchgate"))


def host(url: Column | str) -> Column:
    """The network place of a URL with a scheme, in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def normalize_arxiv(url: Column | str) -> Column:
    """Abstract and PDF addresses become https://arxiv.org/pdf/<id>[vN].pdf; others stay."""
    u = col(url)
    found = F.regexp_extract(u, r"arxiv\.org/(?:abs|pdf)/([\w./-]+?)(?:\.pdf)?$", 1)
    return F.when(F.contains(u, F.lit("arxiv.org")) & (found != ""), F.concat(F.lit("https://arxiv.org/pdf/"), found, F.lit(".pdf"))).otherwise(u)


def normalize_iacr(url: Column | str) -> Column:
    u = col(url)
    return F.when(F.contains(u, F.lit("eprint.iacr.org")) & ~F.endswith(u, F.lit(".pdf")), F.concat(F.rtrim(u, F.lit("/")), F.lit(".pdf"))).otherwise(u)


def normalize_url(url: Column | str) -> Column:
    return normalize_iacr(normalize_arxiv(F.trim(col(url))))


def github_raw(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def referer(url: Column | str) -> Column:
    return F.concat(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))


def url_class(url: Column | str) -> Column:
    """The kind of source that a URL's host stands for."""
    h = host(url)
    kind = F.when(h == "", "unknown")
    for part, name in HOST_CLASSES:
        kind = kind.when(F.contains(h, F.lit(part)), name)
    return kind.when(h.isin(*BROWSER_HOSTS), "gated").otherwise("direct")


def gated_reason(url: Column | str) -> Column:
    h = host(url)
    return F.when(h.isin(*GATED_HOSTS), F.concat(F.lit("auth_required: "), h, F.lit(" requires institutional access")))


def host_suffix(h: Column, domain: Column) -> Column:
    """Whether a host is a domain (a leading dot counts for nothing) or lies below it."""
    bare = F.ltrim(domain, F.lit("."))
    return (h == bare) | F.endswith(h, F.concat(F.lit("."), bare))


def host_suffixes(h: Column) -> Column:
    """The host and all domains above it: what host_suffix() holds for."""
    labels = F.split(h, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def arxiv_version(url: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(url), r"v(\d{1,9})(?=\.pdf)", 1), F.lit("")).try_cast("int"), F.lit(0))


def content_key(title: Column | str, url: Column | str) -> Column:
    """What versions of one paper share: its short slug, and its URL without an arXiv version."""
    u = col(url)
    canonical = F.when(F.contains(u, F.lit("arxiv.org")), F.regexp_replace(u, r"v\d+(?=\.pdf)", "")).otherwise(u)
    return F.concat(slug(F.lower(col(title)), 80, word_boundary=True), F.lit("|"), canonical)


def paper_id(title: Column | str, url: Column | str) -> Column:
    s = slug(title, 60, word_boundary=True)
    return F.concat(F.when(s == "", "untitled").otherwise(s), F.lit("-"), F.substring(F.sha1(col(url)), 1, 8))


def ssrn_id(url: Column | str) -> Column:
    u = col(url)
    found = [F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in (r"abstract_?id=(\d+)", r"/abstract=(\d+)", r"/id/(\d+)")]
    return F.coalesce(*found)


def is_pdf(content: Column | str, least: int = 10_000) -> Column:
    return (F.octet_length(col(content)) >= least) & (F.substring(col(content), 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8"))


# --- identifiers --------------------------------------------------------------------------------------------------

# What identifiers look like.
ARXIV_NEW = r"(?<!\d)(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)"
ARXIV_OLD = r"(?:^|[\s(\[/])([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?"
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"


def arxiv_ids(text: Column | str) -> Column:
    """arXiv ids of either style, as they occur, without versions, in lower case."""
    return F.transform(F.concat(F.regexp_extract_all(col(text), F.lit(ARXIV_NEW), F.lit(1)), F.regexp_extract_all(col(text), F.lit(ARXIV_OLD), F.lit(1))), F.lower)


def dois(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(DOI), F.lit(1)), lambda d: F.lower(F.regexp_replace(d, r"[.,;:)\]]+$", "")))


def own_arxiv_id(url: Column | str) -> Column:
    return F.get(arxiv_ids(F.regexp_replace(col(url), r"\.pdf$", "")), F.lit(0))


# --- bibliography -------------------------------------------------------------------------------------------------


def bib_key(authors: Column | str, date: Column | str) -> Column:
    first = F.trim(F.substring_index(F.coalesce(col(authors), F.lit("")), ",", 1))
    last = F.regexp_replace(F.lower(F.element_at(F.split(first, r"\s+", -1), -1)), "[^a-z0-9]", "")
    return F.concat(F.when(last == "", "anon").otherwise(last), bib_year(date))


def bib_year(date: Column | str) -> Column:
    return F.substring_index(F.coalesce(col(date), F.lit("")), "-", 1)


def bibtex(paper: Column | str, title: Column | str, authors: Column | str, date: Column | str) -> Column:
    entry = "@misc{%s,\n  title  = {%s},\n  author = {%s},\n  year   = {%s},\n  note   = {paper_id: %s}\n}"
    return F.format_string(entry, bib_key(authors, date), col(title), F.coalesce(col(authors), F.lit("")), bib_year(date), col(paper))


# --- vectors ------------------------------------------------------------------------------------------------------


def as_doubles(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def padded(number: Column | str, digits: int) -> Column:
    """A number of at least so many digits, with zeros before it; longer ones stay whole."""
    x = col(number).cast("string")
    return F.when(F.length(x) < digits, F.lpad(x, digits, "0")).otherwise(x)


def l2_normalize(v: Column | str) -> Column:
    """v over its length; a zero vector stays."""
    n = l2_norm(v)
    return F.transform(col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
