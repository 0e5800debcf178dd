"""Blank handling, URL tests and the page-to-text chain."""

from pyspark.sql import Column, functions as F

from driftline.fields import DOI_PREFIX, LOOSE_URL, STRICT_URL

# (?U): white space in the Unicode sense, so tabs, no-break and wide spaces are blank too.
_NON_BLANK = r"(?U)\S"
_OUTER_BLANKS = r"(?U)^\s+|\s+$"


def has_text(x: Column) -> Column:
    """True where the value, as text, holds a character other than white space."""
    return F.coalesce(x.cast("string").rlike(_NON_BLANK), F.lit(False))


def trimmed_or_null(x: Column) -> Column:
    """Text without outer white space; null where nothing is left."""
    text = F.regexp_replace(x.cast("string"), _OUTER_BLANKS, "")
    return F.nullif(text, F.lit(""))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _any_case(pattern: str) -> str:
    return "(?iu)" + pattern


def is_loose_url(x: Column) -> Column:
    """Looks like a web address, scheme optional."""
    return F.coalesce(x.rlike(_any_case(LOOSE_URL)), F.lit(False))


def is_strict_url(x: Column) -> Column:
    return F.coalesce(x.rlike(_any_case(STRICT_URL)), F.lit(False))


def is_real_url(x: Column) -> Column:
    """A strict address or a bare DOI; gear codes such as ``Pel.Trawl`` are neither."""
    return is_strict_url(x) | F.coalesce(x.rlike(_any_case(DOI_PREFIX)), F.lit(False))


def fetch_route(url: Column) -> Column:
    """Pages of this site are built by script and need a rendering fetch."""
    return F.when(url.contains("protocols.io"), F.lit("rendered")).otherwise(F.lit("static"))


# Page-to-text chain: (pattern, replacement), applied in order. Only syntax that Java and RE2 share.
# Script, style and comments that are never closed run to the end of the page, as in a browser;
# the other blocks are dropped only where they are closed, so an open <nav> cannot eat the article.
HTML_STEPS = [
    (r"(?is)<!--.*?(-->|\z)", " "),
    (r"(?is)<script\b.*?(</script\s*>|\z)", " "),
    (r"(?is)<style\b.*?(</style\s*>|\z)", " "),
    (r"(?is)<head\b.*?</head\s*>", " "),
    (r"(?is)<nav\b.*?</nav\s*>", " "),
    (r"(?is)<header\b.*?</header\s*>", " "),
    (r"(?is)<footer\b.*?</footer\s*>", " "),
    (r"(?is)<aside\b.*?</aside\s*>", " "),
    (r'(?is)<div class="ad[^"]*">.*?</div\s*>', " "),
    (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article|/ul|/ol|/table|/title)\b[^>]*>", "\n"),
    (r"(?i)<(p|div|li|h[1-6]|tr|section|article|ul|ol|table)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;|&apos;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


def html_to_text(html: Column) -> Column:
    """Readable text of a page; null where nothing is left."""
    text = html
    for pattern, replacement in HTML_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.nullif(text, F.lit(""))
