"""Text of HTML pages with native expressions."""

from __future__ import annotations

import html as stdlib_html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements without text, and elements that end a line (matched by prefix, so <pre> and <link> do too)
HIDDEN = ("script", "style", "noscript")
BLOCKS = ("p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "ul", "ol", "li", "table", "tr", "td", "th", "br", "hr", "blockquote", "pre", "title", "head", "body")
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&"))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else stdlib_html.unescape(x))


def page_text(page: Column, all_entities: bool = False) -> Column:
    """Lines of text, empty ones left out, joined by a blank line; headings open with # by level.

    The common entities are replaced natively, the ampersand last; all_entities sends the text through the standard
    library instead.
    """
    out = page
    for tag in HIDDEN:
        out = F.regexp_replace(out, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, f"(?is)<h{level}\\b[^>]*>(.*?)</h{level}\\s*>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, "(?i)</?(?:" + "|".join(BLOCKS) + ")[^>]*>", "\n")
    out = F.regexp_replace(out, "(?s)<[^>]+>", "")
    if all_entities:
        out = _unescape(out)
    else:
        for name, value in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(value))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\\f\\x0B ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")
