"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate tokens, and the patterns of wiki titles and links.
TOKEN = "[^ \t\n\r\f]+"
TITLE = "<title>(.+?)</title>"
LINK = r"\[\[(.+?)([\|#]|\]\])"
#: Entities in the order in which they are replaced.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))


def tokens(line: Column) -> Column:
    """The maximal runs outside blank, tab, newline, return and form feed."""
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def starts_with_letter(word: Column) -> Column:
    """The first character is a Unicode letter."""
    return word.rlike(r"^\p{L}")


def first_char(word: Column) -> Column:
    """P3."""
    return F.substring(word, 1, 1)


def xml_unescape(line: Column) -> Column:
    """Entities are replaced one kind after another, so ``&amp;quot;`` becomes a quote but ``&amp;lt;`` stays an entity."""
    for entity, char in ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(char))
    return line


def page_title(unescaped: Column) -> Column:
    """The first title of an unescaped line; empty if there is none."""
    return F.regexp_extract(unescaped, TITLE, 1)


def page_links(unescaped: Column, pattern: str = LINK) -> Column:
    """All link targets, duplicates kept."""
    return F.regexp_extract_all(unescaped, F.lit(pattern), F.lit(1))


def capitalised(link: Column) -> Column:
    """A first letter of ``a`` to ``z`` becomes upper case; the rest stays."""
    head = F.substring(link, 1, 1)
    return F.when(head.between("a", "z"), F.concat(F.upper(head), F.substr(link, F.lit(2)))).otherwise(link)


def split_fields(line: Column, mark: str) -> Column:
    """P10: the fields between marks; empty fields at the end are dropped, so an empty line has none."""
    fields = F.split(line, re.escape(mark), -1)
    last = F.array_max(F.transform(fields, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.slice(fields, F.lit(1), last.cast("int"))


def to_byte(x: Column) -> Column:
    """Truncate and cap at 255."""
    return F.least(F.lit(255.0), F.floor(x)).cast("int")
