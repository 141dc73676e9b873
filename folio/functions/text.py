"""Plain-text expressions: trimming, fallbacks, counting words, labels and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.config import WORDS_PER_MINUTE

#: Unicode white space and line ends, with no-break spaces and the byte order mark.
_WHITE = r"[\s\u000B   -     　﻿]+"
#: A CJK character is a word; elsewhere a run without white space is.
WORD = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]|[^\s\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+"
#: What a search takes for a word.
TOKEN = r"[\p{L}\p{N}]+"


def js_trim(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, rf"^{_WHITE}|{_WHITE}\z", "")


def first_truthy(*values: Column | str) -> Column:
    """The first that is neither null nor ''; the last as it is."""
    columns = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def reading_minutes(words: Column, per_minute: int = WORDS_PER_MINUTE) -> Column:
    """Rounded half up, at least 1."""
    return F.greatest(F.lit(1), F.floor(words / F.lit(per_minute) + F.lit(0.5))).cast("long")


def formatted_tags(tags: Column) -> Column:
    """`#a #b`; '' for none."""
    return F.concat_ws(" ", F.transform(tags, lambda t: F.concat(F.lit("#"), t)))


def without_trailing_hash(text: Column) -> Column:
    return F.regexp_replace(text, r"#\z", "")


def valid_xml(text: Column) -> Column:
    """Without the characters that XML does not allow."""
    # Fixed value: the characters.
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFDD0-\\uFDEF\\uFFFE\\uFFFF]", "")


def language_tag(lang: Column) -> Column:
    """zh_CN as zh-CN: the first underscore only."""
    return F.regexp_replace(lang, "^([^_]*)_", "$1-")


def markdown_name(name: Column) -> Column:
    """With .md unless it ends in .md or .mdx in any case."""
    return F.when(name.rlike(r"(?i)\.(md|mdx)\z"), name).otherwise(F.concat(name, F.lit(".md")))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def page_title(title: Column, site: str, subtitle: str) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(f" - {site}"))).otherwise(f"{site} - {subtitle}")


def compact_number(n: Column, largest: str = "T") -> Column:
    """999, 1.2K, 3M, 4.5B: one decimal at most, half away from zero. largest: the unit that all larger numbers are given in too."""
    out = F.when(F.abs(n) < 1000, F.round(n, 1))
    units = ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T"))
    steps = units[: 1 + [name for _, name in units].index(largest)]
    clean = lambda x: F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.1f", x), r"\.0\z", ""))
    text = clean(out.cast("double"))
    for k, (unit, name) in enumerate(steps):
        # what rounds up to 1000 of a unit is 1 of the next
        top = F.lit(True) if k == len(steps) - 1 else F.round(F.abs(n) / unit, 1) < 1000
        text = F.coalesce(text, F.when(top, F.concat(clean(F.round(n / unit, 1).cast("double")), F.lit(name))))
    return text


def without_emoji_codes(text: Column) -> Column:
    # Fixed value: how a code looks.
    return F.regexp_replace(text, ":[a-zA-Z0-9_]+:", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
