"""What a site is configured with. Every operator takes the values that it needs as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Posts on a page, and page numbers shown at either side of the current one.
PAGE_SIZE, ADJACENT_PAGES = 8, 2
#: Tags and categories from which a list is collapsed; words of a search excerpt; a title's weight.
COLLAPSE_TAGS, COLLAPSE_CATEGORIES, EXCERPT_WORDS, TITLE_WEIGHT = 20, 5, 20, 10
#: Levels of headings in a table of contents, and words read in a minute.
TOC_DEPTH, WORDS_PER_MINUTE = 2, 200


@dataclass(frozen=True)
class NavLink:
    name: str
    url: str
    external: bool = False


@dataclass(frozen=True)
class Site:
    title: str = "Untitled site"
    subtitle: str = ""
    lang: str = "en"
    base: str = "/"
    origin: str = "https://example.org"
    author: str = ""
    toc_depth: int = TOC_DEPTH
    page_size: int = PAGE_SIZE
    #: Paths that robots are to leave alone.
    disallow: tuple[str, ...] = ()
    #: Names of presets (see operators.lookup.PRESETS) or links.
    nav: tuple[str | NavLink, ...] = field(default=("home", "archive", "about"))
