"""Personal data in whole texts, also behind disguises, at the source's own offsets.

Base spans come from the text as it stands. Then a transducer rewrites disguises (compatible forms of
ASCII characters and look-alikes of other scripts, spelled digits, "at" and "dot" in words, brackets or apart,
in the four languages of the tables) and records for each rewritten character which source characters it
stands for. The same finders run over the rewritten text, and what they find is mapped back and added where
no base span of that kind is, or where it contains those that are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit also fails from the others, so only that one is tried.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest local part before it and a domain after it; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", m.end() if m else at + 1)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups())]


def _luhn(digits: str) -> bool:
    turned = digits[::-1]
    return (sum(map(int, turned[::2])) + sum(_DOUBLED[int(x)] for x in turned[1::2])) % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


_FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, by start, then kind."""
    return sorted((s, k, e) for k, find in enumerate(_FINDERS) for s, e in find(text))


# --- the transducer --------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words, in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words that repeat the digit that follows.
TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
# Words for "+", "@" and "." in these languages.
PLUS = ("plus", "más", "mas")
AT = ("at", "ät", "klammeraffe", "arobase", "arrobase", "arroba")
DOT = ("dot", "punkt", "point", "punto")
# Ends of host names, besides all of two letters, that words alone ("name at host dot end") must have,
# and words before "at" in sentences, which name no one.
ENDS = "com org net edu gov mil int info biz name pro dev app online cloud email site store shop tech xyz blog club agency example test invalid local localhost".split()
NO_NAMES = (
    "look looks looking looked me us him her them you it this that these those here there is are was were be been being am and or not meet meets met see seen find found visit visits available "
    "stay stays stayed arrive arrives arrived live lives lived work works worked shop read buy sold sale start starts end ends only even still now then again back home down up out just also all "
    "ist sind war waren und oder nicht ich du er sie es wir uns mich dich ihn hier dort est sont et ou moi toi lui nous vous eux ici es son y o yo me te él ella aquí"
).split()
# Letters written for digits.
LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _plain(c: str) -> str:
    """The ASCII that a character stands for, else itself: look-alikes, decimal digits of all scripts, and compatible forms (NFKC)."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if c in "ªº¹²³" or kind[0] == "C" or kind in ("Zl", "Zp"):  # marks of order and of footnotes are none
        return c
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() and (len(form) == 1 or form.isalpha() and kind[0] == "L") else c


def _classes(points: list[int]) -> str:
    """A character class of these ascending code points."""
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs) + "]"


_ALONE = r"(?<![^\W_])", r"(?![^\W_])"  # no letter or digit before, after
_GLYPH = re.compile(_classes([p for p in range(0x80, 0x20000) if not 0xD800 <= p <= 0xDFFF and _plain(chr(p)) != chr(p)]))
# These rules see the text in lower case. A gap has one line end at most.
_GAP = r"(?:[ \t]+(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
_HOST = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*"
_NAME = r"[a-z0-9_%+-]+(?:\.[a-z0-9_%+-]+)*"
_FRAMED = r"[\[({{<][ \t]*(?:{})[ \t]*[\])}}>]"
_FRAMED_DOT = rf"{_GAP}?{_FRAMED.format(_any(DOT) + r'|\.')}{_GAP}?"
_BARE_DOT = rf"{_GAP}{_any(DOT)}{_GAP}"
# bare words only in the frame "name at host dot domain"
_BARE = re.compile(rf"(?<=[ \t\n]){_any(AT)}{_GAP}{_HOST}(?:(?:{_BARE_DOT}|{_FRAMED_DOT}){_HOST})+(?![a-z0-9])")
_BARE_AT = re.compile(rf"{_any(AT)}{_GAP}")
_BEFORE = re.compile(rf"(?:(?<=[^a-z0-9._%+-])|^)({_NAME}(?:{_BARE_DOT}{_NAME})*)({_GAP})\Z")
_ANY_DOT = re.compile(rf"{_BARE_DOT}|{_FRAMED_DOT}")
_END = re.compile(rf"(?:[a-z]{{2}}|{_any(ENDS)})\Z")
_FRAME = re.compile(rf"[\[({{<][ \t]*(?:(?P<at>{_any(AT)}|@)|{_any(DOT)}|\.)[ \t]*[\])}}>]")
# "name @ host . domain", and the words joined by one mark: "name_at_host_dot_domain"
_APART = re.compile(rf"(?<=[a-z0-9._%+-]){_GAP}@{_GAP}[a-z0-9-]+(?:(?:{_GAP}\.{_GAP}|\.)[a-z0-9-]+)+(?![a-z0-9])")
_APART_MARK = re.compile(rf"{_GAP}?[@.]{_GAP}?")
_LINKED = re.compile(rf"(?<=[a-z0-9])([_-]){_any(AT)}\1[a-z0-9]+(?:\1{_any(DOT)}\1[a-z0-9]+)+(?![a-z0-9])")
_LINKED_MARK = re.compile(rf"[_-](?:(?P<at>{_any(AT)})|{_any(DOT)})[_-]")
# four numbers with words for dots between
_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_BARE_DOT}|{_FRAMED_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")
# what follows a rewritten or plain @
_HOSTS = re.compile(rf"(?<=[a-z0-9._%+-]@){_HOST}(?:{_BARE_DOT}{_HOST})+(?![a-z0-9])")
# whole runs of spelled digits and numerals; _enough() decides
_SPELLED = re.compile(rf"{_ALONE[0]}(?=[{''.join(sorted({w[0] for w in SPELLED}))}]){_any(SPELLED)}{_ALONE[1]}")
_DIGIT = rf"(?:(?:{_any(TIMES)}[ \t-]+)?{_any(SPELLED)}|[0-9]+){_ALONE[1]}"
_RUN = re.compile(rf"{_ALONE[0]}(?:{_any(PLUS)}(?:[ \t-]+|{_GAP}))?{_DIGIT}(?:(?:[ \t-]+|{_GAP}){_DIGIT})*")
_PART = re.compile(rf"{_any([*PLUS, *SPELLED, *TIMES])}|[0-9]+")
# numbers with letters among their digits
_MIXED = re.compile(r"(?<![A-Za-z0-9_])[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl])+(?![A-Za-z0-9_])")


def _enough(parts: list[str], plus: bool) -> bool:
    """Whether a run of spelled digits and numerals is taken for a number: four spelled ones, or fewer in one as long as a phone's or card's."""
    spelled = sum(p in SPELLED for p in parts)
    size = lambda p, before: TIMES.get(before, 1) if p in SPELLED else len(p)
    digits = sum(size(p, before) for p, before in zip(parts, ["", *parts], strict=False) if p not in PLUS and p not in TIMES)
    return spelled >= 4 or spelled and digits >= (9 if plus else 12)


class _Rewritten:
    """A text in the making and its pieces.

    A piece (at, start, end): from position `at` of the result on, the source's [start, end). Pieces of
    equal length on both sides are copies; others stand for one character each.
    """

    def __init__(self, text: str):
        self.source_text, self.out, self.pieces, self.size, self.done = text, [], [], 0, 0

    def put(self, new: str, start: int, end: int) -> None:
        """`new` for the source's [start, end); what lies before is copied."""
        if self.done < start:
            copied, self.done = self.done, start
            self.put(self.source_text[copied:start], copied, start)
        self.done = end
        if new:
            self.out.append(new)
            self.pieces.append((self.size, start, end))
            self.size += len(new)

    def finished(self) -> str | None:
        """The result; None if nothing was rewritten."""
        if not self.done:
            return None
        self.put("", len(self.source_text), len(self.source_text))
        self.text, self.starts = "".join(self.out), [p[0] for p in self.pieces]
        return self.text

    def source(self, position: int) -> tuple[int, int]:
        at, start, end = self.pieces[i := bisect_right(self.starts, position) - 1]
        length = (self.starts[i + 1] if i + 1 < len(self.starts) else self.size) - at
        return (start + position - at, start + position - at + 1) if length == end - start else (start, end)


def _glyphs(text: str, new: _Rewritten) -> None:
    for m in _GLYPH.finditer(text):
        new.put(_plain(m[0]), *m.span())


_GAP_BEFORE, _GAP_AFTER = re.compile(rf"(?<![ \t\n]){_GAP}\Z"), re.compile(_GAP)


def _spaces(text: str, start: int, end: int) -> tuple[int, int]:
    """The span with the blanks around it, over one line end on either side."""
    before, after = _GAP_BEFORE.search(text, max(0, start - 200), start), _GAP_AFTER.match(text, end)
    return before.start() if before else start, after.end() if after else end


def _lowered(text: str) -> str:
    """In lower case, character by character where a whole text would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _addresses(text: str, new: _Rewritten) -> None:
    text = _lowered(text)
    if not any(w in text for w in (*DOT, *"[({<")):  # each match has one of them
        return
    for m in _BARE.finditer(text):
        name = _BEFORE.search(text, max(new.done, m.start() - 300), m.start())
        bare = any(text[p.start() : p.end()].strip().isalpha() for p in _ANY_DOT.finditer(text, m.start(), m.end()))
        if not name or name[1] in NO_NAMES or bare and not _END.search(re.split(r"[^a-z0-9-]", m[0])[-1]):
            continue
        for p in _ANY_DOT.finditer(text, *name.span(1)):
            new.put(".", *p.span())
        at_end = _BARE_AT.match(text, m.start()).end()
        new.put("@", name.end(1), at_end)
        for p in _ANY_DOT.finditer(text, at_end, m.end()):
            new.put(".", *p.span())


def _apart(text: str, new: _Rewritten) -> None:
    low = _lowered(text) if "@" in text else ""
    for m in _APART.finditer(low) if " @" in low or "@ " in low or "\n@" in low or "@\n" in low else ():
        if _END.search(re.split(r"[^a-z0-9-]", m[0])[-1]) and re.search(r"[a-z0-9._%+-]+\Z", low[max(0, m.start() - 100) : m.start()])[0] not in NO_NAMES:
            for p in _APART_MARK.finditer(low, *m.span()):
                new.put(p[0].strip(), *p.span())


def _linked(text: str, new: _Rewritten) -> None:
    if "_" not in text and "-" not in text:
        return
    for m in _LINKED.finditer(_lowered(text)):
        for p in _LINKED_MARK.finditer(_lowered(text), *m.span()):
            new.put("@" if p["at"] else ".", *p.span())


def _quads(text: str, new: _Rewritten) -> None:
    low = _lowered(text)
    if any(w in low for w in (*DOT, *"[({<")):
        for m in _QUAD.finditer(low):
            for p in _ANY_DOT.finditer(low, *m.span()):
                new.put(".", *p.span())


def _frames(text: str, new: _Rewritten) -> None:
    for m in _FRAME.finditer(_lowered(text)):
        start, end = _spaces(text, *m.span())
        if start >= new.done or m.start() >= new.done:
            new.put("@" if m["at"] else ".", max(start, new.done), end)


def _digits(text: str, new: _Rewritten) -> None:
    text = _lowered(text)
    if not _SPELLED.search(text):
        return
    for m in _RUN.finditer(text):
        found = [(p[0], p.span()) for p in _PART.finditer(text, *m.span())]
        parts = [p for p, _ in found]
        if not _enough(parts, parts[0] in PLUS or text[m.start() - 1 : m.start()] == "+"):
            continue
        before = times = None
        for p, (start, end) in found:
            if p in TIMES:
                times = TIMES[p], start
                continue
            if times:
                start = times[1]
            if before is not None and (p.isdigit() or before[0].isdigit()) and before[0] not in PLUS:
                new.put(" ", before[1], start)
            elif before is not None:
                new.put("", before[1], start)
            new.put(text[start:end] if p.isdigit() else SPELLED.get(p, "+") * (times[0] if times else 1), start, end)
            before, times = (p, end), None


def _letters(text: str, new: _Rewritten) -> None:
    for m in _MIXED.finditer(text):
        letters = sum(c in LETTERS for c in m[0])
        if letters and sum(c.isdigit() for c in m[0]) >= 2 * letters:
            for i, c in enumerate(m[0], m.start()):
                if c in LETTERS:
                    new.put(LETTERS[c], i, i + 1)


def _hosts(text: str, new: _Rewritten) -> None:
    if "@" not in text:
        return
    text = _lowered(text)
    for m in _HOSTS.finditer(text):
        for p in _ANY_DOT.finditer(text, *m.span()):
            new.put(".", *p.span())


def rewrite(text: str) -> list[_Rewritten]:
    """The text without disguises, step by step: each rule sees what those before have made of it. Empty if it has none."""
    steps = []
    for rule in (_glyphs, _addresses, _apart, _linked, _frames, _quads, _digits, _letters, _hosts):
        rule(text, new := _Rewritten(text))
        if (plain := new.finished()) is not None:
            text = plain
            steps.append(new)
    return steps


def all_spans(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans and those found behind disguises, by start, then kind."""
    base = base_spans(text) if base is None else base
    steps = rewrite(text)
    if not steps:
        return base

    def source(start: int, end: int) -> tuple[int, int]:
        for step in reversed(steps):
            start, end = step.source(start)[0], step.source(end - 1)[1]
        return start, end

    added = {(*source(s, e), k) for s, k, e in base_spans(steps[-1].text)} - {(s, e, k) for s, k, e in base}
    starts = [[s for s, n, _ in base if n == k] for k in range(len(KINDS))]
    ends = [[e for _, n, e in base if n == k] for k in range(len(KINDS))]  # spans of a kind do not overlap

    def new(s: int, e: int, k: int) -> bool:
        """Whether each base span of its kind that it meets lies within it."""
        met = slice(bisect_right(ends[k], s), bisect_left(starts[k], e))
        return all(s <= b and z <= e for b, z in zip(starts[k][met], ends[k][met], strict=True))

    return sorted(base + [(s, k, e) for s, e, k in added if new(s, e, k)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    spans: kind:start:end of all spans in code points, end exclusive, by start, then kind in the order of
    KINDS, comma-joined; the n_ columns count them. base_sha256: of the same line for the base spans
    alone. n_added: spans that only the transducer shows. Null and empty texts have no spans. Repeated
    rows give repeated rows; ids may be null; other columns are left out.
    """

    def work(rows: dict) -> dict:
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in rows["t"]:
            base = base_spans(text or "")
            found = all_spans(text or "", base)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[1] == k for x in found))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(found))
            out["n_added"].append(len(found) - len(base))
        return {id_col: rows["i"], **out}

    ddl = f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(docs.selectExpr(f"cast({id_col} as long) i", f"{text_col} t"), work, ddl)
