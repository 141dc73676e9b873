"""Disguises that need more than one rule, and plain sentences that hold none."""

import random

import pytest

from folio.llm import pii


@pytest.mark.parametrize("text, kind", [
    ("joe @ mail . org", 0), ("joe@mail dot org", 0), ("10 dot 0 dot 0 dot 1", 1), ("10[.]0[.]0(dot)1", 1), ("𝐣𝐨𝐞@mail.org", 0), ("joe_at_mail_dot_org", 0), ("joe-at-mail-dot-co-dot-uk", 0), ("joe at mail dot\norg", 0),
    ("joe\nat mail dot org", 0), ("joe at mail dot org", 0), ("+1 double five five one two three four five six seven", 3), ("plus one double five triple two one two three four", 3), ("first dot last at mail dot org", 0),
    ("ｊｏｅ＠ｍａｉｌ．ｏｒｇ", 0), ("anna.b ät firma punkt de", 0), ("m.d arobase poste point fr", 0), ("ana arroba correo punto es", 0), ("+٤٩ ٣٠ ١٢٣٤٥٦٧", 3), ("ＡＢ@ⓜail.org", 0), ("4111 1111 1111 1111", 2),
])
def test_disguise(text, kind):
    for before, after in (("", ""), ("Ä: ", ", und"), ("line\n", "\nline"), ("(", ")")):
        found = pii.all_spans(before + text + after)
        assert found == [(len(before), kind, len(before) + len(text))], (before + text + after, found)


@pytest.mark.parametrize("text, base, added", [("jοe@mail.org", "e@mail.org", "jοe@mail.org"), ("ⓙoe@mail.org", "oe@mail.org", "ⓙoe@mail.org"), ("joe@mail.co dot uk", "joe@mail.co", "joe@mail.co dot uk"), ("a@b.co [dot] uk", "a@b.co", "a@b.co [dot] uk")])
def test_a_longer_span_is_added_to_the_base_one(text, base, added):
    around = f"x {text} y"
    assert {around[s:e] for s, _, e in pii.all_spans(around)} == {base, added}
    assert pii.base_spans(around) == [x for x in pii.all_spans(around) if around[x[0] : x[2]] == base]


PLAIN = """look at google dot com
meet me at saint-denis point final
we met at noon dot
She arrived at nine point five percent and left at one
see you @ home . we go
the dot com boom was at its height
5 @ 3 . 20 each
call one two three if you can
foo™ bar … 1² m
We stayed at hotel dot com in May
Version 1 dot 2 dot 3 is out
er wartete am Bahnhof punkt zwölf und ging um eins
Sie ist at home punkt aus
eins zwei drei vorbei
Rencontre à Paris point com et puis un deux trois
il est arobase point
Nos vemos aquí punto final y uno dos tres
está at casa punto es
look_at_me and look-at-this
snake_at_rest_dot_product is a name""".split("\n")


def test_plain_sentences_hold_nothing():
    for text in PLAIN[:-1]:
        assert pii.all_spans(text) == [], text
    together = "\n".join(PLAIN[:-1])
    assert pii.all_spans(together) == [], [together[s:e] for s, _, e in pii.all_spans(together)]


def test_spans_lie_within_the_text_and_hold_the_base():
    r = random.Random(3)
    pieces = ["joe", " at ", "@", " @ ", "mail", " dot ", ".", " . ", "org", "\n", "[at]", "(dot)", "_at_", "_dot_", "𝐣", "ⓙ", "о", "10", " one", " two", " double", " plus", "+", "4111", " ", " ", "com", "look", "-", "，"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(16)))
        found, base = pii.all_spans(text), pii.base_spans(text)
        assert set(base) <= set(found) and len(set(found)) == len(found) and all(0 <= s < e <= len(text) for s, _, e in found), text
