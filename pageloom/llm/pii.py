"""Personal data, also in disguise, with spans in the source text.

Base detection applies four patterns to the text as it stands.  For disguises, transducers
rewrite a copy of the text, each output character remembering the source characters it
stands for: homoglyphs, full-width forms and foreign digits become ASCII, invisible
characters vanish, runs of spelled digits become digits, and at/dot disguises become @ and
a point.  The same patterns run over the copy, and what they find is mapped back to source
characters.  A span is added only if it holds rewritten characters and reaches beyond any base span of its kind; base spans
always stay.

Rows are judged one by one: a null text is empty, repeated rows give repeated results, an
empty table an empty result, a null doc_id is kept and further columns are not read.  Very long texts are
read whole, in time that grows with their length.  Finds that start together are listed by kind, then end.  Spans count code
points, ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pageloom.llm import bytehash as bh

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the four kinds, written so that long runs are read once: an address is found by its at sign, the
#: local part before it then taken backwards; a number starts at the start of its run (no later start can match where that fails).
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Latin letters that these resemble.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "υ": "u", "ν": "v", "ο": "o", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "τ": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "﹫": "@",
}
INVISIBLE = "​‌‍⁠﻿­"

#: Spelled digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SPELLED = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_AT, _DOT = r"(?:at|arroba|arobase|klammeraffe)", r"(?:dot|punkt|point|punto)"
_SPACE = r"[ \t]{1,3}"
#: "at" and "dot" are plain words too, and a site is often named after "at" (look at example.com).  So a bare "at" stands for the sign only with a second sign
#: of disguise: a name that is no word (anna.b, anna7) or is one of an office, or a name that isn't among the words that usually stand before a place
#: (verbs, pronouns, adverbs, and all that ends in -ing, -ed or -ly) before an address with a known ending.
#: Endings; endings that are words as well; domains of mailboxes; offices; words that stand before "at" in plain text.
_TOP = r"(?:com|org|net|edu|gov|mil|info|biz|name|museum|travel|mobi|aero|coop|asia|email|blog|news|wiki|agency|pro|io|co|ai|dev|app|xyz|online|site|tech|cloud|shop|test|example|ae|ar|br|ca|ch|cl|cn|cz|de|dk|ee|es|eu|fi|fr|gr|hk|hr|hu|id|ie|il|ir|jp|ke|kr|li|lt|lu|lv|mx|my|ng|nl|nz|ph|pk|pl|pt|ro|rs|ru|sa|se|sg|si|sk|th|tr|tv|tw|ua|uk|vn|za)"
_WORDLY = r"(?:it|in|is|be|at|us|me|no|as|so)"
_MAILBOX = r"(?:gmail|googlemail|yahoo|ymail|hotmail|outlook|live|msn|aol|icloud|protonmail|proton|gmx|web|posteo|mailbox|t-online|freenet|orange|wanadoo|laposte|free|terra|telefonica|libero|mail|yandex|qq|163|zoho|fastmail)"
_OFFICE = r"(?:info|sales|support|admin|office|help|helpdesk|press|jobs|careers|billing|abuse|webmaster|postmaster|privacy|legal|service|enquiries|inquiries|feedback|newsletter|noreply|kontakt|presse|vertrieb|contacto|ventas)"
_BEFORE = r"(?:look|looks|live|lives|arrive|arrives|arrival|available|visible|present|find|found|buy|bought|sell|sold|meet|meets|met|see|seen|read|visit|shop|host|start|starts|stop|stops|stay|stays|work|works|study|point|points|aim|laugh|good|bad|best|worst|least|most|last|early|late|open|closed|free|here|there|home|us|me|him|her|them|it|you|out|up|down|in|on|off|all|not|and|or|but|only|even|also|just|still|is|are|was|were|be|been|am|more|download|downloads|page|site|blog|store|today|now|then|online|read|docs|documentation|one|two|that|this|these|those|what|back|away|code|source|project|demo|order|sign|log|join|play|mirror|website|homepage|apply|register|check|click|search|browse|ask|chat|enroll|subscribe|donate|vote|book|shows|news|people|everyone|everything|something|nothing|it's|located|price|prices|again|yesterday|tonight|tomorrow|later|earlier|soon|always|never|often|once|twice|around|together|alone|inside|outside|above|below|as|to|for|of|with|by|from|so|yes|no|first|website|link|links|form|list|archive|archives|forum|community|team|users|hosting|us|we|they|he|she|i|who|which|watch|listen|learn|try|get|got|eat|ate|sat|sit|stand|stood|sleep|slept|wait|waits|spend|spent|gone|go|went|years|hours|time|much|little|\w+(?:ing|ed|ly))"
_NO_LABEL = r"(?:the|a|an|this|that|these|those|some|any|one|each|every|what|which|no|my|your|his|her|its|our|their|another|certain|same|home|all|least|last|first|most|best)"
_LABELS = r"[A-Za-z0-9-]+(?:(?:\.|" + _SPACE + _DOT + _SPACE + r")[A-Za-z0-9-]+){0,4}?"
_END = r"(?![A-Za-z0-9-])"
_SPELLED_END = _SPACE + _DOT + _SPACE
_ANY_END = r"(?:\.|" + _SPELLED_END + r")"
#: What may follow a bare "at", by the name before it.
_AFTER_ANY = r"(?!" + _NO_LABEL + r"[ \t])(?:" + _LABELS + _SPELLED_END + r"(?:" + _TOP + "|" + _WORDLY + ")" + _END + "|" + _LABELS + r"\." + _TOP + _END + "|" + _MAILBOX + _ANY_END + _TOP + _END + ")"
_AFTER_NAME = _LABELS + _ANY_END + r"(?:" + _TOP + "|" + _WORDLY + ")" + _END
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"


def _folded(text: str) -> str:
    """Lower case, as patterns that ignore case see it."""
    return text.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")


_BEFORE_AT, _OFFICE_NAME, _AFTER_PLAIN = re.compile(_BEFORE, re.I), re.compile(_OFFICE, re.I), re.compile(_AFTER_ANY, re.I)


def _addressed(m: re.Match) -> bool:
    """Whether a bare "at" stands for the sign, by the name before it and what follows."""
    before = m.string[max(0, m.start() - 80) : m.start()]
    name = before[len(before.rstrip(LOCAL)) :]
    if not name.isalpha():
        return any(c.isalpha() for c in name)
    if _OFFICE_NAME.fullmatch(name):
        return True
    return not _BEFORE_AT.fullmatch(name) and bool(_AFTER_PLAIN.match(m.string, m.end()))


#: Rewriting rules in order: pattern -> what stands in its place (or a function of the match).
_RULES: list[tuple[re.Pattern, object]] = [
    (re.compile(r"&(?:#0*64|#x0*40|commat);", re.I), "@"),
    (re.compile(r"&(?:#0*46|#x0*2e|period);", re.I), "."),
    (re.compile(_OPEN + r"(?:" + _AT + r"|@)" + _CLOSE, re.I), "@"),
    (re.compile(_OPEN + r"(?:" + _DOT + r"|\.)" + _CLOSE, re.I), "."),
    (re.compile(r"(?<=[A-Za-z0-9])_" + _AT + r"_(?=[A-Za-z0-9-]+(?:_" + _DOT + r"_[A-Za-z0-9-]+)+)", re.I), "@"),
    (re.compile(r"(?<=[A-Za-z0-9])_" + _DOT + r"_(?=[A-Za-z0-9])", re.I), "."),
    (re.compile(r"(?<=[A-Za-z0-9._%+-])" + _SPACE + _AT + _SPACE + "(?=" + _AFTER_NAME + ")", re.I), "@"),
    (re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}@[ \t]{1,3}(?=[A-Za-z0-9-]+(?:[ \t]{0,2}\.[ \t]{0,2}[A-Za-z0-9-]+){0,3}?[ \t]{0,2}\.[ \t]{0,2}(?:com|org|net|edu|gov|info|example)\b)"), "@"),
    (re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,2}\.[ \t]{1,2}(?=(?:com|org|net|edu|gov|info|example)\b)"), "."),
    (re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}" + _DOT + r"[ \t]{1,3}(?=[A-Za-z0-9])", re.I), "."),
    (re.compile(r"\b" + _SPELLED + r"(?:[ \t,-]{1,3}" + _SPELLED + r"){2,}\b", re.I), lambda m: "".join(DIGITS[_folded(w)] for w in re.findall(_SPELLED, m, re.I))),
    (re.compile(r"\bplus[ \t]{1,3}(?=[0-9])", re.I), "+"),
]
#: For each rule, what the folded text must hold one of; None: one of the words of digits.
_AT_WORDS, _DOT_WORDS, _DIGIT_WORDS = ("at ", "at\t", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "point", "punto"), frozenset(DIGITS)
#: The rule whose matches are looked at again.
_BARE_AT = 6
_SIGNS: list[tuple[str, ...] | None] = [("&",), ("&",), tuple("[({<"), tuple("[({<"), ("_",), ("_",), _AT_WORDS, (" @", "\t@"), (" .", "\t."), _DOT_WORDS, None, ("plus",)]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(s: str) -> bool:
    d = _only_digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 9 <= len(_only_digits(s)) <= 15


def _ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses."""
    last = 0  # the end of the last address, or the place after the last at sign if that is later
    for m in DOMAIN.finditer(text):
        at = m.start()
        first = max(last, text.rfind("@", last, at) + 1)
        start = first + len(text[first:at].rstrip(LOCAL))
        last = at + 1
        if start < at:
            last = m.end()
            yield start, last


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start."""
    out = [(0, i, j) for i, j in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if _ip(m[0])]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and _card(m[0])]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if _phone(m[0])]
    return out


def _character(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in INVISIBLE:
        return ""
    if c > "\x7f":
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            return str(digit)
        if "！" <= c <= "～":
            return chr(ord(c) - 0xFEE0)
    return c


def normalise(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """(rewritten text, source start of each character, its source end, whether it was rewritten)."""
    chars, start, end, new = [], [], [], []
    for i, c in enumerate(text):
        if (x := _character(c)) == "":
            if end:
                new[-1] = True
            continue
        chars.append(x)
        start.append(i)
        end.append(i + 1)
        new.append(x != c)
    said = "".join(chars)
    for k, (pattern, by) in enumerate(_RULES):
        parts, s, e, n, at = [], [], [], [], 0
        for m in pattern.finditer(said):
            if k == _BARE_AT and not _addressed(m):
                continue
            i, j = m.span()
            x = by(m[0]) if callable(by) else by
            parts += [said[at:i], x]
            s += start[at:i] + [start[i]] * len(x)
            e += end[at:i] + [end[j - 1]] * len(x)
            n += new[at:i] + [True] * len(x)
            at = j
        if at:
            said = "".join([*parts, said[at:]])
            start, end, new = s + start[at:], e + end[at:], n + new[at:]
    return said, start, end, new


def suspicious(text: str) -> bool:
    """Whether normalise would rewrite anything: an odd character, or a match of the first rule to apply; no other text is rewritten."""
    if not text.isascii() and any(c > "\x7f" and _character(c) != c for c in set(text)):
        return True
    low = _folded(text)
    for k, ((pattern, _), signs) in enumerate(zip(_RULES, _SIGNS, strict=True)):
        if signs is None:
            there = not _DIGIT_WORDS.isdisjoint(low.replace(",", " ").replace("-", " ").split())
        else:
            there = any(s in low for s in signs)
        if there and (any(map(_addressed, pattern.finditer(text))) if k == _BARE_AT else pattern.search(text)):
            return True
    return False


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (kind's number, start, end) by kind, then start."""
    text = text or ""
    base = detect(text)
    if not suspicious(text):
        return base, base
    said, start, end, new = normalise(text)
    more = []
    for kind, i, j in detect(said):
        a, b = start[i], end[j - 1]
        if any(new[i:j]) and not any(k == kind and x <= a and b <= y for k, x, y in base):
            more.append((kind, a, b))
    return base, sorted({*base, *more})


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of structs kind, start, end) for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in bh.tidy(batches):
            found = [find(t) for t in b["text"]]
            named = lambda x: [(KINDS[k], i, j) for k, i, j in x]
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": pd.Series([named(x[0]) for x in found], dtype=object), "spans": pd.Series([named(x[1]) for x in found], dtype=object)})

    span = "array<struct<kind: string, start: int, end: int>>"
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if j <= at:
            continue
        if i >= at:
            out += [text[at:i], f"[{KINDS[kind].upper()}]"]
        at = j
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE]; a null text stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in bh.tidy(batches):
            b.isetitem(at, [t if t is None or t != t else masked(t, find(t)[1]) for t in b.iloc[:, at]])
            yield b

    return docs.mapInPandas(run, docs.schema)
