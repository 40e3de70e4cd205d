"""Personal data with source offsets, plain or disguised.

Plain identifiers are found in the text as it stands. A chain of transducers then rewrites
disguises - look-alike characters, spelled digits, "at" and "dot" - and keeps, for every
character it writes, the span of source characters it came from. The same detectors run on
the rewritten text, and what they find is mapped back to source offsets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_column, map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterable[Span]:
    """From each @ the local part is read backwards, so no run of characters is tried twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield "email", start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterable[Span]:
    """Every four numbers of a dotted run are one match; those with a part over 255 are dropped."""
    for run in DOTTED.finditer(text):
        numbers, at = run[0].split("."), run.start()
        for k in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[k : k + 4])) + 3
            if all(len(n := x.lstrip("0")) < 3 or len(n) == 3 and n <= "255" for x in numbers[k : k + 4]):
                yield "ip", at, at + size
            at += size + 1


def luhn(digits: list[int]) -> bool:
    back = digits[::-1]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def cards(text: str) -> Iterable[Span]:
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = [int(c) for c in m[0] if c not in " -"]
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterable[Span]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def detect(text: str) -> list[Span]:
    """Plain identifiers: leftmost and not overlapping within a kind, failing matches dropped."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if any(d in text for d in "0123456789"):
        found += addresses(text)
        found += cards(text)
        if "+" in text:
            found += phones(text)
    return ordered(found)


# Letters of other scripts that look like Latin ones, and words of disguises.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "•": ".",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "un": "1",
}
ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "xyz", "online", "site", "shop", "store", "tech", "blog", "cloud", "example", "test", "invalid", "localhost")
#: Words of two letters that are no country's ending after a spoken dot; all other two letters are.
WORDS = frozenset("is he we an as or of on if my by go up to so no do am hi ok oh".split())
AT_WORDS, DOT_WORDS, TIMES = ("at", "arroba", "arobase"), ("dot", "punto", "point", "punkt"), {"double": 2, "triple": 3}

HIDDEN = re.compile(f"[{INVISIBLE}{''.join(map(re.escape, LOOKALIKES))}٠-٩۰-۹०-९ -   -⁠⁰-ₜ①-⒛　﹐-﹫！-～𝐀-𝟿]")
OPEN, CLOSE = r"(?<!\s)\s*[\[({<]\s*", r"\s*[\])}>]\s*"  # from the start of a run of space alone, so that it's read once
BRACKETED = re.compile(rf"(?i){OPEN}(?:(?P<at>@|{'|'.join(AT_WORDS)})|(?P<dot>\.|{'|'.join(DOT_WORDS)})){CLOSE}")
DOT = rf"\s+(?:{'|'.join(DOT_WORDS)})\s+"
SPOKEN_AT = re.compile(rf"(?i)\s(?:{'|'.join(AT_WORDS)})\s")
CHAIN = re.compile(rf"(?i)[a-z0-9_%+-]+(?:(?:{DOT}|\.)[a-z0-9_%+-]+)*")
SPOKEN_DOT = re.compile(rf"(?i){DOT}")
NUMERAL = rf"(?:(?:{'|'.join(TIMES)})\s+)?(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|[0-9]+)"
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus\s+)?{NUMERAL}(?:(?:\s*[-,.]\s*|{DOT}|\s+){NUMERAL})+(?![^\W_])")
TOKEN = re.compile(rf"(?i)({'|'.join(TIMES)})\s+|(?<=\s)(?P<dot>{'|'.join(DOT_WORDS)})(?=\s)|[^\W\d_]+|[0-9]|[.]|[^\w.]+")
CUES = (*(f"{w[:4]}" for w in DOT_WORDS), *AT_WORDS[1:])


class Tape:
    """A text and where its characters come from in the source.

    Segments begin at ``at``: one that ends at -1 runs on in the source character by character,
    any other is one character that stands for a whole span. Memory grows with the rewritten
    places, not with the text.
    """

    def __init__(self, text: str, at=(0,), first=(0,), end=(-1,)):
        self.text, self.at, self.first, self.end = text, array("q", at), array("q", first), array("q", end)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters from a to b come from."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.first[i] + (a - self.at[i] if self.end[i] < 0 else 0)
        return start, self.first[j] + b - self.at[j] if self.end[j] < 0 else self.end[j]

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Tape:
        """Replace spans (start, end) by pieces (character, start, end), in order of start."""
        if not edits:
            return self
        text, size, done = [], 0, 0
        made = Tape("", (), (), ())

        def add(first: int, end: int) -> None:
            made.at.append(size)
            made.first.append(first)
            made.end.append(end)

        k = 0
        for a, b, pieces in [*edits, (len(self.text), len(self.text), [])]:
            while done < a:  # what stays, segment by segment
                while k + 1 < len(self.at) and self.at[k + 1] <= done:
                    k += 1
                stop = min(a, self.at[k + 1] if k + 1 < len(self.at) else a)
                add(self.first[k] + (done - self.at[k] if self.end[k] < 0 else 0), self.end[k])
                text.append(self.text[done:stop])
                size, done = size + stop - done, stop
            for c, x, y in pieces:
                add(*self.span(x, y))
                text.append(c)
                size += 1
            done = b
        made.text = "".join(text)
        return made


@lru_cache(maxsize=4096)
def plain(char: str) -> str:
    """The ASCII characters that a character stands for, none if it is invisible, else itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if (d := unicodedata.digit(char, -1)) >= 0:
        return str(d)
    same = unicodedata.normalize("NFKC", char)
    return same if same.isascii() else char


def unmask(tape: Tape) -> Tape:
    """Look-alikes, wide forms and foreign digits become ASCII; invisible characters go."""
    return tape.rewrite([(m.start(), m.end(), [(c, m.start(), m.end()) for c in plain(m[0])]) for m in HIDDEN.finditer(tape.text)])


def country_or_known(label: str) -> bool:
    label = label.lower()
    return label in ENDINGS or len(label) == 2 and label.isalpha() and label not in WORDS


def punctuate(tape: Tape) -> Tape:
    """[at], (dot) and the like; bare words only in the shape of a whole address: x at y dot z, x dot w@y dot z.

    A bare "at" before a domain with real dots stays: it's how texts speak of sites.
    """
    tape = tape.rewrite([(m.start(), m.end(), [("@" if m["at"] else ".", m.start(), m.end())]) for m in BRACKETED.finditer(tape.text)])
    text, edits = tape.text, []
    if "@" not in text and not SPOKEN_AT.search(text):
        return tape
    links = list(CHAIN.finditer(text))
    for k, domain in enumerate(links[1:], 1):
        local, between = links[k - 1], text[links[k - 1].end() : domain.start()]
        at = (local.end(), domain.start())
        if local[0].lower() in AT_WORDS and k > 1 and between.isspace():
            local = links[k - 2]
            gap = text[local.end() : links[k - 1].start()]
            if not gap or not gap.isspace():
                continue
            at, bare = (local.end(), domain.start()), True
        elif between.strip() == "@":
            bare = False
        else:
            continue
        dots = list(SPOKEN_DOT.finditer(text, domain.start(), domain.end()))
        stops = [m.start() for m in dots[1:]] + [domain.end()]
        # the domain goes on to the last spoken dot that an ending follows
        last = max((i for i, d in enumerate(dots) if country_or_known(text[d.end() : stops[i]].split(".")[-1])), default=-1)
        if bare and last < 0:
            plain = text[domain.start() : dots[0].start() if dots else domain.end()]
            written = any(b - a > 1 for i, c in enumerate(plain, domain.start()) if c == "." for a, b in [tape.span(i, i + 1)])
            if not written or not country_or_known(plain.split(".")[-1]):
                continue
        before = list(SPOKEN_DOT.finditer(text, local.start(), local.end()))
        if not bare and last < 0 and not (before and "." in domain[0]):
            continue
        edits += [(m.start(), m.end(), [(".", m.start(), m.end())]) for m in before]
        edits.append((*at, [("@", *at)]))
        edits += [(m.start(), m.end(), [(".", m.start(), m.end())]) for m in dots[: last + 1]]
    done, clear = 0, []
    for e in edits:  # a chain between two addresses belongs to the first
        if e[0] >= done:
            clear.append(e)
            done = e[1]
    return tape.rewrite(clear)


def digits(tape: Tape) -> Tape:
    """Runs of seven or more digits, or of four numbers with dots, that are partly words become digits; plus and dots stay."""
    edits = []
    for run in SPELLED.finditer(tape.text):
        if not re.search(r"(?i)[a-zé]", run[0]):
            continue
        pieces: list[tuple[str, int, int]] = []
        times, since = 1, None
        for t in TOKEN.finditer(tape.text, run.start(), run.end()):
            word = t[0].lower()
            if t[1]:
                times, since = TIMES[t[1].lower()], t.start()
                continue
            if word in DIGIT_WORDS or word.isdigit():
                pieces += [(DIGIT_WORDS.get(word, word), t.start() if since is None else since, t.end())] * times
            elif word == "plus" or word == "." or t["dot"]:
                pieces.append(("+" if word == "plus" else ".", t.start(), t.end()))
            times, since = 1, None
        text = "".join(c for c, _, _ in pieces)
        if sum(map(str.isdigit, text)) >= 7 or text.count(".") >= 3:
            edits.append((run.start(), run.end(), pieces))
    return tape.rewrite(edits)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the rewritten text shows, as source spans that no span of ``base`` holds."""
    low = text.lower()
    masked = not text.isascii() and HIDDEN.search(text)
    dotted = any(c in low for c in CUES) or any(b in text for b in "[({<") and BRACKETED.search(text)
    spelled = not DIGIT_WORDS.keys().isdisjoint(low.replace("-", " ").replace(",", " ").replace(".", " ").split())
    if not (masked or dotted or spelled):
        return []
    tape = source = Tape(text)
    for step in (unmask, punctuate, digits):
        tape = step(tape)
    if tape is source:
        return []
    found = [(kind, *tape.span(a, b)) for kind, a, b in detect(tape.text)]
    return outside(found, base)


def outside(found: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``found`` that lie in no span of ``base``, in their order: one sweep over both by where they start."""
    held, at, furthest = set(), 0, -1
    starts = sorted((a, b) for _, a, b in base)
    for k in sorted(range(len(found)), key=lambda k: found[k][1]):
        _, start, end = found[k]
        while at < len(starts) and starts[at][0] <= start:
            furthest = max(furthest, starts[at][1])  # of what starts no later, how far any reaches
            at += 1
        if end <= furthest:
            held.add(k)
    return [f for k, f in enumerate(found) if k not in held]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans; a null text has none. Offsets are code points, ends exclusive."""
    base = detect(text or "")
    return base, ordered([*base, *disguised(text or "", base)])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts of plain spans by kind, a digest of them, and all spans, for each row of ``docs``.

    No shuffle. Null and empty texts have no spans; very long texts are read whole, in time
    linear in their length. Repeated rows and ids are scanned each by itself; of spans that
    start together the kinds' order decides. A disguised span may overlap a plain one that is
    part of it; both are given. Other columns of ``docs`` are not read.
    """

    def rows(doc_id: list, text: list) -> dict[str, list]:
        made = [find(t) for t in text]
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in made] for k in KINDS}
        return {"doc_id": doc_id} | counts | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in made], "spans": [joined(s) for _, s in made]}

    names = ["doc_id", *(f"n_{k}" for k in KINDS)]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())])
    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"]), rows, schema, ", ".join(f"{n} bigint" for n in names) + ", base_sha256 string, spans string")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the first one counts."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in find(text)[1]:
        if a >= at:  # else it goes on from the span before, whose mark stands for both
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in text; all rows and other columns as they are.

    Null and empty texts stay, very long ones are read whole, repeated rows are each changed.
    """
    return map_column(docs, "text", lambda texts: [redacted(t) for t in texts])


def length(text: Column) -> Column:
    """Code points of a text, as the table of documents counts them."""
    return F.length(text)
