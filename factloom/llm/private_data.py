"""Personal data by offset-preserving deobfuscation.

Base spans are found on the text itself: e-mail, IPv4, card and phone patterns,
leftmost and non-overlapping for each kind.  The patterns are scanned without
re-trying the inside of a run, so the time follows the length of the text.

The method then reads the text through transducers that undo disguises:
look-alike letters and full-width signs become ASCII, words for digits in a row
become digits, and "at"/"dot" in brackets or between blanks become signs.  A
transducer gives the normalised text and, for each of its characters, the span
of source characters that it came from; identifiers found there are mapped back
to the source.  Only spans that don't overlap a base span of their kind are
added.  Texts without any sign of a disguise are not rewritten.

Null counts as empty and gives no spans.  Every row is read by itself, so
repeated rows, and rows that share a doc_id or have none, give results of their
own; the time of a very long text follows its length.  An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .workers import bounded_batches, lean

KINDS = ("email", "ip", "card", "phone")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start; failing matches are dropped, without another try."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        # leading zeros, of which there may be any number, don't count
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Look-alikes, fixed values: Cyrillic and Greek letters drawn like Latin ones; full-width signs follow a rule.
_TWINS = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTXIJSaovptuikABEZHIKMNOPTYX"))
_TWINS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_TWINS |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-"}
_NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}

_ANY_TWIN = re.compile("[" + "".join(map(re.escape, _TWINS)) + "]")
_NUMBER = "(?:" + "|".join(_NUMBERS) + ")"
# A row of at least four words for digits, or of digits and such words.
_SPELLED = re.compile(rf"(?<![A-Za-z]){_NUMBER}(?![A-Za-z])(?:[ ,.-]{{1,2}}(?:{_NUMBER}|[0-9])(?![A-Za-z]))*+", re.I)
# In brackets, which may share a blank between them; the group tells "at" from "dot".
_BRACKETS = re.compile(r"[ ]?[\[({<][ ]?(?:(at|@)|dot|\.)[ ]?[\])}>][ ]?", re.I)
# Between blanks: "name at host dot tld", "name at host.tld", and "10 dot 0 dot 0 dot 1"
_SAID = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+( at )[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)*(?: dot |\.)[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)
_SAID_BETWEEN_DIGITS = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)
_SIGNS = re.compile(r"[\[({<][ ]?(?:at|@|dot|\.)[ ]?[\])}>]| dot | at [a-z0-9-]+\.[a-z0-9]|(?<![a-z])(?:" + "|".join(_NUMBERS) + r")[ ,.-]{1,2}(?:" + "|".join(_NUMBERS) + r"|[0-9])(?![a-z])", re.I)


def _edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement), in order and without overlaps."""
    found = [(m.start(), m.end(), _TWINS[m[0]]) for m in _ANY_TWIN.finditer(text)]
    found += [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETS.finditer(text)]
    found += [(m.start(), m.end(), ".") for m in _SAID_BETWEEN_DIGITS.finditer(text)]
    for m in _SAID.finditer(text):
        found.append((m.start(1), m.end(1), "@"))
        found += [(m.end(1) + d.start(), m.end(1) + d.end(), ".") for d in re.finditer(" dot ", text[m.end(1) : m.end()], re.I)]
    for m in _SPELLED.finditer(text):
        words = list(re.finditer(r"[A-Za-z]+|[0-9]", m[0]))
        if len(words) < 4:
            continue
        for k, w in enumerate(words):
            # what stands between two digits goes with the first of them
            end = words[k + 1].start() if k + 1 < len(words) else w.end()
            found.append((m.start() + w.start(), m.start() + end, _NUMBERS.get(w[0].lower(), w[0])))
    out, last = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


def transduce(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The normalised text, and its segments (start there, start in source, source length or -1 where both run alike)."""
    parts, segments, at, n = [], [], 0, 0
    for a, b, to in _edits(text):
        if a > at:
            parts.append(text[at:a])
            segments.append((n, at, -1))
            n += a - at
        parts.append(to)
        segments.append((n, a, b - a))
        n += len(to)
        at = b
    if at < len(text):
        parts.append(text[at:])
        segments.append((n, at, -1))
    return "".join(parts), segments


def _source(segments, at: int, is_end: bool) -> int:
    import bisect

    probe = at - 1 if is_end else at
    n, source, length = segments[bisect.bisect_right(segments, probe, key=lambda s: s[0]) - 1]
    if length < 0:
        return source + probe - n + is_end
    return source + length if is_end else source


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by kind and start."""
    base = base_spans(text)
    if not (_SIGNS.search(text) or (not text.isascii() and _ANY_TWIN.search(text))):
        return base, base
    plain, segments = transduce(text)
    if plain == text:
        return base, base
    added = []
    for kind, a, b in base_spans(plain):
        a, b = _source(segments, a, False), _source(segments, b, True)
        while b > a and text[b - 1] == " ":
            b -= 1
        added.append((kind, a, b))
    by_kind = {k: [s for s in base if s[0] == k] for k in KINDS}
    for s in added:
        if not any(s[1] < o[2] and o[1] < s[2] for o in _near(by_kind[s[0]], s)):
            by_kind[s[0]].append(s)
            by_kind[s[0]].sort()
    return base, [s for k in KINDS for s in by_kind[k]]


def _near(spans, s):
    """The sorted, disjoint spans that could overlap s."""
    import bisect

    i = bisect.bisect_left(spans, s[1], key=lambda o: o[2])
    j = bisect.bisect_right(spans, s[2], key=lambda o: o[1])
    return spans[max(0, i - 1) : j + 1]


def span_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(tables):
    for t in tables:
        rows = []
        for doc_id, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            base, every = all_spans(text or "")
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(every)))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans: one row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_found), SCHEMA)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]
