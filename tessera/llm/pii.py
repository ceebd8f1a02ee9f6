"""Operator 6: personal data, also where it is disguised.

Plain e-mail addresses, IP addresses, card and phone numbers are found in the
text as it stands (``base`` spans).  Then the text is rewritten by a chain of
transducers - look-alike letters and digits, spelled digits, at/dot disguises -
each of which maps every character of its output to the source characters it
stands for.  What the same patterns find in the rewritten text, over at least one
rewritten character, is mapped back and added; base spans always stay.  Spelled
digits are read twice, by themselves and together with the written digits beside
them; where the readings overlap, the longer span stays.

Spans are code points of the source, end exclusive.  Patterns are linear in the
text: each can start at one place of a run only.  Null and empty texts have no
spans; repeated rows are scanned as they come; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import by_size

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping: the longest local part before each @ that is
    free, and the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_LUHN[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Rewritten:
    """A text and, for each of its characters, the source span it stands for.

    Between edits characters map one to one, so only the edits are kept."""

    def __init__(self, text: str, edits: list[tuple[int, int, int, int]] | None = None):
        self.text = text
        #: (start, end) in this text and (start, end) in the source, ascending
        self.edits = edits or []
        self.starts, self.ends = [e[0] for e in self.edits], [e[1] for e in self.edits]

    def source(self, start: int, end: int) -> Span:
        """The source characters behind [start, end), whole edits included."""
        i = bisect_right(self.starts, start) - 1
        if i >= 0 and start < self.edits[i][1]:
            a = self.edits[i][2]
        else:
            a = start + (self.edits[i][3] - self.edits[i][1] if i >= 0 else 0)
        j = bisect_left(self.starts, end) - 1
        if j >= 0 and end <= self.edits[j][1]:
            b = self.edits[j][3]
        else:
            b = end + (self.edits[j][3] - self.edits[j][1] if j >= 0 else 0)
        return a, b

    def touches(self, start: int, end: int) -> bool:
        """Whether an edit lies in [start, end)."""
        return bisect_right(self.ends, start) < bisect_left(self.starts, end)

    def replaced(self, found: list[tuple[int, int, str]]) -> Rewritten:
        """This text with the spans ``found`` (ascending, disjoint) replaced; edits
        that a replacement covers become part of it."""
        if not found:
            return self
        parts, edits, at, shift, k = [], [], 0, 0, 0
        old = list(self.edits)
        for a, b, new in found:
            while k < len(old) and old[k][1] <= a:
                edits.append((old[k][0] + shift, old[k][1] + shift, *old[k][2:]))
                k += 1
            if k < len(old) and old[k][0] < a:  # what is left of an edit stands for all of its source
                edits.append((old[k][0] + shift, a + shift, *old[k][2:]))
            while k < len(old) and old[k][0] < b:
                if old[k][1] > b:
                    old[k] = (b, *old[k][1:])
                    break
                k += 1
            parts += (self.text[at:a], new)
            edits.append((a + shift, a + shift + len(new), *self.source(a, b)))
            shift += len(new) - (b - a)
            at = b
        edits += [(e[0] + shift, e[1] + shift, *e[2:]) for e in old[k:]]
        return Rewritten("".join([*parts, self.text[at:]]), edits)


#: Letters that look like Latin ones.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧορ", "ABEKMHOPCTXaeopcyxijshdqwABEZHIKMNOPTYXop", strict=True))
#: Signs that stand for signs of addresses and numbers.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "－": "-", "‐": "-", "‑": "-", "–": "-", "−": "-", "＿": "_",
         " ": " ", " ": " ", " ": " "}
#: Characters that are not seen.
HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Spelled digits in English, German, French and Spanish.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
          "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
          "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
          "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
#: Words for the signs of an address or number in these languages.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase", "arrobase"), ("dot", "point", "punkt", "punto"), ("plus", "más", "mas")


def _other_forms() -> dict[str, str]:
    """Full-width letters and digits, and the decimal digits of other scripts."""
    wide = {chr(0xFEE0 + c): chr(c) for c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]}
    other = {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
    return wide | other


_FORMS = {**_other_forms(), **LOOK_ALIKES, **SIGNS, **dict.fromkeys(HIDDEN, "")}
_FORM = re.compile("[" + "".join(map(re.escape, sorted(_FORMS))) + "]")
_EDGE = "A-Za-zÀ-ÖØ-öø-ÿ"


def _one_of(words) -> str:
    """A pattern for any of some words, those that begin alike together."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, rest))})" for a, rest in sorted(by.items())) + ")"


_SPELLED = re.compile(rf"(?<![{_EDGE}]){_one_of(DIGITS)}(?![{_EDGE}])", re.I)
_A, _D, _P = map(_one_of, (AT_WORDS, DOT_WORDS, PLUS_WORDS))
_GAP = re.compile(r"[ ,-]{1,3}\Z")
_MEMBER = re.compile(rf"(?P<spelled>{_SPELLED.pattern})|(?P<written>[0-9]+)|(?<![{_EDGE}])(?:{_D}|{_P})(?![{_EDGE}])|\.", re.I)
_BETWEEN = re.compile(r"[ ,-]{0,3}\Z")
_HINT = re.compile(rf"{_D}|[\[({{<]\s{{0,2}}(?:\.|{_A}\b|@)|[\[({{<]a[\])}}>]|{_P} [0-9]", re.I)
# word characters on both sides keep a rewriting inside an address
_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s{{0,2}}[\[({{<]\s{{0,2}}(?:{_A}|@)\s{{0,2}}[\])}}>]\s{{0,2}}(?=[A-Za-z0-9])"
                 rf"|(?<=[A-Za-z0-9_%+-])[\[({{<]a[\])}}>](?=[A-Za-z0-9])", re.I)  # a single letter only without spaces
_DOT = re.compile(rf"(?<=[A-Za-z0-9_-])\s{{0,2}}[\[({{<]\s{{0,2}}(?:{_D}|\.)\s{{0,2}}[\])}}>]\s{{0,2}}(?=[A-Za-z0-9])", re.I)
#: "name at host dot tld" without brackets: only whole, with a top domain of letters, and at most ten labels on either side.
_WORDS = re.compile(rf"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]{{1,64}}(?:(?: {_D} |\.)[A-Za-z0-9_%+-]{{1,64}}){{0,9}}(?P<at> {_A} |@)"
                    rf"[A-Za-z0-9-]{{1,63}}(?:(?: {_D} |\.)[A-Za-z0-9-]{{1,63}}){{0,9}}(?: {_D} )[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I)
_ARTICLE = re.compile(r"(?:the|a|an|this|that|my|our|your|his|her|their) ", re.I)
_SPACED = re.compile(rf" (?:{_D}|{_A}) ", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9]) {_D} (?=[0-9])", re.I)
_PLUS = re.compile(rf"(?<![{_EDGE}]){_P} (?=[0-9])", re.I)


def look_alikes(text: Rewritten) -> Rewritten:
    return text.replaced([(*m.span(), _FORMS[m.group()]) for m in _FORM.finditer(text.text)])


def spelled_digits(text: Rewritten) -> Rewritten:
    """Runs of at least three spelled digits; what separates them goes."""
    t = text.text
    found: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        if len(run) >= 3:
            found.extend((a, run[i + 1][0] if i + 1 < len(run) else b, d) for i, (a, b, d) in enumerate(run))
        run.clear()

    for m in _SPELLED.finditer(t):
        if run and not _GAP.match(t[run[-1][1]: m.start()]):
            close()
        run.append((*m.span(), DIGITS[m.group().lower()]))
    close()
    return text.replaced(found)


def mixed_digits(text: Rewritten) -> Rewritten:
    """Runs of at least three digits of which some are spelled, also with written
    digits and dot, point or plus between; what separates a spelled digit from
    another digit goes, and what separates single written ones."""
    t = text.text
    found: list[tuple[int, int, str]] = []
    #: (start, end, digits, whether spelled); words and signs have no digits
    run: list[tuple[int, int, str, bool]] = []

    def close() -> None:
        if any(x[3] for x in run) and sum(len(x[2]) for x in run) >= 3:
            for (a, b, digits, spelled), after in zip(run, [*run[1:], None], strict=True):
                joined = after and digits and after[2] and (spelled or after[3] or len(digits) == len(after[2]) == 1)
                if spelled:
                    found.append((a, after[0] if joined else b, digits))
                elif joined and b < after[0]:
                    found.append((b, after[0], ""))
        run.clear()

    for m in _MEMBER.finditer(t):
        if run and not _BETWEEN.match(t[run[-1][1]: m.start()]):
            close()
        spelled = m["spelled"] is not None
        run.append((*m.span(), DIGITS[m.group().lower()] if spelled else m["written"] or "", spelled))
    close()
    return text.replaced(found)


def address_words(text: Rewritten) -> Rewritten:
    """at/dot disguises: in brackets, or as words of a whole address."""
    text = text.replaced([(*m.span(), "@") for m in _AT.finditer(text.text)])
    text = text.replaced([(*m.span(), ".") for m in _DOT.finditer(text.text)])
    found = []
    for m in _WORDS.finditer(text.text):
        if _ARTICLE.match(text.text, m.end("at")):
            continue
        for s in _SPACED.finditer(m.group()):
            sign = "@" if s.group().strip().lower() in AT_WORDS else "."
            found.append((m.start() + s.start(), m.start() + s.end(), sign))
    text = text.replaced(found)
    text = text.replaced([(*m.span(), ".") for m in _NUMBER_DOT.finditer(text.text)])
    return text.replaced([(*m.span(), "+") for m in _PLUS.finditer(text.text)])


def rewritten(source: str, digits: Callable[[Rewritten], Rewritten] = spelled_digits) -> Rewritten:
    """The whole chain; parts of it that have nothing to do are skipped."""
    text = Rewritten(source)
    if not source.isascii() and _FORM.search(source):
        text = look_alikes(text)
    if _SPELLED.search(text.text):
        text = digits(text)
    if _HINT.search(text.text):
        text = address_words(text)
    return text


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *s) for kind, find in FINDERS.items() for s in find(text)]


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows; none overlaps a base span of its kind."""
    view = rewritten(text)
    views = [view] if view.edits else []
    if _SPELLED.search(text) or not text.isascii():
        mixed = rewritten(text, mixed_digits)
        if mixed.edits and mixed.text != view.text:
            views.append(mixed)
    out = []
    for kind, find in FINDERS.items() if views else ():
        taken = sorted((a, b) for k, a, b in base if k == kind)
        found = {v.source(start, end) for v in views for start, end in find(v.text) if v.touches(start, end)}
        # longest first if there are two readings
        for a, b in sorted(found, key=lambda s: (s[0] - s[1], s)):
            i = bisect_left(taken, (b, 0))
            if not i or taken[i - 1][1] <= a:
                out.append((kind, a, b))
                if len(views) > 1:
                    taken.insert(i, (a, b))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with spans (kind, start, end, base) in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch):
                out = []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    more = added_spans(t, base)
                    known = set(base)
                    out.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in known} for k, s, e in ordered([*base, *more])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one, named by the first."""
    base = base_spans(text)
    spans = ordered([*base, *added_spans(text, base)])
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` redacted; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, at):
                texts = [None if t is None else redact(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, StructType(
        [StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in docs.schema]))
