"""Personal data in text, plain and disguised.

Plain identifiers are found by pattern on the text as it stands. For disguised ones, transducers rewrite the text and keep for every part
of the result the source characters it stands for: look-alike characters become ASCII, characters of no width go, bracketed separators
become ``@`` and ``.``, spelled digits become digits, and then bare ``at`` and ``dot`` go the same way, so that disguises may be mixed. Identifiers found in the rewritten text are mapped back to source spans;
they are added where they cover rewritten characters and touch no plain identifier of their kind.

Defined cases: a null text counts as empty and has no spans; matches that fail their check are dropped without another try; texts are
read whole and in time that grows with their length; equal texts give equal spans; extra columns are kept or ignored as said below.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Characters of e-mail names, and what may stand before and after a phone number's first digit.
LOCAL_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Digit names in four languages, in the order 0 to 9.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = (
    "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS "
    "αa εe ιi κk νv οo ρp τt υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
# Dashes and spaces beyond ASCII, and characters without width.
DASHES, SPACES, NO_WIDTH = "‐‑‒–—―−", "              　", "­​‌‍⁠﻿"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT_OF = {name: str(n) for names in DIGIT_NAMES for n, name in enumerate(names.split())}
_NAMES = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_ONE = rf"(?<!\w)(?:{_NAMES})(?!\w)"
#: At least this many digit names in a row are read as a number.
LEAST_SPELLED = 4
_SPELLED = re.compile(rf"(?:(?<!\w)plus[ -]{{1,2}})?{_ONE}(?:[ ,-]{{1,2}}{_ONE}){{{LEAST_SPELLED - 1},}}")
_SPELLED_OCTET = rf"{_ONE}(?:[ ,-]{{1,2}}{_ONE}){{0,2}}"
#: Stands in lowered text for a point that was bracketed, as a point that was written plainly disguises nothing.
_BRACKETED_POINT = "\ue000"
_OCTET = rf"(?:{_SPELLED_OCTET}|(?<![0-9])[0-9]{{1,3}}+)"
_POINT = rf"(?: (?:dot|punto|punkt|point) |[.{_BRACKETED_POINT}])"
_SPELLED_IP = re.compile(rf"{_OCTET}(?:{_POINT}{_OCTET}){{3}}(?!\w)")
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_BRACKETED = re.compile(rf"{_OPEN}(?:(at|@)|dot|punto|punkt|point|\.){_CLOSE}")
# Endings that make plain words with "at" and "dot" an address.
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|co|me|tv|eu|us|uk|de|fr|es|it|nl|ch|at|be|pt|pl|se|no|dk|fi|ru|cn|jp|in|br|mx|ar|ca|au"
_DOT = f"(?: dot |[.{_BRACKETED_POINT}])"
_BARE = re.compile(rf"(?<=[a-z0-9._%+-])(?: at |@)[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*?{_DOT}(?:{_ENDINGS})(?:{_DOT}(?:{_ENDINGS}))?(?![a-z0-9-])")
_CONFUSED = re.compile(r"(?<=[0-9])[OolI|](?=[0-9])")
_WIDTHLESS = re.compile(f"[{NO_WIDTH}]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ the name is followed back and the domain forth."""
    out, end, at = [], 0, text.find("@")
    bound = 0
    while at >= 0:
        begin = max(bound, end)
        if at >= begin:
            begin += len(text[begin:at].rstrip(LOCAL_CHARACTERS))
            if begin < at and (found := _DOMAIN.match(text, at)):
                end = found.end()
                out.append((begin, end))
        bound = at + 1
        at = text.find("@", max(bound, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the plain identifiers of each kind, in code points."""
    digits = any(d in text for d in "0123456789")
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits and "." in text else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


class Alignment:
    """Where the parts of a rewritten text come from: stretches that were kept or replaced as a whole."""

    def __init__(self) -> None:
        self.new: list[int] = []
        self.old: list[tuple[int, int, bool]] = []
        self.parts: list[str] = []
        self.length = 0

    def add(self, text: str, begin: int, end: int, kept: bool) -> None:
        if text:
            self.new.append(self.length)
            self.old.append((begin, end, kept))
            self.parts.append(text)
            self.length += len(text)

    def source(self, begin: int, end: int) -> tuple[int, int]:
        """The source span behind a span of the rewritten text."""
        i, j = bisect_right(self.new, begin) - 1, bisect_right(self.new, end - 1) - 1
        first, last = self.old[i], self.old[j]
        return first[0] + (begin - self.new[i] if first[2] else 0), last[0] + end - self.new[j] if last[2] else last[1]


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, Alignment]:
    """Apply replacements, given in order; an edit that begins inside an earlier one is left out."""
    out, at = Alignment(), 0
    for begin, end, new in edits:
        if begin >= at:
            out.add(text[at:begin], at, begin, True)
            out.add(new, begin, end, False)
            at = end
    out.add(text[at:], at, len(text), True)
    return "".join(out.parts), out


@lru_cache(maxsize=1)
def look_alikes() -> dict[int, str]:
    """Characters to the one ASCII character they stand for: compatibility forms by Unicode's rule, and the lists above."""
    table = {}
    for code in range(0x80, 0x20000):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and "!" <= plain <= "~":
            table[code] = plain
        elif (digit := unicodedata.decimal(chr(code), None)) is not None:
            table[code] = str(digit)
    table.update({ord(pair[0]): pair[1] for pair in LOOK_ALIKES.split()})
    table.update(dict.fromkeys(map(ord, DASHES), "-"))
    table.update(dict.fromkeys(map(ord, SPACES), " "))
    return table


@lru_cache(maxsize=1)
def look_alike_characters() -> frozenset[str]:
    return frozenset(map(chr, look_alikes()))


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _digits(spelled: str) -> str:
    words = re.findall(r"\w+", spelled)
    return "".join("+" if w == "plus" else _DIGIT_OF[w] for w in words)


def _spelled_edits(low: str) -> list[tuple[int, int, str]]:
    found = []
    if " dot " in low or " pun" in low or " point " in low or _BRACKETED_POINT in low:
        for m in _SPELLED_IP.finditer(low):
            new = ".".join(x if x.isdecimal() else _digits(x) for x in re.split(_POINT, m[0]))
            if new != m[0].replace(_BRACKETED_POINT, "."):
                found.append((*m.span(), new))
    names = _DIGIT_OF.keys() & set(low.replace(",", " ").replace("-", " ").split())
    if names and (names != {"un"} or "un un" in low or "un,un" in low or "un, un" in low or "un-un" in low):  # "un" alone is an article
        found += [(*m.span(), _digits(m[0])) for m in _SPELLED.finditer(low)]
    return sorted(found)


def _bracket_edits(low: str) -> list[tuple[int, int, str]]:
    if not any(x in low for x in "[({<"):
        return []
    return [(*m.span(), "@" if m[1] else _BRACKETED_POINT) for m in _BRACKETED.finditer(low)]


def _separator_edits(low: str) -> list[tuple[int, int, str]]:
    found = []
    if (" dot " in low or _BRACKETED_POINT in low) and (" at " in low or "@" in low):
        for m in _BARE.finditer(low):
            if " dot " not in m[0] and _BRACKETED_POINT not in m[0]:
                continue  # "at" before a plain domain is prose
            if m[0][0] != "@":
                found.append((m.start(), m.start() + 4, "@"))
            found += [(m.start() + x.start(), m.start() + x.end(), ".") for x in re.finditer(" dot ", m[0])]
    return found


def disguised(text: str) -> dict[str, list[tuple[int, int]]]:
    """Identifiers that only the rewritten text shows, as spans of the source."""
    plain, steps = text, []

    def apply(edits: list[tuple[int, int, str]]) -> None:
        nonlocal plain
        if edits:
            plain, step = rewrite(plain, edits)
            steps.append(step)

    if not text.isascii():
        if not look_alike_characters().isdisjoint(set(text)):
            plain = text.translate(look_alikes())  # one character for one, so positions stay
        apply([(*m.span(), "") for m in _WIDTHLESS.finditer(plain)])
    low = lowered(plain)
    for step in (_bracket_edits, _spelled_edits, _separator_edits):
        if edits := step(low):
            apply([(begin, end, new.replace(_BRACKETED_POINT, ".")) for begin, end, new in edits])
            low = rewrite(low, edits)[0]
    apply([(*m.span(), "1" if m[0] in "lI|" else "0") for m in _CONFUSED.finditer(plain)])
    if plain == text:
        return {}
    out = {}
    for kind, spans in identifiers(plain).items():
        mapped = []
        for begin, end in spans:
            shown = plain[begin:end]
            for step in reversed(steps):
                begin, end = step.source(begin, end)
            if text[begin:end] != shown:
                mapped.append((begin, end))
        out[kind] = mapped
    return out


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans, of each kind in order."""
    base, more = identifiers(text), disguised(text)
    every = {}
    for kind, own in base.items():
        kept, ends = list(own), [e for _, e in own]
        for begin, end in more.get(kind, ()):
            i = bisect_right(ends, begin)
            if i == len(own) or own[i][0] >= end:
                kept.append((begin, end))
        every[kind] = sorted(kept)
    return base, every


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind in KINDS for begin, end in spans[kind])


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (all spans), ``base_sha256`` (digest of the plain spans), ``spans`` (all
    spans as kind:start:end) and ``base_spans``. Positions are code points, ends exclusive."""

    def run(batches):
        for batch in batches:
            rows = [find(x.as_py() or "") for x in batch.column(1)]
            base = [listed(b) for b, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array([len(every[k]) for _, every in rows], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    pa.array([listed(every) for _, every in rows], pa.string()), pa.array(base, pa.string()),
                ],
                ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base_spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(key, text).mapInArrow(run, f"key {kind}, {counts}, base_sha256 string, spans string, base_spans string").withColumnRenamed("key", key)


def redacted(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    _, every = find(text)
    spans = sorted((begin, end, kind) for kind, own in every.items() for begin, end in own)
    if not spans:
        return text
    out, at = [], 0
    for begin, end, kind in spans:
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, personal data replaced; null texts stay null. ``length``, where that column exists, is set anew for
    changed texts."""

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else redacted(x)).astype(object)

    out = docs.withColumn("_redacted", clean(F.col(text)))
    if length in docs.columns:
        changed = ~F.col("_redacted").eqNullSafe(F.col(text))
        out = out.withColumn(length, F.when(changed, F.length("_redacted").cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.withColumn(text, F.col("_redacted")).drop("_redacted").select(*docs.columns)
