"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Spans are offsets in code points, end exclusive. Every pattern is searched without going back over a run of
characters, so that a text's length costs in proportion. The four base kinds (email, ip, card, phone) are kept as
their patterns and checks give them, whatever their score; the other kinds need a score of at least `least`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "mac", "key", "secret")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where its run of digits does: a look back keeps the search from trying the rest of the run
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])")
KEY_PREFIXES = ("AKIA", "ghp_", "sk-")
_SECRET = re.compile(r"(?i:token|password|passwd|secret|api[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?([A-Za-z0-9+/_-]{8,}+)")
_DIGITS = re.compile(r"[0-9]")

#: Words that raise a kind's score when they stand within WINDOW characters before or after, and by how much. Whole words count, plurals among them.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "mac": ("mac", "device", "ethernet", "wifi"),
    "key": ("key", "aws", "access"),
    "secret": ("token", "password", "passwd", "secret", "apikey"),
}
WINDOW, RAISE = 40, 0.35
#: Words that lower a score, of examples and placeholders: not so far that a shape which stands alone goes for them. What a checksum, a prefix or its own label confirms keeps its score.
AGAINST, LOWER, CONFIRMED = ("example", "sample", "dummy", "version"), 0.1, frozenset(("card", "iban", "key", "secret"))
#: Scores by kind before context: a valid checksum, an unmistakable prefix or a label (which secrets' pattern asks for) stands alone, a bare shape does not.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "mac": 0.6, "key": 0.9, "secret": 0.65}
_NEAR = re.compile(r"[a-z0-9]+")
#: The same without a plural's s, as the words nearby are compared.
_CONTEXT = {kind: frozenset(w.removesuffix("s") for w in words) for kind, words in CONTEXT.items()}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of international account numbers: letters stand for 10 to 35, the first four characters go last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards over its run of local characters."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    """At most 255, whatever its zeros in front."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of whole tokens from each start whose check holds: words behind a number, or in front of it, may look like parts of it. A start is tried over a bounded length."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        ends = [m.end(), *(k for k in range(m.end() - 1, m.start(), -1) if text[k] == " ")]
        for end in ends:
            plain = text[m.start() : end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield m.start(), end
                at = end
                break


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Each kind is looked for where the text has what the kind can't be without."""
    digits, out = bool(_DIGITS.search(text)), []
    if digits:
        out += [("iban", *span) for span in _ibans(text)]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    if text.count(":") >= 5 or text.count("-") >= 5:
        out += [("mac", *m.span()) for m in _MAC.finditer(text)]
    if any(prefix in text for prefix in KEY_PREFIXES):
        out += [("key", *m.span()) for m in _KEY.finditer(text)]
    if digits and ("=" in text or ":" in text):
        out += [("secret", *m.span(1)) for m in _SECRET.finditer(text) if _DIGITS.search(m[1])]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    a, b = max(0, start - WINDOW), min(len(text), end + WINDOW)
    # words that the window's edges cut in two are none
    while a and a < start and text[a - 1].isalnum() and text[a].isalnum():
        a += 1
    while b < len(text) and b > end and text[b - 1].isalnum() and text[b].isalnum():
        b -= 1
    near = {w.removesuffix("s") for w in _NEAR.findall(f"{text[a:start]} {text[end:b]}".lower())}
    s = SCORES[kind] + RAISE * (not near.isdisjoint(_CONTEXT[kind])) - LOWER * (kind not in CONFIRMED and not near.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, s)), 2)


def find(text: str | None, least: float = 0.5) -> list[Span]:
    """All spans by kind as listed in KINDS, then by start."""
    if not text:
        return []
    out = [Span(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    out += [s for k, a, b in added_spans(text) if (s := Span(k, a, b, score(text, k, a, b))).score >= least]
    return out


def mask(text: str, spans: Sequence[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of the one that starts first (the longest of these) in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scored(spans: Sequence[Span]) -> str:
    """The scores of spans, in the same order as `listed` names them."""
    return ",".join(f"{s.score:.2f}" for s in spans)


def listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, found (its spans), n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in their order).

    Null and empty texts have none; null ids stay; repeated rows stay rows of their own; an empty table gives no
    rows. Spans of different kinds may overlap, and all are named. A text is searched in time in proportion to its
    length, in one task. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py(), least) for t in batch.column(1)]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in found], pa.int64()) for k in BASE]
            sums = [hashlib.sha256(listed([s for s in spans if s.kind in BASE]).encode()).hexdigest() for spans in found]
            structs = pa.array([[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in spans] for spans in found], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), structs, *counts, pa.array(sums, pa.string()), pa.array(list(map(listed, found)), pa.string()), pa.array(list(map(scored, found)), pa.string())], ["doc_id", "found", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    schema = "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask_documents(docs: DataFrame, least: float = 0.5, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span in its text replaced by its kind in brackets, and the length column, if there is one, set anew where the text changed; all other columns as they are.

    Null and empty texts stay as they are, with their lengths; null ids and repeated rows stay; of overlapping spans the
    one that starts first, and of these the longest, gives the name for all; an empty table gives no rows. Texts take
    time in proportion to their length.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            masked = [t if not (spans := find(t, least)) else mask(t, spans) for t in texts]
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(masked, columns[names.index(text_col)].type)
            if length_col in names:
                k = names.index(length_col)
                lengths = [n if m is t or m == t else len(m) for n, m, t in zip(columns[k].to_pylist(), masked, texts, strict=True)]
                columns[k] = pa.array(lengths, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
