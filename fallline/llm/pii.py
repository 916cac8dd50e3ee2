"""Personal data: expressions propose spans, checksums and ranges confirm them, words nearby weigh.

Kinds with a form of their own (``email``, ``ip``, ``card``, ``phone``) are found by their form and
their check alone. Kinds whose form is weak need more: an ``iban`` passes mod 97, and a ``local``
telephone number or a ``national`` number, which are mere groups of digits, need a word near them
that says what they are. A ``secret`` is a key or token: one with a prefix and length that its issuer gives it,
a private key block, or a long word behind a name such as ``token =`` whose characters have the entropy of a
random one. A span of these further kinds is dropped where it overlaps a span of
the first four.

Whole texts are read, one row gives one row, nothing is shuffled. A null text counts as empty; an
empty text has no spans. Offsets are code points, the end exclusive.
"""

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local", "national", "secret")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs are taken whole (``++``), so no text makes the search slower than its length.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9A-Za-z.-])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
#: Fixed forms of keys that their issuers document, and of key blocks and signed tokens.
_KEY = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,128}|gh[pousr]_[A-Za-z0-9]{36,128}"
    r"|github_pat_[A-Za-z0-9_]{22,128}|xox[abprs]-[A-Za-z0-9-]{10,128}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,64}"
    r"|sk-[A-Za-z0-9_-]{20,128}|hf_[A-Za-z0-9]{30,64}|eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,2048}\.[A-Za-z0-9_-]{8,1024})"
    r"(?![A-Za-z0-9_])"
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_FINISH = re.compile(r"-----END (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
#: A name that says that what follows is secret, and the value: no white space, 12 characters at least.
_NAMED = re.compile(
    r"(?<![A-Za-z])(?:api[_ -]?key|access[_ -]?key|secret|token|passw(?:or)?d|pwd|credentials?|private[_ -]?key|auth)"
    r"[A-Za-z0-9_-]{0,24}[\"']?\s{0,3}(?:=|:|=>|:=|is)\s{0,3}[\"']?([A-Za-z0-9+/_.=~-]{12,512})",
    re.IGNORECASE,
)
#: Bits per character that a named value has at least, and of those made of hexadecimal digits alone.
RANDOM, RANDOM_HEX = 3.3, 2.6
#: Words that say what a number near them is, in the languages of the texts.
CONTEXT = {
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "local": ("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "téléphone", "teléfono", "handy"),
    "national": ("ssn", "social", "security", "insurance", "passport", "ausweis", "dni"),
}
NEAR = 40
SCORES = {"iban": 0.8, "local": 0.3, "national": 0.4}
CONTEXT_GAIN, LEAST_SCORE = 0.4, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without spaces."""
    if not 15 <= len(iban) <= 34:
        return False
    number = 0
    for c in iban[4:] + iban[:4]:
        for d in str(int(c, 36)):
            number = (number * 10 + int(d)) % 97
    return number == 1


def _emails(text: str):
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_PART:
            start -= 1
        found = _AT.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = at + 1 if start == at else last
        at = text.find("@", max(last, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ips(text: str):
    """The leftmost match may begin within a run only where an earlier match ended before it, and
    a match takes its last run whole; so a match always begins where a run does."""
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the first four kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _scored(text: str, kind: str, start: int, end: int) -> float:
    around = re.findall(r"\w+", text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])
    said = {x.lower() for x in around}
    return min(1.0, SCORES[kind] + CONTEXT_GAIN * any(x in said for x in CONTEXT[kind]))


def looks_random(word: str) -> bool:
    """Whether the characters of ``word`` are as mixed as those of a key, digits among them."""
    counts = Counter(word.lower())
    bits = -sum(n / len(word) * log2(n / len(word)) for n in counts.values())
    mere = all(c in "0123456789abcdef" for c in counts)
    return any(c.isdigit() for c in counts) and bits >= (RANDOM_HEX if mere else RANDOM)


def _secrets(text: str):
    """(start, end) of keys by their form, key blocks, and random words behind a name."""
    for m in _KEY.finditer(text):
        yield m.span()
    done, ends = 0, True
    for m in _BEGIN.finditer(text):
        if m.start() >= done:
            end = _FINISH.search(text, m.end()) if ends else None
            ends = end is not None  # without one here there is none further on
            done = end.end() if end else m.end()
            yield m.start(), done
    for m in _NAMED.finditer(text):
        if looks_random(m[1]):
            yield m.span(1)


class Taken:
    """Places that are taken. Each kind proposes its spans in order, so adding them is a merge in all."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts, self.most = [], []  # starts, and the furthest end up to each of them
        for start, _, end in sorted(base):
            self.starts.append(start)
            self.most.append(max(end, self.most[-1] if self.most else 0))

    def add(self, start: int, end: int) -> bool:
        """Take the span unless it overlaps one that is taken."""
        k = bisect_left(self.starts, end)
        if k and self.most[k - 1] > start:
            return False
        # nothing that begins before ``end`` reaches beyond ``start``, so the furthest ends stay in order
        self.starts.insert(k, start)
        self.most.insert(k, end)
        return True


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the further kinds, clear of ``base`` and of each other."""
    proposed: list[tuple[str, int, int]] = [("secret", a, b) for a, b in _secrets(text)]
    if re.search("[0-9]", text):
        for kind, found in (("iban", _IBAN), ("national", _NATIONAL), ("local", _LOCAL)):
            for m in found.finditer(text):
                if kind == "iban" and not mod97(m[0].replace(" ", "")):
                    continue
                if _scored(text, kind, *m.span()) >= LEAST_SCORE:
                    proposed.append((kind, *m.span()))
    out: list[tuple[int, int, int]] = []
    taken = Taken(base)
    for kind, start, end in proposed:
        if taken.add(start, end):
            out.append((start, KINDS.index(kind), end))
    return sorted(out)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    return base, sorted(base + further_spans(text, base))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string"
)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans, for every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column(1).to_pylist():
            base, spans = spans_of(x or "")
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in range(4)), digest, _joined(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    return T.map_batches(docs.select(T.ids(doc_id), T.ids(text, "text")), work, SCHEMA)


def redacted(text: str) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans_of(text)[1]:
        if start >= at:
            out.append(text[at:start] + f"<{KINDS[kind].upper()}>")
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced and ``n_chars`` counted anew.

    A null text stays null.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        done = [None if x is None else redacted(x) for x in batch.column(at).to_pylist()]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))
        k = batch.schema.get_field_index(n_chars) if n_chars else -1
        if k >= 0:
            field = batch.schema.field(k)
            size = [None if x is None else len(x) for x in done]
            batch = batch.set_column(k, field, pa.array(size, field.type))
        return batch

    return T.map_batches(docs, work, docs.schema)
