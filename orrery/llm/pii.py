"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes, plus signs, digits and the cues
of identifiers. At each anchor a deterministic local parser walks outward, settles the span's ends and
validates it: an email from its at-sign to both sides, a phone number from its plus sign, addresses and
card numbers from the first digit of a run (a failing span is passed over whole), a web address from its
scheme, an account number or a secret from its cue.

Kinds, in this order: email, ip, card, phone (the base kinds, each equal to the leftmost, non-overlapping
matches of its pattern that pass its test), then iban, secret, ssn, url. Spans are code points, end
exclusive; kinds may overlap each other, spans of a kind don't. Null and empty texts have no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from orrery.llm.common import field, map_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn", "url")
#: Cues, each taken in lower case, upper case and with a first capital.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key")
CUES = {"iban": ("iban",), "secret": SECRET_CUES, "ssn": ("ssn", "social security")}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[\s:=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_./+=-]{12,})")
SSN = re.compile(r"[\s:=#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
SCHEMES = ("https", "http", "ftps", "ftp")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number: its letters as numbers from 10, the first four signs last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _email(text: str, at: int, free: int) -> tuple[Span | None, int]:
    begin = at
    while begin > free and text[begin - 1] in LOCAL:
        begin -= 1
    tail = DOMAIN.match(text, at + 1) if begin < at else None
    return ((begin, tail.end()), tail.end()) if tail else (None, free)


def _address(text: str, at: int, _: int) -> tuple[Span | None, int]:
    found = ADDRESS.match(text, at)
    if not found:
        return None, DIGITS.match(text, at).end()
    parts = [part.lstrip("0") for part in found.group().split(".")]  # Python reads no number of very many digits, zeros included
    good = all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)
    return (found.span() if good else None), found.end()


def _card(text: str, at: int, _: int) -> tuple[Span | None, int]:
    found = NUMBER.match(text, at)
    if not found:
        return None, at + 1
    digits = found.group().replace(" ", "").replace("-", "")
    return (found.span() if 16 <= len(digits) <= 19 and luhn(digits) else None), found.end()


def _phone(text: str, at: int, free: int) -> tuple[Span | None, int]:
    found = PHONE.match(text, at)
    if not found:
        return None, free
    return (found.span() if 8 <= sum(c.isdigit() for c in found.group()) <= 15 else None), found.end()


def _web(text: str, at: int, free: int) -> tuple[Span | None, int]:
    scheme = next((s for s in SCHEMES if text[max(free, at - len(s)) : at].lower() == s), None)
    rest = URL_REST.match(text, at + 3) if scheme else None
    value = rest.group().rstrip(".,;:!?)*%$#&") if rest else ""
    return ((at - len(scheme), at + 3 + len(value)), at + 3 + len(value)) if value else (None, free)


def _after(pattern: re.Pattern, test: Callable[[str], bool] | None = None):
    def parse(text: str, at: int, free: int) -> tuple[Span | None, int]:
        found = pattern.match(text, at)
        if not found or test and not test(found.group(1).replace(" ", "")):
            return None, free
        return found.span(1), found.end(1)

    return parse


PARSERS: dict[str, Callable[[str, int, int], tuple[Span | None, int]]] = {
    "email": _email,
    "ip": _address,
    "card": _card,
    "phone": _phone,
    "iban": _after(IBAN, mod97),
    "secret": _after(SECRET),
    "ssn": _after(SSN),
    "url": _web,
}


def anchors() -> ahocorasick.Automaton:
    """Each anchor's value: the kinds to try, and whether parsing starts at the anchor's end (or at its first sign)."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", (("email",), 0))
    automaton.add_word("+", (("phone",), 0))
    automaton.add_word("://", (("url",), 2))
    for digit in "0123456789":
        automaton.add_word(digit, (("ip", "card"), 0))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                automaton.add_word(form, ((kind,), -1))
    automaton.make_automaton()
    return automaton


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {}
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
    for end, (kinds, back) in automaton.iter(text):
        at = end - back
        for kind in kinds:
            if at >= free[kind]:
                span, free[kind] = PARSERS[kind](text, at, free[kind])
                if span:
                    found.setdefault(kind, []).append(span)
    return found


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, counts of the base kinds, base_sha256, spans (kind:start:end by kind, then start)."""
    docs = docs.select(field(doc_id).alias("doc_id"), field(text).alias("text"))
    state: dict = {}

    def scan(batch) -> list:
        automaton = state.get("anchors") or state.setdefault("anchors", anchors())
        counts, digests, lines = [[] for _ in BASE], [], []
        for text in batch.column(1):
            found = find_spans(value, automaton) if (value := text.as_py()) else {}
            said = {kind: [f"{kind}:{a}:{b}" for a, b in found.get(kind, ())] for kind in KINDS}
            for column, kind in zip(counts, BASE, strict=True):
                column.append(len(said[kind]))
            digests.append(hashlib.sha256(",".join(x for kind in BASE for x in said[kind]).encode()).hexdigest())
            lines.append(",".join(x for kind in KINDS for x in said[kind]))
        return [batch.column(0), *counts, digests, lines]

    return map_columns(docs, scan, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", docs.schema["doc_id"])
