"""Personal data: plain patterns, and the same patterns in a normalised text whose spans map back to the source."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

# Patterns and limits fixed by the contract. Runs are matched possessively from their first character: the
# leftmost match begins there anyway, and long runs stay linear.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Look-alikes of ASCII characters (fixed values); full-width forms and foreign digits follow by rule.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "﹫": "@", "․": ".", "。": ".", "｡": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "­": "", "﻿": "",
}
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_NAME = "|".join(SPELLED)
#: Parts of a disguised number, and what may stand between two of them.
NUMBER_PART = re.compile(rf"\b(?:({_NAME})|(plus)|(dot|point)|([0-9]{{1,40}}))\b|(\+)", re.I)
NUMBER_GAP = re.compile(r"[\s,().-]{0,8}")
#: A number counts from so many digits on, spelled or not, if it has a spelled part.
MIN_DIGITS = 4
SPELLED_HINT = re.compile(rf"\b(?:{_NAME})[\s,().-]{{1,8}}(?:{_NAME}|dot|point|[0-9])|(?:[0-9+]|\bplus)[\s,().-]{{1,8}}(?:{_NAME}|dot|point|plus)\b|\bplus\s+[0-9]", re.I)
#: ``[at]``, ``(dot)`` and the like, with the blanks around them.
BRACKETED = re.compile(r"\s{0,8}[\[({<]\s{0,8}(at|dot|@|\.)\s{0,8}[\])}>]\s{0,8}", re.I)
BRACKET_HINT = re.compile(r"[\[({<]\s{0,8}(?:at|dot|@|\.)\s{0,8}[\])}>]", re.I)
#: A whole address, its at and dots each plain, bracketed or a bare word; a bare at needs a dot that is not plain.
_OPEN, _CLOSE = r"\s{0,8}[\[({<]\s{0,8}", r"\s{0,8}[\])}>]\s{0,8}"
_DOT = rf"(?:\.|{_OPEN}(?:dot|\.){_CLOSE}|\s{{1,8}}dot\s{{1,8}})"
ADDRESS_AT = re.compile(rf"{_OPEN}(?:at|@){_CLOSE}|\s{{1,8}}(?:at|@)\s{{1,8}}|@", re.I)
ADDRESS_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+", re.I)
ADDRESS_DOT = re.compile(_DOT, re.I)
BARE_DOT = re.compile(r"\sdot\s", re.I)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, leftmost and without overlap for each kind, by start and kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Tape:
    """A text with, for every character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint spans, in order; all characters of a replacement stand for the whole span."""
        if not edits:
            return
        text: list[str] = []
        start: list[int] = []
        end: list[int] = []
        done = 0
        for a, b, new in (*edits, (len(self.text), len(self.text), "")):
            text.append(self.text[done:a])
            start.extend(self.start[done:a])
            end.extend(self.end[done:a])
            if b > a:
                text.append(new)
                start.extend([self.start[a]] * len(new))
                end.extend([self.end[b - 1]] * len(new))
            done = b
        self.text, self.start, self.end = "".join(text), start, end


def look_alike(c: str) -> str | None:
    """The ASCII form of a disguised character, or None."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None) if c > "\x7f" else None
    return None if digit is None else str(digit)


def undo_look_alikes(tape: Tape) -> None:
    if not tape.text.isascii():
        forms = {c: look_alike(c) for c in set(tape.text)}
        if any(f is not None for f in forms.values()):
            tape.rewrite([(i, i + 1, forms[c]) for i, c in enumerate(tape.text) if forms[c] is not None])


def undo_spelling(tape: Tape) -> None:
    if not SPELLED_HINT.search(tape.text):
        return
    runs: list[list[re.Match]] = []
    for part in NUMBER_PART.finditer(tape.text):
        last = runs[-1][-1].end() if runs else 0
        joins = runs and not (part[2] or part[5]) and part.start() - last <= 8 and NUMBER_GAP.fullmatch(tape.text, last, part.start())
        if joins:
            runs[-1].append(part)
        else:
            runs.append([part])
    edits = []
    for run in runs:
        while run and run[0][3]:
            run.pop(0)
        while run and run[-1][3]:
            run.pop()
        if all(p[4] or p[5] for p in run) or sum(bool(p[1]) + len(p[4] or "") for p in run) < MIN_DIGITS:
            continue
        for before, part in zip((None, *run), run, strict=False):
            if before and before.end() < part.start() and not (before[4] and part[4]):
                gap = tape.text[before.end() : part.start()]
                # two numbers of which one is spelled may be two groups of digits
                put = "" if before[3] or part[3] or before[2] or before[5] or before[1] and part[1] else " "
                edits.append((before.end(), part.start(), "." if gap == "." else put))
            if not (part[4] or part[5]):
                edits.append((*part.span(), SPELLED.get(part[0].lower(), "+" if part[2] else ".")))
    tape.rewrite(edits)


def undo_at_and_dot(tape: Tape) -> None:
    if BARE_DOT.search(tape.text) or BRACKET_HINT.search(tape.text):
        edits, done = [], 0
        for at in ADDRESS_AT.finditer(tape.text):
            host = ADDRESS_HOST.match(tape.text, at.end())
            if at.start() < done or not host or not at.start() or tape.text[at.start() - 1] not in EMAIL_LOCAL:
                continue
            dots = [d for d in ADDRESS_DOT.finditer(tape.text, *host.span()) if d[0] != "."]
            if at[0].strip().lower() in ("at", "@") and at[0] != "@" and not dots:
                continue
            edits += [(*at.span(), "@"), *((*d.span(), ".") for d in dots)]
            done = host.end()
        tape.rewrite([e for e in edits if tape.text[e[0] : e[1]] != e[2]])
    if BRACKET_HINT.search(tape.text):
        tape.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in BRACKETED.finditer(tape.text)])


def hidden_spans(text: str, plain: list[Span]) -> list[Span]:
    """Source spans of identifiers that only show once the disguises are undone; none touches a plain one of its kind."""
    tape = Tape(text)
    for undo in (undo_look_alikes, undo_spelling, undo_at_and_dot):
        undo(tape)
    if tape.text is text:
        return []
    out = []
    # spans of a kind are disjoint and in order, so of those before only the last can touch a span
    known = [[(s, e) for s, k, e in plain if k == kind] for kind in range(len(KINDS))]
    next_, done = [0] * len(KINDS), [0] * len(KINDS)
    for a, kind, b in plain_spans(tape.text):
        start, end = tape.start[a], max(tape.end[a:b])
        if text[start:end] == tape.text[a:b]:
            continue
        while next_[kind] < len(known[kind]) and known[kind][next_[kind]][1] <= start:
            next_[kind] += 1
        touches = next_[kind] < len(known[kind]) and known[kind][next_[kind]][0] < end
        if not touches and start >= done[kind]:
            out.append((start, kind, end))
            done[kind] = end
    return out


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs`` (``doc_id, text``): ``doc_id``, counts of plain spans by kind, ``plain``
    and ``spans`` (``kind:start:end`` in code points, end exclusive, by start and kind) and ``n_hidden``.

    A null text is empty; empty texts and tables have no spans. Repeated rows and ids are judged row by row.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "plain", "spans", "n_hidden")}
        for text in rows["text"]:
            text = text or ""
            plain = plain_spans(text)
            hidden = hidden_spans(text, plain)
            for i, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(k == i for _, k, _ in plain))
            out["plain"].append(as_text(plain))
            out["spans"].append(as_text(sorted(plain + hidden)))
            out["n_hidden"].append(len(hidden))
        return out | {"doc_id": rows["doc_id"]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, plain string, spans string, n_hidden long"
    return map_slices(docs.select("doc_id", "text"), schema, work)


def redact(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """``docs`` (any columns besides ``text``) with every span, plain or hidden, replaced by its mask.

    Of overlapping spans the one that starts first (then the longer) is masked. Null texts stay null.
    """

    @F.pandas_udf("string")
    def masked(texts):
        import pandas as pd

        def one(text):
            if text is None:
                return None
            plain = plain_spans(text)
            out, done = [], 0
            for a, k, b in sorted(plain + hidden_spans(text, plain), key=lambda s: (s[0], -s[2])):
                if a >= done:
                    out += [text[done:a], mask.format(kind=KINDS[k])]
                done = max(done, b)
            return "".join((*out, text[done:]))

        return pd.Series([one(t) for t in texts], dtype=object)

    columns = [masked(docs["text"]).alias(c) if c.lower() == "text" else docs[f"`{c}`"] for c in docs.columns]
    return docs.select(*columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find`."""
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("plain").cast("binary"), 256).alias("base_sha256"), "spans", "n_hidden"
    )
