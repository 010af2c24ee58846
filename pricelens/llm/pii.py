"""Personal data in plain and disguised form, with spans in the source text.

Plain identifiers are found in the text as it is.  Disguised ones are found in a
normalised copy that two transducers write: the first maps look-alike characters to
ASCII and drops invisible ones, the second turns "at" and "dot" disguises and
spelled digits into the characters they stand for.  Both keep, for every character
they write, the source stretch it came from, so spans map back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import row_key

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: phones without a country code: (555) 555-0123, 555-555-0123, 555.555.0123
_DOMESTIC = re.compile(r"\([2-9][0-9]{2}\) ?[0-9]{3}[-.][0-9]{4}|[2-9][0-9]{2}([-.])[0-9]{3}\1[0-9]{4}")

# Characters that look like ASCII ones, by the ASCII character.
_ALIKE = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", ".": "․。｡", "-": "‐‑‒–−", "@": "﹫",
}
_MAP = {ord(x): a for a, xs in _ALIKE.items() for x in xs}
_MAP |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
_MAP |= {base + k: str(k) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
_GONE = {0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
_STRANGE = frozenset(map(chr, {*_MAP, *_GONE}))
_STRANGE_RUN = re.compile("[" + "".join(map(re.escape, sorted(_STRANGE))) + "]")

_NUMBERS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(_NUMBERS) + ")"
_SPELLED = re.compile(rf"(?:\bplus[ ,.-]+)?\b(?:{_NUMBER}|[0-9])(?:[ ,.-]{{1,3}}(?:{_NUMBER}|[0-9]))+\b", re.I)
_WORDS, _BETWEEN = tuple(_NUMBERS), frozenset(" ,.-")
_UNIT = re.compile(rf"plus|{_NUMBER}|[0-9]", re.I)

_AT_CORE, _DOT_CORE = (rf"(?:\( ?{w} ?\)|\[ ?{w} ?\]|\{{ ?{w} ?\}}|< ?{w} ?>)[ \t]*+" for w in ("at", "dot"))
_AT = re.compile(rf"(?P<sign>@ ?)|(?P<word> at(?= ))|{_AT_CORE}", re.I)
_DOT_MARK = re.compile(rf"(?P<word> dot(?= ))|{_DOT_CORE}", re.I)
_IN_DOT = rf"[ \t]*{_DOT_CORE}"
_REST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_IN_DOT}| dot )[A-Za-z0-9-]++)++", re.I)
# Top-level domains that tell an address behind the word "at" from prose.
_KNOWN_TOP = re.compile(
    r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|eu|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|cz|gr|ru|ua|tr|jp|cn|kr|in|au|nz|ca|us|mx|br|ar|cl|za)\Z",
    re.I)
_DOT = re.compile(rf"{_IN_DOT}| dot ", re.I)
_DOTTED_WORDS = re.compile(rf"[0-9]{{1,3}}(?:(?:{_IN_DOT}| dot )[0-9]{{1,3}}){{3}}", re.I)
_OCTET = rf"(?:{_NUMBER}|[0-9]{{1,3}})(?:[ -](?:{_NUMBER}|[0-9])){{0,2}}"
_SPELLED_IP = re.compile(rf"\b{_OCTET}(?:(?:{_IN_DOT}| dot ){_OCTET}){{3}}\b", re.I)
_OCTET_UNIT = re.compile(rf"{_IN_DOT}| dot |{_NUMBER}|[ -]", re.I)
_AT_HINT = re.compile(r"[(\[{<] ?at ?[)\]}>]")
_AT_NAME = re.compile(r" at [a-z0-9-]+\.")


def _hinted(text: str) -> bool:
    """Whether an at or dot disguise can be there; searches for fixed strings, so most texts cost little."""
    low = text.casefold()
    return "dot" in low or " @" in low or "@ " in low or bool(_AT_HINT.search(low)) or " at " in low and bool(_AT_NAME.search(low))


def _two_spelled(text: str) -> bool:
    """Whether two spelled digits stand next to each other."""
    low = text.casefold()
    for word in _NUMBERS:
        at = low.find(word)
        while at >= 0:
            p = q = at + len(word)
            while q < p + 3 and low[q:q + 1] in _BETWEEN and q < len(low):
                q += 1
                if low.startswith(_WORDS, q):
                    return True
            at = low.find(word, at + 1)
    return False


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Anchored at each @, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        else:
            done = at + 1  # no local part reaches over an @
        at = text.find("@", max(done, at + 1))


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping identifiers per kind (code points, end exclusive)."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(run[0]):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", run.start() + m.start(), run.start() + m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class Normalised:
    """A text with the source stretch of each of its characters."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches (start, end, new), sorted and apart; new characters stand for the whole stretch."""
        if not edits:
            return
        texts, begins, ends, last = [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            texts += [self.text[last:s], new]
            begins += [self.begin[last:s], np.full(len(new), self.begin[s] if new else 0)]
            ends += [self.end[last:s], np.full(len(new), self.end[e - 1] if new else 0)]
            last = e
        self.text, self.begin, self.end = "".join(texts), np.concatenate(begins), np.concatenate(ends)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.begin[start]), int(self.end[end - 1])


def _plain_letters(n: Normalised) -> None:
    edits = []
    for m in _STRANGE_RUN.finditer(n.text):
        c = ord(m[0])
        edits.append((m.start(), m.end(), "" if c in _GONE else _MAP[c]))
    n.rewrite(edits)


def _dots(text: str) -> dict[int, int]:
    """Start of each dot disguise by its end, blanks round brackets included."""
    found = {}
    for m in _DOT_MARK.finditer(text):
        start = m.start()
        while not m["word"] and start and text[start - 1] in " \t":
            start -= 1
        found[m.end() + bool(m["word"])] = start  # two words may share a blank
    return found


def _addresses(text: str, dots: dict[int, int]) -> Iterator[tuple[int, int, str]]:
    """Edits that undo address disguises.  Anchored at each "at": the domain is read
    forwards, the local part backwards over words and disguised dots of any length."""
    done = 0
    for m in _AT.finditer(text):
        end = m.end() + bool(m["word"])
        rest = _REST.match(text, end)
        if rest is None or m.start() < done:
            continue
        at = m.start()
        if m["sign"]:
            at -= at > done and text[at - 1] == " "
        elif not m["word"]:
            while at > done and text[at - 1] in " \t":
                at -= 1
        start, inner = at, []
        while True:
            word = start
            while word > done and text[word - 1] in _LOCAL:
                word -= 1
            while inner and word < start and text[word] == ".":  # no name starts with one
                word += 1
            if word == start:
                start = inner.pop()[1] if inner else start  # a dot without a word before it
                break
            start = word
            if dots.get(start, -1) < done:
                break
            inner.append((dots[start], start, "."))
            start = dots[start]
        if start == at:
            continue
        outer = [(rest.start() + d.start(), rest.start() + d.end(), ".") for d in _DOT.finditer(rest[0])]
        local = text[start:at]
        if m["word"] and not outer and not (
                re.search(r"[A-Za-z]", local) and re.search(r"[0-9._]", local.rstrip(".")) or inner or _KNOWN_TOP.search(rest[0])):
            continue  # "at" is a word unless a disguised dot, a name of several parts or a known domain tells
        yield from inner
        yield at, end, "@"
        yield from outer
        done = rest.end()


def _phrases(n: Normalised) -> None:
    """at/dot disguises inside an address, dotted numbers and spelled digits."""
    edits: list[tuple[int, int, str]] = []
    if _hinted(n.text):
        dots = _dots(n.text)
        edits += _addresses(n.text, dots)
        if len(dots) >= 3:
            for m in _DOTTED_WORDS.finditer(n.text):
                edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _DOT.finditer(m[0])]
            for m in _SPELLED_IP.finditer(n.text):
                for u in _OCTET_UNIT.finditer(m[0]):
                    new = "." if "dot" in u[0].lower() else _NUMBERS.get(u[0].lower(), "")
                    edits.append((m.start() + u.start(), m.start() + u.end(), new))
    if _two_spelled(n.text):
        for m in _SPELLED.finditer(n.text):
            units = list(_UNIT.finditer(m[0]))
            if len(units) < 7 or sum(len(u[0]) > 1 for u in units) < 2:
                continue
            for k, u in enumerate(units):
                upto = units[k + 1].start() if k + 1 < len(units) else u.end()
                new = "+" if u[0].lower() == "plus" else _NUMBERS.get(u[0].lower(), u[0])
                edits.append((m.start() + u.start(), m.start() + u.end(), new))
                if upto > u.end():
                    edits.append((m.start() + u.end(), m.start() + upto, ""))
    kept, last = [], 0
    for e in sorted(set(edits)):
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    n.rewrite(kept)


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans beyond the plain ones: disguised identifiers, and phones without a
    country code.  A span inside a plain one of its kind adds nothing."""
    found: set[Span] = set()
    if _DIGIT.search(text):
        for m in _DOMESTIC.finditer(text):
            if not (text[m.start() - 1:m.start()].isdigit() or text[m.end():m.end() + 1].isdigit()):
                found.add(("phone", m.start(), m.end()))
    strange = not text.isascii() and not _STRANGE.isdisjoint(text)
    if strange or _hinted(text) or _two_spelled(text):
        n = Normalised(text)
        if strange:
            _plain_letters(n)
        _phrases(n)
        if n.text != text:
            for kind, s, e in plain_spans(n.text):
                found.add((kind, *n.source(s, e)))
            for m in re.finditer(r"(?<![0-9+])[0-9]{9,15}(?![0-9])", n.text):  # spelled out in the source, so longer there
                s, e = n.source(m.start(), m.end())
                if e - s >= 3 * (m.end() - m.start()):
                    found.add(("phone", s, e))
    out: list[Span] = []
    for kind in KINDS:  # by start, longest first: what ends later than all before it lies in none of them
        reach = 0
        mine = [(s, -e, True) for k, s, e in plain if k == kind] + [(s, -e, False) for k, s, e in found if k == kind]
        for s, e, known in sorted(mine, key=lambda x: (x[0], x[1], not x[2])):
            if -e > reach and not known:
                out.append((kind, s, -e))
            reach = max(reach, -e)
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


def masked(text: str, spans: list[Span]) -> str:
    """Overlapping spans are one; a stretch is replaced by the kind that starts it."""
    out, last = [], 0
    stretch: list | None = None
    for k, s, e in [*ordered(spans), (None, len(text), len(text))]:
        if stretch and s < stretch[2]:
            stretch[2] = max(stretch[2], e)
            continue
        if stretch:
            out += [text[last:stretch[1]], f"[{stretch[0].upper()}]"]
            last = stretch[2]
        stretch = [k, s, e] if k else None
    return "".join(out) + text[last:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, row_key, plain and all spans as
    array<struct<kind, start, stop>>, base_text and spans_text (kind:start:stop, comma-joined).

    Null and empty texts have no spans.  Repeated rows are kept; columns besides the
    two named are ignored.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    kind = keyed.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(spans: list[Span]) -> list[dict]:
            return [{"kind": k, "start": s, "stop": e} for k, s, e in ordered(spans)]

        for b in batches:
            base, every, base_text, all_text = [], [], [], []
            for value in b.column(2):
                text = value.as_py()
                plain = plain_spans(text)
                whole = plain + disguised_spans(text, plain)
                base.append(listed(plain))
                every.append(listed(whole))
                base_text.append(written(plain))
                all_text.append(written(whole))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(base, arrow_span), pa.array(every, arrow_span), pa.array(base_text, pa.string()),
                 pa.array(all_text, pa.string())],
                ["doc", "row_key", "plain", "spans", "base_text", "spans_text"],
            )

    out = keyed.mapInArrow(run, f"{kind}, plain {span}, spans {span}, base_text string, spans_text string")
    return out.withColumnRenamed("doc", id_col)


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Every row, with each span of its text replaced by the kind in brackets and
    ``length_col``, if named, set to the new text's code points; other columns
    unchanged, null texts stay null and keep their length."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            plain = plain_spans(text)
            spans = plain + disguised_spans(text, plain)
            return masked(text, spans) if spans else text

        return texts.map(one)

    out = docs.withColumn(text_col, mask(F.col(text_col)))
    if length_col is None:
        return out
    kind = docs.schema[length_col].dataType
    return out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
