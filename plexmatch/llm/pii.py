"""Personal data by offset-preserving deobfuscation.

A chain of small transducers rewrites disguises (look-alike characters, invisible characters,
spelled digits, spelled `at` and `dot`) and records for every character it emits the source
characters it stands for. The detectors run on the plain text and on the rewritten text; spans
found in the latter go back through that record, so every span is in source code points.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table, trimmed

KINDS = ("email", "ip", "card", "phone")

# Characters that look like an ASCII character.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "З": "3",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "ε": "e", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "․": ".", "。": ".", "｡": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "﹫": "@", "﹢": "+",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL_AT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + INVISIBLE + "！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[\x20\t-]{1,3}"
_SPELLED = re.compile(rf"(?<!\w){_WORD}(?:{_GAP}{_WORD})+(?!\w)", re.IGNORECASE)
_AT, _DOT = "(?:at|@|arroba|arobase)", r"(?:dot|\.|punkt|punto|point)"
_WORD_DOT = "(?:dot|punkt|punto|point)"
_B, _NAME = r"[\x20\t]", "[A-Za-z0-9-]"
#: From the bracket or word on; blanks in front are taken in by hand, as a pattern that begins with
#: a run of blanks would try every blank of a long run anew.
_AT_DOT = re.compile(
    rf"(?P<at>[\[({{<]{_B}*+{_AT}{_B}*+[\])}}>]{_B}*+)|(?P<dot>[\[({{<]{_B}*+{_DOT}{_B}*+[\])}}>]{_B}*+)"
    rf"|(?<={_B})(?P<wat>(?:at|arroba|arobase){_B}++(?={_NAME}++{_B}++{_WORD_DOT}{_B}++{_NAME}))|(?<={_B})(?P<wdot>{_WORD_DOT}{_B}++)",
    re.IGNORECASE,
)
_AT_DOT_HINT = re.compile(rf"[\[({{<]{_B}*+(?:{_AT}|{_DOT}){_B}*+[\])}}>]|{_B}{_WORD_DOT}{_B}", re.IGNORECASE)
#: Letters whose case is ignored like that of an ASCII letter.
_CASE_KIN = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "\u212a": "k"})


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        # the leftmost start is where the run of name characters before @ begins
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _MAIL_AT.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _plain(c: str) -> str:
    """ASCII form of one odd character; empty for an invisible one."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.digit(c))


class _Tape:
    """Text that has been rewritten, with a record of every rewriting that leads back to the source."""

    def __init__(self, text: str):
        self.text, self.layers = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given ranges, which are in order and apart."""
        if not edits:
            return
        parts, at, shift = [], 0, 0
        new_s, new_e, old_s, old_e = [], [], [], []
        for s, e, new in edits:
            parts += (self.text[at:s], new)
            new_s.append(s + shift)
            new_e.append(s + shift + len(new))
            old_s.append(s)
            old_e.append(e)
            shift += len(new) - (e - s)
            at = e
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self.layers.append((new_s, new_e, old_s, old_e))

    def source(self, s: int, e: int) -> tuple[int, int]:
        """The source span that the rewritten text's span s to e stands for."""
        for new_s, new_e, old_s, old_e in reversed(self.layers):
            i, j = bisect_right(new_s, s) - 1, bisect_right(new_s, e - 1) - 1
            s = old_s[i] if i >= 0 and s < new_e[i] else s + (old_e[i] - new_e[i] if i >= 0 else 0)
            e = old_e[j] if j >= 0 and e - 1 < new_e[j] else e + (old_e[j] - new_e[j] if j >= 0 else 0)
        return s, e


def _spelled_edits(text: str):
    word = re.compile(_WORD + r"(?!\w)", re.IGNORECASE)
    for run in _SPELLED.finditer(text):
        at = run.start()
        while at < run.end():
            m = word.match(text, at, run.end())
            nxt = m.end()
            while nxt < run.end() and text[nxt] in " \t-":
                nxt += 1
            yield at, m.end(), DIGIT_WORDS.get(m[0].translate(_CASE_KIN).lower(), m[0])
            if nxt > m.end():
                yield m.end(), nxt, ""
            at = nxt


def _at_dot_edits(text: str):
    last = 0
    for m in _AT_DOT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in " \t":
            start -= 1
        if start == m.start() and m.lastgroup in ("wat", "wdot"):
            continue  # the blanks in front belong to the word before
        last = m.end()
        yield start, last, "@" if m.lastgroup in ("at", "wat") else "."


def deobfuscated(text: str) -> _Tape:
    tape = _Tape(text)
    if not text.isascii():
        tape.rewrite([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(text)])
    tape.rewrite(list(_spelled_edits(tape.text)))
    if _AT_DOT_HINT.search(tape.text):
        tape.rewrite(list(_at_dot_edits(tape.text)))
    return tape


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). A found span that a base span of its kind covers adds nothing."""
    base = detect(text)
    tape = deobfuscated(text)
    if not tape.layers:
        return base, base
    starts = {k: [s for kind, s, _ in base if kind == k] for k in KINDS}
    ends = {k: [e for kind, _, e in base if kind == k] for k in KINDS}
    added = set()
    for kind, s, e in detect(tape.text):
        s, e = tape.source(s, e)
        i = bisect_right(starts[kind], s) - 1  # base spans of a kind lie apart: only this one can cover s
        if i < 0 or ends[kind][i] < e:
            added.add((kind, s, e))
    return base, sorted({*base, *added}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [find(t or "") for t in batch.column("text").to_pylist()]
        said = [",".join(f"{k}:{s}:{e}" for k, s, e in base) for base, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                *[pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in KINDS],
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string()),
                pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in every) for _, every in rows], pa.string()),
                pa.array([len(every) - len(base) for base, every in rows], pa.int64()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
        )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, base_sha256, spans, n_added.

    `spans` holds base and deobfuscated spans as kind:start:end, in source code points. A null
    text counts as empty and has no spans; null ids and repeated rows are kept as they come;
    an empty table gives no rows; other columns are not read. Rows are independent, so there is
    no shuffle, and time is linear in a text's length.
    """
    d = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(trimmed(_scan), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
