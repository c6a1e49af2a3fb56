"""Personal data, also where it is disguised.

Base identifiers are found on the text as it is. Then transducers rewrite disguises (invisible characters, look-alikes,
mathematical and full-width forms, digits of other scripts and in words, bracketed or spoken "at" and "dot"), keeping for every output character the source range that it came from;
identifiers found in the rewritten text are mapped back to source characters and added where they overlap no span found
before; an address is also added where it holds all of these within it.

Defined results: a null or empty text has no spans; an empty table gives an empty result; repeated rows, and rows with a
null key, are searched one by one; other columns are not read. Spans are in code points, end exclusive. Every matcher starts only where a match
can start (at the first character of a run, or at an "@"), so that a text of any length takes linear time. Patterns of
disguises are searched in lower-case texts (`_lower`), several times as fast as searching without regard to case.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends with the last digit of a run, so the next can only start with the first digit of another.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_ODD = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    return sum(_ODD[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[Span]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return found


def find(text: str) -> list[Span]:
    """The base spans, by kind as listed and then by start."""
    spans = _emails(text) if "@" in text else []
    if not _DIGITS.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.groups()):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 15 < m.end() - m.start() and 15 < len(digits := re.sub("[ -]", "", m[0])) < 20 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


#: Letters that look like ASCII letters, one to one.
_LOOK_ALIKE = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXov"))
#: Full-width forms, and digits of other scripts that have a fixed distance from theirs.
_FOLD = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {chr(base + i): str(i) for base in (0x660, 0x6F0, 0x966) for i in range(10)} | _LOOK_ALIKE
#: Letters and digits in mathematical styles and in circles, which compatibility names as such.
_FOLD |= {chr(c): plain for c in (*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x24B6, 0x24EA), *range(0x2080, 0x208A)) if len(plain := unicodedata.normalize("NFKC", chr(c))) == 1 and plain.isascii()}
#: Characters that show nothing (soft hyphen, zero-width ones, word joiner, byte order mark).
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]+")
_FOLDED, _FOLD_TABLE = frozenset(_FOLD), str.maketrans(_FOLD)
#: Digits in words.
_SPOKEN = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_WORD = "|".join(sorted(_SPOKEN, key=len, reverse=True))
#: What may stand between two number words: a mark or two, brackets of an area code, a line break.
_GAP = r"[ ,.()\n-]{1,3}"
# At least eight in a row: a shorter row of number words is ordinary speech.
_SPELLED = re.compile(rf"(?<![a-z])(?:{_WORD})(?:{_GAP}(?:{_WORD})(?![a-z])){{7,}}+")
_ONE = re.compile(_WORD)
# Number words beside digits, other number words or spoken dots, however few; the detectors' own tests decide.
_UNIT = rf"(?:[0-9]++|(?:{_WORD})(?![a-z]))"
_DOT = r"(?:\s(?:dot|point)\s|\s{0,2}[\[({<]\s?(?:dot|[.])\s?[\])}>]\s{0,2})"
_MIXED = re.compile(rf"(?<![a-z0-9]){_UNIT}(?:(?:{_DOT}|{_GAP}){_UNIT})++")
_ANY_DOT = re.compile(_DOT)
_NUMBER = re.compile(rf"[0-9]+|{_WORD}")
_SPELLED_PLUS = re.compile(r"(?<![a-z])plus[ ]+(?=[0-9(])")
# Begins with one class of characters, which is quickly looked for: the first of up to two spaces, or the bracket.
_DISGUISE = re.compile(
    r"[\s\[({<](?:(?:(?<=\s)\s?[\[({<]|(?<!\s))\s?(?:(?P<at>at|@)|(?P<dot>dot|[.]))\s?[\])}>]\s{0,2}"
    # A spoken "at" counts only before a domain, of spoken dots or of points and a last part in letters.
    r"|(?<=[a-z0-9] )(?P<says>at )(?=[a-z0-9-]{1,63}(?:(?: dot [a-z0-9-]{1,63}){1,4}(?![a-z0-9-])|(?:\.[a-z0-9-]{1,63}){0,3}\.[a-z]{2,24}(?![a-z0-9-])))"
    r"|(?<=[a-z0-9] )(?P<point>dot )(?=[a-z0-9-]))"
)
# What every match of _DISGUISE holds, and what shows number words; apart, as each begins with characters that are quickly looked for.
_MARK_CUES = [re.compile(p) for p in (r"[\[({<]\s?(?:at|dot|@|[.])\s?[\])}>]", " dot ", r" at (?=[a-z0-9.-]+\.[a-z])")]
_NUMBER_CUES = [re.compile(p) for p in (rf"(?:{_WORD})(?:{_GAP}|\s(?:dot|point)\s)(?:{_WORD}|[0-9])", rf"[0-9](?:{_GAP}|\s(?:dot|point)\s)(?:{_WORD})", r"[0-9]\spoint\s[0-9]")]
_CUES = _MARK_CUES + _NUMBER_CUES


def _lower(text: str) -> str:
    """The text in lower case, as long as it was. The letters that are i or s without regard to case become these."""
    return text.replace("ſ", "s").replace("ı", "i").replace("İ", "i").lower()


class Tape:
    """A text, and the rounds of edits that led to it, each as (start, end, source start, source end)."""

    def __init__(self, text: str, rounds: tuple[list[tuple[int, int, int, int]], ...] = ()):
        self.text, self.rounds = text, rounds

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """The tape with ranges, which are in order and apart, replaced by strings that all stand for the whole range."""
        if not edits:
            return self
        text, done, at, size = [], [], 0, 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            size += a - at
            done.append((size, size + len(new), a, b))
            size, at = size + len(new), b
        return Tape("".join([*text, self.text[at:]]), (*self.rounds, done))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The range of the source that a range, which isn't empty, came from."""
        last = end - 1
        for edits in reversed(self.rounds):
            start, last = _before(edits, start)[0], _before(edits, last)[1]
        return start, last + 1


def _before(edits: list[tuple[int, int, int, int]], at: int) -> tuple[int, int]:
    """The first and the last character, before a round of edits, that a character came from."""
    i = bisect_right(edits, at, key=itemgetter(0)) - 1
    if i < 0:
        return at, at
    _, end, a, b = edits[i]
    return (a, b - 1) if at < end else (at - end + b, at - end + b)


def _spelled(low: str) -> list[tuple[int, int, str]]:
    """Edits of long rows of number words: each word becomes its digit, and what stands between two goes with the second."""
    edits = []
    for m in _SPELLED.finditer(low):
        words = list(_ONE.finditer(low, *m.span()))
        edits += [(words[i - 1].end() if i else w.start(), w.end(), _SPOKEN[w[0]]) for i, w in enumerate(words)]
    return edits


def _mixed(low: str, points: bool) -> list[tuple[int, int, str]]:
    """Edits of rows of number words and digits: spoken dots become points, and what stands beside a number word goes,
    but for a single point, if `points`; so do line breaks in a row that has number words."""
    edits = []
    for m in _MIXED.finditer(low):
        units = list(_NUMBER.finditer(low, *m.span()))
        spoken = any(u[0] in _SPOKEN for u in units)
        for i, u in enumerate(units):
            digit = _SPOKEN.get(u[0])
            if not i:
                edits += [(*u.span(), digit)] if digit else []
                continue
            start = units[i - 1].end()
            between = low[start : u.start()]
            dotted = bool(_ANY_DOT.search(between)) or (points and between == ".")
            if dotted or digit or units[i - 1][0] in _SPOKEN or (spoken and "\n" in between):
                edits.append((start, u.end(), "." * dotted + (digit or u[0])))
    return edits


def _marked(tape: Tape) -> Tape:
    """The tape with its bracketed and spoken "at" and "dot" as marks."""
    low = _lower(tape.text)
    if not any(c.search(low) for c in _MARK_CUES):
        return tape
    marks = [(*m.span(), "@" if m.lastgroup in ("at", "says") else ".") for m in _DISGUISE.finditer(low)]
    return tape.rewritten(marks) if any(x[2] == "@" for x in marks) or any(c in low for c in "@[({<") else tape


def _undisguise(text: str) -> list[Tape]:
    """The tapes of the ways to read a text's number words; none if nothing in the text is disguised."""
    low = _lower(text)
    if (text.isascii() or (_FOLDED.isdisjoint(text) and not _UNSEEN.search(text))) and not any(c.search(low) for c in _CUES):
        return []
    folded = Tape(text).rewritten([(*m.span(), "") for m in _UNSEEN.finditer(text)])
    if not text.isascii():
        folded.text = folded.text.translate(_FOLD_TABLE)
    low = _lower(folded.text)
    tapes: list[Tape] = []
    done: list[list] = []
    for numbers in (_spelled(low), _mixed(low, False), _mixed(low, True)):
        if numbers in done:
            continue
        done.append(numbers)
        tape = folded.rewritten(numbers)
        if numbers:
            tape = tape.rewritten([(*m.span(), "+") for m in _SPELLED_PLUS.finditer(_lower(tape.text))])
        tape = _marked(tape)
        if tape.text != text and all(t.text != tape.text for t in tapes):
            tapes.append(tape)
    return tapes


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that only a rewritten text shows), each by kind as listed and then by start."""
    base = find(text)
    taken = sorted(s[1:] for s in base)
    added: list[Span] = []
    for tape in _undisguise(text):
        new = []
        reach = [0, *accumulate((b for _, b in taken), max)]  # where the spans so far end
        for kind, a, b in find(tape.text):
            start, end = tape.source(a, b)
            i = bisect_left(taken, (end,))
            inside = []
            while reach[i] > start:
                i -= 1
                inside.append(taken[i])
            # An address whose look-alikes cut it short is found again as a whole.
            if not inside or kind == "email" and all(start <= x and y <= end and (x, y) != (start, end) for x, y in inside if y > start):
                new.append((kind, start, end))
        added += new
        taken = sorted([*taken, *(s[1:] for s in new)])
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, `base` and `added`: arrays of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            both = [find_all(t) for t in batch.column(1).to_pylist()]
            spans = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in pair[i]] for pair in both], kind) for i in (0, 1)]
            yield pa.record_batch([batch.column(0), *spans], names=[key, "base", "added"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(key), text_column(text).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, base {spans}, added {spans}")


def op8(docs: DataFrame) -> DataFrame:
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))

    def listed(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return detect(docs).select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added") > 0).alias("has_pii"),
    )
