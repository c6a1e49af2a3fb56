"""Token counts by a compiled finite-state tokenizer (word-end BPE).

The split pattern of the vocabulary is compiled into a deterministic transducer over character classes. A transition is
annotated with the tokens that it emits: one that starts at the character read, and one that started at the character
before (a letter after an apostrophe that turns out not to continue a contraction). The characters of a batch are cut
into chunks of equal length; each chunk is run from every state at once, which gives its state map, the maps are
composed by a parallel prefix scan, and the chunks are then replayed from their true first states.

Inside a word a second machine counts. A sequence of tokens is what BPE gives exactly if each two neighbours stay two when
they are merged on their own, so the tokens are the states, and a transition leads from the last token of a prefix to
the one token that may follow it and ends at the symbol read; it emits one token more than that prefix had. Transitions
are compiled when two tokens first meet.

Defined results: a null or empty text has no tokens and no bytes; special strings inside a text count as one token, as
the library does by default; an empty table gives an empty result; repeated rows are counted one by one; other columns
are not read. Nothing is truncated and no rows are shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .characters import classes, code_points, lower
from .common import text_column

CHUNK = 256
MEMO = 300_000
_NEVER = 1 << 62
#: Characters that are handled at a time.
BATCH = 1 << 20

# Character classes and states of the transducer.
SPACE, DIGIT, MARK, QUOTE, LETTER, ENDS, OPENS_E, OPENS_L, E = range(9)
FREE, WORD, MARKS, QUOTED, NEEDS_E, NEEDS_L = range(6)


def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, and whether a token starts here or started one before, by state and class."""
    to, here, before = np.zeros((6, 9), np.uint8), np.zeros((6, 9), bool), np.zeros((6, 9), bool)
    plain = {SPACE: (FREE, False), DIGIT: (FREE, True), MARK: (MARKS, True), QUOTE: (QUOTED, True)} | {c: (WORD, True) for c in range(LETTER, E + 1)}
    for state in range(6):
        for c, (s, start) in plain.items():
            if state == WORD and c >= LETTER:
                start = False
            if state in (MARKS, QUOTED) and c in (MARK, QUOTE):
                s, start = MARKS, False
            if state == QUOTED and c in (ENDS, OPENS_E, OPENS_L):
                s, start = {ENDS: FREE, OPENS_E: NEEDS_E, OPENS_L: NEEDS_L}[c], False
            if state in (NEEDS_E, NEEDS_L):
                done = c == (E if state == NEEDS_E else OPENS_L)
                before[state, c] = not done
                if c >= LETTER:
                    s, start = FREE if done else WORD, False
            to[state, c], here[state, c] = s, start
    return to, here, before


def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.array([MARK, LETTER, DIGIT, SPACE], np.uint8)[classes()]  # by characters.OTHER, LETTER, NUMBER, SPACE
    for chars, c in (("'", QUOTE), ("stmd", ENDS), ("rv", OPENS_E), ("l", OPENS_L), ("e", E)):
        kinds[[ord(x) for x in chars]] = c
    return kinds


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in the vocabulary: itself if it is printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Counter:
    def __init__(self, vocabulary: dict):
        self.pairs = {tuple(m): i for i, m in enumerate(vocabulary["merges"])}
        self.end = vocabulary["suffix"]
        self.special = re.compile("|".join(map(re.escape, vocabulary["special"])) or "(?!)")
        self.to, self.here, self.before = _machine()
        self.kinds = _classes()
        self.letters = _byte_letters()
        self.symbols = {*self.letters, *(x + self.end for x in self.letters)}
        #: Tokens by how many symbols they have; each is the merge of two others, down to single symbols.
        merged = {a + b for a, b in self.pairs}
        self.longest = max((len(t.removesuffix(self.end)) for t in merged), default=1)
        self.tokens = self.symbols | merged
        self.follows: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a few symbols, merge by merge."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, i = min((self.pairs.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: str) -> list[str]:
        """The symbols of a token."""
        body = token.removesuffix(self.end) if self.end and token not in self.letters else token
        out = list(body)
        if len(body) < len(token):
            out[-1] += self.end
        return out

    def transition(self, left: str, right: str) -> bool:
        """Whether there is a transition: both tokens stay as they are side by side (`left` is empty at a word's start)."""
        if len(self.follows) > MEMO:
            self.follows.clear()
        known = self.follows[left, right] = self.merged([*self.split(left), *self.split(right)]) == [left, right][not left :]
        return known

    def word(self, word: str) -> int:
        body = "".join([self.letters[b] for b in word.encode()])
        n, tokens, follows = len(body), self.tokens, self.follows
        last: list[str | None] = [""]
        count = [0]
        for i in range(1, n + 1):
            end = self.end if i == n else ""
            found, total = None, 0
            # One token fits where the prefix has tokens at all; most are short.
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                token = body[j:i] + end
                if token in tokens and (left := last[j]) is not None:
                    if (known := follows.get((left, token))) is None:
                        known = self.transition(left, token)
                    if known:
                        found, total = token, count[j] + 1
                        break
            last.append(found)
            count.append(total)
        return count[n]

    def states(self, kinds: np.ndarray) -> np.ndarray:
        """The state before each character."""
        n = len(kinds)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, SPACE, np.uint8)
        grid[:n] = kinds
        columns = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        flat = self.to.ravel()
        maps = np.tile(np.arange(6, dtype=np.uint8), (rows, 1))
        for column in columns:
            maps = flat[maps * np.uint8(9) + column[:, None]]
        step = 1
        while step < rows:  # maps[i] then leads from the state before chunk i - 2 step + 1 to the one after chunk i
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), 1)
            step *= 2
        state = np.concatenate([[FREE], maps[:-1, FREE]]).astype(np.uint8)
        out = np.empty((CHUNK, rows), np.uint8)
        for k, column in enumerate(columns):
            out[k] = state
            state = flat[state * np.uint8(9) + column]
        return out.T.ravel()[:n]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces, owners, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.special.split(text)
            total[i] = len(parts) - 1
            for part in parts:
                if part:
                    if not unicodedata.is_normalized("NFC", part):
                        part = unicodedata.normalize("NFC", part)
                    pieces.append(lower(part))
                    owners.append(i)
        if not pieces:
            return total
        text = "\n".join(pieces) + "\n"
        kinds = self.kinds[code_points(text)]
        at = self.states(kinds) * np.uint8(9) + kinds
        starts = self.here.ravel()[at]
        starts[:-1] |= self.before.ravel()[at[1:]]
        bounds = np.flatnonzero(starts | (kinds == SPACE))
        first = np.flatnonzero(starts[bounds])
        begin, end = bounds[first], bounds[first + 1]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        words = [text[b:e] for b, e in zip(begin.tolist(), end.tolist())]
        for w in set(words):
            if w not in memo:
                memo[w] = self.word(w)
        each = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([len(p) + 1 for p in pieces])
        sums = np.concatenate([[0], np.cumsum(each)])
        upto = sums[np.searchsorted(begin, ends)]
        np.add.at(total, np.array(owners), np.diff(upto, prepend=0))
        return total


#: The normalisers and the split pattern that the first machine is compiled from.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def load_vocabulary(path: str) -> dict:
    """Merges, suffix and special strings of a tokenizer file; files that split texts in another way are refused."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    steps = [n["type"] for n in whole["normalizer"]["normalizers"]]
    split = whole["pre_tokenizer"]["pretokenizers"][0]
    if steps != _NORMAL or split["type"] != "Split" or split["pattern"] != {"Regex": _PATTERN} or whole["model"]["type"] != "BPE":
        raise ValueError(f"{path}: not a tokenizer of this kind")
    merges = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
    return {"merges": merges, "suffix": whole["model"]["end_of_word_suffix"] or "", "special": [t["content"] for t in whole["added_tokens"]]}


#: The counter that this Python worker used last, which outlives its tasks.
_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, `n_bytes` (UTF-8) and `n_tokens` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        if path not in _counters:
            _counters.clear()
            _counters[path] = Counter(shared.value)
        counter = _counters[path]
        for batch in batches:
            texts, sizes, tokens = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), []
            i = 0
            while i < len(texts):
                j, size = i + 1, sizes[i]
                while j < len(texts) and size + sizes[j] <= BATCH:
                    size += sizes[j]
                    j += 1
                tokens.append(counter.counts(texts[i:j]))
                i = j
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.concatenate(tokens or [np.zeros(0, np.int64)]))], names=[key, "n_bytes", "n_tokens"])

    t = text_column(text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")


def op6(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    counted = count_tokens(docs, path or public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
