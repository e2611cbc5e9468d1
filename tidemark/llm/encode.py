"""Encoding of a whole corpus with a public byte-level BPE, by a streaming transducer of bounded lookahead.

Text passes two stages. The first splits it into pre-tokens and lets one go as soon as no later character can change where
it ends. The second reads the bytes of a pre-token and lets a token go as soon as no later byte can change it. Texts of
every length take this path; the tokenizer library is asked only whether two tokens may stand side by side and which
characters belong to a class of the pattern.
"""

from __future__ import annotations

import base64
import codecs
import functools
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

try:
    import public_tokenizers
except ImportError:  # then paths and patterns are the caller's to give
    public_tokenizers = None

#: Characters that the transducer holds before pre-tokens leave.
CHUNK = 1 << 15
#: Bytes of a pre-token between two looks for stable tokens.
STEP = 1 << 12
#: Characters after a pre-token that decide where it ends, for the pattern of the public tokenizers: a contraction is an
#: apostrophe and two letters, and white space gives its last character away only if something else follows.
PATTERN_LOOKAHEAD = 2
#: Characters at either end of a pre-token that decide which part of the pattern it matches.
EDGE = 2
#: A worker keeps the ids of so many pre-tokens of at most so many characters, and so many answers about pairs; then it starts anew.
KNOWN, KNOWN_CHARS, KNOWN_PAIRS = 1 << 18, 32, 1 << 20


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_path(name: str = "byte_bpe_50k") -> str:
    return public_tokenizers.path(f"{name}.tiktoken")


def sufficient_lookahead(ranks: dict[bytes, int], alphabet: set[int] | None = None) -> int:
    """Bytes after which a token can no longer change: (number of merges) x (longest token) over the given bytes.

    A later byte reaches back over one token per merge of strictly higher priority, so over no more tokens than there
    are merges; for a run of few different bytes only the merges within them count. It bounds what a transducer holds.
    """
    own = [t for t in ranks if len(t) > 1 and (alphabet is None or alphabet.issuperset(t))]
    return max(1, len(own)) * max((len(t) for t in own), default=1)


@functools.cache
def _members(name: str) -> np.ndarray:
    """Code points of a class (``\\p{L}``, ``\\s``, ...) as the tokenizer library's tables have it.

    Other libraries know other versions of Unicode, which would split some texts elsewhere.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    one_byte = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return np.frombuffer(bytes(one_byte.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)


def class_members(name: str, ascii_only: bool = False) -> str:
    """Ranges of the characters of a class, for use in brackets; of its ASCII ones, if there are any, or of what no ASCII text holds."""
    codes = _members(name)
    codes = (codes[codes < 128] if codes[0] < 128 else codes[-1:]) if ascii_only else codes
    starts = np.flatnonzero(np.diff(codes.astype(np.int64), prepend=-2) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[starts], codes[np.r_[starts[1:] - 1, len(codes) - 1]]))


@functools.cache
def split_patterns(pattern: str) -> tuple[str, str]:
    """The pattern with the library's own classes, and the same for texts of ASCII, whose small classes are faster."""
    name = re.compile(r"\\[pP]\{\w+\}|\\[sS]")
    bracket = re.compile(r"\[(?:\\[pP]\{\w+\}|\\.|[^\]\\])*\]")

    def own(ascii_only: bool) -> str:
        inside = bracket.sub(lambda b: name.sub(lambda m: class_members(m[0], ascii_only), b[0]), pattern)
        return name.sub(lambda m: f"[{class_members(m[0], ascii_only)}]", inside)

    return own(False), own(True)


class Merges:
    """Which tokens may stand side by side, and which bytes end a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, name: str = "own", patterns: tuple[str, str] | None = None):
        self.ranks, self.bytes = ranks, {i: t for t, i in ranks.items()}
        self.encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.longest = max(map(len, ranks))
        self.suffixes = {t[k:] for t in ranks for k in range(len(t))}
        self._any, self._ascii = map(re.compile, patterns or split_patterns(pattern))
        #: Other patterns than the public tokenizers' are matched on whole texts.
        self.after = PATTERN_LOOKAHEAD if public_tokenizers and pattern == public_tokenizers.PATTERN else None
        self.known = _Known(self)
        self._fit: dict[tuple[int, int], bool] = {}

    @functools.cached_property
    def lookahead(self) -> int:
        return sufficient_lookahead(self.ranks)

    def split(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any).findall(text)

    def fit(self, a: int, b: int) -> bool:
        got = self._fit.get((a, b))
        if got is None:
            if len(self._fit) >= KNOWN_PAIRS:
                self._fit.clear()
            got = self._fit[a, b] = self.encoding._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]
        return got


class _Known(dict):
    """Ids of pre-tokens that were transduced before."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode()
        token = self.merges.ranks.get(data)
        if token is not None:
            out = [token]
        else:
            run = RunTransducer(self.merges)
            out = run.feed(data) + run.finish()
        if len(piece) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = out
        return out


class RunTransducer:
    """BPE of one endless pre-token: bytes in, tokens out as soon as no continuation can change them.

    For every position the last token of the prefix's encoding is the one token that ends there and fits its
    predecessor. All encodings of longer inputs pass through one of the last ``longest`` positions; tokens up to the
    position that all of these share are stable and leave, so what is held stays within the sufficient lookahead.
    """

    def __init__(self, merges: Merges):
        self.m, self.held, self.last, self.before = merges, bytearray(), [], None

    def _ends(self, i: int) -> int:
        for k in range(1, min(self.m.longest, i) + 1):
            t = bytes(self.held[i - k : i])
            if t not in self.m.suffixes:
                break
            token = self.m.ranks.get(t)
            if token is None:
                continue
            p = i - k
            left = self.last[p - 1] if p else self.before
            if left is None or self.m.fit(left, token):
                return token
        raise ValueError("the vocabulary does not cover this byte")

    def feed(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), STEP):
            for b in data[at : at + STEP]:
                self.held.append(b)
                self.last.append(self._ends(len(self.held)))
            if len(self.held) >= STEP:
                out += self._stable()
                if len(self.held) > self.m.lookahead:
                    raise RuntimeError("a token stayed open beyond the sufficient lookahead of the merges")
        return out

    def _path(self, i: int) -> list[int]:
        out = []
        while i:
            out.append(self.last[i - 1])
            i -= len(self.m.bytes[out[-1]])
        return out[::-1]

    def _stable(self) -> list[int]:
        n = len(self.held)
        live = set(range(max(0, n - self.m.longest + 1), n + 1))
        while len(live) > 1:
            i = max(live)
            live.discard(i)
            live.add(i - len(self.m.bytes[self.last[i - 1]]))
        common = live.pop()
        if not common:
            return []
        out = self._path(common)
        self.before = out[-1]
        del self.held[:common], self.last[:common]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.held))
        self.held, self.last, self.before = bytearray(), [], None
        return out


class Transducer:
    """Text in pieces of any size in, ids out; holds about ``chunk`` characters and the open bytes of one pre-token."""

    def __init__(self, merges: Merges, chunk: int = CHUNK):
        self.m, self.chunk, self.held, self.run, self.fed = merges, chunk, "", None, 0

    def _ids(self, pieces: list[str]) -> list[int]:
        """Ids of finished pre-tokens; the first may have been begun."""
        out = []
        if self.run is not None and pieces:
            out = self.run.feed(pieces[0][self.fed :].encode()) + self.run.finish()
            self.run, self.fed, pieces = None, 0, pieces[1:]
        out.extend(chain.from_iterable(map(self.m.known.__getitem__, pieces)))
        return out

    def feed(self, text: str) -> list[int]:
        self.held += text
        if self.m.after is None or len(self.held) <= self.chunk:
            return []
        pieces = self.m.split(self.held)
        n = end = len(self.held)
        k = len(pieces)
        while k and end > n - self.m.after:  # the ends of these may still move
            k -= 1
            end -= len(pieces[k])
        out = self._ids(pieces[:k])
        self.held = self.held[end:]
        if k < len(pieces) and len(pieces[k]) > max(self.chunk // 2, 2 * (EDGE + self.m.after)):
            # One pre-token fills the chunk. What is known to be of it goes on to the bytes; the edges that decide how it
            # matches are kept.
            sure = len(pieces[k]) - self.m.after
            self.run = self.run or RunTransducer(self.m)
            out += self.run.feed(self.held[self.fed : sure].encode())
            self.held, self.fed = self.held[:EDGE] + self.held[sure:], EDGE
        return out

    def finish(self) -> list[int]:
        out = self._ids(self.m.split(self.held))
        self.held = ""
        return out

    def parts(self, text: str) -> Iterator[list[int]]:
        for at in range(0, len(text), self.chunk):
            yield self.feed(text[at : at + self.chunk])
        yield self.finish()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))


class Decoder:
    """Ids in, text out: a byte-to-text state machine that keeps an unfinished character until its bytes are there."""

    def __init__(self, merges: Merges):
        self.m, self.state = merges, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.m.bytes[int(i)] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()


_LOADED: dict[tuple, Merges] = {}


def _merges(data: bytes, pattern: str, patterns: tuple[str, str]) -> Merges:
    """One per Python worker; the split patterns come from the driver."""
    key = (len(data), hash(data), pattern)
    if key not in _LOADED:
        _LOADED[key] = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern, patterns=patterns)
    return _LOADED[key]


def _vocabulary_on(df: DataFrame, path: str | None, pattern: str | None):
    with open(path or default_path(), "rb") as f:
        data = f.read()  # a vocabulary file: its size does not grow with the corpus
    pattern = pattern or public_tokenizers.PATTERN
    return df.sparkSession.sparkContext.broadcast(data), pattern, split_patterns(pattern)


def encode(df: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(ident, ids)``: every text as the ids of the tokenizer, without special tokens.

    The strings of special tokens in a text are ordinary text. Empty and null texts have the empty list. ``path`` is a
    ``.tiktoken`` vocabulary, ``pattern`` its pre-tokenizer's; without them the byte-level one of 50k entries is taken.
    """
    data, *how = _vocabulary_on(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(_merges(data.value, *how))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [t.encode(x) if x else [] for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[ident, "ids"])

    return df.select(ident, text).mapInArrow(run, f"`{ident}` {df.schema[ident].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(keep, n_tokens)``: the size of every text in tokens; 0 for empty and null texts."""
    data, *how = _vocabulary_on(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(_merges(data.value, *how))
        for batch in batches:
            sizes = pa.array([sum(map(len, t.parts(x))) if x else 0 for x in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), sizes], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}, n_tokens long")


def decode(df: DataFrame, ident: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(ident, text)`` back from ids; a null list gives null, bytes that are no text give replacement characters."""
    data, *how = _vocabulary_on(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _merges(data.value, *how)
        for batch in batches:
            texts = pa.array([None if x is None else Decoder(m).decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[ident, "text"])

    return df.select(ident, ids).mapInArrow(run, f"`{ident}` {df.schema[ident].dataType.simpleString()}, text string")
