"""Encoding of texts with a byte-level BPE vocabulary by a lazily determinised transducer.

The rank file's merges are compiled into a transducer over bytes. A sequence of tokens is what the merges
give exactly if every two neighbours in it are what the merges give for their joint bytes, so a reading of
the bytes so far is a chain of tokens plus an unfinished one. A state holds all readings that can still go
on, relative to the last token emitted; a token is emitted as soon as every reading agrees on it, which is
after at most the length of the longest vocabulary entry. States and transitions are made when first met.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the public pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered per worker, and transitions kept before the memo starts anew.
MEMO_WORDS, MEMO_LENGTH, MEMO_STATES = 200_000, 48, 200_000

State = tuple[int, tuple[tuple[tuple[int, ...], int], ...]]


class Transducer:
    """Bytes to token ids for one vocabulary given as ``{bytes: rank}``."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for piece, rank in ranks.items():
            node = 0
            for b in piece:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.start: State = (-1, (((), 0),))
        self.moves: dict[tuple[State, int], tuple[State, tuple[int, ...]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first; used for pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges keep ``left`` and ``right`` apart; ``left`` -1 is the start."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            whole = self.tokens[right] if left < 0 else self.tokens[left] + self.tokens[right]
            known = self.pairs[key] = self.merge(whole) == ([right] if left < 0 else [left, right])
        return known

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The next state and the tokens emitted on the way."""
        context, readings = state
        grown: list[tuple[tuple[int, ...], int]] = []
        for pending, node in readings:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and self.follows(pending[-1] if pending else context, token):
                grown.append(((*pending, token), 0))
            if self.children[nxt]:
                grown.append((pending, nxt))
        agreed = 0
        shortest = min(len(p) for p, _ in grown)
        first = grown[0][0]
        while agreed < shortest and all(p[agreed] == first[agreed] for p, _ in grown):
            agreed += 1
        emitted = first[:agreed]
        return (emitted[-1] if emitted else context, tuple((p[agreed:], n) for p, n in grown)), emitted

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        out: list[int] = []
        state, moves = self.start, self.moves
        for b in piece:
            move = moves.get((state, b))
            if move is None:
                if len(moves) >= MEMO_STATES:
                    moves.clear()
                move = moves[state, b] = self.step(state, b)
            state, emitted = move
            if emitted:
                out.extend(emitted)
        out.extend(next(p for p, node in state[1] if node == 0))  # the one reading that ends here
        return out


class Encoder:
    """Texts to ids: the pattern's pre-tokens through the transducer, with a bounded memo of short ones."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{path} has no token for {len(missing)} of the 256 bytes")
        self.split = regex.compile(PATTERN).findall
        self.transducer = Transducer(ranks)
        encoder = self

        class Memo(dict):
            def __missing__(self, word: str) -> array:
                ids = array("i", encoder.transducer.encode(word.encode("utf-8", "replace")))
                if len(word) <= MEMO_LENGTH:
                    if len(self) >= MEMO_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.memo = Memo()

    def encode(self, text: str | None) -> Iterable[int]:
        """Ids of ``text``; none for a null or empty text."""
        return chain.from_iterable(map(self.memo.__getitem__, self.split(text))) if text else ()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of the vocabulary at ``path``."""
    return Encoder(path)


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>) of every row, without special tokens; a null or empty text gives an empty array.

    ``vocabulary`` is the path of a rank file that every executor can read. The operator is a narrow map:
    no shuffle, one row out per row in, repeated rows and null ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1):
                flat.extend(own.encode(text.as_py()))
                ends.append(len(flat))
            values = pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["id", "ids"]
            )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


# The byte ranges of well-formed UTF-8, as (first byte from, to, continuation bytes, second byte from, to).
_UTF8 = [
    (0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
]


class Utf8Stream:
    """Incremental UTF-8: takes the bytes of one token at a time and gives the characters completed so far.

    A byte that cannot go on ends the open sequence with U+FFFD, as does the end of the stream.
    """

    def __init__(self) -> None:
        self.open, self.left, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def _begin(self, b: int) -> str:
        for first, last, more, low, high in _UTF8:
            if first <= b <= last:
                if not more:
                    return chr(b)
                self.open, self.left, self.low, self.high = bytearray([b]), more, low, high
                return ""
        return "�"

    def feed(self, piece: bytes) -> str:
        if not self.left and piece.isascii():
            return piece.decode("ascii")
        out = []
        for b in piece:
            if self.left and self.low <= b <= self.high:
                self.open.append(b)
                self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                if not self.left:
                    out.append(self.open.decode("utf-8"))
            else:
                if self.left:
                    self.left = 0
                    out.append("�")
                out.append(self._begin(b))
        return "".join(out)

    def end(self) -> str:
        left, self.left = self.left, 0
        return "�" if left else ""


def decode_ids(ids: Iterable[int], tokens: dict[int, bytes]) -> str:
    """The text of ``ids``, token by token; an unknown id counts as U+FFFD."""
    stream = Utf8Stream()
    return "".join([stream.feed(tokens[i]) if i in tokens else stream.end() + "�" for i in ids]) + stream.end()


def decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) of every row; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary).transducer.tokens
        for batch in batches:
            texts = [decode_ids((i for i in x.as_py() or () if i is not None), tokens) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
