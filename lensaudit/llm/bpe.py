"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token exactly one token can come last in its encoding. A suffix automaton over the tokens reads a pre-token once: its state is
the longest suffix of the prefix that begins a token, suffix links lead to shorter ones, and dictionary links from token to token among these. A token that
ends a prefix is right if it is compatible with the last token of the prefix before it, that is, if the two, side by side, encode to themselves.
Back-pointers give the ids.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aranges, operator, text_of

#: Fixed by the tokenizer: how byte-level BPE splits text before merges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Encodings of pre-tokens that a worker keeps: at most twice so many, the older half goes first.
CACHED = 200_000
#: Pairs of tokens whose compatibility a worker keeps.
PAIRS = 250_000
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Fixed by the format: the character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        names = {name: bytes(alphabet[c] for c in name) for name in spec["model"]["vocab"]}
        size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.bytes = [b""] * size
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        ids = spec["model"]["vocab"]
        for name, i in ids.items():
            self.bytes[i] = names[name]
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            self.rank.setdefault(ids[a] << 20 | ids[b], rank)
            if self.left[whole] < 0:
                self.born[whole], self.left[whole], self.right[whole] = rank, ids[a], ids[b]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self._split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._pre_tokens = regex.compile(PRE_TOKENS).findall
        self._fits: dict[int, bool] = {}
        self._build(self._reachable(set(ids.values()) - set(self.special.values())))
        self._piece = _Cache(self._encode_piece)
        self._pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._length = np.array([len(x) for x in self.bytes])
        self._begin = np.cumsum(self._length) - self._length

    def _stable(self, a: int, b: int, until: int) -> bool:
        """No merge joins a and b across their border before the time `until`.

        Time runs back: the token made last of the two at the border is undone, until both are single bytes. A pair at the border
        merges if its rank comes before either side is used up; of equal ranks the left pair goes first.
        """
        ends_a = ends_b = until
        rank, born, left, right = self.rank, self.born, self.left, self.right
        while True:
            m = rank.get(a << 20 | b)
            if m is not None and m < ends_a and (m < ends_b or m == ends_b < until):
                return False
            if born[a] > born[b]:
                ends_a, a = born[a], right[a]
            elif born[b] >= 0:
                ends_b, b = born[b], left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._stable(a, b, _NEVER)
        return known

    def _reachable(self, ids: set[int]) -> list[int]:
        """Tokens that can come up; the own bytes of the others encode to something else."""
        good: dict[int, bool] = {}
        for i in sorted(ids, key=lambda i: self.born[i]):
            a, b = self.left[i], self.right[i]
            good[i] = (len(self.bytes[i]) == 1) if a < 0 else good[a] and good[b] and self._stable(a, b, self.born[i])
        return [i for i in ids if good[i]]

    def _build(self, tokens: list[int]) -> None:
        """The suffix automaton: steps (state, byte) -> state, suffix links, the token that a state is, and dictionary links to the longest token among a state's suffixes."""
        steps: dict[int, int] = {}
        above, byte_in, depth, token_of = [0], [0], [0], [-1]
        for i in tokens:
            state = 0
            for byte in self.bytes[i]:
                after = steps.get(state << 8 | byte)
                if after is None:
                    after = steps[state << 8 | byte] = len(above)
                    above.append(state)
                    byte_in.append(byte)
                    depth.append(depth[state] + 1)
                    token_of.append(-1)
                state = after
            token_of[state] = i
        suffix, shorter = [0] * len(above), [0] * len(above)
        for state in sorted(range(1, len(above)), key=depth.__getitem__):
            at, byte = above[state], byte_in[state]
            while at:
                at = suffix[at]
                if (at << 8 | byte) in steps:
                    suffix[state] = steps[at << 8 | byte]
                    break
            to = suffix[state]
            shorter[state] = to if token_of[to] >= 0 else shorter[to]
        self._steps, self._suffix, self._shorter, self._depth, self._token = steps, suffix, shorter, depth, token_of
        chain = [(token, depth[state], shorter[state]) for state, token in enumerate(token_of)]
        #: Of each state: its longest token, that token's length, and the state of the next shorter one.
        self._match = [chain[state] if token >= 0 else chain[shorter[state]] for state, token in enumerate(token_of)]

    def _fall(self, state: int, byte: int) -> int:
        """The step from a state that has none of its own: that of its longest suffix that has one."""
        while state:
            state = self._suffix[state]
            after = self._steps.get(state << 8 | byte)
            if after is not None:
                return after
        return 0

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        step, fall, matches, fits, compatible = self._steps.get, self._fall, self._match, self._fits.get, self.compatible
        last, back = [-1], [0]  # of each prefix: its last token, and the prefix before that
        state = end = 0
        for byte in data:
            end += 1
            after = step(state << 8 | byte)
            state = fall(state, byte) if after is None else after
            token, length, shorter = matches[state]
            while token >= 0:
                at = end - length
                if not at:
                    break
                known = fits(last[at] << 20 | token)
                if known or (known is None and last[at] >= 0 and compatible(last[at], token)):
                    break
                token, length, shorter = matches[shorter]
            last.append(token)
            back.append(end - length)
        ids = []
        while end:
            ids.append(last[end])
            end = back[end]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; special tokens in the text are recognised."""
        get = self._piece.__getitem__
        if not self._split_special:
            return b"".join(map(get, self._pre_tokens(text)))
        parts = self._split_special.split(text)
        return b"".join(struct.pack("<I", self.special[x]) if i % 2 else b"".join(map(get, self._pre_tokens(x))) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text that the ids' bytes give, U+FFFD for what isn't UTF-8."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        parts = (tokens[lo : lo + (1 << 18)] for lo in range(0, len(tokens), 1 << 18))
        return b"".join(self._pool[aranges(self._begin[x], self._length[x])].tobytes() for x in parts).decode("utf-8", "replace")


class _Cache(dict):
    """What make returns for short texts; a dictionary, so that a hit costs no Python call."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text) or self.make(text)
        if len(text) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


_LOADED: dict[int, Bpe] = {}


def _load(content: bytes) -> Bpe:
    """One encoder for each worker and vocabulary."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Bpe(content)
    return _LOADED[key]


def _run(vocabulary, work, limit: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(vocabulary.value)
        for batch in batches:
            lo, size, held = 0, 0, []
            for i, x in enumerate(batch.column(1)):
                held.append(work(bpe, x.as_py()))
                size += sum(map(len, held[-1]))
                if size >= limit or i + 1 == batch.num_rows:
                    yield batch.column(0).slice(lo, i + 1 - lo), held
                    lo, size, held = i + 1, 0, []

    return run


def _encoded(vocabulary):
    rows = _run(vocabulary, lambda bpe, text: (ids := bpe.encode(text), bpe.decode(ids)))

    def run(batches):
        for idents, held in rows(batches):
            yield pa.RecordBatch.from_arrays([idents, pa.array([x[0] for x in held], pa.binary()), pa.array([x[1] for x in held], pa.string())], ["ident", "ids", "decoded"])

    return run


def _decoded(vocabulary):
    rows = _run(vocabulary, lambda bpe, ids: (bpe.decode(ids),))

    def run(batches):
        for idents, held in rows(batches):
            yield pa.RecordBatch.from_arrays([idents, pa.array([x[0] for x in held], pa.string())], ["ident", "text"])

    return run


def _vocabulary(df: DataFrame, path: str):
    """The file's content, a few MB whatever the data; it is read on the driver only."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


@operator
def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id, ids (binary: little-endian unsigned 32-bit integers), n_tokens, decoded (the text the ids give).

    Null texts count as empty and have no ids; texts of any length are encoded whole, one row of them at a time. Rows are independent of each other:
    repeated rows and null ids are kept as they are, an empty table gives an empty result, other columns are not looked at.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("ident"), text_of(text_column).alias("text")).mapInArrow(_encoded(_vocabulary(docs, path)), f"ident {kind}, ids binary, decoded string")
    return out.select(F.col("ident").alias(id_column), (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")


@operator
def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The texts of ids as encode() gives them; null ids give the empty text, bytes that aren't UTF-8 U+FFFD."""
    kind = encoded.schema[id_column].dataType.simpleString()
    rows = encoded.select(F.col(id_column).alias("ident"), F.coalesce(F.col(ids_column), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(_decoded(_vocabulary(encoded, path)), f"ident {kind}, text string").withColumnRenamed("ident", id_column)
