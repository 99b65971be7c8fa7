"""Exact byte-level BPE by backtracking, and the operators that encode and decode a corpus with it.

The merges of BPE never have to be replayed. A sequence of tokens is the BPE encoding of its bytes exactly when
every two neighbours are *compatible*: encoding the bytes of the two gives the two again. So an encoder can take
the longest token at a position (found by Aho-Corasick), keep it when it is compatible with its predecessor, else
try the next shorter prefix token, else step back. Positions that turned out to be dead ends are marked, so each
is left at most once and the time is linear in the length of the piece.

Null and empty texts have defined ids: the empty list.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import pick

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_ENTRIES = 200_000
PAIR_ENTRIES = 1_000_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of a byte-level vocabulary -> byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingEncoder:
    """Encoder and decoder for one byte-level BPE vocabulary (the JSON of the ``tokenizers`` library)."""

    def __init__(self, vocabulary_json: bytes):
        import ahocorasick
        import regex

        model = json.loads(vocabulary_json)["model"]
        to_byte = _byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        ids = {raw(k): v for k, v in model["vocab"].items()}
        self.size = max(ids.values()) + 1
        self.token = [b""] * self.size
        for k, v in ids.items():
            self.token[v] = k
        # Merges in order of priority; ``born`` is the priority at which a token comes into being.
        self.pair: dict[tuple[int, int], int] = {}
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.born = [-1] * self.size
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = ids[raw(a)], ids[raw(b)]
            z = ids[self.token[x] + self.token[y]]
            self.pair[x, y] = rank
            self.made.append(z)
            if self.born[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, rank
        self.length = [len(t) for t in self.token]
        # Only tokens that merging can reach take part; a vocabulary may hold others.
        usable = [v for v in range(self.size) if self.length[v] == 1 or self.born[v] >= 0]
        self.trie = ahocorasick.Automaton()
        for v in usable:
            self.trie.add_word(self.token[v].decode("latin-1"), v)
        self.trie.make_automaton()
        known = {self.token[v]: v for v in usable}
        self.shorter = [-1] * self.size
        for v in usable:
            t = self.token[v]
            self.shorter[v] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pieces = regex.compile(PIECES).findall
        # Decoding: all token bytes in one blob, token v at offset[v]:offset[v + 1].
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)

    def fits(self, a: int, b: int) -> bool:
        """Row (a, b) of the pair-compatibility table; rows are worked out on first use."""
        key = a * self.size + b
        known = self.compatible.get(key)
        if known is None:
            known = self._work_out(a, b)
            if len(self.compatible) < PAIR_ENTRIES:
                self.compatible[key] = known
        return known

    def _work_out(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens from the last one on and look whether, at any time, BPE would rather
        have merged across the border."""
        before = len(self.made)  # merges of a lower priority than this have happened on neither side
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < before:
                return False
            ra, rb = self.born[a], self.born[b]
            if ra < 0 and rb < 0:
                return True
            # The right side's merge of equal priority comes later, as BPE goes from left to right.
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        text = piece.encode("utf-8", "replace").decode("latin-1")
        n = len(text)
        longest = array("i", [-1]) * n
        length = self.length
        for end, v in self.trie.iter(text):
            start = end + 1 - length[v]
            if longest[start] < 0 or length[longest[start]] < length[v]:
                longest[start] = v
        dead = bytearray(n + 1)
        out: list[int] = []
        at, v = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while v >= 0 and (dead[at + length[v]] or (last >= 0 and not self.fits(last, v))):
                v = self.shorter[v]
            if v >= 0:
                out.append(v)
                at += length[v]
                v = longest[at] if at < n else -1
            elif out:
                dead[at] = 1
                v = out.pop()
                at -= length[v]
            else:
                raise ValueError("the vocabulary cannot express this text")
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache, add = self.cache, out.extend
        for p in self.pieces(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(cache) < CACHE_ENTRIES and len(p) < 64:
                    cache[p] = ids
            add(ids)
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> bytes:
        """Bytes of ids, gathered from the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[where].tobytes()


_BUILT: dict[bytes, BacktrackingEncoder] = {}


def encoder(vocabulary: bytes) -> BacktrackingEncoder:
    """One encoder per Python worker and vocabulary."""
    import hashlib

    key = hashlib.sha256(vocabulary).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = BacktrackingEncoder(vocabulary)
    return _BUILT[key]


def _vocabulary(df: DataFrame, tokenizer: str):
    """The vocabulary file as a broadcast: about 1.5 MB whatever the corpus, so workers need not have the file."""
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(column: pa.Array) -> Iterator[str | None]:
    for x in column:
        b = x.as_py()
        yield None if b is None else b.decode("utf-8", "replace")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id, ids array<int>)``: every row of ``df`` as token ids, without special tokens.

    One narrow pass: no shuffle, only the two columns are read. Null and empty texts give ``[]``. Strings of
    special tokens in a text are ordinary text. Bytes that are not UTF-8 are read as U+FFFD. Repeated rows and
    ids come out as often as they come in; an empty table gives an empty table. Other columns are not looked at.
    """
    df = pick(df, id_col, text_col)
    vocabulary = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in _texts(batch.column(1)):
                flat.extend(enc.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    src = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens bigint`` of every row; null and empty texts have 0."""
    vocabulary = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            n = pa.array([enc.count(t) for t in _texts(batch.column(len(keep)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    src = df.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{schema}, n_tokens bigint")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id, text)``: the inverse of :func:`encode_corpus`; null ids give a null text."""
    df = pick(df, id_col, ids_col)
    vocabulary = _vocabulary(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            out = [None if not x.is_valid else enc.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return df.select(id_col, F.col(ids_col).alias("_ids")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")
