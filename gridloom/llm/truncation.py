"""Finding texts that were cut off: by a field limit or in transfer.

There are no labels, so they are made: intact values are cut at random places and at the limits of their source
(positives), and kept whole, or without their final punctuation (negatives). A logistic regression over hashed
features of the closing characters, the punctuation, the form of the last line, how complete the last words are
elsewhere in the corpus, and the distance to the source's length limits is fitted on a bounded sample of these
and then scores every record.

Texts are worked on as arrays of code points, many texts at a time: words are runs of word characters, their hashes
are differences of one running polynomial hash, and all features of a batch come out as one integer matrix.

What is bounded: about ``train_rows`` records of at most ``TRAIN_CHARS`` characters are taken for the fit, by
their hash; the word statistics, which cover every word of every text, are kept in ``2**STAT_BITS`` counters (a hashed
sketch) however large the corpus is; limits are a few for a source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import cut, pick

STAT_BITS = 20
FEATURE_BITS = 18
TRAIN_ROWS = 20_000
TRAIN_CHARS = 20_000
THRESHOLD = 0.5
CHUNK = 1 << 20  # characters that are worked on at a time
MARGIN = 1 << 16  # context around a piece of a text longer than a chunk
TAIL = 1024  # characters before the end that the features of words and lines look at

_FINAL = re.compile(r"[.!?][\"'”“’»)\]]*\s*$")
_CUT_MARKS = ("…", "...", " [...]")
_NUMBER_LEFT = re.compile(r"\d+\s*?(\n|$)")
_HEAD = re.compile(r"\s*(- |-- |\(|\[|\{|\"|```|\d{4}-\d\d-\d\d|[A-Za-zÀ-ž]+:)?")
_HEADS = {"": 0, "-": 1, "--": 2, "(": 3, "[": 4, "{": 5, '"': 6, "```": 7}
_OPEN = ",;:-–(/\"'=+&@#"

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WORD, DIGIT, SPACE, LINE, STOP, MARK, CLOSER, LOWER_CASE, LETTER = (1 << i for i in range(9))


class _Chars:
    """Kinds and lower case of code points, looked up once for each that occurs."""

    def __init__(self):
        self.known = np.zeros(0x110000, dtype=bool)
        self.kind = np.zeros(0x110000, dtype=np.uint16)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def learn(self, code: np.ndarray) -> None:
        seen = np.zeros(0x110000, dtype=bool)
        seen[code] = True
        for i in np.flatnonzero(seen & ~self.known):
            c = chr(i)
            flags = (
                (c.isalnum() or c == "_", WORD), (c.isdecimal(), DIGIT), (c.isspace(), SPACE), (c in "\n\r", LINE), (c in ".!?…", STOP),
                (c in ".!?", MARK), (c in "\"'”“’»)]", CLOSER), (c.islower(), LOWER_CASE), (c.isalpha(), LETTER),
            )
            self.kind[i] = sum(bit for on, bit in flags if on)
            low = c.lower()
            self.lower[i] = ord(low) if len(low) == 1 else i
            self.known[i] = True


@cache
def _chars() -> _Chars:
    return _Chars()


class _Powers:
    """``BASE ** k`` and its inverse modulo ``2 ** 64``."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            steps = [np.full(n, b, dtype=U) for b in (BASE, pow(BASE, -1, 1 << 64))]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=U) for s in steps)


@cache
def _powers() -> _Powers:
    return _Powers()


class _Runs:
    """Hashes of ranges of a sequence, all by one running sum: equal contents have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray, kept: np.ndarray):
        powers = _powers()
        self.at = np.concatenate([[0], np.cumsum(kept)])  # place in the whole sequence -> place among the kept
        powers.grow(int(self.at[-1]) + 1)
        own = values[kept].astype(U) + U(1)
        self.sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(own * powers.up[: len(own)], dtype=U)])
        self.down = powers.down

    def kept(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of the kept places ``first`` to ``last``, the latter excluded."""
        return _mixed((self.sums[last] - self.sums[first]) * self.down[first])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.kept(self.at[start], self.at[end])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def _joined(*parts) -> np.ndarray:
    """One hash of several arrays of numbers."""
    h = U(0x243F6A8885A308D3)
    for p in parts:
        p = np.asarray(p)
        p = p if p.dtype == U else p.astype(np.int64).astype(U)
        h = _mixed((h ^ p) * U(0x94D049BB133111EB) + U(1))
    return h


class _Words:
    """The words of several texts that are laid out one behind the other, with one zero after each."""

    def __init__(self, texts: list[str]):
        chars = _chars()
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.code = code = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars.learn(code)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        self.last = self.first + self.sizes
        self.kind = kind = chars.kind[code].copy()
        kind[self.last] = 0
        word = (kind & WORD) != 0
        digit = (kind & DIGIT) != 0
        edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Digits count as one zero, letters without their case.
        repeated = digit & np.concatenate([[False], digit[:-1]])
        self.norm = _Runs(np.where(digit, np.uint32(48), chars.lower[code]), ~repeated)
        self.hash = self.norm.range(self.start, self.end)
        self.text = np.searchsorted(self.first, self.start, side="right") - 1
        # A stop is a mark with the closing characters behind it; it ends a sentence before white space or the end.
        place = np.arange(len(code))
        behind = np.maximum.accumulate(np.where((kind & CLOSER) != 0, -1, place))
        self.stop = (kind[np.maximum(behind, 0)] & STOP) != 0
        self.mark = (kind[np.maximum(behind, 0)] & MARK) != 0
        after = np.concatenate([kind[1:], [np.uint16(0)]])
        edges = np.zeros(len(code), dtype=bool)
        edges[np.maximum(self.last - 1, 0)] = True
        self.sentence = self.stop & (((after & SPACE) != 0) | edges) | ((kind & LINE) != 0)
        gap = self.stop & (((after & (SPACE | WORD)) != 0) | edges) | ((kind & LINE) != 0)
        done = np.concatenate([[0], np.cumsum(gap)])
        following = np.concatenate([self.start[1:], [len(code)]])
        self.same = np.concatenate([self.text[1:] == self.text[:-1], [False]]) if len(self.text) else np.zeros(0, dtype=bool)
        self.ends = (done[following] - done[self.end]) > 0 if len(self.end) else np.zeros(0, dtype=bool)

    def events(self, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether a sentence or line ends right after) of every word and word pair but the last word's of a text,
        of which nobody knows whether it is whole. ``low`` and ``high``: the part of each text in which words begin."""
        own = self.same.copy()
        if low is not None:
            at = self.start - self.first[self.text]
            own &= (at >= low[self.text]) & (at < high[self.text])
        paired = np.concatenate([[False], self.same[:-1] & ~self.ends[:-1]]) if len(own) else own
        paired = paired & own
        before = np.concatenate([[U(0)], self.hash[:-1]]) if len(own) else self.hash
        return np.concatenate([_slot(0, self.hash[own]), _slot(before[paired], self.hash[paired])]), np.concatenate([self.ends[own], self.ends[paired]])


def _slot(before, word: np.ndarray) -> np.ndarray:
    return (_joined(np.broadcast_to(np.asarray(before, dtype=U), word.shape), word) & U((1 << STAT_BITS) - 1)).astype(np.int64)


def word_events(text: str) -> list[tuple[int, int]]:
    """The events of one text, see :meth:`_Words.events`."""
    return [(int(s), int(e)) for s, e in zip(*_Words([text]).events(), strict=True)]


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Groups of texts of about ``CHUNK`` characters. A longer text comes in pieces with ``MARGIN`` characters of context
    on either side, and each of its words counts in the piece it begins in."""
    held: list[tuple[str, int, int]] = []
    size = 0
    for text in texts:
        for at in range(0, len(text), CHUNK):
            low = max(0, at - MARGIN)
            part = text if len(text) <= CHUNK else text[low : at + CHUNK + MARGIN]
            held.append((part, at - low, min(len(text), at + CHUNK) - low))
            size += len(part)
            if size >= CHUNK:
                yield [h[0] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held])
                held, size = [], 0
    if held:
        yield [h[0] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held])


def _decoded(column: pa.Array) -> list[str]:
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def word_statistics(texts: DataFrame) -> DataFrame:
    """``(slot, total, ends)`` over all words of all texts; each task counts first, so the shuffle carries at most
    ``2**STAT_BITS`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << STAT_BITS
        total, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for batch in batches:
            for part, low, high in _pieces(_decoded(batch.column(0))):
                slots, end = _Words(part).events(low, high)
                total += np.bincount(slots, minlength=n)
                ends += np.bincount(slots[end], minlength=n)
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 1 << 16):
            own = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own]), pa.array(ends[own])], names=["slot", "total", "ends"])

    parts = texts.mapInArrow(run, "slot int, total bigint, ends bigint")
    return parts.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))


def length_limits(hist: DataFrame, surprise: float = 18.0, times: float = 6.0) -> DataFrame:
    """``(source, chars)`` of a histogram (source, chars, n): lengths at which far more texts of a source end than at the
    lengths around.

    The usual number is the mean of the 20 lengths on either side. A limit is a length of at least 30 characters with
    ``times`` as many texts, and so many that the Poisson deviance from the usual number is at least ``surprise`` (the
    same test for small and large sources).
    """
    hist = hist.where("chars >= 30")
    around = Window.partitionBy("source").orderBy("chars").rangeBetween(-20, 20)
    usual = F.greatest((F.sum("n").over(around) - F.col("n")) / 40.0, F.lit(1 / 40))
    deviance = F.col("n") * F.log(F.col("n") / F.col("usual")) - (F.col("n") - F.col("usual"))
    return hist.withColumn("usual", usual).where((F.col("n") >= times * F.col("usual")) & (deviance >= surprise)).select("source", "chars")


def _bits(n: np.ndarray) -> np.ndarray:
    """Binary digits of whole numbers."""
    return np.frexp(np.asarray(n, dtype=np.float64))[1]


class Scorer:
    """Turns texts into hashed features, given the statistics of the corpus."""

    def __init__(self, slots: np.ndarray, totals: np.ndarray, ends: np.ndarray, limits: dict[str, list[int]]):
        self.known = np.zeros(1 << STAT_BITS, dtype=np.uint8)
        self.often = np.full(1 << STAT_BITS, -1, dtype=np.int8)
        self.known[slots] = np.minimum(_bits(totals), 9)
        self.often[slots] = (ends / np.maximum(totals, 1) * 8).astype(np.int8)
        self.limits = {s: np.array(sorted(v), dtype=np.int64) for s, v in limits.items()}

    def below_limit(self, sizes: np.ndarray, sources: list[str | None]) -> np.ndarray:
        """How far each length is below the next limit of its source: 0 on it, 1 within 3 characters, 2 further."""
        out = np.full(len(sizes), 2, dtype=np.int64)
        names = np.array([s or "" for s in sources], dtype=object)
        for s in set(names.tolist()) & set(self.limits):
            own = np.flatnonzero(names == s)
            at = np.searchsorted(self.limits[s], sizes[own])
            far = np.append(self.limits[s], np.iinfo(np.int64).max)[at] - sizes[own]
            out[own] = np.where(far == 0, 0, np.where(far <= 3, 1, 2))
        return out

    def features(self, texts: list[str], sources: list[str | None]) -> np.ndarray:
        """(texts x features) numbers below ``2**FEATURE_BITS``. Brackets, quotes, fences and lines are counted in the whole
        text, all else is read from its last ``TAIL`` characters."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        bodies = [t.rstrip() for t in texts]
        counted = np.array([
            (
                len(b), b.count("\n"), b.count("```") & 1, b.count('"') & 1,
                b.count("{") + b.count("[") + b.count("(") - b.count("}") - b.count("]") - b.count(")"), _head(b), len(b) - (nl := b.rfind("\n")) - 1, len(b) - b.rfind("\n", 0, max(nl, 0)) - 1 if nl >= 0 else -1,
                0 if len(b) == len(t) else 1 if ("\n" in t[len(b):] or "\r" in t[len(b):]) else 2,
            )
            for t, b in zip(texts, bodies, strict=True)
        ], dtype=np.int64).reshape(n, 9)
        length, lines, fence, quotes, depth, head, own_line, two_lines, space = counted.T
        w = _Words([b[-TAIL:] for b in bodies])
        code, kind, end = w.code, w.kind, w.last
        tail = end - w.first
        lower = _chars().lower

        def char(back: int) -> np.ndarray:
            """The character ``back`` places before the end, 0 where there is none."""
            return np.where(tail >= back, code[np.maximum(end - back, 0)], 0).astype(np.int64)

        # The last three words, unless a sentence ends between them.
        number = np.searchsorted(w.text, np.arange(n), side="right")
        begin = np.searchsorted(w.text, np.arange(n), side="left")
        have = number - begin
        ends = np.append(w.ends, False)
        hashes = np.append(w.hash, U(0))

        def word(back: int) -> np.ndarray:
            return np.where(have >= back, number - back, len(w.hash))

        i1, i2, i3 = word(1), word(2), word(3)
        two = (have >= 2) & ~ends[i2]
        three = two & (have >= 3) & ~ends[i3]
        w1, w2, w3 = hashes[i1], np.where(two, hashes[i2], U(0)), np.where(three, hashes[i3], U(0))
        closed = np.where(have >= 1, np.append(w.end, 0)[i1], np.maximum(end - 3, w.first))
        rest = end - closed
        closing = w.norm.range(closed, np.minimum(closed + 6, end))
        final = (tail > 0) & w.mark[np.maximum(end - 1, 0)] & (rest > 0)
        last = char(1)
        mark = np.select([last == 0xFFFD, (rest == 1) & (last == 0x2026), rest == 0, final, np.isin(last, [ord(c) for c in _OPEN])], [0, 1, 2, 3, 4], 5)
        at_end = kind[np.maximum(end - 1, 0)]
        form = np.where((at_end & DIGIT) != 0, 1, np.where((at_end & LOWER_CASE) != 0, 2, np.where((at_end & LETTER) != 0, 3, last + 4)))
        form = np.where(tail > 0, form, 0)
        s1, s2 = _slot(0, w1), _slot(w2, w1)
        known, often = np.where(have >= 1, self.known[s1], 0), np.where(have >= 1, self.often[s1], -1)
        known2, often2 = np.where(two, np.minimum(self.known[s2], 6), 0), np.where(two, self.often[s2], -1)

        # The forms of the last two lines: runs of letters, digits and blanks count as one.
        shape = np.where((kind & LETTER) != 0, 1, np.where((kind & DIGIT) != 0, 2, np.where((kind & SPACE) != 0, 3, 0)))
        run = (shape != 0) & (shape == np.concatenate([[0], shape[:-1]]))
        line = end - np.minimum(own_line, tail)
        earlier = end - np.minimum(np.maximum(two_lines, 0), tail)
        run[line] = run[earlier] = False  # a line begins a run
        forms = _Runs(np.where(shape != 0, shape, lower[code] + 4).astype(np.int64), ~run)
        a, z = forms.at[line], forms.at[end]
        shaped = forms.kept(a, np.minimum(z, a + 60))
        tip = forms.kept(np.maximum(a, z - 8), z)
        b, y = forms.at[earlier], forms.at[np.maximum(line - 1, earlier)]
        same = (two_lines >= 0) & (two_lines <= tail) & (forms.kept(b, np.minimum(y, b + 60)) == shaped)
        # Words since the last end of a sentence in the last line.
        stops = np.flatnonzero(w.sentence)
        k = np.searchsorted(stops, end) - 1
        stopped = np.where(k >= 0, np.append(stops, 0)[k] + 1, 0)
        since = np.minimum(number - np.searchsorted(w.start, np.maximum(stopped, line)), 30) // 2
        depth = np.clip(depth, -1, 2)
        limit = self.below_limit(sizes, sources)
        size = _bits(length)
        long = np.where(have >= 1, np.minimum(np.append(w.end, 0)[i1] - np.append(w.start, 0)[i1], 12), 0)
        short = np.where(length < 40, w.norm.range(w.first, end), U(0))
        tail2, tail3 = w.norm.range(np.maximum(end - 2, w.first), end), _joined(char(1), char(2), char(3))
        single = (have < 6) & (lines == 0)
        known_head = known > 1
        columns = [
            (np.zeros(n),), (mark,), (closing,), (form,), (form, head), (limit, mark), (limit, mark, often),
            (space, mark), (w1, mark), (w2, w1, mark), (w3, w2, w1, mark), (tail3, mark), (tail2, mark),
            (known, mark), (often, mark), (known2, mark), (often2, mark), (known, often, mark), (known2, often2, often, mark),
            (shaped, mark), (same, mark, head), (head, mark), (head, often, known_head, mark), (since, mark), (since, often2, mark),
            (fence, depth, quotes), (fence, mark), (depth, mark), (quotes, mark), (size, mark), (np.minimum(lines, 5), mark),
            (long, known, mark), (head, tip, mark), (single, often, mark), (short,),
        ]
        out = np.empty((n, len(columns)), dtype=np.int32)
        for i, parts in enumerate(columns):
            out[:, i] = (_joined(np.full(n, i), *parts) & U((1 << FEATURE_BITS) - 1)).astype(np.int32)
        return out


def _head(body: str) -> int:
    """How the last line begins: a bullet, a bracket, a quote, a fence, a date, a label, or something else."""
    found = _HEAD.match(body, body.rfind("\n") + 1)[0].strip()
    return 8 if found[:1].isdigit() else 9 if found.endswith(":") else _HEADS.get(found, 10)


def artificial(text: str, seed: int, limits: list[int]) -> list[tuple[str, int]]:
    """Training pairs (text, was cut) from an intact text: itself, itself without its final mark, and cuts."""
    rng = np.random.default_rng(seed)
    out = [(text, 0)]
    bare = text.rstrip()
    if _FINAL.search(bare) and rng.random() < 0.35:
        out.append((bare[:-1], 0))
    if rng.random() < 0.1:
        out.append((bare + ["\n", " ", "\r\n", "  "][rng.integers(4)], 0))
    places = [int(rng.integers(1, len(bare))) for _ in range(2)] if len(bare) > 12 else []
    places += [x for x in limits if x < len(bare)][:2]
    for at in places:
        head, rest = bare[:at], bare[at:]
        kept = head.rstrip()
        whole = not kept or bool(_FINAL.search(kept) and (rest[:1].isspace() or head != kept)) or (rest.lstrip(" ")[:1] in "\r\n.!?" and head == kept)
        whole = whole or (head != kept and "\n" in head[len(kept):]) or bool(head[-1].isdigit() and _NUMBER_LEFT.match(rest))
        if whole:
            continue
        if at not in limits and rng.random() < 0.06:
            head += "\ufffd"
        elif at not in limits and rng.random() < 0.25:
            head += ["\n", " ", "\r\n", "  "][rng.integers(4)]
        elif at in limits and head != kept and rng.random() < 0.5:
            head = kept
        elif at in limits and rng.random() < 0.3:  # some fields mark what they cut, within the limit
            sign = _CUT_MARKS[rng.integers(len(_CUT_MARKS))]
            head = head[: -len(sign)] + sign
        out.append((head, 1))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, epochs: int = 10, rate: float = 0.15, decay: float = 1e-4, seed: int = 1) -> np.ndarray:
    """Weights of a logistic regression over hashed binary features (rows x features), by sparse Adagrad steps."""
    w = np.zeros(1 << FEATURE_BITS)
    seen = np.full(1 << FEATURE_BITS, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            pick = order[i : i + 256]
            x = rows[pick]
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
            at, back = np.unique(x.ravel(), return_inverse=True)
            g = np.bincount(back, weights=np.repeat(p - labels[pick], x.shape[1])) + decay * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
    return w


@dataclass(frozen=True)
class Truncation:
    """``scores``: (id, source, chars, score, truncated) of every record; ``rates``: a row for each source."""

    scores: DataFrame
    rates: DataFrame


def find_truncated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", declared_col: str | None = "n_chars",
                   train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, seed: int = 42) -> Truncation:
    """Score every record and flag those with ``score >= threshold`` as cut off.

    Training takes texts as intact that have their declared length and no length limit, or end a sentence; after a
    first fit, those which it holds for cut are left out and it is fitted again. Of these texts those are taken whose
    hash (of id and text) is below the share that gives about ``train_rows``; all where there are fewer. Rows of equal id
    and text are taken once.

    Defined results: null, empty and blank texts have the score 0 and are never flagged; a null source is a source
    of its own; repeated ids and texts are scored one by one; with no text to learn from (an empty table) every
    score is 0. ``declared_col=None`` takes all texts as of their declared length. Other columns are ignored.
    """
    spark, documents = documents.sparkSession, pick(documents, id_col, text_col, source_col, optional=(declared_col,) if declared_col else ())
    declared = F.col(declared_col) if declared_col else F.length(F.col(text_col))
    docs = documents.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).cast("binary").alias("_text"), F.length(F.col(text_col)).cast("bigint").alias("chars"), declared.cast("bigint").alias("_declared"))
    usable = F.col("chars").between(1, TRAIN_CHARS) & ((F.col("_declared") == F.col("chars")) | F.col("_declared").isNull())
    # One pass over the lengths: how many texts of each length, and how many of them can be learnt from.
    hist = cut(docs.groupBy("source", "chars").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable")), "truncation-lengths")
    limits: dict[str, list[int]] = {}
    for r in length_limits(hist).collect():
        limits.setdefault(r["source"] or "", []).append(int(r["chars"]))
    there = int(hist.agg(F.sum("usable")).first()[0] or 0)
    stats = word_statistics(docs.select("_text")).toArrow()  # at most 2**STAT_BITS rows of 20 bytes
    scorer = Scorer(*(stats[c].to_numpy() for c in ("slot", "total", "ends")), limits)

    lot = F.xxhash64(F.lit(seed), F.col("_id"), F.col("_text"))
    sample = docs.where(usable).select("source", "_text", lot.alias("_lot"))
    if there > train_rows:
        sample = sample.where(F.col("_lot") < int(-(2**63) + 2**64 * train_rows / there))
    sample = sample.groupBy("_lot").agg(F.min_by(F.struct("source", "_text"), F.struct("source", "_text")).alias("s")).select("s.source", "s._text", "_lot")
    shared = spark.sparkContext.broadcast(scorer)
    weights = _train(_training_pairs(sample, shared).toArrow())
    known = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value, known.value
        for batch in batches:
            texts, sources, lots = _decoded(batch.column(2)), batch.column(1).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False)
            out = np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if w is not None and not t.isspace() and t]
            for at in range(0, len(full), 1024):
                some = full[at : at + 1024]
                rows = own.features([texts[i] for i in some], [sources[i] for i in some])
                half = (lots[some] & 1).astype(bool)
                sums = np.where(half, w[1][rows].sum(1), w[0][rows].sum(1))
                out[some] = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.float64())], names=["_id", "source", "chars", "score"])

    kind = docs.schema["_id"].dataType.simpleString()
    scored = docs.select("_id", "source", "_text", "chars", F.coalesce(lot, F.lit(0)).alias("_lot")).mapInArrow(run, f"_id {kind}, source string, chars bigint, score double")
    scored = cut(scored.withColumn("truncated", F.col("score") >= threshold), "truncation-scores")
    rates = scored.groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if(F.col("chars") > 0).alias("with_text"), F.count_if("truncated").alias("truncated"),
    ).withColumn("rate", F.when(F.col("with_text") > 0, F.round(F.col("truncated") / F.col("with_text"), 6)).otherwise(F.lit(0.0)))
    return Truncation(scored.select(F.col("_id").alias(id_col), "source", "chars", F.round("score", 6).alias("score"), "truncated"), rates)


def _training_pairs(sample: DataFrame, shared) -> DataFrame:
    """``(lot, label, features)`` of the sample's intact texts and of what was made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, sources, lots = _decoded(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            limit = own.below_limit(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), sources)
            made: list[tuple[str, str | None, int, int]] = []
            for text, source, number, at in zip(texts, sources, lots, limit.tolist(), strict=True):
                if text.strip() and (at != 0 or _FINAL.search(text) and not text.endswith(_CUT_MARKS)):
                    made += [(t, source, number, y) for t, y in artificial(text, number & 0xFFFFFFFF, own.limits.get(source or "", np.empty(0, np.int64)).tolist())]
            for at in range(0, len(made), 1024):
                some = made[at : at + 1024]
                rows = own.features([m[0] for m in some], [m[1] for m in some])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([m[2] for m in some], pa.int64()), pa.array([m[3] for m in some], pa.int32()), flat], names=["lot", "label", "features"])

    return sample.mapInArrow(run, "lot bigint, label int, features array<int>")


def _train(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """Two models, each fitted on one half of the documents; a record is always scored by the one that has not
    seen it. Documents that the other half's model holds for cut are taken out as negatives, and both are refitted."""
    lots, labels = pairs["lot"].to_numpy(), pairs["label"].to_numpy().astype(np.float64)
    if not len(lots) or len(set(labels)) < 2:
        return None
    rows = pairs["features"].combine_chunks().values.to_numpy().reshape(len(lots), -1)
    order = np.lexsort((rows[:, 1], labels, lots))  # the same order in every run
    lots, labels, rows = lots[order], labels[order], rows[order]
    half, good = lots & 1, np.ones(len(lots), dtype=bool)
    weights = (np.zeros(1), np.zeros(1))
    for _ in range(2):
        use = [np.flatnonzero(good & (half == 1 - k)) for k in (0, 1)]
        use = [u if len(set(labels[u])) == 2 else np.arange(len(lots)) for u in use]
        weights = tuple(fit(rows[u], labels[u]) for u in use)
        score = np.where(half == 0, weights[0][rows].sum(1), weights[1][rows].sum(1))
        doubtful = np.unique(lots[(labels == 0) & (score > 0)])
        good = ~np.isin(lots, doubtful)
    return weights
