"""Detection of periodic runs of words by online dyadic square catching.

A square is a stretch of words followed at once by its copy; squares of one period that overlap merge
into a run. Words are appended; every completed, aligned block of 2**k words keeps a catcher. The first
half of a square of period q, 2**(k+1) <= q < 2**(k+2), holds a whole block of level k, and that block
occurs again q words later. So each appended word completes one window of 2**k words at every level,
and each such window is compared with the two blocks whose distance to it fits the level (three single
words at level 0): log2 n comparisons of window names a word, done for all words of one ``append``
together. Hits of one period at neighbouring blocks are one growing match; when the next block fails,
the match is closed, extended by single words on both sides, checked word by word, and reported
as a run if it is long enough. A match inside a run whose period divides its own is no new run.

Names of windows are 64-bit mixes of two names of the level below; every reported run is checked on
the words themselves, so a clash of names can't report what isn't there, and equal windows always
have equal names. Work and memory of a text of n words are n log n and n.

A run (``start, length, period``) is a maximal stretch with smallest period q and length of at least
``least_length`` and ``exponent`` * q. Texts are read whole, a group of texts of similar size at a time.

Defined cases: a null or blank text has no words and no run; rows are judged one by one, so repeated rows
and ids get a result each; a null ``doc_id`` is carried, and never planted with a period by :func:`run_report`;
other columns are ignored, or carried by :func:`collapse_runs`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.llm.bytescan import mix

EXPONENT = 4
LEAST_LENGTH = 6
#: Words that are appended at once.
CHUNK_WORDS = 1 << 15

RUN_TYPE = "array<struct<start: long, length: long, period: long>>"
REPORT_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)

Run = tuple[int, int, int]


class _Level:
    """Window names of one block size, and the matches of its blocks that still grow."""

    def __init__(self, size: int):
        self.size = size
        self.names = np.zeros(0, np.uint64)
        self.count = 0
        self.rows = 0
        #: per distance in blocks: period, first and last block of each growing match
        self.growing = {d: np.zeros((0, 3), np.int64) for d in ((1, 2, 3) if size == 1 else (2, 3))}


def _extended(buffer: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``buffer`` with ``more`` behind its first ``used`` entries; grows by doubling."""
    if used + len(more) > len(buffer):
        bigger = np.zeros(max(2 * len(buffer), used + len(more)), more.dtype)
        bigger[:used] = buffer[:used]
        buffer = bigger
    buffer[used : used + len(more)] = more
    return buffer


class SquareCatcher:
    """Runs of an appended sequence of word numbers; ``longest`` bounds the length of a run."""

    def __init__(self, longest: int, exponent: int = EXPONENT, least_length: int = LEAST_LENGTH):
        if exponent < 2:
            raise ValueError("a run holds a square: exponent of 2 at least")
        self.exponent, self.least_length = exponent, least_length
        self.words = np.zeros(0, np.int64)
        self.count = 0
        self.levels = [_Level(1)]
        while 2 * self.levels[-1].size * 2 * exponent <= longest:
            self.levels.append(_Level(2 * self.levels[-1].size))
        #: per period: starts and ends of the runs found, ascending, and their number
        self.found: dict[int, list] = {}
        self._new: list[Run] = []

    def append(self, words: np.ndarray) -> list[Run]:
        """Take more words (numbers from 0); returns the runs that ended and weren't reported before."""
        self._take(np.asarray(words, np.int64))
        new, self._new = sorted(self._new), []
        return new

    def finish(self) -> list[Run]:
        """The runs that weren't reported before, those that reach the end included."""
        n = self.count
        # words of their own complete the last row of every level
        self._take(np.arange(self.levels[-1].size + 1) + np.iinfo(np.int64).min)
        for level in self.levels:
            for d in level.growing:
                self._close(level, level.growing[d])
        self.count = n
        return self.append(self.words[:0])

    def _take(self, more: np.ndarray) -> None:
        self.words = _extended(self.words, self.count, more)
        self.count += len(more)
        for below, level in zip([None, *self.levels], self.levels):
            ready = self.count - level.size + 1
            if ready <= level.count:
                continue
            if below is None:
                fresh = mix(self.words[level.count : ready].view(np.uint64))
            else:
                half = level.size // 2
                left, right = (below.names[level.count + s : ready + s] for s in (0, half))
                fresh = mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
            level.names = _extended(level.names, level.count, fresh)
            level.count = ready
            self._compare(level)

    def _compare(self, level: _Level) -> None:
        """Windows of all rows completed since the last call against the blocks 1, 2 or 3 rows before."""
        size, first, end = level.size, level.rows, level.count // level.size
        if end <= first:
            return
        windows = level.names[first * size : end * size].reshape(end - first, size)
        level.rows = end
        for d in level.growing:
            low = max(first, d)
            if end <= low:
                continue
            block = level.names[(low - d) * size : (end - d) * size : size]
            hit = np.flatnonzero(windows[low - first :] == block[:, None])
            row, period = hit // size + low - d, hit % size + d * size
            order = np.lexsort((row, period))
            row, period = row[order], period[order]
            head = np.ones(len(row), bool)
            head[1:] = (period[1:] != period[:-1]) | (row[1:] != row[:-1] + 1)
            at = np.flatnonzero(head)
            last = row[np.append(at[1:], len(row)) - 1] if len(at) else row[:0]
            found = np.column_stack([period[at], row[at], last])
            # a match that grew up to the last row of the call before goes on where its period hits the first row
            held = level.growing[d]
            if len(held):
                place = np.searchsorted(found[:, 0] * (end + 1) + found[:, 1], held[:, 0] * (end + 1) + held[:, 2] + 1)
                inside = place < len(found)
                goes_on = np.zeros(len(held), bool)
                goes_on[inside] = (found[place[inside], 0] == held[inside, 0]) & (found[place[inside], 1] == held[inside, 2] + 1)
                found[place[goes_on], 1] = held[goes_on, 1]
                found = np.concatenate([held[~goes_on], found])
            open_ = found[:, 2] == end - d - 1
            level.growing[d] = found[open_]
            self._close(level, found[~open_])

    def _close(self, level: _Level, found: np.ndarray) -> None:
        """Report the runs of matches that ended."""
        size = level.size
        period, start = found[:, 0], found[:, 1] * size
        matched = (found[:, 2] - found[:, 1] + 1) * size
        # fewer than 2 * (size - 1) words come on at the sides
        need = np.maximum((self.exponent - 1) * period, self.least_length - period)
        keep = matched + 2 * (size - 1) >= need
        if not keep.any():
            return
        period, start, matched = period[keep], start[keep], matched[keep]
        known = np.zeros(len(period), bool)
        for q, (starts, ends, count) in self.found.items():
            mine = np.flatnonzero((period > q) & (period % q == 0))
            if len(mine):
                place = np.searchsorted(starts[:count], start[mine], "right") - 1
                known[mine] |= (place >= 0) & (ends[place] >= start[mine] + period[mine])
        for lower in self.levels:
            if lower is level:
                break
            for grown in lower.growing.values():
                enough = grown[:, 2] - grown[:, 1] + 1 >= self.exponent
                for q, a, b in grown[enough].tolist():
                    reach = (b + 1) * lower.size + q
                    known |= (period % q == 0) & (a * lower.size <= start) & (start + period <= reach)
        for q, a, m in zip(period[~known].tolist(), start[~known].tolist(), matched[~known].tolist()):
            self._report(q, max(0, a - size), min(a + m + size, self.count - q))

    def _report(self, q: int, low: int, high: int) -> None:
        """Runs of period ``q`` whose matches begin and end within [low, high), by the words themselves."""
        same = np.concatenate([[False], self.words[low:high] == self.words[low + q : high + q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in turns.tolist():
            length = b - a + q
            start = low + a
            if length < max(self.least_length, self.exponent * q):
                continue
            starts, ends, count = self.found.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
            if count and starts[count - 1] >= start:
                continue
            starts, ends = (_extended(x, count, np.array([v])) for x, v in ((starts, start), (ends, start + length)))
            self.found[q] = [starts, ends, count + 1]
            self._new.append((start, length, q))


def find_runs(texts: list[np.ndarray], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> list[list[Run]]:
    """Runs of each sequence of word numbers, sorted by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if len(texts[i]) >= max(least_length, exponent)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and (not group or total + len(texts[order[at]]) <= CHUNK_WORDS):
            group.append(order[at])
            total += len(texts[order[at]]) + 1
            at += 1
        catcher = SquareCatcher(len(texts[group[0]]), exponent, least_length)
        starts = np.cumsum([0, *[len(texts[i]) + 1 for i in group[:-1]]]).tolist()
        # a word of its own behind every sequence, which no run crosses
        joined = np.concatenate([x for k, i in enumerate(group) for x in (texts[i], [-1 - k])])
        found = [r for k in range(0, len(joined), CHUNK_WORDS) for r in catcher.append(joined[k : k + CHUNK_WORDS])]
        for a, length, q in found + catcher.finish():
            k = bisect_right(starts, a) - 1
            out[group[k]].append((a - starts[k], length, q))
    return [sorted(runs, key=_by_start) for runs in out]


def _words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, as bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    return [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that no run holds behind its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    free = np.cumsum(gone[:-1]) == 0
    return words if free.all() else [w for w, f in zip(words, free.tolist()) if f]


def _batches(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows with about eight chunks of words together."""
    at, total = 0, 0
    for i, words in enumerate(texts):
        total += len(words)
        if total >= 8 * CHUNK_WORDS:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> list[list[Run]]:
    """Runs of each list of words."""
    out = []
    for a, b in _batches(texts):
        out += find_runs(_numbered(texts[a:b]), exponent, least_length)
    return out


def with_runs(docs: DataFrame, exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id`` and ``runs`` (start, length, period; in words) of every row."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            found = runs_of([_words(t) for t in batch["text"].to_pylist()], exponent, least_length)
            rows = [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found]
            yield pa.record_batch([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "runs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(detect, f"doc_id long, runs {RUN_TYPE}")


def collapse_runs(docs: DataFrame, exponent: int = EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """All rows and columns of ``docs``; of each run in ``text`` only its first period stays. Texts without a run are unchanged."""
    at = docs.columns.index("text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            words = [_words(t) for t in texts]
            for i, runs in enumerate(runs_of(words, exponent, least_length)):
                if runs:
                    texts[i] = b" ".join(kept_words(words[i], runs)).decode("utf-8", "surrogatepass")
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(shorten, docs.schema)


def _by_start(run: Run) -> tuple[int, int]:
    return run[0], run[2]


def planted(words: list, code: int) -> list:
    """``words`` with a periodic tail where ``code`` (unsigned) ends in 0; its other digits set place and period."""
    n, g = len(words), code // 10
    if code % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def digest(words: list[bytes], runs: list[Run]) -> tuple:
    """The report's columns behind ``doc_id``."""
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(kept_words(words, runs))
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def run_report(docs: DataFrame) -> DataFrame:
    """Digest of the runs of every row, some texts planted with a period by the CRC of their id."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in REPORT_SCHEMA.split(", ")]
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            texts = [
                planted(_words(t), 1 if key is None else zlib.crc32(str(key).encode()))
                for key, t in zip(ids, batch["text"].to_pylist())
            ]
            rows = [digest(w, r) for w, r in zip(texts, runs_of(texts))]
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(report, REPORT_SCHEMA)
