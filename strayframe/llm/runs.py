"""Periodic runs of words by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q whose length is at least ``power`` * q and at least ``least`` and
that no neighbouring word extends keeping q. Of each stretch that can hold runs, a suffix automaton gives the Lempel-Ziv factors
(each the longest prefix of the rest that starts earlier, overlaps allowed). A run that touches a factor's ends or crosses into it is
found at the factor's border by Main's extension arrays; one strictly inside a factor has been met at the factor's earlier
occurrence and is copied from there. All of it is linear in the stretch.

Which stretches: in a run of the least length and power each gram of ``gram_size`` consecutive words occurs again inside the run, so
where a text's grams occur once, no run lies. Grams are told by hashes, and a collision only adds a stretch that holds no run. This
keeps the automaton to the parts of a text that repeat.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and null doc_ids keep a row each;
equal texts have equal runs. Memory of a task grows with its longest repeating stretch, about half a kilobyte a word.
Documents are independent, so there is no shuffle and no hot key. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of texts that are coded and sorted together; a longer text is a group of its own.
GROUP_CHARACTERS = 2_000_000

Run = tuple[int, int, int]  # start, length, period
#: Gives for (doc_id, number of words) the start and period from which a text repeats itself, or None.
Rewrite = Callable[[int, int], tuple[int, int] | None]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The rule of the query: one document in ten repeats itself from word a on with period p. Null ids have no decimal and stay."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def gram_size(least: int, power: int) -> int:
    """The longest gram of which any run holds two: length - gram + 1 >= 2 * period for each period."""
    return max(1, min(max(least, power * q) - 2 * q + 1 for q in range(1, least + 1)))


def factors(s: Sequence[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, earlier start or -1) of s by its suffix automaton."""
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]  # first: where a state's strings end for the first time
    last = 0
    for i, c in enumerate(s):
        state = len(step)
        step.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    out, i, n = [], 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n:
            to = step[state].get(s[j])
            if to is None or first[to] >= j:
                break
            state, j = to, j + 1
        out.append((i, max(1, j - i), first[state] - (j - i) + 1 if j > i else -1))
        i = max(i + 1, j)
    return out


def _prefix_lengths(s: Sequence[int]) -> list[int]:
    """For each place of s how far it agrees with the beginning of s."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(s: Sequence[int], b: int, e: int, before: int, least: int, power: int) -> Iterator[Run]:
    """Runs of s that end in s[b:e] and start at b or before, and those that end right in front of b; before: length of the factor in
    front of b. With c = s[b] that factor and c occur nowhere earlier, so a run over b starts less than before + q words in front
    of b, and so (power - 1) * q < before + e - b."""
    most = (before + e - b - 1) // (power - 1)
    if most < 1 or before + most - 1 + e - b < least:
        return
    n, w = len(s), max(0, b - before - most)
    t, u = s[w:b], s[b:e]
    a = len(t)
    back = t[::-1]
    ahead = _prefix_lengths(u)  # how far u agrees with itself q words on
    behind = _prefix_lengths(back)  # the same backwards from b
    over = _prefix_lengths([*back, -1, *reversed(s[w:e])])  # the words in front of b against those in front of b + q
    under = _prefix_lengths([*u, -1, *s[w:e]])  # the words from b on against those from b - q on
    m = len(u)
    for q in range(1, most + 1):
        found = []
        if q < m:
            found.append((b - min(over[a + 1 + m - q], a), b + q + ahead[q]))
        if q <= a:
            found.append((b - q - (behind[q] if q < a else 0), b + min(under[m + 1 + a - q], m)))
        for x, y in found:
            if y - x >= power * q and y - x >= least and not (x > 0 and s[x - 1] == s[x - 1 + q]) and not (y < n and s[y] == s[y - q]):
                yield x, y - x, q


def runs_of(s: Sequence[int], least: int = 6, power: int = 4) -> list[Run]:
    """All runs of a list of numbers that are 0 or more, by start, then period."""
    n = len(s)
    if n < least:
        return []
    met: dict[int, dict[int, int]] = {}  # start -> length -> smallest period
    before = 0
    for b, length, source in [*factors(s), (n, 0, -1)]:
        for x, size, q in _at_border(s, b, b + length, before, least, power) if b else ():
            sizes = met.setdefault(x, {})
            sizes[size] = min(q, sizes.get(size, q))
        if met and source >= 0 and length >= least + 2:
            stop, by = source + length, b - source
            for x in range(source + 1, stop - least):
                for size, q in list(met[x].items()) if x in met else ():
                    if x + size < stop:
                        sizes = met.setdefault(x + by, {})
                        sizes[size] = min(q, sizes.get(size, q))
        before = length
    return sorted(((x, size, q) for x, sizes in met.items() for size, q in sizes.items()), key=lambda r: (r[0], r[2]))


def repeating(codes: np.ndarray, ends: np.ndarray, least: int, size: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of codes, inside the parts that ``ends`` closes, outside of which no gram of ``size`` codes occurs twice
    in its part. Stretches become parts as long as this leaves out a good deal more."""
    mixed = np.random.default_rng(7).integers(1, 2**63, size + 1, dtype=np.uint64) | np.uint64(1)
    parts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    codes = codes.astype(np.uint64)
    while True:
        parts = [(a, z) for a, z in parts if z - a >= least]
        total = sum(z - a for a, z in parts)
        if not parts:
            return parts
        lengths = np.array([z - a - size + 1 for a, z in parts])
        at = np.repeat(np.array([a for a, _ in parts]) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        part = np.repeat(np.arange(len(parts)), lengths)
        h = part.astype(np.uint64) * mixed[0]
        for k in range(size):
            h += codes[at + k] * mixed[k + 1]
        h ^= h >> np.uint64(29)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        marked = np.zeros(len(h), dtype=bool)
        marked[order[1:][same]] = True
        marked[order[:-1][same]] = True
        places = np.flatnonzero(marked)
        if not len(places):
            return []
        new = np.flatnonzero((np.diff(places) > 1) | (np.diff(part[places]) > 0)) + 1
        firsts, lasts = at[places[np.concatenate([[0], new])]], at[places[np.concatenate([new - 1, [len(places) - 1]])]] + size
        parts = list(zip(firsts.tolist(), lasts.tolist(), strict=True))
        if sum(z - a for a, z in parts) > 0.9 * total:
            return [(a, z) for a, z in parts if z - a >= least]


def _strongest(runs: list[Run]) -> Run | None:
    best = None
    for x, size, q in runs:  # by start, then period, so ties keep the first
        if best is None or size * best[2] > best[1] * q:
            best = x, size, q
    return best


class _Codes(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def found_runs(texts: list[str], ids: list[int | None], *, least: int, power: int, rewrite: Rewrite | None) -> list[tuple[list[str], list[Run]]]:
    """Words and runs of each text."""
    code = _Codes()
    listed, coded = [], []
    for text, i in zip(texts, ids, strict=True):
        words = WORD.findall(text)
        turn = rewrite(i, len(words)) if rewrite else None
        if turn:
            a, p = turn
            words = [*words[:a], *(words[a + k % p] for k in range(len(words) - a))]
        listed.append(words)
        coded.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
    ends = np.cumsum([len(c) for c in coded])
    joined = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    runs: list[list[Run]] = [[] for _ in texts]
    for a, z in repeating(joined, ends, least, gram_size(least, power)) if len(joined) else ():
        k = int(np.searchsorted(ends, a, side="right"))
        offset = a - (int(ends[k - 1]) if k else 0)
        runs[k] += [(x + offset, size, q) for x, size, q in runs_of(joined[a:z].tolist(), least, power)]
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(listed, runs, strict=True)]


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words that stay when of each run only the first period is kept."""
    if runs:
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for x, size, q in runs:
            drop[x + q] += 1
            drop[x + size] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    return " ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, strongest struct<start: bigint, length: bigint, period: bigint>, collapsed string"


def periodic_runs(docs: DataFrame, *, least: int = 6, power: int = 4, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period), the strongest run (greatest length / period; ties: smallest
    start, then period; null without runs), and the text whose runs are collapsed to their first period (words joined by one space)."""
    prepare(docs.sparkSession)
    if power < 2 or least < 2:
        raise ValueError("a run repeats its period at least twice")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda r: dict(zip(("start", "length", "period"), r, strict=True)) if r else None
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            begin = 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and (end == begin or held + len(texts[end]) <= GROUP_CHARACTERS):
                    held += len(texts[end])
                    end += 1
                got = found_runs(texts[begin:end], ids[begin:end], least=least, power=power, rewrite=rewrite)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[begin:end], pa.int64()),
                        pa.array([[named(r) for r in runs] for _, runs in got], pa.list_(RUN)),
                        pa.array([named(_strongest(runs)) for _, runs in got], RUN),
                        pa.array([collapsed(words, runs) for words, runs in got], pa.string()),
                    ],
                    names=["doc_id", "runs", "strongest", "collapsed"],
                )
                begin = end

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """Of each row of :func:`periodic_runs` the strongest run and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
