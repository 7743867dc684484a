"""Secret scans by one automaton for all rules.

A rule is a head, a regex, and a tail, a class of characters whose run behind the head is taken whole. The heads (each with
the first character of its tail) become one minimal automaton over bytes by subset construction and minimisation, held as
a transition array; all texts of a batch go through it in one pass, which finds where heads end. A second automaton for each
rule reads the reversed head from there and finds where it starts. Runs of a tail, and how long they are, are found by
comparison with the class; counts are no part of a state, so the automata stay small.

Spans are in code points, ends exclusive. Per kind, matches are the leftmost non-overlapping ones, and those that
are too short are dropped after that.

Defined cases: null and empty texts have no spans. Very long texts and lines are scanned whole. Repeated rows each get
the result; a null doc_id stays null. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import prepare, text_or_empty


@dataclass(frozen=True)
class Rule:
    """head: a regex over bytes (``fold``: in either case). tail: a class of ASCII characters; one at least has to follow
    the head, and all that do belong to the match; empty: the head is the match. least: how many characters the tail (``whole``:
    the match) has to have. A rule without a head matches whole runs of its tail.

    A head may match in one way from a place on, and no two heads of a rule that end at one place may start at two."""

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = True
    fold: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _ASSIGN, "A-Za-z0-9+/_.=-", 12, whole=False, fold=True),
    Rule("access", "AKIA", "A-Z0-9", 18),
    Rule("hex", "", "0-9a-f", 16),
)
ADDED = (
    Rule("forge", "gh[oprsu]_", "A-Za-z0-9", 24),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 1),
)
#: Bytes of text that go through the automaton together.
BATCH_BYTES = 4_000_000
#: Characters of a run that the automaton sees before it reports a rule without a head.
RUN = 6


class Scanner:
    """The automata of rules: one forward over all, one backwards for each head."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.forward = Automaton([(r.head + (f"[{r.tail}]" if r.tail else "") if r.head else f"[{r.tail}]{{{min(RUN, r.least)}}}", r.fold) for r in rules])
        self.back = [Automaton([(r.head, r.fold)], anchored=True, backwards=True) if r.head else None for r in rules]
        self.member = [np.isin(np.arange(256), _members(r.tail)) for r in rules]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text's spans, in that order."""
        raw = [x.encode() for x in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        at, found = self.forward.scan(data)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(at):
            return out
        begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points in front of each byte
        for k, rule in enumerate(self.rules):
            ends = at[(found >> k & 1) == 1]
            if not len(ends):
                continue
            starts, stops = self._bounds(k, data, ends)
            starts, stops = _apart(starts, stops)
            size = stops - (starts if rule.whole else self._heads_end(k, data, starts, ends))
            keep = size >= rule.least
            starts, stops = starts[keep], stops[keep]
            owner = np.searchsorted(begins, starts, side="right") - 1
            for i, a, b in zip(owner.tolist(), (points[starts] - points[begins[owner]]).tolist(), (points[stops] - points[begins[owner]]).tolist(), strict=True):
                out[i].append((a, k, b))
        return [sorted(x) for x in out]

    def _bounds(self, k: int, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the matches whose reports are at ``ends``."""
        rule, backwards = self.rules[k], self.back[k]
        if not rule.tail:
            return backwards.firsts(data, ends + 1), ends + 1
        other = np.flatnonzero(~self.member[k][data])  # the last byte is a line feed
        after = np.searchsorted(other, ends)
        if backwards is None:
            runs = np.unique(after)
            return np.where(runs > 0, other[runs - 1] + 1, 0), other[runs]
        return backwards.firsts(data, ends), other[after]

    def _heads_end(self, k: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the tails of the matches from ``starts`` on begin: at the first report behind the start that leads back to it."""
        first = self.back[k].firsts(data, ends)
        order = np.lexsort((ends, first))
        return ends[order][np.searchsorted(first[order], starts)]


def _members(tail: str) -> list[int]:
    """The bytes of a character class as it is written between brackets."""
    out, at = [], 0
    while at < len(tail):
        if tail[at + 1 : at + 2] == "-" and at + 2 < len(tail):
            out += range(ord(tail[at]), ord(tail[at + 2]) + 1)
            at += 3
        else:
            out.append(ord(tail[at]))
            at += 1
    return out


def _apart(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leftmost matches of which none begins inside the one before it; of those from one start, the longest."""
    order = np.lexsort((-stops, starts))
    starts, stops = starts[order], stops[order]
    if (starts[1:] >= stops[:-1]).all():
        return starts, stops
    kept, end = [], 0
    for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        if a >= end:
            kept.append(i)
            end = b
    return starts[kept], stops[kept]


def secrets(docs: DataFrame, *, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256 (of kind:start:end, comma-joined), spans (all rules', likewise)."""
    prepare(docs.sparkSession)
    rules = base + added
    kept = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # of the rules' size
    names = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept.value
        show = lambda found: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, found = part.column(1).to_pylist(), []
                held: list[str] = []
                size = 0
                for x in texts:
                    held.append(x)
                    size += len(x)
                    if size > BATCH_BYTES:
                        found += scanner.spans(held)
                        held, size = [], 0
                found += scanner.spans(held)
                first = [[s for s in x if s[1] < len(base)] for x in found]
                counts = [pa.array([sum(s[1] == k for s in x) for x in first], pa.int64()) for k in range(len(base))]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(show(x).encode()).hexdigest() for x in first], pa.string()), pa.array([show(x) for x in found], pa.string())], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(scan, f"doc_id bigint, {', '.join(f'{x} bigint' for x in names[1:-2])}, base_sha256 string, spans string")
