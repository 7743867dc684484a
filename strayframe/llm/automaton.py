"""Regexes over bytes as one minimal automaton: a forward scan that finds where patterns end in many texts at once, and an
anchored one over reversed patterns that finds where they began."""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """A small regex dialect: literals, [classes], groups, |, ?, *, +, {n}, \\xHH."""

    def __init__(self, pattern: str, fold: bool, backwards: bool = False):
        self.text, self.at, self.fold, self.backwards = pattern, 0, fold, backwards
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def folded(self, chosen: set[int]) -> frozenset[int]:
        if self.fold:
            chosen |= {ord(chr(b).swapcase()) for b in chosen if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(chosen)

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("then", parts)

    def repeated(self):
        part = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                part, self.at = ("then", [part] * int(self.text[self.at : end])), end + 1
            else:
                part = (c, part)
        return part

    def atom(self):
        if self.peek() == "(":
            self.take()
            inner = self.alternatives()
            self.take()
            return inner
        if self.peek() == "[":
            self.take()
            chosen: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    chosen |= set(range(low, self.byte() + 1))
                else:
                    chosen.add(low)
            self.take()
            return ("in", self.folded(chosen))
        return ("in", self.folded({self.byte()}))

    def build(self, node, start: int) -> int:
        """Add the node's states behind ``start``; the state after it."""
        kind, part = node
        if kind == "in":
            end = self.state()
            self.moves[start].append((part, end))
            return end
        if kind == "then":
            for x in reversed(part) if self.backwards else part:
                start = self.build(x, start)
            return start
        end = self.state()
        if kind == "or":
            for x in part:
                self.free[self.build(x, start)].append(end)
            return end
        inner = self.state()
        self.free[start].append(inner)
        last = self.build(part, inner)
        self.free[last].append(end)
        if kind in "?*":
            self.free[start].append(end)
        if kind in "*+":
            self.free[last].append(inner)
        return end


class Automaton:
    """Finds where any rule's pattern ends. A state is held as its number times ``width``;
    ``table[state + kind[byte]]`` is the next one. States from ``first_out`` on report the rules of ``out``. ``anchored``: a
    match begins with the first byte, and ``dead`` is the state (if any) that nothing leaves. ``backwards``: bytes come
    from a pattern's end to its start."""

    def __init__(self, rules: list[tuple[str, bool]], *, anchored: bool = False, backwards: bool = False):
        moves: list[list[tuple[frozenset[int], int]]] = []
        free: list[list[int]] = []
        starts, ends = [], {}
        for number, (pattern, fold) in enumerate(rules):
            p = _Parser(pattern, fold, backwards)
            node, start = p.alternatives(), p.state()
            end = p.build(node, start)
            base = len(moves)
            moves += [[(chosen, to + base) for chosen, to in x] for x in p.moves]
            free += [[to + base for to in x] for x in p.free]
            starts.append(start + base)
            ends[end + base] = 1 << number
        self.anchored = anchored
        self._subsets(moves, free, starts, ends)
        self._minimise()

    def _subsets(self, moves, free, starts, ends) -> None:
        closures: dict[int, frozenset[int]] = {}
        for s in range(len(free)):
            seen, todo = {s}, [s]
            while todo:
                for to in free[todo.pop()]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            closures[s] = frozenset(x for x in seen if moves[x] or x in ends)
        used = {chosen for x in moves for chosen, _ in x}
        marks: dict[tuple[bool, ...], int] = {}
        self.kind = np.array([marks.setdefault(tuple(b in c for c in used), len(marks)) for b in range(256)], dtype=np.uint8)
        self.width = len(marks)
        one = [int(np.flatnonzero(self.kind == k)[0]) for k in range(self.width)]
        begin = frozenset().union(*(closures[s] for s in starts))
        number, order, rows = {begin: 0}, [begin], []
        for now in order:  # grows while it runs
            row = []
            for b in one:
                new = set() if self.anchored else set(begin)  # a match may begin anywhere
                for s in now:
                    for chosen, to in moves[s]:
                        if b in chosen:
                            new |= closures[to]
                new = frozenset(new)
                if new not in number:
                    number[new] = len(order)
                    order.append(new)
                row.append(number[new])
            rows.append(row)
        self.next = np.array(rows, dtype=np.int32)
        self.found = np.array([sum(v for s, v in ends.items() if s in x) for x in order], dtype=np.int64)

    def _minimise(self) -> None:
        part = np.unique(self.found, return_inverse=True)[1]
        while True:
            key = np.column_stack([part, part[self.next]])
            new = np.unique(key, axis=0, return_inverse=True)[1].ravel()
            if new.max() == part.max():
                break
            part = new
        n = int(part.max()) + 1
        one = np.zeros(n, dtype=np.int64)
        one[part] = np.arange(len(part))
        found, table = self.found[one], part[self.next[one]]
        order = np.argsort(found > 0, kind="stable")  # the reporting states come last
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.start, self.states = int(place[part[0]]), n
        self.table = (place[table[order]] * self.width).astype(np.int32).ravel()
        self.out = found[order]
        self.first_out = int((self.out == 0).sum())
        after = self.table.reshape(n, self.width)
        idle = np.flatnonzero((after == np.arange(n)[:, None] * self.width).all(axis=1) & (self.out == 0))
        self.dead = int(idle[0]) * self.width if len(idle) else -1
        del self.next, self.found

    def scan(self, data: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the last bytes in ascending order, rules) of all reports.

        The bytes are cut into lanes of equal length, and each step moves all lanes by one byte. A lane starts as if nothing
        were under way before it. Where the lane in front ends in another state, both states go through the lane until they meet,
        which they do within a few bytes, or else the lane hands its new end on. Where that goes on for more than a few lanes,
        the ends of all lanes are found for each entry that occurs, at most one pass a state. A last pass has the true entries."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        many = -(-n // lane)
        kinds = np.zeros(many * lane, dtype=np.uint8)
        kinds[:n] = self.kind[data]
        kinds = np.ascontiguousarray(kinds.reshape(many, lane).T)
        entry = np.full(many, self.start * self.width, dtype=np.int32)
        ends, _ = self._run(kinds, entry)
        todo = np.flatnonzero(ends[:-1] != entry[1:]) + 1
        for _ in range(4):
            lanes, true, tried = todo, ends[todo - 1], entry[todo]
            entry[todo] = true
            for t in range(lane):
                if not len(lanes):
                    break
                true, tried = self.table[true + kinds[t, lanes]], self.table[tried + kinds[t, lanes]]
                apart = true != tried
                lanes, true, tried = lanes[apart], true[apart], tried[apart]
            ends[lanes] = true
            todo = lanes[lanes + 1 < many] + 1
            todo = todo[entry[todo] != ends[todo - 1]]
        known: dict[int, np.ndarray] = {}
        for i in todo.tolist():
            while i < many and entry[i] != ends[i - 1]:
                now = int(ends[i - 1])
                if now not in known:
                    known[now] = self._run(kinds, np.full(many, now, dtype=np.int32))[0]
                entry[i], ends[i] = now, known[now][i]
                i += 1
        _, (at, out) = self._run(kinds, entry, found=True)
        order = np.argsort(at, kind="stable")
        at, out = at[order], out[order]
        inside = at < n
        return at[inside], self.out[out[inside] // self.width]

    def _run(self, kinds: np.ndarray, state: np.ndarray, found: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(states after all lanes' last byte, (places, states) of reports if asked for). kinds: bytes of a lane x lanes."""
        limit, lane = self.first_out * self.width, len(kinds)
        places, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for t in range(lane):
            state = self.table[state + kinds[t]]
            if found and state.max() >= limit:
                hit = np.flatnonzero(state >= limit)
                places.append(hit * lane + t)
                states.append(state[hit])
        return state, (np.concatenate(places), np.concatenate(states))

    def firsts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For a backwards automaton: the leftmost start of a match that ends before each of ``ends``; -1 if there is none."""
        found = np.full(len(ends), -1, dtype=np.int64)
        state = np.full(len(ends), self.start * self.width, dtype=np.int32)
        limit, alive, at = self.first_out * self.width, np.arange(len(ends)), ends.astype(np.int64)
        if limit <= self.start * self.width:
            found[:] = ends  # an empty pattern
        while len(alive) > 8:
            at = at - 1
            on = at >= 0
            alive, at, state = alive[on], at[on], state[on]
            state = self.table[state + self.kind[data[at]]]
            hit = state >= limit
            found[alive[hit]] = at[hit]
            on = state != self.dead
            alive, at, state = alive[on], at[on], state[on]
        table, kind = self.table.tolist(), self.kind.tolist()
        for k, p, now in zip(alive.tolist(), at.tolist(), state.tolist(), strict=True):  # a few that reach far back
            while p > 0 and now != self.dead:
                low = max(0, p - (1 << 16))
                for b in data[low:p][::-1].tobytes():
                    p, now = p - 1, table[now + kind[b]]
                    if now >= limit:
                        found[k] = p
                    elif now == self.dead:
                        break
        return found
