"""Re-Pair grammars over symbol sequences, with min-plus transfer matrices.

A sequence of edited turns has to spell ``(s?(ua)+)?`` in role initials. That
is an automaton of four states: nothing yet, after ``s``, after ``u``, after
``a`` (which may end, as may the first). For each symbol a matrix says what it
costs at least to come from one state to another: inserts first, then one edit
of the turn itself. Matrices are multiplied in the min-plus semiring, and the
rules of a grammar need one product each, bottom-up, however often they occur.

Ties go to the audit (the initials of the edits) that is least in ASCII. In a
matrix the audits from one state to different states are different, as an audit
fixes the path; and none begins another, as each ends with the edit of the last
turn and has as many such edits. So their order is decided within the matrix
and only its ranks are needed: an audit of a product is ordered by the rank of
its left part, then of its right part. The audit itself is a rope: each entry
names the state in the middle, and is expanded only where it is asked for.
"""

from __future__ import annotations

import heapq
from functools import cache

NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where the role that a state lacks leads to, and which role it is.
NEXT = {START: (AFTER_U, "user"), AFTER_S: (AFTER_U, "user"), AFTER_U: (AFTER_A, "assistant"), AFTER_A: (AFTER_U, "user")}
KEPT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}

#: Symbols: 0 is a turn that must go; then the initials, sound and truncated.
INITIALS = "sua?"
SYMBOLS = 1 + 2 * len(INITIALS)


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return 0
    place = INITIALS.find(initial) if initial and initial != "?" else len(INITIALS) - 1
    return 1 + (place if place >= 0 else len(INITIALS) - 1) + len(INITIALS) * truncated


class Matrix:
    """``cost``, ``rank`` and middle state ``mid`` of each (from, to)."""

    __slots__ = ("cost", "rank", "mid")

    def __init__(self, cost: list[int], rank: list[int], mid: list | None):
        self.cost, self.rank, self.mid = cost, rank, mid


def _ranked(keys: list, cost: list[int]) -> list[int]:
    """For each (from, to), the place of its key among those from the same state."""
    rank = [0] * 16
    for i in range(0, 16, 4):
        for place, j in enumerate(sorted((j for j in range(i, i + 4) if cost[j] < NEVER), key=keys.__getitem__)):
            rank[j] = place
    return rank


@cache
def terminal(x: int) -> Matrix:
    """The matrix of one symbol; its ropes are the audits themselves."""
    best: dict[int, tuple[int, str]] = {}
    initial = INITIALS[(x - 1) % len(INITIALS)] if x else ""
    more = TRUNCATED if x > len(INITIALS) else 0
    for i in range(4):
        state, price, text = i, 0, ""
        for _ in range(3):  # a third insert would come back to where one was
            ways = [(state, DELETE, "D")]
            if x:
                ways.append((NEXT[state][0], REROLE + more, "R"))
                if (initial, state) in KEPT:
                    ways.append((KEPT[initial, state], KEEP + more, "K"))
            for to, cost, edit in ways:
                got = (price + cost, text + edit)
                best[4 * i + to] = min(best.get(4 * i + to, got), got)
            state, price, text = NEXT[state][0], price + INSERT, text + "I"
    cost = [best[k][0] if k in best else NEVER for k in range(16)]
    ropes = [best[k][1] if k in best else "" for k in range(16)]
    return Matrix(cost, _ranked(ropes, cost), ropes)


def product(a: Matrix, b: Matrix) -> Matrix:
    cost, mid, keys = [NEVER] * 16, [0] * 16, [(0, 0)] * 16
    for i in range(4):
        for j in range(4):
            found = min((a.cost[4 * i + k] + b.cost[4 * k + j], a.rank[4 * i + k], b.rank[4 * k + j], k) for k in range(4))
            if found[0] < NEVER:
                cost[4 * i + j], mid[4 * i + j], keys[4 * i + j] = found[0], found[3], found[1:3]
    return Matrix(cost, _ranked(keys, cost), mid)


def re_pair(sequences: list[tuple[int, ...]], symbols: int = SYMBOLS) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (a pair each; the first has the number ``symbols``) and what is
    left of the sequences: the most frequent pair becomes a new symbol until
    none occurs twice."""
    sym: list[int] = []
    for s in sequences:
        sym += [*s, -1]
    after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    at: dict[tuple[int, int], set[int]] = {}
    for k in range(len(sym) - 1):
        if sym[k] >= 0 and sym[k + 1] >= 0:
            at.setdefault((sym[k], sym[k + 1]), set()).add(k)
    heap = [(-len(where), pair) for pair, where in at.items() if len(where) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        where = at.get(pair, ())
        if len(where) != -count:
            if len(where) > 1:
                heapq.heappush(heap, (-len(where), pair))
            continue
        new, changed = symbols + len(rules), set()
        used = 0
        for k in sorted(where):
            j = after[k]
            if sym[k] != pair[0] or j >= len(sym) or sym[j] != pair[1]:
                continue  # it shares a symbol with the one before
            used += 1
            p, n = before[k], after[j]
            if p >= 0 and sym[p] >= 0:
                at[sym[p], pair[0]].discard(p)
                at.setdefault((sym[p], new), set()).add(p)
                changed.add((sym[p], new))
            if sym[n] >= 0:
                at[pair[1], sym[n]].discard(j)
                at.setdefault((new, sym[n]), set()).add(k)
                changed.add((new, sym[n]))
            sym[k], sym[j] = new, -2
            after[k], before[n] = n, k
        if used:
            rules.append(pair)
        at.pop(pair, None)
        for c in changed:
            if len(at.get(c, ())) > 1:
                heapq.heappush(heap, (-len(at[c]), c))
    left, k = [], 0
    for _ in sequences:
        own = []
        while sym[k] != -1:
            own.append(sym[k])
            k = after[k]
        left.append(own)
        k += 1
    return rules, left


class Grammar:
    """The grammar of some sequences, with the matrix of each rule."""

    def __init__(self, sequences: list[tuple[int, ...]]):
        distinct = list(dict.fromkeys(sequences))
        self.rules, left = re_pair(distinct)
        self.left = dict(zip(distinct, left))
        self.matrices = [terminal(x) for x in range(SYMBOLS)]
        for a, b in self.rules:
            self.matrices.append(product(self.matrices[a], self.matrices[b]))

    def _rows(self, sequence: tuple[int, ...], start: int) -> tuple[list[int], list[int], list[list[int]]]:
        """Least costs from ``start`` to each state, their ranks, and for each
        symbol that is left the state before."""
        cost, rank, back = [NEVER] * 4, [0] * 4, []
        cost[start] = 0
        for x in self.left[sequence]:
            m = self.matrices[x]
            found = [min((cost[k] + m.cost[4 * k + j], rank[k], m.rank[4 * k + j], k) for k in range(4)) for j in range(4)]
            order = sorted(range(4), key=lambda j: found[j][1:3])
            cost, rank = [min(f[0], NEVER) for f in found], [order.index(j) for j in range(4)]
            back.append([f[3] for f in found])
        return cost, rank, back

    def matrix(self, sequence: tuple[int, ...]) -> tuple[list[int], list[int]]:
        """Costs and ranks of a whole sequence, for each (from, to)."""
        rows = [self._rows(sequence, i) for i in range(4)]
        return [c for r in rows for c in r[0]], [k for r in rows for k in r[1]]

    def audit(self, sequence: tuple[int, ...], start: int, end: int) -> str:
        _, _, back = self._rows(sequence, start)
        steps = []
        for x, b in zip(reversed(self.left[sequence]), reversed(back)):
            steps.append((x, b[end], end))
            end = b[end]
        out = []
        while steps:
            x, i, j = steps.pop()
            mid = self.matrices[x].mid[4 * i + j]
            if x < SYMBOLS:
                out.append(mid)
            else:
                a, b = self.rules[x - SYMBOLS]
                steps += [(b, mid, j), (a, i, mid)]
        return "".join(out)

    def solve(self, sequence: tuple[int, ...]) -> tuple[int, str]:
        """Least cost and audit of a sequence by itself."""
        cost, rank, _ = self._rows(sequence, START)
        price, end, tail = finish(cost, rank)
        return price, self.audit(sequence, START, end) + tail


def finish(cost: list[int], rank: list[int]) -> tuple[int, int, str]:
    """Least cost, state before the last inserts, and those inserts."""
    inserts = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}
    price, _, end = min((cost[k] + INSERT * n, rank[k], k) for k, n in inserts.items())
    return price, end, "I" * inserts[end]


def chain(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """Least cost of segments in turn, (from, to) of each, and the inserts at
    the end. A segment is given by the costs and ranks of its matrix."""
    cost, rank, back = [0, NEVER, NEVER, NEVER], [0] * 4, []
    for c, r in segments:
        found = [min((cost[k] + c[4 * k + j], rank[k], r[4 * k + j], k) for k in range(4)) for j in range(4)]
        order = sorted(range(4), key=lambda j: found[j][1:3])
        cost, rank = [min(f[0], NEVER) for f in found], [order.index(j) for j in range(4)]
        back.append([f[3] for f in found])
    price, end, tail = finish(cost, rank)
    steps = []
    for b in reversed(back):
        steps.append((b[end], end))
        end = b[end]
    return price, steps[::-1], tail


def applied(audit: str, turns: list[tuple[str, str]], state: int = START) -> list[tuple[str, str]]:
    """The (role, text) that an audit leaves of turns, from a state on."""
    out, k = [], 0
    for edit in audit:
        if edit == "I":
            state, role = NEXT[state]
            out.append((role, ""))
            continue
        role, text = turns[k]
        k += 1
        if edit == "R":
            state, role = NEXT[state]
        elif edit == "K":
            state = KEPT[role[:1], state]
        if edit != "D":
            out.append((role, text))
    return out
