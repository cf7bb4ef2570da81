"""The cheapest repair of a sequence of turns as a choice of the turns that are retained; no Spark in here.

A turn has a code: its role's initial (0 other, 1 ``s``, 2 ``u``, 3 ``a``), plus
4 if it must go, plus 8 if it is truncated.  States are what was put out last:
0 nothing yet, 1 ``s``, 2 ``u``, 3 ``a``.  Between two retained turns all turns
are deleted, at a price that prefix sums give, and the roles of the pair fix
what is inserted; so the best next turn of each role is a running minimum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MUST_GO, TRUNCATED = 4, 8
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
#: More than any repair of a block costs; the sums stay exact.
FAR = 1 << 60
#: Number of turns inserted between two states; None if the step is impossible.  An ``s`` can only be kept, and first.
BETWEEN = {(0, 1): 0, (0, 2): 0, (0, 3): 1, (1, 2): 0, (1, 3): 1, (2, 2): 1, (2, 3): 0, (3, 2): 0, (3, 3): 1}
#: Turns inserted after the last retained one, by state.
AFTER = ("", "ua", "a", "")
END = tuple(INSERT * len(a) for a in AFTER)


def retain_costs(code: int) -> tuple[int, int, int]:
    """Price of putting a turn out as s, u and a."""
    if code & MUST_GO:
        return FAR, FAR, FAR
    own, more = code & 3, CUT_SHORT if code & TRUNCATED else 0
    return (more if own == 1 else FAR), (0 if own == 2 else REROLE) + more, (0 if own == 3 else REROLE) + more


_COSTS = tuple(retain_costs(c) for c in range(16))


def suffix_costs(codes: Sequence[int], end: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """For each place, and for the end, the least price of the rest from each state; ``end`` is that of what follows."""
    n = len(codes)
    out = [tuple(end)] * (n + 1)
    ms = mu = ma = FAR  # the best next turn put out as s, u, a, with the deletions up to it
    gone = DELETE * n
    tail0, tail1, tail2, tail3 = (gone + e for e in end)  # all the rest deleted
    _, b1, b2, b3 = end
    for i in range(n - 1, -1, -1):
        here = DELETE * i
        s, u, a = _COSTS[codes[i]]
        if u < FAR:
            ms, mu, ma = min(ms, here + s + b1), min(mu, here + u + b2), min(ma, here + a + b3)
        to_a = min(mu + INSERT, ma)
        to_u = min(mu, ma + INSERT)
        b2, b1 = min(to_a, tail2) - here, min(to_u, tail1) - here
        b3 = min(to_u, tail3) - here
        out[i] = (min(ms, to_u, tail0) - here, b1, b2, b3)
    return out


def decode(codes: Sequence[int], costs: list[tuple[int, int, int, int]], state: int) -> tuple[str, int]:
    """The least of the cheapest audits from ``state``, and the state after it; inserts that end a conversation are not in it."""
    out = []
    for i, code in enumerate(codes):
        best, rest = costs[i][state], costs[i + 1]
        if rest[state] + DELETE == best:
            out.append("D")
            continue
        options = []
        for to, price in enumerate(_COSTS[code], 1):
            number = BETWEEN.get((state, to))
            if number is not None and price < FAR and INSERT * number + price + rest[to] == best:
                options.append(("I" * number + ("K" if to == code & 3 else "R"), to))
        step, state = min(options)
        out.append(step)
    return "".join(out), state


def matrix(codes: Sequence[int]) -> list[list[int]]:
    """Least price through a block from each state to each; FAR or more where there is no way."""
    columns = [suffix_costs(codes, [0 if k == out else FAR for k in range(4)])[0] for out in range(4)]
    return [[columns[out][into] for out in range(4)] for into in range(4)]


def ends_of(matrices: Sequence[Sequence[Sequence[int]]]) -> tuple[list[tuple[int, ...]], int]:
    """What follows each block of a conversation costs from each state, and what the whole one costs."""
    now, out = np.array(END), []
    for m in reversed(matrices):
        out.append(tuple(int(x) for x in now))
        now = np.minimum(np.array(m) + now, FAR).min(1)
    return out[::-1], int(now[0])


def outputs(audit: str, codes: Sequence[int], state: int) -> tuple[list[tuple[str, str, str]], int]:
    """For each turn its edit, the role's initial that it is put out with, and the initials inserted before it."""
    out, before, at = [], "", 0
    for step in audit:
        if step == "I":
            state = 3 if state == 2 else 2
            before += "sua"[state - 1]
            continue
        if step == "D":
            out.append((step, "", before))
        else:
            state = codes[at] & 3 if step == "K" else 3 if state == 2 else 2
            out.append((step, "sua"[state - 1], before))
        before, at = "", at + 1
    return out, state
