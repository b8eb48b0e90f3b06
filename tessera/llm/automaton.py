"""One deterministic automaton over bytes for many rules.

Rules are regular expressions over ASCII with literals, `\\xNN`, classes, groups, alternation and the repeats
`? * + {m} {m,} {m,n}`. They are parsed to a nondeterministic automaton, made deterministic by subset construction over
byte classes and minimised by refining a partition of the states; the result is a transition array whose states carry
the set of rules that accept there, as bits.

`begins` runs the combined automaton of all mirrored rules over all texts in one pass from the end: the buffer is laid out in
lanes that step together, and a lane whose neighbour ends in another state than it began with is run again until the states
agree. Its states tell at which bytes which rules may begin. `Ahead` is the combined automaton of the rules as they are; from
those bytes it tells how far each rule reaches. Both together give `spans`: leftmost-longest, non-overlapping matches.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Ends a text in the buffer; no UTF-8 text holds it.
END = 0xFF


# --- parsing: trees are ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)


def parse(pattern: str) -> tuple:
    at = 0

    def escape() -> frozenset[int]:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return frozenset([int(pattern[at - 2 : at], 16)])
        named = {"d": string.digits, "w": string.ascii_letters + string.digits + "_", "n": "\n", "r": "\r", "t": "\t"}
        return frozenset(map(ord, named.get(c, c)))

    def members() -> frozenset[int]:
        nonlocal at
        negated = pattern[at] == "^"
        at += negated
        found: set[int] = set()
        while pattern[at] != "]":
            c = pattern[at]
            at += 1
            low = escape() if c == "\\" else frozenset([ord(c)])
            if pattern[at] == "-" and pattern[at + 1] != "]" and len(low) == 1:
                high = pattern[at + 1]
                at += 2
                found |= set(range(min(low), (min(escape()) if high == "\\" else ord(high)) + 1))
            else:
                found |= low
        at += 1
        return frozenset(set(range(END)) - found if negated else found)

    def either() -> tuple:
        nonlocal at
        branches = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            branches.append(sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            at += 1
            if c == "(":
                if pattern.startswith("?:", at):
                    at += 2
                item = either()
                if at >= len(pattern):
                    raise ValueError(f"unclosed group: {pattern}")
                at += 1
            elif c == "[":
                item = ("set", members())
            elif c == "\\":
                item = ("set", escape())
            elif c == ".":
                item = ("set", frozenset(set(range(END)) - {10}))
            else:
                item = ("set", frozenset([ord(c)]))
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
                if c == "{":
                    close = pattern.index("}", at)
                    low, comma, high = pattern[at:close].partition(",")
                    least, most, at = int(low), (int(high) if high else None) if comma else int(low), close + 1
                item = ("rep", item, least, most)
            parts.append(item)
        return ("cat", parts)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"unbalanced: {pattern}")
    return tree


def any_case(tree: tuple) -> tuple:
    """The same with ASCII letters in either case."""
    if tree[0] == "set":
        return "set", frozenset(ord(x) for b in tree[1] for x in (chr(b).lower(), chr(b).upper()) if b < 128) | frozenset(b for b in tree[1] if b >= 128)
    if tree[0] == "rep":
        return "rep", any_case(tree[1]), *tree[2:]
    return tree[0], [any_case(x) for x in tree[1]]


def backwards(tree: tuple) -> tuple:
    """Accepts the mirrored words."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return "rep", backwards(tree[1]), *tree[2:]
    parts = [backwards(x) for x in tree[1]]
    return tree[0], parts[::-1] if tree[0] == "cat" else parts


def uncounted(tree: tuple) -> tuple:
    """Accepts at least the beginnings that the tree does, with endless repeats of one or more in place of counted ones."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        part = uncounted(tree[1])
        return ("rep", part, min(tree[2], 1), None if tree[2] > 1 or tree[3] is None else tree[3])
    return tree[0], [uncounted(x) for x in tree[1]]


# --- construction


@dataclass(frozen=True)
class Automaton:
    """table[state * width + byte_class[byte]] is the next state times width; accepts[state] has the rules' bits. State 0 begins, and END leads to it."""

    table: np.ndarray
    byte_class: np.ndarray
    accepts: np.ndarray
    width: int
    dead: int  # the state that nothing leaves, or -1


def build(trees: Iterable[tuple], anywhere: bool) -> Automaton:
    """anywhere: a match may begin at any byte (the language .*rule); else at the first one."""
    edges: list[list[tuple[frozenset[int], int]]] = []
    empty: list[list[int]] = []
    ends: dict[int, int] = {}

    def state() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    def wire(tree: tuple, start: int) -> int:
        if tree[0] == "set":
            edges[start].append((tree[1], end := state()))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = wire(part, start)
            return start
        if tree[0] == "alt":
            end = state()
            for part in tree[1]:
                empty[start].append(first := state())
                empty[wire(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = wire(part, start)
        if most is None:
            empty[start].append(first := state())
            last = wire(part, first)
            empty[last].append(first)
            empty[first].append(end := state())
            empty[last].append(end)
            return end
        end = state()
        empty[start].append(end)
        for _ in range(most - least):
            start = wire(part, start)
            empty[start].append(end)
        return end

    root = state()
    for bit, tree in enumerate(trees):
        empty[root].append(first := state())
        last = wire(tree, first)
        ends[last] = ends.get(last, 0) | 1 << bit

    # bytes that no edge tells apart are one class
    marks: dict[tuple, int] = {}
    sets = sorted({e[0] for x in edges for e in x}, key=sorted)
    byte_class = np.zeros(256, np.int64)
    for b in range(256):
        byte_class[b] = marks.setdefault((b == END, *(b in s for s in sets)), len(marks))
    sample = {int(byte_class[b]): b for b in range(255, -1, -1)}
    width = len(marks)

    def closure(states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += empty[x]
        return frozenset(x for x in seen if edges[x] or x in ends)

    # subset construction
    begin = closure([root])
    numbers, order, rows = {begin: 0}, [begin], []
    while len(rows) < len(order):
        own = [e for x in order[len(rows)] for e in edges[x]]
        row = []
        for k in range(width):
            b = sample[k]
            reached = closure(to for s, to in own if b in s) if b != END else frozenset()
            reached = begin if b == END else reached | begin if anywhere else reached
            if reached not in numbers:
                numbers[reached] = len(order)
                order.append(reached)
            row.append(numbers[reached])
        rows.append(row)
    nexts = np.array(rows)
    accepts = np.array([sum({ends[x] for x in s if x in ends}) if len({ends[x] for x in s if x in ends}) < 2 else _bits(ends[x] for x in s if x in ends) for s in order])

    # minimisation: blocks are split by the blocks that their transitions reach until none splits
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, finer = np.unique(np.column_stack([block, block[nexts]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    # the block of the beginning is state 0
    names = np.unique(block, return_index=True)[1]
    rank = np.empty(len(names), np.int64)
    rank[[block[0], *[b for b in range(len(names)) if b != block[0]]]] = np.arange(len(names))
    keep = names[np.argsort(rank)]
    table = rank[block[nexts[keep]]]
    letters = [k for k in range(width) if sample[k] != END]
    dead = [s for s in range(len(keep)) if not accepts[keep][s] and (table[s][letters] == s).all()]
    return Automaton((table * width).ravel().astype(np.int32), byte_class.astype(np.uint8), accepts[keep], width, dead[0] if dead else -1)


def _bits(values: Iterable[int]) -> int:
    out = 0
    for v in values:
        out |= v
    return out


# --- running


def states(machine: Automaton, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """The state (times width) after each byte of data."""
    n = len(data)
    steps = -(-n // lanes)
    if steps < 16:
        lanes = max(1, n // 16)
        steps = -(-n // lanes)
    padded = np.full(lanes * steps, END, np.uint8)
    padded[:n] = data
    classes = np.ascontiguousarray(machine.byte_class[padded].reshape(lanes, steps).T)
    out = np.empty((steps, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for t in range(steps):
        now = machine.table[now + classes[t]]
        out[t] = now
    # lanes began in state 0; where the lane before ended elsewhere, step again until the states meet
    came = np.zeros(lanes, np.int32)
    while True:
        should = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
        active = np.flatnonzero(should != came)
        if not len(active):
            break
        came = should
        now = should[active]
        for t in range(steps):
            now = machine.table[now + classes[t, active]]
            differ = now != out[t, active]
            active, now = active[differ], now[differ]
            if not len(active):
                break
            out[t, active] = now
    return out.T.ravel()[:n]


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, each followed by END, and where each begins there. data[offsets[i]:offsets[i+1]] is text i."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, END, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets[:-1] + np.arange(n)


def begins(machine: Automaton, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit, position) of all places where a match of a rule may begin, in this order; machine: of the mirrored rules, anywhere. One pass over the buffer from its end."""
    ran = states(machine, buffer[::-1])[::-1]
    flags = np.repeat(machine.accepts, machine.width).astype(np.int64)
    at = np.flatnonzero((flags != 0)[ran])
    bits = flags[ran[at]]
    bit, k = np.nonzero((bits[None, :] >> np.arange(int(bits.max(initial=0)).bit_length())[:, None]) & 1)
    return bit, at[k]


class Ahead:
    """The combined automaton of rules that begin at a given byte; it tells how far each of them reaches."""

    #: Fewer matches than this are followed one by one.
    FEW = 8

    def __init__(self, trees: list[tuple]):
        self.machine, self.rules = build(trees, anywhere=False), len(trees)
        self.flags = np.repeat(self.machine.accepts, self.machine.width).astype(np.int64)
        self.dead = self.machine.dead * self.machine.width
        nexts = self.machine.table.reshape(-1, self.machine.width)[:, self.machine.byte_class]
        self._nexts = {s * self.machine.width: row for s, row in enumerate(nexts.tolist())}
        self._flags = {s * self.machine.width: int(b) for s, b in enumerate(self.machine.accepts)}

    def ends(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each start and rule: the end of the longest match, or -1."""
        out = np.full((len(starts), self.rules), -1, np.int64)
        lane, now, at = np.arange(len(starts)), np.zeros(len(starts), np.int32), starts.copy()
        while len(lane) >= self.FEW:
            byte = buffer[at]
            now = self.machine.table[now + self.machine.byte_class[byte]]
            at = at + 1
            going = (byte != END) & (now != self.dead)
            lane, now, at = lane[going], now[going], at[going]
            reached = self.flags[now]
            for bit in range(self.rules if reached.any() else 0):
                here = np.flatnonzero(reached >> bit & 1)
                out[lane[here], bit] = at[here]
        for i, s, k in zip(lane.tolist(), now.tolist(), at.tolist(), strict=True):
            rest, last = memoryview(buffer)[k:], {}
            for step, byte in enumerate(rest, k + 1):
                s = self._nexts[s][byte]
                if byte == END or s == self.dead:
                    break
                if self._flags[s]:
                    last[self._flags[s]] = step
            for bits, end in last.items():
                for bit in range(self.rules):
                    if bits >> bit & 1:
                        out[i, bit] = max(out[i, bit], end)
        return out


def spans(behind: Automaton, ahead: Ahead, rules: int, buffer: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leftmost-longest matches of each of the first `rules` rules that don't overlap others of the rule: (text, rule, start, the ends of all rules there).

    first: where each text begins in the buffer. All texts and rules go ahead together, each by one match a round.
    """
    bit, at = begins(behind, buffer)
    size = len(buffer) + 1
    keys = bit * size + at
    text = np.searchsorted(first, at, "right") - 1
    new = np.flatnonzero(np.diff(bit, prepend=-1).astype(bool) | np.diff(text, prepend=-1).astype(bool))
    here, stop = new, np.append(new[1:], len(at))
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros((0, ahead.rules), np.int64),)]
    while len(here):
        ends = ahead.ends(buffer, at[here])
        own = ends[np.arange(len(here)), bit[here]]
        matched = own > at[here]
        found.append((text[here][matched], bit[here][matched], at[here][matched], ends[matched]))
        here = np.searchsorted(keys, bit[here] * size + np.maximum(own, at[here] + 1))
        going = here < stop
        here, stop = here[going], stop[going]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
