"""Minimal acyclic transducer from terms to their ordinals in byte order."""

from __future__ import annotations

import numpy as np


class Transducer:
    """Arrays of a minimal acyclic transducer: arcs ``base[state] + byte`` with their owner, target and output; final states.

    The outputs along the path of a term add up to its ordinal. Built from sorted terms in one pass: states that no later term can
    change are looked up by their arcs and shared. States are placed so that the arcs of several states interleave.
    """

    def __init__(self, base: np.ndarray, owner: np.ndarray, target: np.ndarray, output: np.ndarray, final: np.ndarray, below: np.ndarray):
        self.base, self.owner, self.target, self.output, self.final, self.below = base, owner, target, output, final, below

    @classmethod
    def build(cls, terms) -> "Transducer":
        """``terms``: distinct byte strings in ascending order."""
        known: dict[tuple, int] = {}  # (final, arcs) -> state
        states: list[tuple[bool, tuple]] = []  # of a state: final, arcs (byte, target); targets come first
        path: list[tuple[list, list]] = [([False], [])]  # along the last term: final, arcs to frozen states
        last = b""

        def freeze(node) -> int:
            key = (node[0][0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))

        for term in terms:
            same = 0
            while same < len(last) and same < len(term) and last[same] == term[same]:
                same += 1
            close(same)
            path += [([False], []) for _ in term[same:]]
            path[-1][0][0] = True
            last = term
        close(0)
        return cls._placed(states, freeze(path[0]))

    @classmethod
    def _placed(cls, states: list[tuple[bool, tuple]], start: int) -> "Transducer":
        below = np.zeros(len(states), np.int64)  # terms from a state on
        for s, (final, arcs) in enumerate(states):
            below[s] = final + sum(int(below[t]) for _, t in arcs)
        renamed = {start: 0}
        for s in range(len(states)):
            renamed.setdefault(s, len(renamed))
        taken, base, free, hole, slots = bytearray(1024), np.zeros(len(states), np.int64), 0, 0, []
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            arcs = states[s][1]
            if not arcs:
                continue
            first, tries = arcs[0][0], 0
            at = max(hole if len(arcs) == 1 else free, first)
            while True:
                while len(taken) < at + 512 or not 0 <= taken.find(0, at) <= len(taken) - 512:
                    taken += bytearray(len(taken))
                at = taken.find(0, at)
                if not any(taken[at - first + b] for b, _ in arcs[1:]):
                    break
                at, tries = at + 1, tries + 1
            for b, t in arcs:
                taken[at - first + b] = 1
                slots.append((at - first + b, s, b, t))
            base[s] = at - first
            if tries > 32:  # few places are left below
                free = at
            if len(arcs) == 1 and hole >= first:
                hole = at
        size = max((slot for slot, *_ in slots), default=0) + 257
        owner, target, output = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        before: dict[int, int] = {}
        for slot, s, _, t in slots:  # arcs of a state stand together, bytes ascending
            had = before.get(s, int(states[s][0]))
            owner[slot], target[slot], output[slot] = renamed[s], renamed[t], had
            before[s] = had + int(below[t])
        order = np.array(sorted(renamed, key=renamed.get), np.int64)
        final = np.array([states[s][0] for s in order.tolist()], bool)
        return cls(base[order], owner.astype(np.int32), target.astype(np.int32), output, final, below[order])

    def arrays(self) -> dict[str, bytes]:
        """As named byte strings, for a row of a table."""
        return {"base": self.base.astype("<i8").tobytes(), "owner": self.owner.astype("<i4").tobytes(), "target": self.target.astype("<i4").tobytes(), "output": self.output.astype("<i8").tobytes(), "final": self.final.tobytes(), "below": self.below.astype("<i8").tobytes()}

    @classmethod
    def of(cls, row: dict) -> "Transducer":
        kinds = {"base": "<i8", "owner": "<i4", "target": "<i4", "output": "<i8", "final": "?", "below": "<i8"}
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in kinds.items()})

    def state(self, prefix: bytes) -> tuple[int, int]:
        """State and output after a prefix; state -1 if no term has it."""
        state, out = 0, 0
        for byte in prefix:
            slot = int(self.base[state]) + byte
            if self.owner[slot] != state:
                return -1, 0
            state, out = int(self.target[slot]), out + int(self.output[slot])
        return state, out

    def ordinals(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places and ordinals of the known ones among the words that are the byte ranges of ``flat``; all words take a step at a time.

        ``state`` is that of a prefix that the words stand behind; ordinals then count from its first term.
        """
        words, states, sums = np.arange(len(starts)), np.full(len(starts), state), np.zeros(len(starts), np.int64)
        at, found = starts, [(words[:0], sums[:0])]
        while len(words):
            slots = self.base[states] + flat[at]
            on = np.flatnonzero(self.owner[slots] == states)
            slots, words, at = slots[on], words[on], at[on] + 1
            states, sums = self.target[slots].astype(np.int64), sums[on] + self.output[slots]
            over = at == ends[words]
            ended = over & self.final[states]
            found.append((words[ended], sums[ended]))
            on = ~over
            words, states, sums, at = words[on], states[on], sums[on], at[on]
        return tuple(np.concatenate(c) for c in zip(*found))

    def term(self, ordinal: int) -> bytes:
        """The term with an ordinal."""
        state, out = 0, bytearray()
        while not (self.final[state] and ordinal == 0):
            begin = int(self.base[state])
            arcs = np.flatnonzero(self.owner[max(begin, 0) : begin + 256] == state) + max(begin, 0)
            slot = int(arcs[np.searchsorted(self.output[arcs], ordinal, "right") - 1])
            out.append(slot - begin)
            ordinal -= int(self.output[slot])
            state = int(self.target[slot])
        return bytes(out)
