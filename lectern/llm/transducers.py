"""Small weighted transducers over symbols: arcs, composition and the best path.

A machine's arcs lead from a state and an input symbol to any number of (output, weight, next state).
Weights are factors on the weight that comes with the input symbol, and add up along a path. A path
counts only if it ends in a final state. Composition runs two machines as one: what the first writes,
the second reads.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

Arc = tuple[Hashable, float, int]


class Machine:
    """States are numbers, 0 is the start. Without an arc for its input a path dies."""

    def __init__(self):
        self.arcs: list[dict[Hashable, list[Arc]]] = [{}]
        self.final: set[int] = set()

    def state(self, final: bool = False) -> int:
        self.arcs.append({})
        if final:
            self.final.add(len(self.arcs) - 1)
        return len(self.arcs) - 1

    def arc(self, source: int, symbol: Hashable, target: int, output: Hashable = None, weight: float = 0.0) -> None:
        self.arcs[source].setdefault(symbol, []).append((output, weight, target))


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that reads what ``first`` reads and writes what ``second`` writes; only states that can be reached."""
    out, number, todo = Machine(), {(0, 0): 0}, [(0, 0)]
    while todo:
        p, q = todo.pop()
        here = number[p, q]
        if p in first.final and q in second.final:
            out.final.add(here)
        for symbol, arcs in first.arcs[p].items():
            for middle, w, p2 in arcs:
                for output, v, q2 in second.arcs[q].get(middle, ()):
                    if (p2, q2) not in number:
                        number[p2, q2] = out.state()
                        todo.append((p2, q2))
                    out.arc(here, symbol, number[p2, q2], output, w + v)
    return out


def best_path(machine: Machine, symbols: Sequence[tuple[Hashable, float]], outputs: int) -> tuple[float, ...] | None:
    """Weights by output, of the heaviest path that reads ``symbols``, pairs of symbol and weight, and ends well.

    Outputs are numbers below ``outputs``, or None for nothing. Of equally heavy paths the one with more
    weight in the later outputs counts.
    """
    live = {0: (0.0, (0.0,) * outputs)}
    for symbol, weight in symbols:
        after: dict[int, tuple] = {}
        for state, (total, sums) in live.items():
            for output, factor, target in machine.arcs[state].get(symbol, ()):
                if output is None:
                    got = total, sums
                else:
                    w = factor * weight
                    got = total + w, (*sums[:output], sums[output] + w, *sums[output + 1 :])
                if target not in after or _order(got) > _order(after[target]):
                    after[target] = got
        live = after
    ends = [x for state, x in live.items() if state in machine.final]
    return max(ends, key=_order)[1] if ends else None


def _order(x: tuple) -> tuple:
    return round(x[0], 9), x[1][::-1]


class Trie:
    """A word acceptor: states are prefixes, accepting ones carry weights for words ("idiot$") or stems ("idio")."""

    def __init__(self, entries: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.weights: list[float] = [0.0]
        for entry, weight in entries.items():
            at = 0
            for c in entry:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.weights.append(0.0)
                at = self.next[at][c]
            self.weights[at] = max(self.weights[at], weight)

    def weight(self, word: str) -> float:
        """The heaviest accepting state on the word's way; a stem is shorter than its word."""
        at, found = 0, 0.0
        for c in word:
            found = max(found, self.weights[at])
            if (at := self.next[at].get(c, -1)) < 0:
                return found
        end = self.next[at].get("$", -1)
        return max(found, self.weights[end]) if end >= 0 else found


def symbols_of(machines: Iterable[Machine]) -> set:
    return {s for m in machines for arcs in m.arcs for s in arcs}
