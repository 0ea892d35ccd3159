"""A trie of entries that is searched with weighted edit distances.

Entries are sorted, so that the children of a node stand in one stretch of the next level. A search keeps, for each node that
is still open, one row of the distance table against the text, worked out from its parent's for all open nodes of a level
at once; entries below a node share its row. A node whose least cost is over the limit is closed, and everything below it
is never looked at: insertions, deletions and substitutions cost 0 or more, so costs along a branch don't fall.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from os.path import commonprefix

import numpy as np

from labelloom.functions.distance import Weights, distances, substitution_cost

#: Costs are added in another order here than in the whole table; what this much decides is measured again there.
SLACK = 1e-6


class Trie:
    def __init__(self, entries: Iterable[str], weights: Weights):
        self.entries = list(entries)
        self.weights = dict(weights)
        order = sorted(range(len(self.entries)), key=self.entries.__getitem__)
        self.letters = sorted(set("".join(self.entries)))
        number = {c: i for i, c in enumerate(self.letters)}
        letter: list[array] = []
        parent: list[array] = []
        ends: dict[tuple[int, int], list[int]] = {}
        last = ""
        for i in order:
            word = self.entries[i]
            for depth in range(len(commonprefix([last, word])), len(word)):
                if depth == len(letter):
                    letter.append(array("i"))
                    parent.append(array("i"))
                letter[depth].append(number[word[depth]])
                parent[depth].append(len(letter[depth - 1]) - 1 if depth else 0)
            depth = len(word)
            ends.setdefault((depth, len(letter[depth - 1]) - 1 if depth else 0), []).append(i)
            last = word
        self.letter = [np.array(x, np.int32) for x in letter]
        #: The children of node j of a level stand from starts[j] to before starts[j + 1] in the next one.
        self.starts = [np.searchsorted(np.array(x), np.arange(n + 1)) for x, n in zip(parent, [1, *map(len, letter)])]
        self.ends = ends
        self.costs: dict[str, np.ndarray] = {}
        self.visited = 0

    def cost(self, c: str) -> np.ndarray:
        """Of each letter of the trie against c."""
        if c not in self.costs:
            self.costs[c] = np.array([substitution_cost(x, c, self.weights) for x in self.letters])
        return self.costs[c]

    def near(self, text: str, limit: float) -> list[tuple[int, float]]:
        """The entries, by place, within limit of text, and their distances; `visited` counts the nodes that were looked at."""
        n = len(text)
        against = np.stack([self.cost(c) for c in text]) if n else np.zeros((0, len(self.letters)))
        steps = np.arange(n + 1.0)
        rows, nodes = steps[None, :], np.zeros(1, np.int64)
        found = self._ended(0, nodes, rows, limit)
        for depth, letter in enumerate(self.letter):
            starts = self.starts[depth]
            count = starts[nodes + 1] - starts[nodes]
            if not count.any():
                break
            children = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[nodes], count)
            above = np.repeat(rows, count, axis=0)
            self.visited += len(children)
            best = np.empty_like(above)
            best[:, 0] = above[:, 0] + 1
            best[:, 1:] = np.minimum(above[:, :-1] + against[:, letter[children]].T, above[:, 1:] + 1)
            # Letters of the text that are left out cost 1 each: a running minimum, with these costs taken off.
            best = np.minimum.accumulate(best - steps, axis=1) + steps
            still = best.min(axis=1) <= limit + SLACK
            rows, nodes = best[still], children[still]
            if not len(nodes):
                break
            found += self._ended(depth + 1, nodes, rows, limit)
        measured = distances([text] * len(found), [self.entries[i] for i in found], self.weights).tolist()
        return [(i, d) for i, d in zip(found, measured) if d <= limit]

    def _ended(self, depth: int, nodes: np.ndarray, rows: np.ndarray, limit: float) -> list[int]:
        close = nodes[rows[:, -1] <= limit + SLACK]
        return [i for node in close.tolist() for i in self.ends.get((depth, node), ())]
