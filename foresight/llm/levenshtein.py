"""Levenshtein automaton of a word, run as bit sets over a trie of terms."""

from __future__ import annotations

from collections.abc import Iterable


class Trie:
    """Terms as nested nodes; ``None`` marks the end of a term and holds its allowed distance."""

    def __init__(self, terms: Iterable[tuple[str, int]]) -> None:
        self.root: dict = {}
        self.most = 0
        self.depth = 0
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.middles: set[str] = set()
        for term, allowed in terms:
            self._note_pieces(term, allowed + 1)
            node = self.root
            for char in term:
                node = node.setdefault(char, {})
            node[None] = allowed
            self.most = max(self.most, allowed)
            self.depth = max(self.depth, len(term))

    def _note_pieces(self, term: str, pieces: int) -> None:
        """Of one piece more than edits are allowed, one is left whole: the first, the last or one between."""
        edges = [len(term) * k // pieces for k in range(pieces + 1)]
        head, tail = term[: edges[1]], term[edges[-2] :]
        self.heads.setdefault(len(head), set()).add(head)
        self.tails.setdefault(len(tail), set()).add(tail)
        self.middles.update(term[a:b] for a, b in zip(edges[1:-2], edges[2:-1], strict=True))

    def may_match(self, word: str) -> bool:
        """False only where no term can be near: most words end here, before any walk."""
        return (
            any(word[:n] in heads for n, heads in self.heads.items())
            or any(word[-n:] in tails for n, tails in self.tails.items() if n)
            or any(middle in word for middle in self.middles)
        )

    def distance(self, word: str) -> int | None:
        """The least edit distance to a term that allows it, or None.

        Bit j of state e says that j letters of the word are read after e edits or fewer. A branch
        ends where no state is left, so only terms near the word are walked.
        """
        if not self.root or not self.may_match(word):
            return None
        masks: dict[str, int] = {}
        for place, char in enumerate(word):
            masks[char] = masks.get(char, 0) | 1 << place
        end, edits = 1 << len(word), self.most
        room = (end << 1) - 1
        start = [(1 << (e + 1)) - 1 & room for e in range(edits + 1)]
        best = None
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for char, child in node.items():
                if char is None:
                    for e in range(child + 1):
                        if states[e] & end and (best is None or e < best):
                            best = e
                            break
                    continue
                mask = masks.get(char, 0)
                below = (states[0] & mask) << 1
                after = [below]
                for e in range(1, edits + 1):
                    less = states[e - 1]
                    below = ((states[e] & mask) << 1 | less | less << 1 | below << 1) & room
                    after.append(below)
                if after[-1]:
                    stack.append((child, after))
        return best
