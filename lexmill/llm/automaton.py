"""Generalised suffix automaton over sequences of whole numbers."""

from __future__ import annotations


class SuffixAutomaton:
    """All runs of the sequences added; grows by ``add``.

    States are numbers: ``size`` is the longest run that ends in a state, ``link``
    its suffix link and ``next`` its transitions.
    """

    def __init__(self) -> None:
        self.size = [0]
        self.link = [-1]
        self.next: list[dict] = [{}]

    def add(self, sequence, owner: list[int] | None = None, by: int = 0) -> list[int]:
        """Add a sequence; the state of each of its prefixes.

        ``owner`` is a list with a number for each state, which gets ``by`` for the new
        ones and for a clone what the state it is cloned from has: with growing ``by``,
        the first sequence that has the state's runs.
        """
        size, link, step = self.size, self.link, self.next
        last, out = 0, []
        for c in sequence:
            q = step[last].get(c)
            if q is not None:
                if size[q] == size[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                    if owner is not None:
                        owner.append(owner[q])
                out.append(last)
                continue
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            step.append({})
            if owner is not None:
                owner.append(by)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    link[new] = self._clone(p, c, q)
                    if owner is not None:
                        owner.append(owner[q])
            last = new
            out.append(new)
        return out

    def _clone(self, p: int, c, q: int) -> int:
        size, link, step = self.size, self.link, self.next
        new = len(size)
        size.append(size[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def by_size(self) -> list[int]:
        """States but the root, longest first, so a state comes before its link."""
        return sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True)

    def matching(self, sequence):
        """(state, length) of the longest run that ends at each place of ``sequence``."""
        size, link, step = self.size, self.link, self.next
        state = length = 0
        for c in sequence:
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(c)
            if to is not None:
                state, length = to, length + 1
            yield state, length
