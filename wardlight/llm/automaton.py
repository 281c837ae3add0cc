"""Suffix automaton over word sequences, with the least owner of each sequence."""

_FAR = (1 << 63) - 1


class SuffixAutomaton:
    """Of a shard of reference sequences, each with an owner number."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [_FAR]

    def add(self, sequence: list, owner: int) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)
            if owner < self.owner[last]:
                self.owner[last] = owner

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(_FAR)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for the shorter sequences that reach it from p."""
        following, link = self.next, self.link
        copy = self._state(self.length[p] + 1, link[q], dict(following[q]))
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _extend(self, p: int, word) -> int:
        following, link, length = self.next, self.link, self.length
        q = following[p].get(word)
        if q is not None:  # an earlier sequence has been here
            return q if length[q] == length[p] + 1 else self._split(p, word, q)
        new = self._state(length[p] + 1, 0, {})
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def settle(self) -> None:
        """Hand owners on to shorter suffixes, after the last sequence is added."""
        owner, link = self.owner, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if owner[s] < owner[link[s]]:
                owner[link[s]] = owner[s]

    def matches(self, sequence: list, least: int) -> list[int | None]:
        """For each place: the least owner of the last ``least`` words there, None where the longest match is shorter."""
        following, link, length, found = self.next, self.link, self.length, []
        state = matched = 0
        for word in sequence:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            while state and length[link[state]] >= least:  # keep only as much as is asked for
                state = link[state]
                matched = length[state]
            found.append(self.owner[state] if matched >= least else None)
        return found
