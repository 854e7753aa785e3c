"""WordPiece by an automaton: longest pieces first, in one pass over the word.

A trie holds the vocabulary's entries as they start a word, another one what follows `##`. A node that is no
entry has the pieces of its longest-first split and the node of the second trie that the rest of its text leads to
(its failure link). Both follow from the parent's, so the automaton is built once per vocabulary in the
length of its entries. A word runs through it character by character; on a character without a way on, the pieces
of the node are put out and the walk goes on at its link. No substring is ever cut or looked up.
"""

from __future__ import annotations

from collections.abc import Iterable

INNER = "##"
NOWHERE = -1


class PieceAutomaton:
    """`step` leads from (node, character) to a node; node 0 starts a word, node 1 goes on inside one."""

    def __init__(self, tokens: Iterable[str]):
        self.step: dict[tuple[int, str], int] = {}
        self.link: list[int] = [NOWHERE, NOWHERE]
        self.pops: list[tuple[str, ...]] = [(), ()]
        entry: list[str | None] = [None, None]
        parent: list[tuple[int, str]] = [(NOWHERE, ""), (NOWHERE, "")]
        depth = [0, 0]

        def insert(start: int, text: str, token: str) -> None:
            node = start
            for c in text:
                after = self.step.get((node, c))
                if after is None:
                    after = self.step[node, c] = len(entry)
                    entry.append(None)
                    parent.append((node, c))
                    depth.append(depth[node] + 1)
                    self.link.append(NOWHERE)
                    self.pops.append(())
                node = after
            if node != start:
                entry[node] = token

        for token in tokens:
            insert(0, token, token)
            if token.startswith(INNER):
                insert(1, token[len(INNER) :], token)
        for node in sorted(range(2, len(entry)), key=depth.__getitem__):
            if entry[node] is not None:
                self.link[node], self.pops[node] = 1, (entry[node],)
                continue
            up, c = parent[node]
            at, out = self.link[up], self.pops[up]
            while at != NOWHERE and (at, c) not in self.step:
                at, out = self.link[at], out + self.pops[at]
            if at != NOWHERE:
                self.link[node], self.pops[node] = self.step[at, c], out

    def pieces(self, word: str) -> list[str] | None:
        """The pieces of a word, or None when some rest of it matches no entry."""
        node, out = 0, []
        for c in word:
            while (after := self.step.get((node, c))) is None:
                if self.link[node] == NOWHERE:
                    return None
                out.extend(self.pops[node])
                node = self.link[node]
            node = after
        while node > 1:
            if self.link[node] == NOWHERE:
                return None
            out.extend(self.pops[node])
            node = self.link[node]
        return out
