"""Generalised LL parsing: descriptors over a graph-structured stack, for any context-free grammar.

A grammar maps nonterminals to alternatives, each a tuple of symbols. A symbol that is no nonterminal is a terminal:
``fits(symbol, kind)`` says whether it can begin with a token of that kind, and ``step(symbol, i)`` where the input goes on
after it, or -1. Ambiguity and recursion are no problem: the parser follows all alternatives side by side, sharing their
stacks, and leaves out at once what the next token rules out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

Grammar = dict[str, list[tuple[str, ...]]]
#: nonterminal to where it begins to where it can end
Ends = dict[str, dict[int, set[int]]]


@dataclass
class State:
    """What has been parsed of one input: all attempts share it, so that none repeats what another has done."""

    done: Ends = field(default_factory=dict)
    edges: dict = field(default_factory=dict)
    seen: set = field(default_factory=set)


class Parser:
    def __init__(self, grammar: Grammar, fits: Callable[[str, str], bool]):
        self.grammar, self.fits = grammar, fits
        self.empty = self._nullable()
        self.first = self._first()
        # Places in alternatives are numbers: a place is followed by the next number, and ends with no symbol.
        self.symbol: list[str | None] = []
        self.begins: dict[str, list[int]] = {}
        for nt, alts in grammar.items():
            self.begins[nt] = []
            for alt in alts:
                self.begins[nt].append(len(self.symbol))
                self.symbol += [*alt, None]
        self._goes: dict[tuple[int, str], bool] = {}
        self._opens: dict[tuple[str, str], list[int]] = {}

    def _nullable(self) -> set[str]:
        empty: set[str] = set()
        grew = True
        while grew:
            grew = False
            for nt, alts in self.grammar.items():
                if nt not in empty and any(all(s in empty for s in a) for a in alts):
                    empty.add(nt)
                    grew = True
        return empty

    def _first(self) -> dict[str, set[str]]:
        first: dict[str, set[str]] = {nt: set() for nt in self.grammar}
        grew = True
        while grew:
            grew = False
            for nt, alts in self.grammar.items():
                before = len(first[nt])
                for alt in alts:
                    first[nt] |= self.starts(alt, first)
                grew |= len(first[nt]) != before
        return first

    def starts(self, symbols: tuple[str, ...], first: dict[str, set[str]] | None = None) -> set[str]:
        """The terminals that can begin these symbols."""
        first, out = self.first if first is None else first, set()
        for s in symbols:
            out |= first[s] if s in self.grammar else {s}
            if s not in self.empty:
                break
        return out

    def goes(self, place: int, kind: str) -> bool:
        """Whether what is left from a place on can meet a token of this kind, or be empty."""
        known = self._goes.get((place, kind))
        if known is None:
            known, at = False, place
            while True:
                s = self.symbol[at]
                if s is None or any(self.fits(x, kind) for x in (self.first[s] if s in self.grammar else (s,))):
                    known = True
                    break
                if s not in self.empty:
                    break
                at += 1
            self._goes[place, kind] = known
        return known

    def open(self, nt: str, kind: str) -> list[int]:
        """The alternatives that can meet a token of this kind, or be empty."""
        known = self._opens.get((nt, kind))
        if known is None:
            known = self._opens[nt, kind] = [p for p in self.begins[nt] if self.goes(p, kind)]
        return known

    def parse(self, start: str, at: int, kinds: list[str], step: Callable[[str, int], int], state: State) -> Ends:
        """All completed nonterminals so far; ``kinds`` are those of the tokens, with one more for the end."""
        symbols, grammar, goes = self.symbol, self.grammar, self._goes
        done, edges, seen = state.done, state.edges, state.seen
        todo: list[tuple[int, tuple[str, int], int]] = []

        def go(place: int, node: tuple[str, int], i: int) -> None:
            key = (place, kinds[i])
            ok = goes.get(key)
            if ok is None:
                ok = self.goes(*key)
            if ok:
                d = (place, node, i)
                if d not in seen:
                    seen.add(d)
                    todo.append(d)

        def call(nt: str, i: int, back: tuple[int, tuple[str, int]] | None) -> None:
            node = (nt, i)
            callers = edges.get(node)
            if callers is None:
                edges[node] = {back: None}
                for place in self.open(nt, kinds[i]):
                    d = (place, node, i)
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            elif back not in callers:
                callers[back] = None
                if back is not None:
                    for end in tuple(done.get(nt, {}).get(i, ())):
                        go(back[0], back[1], end)

        call(start, at, None)
        while todo:
            place, node, i = todo.pop()
            while (symbol := symbols[place]) is not None:
                if symbol in grammar:
                    call(symbol, i, (place + 1, node))
                    break
                i = step(symbol, i)
                if i < 0:
                    break
                place += 1
            else:
                ends = done.setdefault(node[0], {}).setdefault(node[1], set())
                if i not in ends:
                    ends.add(i)
                    for back in edges[node]:
                        if back is not None:
                            go(back[0], back[1], i)
        return done
