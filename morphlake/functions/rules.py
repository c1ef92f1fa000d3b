"""Context-sensitive rewrite rules over codes: built-in expressions where those are exact, else one Arrow function."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from morphlake.functions.derivatives import Automaton
from morphlake.functions.patterns import EMPTY, Node, Patterns, alphabet, expression, literal, mirrored, singles, strings

#: Placeholders of a simultaneous replacement lie here.
HELD = 0x100000


@dataclass
class Rule:
    """pairs: (input, outputs) that apply in one pass where the contexts fit. direction: ltr, rtl or sim.

    ltr: from left to right; the left context is seen in what has been written, the right one in what is still to be
    read. rtl is its mirror image; under sim both contexts are seen in the input. Where an input fits, it must be rewritten.
    """

    pairs: list[tuple[Node, list[str]]]
    left: Node = EMPTY
    right: Node = EMPTY
    direction: str = "ltr"
    name: str = ""
    tests: list = field(default_factory=list)
    symbols: str = ""

    @cached_property
    def automata(self) -> tuple[list[tuple[Automaton, list[str]]], Automaton | None, Automaton | None]:
        """(inputs with their outputs, whether a left context ends here, whether a right context, read from the end, begins here)."""
        every = frozenset(self.symbols).union(*map(alphabet, (self.left, self.right, *(a for a, _ in self.pairs))), *(frozenset(o) for _, outs in self.pairs for o in outs))
        anything = Node("*", (Node("set", codes=every),))
        behind = lambda n: None if n == EMPTY else Automaton.of(Node("seq", (anything, n)))
        return [(Automaton.of(a), outs) for a, outs in self.pairs], behind(self.left), behind(mirrored(self.right))

    def rewrite(self, codes: str) -> list[str]:
        """All results for one string, in order.

        Two passes: from the end, where right contexts begin; then from the front, where a place in the input and the state of the left context
        over what has been written say all that matters of it, so places are gone through once however many results there are.
        """
        if self.direction == "rtl":
            return sorted(x[::-1] for x in self._back.rewrite(codes[::-1]))
        if unknown := set(codes) - set(self.symbols):
            return replace(self, symbols=self.symbols + "".join(sorted(unknown))).rewrite(codes)
        inputs, before, after = self.automata
        n = len(codes)
        follows = [True] * (n + 1)
        if after is not None:
            state = 0
            for q in range(n, -1, -1):
                follows[q] = after.ended(state)
                state = after.step(state, codes[q - 1]) if q else state
        read = [0] * (n + 1)
        if before is not None and self.direction == "sim":
            for p in range(n):
                read[p + 1] = before.step(read[p], codes[p])
        on = lambda s, out: s if before is None or self.direction == "sim" else before.step(s, out)
        insert = sorted({o for a, outs in inputs if a.ends[0] for o in outs})
        hits: dict[int, list[tuple[int, str]]] = {}

        def found(p: int) -> list[tuple[int, str]]:
            if p not in hits:
                own = []
                for a, outs in inputs:
                    state, q = 0, p
                    while q < n and (state := a.step(state, codes[q])) >= 0:
                        q += 1
                        if a.ends[state] and follows[q]:
                            own += [(q, o) for o in outs]
                hits[p] = own
            return hits[p]

        arcs: list[dict[int, set[tuple[str, int, int]]]] = [{} for _ in range(n + 2)]
        arcs[0][0] = set()
        for p in range(n + 1):
            for s, own in arcs[p].items():
                fits = before is None or before.ended(read[p] if self.direction == "sim" else s)
                rewrites = found(p) if fits else []
                for q, o in rewrites:
                    own.add((o, q, on(s, o)))
                if not rewrites:  # copied, with what is inserted in front
                    for o in (insert if fits and follows[p] else ()) or ("",):
                        whole = o + codes[p : p + 1]
                        own.add((whole, p + 1, on(s, whole)))
                for _, q, t in own:
                    arcs[q].setdefault(t, set())
        done, todo = set(), [([], 0, 0)]
        while todo:
            out, p, s = todo.pop()
            while p <= n:
                first, *others = arcs[p][s]
                todo += [([*out, o], q, t) for o, q, t in others]
                out.append(first[0])
                p, s = first[1:]
            done.add("".join(out))
        return sorted(done)

    @cached_property
    def _back(self) -> Rule:
        return Rule([(mirrored(a), [o[::-1] for o in b]) for a, b in self.pairs], mirrored(self.right), mirrored(self.left), symbols=self.symbols)

    def native(self, codes: Column) -> Column | None:
        """The rewrite as built-in functions, or None where those could give other results.

        Exact if inputs are single symbols, each has one output, and the left context speaks of no symbol that the rule reads or writes.
        """
        read: frozenset = frozenset()
        for a, outs in self.pairs:
            if alphabet(a) != singles(a) or a.op not in ("set", "seq", "alt") or expression(a) == "" or len(outs) != 1 or read & singles(a):
                return None
            if a.op == "seq" and len(a.parts) != 1:
                return None
            read |= singles(a)
        written = frozenset("".join(outs[0] for _, outs in self.pairs))
        if self.direction == "rtl" or (self.direction == "ltr" and alphabet(self.left) & (read | written)):
            return None
        if self.direction == "ltr" and self.left != EMPTY and any(outs == [""] for _, outs in self.pairs):
            return None  # a deletion brings a left context next to what follows
        hold = {c: chr(HELD + k) for k, (a, _) in enumerate(self.pairs) for c in singles(a)}
        if len(self.pairs) == 1:
            hold = {}
        before = f"(?<={expression(self.left, hold)})" if self.left != EMPTY else ""
        after = f"(?={expression(self.right, hold)})" if self.right != EMPTY else ""
        for k, (a, outs) in enumerate(self.pairs):
            codes = F.regexp_replace(codes, before + expression(a) + after, chr(HELD + k) if hold else outs[0])
        for k, (_, outs) in enumerate(self.pairs):
            codes = F.replace(codes, F.lit(chr(HELD + k)), F.lit(outs[0])) if hold else codes
        return codes


def make_rule(patterns: Patterns, pairs: list[tuple[str | None, str | None]], left: str | None = None, right: str | None = None, direction: str = "ltr", name: str = "", tests: list | None = None) -> Rule:
    """A rule from pattern strings; a right context that is # alone is the end of the word."""
    after = literal(patterns.symbols.eow) if (right or "").strip() == "#" else patterns.parse(right)
    return Rule([(patterns.parse(a), strings(patterns.parse(b))) for a, b in pairs], patterns.parse(left), after, direction or "ltr", name, tests or [], "".join(sorted(patterns.symbols.symbol)))


def rewritten(rules: list[Rule], codes: Column) -> Column:
    """Array column of results of the rules in a row over a column of codes."""
    column: Column | None = codes
    for rule in rules:
        column = rule.native(column) if column is not None else None
    return F.array(column) if column is not None else rewritten_all(rules, F.array(codes))


def rewritten_all(rules: list[Rule], many: Column) -> Column:
    """The same over a column of arrays, by the general procedure; equal strings of a batch are rewritten once."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known: dict[str, list[str]] = {}

            def whole(start: str, known=known) -> list[str]:
                if start not in known:
                    now = {start}
                    for rule in rules:
                        now = set().union(*(rule.rewrite(x) for x in now)) if now else now
                    known[start] = sorted(now)
                return known[start]

            yield batch.map(lambda own: None if own is None else sorted({y for x in own if x is not None for y in whole(x)}))

    return run(many)
