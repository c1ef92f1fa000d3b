"""Patterns as deterministic automata by derivatives: the states of a pattern are what is left to match of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.patterns import EMPTY, Node, nullable

NEVER = Node("set")


def _seq(parts: list[Node]) -> Node:
    flat: list[Node] = []
    for p in parts:
        if p == NEVER:
            return NEVER
        flat += p.parts if p.op == "seq" else [p]
    return flat[0] if len(flat) == 1 else Node("seq", tuple(flat))


def _alt(parts: list[Node]) -> Node:
    """A choice without what can't match, in one order, so that equal states are found equal; sets of symbols become one."""
    flat, codes = [], frozenset()
    for p in parts:
        for q in p.parts if p.op == "alt" else (p,):
            if q.op == "set":
                codes |= q.codes
            else:
                flat.append(q)
    if codes:
        flat.append(Node("set", codes=codes))
    own = sorted(set(flat), key=repr)
    return NEVER if not own else own[0] if len(own) == 1 else Node("alt", tuple(own))


def derivative(node: Node, code: str) -> Node:
    """What is left of node to match behind one symbol."""
    if node.op == "set":
        return EMPTY if code in node.codes else NEVER
    if node.op == "seq":
        out = []
        for k, p in enumerate(node.parts):
            out.append(_seq([derivative(p, code), *node.parts[k + 1 :]]))
            if not nullable(p):
                break
        return _alt(out)
    if node.op == "alt":
        return _alt([derivative(p, code) for p in node.parts])
    own = derivative(node.parts[0], code)
    return own if node.op == "?" else _seq([own, Node("*", node.parts)])


def _sets(node: Node) -> set[frozenset]:
    return {node.codes} if node.op == "set" else set().union(*map(_sets, node.parts)) if node.parts else set()


@dataclass
class Automaton:
    """A deterministic automaton from state 0: moves of each state by symbol, and which states are ends. A missing move matches nothing."""

    moves: list[dict[str, int]]
    ends: list[bool]

    @classmethod
    def of(cls, node: Node, most: int = 10000) -> Automaton:
        """The automaton of a pattern; one of more than `most` states is an error."""
        sets = _sets(node)
        groups: dict[frozenset, list[str]] = {}  # symbols that the pattern doesn't tell apart move alike
        for c in sorted(set().union(*sets)) if sets else ():
            groups.setdefault(frozenset(s for s in sets if c in s), []).append(c)
        states, moves, at = {node: 0}, [], 0
        todo = [node]
        while at < len(todo):
            own: dict[str, int] = {}
            for codes in groups.values():
                after = derivative(todo[at], codes[0])
                if after != NEVER:
                    if after not in states:
                        states[after] = len(todo)
                        todo.append(after)
                        if len(todo) > most:
                            raise ValueError(f"a pattern needs more than {most} states")
                    own |= dict.fromkeys(codes, states[after])
            moves.append(own)
            at += 1
        return cls(moves, [nullable(n) for n in todo])

    def step(self, state: int, codes: str) -> int:
        """The state behind codes; -1 once nothing can match."""
        for c in codes:
            if state < 0:
                return -1
            state = self.moves[state].get(c, -1)
        return state

    def ended(self, state: int) -> bool:
        return state >= 0 and self.ends[state]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(arcs, ends) with states as strings."""
        arcs = [(str(s), c, str(t)) for s, own in enumerate(self.moves) for c, t in sorted(own.items())]
        return spark.createDataFrame(arcs, "state string, label string, next string"), spark.createDataFrame([(str(s),) for s, e in enumerate(self.ends) if e], "state string")

    def accepts(self, codes: Column) -> Column:
        """Whether a string of symbols matches as a whole: one look into a table for each symbol."""
        alphabet = "".join(sorted({c for own in self.moves for c in own}))
        width, dead = len(alphabet) + 1, len(self.moves)
        flat = [dead if k == 0 else own.get(alphabet[k - 1], dead) for own in [*self.moves, {}] for k in range(width)]
        table = F.array(*map(F.lit, flat))
        step = lambda s, c: F.get(table, s * width + F.instr(F.lit(alphabet), c))
        last = F.aggregate(F.regexp_extract_all(codes, F.lit("(?s)."), F.lit(0)), F.lit(0), step)
        return F.get(F.array(*map(F.lit, [*self.ends, False])), last)
