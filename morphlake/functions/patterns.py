"""Patterns over symbols: syntax, and translation to regular expressions over codes that Spark's and Python's engines both take."""

from __future__ import annotations

import graphlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from morphlake.functions.symbols import BOW, EOW, Symbols, normalized


class PatternSyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """op: set (one symbol of codes), seq, alt, or one of ? * +."""

    op: str
    parts: tuple = ()
    codes: frozenset = frozenset()


EMPTY = Node("seq")


def literal(codes: str) -> Node:
    return Node("seq", tuple(Node("set", codes=frozenset(c)) for c in codes))


def nullable(node: Node) -> bool:
    if node.op == "set":
        return False
    if node.op == "alt":
        return any(map(nullable, node.parts))
    return node.op in "?*" or all(map(nullable, node.parts))


def singles(node: Node) -> frozenset:
    """Codes that are whole matches of node."""
    if node.op == "set":
        return node.codes
    if node.op == "seq":
        own = [singles(p) for k, p in enumerate(node.parts) if all(nullable(q) for j, q in enumerate(node.parts) if j != k)]
        return frozenset().union(*own)
    return frozenset().union(*map(singles, node.parts))


def alphabet(node: Node) -> frozenset:
    return node.codes.union(*map(alphabet, node.parts))


def expression(node: Node, also: dict[str, str] | None = None) -> str:
    """node as a regular expression. also: code -> further code to take wherever the first one fits."""
    if node.op == "set":
        codes = sorted(node.codes | {also[c] for c in node.codes if also and c in also})
        return codes[0] if len(codes) == 1 else "[" + "".join(codes) + "]" if codes else "(?!)"
    own = [expression(p, also) for p in node.parts]
    if node.op == "seq":
        return "".join(own)
    return "(?:" + "|".join(own) + ")" if node.op == "alt" else f"(?:{own[0]}){node.op}"


def mirrored(node: Node) -> Node:
    parts = tuple(map(mirrored, node.parts))
    return Node(node.op, parts[::-1] if node.op == "seq" else parts, node.codes)


def strings(node: Node, most: int = 1000) -> list[str]:
    """All strings of a finite pattern in order; an infinite one, or one of more than `most`, is an error."""

    def walk(n: Node) -> set[str]:
        if n.op == "set":
            return set(n.codes)
        if n.op in "*+" and alphabet(n):
            raise PatternSyntaxError("a value of this kind must denote finitely many strings")
        if n.op == "seq":
            out = {""}
            for p in n.parts:
                own = walk(p)
                out = {a + b for a in out for b in own}
                if len(out) > most:
                    raise PatternSyntaxError(f"a value denotes more than {most} strings")
            return out
        out = set().union(*map(walk, n.parts))
        return out | {""} if n.op in "?*" else out

    return sorted(walk(node))


class Patterns:
    """Pattern parser of a grammar: its symbols, classes (ref -> symbols) and named patterns (ref -> pattern string)."""

    def __init__(self, symbols: Symbols, classes: dict[str, Iterable[str]] | None = None, named: dict[str, str] | None = None):
        self.symbols = symbols
        self.refs: dict[str, Node] = {
            "<Phone>": Node("set", codes=symbols.of_kind("phone")),
            "<tag>": Node("set", codes=symbols.of_kind("tag", "feature")),
            "<Boundary>": Node("set", codes=symbols.of_kind("boundary")),
            "<Sigma>": Node("set", codes=symbols.sigma),
            "<Empty>": EMPTY,
        }
        for ref, members in (classes or {}).items():
            self.refs[ref] = Node("set", codes=frozenset(symbols.code[normalized(m)] for m in members))
        self.starts = {p[0] for p in symbols.phones}
        named = named or {}
        needs = {ref: {m for m in re.findall(r"<[^<>]+>", text or "") if m in named} for ref, text in named.items()}
        try:
            order = list(graphlib.TopologicalSorter(needs).static_order())
        except graphlib.CycleError as e:
            raise PatternSyntaxError(f"patterns refer to each other in a circle: {e.args[1]}") from e
        for ref in order:
            self.refs[ref] = self.parse(named[ref])

    def tokens(self, pattern: str) -> list[tuple[str, object]]:
        """(kind, value) pairs; kind is an operator itself, or node."""
        text, at, out = normalized(pattern), 0, []
        first, last = text.startswith("#"), len(text) > 1 and text.endswith("#")
        text = text[1:] if first else text
        text = text[:-1] if last else text
        if first:
            out.append(("node", literal(self.symbols.code[BOW])))
        while at < len(text):
            c = text[at]
            if c not in self.starts and c in "()|{}^?*+.":
                out.append(("node", self.refs["<Sigma>"]) if c == "." else (c, c))
                at += 1
                continue
            if c not in self.starts and c == "<":
                ref = max((r for r in self.refs if text.startswith(r, at)), key=len, default=None)
                if ref is None:
                    raise PatternSyntaxError(f"unknown reference at {text[at:]!r}")
                out.append(("node", self.refs[ref]))
                at += len(ref)
                continue
            found = self.symbols.longest(text, at)
            if found is None:
                raise PatternSyntaxError(f"unknown token at {text[at:]!r}")
            out.append(("node", literal(self.symbols.code[found])))
            at += len(found)
        if last:
            out.append(("node", literal(self.symbols.code[EOW])))
        return out

    def parse(self, pattern: str | None) -> Node:
        if not pattern or not pattern.strip():
            return EMPTY
        tokens = self.tokens(pattern)
        node, at = self._choice(tokens, 0)
        if at < len(tokens):
            raise PatternSyntaxError(f"{tokens[at][0]!r} doesn't fit in {pattern!r}")
        return node

    def _choice(self, tokens: list, at: int) -> tuple[Node, int]:
        node, at = self._row(tokens, at)
        parts = [node]
        while at < len(tokens) and tokens[at][0] == "|":
            node, at = self._row(tokens, at + 1)
            parts.append(node)
        return (parts[0] if len(parts) == 1 else Node("alt", tuple(parts))), at

    def _row(self, tokens: list, at: int) -> tuple[Node, int]:
        parts = []
        while at < len(tokens) and tokens[at][0] in ("node", "(", "{"):
            node, at = self._factor(tokens, at)
            if at < len(tokens) and tokens[at][0] in "?*+":
                node, at = Node(tokens[at][0], (node,)), at + 1
                if at < len(tokens) and tokens[at][0] in "?*+":
                    raise PatternSyntaxError("two operators in a row")
            parts.append(node)
        if not parts:
            raise PatternSyntaxError("an empty alternative" if at >= len(tokens) or tokens[at][0] in "|)" else f"{tokens[at][0]!r} out of place")
        return (parts[0] if len(parts) == 1 else Node("seq", tuple(parts))), at

    def _factor(self, tokens: list, at: int) -> tuple[Node, int]:
        kind, value = tokens[at]
        if kind == "node":
            return value, at + 1
        if kind == "(":
            node, at = self._choice(tokens, at + 1)
            if at >= len(tokens) or tokens[at][0] != ")":
                raise PatternSyntaxError("a group isn't closed")
            return node, at + 1
        at += 1
        negated = at < len(tokens) and tokens[at][0] == "^"
        at += negated
        parts = []
        while at < len(tokens) and tokens[at][0] in ("node", "(", "{"):
            node, at = self._factor(tokens, at)
            parts.append(node)
        if at >= len(tokens) or tokens[at][0] != "}" or not parts:
            raise PatternSyntaxError("braces hold symbols, references and groups only, and must be closed")
        node = Node("alt", tuple(parts))
        return (Node("set", codes=self.symbols.sigma - singles(node)) if negated else node), at + 1

    def regex(self, pattern: str | None) -> str:
        return expression(self.parse(pattern))

    def matches(self, codes: Column, pattern: str) -> Column:
        """Whether codes (without word edges) match as a whole, bare or between word edges."""
        return F.regexp_like(F.concat(F.lit(self.symbols.bow), codes, F.lit(self.symbols.eow)), F.lit(self.whole(pattern)))

    def whole(self, pattern: str) -> str:
        """Regular expression over codes between word edges: the pattern is the bare word, or with the edges that it names."""
        own, bow, eow = self.regex(pattern), self.symbols.bow, self.symbols.eow
        text = normalized(pattern or "")
        either = {f"{bow}(?:{own}){eow}", f"(?:{own})"}
        if text.startswith("#") != (len(text) > 1 and text.endswith("#")):
            either.add(f"(?:{own}){eow}" if text.startswith("#") else f"{bow}(?:{own})")
        return f"^(?:{'|'.join(sorted(either))})$"
