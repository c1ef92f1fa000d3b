"""Symbols of a grammar and their encoding: one private-use code point for each, so that Spark's string functions work on symbols."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word edges, boundaries and edit marks that every grammar has.
BOW, EOW = "[BOW]", "[EOW]"
BOUNDARIES = ("-", "=", "_")
EDITS = ("[insert]", "[substitute]", "[delete]")
FIRST = 0xE000


class SymbolError(ValueError):
    """A string has a part that is no symbol."""


def normalized(text: str) -> str:
    """Trimmed, compatibility-decomposed text: symbols are compared in this form."""
    return unicodedata.normalize("NFKD", text.strip())


@dataclass
class Symbols:
    """Ordered symbols. kinds: phone, tag, feature, boundary, edit, edge."""

    phones: list[str]
    tags: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.phones = list(dict.fromkeys(map(normalized, self.phones)))
        self.tags = list(dict.fromkeys(map(normalized, self.tags)))
        self.kind: dict[str, str] = {}
        for kind, names in (("phone", self.phones), ("tag", self.tags), ("feature", self.features), ("boundary", BOUNDARIES), ("edit", EDITS), ("edge", (BOW, EOW))):
            for name in names:
                self.kind.setdefault(name, kind)
        self.code = {s: chr(FIRST + k if k < 6400 else 0xF0000 + k - 6400) for k, s in enumerate(self.kind)}
        self.symbol = {c: s for s, c in self.code.items()}
        self.bow, self.eow = self.code[BOW], self.code[EOW]
        self._by_start: dict[str, list[str]] = {}
        for s in self.kind:
            self._by_start.setdefault(s[0], []).append(s)
        for names in self._by_start.values():
            names.sort(key=len, reverse=True)

    def of_kind(self, *kinds: str) -> frozenset[str]:
        return frozenset(self.code[s] for s, k in self.kind.items() if k in kinds)

    @property
    def sigma(self) -> frozenset[str]:
        """What a single dot stands for: everything but edit marks."""
        return self.of_kind("phone", "tag", "feature", "boundary", "edge")

    def longest(self, text: str, at: int) -> str | None:
        return next((s for s in self._by_start.get(text[at : at + 1], ()) if text.startswith(s, at)), None)

    def encode(self, word: str) -> str:
        """Codes of a word's symbols, longest first; raises SymbolError at a part that is none."""
        text, at, out = normalized(word), 0, []
        while at < len(text):
            found = self.longest(text, at)
            if found is None:
                raise SymbolError(f"no symbol at {text[at:]!r} in {word!r}")
            out.append(self.code[found])
            at += len(found)
        return "".join(out)

    def decode(self, codes: str, tags: bool = False, edges: bool = False) -> str:
        drop = {"edit"} | ({"tag", "feature"} if not tags else set()) | ({"edge"} if not edges else set())
        return "".join(s for s in (self.symbol.get(c, c) for c in codes) if self.kind.get(s) not in drop)

    def try_encode(self, word: str | None) -> str | None:
        try:
            return None if word is None else self.encode(word)
        except SymbolError:
            return None

    def table(self, spark: SparkSession) -> DataFrame:
        """symbol, kind, id, code."""
        return spark.createDataFrame([(s, k, i, self.code[s]) for i, (s, k) in enumerate(self.kind.items())], "symbol string, kind string, id int, code string")


def encoded(symbols: Symbols, col: Column) -> Column:
    """Codes of each word of a column; null where a part is no symbol."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            known = {w: symbols.try_encode(w) for w in set(words)}
            yield words.map(known)

    return run(col)


def decoded(symbols: Symbols, col: Column, tags: bool = False) -> Column:
    """Words of a column of codes, by built-in functions; tags are dropped unless asked for, word edges always."""
    single, drop = [], [symbols.bow, symbols.eow]
    for s, kind in symbols.kind.items():
        code = symbols.code[s]
        if kind in ("tag", "feature") and not tags:
            drop.append(code)
        elif kind in ("edit", "edge"):
            drop.append(code)
        elif len(s) == 1:
            single.append((code, s))
        else:
            col = F.replace(col, F.lit(code), F.lit(s))
    return F.translate(col, "".join(c for c, _ in single) + "".join(dict.fromkeys(drop)), "".join(s for _, s in single))


def feature_key(features: dict[str, str] | Iterable[tuple[str, str]]) -> str:
    """Canonical name of a feature bundle: [f=v] in order."""
    pairs = features.items() if isinstance(features, dict) else features
    return "".join(f"[{f}={v}]" for f, v in sorted(pairs))


def feature_key_column(bundle: Column) -> Column:
    """The same over a map column, which can't be a key of joins and groups itself."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(bundle)), lambda e: F.concat(F.lit("["), e["key"], F.lit("="), e["value"], F.lit("]"))), "")
