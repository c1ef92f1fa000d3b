"""Secrets by a battery of randomness tests, in DataFrame operations only.

Base spans come from patterns with checks. Runs of key characters are further candidates: for each one an encoding is inferred, and
three tests over its symbols, for even use of the alphabet, for runs of its halves and for correlation of neighbours, say how far it is from
random. What ordinary text looks like under the same tests is learnt from all words of all documents run together; candidates
that hardly any of those would match, at a false-discovery rate kept for each length and encoding, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.common import written
from morphlake.llm.pii import free, let, matches

#: The patterns of the base kinds; matches that are too short are dropped.
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{16,}+",
}
BASE = list(PATTERNS)
RUN = r"[\w+/-]{16,}+"
#: Lengths that a class begins with; words run together for a class are shorter than where the next one begins.
CLASSES = [16, 24, 32, 48, 64, 96]
ENCODINGS = ["hex", "base32", "letters", "alnum", "base64"]
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Departures are counted in quarters up to this many.
BINS = 400
#: What a string with no spread at all departs by.
FAR = 1e9

Judged = "struct<start:int,end:int,cls:int,enc:string,t:double>"

#: What an alphabet consists of, in order: for each encoding, where letters of one case are told by their lower case and where not.
ALPHABETS = {
    "hex": (DIGITS + "abcdef",) * 2,
    "base32": (UPPER + "234567",) * 2,
    "letters": (LOWER, UPPER + LOWER),
    "alnum": (LOWER + DIGITS, UPPER + LOWER + DIGITS),
    "base64": (UPPER + LOWER + DIGITS + "+/",) * 2,
}
#: A symbol is a number: its place in the alphabet, and HALF more in the upper half; so a sum of products of BLOCK symbols holds those of places, of halves and of both.
HALF, BLOCK = 1 << 24, 4096


def _like(s: Column, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(pattern))


def encoding(s: Column) -> Column:
    """The narrowest of ENCODINGS that a run of key characters fits."""
    return (
        F.when(_like(s, "^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(_like(s, "^[A-Z2-7]*[2-7][A-Z2-7]*$"), "base32")
        .when(_like(s, "^[A-Za-z]+$"), "letters")
        .when(_like(s, "^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def _symbols(alphabet: str) -> Column:
    """The size of an alphabet and the symbol of each ASCII character in it."""
    place = {c: k for k, c in enumerate(alphabet)}
    if "A" not in alphabet:  # the other case counts as this one
        place |= {c.upper(): k for c, k in place.items()}
    if "/" in alphabet:
        place |= {"-": place["+"], "_": place["/"]}
    symbol = [k + (HALF if 2 * k >= len(alphabet) else 0) for k in (place.get(chr(c), 0) for c in range(128))]
    return F.struct(F.lit(float(len(alphabet))).alias("a"), F.array(*(F.lit(v).cast("bigint") for v in symbol)).alias("of"))


def _alphabet(s: Column, enc: Column) -> Column:
    one = _like(s, "^(?:[^a-z]+|[^A-Z]+)$")
    out = None
    for name, (single, both) in ALPHABETS.items():
        own = _symbols(single) if single == both else F.when(one, _symbols(single)).otherwise(_symbols(both))
        out = F.when(enc == name, own) if out is None else out.when(enc == name, own)
    return out


def departure(s: Column, enc: Column) -> Column:
    """How far a string is from random symbols of its encoding: the squares of three test statistics added up.

    Chi-squared against even use of the alphabet (only excess counts), runs of symbols of the lower and upper half, circular serial
    correlation; each less its mean and over its deviation under randomness for the length. Letters of one case are told by their lower case.
    """
    whole = F.lit(0).cast("bigint")
    given = lambda x, then: F.aggregate(F.array(x), F.lit(0.0), lambda _, v: then(v))  # let, of a number: it works out no types for each string
    total = lambda xs, f: F.aggregate(xs, whole, lambda acc, x: acc + f(x)).cast("double")

    def coded(alphabet: Column) -> Column:
        x = F.when(alphabet["a"] >= 2 * len(LOWER), F.translate(s, "-_", "+/")).when(alphabet["a"] == len(UPPER + "234567"), s).otherwise(F.lower(s))
        return given(x, lambda x: given(F.split(x, "", -1), lambda signs: told(x, signs, alphabet)))

    def told(x: Column, signs: Column, alphabet: Column) -> Column:
        code = lambda c: F.get(alphabet["of"], F.ascii(c))
        times = F.transform(F.array_distinct(signs), lambda c: F.struct(code(c).alias("x"), (F.octet_length(x) - F.octet_length(F.replace(x, c, F.lit("")))).cast("bigint").alias("v")))
        return given(F.transform(signs, code), lambda codes: counted(codes, times, alphabet["a"]))

    def counted(codes: Column, times: Column, a: Column) -> Column:
        size = F.size(codes)
        ends = lambda at: F.least(at + BLOCK, size - 1) - 1
        block = lambda at: F.aggregate(F.sequence(at, ends(at)), whole, lambda acc, i: acc + F.get(codes, i) * F.get(codes, i + 1))
        pairs = F.when(size > 1, F.transform(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0)), F.lit(BLOCK)), block)).otherwise(F.array().cast("array<bigint>"))
        both = F.struct(size.cast("double").alias("n"), a.alias("a"), codes[0].alias("first"), F.element_at(codes, -1).alias("last"), pairs.alias("pairs"), times.alias("times"))
        return given(both, summed)

    def summed(x: Column) -> Column:
        place = lambda y: y["x"].bitwiseAND(HALF - 1)
        found = {
            "square": total(x["times"], lambda y: y["v"] * y["v"]),
            "high": total(x["times"], lambda y: F.when(y["x"] >= HALF, y["v"]).otherwise(whole)),
            "s": total(x["times"], lambda y: y["v"] * place(y)),
            "ss": total(x["times"], lambda y: y["v"] * place(y) * place(y)),
            "sp": total(x["pairs"], lambda p: p.bitwiseAND(HALF - 1)) + (place(F.struct(x["first"].alias("x"))) * place(F.struct(x["last"].alias("x")))).cast("double"),
            "both": total(x["pairs"], lambda p: F.shiftright(p, 48)),
            "ends": (F.when(x["first"] >= HALF, 1.0).otherwise(0.0) + F.when(x["last"] >= HALF, 1.0).otherwise(0.0)),
        }
        return given(F.struct(x["n"].alias("n"), x["a"].alias("a"), *(v.alias(k) for k, v in found.items())), combined)

    def combined(t: Column) -> Column:
        n, a, high = t["n"], t["a"], t["high"]
        uneven = t["square"] * a / n - n
        chi = F.greatest((uneven - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n), F.lit(0.0))
        changes = 2 * high - t["ends"] - 2 * t["both"]
        mean = 2 * high * (n - high) / n + 1
        runs = (changes + 1 - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        serial = ((n * t["sp"] - t["s"] * t["s"]) / (n * t["ss"] - t["s"] * t["s"]) + 1 / (n - 1)) * F.sqrt(n - 1)
        flat = (n <= 1) | (mean <= 2) | (n * t["ss"] <= t["s"] * t["s"])
        return F.when(flat, FAR).otherwise(chi * chi + runs * runs + serial * serial)

    return given(_alphabet(s, enc), coded)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(CLASSES[1:-1]):
        out = F.when(n >= low, k + 1).otherwise(out)
    return out


def _judged(found: Column) -> Column:
    named = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), encoding(x["s"]).alias("enc")))
    judged = F.transform(named, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), length_class(F.octet_length(x["s"])).alias("cls"), x["enc"].alias("enc"), departure(x["s"], x["enc"]).alias("t")))
    return judged.cast(f"array<{Judged}>")


def ordinary(text: Column) -> Column:
    """All words of a text run together and cut into strings, from its first character to its last: joined, with a sign between them or with capitals.

    The strings' lengths go through the length classes in turn, one in each that the text's hash names. Runs of 16 key characters are left out first,
    and so are strings without letters; what is left at the end is a string of its own if it is long enough for any class.
    """
    pick = F.xxhash64(text, F.lit(14))
    style = F.pmod(pick, F.lit(4))
    words = F.regexp_replace(text, RUN, " ")
    sign = lambda x, to: F.regexp_replace(x, r"\P{Alnum}++", to)
    joined = F.when(style == 0, F.lower(sign(words, ""))).when(style == 1, F.replace(F.initcap(sign(words, " ")), F.lit(" "), F.lit(""))).when(style == 2, sign(words, "_")).otherwise(sign(words, "-"))
    sizes = [low + F.shiftright(pick, 8 * (k + 1)).bitwiseAND(255) % (high - low) for k, (low, high) in enumerate(zip(CLASSES, CLASSES[1:], strict=False))]

    def cut(x: Column) -> Column:
        """Bytes are told by their place at once, characters by going through all before."""
        data, size = x["j"], x["size"]
        turn = F.aggregate(size, F.lit(0), lambda acc, n: acc + n)
        lead = F.transform(size, lambda _, k: F.aggregate(F.slice(size, 1, k), F.lit(0), lambda acc, n: acc + n))
        whole = lambda y: F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(data) - 1) / y["turn"]).cast("int")), lambda r: F.transform(size, lambda n, k: F.substring(data, r * y["turn"] + F.get(y["lead"], k) + 1, n).cast("string")))
        return F.when(F.octet_length(data) > 0, let(F.struct(turn.alias("turn"), lead.alias("lead")), lambda y: F.flatten(whole(y)))).otherwise(F.array().cast("array<string>"))

    strings = let(F.struct(joined.cast("binary").alias("j"), F.array(*(n.cast("int") for n in sizes)).alias("size")), cut)
    return F.filter(strings, lambda s: (F.octet_length(s) >= CLASSES[0]) & _like(s, "[A-Za-z]"))


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, checked base spans by kind, candidates and ordinary strings under the tests; no text."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fits = {
        "assign": lambda x: F.length(F.regexp_extract(x["s"], PATTERNS["assign"], 1)) >= 12,
        "access": lambda x: F.length(x["s"]) >= 18,
        "hex": lambda x: F.lit(True),
    }
    base = [F.transform(F.filter(matches(text, PATTERNS[k]), fits[k]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in BASE]
    found = F.filter(matches(text, RUN), lambda x: _like(x["s"], "[A-Za-z]"))
    plain = F.transform(ordinary(text), lambda s: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), s.alias("s")))
    return rows.select("doc_id", *base, _judged(found).alias("found"), _judged(plain).alias("plain"))


def _bin(t: Column) -> Column:
    return F.least(F.floor(t * 4), F.lit(BINS)).cast("int")


def thresholds(rows: DataFrame, rate: float) -> list[tuple[int, str, int]]:
    """(length class, encoding, greatest bin that is let through): step-up control of the share of false finds in each class and encoding.

    A bin's chance is that of ordinary strings of the length class to have the encoding and to depart no more, times the number of encodings. All are
    counts in tables of a fixed size: classes x encodings x bins.
    """
    each = rows.select(F.explode(F.concat(F.transform("found", lambda x: F.struct(x["cls"].alias("cls"), x["enc"].alias("enc"), _bin(x["t"]).alias("bin"), F.lit(1).alias("c"), F.lit(0).alias("r"))), F.transform("plain", lambda x: F.struct(x["cls"].alias("cls"), x["enc"].alias("enc"), _bin(x["t"]).alias("bin"), F.lit(0).alias("c"), F.lit(1).alias("r"))))).alias("x"))
    counts = each.groupBy("x.cls", "x.enc", "x.bin").agg(F.sum("x.c").alias("c"), F.sum("x.r").alias("r"))
    own = Window.partitionBy("cls", "enc")
    upto = own.orderBy("bin")
    every = F.sum("r").over(Window.partitionBy("cls"))
    chance = F.least(F.lit(1.0), len(ENCODINGS) * (1.0 + F.col("below")) / (1.0 + F.col("every")))
    graded = counts.select("cls", "enc", "bin", every.alias("every"), F.sum("r").over(upto).alias("below"), F.sum("c").over(upto).alias("taken"), F.sum("c").over(own).alias("m"))
    passed = graded.where((F.col("taken") > 0) & (chance * F.col("m") <= rate * F.col("taken")))
    return [(r["cls"], r["enc"], r["bin"]) for r in passed.groupBy("cls", "enc").agg(F.max("bin").alias("bin")).collect()]


def _tagged(kind: str | None):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).cast("string").alias("kind"))


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind as listed."""
    kinds = F.array(*map(F.lit, [*BASE, "random"]))
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, rate: float = 0.05, limit: float = 16.27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row for each row of docs.

    Spans of base kinds are whole matches, the name of an assigned value with it. Added ones, of kind random, touch no base span: they are
    within the false-discovery rate, and their departure is at most `limit` (random strings pass 16.27 once in a thousand).

    Null text counts as empty and gives no spans; ids may be null or repeat, each row has its own result; very long texts and runs are
    tested whole; an empty table gives an empty result, and one without ordinary words adds nothing. Other columns are ignored.
    """
    found = written(propose(docs, id_col, text_col), "secrets")
    passed = thresholds(found, rate)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    base = F.concat(*map(F.col, BASE))
    fits = lambda x: F.lit(False)
    if passed:
        most = F.create_map(*(F.lit(v) for c, e, b in passed for v in (f"{c}{e}", b)))
        fits = lambda x: (x["t"] <= limit) & (_bin(x["t"]) <= F.coalesce(F.try_element_at(most, F.concat(x["cls"].cast("string"), x["enc"])), F.lit(-1)))
    more = F.transform(F.filter("found", fits), _tagged("random"))
    rows = found.select("doc_id", *BASE, F.when(F.size(more) > 0, free(base, more)).otherwise(none).alias("added"))
    spans = F.concat(*(F.transform(k, _tagged(k)) for k in BASE))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(spans), 256).alias("base_sha256"),
        _listed(F.concat(spans, "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_random"),
    )
