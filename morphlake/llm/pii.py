"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans come from patterns with checks. High-recall generators propose further, overlapping spans of three kinds. Two
views of a candidate, its format and its context, have boosted trees of their own, each of which learns labels that come from
the other view alone; their scores are calibrated on documents held out, and spans over either threshold are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import written

#: The patterns of the base kinds, as possessive forms that need no backtracking over long runs,
#: and a text that every match holds, for a cheap first look.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = list(PATTERNS)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_OK = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"

#: What names a span of each kind in front of it, and formats that tell a kind by themselves.
NAMED = {
    "secret": r"(?i)(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$",
    "number": r"(?i)(?:phone|tel|mobile|cell|fax|call|whatsapp|card|iban|account|ssn|passport)(?:\s?(?:no|number|nr))?\.?\s{0,2}[:=#]?\s{0,2}[\"'(]?$",
    "contact": r"(?i)(?:e-?mail|mail|contact|write to|reach (?:me|us)(?: at)?)\s{0,2}[:=]?\s{0,2}[\"'(<]?$",
}
KNOWN = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xox[abp]-|AIza|glpat-|eyJ)|^[0-9a-fA-F]{32,}$"
#: The generators of each kind: runs of key characters with a digit, and whatever follows a sign of assignment; digits in groups;
#: addresses with their signs spelt out, spaced or missing. A local part has 64 characters at most, a label 63, as the standards for mail and names have it.
GENERATORS = {
    "secret": [
        r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,}+",
        r"(?<=[=:][\x20\"']{0,3})(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{6,}+",
    ],
    "number": [r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+(?![A-Za-z0-9])"],
    "contact": [r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s)[A-Za-z0-9-]{1,63}+(?:(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)[A-Za-z0-9-]{2,63}+)++"],
}
KINDS = list(GENERATORS)
#: Characters of context on either side.
CONTEXT = 32
#: Members of an array that are gone through at a time.
BLOCK = 256

Place = "struct<start:int,end:int>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is named."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def scan(xs: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step(state, x) -> (next state, y) gives for each member of xs in order, without nulls; y is of type `kind`.

    Arrays grow by copying; so blocks of results are built first and then joined, which keeps long arrays cheap.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, y = step(acc["state"], x)
        return let(y, lambda y: F.struct(after.alias("state"), F.when(y.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], y)).alias("out")))

    def many(acc: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["out"], o["out"]).alias("out")))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

    return let(xs, lambda v: F.when(F.size(v) > 0, F.aggregate(blocks(v), F.struct(state.alias("state"), none.alias("out")), many, lambda acc: acc["out"])).otherwise(none))


def matches(text: Column, pattern: str, around: int = 0) -> Column:
    """Leftmost non-overlapping matches with code-point positions: what lies between them gives the starts.

    around: how many characters in front of each match, b, and behind it, e, come with it. They are put together from
    the pieces next to it, so that no match looks into the whole text.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    hit = lambda x: F.coalesce(x["hit"], F.lit(""))
    kind = "struct<start:int,end:int,s:string" + (",b:string,e:string>" if around else ">")
    if around:
        behind = lambda then, x: (F.substring(F.concat(F.substring(x["gap"], 1, around), F.substring(hit(x), 1, around), then), 1, around), F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), then.alias("then")))
        zipped = F.reverse(scan(F.reverse(zipped), F.lit(""), "struct<gap:string,hit:string,then:string>", behind))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(hit(x))
        place = [start.alias("start"), end.alias("end"), x["hit"].alias("s")]
        if not around:
            return F.struct(end.alias("at")), F.when(x["hit"].isNotNull(), F.struct(*place))
        before = F.right(F.concat(state["last"], F.right(x["gap"], F.lit(around))), F.lit(around))
        after = F.struct(end.alias("at"), F.right(F.concat(before, F.right(hit(x), F.lit(around))), F.lit(around)).alias("last"))
        return after, F.when(x["hit"].isNotNull(), F.struct(*place, before.alias("b"), x["then"].alias("e")))

    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("last")) if around else F.struct(F.lit(0).alias("at"))
    return F.when(F.regexp_like(text, F.lit(pattern)), scan(zipped, state, kind, step)).otherwise(F.array().cast(f"array<{kind}>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Luhn's check over 16 to 19 digits."""
    total = F.lit(0)
    back = F.reverse(_digits(s))
    for i in range(19):
        d = F.coalesce(F.substring(back, i + 1, 1).try_cast("int"), F.lit(0))
        total = total + (d if i % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def _fits(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(s, F.lit(IP_OK))
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(16, 19) & _luhn(s)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _checker(kind: str):
    return lambda x: _fits(kind, x["s"])


#: Bits of a candidate span's own text.
FORMAT = {
    "secret": [
        lambda s: F.regexp_like(s, F.lit("[a-z]")) & F.regexp_like(s, F.lit("[0-9]")),
        lambda s: F.regexp_like(s, F.lit("[A-Z]")) & F.regexp_like(s, F.lit("[0-9]")),
        lambda s: F.regexp_like(s, F.lit("[A-Z]")) & F.regexp_like(s, F.lit("[a-z]")),
        lambda s: F.length(s) >= 16,
        lambda s: F.length(s) >= 20,
        lambda s: F.length(s) >= 32,
        lambda s: 10 * F.length(_digits(s)) >= 3 * F.length(s),
        lambda s: F.regexp_like(s, F.lit("^[0-9a-fA-F]+$")),
        lambda s: F.regexp_like(s, F.lit("^[0-9.+-]+$")),
        lambda s: F.regexp_like(s, F.lit("[0-9][A-Za-z]+[0-9]")),
        lambda s: F.regexp_like(s, F.lit("[+/=_.-]")),
    ],
    "number": [
        *(lambda s, n=n: F.length(_digits(s)) >= n for n in (9, 10, 12, 13, 16, 20)),
        lambda s: F.regexp_like(s, F.lit("[ ]")),
        lambda s: F.regexp_like(s, F.lit("-")),
        lambda s: F.regexp_like(s, F.lit("[.]")),
        lambda s: F.regexp_like(s, F.lit("/")),
        lambda s: F.regexp_like(s, F.lit("[(]")),
        lambda s: F.regexp_like(s, F.lit(r"^(?:19|20)[0-9]{2}\D")),
    ],
    "contact": [
        lambda s: F.regexp_like(s, F.lit("@")),
        lambda s: F.regexp_like(s, F.lit(r"\s@|@\s")),
        lambda s: F.regexp_like(s, F.lit(r"(?i)[(\[{<]\s?at")),
        lambda s: F.regexp_like(s, F.lit(r"(?i)dot")),
        lambda s: F.regexp_like(s, F.lit(r"^[^@\s]*[._0-9]")),
        lambda s: F.regexp_like(s, F.lit(r"(?i)[.t)\]}> ](?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$")),
    ],
}


def _around(kind: str) -> list:
    """Bits of what stands in front of a candidate, b, and behind it, e."""
    return [
        lambda b, e: F.regexp_like(b, F.lit(NAMED[kind])),
        lambda b, e: F.regexp_like(b, F.lit("[:=][ \"']{0,3}$")),
        lambda b, e: F.regexp_like(b, F.lit("[\"'(<]$")),
        lambda b, e: F.regexp_like(b, F.lit(r"[A-Za-z]\s?:\s?$")),
        lambda b, e: F.regexp_like(b, F.lit(r"(?:^|\n)\s*$")),
        lambda b, e: F.regexp_like(e, F.lit("^[\"')>]")),
        lambda b, e: F.regexp_like(e, F.lit(r"^\s*(?:\n|$)")),
        lambda b, e: F.regexp_like(b, F.lit(r"[0-9]\W{0,2}$")) | F.regexp_like(e, F.lit(r"^\W{0,2}[0-9]")),
    ]


def _formal(kind: str, s: Column) -> Column:
    """Whether a candidate's own text proves it, whatever stands around it."""
    if kind == "secret":
        return F.regexp_like(s, F.lit(KNOWN))
    if kind == "number":
        return _fits("card", s) | (F.startswith(s, F.lit("+")) & _fits("phone", s))
    return F.regexp_like(s, F.lit(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))


def _failed(kind: str, s: Column) -> Column:
    """Whether a candidate has the format of a base kind and fails its check: nothing of its kind, whatever stands around it."""
    if kind != "number":
        return F.lit(False)
    card = F.regexp_like(s, F.lit(r"^[0-9](?:[\x20-]?[0-9])++$")) & F.length(_digits(s)).between(16, 19) & ~_luhn(s)
    address = F.regexp_like(s, F.lit(r"^[0-9]++(?:\.[0-9]++){3}$")) & ~_fits("ip", s)
    return card | address | (F.startswith(s, F.lit("+")) & ~_fits("phone", s))


def _candidates(text: Column, kind: str, pattern: str) -> Column:
    """start, end, format bits f, context bits c, whether the context names the kind, whether the format proves it, whether a check fails it."""

    def code(bits: list[Column]) -> Column:
        return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))

    def judged(x: Column) -> Column:
        before, after = x["b"], x["e"]
        named = F.regexp_like(before, F.lit(NAMED[kind])) & F.regexp_like(x["s"], F.lit("[0-9@]|(?i)dot"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), code([f(x["s"]) for f in FORMAT[kind]]).alias("f"), code([f(before, after) for f in _around(kind)]).alias("c"), named.alias("named"), _formal(kind, x["s"]).alias("formal"), _failed(kind, x["s"]).alias("failed"))

    return F.transform(matches(text, pattern, CONTEXT), judged)


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held (whether the document is for calibration), checked base spans by kind, candidate spans by kind; no text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    need = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    plain = lambda found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = [F.when(need[k], plain(F.filter(matches(text, PATTERNS[k]), _checker(k)))).otherwise(F.array().cast(f"array<{Place}>")).alias(k) for k in BASE]
    more = [F.concat(*(_candidates(text, k, p) for p in GENERATORS[k])).alias(f"c_{k}") for k in KINDS]
    return rows.select("doc_id", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held"), *base, *more)


def boost(cells: list[tuple[int, float, float]], bits: int, rounds: int = 12, rate: float = 0.4) -> list:
    """Trees from (bits, labelled, others) rows, of which there are at most 2 ** bits; none without a label.

    Each tree splits on two bits; leaves are Newton steps on the logistic loss.
    """
    if not sum(p for _, p, _ in cells):
        return []
    score = dict.fromkeys((b for b, _, _ in cells), 0.0)
    trees = []
    for _ in range(rounds):
        best = None
        steps = [(b, pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)) for b, pos, neg in cells for p in [1 / (1 + math.exp(-score[b]))]]
        for j in range(bits):
            for k in range(j + 1, bits):
                sums = [[0.0, 0.0] for _ in range(4)]
                for b, g, h in steps:
                    leaf = sums[(b >> j & 1) * 2 + (b >> k & 1)]
                    leaf[0] += g
                    leaf[1] += h
                gain = sum(g * g / (h + 1) for g, h in sums)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, j, k, [rate * max(-4.0, min(4.0, g / (h + 1))) for g, h in sums]
        _, j, k, leaves = best
        trees.append((j, k, leaves))
        for b in score:
            score[b] += leaves[(b >> j & 1) * 2 + (b >> k & 1)]
    return trees


def calibrated(cells: list[tuple[float, float, float]], precision: float = 0.9) -> float:
    """The lowest score over which an estimated share `precision` of the candidates are of the kind, from (score, labelled, all) rows; infinite if there is none.

    Labels are sure, but not all have one: what the label needs may be missing where the other view is right. In the score with the
    greatest share of labels all candidates are taken to be of the kind, so this share is how often such ones have a label (a half at least,
    so that a rare label proves nothing); other counts of labels are divided by it. A score of no more than 0 speaks against a candidate, so no
    threshold is that low.
    """
    rates = [pos / n for _, pos, n in cells if n >= 5] or [pos / n for _, pos, n in cells]
    found = max([0.5, *rates])
    threshold, likely, every = math.inf, 0.0, 0.0
    for s, pos, n in sorted(cells, reverse=True):
        likely, every = likely + min(n, pos / found), every + n
        if s > 0 and likely and likely >= precision * every:
            threshold = s
    return threshold


def _value(trees: list, code: Column) -> Column:
    bit = lambda j: F.shiftright(code, j).bitwiseAND(F.lit(1))
    return sum((F.element_at(F.array(*map(F.lit, leaves)), (bit(j) * 2 + bit(k) + 1).cast("int")) for j, k, leaves in trees), F.lit(0.0))


def _tagged(kind: str | None, *fields: str):
    return lambda x: F.struct(*(x[f].alias(f) for f in fields), F.lit(kind).cast("string").alias("kind"))


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _written_out(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["start"], x["end"])


Model = dict[str, list[tuple[list, float]]]
#: The views: column of bits, label to learn, which comes from the other view.
VIEWS = [("f", "named"), ("c", "formal")]


def fit(found: DataFrame, precision: float = 0.9) -> Model:
    """kind -> (trees, threshold) of each view.

    Format trees learn which candidates the context names; context trees learn which ones the format proves; neither sees what its
    labels come from. Trees learn from three quarters of the documents, by a hash of their text; thresholds are
    set on the last quarter (on all, if that has no candidate). Candidates that fail the check of a format that they have count as others, and are never chosen. The driver sees counts by bit pattern, at most 2 ** 12 a view.
    """
    each = F.explode(F.concat(*(F.transform(f"c_{k}", _tagged(k, "f", "c", "named", "formal", "failed")) for k in KINDS))).alias("x")
    counts = written(found.select("held", each).select("held", "x.*").groupBy("held", "kind", "f", "c", "named", "formal", "failed").agg(F.count("*").alias("n")), "candidates")
    out: Model = {k: [] for k in KINDS}
    for view, label in VIEWS:
        own = counts.groupBy("kind", "held", F.col(view).alias("bits")).agg(F.sum(F.when(F.col(label) & ~F.col("failed"), F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("n"))
        rows = sorted((r["kind"], r["held"], r["bits"], float(r["pos"]), float(r["n"])) for r in own.collect())
        for k in KINDS:
            trees = boost([(b, pos, n - pos) for kind, held, b, pos, n in rows if kind == k and not held], len(FORMAT[k]) if view == "f" else len(_around(k)))
            bins: dict[float, list[float]] = {}
            some = any(kind == k and held for kind, held, *_ in rows)
            for kind, held, b, pos, n in rows:
                if kind == k and held >= some:
                    cell = bins.setdefault(round(sum(leaves[(b >> i & 1) * 2 + (b >> j & 1)] for i, j, leaves in trees), 2), [0.0, 0.0])
                    cell[0], cell[1] = cell[0] + pos, cell[1] + n
            out[k].append((trees, calibrated([(s, *x) for s, x in bins.items()], precision) - 0.005 if trees else math.inf))
    return out


def _chosen(kind: str, model: Model) -> Column:
    """The candidates that either view puts over its threshold."""
    views = [(view, *own) for (view, _), own in zip(VIEWS, model[kind], strict=True) if own[1] < math.inf]
    if not views:
        return F.array().cast("array<struct<start:int,end:int,kind:string>>")
    fits = F.filter(F.col(f"c_{kind}"), lambda x: ~x["failed"] & (F.greatest(*(_value(trees, x[view]) - threshold for view, trees, threshold in views), F.lit(-1.0)) >= 0))
    return F.transform(fits, _tagged(kind, "start", "end"))


def free(base: Column, more: Column) -> Column:
    """The spans of more that touch none of base nor one taken before, the earlier and then the longer first."""
    kind = "struct<start:int,end:int,kind:string>"
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    every = F.array_sort(F.concat(F.transform(base, _tagged(None, "start", "end")), more), order)
    fixed = lambda x: x["kind"].isNull()
    # backwards: what reaches into the next base span goes; then forwards: what starts within a base span, or one that is taken
    back = scan(F.reverse(every), F.lit(2147483647), kind, lambda at, x: (F.when(fixed(x), F.least(at, x["start"])).otherwise(at), F.when(fixed(x) | (x["end"] <= at), x)))
    clear = scan(F.reverse(back), F.lit(0), kind, lambda at, x: (F.when(fixed(x), F.greatest(at, x["end"])).otherwise(at), F.when(~fixed(x) & (x["start"] >= at), x)))
    return scan(clear, F.lit(0), kind, lambda at, x: (F.when(x["start"] >= at, x["end"]).otherwise(at), F.when(x["start"] >= at, x)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_number, n_contact, n_spans: one row for each row of docs.

    Candidates that touch a base span, or one another, count once, base spans first, then the earlier and the longer.

    Null text counts as empty and gives no spans; ids may be null or repeat, each row has its own
    result; very long texts are scanned whole; an empty table gives an empty result. Other columns are ignored.
    """
    found = written(propose(docs, id_col, text_col), "pii")
    model = fit(found)
    base = F.concat(*map(F.col, BASE))
    more = F.concat(*(_chosen(k, model) for k in KINDS))
    added = F.when(F.size(more) > 0, free(base, more)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    rows = found.withColumn("added", added)
    base_spans = F.concat(*(F.transform(F.transform(k, _tagged(k, "start", "end")), _written_out) for k in BASE))
    more_spans = F.concat(*(F.transform(F.filter("added", _of(k)), _written_out) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base_spans, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base_spans, more_spans), ",").alias("spans"),
        *(F.size(F.filter("added", _of(k))).cast("bigint").alias(f"n_{k}") for k in KINDS),
        (F.size(base) + F.size("added")).cast("bigint").alias("n_spans"),
    )
