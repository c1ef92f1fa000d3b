import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from helpers import docs, empty, odd
from pyspark.sql import functions as F

from morphlake.llm.secret_scan import CLASSES, ENCODINGS, departure, encoding, find_secrets, ordinary, propose, thresholds

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
OTHER = {"access": (re.compile("AKIA[A-Z0-9]+"), 18), "hex": (re.compile("[0-9a-f]+"), 16)}


def base(text):
    """Spans of each base kind by the contract's own patterns."""
    text = text or ""
    out = {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]}
    return out | {k: [m.span() for m in p.finditer(text) if len(m.group()) >= n] for k, (p, n) in OTHER.items()}


def listed(spans):
    order = ["assign", "access", "hex", "random"]
    every = sorted((a, order.index(k), b, k) for k, own in spans.items() for a, b in own)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in every)


def plain_encoding(s):
    for name, pattern in (("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]*[2-7][A-Z2-7]*"), ("letters", "[A-Za-z]+"), ("alnum", "[A-Za-z0-9]+")):
        if re.fullmatch(pattern, s):
            return name
    return "base64"


def plain_departure(s):
    enc, low, up, ten = plain_encoding(s), string.ascii_lowercase, string.ascii_uppercase, string.digits
    one = not (re.search("[a-z]", s) and re.search("[A-Z]", s))
    alphabet = {"hex": ten + "abcdef", "base32": up + "234567", "letters": low if one else up + low, "alnum": low + ten if one else up + low + ten, "base64": up + low + ten + "+/"}[enc]
    x = s.translate(str.maketrans("-_", "+/")) if "A" in alphabet else s.lower()
    n, a, codes = len(x), len(alphabet), [alphabet.index(c) for c in x]
    chi = max(0, (sum(v * v for v in Counter(x).values()) * a / n - n - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n))
    half = [2 * c >= a for c in codes]
    high = sum(half)
    mean = 2 * high * (n - high) / n + 1
    total, square = sum(codes), sum(c * c for c in codes)
    if mean <= 2 or n * square <= total * total:
        return 1e9
    runs = (1 + sum(p != q for p, q in zip(half, half[1:])) - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))
    around = sum(codes[i] * codes[(i + 1) % n] for i in range(n))
    serial = ((n * around - total**2) / (n * square - total**2) + 1 / (n - 1)) * math.sqrt(n - 1)
    return chi**2 + runs**2 + serial**2


def test_base_spans(spark):
    rng = random.Random(13)
    bits = ["password", "API_KEY", "apikey", "Token", "ſecret", "toKen", "passwd", '"', "'", " ", "  ", ":", "=", "abcdefghijkl", "x", "A+/_.=-9", "AKIA", "AKIA0123456789ABCD", "Z9", "deadbeef", "0123456789abcdef", "g", "\n", "é", "\U0001f600"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = {r["doc_id"]: r for r in find_secrets(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want, r = base(t), rows[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(want[k]) for k in ("assign", "access", "hex")], t
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in listed(want).split(",") if s]


def test_battery(spark):
    rng = random.Random(5)
    pools = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "ab", "a", "az09_-", string.ascii_lowercase + string.digits]
    strings = ["".join(rng.choice(p) for _ in range(rng.choice([16, 20, 40, 64, 300]))) for p in pools for _ in range(6)]
    for r in spark.createDataFrame([(s,) for s in strings], "s string").select("s", encoding(F.col("s")).alias("e"), departure(F.col("s"), encoding(F.col("s"))).alias("t")).collect():
        assert r["e"] == plain_encoding(r["s"])
        assert r["t"] == pytest.approx(plain_departure(r["s"]), rel=1e-9, abs=1e-9)


def corpus(rng, n):
    """Texts of words with identifiers of words run together, and keys of random symbols in every fifth: (texts, keys)."""
    syllables = ["ta", "ren", "mo", "sil", "kor", "an", "de", "vi", "lus", "pre"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    pools = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", string.ascii_uppercase + "234567"]
    texts, keys = [], []
    for i in range(n):
        own = [word() + rng.choice([""] * 9 + [str(rng.randint(1, 99))]) for _ in range(300)]
        for _ in range(i % 3):
            own.insert(rng.randint(0, 100), rng.choice(["".join, "_".join, "/".join])([rng.choice([str, str.title])(word()) for _ in range(6)]))
        if i % 5 == 0:
            p = rng.choice(pools)
            keys.append((i, "".join(rng.choice(p) for _ in range(rng.choice([40, 48, 64])))))
            own.insert(rng.randint(0, 100), keys[-1][1])
        texts.append(" ".join(own))
    return texts, keys


def test_random_keys_are_found_and_words_are_not(spark):
    texts, keys = corpus(random.Random(8), 600)
    rows = {r["doc_id"]: r["spans"] for r in find_secrets(docs(spark, texts)).collect()}
    added = {(i, texts[i][int(a) : int(b)]) for i, spans in rows.items() for kind, a, b in (s.split(":") for s in spans.split(",") if s) if kind == "random"}
    hit = added & set(keys)
    assert len(hit) >= 0.9 * len(keys)
    assert len(added - hit) <= 0.05 * len(added) + 1


def test_thresholds_keep_the_rate(spark):
    """The step-up rule over bins, in plain Python."""
    texts, _ = corpus(random.Random(9), 200)
    found = propose(docs(spark, texts)).cache()
    cells, every = {}, Counter()
    for r in found.select("found", "plain").collect():
        for side, own in ((0, r["found"]), (1, r["plain"])):
            for x in own:
                cells.setdefault((x["cls"], x["enc"]), []).append((min(math.floor(x["t"] * 4), 400), side))
                every[x["cls"]] += side
    want = set()
    for (c, e), own in cells.items():
        m, best = sum(s == 0 for _, s in own), None
        for b in sorted({b for b, _ in own}):
            chance = min(1, len(ENCODINGS) * (1 + sum(s for x, s in own if x <= b)) / (1 + every[c]))
            taken = sum(s == 0 for x, s in own if x <= b)
            if taken and chance * m <= 0.05 * taken:
                best = b
        if best is not None:
            want.add((c, e, best))
    assert set(thresholds(found, 0.05)) == want and want


def test_ordinary_strings_are_words_of_the_text(spark):
    text = "Some plain words, 3 of them here " * 40
    own = spark.createDataFrame([(text,), ("",), ("1 2 3 " * 500,)], "text string").select(ordinary(F.col("text")).alias("o")).collect()
    assert {sum(len(s) >= c for c in CLASSES) for s in own[0]["o"]} == {1, 2, 3, 4, 5} and len(own[0]["o"]) >= len(CLASSES) - 1
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    assert all(bare(s) in bare(text) for s in own[0]["o"]) and own[1]["o"] == own[2]["o"] == []


def test_odd_rows(spark):
    for table in (odd(spark), empty(spark), docs(spark, [None, "", "token = " + "a1" * 30000])):
        rows = find_secrets(table).collect()
        assert len(rows) == table.count()
        texts = {(r["doc_id"], r["text"]) for r in table.collect()}
        assert {(r["doc_id"], r["base_sha256"]) for r in rows} == {(i, hashlib.sha256(listed(base(t)).encode()).hexdigest()) for i, t in texts}


def test_ordinary_strings_hold_the_whole_text(spark):
    """Not a stretch of it: strings put together again are the words of a long text, but for an end that is too short for any class."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (3, 60, 4000, 4001, 4002, 4003)]
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", ordinary(F.col("text")).alias("o")).collect():
        own, whole = bare("".join(r["o"])), bare(r["text"])
        assert whole.startswith(own) and len(whole) - len(own) < CLASSES[0]


def test_no_python_on_executors(spark):
    """DataFrame operations only: no Python node in the plan."""
    plan = propose(docs(spark, ["some plain text, token=abcdefghijklmnop"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_long_strings_are_tested_exactly(spark):
    """Sums are taken over stretches of symbols; strings longer than one come out as in plain Python."""
    rng = random.Random(4)
    strings = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (4095, 4096, 4097, 4098, 8193, 20000)]
    for r in spark.createDataFrame([(s,) for s in strings], "s string").select("s", departure(F.col("s"), encoding(F.col("s"))).alias("t")).collect():
        assert r["t"] == pytest.approx(plain_departure(r["s"]), rel=1e-9, abs=1e-9)
