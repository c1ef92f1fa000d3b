import collections
import random
import zlib

import numpy as np
import public_tokenizers
from helpers import docs, empty, odd
from tokenizers import Tokenizer

from morphlake.llm import packing
from morphlake.llm.packing import Packer, encoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_gives_the_tokenizers_ids():
    own, t = encoder(PATH, most=50), Tokenizer.from_file(PATH)
    texts = ["Hello, World's 123 abc", "a<|endoftext|>b c", "", None, "été ́x   y \x1c z", "I'll we've ... $$$", "Σας ΟΔΟΣ", " no break", "<|startoftext|>"]
    for got, text in zip(own(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids, text
    for got, text in zip(own(texts[:3]), texts[:3], strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_adversarial_words_with_a_warm_cache():
    rng, own, t = random.Random(9), encoder(PATH, most=2000), Tokenizer.from_file(PATH)
    letters = "aZéİIıßẞſΣςσǅŉΐﬁÅK가각ᄀ一あनभा.,'’s!?-–0٣²①\U0001f642\u0301\u0307\u0345\u200d\xad\xa0\u2028_<|>TEKLFİ"
    for _ in range(600):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) + rng.choice(["", ".", ",", "!"]) for _ in range(12)]
        words += [w.rstrip(".,") for w in words] + ["TEKLİFİ", "TEKLİFİ.", "İ,"]
        texts = [" ".join(rng.sample(words, 12)), "".join(rng.sample(words, 3)), words[0], f"{words[0]}."]
        for got, text in zip(own(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_ids_of_every_letter_with_a_sign_behind():
    import sys
    import unicodedata

    own, t = encoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"{c}{sign} a{c}{sign}" for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and not "\u4e00" < c < "\u9fff" and not "\uac00" < c < "\ud7a0" and ord(c) < 0x17000 for sign in ".,"]
    texts += ["\u092a\u095d.", "\ufb1d,", "\u0f43\u09dc."]
    want = t.encode_batch_fast(texts, add_special_tokens=False)
    assert [x for x, got, e in zip(texts, own(texts), want, strict=True) if np.frombuffer(got, "<u4").tolist() != e.ids] == []


def test_a_worker_encodes_a_word_once_and_keeps_the_last_ones(monkeypatch):
    """Tasks that run in one worker share what it has learnt; signs behind a word make no new word; at most `most` strings are held."""
    learnt, held, learn = [], [], packing._Words.learn

    def noted(self, words):
        learnt.extend(words)
        held.append(self)
        return learn(self, words)

    monkeypatch.setattr(packing._Words, "learn", noted)
    texts = ["qnorth qsea, qnorth. qsea$$$ (qnorth", "qsea... Qété, qété! QÉTÉ$$$"]
    first = encoder(PATH)(texts)
    assert sorted(w for w in learnt if "q" in w) == ["(qnorth", "qnorth", "qsea", "qété"]
    seen = len(learnt)
    assert encoder(PATH)(texts) == first and len(learnt) == seen
    own = encoder(PATH, most=200)
    for k in range(40):
        own(["often " + " ".join(f"w{'abcdefghij'[k % 10]}{'klmno'[k // 10]}{x}" for x in "abcdefghijklmnopqrstuvwxyz")])
        assert len(held[-1].names) <= 200
    assert learnt.count("often") == 1


def test_ids_where_words_are_cut_at_signs():
    rng, own, t = random.Random(4), encoder(PATH, most=3000), Tokenizer.from_file(PATH)
    parts = ["a", "Z", "word", "é", "É", "ß", "ª", "×", "÷", "«", "»", "µ", "½", "7", ".", ",", "'", "'s", "'ll", "''", "$$$", "<", "|", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "endoftext", "\xa0", "\x85", "\x1c", "\u0301", "\u0338", "\u0416", " ", "\n"]
    for _ in range(400):
        texts = ["".join(rng.choices(parts[: rng.choice([31, 36])] + [" "] * 3, k=rng.randint(0, 14))) for _ in range(12)]
        for got, text in zip(own(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def whole(pieces, want, gaps=False):
    """Pieces cover each document once, and each sequence without gaps (but where other documents' pieces are left out)."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    for doc, ids in want.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.asarray(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] >= at if gaps else p["offset"] == at
            at = p["offset"] + p["length"]
        assert at <= 4096
    return by_seq


def test_round_trip_and_padding(spark):
    rng, t = random.Random(2), Tokenizer.from_file(PATH)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "delta42", "ü"]) for _ in range(rng.choice([0, 3, 40, 900, 9000]))) for _ in range(80)] + [None]
    rows = pack(docs(spark, texts), PATH, segments=64).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    seqs = whole(rows, want)
    sizes = [sum(p["length"] for p in s) for s in seqs.values()]
    assert max(len(s) for s in seqs.values()) <= 64
    assert sum(4096 - n for n in sizes if n & (n - 1)) == 0


def test_limits_hold_together():
    rng, p = random.Random(3), Packer(0, size=100, segments=4, loss=50, pool=20)
    for doc in range(300):
        n = rng.choice([1, 5, 30, 80, 250])
        p.add(doc, np.arange(n, dtype="<u4").tobytes(), rng.choice([0, n // 2, n]))
    p.finish()
    seqs = collections.defaultdict(lambda: [0, 0, 0])
    tokens = collections.Counter()
    for doc, _, n, _, _, seq, _, loss in p.take():
        for k, v in enumerate((n, 1, loss)):
            seqs[seq][k] += v
        tokens[doc] += n
    assert all(a <= 100 and b <= 4 and c <= 50 for a, b, c in seqs.values())
    assert len(tokens) == 300


def test_conversations_fill_each_limit(spark):
    """Instruction data: what precedes the last answer bears no loss; each of the three limits stops some sequences."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks, t = collections.defaultdict(list), Tokenizer.from_file(PATH)
    for r in turns:
        talks[r["conv_id"]].append(r["text"] or "")
    count = lambda texts: len(t.encode(" ".join(texts), add_special_tokens=False).ids)
    rows = [(c, " ".join(own), count(own[:-1])) for c, own in talks.items()] + [(1000 + i, "hi there", 1) for i in range(400)] + [(2000 + i, "all of it counts " * 40, 0) for i in range(20)]
    size, segments, loss = 1024, 24, 500
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, prompt long").coalesce(1)
    pieces = pack(docs_, PATH, size=size, segments=segments, loss=loss, loss_from="prompt").collect()
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 2] for d, x, _ in rows}
    seqs = whole(pieces, ids)
    sums = [(sum(p["length"] for p in s), len(s), sum(p["loss_tokens"] for p in s)) for s in seqs.values()]
    first = {d: k for d, _, k in rows}
    assert all(p["loss_tokens"] == max(0, p["start"] + p["length"] - max(p["start"], first[p["doc_id"]])) for p in pieces)
    assert all(a <= size and b <= segments and c <= loss for a, b, c in sums)
    assert any(a == size for a, _, _ in sums) and any(b == segments for _, b, _ in sums) and any(c == loss for _, _, c in sums)
    full = [s for s in sums if s[0] & (s[0] - 1)]  # the others need no padding
    assert sum(size - a for a, b, c in full if b < segments and c < loss) == 0


def test_with_ids_and_odd_rows(spark):
    rows = pack(odd(spark).unionByName(docs(spark, ["other", "text of", "id"])), PATH, with_ids=True).collect()
    assert len(rows) == pack(odd(spark).unionByName(docs(spark, ["other", "text of", "id"])), PATH).count()
    assert all(zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["doc_id"] in (1, 2, 4)) == {(1, 1): 1, (2, 1): 1, (4, 1): 1, (1, 3): 2, (2, 2): 1}
    assert sum(r["doc_id"] is None for r in pack(odd(spark), PATH).collect()) >= 1
    assert pack(empty(spark), PATH).count() == 0
