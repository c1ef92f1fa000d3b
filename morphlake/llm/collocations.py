"""Phrase collocations: frequent runs of words, mined by pivot partitions and scored by their weakest cut.

The words of a run are ordered by how frequent they are, and its rarest one is its pivot. A text is rewritten for each pivot that it
holds: what lies beyond a rarer word, a word that is too rare for any phrase or a pair of words that is, is cut off. The fragments that
are left go to their pivot's partition, which counts the runs that hold the pivot, and no others; so every run is counted in one
place, and fragments are short where a pivot is frequent.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.common import MIX_1, discard, mixed, written
from morphlake.llm.wordruns import bounded, byte_kinds, words_of

#: Blanks part words; punctuation and line ends part pieces.
KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
BLANKS = byte_kinds(b" ")
#: Bytes of text that a task works on at a time.
STRETCH = 4 << 20


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    coded = pc.dictionary_encode(pc.fill_null(batch.column(0), "und"))
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _counted(language: np.ndarray, names: list[str], strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(language, first place, count, string) of each distinct pair of language and string."""
    coded = pc.dictionary_encode(strings)
    size = max(1, len(coded.dictionary))
    key, first, n = np.unique(language * size + coded.indices.to_numpy(), return_index=True, return_counts=True)
    return key // size, first, n, coded.dictionary.take(pa.array(key % size))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of docs (lang, text): all words, added up in each task first."""

    def count(batches):
        for batch, rows, words, _, text, own in bounded(batches, 1, KINDS, STRETCH):
            code, names = _languages(batch)
            mine = np.flatnonzero(own)
            language, _, n, found = _counted(code[rows[text[mine]]], names, words.take(pa.array(mine)))
            bare = pc.utf8_slice_codeunits(found, 0, -1) if len(found) else found
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(language)), bare.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Ranks:
    """Order of words by frequency as a table of fixed size: the counts of frequent words in 2**bits buckets.

    A word's rank is its bucket's count and its checksum, 0 for a bucket without frequent words. Words that share a bucket seem more frequent
    than they are, which costs work and never a count: any one order of words gives each run one pivot.
    """

    def __init__(self, words: DataFrame, bits: int):
        self.mask = (1 << bits) - 1
        bucket = F.crc32(F.col("word").cast("binary")).bitwiseXOR(F.crc32(F.col("lang").cast("binary"))).bitwiseAND(F.lit(self.mask))
        found = words.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
        table = np.zeros(1 << bits, np.float32)
        table[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        self.table = words.sparkSession.sparkContext.broadcast(table)

    def of(self, language: np.ndarray, names: list[str], words: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(words)
        own = np.array([zlib.crc32(w[:-1].encode()) for w in coded.dictionary.to_pylist()], np.int64)
        check = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)
        salt = np.array([zlib.crc32(n.encode()) for n in names], np.int64)
        count = self.table.value[(check ^ salt[language]) & self.mask]
        return np.where(count > 0, (count.view(np.uint32).astype(np.uint64) << np.uint64(32)) | check.astype(np.uint64), np.uint64(0))


def _neighbours(rank: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Whether each word and the next are of one piece and both frequent."""
    return (piece[:-1] == piece[1:]) & (rank[:-1] > 0) & (rank[1:] > 0)


def _pair(rank: np.ndarray) -> np.ndarray:
    """A number for each word and the next."""
    return mixed(rank[:-1] * MIX_1 + rank[1:])


def pair_counts(docs: DataFrame, ranks: Ranks, least: int) -> np.ndarray:
    """Counts of pairs of neighbouring frequent words in a table of fixed size, 0 for buckets below `least`: no pair of those can be frequent."""
    mask = ranks.mask

    def count(batches):
        total = np.zeros(mask + 1, np.uint32)
        for batch, rows, words, piece, text, own in bounded(batches, 1, KINDS, STRETCH, 0, 1):
            if len(words) > 1:
                code, names = _languages(batch)
                rank = ranks.of(code[rows[text]], names, words)
                near = _neighbours(rank, piece) & own[:-1]
                bucket, n = np.unique((_pair(rank)[near] & np.uint64(mask)).astype(np.int64), return_counts=True)
                total[bucket] += n.astype(np.uint32)
        held = np.flatnonzero(total)
        for at in range(0, len(held), 1 << 20):
            own = held[at : at + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    found = docs.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # 2**bits rows at most
    table = np.zeros(mask + 1, np.float32)
    table[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return table


def fragments(docs: DataFrame, ranks: Ranks, pairs: np.ndarray, least: int, longest: int, hot: int, slots: int) -> DataFrame:
    """lang, slot, whole, side, at, fragment, n: what is left of texts around each pivot, whose place in it is `at`.

    Pivots are dealt to slots by a hash. A row holds all different fragments that a stretch of text has for a slot, with how often each is there.

    Words in front of the pivot are more frequent than it is, those behind it at least as frequent: of a run with its rarest word twice,
    the first one is the pivot. A pivot with more than `hot` occurrences is dealt to parts by the pair that it forms with the word
    behind it (side 1, for runs that go on there) or, for runs that end with it, in front of it (side 2), so that each run is still counted
    in one place. Only the fragments of a pair of over 8 * hot occurrences are dealt out by their own checksum; they aren't whole in a slot.
    """
    spread = docs.sparkSession.sparkContext.broadcast(pairs)
    reach = longest - 1

    def emit(batches):
        for batch, rows, words, piece, text, own in bounded(batches, 1, KINDS, STRETCH, reach, reach):
            n = len(words)
            if n < 2:
                continue
            code, names = _languages(batch)
            language = code[rows[text]]
            rank = ranks.of(language, names, words)
            pair = _pair(rank)
            seen = spread.value[(pair & np.uint64(ranks.mask)).astype(np.int64)]
            link = _neighbours(rank, piece) & (seen >= least)
            left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
            back, ahead = np.ones(n, bool), np.ones(n, bool)
            for d in range(1, min(reach, n - 1) + 1):
                back[:d] = False
                back[d:] &= link[: n - d] & (rank[: n - d] > rank[d:])
                left += back
                ahead[n - d :] = False
                ahead[: n - d] &= link[d - 1 :] & (rank[d:] >= rank[: n - d])
                right += ahead
            often = (rank >> np.uint64(32)).astype(np.uint32).view(np.float32)
            dealt = often > hot
            for side, at in enumerate([np.flatnonzero(own & ~dealt & (left + right > 0)), np.flatnonzero(own & dealt & (right > 0)), np.flatnonzero(own & dealt & (left > 0))]):
                if not len(at):
                    continue
                strings = _slices(words, at - left[at], at + 1 + (right[at] if side < 2 else 0))
                where, first, count, found = _counted(language[at], names, strings)
                at = at[first]
                part, salts, salt = np.zeros(len(at), np.int64), np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
                if side:
                    near = at - (side == 2)
                    part = ((pair[near] >> np.uint64(32)).astype(np.int64)) % (1 + often[at] // hot).astype(np.int64)
                    salts += (seen[near] // (8 * hot)).astype(np.int64)
                    many = np.flatnonzero(salts > 1)
                    salt[many] = [zlib.crc32(f.encode()) for f in found.take(pa.array(many)).to_pylist()]
                    salt %= salts
                slot = (mixed(rank[at] + mixed((part << 20 | salt).astype(np.uint64))) % np.uint64(slots)).astype(np.int64)
                order = np.lexsort((salts > 1, slot, where))
                keys = [k[order] for k in (where, slot, salts == 1)]
                fresh = np.ones(len(order), bool)
                fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
                first = np.flatnonzero(fresh)
                cuts = pa.array(np.append(first, len(order)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, v) for v in (pa.array(left[at][order], pa.int8()), found.take(pa.array(order)).cast(pa.string()), pa.array(count[order], pa.int64()))]
                language_of, slot_of, whole = (k[first] for k in keys)
                columns = [pa.array(names, pa.string()).take(pa.array(language_of)), pa.array(slot_of, pa.int32()), pa.array(whole), pa.array(np.full(len(first), side), pa.int32()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "slot", "whole", "side", "at", "fragment", "n"])

    return docs.mapInArrow(emit, "lang string, slot int, whole boolean, side int, at array<tinyint>, fragment array<string>, n array<long>")



def _slices(words: pa.LargeStringArray, low: np.ndarray, high: np.ndarray) -> pa.LargeStringArray:
    """The run of words from each low to before each high as one string."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)
    begin, size = offsets[low], offsets[high] - offsets[low] - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(ends[-1], offsets[-1]) < 1 << 31 else np.int64
    index = np.repeat((begin - ends[:-1]).astype(kind), size)
    index += np.arange(ends[-1], dtype=kind)
    data = np.frombuffer(words.buffers()[2], np.uint8)[index]
    return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


def mine(pieces: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, phrase, n: the runs of 2 to `longest` words that come to `least` or more, each counted where its pivot's fragments are.

    Slots drop what is too rare themselves. Only where the fragments of one pair are dealt to several of them are all counts kept, to be added
    up afterwards. A run has its pivot in one place, so each distance to its ends is counted on its own.
    """
    schema = "lang string, phrase string, n long, whole boolean"

    def count(key, table):
        whole = key[2].as_py()
        flat = {c: pa.concat_arrays([chunk.flatten() for chunk in table.column(c).chunks]) for c in ("at", "fragment", "n")}
        words, _, text = words_of(flat["fragment"], BLANKS)
        size = np.bincount(text, minlength=len(flat["fragment"]))
        place = flat["at"].to_numpy().astype(np.int64)
        pivot = np.cumsum(size) - size + place
        weight = flat["n"].to_numpy()
        side = np.repeat(table.column("side").to_numpy(), pc.list_value_length(table.column("at")).to_numpy())
        found, total = [], []
        for back in range(longest):
            for ahead in range(longest - back):
                sides = [k for k, asked in enumerate((back + ahead > 0, ahead > 0, ahead == 0 and back > 0)) if asked]
                held = np.flatnonzero((place >= back) & (size - 1 - place >= ahead) & np.isin(side, sides))
                if len(held):
                    coded = pc.dictionary_encode(_slices(words, pivot[held] - back, pivot[held] + ahead + 1))
                    n = np.zeros(len(coded.dictionary), np.int64)
                    np.add.at(n, coded.indices.to_numpy(), weight[held])
                    keep = np.flatnonzero(n >= (least if whole else 1))
                    found.append(coded.dictionary.take(pa.array(keep)).cast(pa.string()))
                    total.append(n[keep])
        phrases = pa.concat_arrays(found) if found else pa.array([], pa.string())
        n = np.concatenate(total) if total else np.zeros(0, np.int64)
        return pa.table({"lang": pa.repeat(key[0], len(n)).cast(pa.string()), "phrase": phrases, "n": pa.array(n, pa.int64()), "whole": pa.repeat(whole, len(n))})

    raw = written(pieces.groupBy("lang", "slot", "whole").applyInArrow(count, schema), "phrases")
    merged = raw.where("NOT whole").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = written(raw.where("whole").select("lang", "phrase", "n").unionByName(merged), "phrases")
    discard(raw)
    return found


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: each phrase with its lowest-scoring cut in two, the first of those; whole numbers throughout."""
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    own = phrases.select("lang", "phrase", F.col("n").alias("a"), F.size(F.split("phrase", " ")).alias("m"))
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - m)").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = {c: f"CAST({c} AS DECIMAL(18, 0))" for c in "anlr"}
    score = F.expr(f"(1000 * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def unsubsumed(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer phrase of the same count holds: it is enough to look at those with one word more, as counts only fall with length."""
    longer = phrases.where(F.size(F.split("phrase", " ")) > 2)
    size = F.size(F.split("phrase", " "))
    inner = longer.select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)"), F.expr("substring_index(phrase, ' ', 1 - size(split(phrase, ' ')))"))).alias("phrase"), "n", size.alias("m"))
    held = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    return phrases.join(held, ["lang", "phrase"], "left").where("most IS NULL OR most < n").drop("most")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, bits: int = 22, hot: int = 1 << 18, share: int = 1 << 19, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each language the `top` phrases of 2 to `longest` words with at least `least` occurrences, by score, count and phrase.

    A null language counts as und, a null text as empty; repeated rows count each time; an empty table, or a language without frequent phrases, has no
    rows. Long texts are worked on in overlapping stretches. bits: size of the tables of word and pair counts, the only ones that tasks
    hold: 4 bytes for each of 2**bits buckets, whatever the size of the corpus. share: words of the corpus for each slot that pivots are dealt to.
    """
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(word_counts(own), "words")
    frequent = words.where(F.col("n") >= least)
    ranks = Ranks(frequent, bits)
    slots = 1 + (words.agg(F.sum("n")).first()[0] or 0) // share
    phrases = mine(fragments(own, ranks, pair_counts(own, ranks, least), least, longest, hot, slots), longest, least)
    found = scored(phrases, words).join(unsubsumed(phrases).select("lang", "phrase"), ["lang", "phrase"])
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.crc32(F.col("phrase").cast("binary")), F.lit(64))
    # the best of each share of a language first, so that no task orders all phrases of one
    first = found.withColumn("share", share).withColumn("k", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("k") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
