"""Packing of token sequences by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _letters(w: str) -> bool:
    """Whether w is of letters alone, composed (as the tokenizer does first) and in lower case too: some letters get a mark of their own there that joins what follows."""
    if not w.isalpha() or w.isascii():
        return w.isalpha()
    c = w if unicodedata.is_normalized("NFC", w) else unicodedata.normalize("NFC", w)
    return c.isalpha() and c.lower().isalpha()


class _Words:
    """Strings without white space and their ids, of which it holds the `most` met last, side by side in arrays: some 40 bytes each."""

    def __init__(self, path: str, most: int):
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.turn, self.names, self.met = 0, pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def find(self, names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where in them those of each of names begin, how many they are). names: distinct, an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(names, value_set=self.names)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        self.turn += 1
        self.met[at[~new]] = self.turn
        if new.any():
            fresh = names.filter(pa.array(new))
            ids = self.learn(fresh.to_numpy(zero_copy_only=False).tolist())
            at[new] = len(self.names) + np.arange(len(fresh))
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.names, self.met = pa.concat_arrays([self.names, fresh]), np.append(self.met, np.full(len(fresh), self.turn))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(size))
            self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))
        flat, start, size = self.flat, self.ends[at], self.ends[at + 1] - self.ends[at]
        if len(self.names) > self.most:
            self._forget(3 * self.most // 4)
        return flat, start, size

    def _forget(self, most: int) -> None:
        """Keeps the `most` strings that were met last."""
        keep = np.sort(np.argpartition(self.met, -most)[-most:]) if most else np.zeros(0, np.int64)
        self.names, self.met, (self.flat, self.ends) = self.names.take(keep), self.met[keep], _gathered(self.flat, self.ends[keep], self.ends[keep + 1] - self.ends[keep])

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, w: str) -> bytes:
        """The ids of letters up to U+00FF: they are composed and their small letters are plain, so the model takes them without the normalizer and the patterns."""
        w = w.lower()
        found = self.model.tokenize(w if w.isascii() else self.bytes.pre_tokenize_str(w)[0][0])
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each of words, which are distinct, by the tokenizer; all but plain words many at a time.

        A word of letters alone is one of the tokenizer's own words, whose last token is marked so, which tells
        where in a common encoding each word ends. A mark behind such a word is a word of its own. All others are encoded one by one.
        """
        found: dict[str, bytes] = {}
        one, two, rest = set(), [], []
        for w in words:
            if _letters(w):
                if w.isascii() or max(w) < "\u0100":
                    found[w] = self._plain(w)
                else:
                    one.add(w)
            elif w[-1] in ".," and _letters(w[:-1]):
                two.append(w)
                one.add(w[:-1])
            else:
                rest.append(w)
        one = list(one)
        parts = [one[at : at + 1000] for at in range(0, len(one), 1000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(cuts) != len(part) or cuts[-1] != 4 * len(ids):
                found.update((w, self.ids(w)) for w in part)
                continue
            raw = ids.tobytes()
            found.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        if two:
            marks = {m: self.ids(m) for m in ".,"}
            found.update((w, found[w[:-1]] + marks[w[-1]]) for w in two)
        found.update(zip(rest, (np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return list(map(found.__getitem__, words))


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of flat that begin at start, one behind the other; where they end, after a 0)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


@functools.lru_cache(maxsize=1)
def _kept(path: str, stamp: tuple[int, int], most: int) -> _Words:
    """The words of one tokenizer, as long as this worker lives: a task goes on with what those before it have learnt."""
    return _Words(path, most)


#: What a byte of UTF-8 is: 1 white space, 2 an ASCII letter, 3 an ASCII sign.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without white space, where each piece starts in them and where the last ends, number of pieces before each text and in all).

    A piece ends at white space, at the end of a text, and between a letter and an ASCII sign: there the tokenizer parts words
    too, and nothing composes across. Letters are told up to U+00FF. Words that may hold a special token stay whole.
    """
    kind = _KIND[data]
    space = kind == 1
    letter = kind == 2
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # two bytes from U+00C0 on, but for the two signs there
    begin = np.ones(len(data), bool)
    begin[1:] = space[:-1]
    begin[offsets[offsets < len(data)]] = True
    cut = np.flatnonzero((kind[1:] == 3) & letter[:-1]) + 1
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    if len(special):
        words = np.flatnonzero(begin)
        cut = cut[~np.isin(np.searchsorted(words, cut, "right"), np.searchsorted(words, special, "right"))]
    begin[cut] = True
    begin &= ~space
    return data[~space], np.append(np.flatnonzero(begin[~space]), len(data) - np.count_nonzero(space)), np.searchsorted(np.flatnonzero(begin), offsets)


def _small(text: str) -> str:
    """text in lower case, as the tokenizer takes it anyway, where that is plain: all characters up to U+00FF, and nothing like a special token, which only matches as it is."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def encoder(path: str, most: int = 500_000):
    """texts -> ids of each as little-endian unsigned 32-bit bytes.

    This tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in a row. The distinct pieces of a call are looked up; the tokenizer encodes those that this worker hasn't met lately.
    """
    import pyarrow as pa

    from morphlake.llm.common import batch_bytes

    about = os.stat(path)
    words = _kept(path, (about.st_mtime_ns, about.st_size), most)

    def encode(texts: list[str | None]) -> list[bytes]:
        data, starts, of = _pieces(*batch_bytes(pa.array([_small(t) if t else "" for t in texts], pa.large_string())))
        coded = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)).dictionary_encode()
        flat, start, size = words.find(coded.dictionary)
        which = coded.indices.to_numpy()
        found, ends = _gathered(flat, start[which], size[which])
        raw = found.tobytes()
        cuts = (4 * ends[of]).tolist()
        return [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    return encode


class Packer:
    """Places examples into sequences of at most `size` tokens, `segments` pieces and `loss` loss-bearing tokens.

    Full-length stretches of an example go out at once. What is left of it waits in a pool of at
    most `pool` examples. A bin takes, again and again, the fitting example whose demand has the
    greatest dot product with what the bin has left; if none fits, that one is cut to fill the gap.
    """

    def __init__(self, first_id: int, size: int = 4096, segments: int = 64, loss: int | None = None, pool: int = 1024, keep: bool = False):
        self.keep = keep  # whether pieces come with their ids
        self.size, self.segments, self.loss, self.pool = size, segments, loss or size, pool
        self.next, self.out = first_id, []
        self.items: list = []  # [doc, ids, start, end, tokens of the document, first loss-bearing token]
        self.need = np.zeros((2 * pool + 8, 2))  # tokens, loss-bearing tokens of each waiting item
        self.n = 0

    def _losing(self, item, start: int, end: int) -> int:
        return max(0, end - max(start, item[5]))

    def _put(self, item, start: int, end: int, seq: int, offset: int) -> None:
        doc, ids, _, _, total, _ = item
        own = ids[4 * start : 4 * end]
        self.out.append((doc, start, end - start, zlib.crc32(own), total, seq, offset, self._losing(item, start, end), *([own] if self.keep else ())))

    def add(self, doc, ids: bytes, loss_from: int = 0) -> None:
        total = len(ids) // 4
        item = [doc, ids, 0, total, total, loss_from]
        while item[3] - item[2] >= self.size and self._losing(item, item[2], item[2] + self.size) <= self.loss:
            self._put(item, item[2], item[2] + self.size, self.next, 0)
            self.next += 1
            item[2] += self.size
        if item[2] < item[3]:
            self._wait(item)
            while self.n >= self.pool:
                self._fill()

    def _wait(self, item) -> None:
        if self.n + 1 > len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.items.append(item)
        self.need[self.n] = item[3] - item[2], self._losing(item, item[2], item[3])
        self.n += 1

    def _drop(self, k: int) -> None:
        self.n -= 1
        self.items[k] = self.items[self.n]
        self.need[k] = self.need[self.n]
        self.items.pop()

    def _cut(self, item, room: int, loss_room: int) -> int:
        """The end of the longest head of item that fits."""
        end = min(item[3], item[2] + room)
        over = self._losing(item, item[2], end) - loss_room
        return end - max(0, over)

    def _fill(self) -> None:
        room, loss_room, left = self.size, self.loss, self.segments
        offset = 0
        while room and left and self.n:
            need = self.need[: self.n]
            gain = need[:, 0] * (room / self.size**2) + need[:, 1] * (loss_room / self.loss**2) + (left / self.segments**2)
            fits = (need[:, 0] <= room) & (need[:, 1] <= loss_room)
            if left == 1:
                fits &= need[:, 0] == room
            whole = bool(fits.any())
            k = int(np.argmax(np.where(fits, gain, -1.0) if whole else gain))
            item = self.items[k]
            end = item[3] if whole else self._cut(item, room, loss_room)
            if end == item[2]:
                break
            self._put(item, item[2], end, self.next, offset)
            offset += end - item[2]
            room -= end - item[2]
            loss_room -= self._losing(item, item[2], end)
            left -= 1
            if end == item[3]:
                self._drop(k)
            else:
                item[2] = end
                self.need[k] = item[3] - end, self._losing(item, end, item[3])
        self.next += 1

    def finish(self) -> None:
        """Fills while a whole sequence is there; the rest goes into sequences whose lengths are powers of two, which need no padding."""
        while self.need[: self.n, 0].sum() >= self.size:
            self._fill()
        full, loss = self.size, self.loss
        while self.n:
            rest = int(self.need[: self.n, 0].sum())
            self.size = min(full, 1 << (rest.bit_length() - 1))
            self.loss = min(loss, self.size) if loss == full else loss
            self._fill()
        self.size, self.loss = full, loss

    def take(self) -> list:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, size: int = 4096, segments: int = 64, loss: int | None = None, loss_from: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in which sequence at which offset.

    Each task packs what it reads, so nothing is shuffled and no task sees more than its input;
    sequence ids are unique across tasks (task number in the upper bits). `loss_from` names a column
    with the number of leading tokens that bear no loss (a prompt); with_ids adds the tokens.

    A null or empty text is the end id alone (nothing at all if end_id is None). A document longer
    than `size` is cut; repeated rows are packed each; null ids stay null. An empty table gives no rows.
    """
    cols = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")]
    cols.append((F.coalesce(F.col(loss_from).cast("bigint"), F.lit(0)) if loss_from else F.lit(0).cast("bigint")).alias("loss_from"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from morphlake.llm.common import small_batches

        encode, tail = encoder(tokenizer), b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 32, size, segments, loss, keep=with_ids)
        names = [f.split()[0] for f in PIECES.split(", ")]

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True)) or [()] * (len(names) + with_ids)
            out = [pa.array(c, pa.int64()) for c in columns[: len(names)]]
            if with_ids:
                out.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in columns[-1]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, [*names, *(["ids"] if with_ids else ())])

        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            for doc, body, first in zip(batch.column(0).to_pylist(), encode(texts), batch.column(2).to_pylist(), strict=True):
                packer.add(doc, body + tail, first)
            if len(packer.out) >= 5000:
                yield rows()
        packer.finish()
        yield rows()
        pa.default_memory_pool().release_unused()  # this worker lives on

    return docs.select(*cols).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
