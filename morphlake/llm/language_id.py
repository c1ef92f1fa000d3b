"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.common import batch_bytes, discard, small_batches, written

#: Order of the longest context.
ORDER = 3


@dataclass
class Model:
    """Frozen statistics: the exact code length of each byte after each context, for each language.

    code: byte -> column. row: number of the last three columns -> row of cost. cost: (rows, columns, languages), in bits.
    limits: language -> (bits a byte that its texts take, their spread at one byte), from texts that weren't counted.
    """

    languages: list[str]
    code: np.ndarray
    row: np.ndarray
    cost: np.ndarray
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def start(self) -> int:
        return self.cost.shape[1] - 1


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int, train) -> DataFrame:
    """(text, lang, row): whole texts of at most `most` labelled documents of each language, those of least id hash."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(train(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).withColumn("row", F.xxhash64("doc_id", "text"))
    # ranked without texts, in many tasks for each language first; at most `most` names a language come back to the rows
    chosen = rows.select("lang", "row", F.xxhash64("doc_id").alias("rank"), F.pmod("row", F.lit(256)).alias("deal"))
    for keys in (["lang", "deal"], ["lang"]):
        chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "row"))).where(F.col("k") <= most)
    return rows.join(F.broadcast(chosen.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"]).coalesce(8)  # of bounded size


def grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of ORDER + 1 bytes in a row, over the texts of a sample."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, tuple] = {}
        for batch in batches:
            parts: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(b"\0" * ORDER + text.encode().replace(b"\0", b" "))
            for lang, texts in parts.items():
                raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
                four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
                found, n = np.unique(four[raw[3:] > 0], return_counts=True)
                before = sums.get(lang, (found[:0], n[:0]))
                both, at = np.unique(np.concatenate([before[0], found]), return_inverse=True)
                sums[lang] = both, np.bincount(at, np.concatenate([before[1], n]), len(both)).astype(np.int64)
        for lang, (found, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(counts: pd.DataFrame) -> Model:
    """Cost tables from gram counts.

    In each language a byte is coded in its longest context that the language has seen, or after
    an escape in the next shorter one (method C: the number of distinct bytes weighs as the
    escape's count), where what the longer one holds is excluded; in the end all bytes that are left
    are alike. All contexts of the sample are kept, so the table has 4 bytes for each context, byte and language that the sample holds.
    """
    languages = sorted(counts["lang"].unique())
    gram = counts["gram"].to_numpy(np.int64)
    seen = np.unique(gram & 255)
    columns = len(seen) + 2  # the bytes of the sample, any other byte, the start of a text
    code = np.full(256, len(seen), np.uint8 if columns <= 256 else np.uint16)
    code[seen] = np.arange(len(seen))
    coded = lambda b: np.where(b == 0, columns - 1, code[b].astype(np.int64))
    table = []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        g, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
        table.append((coded(g >> 24 & 255), coded(g >> 16 & 255), coded(g >> 8 & 255), code[g & 255].astype(np.int64), n))

    def dense(keys: np.ndarray, order: int, lang: int) -> np.ndarray:
        """Counts of each byte after each of the contexts `keys` (numbers of `order` columns)."""
        a, b, c, s, n = table[lang]
        own = (a * columns + b) * columns + c if order == 3 else b * columns + c if order == 2 else c
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        fits = keys[at] == own
        out = np.zeros((len(keys), len(seen)))
        np.add.at(out, (at[fits], s[fits]), n[fits])
        return out

    three = np.unique(np.concatenate([(a * columns + b) * columns + c for a, b, c, _, _ in table])) if table else np.zeros(0, np.int64)
    two = np.unique(np.concatenate([b * columns + c for _, b, c, _, _ in table])) if table else np.zeros(0, np.int64)
    n3, n2 = len(three), len(two)
    pair = np.tile(np.arange(columns, dtype=np.int32), columns) + np.int32(n3 + n2)  # contexts that nothing was seen in: their last column alone
    pair[two] = np.arange(n3, n3 + n2, dtype=np.int32)
    row = np.tile(pair, columns)
    row[three] = np.arange(n3, dtype=np.int32)
    contexts_of = np.concatenate([three, two, np.arange(columns, dtype=np.int64)])
    cost = np.zeros((len(contexts_of), columns, max(1, len(languages))), np.float32)
    for k in range(len(languages)):
        ones, pairs, top = dense(np.arange(columns, dtype=np.int64), 1, k), dense(two, 2, k) if n2 else None, dense(three, 3, k) if n3 else None
        alone = ones.sum(0)
        for at in range(0, len(cost), 2048):
            rows = np.arange(at, min(at + 2048, len(cost)))
            key = contexts_of[rows]
            levels = [ones[key % columns], np.tile(alone, (len(rows), 1))]
            if n2:
                second = np.searchsorted(two, key % columns**2)
                second[(rows >= n3 + n2) | (second == n2)] = 0
                held = (rows < n3 + n2) & (two[second] == key % columns**2)
                levels.insert(0, np.where(held[:, None], pairs[second], 0))
            if n3:
                levels.insert(0, np.where((rows < n3)[:, None], top[np.minimum(rows, n3 - 1)], 0))
            bits, paid, gone = np.zeros(levels[0].shape), np.zeros(len(rows)), np.zeros(levels[0].shape, bool)
            for count in levels:
                count = np.where(gone, 0, count)
                total, kinds = count.sum(1), (count > 0).sum(1)
                whole = np.maximum(total + kinds, 1)
                new = count > 0
                bits = np.where(new, paid[:, None] - np.log2(np.maximum(count, 1) / whole[:, None]), bits)
                paid = paid + np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
                gone |= new
            rest = paid + np.log2(256 - gone.sum(1))
            cost[rows, : len(seen), k] = np.where(gone, bits, rest[:, None])
            cost[rows, len(seen), k] = rest
    return Model(languages, code, row, cost)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each language takes for each text of the batch: (texts, languages)."""
    n = len(offsets) - 1
    columns, total = model.cost.shape[1], len(data) + ORDER * n
    out = np.zeros((n, model.cost.shape[2]))
    if not len(data):
        return out
    lengths = np.diff(offsets)
    codes = np.full(total, model.start, np.int32)
    where = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, n + 1), lengths)
    codes[where] = model.code[data]
    key = (codes[:-3] * columns + codes[1:-2]) * columns + codes[2:-1]
    at = where - 3
    flat = model.row[key[at]].astype(np.int64) * columns + codes[where]
    bits = model.cost.reshape(-1, model.cost.shape[2])[flat]
    full = np.flatnonzero(lengths)
    out[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 400, train=None, hold: int = 0) -> Model:
    """A model from at most `most` labelled documents of each language (those of smallest id hash, whole texts).

    train: id column (string) -> whether a document may be learned from. hold: one sampled document in so many (by a hash) isn't counted, but
    tells how many bits a byte texts of its language take; none if 0. Counting is a Spark job; the driver gets one row for each language and byte
    sequence of the sample and one for each document held out. Rows without text or language are left out, rows alike in id and text
    count once. Without any the model has no languages. Other columns are ignored.
    """
    chosen = sampled(docs, id_col, text_col, lang_col, most, train or (lambda _: F.lit(True)))
    if not hold:
        return build(grams(chosen).toPandas())
    chosen = written(chosen, "sample")
    held = F.pmod("row", F.lit(hold)) == 0
    model = build(grams(chosen.where(~held)).toPandas())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rates(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        at = {lang: k for k, lang in enumerate(model.languages)}
        for batch in small_batches(batches, 1 << 19):
            data, offsets = batch_bytes(batch.column(0))
            bits, langs = code_lengths(model, data, offsets), batch.column(1).to_pylist()
            own = [k for k, lang in enumerate(langs) if lang in at]
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in own], pa.string()), pa.array(np.diff(offsets)[own], pa.int64()), pa.array([float(bits[k, at[langs[k]]]) for k in own], pa.float64())], ["lang", "n", "bits"])

    seen: dict[str, list] = {}
    for r in chosen.where(held).select("text", "lang").mapInArrow(rates, "lang string, n long, bits double").collect():
        seen.setdefault(r["lang"], []).append((r["n"], r["bits"]))
    for lang, own in seen.items():
        n, bits = np.array(own, np.float64).T
        mean = bits.sum() / n.sum()
        model.limits[lang] = float(mean), float(np.sqrt(np.mean(n * (bits / n - mean) ** 2)))
    discard(chosen)
    return model


#: Bytes that are ASCII letters.
LETTER = np.zeros(256, np.uint8)
LETTER[[*range(65, 91), *range(97, 123)]] = 1


def judged(model: Model, texts, slack: float = 0.5, spread: float = 6.0) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, bits a byte, whether some language's limit holds it) of each text of an Arrow column.

    A limit is the mean of the language's own texts and the share `slack` of it, and `spread` times what chance makes of a text of that length.
    """
    data, offsets = batch_bytes(texts)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    letters = np.zeros(n, bool)
    full = np.flatnonzero(lengths)
    if len(full):
        letters[full] = np.maximum.reduceat(LETTER[data], offsets[:-1][full]) > 0
    for k in np.flatnonzero((lengths > 0) & ~letters):
        letters[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
    bits = code_lengths(model, data, offsets)
    nats = (bits - bits.min(1, keepdims=True)) * np.log(2)
    pred = [model.languages[b] if known else "und" for b, known in zip(bits.argmin(1), letters, strict=True)]
    mean, sd = np.array([model.limits.get(lang, (1e9, 0.0)) for lang in model.languages]).T
    within = (bits <= lengths[:, None] * mean * (1 + slack) + spread * sd * np.sqrt(lengths)[:, None]).any(1) if len(full) else np.ones(n, bool)
    return pred, np.where(letters, 1 / np.exp(-nats).sum(1), 0.0), bits.min(1) / np.maximum(lengths, 1), within


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for each row: the language of the shortest code.

    score is its posterior probability under equal priors. Null, empty and letterless texts are
    `und` with score 0; so is every text under a model without languages. Ties go to the
    alphabetically first language. Ids may be null or repeat; each row gets its own result. Very long texts are coded whole, at about
    60 bytes of memory for each byte. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 19):
            pred, score, rate, _ = judged(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs without the rows that identification rejects. All columns as they were, whatever their names.

    Rejected are texts that are `und` (so null, empty and letterless ones), whose score is under `least`, whose language isn't wanted, or that take more bits
    than the limits of all languages allow (see fit, hold): other languages, and junk. Each row is judged by its own text; very long texts whole, at about
    60 bytes of memory for each byte. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 19):
            pred, score, _, within = judged(shared.value, batch.column(at))
            yield batch.filter(pa.array([p != "und" and s >= least and bool(w) and (languages is None or p in languages) for p, s, w in zip(pred, score, within, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
