"""Deletion of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import LAST, discard, row_key, unused, written

#: What is not part of a line's content at its ends; what a word is.
TRIMMED = " \t\r"
WORD = r"[^\x20\x09-\x0D]+"


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, k2 (name the row), d, and for each line two hashes (h, g) and its number of words (n)."""
    k, k2 = row_key(id_col, text_col)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(TRIMMED)))
    rows = docs.select(k.alias("k"), k2.alias("k2"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("d"), lines.alias("lines"))
    each = {"h": lambda x: F.xxhash64(x), "g": lambda x: F.xxhash64(F.lit(1), x), "n": lambda x: F.regexp_count(x, F.lit(WORD))}
    return rows.select("k", "k2", "d", *(F.transform("lines", f).alias(c) for c, f in each.items()))


def _windows(rows: DataFrame, run: int, words: int) -> DataFrame:
    """k, k2, d, at, size, mark, pos, one, two: windows of `run` lines, and shorter ones of `words` words or more.

    mark is the fingerprint, the least line hash of the window, and pos the line it stands on, the last one of equals: all windows that one line
    is least in share its fingerprint. one and two hash all its lines in order. Nothing else of a text goes on.
    """
    parts = []
    for size in range(1, run + 1):
        starts = F.when(F.size("h") >= size, F.sequence(F.lit(1), F.size("h") - size + 1)).otherwise(F.array().cast("array<int>"))
        if size < run:
            starts = F.filter(starts, _heavy(size, words))
        parts.append(F.transform(starts, _window(size)))
    return rows.select("k", "k2", "d", F.explode(F.concat(*parts)).alias("w")).select("k", "k2", "d", "w.*")


def _heavy(size: int, words: int):
    return lambda i: sum((F.element_at("n", i + j) for j in range(1, size)), F.element_at("n", i)) >= words


def _window(size: int):
    def window(i: Column) -> Column:
        h, g = ([F.element_at(c, i + j if j else i) for j in range(size)] for c in ("h", "g"))
        mark = F.least(*h) if size > 1 else h[0]
        last = F.lit(0)
        for j in range(1, size):
            last = F.when(h[j] == mark, j).otherwise(last)
        return F.struct((i - 1).alias("at"), F.lit(size).alias("size"), mark.alias("mark"), (i - 1 + last).cast("int").alias("pos"), F.xxhash64(F.lit(size), *h).alias("one"), F.xxhash64(F.lit(size), *g).alias("two"))

    return window


def deleted_lines(docs: DataFrame, run: int = 3, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, k2, gone): for rows keyed by row_key, the stretches (start, stop) of lines to delete, ascending and apart, ends exclusive."""
    every = written(_windows(_hashed(docs, id_col, text_col), run, words), "line_windows")
    # winnowing: windows whose least line is the same one are one fingerprint; only those that stand in two places can be of repeated runs
    places = every.groupBy("mark").agg(F.min(F.struct("k", "k2", "pos")).alias("lo"), F.max(F.struct("k", "k2", "pos")).alias("hi"))
    shared = written(places.where("lo <> hi").select("mark"), "line_marks")
    # positions of a shared fingerprint are joined to the first holder of the lines around it
    met = written(every.join(shared, "mark", "left_semi").select("k", "k2", "d", "at", "size", "one", "two"), "lines")
    discard(every)
    discard(shared)
    place = F.struct("d", "k", "k2", "at")
    first = written(met.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("one", "two", "first"), "line_firsts")
    later = met.join(first, ["one", "two"]).where(place != F.col("first"))
    # matches grow both ways: what follows one another in a text is one stretch
    line = later.select("k", "k2", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("line"))
    lists = line.groupBy("k", "k2").agg(F.sort_array(F.collect_set("line")).alias("l"))
    begin = F.filter("l", lambda x, i: (i == 0) | (F.get("l", i - 1) != x - 1))
    end = F.filter("l", lambda x, i: (i == F.size("l") - 1) | (F.get("l", i + 1) != x + 1))
    runs = lists.select("k", "k2", F.arrays_zip(begin.alias("start"), F.transform(end, lambda x: x + 1).alias("stop")).alias("gone"))
    out = written(runs, "line_runs")
    discard(met)
    discard(first)
    return out


def _left(text: Column, gone: Column) -> Column:
    """text without the lines of the stretches gone: the lines between them, put together again."""
    lines = F.split(text, "\n", -1)
    begin = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x["stop"]))
    end = F.concat(F.transform(gone, lambda x: x["start"]), F.array(F.size(lines)))
    kept = F.transform(F.array(lines), lambda v: F.flatten(F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda x: F.slice(v, x["a"] + 1, x["b"] - x["a"]))))[0]
    return F.array_join(kept, "\n")


def _cut(docs: DataFrame, run: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs and the name of a column with the stretches to delete, null where there are none."""
    names = {c: unused(docs, f"__{c}") for c in ("k", "k2", "gone")}
    k, k2 = row_key(id_col, text_col)
    found = deleted_lines(docs, run, words, id_col, text_col).select(*(F.col(c).alias(n) for c, n in names.items()))
    # what is deleted grows with the documents, so it is never broadcast, however few they are
    return docs.withColumns({names["k"]: k, names["k2"]: k2}).join(found.hint("merge"), [names["k"], names["k2"]], "left"), names["gone"]


def delete_repeated_runs(docs: DataFrame, run: int = 3, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without each line that lies in a run of consecutive lines which stands earlier too; other columns stay.

    A run counts if it has `run` lines, or fewer with `words` words or more together. Lines compare without blanks at their ends. Earlier is
    a smaller id (null last), or in the same document a smaller line number; so the first of equal runs stays, whole.

    Each window of lines that would count is named by its least line hash, a fingerprint that no equal window can lack. Positions of shared
    fingerprints are joined on two 64-bit hashes of the lines around them to the first place that has these lines; places that follow one
    another extend a match both ways as far as it goes. Hashes alone are shuffled; all groups are formed with partial
    aggregation and joins of stored tables, which Spark splits, so a line that a third of the documents hold makes no task of its own.

    Null text stays null, and texts without repeated runs stay as they are. A text of very many lines costs in proportion to its length. Rows
    alike in id and text are one document. An empty table gives an empty result. Extra columns may have any names.
    """
    cut, gone = _cut(docs, run, words, id_col, text_col)
    text = F.col(f"`{text_col}`")
    left = F.when(F.col(gone).isNull(), text).otherwise(_left(text, F.col(gone)))
    return cut.select(*(left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def line_report(docs: DataFrame, run: int = 3, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_sha256 for each row: what delete_repeated_runs does to it (null text as empty)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut, gone = _cut(rows, run, words, "doc_id", "text")
    lost = F.aggregate(gone, F.lit(0), lambda acc, x: acc + x["stop"] - x["start"])
    left = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_left(F.col("text"), F.col(gone)))
    return cut.select("doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("bigint").alias("n_deleted"), F.sha2(left, 256).alias("kept_sha256"))
