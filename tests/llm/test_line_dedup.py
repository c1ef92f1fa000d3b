import random

from helpers import docs, empty, odd

from morphlake.llm.line_dedup import delete_repeated_runs, line_report


def brute(texts, run, words=50):
    """Texts without the lines that an earlier run of lines covers, of `run` lines or of `words` words."""
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        bare = [x.strip(" \t\r") for x in lines]
        gone = set()
        for i in range(len(lines)):
            for size in range(1, min(run, len(lines) - i) + 1):
                key = tuple(bare[i : i + size])
                if size == run or sum(len(x.split()) for x in key) >= words:
                    if key in seen:
                        gone |= set(range(i, i + size))
                    seen.add(key)
        out.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = [[f"shared {k} {i}" for i in range(rng.randint(1, 6))] for k in range(6)]
    shared += [[f"long {k} {i}" + " and on" * n for i, n in enumerate(sizes)] for k, sizes in enumerate(([24], [23], [12, 11], [10, 10], [30, 1], [0, 25, 0]))]
    texts = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 8)):
            lines += rng.choice(shared) if rng.random() < 0.5 else [rng.choice([f"own {d} {rng.random()}", "hot line", "", " hot line\t"])]
        texts.append("\n".join(lines))
    return [*texts, texts[3], None, "", "x\n" * 40]


def test_against_brute_force(spark):
    for run in (2, 3):
        texts = corpus(run)
        rows = delete_repeated_runs(docs(spark, texts), run)
        assert rows.columns == docs(spark, []).columns
        assert {r["doc_id"]: r["text"] for r in rows.collect()} == dict(enumerate(brute(texts, run)))


def test_a_text_of_very_many_lines(spark):
    rng = random.Random(4)
    lines = [f"line {rng.randint(0, 60000)}" for _ in range(100000)]
    lines[70000:70500] = lines[1000:1500]
    texts = ["\n".join(lines), "\n".join(["own", *lines[20000:60000], "end"])]
    rows = delete_repeated_runs(docs(spark, texts))
    assert [r["text"] for r in rows.orderBy("doc_id").collect()] == brute(texts, 3)


def test_columns_of_any_name(spark):
    table = docs(spark, corpus(5)[:20]).selectExpr("doc_id", "text", "1 as __k", "2 as __K2", "3 as __gone", "4 as gone", "5 as `a.b`")
    got = delete_repeated_runs(table)
    assert got.columns == table.columns
    assert {(r["__k"], r["__gone"], r["a.b"]) for r in got.collect()} == {(1, 3, 5)}


def test_odd_rows(spark):
    assert delete_repeated_runs(odd(spark)).count() == 8
    assert len(line_report(odd(spark)).collect()) == 8
    assert delete_repeated_runs(empty(spark)).count() == 0
