"""Pattern rows, corrections, samples, dealt files and calls against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabloom.operators import batches, patterns

ROWS = "table_id string, page int, row_idx int, cells array<string>"


def is_number(c):
    return re.fullmatch("[0-9]+", c.replace(",", "").replace(".", "")) is not None


def repeats(row, pattern):
    a, b = ([(c or "").strip(" ").lower() for c in x] for x in (row, pattern))
    if a and is_number(a[0]):
        return False
    pairs = [(x, y) for x, y in zip(a, b, strict=False) if (x or y) and not is_number(x) and not is_number(y)]
    return len(pairs) >= 5 and sum(x == y for x, y in pairs) >= 0.8 * len(pairs)


def test_pattern_rows_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    words = ["Party", "Name", "votes", "NOTA", "", None, "12", "1,234.5", "Booth", "x"]
    base = [[rng.choice(words) for _ in range(rng.randrange(4, 11))] for _ in range(25)]
    near = [[c if rng.random() < 0.88 else rng.choice(words) for c in rng.choice(base)] for _ in range(400)]
    rows = [(rng.choice("ab"), 1, i, r) for i, r in enumerate(near + base[:5] * 3 + [[], [None], ["7", *["a"] * 6]])]
    pats = spark.createDataFrame(list(enumerate(base + base[:2] + [["7", *["a"] * 6], []])), "pattern_id int, cells array<string>")
    df = spark.createDataFrame(rows, ROWS)
    want = {(r[0], r[2], i) for r in rows for i, p in enumerate(base + base[:2] + [["7", *["a"] * 6], []]) if repeats(r[3], p)}
    got = [(r["table_id"], r["row_idx"], r["pattern_id"]) for r in patterns.pattern_matches(df, pats).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    left = patterns.drop_pattern_rows(df.withColumn("extra", F.lit(1)), pats)
    assert {(r["table_id"], r["row_idx"]) for r in left.collect()} == {(r[0], r[2]) for r in rows} - {w[:2] for w in want} and "extra" in left.columns
    assert patterns.drop_pattern_rows(df, pats.limit(0)).count() == len(rows)


def test_corrections_by_column(spark):
    rows = [["1", "RAMAN — K", "1O5", "a · b"], ["2", " two  spaces ", "l 23", "x"], ["3", None, "abc", "1234S"], ["4", "S O S", "B,O", ""]]
    cells = [("t", 1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    df = spark.createDataFrame(cells, "table_id string, page int, row_idx int, col_idx int, value string")
    heads = spark.createDataFrame([("t", 1, "Name"), ("t", 2, "Valid Votes"), ("t", 3, None)], "table_id string, col_idx int, header string")
    got = {(r["row_idx"], r["col_idx"]): (r["value"], r["numeric"]) for r in patterns.correct_by_column(df, heads).collect()}
    assert [got[r, 2] for r in range(4)] == [("105", True), ("123", True), ("abc", True), ("8,0", True)]
    assert [got[r, 1] for r in range(4)] == [("RAMAN - K", False), ("two spaces", False), (None, False), ("S O S", False)]
    assert [got[r, 3] for r in range(4)] == [("a . b", False), ("x", False), ("12345", True), ("", False)] and got[0, 0] == ("1", True)


def test_samples_merge_and_are_compared(spark):
    cells = [(t, 1, r, c, f"{r}.{c}") for t, n in (("big", 400), ("small", 3)) for r in range(n) for c in range(3)]
    df = spark.createDataFrame(cells, "table_id string, page int, row_idx int, col_idx int, value string")
    once = {tuple(r) for r in patterns.sample_cells(df, size=16).collect()}
    again = {tuple(r) for r in patterns.sample_cells(df.repartition(7), size=16).collect()}
    halves = patterns.sample_cells(df.where("row_idx < 100"), size=16).union(patterns.sample_cells(df.where("row_idx >= 100"), size=16))
    assert once == again == {tuple(r) for r in patterns.sample_cells(halves, size=16).collect()}
    assert sum(r[0] == "big" for r in once) == 16 and once != {tuple(r) for r in patterns.sample_cells(df, size=16, seed="x").collect()}
    source = df.where("row_idx <> 1").withColumn("value", F.when((F.col("table_id") == "big") & (F.col("row_idx") > 1), F.lit("?")).otherwise(F.concat(F.lit(" "), "value")))
    told = {r["table_id"]: r for r in patterns.sample_accuracy(df, source, size=16).collect()}
    sampled = [r for r in once if r[0] == "small"]
    assert (told["small"]["n_sampled"], told["small"]["n_missing"]) == (len(sampled), sum(r[2] == 1 for r in sampled)) and told["small"]["n_differ"] == 0
    assert told["big"]["n_differ"] == sum(r[0] == "big" and r[2] > 1 for r in once)


def test_dealt_files(spark):
    rng = random.Random(2)
    files = [(i, rng.choice(["text", "scan", None]), rng.choice([None, 1, 10, 50, 400])) for i in range(500)] + [(7, "text", 5000)]
    df = spark.createDataFrame(files, "doc_id int, kind string, size int")
    got = batches.deal_files(df, 300, lanes=4).collect()
    assert len(got) == len(files)
    tasks = defaultdict(list)
    for r in got:
        tasks[r["lane"], r["task"]].append((r["kind"], r["size"] or 0))
    for own in tasks.values():
        assert len({k for k, _ in own}) == 1 and sum(s for _, s in own) < 300 + max(s for _, s in own) + 1
    for lane in range(4):
        order = [next(iter(tasks[k]))[0] for k in sorted(tasks) if k[0] == lane]
        assert order == sorted(order, key=["text", "scan", None].index)
        assert len(order) <= sum(s for k, own in tasks.items() if k[0] == lane for _, s in own) / 300 + 3
    pages = [("a", 2, "x" * 500), ("a", 1, " short "), ("b", 1, "y" * 200), ("c", 1, None)]
    kinds = batches.file_classes(spark.createDataFrame(pages, "doc_id string, page int, text string"))
    assert {(r["doc_id"], r["kind"], r["n_pages"]) for r in kinds.collect()} == {("a", "scan", 2), ("b", "text", 1), ("c", "scan", 1)}


def test_calls_hold_so_many_characters(spark, tmp_path):
    log = str(tmp_path)

    def connector(text):
        import uuid
        from pathlib import Path

        Path(log, uuid.uuid4().hex).write_text(text)
        if "bad" in text:
            raise ValueError(text)
        return text.upper().replace("GLUE\n", "GLUE ")

    texts = [f"text number {i}" for i in range(300)] + ["bad one", "glue", "two\nlines", None, " ", "Sentence one. " * 90 + "w" * 700] + ["known"]
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string").repartition(3)
    known = spark.createDataFrame([("known", "told")], "value string, answer string")
    got = {r["value"]: r["answer"] for r in batches.ask_in_calls(df, "t", connector, known, most=500).collect()}
    assert set(got) == {t for t in texts if t and t.strip()} and got["known"] == "told" and got["bad one"] == "bad one"
    assert all(got[t] == t.upper() for t in texts[:300]) and got["two\nlines"] == "TWO\nLINES" and got["glue"] == "GLUE"
    assert got[texts[305]] == " ".join(p.upper() for p in batches.sentences(texts[305], 500)) and got[texts[305]].replace(" ", "") == texts[305].upper().replace(" ", "")
    calls = [p.read_text() for p in tmp_path.iterdir()]
    assert max(map(len, calls)) <= 500 and len(calls) < 120 and not any("known" in c for c in calls)


def test_close_texts_anywhere_are_those_of_all_pairs(spark):
    from difflib import SequenceMatcher

    from tabloom.operators import lookup

    rng = random.Random(5)
    names = ["".join(rng.choice("aeiknrs. ") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    near = ["".join(c if rng.random() < 0.8 else rng.choice("xyz") for c in rng.choice(names)) for _ in range(150)] + ["", "q", names[0], names[0]]
    left = spark.createDataFrame(list(enumerate(near)) + [(999, None)], "i int, t string")
    right = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, party int")
    for cutoff in (0.6, 0.75, 1.0):
        got = {r["i"]: (round(r["score"], 9), r["name"], r["party"]) for r in lookup.close_match_anywhere(left, right, "t", "name", cutoff).collect()}
        want = {}
        for i, t in enumerate(near):
            best = max(((round(SequenceMatcher(None, t, n).ratio(), 9), n, k) for k, n in enumerate(names) if t), default=(0,))
            if best[0] >= cutoff:
                want[i] = best
        assert got == want and len(want) > 3


def test_lanes_keep_the_rate_together(spark):
    import time

    from tabloom.operators import connect

    df = spark.createDataFrame([(f"v{i}",) for i in range(40)], "t string").repartition(4)
    began = time.time()
    got = connect.ask(df, "t", lambda s: s.str.upper(), pause=0.2, lanes=4)
    assert got.rdd.getNumPartitions() == 4 and {r["answer"] for r in got.collect()} == {f"V{i}" for i in range(40)}
    assert time.time() - began >= 0.2 * 4


def test_pattern_rows_of_wide_and_narrow_tables(spark):
    """Forms of 4 to 30 cells meet by sets of one, two and three cells."""
    rng = random.Random(3)
    words = ["Party", "votes", "NOTA", "", None, "12", "Booth", "x", *(f"w{i}" for i in range(12))]
    base = [[rng.choice(words) for _ in range(rng.choice([5, 8, 12, 16, 22, 30]))] for _ in range(40)]
    near = [[c if rng.random() < 0.9 else rng.choice(words) for c in rng.choice(base)] + ["y"] * rng.choice([0, 0, 9]) for _ in range(500)]
    near += [r[: rng.randrange(5, 31)] for r in near[:100]]
    want = {(i, j) for i, r in enumerate(near) for j, p in enumerate(base) if repeats(r, p)}
    pats = spark.createDataFrame(list(enumerate(base)), "pattern_id int, cells array<string>")
    df = spark.createDataFrame([("t", 1, i, r) for i, r in enumerate(near)], ROWS)
    got = [(r["row_idx"], r["pattern_id"]) for r in patterns.pattern_matches(df, pats).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def _most_rows(node):
    """The most rows that an operator of a finished plan gave."""
    name = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    children = inner or [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if node.metrics().contains("numOutputRows") else 0
    return max([own, *(_most_rows(c) for c in children)])


def test_like_patterns_and_few_words_lead_to_few_pairs(spark):
    """Twenty times the same patterns, and rows that differ from them by their numbers; any two cells are much repeated."""
    rng = random.Random(5)
    text = lambda: [f"b{rng.randrange(12)}", *(f"{c}{rng.randrange(6)}" for c in "cdefg")]
    kinds = [text() for _ in range(60)]
    pats = spark.createDataFrame([(i, kinds[i % 60] + [str(i)]) for i in range(1200)], "pattern_id int, cells array<string>")
    rows = [("t", 1, i, (kinds[i % 60] if i % 9 == 0 else text()) + [str(i)]) for i in range(900)]
    left = patterns.drop_pattern_rows(spark.createDataFrame(rows, ROWS), pats)
    assert {r["row_idx"] for r in left.collect()} == {r[2] for r in rows if not any(repeats(r[3], k) for k in kinds)}
    assert _most_rows(left._jdf.queryExecution().executedPlan()) < 20_000
