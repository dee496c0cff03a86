"""The validation report counts what the list of issues holds, without sorting or holding a table."""

import random
import re

from pyspark.sql import functions as F

from tabloom import model
from tabloom.operators import quality


def shuffled(node):
    """(columns that it is dealt by, rows) of all exchanges of a finished plan."""
    name = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    children = inner or [node.children().apply(i) for i in range(node.children().size())]
    dealt = re.sub(r"#[0-9]+L?", "", node.outputPartitioning().toString()) if name == "ShuffleExchangeExec" else ""
    own = [(dealt, node.metrics().apply("shuffleRecordsWritten").value())] if dealt else []
    return own + [x for c in children for x in shuffled(c)]


def test_report_counts_the_issues(spark):
    rng = random.Random(2)
    heads = [("Polling Station", "DMK Votes", "Total valid", "NOTA"), ("Name", "x"), ("a", "b", "c", "none of the above"), (), ("Sl", *["votes"] * 31), None]
    values = ["1", "17", "", None, "-4", "60,000", "250000", "1O", "x", "12a", "₹ 5", "1e6", "TOTAL", "99.5", "O"]
    rows, headers = [], []
    for t in range(40):
        wide, dirty = rng.choice(heads), rng.random()
        headers.append((f"t{t}", wide and list(wide)))
        for i in range(rng.choice([0, 3, 12, 40, 520])):
            n = len(wide or ()) + (rng.random() < dirty / 20)
            first = rng.choice(["TOTAL 9", "", "7", "q"]) if rng.random() < dirty / 4 else str(i * 3 + 9 * (rng.random() < dirty / 20))
            rows.append((f"t{t}", 1 + i // 300, i * rng.choice([1, 1, 2000]) if dirty > 0.7 else i, [first, *(rng.choice(values) if rng.random() < dirty else "5" for _ in range(n - 1))]))
    # the order of rows of one number is open: none here
    rows = list({r[:3]: r for r in rows}.values())
    table, header = spark.createDataFrame(rows, model.ROWS).repartition(3), spark.createDataFrame(headers, model.HEADERS)
    report, issues = quality.validate(table, header, header.limit(5).select("table_id", F.lit("ocr").alias("method")))
    listed = {(r["table_id"], r["check"], r["severity"]): r["count"] for r in issues.groupBy("table_id", "check", "severity").count().collect()}
    counts = quality.issue_counts(table, header).collect()
    got = {(r["table_id"], *c.split("_")): r[c] for r in counts for c in r.asDict() if c.split("_")[-1] in ("critical", "error", "warning", "info") and r[c]}
    assert got == listed and len(got) > 100 and len(counts) == 40
    shares = {r["table_id"]: r["empty_ratio"] for r in quality.empty_ratio(table).collect()}
    even = {r["table_id"]: r["type_consistency"] for r in quality.type_consistency(table, header).collect()}
    for r in report.collect():
        total = lambda s: sum(n for k, n in listed.items() if k[0] == r["table_id"] and k[2] == s)  # noqa: B023, E731
        assert [r["criticals"], r["errors"], r["warnings"], r["infos"]] == [total(s) for s in ("critical", "error", "warning", "info")]
        assert r["empty_ratio"] == shares.get(r["table_id"], 0.0) and r["type_consistency"] == even.get(r["table_id"])
        for kind, weights in quality.PENALTIES.items():
            assert abs(r[kind] - max(0, 1 - sum(w * listed.get((r["table_id"], kind, s), 0) for s, w in weights.items()))) < 1e-9


def test_report_shuffles_rows_twice_and_never_by_table(spark):
    cells = F.array(F.col("id").cast("string"), F.col("id").cast("string"), F.lit("x"))
    table = spark.range(20_000).select(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("table_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("row_idx"), cells.alias("cells"))
    heads = spark.createDataFrame([("t0", ["Sl", "votes", "NOTA"]), ("t1", ["Sl", "votes", "NOTA"])], model.HEADERS)
    report = quality.validate(table, heads, heads.select("table_id", F.lit("ocr").alias("method")))[0]
    assert {(r["table_id"], r["errors"], r["warnings"]) for r in report.collect()} == {("t0", 11, 1), ("t1", 11, 1)}
    dealt = shuffled(report._jdf.queryExecution().executedPlan())
    assert sum(n for _, n in dealt) < 2.2 * 20_000
    assert max(n for by, n in dealt if by.startswith("hashpartitioning(table_id, 4")) < 100
