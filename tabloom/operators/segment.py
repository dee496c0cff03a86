"""Order-dependent grouping: gap clusters, anchored rows, blocks, carried values, and joins in space.

Windows stay inside one document or page.  Only two operators need a group's rows together in Python: greedy one-use
matching and card rows, both of one page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabloom.functions.text import epics
from tabloom.operators.labels import _checked
from tabloom.operators.merge import COPIES, counted, repeated


def gap_clusters(df: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Rows with ``cluster``: a new one wherever the step from the previous value is more than ``tolerance``."""
    w = W.partitionBy(*keys).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def cluster_means(df: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    return gap_clusters(df, keys, value, tolerance).groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def anchored_rows(df: DataFrame, keys: Sequence[str], value: str, tolerance: float, items: Sequence[str]) -> DataFrame:
    """(keys, row, anchor, items): a new row where a value is more than ``tolerance`` from its row's first.

    Rows are dealt by keys and sorted by Spark; one pass over each sorted partition keeps the last key, anchor and row number
    and nothing else, so a page may have any number of rows.  ``items`` are structs of the value (``v``) and the
    named columns, in order.  A null value is a row of its own, before the others.
    """
    keyed = df.select(*keys, F.col(value).cast("double").alias("v"), *[c for c in items if c not in keys])
    order = [F.asc_nulls_first(c) for c in dict.fromkeys((*keys, "v", *items))]
    dealt = keyed.repartition(*keys).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor, row = None, None, 0
        for batch in batches:
            rows, anchors = [], []
            own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for k, v in zip(own, batch.column("v").to_pylist(), strict=True):
                if k != key:
                    key, anchor, row = k, v, 0
                elif v is None or anchor is None or not abs(v - anchor) <= tolerance:
                    anchor, row = v, row + 1
                rows.append(row)
                anchors.append(anchor)
            columns = [*batch.columns, pa.array(rows, pa.int32()), pa.array(anchors, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "row", "anchor"])

    numbered = dealt.mapInArrow(number, T.StructType([*keyed.schema.fields, T.StructField("row", T.IntegerType()), T.StructField("anchor", T.DoubleType())]))
    listed = F.array_sort(F.collect_list(F.struct("v", *items)))
    return numbered.groupBy(*keys, "row").agg(F.first("anchor").alias("anchor"), listed.alias("items"))


def words_to_lines(words: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(doc_id, page, line_no, text) of word boxes; without a tolerance, half of the page's upper median word height."""
    keys = ["doc_id", "page"]
    if tolerance is None:
        height = F.sort_array(F.collect_list(F.col("bottom") - F.col("top")))
        median = words.groupBy(*keys).agg(height.alias("_h")).select(*keys, (F.element_at("_h", (F.size("_h") / 2).cast("int") + 1) / 2).alias("_t"))
        scaled = words.join(median, keys).withColumn("top", F.col("top") / F.greatest("_t", F.lit(1e-6)))
        rows = anchored_rows(scaled, keys, "top", 1.0, ["x0", "text"])
    else:
        rows = anchored_rows(words, keys, "top", tolerance, ["x0", "text"])
    text = F.array_join(F.transform(F.array_sort(F.transform("items", lambda i: F.struct(i["x0"], i["text"]))), lambda i: i["text"]), " ")
    return rows.select(*keys, F.col("row").alias("line_no"), text.alias("text"))


def lines_by_number(boxes: DataFrame) -> DataFrame:
    """OCR words of one block and line in reading order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ")
    return boxes.groupBy("page", "block_num", "line_num").agg(text.alias("text"), F.min("y").alias("y"), F.avg("confidence").alias("confidence"))


def column_extents(boxes: DataFrame, row_keys: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rank, lo, hi): the extents of the n-th boxes of all rows, or of the rows of each of ``keys`` (doc_id, page)."""
    rank = F.row_number().over(W.partitionBy(*dict.fromkeys((*keys, *row_keys))).orderBy("x")) - 1
    return boxes.withColumn("rank", rank).groupBy(*keys, "rank").agg(F.min("x").alias("lo"), F.max(F.col("x") + F.col("width")).alias("hi"))


def blocks(lines: DataFrame, keys: Sequence[str], order: str, is_start: Column, drop_before_first: bool = False) -> DataFrame:
    """(keys, block, lines): a start begins a block; what stands before the first is a block of its own or dropped."""
    n = F.sum(is_start.cast("int")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    marked = lines.withColumn("block", n)
    if drop_before_first:
        marked = marked.where("block > 0")
    text = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return marked.groupBy(*keys, "block").agg(text.alias("lines"))


def entries(lines: DataFrame, legacy_continuation: bool = False) -> DataFrame:
    """Numbered entries of text lists: doc_id, entry, serial_no, id_no, text.

    A line that begins with two numbers starts an entry; other lines continue it (with ``legacy_continuation`` only
    those that begin with one number do); lines before the first start are dropped.
    """
    start = F.col("text").rlike("^\\s*[0-9]{1,4}\\s+[0-9]{1,4}[A-Z]?\\s+\\S")
    w = W.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("_s", start).withColumn("entry", F.sum(F.col("_s").cast("int")).over(w)).where("entry > 0")
    if legacy_continuation:
        marked = marked.where(F.col("_s") | F.col("text").rlike("^\\s*[0-9]+\\s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: F.trim(x["text"])), " ")
    out = marked.groupBy("doc_id", "entry").agg(joined.alias("_t"))
    part = "^\\s*([0-9]{1,4})\\s+([0-9]{1,4})[A-Z]?\\s+(.*)$"
    return out.select("doc_id", "entry", *[F.regexp_extract("_t", part, i).try_cast("int").alias(n) for i, n in ((1, "serial_no"), (2, "id_no"))], F.regexp_extract("_t", part, 3).alias("text"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The last known value so far."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def carried_serials(df: DataFrame, keys: Sequence[str], order: Sequence[str], parsed: str) -> DataFrame:
    """A parsed serial resets the count; rows without one count on from it (from 1 before the first)."""
    w = W.partitionBy(*keys).orderBy(*order)
    island = F.sum(F.col(parsed).isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("_i", island)
    inside = W.partitionBy(*keys, "_i").orderBy(*order)
    base = F.coalesce(F.first(parsed).over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(1))
    return marked.withColumn("serial", base + F.row_number().over(inside) - 1).drop("_i")


def running_offsets(df: DataFrame, group: str, order: str, count: str) -> DataFrame:
    """Start and end rows of consecutive groups of ``count`` rows, in ``order`` inside ``group``."""
    ahead = F.coalesce(F.sum(count).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start_row", ahead).withColumn("end_row", F.col("start_row") + F.col(count) - 1)


def join_continuations(text: Column) -> Column:
    """Line ends that no field label follows become spaces, where the text has a relation label at all."""
    label = "(?i:name|father|husband|mother|house|age|gender|sex|photo|பெயர்|தந்தை|கணவர்|வீட்டு|வயது|பாலினம்)"
    return F.when(text.rlike("(?i)father|husband|mother|தந்தை|கணவர்"), F.regexp_replace(text, f"\\n(?!\\s*{label})", " ")).otherwise(text)


def epic_segments(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n, epic, segment): the text from the end of the previous id to the start of the next."""
    pattern = "(?<![A-Z])[A-Z]{3}[0-9]{7}(?![0-9])"
    between = F.split("text", pattern)
    found = pages.withColumn("_e", epics(F.col("text"))).withColumn("_b", between)
    rows = found.select("doc_id", "page", "_b", F.posexplode("_e").alias("n", "epic"))
    return rows.select("doc_id", "page", "n", "epic", F.concat(F.get("_b", F.col("n")), F.col("epic"), F.get("_b", F.col("n") + 1)).alias("segment"))


def label_segments(text: Column, labels: str = "Name|Father|Husband|Mother|House|Age|Gender") -> Column:
    return F.filter(F.transform(F.split(text, f"(?=\\b(?:{labels})\\b\\s*[:=])"), lambda s: F.trim(s)), lambda s: s != "")


def split_cards(text: Column, n: int) -> Column:
    """A stitched text as ``n`` cards: by form feeds, by rules, by blank lines, else whole and empty."""
    by = [F.filter(F.split(text, p), lambda s: F.trim(s) != "") for p in ("\\f", "\\n\\s*[-=_]{5,}\\s*\\n", "\\n\\s*\\n")]
    out = F.concat(F.array(text), F.array_repeat(F.lit(""), n - 1))
    for parts in reversed(by):
        out = F.when(F.size(parts) == n, parts).otherwise(out)
    return out


def words_in_cards(words: DataFrame, cards: DataFrame, margin: float = 8.0, below: float = 2.0) -> DataFrame:
    """Words whose middle lies in a card of the same page, by one equi join on the page with a residual."""
    w = words.withColumn("_cx", (F.col("x0") + F.col("x1")) / 2).withColumn("_cy", (F.col("top") + F.col("bottom")) / 2)
    c = cards.select("doc_id", "page", "card_idx", F.col("x0").alias("_l"), F.col("x1").alias("_r"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    hit = w.join(c, ["doc_id", "page"]).where(
        F.col("_cx").between(F.col("_l") - margin, F.col("_r") + margin) & F.col("_cy").between(F.col("_t"), F.col("_b") + below)
    )
    return hit.drop("_cx", "_cy", "_l", "_r", "_t", "_b")


def deleted_cards(cards: DataFrame, stamps: DataFrame) -> DataFrame:
    """Cards without a deletion stamp whose centre lies in them (stamps: doc_id, page, x, y)."""
    s = stamps.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "x", "y")
    inside = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("top"), F.col("bottom"))
    return cards.join(s, inside, "left_anti")


def box_columns(boxes: DataFrame, extents: DataFrame) -> DataFrame:
    """Each box with the column that holds its middle, else the next one to the right, else the last.

    Extents meet the boxes of their own doc_id and page, as far as both tables have these columns.  All rows stay,
    repeated ones too; where no extents are known, the column is null.
    """
    keys = [c for c in ("doc_id", "page") if c in boxes.columns and c in extents.columns]
    # the extents of one page are one row, so boxes are neither multiplied nor grouped
    listed = _checked(extents.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "rank")).alias("_e")))
    cx = F.col("x") + F.col("width") / 2

    def place(e: Column) -> Column:
        kind = F.when((cx >= e["lo"]) & (cx <= e["hi"]), 0).when(e["lo"] > cx, 1).otherwise(2)
        return F.struct(kind.alias("kind"), F.when(kind == 2, -e["rank"]).otherwise(e["rank"]).alias("place"), e["rank"].alias("rank"))

    pairs = boxes.join(listed, keys, "left") if keys else boxes.join(listed, F.lit(True), "left")
    return pairs.select(*[boxes[c] for c in boxes.columns], F.array_min(F.transform("_e", place))["rank"].alias("column"))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, width: float, right_order: str) -> DataFrame:
    """The first right row, in order, of those within ``width`` of each left row.

    Repeated left rows stay; left rows with nothing in reach are left out.
    """
    near = counted(left).join(right, list(keys)).where(F.abs(F.col(a) - F.col(b)) < width)
    cols = [c for c in right.columns if c not in keys]
    best = near.groupBy(*left.columns, COPIES).agg(F.min_by(F.struct(*cols), right_order).alias("_m"))
    return repeated(best.select(*left.columns, COPIES, "_m.*"))


def greedy_nearest(voters: DataFrame, ids: DataFrame, side: float = 20.0, reach: float = 100.0) -> DataFrame:
    """(doc_id, page, pos, epic): each voter in order takes the nearest id of its page that is still free.

    ``voters``: doc_id, page, pos, x, y; ``ids``: doc_id, page, epic, x, y.  Pages are bounded; each is one group.
    """

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = right.sort_values(["y", "x", "epic"]).to_dict("records")
        out = []
        for v in left.sort_values("pos").to_dict("records"):
            near = [(abs(e["y"] - v["y"]), k) for k, e in enumerate(free) if abs(e["x"] - v["x"]) <= side and abs(e["y"] - v["y"]) < reach]
            if near:
                out.append((key[0], key[1], v["pos"], free.pop(min(near)[1])["epic"]))
        return pd.DataFrame(out, columns=["doc_id", "page", "pos", "epic"])

    return voters.groupBy("doc_id", "page").cogroup(ids.groupBy("doc_id", "page")).applyInPandas(match, "doc_id string, page int, pos int, epic string")


def fill_ids_by_position(voters: DataFrame, ids: DataFrame) -> DataFrame:
    """Voters without an id get the page's unused ids in order; used ones are left out first."""
    used = voters.where("voter_id IS NOT NULL AND voter_id <> ''").select("doc_id", "page", F.col("voter_id").alias("epic"))
    spare = ids.join(used, ["doc_id", "page", "epic"], "left_anti")
    spare = spare.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("pos"))).select("doc_id", "page", "_n", "epic")
    lacking = F.coalesce(F.col("voter_id"), F.lit("")) == ""
    n = F.when(lacking, F.sum(lacking.cast("int")).over(W.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    joined = voters.withColumn("_n", n).join(spare, ["doc_id", "page", "_n"], "left")
    return joined.withColumn("voter_id", F.when(lacking, F.col("epic")).otherwise(F.col("voter_id"))).drop("_n", "epic")


def name_id_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, name_line, name, epic), orphan ids): a name takes the first id before the next name."""
    name = F.nullif(F.regexp_extract("text", "(?i)^\\s*name\\s*[:=]\\s*(.+)$", 1), F.lit(""))
    epic = F.try_element_at(epics(F.col("text")), F.lit(1))
    w = W.partitionBy("doc_id").orderBy("page", "line_no")
    marked = lines.withColumn("name", name).withColumn("epic", epic).withColumn("seg", F.sum(name.isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    firsts = marked.where("seg > 0").groupBy("doc_id", "seg").agg(F.min_by("name", F.struct("page", "line_no")).alias("name"), F.min_by("epic", F.when(F.col("epic").isNotNull(), F.struct("page", "line_no"))).alias("epic"))
    all_ids = marked.where("epic IS NOT NULL").select("doc_id", "epic").distinct()
    return firsts, all_ids.join(firsts, ["doc_id", "epic"], "left_anti")


def card_rows(lines: DataFrame) -> DataFrame:
    """Card rows read across: a line of names starts a batch, later lines fill its slots from the left, as many as they have.

    ``lines``: doc_id, page, line_no, kind (name, relation, house, age, epic), values array<string>.  A batch is a
    running count of name lines, so filling is an aggregate over (batch, slot), not a loop.
    """
    w = W.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("batch", F.sum((F.col("kind") == "name").cast("int")).over(w)).where("batch > 0")
    slots = marked.select("doc_id", "page", "batch", "line_no", "kind", F.posexplode("values").alias("slot", "value"))
    kinds = ("name", "relation", "house", "age", "epic")
    aggs = [F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("line_no"))).alias(k) for k in kinds]
    return slots.groupBy("doc_id", "page", "batch", "slot").agg(*aggs)
