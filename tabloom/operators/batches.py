"""Work dealt by size: files to tasks of bounded length, and texts to calls of bounded length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A first page with so many characters is text; others have to be read as images.
TEXT_CHARS = 200
#: Characters of one call.
CALL_CHARS = 5000


def file_classes(pages: DataFrame, least: int = TEXT_CHARS) -> DataFrame:
    """(doc_id, kind, n_pages): ``text`` if the first page has enough characters without white space at its ends, else ``scan``."""
    chars = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    first = F.min_by(chars, F.col("page"))
    return pages.groupBy("doc_id").agg(F.when(first >= least, "text").otherwise("scan").alias("kind"), F.count(F.lit(1)).alias("n_pages"))


def deal_files(files: DataFrame, target: int, lanes: int = 64, kinds: Sequence[str] = ("text", "scan"), id_col: str = "doc_id", size_col: str = "size", kind_col: str = "kind") -> DataFrame:
    """The files with ``lane`` and ``task``: kinds in the order of ``kinds``, and in a task files of one kind only.

    Files fall into ``lanes`` by a hash of their id; within a lane and kind they are laid end to end, the largest first,
    and cut every ``target``.  So the sizes of a task are less than ``target`` and its largest file together, a lane
    has at most its sizes / target + 1 tasks a kind, and (task, lane) in ascending order does quick kinds first.
    No file is moved to fit, and no lane looks at another: each is numbered by itself, on narrow rows.
    Null sizes count as 0; kinds that are not listed come last.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    lane = (F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % lanes).cast("int")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind_col))
    rank = F.when(order > 0, order - 1).otherwise(len(kinds)).cast("long")
    w = W.partitionBy("lane", "_rank").orderBy(F.desc("_size"), id_col).rowsBetween(W.unboundedPreceding, -1)
    marked = files.withColumns({"lane": lane, "_rank": F.coalesce(rank, F.lit(len(kinds)).cast("long")), "_size": size})
    at = F.floor(F.coalesce(F.sum("_size").over(w), F.lit(0)) / target)
    # tasks of a later kind begin after all of the kinds before
    cut = marked.withColumn("_cut", at)
    most = W.partitionBy("lane")
    ends = [F.coalesce(F.max(F.when(F.col("_rank") == k, F.col("_cut") + 1)).over(most), F.lit(0)) for k in range(len(kinds))]
    offset = F.lit(0)
    for k, end in enumerate(ends):
        offset = offset + F.when(F.col("_rank") > k, end).otherwise(0)
    return cut.withColumn("task", (F.col("_cut") + offset).cast("long")).drop("_rank", "_size", "_cut")


def sentences(text: str, most: int) -> list[str]:
    """A text in pieces of at most ``most`` characters that end where sentences do, else at white space, else anywhere."""
    import re

    pieces, open_ = [], ""
    for part in re.findall(r"[^.!?\n]*(?:[.!?]+\s*|\n+|$)", text):
        while part:
            if len(open_) + len(part) <= most:
                open_, part = open_ + part, ""
            elif open_:
                pieces, open_ = [*pieces, open_], ""
            else:
                cut = part.rfind(" ", 0, most) + 1 or most
                pieces, part = [*pieces, part[:cut]], part[cut:]
    return [p.strip() for p in [*pieces, open_] if p.strip()]


def ask_in_calls(values: DataFrame, column: str, connector: Callable[[str], str], known: DataFrame | None = None, most: int = CALL_CHARS, mark: str = "\n") -> DataFrame:
    """(value, answer) of the distinct texts, asked for in calls of at most ``most`` characters.

    Texts are put in a row, parted by ``mark``, as long as a call holds them; the answer is cut at the marks and given back by
    position.  Where the numbers differ or the call fails, each text of the call is asked for alone, and a text whose own call
    fails is its own answer.  Texts that hold the mark go alone; longer ones are cut at sentences, and their
    answers joined by spaces.  Texts in ``known`` (value, answer) are not asked for; null and blank texts are left out.

    Every partition of distinct texts makes its own calls: there is no single lane, and no more than a call is held.
    Answers are made anew if a task is lost: write them before they are used more than once.
    """
    asked = values.select(F.col(column).alias("value")).where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").distinct()
    if known is not None:
        asked = asked.join(known.select("value"), "value", "left_anti")

    def alone(text: str) -> str:
        try:
            return connector(text)
        except Exception:
            return text

    def call(texts: list[str]) -> list[str]:
        if len(texts) > 1:
            try:
                answers = connector(mark.join(texts)).split(mark)
                if len(answers) == len(texts):
                    return answers
            except Exception:  # one bad text does not take the answers of the others
                pass
        return [alone(t) for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(texts: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"value": texts, "answer": call(texts)})

        row: list[str] = []
        length = 0
        for batch in batches:
            for text in batch["value"]:
                if len(text) > most:
                    yield pd.DataFrame({"value": [text], "answer": [" ".join(alone(p).strip() for p in sentences(text, most))]})
                elif mark in text:
                    yield pd.DataFrame({"value": [text], "answer": [alone(text)]})
                else:
                    if row and length + len(mark) + len(text) > most:
                        yield told(row)
                        row, length = [], 0
                    length += len(text) + (len(mark) if row else 0)
                    row.append(text)
        if row:
            yield told(row)

    found = asked.mapInPandas(run, "value string, answer string")
    return found if known is None else known.select("value", "answer").unionByName(found)
