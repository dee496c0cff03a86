"""Histogram-sort sharding with DataFrame functions only.

The sort key of a row is (hash of its text, hash of its id).  Exact byte counts below candidate key boundaries are
taken across all partitions; candidates are refined, only around the boundaries that are not yet close enough,
until every splitter meets the tolerance; then rows are exchanged once.  Equal texts are neighbours in key order and
are parted only where one group of copies alone would break the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.llm.common import saved

_LOW = -(1 << 63)
#: Key bits that the first and each later round add; the driver sees at most 2**_FIRST sums, then 2**_MORE a splitter.
_FIRST, _MORE = 12, 8
#: Independent pieces of a shard within which slots are numbered, so that numbering is parallel.
_PIECES = 64


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _prefix(key: str, bits: int) -> Column:
    return F.shiftright(F.col(key), 64 - bits)


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.005) -> list[tuple[int, int]]:
    """The ``n_shards - 1`` lower bounds (h, g) of the shards after the first.

    ``keys`` has the columns h, g (64-bit keys) and size.  A splitter is settled when the bytes below it are within
    ``tolerance`` of a shard's mean from the wanted sum, or when the key has no more bits.
    """
    first = keys.groupBy(_prefix("h", _FIRST).alias("p")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
    total = sum(r["s"] for r in first)
    slack = tolerance * total / n_shards
    cuts: dict[int, tuple[int, int]] = {}
    #: The cell (None or the hash whose group is split, bits, prefix) that holds the target, and the bytes below it.
    open_: dict[int, tuple[tuple[int | None, int, int], int]] = {}

    def settle(i: int, group: int | None, bits: int, cells: list, below: int) -> None:
        target = total * i / n_shards
        low = lambda p: (p << (64 - bits), _LOW) if group is None else (group, p << (64 - bits))
        for r in cells:
            if below + r["s"] < target and r is not cells[-1]:
                below += r["s"]
                continue
            near, far = abs(target - below), abs(below + r["s"] - target)
            done = group is not None and bits == 64
            if min(near, far) <= slack or done:
                cuts[i] = low(r["p"]) if near <= far else low(r["p"] + 1) if r["p"] + 1 < 1 << (bits - 1) else (group if group is not None else (1 << 63) - 1, (1 << 63) - 1)
            elif group is None and r["lo"] == r["hi"]:
                open_[i] = ((r["lo"], 0, 0), below)
            else:
                open_[i] = ((group, bits, r["p"]), below)
            return

    cells = sorted(first, key=lambda r: r["p"])
    for i in range(1, n_shards):
        if cells:
            settle(i, None, _FIRST, cells, 0)
        else:
            cuts[i] = (_LOW, _LOW)
    while open_:
        now, open_ = open_, {}
        kinds: dict[tuple[bool, int], set] = {}
        for (group, bits, p), _ in now.values():
            kinds.setdefault((group is not None, bits), set()).add((group, p))
        found: dict[tuple, list] = {}
        for (in_group, bits), wanted in kinds.items():
            key, more = ("g" if in_group else "h"), min(64, bits + _MORE)
            rows = keys
            if in_group:
                rows = rows.where(F.col("h").isin(*{g for g, _ in wanted}))
            if bits:
                rows = rows.where(_prefix(key, bits).isin(*{p for _, p in wanted}))
            by = [F.col("h").alias("o")] if in_group else [F.lit(None).cast("long").alias("o")]
            for r in rows.groupBy(*by, _prefix(key, more).alias("p")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect():
                at = 0 if not bits else r["p"] >> (more - bits)
                found.setdefault((r["o"], bits, at), []).append(r)
        for i, ((group, bits, p), below) in now.items():
            settle(i, group, min(64, bits + _MORE), sorted(found[group, bits, p], key=lambda r: r["p"]), below)
    return [cuts[i] for i in range(1, n_shards)]


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.005,
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards of nearly equal bytes.

    Returns the input columns with ``size`` (UTF-8 bytes of the text plus 16), ``law``, ``shard`` (int) and ``slot``
    (long, gapless from 0 in each shard); columns of these names are replaced.  A null text has no bytes.  Rows that
    repeat both id and text have one key and stay together.  The table itself is only read and exchanged once; the
    rounds read its keys from a narrow table in the shared folder.
    """
    rows = docs.drop("law", "shard", "slot")
    rows = rows.withColumn("size", byte_size(F.col(text_col)))
    rows = rows.withColumn("_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_g", F.xxhash64(F.lit(7), F.col(id_col)))
    keys = saved(rows.select(F.col("_h").alias("h"), F.col("_g").alias("g"), "size"), "shard-keys")
    cuts = find_splitters(keys, n_shards, tolerance)

    def shard(h: Column, g: Column) -> Column:
        out = F.lit(0)
        for a, b in cuts:
            out = out + ((h > a) | ((h == a) & (g >= b))).cast("int")
        return out

    piece = F.pmod(F.shiftright(F.col("_g"), 20), F.lit(_PIECES)).cast("int")
    counts = (
        keys.select(shard(F.col("h"), F.col("g")).alias("shard"), F.col("g").alias("_g")).withColumn("_piece", piece)
        .groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    )
    before = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = rows.withColumn("shard", shard(F.col("_h"), F.col("_g"))).withColumn("_piece", piece)
    within = W.partitionBy("shard", "_piece").orderBy("_g", "_h")
    placed = placed.withColumn("_rn", F.row_number().over(within))
    # at most n_shards * _PIECES rows
    placed = placed.join(F.broadcast(base), ["shard", "_piece"])
    return (
        placed.withColumn("law", F.lit("bytes"))
        .withColumn("slot", (F.col("_base") + F.col("_rn") - 1).cast("long"))
        .drop("_h", "_g", "_piece", "_rn", "_base")
    )


def op7_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    return shard_by_bytes(docs, 40).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
