"""Alignment of two tokenizers over the same texts, counted over the whole corpus.

Every text is encoded by a byte-level vocabulary (A, of space and text) and by a vocabulary of pieces (B, which adds the
space itself), so that the tokens of both tile the same bytes.  In each Arrow partition DuckDB holds both as tables of
byte intervals, a stretch of a block of texts at a time: an ASOF join finds the B token in which each A token starts, a
range join the B tokens that start inside an A token, and a window over the ends that both share numbers the groups.
Blocks send partial counts of their id pairs, which Spark adds up.  The documents' own pairs then meet the counts: those
of the frequent pairs, at most ``FREQUENT`` of them by the choice of the threshold, by a broadcast, all others by a shuffle
in which no pair is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import tokens
from tabloom.llm.common import given_back, lean, saved, scratch

#: Bytes of text that are encoded at once.  They are aligned in stretches of about a quarter of it, which end where tokens
#: of both end: DuckDB takes up to 100 times the bytes of a stretch.
BLOCK = 1_000_000
#: Chunks of A, and parts of B, that a worker remembers: fewer than one vocabulary alone may, as it holds both and DuckDB.
REMEMBERED = 150_000
#: Pairs that are joined by broadcast.  A pair is frequent from the (total / FREQUENT)-th link on, so there are no more.
FREQUENT = 100_000
_OWN = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
_PAIR = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("n", T.LongType())]))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Spaced(tokens.Encoder):
    """Encodes a space and the text; the texts neither begin nor end with white space nor hold rarer white space."""

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        return _first_spaced(super()._chunks(texts))


def _first_spaced(chunks: pa.ListArray) -> pa.ListArray:
    """Chunks whose mark of a missing space is taken from the first chunk of each text."""
    values, first = chunks.flatten(), np.zeros(len(chunks.flatten()), bool)
    first[chunks.offsets.to_numpy()[:-1] - chunks.offsets[0].as_py()] = True
    return pa.ListArray.from_arrays(pc.subtract(chunks.offsets, chunks.offsets[0]), pc.if_else(pa.array(first), pc.utf8_slice_codeunits(values, 1), values))


class Bytes:
    """Ids and byte lengths of a space and each text, by a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.chunked = _Spaced(path, False, REMEMBERED)
        self.odd = f"{tokens._WHOLE}|(?i:{tokens._special(path)})"
        alphabet = _byte_alphabet()
        vocabulary = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelt[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        rest = np.flatnonzero(~whole)
        if len(rest):
            found = self.chunked.encode(texts.take(pa.array(rest)))
            for k, ids in zip(rest.tolist(), np.split(found.ids, found.ends[:-1]), strict=True):
                out[k] = ids
        alone = np.flatnonzero(whole).tolist()
        if alone:
            for k, e in zip(alone, self.tokenizer.encode_batch_fast([" " + texts[k].as_py() for k in alone], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, np.uint32)
        return out


class Pieces:
    """Ids and byte lengths of each text, by a vocabulary of pieces that adds a space before the text.

    No piece of such a vocabulary goes on past a space, nor holds a line end: so texts are cut there, and each part is
    encoded once in a worker.  Texts with runs of white space, and all texts of other vocabularies, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelt = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.model.encode(" \n a") == [
            *self.model.encode(""), *self.model.encode(" "), *self.model.encode("\n")[1:], *self.model.encode("a")
        ]
        self.bytes = pa.array(self.spelt, pa.large_binary())
        self.table = tokens._Table()

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        return np.frombuffer(self.bytes.take(pa.array(ids)).buffers()[2] or b"", np.uint8)

    def _learn(self, parts: list[str]) -> None:
        found = self.model.encode(parts, num_threads=1)
        # a part that begins with a line end has no space of its own
        found = [ids[1:] if part[0] == "\n" else ids for part, ids in zip(parts, found, strict=True)]
        self.table.add(parts, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.table.full(REMEMBERED):
            self.table = tokens._Table()
        odd = "  | \n|^[ \n]| $|^$|[\\x00▁]" if self.cuts else ""
        whole = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        alone = np.flatnonzero(whole).tolist()
        for k, ids in zip(alone, self.model.encode([texts[k].as_py() for k in alone], num_threads=1), strict=True):
            out[k] = np.array(ids, np.uint32)
        rest = np.flatnonzero(~whole)
        if not len(rest):
            return out
        cut = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rest)), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        names, table = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.table
        code = np.fromiter(map(table.code.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(code < 0)
        if len(new):
            fresh = [names[k] for k in new.tolist()]
            self._learn(fresh)
            code[new] = np.fromiter(map(table.code.__getitem__, fresh), np.int64, len(fresh))
        ids, end = table.of(code, coded.indices)
        last = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        for k, own in zip(rest.tolist(), np.split(ids, end[last - 1][:-1]), strict=True):
            out[k] = own
        return out


@cache
def _bytes(path: str) -> Bytes:
    return Bytes(path)


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


given_back.extend(f.cache_clear for f in (_bytes, _pieces))

_HELD = """
-- the B token in which each A token starts
CREATE OR REPLACE TEMP TABLE held AS
  SELECT a.doc, a.id AS a, a.s, a.e, b.id AS b, b.e AS b_e FROM a_in a ASOF JOIN b_in b ON a.s >= b.s;
-- the B tokens that start inside an A token
CREATE OR REPLACE TEMP TABLE inside AS
  SELECT h.doc, h.a, h.e, i.id AS b, i.e AS b_e FROM (SELECT * FROM held WHERE e > b_e) h
  JOIN (SELECT * FROM b_in ANTI JOIN a_in USING (s)) i ON i.s > h.s AND i.s < h.e;
"""
_PAIRS = """
SELECT doc, (a::BIGINT << 32) + b AS p, count(*) AS n FROM (
  SELECT doc, a, b FROM held UNION ALL SELECT doc, a, b FROM inside
) GROUP BY ALL
"""
#: Groups end where both end, and an A token ends with one of its own B tokens; the running sum is the group's number.
_CUTS = """
SELECT e FROM (
  SELECT e, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT e FROM held WHERE e = b_e UNION ALL SELECT e FROM inside WHERE e = b_e
  )
) ORDER BY g
"""


class _Aligner:
    """One DuckDB connection of a task."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.con.execute("SET preserve_insertion_order = false")

    def align(self, doc: np.ndarray, a: tuple, b: tuple) -> tuple[pa.Table, np.ndarray]:
        """(doc, p, n) and the ends of the groups; ``a`` and ``b`` are (ids, ends) from byte 0 on."""
        ends = [x[1].astype(np.int32) for x in (a, b)]
        starts = [np.concatenate(([0], e[:-1])).astype(np.int32) for e in ends]
        a_in = pa.table({"doc": doc.astype(np.int32), "id": a[0].astype(np.int32), "s": starts[0], "e": ends[0]})
        b_in = pa.table({"id": b[0].astype(np.int32), "s": starts[1], "e": ends[1]})
        self.con.register("a_in", a_in)
        self.con.register("b_in", b_in)
        self.con.execute(_HELD)
        pairs = self.con.sql(_PAIRS).to_arrow_table().combine_chunks()
        pairs = pairs.take(pa.array(np.argsort(pairs["doc"].to_numpy(), kind="stable")))
        cuts = self.con.execute(_CUTS).fetchnumpy()["e"]
        self.con.unregister("a_in")
        self.con.unregister("b_in")
        return pairs, np.asarray(cuts, np.int64)


@cache
def _spelt_numbers(n: int) -> pa.Array:
    """The numbers below ``n`` as text: bare, then after each of the three marks."""
    return pa.array([mark + str(i) for mark in ("", ";", ",", "|") for i in range(n)])


def _groups(cuts: np.ndarray, a: tuple, b: tuple, doc: np.ndarray, n_docs: int, n_ids: int, opened: bool) -> tuple[pa.Array, np.ndarray]:
    """What a stretch adds to each document's text of groups, and its number of groups.  ``opened``: a group came before."""
    ga, gb = np.searchsorted(cuts, a[1]), np.searchsorted(cuts, b[1])
    first_a, first_b = np.diff(ga, prepend=-1) > 0, np.diff(gb, prepend=-1) > 0
    first_doc = np.diff(doc, prepend=-1) > 0
    if opened:
        first_doc[0] = False
    names = np.empty(len(ga) + len(gb), np.int64)
    at_a = np.arange(len(ga)) + np.searchsorted(gb, ga, "left")
    names[at_a] = a[0] + n_ids * np.where(first_doc, 0, np.where(first_a, 1, 2))
    names[np.arange(len(gb)) + np.searchsorted(ga, gb, "right")] = b[0] + n_ids * np.where(first_b, 3, 2)
    begin = np.searchsorted(doc, np.arange(n_docs + 1))
    offsets = np.append(at_a, len(names))[begin]
    strings = _spelt_numbers(n_ids).take(pa.array(names))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings), "")
    return text, np.bincount(doc[first_a], minlength=n_docs)


def _stretches(total: int, ends_a: np.ndarray, ends_b: np.ndarray) -> list[int]:
    """Ends of stretches of about a quarter of ``BLOCK`` bytes, all of which are ends of tokens in both."""
    step = max(1, BLOCK // 4)
    if total <= 2 * step:
        return [total]
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    at = np.searchsorted(both, np.arange(step, total, step))
    return np.unique(both[np.minimum(at, len(both) - 1)].tolist() + [total]).tolist()


def _block(texts: pa.Array, coders: tuple[Bytes, Pieces], sizes: tuple[np.ndarray, np.ndarray], aligner: _Aligner, with_groups: bool) -> dict:
    """The columns of a block of texts (null: none)."""
    n = len(texts)
    out = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64)}
    digest: list = [None] * n
    written: list[list[str]] = [[] for _ in range(n)]
    raw = pc.fill_null(texts, "")
    found = [c.encode(raw) for c in coders]
    spelt = coders[1].spell(np.concatenate([*found[1], np.empty(0, np.uint32)]))
    rows, to = [], 0
    for k, space in enumerate(pc.binary_join_element_wise("", raw, " ").cast(pa.binary()).to_pylist()):
        at, to = to, to + int(sizes[1][found[1][k]].sum())
        # ids of bytes spell what they encode, so their length tells; pieces may not
        if len(space) > 1 and to - at == len(space) == sizes[0][found[0][k]].sum() and spelt[at:to].tobytes() == space:
            rows.append(k)
    parts = []
    if rows:
        ids = [np.concatenate([f[k] for k in rows]).astype(np.int64) for f in found]
        counts = [np.array([len(f[k]) for k in rows]) for f in found]
        out["n_a"][rows], out["n_b"][rows] = counts
        docs = [np.repeat(np.arange(len(rows)), c) for c in counts]
        ends = [np.cumsum(s[i]) for s, i in zip(sizes, ids, strict=True)]
        n_ids, begin, at = max(len(s) for s in sizes), 0, [0, 0]
        for end in _stretches(int(ends[0][-1]), *ends):
            to = [int(np.searchsorted(e, end, "right")) for e in ends]
            a, b = ((i[f:t], e[f:t] - begin) for i, e, f, t in zip(ids, ends, at, to, strict=True))
            doc = docs[0][at[0] : to[0]]
            pairs, cuts = aligner.align(doc, a, b)
            low, high = int(doc[0]), int(doc[-1])
            opened = at[0] > 0 and docs[0][at[0] - 1] == low
            text, groups = _groups(cuts, a, b, doc - low, high - low + 1, n_ids, opened)
            for k, piece, g in zip(rows[low : high + 1], text.to_pylist(), groups.tolist(), strict=True):
                digest[k] = digest[k] or hashlib.sha256()
                digest[k].update(piece.encode())
                out["n_groups"][k] += g
                if with_groups:
                    written[k].append(piece)
            parts.append(pairs)
            begin, at = end, to
    pairs = pa.concat_tables(parts) if parts else pa.table({"doc": pa.array([], pa.int32()), "p": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    row = np.array(rows, np.int64)[pairs["doc"].to_numpy()] if rows else np.empty(0, np.int64)
    own = pa.StructArray.from_arrays([c.combine_chunks() for c in (pairs["p"], pairs["n"])], ["p", "n"])
    out["n_links"] = np.bincount(row, weights=pairs["n"].to_numpy(), minlength=n).astype(np.int64)
    out["groups_sha256"] = [d.hexdigest() if d else "" for d in digest]
    if with_groups:
        out["groups"] = ["".join(w) for w in written]
    total = pairs.group_by("p").aggregate([("n", "sum")])
    totals = pa.StructArray.from_arrays([c.combine_chunks() for c in (total["p"], total["n_sum"])], ["p", "n"])
    out["_pairs"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), own)
    # the block's counts go with its last row
    out["_totals"] = pa.ListArray.from_arrays(pa.array([0] * n + [len(totals)], pa.int32()), totals)
    return out


def _encode(byte_path: str, piece_path: str, text_col: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _bytes(byte_path), _pieces(piece_path)
        sizes = tuple(np.array([len(s) for s in c.spelt], np.int64) for c in coders)
        aligner = _Aligner()
        for batch in batches:
            column = batch.column(text_col).cast(pa.string())
            block = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            kept = [i for i, name in enumerate(batch.schema.names) if name != text_col]
            for low, high in zip(edges, edges[1:], strict=False):
                if low < high:
                    own = _block(column.slice(low, high - low), coders, sizes, aligner, with_groups)
                    part = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i) for i in kept), *(v if isinstance(v, pa.Array) else pa.array(v) for v in own.values())],
                        [*(batch.schema.names[i] for i in kept), *own],
                    )

    return run


def align_tokens(
    docs: DataFrame,
    text_col: str = "text",
    byte_path: str | None = None,
    piece_path: str | None = None,
    with_groups: bool = False,
) -> DataFrame:
    """How two tokenizers cut each text, and how usual their id pairs are in the whole corpus.

    Returns one row for each row of ``docs``: its columns without the text, and (long) ``n_a``, ``n_b`` tokens,
    ``n_groups`` shortest stretches that begin and end with tokens of both, ``n_links`` pairs of overlapping tokens,
    ``n_best`` links whose pair is the most frequent of its B id (ties included), ``count_sum`` the counts of the
    links' pairs added up, and ``groups_sha256`` of the text of groups ``a1,a2|b1;a3|b2,b3``, which ``groups`` gives
    if wanted.  Texts that are null or empty, or that the tokens do not spell byte for byte, have zeros and empty
    strings.  Texts of any length are read whole, and aligned in stretches.  Repeated rows
    and repeated ids count as often as they come; an empty table gives no rows.  Columns of ``docs`` with these names
    are replaced, others are kept whatever their names, except those that begin with an underscore and are used here.
    """
    spark = docs.sparkSession
    docs = docs.drop(*_OWN, "_pairs", "_totals", "_row")
    own = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())]
    own += [T.StructField("groups", T.StringType())] * with_groups + [T.StructField("_pairs", _PAIR), T.StructField("_totals", _PAIR)]
    kept = [f for f in docs.schema.fields if f.name != text_col]
    run = _encode(byte_path or byte_vocabulary(), piece_path or piece_vocabulary(), text_col, with_groups)
    with scratch(spark):
        # written once, so that a row's number is the same for all that read it
        rows = saved(docs.mapInArrow(lean(run, keeps=True), T.StructType(kept + own)).withColumn("_row", F.monotonically_increasing_id()), "alignment-rows")
        exploded = F.explode("_totals").alias("t")
        counts = saved(rows.select(exploded).groupBy("t.p").agg(F.sum("t.n").alias("c")), "alignment-counts")
        piece = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF))
        # at most one row for each piece of the vocabulary
        best = counts.groupBy(piece.alias("b")).agg(F.max("c").alias("top"))
        counts = counts.join(F.broadcast(best), piece == F.col("b")).select("p", "c", (F.col("c") == F.col("top")).cast("long").alias("is_best"))
        counts = saved(counts, "alignment-best")
        least = max(1, -(-(counts.agg(F.sum("c")).first()[0] or 0) // FREQUENT))
        links = rows.select("_row", F.explode("_pairs").alias("l")).select("_row", "l.p", "l.n")
        usual = counts.where(F.col("c") >= least).select(F.col("p").alias("_p"), "c", "is_best")
        # the threshold leaves at most FREQUENT rows
        met = links.join(F.broadcast(usual), F.col("p") == F.col("_p"), "left")
        sums = [F.sum(F.col("n") * F.col("is_best")).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum")]
        frequent = met.where("_p IS NOT NULL").groupBy("_row").agg(*sums)
        rest = met.where("_p IS NULL").select("_row", "p", "n").join(counts.where(F.col("c") < least), "p").groupBy("_row").agg(*sums)
        both = frequent.union(rest).groupBy(F.col("_row").alias("_at")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        told = rows.drop("_pairs", "_totals").join(both, F.col("_row") == F.col("_at"), "left").drop("_row", "_at")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
        return saved(told.withColumns(zero), "alignment", keep=True)


def op12_token_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokens(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
