"""Token alignment against plain Python on whole and odd texts."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import alignment

ODD = [
    None, "", " ", "\n", "a", "A b  c", " lead", "trail ", "a\n\nb", "a \nb", "a\n b", "tab\tx", "<|endoftext|> a <s> b </s>",
    "ﬁ① é naïve", "日本語 テキスト", "a▁b", "emoji 😀👍🏽 ok", "x\r\ny", "<0x0A>", "a\n", "\x00z", "Some ordinary words, repeated.", "Some ordinary words, repeated.",
]


def plain(texts):
    """What the contract asks for, by tokens and byte offsets in Python."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(alignment.byte_vocabulary())
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=alignment.piece_vocabulary())
    alphabet = alignment._byte_alphabet()
    rows, count = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        spelt_a = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        spelt_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
            rows.append(None)
            continue
        spans = []
        for ids, spelt in ((a, spelt_a), (b, spelt_b)):
            at, own = 0, []
            for i, s in zip(ids, spelt, strict=True):
                own.append((i, at, at + len(s)))
                at += len(s)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        count.update(links)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in own if low <= s and e <= cut) for own in spans))
            low = cut
        rows.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
        else:
            text = ";".join(r[2])
            best = sum(count[x] == top[x[1]] for x in r[3])
            out.append((r[0], r[1], len(r[2]), len(r[3]), best, sum(count[x] for x in r[3]), hashlib.sha256(text.encode()).hexdigest(), text))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize(("block", "frequent"), [(alignment.BLOCK, alignment.FREQUENT), (97, 20)])
def test_alignment_is_that_of_plain_python(spark, monkeypatch, block, frequent):
    """Small blocks align single texts in stretches; a small share of frequent pairs sends the others through the shuffle."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    texts = ODD + ["Licht und Straße, déjà vu; tokens unlike: xylophonic hyperparameters. " * 6, "word " * 400 + "\nEnd."]
    run, own = alignment._encode, block

    def small(*args):
        made = run(*args)

        def with_block(batches):
            from tabloom.llm import alignment as there

            there.BLOCK = own
            return made(batches)

        return with_block

    monkeypatch.setattr(alignment, "_encode", small)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, p string").repartition(3)
    got = {r["doc_id"]: r for r in alignment.align_tokens(docs, with_groups=True).collect()}
    assert len(got) == len(texts) and got[0]["p"] == "y"
    for i, want in enumerate(plain(texts)):
        assert tuple(got[i][c] for c in COLUMNS) == want, texts[i]


def test_alignment_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "same words"), (1, "same words"), (1, "same words"), (None, None)], "doc_id long, text string")
    got = alignment.align_tokens(docs.withColumns({c: F.lit("k") for c in ("n", "c", "b", "top", "is_best")})).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in got) == [("1", 2, 6), ("1", 2, 6), ("None", 0, 0), ("None", 2, 6)]
    assert alignment.align_tokens(docs.limit(0)).count() == 0


def test_pieces_are_those_of_the_library():
    texts = [t for t in ODD if t] + ["The same. The\nsame\nThe " + "x" * 5000, "a b\nc d " * 300 + "e"]
    pieces = alignment.Pieces(alignment.piece_vocabulary())
    assert pieces.cuts
    for _ in range(2):
        assert [p.tolist() for p in pieces.encode(pa.array(texts))] == pieces.model.encode(texts)
