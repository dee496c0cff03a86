"""Whole-text tokenisation with the tokenizers library, a chunk at a time.

Both kinds of vocabulary cut texts at white space before anything else, so a text's ids are those of its chunks in a
row.  Arrow splits a batch of texts into chunks and finds the different ones; a chunk is encoded once in a worker and
then looked up.  Texts whose white space does not allow the cut, and those with a special token's string, are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabloom.llm.common import given_back

#: What keeps a text from being cut for a byte-level vocabulary, which joins white space to what follows: runs of
#: white space, white space at an end, rarer white space, and the two bytes that mark chunks.
_WHOLE = (
    r"[ \n][ \n]|^[ \n]|[ \n]$"
    r"|[\x00\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Letters after which a mark is cut off, in RE2 and Python: composed ones of Latin-1, which no normaliser changes once they are lower-case.
_LOWER_LETTERS, _LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f"[{_LETTERS}]+")
#: Chunks that a worker remembers (about 140 MB); beyond it, those that were met only once are forgotten.
_REMEMBERED = 700_000
#: Characters of a remembered chunk on average, at most.
_LONG = 32
#: Words joined to one string when they are learnt.
_JOINED = 2000


@cache
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> str:
    """A pattern of the strings that the vocabulary keeps as single tokens wherever they stand in a text."""
    return "|".join(re.escape(t.content) for t in _load(path).get_added_tokens_decoder().values()) or r"[^\x00-\x{10FFFF}]"


@cache
def _load_plain(path: str, words: bool):
    """The same vocabulary for chunks of letters only, and which ids end (``words``) or begin such a chunk.

    Words of Latin-1 letters, made lower-case, of a vocabulary of words need neither its normaliser nor its pattern.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = _load(path)
    if words:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.normalizer = None
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
    edge = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        edge[i] = token.endswith("</w>") if words else token.startswith("\u0120")
    return tokenizer, edge


class Encoded(NamedTuple):
    """The ids of a batch of texts in a row."""

    ids: np.ndarray  # uint32
    #: Where each text ends.
    ends: np.ndarray
    #: Where sentences end, ascending; ends of texts are not among them unless a sentence ends there.
    stops: np.ndarray


class _Table:
    """The ids of the known chunks, in one array."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = 0
        self.ids = np.empty(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.size = np.zeros(1 << 18, np.int64)
        self.stop = np.zeros(1 << 18, bool)
        self.again = np.zeros(1 << 18, bool)  # met again after it was learnt
        self.used = 0

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.code), len(chunks)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while k + n > len(self.start):
            for name in ("start", "size", "stop", "again"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + n] = sizes
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.stop[k : k + n] = [c.endswith((".", "!", "?")) for c in chunks]
        self.used += len(ids)
        self.chars += sum(map(len, chunks))
        self.code.update(zip(chunks, range(k, k + n), strict=True))

    def full(self, most: int) -> bool:
        return len(self.code) > most or self.chars > _LONG * most

    def of(self, code: np.ndarray, which: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks ``code[which]`` in a row, and where each ends; every id of ``code`` is looked up once."""
        size = self.size[code]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[code] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        bounds = np.concatenate(([0], 4 * end))
        kinds = (pa.binary(), np.int32) if 4 * int(size.max(initial=0)) * len(which) < 1 << 31 else (pa.large_binary(), np.int64)
        spelt = pa.Array.from_buffers(kinds[0], len(code), [None, pa.py_buffer(bounds.astype(kinds[1])), pa.py_buffer(ids)])
        taken = spelt.take(which)
        ends = np.frombuffer(taken.buffers()[1], kinds[1])[1 : len(which) + 1].astype(np.int64) // 4
        return np.frombuffer(taken.buffers()[2] or b"", np.uint32)[: ends[-1] if len(ends) else 0], ends


class Encoder:
    """Encodes texts with a vocabulary, to the ids that the library gives each text by itself.

    ``words``: the vocabulary lower-cases, drops white space and ends words; else it is byte-level and keeps it all.
    Of a byte-level vocabulary, chunks have lost their leading space, and those that had none begin with byte 1.
    """

    def __init__(self, path: str, words: bool, most: int | None = None) -> None:
        self.path, self.tokenizer, self.words, self.most, self.table = path, _load(path), words, most, _Table()

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        # marks that stand between a letter and white space are a piece of their own
        if self.words:
            low = pc.replace_substring_regex(pc.ascii_lower(texts), rf"([{_LOWER_LETTERS}])([.,!?]+)(\s|$)", r"\1 \2\3")
            return pc.ascii_split_whitespace(low)
        raw = pc.replace_substring(texts, "\n", " \x01\n \x01")
        raw = pc.replace_substring_regex(raw, rf"([{_LETTERS}])([.,!?]+)( |$)", "\\1 \x01\\2\\3")
        return pc.split_pattern(pc.binary_join_element_wise("\x01", raw, ""), " ")

    def _learn(self, chunks: list[str]) -> None:
        """Chunks that white space may part are encoded in long strings, the rest one by one."""
        add, words = self.table.add, self.words
        plain, mixed, alone = [], [], []
        for c in chunks:
            if _WORD.fullmatch(c) if words else c.isalpha():
                plain.append(c)
            elif not c or (not words and (c[0] == "\x01" or c[0].isspace() or c[-1].isspace())):
                alone.append(c)
            else:
                mixed.append(c)
        tokenizer, edge = _load_plain(self.path, words)
        groups = [plain[at : at + _JOINED] for at in range(0, len(plain), _JOINED)]
        joined = [" ".join(g).lower() if words else " " + " ".join(g) for g in groups]
        for group, e in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(edge[ids])
            add(group, ids, np.diff(at + 1, prepend=0) if words else np.diff(at, append=len(ids)))
        if alone:
            texts = [c[1:] if c[:1] == "\x01" else "" if words else " " + c for c in alone]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            add(alone, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))
        for at in range(0, len(mixed), _JOINED):
            some = mixed[at : at + _JOINED]
            found = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            # a chunk begins with the space before it, which may be a token of its own
            begin = np.cumsum([1 + len(c) for c in some]) - [1 + len(c) for c in some]
            offsets = np.fromiter((o[1] for o in found.offsets), np.int64, len(found.ids)) - 1
            add(some, np.array(found.ids, np.uint32), np.bincount(np.searchsorted(begin, offsets, "right") - 1, minlength=len(some)))

    def _forget(self) -> None:
        """A new table of the chunks that were met again."""
        old, new = self.table, _Table()
        kept = [c for c, again in zip(old.code, old.again.tolist(), strict=False) if again]
        code = np.flatnonzero(old.again[: len(old.code)])
        size = old.size[code]
        end = np.cumsum(size)
        new.add(kept, old.ids[np.repeat(old.start[code] - end + size, size) + np.arange(end[-1] if len(end) else 0)], size)
        self.table = new

    def encode(self, texts: pa.Array) -> Encoded:
        """The ids of all texts (null: none)."""
        if self.table.full(self.most or _REMEMBERED):
            self._forget()
        # a copy of its own: Arrow's ascii_lower goes wrong on slices
        texts = pc.fill_null(pa.concat_arrays([texts.cast(pa.string()), pa.array([], pa.string())]), "")
        mask = pc.match_substring_regex(texts, _special(self.path), ignore_case=True)
        if not self.words:
            mask = pc.or_(mask, pc.match_substring_regex(texts, _WHOLE))
        whole = np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist()
        if whole:
            own = [texts[k].as_py() for k in whole]
            texts = pc.if_else(mask, "", texts)
        chunks = self._chunks(texts)
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        table = self.table
        code = np.fromiter(map(table.code.get, names, repeat(-1)), np.int64, len(names))
        table.again[code[code >= 0]] = True
        new = np.flatnonzero(code < 0)
        if len(new):
            fresh = [names[k] for k in new.tolist()]
            self._learn(fresh)
            code[new] = np.fromiter(map(table.code.__getitem__, fresh), np.int64, len(fresh))
        ids, end = table.of(code, coded.indices)
        stops = end[table.stop[code][coded.indices.to_numpy()]]
        last = chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()
        ends = np.concatenate(([0], end))[last]
        if whole:
            parts, shift, at = [], np.zeros(len(ends), np.int64), 0
            for k, text in zip(whole, own, strict=True):
                found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                parts += [ids[at : ends[k]], found]
                at = ends[k]
                shift[k:] += len(found)
            stops = stops + shift[np.searchsorted(ends, stops)]
            ids, ends = np.concatenate([*parts, ids[at:]]), ends + shift
        return Encoded(ids, ends, stops)


@cache
def encoder(path: str, words: bool) -> Encoder:
    """The worker's encoder, which lives as long as the worker does."""
    return Encoder(path, words)


given_back.extend(f.cache_clear for f in (encoder, _load, _load_plain))
