"""Whole texts as token ids by way of a memory of word parts.

The tokenizer splits before it merges, so a text's ids are its parts' ids in a row.  A batch is cut at ASCII white space
and, for a tokenizer that lowers its text and splits it into letters, digits and other characters, there too; its parts
are numbered in Arrow, each distinct part is tokenized once a worker, and the ids of the batch are then put together by
array gathers.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestrata.llm.common import take_memory

_STOPS = (".", "!", "?", "。", "！", "？", "…", ":", ";")

#: Distinct words, or parts of them, remembered by a worker (some 200 bytes each) unless the caller says otherwise; beyond it the memory starts
#: anew, which changes no result.
MEMORY_WORDS = 1_500_000

_MARK = "<|startoftext|>"

#: What a tokenizer does before it merges if words may be cut into letters, digits and other characters.
_LOWERED = ["NFC", "Replace", "Lowercase"]
_SPACES = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "</w>"

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD, _LEAD = range(6)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes, and of the characters of two bytes.

    Odd is what may be changed together with its neighbours (combining marks), may begin a special token or an English
    ending, or is rare: a word with such a character is not cut.
    """
    byte, pair = np.full(256, _ODD, np.uint8), np.full(2048, _ODD, np.uint8)
    for c in map(chr, range(33, 127)):
        byte[ord(c)] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _ODD if c in "'<" else _OTHER
    byte[[9, 10, 11, 12, 13, 32]] = _SPACE
    byte[0xC2:0xE0] = _LEAD
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x37F), *range(0x380, 0x482)]):
        low = c.lower()
        if len(low) == 1 and unicodedata.normalize("NFC", c) == c and all(unicodedata.category(x)[0] == "L" for x in c + low):
            pair[ord(c)] = _LETTER
    pair[[ord(c) for c in "¡§«»¿"]] = _OTHER
    return byte, pair


_BYTE, _PAIR = _kinds()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def cuts_words(tok) -> bool:
    """Whether a tokenizer cuts words as ``word_parts`` does, each part ending in a token of its own kind."""
    told = [json.loads(x.__getstate__()) if x else {} for x in (tok.normalizer, tok.pre_tokenizer)]
    steps, splits = told[0].get("normalizers", []), told[1].get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == _LOWERED
        and steps[1] == _SPACES
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and type(tok.model).__name__ == "BPE"
        and tok.model.end_of_word_suffix == _END
        and not tok.model.continuing_subword_prefix
        and all(x.content.startswith("<") for x in tok.get_added_tokens_decoder().values())
    )


def word_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of all texts (large strings without nulls) in a row, A-Z lowered; whether each is a whole word with an odd
    character, left as it is; whether a word ends there; and where each text's parts begin, with the total."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: at[-1]]
    kind = _BYTE[raw]
    lead = np.flatnonzero(kind == _LEAD)
    kind[lead] = kind[lead + 1] = _PAIR[(raw[lead] & 31).astype(np.int64) << 6 | raw[lead + 1] & 63]
    low = _LOWER[raw]
    inside = kind != _SPACE
    first = inside.copy()  # of a word
    first[1:] &= ~inside[:-1]
    doc = at[:-1][at[:-1] < len(raw)]
    first[doc] = inside[doc]
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        begin = np.flatnonzero(first)
        word = np.unique(np.searchsorted(begin, odd, "right") - 1)
        n = np.append(begin, len(raw))[word + 1] - begin[word]
        whole = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kind[whole] = _ODD
        low[whole] = raw[whole]
    start = first | (kind == _DIGIT)
    start[1:] |= kind[1:] != kind[:-1]
    start &= inside
    where = np.flatnonzero(start)
    ends = np.append(first[where], True)[1:]
    low = low[inside]
    offsets = np.append(np.flatnonzero(start[inside]), len(low))
    parts = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(low))
    return parts, kind[where] == _ODD, ends, np.searchsorted(where, at)


_open: dict = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A path of a public tokenizer file; callers may pass any other path of the same kind."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Texts to ids; also which tokens end a sentence."""

    def __init__(self, path: str, most: int = MEMORY_WORDS):
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cuts = cuts_words(self.tok)
        n = self.tok.get_vocab_size()
        self.last = np.fromiter((self.cuts and self.tok.id_to_token(i).endswith(_END) for i in range(n)), bool, n)  # tokens that end a part
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.stop = np.zeros(1 << 14, bool)
        self.used = 0

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; many words go through one call, with a special token between them, which is cheaper."""
        mark = self.tok.token_to_id(_MARK)
        if mark is None or any("<|" in w for w in words):
            return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        out: list[list[int]] = []
        for i in range(0, len(words), 1000):
            ids = np.array(self.tok.encode_batch_fast([f" {_MARK} ".join(words[i : i + 1000])], add_special_tokens=False)[0].ids, np.int32)
            parts = np.split(ids, np.flatnonzero(ids == mark))
            out += [parts[0].tolist(), *(p[1:].tolist() for p in parts[1:])]
        return out

    def _encoded_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and how many each has: the last token of a part, and no other, is of the kind that ends one."""
        got = [np.zeros(0, np.int32)]
        for i in range(0, len(parts), 1000):
            got.append(np.array(self.tok.encode_batch_fast([" ".join(parts[i : i + 1000])], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate(got)
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(sizes) != len(parts) or sizes.sum() != len(ids):
            raise ValueError(f"{len(parts)} parts of words have {len(sizes)} ends")
        return ids, sizes

    def learn(self, words: list[str], whole: np.ndarray) -> np.ndarray:
        """Remember new words, or parts of them where whole is false; gives their numbers."""
        order = np.argsort(whole, kind="stable")
        words = [words[i] for i in order.tolist()]
        cut = len(words) - int(whole.sum())
        ids, sizes = self._encoded_parts(words[:cut])
        rest = self._encoded(words[cut:])
        ids = np.concatenate([ids, np.array([i for x in rest for i in x], np.int32)])
        sizes = np.concatenate([sizes, np.array(list(map(len, rest)), np.int64)])
        n0 = len(self.index)
        need, total = n0 + len(words), self.used + len(ids)
        if need > len(self.size):
            grow = max(need, 2 * len(self.size))
            for name in ("begin", "size", "stop"):
                old = getattr(self, name)
                new = np.zeros(grow, old.dtype)
                new[:n0] = old[:n0]
                setattr(self, name, new)
        if total > len(self.pool):
            new = np.zeros(max(total, 2 * len(self.pool)), np.int32)
            new[: self.used] = self.pool[: self.used]
            self.pool = new
        self.index.update(zip(words, range(n0, need)))
        self.size[n0:need] = sizes
        self.begin[n0:need] = self.used + np.cumsum(sizes) - sizes
        self.stop[n0:need] = [w.endswith(_STOPS) for w in words]
        self.pool[self.used : total] = ids
        self.used = total
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(n0, need)
        return numbers

    def __call__(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the rising counts of ids at which sentences end."""
        column = pa.array([t or "" for t in texts], pa.large_string())
        if self.cuts:
            values, whole, word_ends, offsets = word_parts(column)
        else:
            parts = pc.ascii_split_whitespace(column)
            values, offsets = parts.values, parts.offsets.to_numpy()
            whole = word_ends = np.ones(len(values), bool)
        coded = values.dictionary_encode()
        nth = coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        if len(self.index) > self.most:
            self.clear()
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        if len(new):
            odd = np.zeros(len(words), bool)
            odd[nth[whole]] = True
            known[new] = self.learn([words[i] for i in new.tolist()], odd[new])
        at = known[nth]
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.begin[at] - (ends - size), size) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        cut = ends[offsets]
        stops = ends[1:][self.stop[at] & word_ends & (size > 0)]
        where = np.searchsorted(stops, cut, "right")
        return [(ids[a:b], stops[i:j] - a) for a, b, i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), where[:-1].tolist(), where[1:].tolist())]


def word_ids(path: str, most: int = MEMORY_WORDS) -> WordIds:
    """One memory a worker process and file, kept between tasks."""
    take_memory("word ids", _open.clear)
    if path not in _open:
        _open[path] = WordIds(path, most)
    _open[path].most = most
    return _open[path]
