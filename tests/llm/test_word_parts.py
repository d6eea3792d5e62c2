"""Texts as ids by way of word parts: the tokenizer's own ids, with fewer parts to tokenize than there are words."""

import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lodestrata.llm.dp_packing import Packer
from lodestrata.llm.words import _STOPS, WordIds, cuts_words, tokenizer_file

ODD = [
    "",
    None,
    " \n\t",
    "It's O'Neill's, we'll don't 'twas L'ÉTÉ d'une",
    "<|startoftext|> a<|endoftext|>b <|StartOfText|> <b>x</b> 1<2|3",
    "Straße, ÉCOLE! ñandú? ¿Qué? «Où» §12 œuvre Ǆ ǅ ſ İ ŉ",
    "é É ẖ H̱ i̇ ʹ Å K",
    "3.14 1,000,000 v2b ²½ ٣ _a_ a_b --- ...!? end.) end.",
    "a b a\u0085b a b a\x1cb \x00 \x7f a​b",
    "Σίσυφος ς. Йод ёж: й; 中文。 日本！ … 😀👍🏽 กิ 가",
]


def test_ids_are_the_tokenizers_and_stops_are_at_word_ends():
    texts = [*ODD, *[f"x{chr(c)}y {chr(c)}. A{chr(c)}" for c in range(1, 0x900)]]
    whole, words = Tokenizer.from_file(tokenizer_file()), WordIds(tokenizer_file())
    assert words.cuts
    for _ in range(2):  # learned, then remembered
        for text, (ids, stops) in zip(texts, words(texts)):
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
            parts = re.split("[ \t\n\v\f\r]+", text or "")
            ends = [len(whole.encode(" ".join(parts[: i + 1]), add_special_tokens=False).ids) for i, w in enumerate(parts) if w.endswith(_STOPS)]
            assert stops.tolist() == ends, text


def test_case_and_punctuation_make_no_new_word():
    words = WordIds(tokenizer_file())
    words([f"{a}{w}{b}" for w in ("Harbour", "HARBOUR", "harbour") for a in ("", "(", "--") for b in ("", ",", ".", "!?", "***", "42")])
    assert sorted(words.index) == sorted(["harbour", "(", "--", ",", ".", "!?", "***", "4", "2"])


def test_a_memory_that_starts_anew_changes_nothing():
    small, large = WordIds(tokenizer_file(), 3), WordIds(tokenizer_file())
    for text in ["one two, three.", "It's four; five!", "two six's one."] * 2:
        (a, s), (b, t) = small([text])[0], large([text])[0]
        assert a.tolist() == b.tolist() and s.tolist() == t.tolist()


def test_other_tokenizers_are_not_cut():
    assert cuts_words(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert not cuts_words(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_packing_documents_looks_up_fewer_parts_than_words():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    whole, words, packer = Tokenizer.from_file(tokenizer_file()), WordIds(tokenizer_file()), Packer()
    pieces = []
    for k, (ids, stops) in enumerate(words(texts)):
        pieces += packer.add(k, np.append(ids, np.int32(1)), stops)
    pieces += packer.finish()
    for k, text in enumerate(texts):
        got = b"".join(ids for row, *_, ids in pieces if row == k)
        assert np.frombuffer(got, "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]
    assert len(words.index) < 0.9 * len({w for t in texts for w in (t or "").split()})
