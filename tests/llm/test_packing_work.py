"""What packing's tasks do once instead of again and again, and that results stay the same."""

from __future__ import annotations

import types

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from orespark.llm import bpe, packing  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


def counting(encoder, sizes: list[int]):
    """The encoder, which notes the length of every text that it is given."""

    def encode_to_numpy(text: str, **options):
        sizes.append(len(text))
        return encoder.encode_to_numpy(text, **options)

    return types.SimpleNamespace(name=encoder.name, n_vocab=encoder.n_vocab, _pat_str=encoder._pat_str, encode_to_numpy=encode_to_numpy)


def test_repeated_parts_are_encoded_once():
    """Texts of a few words cost the library those words, not all positions."""
    assert packing.CUT_PATTERN == P.PATTERN
    rng, sizes = np.random.RandomState(3), []
    names = [f"w{k}ord" for k in range(50)]
    texts = ["".join(names[i] + " \n"[i % 2] for i in rng.randint(50, size=300)) for _ in range(200)]
    encoder = bpe.rank_encoder(PATH, P.PATTERN, special=True)
    got = packing.token_ids(counting(encoder, sizes), texts, 1)
    assert [x.tolist() for x in got] == [[*encoder.encode(t, allowed_special="all"), 1] for t in texts]
    assert sum(sizes) < 2000 < sum(map(len, texts)) // 100  # a word after a space, after a line's end, and first in a text


def test_cuts_keep_the_tokens():
    """Ids and words of texts of white space of all kinds, contractions, special and split characters, as one slice."""
    kinds = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u200a", "\u2028", "\u2029",
        "\u202f", "\u205f", "\u3000", "\u200b", "\u180e", "\ufeff", "a", "B", "'s", "'", "1", "\xe9", "\u4e2d", "\u3002", "\u2026", "\x00",
        "\x7f", "\U0001f600", "\u0120", "<|endoftext|>", "<|endof", "!", "-", "ll", "\u0345", "\u0420", "\u042f"]
    rng = np.random.RandomState(1)
    encoder, tokenizer = bpe.rank_encoder(PATH, P.PATTERN, special=True), bpe.json_tokenizer(P.path("byte_bpe_50k.json"))
    for _ in range(200):
        texts = ["".join(kinds[i] for i in rng.randint(len(kinds), size=rng.randint(14))) for _ in range(rng.randint(12))]
        got = packing.token_ids(encoder, texts, 1)
        assert [x.tolist() for x in got] == [[*e.ids, 1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        number, owner = packing.words_of(encoder, got)
        want = [(k, w) for k, t in enumerate(texts) for w in t.encode().split()]
        assert owner.tolist() == [k for k, _ in want]
        assert len({w for _, w in want}) == len(set(number.tolist())) == len(set(zip(number.tolist(), (w for _, w in want), strict=True)))
    other = bpe.rank_encoder(PATH, r"[^\n]+|\n", special=True)  # matches go over white space: nothing is cut
    assert packing.token_ids(other, ["a b a b\nc "], 1)[0].tolist() == [*other.encode("a b a b\nc "), 1]


def test_scores_of_blocks(monkeypatch):
    """Products made for many seeds at once are those made singly, also where no room is left and when documents are left out."""
    rng = np.random.RandomState(4)
    terms = [np.minimum(rng.zipf(1.3, size=rng.randint(1, 60)), 10**6) for _ in range(300)]
    terms[7] = np.array([10**7])  # a word of one document
    words, owners = np.concatenate(terms).astype(np.uint64), np.repeat(np.arange(300), [len(t) for t in terms])
    lengths = rng.randint(1, 90, size=300).astype(float)
    plain, index = packing.Index(words, owners, lengths), packing.Index(words, owners, lengths)
    single = sum(len({k for k, t in enumerate(terms) if w in t}) == 1 for w in np.unique(words))
    assert single > 100 and len(plain.size) == len(np.unique(words)) - single and not plain.scores(7).any()
    index.step = 64
    monkeypatch.setattr(packing, "BLOCK_BYTES", 3 * 64 * 300 * 4)  # three of five blocks fit
    unused = np.ones(300, bool)
    for doc in rng.permutation(300)[:250].tolist():
        unused[doc] = False
        assert np.allclose(index.scores(doc), plain.scores(doc)[index.docs], rtol=1e-5, atol=1e-5)
        if 2 * unused.sum() < len(index.docs):
            index.keep(unused)
    assert 0 < len(index.blocks) and len(index.docs) < 150
