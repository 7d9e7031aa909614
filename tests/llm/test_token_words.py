"""op11: plain words go to the library's model without its splitter; a block's steps are found at once."""

import random

import numpy as np

import public_tokenizers
from mailflow.llm import mixcoder, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plain_words_pass_the_librarys_splitter_by(monkeypatch):
    encode = token_files.Encoder(PATH)
    texts = ["words of plain naïve letters\nŸŁɏ Ġx and more.", "more, words of letters"]
    want = encode.whole(texts)
    asked, whole = [], encode.whole
    monkeypatch.setattr(encode, "whole", lambda given: asked.extend(given) or whole(given))
    assert encode(texts) == want
    assert not any(c.isalpha() for t in asked for c in t)


def test_uneven_texts_beside_even_ones_give_the_librarys_ids():
    encode = token_files.Encoder(PATH)
    pick = random.Random(0)
    for _ in range(60):
        texts = ["".join(pick.choices("ab é\n\t .,'1\x85ßsxĠɏ　\r-_", k=pick.randrange(25))) for _ in range(40)]
        assert encode(texts) == encode.whole(texts)
        assert all(s and not s[1:].count(" ") and s != "\n" for s in encode.known)


def test_steps_found_at_once_are_those_of_the_model():
    rng = np.random.default_rng(2)
    blocks = [np.tile(rng.integers(0, 90, 150), 8), np.minimum(rng.zipf(1.3, 700), 500), np.arange(257), np.zeros(65, int), np.ones(1, int)]
    alphabets, symbols = zip(*(np.unique(b, return_inverse=True) for b in blocks))
    symbols, sizes = [s + 1 for s in symbols], [len(a) for a in alphabets]
    start, freq = mixcoder._all_steps(symbols, sizes)
    for j, (s, size) in enumerate(zip(symbols, sizes)):
        model, done = mixcoder._Model(np.array([size])), 0
        for t, _, again in mixcoder._steps(np.array([len(s)])):
            if again:
                model.refresh(t, s[done:t, None])
                done = t
            model.predict()
            low, width = model.span(s[t:t + 1])
            assert (low[0], width[0]) == (start[j, t], freq[j, t])
            model.learn(s[t:t + 1])
