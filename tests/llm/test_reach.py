"""Cross-parsing searches little of a copy and tells tokens as TOKEN does; runs are those of all pairs of texts."""

import random

import numpy as np

from causalgraph.llm import crossparse
from tests.llm.test_arrays import batch, shard


def test_a_copy_in_every_array_is_searched_in_few_places(monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(5000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    mine, searched = text(3000), []
    longest = crossparse.Shard.longest
    monkeypatch.setattr(crossparse.Shard, "longest", lambda self, *a: searched.append(len(a[-1])) or longest(self, *a))
    b = batch([mine])
    for k in range(20):
        b.meet(shard([text(50) + mine[:2000] + text(50), text(500)], 10 * k), np.array([-1]))
    # Positions of the copy all pass the filters of their first words.
    assert b.best[:1990].tolist() == list(range(2000, 10, -1)) and sum(searched) < 1000


def longest_runs(texts, i):
    """The longest run from each position of a text in any other, by comparison of all pairs of positions."""
    mine, out = texts[i], np.ones(len(texts[i]), int)
    for j, other in enumerate(texts):
        if j != i:
            row = [0] * (len(other) + 1)
            for a in range(len(mine) - 1, -1, -1):
                row = [row[b + 1] + 1 if mine[a] == other[b] else 0 for b in range(len(other))] + [0]
                out[a] = max(out[a], *row)
    return out.tolist()


def test_runs_of_copies_and_own_documents():
    rng = random.Random(7)
    for words in ("ab", "abcdefgh", [f"w{k}" for k in range(60)]):
        texts = [rng.choices(words, k=rng.randrange(1, 90)) for _ in range(16)]
        texts[3] = texts[1][:40] + texts[2][10:]
        texts[5] = texts[4][:]
        texts[6] = ["x"] * 70
        texts[7] = texts[0] + texts[0]
        for t in texts[8:12]:
            t[20:20] = texts[1][5:60]
        want = [n for i in range(16) for n in longest_runs(texts, i)]
        for size in (1, 5, 16):
            b = batch(texts)
            for k in range(0, 16, size):
                s = shard(texts[k : k + size], k)
                b.meet(s, s.index(list(range(16))))
            assert b.best.tolist() == want


def test_tokens_of_odd_texts(monkeypatch):
    rng, known = random.Random(8), {}
    odd = "ab_1é \n\t.,-'\x00\x1c\x85²́ำ​ 中\U0001f600\U00020000"
    for size in (8, 1 << 18):
        monkeypatch.setattr(crossparse.Hasher, "CHARS", size)
        hasher = crossparse.Hasher()
        for _ in range(300):
            texts = ["".join(rng.choices(odd, k=rng.randrange(50))) for _ in range(rng.randrange(6))]
            for text, hashes in zip(texts, hasher.texts(texts), strict=True):
                for token, h in zip(crossparse.TOKEN.findall(text), hashes.tolist(), strict=True):
                    assert known.setdefault(token, h) == h
    assert len(set(known.values())) == len(known) > 1000
