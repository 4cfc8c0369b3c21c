"""Cross-parsing costs little for an array that holds nothing of a document, however many there are."""

import random

import numpy as np

from causalgraph.llm import crossparse
from tests.llm.test_whole import brute_phrases


def shard(texts, first):
    hasher = crossparse.Hasher()
    return crossparse.Shard.build(list(range(first, first + len(texts))), [hasher(t) for t in texts])


def batch(texts):
    tokens = np.concatenate([crossparse.Hasher()(t) for t in texts])
    n = max(len(tokens), 30_000) + 1
    return crossparse.Batch(tokens, np.array([len(t) for t in texts]), crossparse.powers(n), crossparse.powers(n, crossparse.INVERSE))


def test_arrays_without_a_longer_run_are_hardly_searched(monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(2000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    mine, searched, numbered = [text(2000) for _ in range(5)], [], []
    longest, unique = crossparse.Shard.longest, np.unique
    monkeypatch.setattr(crossparse.Shard, "longest", lambda self, *a: searched.append(len(a[-1])) or longest(self, *a))
    b = batch(mine)
    shards = [shard([text(2000) for _ in range(10)], 10 * k) for k in range(20)]
    monkeypatch.setattr(np, "unique", lambda *a, **k: numbered.append(1) or unique(*a, **k))
    for s in shards:
        b.meet(s, np.full(5, -1))
    # About half a percent of the pairs of words are in an array of 20,000 words; a filter lets by few others.
    assert sum(searched) < 0.05 * 20 * 10_000 and not numbered


def test_many_arrays_give_the_runs_of_one():
    rng = random.Random(5)
    texts = [rng.choices("abcde", k=rng.randrange(1, 80)) for _ in range(40)]
    texts[9] = texts[4]
    texts[11] = texts[4] + texts[5]
    for size in (1, 3, 40):
        b = batch(texts)
        for k in range(0, 40, size):
            s = shard(texts[k : k + size], k)
            b.meet(s, s.index(list(range(40))))
        at, steps = 0, b.best.tolist()
        for i, t in enumerate(texts):
            end, count = at + len(t), 0
            p = at
            while p < end:
                p, count = p + steps[p], count + 1
            assert p == end and count == brute_phrases(t, [x for j, x in enumerate(texts) if j != i])
            at = end
