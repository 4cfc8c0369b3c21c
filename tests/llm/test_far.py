"""Near copies at the far end of the threshold, where no segment agrees within a bit."""

import numpy as np
import pytest

import corpus_pipeline
from causalgraph.llm import simhash

#: Differing bits by segment: one segment differs in just as many as it may, the others in more.
SPREADS = [[3, 4, 4, 3, 3, 3, 3, 3, 3, 3], [4, 3, 4, 3, 3, 3, 3, 3, 3, 3], [4, 4, 3, 3, 3, 3, 3, 3, 3, 3]]
SPREADS += [[3, 3, 3] + [2 if j == k else 3 for j in range(7)] for k in range(7)] + [[2] * 10]
SPREADS += [[4, 4, 4] + [2 if j == k else 3 for j in range(7)] for k in range(7)]
SPREADS = [s for s in SPREADS if sum(s) <= simhash.MAX_DISTANCE]


def flipped(rng, a, spread):
    b = a.copy()
    for x, y, n in zip(simhash.CUTS, simhash.CUTS[1:], spread):
        b[rng.choice(np.arange(x, y), n, replace=False)] ^= 1
    return b


def roots(spark, sigs):
    signed = spark.createDataFrame([(np.packbits(x).tobytes(),) for x in sigs], "sig binary")
    sids = {r.sig: r.sid for r in signed.withColumn("sid", simhash._sid("sig")).collect()}
    linked = {r.sid: r.root for r in simhash.signature_groups(signed).collect()}
    return [linked.get(sids[np.packbits(x).tobytes()]) for x in sigs]


def test_every_pair_within_the_threshold_is_linked(spark):
    rng, sigs = np.random.default_rng(4), []
    for spread in SPREADS * 12:
        a = rng.integers(0, 2, simhash.BITS).astype(np.uint8)
        sigs += [a, flipped(rng, a, spread)]
    for _ in range(200):
        a, b = rng.integers(0, 2, (2, simhash.BITS)).astype(np.uint8)
        b[:] = a
        b[rng.choice(simhash.BITS, simhash.MAX_DISTANCE, replace=False)] ^= 1
        sigs += [a, b]
    got = roots(spark, sigs)
    assert all(x is not None and x == y for x, y in zip(got[::2], got[1::2]))
    assert len(set(got)) == len(sigs) // 2


@pytest.mark.parametrize("large", [1 << 14, 0])
def test_values_of_many_members_are_compared_too(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2, simhash.BITS).astype(np.uint8)
    many = [flipped(rng, a, [0] + [rng.integers(2) for _ in range(9)]) for _ in range(200)]
    sigs = many + [flipped(rng, a, [3] + [1] * 9), flipped(rng, a, [3] + [12] * 9)]
    sig = np.stack([np.packbits(x) for x in sigs]).view(np.uint64)
    root = np.array([1] * 100 + list(range(2, 104)))
    block = simhash.blocks(32)[next(j for j, (x, _, i, k, _) in enumerate(simhash.blocks(32)) if x == 0 and (sigs[-2][i:k] == a[i:k]).all())]
    got = simhash.across(np.zeros(len(sigs), np.int64), root, sig, block, 32)
    near = {int(r) for r, s in zip(root[:200], sig) if np.bitwise_count(s ^ sig[200]).sum() <= 32}
    reached, front = {102}, [102]
    while front:
        x = front.pop()
        for y in {int(q) for e in got for q in e if x in e} - reached:
            reached.add(y)
            front.append(y)
    assert near <= reached and 103 not in reached


def test_a_bit_beyond_the_threshold_is_not_linked(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, simhash.BITS).astype(np.uint8)
    far = flipped(rng, a, [2, 2, 2, 2, 2, 2, 2, 2, 2, 15])
    assert roots(spark, [a, far]) == [None, None]


@pytest.mark.parametrize("most", [0, 5, 19, 20, 29, 32, 45])
def test_allowances_leave_no_pair(most):
    allowed = simhash.allowances(most)
    assert sum(t + 1 for t in allowed) == most + 1 and len(allowed) == simhash.SEGMENTS


def test_groups_against_all_pairs_of_far_copies(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(120):
        own = [f"w{i}_{k}" for k in range(120)]
        texts.append(" ".join(own))
        for n in (2, 3, 4, 5, 6):
            other = own.copy()
            for k in rng.choice(120, n, replace=False):
                other[k] = f"x{i}_{n}_{k}"
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = simhash.brute_groups(list(range(len(texts))), texts)
    got = {(r.doc_id, r.keep_id) for r in simhash.groups(docs).collect()}
    assert got == set(zip(want.doc_id.tolist(), want.keep_id.tolist())) and len(got) > 300


def test_the_stage_keeps_one_of_far_copies(spark):
    rng = np.random.default_rng(8)
    texts = []
    for i in range(150):
        own = [f"w{i}_{k}" for k in range(120)]
        other = own.copy()
        for k in rng.choice(120, 5, replace=False):
            other[k] = f"x{i}_{k}"
        texts += [" ".join(own), " ".join(other)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = simhash.brute_groups(list(range(len(texts))), texts)
    gone = set(want[want.doc_id != want.keep_id].doc_id.tolist())
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == set(range(len(texts))) - gone and len(gone) > 50
