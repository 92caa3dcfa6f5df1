import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from strataloom.llm import components, simhash
from tests.llm import helpers


def brute_fingerprint(text, n=4, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), seed)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def brute_groups(fps, bits):
    return grouped(fps, lambda a, b: (a ^ b).bit_count() <= bits)


def brute_wide_groups(entries, bits, shared):
    """Entries of several fingerprints: one has so many bytes in common, and all differ in so many bits at most."""

    def linked(a, b):
        x = [p ^ q for p, q in zip(a, b)]
        return sum(y.bit_count() for y in x) <= bits and any(y.to_bytes(8, "little").count(0) >= shared for y in x)

    return grouped(entries, linked)


def grouped(things, linked):
    u = sorted(set(things))
    up = {x: x for x in u}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if linked(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in u}


def test_fingerprints_and_components(spark):
    rows = helpers.rows(40)
    texts = [t for _, t, *_ in rows]
    fps = [brute_fingerprint(t) for t in texts]
    groups = brute_groups(fps, 4)
    least = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            least[groups[f]] = min(least.get(groups[f], i), i)
    want = Counter((r[0], f"{f:016x}", least.get(groups[f])) for r, f in zip(rows, fps))
    assert Counter(tuple(r) for r in simhash.simhash_components(helpers.table(spark, 40)).collect()) == want


@pytest.mark.parametrize("bits,limit", [(4, 16), (6, 4096)])
def test_links_reach_all_that_brute_force_links(spark, bits, limit):
    rnd, points = random.Random(bits), set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rnd.randrange(8)):
                x ^= 1 << rnd.randrange(64)
            points.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in points}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    links = simhash.fingerprint_links(df, bits, limit)
    labels = {r.u: r.v for r in components.component_labels(links).collect()}
    mine, brute = {}, {}
    groups = brute_groups(points, bits)
    for x, s in signed.items():
        mine.setdefault(labels.get(s, s), set()).add(x)
        brute.setdefault(groups[x], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_tally_retains_and_bits_verify():
    a = np.array([[0], [0], [0]], dtype=np.uint64)
    b = np.array([[0x0101010100000000], [0x0F00000000000000], [0x0101010101000000]], dtype=np.uint64)
    positions = simhash.shared_positions(a, b)
    assert [int(p).bit_count() for p in positions[:, 0]] == [4, 7, 3]
    assert simhash.retained(positions, 4).tolist() == [True, True, False]
    entries = np.stack([a[:, 0], b[:, 0]], axis=1)[:, :, None]
    first, combos = simhash.first_combinations(4), len(simhash.byte_masks(4))
    links = [simhash.linked_pairs(entries[[r]], np.array([c]), 2, 4, 4, first, combos)[0] for r in range(3) for c in range(combos)]
    assert sum(map(len, links)) == 2  # each link once, and none below the minimum


def test_forest_connects_what_is_linked():
    fps = np.array([0, 1, 3, 7, 15, 3 << 40, (3 << 40) + 1], dtype=np.uint64)
    a, b = simhash.forest(fps[:, None], 1, 7)
    assert len(a) == 5 and all((int(x) ^ int(y)).bit_count() <= 1 for x, y in zip(a[:, 0], b[:, 0]))


@pytest.mark.parametrize("limit", [16, 4096])
def test_links_of_several_fingerprints(spark, limit):
    rnd, points = random.Random(3), set()
    for _ in range(8):
        centre = [rnd.getrandbits(64) for _ in range(3)]
        for _ in range(40):
            flips = [sum(1 << b for b in rnd.sample(range(64), rnd.randrange(18))) for _ in centre]
            points.add(tuple(c ^ f for c, f in zip(centre, flips)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([tuple(map(signed, p)) for p in points], "fp long, fp1 long, fp2 long")
    labels = {r.u: r.v for r in components.component_labels(simhash.fingerprint_links(df, 31, limit, 3)).collect()}
    mine, brute = {}, {}
    groups = brute_wide_groups(points, 31, 3)
    for r in df.withColumn("id", simhash.entry_id(df.columns)).collect():
        p = tuple(x % (1 << 64) for x in r[:3])
        mine.setdefault(labels.get(r.id, r.id), set()).add(p)
        brute.setdefault(groups[p], set()).add(p)
    assert len(brute) > 20 and sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(9000, 9001)], "a long, b long").repartition(8)
    got = {r.u: r.v for r in components.component_labels(links).collect()}
    assert got == {i: 0 for i in range(1, 3001)} | {9001: 9000}


def test_stars_settle_without_one_task_seeing_all_links(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 40)
    rnd = random.Random(1)
    pairs = [(i, rnd.randrange(max(0, i - 5), i)) for i in range(1, 400) if i % 50]
    got = {r.u: r.v for r in components.component_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}
    for a, b in pairs:
        up[a] = b
    for i in range(400):
        x = i
        while x in up:
            x = up[x]
        assert got.get(i, i) == x


def test_first_of_each_group_keeps_columns(spark):
    docs = helpers.table(spark, 30)
    got = simhash.first_of_each_group(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert 3 in ids and 1003 not in ids and 1004 not in ids and ids.count(3) == 3


def test_one_row_stays_where_ids_are_null_or_stand_for_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a), (None, a + " more"), (2, b), (5, b + " more"), (5, "something else that is long enough to be a text"), (None, b)]
    got = simhash.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text[:9]) for r in got) == [(False, 2, "b0 b1 b2 "), (False, 5, "something"), (True, 0, "a0 a1 a2 ")]


def test_no_rows(spark):
    assert simhash.simhash_components(helpers.empty(spark)).count() == 0
