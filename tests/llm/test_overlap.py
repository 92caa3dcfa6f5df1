import random

import pytest

from strataloom.llm import overlap, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = text.lower().split()
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([" ".join(words)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited_texts(seed, groups=12, copies=14, words=300, most=9):
    """Groups of texts of which each has up to so many words of its base changed: overlaps lie on both sides of 0.8."""
    rnd, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for at in rnd.sample(range(words), rnd.randrange(most)):
                text[at] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(text))
    rnd.shuffle(texts)
    return texts


def first_ids(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard(a, b) >= 0.8 and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i in range(len(sets)) if root(i) == i}


def stay(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id for r in simhash.first_of_each_group(docs).collect()}


def test_near_copies_at_the_limit_are_all_found(spark):
    """Pairs of texts that overlap by 0.80 to 0.85 and have no other partner: each has its second text removed."""
    rnd, texts = random.Random(1), []
    for _ in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        for at in range(10, 10 + 40 * 6, 40):  # six words: 30 of 296 shingles, 266 / 326 = 0.816
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts += [" ".join(base), " ".join(copy)]
    assert all(0.8 <= jaccard(shingles(a), shingles(b)) < 0.85 for a, b in zip(texts[::2], texts[1::2]))
    assert stay(spark, texts) == set(range(0, 120, 2))

def test_texts_without_a_partner_at_the_limit_stay(spark):
    """Pairs of texts that overlap by 0.70 to 0.80: nothing is removed."""
    rnd, texts = random.Random(2), []
    for _ in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        for at in range(10, 10 + 35 * 8, 35):  # eight words: 40 of 296 shingles, 256 / 336 = 0.762
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts += [" ".join(base), " ".join(copy)]
    assert all(0.7 <= jaccard(shingles(a), shingles(b)) < 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert stay(spark, texts) == set(range(120))


@pytest.mark.parametrize("pairwise,block", [(12, 2048), (3, 4), (1000, 2048), (0, 2048)])
def test_stage_against_brute_force_overlap(spark, monkeypatch, pairwise, block):
    monkeypatch.setattr(overlap, "PAIRWISE", pairwise)
    monkeypatch.setattr(overlap, "BLOCK", block)
    texts = edited_texts(3)
    want = first_ids(texts)
    assert 20 < len(want) < len(texts) - 60
    assert stay(spark, texts) == want


def templated(n, own, seed=5, words=200, pool=None):
    """Texts of one template: common words, then own ones (or drawn from a pool of passages)."""
    rnd = random.Random(seed)
    body = [f"body{i}" for i in range(words - own)]
    passages = [[f"p{k}w{i}" for i in range(own // 2)] for k in range(pool or 0)]
    ends = [sum(rnd.sample(passages, 2), []) if pool else [f"own{rnd.randrange(10**9)}" for _ in range(own)] for _ in range(n)]
    return [" ".join(body + end) for end in ends]


def test_pages_of_one_template_meet_nowhere_by_rare_shingles(spark):
    texts = templated(150, 30)
    assert jaccard(shingles(texts[0]), shingles(texts[1])) > 0.7
    assert stay(spark, texts) == set(range(150))
    sets = spark.createDataFrame([(i, overlap.np.unique(overlap.shingle_set(t).astype("<u4")).tobytes()) for i, t in enumerate(texts)], "__entry long, __set binary")
    firsts = overlap.first_shingles(sets.selectExpr("__entry", "__entry AS label"), sets, 0.8).collect()
    assert not any(k < r.leading for r in firsts for k in r.shared)  # but where two shingles fall into one cell


@pytest.mark.parametrize("pairwise,block", [(12, 2048), (2, 5), (0, 2048)])
def test_templates_with_passages_and_longer_copies_against_brute_force(spark, monkeypatch, pairwise, block):
    monkeypatch.setattr(overlap, "PAIRWISE", pairwise)
    monkeypatch.setattr(overlap, "BLOCK", block)
    rnd = random.Random(8)
    texts = templated(60, 40, pool=9) + templated(40, 30, seed=6)
    base = [f"g{rnd.randrange(10**6)}" for _ in range(250)]
    texts += [" ".join(base + [f"tail{rnd.randrange(10**6)}" for _ in range(k)]) for k in range(0, 70, 2)]  # of other sizes, on both sides of the limit
    texts += [" ".join(base[k : k + 210]) for k in range(0, 40, 3)]
    rnd.shuffle(texts)
    want = first_ids(texts)
    assert stay(spark, texts) == want and 40 < len(want) < len(texts) - 30


def test_a_filter_of_bounded_size_loses_no_key(spark):
    from pyspark.sql import functions as F

    from strataloom.llm import common

    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), "id", F.lit("text").alias("t"))
    keys = rows.where("id % 50 = 0").select("k")
    got = {r.id for r in common.that_may_meet(rows, keys, "k").collect()}
    assert got >= set(range(0, 20_000, 50)) and len(got) < 2000
    assert common.that_may_meet(rows, keys.where("FALSE"), "k").count() == 0 and common.that_may_meet(rows.where("FALSE"), keys, "k").count() == 0


def test_stage_where_what_is_asked_for_is_not_broadcast(spark, monkeypatch):
    from strataloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    texts = edited_texts(4, groups=6)
    assert stay(spark, texts) == first_ids(texts)


def entries_of(spark, texts):
    sets = [overlap.shingle_set(t) for t in texts]
    return spark.createDataFrame([(i, overlap.majority(overlap.bit_counts(s), len(s))) for i, s in enumerate(sets)], "__entry long, __fp long")


def test_candidates_come_from_the_fingerprint_index(spark):
    """Texts with a word changed meet by their fingerprints; every candidate shares the bytes and is within the bits, and each fingerprint has two at most."""
    rnd, texts = random.Random(9), []
    for _ in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:150], "other", *base[151:]])]
    entries = entries_of(spark, texts)
    fp = {r[0]: r[1] % (1 << 64) for r in entries.collect()}
    pairs = [tuple(sorted(r)) for r in simhash.fingerprint_pairs(entries).collect()]
    for a, b in pairs:
        x = fp[a] ^ fp[b]
        assert x.bit_count() <= simhash.NEAR_BITS and x.to_bytes(8, "little").count(0) >= simhash.NEAR_BYTES
    meant = {(i, i + 1) for i in range(0, 80, 2)}
    can = {(a, b) for a, b in meant if (x := fp[a] ^ fp[b]).bit_count() <= simhash.NEAR_BITS and x.to_bytes(8, "little").count(0) >= simhash.NEAR_BYTES}
    assert len(can) > 35 and can <= set(pairs) and len(pairs) <= 2 * len(texts)


def test_stage_links_by_fingerprints_where_bands_give_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    whole = overlap.distinct_entries
    monkeypatch.setattr(overlap, "distinct_entries", lambda *a: whole(*a).withColumn("__bands", F.slice("__bands", 1, 0)))
    rnd, texts = random.Random(10), []
    for _ in range(30):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:150], "other", *base[151:]])]
    got = stay(spark, texts)
    assert got >= set(range(0, 60, 2)) and len(got) < 34  # 60 before there was a fingerprint index


def test_candidates_of_a_large_group_grow_with_its_entries(spark):
    """A group of near copies fills postings of every combination; no fingerprint gets more than two candidates."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(300)]
    pairs = [tuple(sorted(r)) for r in simhash.fingerprint_pairs(entries_of(spark, texts)).collect()]
    assert 280 < len(pairs) <= 600 and len({i for p in pairs for i in p}) > 280
    assert stay(spark, texts) == {0}
