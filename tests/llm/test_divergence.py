import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import divergence
from tests.llm import helpers

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = Counter()
    for lang in {k[0] for k in n}:
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: E731, B023
        shares = {}
        of_lang = Counter()
        for (la, source), counts in n.items():
            if la == lang:
                of_lang.update(counts)
        for (la, source), counts in n.items():
            if la == lang:
                total = sum(counts[t] for t in kept)
                shares[source] = {t: share(counts[t], total) for t in kept}
        q = {t: share(of_lang[t], sum(of_lang[t] for t in kept)) for t in kept}
        for source, p in shares.items():
            pairs = [(-sum(abs(p[t] - other[t]) for t in kept), name.encode()) for name, other in shares.items() if name != source]
            terms = [(q[t] - p[t], t.encode()) for t in kept if n[lang, source][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                for rank, (v, item) in enumerate(found, 1):
                    out[lang, source, part, item.decode(), -v, rank] += 1
    return out


def rows(sources=7):
    made = [(i, t, la, None if s is None else f"src{(i or 0) % sources}", *rest) for i, t, la, s, *rest in helpers.rows(120)]
    extra = [(5000 + i, "Ärger ÄRGER ærø\x00b c1d" * (i % 3), "de", f"g{i % 4}", None, *"xyzkcw") for i in range(40)]
    return made + extra + [(6000, "123 !?", "xx", "only", None, *"xyzkcw"), (6001, None, "yy", "a", None, *"xyzkcw"), (6002, "", "yy", "b", None, *"xyzkcw")]


@pytest.mark.parametrize(("block", "team", "at_once", "held"), [(4096, 8, 8, 200_000), (3, 1, 2, 5), (5, 3, 1, 40)])
def test_against_brute_force(spark, monkeypatch, block, team, at_once, held):
    for name, value in (("BLOCK_TERMS", block), ("TEAM", team), ("ROUNDS_AT_ONCE", at_once), ("HELD_TERMS", held)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows(), helpers.SCHEMA)
    got = Counter(tuple(r) for r in divergence.divergence(docs, min_docs=6, top=4).collect())
    want = brute(rows(), 6, 4)
    assert got == want
    assert {k[0] for k in got if k[2] == "term"} >= {"en", "de"} and any(k[0] == "yy" and k[4] == 0 for k in got)


def test_every_two_teams_meet_once_in_one_place(spark):
    for teams in range(1, 12):
        m = teams + teams % 2
        plan = spark.range(teams).select(F.col("id").cast("int").alias("team"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("round"))
        met = plan.select("team", "round", divergence.meeting_place(F.col("team"), F.lit(teams), F.col("round")).alias("place")).where("place IS NOT NULL").collect()
        assert Counter(frozenset((r.team, r.place)) for r in met) == Counter([frozenset(p) for p in combinations(range(teams), 2)] + [frozenset([t]) for t in range(teams)])
        for r in range(m):
            busy = [t for x in met if x["round"] == r for t in {x.team, x.place}]
            assert len(busy) == len(set(busy))


def test_pieces_come_back_as_they_were():
    slots, shares = np.array([0, 3, 4, 900]), np.array([5, 1 << 40, 7, 1])
    whole = divergence.unpack(divergence.pack(slots, shares), 2, 1000)
    assert whole[slots].tolist() == shares.tolist() and (np.delete(whole, slots) == 2).all()
    assert (divergence.unpack(None, 9, 4) == 9).all()


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 9 * 10**15, 9 * 10**16 + 7, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_no_rows(spark):
    assert divergence.divergence(helpers.empty(spark)).count() == 0
