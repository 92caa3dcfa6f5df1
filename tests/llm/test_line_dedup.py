import hashlib
from collections import Counter, defaultdict

import pytest

from strataloom.llm import line_dedup
from tests.llm import helpers

UPPER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_chars=10, min_docs=2, keep_first=True):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in first or (keep_first and first[key(x)] == i)]
        out[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


def crafted():
    return [
        (2000, "Shared Line here\nown words of one\nshared line HERE  ", "en", "s0"),
        (1999, "\tshared line here\x0b\nÄÖÜ äöü ß ñ\n" + "x" * 9, "en", "s0"),
        (2001, "äÖÜ äöü ß ñ\nÄÖÜ äöü ß ñ\r\n" + "x" * 9 + "\n\n", "de", None),
        (None, "shared line here\nnobody has an id here", None, None),
        (None, "nobody has an id here\nstill its own line", None, None),
        (2002, "shared line here\n" * 50_000 + "the end of it", "en", "s0"),
        (2003, "1234567890", "en", "s0"),
        (2004, "1234567890", "en", "s0"),
        (2005, "é" * 9 + "\n" + "é" * 10, "en", "s0"),
        (2006, "é" * 9 + "\n" + "é" * 10, "en", "s0"),
    ]


def rows():
    return helpers.rows() + [(*r, None, "x", "y", "z", "k", "c", "w") for r in crafted() for _ in range(2 if r[0] == 2001 else 1)]


@pytest.mark.parametrize(("heavy", "options"), [(10_000, {}), (1, {}), (10**9, {"min_docs": 3}), (50, {"keep_first": False, "min_chars": 3})])
def test_against_brute_force(spark, monkeypatch, heavy, options):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    docs = spark.createDataFrame(rows(), helpers.SCHEMA)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.without_repeated_lines(docs, **options).collect())
    assert got == brute(rows(), **options) and any(k[2] for k in got)


def test_heavy_lines_only_are_broadcast_and_rows_are_handed_over_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 7)
    many = [(i, "\n".join(["in every document", f"in pairs {i // 2:08d}", f"alone {i:08d}"]), "en", "s", 0, *"abcdef") for i in range(300)]
    docs = spark.createDataFrame(many, helpers.SCHEMA)
    monkeypatch.setattr(line_dedup, "HEAVY", 100)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.without_repeated_lines(docs).collect())
    assert got == brute(many) and Counter(k[2] for k in got) == {0: 1, 1: 149, 2: 150}


def test_carried_columns_and_no_rows(spark):
    docs = spark.createDataFrame(rows(), helpers.SCHEMA)
    kept = line_dedup.without_repeated_lines(docs, carry=("kept", "size", "doc_id", "__text"))
    assert kept.columns == ["kept", "size", "doc_id", "__text", "n_lines", "n_dropped", "kept"] and kept.count() == len(rows())
    assert line_dedup.without_repeated_lines(helpers.empty(spark)).count() == 0


def test_query_digests_what_is_kept(spark, tmp_path):
    spark.createDataFrame(rows(), helpers.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in line_dedup.op11_line_dedup(spark, str(tmp_path)).collect())
    assert got == Counter({(i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in brute(rows()).items()})
