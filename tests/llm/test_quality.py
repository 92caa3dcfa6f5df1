import re
from collections import Counter, defaultdict

from strataloom.llm import quality
from tests.llm import helpers


def brute_repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(hit)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def norm(line):
    return re.sub("[0-9]+", "0", " ".join(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(line)))


def brute(rows, max_docs, max_share, min_words, min_left):
    docs, hosts = defaultdict(set), defaultdict(set)
    for i, t, _, s, *_ in rows:
        hosts[s].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                docs[s, norm(line)].add(t or "")
    out = Counter()
    for i, t, _, s, *_ in rows:
        words, lines = words_of(t), (t or "").split("\n")
        gone = [x for x in lines if norm(x) and len(docs[s, norm(x)]) > max_docs and len(docs[s, norm(x)]) > max_share * len(hosts[s])]
        left = len(words) - sum(len(words_of(x)) for x in gone)
        seen, dups = set(), 0
        for x in lines:
            if words_of(x):
                dups += x in seen
                seen.add(x)
        n = brute_repeats(words)
        failed = len(words) < 10 or 100 * n > 20 * len(words)
        kept = not failed and left >= min_words and left >= min_left * len(words)
        out[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dups, n, len(gone), left, failed, kept)] += 1
    return out


def boilerplate(rows):
    return [(i, f"{t}\nSign in 12 times" if t and i is not None and i % 2 else t, *rest) for i, t, *rest in rows]


def test_against_brute_force(spark):
    rows = boilerplate(helpers.rows())
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    got = quality.judged_documents(docs, max_docs=3, max_share=0.1, min_words=5, min_left=0.5)
    want = brute(rows, 3, 0.1, 5, 0.5)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(x[6] for x in want) and any(x[-1] for x in want)


def test_kept_documents_lose_lines_above_limits_only(spark):
    rows = boilerplate(helpers.rows())
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    got = quality.kept_documents(docs, max_docs=3, max_share=0.1)
    assert got.columns == docs.columns
    texts = {i: t for i, t, *_ in rows}
    for r in got.collect():
        assert r.text == "\n".join(x for x in texts[r.doc_id].split("\n") if not x.startswith("Sign in") or r.source is None) and r.n_chars == len(r.text) and r.kept == "k"


def test_no_rows(spark):
    assert quality.judged_documents(helpers.empty(spark)).count() == 0
    assert quality.kept_documents(helpers.empty(spark)).count() == 0


def test_long_repetitive_text_is_covered_whole():
    assert quality.words_in_repeats(["a"] * 50_000) == 50_000
    assert quality.words_in_repeats(list("abcdefgabcdexyz")) == brute_repeats(list("abcdefgabcdexyz")) == 10


def test_lines_are_joined_by_host_where_there_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    rows = [(i, t, la, "one host", *rest) for i, t, la, _, *rest in boilerplate(helpers.rows())]  # which holds every row
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    got = quality.judged_documents(docs, max_docs=3, max_share=0.1, min_words=5, min_left=0.5)
    want = brute(rows, 3, 0.1, 5, 0.5)
    assert Counter(tuple(r) for r in got.collect()) == want and any(x[6] for x in want)
    kept = quality.kept_documents(docs, max_docs=3, max_share=0.1)
    assert not any(line.startswith("Sign in") for r in kept.collect() for line in r.text.split("\n"))
