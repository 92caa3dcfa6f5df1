"""Small tables with the cases that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` string, score string, fp string, kept string, copy string, `__text` string"
WORDS = "the of and river stone cloud idea Ältere größer niño année forest metal quiet seven".split()


def rows(n=60, seed=5):
    rnd = random.Random(seed)
    made = []
    for i in range(n):
        text = "\n".join(" ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(rnd.randrange(3, 14))) for _ in range(rnd.randrange(1, 7)))
        made.append((i, text, "en", f"s{i % 3}"))
    made += [(1000, None, None, None), (1001, "", "en", "s0"), (1002, " \n\t", "de", "s1"), (None, "no id here at all", "en", "s1"), (None, None, None, "s1")]
    made += [made[3], made[3], (1003, made[3][1], "en", None), (1004, made[7][1], "en", "s2"), (1005, "word " * 30_000, "en", "s0"), (1006, "a\x0bb\x0cc d #$%", "en", "s9")]
    return [(i, t, la, s, None if t is None else len(t), "x", "y", "z", "k", "c", "w") for i, t, la, s in made]


def table(spark, n=60):
    return spark.createDataFrame(rows(n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
