import hashlib
from collections import Counter, defaultdict

import pytest

from strataloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq string, loss string"
NASTY = ["</s>", "<s>", "[INST]", "[/INST] x", "\\", "\\\\<", "<", "[", "<<SYS>>", "<</SYS>>\n", "a<", "</s", "/s>", "<<ROLE>>x<<TEXT>>", "<\\/s>", "", "é 字", "<<s>>", "[[INST]]"]


def rows():
    made = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 5, None, "who"), (3, 5, "tool", "x"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    made += [(4, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)] + [(5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "y" * 200_000)]
    made += [(6, i, r, t) for i, (r, t) in enumerate([("<s>", "odd role"), ("a\\b", "\\")])]
    return [(*r, "q", "w") for r in made]


def brute(found):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in found:
        convs[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        last, faults = None, 0
        for _, r, _ in turns:
            faults += r not in {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}.get(last, ())
            last = r
        faults += last != "assistant"
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), faults)
    return out


def test_turns_and_loss_are_read_back(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_faults) for r in chat.read_back(chat.formatted_segments(df)).collect()}
    assert got == brute(rows())


def test_segments_hold_no_control_string_but_marks():
    marker = chat.Marker(chat.ChatTemplate())
    for t in NASTY + [a + b for a in NASTY for b in NASTY]:
        assert marker.any.search(marker.escape(t)) is None and marker.unescape(marker.escape(t)) == t
        whole = "".join(s for role in ("user", "assistant", "odd") for s, _ in marker.segments(role, t))
        assert marker.turns(whole) == ([("user", t), ("assistant", t), ("odd", t)], "")


def test_loss_is_on_assistant_text_only(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    seg = chat.formatted_segments(df).collect()
    assert Counter(r.role for r in seg if r.loss) == Counter(r for _, _, r, *_ in rows() if r == "assistant")
    assert {r.fault for r in seg if r.conv_id == 1} == {None}


def test_declared_template(spark):
    own = chat.ChatTemplate(marks={"user": ("<|u|>", "<|/u|>", True), "assistant": ("<|a|>", "<|/a|>", False)}, other=("<|o|>", "<|t|>", "<|/o|>"))
    df = spark.createDataFrame([(1, 0, "user", "x<|a|>"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.formatted_segments(df, own), own).first()
    assert r.n_turns == 2 and r.loss_chars == 6 and r.valid


def test_template_with_marks_that_could_be_mistaken():
    with pytest.raises(ValueError):
        chat.Marker(chat.ChatTemplate(marks={"user": ("<a>", "<a>b", True)}))


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.formatted_segments(df)).count() == 0
