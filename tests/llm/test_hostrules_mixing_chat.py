"""Operators 2, 5 and 8: small cases, and their SQL over the smallest tables is held against
the queries by test_oracles."""

from __future__ import annotations

import math

from quarrylight.llm import chat, hostrules, mixing

DOCS = "doc_id long, text string, source string, lang string, keep string, host string"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", "k", "h") for r in rows], DOCS)


GOOD = "the quick brown fox jumps over one lazy dog and runs far away from here today"


def test_rules_flag_each_kind_of_junk(spark):
    rows = [
        (1, GOOD, "a"), (2, "WOW!! BUY!! NOW!! " * 10, "a"), (3, " | ".join("abcdefghijkl"), "a"), (4, "spam spam spam spam " * 10, "a"),
        (5, None, "a"), (6, "  \n ", "a"), (7, "ok", None), (7, "ok", None),
    ]
    # most of these rows are junk, so that both hosts would be bad: only the rules count here
    got = {(r["doc_id"], r["keep"]) for r in hostrules.judge(docs(spark, rows), bad_rate=1.1).collect()}
    assert got == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True)}
    kept = hostrules.filter_documents(docs(spark, rows), bad_rate=1.1)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 7]


def test_host_verdicts_shrink_towards_the_corpus(spark):
    bad = "JUNK!! JUNK!! TRASH!! " * 10
    rows = [(i, GOOD + str(i), "good") for i in range(200)] + [(1000 + i, bad, "bad") for i in range(60)] + [(2000, bad, "tiny"), (2001, GOOD, "tiny")]
    rows += [(3000 + i, GOOD, "bad") for i in range(3)]
    out = hostrules.judge(docs(spark, rows)).collect()
    verdict = {r["host"]: r["host_verdict"] for r in out}
    rate = {r["host"]: r["host_rate_ppm"] / 1e6 for r in out}
    assert verdict["bad"] == "bad" and verdict["tiny"] in ("watch", "bad")
    assert rate["bad"] < 60 / 63 + 1e-6 and 61 / 265 < rate["tiny"] <= 0.5 + 0.01  # pulled from 1/2 towards the corpus
    assert not any(r["keep"] for r in out if r["host"] == "bad")  # clean ones too: the whole host goes
    assert all(r["keep"] for r in out if r["host"] == "good")


def test_empty_tables(spark):
    none = docs(spark, [])
    assert hostrules.judge(none).count() == 0
    assert hostrules.filter_documents(none).columns == none.columns
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mix(none, labels).count() == 0
    assert mixing.mix_documents(none, labels).columns == none.columns
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_mix(rows, quality, alpha, ratio):
    import hashlib

    toks = {}
    for i, text, source in rows:
        flat = (text or "").replace("\n", " ")
        n = len(flat) - len(flat.replace(" ", "")) + 1 if flat.strip(" ") else 0
        if n:
            h = hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()
            u = (int(h[:13], 16) + 0.5) / 2**52
            w = {1: mixing.W_GOOD, 0: mixing.W_BAD}.get(quality.get(i), mixing.W_UNKNOWN)
            toks.setdefault(source or "", []).append((-math.log(u) / w, i if i is not None else -1, n))
    total = {s: sum(n for *_, n in v) for s, v in toks.items()}
    sw = sum(t**alpha for t in total.values())
    out = []
    for s, v in toks.items():
        budget = math.floor(total[s] ** alpha / sw * sum(total.values()) * ratio + 0.5)
        epochs, rest, before = budget // total[s], budget % total[s], 0
        for _, i, n in sorted(v):
            c = epochs + (before < rest)
            before += n
            if c:
                out.append((i, s, n, c))
    return sorted(out)


def test_mixing_equals_a_sort_of_each_source(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), "abc"[min(i % 7, 2)]) for i in range(400)] + [(900, None, "a"), (901, "", "b"), (902, " ", None), (903, "x y", None)]
    quality = {i: i % 2 for i in range(0, 400, 3)}
    labels = spark.createDataFrame([(i, q) for i, q in quality.items()] + [(3, None), (None, 1), (6, 0)], "doc_id long, quality int")
    for alpha, ratio in ((0.7, 1.0), (0.0, 2.5), (1.0, 0.3)):
        got = mixing.mix(docs(spark, rows), labels, alpha, ratio).collect()
        assert sorted((r["doc_id"], r["source"], r["n_tokens"], r["copies"]) for r in got) == brute_mix(rows, quality, alpha, ratio)
        full = mixing.mix_documents(docs(spark, rows), labels, alpha, ratio)
        assert full.count() == sum(r["copies"] for r in got) and full.columns == docs(spark, rows).columns


def test_mixing_repeated_rows_and_named_weights(spark):
    rows = [(1, "a b c", "s")] * 4 + [(2, "d e", "t")] * 2
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = mixing.mix(docs(spark, rows), labels, weights={"s": 1.0}).collect()
    # only s is named: all 16 tokens go to its 12: one epoch, and the tied rows are taken together
    assert {r["source"] for r in got} == {"s"} and [r["copies"] for r in got] == [2, 2, 2, 2]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, error string")


def test_chat_machine_and_segments(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", None),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "user", "a"), (4, 0, "assistant", "a"), (5, 0, "user", "a"), (5, 0, "assistant", "b"),
        (6, None, "user", "a"), (7, 0, None, "a"), (8, 0, "user", "q"), (8, 1, "assistant", "x"), (8, 2, "tool", "t"), (8, 3, "assistant", "y"),
        (9, 0, "wizard", "a"), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
    ]
    out = chat.format_chats(chats(spark, rows)).collect()
    errors = {r["conv_id"]: r["error"] for r in out}
    assert errors == {
        1: None, 2: "bad order", 3: "unfinished", 4: "bad order", 5: "repeated turn", 6: "null turn", 7: "bad order", 8: None, 9: "bad order", None: None,
    }
    one = sorted((r["segment"], r["text"], r["loss"]) for r in out if r["conv_id"] == 1)
    assert "".join(t for _, t, _ in one) == "<|begin|>system\nbe kind<|end|>\n<|begin|>user\nhi<|end|>\n<|begin|>assistant\n<|end|>\n"
    assert [loss for *_, loss in one] == [0] * 7 + [1, 1]
    assert all(r["segment"] == -1 and r["text"] is None for r in out if r["error"])


def test_chat_other_machine_and_head(spark):
    m = chat.Machine("s", {"s": {"q": "one"}, "one": {"q": "two"}, "two": {"a": "end"}}, frozenset({"end"}))
    t = chat.Template({"q": [("{text}?", 0)] and [("{text}", 0)], "a": [("{text}", 1)]}, head=[("<s>", 0)])
    out = chat.format_chats(chats(spark, [(1, 0, "q", "x"), (1, 1, "q", "y"), (1, 2, "a", "z"), (2, 0, "q", "x"), (2, 1, "a", "y")]), m, t).collect()
    assert "".join(r["text"] for r in sorted(out, key=lambda r: r["segment"]) if r["conv_id"] == 1) == "<s>xyz"
    assert [r["error"] for r in out if r["conv_id"] == 2] == ["bad order"]
