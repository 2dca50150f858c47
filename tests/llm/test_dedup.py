"""Operators 4 and 10 against brute force and on the edges of their input."""

from __future__ import annotations

import random

import numpy as np

from quarrylight.llm import linededup, neardup
from quarrylight.llm.components import components
from quarrylight.llm.editdistance import within

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "da fe gi ho ju ka lem nip".split()]


def text(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def edit(r: random.Random, t: str, k: int) -> str:
    w = t.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def corpus(seed: int = 1):
    r = random.Random(seed)
    rows, group = [], {}
    for g in range(120):
        base = text(r, r.randrange(60, 300))
        for c in range(1 if g % 3 else r.randrange(2, 5)):
            group[len(rows)] = g
            rows.append((len(rows), base if c % 2 else edit(r, base, c)))
    return rows, group


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id long, text string, group_id int, keep string, n_chars long")


def brute_groups(sig: dict[int, np.ndarray], radius: int) -> dict[int, int]:
    ids = sorted(sig)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_have_the_recall_of_brute_force(spark):
    rows, group = corpus()
    df = frame(spark, rows)
    sig = {r["__id"]: np.frombuffer(r["__sig"], np.uint64) for r in neardup.signatures(df).collect()}
    want = brute_groups(sig, neardup.RADIUS)
    got = {r["doc_id"]: r["group_id"] for r in neardup.find(df).collect()}
    pairs = {(i, j) for i in want for j in want if i < j and want[i] == want[j]}
    assert pairs and sum(got.get(i, -1) == got.get(j, -2) for i, j in pairs) >= 0.9 * len(pairs)
    assert all(want[i] == want[g] for i, g in got.items())  # nothing is grouped that brute force does not group
    planted = {(i, j) for i in group for j in group if i < j and group[i] == group[j]}
    assert sum(got.get(i, -1) == got.get(j, -2) for i, j in planted) >= 0.95 * len(planted)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if got.get(i, i) == i}


def test_oversized_buckets_are_split_and_stay_complete(spark):
    r = random.Random(3)
    base = text(r, 400)
    rows = [(i, edit(r, base, i % 4)) for i in range(300)] + [(1000 + i, text(r, 50)) for i in range(50)]
    df = frame(spark, rows)
    nodes = neardup.signatures(df).select("__sig").distinct()
    for cap in (4, 16, 10_000):
        edges = neardup.near_pairs(nodes, nodes.count(), cap=cap)
        roots = {x["root"] for x in components(edges).collect()}
        assert len(roots) == 1
    # a leaf that no bit can split is compared in full
    sig = np.zeros((500, 4), np.uint64)
    sig[250:, 3] = np.uint64(2**64 - 1)
    a, b = neardup._links(np.array([0, 500]), sig, 10, 64)
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a, b, strict=True):
        root[find(int(x))] = find(int(y))
    assert len({find(i) for i in range(500)}) == 2


def test_near_duplicate_edges_of_input(spark):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, "... !!"), (4, "one"), (5, "one"), (None, "one"), (6, long), (7, long), (8, "alpha beta"), (8, "alpha beta"), (8, "gamma delta epsilon zeta")]
    df = frame(spark, rows)
    got = {(r["doc_id"], r["group_id"]) for r in neardup.find(df).collect()}
    assert got == {(4, 4), (5, 4), (None, 4), (6, 6), (7, 6), (8, 8)}
    kept = sorted(neardup.keep_one(df).collect(), key=str)
    assert sorted(str(r["doc_id"]) for r in kept) == sorted("1 2 3 4 6 8 8".split())
    assert neardup.find(frame(spark, [])).count() == 0 and neardup.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(200)] + [(500 + r.randrange(60), 500 + r.randrange(60)) for _ in range(80)] + [(9, 9), (None, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {i: i for p in pairs for i in p if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for p in pairs if p[0] is not None and p[0] != p[1] for i in p}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_lines_against_brute_force(spark):
    r = random.Random(11)
    lines = [text(r, r.randrange(8, 30)) for _ in range(40)]
    rows = []
    for i in range(60):
        picked = [lines[r.randrange(40)] for _ in range(r.randrange(1, 4))]
        rows.append((i, "\n".join(edit(r, x, 1) if r.random() < 0.4 else x.upper() + "!" if r.random() < 0.2 else x for x in picked)))
    df = frame(spark, rows)
    norm = {(i, n): " ".join(x.lower().replace("!", "").split()) for i, t in rows for n, x in enumerate(t.split("\n"))}
    distinct = sorted(set(norm.values()))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    similar = []
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if abs(len(a) - len(b)) < 30 and lev(a, b) <= (1 - linededup.SIMILARITY) * max(len(a), len(b)) + 1e-9:
                similar.append((a, b))
                root[find(a)] = find(b)
    first = {}
    for at in sorted(norm):
        first.setdefault(find(norm[at]), at)
    want = {at for at, x in norm.items() if first[find(x)] == at}
    after = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(df).collect()}
    kept = [" ".join(x.lower().replace("!", "").split()) for t in after.values() for x in t.split("\n")]
    assert len(want) <= len(kept) <= len(want) + 0.1 * len(similar)  # recall of at least 0.9
    assert all(kept.count(x) == 1 for x in kept)
    assert {find(x) for x in kept} == {find(x) for x in distinct}  # every group keeps one


def planted_signatures(r, pairs: int, bits: int):
    """Pairs of signatures that differ in so many bits."""
    base = r.integers(0, 2**64, (pairs, 2), dtype=np.uint64)
    other = np.unpackbits(base.view(np.uint8), axis=1)
    for row in other:
        row[r.choice(128, bits, replace=False)] ^= 1
    return base, np.packbits(other, axis=1).view(np.uint64).reshape(-1, 2)


def test_pigeonhole_guarantee_and_recall_at_every_size(spark):
    """Every pair within the radius of the blocks is a candidate, and once; at larger distances the
    planned recall holds, for any number of nodes and any length of lines."""
    r = np.random.default_rng(0)
    for words in (5, 30):
        d = round(128 * linededup.apart(words))
        rows, planted = [], {"near": set(), "planned": set()}
        for kind, bits, count in (("near", 3, 60), ("planned", d, 400)):
            for x, y in zip(*planted_signatures(r, count, bits), strict=True):
                planted[kind].add((len(rows), len(rows) + 1))
                rows += [(len(rows) + i, int(s[0].view(np.int64)), int(s[1].view(np.int64)), 0, 0, 100, words) for i, s in enumerate((x, y))]
        nodes = spark.createDataFrame(rows, "h1 long, s1 long, s2 long, s3 long, s4 long, size int, words int").repartition(4)
        for size in (1 << 12, 1 << 30, 1 << 40):
            bits, blocks = linededup.key_plan(size)
            assert min(blocks) >= 128 // bits > 3
            got = [(x["a"], x["b"]) for x in linededup.candidate_pairs(nodes, size).collect()]
            assert len(got) == len(set(got)) and planted["near"] - set(got) == set() if bits <= 32 else True
            assert len(planted["planned"] & set(got)) >= 0.87 * len(planted["planned"]), (words, size)


def test_recall_for_each_length_of_lines(spark):
    """One letter in one word of eight changed, one at least: nine of ten such pairs are linked."""
    r = random.Random(5)
    for words in (4, 6, 8, 24, 100):
        rows = []
        for i in range(120):
            w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(words)]
            rows.append((2 * i, " ".join(w)))
            for j in r.sample(range(words), max(1, words // 8)):
                k = r.randrange(len(w[j]))
                w[j] = w[j][:k] + "q" + w[j][k + 1 :]
            rows.append((2 * i + 1, " ".join(w)))
        kept = {x["doc_id"] for x in linededup.dedup_lines(frame(spark, rows)).select("doc_id").collect()}
        assert {2 * i for i in range(120)} <= kept
        assert sum(2 * i + 1 not in kept for i in range(120)) >= 0.9 * 120, words


def test_lines_without_spaces(spark):
    r = random.Random(2)
    page = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(80))
    close = page[:30] + "\u4e00" + page[31:]
    rows = [(1, page + "\nan english footer of this very site"), (2, close + "\nan english footer of this very site"), (3, "".join(reversed(page)))]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 3: rows[2][1]}


def test_columns_keep_their_values_whatever_their_names(spark):
    shared = "a line of several words that both documents have"
    rows = [(1, shared, 11, 21, 31, {"k": 1}), (2, f"{shared}\nand one more line that is its own", 12, 22, 32, {"k": 2}), (3, "three words here twice over", 13, 23, 33, {"k": 3}), (3, "three words here twice over", 13, 23, 33, {"k": 3})]
    df = spark.createDataFrame(rows, "doc_id long, text string, __rid int, __drop int, c0 int, `__n.x` map<string,int>")
    for f in (linededup.dedup_lines, neardup.keep_one):
        out = f(df)
        assert out.columns == df.columns
        got = {tuple(x)[0]: tuple(x)[2:] for x in out.collect()}
        assert got == {1: (11, 21, 31, {"k": 1}), 2: (12, 22, 32, {"k": 2}), 3: (13, 23, 33, {"k": 3})} and out.count() == 3


def test_fuzzy_line_edges_of_input(spark):
    shared = "this boilerplate sentence is on every page of the site"
    rows = [
        (1, f"{shared}\nunique first document line with words"), (2, f"short\n{shared}\n\nanother line that only this one has"), (3, shared), (4, None), (5, ""),
        (6, "x y\nx y"), (7, "x y"), (8, f"{shared}\r\nlast but not least a line of its own"), (None, shared), (9, "a row given twice for the test"), (9, "a row given twice for the test"),
    ]
    out = linededup.dedup_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {
        1: (rows[0][1], 1), 2: ("short\n\nanother line that only this one has", 42), 4: (None, 1), 5: ("", 1), 6: ("x y\nx y", 1), 7: ("x y", 1),
        8: ("last but not least a line of its own", 36), 9: (rows[9][1], 1),
    }
    assert out.filter("doc_id = 9").count() == 1
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    two = linededup.dedup_lines(frame(spark, [(1, long), (2, long + " tail"), (3, long[:-2])]))
    assert [r["doc_id"] for r in two.collect()] == [1]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_edit_distances_equal_the_full_table():
    r = random.Random(3)
    left, right, most = [], [], []
    for _ in range(600):
        letters = r.choice(["ab", "abcé漢\U0001f600 "])
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        b = list(a)
        for _ in range(r.randint(0, 8)):
            p, kind = r.randint(0, len(b)), r.random()
            b[p : p + (kind > 0.4)] = [r.choice(letters)] if kind < 0.7 else []
        left.append(a)
        right.append("".join(b))
        most.append(r.randint(0, 9))
    want = [levenshtein(a, b) <= k for a, b, k in zip(left, right, most, strict=True)]
    assert within(left, right, np.array(most)).tolist() == want
