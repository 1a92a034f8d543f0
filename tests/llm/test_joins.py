"""Near copies, vectors, quotations and components against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import near_vectors, ngram_join, quotations, topk
from larkspur.llm.common import materialise, release
from larkspur.llm.graph import components


def groups_of(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(r.choice([5, 120, 400]))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    pairs += [(2000, 2001 + i) for i in range(80)] * 2
    frame = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    got = {x.node: x.component for x in components(frame).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert got == groups_of({n for p in real for n in p}, real)
    assert components(frame.limit(0)).collect() == []


def test_intermediates_can_be_dropped(spark):
    frame = materialise(spark.range(5), "five")
    assert frame.count() == 5
    assert release(spark) > 0 and release(spark) == 0


# --- n-gram Jaccard -----------------------------------------------------------------------------------------------------


def word_sets(text, n=5):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_groups(rows):
    sets = [(i, word_sets(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, s) in enumerate(sets) for b, u in sets[:k] if s and u and a is not None and b is not None and 100 * len(s & u) >= 80 * len(s | u)]
    comp = groups_of({i for i, _ in rows if i is not None}, pairs)
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


def near_copies(r, n):
    """Texts of all sizes, copies with some words changed, cut or added, shared passages."""
    words = lambda k: [f"w{r.randrange(4000)}" for _ in range(k)]
    shared, texts = words(60), []
    while len(texts) < n:
        kind = r.random()
        if kind < 0.35 or not texts:
            texts.append(words(r.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 16, 30, 80, 200])))
        elif kind < 0.5:
            texts.append(words(r.choice([2, 6, 10, 60])) + shared)
        else:
            t = list(r.choice(texts))
            for _ in range(r.randrange(0, 3)):
                if t and (how := r.random()) < 0.5:
                    t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
                elif how < 0.75 and t:
                    del t[r.randrange(len(t))]
                else:
                    t.insert(r.randrange(len(t) + 1), "new")
            texts.append(t)
    return [r.choice([" ", "\n", " \t"]).join(w.upper() if r.random() < 0.1 else w for w in t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i * 3, t) for i, t in enumerate(near_copies(r, 260))]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, rows[3][1]), (rows[7][0], rows[7][1]), (rows[8][0], rows[40][1]), (9000, "long " * 20_000 + "end"), (9001, "long " * 20_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "'k' AS component")
    assert sorted(map(tuple, ngram_join.similar_groups(docs.repartition(5)).collect()), key=str) == brute_groups(rows)


def test_a_large_group_of_near_copies(spark):
    """Not every pair is compared, yet every link counts: many copies, some of them linked only by others."""
    r = random.Random(9)
    first = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(220):
        t = list(first)
        for _ in range(r.randrange(6)):
            t[r.randrange(100)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(900, " ".join(first[:88])), (901, " ".join(first[:78]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_groups(docs).collect()), key=str) == brute_groups(rows)


@pytest.mark.parametrize("hot", [0, 3, 30])
def test_hot_lists_give_the_same_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "PARTNERS", 7)
    rows = [(i, t) for i, t in enumerate(near_copies(random.Random(hot), 200))]
    assert sorted(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute_groups(rows)


def test_templates_just_below_the_threshold_meet_nowhere(spark, monkeypatch):
    """Documents of 103 shared and 13 own shingles (0.798): they share all of 103 lists, and no pair is compared."""
    compared = []
    real = ngram_join.compare

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "compare", counting)
    common = " ".join(f"c{i}" for i in range(107))
    rows = [(i, f"{common} " + " ".join(f"x{i}_{j}" for j in range(13))) for i in range(3000)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(i, 116, i) for i in range(3000)]
    assert sum(compared) < 3000


def test_no_rows_and_only_empty_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ngram_join.similar_groups(docs.limit(0)).collect() == []
    assert sorted(map(tuple, ngram_join.similar_groups(docs).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("x", [0, 4, 9, 12])
def test_any_boundary_gives_the_same_groups(spark, monkeypatch, x):
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes, t: x)
    rows = [(i, t) for i, t in enumerate(near_copies(random.Random(31), 150))]
    assert sorted(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute_groups(rows)


def test_light_keys_meet_exactly_when_sets_link():
    r, t = random.Random(2), (4, 5)
    for _ in range(3000):
        common = [np.uint64(r.randrange(2**60)) for _ in range(r.randrange(1, 10))]
        a, b = (np.unique(np.array(common + [r.randrange(2**60) for _ in range(r.randrange(3))], "uint64")) for _ in range(2))
        both = len(np.intersect1d(a, b))
        mine, theirs = ({k: role for k, role, _ in ngram_join.light_keys(x, 12, t)} for x in (a, b))
        meet = any(mine[k] != theirs[k] or mine[k] == ngram_join.ALIKE for k in mine.keys() & theirs.keys())
        assert meet == (5 * both >= 4 * (len(a) + len(b) - both))


def test_boundary_weighs_costs():
    assert ngram_join.boundary({}, (4, 5)) == 0
    assert ngram_join.boundary({3: 100}, (4, 5)) >= 3
    assert ngram_join.boundary({12: 10**6}, (4, 5)) < 12
    # nothing but cost ends the search: sets of 4 words more cost less as lists of subsets, however large x becomes
    assert ngram_join.boundary({2: 10**6, 24: 1, 60: 10**4}, (4, 5)) >= 2
    r, t = random.Random(4), (4, 5)
    for _ in range(60):
        sizes = {r.randrange(1, r.choice([8, 40])): r.randrange(1, 2000) for _ in range(r.randrange(1, 9))}

        def cost(x, sizes=sizes):
            light = sum(c * sum(math.comb(n, ngram_join.need(n, m, t)) for m in ngram_join.partners(n, t) if m <= x) for n, c in sizes.items() if n <= x)
            return light + sum(c * ngram_join.posted(n, t) * ngram_join.COMPARISON for n, c in sizes.items() if 5 * n > 4 * x)

        assert cost(ngram_join.boundary(sizes, t)) == min(map(cost, range(max(sizes) * 5 // 4 + 2)))


def test_classes_that_share_a_name_are_named_anew(spark, monkeypatch):
    """With names of 6 bits many clash, until a seed is found for which none do."""
    rows = [(i, t) for i, t in enumerate(near_copies(random.Random(3), 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seeds = []
    made = ngram_join.postings
    monkeypatch.setattr(ngram_join, "postings", lambda r, s, x, n, t, seed: (seeds.append(seed), made(r, s, x, n, t, seed).withColumn("class", ngram_join.F.expr("class & 63") if seed < 2 else ngram_join.F.col("class")))[1])
    assert sorted(map(tuple, ngram_join.similar_groups(docs).collect()), key=str) == brute_groups(rows) and seeds == [0, 1, 2]


# --- vectors ------------------------------------------------------------------------------------------------------------


def vector_rows(seed, n=240, dims=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) * r.choice([0.1, 1, 3], size=(n, 1))
    for i in range(60, n):
        if i % 2:
            x[i] = x[i % 20] * r.choice([1, 2]) + r.normal(size=dims) * 0.05
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return rows + [(1000, None), (1001, []), (1002, [0.0] * dims), (1003, [1.0, None]), (1004, [float("nan")] * dims), (1100, [float("inf"), 1.0]), (None, rows[0][1]), (1200, rows[1][1][:5]), (1300, rows[2][1]), (1301, rows[2][1])]


def brute_top(rows, every=100, k=10, scale=1024):
    ok = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q)  # noqa: B905
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 50 * 16 * 12)
    monkeypatch.setattr(topk, "HEAD_ROWS", 30)
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = vector_rows(seed)
    df = spark.createDataFrame([*rows, rows[5]], "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS norm")
    assert sorted(map(tuple, topk.search(df).collect())) == brute_top(rows)
    assert sorted(map(tuple, topk.search(df, every=40, k=3).collect())) == brute_top(rows, 40, 3)


def test_top_k_of_one_length_over_many_blocks(spark, monkeypatch):
    """Equal lengths prune nothing: more blocks than the head holds, and every query meets them all."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 40 * 16 * 8)
    monkeypatch.setattr(topk, "HEAD_ROWS", 60)
    r = np.random.default_rng(5)
    rows = [(i, [float(s) for s in r.choice([-1, 1], 8)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df).collect())) == brute_top(rows)


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(100, [1e9, 3.0]), (200, [-1e9, 2.5]), (7, [1e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df).collect())) == brute_top(rows)
    assert topk.search(df.limit(0)).collect() == []


def test_rows_of_one_id_take_one_place(spark):
    """A vec_id on many rows with different, high-scoring vectors leaves the other places to others."""
    rows = [(100, [1.0, 0.0])] + [(7, [9.0 + i, 1.0]) for i in range(30)] + [(i, [i / 50, 2.0]) for i in range(20, 50)]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    best = {i: max(1024 * math.floor(1024 * v[0]) for j, v in rows if j == i) for i, _ in rows if i != 100}
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert got == [(100, n + 1, i, score) for n, (i, score) in enumerate(want)]


def brute_links(rows, least=0.9):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.zeros(12)
            x[: len(v)] = v
            ok[k] = x / np.linalg.norm(x)
    near = {(a, b) for a in ok for b in ok if a != b and ok[a] @ ok[b] >= least}
    comp = groups_of({i for i, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in near])
    n = defaultdict(int)
    for a, _ in near:
        n[a] += 1
    return sorted(((i, n[k], comp.get(i) if k in ok else i, i is not None and (comp.get(i) if k in ok else i) == i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_near_vectors_find_the_links(spark, monkeypatch, seed):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_vectors, "PARTNERS", 8)
    rows = vector_rows(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS v")
    got = sorted(map(tuple, near_vectors.near_duplicates(df).collect()), key=str)
    want = brute_links(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.9 * there <= found <= there
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_a_large_group_beyond_every_window(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=16)
    rows = [(i, [float(v) for v in base + r.normal(size=16) * (0.02 if i % 9 else 0.3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    degree = (x @ x.T >= 0.9).sum(1) - 1
    got = sorted(map(tuple, near_vectors.near_duplicates(df, window=3, passes=12).collect()))
    assert sum(g[1] for g in got) >= 0.9 * degree.sum() and all(g[1] <= d for g, d in zip(got, degree, strict=True))
    assert [g[1] for g in got if g[2] == 0] == [int(d) for g, d in zip(got, degree, strict=True) if g[2] == 0]


def test_copies_hide_nothing(spark):
    """Copies, scaled or not, join what their first joins, with windows smaller than a group of copies."""
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 16))
    x[150:] = x[:150] + r.normal(size=(150, 16)) * 0.4
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    copies = [(i + 1000 * k, [c * (1, 3)[k % 2] for c in v]) for i, v in rows for k in range(1, 9)]
    frame = lambda some: spark.createDataFrame(some, "vec_id long, embedding array<double>")
    alone = {g.vec_id: g.component_id for g in near_vectors.near_duplicates(frame(rows), passes=4, window=4).collect()}
    got = {g.vec_id: g.component_id for g in near_vectors.near_duplicates(frame(rows + copies), passes=4, window=4).collect()}
    assert got == {i: alone[i % 1000] for i in got} and len(got) == 2700
    assert sum(i != c for i, c in alone.items()) > 80


def test_recall_does_not_fall_with_the_table():
    """The scheme in numpy: 400,000 random vectors, pairs at cosine 0.9 exactly, as many passes as the operator makes."""
    assert near_vectors.extent(0) == near_vectors.extent(50_000) == (16, 24)
    n, dims, m = 400_000, 32, 1000
    passes, window = near_vectors.extent(n)
    r = np.random.default_rng(1)
    x = r.normal(size=(n, dims)).astype("float32")
    x[:m] /= np.linalg.norm(x[:m], axis=1, keepdims=True)
    side = r.normal(size=(m, dims))
    side -= (side * x[:m]).sum(1, keepdims=True) * x[:m]
    x[m : 2 * m] = 0.9 * x[:m] + np.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1, keepdims=True)
    hit, power = np.zeros(m, bool), (1 << np.arange(40, dtype="int64"))[::-1]
    for _ in range(passes):
        key = (x @ r.normal(size=(dims, 40)).astype("float32") > 0) @ power
        rank = np.empty(n, "int64")
        rank[np.argsort(key)] = np.arange(n)
        hit |= np.abs(rank[:m] - rank[m : 2 * m]) <= window
    assert hit.mean() >= 0.9


def test_rounded_vectors_decide_or_leave_it(spark):
    """Bounds hold: what is called sure reaches the threshold, and what reaches it is sure or still to be verified."""
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 24)) * np.exp(r.normal(size=(400, 24)))
    x[200:] = x[:200] + r.normal(size=(200, 24)) * r.choice([0.1, 0.35, 0.6], size=(200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, off = near_vectors.from_rough(near_vectors.rough(x), 24)
    assert (np.linalg.norm(x - y, axis=1) <= off).all() and off.max() < 0.02
    order = np.array([k for p in range(200) for k in (p, p + 200)])
    cos = (x[:200] * x[200:]).sum(1)
    found = {(a, b): sure for a, b, sure in near_vectors.close(order, np.zeros(400, int), y[order], off[order], 1, 0.9, near_vectors.Forest())}
    for p in range(200):
        sure = found.get((p, p + 200))
        assert (sure is not True or cos[p] >= 0.9) and (cos[p] < 0.9 or sure is not None)
    pairs = spark.createDataFrame([(p, p + 200) for p in range(200)], "a long, b long")
    rows = spark.createDataFrame([(i, b"d" + v.tobytes()) for i, v in enumerate(x)], "vec_id long, v binary")
    got = {r.a for r in near_vectors.verified(pairs, rows, 24, 0.9).collect()}
    assert got == {p for p in range(200) if cos[p] >= 0.9} and 0 < len(got) < 200


def test_vectors_without_links(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors.near_duplicates(df.limit(0)).collect() == []


# --- quotations ---------------------------------------------------------------------------------------------------------


def test_parsing_of_nested_quotes():
    own, quotes = quotations.parse("Hi.\n\nOn Monday Ann wrote:\n> > deep one\n> > goes on\n> reply\n>\n> next part\nMy answer.")
    assert own == "Hi.\n\nMy answer."
    assert quotes == [(2, "deep one\ngoes on"), (1, "reply"), (1, "next part")]
    assert quotations.parse("") == ("", []) and quotations.parse(">") == ("", [])
    assert quotations.fingerprint("Hello,  World!") == quotations.fingerprint("hello\nworld") and quotations.fingerprint("?!") is None


def plain(text):
    """Letters and digits in words, lower-cased."""
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def plain_parse(text):
    """Own text and (level, passage) pairs, character by character."""
    own, quotes, before = [], [], 0
    for line in text.split("\n"):
        level, at = 0, 0
        for k, c in enumerate(line):
            if c == ">":
                level, at = level + 1, k + 1
            elif c not in " \t":
                break
        rest = line[at:].strip()
        if not level:
            own.append(line)
        elif rest and before == level:
            quotes[-1][1].append(rest)
        elif rest:
            quotes.append((level, [rest]))
        before = level if rest else 0
    text = "\n".join(own)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip("\n"), [(n, "\n".join(q)) for n, q in quotes if plain("\n".join(q))]


def brute_thread(rows):
    """The same by plain loops over texts, none of it through the module: parent, conversation, position, numbers of
    quotes and links, own text of each message.  A passage is offered by whom its words, line by line, are a run of."""
    messages = [(c, t, *plain_parse(x or ""), x or "") for c, t, x in rows]

    def offers(own, passage):
        want, have = [x for x in map(plain, passage.split("\n")) if x], [x for x in map(plain, own.split("\n")) if x]
        whole = " ".join(want)
        pieces = [plain(own), *(plain(p) for p in own.split("\n\n")), *have]
        return whole in pieces or any(have[k : k + len(want)] == want for k in range(len(have) - len(want) + 1))

    found, joined = {}, []
    for c, t, _, quotes, _ in messages:
        if c is None or t is None:
            continue
        for at, (level, q) in enumerate(quotes):
            places = sorted((c2, t2) for c2, t2, own2, _, _ in messages if c2 is not None and t2 is not None and offers(own2, q))
            here = [o for o in places if o[0] == c][:1]
            far = places and places[0][0] < c and len(plain(q).split()) >= quotations.ACROSS_WORDS
            to = here[0] if here and here[0][1] < t else places[0] if far else None
            found.setdefault((c, t), []).append((to is None, level, at, to))
            if to and to[0] != c:
                joined.append((c, to[0]))
    # of messages that share conv_id and turn, links count together, and the best of all makes the reply
    across = [(c, min(x)[3][0]) for (c, _), x in found.items() if min(x)[3] and min(x)[3][0] != c]
    name = groups_of({c for c, t, *_ in messages if c is not None and t is not None}, across)
    out = []
    for c, t, own, quotes, raw in messages:
        if c is None or t is None:
            out.append((None, c, t, None, None, len(quotes), 0, max([n for n, _ in quotes], default=0), own))
            continue
        some = found.get((c, t), [])
        before = [t2 for c2, t2, *_ in messages if c2 == c and t2 is not None and t2 < t]
        parent = min(some)[3] if some and min(some)[3] else (c, max(before)) if before else (None, None)
        out.append((name[c], c, t, *parent, len(quotes), sum(x[3] is not None for x in some), max([n for n, _ in quotes], default=0), own))
    return sorted(out, key=str)


def thread_rows(seed):
    r = random.Random(seed)
    said, rows = [], []
    for c in range(12):
        for t in range(r.randrange(1, 7)):
            text = f"{r.choice(['Yes', 'No', 'Fine'])} word{r.randrange(99)} of {c}.\nSecond line {r.randrange(5)}"
            if said and r.random() < 0.6:
                quote = r.choice(said).split("\n")[: r.choice([1, 2])]
                mark = r.choice(["> ", ">", "> > ", ">> "])
                text = "\n".join(mark + q for q in quote) + "\n" + text
            said.append(quotations.parse(text)[0])
            rows.append((c, t * 5000 if c == 3 else t, text))
    return rows + [(3, None, "> x"), (None, 1, "y"), (40, 0, None), (41, 0, ""), (41, 0, "twice"), (41, 0, "twice"), (41, 0, "twice"), (41, 1, "> Yes\nOk"), (43, 0, "Yes"), (44, 0, "> yes!\nToo short to link afar"), (42, 0, "> unknown\n" + "long " * 20_000)]


@pytest.mark.parametrize("seed", range(3))
def test_quotations(spark, seed):
    rows = thread_rows(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'u' AS role", "1 AS position")
    got = quotations.link(frame).collect()
    assert sorted(((g.conversation_id, g.conv_id, g.turn, g.reply_conv, g.reply_turn, g.n_quotes, g.n_linked, g.max_level, g.text) for g in got), key=str) == brute_thread(rows)
    whole = [g for g in got if g.conv_id is not None and g.turn is not None]
    by = defaultdict(list)
    for g in whole:
        by[g.conversation_id].append(g)
    for name, some in by.items():
        some.sort(key=lambda g: g.position)
        assert [g.position for g in some] == list(range(len(some))) and name == min(g.conv_id for g in some)
        place = {}
        for g in some:
            place.setdefault((g.conv_id, g.turn), g.position)
        assert all(place[g.reply_conv, g.reply_turn] < g.position for g in some if g.reply_turn is not None)
    assert quotations.link(frame.limit(0)).collect() == []


def test_part_of_a_paragraph_is_linked(spark):
    """Two of four lines, a run across a blank line, and lines that no message has in this order."""
    first = "Line one is here.\nLine two, too!\nLine three.\nLine four\n\nAnother paragraph"
    rows = [
        (1, 0, first),
        (1, 1, "something else"),
        (1, 2, "> Line two, too!\n> Line three.\nI agree"),
        (1, 3, "> line four\n> another paragraph\nMe too"),
        (1, 4, "> Line three.\n> Line two, too!\nNo such run"),
        (2, 0, "> Line one is here.\n> Line two, too!\n> Line three.\nFrom afar"),
    ]
    got = {(g.conv_id, g.turn): g for g in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    for key in ((1, 2), (1, 3), (2, 0)):
        assert (got[key].reply_conv, got[key].reply_turn, got[key].n_linked) == (1, 0, 1), key
    assert (got[1, 4].reply_turn, got[1, 4].n_linked) == (3, 0)
    assert {g.conversation_id for g in got.values()} == {1} and got[2, 0].position == 5
    assert quotations.runs(first, {quotations.fingerprint("line two too"): [2, 9]}) == {quotations.fingerprint("Line two, too!\nLine three.")}
