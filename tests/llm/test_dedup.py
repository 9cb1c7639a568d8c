"""Exact dedup, MinHash near-dedup and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from vellum.llm import components, exact_dedup, minhash

WHITE = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, hash string, a long, signature string"
EDGES = [
    (5, "a b", "x", 1, "s"), (3, "ab", "y", None, None), (9, "a  b", "z", 2, "s"), (2, None, None, None, None), (8, "", None, None, "q"),
    (4, " \t\n\x0b\x0c\r", "h", 1, "s"), (None, "ab", None, None, None), (7, "a b", "x", 1, "s"), (6, "é " * 9000, "x", 1, "s"), (11, "é" * 9000, "x", 1, "s"), (11, "é" * 9000, "x", 1, "s"),
]


def brute_exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(WHITE.sub("", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for norm, group in groups.items():
        ids = [x for x in group if x[0] is not None]
        keep = min(ids, key=lambda x: (-x[1], x[0]))[0] if ids else None
        out += [(d, keep, len(group), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in group]
    return sorted(out, key=repr)


def test_exact_matches_brute_force(spark):
    got = exact_dedup.find_copies(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(EDGES)


def test_exact_extreme_ids(spark):
    rows = [(2**63 - 1, "a a"), (-(2**63), "a a"), (0, "aa"), (1, "b"), (-1, "b")]
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)


def test_exact_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "k"), (2, "a ", "l"), (3, "b", "m")], "doc_id long, text string, hash string")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


@pytest.mark.parametrize("operator", [exact_dedup.find_copies, minhash.near_duplicates])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_sets(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sets


def brute_near(rows, percent=85):
    sets = brute_sets(rows)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_corpus(seed, groups=(60, 30, 4, 2), words=120):
    """Groups of copies with random edits, small and large, besides single texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, doc_id = [], 0
    common = [r.choice(vocabulary) for _ in range(40)]
    for size in [*groups, *[1] * 20]:
        base = common + [r.choice(vocabulary) for _ in range(words)]
        edited = list(base)
        for k in range(size):
            if k % 10 == 9:  # copies of copies
                for _ in range(3):
                    edited[r.randrange(len(edited))] = f"x{r.random()}"
            text = list(edited if k % 2 else base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 5])):
                at = r.randrange(len(text))
                text[at : at + 1] = r.choice([[f"e{r.random()}"], [], [text[at], "plus"]])
            rows.append((doc_id, " ".join(text).upper() if k % 3 else "\t".join(text), "h", 1, "s"))
            doc_id += 1
    rows += [(doc_id, None, None, None, None), (doc_id + 1, " \n", None, None, None), (doc_id + 2, "one two", "", 1, ""), (doc_id + 3, "One  TWO", "", 1, ""), (doc_id + 4, "one", "", 1, "")]
    rows += [(doc_id + 5, "r " * 30000, "", 1, ""), (doc_id + 6, "r " * 29000, "", 1, ""), (doc_id + 7, rows[0][1], "", 1, "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_near_matches_brute_force(spark, seed, percent):
    rows = near_corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=percent).collect()
    want = brute_near(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def loose_group(n, seed):
    """Copies of one text, of copies of it and of two texts that share a half with it, with edits of new and of known words, many of them too many for a link."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(90)]
    starts = [base, base[:45] + [f"c{k}" for k in range(45)], base[45:] + [f"d{k}" for k in range(40)]]
    rows = []
    for d in range(n):
        text = list(r.choices(starts[:3], [6, 1, 1])[0])
        for _ in range(r.choice([0, 1, 1, 2, 2, 2, 3, 3, 4])):
            at = r.randrange(len(text))
            text[at : at + 1] = r.choice([[], [f"e{r.randrange(9)}"], [f"n{r.random()}"]])
        if d % 60 == 0:
            starts.append(text)
        if len(starts) > 6 and r.random() < 0.3:
            text = list(r.choice(starts[3:]))
            text[r.randrange(len(text))] = f"m{r.randrange(4)}"
        rows.append((d, " ".join(text)))
    return rows


def fast_components(rows, percent):
    """As :func:`brute_near`, by counting shared shingles through lists of documents."""
    sets = brute_sets(rows)
    ids = sorted(sets)
    posts = {}
    for k, d in enumerate(ids):
        for x in sets[d]:
            posts.setdefault(x, []).append(k)
    sizes = np.array([len(sets[d]) for d in ids])
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, d in enumerate(ids):
        shared = np.bincount(np.concatenate([posts[x] for x in sets[d]]), minlength=len(ids)) if sets[d] else np.zeros(len(ids))
        for j in np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes + sizes[k] - shared))):
            x, y = find(k), find(int(j))
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), ids[find(k)]) for k, d in enumerate(ids)}


@pytest.mark.parametrize(("seed", "percent"), [(3, 85), (4, 80)])
def test_near_large_loose_group(spark, seed, percent):
    rows = loose_group(2000, seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent).collect()
    want = fast_components(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 50


def test_near_postings_stay_in_proportion(spark, monkeypatch):
    """Twice the members of a loose group make about twice the rows of each round, not four times."""
    made = {}
    for n in (700, 1400):
        rounds = []
        monkeypatch.setattr(minhash, "_meetings", lambda members, percent, f=minhash._meetings, rounds=rounds: (rounds.append(members.count()), f(members, percent))[1])
        minhash.near_duplicates(spark.createDataFrame(loose_group(n, 5), "doc_id long, text string").repartition(4), percent=85).count()
        monkeypatch.undo()
        made[n] = sum(rounds)
    assert made[1400] < 3 * made[700], made


def test_near_rounds_leave_out_what_is_joined(spark, monkeypatch):
    """Rounds of stars count and post for members outside the component that most are in, not for each pair of members that short lists have joined."""
    n, elements, rows = 1400, [], []
    monkeypatch.setattr(minhash, "_sketch", lambda df, tokens_of, f=minhash._sketch: ("delta" in df.columns and elements.extend(len(r.delta) // 8 for r in df.collect()), f(df, tokens_of))[1])
    monkeypatch.setattr(minhash, "_meetings", lambda members, percent, f=minhash._meetings: (met := f(members, percent), rows.append(met.count()))[0])
    docs = loose_group(n, 5)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == fast_components(docs, 80)
    assert sum(rows) < 24 * n and sum(elements) < 110 * n, (rows, sum(elements))


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, minhash.drop_near_duplicates])
def test_drops_tell_rows_apart_by_text(spark, drop):
    """Ids repeat, are null or clash with nothing that the operator adds; rows go by what they hold."""
    schema = "doc_id long, text string, `key` string, row int, rank int, `__lost` long, `a.b` int, component long"
    more = ("k", 1, 2, 3, 4, 5)
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "ab cd ef gh ij kl"), (2, "x y z u v w"), (2, "ab cd ef gh ij kl"), (None, "x y z u v w"), (None, "only null ids here now ok"), (None, "only null ids here now ok"), (5, long), (5, long), (4, long), (6, "r " * 50000)]
    got = drop(spark.createDataFrame([(*r, *more) for r in rows], schema).repartition(3))
    assert got.columns == [c.strip("`") for c in "doc_id text key row rank __lost a.b component".split()]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, rows[0][1]), (2, rows[1][1]), (None, rows[4][1]), (4, long), (6, rows[9][1])], key=repr)
    assert drop(spark.createDataFrame([], schema)).collect() == []
    empty = drop(spark.createDataFrame([(1, None, *more), (2, "", *more), (3, " \n", *more)], schema)).collect()
    assert len(empty) == (1 if drop is exact_dedup.drop_copies else 3)


def test_near_with_a_full_map(spark, monkeypatch):
    """More candidates than the bit map can tell apart: ids choose the texts, and nothing changes."""
    monkeypatch.setattr(minhash, "MAP_BITS", 6)
    rows = near_corpus(6, groups=(30, 4))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)


def test_near_ids_that_repeat_with_other_texts(spark):
    long = [f"w{k}" for k in range(80)]
    rows = [(3, " ".join(long)), (3, "quite another text than that one"), (2, " ".join([*long[:79], "x"])), (1, "quite another text than that other one")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 3, 1), (2, 76, 2), (3, 2, 3), (3, 76, 2)]


def test_near_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other words here"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True)], key=repr)


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {row.node: row.component for row in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
