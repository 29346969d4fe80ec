import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from skyadjust.llm import jaccard
from skyadjust.llm._common import Scratch

from .conftest import ODD_TEXTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        inner = len(sets[i] & sets[j])
        if inner and 100 * inner >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), low[find(i)]) for i, r in enumerate(rows))


def run(docs):
    return sorted(map(tuple, jaccard.join(docs).collect()))


def near(text, r, share):
    words = text.split()
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in words)


@pytest.mark.parametrize("hot,tile", [(64, 2048), (2, 3)])
def test_equals_brute_force(make_docs, prose, monkeypatch, hot, tile):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "ROUNDS", 3 if hot > 2 else 0)
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    base = [prose(i, n, 5000) for i, n in enumerate([3, 5, 6, 8, 12, 20, 40, 90, 130, 300, 700])]
    at = 100
    for t in base:
        for share in (0, 0, 0.01, 0.02, 0.04, 0.05, 0.06, 0.08):
            rows.append((at, near(t, r, share).upper() if at % 3 else near(t, r, share)))
            at += 1
        rows.append((at, " ".join(t.split()[: int(len(t.split()) * 0.8)])))
        at += 1
    assert run(make_docs(rows)) == brute(rows)


def test_chains_and_common_passages(make_docs, prose):
    words = prose(9, 1200, 10_000).split()
    chain = [(i, " ".join(words[i * 10 : i * 10 + 200])) for i in range(60)]
    shared = prose(10, 30)
    rows = chain + [(1000 + i, shared + " " + prose(500 + i, 60, 10_000)) for i in range(80)] + [(5000 + i, chain[0][1]) for i in range(20)]
    got = run(make_docs(rows))
    assert got == brute(rows)
    assert len({c for i, _, c in got if i < 60}) == 1


def test_empty_table_and_repeated_ids(make_docs):
    assert run(make_docs([])) == []
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of some words"), (0, None), (None, "a b c d e f g"), (None, "alone in here")]
    assert sorted(map(tuple, jaccard.join(make_docs(rows)).collect()), key=str) == [(0, 0, 0), (1, 2, 1), (1, 3, 1), (1, 3, 1), (None, 1, None), (None, 3, 1)]


def group(prose, m):
    """Near copies of one text, of which many are likely to 0.5 to 0.75 without linking."""
    r, base = random.Random(m), prose(77, 120, 10_000)
    return [(i, near(base, r, r.choice((0.0, 0.02, 0.04, 0.06, 0.08)))) for i in range(m)]


def test_rows_of_a_near_copy_group_grow_in_proportion(make_docs, prose, monkeypatch):
    made = {}
    save = Scratch.save
    for m in (500, 2000):
        most = []

        def counting(self, df, name, most=most):
            out = save(self, df, name)
            if name in ("best", "near", "few", "many", "found", "members", "links", "need", "texts"):
                most.append((name, out.count()))
            return out

        monkeypatch.setattr(Scratch, "save", counting)
        got = run(make_docs(group(prose, m)))
        monkeypatch.setattr(Scratch, "save", save)
        made[m] = max(n for _, n in most)
        if m == 500:
            assert got == brute(group(prose, m))
        assert made[m] <= 3 * m, most
    assert made[2000] <= 6 * made[500]


def test_spanning_links_merge_all_and_no_more(prose):
    rows = group(prose, 150)
    texts = pa.array([t for _, t in rows])
    cls = jaccard.class_ids(*jaccard.shingle_sets(texts))
    _, at = np.unique(cls, return_index=True)
    texts, cls, rows = texts.take(pa.array(at)), cls[at], [rows[i] for i in at.tolist()]
    want = len({c for _, _, c in brute(rows)})
    links = jaccard.spanning_links(texts, cls, cls)
    assert len(links) == len(cls) - want
    half = np.arange(len(cls)) % 2
    both = jaccard.spanning_links(texts, cls, cls, half)
    assert 0 < len(both) <= len(links) and all(half[cls == a] != half[cls == b] for a, b in both)
    assert jaccard.spanning_links(texts, cls + 1, cls) == []


def test_candidates_reach_every_member_of_a_component(prose):
    r, words = random.Random(3), prose(5, 240, 10_000).split()
    chain = [" ".join(words[8 * i : 8 * i + 120]) for i in range(12)]
    texts = pa.array([*chain, near(chain[0], r, 0.02), near(chain[11], r, 0.02)])
    first, s = jaccard.shingle_sets(texts)
    bits, n, cls = jaccard.parity_sketches(first, s), np.diff(first), np.arange(len(texts))
    root = np.where(cls < 12, 0, cls)
    far = np.array([[jaccard.distances(pa.array([x]), pa.array([y]))[0] for y in bits] for x in bits])
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if root[i] != root[j] and far[i, j] * 7 <= n[i] + n[j]}
    found = {(min(p), max(p)) for p in jaccard.spanning_candidates(n, bits, cls, root)}
    assert len(want) > 2 and found <= want and {i for p in found for i in p} == {i for p in want for i in p}


def test_sketch_distance_is_a_lower_bound(prose):
    r = random.Random(4)
    texts = []
    for n in (10, 150, 900, 4000):
        t = prose(n, n, 10_000)
        texts += [t, near(t, r, 0.03)]
    first, s = jaccard.shingle_sets(pa.array(texts))
    bits = pa.array(jaccard.parity_sketches(first, s))
    for i in range(0, len(texts), 2):
        a, b = (set(s[first[k] : first[k + 1]].tolist()) for k in (i, i + 1))
        far = jaccard.distances(bits.slice(i, 1), bits.slice(i + 1, 1))[0]
        assert (far > 0) == (a != b) and far <= len(a ^ b)


def test_pigeonhole_leaves_enough_chunks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 6, 7, 12, 13, 50, 127, 128, 200, 255, 256, 1000, 5000):
        s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        _, items, _ = jaccard.sketch_chunks(np.array([0, len(s)]), s, np.zeros(0, np.uint64))
        which, _ = jaccard.roles(np.array([len(s)]))
        assert len(items) >= len(which) * ((n + 4 * n // 3) // 7 + n // 48 + 1)


@pytest.mark.parametrize("rows", [[(3, "a b c d e f g h"), (1, "A B C D E F G H"), (2, "z y x w v u t"), (4, None), (5, "")]])
def test_keep_first(make_docs, rows):
    kept = jaccard.keep_first(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]
    assert kept.columns == make_docs(rows).columns


def test_keep_first_judges_rows_that_share_an_id(make_docs):
    rows = [(1, "a b c d e f g h"), (1, "z y x w v u t s"), (2, "A B C D E F G H"), (2, "k l m n o p q r"), (3, "one"), (3, "one"), (None, "z y x w v u t s"), (None, "two"), (None, "two")]
    kept = jaccard.keep_first(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "two"), (0, "two"), (0, "z y x w v u t s"), (1, "a b c d e f g h"), (1, "z y x w v u t s"), (2, "k l m n o p q r"), (3, "one")]
