import hashlib
import re
from collections import Counter

import pytest

from skyadjust.llm import phrases

from .conftest import ODD_TEXTS


def brute(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (doc, *_), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(docs):
    return sorted(map(tuple, phrases.dedup(docs).collect()))


@pytest.mark.parametrize("shares,group", [(4096, 1500), (1, 3), (8, 1)])
def test_equals_brute_force(make_docs, prose, monkeypatch, shares, group):
    monkeypatch.setattr(phrases, "SHARES", shares)
    monkeypatch.setattr(phrases, "GROUP", group)
    passage, other = prose(1, 60, 10_000), prose(2, 36, 10_000)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, prose(50 + i, 40 + 7 * i) + " " + (passage if i % 2 else other) + "\n" + prose(90 + i, 20)) for i in range(12)]
    rows += [(200, " ".join(passage.split()[:34])), (201, " ".join(passage.split()[:35])), (202, " ".join(passage.split()[20:58]) + " end")]
    rows += [(300, prose(7, 100)), (301, prose(7, 100)), (302, prose(7, 100) + " more"), (303, "a b c " * 14), (304, "p q " * 20)]
    rows += [(400, prose(8, 50) + " middle " + prose(8, 50)), (401, prose(8, 50).upper())]
    assert run(make_docs(rows)) == brute(rows)


def test_short_periods_recur_inside_a_text(make_docs):
    rows = [(n, " ".join(f"p{i % period}" for i in range(n))) for period in (1, 2, 5, 13, 29, 36) for n in (35, 36, 37, 48, 70, 73)]
    rows = [(i, f"own{i} " + t) for i, (_, t) in enumerate(rows)]
    assert run(make_docs(rows)) == brute(rows)


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def test_strip_keeps_rows_and_columns(make_docs, prose):
    passage = prose(3, 40, 10_000)
    rows = [(1, "first words " + passage), (2, passage + " last words"), (3, "untouched\n text"), (4, None)]
    docs = make_docs(rows)
    got = phrases.strip(docs)
    assert got.columns == docs.columns
    by = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert by == {1: ("first words", 11), 2: ("last words", 10), 3: ("untouched\n text", 15), 4: (None, None)}
