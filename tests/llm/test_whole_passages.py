"""Removed spans hold all of what two documents share."""

import random
import re

from jobtide.llm import substring_dedup


def spans_of(repeated):
    return {r.doc_id: [tuple(map(int, s.split(":"))) for s in r.spans.split(",")] for r in substring_dedup.removals(repeated).collect()}


def test_whole_passages_and_all_copies_go(docs_of):
    rng = random.Random(31)
    text = lambda n: " ".join(f"{rng.choice('aeiou')}é{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for k, n in enumerate((51, 55, 60, 80, 120, 200)):
        passage = text(n)
        rows.append((2 * k, f"{text(40)} {passage} {text(40)}"))
        head = text(35) + " "
        rows.append((2 * k + 1, f"{head}{passage.replace('a', 'A')} {text(33)}"))
        want[2 * k + 1] = [(len(head), len(head) + len(passage))]
    # Three copies in a later document, two in the one that keeps the first.
    passage = text(70)
    rows.append((100, f"{passage}\n{text(30)}\n{passage}"))
    want[100] = [(len(rows[-1][1]) - len(passage), len(rows[-1][1]))]
    rows.append((101, f"{passage} {text(30)}\n{passage}\n{text(30)} {passage}"))
    at = [(m.start(), m.end()) for m in re.finditer(passage, rows[-1][1])]
    assert len(at) == 3
    want[101] = at
    rows += [(200, "The " * 400), (201, "the " * 400), (300, f"{passage[:40]} alone"), (301, None)]
    got = spans_of(substring_dedup.repeated_paragraphs(docs_of(rows)))
    # A word repeated all over: one paragraph stays.
    assert got.pop(201) == [(0, 1599)]
    assert got.pop(200)[0][0] >= 24 * 4 - 1
    assert got == want


def words_of(text):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\S+", text)]


def test_longer_runs_of_later_documents_go_too(docs_of):
    """Document 1 holds the middle of a passage only; 2 and 3 share more of it, which 3 loses whole."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n))
    left, middle, right = text(18), text(24), text(18)
    whole = f"{left} {middle} {right}"
    rows = [(1, f"{text(40)} {middle} {text(40)}"), (2, f"{text(30)} {whole} {text(5)}"), (3, f"{text(9)} {whole}")]
    got = spans_of(substring_dedup.repeated_paragraphs(docs_of(rows)))
    start = len(rows[2][1]) - len(whole)
    assert got[3] == [(start, start + len(whole))] and 1 not in got


def test_every_shared_run_of_fifty_words_against_brute_force(docs_of):
    """Every word of a run of 50 that an earlier document has is removed, and every removed word lies in a run of 24 that it has."""
    rng = random.Random(19)
    source = [f"{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(400)]
    rows = []
    for d in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a, n = rng.randrange(400), rng.randrange(5, 130)
            parts += source[a : a + n] + [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
        rows.append((d, rng.choice([" ", "  ", " \t"]).join(parts)))
    got = spans_of(substring_dedup.repeated_paragraphs(docs_of(rows)))
    seen = {24: set(), 50: set()}
    for d, text in rows:
        found = words_of(text)
        tokens = [w for _, _, w in found]
        must, may = set(), set()
        for n, into in ((50, must), (24, may)):
            here = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
            own = set()
            for i, run in enumerate(here):
                if run in seen[n] or run in own:  # repeats inside the document may go as well
                    into.update(range(i, i + n) if run in seen[n] or n == 24 else ())
                own.add(run)
            seen[n] |= own
        gone = {i for i, (a, b, _) in enumerate(found) if any(x <= a and b <= y for x, y in got.get(d, []))}
        assert must <= gone <= may, d
