import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import line_align
from corpusmill.llm.line_align import patience, without_aligned_lines


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_rises_in_both_and_takes_equal_lines(a, b):
    got = patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < m and j < n for (i, j), (m, n) in zip(got, got[1:], strict=False))
    assert patience(a, a) == [(i, i) for i in range(len(a))]
    if len(set(a)) == len(a) and set(a) == set(b) and a == b[: len(a)]:
        assert len(got) == len(a)


def runs_of(lines, min_words):
    """The shortest runs of lines with words enough that begin, or end, at each line."""
    out = set()
    for i in range(len(lines)):
        for ends in (range(i, len(lines)), range(i, -1, -1)):
            for j in ends:
                a, b = min(i, j), max(i, j)
                if sum(n for _, _, n in lines[a : b + 1]) >= min_words:
                    out.add(tuple(x for _, x, _ in lines[a : b + 1]))
                    break
    return out


def brute(rows, min_words, all_pairs=True):
    """Removed lines of each (id, text), every text beside all earlier ones that have a run of it, or beside the earliest holder of each run."""
    order = lambda i, t: (i is None, i if i is not None else 0, md5(t.encode()).hexdigest())
    lines = {}
    for i, t in rows:
        if t is not None:
            lines[order(i, t)] = [(k, x.strip(b" \t\r\x0b\x0c"), len(x.split())) for k, x in enumerate(t.encode().split(b"\n")) if x.split()]
    text_of = {o: o[2] for o in lines}
    first = {}
    for o in sorted(lines):
        first.setdefault(text_of[o], o)
    distinct = sorted(first.values())
    holders = defaultdict(list)
    for o in distinct:
        for run in runs_of(lines[o], min_words):
            holders[run].append(o)
    pairs = {(o, e) for hs in holders.values() for k, o in enumerate(hs) for e in (hs[:k] if all_pairs else hs[: min(k, 1)])}
    out = Counter()
    gone = defaultdict(set)
    for later, earlier in pairs:
        a, b = lines[later], lines[earlier]
        runs = []
        for i, j in patience([x for _, x, _ in a], [x for _, x, _ in b]):
            if runs and runs[-1][-1] == (i - 1, j - 1):
                runs[-1].append((i, j))
            else:
                runs.append([(i, j)])
        for r in runs:
            if sum(a[i][2] for i, _ in r) >= min_words:
                gone[later] |= {a[i][0] for i, _ in r}
    for o in lines:
        if first[text_of[o]] != o and sum(n for _, _, n in lines[o]) >= min_words:
            gone[o] = {k for k, _, _ in lines[o]}
    for i, t in rows:
        removed = sorted(gone[order(i, t)]) if t is not None else []
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed)
        out[(i, tuple(removed), kept)] += 1
    return out


def found(df, **options):
    cut = without_aligned_lines(df, into="cut", **options)
    return Counter((x["doc_id"], tuple(x["cut"]["removed"]), x["cut"]["kept"]) for x in cut.collect())


@pytest.mark.parametrize("seed", [1, 3, 50])
def test_against_all_texts(documents, seed):
    r = random.Random(seed)
    pool = [" ".join(f"l{k}w{j}" for j in range(r.randrange(1, 9))) for k in range(40)]
    rows = []
    for i in range(60):
        at = r.randrange(30)
        copied = pool[at : at + r.randrange(0, 8)]
        own = [f"own {i} {k} a b c" for k in range(r.randrange(4))]
        rows.append((i, "\n".join([*own[:2], *copied, "", *own[2:], *r.sample(pool, r.randrange(3))])))
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [rows[3]]
    assert found(documents(rows, 3)) == brute(rows, 5)


def test_all_kinds_of_rows(hostile, nothing):
    rows = [(x["doc_id"], x["text"]) for x in hostile.collect()]
    assert found(hostile) == brute(rows, 5)
    out = without_aligned_lines(hostile)
    assert out.columns == [*hostile.columns, "_lines"]
    assert without_aligned_lines(nothing).count() == 0


def test_blocks_of_lines_whose_first_holders_differ(documents):
    """Each line's first holder has it alone; the runs of the block meet at the first guest."""
    dishes = [f"dish{k} hot" for k in range(8)]
    menus = [(k, f"only {k}\n{d}\nalso {k}") for k, d in enumerate(dishes)]
    menus += [(20 + k, "\n".join([f"guest {k}", *dishes, f"bye {k}"])) for k in range(6)]
    assert found(documents(menus, 3)) == brute(menus, 5) == brute(menus, 5, all_pairs=True)


@pytest.mark.parametrize("more", [0, 1, 3, 9])
def test_the_number_of_holders_changes_nothing(documents, more):
    """Of two lines that cross, patience keeps one, however many later texts hold both."""
    x, y = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}"), *[(3 + k, f"own {k}\n{x}\nmid {k}\n{y}\nend {k}") for k in range(more)]]
    got = found(documents(rows, 2))
    assert got == brute(rows, 5)
    assert [gone for i, gone, _ in got if i == 2] in ([(0,)], [(1,)])


def test_holders_after_the_earliest_take_part(documents):
    """Two lines cross in the earliest holder; each stands alone in a later one."""
    x, y = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{x}\nmid\n{y}"), (2, f"{x}\nown 2"), (3, f"own 3\n{y}"), (4, f"{y}\nown 4\n{x}")]
    got = found(documents(rows, 2))
    assert [gone for i, gone, _ in got if i == 4] == [(0, 2)]
    assert got == brute(rows, 5) != brute(rows, 5, all_pairs=False)


@pytest.mark.parametrize("seed", [2, 4])
def test_repeated_and_crossing_lines_meet_all_holders(documents, seed):
    r = random.Random(seed)
    pool = [" ".join(f"l{k}w{j}" for j in range(r.randrange(3, 8))) for k in range(6)]
    rows = []
    for i in range(80):
        lines = r.choices(pool, k=r.randrange(1, 5))
        for k in range(r.randrange(3)):
            lines.insert(r.randrange(len(lines) + 1), f"own {i} {k}")
        rows.append((i, "\n".join(lines)))
    got = found(documents(rows, 3))
    assert got == brute(rows, 5) != brute(rows, 5, all_pairs=False)


def test_a_text_of_many_lines(documents):
    shared = [f"shared line number {k} of the two" for k in range(60_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["a head of its own here", *shared, "a tail of its own here"]))]
    ((gone, kept),) = [(g, k) for i, g, k in found(documents(rows)) if i == 2]
    assert len(gone) == 60_000 and kept == "a head of its own here\na tail of its own here"


def test_what_goes_is_in_an_earlier_text(documents):
    r = random.Random(5)
    pool = [" ".join(f"l{k}w{j}" for j in range(r.randrange(1, 9))) for k in range(12)]
    rows = [(i, "\n".join([f"own {i}", *r.choices(pool, k=r.randrange(7)), f"end {i}"])) for i in range(60)]
    got = found(documents(rows, 3))
    assert got == brute(rows, 5)
    gone = {i: set(g) for i, g, _ in got}
    for i, text in rows:
        lines = text.split("\n")
        earlier = ["\n" + t + "\n" for j, t in rows if j < i]
        seen = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if len(" ".join(lines[a:b]).split()) >= 5 and any("\n" + "\n".join(lines[a:b]) + "\n" in t for t in earlier):
                    seen |= set(range(a, b))
        assert gone[i] <= seen


@pytest.mark.parametrize("wide", [1, 16])
def test_views_and_pairs_settle_what_all_holders_would(documents, monkeypatch, wide):
    """Lines that few pairs share part them from the views of others."""
    monkeypatch.setattr(line_align, "_WIDE", wide)
    r = random.Random(8)
    pool = [" ".join(f"l{k}w{j}" for j in range(r.randrange(2, 8))) for k in range(9)]
    rows = []
    for i in range(90):
        lines = r.choices(pool, weights=[9, 6, 3, 1, 1, 1, 1, 1, 1], k=r.randrange(1, 6))
        for k in range(r.randrange(4)):
            lines.insert(r.randrange(len(lines) + 1), f"own {i} {k}")
        rows.append((i, "\n".join(lines)))
    assert found(documents(rows, 3)) == brute(rows, 5)


def test_pairs_do_not_grow_with_the_square_of_a_group(documents, monkeypatch):
    """A line stands twice in half the texts that hold it, where no earlier one settles it; other lines tell all holders apart."""
    counts = []
    removals = line_align._removals
    monkeypatch.setattr(line_align, "_removals", lambda texts, pairs, *more: counts.append(pairs.count()) or removals(texts, pairs, *more))
    x = "one two three four five"
    rows = [(k, f"own {k}\n{x}\nby {k}") for k in range(40)]
    rows += [(40 + k, f"by {k}\n{x}\nmid {k}\n{x}\nend {k}") for k in range(40)]
    got = found(documents(rows, 2))
    assert got == brute(rows, 5)
    assert sum(counts) < 4 * len(rows)
