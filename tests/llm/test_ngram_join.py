import random

from corpusmill.llm.components import components
from corpusmill.llm.ngram_join import jaccard_classes, one_of_each, prefix_depth, recall


def brute(rows, threshold=0.8):
    """(links, class) of each row by all pairs."""
    sets = []
    for _, t in rows:
        ws = (t or "").encode().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= threshold * len(a | b)
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_depth_is_shortened_until_the_target():
    d = prefix_depth(0.8, 8, 32, 0.9999)
    assert recall(0.8, d, 32) >= 0.9999 > recall(0.8, d + 1, 32)
    assert prefix_depth(0.1, 8, 1, 0.9999) == 1


def test_components_against_search(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(60)]
    found = {x["v"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert len(set(found.values())) == len({top(v) for v in found})
    assert all((found[a] == found[b]) for a, b in edges if a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed=1, groups=25, size=6):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"v{r.randrange(5000)}" for _ in range(r.choice([8, 30, 120]))]
        for _ in range(r.randrange(1, size)):
            ws = list(words)
            for _ in range(r.randrange(0, 1 + len(ws) // 25)):
                ws[r.randrange(len(ws))] = f"x{r.randrange(9000)}"
            rows.append((len(rows), " ".join(ws)))
    return rows


def test_classes_and_links_against_all_pairs(documents):
    rows = near_copies()
    found = jaccard_classes(documents(rows, 3)).collect()
    assert sorted(((x["doc_id"], x["n_links"], x["class_id"]) for x in found), key=str) == brute(rows)


def test_a_large_component_is_compared_in_blocks(documents):
    rows = near_copies(2, 3, 60)
    found = jaccard_classes(documents(rows, 3), block=7).collect()
    assert sorted(((x["doc_id"], x["n_links"], x["class_id"]) for x in found), key=str) == brute(rows)


def test_all_kinds_of_rows(hostile, nothing):
    found = jaccard_classes(hostile).collect()
    rows = [(x["doc_id"], x["text"]) for x in hostile.collect()]
    got = sorted(((x["doc_id"], x["n_links"], x["class_id"]) for x in found), key=str)
    want = [(i, n, c if n else i) for i, n, c in brute(rows)]
    assert got == want
    kept = one_of_each(hostile)
    assert kept.columns == hostile.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(i for i, t in texts if t and t.split()) == [1, 5, 7, 7, 8]  # the copy without an id goes
    assert len(texts) == 5 + 4  # texts without words stay
    assert jaccard_classes(nothing).count() == 0
    assert one_of_each(nothing).count() == 0
