import itertools
import random
import re

from rankscreen.llm import minhash
from rankscreen.llm.hashing import shingle_set

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = WORD.findall((text or "").encode().lower())
        sets[doc] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus():
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(300)] + ["Émile", "ÀB", "x\x1cy"]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 80, 200]))]
        for _ in range(rnd.choice([1, 2, 9])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6, 12])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows) * 7 % 997, " ".join(t)))
    chain = [rnd.choice(words) for _ in range(100)]   # each differs from the next one only a little: linked in a chain
    for i in range(25):
        rows.append((1000 + i, " ".join(chain[i * 4:] + ["c%d" % j for j in range(i * 4)])))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "A b"), (2004, "a B"), (2005, "a b c d e"), (2006, "A B C D E"), (2007, "a b c d")]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows + rows[:2]] + [(None, rows[0][1], 1)], "doc_id long, text string, kept int")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id][1])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})


def test_links_that_miss_the_smallest_member_are_found(spark):
    """Two texts linked with each other, both in buckets with a smaller third that links to neither."""
    rnd = random.Random(9)
    base = ["v%d" % rnd.randrange(10**6) for _ in range(120)]
    far = base[:90] + ["q%d" % i for i in range(30)]
    near = base[:2] + ["z"] + base[3:]
    rows = [(1, " ".join(far)), (2, " ".join(base)), (3, " ".join(near))] + [(10 + i, " ".join(base[:118 - i] + ["t%d" % i] * (i + 2))) for i in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_star_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_shingles_ignore_only_ascii_case():
    assert set(shingle_set("A b C d E f", 5)) == set(shingle_set("a B\tc\x0bD e\nF", 5))
    assert set(shingle_set("É b c d e", 5)) != set(shingle_set("é b c d e", 5))
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set(" ", 5)) == 0 and shingle_set("a b", 5)[0] != shingle_set("b a", 5)[0]
