import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import jaccard, queries, words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    sets = [brute_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * len(a) < percent * len(b):
                break
            if a and top(i) != top(j) and 100 * len(a & b) >= percent * len(a | b):
                parent[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def near_copies(seed, groups=8, size=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 12, 60, 400]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(w) if rng.random() < 0.5 else " \n".join(w).upper())
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op7_jaccard_components(spark, sf)) == brute(rows, 4, 85)


@pytest.mark.parametrize("tile, forest, heavy", [(512, 500_000, 4096), (4, 7, 50)])
def test_near_copies_and_edge_cases(spark, tile, forest, heavy, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "FOREST", forest)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "ROWS", 50)
    monkeypatch.setattr(jaccard, "SALT_ROWS", 5)
    rows = near_copies(3) + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (6, "other text of same id"), (None, "a b c"), (None, "null id alone"), (7, "é É"), (8, "é é"), (9, "w " * 50_000)]
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows], "doc_id long, text string, node string, n int, key int")
    want = brute(rows, 4, 85)
    assert got(jaccard.join(df, 4, 85)) == want
    assert len({w[2] for w in want}) > 12
    assert got(jaccard.join(df, 5, 80)) == brute(rows, 5, 80)
    assert jaccard.join(df.limit(0), 5, 80).count() == 0


def test_keys_lose_no_link():
    rng = np.random.default_rng(0)
    for percent in (60, 80, 85, 95):
        keys = jaccard.Keys(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            extra = int((100 - percent) * n / percent)
            a, b = np.unique(both), np.unique(np.concatenate((both[: max(1, n - int(rng.integers(0, n)))], rng.integers(0, 2**64, int(rng.integers(0, extra + 1)), dtype=np.uint64))))
            if jaccard.linked(jaccard.overlap(a, b), len(a), len(b), percent):
                assert set(keys.of(a).tolist()) & set(keys.of(b).tolist())
                bits = jaccard.Sketches(pa.array([jaccard.sketch(a), jaccard.sketch(b)]))
                assert jaccard.may_link(bits, np.array([0]), np.array([len(a)]), bits, np.array([1]), np.array([len(b)]), percent)[0]


def test_unlinked_sets_share_no_keys():
    """What sets hold nothing of is no key that they share, or groups would grow with the table."""
    rng = np.random.default_rng(4)
    for percent, k in ((80, 450), (85, 450), (80, 90)):
        keys = jaccard.Keys(percent)
        for n in range(4 * k // 5, k, k // 18):
            own = [keys.of(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))) for _ in range(200)]
            every, times = np.unique(np.concatenate(own), return_counts=True)
            assert len(every) > 20 * k and (times > 1).sum() <= 2


def test_links_at_the_threshold_share_a_key():
    """Sets that differ by as much as linked ones can, one difference in each of as many parts as possible."""
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        keys = jaccard.Keys(percent)
        for n in [*range(1, 24), 57, 400]:
            for grow in (0, 1):
                band = keys.band(n) + grow
                p = keys.parts(band)
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                own, part = keys.of(a), ((a >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(int)
                # others in empty parts first, and in place of one element of each part
                free = [x for x in range(p) if x not in set(part.tolist())] + list(range(p))
                added = [np.uint64((x * 2**32 // p + 1) << 32) + np.uint64(int(rng.integers(1, 2**31))) for x in free]
                gone = np.unique(part, return_index=True)[1]
                gone = gone[np.argsort(np.bincount(part, minlength=p)[part[gone]], kind="stable")]
                for less in range(len(gone) + 1):
                    for more in range(0, len(added) + 1, 1 + len(added) // 20):
                        if jaccard.linked(n - less, n, n - less + more, percent):
                            b = np.unique(np.concatenate((np.delete(a, gone[:less]), np.array(added[:more], np.uint64))))
                            if jaccard.linked(jaccard.overlap(a, b), len(a), len(b), percent):
                                assert np.isin(own, keys.of(b)).any(), (percent, n, less, more)


def test_links_of_a_large_group_stay_linear(spark):
    """5000 near copies of one text, some linked only by way of others: links that are joined number at most 2 x nodes."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(5000):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = jaccard.Scratch(spark, "test")
    narrow, comps = jaccard.links_and_components(df, scratch, 4, 85)
    nodes = narrow.select("node").distinct().count()
    forests = [t.count() for path, t in scratch.paths.items() if t is not None and "/forest-" in path]
    assert nodes > 3000 and forests and max(forests) <= 2 * nodes
    scratch.keep()


def test_words_over_chunk_edges(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 7)
    texts = ["ab cd", "", None, "a" * 70_001, " x  y", "é😀 ß\tA\x0bB", "tail"]
    for table, p in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, n = words.word_hashes(pa.array(texts), table)
        lists = [re.findall(p, (t or "").translate(UPPER)) for t in texts]
        assert n.tolist() == [len(x) for x in lists]
        flat = [w for x in lists for w in x]
        assert len(set(h.tolist())) == len(set(flat)) and len(h) == len(flat)
        known = {}
        assert all(known.setdefault(w, x) == x for w, x in zip(flat, h.tolist(), strict=True))
