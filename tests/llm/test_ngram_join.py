import numpy as np

from scholia.llm.components import connected_components
from scholia.llm.ngram_join import first_of_each, least_overlap, most_shared, postings_of, shingles_of, signature_of, similarity_components, words_of


def brute(texts, percent=80):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def made_texts(rng, n=240):
    base = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(k)) for k in (3, 5, 6, 8, 12, 30, 60, 200)]
    common = " ".join(f"c{i}" for i in range(30))
    out = [None, "", "  ", *base, *base]
    while len(out) < n:
        w = base[rng.integers(0, len(base))].split()
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 50)}"
        out.append(" ".join(w) + (f" {common}" if rng.random() < 0.3 else ""))
    return out


def test_prefixes_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    none, zero = np.empty(0, np.uint64), np.empty(0, np.int64)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = rng.random(len(a)) < 0.95
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert most_shared(signature_of(a), signature_of(b), len(a), len(b)) >= both
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            for light in (1, 4, 12, 50):
                frequent = np.sort(rng.choice(a, min(3, len(a)), replace=False))
                for f, c in ((none, zero), (frequent, np.arange(1, len(frequent) + 1))):
                    (x, i), (y, j) = postings_of(a, f, c, light, 80), postings_of(b, f, c, light, 80)
                    shared, p, q = np.intersect1d(x, y, return_indices=True)
                    assert shared.size
                    # and at one of them both have room for what they share
                    assert (np.minimum(len(a) - i[p], len(b) - j[q]) >= both).any()


def test_least_overlap():
    assert [least_overlap(n, 80) for n in (1, 2, 5, 6, 10)] == [1, 2, 4, 5, 8]


def test_components_equal_brute_force(spark):
    texts = made_texts(np.random.default_rng(5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want, sizes = brute(texts)
    got = similarity_components(df, frequent_from=2).collect()
    groups = {}
    for r in got:
        assert r.n_shingles == sizes[r.doc_id]
        groups.setdefault(r.component if r.component is not None else ("alone", r.doc_id), []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, w in enumerate(want) if w == k) for k in set(want))


def passage_texts(rng, groups=30):
    """Pairs of texts that share a passage of 56 shingles, beside smaller sets cut from it that are like none of them, and texts of other sizes with parts of it."""
    out = []
    for g in range(groups):
        passage = [f"p{g}x{i}" for i in range(60)]
        alone = lambda n: [f"u{g}x{len(out)}x{i}" for i in range(n)]  # noqa: B023, E731
        for _ in range(2):
            out.append(alone(6) + passage)
        out += [passage[:49], passage[11:]]
        for k in rng.integers(20, 61, 2):
            out.append(alone(int(rng.integers(0, 12))) + passage[-int(k) :])
    return [" ".join(w) for w in out]


def test_larger_sets_meet_beside_smaller_ones(spark):
    texts = passage_texts(np.random.default_rng(11))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want, _ = brute(texts)
    groups = {}
    for r in similarity_components(df, frequent_from=2).collect():
        groups.setdefault(r.component, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, w in enumerate(want) if w == k) for k in set(want))


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 160))


def test_odd_rows(spark, odd, none):
    kept = first_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([(False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (False, 5), (False, 6), (False, 7)])
    assert first_of_each(none).count() == 0


def test_whole_sequence_of_few_words():
    assert len(shingles_of(words_of("a b"), 5)) == 1 and len(shingles_of(words_of("A  b"), 5)) == 1
    assert (shingles_of(words_of("A b"), 5) == shingles_of(words_of("a\tb"), 5)).all()
