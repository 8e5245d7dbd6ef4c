"""The near-copy stage on one crowd of texts that lie just below the least similarity."""

import numpy as np

from introngrid.llm import shingles, simhash

KINDS = "doc_id long, text string"


def edited(rng, base, edits):
    words = list(base)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"e{rng.integers(1 << 40)}"
    return " ".join(words)


def test_pairs_of_a_crowd_are_not_spelled_out(spark, monkeypatch):
    """Pairs of a crowd are compared in blocks: few are written, and every link between its texts is found."""
    rng = np.random.default_rng(11)
    base = [f"w{rng.integers(5000)}" for _ in range(400)]
    # 400 texts at about 0.72 from each other, and 60 with fewer edits, on both sides of 0.8.
    texts = [edited(rng, base, 7) for _ in range(400)] + [edited(rng, base, int(rng.integers(1, 6))) for _ in range(60)]
    texts += [" ".join(f"x{rng.integers(5000)}" for _ in range(100)) for _ in range(40)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], KINDS).repartition(3)
    written, real = [], simhash.materialize

    def counted(df, label, *rest):
        out = real(df, label, *rest)
        if label.endswith("pairs"):
            written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    got = {r["doc_id"]: r["comp"] for r in simhash.link_near_copies(table, width=5, least=0.8).collect()}

    sets = [set(shingles.shingle_set(t.encode(), 5).tolist()) for t in texts]
    low = list(range(len(texts)))
    find = lambda i: i if low[i] == i else find(low[i])
    for i in range(len(texts)):
        for j in range(i):
            if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low[find(i)] = find(j)
    names = {}
    for i in range(len(texts)):
        names.setdefault(find(i), set()).add(i)
    groups = {}
    for i, comp in got.items():
        groups.setdefault(comp, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, names.values()))
    assert max(map(len, names.values())) > 40
    # 9,942 pairs here, 6,981 of them from the buckets of one fingerprint; 46,952 where the buckets of all fingerprints spell them out.
    assert sum(written) < 30 * len(texts)
