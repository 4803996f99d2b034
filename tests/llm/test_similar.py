"""Near copies in crowded buckets: texts of one template, groups of copies, chains, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.llm import similar, simhash
from verdigris.llm.common import connected_components, stage


def template_texts(n, rng, common=300, own=96):
    """Texts that share 300 of their 396 words in one run: similarity some 0.6 by five-word shingles."""
    head = [f"w{rng.randint(0, 99999)}" for _ in range(common)]
    return [" ".join(head + [f"x{rng.randint(0, 10**9)}" for _ in range(own)]) for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def links_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = stage(simhash.fingerprints(docs, "doc_id", "text", 5, 42, hashed=True), "test_fp")
    return rows, similar.links(docs, rows, "text", 5, 42, 0.8)


def components_of(spark, texts):
    rows, found = links_of(spark, texts)
    roots = connected_components(found)
    joined = rows.join(roots, F.col("fp") == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("root")).collect()
    groups = {}
    for r in joined:
        groups.setdefault(r.root, set()).add(r.id)
    return sorted(map(sorted, groups.values()))


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(find(k), set()).add(k)
    return sorted(map(sorted, groups.values()))


def test_rows_of_a_template_grow_in_proportion(spark, monkeypatch):
    compared = []
    before = similar._compared
    monkeypatch.setattr(similar, "_compared", lambda dealt, s: (compared.append(dealt.count()), before(dealt, s))[1])
    rng, rows = random.Random(1), []
    for n in (1500, 6000):
        compared.clear()
        texts = template_texts(n, rng)
        texts += [t + " end" for t in texts[:20]]  # twenty near copies among them
        _, found = links_of(spark, texts)
        assert found.where("a <> b").count() >= 20
        rows.append(sum(compared))
    assert rows[1] <= 4.4 * rows[0] + 100
    assert rows[1] < 2 * 6000


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"y{rng.randint(0, 10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [8, 64])
def test_crowded_groups_equal_all_pairs(spark, monkeypatch, block):
    """Buckets of every size take the crowded way: copies, copies of copies, texts around 0.8, templates."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "CROWD", block)
    rng = random.Random(block)
    base = template_texts(1, rng, 100, 100)[0]
    texts = template_texts(60, rng, 60, 30)
    texts += [changed(base, k % 7, rng) for k in range(150)]
    chain = base
    for _ in range(30):
        chain = changed(chain, 2, rng)
        texts.append(chain)
    texts += [" ".join(base.split()[k:]) for k in range(0, 60, 4)] + ["short text", "short text", "one", "", "a b c d e"]
    texts = list(dict.fromkeys(t for t in texts if t.split()))
    got, want = components_of(spark, texts), plain_components(texts)
    # A pair at 0.8 shares a band with probability 0.99: what all pairs connect may be missed at its very edge, nothing else is connected.
    of = {k: n for n, g in enumerate(want) for k in g}
    assert all(len({of[k] for k in g}) == 1 for g in got)
    assert len(got) <= len(want) + 2


def test_the_radius_has_a_bound(spark):
    with pytest.raises(ValueError, match="tau is 5"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 5)
