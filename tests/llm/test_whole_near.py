"""Groups of near copies that one partner for each text does not join."""

import itertools

import numpy as np
from textguard.llm import near_dedup
from textguard.llm.graph import connected_components


def test_an_original_with_hundreds_of_independently_edited_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words)]
    for c in range(300):  # nine words changed far apart: 0.86 to the original, 0.74 to each other
        at = set((rng.choice(np.arange(5, 590, 6), 9, replace=False)).tolist())
        texts.append(" ".join(f"c{c}x{i}" if i in at else w for i, w in enumerate(words)))
    order = rng.permutation(len(texts)).tolist()
    rows = [(k, texts[i]) for k, i in enumerate(order)] + [(900 + k, " ".join(f"o{k}x{i}" for i in range(200))) for k in range(5)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["class_size"] for r in found if r["kept"]) == [1] * 5 + [301]


def test_every_pair_of_a_group_is_settled(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    sets = {}
    for family in range(12):  # a shared part that brings all into one band, too small to make them alike
        core = [*range(40), *(1000 * (family + 1) + np.arange(100)).tolist()]
        for m in range(5):
            drop = set(rng.choice(len(core), int(rng.integers(0, 60)), replace=False).tolist())
            sets[len(sets) * 7 + 3] = [x for i, x in enumerate(core) if i not in drop]
    label = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if (n := len({*sets[a]} & {*sets[b]})) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(list(sets.items()), "node long, items array<long>")
    members = spark.createDataFrame([(i, 1) for i in sets], "node long, band long")
    links = near_dedup.all_links(members, lambda nodes: frame, 0.8)
    found = {i: i for i in sets} | {r["node"]: r["component"] for r in connected_components(links, "node", "rep").collect()}
    assert found == label
    assert len(set(label.values())) > 12
