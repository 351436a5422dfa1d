"""Words of verbatim passages that go, and words of the documents' own that stay."""

from collections import Counter

import pytest

from textguard.llm import paragraph_dedup

PAIRS = 60


def prose(stem: str, n: int, sentence: int) -> str:
    """``n`` words of their own in sentences of ``sentence`` words."""
    ws = [f"{stem}w{i}" for i in range(n)]
    return " ".join(" ".join(ws[i : i + sentence]) + "." for i in range(0, n, sentence))


@pytest.mark.parametrize("sentence", [100, 12])
def test_verbatim_passages_between_own_sentences(spark, sentence):
    rows = []
    for length in (30, 40, 60, 90):
        for k in range(PAIRS):
            passage = prose(f"p{length}x{k}", length, sentence)
            for v in range(2):
                own = [prose(f"{side}{length}x{k}x{v}", 40, 40) for side in ("a", "b")]
                rows.append((length * 1000 + 2 * k + v, f"{own[0]} {passage} {own[1]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeats(df).collect()}
    left, lost = Counter(), Counter()
    for i, text in rows:
        kept = set(out[i].split())
        gone = [w for w in text.split() if w not in kept]
        own = sum(not w.startswith("p") for w in gone)
        assert i % 2 or not gone  # the first of each two is left as it is
        lost[i // 1000] += own
        left[i // 1000] += (i % 2) * (i // 1000 - (len(gone) - own))
    for length in (30, 40, 60, 90):
        assert left[length] <= 0.02 * length * PAIRS, (length, left)
        assert lost[length] <= 0.001 * 160 * PAIRS, (length, lost)
