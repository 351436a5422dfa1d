"""Near-equal passages whose units collide with many unlike ones."""

from textguard.llm import paragraph_dedup


def test_variants_over_a_shared_template(spark):
    rows = []
    for f in range(60):  # two variants 0.93 alike; families are 0.73 alike at most
        for v in range(2):
            unit = [f"family{f}" if i == 3 else f"variant{f}x{v}" if i == 29 else f"template{i}" for i in range(30)]
            own = [" ".join(f"{side}{f}x{v}x{i}" for i in range(12)) for side in ("own", "end")]
            rows.append((2 * f + v, f"{own[0]}.\n{' '.join(unit)}.\n{own[1]}."))
    found = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kept_doc_id"], r["removed"]) for r in found} == {(2 * f + v, 2 * f, v == 1) for f in range(60) for v in range(2)}
    assert len({r["class_id"] for r in found}) == 60
