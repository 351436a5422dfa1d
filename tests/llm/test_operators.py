"""The training-data operators against brute force, and on odd tables."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from tests.oracle import DATA, connected, difference
from textguard.llm import html_main, imatch, lang_crf, mixing, near_dedup, paragraph_dedup, pieces, quality_net, quality_rules, url_trees
from textguard.llm.graph import connected_components
from textguard.llm.oracles import ORACLES
from textguard.llm.queries import QUERIES
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid string, size int, n_words string, k1 int, x int, vec array<int>"
PROSE = "the old house by the river was sold to a young couple from the city who wanted a quiet life near water and trees. "
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, PROSE * 2), (6, PROSE * 2), (6, PROSE * 2), (None, PROSE), (7, "!!! ### 123 ½"),
    (8, "é" * 5000), (9, " ".join(f"w{i}" for i in range(3000))), (10, "a\x00b 😀 c"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en" if i else None, None if i == 4 else "s", len(t or ""), "r", 1, "n", 2, 3, [1]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def crosses(spark):
    return {
        "op1": lambda d: lang_crf.identify(d),
        "op2": lambda d: mixing.mix(d),
        "op3": lambda d: quality_rules.score_quality(d),
        "op5": lambda d: near_dedup.near_duplicates(d),
        "op6": lambda d: imatch.fingerprint_documents(d),
        "op8": lambda d: pieces.encode_documents(d),
        "op9": lambda d: quality_net.score_documents(d, spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, quality int")),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op8", "op9"])
def test_odd_rows_and_empty_table(spark, name):
    f = crosses(spark)[name]
    rows = f(odd(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(i or 0 for i, _ in ODD)
    assert f(odd(spark).limit(0)).count() == 0


def test_row_keeping_stages_keep_columns(spark):
    for f in (quality_rules.filter_quality, near_dedup.drop_near_duplicates, paragraph_dedup.remove_repeats, mixing.mixed_documents):
        assert f(odd(spark)).columns == odd(spark).columns
        assert f(odd(spark).limit(0)).count() == 0


# op1


def test_messages_equal_all_paths():
    rng = np.random.default_rng(0)
    score, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.mean(np.exp(moves[:, path[0]])) * np.exp(sum(score[i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, p in enumerate(path):
            total[i, p] += weight
    found = lang_crf.marginals(score, np.array([0, 5]), moves)
    assert np.allclose(found, total / total.sum(axis=1, keepdims=True))


def test_messages_of_long_chains_equal_a_plain_pass():
    rng = np.random.default_rng(1)
    lengths = [1, 64, 65, 300, 2]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    score, moves = rng.normal(size=(starts[-1], 4)), rng.normal(size=(4, 4))
    found = lang_crf.marginals(score, starts, moves)
    for a, b in itertools.pairwise(starts):
        e, t = np.exp(score[a:b]), np.exp(moves)
        fwd, bwd = [np.full(4, 0.25) @ t * e[0]], [np.ones(4)]
        for i in range(1, b - a):
            x = fwd[-1] @ t * e[i]
            fwd.append(x / x.sum())
            y = t @ (e[b - a - i] * bwd[-1])
            bwd.append(y / y.sum())
        p = np.array(fwd) * np.array(bwd[::-1])
        assert np.allclose(found[a:b], p / p.sum(axis=1, keepdims=True))


def test_language_accuracy_and_unknown(spark, docs):
    rows = QUERIES["op1_language_crf"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97
    assert all(crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    found = {r["doc_id"]: r for r in lang_crf.identify(odd(spark)).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and found[7]["score"] == 0


# op2


def test_mix_oracle(spark):
    assert difference(spark, connected(), QUERIES["op2_curriculum_mix"], ORACLES["op2_curriculum_mix"]) == ""


def test_mix_meets_targets(spark):
    rows = QUERIES["op2_curriculum_mix"](spark, "/root/testdata/sf0.01").collect()
    source = {r["doc_id"]: r["source"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    sums = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = sums.setdefault(source[r["doc_id"]], [0, r["target"]])
        s[0] += r["taken"]
    assert all(abs(taken - target) <= 1 for taken, target in sums.values())


# op3


def test_quality_measures_against_loops(spark, docs):
    for r in quality_rules.score_quality(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        t = next(d["text"] for d in docs if d["doc_id"] == r["doc_id"])
        ws = WORD.findall(t)
        windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
        covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws)) and not (r["base_failed"] and r["kept"])


# op4


def test_a_planted_passage_is_removed_from_all_but_the_first(spark):
    passage = " ".join(f"planted{i}" for i in range(60)) + "."
    texts = {i: " ".join(f"own{i}x{j}" for j in range(40)) + ". " + passage + " " + " ".join(f"end{i}x{j}" for j in range(40)) + "." for i in (3, 1, 2)}
    df = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in paragraph_dedup.remove_repeats(df).collect()}
    assert out[1]["text"] == texts[1]
    for i in (2, 3):
        assert "planted" not in out[i]["text"] and f"own{i}x39." in out[i]["text"] and f"end{i}x0 " in out[i]["text"]
        assert out[i]["n_chars"] == len(out[i]["text"])


# op5


def test_near_duplicates_against_all_pairs(spark, docs):
    def shingles(t):
        ws = WORD.findall(t)
        return frozenset(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, min(len(ws), 1))))

    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    label = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = near_dedup.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == label
    assert sum(r["kept"] for r in rows) == len(set(label.values()))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["component"]) for r in connected_components(links, "a", "b").collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# op6


@pytest.mark.parametrize("ranges", [1, 7])
def test_edited_texts_and_fingerprints(spark, docs, ranges, monkeypatch):
    plain = imatch.in_order
    monkeypatch.setattr(imatch, "in_order", lambda d: plain(d, ranges))
    rows = {r["doc_id"]: r for r in imatch.fingerprint_documents(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    ordered = sorted(docs, key=lambda d: d["doc_id"])
    prints = {}
    for d, after in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        r, t = rows[d["doc_id"]], d["text"]
        k = len(t) // 4
        edited = t[: len(t) - k] + after["text"][:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.3 and np.mean([r["near_next"] for r in rows.values()]) < 0.1


# op7


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just some words", "just some words"),
        ("<nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>One  two\n three &eacute;<br>four<p>" + "Long text. " * 20 + "</article><footer>Foot</footer>", "Head & line One two three é four " + ("Long text. " * 20).strip()),
        ("<div class=ad>Buy now<article><p>" + "Body text here. " * 9 + "<p>Short.</article><div id=comments><p>" + "Nice post indeed. " * 30 + "</div>", ("Body text here. " * 9).strip() + " Short."),
        ("<main><p>" + "Kept words. " * 9 + "</p><script>var a = '<p>no</p>'</script><aside>" + "Side words. " * 20 + "</aside></main>", ("Kept words. " * 9).strip()),
    ],
)
def test_main_text(html, text):
    assert html_main.main_text(html) == text


# op8


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {i: d["text"] for i, d in enumerate(docs)} | {1000 + i: t for i, t in enumerate(["", " ", "   a  b", "\n\n x\t", "😀 ñandú 日本", "x" * 300, "a    " * 9])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pieces.encode_documents(df).collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["exact"]


# op9


def test_quality_scores_separate_held_out_rows(spark):
    rows = QUERIES["op9_quality_network"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    good = [r["score"] for r in rows if quality.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if quality.get(r["doc_id"]) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


# op10


def test_url_rules_against_a_loop(spark):
    urls = [r["url"] for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()]
    urls += [None, "", "nonsense", "http://", "HTTP://WWW.EXAMPLE.ORG/en/1?x", "x://org", "x://org/", "x://a.com/fr/x#y", "x://acom/fr/", "x://b.com/de/", "x://é.net?q/de/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_trees.judge_urls(df).collect():
        rest = u.split("://", 1)[1] if (u := urls[r["page_id"]]) and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_trees.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[2] if best else r["verdict"] in ("allow", "block")
    assert url_trees.judge_urls(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mix_sources", "sentencepiece"]
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "exact", "position"]
    found = sorted((r["position"], r["doc_id"], r["n_tokens"], r["exact"]) for r in rows.drop("ids").collect())
    assert [r[0] for r in found] == list(range(len(found))) and found and all(r[3] for r in found)
    assert sorted((r["position"], r["doc_id"], r["n_tokens"], r["exact"]) for r in corpus_pipeline.run(spark, DATA).drop("ids").collect()) == found


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
