"""Columns whose names hold dots and back-ticks pass through every operator that carries columns; other repairs of this kind."""

import time

import numpy as np
import pytest

import corpus_pipeline as pipeline
from covaria.llm import extract, fingerprint, language, lm, mixing, pieces, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "x y.z"]


@pytest.fixture(scope="module")
def named(spark):
    texts = ["the cat sat on the mat and the dog ran off", "der Hund lief und die Katze sass auf der Matte", "le chat et le chien sont dans la rue", None, "", "password = abcdef123456 and more words"]
    rows = [(i, t, ("en", "de", "fr")[i % 3], "s", len(t or ""), f"dot{i}", "tick", "both") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` string, `x y.z` string")


def test_columns_with_dots(named):
    model = language.train(named, named["doc_id"] < 3)
    for out in (
        language.identify(named, model), fingerprint.fingerprints(named), simhash.fingerprints(named), pieces.encode(named, check=True), pieces.decode(pieces.encode(named)), mixing.apply(named),
        secrets.redact(named), simhash.keep_one(named), simhash.keep_one_similar(named),
    ):
        assert out.columns[: len(COLUMNS)] == COLUMNS
        rows = out.collect()
        assert rows and all(r["a.b"] == f"dot{r['doc_id']}" and r["c`d"] == "tick" and r["x y.z"] == "both" for r in rows)


def test_stages_with_dots(spark, named, tmp_path):
    docs = named
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r["a.b"] for r in docs.collect()} <= {f"dot{i}" for i in range(6)} and docs.count()


def test_training_holds_a_million_code_points_at_once(spark, monkeypatch):
    """A long text is counted in pieces, and the counts are those of the whole."""
    text = "der Hund und die Katze laufen. " * 90_000  # 2.8 million
    parts = list(language._together(language._pieces(text)))
    assert max(sum(map(len, p)) for p in parts) <= 1 << 20 and "".join("".join(p) for p in parts) == text
    assert list(language._together([])) == [] and list(language._together(["ab", "c", "d"], 2)) == [["ab"], ["c", "d"]]
    one = spark.createDataFrame([(text, "de"), ("the cat", "en")], "text string, lang string")
    many = spark.createDataFrame([(text[a : a + 31_000], "de") for a in range(0, len(text), 31_000)] + [("the cat", "en")], "text string, lang string")
    a, b = (language.train(d, d["text"].isNotNull()) for d in (one, many))
    assert a["langs"] == b["langs"] and all(np.allclose(a["logs"][k], b["logs"][k], atol=1e-4) for k in a["logs"])


def test_unlike_rows_of_one_bucket_are_led_together():
    """8,000 rows of one key that look alike by chance only, among them ten copies of 100 texts each."""
    rng = np.random.default_rng(0)
    checks = rng.integers(0, 1 << 32, (8000, simhash.CHECKS), dtype=np.uint32)
    group = np.full(8000, -1)
    for g in range(100):
        group[g * 10 : g * 10 + 10] = g
        checks[g * 10 : g * 10 + 10] = checks[g * 10] ^ (np.uint32(1) << rng.integers(0, 32, (10, simhash.CHECKS)).astype(np.uint32))
    order = rng.permutation(8000)
    began = time.time()
    pairs, free = simhash._leaders(np.zeros(8000, dtype=np.uint64), checks[order], rng.permutation(8000))
    assert time.time() - began < 4
    group = group[order]
    found = {(int(x), int(y)) for a, b, given, _ in pairs for x, y in zip(a[given], b[given], strict=True)}
    root = list(range(8000))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[top(a)] = top(b)
    for g in range(100):
        assert len({top(i) for i in np.flatnonzero(group == g)}) == 1
    assert sum(map(lambda p: len(p[0]), pairs)) < 3000 and len(free) == 8000 and free.sum() >= 8000 - 1000


def test_main_text_at_any_depth_and_with_anchors():
    deep = "<div>" * 70 + "<nav>menu</nav><article><p>story</p></article>" + "</div>" * 70
    assert extract._text(deep, set()) == "story"
    page = (
        '<article><section id="side-effects"><p>one</p></section><h2 id="related-work">two</h2><h2 id="alert-levels">three</h2><section id="comments-on-the-law"><p>four</p></section>'
        '<section id="comments"><p>no</p></section><div class="comment-list">no</div></article><div id="side-bar">no</div>'
    )
    assert extract._text(page, set()) == "one two three four"
    assert extract._text("<article data-u=https://a.b/c/><p>in</p></article><p>out</p>", set()) == "in"
    assert extract._text("<article><svg/><p>a<br/>b</p></article>", set()) == "a b"
    began = time.time()
    assert len(extract._text("<div>x" * 50_000, set()).split()) == 50_000 and len(extract._features("<div>x" * 50_000)) == 2 * extract.DEPTH and time.time() - began < 20


def test_parts_of_a_filter_grow():
    assert lm._shape(10**6, 1 << 23)[0] == 2
    parts, bits = lm._shape(10**10, 1 << 23)
    assert parts <= lm.MANY_PARTS and bits > 1 << 23
    assert lm.MOST_PART_BITS // 2 < lm._shape(10**12, 1 << 23)[1] <= lm.MOST_PART_BITS
