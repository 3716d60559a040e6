"""Operators on odd rows and whole small tables, held against plain versions."""

import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from covaria.llm import chat, extract, fingerprint, language, lm, mixing, pieces, quality, queries, secrets, simhash
from covaria.llm.common import held_out, split_words
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row int, fp string, _row string, ids string"
LONG = "wort und " * 30_000 + "ende"
KEY = "AKIA" + "Z9" * 9


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    x = [7, "k", 1, "f", "r", "i"]
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, LONG, "de", "b", len(LONG)), (5, "the cat sat on the mat and the dog", "en", "a", 33),
        (6, "the cat sat on the mat and the dog", "en", None, 33), (6, "the cat sat on the mat and the dog", "en", None, 33), (None, "no id at all here", "en", "c", 17),
        (8, f"api_key = 'abcdef123456' then {KEY} and {'0f' * 13} €", "en", "a", 70), (9, "日本語 😀 ▁ \x00 \U0010ffff", None, "c", 12), (10, "12 34 !!", "fr", "b", 8), (11, "a", "fr", "b", 1),
    ]
    return spark.createDataFrame([(*r, *x) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_words_of_a_slice_are_its_own():
    """PyArrow 23's ascii_lower misreads slices, and operators pass slices of batches."""
    texts = pa.array([f"Ein Ä{i} Satz mit {i * 7} Wörtern und É mehr davon" for i in range(900)] + ["", None, "KURZ"])
    for kind in (pa.string(), pa.large_string()):
        words, counts = split_words(texts.cast(kind).slice(350, 553))
        want = [brute.words(brute.lower(t)) for t in texts.to_pylist()[350:903]]
        assert counts.tolist() == list(map(len, want)) and words.to_pylist() == [w for ws in want for w in ws]


# mixing


def check_mix(docs):
    got = mixing.mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.words(r["text"]))
    want, taken = brute.mix_targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    return got


def test_mix(docs):
    got = check_mix(docs)
    n = Counter()
    for r in mixing.apply(docs).collect():
        n[r["doc_id"]] += len(brute.words(r["text"]))
    assert n == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})


def test_mix_odd(odd):
    check_mix(odd)
    made = mixing.apply(odd)
    assert made.columns == odd.columns and sum(len(brute.words(r["text"])) for r in made.collect()) == sum(r["taken"] for r in mixing.mix(odd).collect())
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.apply(odd.limit(0)).count() == 0


def test_mix_prefers_long_documents(spark):
    rows = [(i, "w " * (1 if i % 2 else 20), "ab"[i < 600]) for i in range(1200)] + [(2000 + i, "w " * 200, "c") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 1.0, 30.0)).where("source = 'a'")
    full = {r["size"]: r["share"] for r in got.groupBy("size").agg(F.avg((F.col("taken") > 0).cast("int")).alias("share")).collect()}
    assert 0 < full[1] < full[20] <= 1


# language


def test_language(docs):
    model = language.train(docs, ~held_out(4))
    got = by_id(language.identify(docs.select("doc_id", "text"), model))
    rows = [r for r in docs.collect() if brute.held(r["doc_id"], 4) and r["lang"] and len(r["text"] or "") > 50]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_spans(spark, docs):
    model = language.train(docs, F.lit(True))
    long = {x: next(r["text"] for r in docs.where(f"lang = '{x}' AND n_chars > 1500").collect()).replace("\n", " ") for x in ("en", "fr")}
    mixed = spark.createDataFrame([(1, " ".join(long["en"].split()[:60]) + " " + " ".join(long["fr"].split()[:40]))], "doc_id long, text string")
    spans = by_id(language.identify(mixed, model))[1]["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and abs(spans[0]["words"] - 60) <= 5


def test_language_odd(odd, docs):
    model = language.train(docs, F.lit(True))
    got = language.identify(odd, model)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    nothing = language.train(odd.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_language_of_scripts_not_learned(spark, docs):
    model = language.train(docs, F.lit(True))
    known = next(r["text"] for r in docs.where("lang = 'en' AND n_chars > 500").collect())
    rows = [(1, known), (2, "这是一个中文句子没有别的语言"), (3, "Это русский текст"), (4, known + " это русский текст " * 20)]
    got = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, Score string").withColumnRenamed("Score", "text").withColumn("Score", F.lit("mine")), model))
    assert got[1]["score"] > 0.8 and got[2]["score"] == got[3]["score"] == got[2]["sure"] == 0 and 0 < got[4]["score"] < got[1]["score"]
    again = language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("mine")), model, names=("_a", "_b", "_c", "_d"))
    assert {r["Score"] for r in again.collect()} == {"mine"}


def test_viterbi_against_brute_force():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(5)
    counts = rng.integers(0, 6, 40)
    scores = rng.normal(0, 4, (int(counts.sum()), 3)).astype(np.float32)
    path, at = language._viterbi(scores, counts, 2.5), 0
    total = lambda p, s: sum(s[i, k] for i, k in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for n in counts.tolist():
        s = scores[at : at + n]
        best = max(total(p, s) for p in product(range(3), repeat=n))
        assert math.isclose(total(path[at : at + n].tolist(), s), best, abs_tol=1e-3)
        at += n


def test_long_texts_are_cut_between_words():
    text = "abc défg " * 1000 + "x" * 5000 + " end"
    parts = language._pieces(text, 100)
    assert "".join(parts) == text and all(len(p) <= 100 for p in parts) and sum(p.endswith(" ") for p in parts) > 80


# secrets


def check_secrets(docs):
    got = secrets.report(secrets.scan(docs)).collect()
    want = Counter()
    kinds = "assign", "access", "hex"
    for r in docs.select("doc_id", "text").collect():
        s = brute.base_spans(r["text"])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)
        want[r["doc_id"], *(sum(k == i for _, k, _ in s) for i in range(3)), brute.sha(joined)] += 1
        own = next(g for g in got if g["doc_id"] == r["doc_id"])
        assert set(filter(None, joined.split(","))) <= set(own["spans"].split(","))
    assert want == Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got)
    return got


def test_secrets(docs):
    check_secrets(docs)


def test_secrets_odd(odd):
    check_secrets(odd)
    assert secrets.scan(odd.limit(0)).count() == 0
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    text = texts(clean)
    assert KEY not in text[8] and text[8].startswith("[secret]' then [secret] and [secret]") and text[1] is None and text[4] == LONG


def test_secrets_examples_stay(spark):
    rows = [(i, f"see AKIA{'E' * 16} in the manual", f"s{i}", "en") for i in range(9)] + [(99, f"mine AKIA{'L' * 16}", "s1", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = by_id(secrets.report(secrets.scan(d)))
    assert got[99]["n_live"] == 1 and all(got[i]["n_live"] == 0 and got[i]["n_access"] == 1 for i in range(9))
    text = texts(secrets.redact(d))
    assert "[secret]" in text[99] and "AKIA" in text[0]


def test_secrets_of_the_table_that_owners_share(spark):
    """Values that several sources of the fixture hold are examples, those of one source are live however often it repeats them."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, owners = d.select("doc_id", "text", "source").collect(), defaultdict(set)
    values = {r["doc_id"]: [(r["text"] or "")[a:b] if k else brute.ASSIGN.match(r["text"], a)[1] for a, k, b in brute.base_spans(r["text"])] for r in rows}
    for r in rows:
        for v in values[r["doc_id"]]:
            owners[v].add(r["source"])
    got = by_id(secrets.report(secrets.scan(d)))
    assert all(got[i]["n_live"] >= sum(len(owners[v]) == 1 for v in vs) for i, vs in values.items())
    assert all(got[i]["n_example"] <= sum(len(owners[v]) > 1 for v in vs) for i, vs in values.items())
    assert sum(r["n_example"] for r in got.values()) > 0


def test_secrets_many_matches(spark):
    """A dump of very many matches takes time in proportion, and is cut right."""
    import time

    began = time.time()
    text = " ".join(f"{i:06x}" + "a" * 20 for i in range(100_000)) + " 日 end"
    d = spark.createDataFrame([(1, text, "s", "en"), (2, "x", "t", "en")], "doc_id long, text string, source string, lang string")
    assert by_id(secrets.report(secrets.scan(d)))[1]["n_hex"] == 100_000
    assert texts(secrets.redact(d))[1] == " ".join(["[secret]"] * 100_000) + " 日 end" and time.time() - began < 60


# near-duplicates


def test_simhash(docs):
    got = by_id(simhash.near_duplicates(docs))
    prints = [(d, brute.simhash(t)) for d, t in texts(docs).items()]
    want = brute.components(prints)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{h:016x}", want[d]) for d, h in prints}
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_simhash_odd(odd):
    named = odd.where("doc_id IS NOT NULL")
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = brute.components([(r["doc_id"], brute.simhash(r["text"])) for r in named.collect()])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    kept = simhash.keep_one(odd)
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == odd.columns and kept.where("doc_id = 6").count() <= 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_chains_and_blocks(spark, monkeypatch):
    """Links at every distance to 5, and chains, whatever the size of blocks."""
    import random

    rng = random.Random(3)
    prints = []
    for i in range(60):
        x = rng.getrandbits(64)
        for step in range(6):
            prints.append(x)
            for b in rng.sample(range(64), step):
                x ^= 1 << b
    rows = [((p - (1 << 64) if p >> 63 else p),) for p in prints]
    df = spark.createDataFrame(rows, "fp long")
    want = brute.components(list(enumerate(prints)))
    for variants in (simhash.BLOCK_VARIANTS, 500):
        monkeypatch.setattr(simhash, "BLOCK_VARIANTS", variants)
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
        got = defaultdict(set)
        for i, (p,) in enumerate(rows):
            got[roots.get(p, p)].add(want[i])
        assert all(len(s) == 1 for s in got.values()) and len(got) == len(set(want.values()))


# extraction

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title {i}</h1><p>First &amp; <b>bold{i}</b> text&nbsp;of   page {i}.</p><div class="promo-box">Same box</div><p>Second {j} line<br>goes on.</p></article>
<section class="comments"><p>Reader {i} says</p></section><footer>About us</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_extract(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, j=i * 7)) for i in range(8)] + [(20, None, None), (21, "odd", ""), (22, "http://x.example", "plain <p>text</p>"), (22, "http://x.example", "plain <p>text</p>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = by_id(extract.extract(df), "page_id")
    for i in range(8):
        assert got[i]["text"] == f"Title {i} First & bold{i} text of page {i}. Second {i * 7} line goes on." and got[i]["n_chars"] == len(got[i]["text"])
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "plain text" and extract.extract(df).count() == len(rows)
    assert extract.extract(df.limit(0)).count() == 0


def test_style_tree_removes_what_recurs(spark):
    """A box that no name marks goes where all pages of a host share it, and stays on a host with few pages."""
    page = "<body><div class=x1><p>Join our club today for more</p></div><div class=x2><p>Story number {0} tells of {1} and {2}.</p></div></body>"
    rows = [(i, f"http://many.example/{i}", page.format(i, i * i, "abc"[i % 3])) for i in range(12)] + [(100, "http://few.example/1", page.format(1, 2, 3))]
    got = by_id(extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all("club" not in got[i]["text"] and f"Story number {i} " in got[i]["text"] for i in range(12)) and "club" in got[100]["text"]


def test_extract_broken_and_deep_pages():
    article = "<article class='post'><header class=article-header><h1>Big  news</h1></header><p>It &lt;works&gt; now.</article>"
    for page, want in {
        f"<script>for(var i=0;i<n;i++){{}}</script>{article}": None, f"<body class='single has-sidebar'>{article}<aside>x</aside></body>": None,
        f"<form id=aspnet><div class=sidebar>s</div>{article}</form>": None, f"<html><head><title>t</title><meta x>{article}": None,
        f"<div class=related><article><p>Other</p></article></div>{article}<div id=comments><article>me</article></div>": None,
        "<b>" * 3000 + "<div>" * 3000 + "deep <i>down</i>": "deep down", "</p>" * 10 + "a < b<br>c" + "<script>": "a < b c", "<p>one<p class=ad>two<p>three": "one three",
    }.items():
        assert extract._text(page, set()) == (want or "Big news It <works> now.")


def test_style_tree_against_brute_force(spark, sf_dir):
    """Importance from plain counts, on the table's pages and on a host whose pages share boxes."""
    rows = [(i, f"http://h.example/{i}", f"<body><div class=a><p>Same words</p></div><div class=b><p>{i * i}</p>" + "<p>more</p>" * (i % 3) + "</div></body>") for i in range(7)]
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").limit(300).union(spark.createDataFrame(rows, "page_id long, url string, html string"))
    hosted = df.withColumn("host", F.regexp_extract("url", "//([^/?#]*)", 1)).cache()
    got = {(r["host"], r["path"]): r["importance"] for r in extract.site_trees(hosted).collect()}
    sites = defaultdict(dict)
    for r in hosted.collect():
        features = extract._features(r["html"] or "")
        sites[r["host"]][tuple(f[3] for f in features if f[2] == "text")] = features
    want, novel = {}, {}
    for host, pages in sites.items():
        seen, above, weight = defaultdict(lambda: defaultdict(set)), {}, {}
        for name, features in pages.items():
            for path, up, kind, value, w in features:
                seen[path][kind, value].add(name)
                if kind == "text":
                    above[path], weight[path, value] = up, w
        m = {p: len(set().union(*v.values())) for p, v in seen.items()}
        for p, v in seen.items():
            if (t := [len(x) for (kind, _), x in v.items() if kind == "text"]) and m[p]:
                novel[p] = 1 - sum(map(math.log, t)) / len(t) / math.log(m[p]) if m[p] > 1 else 1.0
        for p, v in seen.items():
            styles = [len(x) / m[p] for (kind, _), x in v.items() if kind == "style"]
            own = min(1.0, max(0.0, -sum(x * math.log(x) for x in styles) / math.log(m[p]))) if m[p] > 1 else None
            under = [(novel[q], sum(w for (x, _), w in weight.items() if x == q)) for q, up in above.items() if p in up]
            content = sum(a * b for a, b in under) / sum(b for _, b in under) if under else own
            rest = 0.9 ** max(1, len(styles))
            want[host, p] = 1.0 if m[p] < extract.PAGES else (1 - rest) * own + rest * content
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    texts_ = by_id(extract.extract(df.where("url LIKE 'http://h.example/%'")), "page_id")
    assert all(texts_[i]["text"].startswith(str(i * i)) and "Same" not in texts_[i]["text"] for i in range(7))


# pieces


def test_pieces_equal_the_library(docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for df in (docs, odd):
        got = pieces.encode(df.select("doc_id", "text"), check=True).collect()
        assert len(got) == df.count()
        for r in got:
            assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])
    again = pieces.decode(pieces.encode(docs)).where("decoded = text").count()
    assert again == docs.where("text IS NOT NULL").count()
    assert pieces.summary(odd.limit(0)).count() == 0 and pieces.summary(odd).count() == odd.count()


def test_pieces_random_texts():
    import random

    import sentencepiece

    model = open(pieces.model_path(), "rb").read()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefgh ▁\néßñ日😀  \t.,") for _ in range(rng.randint(0, 80))) for _ in range(800)] + ["a" * 300, "ab" * 99, " " * 70 + "x", "<s></s><0x0A>[INST]"]
    assert own.encode(pa.array(made)).to_pylist() == [sp.encode(t) for t in made]
    pieces_kept, pieces.WORDS_KEPT = pieces.WORDS_KEPT, 10
    try:
        assert own.encode(pa.array(made[:50])).to_pylist() == [sp.encode(t) for t in made[:50]]
    finally:
        pieces.WORDS_KEPT = pieces_kept


# language model


def check_lm(df, **options):
    got = lm.score(df, **options).collect()
    rows = df.select("doc_id", "text").collect()
    tokens = [(r["doc_id"], [*brute.words(brute.lower(r["text"])), None]) for r in rows]
    c = Counter(t for d, ts in tokens if not brute.held(d, 7) for t in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((d, brute.held(d, 7), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 4)) for d, ts in tokens)
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    return got


def exact_scores(df):
    """The model's formula with exact counts and weights, by plain counting."""
    rows = [(r["doc_id"], [*brute.words(brute.lower(r["text"])), None]) for r in df.select("doc_id", "text").collect()]
    word, pair, kinds, paired = Counter(), Counter(), Counter(), Counter()
    for d, ts in rows:
        if not brute.held(d, 7):
            word.update(ts)
            pair.update(zip(["<"] + ts, ts, strict=False))
            word["<"] += 1
    for (v, _), n in pair.items():
        kinds[v] += 1
        paired[v] += n
    size = sum(n for w, n in word.items() if w != "<") + len(word) - ("<" in word) + 1
    back = lambda v: 1 - (paired[v] - lm.DISCOUNT * kinds[v]) / word[v] if word[v] else 1.0
    p = lambda v, w: (max(0, pair[v, w] - lm.DISCOUNT) / max(1, word[v])) + back(v) * (word[w] + 1) / size
    return {d: sum(math.log10(min(1, p(v, w))) for v, w in zip(["<"] + ts, ts, strict=False)) for d, ts in rows}


def test_lm(docs):
    got = check_lm(docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    want, tokens = exact_scores(docs), sum(r["n_tokens"] for r in got)
    errors = [r["score"] - want[r["doc_id"]] for r in got]
    # levels a factor of 1.5 apart: log10 of a token's probability is off by 0.05 on average at most, and by chance either way
    assert abs(sum(errors)) / tokens < 0.02 and sum(map(abs, errors)) / tokens < 0.05
    dealt = by_id(lm.score(docs, filter_bytes=0, part_bits=1 << 18))
    whole = by_id(lm.score(docs, part_bits=1 << 18))
    assert all(math.isclose(whole[d]["score"], r["score"], rel_tol=1e-9) for d, r in dealt.items())


def test_lm_odd(odd):
    got = check_lm(odd)
    assert all(r["score"] <= 0 for r in got)
    check_lm(odd, filter_bytes=0)
    for options in ({}, {"filter_bytes": 0}):
        assert lm.score(odd.limit(0), **options).count() == 0
        assert {r["score"] for r in lm.score(odd.where("doc_id = 5"), F.lit(True), **options).collect()} == {0.0}


def test_lm_filter(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    key, level = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(1, 12, 5000)
    rows = spark.createDataFrame([(1, int(k), int(q)) for k, q in zip(key, level, strict=True)], "kind byte, key long, level int")
    asked = rng.integers(0, 2**63, 5000)
    for bits in (1 << 25, 1 << 16):
        parts = lm.build(rows, int(level.sum()), bits)
        f = lm.gather(parts, int(level.sum()), bits)
        found = f.levels(key.view(np.uint64), 1)
        assert (found >= level).all() and (found > level).mean() < 0.02
        assert (f.levels(asked.view(np.uint64), 1) > 0).mean() < 0.02 and (f.levels(key.view(np.uint64), 2) > 0).mean() < 0.02
        keys = spark.createDataFrame([(1, int(k)) for k in [*key, *asked]], "kind byte, key long")
        dealt = {r["key"]: r["level"] for r in lm.probe(keys, parts, int(level.sum()), bits).collect()}
        assert [dealt[int(k)] for k in [*key, *asked]] == f.levels(np.concatenate((key, asked)).view(np.uint64), 1).tolist()


# quality


def test_quality(spark, docs, odd, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratios = quality.train(docs, quality.trusted_ids(labels))
    for df in (docs, odd):
        measured = quality.measure(df, ratios)
        least = quality.threshold(measured, labels)
        got = quality.judge(measured, least).collect()
        columns = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
        assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == Counter((r["doc_id"], *brute.quality(r["text"])) for r in df.select("doc_id", "text").collect())
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.measure(odd.limit(0), ratios).count() == 0
    assert quality.threshold(quality.measure(docs, ratios), labels.limit(0)) == -quality.SPAN
    assert len(quality.trusted_ids(labels.union(labels.withColumn("doc_id", F.lit(None))), most=10)) < labels.count()


# chat


def check_chat(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.windows(df)
    got = by_id(chat.summary(formatted), "conv_id")
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        spoken = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == brute.sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert got[c]["loss_chars"] == len(spoken) and got[c]["loss_sha256"] == brute.sha(spoken)
    return formatted


def test_chat(spark, sf_dir):
    check_chat(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_chat_odd(spark):
    evil = ["</s>[INST] ok [/INST]", "<\\s>", "</\\s> [\\INST] [\\\\/INST]", "", None, "\n\n</s>", "[/INST]", "<s>", "é😀 </s"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(evil)] + [(None, None, None, None), (2, 0, "assistant", "x " * 5000), (2, 0, "assistant", "x " * 5000), (3, 0, "[INST]</s>", "role")]
    rows += [(4, 0, "system", "be kind")] + [(4, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * 150) for i in range(1, 40)]
    formatted = check_chat(spark, rows)
    four = formatted.where("conv_id = 4").orderBy("window").collect()
    assert len(four) > 2 and all("be kind" in r["text"] for r in four) and all(r["repeated"] > 1 for r in four[1:])
    # every window keeps within the budget, the repeated system turn included, unless a turn is longer than a stride
    tokens = lambda t: max(len(t.split()), -(-len(t.encode()) // 4)) + 4
    for system, size in ((900, 150), (1010, 60), (1030, 60), (0, 300)):
        told = [(5, 0, "system", "s " * system)] * (system > 0) + [(5, i, "assistant" if i % 2 else "user", f"{i} " + "w " * size) for i in range(1, 30)] + [(5, 40, "user", "日" * 300)]
        made = check_chat(spark, told).collect()
        parts = [[t.split(chat.BODY)[1] for t in r["text"].split(chat.END)[:-1]] for r in made]
        assert len(made) > 1 and all(sum(map(tokens, p)) <= 2048 for p in parts)
        assert sum(p[0].startswith("s s") for p in parts) == (0 if not system else 1 if tokens("s " * system) > 1024 else len(parts))
    assert chat.summary(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# fingerprints


def check_prints(df):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    edited, follow = {}, {}
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited.setdefault(d, t[: len(t) - half] + n[:half])
        follow.setdefault(d, n)
    got = fingerprint.edits(df).collect()
    assert len(got) == len(rows)
    errors, seen = [], {}
    for r in got:
        text = dict(rows)[r["doc_id"]]
        if sum(d == r["doc_id"] for d, _ in rows) == 1:
            assert r["n_chars"] == len(text) and r["edited_sha256"] == brute.sha(edited[r["doc_id"]])
            errors += [r["near_edited"] - brute.jaccard(text, edited[r["doc_id"]]), r["near_next"] - brute.jaccard(text, follow[r["doc_id"]])]
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    return errors


def test_fingerprints(docs):
    errors = check_prints(docs)
    assert max(map(abs, errors)) < 0.25 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_fingerprints_odd(odd, monkeypatch):
    check_prints(odd)
    assert fingerprint.edits(odd.limit(0)).count() == 0
    one = fingerprint.edits(odd.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    small = fingerprint.with_next(odd, rows_per_range=2)
    assert small.where("guest = 0").count() == odd.count()


def test_queries_have_the_columns(spark, sf_dir):
    want = {
        "op1": "doc_id size source_size target taken", "op2": "doc_id held_out lang_pred score", "op3": "doc_id n_assign n_access n_hex base_sha256 spans", "op4": "doc_id fingerprint component_id",
        "op5": "page_id url text n_chars", "op6": "doc_id n_tokens ids", "op7": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op10": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op11": "doc_id n_bytes n_tokens over_limit",
        "op12": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    }
    for name, f in queries.queries().items():
        df = f(spark, sf_dir)
        assert set(want[name.split("_")[0]].split()) <= set(df.columns)
        table = {"op5": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
        n = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        assert df.count() == (n.select("conv_id").distinct().count() + 1 if table == "conversations" else n.count())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda rows, columns: sorted((tuple(round(r[columns.index(c)], 6) if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in names) for r in rows), key=repr)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)
