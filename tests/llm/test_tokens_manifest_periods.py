"""Token counts, Merkle manifest and periodic runs against the library, plain versions and each other."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from covaria.llm import manifest, periods, pieces, tokens
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, N_RUNS string, leaf string, tree string, item int, `a.b` string, `c``d` string, path string"
LONG = "wort und " * 30_000 + "ende"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash or have dots."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, LONG, "de", "b", len(LONG)), (5, "the cat sat on the mat", "en", "a", 22), (6, "the cat", "en", None, 7),
        (6, "the cat", "en", None, 7), (6, "the dog", "en", None, 7), (None, "no id", "en", "c", 5), (None, "no id", "en", "c", 5), (9, "日本語 😀 ▁ \x00 \U0010ffff</s><s>", None, "c", None), (-10, "a " * 40, "fr", "b", 1), (30, "x y z " * 9, "", "b", 1),
    ]
    return spark.createDataFrame([(*r, 7, "r", "l", "t", 1, "dot", "tick", "p") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def merges():
    with open(pieces.model_path(), "rb") as f:
        return tokens.Merges(f.read())


# token counts


def made_up(library):
    rnd = random.Random(1)
    vocab = [library.id_to_piece(i).replace("▁", " ") for i in range(300, library.vocab_size())]
    out = ["", " ", "\n", " \n \n", "a", "</s>", "<s>hi<unk> <0x0A>", " " * 50 + "x" + " " * 33, "ab" * 600, "a" * 3000, " " * 2000, "x" * 1025, "▁▁ ▁x"]
    out += ["".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    out += ["".join(rnd.choice("abcdetion \nAB1é日\t") for _ in range(rnd.randint(1, 80))) for _ in range(500)]
    out += ["".join(rnd.choice("          \n\tx=") for _ in range(rnd.randint(1, 300))) for _ in range(100)]
    return out + ["".join(rnd.choice(vocab).strip() for _ in range(700)) for _ in range(10)]


@pytest.mark.parametrize("long", [0, 1024, 10**9])
def test_merges_are_the_librarys(library, merges, monkeypatch, long):
    """Whether sequences are merged in rounds over arrays or, when long, from a heap; slices of arrays too."""
    monkeypatch.setattr(tokens, "LONG", long)
    monkeypatch.setattr(tokens, "MERGE_BYTES", 5000)
    merges.counts.clear()
    cases = made_up(library)
    want = [len(x) for x in library.encode(cases)]
    assert merges.count(pa.array(cases)).tolist() == want
    assert merges.count(pa.array(cases).slice(100, 500)).tolist() == want[100:600]
    assert merges.count(pa.array([None, "x"], pa.string())).tolist() == [0, 2 if len(library.encode("x")) == 2 else 1]
    assert merges.count(pa.array([], pa.string())).tolist() == []


def test_what_a_task_remembers_is_bounded(library, merges, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 10)
    merges.counts.clear()
    for k in range(20):
        text = " ".join(f"w{k}x{i % 7}" for i in range(30))
        assert merges.count(pa.array([text])).tolist() == [len(library.encode(text))] and len(merges.counts) <= 10


def test_token_counts_of_documents(docs, library):
    got = {r["doc_id"]: r for r in tokens.summary(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        t = r["text"] or ""
        n = len(library.encode(t))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == (n, len(t.encode()), n > 4096)


def test_token_counts_odd(odd, library):
    got = tokens.count(odd, limit=6)
    assert got.columns == [c for c in odd.columns if c != "n_tokens"] + ["n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == 13 and all(r["n_tokens"] == len(library.encode(r["text"] or "")) and r["over_limit"] == (r["n_tokens"] > 6) and r["a.b"] == "dot" for r in rows)
    assert tokens.count(odd.limit(0)).count() == 0


def test_other_models_are_refused(merges, tmp_path):
    with pytest.raises(Exception):  # noqa: B017  whatever the library raises
        tokens.Merges(b"no model")


# Merkle manifest


def plain_manifest(rows, fan=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, built level by level."""
    shape = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: brute.sha("".join(shape(v) for v in (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))

    def tree(nodes):
        at, paths = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for i, a in enumerate(at):
                paths[i].append((nodes[a // fan * fan : a // fan * fan + fan], a % fan))
            nodes = [brute.sha("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
            at = [a // fan for a in at]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[g]]) for g in order]
    root, tops = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            d = r["doc_id"]
            acc = leaf(r, int(d is not None and zlib.crc32(str(d).encode()) % 7 == 0))
            for run, k in path + top:
                acc = brute.sha("".join(run[:k] + [acc] + run[k + 1 :]))
            proof = brute.sha("".join(h for run, k in path + top for i, h in enumerate(run) if i != k))
            out.append((d, leaf(r), subroot, root, proof, acc, acc == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "deep"), [(2, 12), (2, 2), (3, 2)])
def test_manifest_of_documents(docs, fan, deep):
    """Blocks of one or of many passes, runs of two or three."""
    got = manifest.audit(docs, fan, deep).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(docs.collect(), fan)
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 4


def test_manifest_odd(spark, odd):
    """Null ids and langs, repeated rows and ids, empty and long texts; one row, no row, one group."""
    assert sorted(map(tuple, manifest.audit(odd, deep=1).collect()), key=repr) == plain_manifest(odd.collect())
    for some in (odd.where("doc_id = 4"), odd.where("lang = 'en'"), odd.where("lang IS NULL")):
        assert sorted(map(tuple, manifest.audit(some).collect()), key=repr) == plain_manifest(some.collect())
    assert manifest.audit(odd.limit(0)).collect() == []
    single = manifest.audit(odd.where("doc_id = 4")).first()
    assert single["leaf"] == single["subroot"] == single["root"] and single["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_manifest_of_other_columns(odd):
    """Any values, key and group; a path leads to the root, and another digest doesn't."""
    built = manifest.build(odd, ["a.b", "text"], "doc_id", "c`d", {"n": F.col("n_chars")})
    rows = built.withColumn("to", manifest.fold(F.col("leaf"), F.col("path"))).withColumn("off", manifest.fold(F.sha2("leaf", 256), F.col("path"))).collect()
    assert len(rows) == 13 and all(r["to"] == r["root"] == r["subroot"] != r["off"] for r in rows)
    assert all(r["path"][0]["pre"][64 * r["path"][0]["slot"] :][:64] == r["leaf"] for r in rows)


# periodic runs


def plain_runs(w):
    """All runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(24, 3 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_summary(doc_id, text):
    w = brute.words(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return (
        len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], brute.sha("".join(f"{a},{n},{q}\n" for a, n, q in found)),
        brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_of_made_up_sequences(monkeypatch):
    rnd = random.Random(3)
    for k in range(700):
        monkeypatch.setattr(periods, "KEY_WORDS", 1 << 14 if k % 2 else 8)
        monkeypatch.setattr(periods, "AUTOMATON_WORDS", 1 << 18 if k % 3 else 16)
        n, kinds, w = rnd.randint(0, 260), rnd.choice([1, 2, 2, 3, 5, 50]), []
        while len(w) < n:
            q = rnd.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 20, 31, 32, 33, 40, 64])
            part = [rnd.randrange(kinds) for _ in range(q)]
            w += [part[i % q] for i in range(rnd.randint(1, 6 * q + 24))] if rnd.random() < 0.6 else part[:30]
        assert list(map(tuple, periods.runs(np.array(w[:n], dtype=np.int64)).tolist())) == plain_runs(w[:n]), w[:n]


@pytest.mark.parametrize(("name", "codes", "want"), [
    ("one word", np.zeros(300_000, dtype=np.int64), [[0, 300_000, 1]]), ("a third", np.arange(300_000) % 99_999, [[0, 300_000, 99_999]]), ("two levels", np.tile(np.r_[np.zeros(30, dtype=np.int64), np.arange(1, 99)], 800), None),
    ("many", np.repeat(np.arange(4000), 25), [[25 * i, 25, 1] for i in range(4000)]), ("none", np.arange(300_000), []),
])
def test_runs_of_long_sequences(name, codes, want):
    """Long texts, with one run of any length or thousands of them."""
    got = periods.runs(codes).tolist()
    assert got == want if want is not None else (len(got) == 801 and [0, len(codes), 128] in got)


def test_runs_of_documents(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in periods.summary(docs).collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if len(brute.words(r["text"])) < 1500]
    assert len(got) == docs.count() and len(rows) > 100 and sum(v[0] > 0 for v in got.values()) > 10
    for r in rows:
        assert got[r["doc_id"]] == plain_summary(r["doc_id"], r["text"]), r["doc_id"]


def test_runs_odd(odd):
    """Nulls, empty and long texts, repeated rows; other columns stay, and a table without rows has none."""
    got = periods.detect(odd, alter=True)
    assert got.columns == [c for c in odd.columns if c != "N_RUNS"] + list(periods.COLUMNS)
    rows = got.collect()
    assert len(rows) == 13 and all(r["a.b"] == "dot" and r["c`d"] == "tick" for r in rows)
    for r in rows:
        if r["text"] != LONG:
            assert tuple(r[c] for c in periods.COLUMNS) == plain_summary(r["doc_id"], r["text"])
    long = next(r for r in rows if r["text"] == LONG)
    assert long["n_runs"] == 1 and (long["start"], long["length"], long["period"]) == (0, 60_000, 2)
    assert long["collapsed_sha256"] == brute.sha("wort und ende")
    assert periods.detect(odd.limit(0)).count() == 0
