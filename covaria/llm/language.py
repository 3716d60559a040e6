"""Language identification: script ranges narrow candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.llm.common import mix64, slices, with_arrays

# First and last code points of scripts' letters. Letters outside are of script 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x5D0, 0x5F4)],
    "arabic": [(0x620, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE01, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "kana": [(0x3041, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
BUCKETS = 1 << 16
ORDERS = (2, 3)
#: Cost of a change of language between two words, in nats.
SWITCH = 6.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Values of n-grams that are gathered at once; log-odds below which a language counts as out of the question.
GATHERED, FLOOR = 1 << 22, -40.0


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 + place in SCRIPTS (0: other), and whether it is a letter."""
    script = np.zeros(0x110000, dtype=np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = i + 1
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return script, letter


class _Chars:
    """Code points of a slice of texts, lowered, with a space before and after each text; words and n-gram buckets."""

    script, letter = None, None

    def __init__(self, texts: list[str]) -> None:
        if _Chars.letter is None:
            _Chars.script, _Chars.letter = _tables()
        joined = " " + " ".join(texts) + " "
        self.c = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        # lower() may lengthen a text, so its length is taken after it
        lens = np.fromiter((len(t.lower()) for t in texts), dtype=np.int64, count=len(texts))
        self.first = 1 + np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
        self.is_letter = _Chars.letter[self.c]
        # runs of letters are words
        edge = np.diff(self.is_letter.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(np.concatenate((edge, [-1 if self.is_letter[-1] else 0]))[1:] == -1) + 1
        self.text = np.searchsorted(self.first, self.start, side="right") - 1

    def grams(self, order: int) -> np.ndarray:
        """Bucket of the n-gram that begins at each place; what isn't a letter counts as a word's edge."""
        x = np.where(self.is_letter, self.c, 32).astype(np.uint64)
        key = np.full(len(x), order, dtype=np.uint64)
        for k in range(order):
            key = (key << np.uint64(21)) | np.concatenate((x[k:], np.full(k, 32, dtype=np.uint64)))
        return (mix64(key) % np.uint64(BUCKETS)).astype(np.int64)

    def scores(self, words: np.ndarray, grams: np.ndarray, order: int, logs: np.ndarray) -> np.ndarray:
        """Sums of logs (buckets, languages) over the n-grams of the words named, their edges included."""
        a = self.start[words] - 1
        n = np.maximum(self.end[words] + 1 - order, a) + 1 - a
        out = np.empty((len(words), logs.shape[1]), dtype=np.float32)
        many, lo = np.cumsum(n), 0
        while lo < len(words):  # so many n-grams at once that their logs stay within GATHERED
            hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + GATHERED // logs.shape[1], side="right")))
            first = np.cumsum(n[lo:hi]) - n[lo:hi]
            at = np.repeat(a[lo:hi] - first, n[lo:hi]) + np.arange(int(n[lo:hi].sum()))
            out[lo:hi] = np.add.reduceat(logs[grams[at]], first, axis=0)
            lo = hi
        return out


def _pieces(text: str, limit: int = 1 << 20) -> list[str]:
    """Parts of about `limit` code points, cut after something that isn't a letter; a longer run of letters is cut in it."""
    out, at = [], 0
    while len(text) - at > limit:
        to = next((i for i in range(at + limit, at + limit // 2, -1) if not text[i - 1].isalpha()), at + limit)
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def _together(pieces: Iterable[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Pieces of texts in lists of about `limit` code points, which bounds the arrays made of one."""
    some, size = [], 0
    for p in pieces:
        if some and size + len(p) > limit:
            yield some
            some, size = [], 0
        some.append(p)
        size += len(p)
    if some:
        yield some


def train(docs: DataFrame, labelled: Column, lang: str = "lang") -> dict:
    """Counts of hashed letter n-grams and scripts by language over every labelled row with text; a small dict.

    Counting runs in tasks and is summed over the shuffle; what comes back is one row per language, order and
    bucket at most. Raises ValueError beyond 2,000 languages, which bounds the model. Rows with a null text or label
    don't count, repeated rows count as often as they are there, and a table without labelled rows gives no languages.
    """
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text")
    orders = list(ORDERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for part in slices(batches):
            names, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for name in set(names):
                for some in _together(p for n, t in zip(names, texts, strict=True) if n == name for p in _pieces(t)):
                    chars = _Chars(some)
                    inside = chars.is_letter.copy()
                    inside[:-1] |= chars.is_letter[1:]
                    for order in orders:
                        n = np.bincount(chars.grams(order)[inside], minlength=BUCKETS)
                        totals[name, order] = totals.get((name, order), 0) + n
                    n = np.bincount(_Chars.script[chars.c[chars.is_letter]], minlength=len(SCRIPTS) + 1)
                    totals[name, 0] = totals.get((name, 0), 0) + n
        for (name, order), n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), order), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "kind", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    # a language's table fits one row: buckets are few
    per = counted.groupBy("lang", "kind").agg(F.collect_list(F.struct("bucket", "n")).alias("at")).limit(2_000 * (len(orders) + 1) + 1).collect()
    langs = sorted({r["lang"] for r in per})
    if len(langs) > 2_000:
        raise ValueError("more than 2,000 languages")
    tables = {k: np.zeros((BUCKETS if k else len(SCRIPTS) + 1, max(1, len(langs))), dtype=np.float64) for k in (0, *orders)}
    for r in per:
        at = np.array([(x["bucket"], x["n"]) for x in r["at"]], dtype=np.int64)
        tables[r["kind"]][at[:, 0], langs.index(r["lang"])] = at[:, 1]
    logs = {k: np.log((tables[k] + 0.05) / (tables[k].sum(axis=0) + 0.05 * BUCKETS)).astype(np.float32) for k in orders}
    share = tables[0] / np.maximum(1, tables[0].sum(axis=0))
    return {"langs": langs, "logs": logs, "allowed": share >= SCRIPT_SHARE}


def _viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best state of each word; scores (words, states) of texts one after the other, counts words in each text.

    Texts step side by side, the longest first, so the loop runs once per word place and not once per word. A state
    is kept or left for the best one at a cost, so one flag per word and state is all that tracing back needs.
    """
    order = np.argsort(-counts, kind="stable")
    n, first = counts[order], np.concatenate(([0], np.cumsum(counts)))[:-1][order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
    d = np.zeros((len(n), scores.shape[1]), dtype=np.float32)
    moved = np.zeros(scores.shape, dtype=bool)
    best = np.zeros(len(scores), dtype=np.int32)
    for t in range(longest):
        at = first[: active[t]] + t
        now = d[: active[t]]
        if t:
            best[at - 1] = top = now.argmax(axis=1)
            now -= now[np.arange(len(top)), top][:, None]
            low = now < -switch
            moved[at] = low
            now[low] = -switch
        now += scores[at]
    path = np.zeros(len(scores), dtype=np.int32)
    state = d.argmax(axis=1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        at, now = first[: active[t]] + t, state[: active[t]]
        path[at] = now
        if t:
            state[: active[t]] = np.where(moved[at, now], best[at - 1], now)
    return path


def identify(docs: DataFrame, model: dict, switch: float = SWITCH, names: tuple[str, ...] = ("lang_pred", "score", "sure", "spans")) -> DataFrame:
    """Add lang_pred, score, sure and spans to docs, under `names`: spans is an array of (lang, words) in text order.

    Words are runs of letters. Script ranges leave each word its candidates, and only these are scored, by log-odds summed
    over letter n-grams; Viterbi with a switching cost labels the words. A word of a script that no learned language uses has
    no candidate and fits none: it takes its neighbours' label and its posterior is 0.
    lang_pred has the most letters; score is the mean posterior over all letters of words with that label, others counting 0,
    from 0 to 1. sure is the mean posterior of all words, each in the language that its span is labelled with.
    A text that is null or has no letter is `und` with score 0, and so is every text when nothing was learned. Ties go
    to the first language in order; repeated rows get equal results; an empty table gives no rows. Columns of docs with one of
    the names, in any case, are replaced. Texts beyond a million code points are scored in parts and labelled as a whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = dict(zip(names, ("string", "double", "double", "array<struct<lang:string,words:int>>"), strict=True))

    def make():
        m = sent.value
        langs, many = m["langs"], max(1, len(m["langs"]))

        @lru_cache(None)
        def table(order: int, script: int) -> np.ndarray:
            return m["logs"][order] if m["allowed"][script].all() else np.ascontiguousarray(m["logs"][order][:, m["allowed"][script]])

        def compute(given: pa.Array) -> list[pa.Array]:
            texts = pc.fill_null(given, "").to_pylist()
            scores, owners, letters, strange = [], [], [], []
            todo = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
            at = 0
            while at < len(todo):  # about a million code points at once
                to, size = at, 0
                while to < len(todo) and (to == at or size + len(todo[to][1]) <= 1 << 20):
                    size += len(todo[to][1])
                    to += 1
                chars = _Chars([p for _, p in todo[at:to]])
                if len(chars.start):
                    words = np.full((len(chars.start), many), FLOOR, dtype=np.float32)
                    script = _Chars.script[chars.c[chars.start]]
                    grams = {order: chars.grams(order) for order in ORDERS}
                    for k in np.unique(script):
                        able, at_ = np.flatnonzero(m["allowed"][k]), np.flatnonzero(script == k)
                        if len(able):
                            own = sum(chars.scores(at_, grams[order], order, table(order, k)) for order in ORDERS)
                            words[np.ix_(at_, able)] = np.maximum(own - own.max(axis=1, keepdims=True), FLOOR)
                        else:
                            words[at_] = 0.0
                    strange.append(~m["allowed"][script].any(axis=1))
                    scores.append(words)
                    owners.append(np.array([i for i, _ in todo[at:to]], dtype=np.int64)[chars.text])
                    letters.append((chars.end - chars.start).astype(np.float64))
                at = to
            pred, score, fit, spans = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
            if scores and langs:
                s, owner, weight = np.concatenate(scores), np.concatenate(owners), np.concatenate(letters)
                counts = np.bincount(owner, minlength=len(texts))
                path = _viterbi(s, counts, switch)
                held = np.bincount(owner * many + path, weights=weight, minlength=len(texts) * many).reshape(-1, many)
                some = counts > 0
                pred[some] = held.argmax(axis=1)[some]
                e = np.exp(s)
                sure = np.where(np.concatenate(strange), 0.0, e[np.arange(len(path)), path] / e.sum(axis=1))
                # words weigh by their letters
                mine = path == pred[owner]
                total = np.bincount(owner, weights=weight, minlength=len(texts))
                score = np.bincount(owner, weights=weight * np.where(mine, sure, 0), minlength=len(texts)) / np.maximum(total, 1)
                fit = np.bincount(owner, weights=weight * sure, minlength=len(texts)) / np.maximum(total, 1)
                cut = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (owner[1:] != owner[:-1]))))
                for a, n in zip(cut.tolist(), np.diff(np.append(cut, len(path))).tolist(), strict=True):
                    spans[owner[a]].append({"lang": langs[path[a]], "words": n})
            named = [langs[p] if p >= 0 else "und" for p in pred]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
            return [pa.array(named, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.clip(fit, 0, 1)), pa.array(spans, kind)]

        return compute

    return with_arrays(docs, ("text",), added, make)
