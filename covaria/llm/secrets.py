"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.llm.common import BROADCAST_ROWS, broadcast_if_small, materialize, quoted

# Kinds of secrets in listed order, patterns and least lengths of the whole match or of group 2.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Kinds that the method adds where only few owners hold the value.
ADDED = {
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "prefixed": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----",
}
KINDS = [*BASE, *ADDED]
LEAST_ASSIGN = 6
SPAN = "struct<start:int,k:int,kind:string,end:int,hash:string>"
#: Code points of the pieces in which a text is cut up for replacing.
PIECE = 4096


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (k, i, gap, length, ok, hash) of all matches in order, leftmost and not overlapping, in code points.

    Gaps between matches come from splitting the text at the pattern, so sums of gaps and lengths are the offsets.
    """
    k, lit = KINDS.index(kind), F.lit(pattern)
    value = F.regexp_extract_all(text, lit, F.lit(2 if kind == "assign" else 0)).alias("value")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, lit, F.lit(0)).alias("hit"), value)
    least = LEAST_ASSIGN if kind == "assign" else 1
    # the last gap has no match beside it
    made = F.transform(
        F.filter(zipped, lambda p: p["hit"].isNotNull()),
        lambda p, i: F.struct(
            F.lit(k).alias("k"), i.alias("i"), F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("length"),
            (F.char_length(p["value"]) >= least).alias("ok"), F.sha2(p["value"], 256).alias("hash"),
        ),
    )
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<k:int,i:int,gap:int,length:int,ok:boolean,hash:string>>"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, repository: tuple[str, ...] = ("source", "lang"), owner: str = "source", share: float = 0.01, spread: float = 0.5, least_owners: int = 2
) -> DataFrame:
    """One row per row of docs: doc_id, key (hash of the text), base, added and live (arrays of spans), n_example.

    Candidates of all kinds are hashed and their documents counted over the corpus by distinct repositories and owners. A
    value is a widely copied example if at least `least_owners` owners and `share` of all owners hold it, and these are at
    least `spread` of those that as many documents would have if owners had nothing to do with it: its number of documents,
    at most the corpus's effective number of owners (the inverse of the chance that two documents share one). It is one too
    where it is as spread over repositories and has `least_owners` owners. Any other value is owner-specific and so
    live-looking, however often its owner repeats it. Base spans stay whatever the verdict; matches of the added kinds become
    spans only where they look live.

    Null text counts as empty and has no spans; a null owner or repository is one of its own. Repeated rows get equal
    results and count once. An empty table gives no rows. A text may have any number of matches: each is a row until they
    are gathered by text. Columns of docs other than doc_id, text and those named aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = materialize(
        docs.select(
            "doc_id", F.xxhash64(text).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner"),
            F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in repository]).alias("repository"),
            F.concat(*[_matches(text, k, p) for k, p in (BASE | ADDED).items()]).alias("m"), F.monotonically_increasing_id().alias("row"),
        ), "secrets",
    )
    some, none = scanned.where(F.size("m") > 0), scanned.where(F.size("m") == 0)
    each = some.select("row", "doc_id", "key", "owner", "repository", F.explode("m").alias("m")).select("row", "doc_id", "key", "owner", "repository", "m.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "k").orderBy("i")).cast("int")
    kinds = F.array(*map(F.lit, KINDS))
    spans = each.withColumn("end", end).where("ok").select(
        "row", "doc_id", "key", "owner", "repository", "hash",
        F.struct((F.col("end") - F.col("length")).alias("start"), "k", F.get(kinds, F.col("k")).alias("kind"), "end", "hash").alias("s"),
    )
    spans = materialize(spans, "secret-spans")
    # a third of all rows may hold one value: its documents are counted by owner and repository before they meet
    held = spans.select("hash", "owner", "repository", "doc_id", "key").distinct().groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    counts = held.groupBy("hash").agg(F.sum("n").alias("n"), F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    all_ = {c: scanned.groupBy(c).agg(F.count("*").cast("double").alias("n")).agg(F.count("*"), F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).first() for c in ("owner", "repository")}

    def spread_over(name: str, column: str) -> Column:
        many, effective = all_[name]
        return F.col(column) >= F.greatest(F.lit(float(least_owners)), F.lit(share * (many or 0)), spread * F.least(F.col("n"), F.lit(float(effective or 0))))

    wide = (spread_over("owner", "owners") | spread_over("repository", "repositories")) & (F.col("owners") >= least_owners)
    examples = materialize(counts.where(wide).select(F.col("hash").alias("_hash")), "secret-examples")
    judged = spans.join(broadcast_if_small(examples), F.col("hash") == F.col("_hash"), "left").withColumn("example", F.col("_hash").isNotNull())
    gathered = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("s.k") < len(BASE), F.col("s"))).alias("base"), F.collect_list(F.when((F.col("s.k") >= len(BASE)) & ~F.col("example"), F.col("s"))).alias("added"),
        F.collect_list(F.when(~F.col("example"), F.col("s"))).alias("live"), F.count_if("example").alias("n_example"),
    )
    empty = F.array().cast(f"array<{SPAN}>")
    found = some.select("row", "doc_id", "key").join(gathered, "row", "left").select("doc_id", "key", *[F.coalesce(c, empty).alias(c) for c in ("base", "added", "live")], F.coalesce("n_example", F.lit(0)).alias("n_example"))
    return found.unionByName(none.select("doc_id", "key", empty.alias("base"), empty.alias("added"), empty.alias("live"), F.lit(0).cast("long").alias("n_example")))


def report(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of base spans and all spans as text, for each row of scan()'s result."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("n_example").cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """Documents with live-looking secrets replaced by `mark`; widely copied examples stay. n_chars follows the text.

    Overlapping spans of several kinds are replaced as one. All rows and columns stay, whatever their names; a null text
    stays null and an empty table empty. Documents meet their spans by a broadcast where these are few; else only documents
    that match some pattern are shuffled.
    """
    live = scan(docs, **options).where(F.size("live") > 0).select("doc_id", "key", "live").dropDuplicates(["doc_id", "key"])
    each = live.select("doc_id", "key", F.explode("live").alias("s")).select("doc_id", "key", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    # spans that overlap or touch are one cut: a new one begins beyond all ends before
    order = Window.partitionBy("doc_id", "key").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.sum(F.when(F.col("a") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = each.withColumn("before", before).withColumn("cut", cut).groupBy("doc_id", "key", "cut").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cuts = cuts.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    cuts = materialize(cuts.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "secret-cuts")
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    packed = docs.select(F.struct(*[F.col(quoted(c)).alias(n) for c, n in names.items()]).alias("_d"))
    given = F.col(f"_d.{names['text']}")
    few = cuts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    matches = F.lit(True) if few else F.coalesce(F.greatest(*[given.rlike(p) for p in (*BASE.values(), *ADDED.values())]), F.lit(False))
    same = F.col(f"_d.{names['doc_id']}").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(given, F.lit(""))) == F.col("_key"))
    joined = packed.where(matches).join(F.broadcast(cuts) if few else cuts, same, "left").select("_d", "cuts")
    if not few:
        joined = joined.unionByName(packed.where(~matches).select("_d", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts")))
    # a piece of text is taken from short pieces, so that a text with many spans isn't walked through for each
    pieces = F.regexp_extract_all(given, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(a: Column, b: Column, pieces: Column) -> Column:
        places = F.sequence(F.floor(a / PIECE), F.floor(F.greatest(a, b - 1) / PIECE))

        def part(c: Column) -> Column:
            begin = F.greatest(a - c * PIECE, F.lit(0))
            return F.substring(F.coalesce(F.get(pieces, c.cast("int")), F.lit("")), (begin + 1).cast("int"), (F.least(b - c * PIECE, F.lit(PIECE)) - begin).cast("int"))

        return F.array_join(F.transform(places, part), "")

    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda s: s["b"]))
    ends = F.concat(F.transform("cuts", lambda s: s["a"]), F.array(F.char_length(given)))
    # bound to a variable of transform(), the pieces are made once for a text and not for each span
    made = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: between(s["a"], s["b"], p)), mark))
    joined = joined.select("_d", "cuts", F.when(F.col("cuts").isNull(), given).otherwise(F.get(made, F.lit(0))).alias("_t"))
    changed = {"text": F.col("_t")}
    if "n_chars" in names:
        n = F.col(f"_d.{names['n_chars']}")
        changed["n_chars"] = F.when(F.col("cuts").isNull(), n).otherwise(F.char_length("_t")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, F.col(f"_d.{n}")).alias(c) for c, n in names.items()])
