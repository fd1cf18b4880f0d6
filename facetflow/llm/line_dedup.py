"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Every line of every text is hashed to a 128-bit line id; equal lines are one
node from there on, however often they occur.

The signature hashes the elements of a line once and puts them in order around
a circle.  Its keys are the hashes of elements that follow each other there, and the
least of them are the buckets of candidates.  Two sets whose union has u elements,
d of them in one set only, share a run of (u - d) / d elements of the circle at
least, so that at 0.8 four in a row are always there.

Elements are pairs of neighbouring words, three in a row, which costs a fifth
of what runs of characters cost; a line of few different pairs, or of long
words, is signed by all its runs of ``shingle`` characters, by both where it is near the
bound.  A short line has all of its keys, so that none of its links is missed;
of a longer one a pair at 0.8 shares a bucket with a probability of some 0.99
(simulated, elements lost at random; see the test of recall by length).

Buckets that hold the same lines (as many, of the same two sums of nodes, modulo
two) are one.  Candidates are confirmed on the full sets of character shingles (exact Jaccard)
and joined by distributed union-find (``links`` and ``components``); a pair is made only if the sketches of its sets, an exact bound on their
difference, allow a link.  Of every component the first line, by document id and
line number, is kept.

Defined results: a null or empty text has no lines; white space (space, tab,
form feed, carriage return) around a line is not part of it; blank lines are
never removed; shorter lines than the option ``least`` take no part, its default
of 1 leaves none out; repeated rows of an id are lines of one document and count
by their number; documents without an id are one document; extra columns are
ignored; an empty table gives an empty result.  A line is held in one row; to
verify one takes some 50 bytes a character besides.  Lines that share few pairs
of words and yet most of their runs of characters (one very long word among others that
all differ) may be missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .links import linked_components

#: Line ids and buckets may be broadcast up to this many (24 bytes each).
BROADCAST_IDS = 20_000
#: Different pairs of neighbouring words that a line must have to be signed by them.
WORDS = 8
#: Lines of fewer, or of more characters to each, are signed by all their runs (as well).
FULL, WIDE = 16, 12
#: Elements of a bucket, and buckets at most, by what is signed: pairs of words, all runs of
#: a short line (every one is a bucket's first: no pair is missed), all runs of a longer one.
AT_WORDS, SHORT, LONGER = (3, 18), (4, 40), (5, 16)
#: Runs of a line that is signed as a longer one, at least.
LONG = 32
#: Words of 64 bits of a set's sketch, and members of a bucket beyond which there is one.
SKETCH = 8
CROWD = 1
BLANKS = " \t\r\f\v"


def lines_of(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, line_no, line, h1, h2): the lines that take part, white space trimmed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    rows = rows.select("id", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line")).where(F.length("line") >= max(least, 1))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(97), "line").alias("h2"))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def runs(line: Column, k: int, distinct: bool = True) -> Column:
    """The set of a line's runs of ``k`` characters; a shorter line is one run."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return F.when(F.length(line) < k, F.array(line)).otherwise(F.array_distinct(found) if distinct else found)


def ordered(hashes: Column) -> Column:
    """Distinct hashes in order."""
    return F.sort_array(F.array_distinct(hashes))


def zipped(x: Column, by: int) -> Column:
    """Hashes of every element and the one ``by`` places on, around the circle."""
    turned = F.concat(F.slice(x, F.lit(by + 1), F.size(x)), F.slice(x, 1, by))
    return F.zip_with(x, turned, lambda p, q: F.xxhash64(p, q))


def circular(z: Column, rows: int, most: int) -> Column:
    """Keys of ``rows`` hashes that follow each other around the circle; the least ``most``.

    Keys of rows are made from two of fewer rows, the second moved on, which is why
    they are a few zips and not a slice for each.
    """

    def made(x: Column, have: int) -> Column:
        if have == rows:
            return F.slice(F.sort_array(x), 1, most)
        by = min(have, rows - have)
        return bind(zipped(x, by), lambda w: made(w, have + by))

    return made(z, 1)


def buckets(line: Column, k: int) -> Column:
    """Keys of the buckets of a line that is not empty."""
    none = F.array().cast("array<bigint>")

    def full(z: Column) -> Column:
        short = F.when(F.size(z) <= SHORT[1], circular(z, *SHORT)).otherwise(none)
        return F.concat(short, F.when(F.size(z) >= LONG, circular(z, *LONGER)).otherwise(none))

    def both(z: Column) -> Column:
        some = F.when(F.size(z) >= WORDS, circular(z, *AT_WORDS)).otherwise(none)
        few_or_wide = (F.size(z) < FULL) | (F.length(line) > F.size(z) * WIDE)
        hashes = F.transform(runs(line, k, distinct=False), lambda x: F.xxhash64(x))
        return F.concat(some, F.when(few_or_wide, bind(ordered(hashes), full)).otherwise(none))

    return bind(bind(F.split(line, " "), lambda w: ordered(zipped(w, 1))), both)


def parities(items: Column) -> Column:
    """A sketch of a set: parities of how many of its elements fall on each of some bits."""

    def word(hashes: Column, i: int) -> Column:
        mine = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(SKETCH - 1)) == i)
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))

    return bind(F.transform(items, lambda x: F.xxhash64(x)), lambda hs: F.struct(*(word(hs, i).alias(f"w{i}") for i in range(SKETCH))))


def few(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` only if it is counted and below the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    least: int = 1,
    shingle: int = 5,
) -> DataFrame:
    """``(id, n_lines, n_removed, removed)`` per document; removed are line numbers from 0."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut
    lines = lines_of(docs, id_col, text_col, least)
    signed = cut(lines.select("id", "line_no", "h1", "h2", buckets(F.col("line"), shingle).alias("keys")), "line-signed")
    at = F.min(F.struct("id", "line_no")).alias("at")
    found = signed.groupBy("h1", "h2").agg(F.count("*").alias("c"), at, F.first("keys").alias("keys"))
    found = cut(found.select(F.monotonically_increasing_id().alias("node"), "*"), "line-found")
    # the keys take most of these tables and go as soon as they are read
    places = cut(signed.select("id", "line_no", "h1", "h2"), "line-places")
    scratch.release(signed)
    members = found.select("node", F.explode("keys").alias("bucket"))
    crowd = members.withColumn("crowd", F.count("*").over(Window.partitionBy("bucket"))).where("crowd > 1")
    shared = cut(crowd, "line-shared")
    per = cut(found.drop("keys"), "line-distinct")
    scratch.release(found)
    # near lines meet in many buckets that hold the same lines: one of them stands for all
    x, y = (F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2))
    same = shared.groupBy("bucket").agg(F.count("*").alias("c"), x.alias("x"), y.alias("y"))
    kept = cut(same.groupBy("c", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "line-kept")
    unlike = cut(shared.join(few(kept), "bucket", "left_semi"), "line-unlike")
    scratch.release(kept, shared)
    # only lines that share a bucket move; their texts are dealt by hash, and no sort takes them
    wanted = unlike.groupBy("node").agg(F.max("crowd").alias("most"))
    wanted = cut(per.select("node", "h1", "h2").join(few(wanted), "node"), "line-wanted")
    texts = lines.select("h1", "h2", "line").join(wanted.hint("shuffle_hash"), ["h1", "h2"]).select("h1", "h2", "node", "line", "most").distinct()
    size = lambda x: F.struct(F.size(x).cast("long").alias("n"), parities(x).alias("sketch"))
    texts = texts.select("node", "line", F.when(F.col("most") > CROWD, bind(runs(F.col("line"), shingle), size)).alias("s"))
    texts = cut(texts.select("node", "line", "s.n", "s.sketch"), "line-texts")
    sized = cut(unlike.join(texts.select("node", "n", "sketch"), "node").select("bucket", F.col("node").alias("id"), "n", "sketch"), "line-sized")
    scratch.release(unlike, wanted)

    def sets_of(ids: DataFrame) -> DataFrame:
        some = texts.select(F.col("node").alias("id"), "line").join(ids, "id", "left_semi")
        return some.select("id", runs(F.col("line"), shingle).alias("items"))

    # a line is much smaller than its set, so lines move, and sets are formed where they are compared
    def check(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("node").alias(c), F.col("line").alias("x" + c)) for c in "ab")
        both = pairs.join(left, "a").join(right, "b")

        def jaccard(s: Column) -> Column:
            sizes = F.size(s["a"]) + F.size(s["b"])
            return bind(F.size(F.array_intersect(s["a"], s["b"])), lambda i: i * 100 >= (sizes - i) * percent)

        ok = bind(F.struct(*(runs(F.col("x" + c), shingle).alias(c) for c in "ab")), jaccard)
        return both.where(ok).select("a", "b", "ca", "cb")

    comps = cut(linked_components(sized, sets_of, percent, check=check), "line-components")
    scratch.release(but=(places, per, comps))
    # groups: components of different lines, and lines that occur again
    many = comps.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    comps = comps.join(many, "component", "left_semi").select(F.col("id").alias("node"), "component")
    grouped = per.select("h1", "h2", "node", "c", "at").join(comps, "node", "left").where("c > 1 OR component IS NOT NULL")
    grouped = cut(grouped.select("h1", "h2", F.coalesce("component", "node").alias("g"), "at"), "line-groups")
    first = grouped.groupBy("g").agg(F.min("at").alias("first"))
    verdict = grouped.join(first, "g").select("h1", "h2", "first")
    gone = places.join(verdict, ["h1", "h2"]).where("NOT (id <=> first.id AND line_no = first.line_no)")
    per_doc = gone.groupBy("id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    per_doc = cut(per_doc.select(F.col("id").alias("of"), "removed"), "line-removed")
    scratch.release(but=(per_doc,))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"))
    out = base.join(per_doc, base["id"].eqNullSafe(per_doc["of"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their removed lines left out; a document without a verdict stays as it is.

    Rows that repeat an id lose the lines of these numbers alike.
    """
    gone, of = "gone", "of"
    while gone in docs.columns or of in docs.columns:
        gone, of = gone + "_", of + "_"
    v = verdicts.where("size(removed) > 0").select(F.col("id").alias(of), F.col("removed").alias(gone))
    v = v.dropDuplicates([of])
    d = docs.join(v, docs[id_col].eqNullSafe(v[of]), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    whole = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    return d.select(*(whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: all lines of all ``documents`` that are not blank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).withColumnRenamed("id", "doc_id")
