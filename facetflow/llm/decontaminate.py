"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

Item words are cut into windows (``window`` consecutive words, or the whole
item where it is shorter).  A window is the set of its shingles with their
offsets.  Since a window has to be contained whole, one token of it is a
sufficient prefix: its rarest shingle, by document-side counts.  Documents are
exploded into shingles once and reduced at once to shingles that the benchmark
holds; everything after works on those few rows:

* prefix join: a document shingle meets the windows whose prefix it is;
* positional bound: the window must start at a word that exists;
* length bound: it must end before the document does;
* verification: every shingle of the window stands at its place.  Shingles are
  compared as text and overlap by all but one word, so this is word equality.

Defined results: a null, empty or wordless text has no words and no hits; items
without words give no window; repeated items count by their own ids; an empty
benchmark gives zeros; columns other than id and text are not looked at.  Rows
are judged one by one, known by a 128-bit hash of id and text: rows that repeat
an id with another text do not mix, a row without an id counts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch

#: Fixed values of the contract: characters that separate words, and A-Z.
SEPARATORS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Benchmark-side tables below this many rows may be broadcast (rows are short).
BROADCAST_ROWS = 200_000


def words(text):
    """Words of a text column: A-Z lower-cased, cut at ASCII that is no letter or digit."""
    flat = F.translate(text, UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.array_remove(F.split(F.coalesce(flat, F.lit("")), " "), "")


def shingle_texts(w: str, k: int):
    """Array of the shingles of ``k`` words that begin at each word; null past the end."""
    parts = ", ' ', ".join(["x", *(f"get({w}, i + {j})" for j in range(1, k))])
    return F.expr(f"transform({w}, (x, i) -> concat({parts}))") if k > 1 else F.col(w)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it is counted and below the bound."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``(item_id, wid, len, k, parts)``: parts are the window's shingles by offset."""
    held = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    cutted = held.select(
        "item_id",
        F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("w"),
    ).groupBy("w").agg(F.collect_set("item_id").alias("item_ids"))
    sized = cutted.withColumn("len", F.size("w")).withColumn("k", F.least(F.lit(shingle), F.size("w")))
    parts = F.expr("transform(sequence(0, len - k), i -> concat_ws(' ', slice(w, i + 1, k)))")
    return sized.select(F.concat_ws(" ", "w").alias("wid"), "item_ids", "len", "k", parts.alias("parts"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items, items_sha256, contaminated, spans)`` per document.

    ``spans`` are the maximal runs of hit words as (first, last + 1).
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut
    windows = cut(item_windows(items, item_id, item_text, window, shingle), "windows")
    tokens = windows.select("k", F.explode("parts").alias("sh")).distinct()
    sizes = [r["k"] for r in windows.select("k").distinct().collect()]  # at most ``shingle`` values
    # rows that share id and text are alike in all that follows; the id is part of the key, and may be null
    raw = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("t"))
    raw = raw.select("id", F.xxhash64("id", "t").alias("r1"), F.xxhash64(F.lit(97), "t", "id").alias("r2"), "t")
    texts = raw.select("id", "r1", "r2", words(F.col("t")).alias("w"))
    counted = texts.select("id", "r1", "r2", F.size("w").cast("long").alias("n_words"))
    found = None
    for k in sizes:
        rows = texts.select("r1", "r2", F.size("w").alias("n"), F.posexplode(shingle_texts("w", k)).alias("pos", "sh")).where("sh is not null")
        rows = rows.join(small(tokens.where(F.col("k") == k).select("sh")), "sh").withColumn("k", F.lit(k))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        hits = counted.where("false").select("r1", "r2", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"))
        return _report(counted, hits)
    found = cut(found.select("r1", "r2", "n", "pos", "k", "sh"), "matches")
    # rarity: document-side frequency of the benchmark's shingles; ties by text
    rarity = found.groupBy("k", "sh").agg(F.count("*").alias("freq"))
    spread = windows.select("wid", "len", "k", F.posexplode("parts").alias("at", "sh"))
    ranked = spread.join(rarity, ["k", "sh"], "left")
    prefix = ranked.groupBy("wid", "len", "k").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "sh", "at")).alias("m")
    ).where("m.f > 0").select("wid", "len", "k", F.col("m.sh").alias("sh"), F.col("m.at").alias("at"))
    prefix = cut(prefix, "prefix")
    cands = found.join(small(prefix), ["k", "sh"]).select("r1", "r2", "n", "k", "wid", "len", (F.col("pos") - F.col("at")).alias("start"))
    cands = cands.where("start >= 0 and start + len <= n")
    # a window with a single shingle is verified by the prefix itself
    parts = windows.where("size(parts) > 1").select("wid", F.size("parts").alias("need"), F.posexplode("parts").alias("at", "sh"))
    many = cands.join(small(windows.where("size(parts) > 1").select("wid", "parts")), "wid")
    want = many.select("r1", "r2", "wid", "start", "len", F.size("parts").alias("need"), "k", F.posexplode("parts").alias("at", "sh"))
    want = want.withColumn("pos", F.col("start") + F.col("at"))
    whole = want.join(found.select("r1", "r2", "pos", "k", "sh"), ["r1", "r2", "pos", "k", "sh"]).groupBy("r1", "r2", "wid", "start", "len", "need").agg(F.count_distinct("at").alias("got"))
    whole = whole.where("got >= need").select("r1", "r2", "wid", "start", "len")
    alone = cands.join(small(windows.where("size(parts) = 1").select("wid")), "wid", "left_semi").select("r1", "r2", "wid", "start", "len")
    placed = whole.unionByName(alone)
    placed = placed.join(small(windows.select("wid", "item_ids")), "wid")
    per = placed.groupBy("r1", "r2").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("item_ids", lambda x: x.cast("string")))))).alias("items"),
    )
    # runs are sorted by start: fold them into maximal spans
    fold = """aggregate(runs, cast(array() as array<struct<s:int,e:int>>), (acc, r) ->
        CASE WHEN size(acc) > 0 AND r.s <= element_at(acc, -1).e
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, r.e))))
             ELSE concat(acc, array(named_struct('s', r.s, 'e', r.e))) END)"""
    hits = per.select("r1", "r2", F.expr(fold).alias("spans"), "items")
    hits = cut(hits.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + (x.e - x.s))")), "hits")
    scratch.release(but=(hits,))
    return _report(counted, hits)


def _report(counted: DataFrame, hits: DataFrame) -> DataFrame:
    out = counted.join(hits, ["r1", "r2"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias("spans"),
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """The query: whole ``documents`` against whole ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate(docs, items).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     lens AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
     dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
     hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.list, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
