"""Operators against plain versions, and on nulls, empties, ties, repeats and clashing columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.llm import (
    bytesops,
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    links,
    minhash_dedup,
    sentencepiece_codec,
    suffix_dedup,
    toxicity,
    url_filter,
)

from . import brute

KIND = "doc_id long, text string, id long, n long, uid string, bucket string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, 7, "u", "b") for i, t in zip(ids, texts)], KIND)


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of two kinds, shared passages, short, empty and null texts."""
    rnd = random.Random(5)
    base = [words(rnd, rnd.randrange(3, 160)) for _ in range(25)]
    out = [None, "", "  \n ", "one", "One two", "é ß 日本", *base, *base[:6], base[0].upper()]
    star = base[3].split() + words(rnd, 120).split()
    for k in range(60):
        w = list(star)
        for _ in range(k % 7):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
        out.append(" ".join(w))
    passage = words(rnd, 70)
    out += [f"{words(rnd, 20)} {passage} {words(rnd, k)}" for k in range(15)]
    return out


def test_components_of_long_chains(spark):
    from facetflow.plans.components import connected_components

    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r.id: r.component for r in connected_components(e).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 2000: 2000, 2001: 2000}
    assert connected_components(e.where("false")).count() == 0


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """A short list is settled at once; beyond the bound by rounds, with the same result."""
    from facetflow.plans import components, lineage

    made, cut = [], lineage.Scratch.cut
    monkeypatch.setattr(lineage.Scratch, "cut", lambda self, df, name="t": made.append(name) or cut(self, df, name))
    rnd = random.Random(4)
    pair = lambda: tuple((f"n{rnd.randrange(40)}", rnd.randrange(-2, 3)) for _ in "ab")
    e = spark.createDataFrame([pair() for _ in range(120)], "a struct<s:string,k:long>, b struct<s:string,k:long>")
    got = {r.id: r.component for r in components.connected_components(e).collect()}
    assert "cc-edges" not in made
    for bound in (30, 0):
        monkeypatch.setattr(components, "DRIVER_EDGES", bound)
        assert {r.id: r.component for r in components.connected_components(e).collect()} == got
    assert "cc-edges" in made


def test_exact_dedup(spark, corpus):
    rows = [(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, corpus)).collect()]
    by = {}
    for i, t in enumerate(corpus):
        by.setdefault(t or "", []).append(i)
    assert sorted(rows) == sorted((i, max(g), len(g), i == max(g)) for g in by.values() for i in g)


def test_exact_dedup_repeated_ids_and_empty(spark):
    got = exact_dedup.exact_dedup(frame(spark, ["a", "a", "b"], [1, 1, 1])).collect()
    assert sorted((r.id, r.group_size) for r in got) == [(1, 1), (1, 2), (1, 2)]
    assert exact_dedup.exact_dedup(frame(spark, ["a"]).where("false")).count() == 0


def test_exact_dedup_keeps_one_row_of_a_group(spark):
    got = exact_dedup.exact_dedup(frame(spark, ["a", "a", "a", "b", "b", "c", "c"], [1, 1, None, None, None, 5, 6])).collect()
    assert sorted((r.text_sha256[:2], r.group_size) for r in got if r.kept) == sorted({(r.text_sha256[:2], r.group_size) for r in got})
    assert all(r.kept is not None for r in got) and [r.id for r in got if r.keep_id == 6 and r.kept] == [6]


def test_chunks_concatenate(spark, corpus):
    long = "".join(random.Random(1).choice("abe \n") for _ in range(30_000)) + "x" * 9000
    df = frame(spark, [*corpus, long])
    bad = df.where(F.array_join(exact_dedup.chunks(F.coalesce("text", F.lit(""))), "") != F.coalesce("text", F.lit("")))
    assert bad.count() == 0


def test_clashing_identifiers_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", lambda c: F.length(c).cast("long"))
    got = {r.id: r.group_size for r in exact_dedup.exact_dedup(frame(spark, ["aa", "bb", "aa", "c"])).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("window", [10, 2])
def test_decontamination(spark, corpus, window):
    items = [(1, " ".join(corpus[8].split()[:25])), (2, "one"), (10, " ".join(corpus[9].split()[3:20])), (11, None), (12, "!!"), (13, " ".join(corpus[8].split()[:25])), (14, "w1 w2")]
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id long")
    got = {r.id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(frame(spark, corpus), it, window=window).collect()}
    assert got == brute.decontaminate(list(enumerate(corpus)), items, window)


def test_decontamination_empty_sides(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, corpus), none)
    assert got.count() == len(corpus) and got.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, corpus).where("false"), one).count() == 0


def test_decontamination_of_repeated_and_missing_ids(spark):
    item = "a b c d e f g h i j"
    docs = [(1, "a b c d e f x y z q"), (1, "x y z q e f g h i j"), (None, item), (2, item), (2, item), (None, "a b c d e f g h i x")]
    got = decontaminate.decontaminate(frame(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.id or 0, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (0, 10, True), (1, 0, False), (1, 0, False), (2, 10, True), (2, 10, True)]


def test_minhash(spark, corpus):
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_dedup(frame(spark, corpus)).collect()}
    assert got == brute.near(list(enumerate(corpus)))


def test_minhash_edges(spark):
    got = minhash_dedup.near_dedup(frame(spark, ["a b c d e f", "a b c d e f", None], [4, 4, None])).collect()
    assert sorted((r.id is None, r.n_shingles) for r in got) == [(False, 2), (False, 2), (True, 0)]
    assert minhash_dedup.near_dedup(frame(spark, ["a"]).where("false")).count() == 0


def test_minhash_of_repeated_and_missing_ids(spark):
    """60 ids with two texts each; every second text is a near copy of the next id's first one."""
    rnd = random.Random(31)
    base = [words(rnd, 40, 9999) for _ in range(61)]
    docs = [(i, base[i]) for i in range(60)] + [(i, base[i + 1] + " end") for i in range(0, 60, 3)]
    docs += [(None, base[7] + " other"), (None, "quite alone in all of this table"), (200, base[8]), (200, base[8])]
    got = minhash_dedup.near_dedup(frame(spark, [t for _, t in docs], [i for i, _ in docs])).collect()
    comp = {}
    for r in got:
        comp.setdefault(r.id, set()).add(r.component_id)
    for i in range(0, 59, 3):
        assert comp[i] == comp[i + 1] == {i}
    assert comp[5] == {5} and comp[200] == {8} and comp[None] == {6, None} and not any(r.kept for r in got if r.id is None)


def test_minhash_of_a_long_text(monkeypatch, corpus):
    import pyarrow as pa

    texts = [words(random.Random(2), 3000, 50), "x" * 5000 + " y z", corpus[8]]
    want = [x[2].tolist() for t in texts for x in minhash_dedup.text_sets(pa.array([t]), 5)]
    real = bytesops.stretches
    monkeypatch.setattr(bytesops, "stretches", lambda d, o, s: real(d, o, s, 700))
    assert [x[2].tolist() for t in texts for x in minhash_dedup.text_sets(pa.array([t]), 5)] == want


def test_links_of_an_unlinked_crowd(spark):
    """One bucket of sets none of which link, one of a star: nothing is lost, nothing is invented."""
    sets = [(i, [i * 10 + k for k in range(10)]) for i in range(40)] + [(100 + i, [*range(5000, 5019), 6000 + i]) for i in range(30)]
    members = [(1, i, len(x)) for i, x in sets]
    m = spark.createDataFrame(members, "bucket long, id long, n int")
    s = spark.createDataFrame(sets, "id long, items array<long>")
    got = {r.id: r.component for r in links.linked_components(m, s, 85).collect()}
    assert all(got[i] == i for i in range(40)) and {got[100 + i] for i in range(30)} == {100}


def test_links_of_a_crowd_within_few_bounds_take_two_rounds(spark, monkeypatch):
    """Members whose sizes hardly ever allow a link are all tested once the pairs are counted."""
    from facetflow.plans import lineage

    made, cut = [], lineage.Scratch.cut
    monkeypatch.setattr(lineage.Scratch, "cut", lambda self, df, name="t": made.append(name) or cut(self, df, name))
    rnd = random.Random(6)
    sets = [(i, rnd.sample(range(2000), 10 + 3 * i)) for i in range(130)]
    sets += [(200 + i, [*x[1:], 5000]) for i, x in sets[40:60]]
    m = spark.createDataFrame([(1, i, len(x)) for i, x in sets], "bucket long, id long, n int")
    s = spark.createDataFrame(sets, "id long, items array<long>")
    got = {r.id: r.component for r in links.linked_components(m, s, 85).collect()}
    assert got == {i: i - 200 if i >= 200 else i for i, _ in sets}
    assert made.count("hubs") == 2


def test_suffix(spark, corpus):
    docs = list(corpus) + ["".join(random.Random(2).choice("ab") for _ in range(900)), "ab" * 300]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == brute.suffix(docs)


def test_suffix_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(500))
    docs = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(30))) + base[a : a + rnd.randrange(150, 400)] for a in (rnd.randrange(200) for _ in range(40))]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == brute.suffix(docs)


def test_suffix_long_text_in_stretches(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, 5000, dtype=np.uint8)
    off = np.array([0, 5000])
    parts = [suffix_dedup.spans_of(data[s:e], np.array([0, e - s]), 32, 200)[3] + skip for _, _, s, e, skip in suffix_dedup.stretches(off, 200)]
    whole = suffix_dedup.spans_of(data, off, 32, 200)
    starts = np.concatenate(parts)
    assert set(whole[3]) <= set(starts) and starts.min() == 0 and len(starts) <= len(whole[3]) + 5


def test_suffix_empty(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, ["a"]).where("false")).count() == 0


def toxic_corpus(n=400):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        w = words(rnd, rnd.randrange(5, 60)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rnd.randrange(len(w))] = rnd.choice(["vilest", "vilely", "rottenness", "rotten"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_and_handles_edges(spark):
    rows = toxic_corpus()
    extra = [(1000, None), (1001, ""), (1002, "?!"), (None, "vilest rotten vilest"), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in [(r[0], r[1]) for r in rows] + extra], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(50))
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    clean = toxicity.clean_rows(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a", None])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_language_spans(spark):
    rnd = random.Random(4)
    make = {"xx": lambda: "".join(rnd.choice(["ka", "to", "mi"]) for _ in range(3)), "yy": lambda: "".join(rnd.choice(["sch", "ung", "ein"]) for _ in range(2)), "ru": lambda: "".join(rnd.choice("абвгде") for _ in range(5))}
    text = lambda k, n: " ".join(make[k]() for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(["xx", "yy", "ru"] * 60)]
    mixed = text("xx", 40) + ". " + text("yy", 15) + " " + text("ru", 8)
    rows += [(900, None, "xx"), (901, "12 !?", "yy"), (902, mixed, None), (903, "日本語", None), (904, "", "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 904)] == ["und"] * 3 and got[901].score == 0
    held = [r for r in rows[:180] if got[r[0]].held_out]
    assert all(got[i].lang_pred == k for i, _, k in held)
    assert [s.lang for s in got[902].spans] == ["xx", "yy", "ru"] and (got[902].spans[0].last, got[902].spans[1].last) == (40, 55)
    assert language_id.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_of_many_languages(spark):
    """140 languages, each with letters of its own words; none is left out of the sample."""
    rnd = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:03}" for k in range(140)]
    vocabulary = {k: ["".join(rnd.choice(alphabet) for _ in range(9)) for _ in range(6)] for k in names}
    rows = [(i, " ".join(rnd.choice(vocabulary[k]) for _ in range(12)), k) for i, k in enumerate(names * 5)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spans=False).collect()
    truth = {i: k for i, _, k in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(rows)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    score = rng.normal(size=(7, 3)).astype(np.float32)
    count = np.array([4, 0, 3])
    got = language_id.viterbi(score, np.array([0, 4, 4]), count, 0.7)
    for lo, hi in ((0, 4), (4, 7)):
        best = max((sum(score[lo + t, p[t]] for t in range(hi - lo)) - 0.7 * sum(a != b for a, b in zip(p, p[1:])), p) for p in np.ndindex(*(3,) * (hi - lo)))
        assert tuple(got[lo:hi]) == best[1]


def test_license_scan(spark):
    texts = [
        None, "", "Released under the GNU-General  public\nLICENSE, or the MIT license. MIT license", "gnu general public licenses", "cc by cc by", "xcc by",
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause WITH some-exception", "SPDX-License-Identifier: AND MIT", "é MIT License é",
    ]
    got = {r.id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
        assert {*filter(None, r.base_labels.split(","))} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "apache,bsd" and got[7].labels == ""
    assert license_scan.license_scan(frame(spark, ["a"]).where("false")).count() == 0


def test_license_expressions():
    f = license_scan.alternatives
    assert f("MIT") == [frozenset(["mit"])]
    assert f("a or b and c with e") == [frozenset(["a"]), frozenset(["b", "c with e"])]
    assert f("(a or b) and a") == [frozenset(["a"])]
    for bad in ("", "and", "a b", "(a", "a)", "a or", "(a or b) with e"):
        assert f(bad) is None


def test_best_license_alternative(spark):
    f, every = license_scan.best_alternative, license_scan.alternatives
    for bad in ("", "and", "a b", "(a", "a)", "a or", "(a or b) with e", "(a and b) with e"):
        assert f(bad) is None
    rnd = random.Random(4)

    def make(depth):
        if not depth or rnd.random() < 0.2:
            return rnd.choice(["a", "b", "c", "d", "e", "f", "a with x", "(a or a and b) with x"])
        return "(" + rnd.choice([" and ", " or "]).join(make(depth - 1) for _ in range(rnd.randrange(2, 4))) + ")"

    for _ in range(300):
        text = make(3)
        assert f(text) == every(text)[0], text
    assert f(" and ".join(f"(a{i} or b{i})" for i in range(40))) == {f"a{i}" for i in range(40)}
    assert len(f(" and ".join(f"(a{i} or a{i + 1})" for i in range(40)))) == 20
    deep = "a"
    for i in range(800):
        deep = f"(x{i} {('and', 'or')[i % 2]} {deep})"
    assert f(deep) == {"x799"}
    wide = "SPDX-License-Identifier: " + " and ".join(f"(LicenseRef-a{i} or LicenseRef-b{i})" for i in range(10))
    assert license_scan.license_scan(frame(spark, [wide])).first().labels == ",".join(f"licenseref-a{i}" for i in range(10))
    names = ["mitre-x", "iscx", "MIT", "mit-0", "GPL-2.0+", "Apache-2.0", "never-heard", "cc-by-4.0", "0BSD"]
    assert [license_scan.family(x.lower()) for x in names] == [None, None, "mit", "mit", "gpl", "apache", None, "cc-by", None]


def test_url_filter(spark):
    log = [
        ("evil.example.com", "spam", "on", 10), ("evil.example.com", "spam", "off", 20), ("evil.example.com", "spam", "on", 30), ("evil.example.com", "spam", "on", 31),
        ("example.org/bad", "adult", "on", 5), (None, "x", "on", 1), ("a.example.com", "x", None, 1), ("b.example.com", "x", "on", None), ("evil.example.com", "spam", "on", 10),
    ]
    entries = spark.createDataFrame(log, "rule string, category string, action string, at int")
    urls = [(1, "http://evil.example.com/x", 9), (2, "https://sub.EVIL.example.com:80/x", 10), (3, "http://evil.example.com", 20), (4, "http://evil.example.com", 99), (5, "http://example.org/bad/y", 5), (6, "http://example.org/badly", 5), (7, None, 5), (8, "junk", 5), (9, "http://evil.example.com", None), (9, "http://evil.example.com", None)]
    got = url_filter.filter_urls(spark.createDataFrame([(*u, 1) for u in urls], "page_id long, url string, fetched int, id long"), entries).collect()
    assert sorted(r.id for r in got if r.blocked) == [2, 4, 5] and len(got) == len(urls)
    assert {r.id: r.since for r in got}[4] == 30
    none = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string, fetched int"), entries.where("false"))
    assert none.where("blocked").count() == 0


def test_url_filter_judges_captures_one_by_one(spark):
    entries = spark.createDataFrame([("bad.org", "spam", "on", 1)], "rule string, category string, action string, at int")
    rows = [(1, "http://bad.org/x", 5), (1, "http://good.org/x", 5), (None, "http://bad.org", 5), (None, "http://good.org", 5), (2, "http://bad.org", 0), (2, "http://bad.org", 9), (3, "http://bad.org", 3), (3, "http://bad.org", 3)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched int"), entries).collect()
    assert sorted((r.id or 0, r.host, r.blocked, r.n_rules) for r in got) == [
        (0, "bad.org", True, 1), (0, "good.org", False, 0), (1, "bad.org", True, 1), (1, "good.org", False, 0),
        (2, "bad.org", False, 0), (2, "bad.org", True, 1), (3, "bad.org", True, 1), (3, "bad.org", True, 1),
    ]


TEXTS = [None, "", " ", "Hello  world", "▁▁ x ▁", "tab\tnew\nline\r\n", "日本語 text é ñ \U0001f600", "\x00\x01 end ", "  lead", "a" * 3000, "aaaa " * 200, "<0x0A> <s>"]


def test_sentencepiece_round_trip(spark):
    docs = frame(spark, TEXTS)
    rows = sentencepiece_codec.encode(docs).cache()
    assert rows.where("NOT lossless").count() == 0 and rows.where("n_pieces <> size(pieces)").count() == 0
    back = {r.id: r.text for r in sentencepiece_codec.decode(rows).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    again = {r.id: r.pieces for r in sentencepiece_codec.encode(docs.repartition(3)).collect()}
    assert again == {r.id: r.pieces for r in rows.collect()}
    other = {r.id: r.pieces for r in sentencepiece_codec.encode(docs, seed=2).collect()}
    assert other != again
    assert sentencepiece_codec.encode(docs.where("false")).count() == 0


def test_sentencepiece_samples_the_lattice():
    """Frequencies of sampled segmentations against all ways through the lattice."""
    pieces = sentencepiece_codec.Pieces.load(sentencepiece_codec.MODEL, 1.0)
    table = pieces.lookup()
    word = b" abab"
    data, off = np.frombuffer(word, np.uint8), np.array([0, len(word)])
    lattice = sentencepiece_codec.Lattice(pieces, table, data, off)
    at = {}
    for s, e, i in zip(lattice.src, lattice.dst, lattice.ids):
        at.setdefault(int(s), []).append((int(e), int(i)))
    ways = {}

    def walk(node, path, weight):
        if node == len(word):
            ways[tuple(path)] = math.exp(weight)
        for e, i in at.get(node, ()):
            walk(e, [*path, i], weight + pieces.weight[i])

    walk(0, [], 0.0)
    total = sum(ways.values())
    assert math.log(total) == pytest.approx(lattice.loglik[0])
    n = 20_000
    ids, count = lattice.sample(np.zeros(n, np.int64), bytesops.mix(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(count)
    seen = {}
    for a, b in zip(ends - count, ends):
        k = tuple(ids[a:b].tolist())
        seen[k] = seen.get(k, 0) + 1
    assert set(seen) <= set(ways)
    for k, w in ways.items():
        assert abs(seen.get(k, 0) / n - w / total) < 0.02


def test_sentencepiece_does_not_depend_on_blocks(monkeypatch):
    """Kept lattices, the size of blocks and other texts beside it change nothing; long units go window by window."""
    import pyarrow as pa

    rnd = random.Random(12)
    texts = [" ".join("".join(rnd.choice("abcdeéñ日本") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(300))) for _ in range(40)]
    texts += ["日本語" * 500, "ab" * 700 + " x", "  ", "\n\n a", texts[3]]
    pieces = sentencepiece_codec.Pieces.load(sentencepiece_codec.MODEL, 1.0)

    def run(texts, keys):
        data, off = bytesops.column_bytes(pa.array(texts))
        out, sampler = [], sentencepiece_codec.Sampler(pieces)
        for _, _, ids, bound, same in sentencepiece_codec.encoded_rows(sampler, data, off, keys):
            assert same.all()
            out += [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])]
        return out

    keys = bytesops.mix(np.arange(len(texts), dtype=np.uint64))
    monkeypatch.setattr(sentencepiece_codec, "LONG_UNIT", 1000)
    want = run(texts, keys)
    for block, kept in ((1 << 18, 50), (700, 1 << 18), (64, 64)):
        monkeypatch.setattr(sentencepiece_codec, "BLOCK_BYTES", block)
        monkeypatch.setattr(sentencepiece_codec, "KEPT_BYTES", kept)
        assert run(texts, keys) == want
    assert [run([t], keys[i : i + 1])[0] for i, t in enumerate(texts)] == want


def test_sentencepiece_long_unit_has_the_same_distribution():
    pieces = sentencepiece_codec.Pieces.load(sentencepiece_codec.MODEL, 1.0)
    sampler = sentencepiece_codec.Sampler(pieces)
    data = np.frombuffer(" ababé".encode(), np.uint8)
    seeds = bytesops.mix(np.arange(400, dtype=np.uint64))
    short, count = sampler.sample(np.tile(data, 400), np.arange(400) * len(data), np.arange(1, 401) * len(data), seeds)
    for window in (1, 3, 100):
        long = [sentencepiece_codec.sample_long(pieces, sampler.table, data, x, window) for x in seeds]
        assert np.array_equal(np.concatenate(long), short) and [len(x) for x in long] == count.tolist()


def test_sentencepiece_of_colliding_units(monkeypatch):
    """Units are compared by their bytes, not only by their hash."""
    import pyarrow as pa

    pieces = sentencepiece_codec.Pieces.load(sentencepiece_codec.MODEL, 1.0)
    sampler = sentencepiece_codec.Sampler(pieces)
    data, off = bytesops.column_bytes(pa.array(["one two three two", "four one"]))
    real = bytesops.span_hashes
    monkeypatch.setattr(sampler, "_number", lambda h: np.where(len(sampler.code) > 0, 0, -1) + np.zeros(len(h), np.int64))
    assert bytesops.span_hashes is real
    for _, _, ids, bound, same in sentencepiece_codec.encoded_rows(sampler, data, off, np.arange(2, dtype=np.uint64)):
        assert same.all()


def test_sentencepiece_long_text_in_bounded_memory():
    """A text of 24 MB costs its own bytes and pieces, and little besides."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from facetflow.llm import sentencepiece_codec as S
pieces = S.Pieces.load(S.MODEL, 1.0)
rng = np.random.default_rng(1)
words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(2, 10, 3000)]
text = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 3000, 3_700_000)), np.uint8)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = list(S.encoded_rows(S.Sampler(pieces), text, np.array([0, len(text)]), np.zeros(1, np.uint64)))
assert len(text) > 24e6 and got[0][4].all() and got[0][3][1] == len(got[0][2])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 300


def test_pieces_beside_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (None, None, None, None), (3, "", "y", 2)], "doc_id long, text string, pieces string, n_chars int")
    got = sentencepiece_codec.with_pieces(docs)
    assert got.columns == ["doc_id", "text", "pieces_in", "n_chars", "n_pieces", "pieces", "lossless"]
    plain = {r.id: r.pieces for r in sentencepiece_codec.encode(docs).collect()}
    assert {(r.doc_id, r.text, r.pieces_in, r.n_chars) for r in got.collect()} == {tuple(r) for r in docs.collect()}
    assert {r.doc_id: r.pieces for r in got.collect()} == plain


def test_line_dedup(spark):
    rnd = random.Random(8)
    line = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    lines = [line(rnd.randrange(6, 25)) for _ in range(30)]
    near = [x + "." for x in lines[:10]] + [x.replace(x.split()[2], "q", 1) for x in lines[10:15]]
    docs = [None, "", "short", "\n\n", *("\n".join(rnd.sample(lines + near, 6) + ["tiny"]) for _ in range(20)), "a" * 60, "a" * 61]
    want = brute.lines(list(enumerate(docs)))
    got = {r.id: (r.n_lines, r.removed) for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert {i: x[1] for i, x in got.items()} == want
    assert [got[i][0] for i in range(4)] == [0, 0, 1, 3]
    df = frame(spark, docs)
    out = line_dedup.without_lines(df, line_dedup.line_dedup(df)).orderBy("doc_id").collect()
    assert out[5].text == "\n".join(x for n, x in enumerate(docs[5].split("\n")) if n not in want[5]) and out[0].text is None
    assert line_dedup.line_dedup(df.where("false")).count() == 0


def test_line_dedup_recall_by_length(spark):
    """Near pairs at 0.8 to 0.9 of every length class against brute force, across any word count."""
    rnd = random.Random(77)
    letters = "abcdefghijklmnopqrstuvwxyz  "
    docs = []
    for size in (9, 14, 22, 35, 60, 100, 160, 190, 400, 900):
        for _ in range(40):
            x = "".join(rnd.choice(letters) for _ in range(size)).strip() + "."
            y = list(x)
            for _ in range(max(size // 55, 1)):
                at = rnd.choice([0, len(y) - 1]) if size < 50 else rnd.randrange(len(y))
                y[at] = rnd.choice(["", "é", " and "[: rnd.randrange(1, 4)]])
            docs += [x, "".join(y)]
    want = brute.lines(list(enumerate(docs)))
    got = {r.id: r.removed for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    due, found = sum(map(len, want.values())), sum(len(set(got[i]) & set(want[i])) for i in want)
    assert due > 200 and found >= 0.99 * due and sum(map(len, got.values())) == found


def test_line_dedup_of_families_that_share_buckets(spark):
    """Chains of edited lines, two to nine of them: many buckets hold the same lines, others only some of them."""
    rnd = random.Random(5)
    docs = []
    for size in range(2, 10):
        for _ in range(4):
            line = [rnd.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300)]
            for _ in range(size):
                docs.append("x" + "".join(line) + "x")
                line[rnd.randrange(300)] = "#"
    rnd.shuffle(docs)
    want = brute.lines(list(enumerate(docs)))
    got = {r.id: r.removed for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert got == {i: list(want[i]) for i in want} and sum(map(len, got.values())) == len(docs) - 32


def test_line_dedup_pairs_of_a_family(spark, monkeypatch):
    """Lines that share buckets but not enough text are not paired; the links among them are found all the same."""
    rnd = random.Random(9)
    base = [rnd.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300)]

    def edited(line, count):
        line = list(line)
        for at in rnd.sample(range(1, 300), count):
            line[at] = rnd.choice("0123456789")
        return "".join(line)

    docs = [edited(["x", *base, "x"], 8) for _ in range(120)]
    docs += [edited(x, 1) for x in docs[:20]]
    made, inner = [], line_dedup.linked_components

    def watched(members, sets, percent, check):
        def counted(pairs):
            made.append(pairs.count())
            return check(pairs)

        return inner(members, sets, percent, check=counted)

    monkeypatch.setattr(line_dedup, "linked_components", watched)
    want = brute.lines(list(enumerate(docs)))
    got = {r.id: r.removed for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert got == {i: list(want[i]) for i in want} and sum(map(len, got.values())) >= 20
    assert sum(made) < 200


def test_line_dedup_of_odd_rows(spark):
    """White space around lines, rows without an id, columns with names of its own."""
    rows = [(1, "same line\r\n\tsame line\nother", 5, "x"), (None, "same line", 6, "y"), (None, None, 7, None), (2, "\x0csame line ", 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int, gone string")
    verdicts = line_dedup.line_dedup(docs)
    got = {(r.id, r.n_lines): r.removed for r in verdicts.collect()}
    assert got == {(1, 3): [0, 1], (None, 1): [], (None, 0): [], (2, 1): [0]}
    out = line_dedup.without_lines(docs, verdicts)
    assert out.columns == docs.columns and sorted((r.removed, r.text) for r in out.collect() if r.text is not None) == [(5, "other"), (6, "same line"), (8, "")]


def test_line_dedup_is_native(spark, monkeypatch):
    """No step of it runs Python on the executors: words, runs, sketches of a large bucket and the comparison."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))
    base = [word() for _ in range(40)]
    docs = [" ".join([*base[:i], word(), *base[i + 1 :]]) for i in range(20)]
    docs += ["é日" * 40, "é日" * 41, "short line", "short line.", " ".join(word() for _ in range(40)), "\U0001f600 smile at it", "\U0001f600 smile at it!"]
    df = frame(spark, docs)

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, refused)
    want = brute.lines(list(enumerate(docs)))
    assert {r.id: r.removed for r in line_dedup.line_dedup(df).collect()} == want and sum(map(len, want.values())) == 22


def test_line_dedup_across_word_counts(spark):
    """Near lines of 15 and 16 words, and ones that spaces, length or repetition set apart."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(5, 11)))
    docs = []
    for _ in range(60):
        w = [word() for _ in range(16)]
        docs += [" ".join(w), " ".join(w[:7] + w[8:])]
    long = [word() for _ in range(300)]
    docs += [" ".join(long), " ".join(long[:140] + long[141:]), "é日" * 90, "é日" * 91 + "x", "-" * 24, "-" * 90]
    want = brute.lines(list(enumerate(docs)))
    assert sum(map(len, want.values())) >= 60
    assert {r.id: r.removed for r in line_dedup.line_dedup(frame(spark, docs)).collect()} == want


def test_word_kernels_agree_with_regular_expressions(corpus):
    import pyarrow as pa

    data, off = bytesops.column_bytes(pa.array(corpus))
    s, e, row = bytesops.word_spans(bytesops.LOWER[data], off, bytesops.PUNCT)
    got = [[] for _ in corpus]
    for a, b, r in zip(s, e, row):
        got[r].append(bytesops.LOWER[data][a:b].tobytes().decode())
    assert got == [brute.item_words(t) for t in corpus]
