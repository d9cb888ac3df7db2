"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns: for every operator."""

import pytest
from pyspark.sql import functions as F

from nibblespark.llm import decontamination, license_scan, nbsvm, packing, quality_rules, sharding, simhash, suffix_dedup, token_files, warc_zip
from nibblespark.llm._tokens import public_tokenizer

pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, score double, words string, bucket long, length long, key long, hash long, spans string, at long"
LONG = "lorem ipsum dolor " * 12_000


def rows():
    extra = (0.5, "w", 1, 2, 3, 4, "s", 5)
    texts = [None, "", " ", "a", "MIT License", LONG, "same text here", "same text here"]
    return [(i, t, *extra) for i, t in enumerate(texts)] + [(None, "same text here", *extra), (7, "same text here", *extra), (8, "tie", *extra), (9, "tie", *extra)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_license_scan(docs, none):
    got = license_scan.report(docs).collect()
    assert len(got) == len(rows())
    assert next(r for r in got if r["doc_id"] == 4)["base_labels"] == "mit"
    empty = next(r for r in got if r["doc_id"] == 0)
    assert (empty["n_words"], empty["n_base"], empty["first_word"], empty["labels"], empty["score"]) == (0, 0, None, "", 0.0)
    assert license_scan.report(none).count() == 0


def test_sharding(docs, none):
    got = sharding.assign(docs, 4).collect()
    assert len(got) == len(rows())
    by_text = {}
    for r in got:
        by_text.setdefault(r["key"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign(none, 4).count() == 0


def test_classifier(docs, none, labels):
    for known in (labels, labels.limit(0)):
        got = nbsvm.score(docs, nbsvm.train(docs, known), docs.columns).collect()
        assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert nbsvm.score(none, nbsvm.train(none, labels)).count() == 0


def test_quality_rules(docs, none, labels):
    got = quality_rules.apply_rules(docs, labels).collect()
    assert len(got) == len(rows())
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality_rules.apply_rules(none, labels).count() == 0


def test_token_files(docs, none):
    path = public_tokenizer("byte_bpe_50k.json")
    got = token_files.round_trip(docs, path).orderBy("start").collect()
    assert len(got) == len(rows()) and got[0]["doc_id"] is None
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert next(r for r in got if r["doc_id"] == 0)["n_tokens"] == 1
    assert token_files.round_trip(none, path).count() == 0


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows())
    whole = next(r for r in got if r["doc_id"] == 5)
    assert whole["n_removed"] == len(LONG) and whole["text"] == ""  # it repeats itself
    assert next(r for r in got if r["doc_id"] == 0)["text"] is None
    assert "words" in got[0].asDict()
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_packing(docs, none):
    path = public_tokenizer("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, limit=512).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 512
    assert packing.pack_documents(none, path).count() == 0


def test_simhash(docs, none):
    got = {(r["doc_id"], r["print"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {c for (d, p), c in got.items() if p == 0} == {0}  # null, empty and blank texts
    assert {c for (d, p), c in got.items() if d in (None, 6, 7)} == {6}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_copies(docs).count() == len(rows()) and simhash.near_copies(none).count() == 0


def test_warc(spark):
    big = "x" * 2000
    pages = [(1, "u", big), (2, "u\r\nv", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (2, "u\r\nv", big)]
    got = warc_zip.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", 2)], key=lambda x: x)
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decontamination(spark, docs, none):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (1, item)], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, f"before {item} after"), (50, f"before {item} after"), (None, item)], "doc_id long, text string"))
    got = decontamination.contaminated(more, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["n_matched"]) for r in got) == [("50", 1, 20), ("None", 1, 20)]
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
