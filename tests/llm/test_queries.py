"""Registered queries as a whole against plain versions of them, on the small tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nibblespark.llm import license_scan, nbsvm, quality_rules, queries, token_files, warc_zip
from nibblespark.llm._tokens import public_tokenizer

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def documents(spark, folder=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_op1_every_template_is_found_in_its_own_text(spark):
    texts = [" ".join(t.words) for t in license_scan.TEMPLATES]
    texts += [" ".join(reversed(t.words)) for t in license_scan.TEMPLATES] + ["The MIT License. The mit license! MIT-License", "general public license " * 5000]
    got = license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, license_scan.TEMPLATES):
        assert t.label in r["labels"].split(",") and r["score"] == 1.0
    for r, text in zip(got, texts):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if x]
        starts = {(t.label, i, t.base) for t in license_scan.TEMPLATES for i in range(len(w)) if w[i : i + len(t.key[1])] == t.key[1]}
        base = [i for _, i, b in starts if b]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), min(base, default=None), max(base, default=None))
        assert r["labels"] == ",".join(sorted({name for name, _, _ in starts}))


def test_op2_sharding(spark):
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    texts = documents(spark)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    size, shard_of, loads = Counter(), {}, Counter()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 16
        key = int(hashlib.md5(raw).hexdigest()[:15], 16)
        size[key] += r["size"]
        loads[r["shard"]] += r["size"]
        assert shard_of.setdefault(key, r["shard"]) == r["shard"]
    for shard in loads:
        mine = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["doc_id"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
    groups = [size[k] for k in sorted(size)]

    def shards(capacity):
        used, filled = 1, 0
        for g in groups:
            used, filled = (used + 1, g) if filled + g > capacity else (used, filled + g)
        return used

    low, high = max(groups), sum(groups)
    while low < high:
        low, high = (low, (low + high) // 2) if shards((low + high) // 2) <= 16 else ((low + high) // 2 + 1, high)
    assert max(loads.values()) <= low
    order = [shard_of[k] for k in sorted(size)]
    assert order == sorted(order)  # contiguous


def plain_features(text):
    """Ids of the distinct 2-, 3- and 4-grams of bytes, and the id of the shares of repeated word pairs."""
    ids = set()
    for n in (2, 3, 4):
        for i in range(len(text) - n + 1):
            code = 0
            for c in text[i : i + n]:
                code = (code * 257 + c) % 2**32
            ids.add((code * 2654435761 + n * 97) % 2**32 >> (32 - nbsvm.BITS))
    w = text.split()
    pairs = list(zip(w, w[1:]))
    again, same = len(pairs) - len(set(pairs)), sum(a == b for a, b in pairs)
    n = max(len(pairs), 1)
    return sorted(ids), nbsvm.GRAMS + int(10 * (again / n)) + 11 * int(10 * same / n)


def test_op3_quality_classifier(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_classifier"](spark, SF).collect()}
    texts = documents(spark)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None}
    model = nbsvm.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(got) == set(texts)
    sets = {i: plain_features(t.encode()) for i, t in texts.items() if len(t) < 4000}
    for i, (ids, shape) in sets.items():
        m = sum(model.weights[k] for k in ids) / max(len(ids), 1) ** 0.5 + model.weights[shape] + model.bias
        score = 1 / (1 + np.exp(-(model.slope * m + model.shift)))
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(score >= 0.7)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in texts)

    # the margins of the exact optimum, from the kernel of the same scaled indicators
    known = [i for i in sorted(labels) if i in texts and not got[i]["held_out"]]
    sets = {i: (sets[i] if i in sets else plain_features(texts[i].encode())) for i in known}
    good, bad = [i for i in known if labels[i] == 1], [i for i in known if labels[i] == 0]
    count = {q: Counter(k for i in part for k in (*sets[i][0], sets[i][1])) for q, part in ((1, good), (0, bad))}
    ratio = lambda k: np.log((count[1][k] + 1) / (len(good) + 2)) - np.log((count[0][k] + 1) / (len(bad) + 2))
    rows = [{**{k: ratio(k) / max(len(sets[i][0]), 1) ** 0.5 for k in sets[i][0]}, sets[i][1]: ratio(sets[i][1])} for i in known]
    kernel = np.array([[1 + sum(v * b.get(k, 0) for k, v in a.items()) for b in rows] for a in rows])
    y = np.array([1.0 if labels[i] == 1 else -1.0 for i in known])
    loss = np.array([1 / (len(known) / max(2 * (len(good) if s > 0 else len(bad)), 1) * 2 * nbsvm.COST) for s in y])
    quad, alpha = kernel * np.outer(y, y) + np.diag(loss), np.zeros(len(y))
    for _ in range(3000):
        for k in range(len(y)):
            alpha[k] = max(0.0, alpha[k] + (1 - quad[k] @ alpha) / quad[k, k])
    best = kernel @ (alpha * y)
    mine = np.array([model.margin(nbsvm.features(texts[i].encode())) for i in known])
    assert np.corrcoef(best, mine)[0, 1] > 0.99 and np.abs(best - mine).max() < 0.2


def test_op4_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizer("byte_bpe_50k.json")
    library, texts, start, want = Tokenizer.from_file(path), documents(spark), 0, []
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op4_token_files"](spark, SF).collect())) == want
    rolled = token_files.round_trip(spark.read.parquet(f"{SF}/documents.parquet"), path, file_tokens=20_000)
    assert sorted(map(tuple, rolled.collect())) == want


def test_op4_ids_beyond_the_width_raise():
    with pytest.raises(ValueError):
        token_files.pack(np.array([70_000]), 16)
    with pytest.raises(ValueError):
        token_files.pack(np.array([1, 2]), 1)


def test_op8_packages_are_closed_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "RECORDS", 7)
    pages = [(i, f"http://h/{i % 5}", ("<p>long</p>" * 200_000 if i == 3 else f"<p>{i % 40}</p>" * (i % 300))) for i in range(200)] + [(None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc_zip.write_packages(df, f"file://{tmp_path}/p", package_bytes=4000)
    assert manifest.select("path").distinct().count() > 4
    got = {r["page_id"]: r for r in warc_zip.read_packages(manifest, f"file://{tmp_path}/p", payloads=True).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw, r = (html or "").encode(), got[i]
        twins = [j for j, _, h in pages if h == html and len(raw) >= warc_zip.LEAST]
        want = max(twins, default=i)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == i else ("revisit", want))
        assert r["payload"] is None if want != i else bytes(r["payload"]) == raw


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, lines, seen, dup = len(words), 0, set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    often = Counter(windows)
    again = len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)})
    symbols, chars = len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, words))
    size = max(len("".join(words).encode()), 1)
    rate = lambda letters: sum(c in letters for w in words for c in w) / size
    features = [chars / max(n, 1), rate("#*$%&|<>"), dup / max(lines, 1), again / max(n, 1), rate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), rate("!?"), sum(a == b for a, b in zip(words, words[1:])) / max(n, 1)]
    return (n, chars, symbols, dup, again), features


def test_op10_quality_rules(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_rules"](spark, LARGER).collect()}
    stats = {i: plain_statistics(t) for i, t in documents(spark, LARGER).items()}
    failed = {i: s[0][0] < 10 or 100 * s[0][4] > 20 * s[0][0] for i, s in stats.items()}
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where("quality IS NOT NULL")
    order = [(r["doc_id"], r["quality"]) for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    sample = [(stats[i][1], q) for i, q in order if i in stats and not failed[i] and zlib.crc32(str(i).encode()) % 4 != 2]
    forest, edge = quality_rules.fit_forest(np.array([f for f, _ in sample]), np.array([q for _, q in sample]))

    def path(tree, row):
        feature, value, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] < value[at] else right[at]
        return length[at]

    def odd(f):
        row = np.clip((np.array(f) - forest.low) / (forest.high - forest.low), *quality_rules.CELL)
        return 2 ** (-sum(path(t, row) for t in forest.trees) / len(forest.trees) / quality_rules.usual_path(forest.size))

    assert set(rows) == set(stats)
    for i, (base, f) in stats.items():
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        score = odd(f)
        assert r["base_failed"] == failed[i] and abs(r["anomaly"] - score) < 1e-9
        assert r["kept"] == (not failed[i] and score <= edge) or abs(score - edge) < 1e-9
    good, bad = ([rows[i]["kept"] for i, q in order if i in rows and q == k and not failed[i]] for k in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2


def test_op10_fits_all_labelled_rows(spark):
    """More labels than the 20,000 of before: forest and threshold equal those of all rows at once."""
    rng = np.random.default_rng(4)
    n, names = 27_000, [f"f_{x}" for x in quality_rules.FEATURES]
    quality = (rng.random(n) < 0.8).astype(int)
    rows = np.column_stack([rng.normal(5, 1, n).round(3), *(np.maximum(rng.normal(0.01 * k, 0.05, n), 0) for k in range(6))]) + np.where(quality, 0, 0.15)[:, None]
    known = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "quality": quality} | dict(zip(names, rows.T.copy()))))
    order = [r["doc_id"] for r in known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for kept in (np.array(order), np.array([i for i in order if quality[i]])):  # with bad rows, and without
        forest, edge = quality_rules.fit_table(known.where(F.lit(len(kept) == n) | (F.col("quality") == 1)), names)
        plain, want = quality_rules.fit_forest(rows[kept], quality[kept])
        assert np.allclose(forest.low, plain.low, rtol=0, atol=1e-12) and np.allclose(forest.high, plain.high, rtol=0, atol=1e-12)
        assert abs(edge - want) < 1e-9 and np.allclose(forest.score(rows[:500]), plain.score(rows[:500]), rtol=0, atol=1e-9)


def test_op10_labels_beyond_a_sample_count(spark):
    """Of 24,000 good rows, the 3,000 that come last by the hash of their ids are long-worded: the whole table is the usual range."""
    ids = [r["id"] for r in spark.range(34_000).where(F.crc32(F.col("id").cast("string")) % 4 != 2).orderBy(F.xxhash64("id"), "id").collect()][:24_000]
    words = {i: ("w" * (5 + i % 3), "longerword" * 2)[k >= 21_000] for k, i in enumerate(ids)}
    texts = [" ".join(f"{w}{chr(97 + k)}" for k in range(12)) for w in words.values()]
    docs = spark.createDataFrame(pa.table({"doc_id": ids, "text": texts}))
    labels = spark.createDataFrame(pa.table({"doc_id": ids, "quality": [1] * len(ids)}))
    assert quality_rules.apply_rules(docs, labels).where("kept").count() >= 0.99 * len(ids)
