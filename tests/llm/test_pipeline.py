"""The pipeline against a version that compares everything with everything."""

import os
import re
import zlib

import numpy as np
import pytest

from nibblespark.llm import _tokens, nbsvm, packing, suffix_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def leaks(text, items):
    """Items of which the text has a dense run of enough equal words on one diagonal."""
    w = words(text)
    places = {}
    for i, x in enumerate(w):
        places.setdefault(x, []).append(i)
    lines = {}
    for item, v in items:
        for j, x in enumerate(v):
            for i in places.get(x, ()):
                lines.setdefault((item, len(v), i - j), []).append(i)
    found = set()
    for (item, n, _), same in lines.items():
        same.sort()
        need = n if n < 10 else min(12, -(-n * 4 // 5))
        if any(10 * (j - i) >= 7 * (same[j - 1] - same[i] + 1) for i in range(len(same)) for j in range(i + need, len(same) + 1)):
            found.add(item)
    return found


def jaccard_groups(rows):
    """Groups of ids whose sets of five-word shingles share 0.8 of their union, or are joined by such."""
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if z == y else z for i, z in label.items()}
    return label


def repeats(rows):
    """For each id the bytes under repeats of 400 bytes or of 51 words."""
    gone = {i: np.zeros(len(t.encode()), bool) for i, t in rows.items()}
    seen, runs, spots = {}, {}, {}
    for i, t in rows.items():
        b = t.encode()
        for k in range(len(b) - suffix_dedup.WINDOW + 1):
            seen.setdefault(b[k : k + suffix_dedup.WINDOW], []).append((i, k))
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        found = list(re.finditer(rb"[0-9a-z\x80-\xff]+", lower))
        spots[i] = [m.start() for m in found] + [len(b)]
        w = [m.group() for m in found]
        for k in range(len(w) - suffix_dedup.WORDS + 1):
            runs.setdefault(tuple(w[k : k + suffix_dedup.WORDS]), []).append((i, k))
    for places in seen.values():
        for i, k in places if len(places) > 1 else ():
            gone[i][k : k + suffix_dedup.WINDOW] = True
    for places in runs.values():
        for i, k in places if len(places) > 1 else ():
            gone[i][spots[i][k] : spots[i][k + suffix_dedup.WORDS]] = True
    return gone


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = nbsvm.train(docs, labels)
    rows = {i: t for i, t in rows.items() if model.score(nbsvm.features(t.encode())) >= nbsvm.THRESHOLD}

    label = jaccard_groups(rows)
    rows = {i: rows[i] for i in sorted(set(label.values()))}
    gone = repeats(rows)
    rows = {i: np.frombuffer(t.encode(), np.uint8)[~gone[i]].tobytes().decode("utf-8", "ignore") for i, t in rows.items()}

    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not leaks(t, items)}

    encoder = _tokens.WordEncoder(_tokens.public_tokenizer("word_bpe_49k.json"), False)
    want = set()
    for i, t in rows.items():
        tokens = np.append(np.frombuffer(encoder._whole(t), "<u4"), np.uint32(packing.END_ID)).astype("<u4")
        for k in range(0, len(tokens), packing.LIMIT):
            part = tokens[k : k + packing.LIMIT]
            want.add((i, k // packing.LIMIT, k, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= packing.LIMIT


def test_a_short_passage_of_51_words_is_cut(spark):
    import corpus_pipeline

    word = lambda kind, i: f"{kind}{i:03d}"
    planted, shorter = [word("p", i) for i in range(51)], [word("q", i) for i in range(50)]
    texts = [" ".join([word(a, i) for i in range(30)] + part + [word(b, i) for i in range(30)]) for a, b, part in (("a", "b", planted), ("c", "d", planted), ("e", "f", shorter), ("g", "h", shorter))]
    assert len(" ".join(planted)) < suffix_dedup.WINDOW
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert [len(got[i]) for i in range(4)] == [60, 60, 110, 110] and not set(planted) & set(got[0] + got[1])


TABLE = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, `__n` long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.25, "x", 7) for i, t in rows], TABLE)


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "repeated_strings", "decontaminate", "pack"])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, empty tables."""
    import corpus_pipeline

    long, own = prose(1, 30_000), [prose(k, 120) for k in range(10, 16)]
    rows = [(1, None), (2, ""), (3, " "), (4, long), (5, own[0]), (5, own[0]), (5, own[1]), (None, own[2]), (None, own[2]), (6, own[0]), (7, own[3]), (7, own[4])]
    item = " ".join(own[4].split()[20:60])
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = getattr(corpus_pipeline, stage)
    docs = table(spark, rows)
    got = run(spark, docs, str(tmp_path))
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    if stage == "pack":
        assert {r["doc_id"] for r in got.collect()} == {i for i, _ in rows}
        return
    assert got.columns == docs.columns
    left = got.collect()
    assert all((r["lang"], r["score"], r["spans"], r["__n"]) == ("en", 0.25, "x", 7) for r in left)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in left)
    if stage == "near_duplicates":  # one row of a group, by its place: no text is lost
        assert kept == sorted([("1", ""), ("4", long), ("5", own[0]), ("5", own[1]), ("None", own[2]), ("7", own[3]), ("7", own[4])])
    if stage == "decontaminate":  # the other row of id 7 stays
        assert kept == sorted((str(i), t or "") for i, t in rows if t != own[4])
    if stage == "repeated_strings":
        assert len(left) == len(rows) and ("4", long) in kept and ("5", own[1]) in kept
        assert all(r["n_chars"] == len(r["text"]) for r in left if r["text"] is not None) and sum(r["text"] is None for r in left) == 1


def test_near_copies_are_caught(spark):
    """Copies with words replaced, added or cut, all of a similarity of 0.8 or more: each group leaves one row."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        words = prose(100 + k, int(rng.integers(60, 300))).split()
        rows.append((k, " ".join(words)))
        for c in range(3):
            w = list(words)
            if c == 0:
                for at in rng.choice(len(w), max(1, len(w) // 60), replace=False):
                    w[at] = "zz"
            elif c == 1:
                w += prose(1000 + k, len(w) // 9).split()
            else:
                w = w[: len(w) - len(w) // 8]
            rows.append((1000 * (c + 1) + k, " ".join(w)))
    label = jaccard_groups(dict(rows))
    assert sum(i >= 1000 and label[i] != i for i in label) >= 110
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()}
    assert got == set(label.values())


def test_the_driver_gives_back_what_the_fit_took(tmp_path):
    """In a process of its own, as memory that earlier tests freed would hide what a fit keeps."""
    import subprocess
    import sys

    code = f"""
import re
import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from nibblespark.llm import nbsvm
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}").getOrCreate()
rng = np.random.default_rng(1)
texts = ["".join(map(chr, rng.integers(97, 123, 2500))) for _ in range(2000)]
docs = spark.createDataFrame(pa.table({{"doc_id": range(2000), "text": texts}}))
labels = spark.createDataFrame(pa.table({{"doc_id": range(2000), "quality": [i % 2 for i in range(2000)]}}))
held = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
nbsvm.train(docs.limit(50), labels)  # what is loaded once
before = held()
nbsvm.train(docs, labels)
print("kept", held() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert float(out.stdout.split("kept")[1]) < 25, out.stdout + out.stderr[-2000:]
