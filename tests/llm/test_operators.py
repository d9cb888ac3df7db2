"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import io
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nibblespark.llm import _suffixes, components, decontamination, license_scan, nbsvm, packing, quality_rules, sharding, simhash, suffix_dedup, token_files, warc_zip
from nibblespark.llm._common import held_out

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---------------------------------------------------------------- 1 licences


def test_templates_need_their_phrase_and_count_their_surroundings(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "a general license, public", "the MIT license and the mit-license", "licensed under CC BY-NC 4.0"]
    got = license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["gpl", "", "mit", "cc-by-nc"]
    assert (got[0]["score"], got[0]["first_word"]) == (1.0, 7)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 1, 5)
    assert got[3]["base_labels"] == "" and 0 < got[3]["score"] < 1


# ---------------------------------------------------------------- 2 shards


def test_minimax_is_the_smallest_capacity():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, shards = int(rng.integers(1, 50)), int(rng.integers(1, 8))
        keys, sizes = np.sort(rng.choice(1 << 60, n, replace=False)), rng.integers(1, 100, n)
        sizes[rng.integers(n)] = 1000 if trial % 3 == 0 else 1

        def weigh(ranges, bits):
            out = {}
            for lo, hi in ranges:
                inside = (keys >= lo) & (keys <= hi)
                for cell in np.unique(keys[inside] >> bits):
                    own = inside & (keys >> bits == cell)
                    out[int(keys[own][0]) if own.sum() == 1 else int(cell) << bits] = (int(sizes[own].sum()), bool(own.sum() == 1))
            return out

        def needed(capacity):
            used, filled = 1, 0
            for s in sizes:
                used, filled = (used + 1, s) if filled + s > capacity else (used, filled + s)
            return used

        sums = sharding.PrefixSums(weigh)
        best = sharding.minimax(sums, shards)
        assert best == next(c for c in range(int(sizes.max()), int(sizes.sum()) + 1) if needed(c) <= shards)
        at = np.searchsorted(np.array(sharding.cuts(sums, best, shards), np.int64), keys, side="right")
        loads = np.bincount(at, weights=sizes)
        assert len(loads) <= shards and loads.max() <= best


@tables
def test_written_shards_hold_the_rows_assigned(spark, tmp_path):
    docs = read(spark, "documents")
    placed = sharding.write_shards(docs, f"file://{tmp_path}/shards", 4)
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/shards").select("doc_id", "shard").collect())) == sorted(map(tuple, placed.select("doc_id", "shard").collect()))


# ---------------------------------------------------------------- 3 and 10 quality


@tables
def test_classifier_on_the_held_out_fold(spark):
    docs, labels = read(spark, "documents").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**6)), read(spark, "labels")
    more = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("doc_id", F.col("doc_id") + 10**6)
    known = labels.unionByName(more)
    scored = nbsvm.score(docs, nbsvm.train(docs, known)).join(known, "doc_id").where(held_out(F.col("doc_id"))).collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert np.mean(np.array(good) >= 0.7) > 0.95 and np.mean(np.array(bad) < 0.7) > 0.8


def test_forest_tells_odd_rows():
    rng = np.random.default_rng(1)
    usual, odd = rng.normal(size=(800, 4)), rng.normal(size=(20, 4)) + np.array([15, 0, 0, 0])
    forest = quality_rules.IsolationForest(usual)
    assert np.quantile(forest.score(usual), 0.99) < forest.score(odd).min()


def test_repeated_words_are_counted_by_window():
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        n, chars, _, _, repeated, *_ = quality_rules.statistics(" ".join(words).encode())
        assert (n, chars, repeated) == (len(words), len(words), len(covered))
    assert quality_rules.statistics("a\n b \na\n\n\na|é".encode())[1:4] == (6, 1, 1)


# ---------------------------------------------------------------- 4 and 6 tokens


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 16, 17, 24, 32])
def test_bits_round_trip(bits):
    for n in (0, 1, 63, 64, 65, 1000):
        x = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
        raw = token_files.pack(x, bits)
        assert len(raw) == -(-n * bits // 64) * 8 and (token_files.unpack(raw, n, bits) == x).all()


def test_token_file_random_access():
    out = io.BytesIO()
    writer = token_files.TokenWriter(out, 17, block=100)
    docs = [np.random.default_rng(i).integers(0, 1 << 17, i * 37 % 500).astype(np.uint32) for i in range(60)]
    for i, d in enumerate(docs):
        writer.add(i if i % 7 else None, d)
    writer.close()
    reader = token_files.TokenReader(io.BytesIO(out.getvalue()))
    assert all((reader.document(i) == docs[i]).all() for i in (59, 0, 31))
    assert all((a == b).all() for (_, a), b in zip(reader.documents(chunk=900), docs))
    assert (reader.tokens(1234, 1999) == np.concatenate(docs)[1234:1999]).all()


@tables
def test_encoder_gives_the_librarys_ids(spark):
    from nibblespark.llm import _tokens

    texts = [r["text"] for r in read(spark, "documents").collect()] + ["", " ", "a  b", "\n", "a\n\nb", " x", "x ", "x<|endoftext|>y", "tab\tx", "a'll b's", "~ a~b ~", "ΣΑΣ İ", "a\x1cb", "日本 語"]
    for name, leading in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = _tokens.WordEncoder(_tokens.public_tokenizer(name), leading, memory=1000)
        assert e.encode(texts) == [e._whole(t) for t in texts]


def test_packing_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for lengths in (np.minimum(4096, np.maximum(1, rng.lognormal(6, 1.3, 3000).astype(int))), rng.integers(1500, 2600, 500), np.ones(9000, int), np.array([4096] * 3)):
        runs, sequences = packing.plan(np.bincount(lengths, minlength=4097))
        load = np.zeros(sequences, int)
        spots, count = set(), np.zeros(4097, int)
        for n, rank, pieces, base, offset, times in runs:
            assert count[n] == rank
            count[n] += pieces
            for r in range(pieces):
                spot = (base + r // times, offset + r % times * n)
                assert spot not in spots
                spots.add(spot)
                load[spot[0]] += n
        assert (count == np.bincount(lengths, minlength=4097)).all() and load.max() <= 4096 and load.min() > 0
        assert sequences <= -(-lengths.sum() // 4096) * 1.15 + 2


# ---------------------------------------------------------------- 5 suffixes


def brute_spans(texts, window):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            seen.setdefault(t[i : i + window], []).append((k, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + window] = True
    return gone


@pytest.mark.parametrize("most,cut", [(4096, 64), (1, 64), (4096, 3), (1, 3)])
def test_repeats_like_brute_force(spark, most, cut, monkeypatch):
    """Also where minimizers' hashes collide all the time: ``cut`` bits are left of them."""
    keep = np.uint64((1 << cut) - 1)
    exact = _suffixes.segments

    def collide(*x):
        got = exact(*x)
        return got and (*got[:4], got[4] & keep)

    monkeypatch.setattr(suffix_dedup, "segments", collide)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.4 else word() for _ in range(rng.randrange(0, 25))) for _ in range(60)] + ["ab" * 300, "ab" * 50, "x" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    gone = brute_spans(raw, 60)
    for r in suffix_dedup.remove_repeats(df, window=60, gram=16, texts=False, most=most).collect():
        k = r["doc_id"]
        kept = np.frombuffer(raw[k], np.uint8)[~gone[k]].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(raw[k]), int(gone[k].sum()), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == int((np.diff(np.append(0, gone[k].astype(int))) == 1).sum())


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start, length = rng.integers(0, 300, 90), rng.integers(0, 100, 90)
    group = np.sort(rng.integers(0, 5, 90))
    order, common = _suffixes.suffix_sort(data, group, start, length)
    spans = [(int(group[i]), data[start[i] : start[i] + length[i]].tobytes(), i) for i in range(90)]
    assert [spans[i] for i in order] == sorted(spans)
    for a, b, k in zip(order, order[1:], common[1:]):
        assert k == (len(os.path.commonprefix([spans[a][1], spans[b][1]])) if spans[a][0] == spans[b][0] else -1)


# ---------------------------------------------------------------- 7 near duplicates


def test_masks_cover_every_pair_within_the_radius():
    for seed in (1, 2):
        kept = [sum(1 << t for t, m in enumerate(simhash.masks(4, seed)) if m >> i & 1) for i in range(64)]
        rng = random.Random(seed)
        for _ in range(20_000):
            a = [kept[i] for i in rng.sample(range(64), 4)]
            assert a[0] | a[1] | a[2] | a[3] != (1 << 31) - 1


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(340, 339)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [7, *range(300, 341)]} == {7}


@pytest.mark.parametrize("most", [8192, 3])
def test_links_like_brute_force(spark, most):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(6)}
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "print long, id long")
    got = {r["id"]: r["component"] for r in components.connected_components(simhash.links(df, most=most)).collect()}
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got.get(i, i) for i in range(len(prints))] == label


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    for text in ("", "One two", "a b c d e f a b c d", "Ä ä x y z"):
        words = text.lower().split() if text.isascii() else [w for w in text.translate({i: i + 32 for i in range(65, 91)}).split(" ") if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text.encode()) == want


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [[word() for _ in range(200)] for _ in range(30)]
    copies = []
    for i in range(0, 30, 3):
        c = list(texts[i])
        c[rng.randrange(200)] = word()
        copies.append((100 + i, " ".join(c)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + copies, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert all(got[100 + i] == i for i in range(0, 30, 3)) and all(got[i] == i for i in range(30))


def jaccard_components(texts, least=0.8):
    """Components by five-word shingles themselves, all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if label[a] != label[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if z == y else z for i, z in label.items()}
    return label


def test_near_copies_with_text_added_or_cut_are_all_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for i in range(60):
        own = [word() for _ in range(rng.randrange(40, 400))]
        texts[i] = " ".join(own)
        more = rng.choice([0.88, 0.9, 0.95])
        texts[100 + i] = " ".join(own + [word() for _ in range(int(len(own) / more) - len(own))] if i % 2 else own[: int(len(own) * more)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = jaccard_components(texts)
    assert len(set(want.values())) < 70 and got == want


def test_texts_below_the_similarity_are_not_joined(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for i in range(60):
        own = [word() for _ in range(200)]
        other = list(own)
        for k in range(10, 10 + 30 * 6, 30):  # 30 of 196 shingles: 0.73
            other[k] = word()
        texts[i], texts[100 + i] = " ".join(own), " ".join(other)
    assert simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("doc_id != component_id").count() == 0


@pytest.mark.parametrize("all_meet", [32, 3])
def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch, all_meet):
    """400 texts that differ from one text, which is not there, and are too far from each other; some have copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, few = [word() for _ in range(100)], [word() for _ in range(4)]
    texts = {}
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(5, 95), 2):
            own[at] = word() if i % 4 else rng.choice(few)  # some of the changes are those of others
        texts[i] = " ".join(own)
        if i % 10 == 0:
            own[rng.randrange(100)] = word()
            texts[1000 + i] = " ".join(own)
    met, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda rows, texts, pairs: met.append(pairs.count()) or similar(rows, texts, pairs))
    monkeypatch.setattr(simhash, "ALL_MEET", all_meet, raising=False)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = jaccard_components(texts)
    assert got == want and 300 < len(set(want.values())) < 400
    assert sum(met) < 20 * len(texts)


# ---------------------------------------------------------------- 8 packages


def test_zip64_directories_are_parsed(tmp_path):
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(3):
            with z.open(f"m{i}", "w", force_zip64=True) as f:
                f.write(bytes([i]) * (10 + i))
        z.writestr(zipfile.ZipInfo("note"), "x", zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", raw, end + 10)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    wide = raw[:end] + end64 + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for data in (raw, wide):
        source = io.BytesIO(data)
        members = warc_zip.directory(source)
        assert list(members) == ["m0", "m1", "m2", "note"]
        at = warc_zip.data_start(source, members["m2"])
        assert data[at : at + members["m2"].size] == bytes([2]) * 12
        with pytest.raises(ValueError):
            warc_zip.data_start(source, members["note"])


def test_damaged_records_are_noticed():
    raw = warc_zip.record(5, "u", b"payload", None)
    assert warc_zip.parse(zlib.decompress(warc_zip.gzip_member(raw), 31))["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc_zip.parse(raw.replace(b"payload\r\n", b"paylOad\r\n"))


# ---------------------------------------------------------------- 9 benchmark


def bench(spark, docs, items):
    return decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_every_overlap_holds_a_seed():
    """All patterns of equal and replaced words that just count as an overlap, for every length of an item."""
    from itertools import combinations

    patterns = set()
    for n in [*range(decontamination.SHORT, 18), 60]:
        equal = min(decontamination.MATCHED, -(-n * 4 // 5))
        for length in range(equal, min(n, equal * 10 // 7) + 1):
            for replaced in combinations(range(1, length - 1), length - equal):
                patterns.add(tuple(i not in replaced for i in range(length)))
    assert len(patterns) > 4000
    for p in patterns:
        assert any(s + m[-1] < len(p) and all(p[s + k] for k in m) for s in range(len(p)) for m in decontamination.MASKS)


def test_substitutions_are_tolerated(spark):
    """At 0 to 20 % of words replaced, all that keep enough equal words are found."""
    rng = random.Random(9)
    docs, items, want = [], [], set()
    for i in range(200):
        item = [f"w{i}x{k}" for k in range(rng.randrange(14, 60))]
        words = list(item)
        for k in rng.sample(range(len(item)), rng.randrange(len(item) // 5 + 1)):
            words[k] = "other"
        docs.append((i, " ".join(["noise"] * (i % 7) + words + ["end"])))
        items.append((i, " ".join(item)))
        equal = [k for k, (a, b) in enumerate(zip(item, words)) if a == b]
        if any(10 * (b - a) >= 7 * (equal[b - 1] - equal[a] + 1) for a in range(len(equal)) for b in range(a + 12, len(equal) + 1)):
            want.add((i, i))
    docs += [(1000 + i, " ".join(rng.sample(items[i][1].split(), 14))) for i in range(10)]
    got = {(r["doc_id"], r["item_id"]) for r in bench(spark, docs, items).collect()}
    assert got == want and len(want) >= 196


def test_more_overlap_never_hides_an_overlap(spark):
    """Two far blocks of one item, a block and a stray seed, and an item of a few words."""
    item = [f"w{k}" for k in range(160)]
    filler = [f"f{k}" for k in range(160)]
    two = item[:15] + filler[:40] + item[55:70]
    stray = item[:30] + filler[:90] + item[120:133]
    short = filler[:5] + ["what", "is", "it", "called"] + filler[5:9]
    got = bench(spark, [(1, " ".join(two)), (2, " ".join(stray)), (3, " ".join(short)), (4, " ".join(item[:11]))], [(1, " ".join(item)), (2, "What is it called?")])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 15, 0, 14), (2, 1, 30, 0, 29), (3, 2, 4, 5, 8)]


def test_the_shuffled_side_finds_the_same(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 40, 300])))) for i in range(40)]
    docs = [(i, " ".join([f"n{k}" for k in range(rng.randrange(400))] + items[i % 40][1].split()[rng.randrange(20) :] + ["z"] * rng.randrange(300))) for i in range(120)]
    small = sorted(map(tuple, bench(spark, docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, bench(spark, docs, items).collect())) == small and len(small) > 40
