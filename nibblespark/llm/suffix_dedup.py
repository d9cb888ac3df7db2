"""Removal of long strings that repeat across a corpus, by hash-compared suffix sorting.

A byte goes if a ``WINDOW``-byte string over it starts anywhere else too, in the same text or another.

1. Every window has a minimizer, so equal windows have equal minimizers at equal distance. Each task cuts
   its texts into segments (runs of windows with one minimizer).
2. Segments of equal bytes are one class; a cryptographic digest of 128 bits tells, not a hash. In a class of
   two or more all windows repeat. Classes are counted by partial aggregation, so thousands of copies leave one
   row per task.
3. Classes that share a minimizer string with other classes may share windows in part. Their bytes come
   together by minimizer and are suffix sorted on both sides of it; common extensions, held against the bytes,
   give the windows that repeat. Where a minimizer has over ``MOST`` classes, their windows are counted by such
   digests instead, which splits the group over all tasks.
4. Each task reads its texts again with the spans found for its rows, and cuts them out.

With ``words``, runs of so many equal words that repeat are found too, however short in bytes: the same steps
run over the words' 32-bit hashes, and what is found is rounded inwards to whole words. Words are runs of
letters, digits and characters beyond ASCII, A-Z as a-z, so signs and line ends between them don't matter.

Texts are never shuffled: rows are named by file and row number, and what is found for a block of rows is
written to a folder of the block in the shared scratch folder, where the tasks that read those rows find it.

Null text: empty, nothing removed. Null ids and repeated rows are rows of their own (equal rows of
``WINDOW`` bytes or more remove each other). An empty table gives no rows. Extra columns are kept, but for
those that have the name of one of the results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import handed_on, materialise, scratch_scope, small_batches, text_bytes
from ._rows import Findings, leave, named, scanned
from ._suffixes import digests, repeated_windows, segments

WINDOW, GRAM = 400, 64
#: Words of the shortest passage that counts as repeated, however few bytes it has.
WORDS = 51
#: Classes of one minimizer that a task sorts; bytes that it sorts at once; bytes that are cut at once.
MOST, SORT_BYTES, CUT_BYTES = 4096, 4 << 20, 1 << 20


def _where(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window start, last one and minimizer in one number; the latter two are near the first."""
    return first << 20 | (last - first) << 10 | (anchor - first)


def _parts_of(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = where >> 20
    return first, first + (where >> 10 & 1023), first + (where & 1023)


def _pieces(texts: list[bytes], window: int, most: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in handfuls of at most ``most`` bytes; longer ones in parts that overlap by a window."""
    rows, offsets, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - window + 1, 0), most):
            part = t[at : at + most + window - 1]
            if held + len(part) > most and parts:
                yield rows, offsets, parts
                rows, offsets, parts, held = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, offsets, parts


def _segments(named: DataFrame, window: int, gram: int, coded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _symbols(coded)
        for b in batches:
            block, row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__block", "__row"))
            for rows, offsets, parts in _pieces(list(map(symbols, text_bytes(b.column("text")))), window, CUT_BYTES):
                lens = np.fromiter(map(len, parts), np.int64, len(parts))
                starts = np.cumsum(lens) - lens
                joined = b"".join(parts)
                got = segments(np.frombuffer(joined, np.uint8), starts, lens, window, gram)
                if got is None:
                    continue
                k, first, last, anchor, key = got
                content, check = digests(joined, first, last + window)
                at, shift = np.array(rows)[k], np.array(offsets)[k] - starts[k]
                yield _gathered(block[at], row[at], _where(first + shift, last + shift, anchor + shift), content, check, key.view(np.int64))

    return named.select("__block", "__row", "text").mapInArrow(run, "block long, content long, check long, gram long, rows array<long>, ats array<long>")


def _gathered(block: np.ndarray, row: np.ndarray, at: np.ndarray, content: np.ndarray, check: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
    """One row for equal segments of a handful of texts, with all their places: what is common is small before any shuffle."""
    order = np.lexsort((at, row, check, content, gram, block))
    block, row, at, content, check, gram = (x[order] for x in (block, row, at, content, check, gram))
    starts = np.append(0, np.flatnonzero(np.any([np.diff(x) != 0 for x in (block, gram, content, check)], axis=0)) + 1)
    ends = pa.array(np.append(starts, len(block)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (row, at)]
    return pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in (block, content, check, gram)), *lists], names=["block", "content", "check", "gram", "rows", "ats"])


CONTEXT = "gram long, block long, row long, at long, classes long, context binary"


def _contexts(named: DataFrame, path: str, window: int, coded: bool) -> DataFrame:
    """The bytes of the segments named in the findings at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, symbols = Findings(path), _symbols(coded)
        for b in batches:
            out: list[tuple] = []
            for block, row, t in zip(b.column("__block").to_pylist(), b.column("__row").to_pylist(), text_bytes(b.column("text"))):
                if (mine := found.of(block, row)) is None:
                    continue
                t = symbols(t)
                first, last, _ = _parts_of(at := mine.column("at").to_numpy())
                for g, w, c, i, j in zip(mine.column("gram").to_pylist(), at.tolist(), mine.column("classes").to_pylist(), first.tolist(), last.tolist()):
                    out.append((g, block, row, w, c, t[i : j + window]))
            for i in range(0, len(out), 4096):
                columns = zip(*out[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()])], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return named.select("__block", "__row", "text").mapInArrow(run, CONTEXT)


SPAN = "block long, row long, first long, last long"


def _sorted_spans(contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """Suffix sort the classes of each minimizer; spans of bytes under windows that repeat."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(tables).combine_chunks()
            key = t.column("gram").to_numpy()
            first, last, anchor = _parts_of(t.column("at").to_numpy())
            group = np.append(0, np.cumsum(np.diff(key) != 0))
            i, lo, hi = repeated_windows(group, anchor - first, last - first, t.column("context").to_pylist(), window, gram)
            if len(i):
                yield pa.RecordBatch.from_pydict({"block": t.column("block").to_numpy()[i], "row": t.column("row").to_numpy()[i], "first": first[i] + lo, "last": first[i] + hi + window})

        held: list[pa.Table] = []
        size = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            while t.num_rows:
                key = t.column("gram").to_numpy()
                ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
                same = int(ends[0]) if held and held[-1].column("gram")[-1].as_py() == key[0] else 0
                if same and size >= SORT_BYTES:
                    held.append(t.slice(0, same))
                    t = t.slice(same)
                    if t.num_rows:
                        yield from close(held)
                        held, size = [], 0
                    continue
                room = np.cumsum(np.fromiter(map(len, t.column("context").to_pylist()), np.int64, len(key)))
                fit = ends[room[ends - 1] + size <= SORT_BYTES]
                take = int(fit[-1]) if len(fit) else int(ends[0])
                held.append(t.slice(0, take))
                size += int(room[take - 1])
                t = t.slice(take)
                if size >= SORT_BYTES and t.num_rows:
                    yield from close(held)
                    held, size = [], 0
        if held:
            yield from close(held)

    return dealt.mapInArrow(run, SPAN)


def _counted_spans(contexts: DataFrame, window: int) -> DataFrame:
    """The same for minimizers of very many classes: windows counted by a digest of their bytes, over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last, _ = _parts_of(b.column("at").to_numpy())
            contexts = b.column("context").to_pylist()
            lens = np.fromiter(map(len, contexts), np.int64, len(contexts))
            n = last - first + 1
            i = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            start = (np.cumsum(lens) - lens)[i] + k
            content, check = digests(b"".join(contexts), start, start + window)
            names = (*CLASS, *(x.split()[0] for x in SPAN.split(", ")))
            columns = (b.column("gram").to_numpy()[i], content, check, b.column("block").to_numpy()[i], b.column("row").to_numpy()[i], first[i] + k, first[i] + k + window)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    windows = contexts.mapInArrow(run, f"gram long, content long, check long, {SPAN}")
    again = windows.groupBy(*CLASS).agg(F.count("*").alias("n")).where("n > 1").select(*CLASS)
    return windows.join(again, CLASS, "left_semi").select("block", "row", "first", "last")


#: What tells classes of equal segments apart: a 128-bit digest of their bytes, and the minimizer's hash.
CLASS = ["gram", "content", "check"]


def repeated_spans(named: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, coded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bytes that go: whole segments (block, rows, ats), and other spans (block, row, first, last). They may overlap.

    ``coded``: of the texts' word hashes instead.
    """
    cut = materialise(_segments(named, window, gram, coded), "segments")
    one = F.struct("block", F.get("rows", F.lit(0)).alias("row"), F.get("ats", F.lit(0)).alias("at"))
    classes = materialise(cut.groupBy(*CLASS).agg(F.sum(F.size("rows")).alias("n"), F.min(one).alias("one")), "classes")
    whole = cut.join(classes.where("n > 1").select(*CLASS), CLASS, "left_semi").select("block", "rows", "ats")
    shared = classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1")
    partial = classes.join(shared, "gram").select("gram", "one.block", "one.row", "one.at", "classes")
    contexts = _contexts(named, leave(partial, "partial"), window, coded)
    spans = _sorted_spans(contexts.where(F.col("classes") <= most), window, gram)
    if shared.where(F.col("classes") > most).limit(1).count():
        hot = materialise(contexts.where(F.col("classes") > most), "hot-contexts")
        spans = spans.unionByName(_counted_spans(hot, window))
    return whole, spans


#: Bytes of a word's hash.
CODE = 4
#: What counts in words: letters, digits and all beyond ASCII; A-Z as a-z. The rest separates.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Codes(dict):
    """Hashes of words, each made once while it is remembered."""

    MOST = 1 << 16

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh32_digest

        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxh32_digest(word)
        return h


def _symbols(coded: bool) -> Callable[[bytes], bytes]:
    """A text as it is, or each of its words as its hash."""
    if not coded:
        return lambda t: t
    memory = _Codes()
    return lambda t: b"".join(map(memory.__getitem__, t.translate(_PLAIN).split()))


def _runs_of_words(spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Runs of whole words, of so many or more, under spans of word hashes that repeat."""
    runs = [(-(-i // CODE), j // CODE) for i, j in merged(spans)]
    return [(i, j) for i, j in runs if j - i >= words]


def _bytes_of_words(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as bytes of the text, each up to the word after it."""
    if not runs:
        return []
    starts = [*(m.start() for m in re.finditer(rb"[^ ]+", text.translate(_PLAIN))), len(text)]
    return [(starts[i], starts[j]) for i, j in runs]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out


def _found(rows: DataFrame, window: int, gram: int, most: int, coded: bool) -> tuple[str, str]:
    """Where the whole segments and the spans that repeat are left."""
    with scratch_scope(rows.sparkSession):
        whole, spans = repeated_spans(rows, window, gram, most, coded)
        return handed_on(leave(whole, "wholes")), handed_on(leave(spans, "spans"))


#: The columns that remove_repeats adds.
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_words")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True, most: int = MOST, words: int = 0, cut_words: bool = True) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans, spans and kept_sha256, and with the cut text if ``texts``.

    With ``words`` also n_passage_words: the words in runs of so many or more that stand elsewhere too; these
    runs are removed as well if ``cut_words``. A character of which a part was removed goes from the cut text;
    the digest is of the kept bytes.
    """
    if window - gram > 1023 or CODE * words - gram > 1023 or window <= gram or 0 < CODE * words <= gram:
        raise ValueError(f"windows must be longer than {gram} bytes, by 1023 at most")
    small_batches(docs.sparkSession)
    rows = named(scanned(docs))
    wholes, parts = _found(rows, window, gram, most, False)
    again = _found(rows, CODE * words, gram, most, True) if words else ()
    own = {"text", *RESULTS} - (set() if words else {"n_passage_words"})
    keep = [c for c in docs.columns if c.lower() not in own] if texts else ["doc_id"]

    def spans_of(whole: Findings, part: Findings, block: int, row: int, window: int) -> list[tuple[int, int]]:
        spans = []
        if (mine := whole.of(block, row)) is not None:
            first, last, _ = _parts_of(mine.column("at").to_numpy())
            spans += zip(first.tolist(), (last + window).tolist())
        if (mine := part.of(block, row)) is not None:
            spans += zip(mine.column("first").to_pylist(), mine.column("last").to_pylist())
        return spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, coded = (Findings(wholes), Findings(parts)), tuple(map(Findings, again))
        for b in batches:
            if not b.num_rows:
                continue
            out, passages = [], []
            for block, row, t in zip(b.column("__block").to_pylist(), b.column("__row").to_pylist(), text_bytes(b.column("text"))):
                spans = spans_of(*found, block, row, window)
                runs = _runs_of_words(spans_of(*coded, block, row, CODE * words), words) if coded else []
                gone = merged(spans + _bytes_of_words(t, runs) if cut_words else spans)
                passages.append(sum(j - i for i, j in runs))
                kept = t
                if gone:
                    ends = [0, *(x for s in gone for x in s), len(t)]
                    kept = b"".join(t[i:j] for i, j in zip(ends[::2], ends[1::2]))
                cuts = [{"first": i, "last": j} for i, j in gone]
                out.append((kept.decode("utf-8", "ignore") if texts else "", len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), cuts))
            text, n, removed, count, digest, cuts = zip(*out)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            extra = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest), "spans": pa.array(cuts, kind)}
            if words:
                extra["n_passage_words"] = pa.array(passages, pa.int64())
            if texts:  # a text that was null stays so
                extra["text"] = pa.array(text, mask=~b.column("text").is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *extra.values()], names=[*keep, *extra])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    stats = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"
    schema = ", ".join([*fields, stats, *(["n_passage_words long"] if words else []), *(["text string"] if texts else [])])
    return rows.select(*keep, "text", "__block", "__row").mapInArrow(run, schema)
