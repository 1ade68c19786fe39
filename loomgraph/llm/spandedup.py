"""Exact removal of long byte strings that occur more than once in a corpus.

Sharding.  With k-byte anchors chosen by windows of w positions and w + k - 1 = length, every string of `length` bytes
has an anchor at a place that its own bytes decide, so equal strings meet in the shard of an anchor.  The segment of an
anchor holds every string of `length` bytes that has the anchor among its choices.  Anchors that occur once settle
their strings at once; segments that are equal as a whole are repeated as a whole; only the differing segments of a
repeated anchor have their strings compared.

A string that reaches no farther to the left of its anchor than half the way reaches half the way to the right, and the
other way round.  So the differing segments of an anchor are parted by the bytes of half a context on the right, and
once more by those on the left: equal strings are in one part of either sort, and a passage that very many texts share
falls apart by what stands beside it.  A part of a single segment has no repeats and is never fetched.

Resolution.  resolve="suffix_array" builds the suffix array of the segments of a part by induced sorting
and reads the repeats from the permuted common prefixes.  resolve="windows" puts the same strings into classes by their
identity (part, place, 64-bit hash) instead, in vector operations; the README has the figures of both.  Parts with more
than `wide` segments are resolved by counting keys of the single strings, which Spark combines before the shuffle, so
that no part is a group of unbounded size in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bytetext as bt
from loomgraph.llm.sais import repeated_starts
from loomgraph.llm.storage import cut, drop

ANCHOR = 200
#: Segments of a part up to this number are compared in one task (some 10 MB); more are counted by keys.
WIDE = 20_000
#: A segment with more than this share (one in ...) of all places is dealt with apart; so there are fewer of them than this.
MOST_HOT = 5000
#: Strings whose keys a task holds at once.
HELD_KEYS = 500_000
_I64 = lambda a: pa.array(a.view(np.int64) if a.dtype == np.uint64 else a)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid and k64 name a row: its id (null has a stand-in) and the hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("rid"), F.xxhash64(text).alias("k64"), text.alias("text"))


def _occurrences(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(rid, k64, pos, anchor, seg, lefts, rights): each anchor of each text, with the hashes of its segment and of half a
    context on either side (0 where the text ends before)."""
    w = length - anchor + 1
    before, after = _halves(length, anchor)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, k64 = (b.column(i).to_numpy() for i in (0, 1))
            got: list[list[np.ndarray]] = []
            data, offsets = bt.buffer_of(bt.column(b, "text"))
            for i in np.flatnonzero(np.diff(offsets) >= length):
                t = data[offsets[i] : offsets[i + 1]]
                at, h = bt.anchors(t, anchor, w)
                lo, hi = np.maximum(at - (w - 1), 0), np.minimum(at + length, len(t))
                sums = bt.prefix(t)
                seg = bt.mix(bt.spans_hash(sums, lo, hi) + (at - lo).astype(np.uint64))
                lefts = np.where(at >= before, bt.spans_hash(sums, np.maximum(at - before, 0), at), np.uint64(0))
                end = at + anchor
                rights = np.where(end + after <= len(t), bt.spans_hash(sums, end, np.minimum(end + after, len(t))), np.uint64(0))
                got.append([np.full(len(at), rid[i]), np.full(len(at), k64[i]), at.astype(np.int32), h, seg, lefts, rights])
            if got:
                yield pa.RecordBatch.from_arrays([_I64(np.concatenate(c)) for c in zip(*got)], ["rid", "k64", "pos", "anchor", "seg", "lefts", "rights"])

    return rows.mapInArrow(find, "rid long, k64 long, pos int, anchor long, seg long, lefts long, rights long")


def _halves(length: int, anchor: int) -> tuple[int, int]:
    """Bytes before and after an anchor, of which each string that has it holds all of the one or all of the other."""
    before = (length - anchor) // 2 + 1
    return before, length - anchor - (before - 1)


def _segments(rows: DataFrame, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes of the wanted halves of segments (rid, k64, pos, part, on_left, n), cut from their texts."""
    w = length - anchor + 1
    before, after = _halves(length, anchor)
    per_row = wanted.groupBy("rid", "k64").agg(F.collect_list(F.struct("pos", "part", "on_left", "n")).alias("want"))
    joined = rows.join(per_row, ["rid", "k64"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bt.buffer_of(bt.column(b, "text"))
            want = b.column(b.schema.get_field_index("want"))
            ends = want.offsets.to_numpy()
            flat = want.values
            pos, part, on_left, n = (flat.field(i).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for i in range(4))
            rid, k64 = (b.column(i).to_numpy() for i in (0, 1))
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            for s in range(0, len(row), 2000):
                r, p, left = row[s : s + 2000], pos[s : s + 2000].astype(np.int64), on_left[s : s + 2000]
                lo = np.maximum(p - np.where(left, w - 1, before - 1), 0) + offsets[r]
                hi = np.minimum(p + np.where(left, anchor + after - 1, length) + offsets[r], offsets[r + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (rid[r], k64[r], pos[s : s + 2000], part[s : s + 2000], n[s : s + 2000])] + [pa.array([data[a:z].tobytes() for a, z in zip(lo, hi)], pa.binary()), pa.array((p + offsets[r] - lo).astype(np.int32))],
                    ["rid", "k64", "pos", "anchor", "n", "bytes", "left"],
                )

    return joined.select("rid", "k64", "text", "want").mapInArrow(fetch, "rid long, k64 long, pos int, anchor long, n long, bytes binary, left int")


def _window_keys(segs: list[bytes], left: np.ndarray, anchor: np.ndarray, length: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every string of `length` bytes with the anchor among its choices: segment number, place of the anchor in it,
    and a key that equal strings of the anchor share; in blocks of places of about HELD_KEYS strings, so that equal
    strings are in one block."""
    sizes = np.fromiter(map(len, segs), np.int64, len(segs))
    low, high = np.maximum(length - sizes + left, 0), np.minimum(left, w - 1)
    until = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(until, np.arange(0, int(until[-1]), bt.PIECE_BYTES), side="right")) if len(segs) else []
    step = max(1, HELD_KEYS // max(1, len(segs)))
    for p in range(0, w, step):
        parts = []
        for first, last in zip(cuts, [*cuts[1:], len(segs)]):  # hashed a piece at a time, anew for each block of places
            least, most = np.maximum(low[first:last], p), np.minimum(high[first:last], p + step - 1)
            count = np.maximum(most - least + 1, 0)
            seg = np.repeat(np.arange(last - first), count)
            place = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + least[seg]
            at = (until[first:last] - sizes[first:last] - (until[first] - sizes[first]) + left[first:last])[seg] - place
            h = bt.spans_hash(bt.prefix(np.frombuffer(b"".join(segs[first:last]), np.uint8)), at, at + length)
            seg += first
            parts.append((seg, place, bt.mix(h + anchor.view(np.uint64)[seg] * bt.BASE + place.astype(np.uint64))))
        if parts:
            yield tuple(np.concatenate(x) for x in zip(*parts))


def _resolve(segments: DataFrame, length: int, anchor: int, resolve: str) -> DataFrame:
    """(rid, k64, lo, hi) for the segments seen once (n = 1): the part covered by strings that other segments of the
    anchor hold as well."""
    w = length - anchor + 1

    def settle(bs: list[bytes], left: np.ndarray, anc: np.ndarray, owner: list[tuple], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most place of the anchor in a repeated string, by segment; -1 if there is none."""
        least, most = np.full(len(bs), 1 << 30), np.full(len(bs), -1)
        if resolve == "windows":
            for seg, place, key in _window_keys(bs, left, anc, length, w):
                order = np.argsort(key)
                k = key[order]
                same = np.zeros(len(k), bool)
                same[1:] = k[1:] == k[:-1]
                same[:-1] |= same[1:]
                hit = order[same]
                np.minimum.at(least, seg[hit], place[hit])
                np.maximum.at(most, seg[hit], place[hit])
        else:
            cuts = np.flatnonzero(np.diff(anc)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bs)]):
                origins = [(owner[i][:2] if n[i] == 1 else i, owner[i][2] - int(left[i])) for i in range(lo, hi)]
                for i, flags in enumerate(repeated_starts(bs[lo:hi], length, origins), lo):
                    at = np.flatnonzero(flags[max(0, left[i] - w + 1) : left[i] + 1]) + max(0, left[i] - w + 1)
                    if len(at):
                        least[i], most[i] = left[i] - at[-1], left[i] - at[0]
        return least, most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "k64", "lo", "hi"]
        held: list[pa.Table] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            rid, k64, pos, anc, n, left = (t.column(c).to_numpy() for c in ("rid", "k64", "pos", "anchor", "n", "left"))
            least, most = settle(t.column("bytes").to_pylist(), left.astype(np.int64), anc, list(zip(rid.tolist(), k64.tolist(), pos.tolist())), n)
            ok = (most >= 0) & (n == 1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[ok], k64[ok], (pos[ok] - most[ok]).astype(np.int32), (pos[ok] - least[ok] + length).astype(np.int32))], names)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(len(t) for t in held) < 4000:
                continue
            t = pa.concat_tables(held).combine_chunks()
            a = t.column("anchor").to_numpy()
            whole = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0
            if whole:
                yield out(t.slice(0, whole).combine_chunks())
                held = [t.slice(whole).combine_chunks()]
            else:
                held = [t]
        if held:
            yield out(pa.concat_tables(held).combine_chunks())

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "rid long, k64 long, lo int, hi int")


def _resolve_wide(segments: DataFrame, length: int, anchor: int) -> DataFrame:
    """As `_resolve` for anchors with very many segments: counts of keys, combined before they are dealt out."""
    w = length - anchor + 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 500):
                t = b.slice(s, 500)
                rid, k64, pos, anc, n, left = (t.column(t.schema.get_field_index(c)).to_numpy() for c in ("rid", "k64", "pos", "anchor", "n", "left"))
                for seg, place, key in _window_keys(t.column(t.schema.get_field_index("bytes")).to_pylist(), left.astype(np.int64), anc, length, w):
                    yield pa.RecordBatch.from_arrays([_I64(x) for x in (rid[seg], k64[seg], pos[seg], place.astype(np.int32), key, n[seg])], ["rid", "k64", "pos", "place", "key", "n"])

    each = segments.mapInArrow(keys, "rid long, k64 long, pos int, place int, key long, n long")
    again = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    found = each.where("n = 1").join(again, "key").groupBy("rid", "k64", "pos").agg(F.min("place").alias("a"), F.max("place").alias("z"))
    return found.select("rid", "k64", F.expr("pos - z").alias("lo"), F.expr(f"pos - a + {length}").alias("hi"))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", anchor: int | None = None, resolve: str = "windows", wide: int = WIDE) -> DataFrame:
    """(rid, k64, spans): for each row with repeated strings, byte ranges whose union is what they cover."""
    anchor = anchor or min(ANCHOR, (length + 1) // 2)
    w = length - anchor + 1
    rows = _located(docs, id_col, text_col)
    occ = cut(_occurrences(rows, length, anchor))
    per = cut(occ.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("a"), F.max("seg").alias("z")).where("n > 1").select("anchor", (F.col("a") != F.col("z")).alias("mixed")))
    # `per` is a table of its own, so that the join may split an anchor that very many texts share
    live = cut(occ.join(per, "anchor"))
    drop(occ)
    whole = F.greatest(F.col("pos") - (w - 1), F.lit(0)).alias("lo"), (F.col("pos") + length).alias("hi")
    plain = live.where("not mixed").select("rid", "k64", *whole)
    mixed = live.where("mixed")
    segs = cut(mixed.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("rid", "k64", "pos")).alias("at"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights")))
    again = segs.where("n > 1").select("anchor", "seg")
    # segments that very many texts share are few: they go to every task, so that none is a group in one task
    total = segs.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(segs.where((F.col("n") > 1) & (F.col("n") > total / MOST_HOT)).select("anchor", "seg"))
    same = mixed.join(hot, ["anchor", "seg"], "left_semi").select("rid", "k64", *whole)
    same = same.union(mixed.join(hot, ["anchor", "seg"], "left_anti").join(again, ["anchor", "seg"], "left_semi").select("rid", "k64", *whole))
    # the two halves of a segment, each in the part of its anchor and its context
    half = lambda on_left, c: F.when(F.col(c) != 0, F.struct(F.lit(on_left).alias("on_left"), F.xxhash64("anchor", F.lit(on_left), c).alias("part")))
    halves = segs.select("at.rid", "at.k64", "at.pos", "n", F.explode(F.array_compact(F.array(half(True, "lefts"), half(False, "rights")))).alias("h")).select("rid", "k64", "pos", "n", "h.*")
    parts = cut(halves.groupBy("part").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("part", "m"))
    wanted = halves.join(parts, "part")
    found = [plain, same, _resolve(_segments(rows, wanted.where(F.col("m") <= wide), length, anchor), length, anchor, resolve)]
    if not parts.where(F.col("m") > wide).isEmpty():
        found.append(_resolve_wide(_segments(rows, wanted.where(F.col("m") > wide), length, anchor), length, anchor))
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.union(f)
    return ranges.groupBy("rid", "k64").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """One row per row of `docs` (columns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also `kept`).

    Each byte that a repeated string of `length` bytes covers is removed.  Null texts count as empty; texts under
    `length` bytes keep all; repeated rows are further places and so lose everything; rows without an id are treated
    like others; an empty table gives no rows.  Removal works on bytes, so that `kept` is binary.
    """
    rows = _located(docs, id_col, text_col)
    spans = repeated_spans(docs, length, id_col, text_col, **options)
    joined = rows.join(spans, ["rid", "k64"], "left").select("rid", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bt.buffer_of(bt.column(b, "text"))
            rid = b.column(0).to_numpy()
            col = b.column(b.schema.get_field_index("spans"))
            out = []
            for i in range(len(b)):
                t = data[offsets[i] : offsets[i + 1]]
                removed = runs = 0
                if col.is_valid()[i].as_py():
                    e = col.offsets
                    flat = col.values.slice(e[i].as_py(), e[i + 1].as_py() - e[i].as_py())
                    lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    step = np.zeros(len(t) + 1, np.int64)
                    np.add.at(step, lo, 1)
                    np.add.at(step, np.minimum(hi, len(t)), -1)
                    gone = np.cumsum(step)[:-1] > 0
                    removed = int(gone.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    size, t = len(t), t[~gone]
                else:
                    size = len(t)
                kept = t.tobytes()
                out.append((rid[i], size, removed, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    got = joined.mapInArrow(apply, "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return got.select(F.when(F.col("rid") != -(2**63), F.col("rid")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract query: strings of 400 bytes, over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
