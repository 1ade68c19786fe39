"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: runs of letters, digits and bytes from 0x80 on, in lower case (A-Z and Latin-1 capitals).  Numbers,
names (of one or more words) and units become typed placeholders, whose values are kept as slots.  Windows of `window`
tokens of the benchmark items (a shorter item is one window) are hash-joined with those of the documents, so that a
question with other numbers or names still meets its item; a hit counts only if the slots agree with each other: places
that hold one value in the item hold one value in the document.  Whether a window's first token is a name or a unit
hangs on what stands before it, so that windows are looked up in both forms.

Names are told by their capitals, so that a text in lower case has none.  All windows are therefore looked for by their
exact tokens in lower case as well.  Windows with less than half literal tokens and items of fewer than 5 tokens say too
little as templates and are looked for by their exact tokens alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bytetext as bt
from loomgraph.llm.storage import cut

#: Units of measure that become a placeholder after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hours minutes seconds days weeks months years usd eur gbp dollars euros cents percent kmh mph hz khz mhz ghz w kw mw v a k c f pa kpa bar j kj cal kcal b kb mb gb tb".split()
#: Placeholder hashes.
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3))
#: Tells hashes of exact tokens from those of templates.
EXACT = np.uint64(0x5EED0FEAC7)
#: Tokens of the shortest item that is looked for as a template.
LEAST = 5
#: Windows of benchmark items whose hashes go to the executors at once; a larger benchmark is taken in blocks.
BLOCK_WINDOWS = 500_000

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?:;\n\r\"'()[]{}|*#-"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = bt.buffer_of(pa.array(words, pa.large_string()))
    return bt.spans_hash(bt.prefix(data), offsets[:-1], offsets[1:])


UNIT_HASHES = np.sort(_hash_words(UNITS))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, value, row) of each token of the template, and (value, row) of each exact token.

    A placeholder's hash is its type and its value what it replaces: a number with its decimals, a name with all its
    words.  Exact tokens are words and whole numbers.
    """
    start, end, row = bt.words(data, offsets, _BREAK)
    if not len(start):
        none = np.zeros(0, np.uint64)
        return none, none, row, none, row
    low = bt.lower(data)
    sums = bt.prefix(low)
    value = bt.spans_hash(sums, start, end)
    number = _DIGIT[data[start]]
    same_row = np.zeros(len(start), bool)
    same_row[1:] = row[1:] == row[:-1]
    decimals = same_row.copy()  # they belong to their number
    decimals[1:] &= number[1:] & number[:-1] & (start[1:] == end[:-1] + 1)
    decimals[1:] &= np.isin(data[start[1:] - 1], np.frombuffer(b".,", np.uint8))
    at = np.searchsorted(UNIT_HASHES, value)
    unit = (UNIT_HASHES[np.minimum(at, len(UNIT_HASHES) - 1)] == value) & same_row
    unit[1:] &= number[:-1]
    # a name: a capital that does not begin a sentence, after a lower-case word and one space
    name = _UPPER[data[start]] & ~number & same_row & (end - start > 1)
    name[1:] &= (start[1:] == end[:-1] + 1) & (data[np.maximum(start[1:] - 1, 0)] == 32)
    name[1:] &= ~_UPPER[data[end[:-1] - 1]]  # not within a text in capitals
    more = name.copy()  # the further words of a name belong to it
    more[1:] &= name[:-1]

    def joined(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that begin something, and the values of all they begin."""
        first = np.flatnonzero(~rest)
        last = np.append(first[1:], len(rest)) - 1
        out = value[first].copy()
        long = last > first
        out[long] = bt.spans_hash(sums, start[first[long]], end[last[long]])
        return first, out

    exact, exact_value = joined(decimals)
    first, first_value = joined(decimals | more)
    h = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))[first]
    return h, first_value, row[first], exact_value, row[exact]


def _alone(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of each token as if nothing stood before it: no name, no unit."""
    return np.where(h == NUMBER, h, value)


def _other(h: np.ndarray, alone: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n tokens at `at` in the other form of their first token, where there is one."""
    at = at[alone[at] != h[at]]
    x = alone[at]
    for i in range(1, n):
        x = x * bt.BASE + h[at + i]
    return bt.mix(x), at


def _windows(h: np.ndarray, row: np.ndarray, n_rows: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, length) of each window; a row with fewer tokens has one window of all its tokens."""
    keys, at = bt.grams(h, row, window)
    size = np.full(len(at), window)
    count = np.bincount(row, minlength=n_rows)
    first = np.searchsorted(row, np.arange(n_rows))
    short = np.flatnonzero((count > 0) & (count < window))
    extra = []
    for r in short:
        x = h[first[r] : first[r] + count[r]]
        extra.append(int(bt.grams(x, np.zeros(len(x), np.int64), len(x))[0][0]))
    return np.concatenate([keys, np.array(extra, np.uint64)]), np.concatenate([at, first[short]]), np.concatenate([size, count[short]])


def _slots(h: np.ndarray, value: np.ndarray, at: int, size: int) -> list[int]:
    x = slice(at, at + size)
    return value[x][h[x] <= UNIT].view(np.int64).tolist()


_SCHEMA = "id long, whash long, pos int, size int, exact boolean, slots array<long>"


def _item_windows(tokens: tuple, n_rows: int, window: int) -> list[tuple]:
    """(hash, first token, length, first token is alone, exact) of the windows of items."""
    h, value, row, exact, exact_row = tokens
    key, at, size = _windows(h, row, n_rows, window)
    literal = np.concatenate([[0], np.cumsum(h > UNIT)])
    ok = (2 * (literal[at + size] - literal[at]) >= size) & (size >= LEAST)
    e_key, e_at, e_size = _windows(exact, exact_row, n_rows, window)
    parts = [(key[ok], at[ok], size[ok], False, False), (e_key ^ EXACT, e_at, e_size, False, True)]
    alone = _alone(h, value)
    for n in set(size[ok].tolist()):
        k, a = _other(h, alone, at[ok & (size == n)], n)
        parts.append((k, a, np.full(len(a), n), True, False))
    return parts


def _document_windows(tokens: tuple, only: np.ndarray, lengths: list[int]) -> list[tuple]:
    """The same of those windows of documents whose hashes are in `only`."""
    h, value, row, exact, exact_row = tokens
    parts = []
    alone = _alone(h, value)
    for n in lengths:
        k, a = bt.grams(h, row, n)
        e_key, e_at = bt.grams(exact, exact_row, n)
        for key, at, first, is_exact in ((k, a, False, False), (*_other(h, alone, a, n), True, False), (e_key ^ EXACT, e_at, False, True)):
            j = np.minimum(np.searchsorted(only, key), len(only) - 1)
            ok = only[j] == key
            parts.append((key[ok], at[ok], np.full(int(ok.sum()), n), first, is_exact))
    return parts


def _emit(df: DataFrame, window: int, sent: Broadcast | None) -> DataFrame:
    """Windows of (id, text) rows; `sent`: sorted hashes to keep, of windows of some lengths (documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in bt.pieces(bt.column(b, "text")):
                tokens = canonical(data, offsets)
                h, value, row, _, exact_row = tokens
                parts = _item_windows(tokens, hi - lo, window) if sent is None else _document_windows(tokens, *sent.value)
                for key, at, size, first, exact in parts:
                    if not len(key):
                        continue
                    of = exact_row if exact else row
                    slots = [[] if exact else _slots(h, value, a + first, s - first) for a, s in zip(at, size)]
                    cols = [pa.array(ids[lo:hi][of[at]], pa.int64(), from_pandas=True), pa.array(key.view(np.int64)), pa.array((at - np.searchsorted(of, of[at])).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(key), exact)), pa.array(slots, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "whash", "pos", "size", "exact", "slots"])

    return df.mapInArrow(run, _SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, same_slots): documents that hold windows of benchmark items.

    Windows are counted as templates and as exact tokens, each by itself: coverage is the greater share of the item's
    windows found, n_windows the greater number; same_slots tells whether some hit has the item's own values.  Null and
    empty texts have no windows; rows without an id are not reported; an item that occurs twice in the benchmark counts
    once; an empty table on either side gives no rows.
    """
    items = _emit(benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")), window, None)
    items = cut(items.where("id is not null").dropDuplicates(["id", "whash", "pos"]))
    n = items.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    hits = None
    for k in range(blocks if n else 0):
        block = items.where(F.pmod("whash", F.lit(blocks)) == k) if blocks > 1 else items
        hashes = block.select("whash", "size").distinct().toPandas()  # at most about BLOCK_WINDOWS rows
        only = np.sort(hashes["whash"].to_numpy().view(np.uint64))
        found = _emit(rows, window, rows.sparkSession.sparkContext.broadcast((only, sorted(set(hashes["size"].tolist())))))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = rows.sparkSession.createDataFrame([], _SCHEMA)
    i, d = items.alias("i"), hits.alias("d")
    agree = F.expr("not exists(sequence(1, greatest(size(i.slots), 1)), x -> x <= size(i.slots) and d.slots[array_position(i.slots, i.slots[x - 1]) - 1] <> d.slots[x - 1])")
    joined = d.join(i, (F.col("i.whash") == F.col("d.whash")) & (F.col("i.size") == F.col("d.size")) & (F.size("i.slots") == F.size("d.slots"))).where(agree)
    per = joined.groupBy(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), F.col("i.exact").alias("exact")).agg(F.countDistinct("i.pos").alias("n"), F.max(F.col("i.exact") | (F.col("i.slots") == F.col("d.slots"))).alias("same"))
    total = items.groupBy(F.col("id").alias("item_id"), "exact").agg(F.countDistinct("pos").alias("all"))
    return per.join(total, ["item_id", "exact"]).groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.max(F.col("n") / F.col("all")).alias("coverage"), F.max("same").alias("same_slots"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id") -> DataFrame:
    """`docs` without the documents that hold a window of a benchmark item; rows without an id stay."""
    return docs.join(contaminated(docs, benchmark, window, id_col).select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
