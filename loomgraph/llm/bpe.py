"""Byte-level BPE encoding and decoding.

Words are the pre-tokenizer's matches.  A match that is a token of the vocabulary is that token, as in the library.  The
distinct other words of a text are encoded with Spark's higher-order functions: the bytes of a word become symbols, and
a fold merges the adjacent pair of least rank until no pair has a rank, the ranks coming from a constant table.  Common
words are folded once beforehand and sent to the workers, in bounded number.  Taking the words of a text is done by
Arrow batches in Python, which leave a hole for each word that is not known; the fold's results fill the holes, all in
one pass over the texts without a shuffle.  Decoding concatenates the binary pieces of the identifiers.

The fold takes one step a byte over the whole state, so that its work grows with the square of a word's length.  Words
of more than LONG_WORD bytes (unbroken runs of letters) have the same merges done with a heap and a linked list instead.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import literals
from loomgraph.llm.storage import cut, short_plans, small_batches, tidy

#: The cache of common words is learned from about so many documents and holds so many words at most.  It only saves
#: work: what it lacks is encoded by the same fold, text by text.
CACHE_DOCUMENTS = 30_000
CACHE_WORDS = 250_000
#: Texts that a worker holds at once.
BATCH = 500
#: Bytes of the longest word that is folded.
LONG_WORD = 256
#: Rank of pairs without one, and the symbol after the last; identifiers are below both.
_NONE = 1 << 16
_END = _NONE - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def explicit_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out as Unicode white space, as in the library's engine."""
    white = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    inside = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{white}{m[2]}]", pattern)
    return inside.replace("\\S", f"[^{white}]").replace("\\s", f"[{white}]")


def merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The identifiers of one word: the leftmost pair of least rank is merged until no pair has a rank, in n log n steps."""
    n = len(word)
    symbols: list[bytes] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # an end of the pair was merged meanwhile
        symbols[i], symbols[j] = a + b, b""
        after[i] = k = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
        for x, y in ((i, k), (before[i], i)):
            if x >= 0 and y >= 0 and (r := rank.get(symbols[x] + symbols[y])) is not None:
                heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
    return [rank[x] for x in symbols if x]


class Known:
    """What a worker knows of words: the vocabulary's own, and the cache's, by their identifiers joined by commas."""

    def __init__(self, pieces: list[bytes], words: str, ids: str):
        self.rank = {p: i for i, p in enumerate(pieces) if p}
        self.of = dict(zip(words.split("\0"), ids.split(" "))) if ids else {}
        for piece, i in self.rank.items():
            try:
                self.of[piece.decode()] = str(i)
            except UnicodeDecodeError:  # part of a character: no word
                continue

    def long(self, word: str) -> str | None:
        """The identifiers of a word that is too long to be folded."""
        if len(word) * 4 <= LONG_WORD or len(b := word.encode("utf-8", "surrogatepass")) <= LONG_WORD:
            return None
        return ",".join(map(str, merge_long(b, self.rank)))


_known: list[tuple[tuple, Known]] = []


def known_words(sent: Broadcast) -> Known:
    """One `Known` for each broadcast and worker, kept from task to task; only the last one is kept."""
    value = sent.value
    if not _known or _known[0][0] is not value:
        _known[:] = [(value, Known(*value))]
    return _known[0][1]


class Codec:
    """Expressions for one vocabulary, as SQL text over a constant column __ranks or __pieces.  Identifiers are ranks, as in
    the library."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = explicit_pattern(pattern)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        first, rows = literals.displaced(pairs, _END + 1)
        self.ranks = F.struct(literals.longs(first).alias("d"), literals.longs(rows).alias("r"), literals.longs([ranks[bytes([b])] for b in range(256)]).alias("bytes"))
        self.settled = False
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def settle(self, spark) -> None:  # noqa: ANN001
        """Puts the constant table of ranks into a table of one row, from which plans take it by a scalar subquery: as a
        literal it would be written out in every description of a plan that the driver keeps."""
        if not self.settled:
            self.ranks = cut(spark.range(1).select(self.ranks.alias("t"))).select("t").scalar()
            self.settled = True

    def _rank(self, a: str, b: str) -> str:
        """Rank of the pair (a, b) in its place of a state, _NONE there if it has none."""
        return f"shiftleft(least(t.r[t.d[{a}] + {b}] ^ shiftleft({a} + 1L, 20), {_NONE}L), 46)"

    def _fold(self, word: str) -> str:
        """The identifiers of `word`, joined by commas, with the constant table under the name t.

        The fold has as many steps as a word has bytes, less one.  Its state is a number for each symbol, that has from
        the top: the rank of the pair with the next symbol, the symbol's first byte, the symbol.  So the least number is
        the leftmost pair of least rank, whose rank is the merged symbol.  An end symbol follows the last.
        """
        symbols = f"concat(transform(split(decode(encode({word}, 'UTF-8'), 'ISO-8859-1'), ''), c -> t.bytes[ascii(c)]), array({_END}L))"
        start = f"transform(x, (b, i) -> if(b = {_END}L, {_NONE << 46}L, {self._rank('b', 'x[i + 1]')}) | shiftleft(cast(i as bigint), 16) | b)"
        n = "shiftright(m, 46)"
        new = f"{self._rank(n, '(s[p + 1] & 65535L)')} | (m & {(1 << 46) - (1 << 16)}L) | {n}"
        before = f"{self._rank('(e & 65535L)', n)} | (e & {(1 << 46) - 1}L)"
        merged = f"transform(array_remove(s, s[p]), (e, i) -> case when i = p - 1 then {new} when i = p - 2 then {before} else e end)"
        step = _let("array_min(s)", "m", f"if(m >= {_NONE << 46}L, s, {_let('cast(array_position(s, m) as int)', 'p', merged)})")
        done = "s -> array_join(transform(slice(s, 1, size(s) - 1), e -> cast(e & 65535L as string)), ',')"
        return _let(symbols, "x", f"aggregate(sequence(1, greatest(size(x) - 2, 1)), {start}, (s, k) -> {step}, {done})")

    def encode_words(self, words: DataFrame, column: str = "w") -> DataFrame:
        """(w, ids) of distinct words: the identifiers of each, joined by commas."""
        return words.withColumn("__ranks", self.ranks).select(F.col(column).alias("w"), F.expr(_let("__ranks", "t", self._fold(column))).alias("ids"))

    def fill(self, found: DataFrame, column: str, name: str) -> DataFrame:
        """`found` with a column `name`: the identifiers of each text, from the words that `column` holds beside the
        pieces of identifiers between them (struct<pieces, holes, words>, as `encode` takes them)."""
        done = f"transform({column}.words, w -> {self._fold('w')})"
        piece = f"zip_with({column}.pieces, {column}.holes, (a, h) -> concat_ws(',', nullif(a, ''), d[h]))"
        filled = _let("__ranks", "t", _let(done, "d", f"array_join(filter({piece}, a -> a <> ''), ',')"))
        whole = f"if(size({column}.words) = 0, {column}.pieces[0], {filled})"
        return found.withColumn("__ranks", self.ranks).withColumn(name, F.expr(whole)).drop("__ranks")

    def decode(self, coded: DataFrame, ids: str = "ids", name: str = "decoded", workers: bool = True) -> DataFrame:
        """`coded` with a binary column: the bytes of the identifiers that column `ids` holds joined by commas.

        With `workers`, Arrow batches join the pieces; without, Spark's own functions do, as hexadecimal texts, since only
        texts can be joined in one step: they take about twice the time but no further worker and its memory.
        """
        if not workers:
            pieces = F.split(F.lit(",".join(p.hex() for p in self.pieces)), ",")
            joined = f"array_join(transform(split({ids}, ','), i -> t[cast(i as int)]), '')"
            return coded.withColumn("__pieces", pieces).withColumn(name, F.expr(f"if({ids} = '', X'', unhex({_let('__pieces', 't', joined)}))")).drop("__pieces")
        sent = coded.sparkSession.sparkContext.broadcast({str(i): p for i, p in enumerate(self.pieces)})  # the vocabulary

        kind = T.StructType([f for f in coded.schema.fields if f.name != name] + [T.StructField(name, T.BinaryType())])
        carried = kind.names[:-1]

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece = sent.value.__getitem__
            for b in (whole.slice(lo, BATCH) for whole in batches for lo in range(0, len(whole), BATCH)):
                texts = [b"".join(map(piece, x.split(","))) if x else b"" for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in carried] + [pa.array(texts, pa.binary())], [*carried, name])

        # over whole rows: the planner leaves out a function of one column that hangs on another's result in a lambda
        return coded.mapInArrow(join, kind)


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `value` worked out once under `name`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cache(codec: Codec, texts: DataFrame) -> Broadcast:
    """(pieces of the vocabulary, common words, their identifiers) for the workers: CACHE_WORDS words at most, as two
    strings, so that the driver holds no table of them."""
    n = texts.count()
    pattern = codec.pattern
    sample = texts.where(F.pmod(F.xxhash64(F.lit("cache"), "text"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, CACHE_DOCUMENTS / max(1, n)))))
    own = {p for p in codec.pieces if p}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        c: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(find(t))
        rows = [(w, k) for w, k in c.items() if len(e := w.encode("utf-8", "surrogatepass")) <= LONG_WORD and e not in own and "\0" not in w]
        for lo in range(0, len(rows), 100_000):
            w, k = zip(*rows[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64())], ["w", "n"])

    top = sample.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(CACHE_WORDS)
    coded = cut(codec.encode_words(cut(top.select("w").repartition(48))))  # the plan with the constant tables is not planned anew
    coded = coded.agg(F.collect_list(F.struct("w", "ids")).alias("x")).select(F.expr("array_join(x.w, char(0))").alias("w"), F.expr("array_join(x.ids, ' ')").alias("ids"))  # two strings
    text = coded.first()
    tidy(texts.sparkSession)  # plans with the constant tables are large
    return texts.sparkSession.sparkContext.broadcast((codec.pieces, text["w"], text["ids"]))


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", name: str = "ids") -> DataFrame:
    """`docs` with a column `name`: the identifiers of each whole text joined by commas ('' for null and empty texts).

    Repeated rows stay repeated, rows without an id are encoded like others, an empty table gives no rows, and the other
    columns are untouched.
    """
    short_plans(docs.sparkSession)  # the constant tables would fill the driver's plan descriptions
    small_batches(docs.sparkSession)
    codec.settle(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sent, pattern = _cache(codec, docs.select(text.alias("text"))), codec.pattern
    kind = T._parse_datatype_string("struct<pieces: array<string>, holes: array<int>, words: array<string>>")
    rows = docs.withColumn("__text", text)
    carried = docs.columns

    def taken(texts: list[str], find: Callable, words_known: Known) -> pa.Array:
        known, long = words_known.of.get, words_known.long
        pieces, holes, words, ends, word_ends = [], [], [], [0], [0]
        for t in texts:
            found = find(t)
            ids = list(map(known, found))
            new: dict[str, int] = {}
            at = 0
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        if (x := long(found[i])) is not None:
                            ids[i] = x
                            continue
                        pieces.append(",".join(ids[at:i]))
                        holes.append(new.setdefault(found[i], len(new)))
                        at = i + 1
            pieces.append(",".join(ids[at:]))
            holes.append(None)  # no word follows the last piece
            words.extend(new)
            ends.append(len(pieces))
            word_ends.append(len(words))
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, k)) for e, v, k in ((ends, pieces, pa.string()), (ends, holes, pa.int32()), (word_ends, words, pa.string()))]
        return pa.StructArray.from_arrays(lists, names=["pieces", "holes", "words"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = regex.compile(pattern).findall, known_words(sent)
        for whole in batches:
            for lo in range(0, len(whole), BATCH):
                b = whole.slice(lo, BATCH)
                cols = [b.column(b.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*cols, taken(b.column(b.schema.get_field_index("__text")).to_pylist(), find, known)], [*carried, "__found"])

    found = rows.mapInArrow(take, T.StructType([*docs.schema.fields, T.StructField("__found", kind)]))
    filled = codec.fill(found, "__found", name).drop("__found")
    tidy(docs.sparkSession)
    return filled


def count_ids(ids: Column) -> Column:
    return F.when(ids == "", F.lit(0)).otherwise(F.octet_length(ids) - F.octet_length(F.replace(ids, F.lit(","), F.lit(""))) + 1).cast("long")


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    coded = codec.decode(encode(docs.select("doc_id", "text"), codec).select("doc_id", "ids"))
    return coded.select("doc_id", count_ids(F.col("ids")).alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_codec() -> Codec:
    import public_tokenizers

    return Codec(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract query: every whole text encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_codec())
