"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bytetext as bt

#: Entries that a worker keeps of pieces and words counted before; the memory is emptied when it is full.
REMEMBERED = 600_000


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in visible}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class Counter:
    """Counts tokens as the tokenizer described by a .json file does: special strings, normalisation, pieces, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.vocabulary = spec["model"]["vocab"].keys()
        self.symbol = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        self.nfc, self.lower = (any(n["type"] == kind for n in steps) for kind in ("NFC", "Lowercase"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.of_word: dict[str, int] = {}
        self.of_piece: dict[bytes, int] = {}

    def merges(self, word: str) -> int:
        """Symbols less merges: the adjacent pair of least rank, leftmost first, is merged until none has a rank."""
        symbols = [self.symbol[b] for b in word.encode("utf-8", "surrogatepass")]
        if not symbols:
            return 0
        symbols[-1] += self.suffix
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # an end of the pair was merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            after[j] = -1
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return left

    def _plain(self, text: str) -> int:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter, without the final form of sigma
        total = 0
        for w in self.pattern.findall(text):
            n = self.of_word.get(w)
            if n is None:
                n = self.merges(w)
                if len(w) <= 64:
                    if len(self.of_word) >= REMEMBERED:
                        self.of_word.clear()
                    self.of_word[w] = n
            total += n
        return total

    def piece(self, piece: bytes) -> int:
        """Tokens of a text without ASCII white space."""
        text = piece.decode("utf-8", "replace")
        if self.special is None or not (found := self.special.findall(text)):
            n = self._plain(text)
        else:
            n = len(found) + sum(map(self._plain, self.special.split(text)))
        if len(piece) <= 64:
            if len(self.of_piece) >= REMEMBERED:
                self.of_piece.clear()
            self.of_piece[piece] = n
        return n

    def count(self, text: bytes) -> int:
        """Tokens of a UTF-8 text.  No token holds white space, so that the pieces between it are counted apart."""
        known = self.of_piece.get
        total = 0
        for p in text.split():
            n = known(p)
            total += self.piece(p) if n is None else n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each file and worker, which keeps what it has counted from task to task."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; `path` is read on the executors.

    Null texts count as empty ones (0 tokens).  Rows without an id are counted too; repeated rows stay repeated; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            data, offsets = bt.buffer_of(bt.column(b, "text"))
            n = [c.count(data[lo:hi].tobytes()) for lo, hi in zip(offsets, offsets[1:])]
            size = offsets[1:] - offsets[:-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract query: tokens of every whole text by word_bpe_49k.json."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
