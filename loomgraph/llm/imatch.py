"""I-Match document fingerprints, with DataFrame functions only.

A term is a run of letters and digits in lower case.  The lexicon holds the terms of a band of inverse document
frequencies; a document's distinct lexicon terms are sorted, and hashed once for each of several randomised
sub-lexicons.  Two documents are alike in the share of sub-lexicons on which their hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.llm import literals
from loomgraph.llm.storage import cut

#: Terms that occur in this share of the documents at least and at most.
BAND = (0.002, 0.2)
#: The lexicon is sent to every task.  Terms in a share p of the documents number at most (mean distinct terms of a
#: document) / p, whatever the corpus; the lower end of the band rises where that could pass this bound.
LEXICON_BOUND = 100_000
#: Sub-lexicons: eight for each sampling rate (as a power of 1/2).
RATES = (3, 5, 6, 7)
PER_RATE = 8
PARTS = len(RATES) * PER_RATE + 1
WIDTH = 8
#: Documents in the order of their ids are dealt out in ranges of about so many bytes; there are at most MOST_RANGES of
#: them (their bounds are two constant arrays), larger ones beyond that.
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000


def terms(text: str) -> str:
    """SQL for the hashes of the distinct terms of a text column."""
    return f"transform(array_distinct(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')), w -> xxhash64(w))"


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> list[int]:
    """Hashes of the terms in the band, at most LEXICON_BOUND of them."""
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__t")).select(F.explode(F.expr(terms("__t"))).alias("h"))
    counts = cut(found.groupBy("h").agg(F.count("*").alias("n")))
    n = docs.count()
    pairs = counts.agg(F.sum("n")).first()[0] or 0
    low = max(band[0], pairs / max(1, n) / LEXICON_BOUND)
    return sorted(r[0] for r in counts.where((F.col("n") >= low * n) & (F.col("n") <= band[1] * n)).select("h").collect())


def _parts(df: DataFrame, words: list[int], text_col: str, name: str) -> DataFrame:
    """`df` with an array of PARTS hashes (hex or null): one for each sub-lexicon, and one for all lexicon terms."""
    p, q, first, second = literals.two_place(words)
    table = F.struct(*[literals.longs([0 if i is None else words[i] for i in t]).alias(c) for c, t in (("a", first), ("b", second))])
    masks = [((1 << PER_RATE) - 1) << (PER_RATE * i) for i in range(len(RATES))]
    grouped = " | ".join("(" + " & ".join([*(f"xxhash64(h, {k})" for k in range(rate)), f"{m}L"]) + ")" for rate, m in zip(RATES, masks))
    kept = f"array_sort(transform(filter(__terms, h -> t.a[int(pmod(h, {p}L))] = h or t.b[int(pmod(h, {q}L))] = h), h -> struct(h as h, {grouped} as m)))"
    part = "filter(x, e -> (shiftright(e.m, j) & 1L) = 1L).h"
    short = lambda v: f"right(lower(hex({v})), {WIDTH})"
    parts = f"transform(sequence(0, {PARTS - 2}), j -> transform(array({part}), s -> if(size(s) = 0, null, lpad({short('xxhash64(s)')}, {WIDTH}, '0')))[0])"
    rest = f"lpad({short(f'''case when size(x) > 0 then xxhash64(x.h) when size(__terms) > 0 then xxhash64(array_sort(__terms)) else xxhash64({text_col}, 1) end''')}, {WIDTH}, '0')"
    whole = f"transform(array({kept}), x -> concat({parts}, array({rest})))[0]"
    return df.withColumn("__terms", F.expr(terms(text_col))).withColumn("__lexicon", table).withColumn(name, F.expr(f"transform(array(__lexicon), t -> {whole})[0]")).drop("__terms", "__lexicon")


def fingerprint(parts: str) -> Column:
    return F.expr(f"array_join({parts}, '', '{'-' * WIDTH}')")


def likeness(a: str, b: str) -> Column:
    """Share of equal parts among those that either document has."""
    both = f"zip_with({a}, {b}, (x, y) -> struct(x as x, y as y))"
    return F.expr(f"transform(array({both}), z -> size(filter(z, e -> e.x = e.y)) / cast(size(filter(z, e -> e.x is not null or e.y is not null)) as double))[0]")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[int] | None = None) -> DataFrame:
    """(doc_id, parts, fingerprint) for each row.

    Null texts count as empty.  A text without a lexicon term is known by all its terms, one without a term by its
    bytes.  Repeated rows stay repeated; an empty table gives no rows.
    """
    words = lexicon(docs, text_col) if words is None else words
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _parts(rows, words, "text", "parts").select("doc_id", "parts", fingerprint("parts").alias("fingerprint"))


def parts_of(fingerprint: str) -> str:
    """SQL for the array of parts that a fingerprint joins."""
    return f"transform(sequence(0, {PARTS - 1}), i -> nullif(substr({fingerprint}, i * {WIDTH} + 1, {WIDTH}), '{'-' * WIDTH}'))"


def range_bounds(docs: DataFrame) -> list[tuple[int | None, int]]:
    """The least (doc_id, hash of text) of each range, ascending: as many as MOST_RANGES at most."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(MOST_RANGES, size // RANGE_BYTES + 1))
    placed = docs.select("doc_id", F.xxhash64("text").alias("k")).repartitionByRange(ranges, "doc_id", "k")
    least = placed.groupBy(F.spark_partition_id().alias("b")).agg(F.min(F.struct("doc_id", "k")).alias("m"))
    return [tuple(r["m"]) for r in least.orderBy("m").collect()] or [(None, 0)]


def with_next(rows: DataFrame, bounds: list[tuple[int | None, int]], columns: tuple[str, ...]) -> DataFrame:
    """`rows` (doc_id, text, ...) with next_<c> for each of `columns`, from the row that follows by (doc_id, hash of
    text); the first follows the last, and a row without an id comes first.

    The rows are dealt out once, by range.  The first row of a range goes to the range before as well, behind its last
    row, so that each range finds its followers by itself.
    """
    lowest = -(2**63)
    ids, ks = [lowest if i is None else i for i, _ in bounds], [k for _, k in bounds]
    step = max(1, int(len(bounds) ** 0.5))
    both = lambda a, b: F.arrays_zip(literals.longs(a), literals.longs(b))
    passed = lambda h: (h["0"] < F.col("__id")) | ((h["0"] == F.col("__id")) & (h["1"] <= F.col("__k")))
    every, some = both(ids, ks), both(ids[::step], ks[::step])
    placed = rows.withColumn("__id", F.coalesce("doc_id", F.lit(lowest))).withColumn("__k", F.xxhash64("text"))
    placed = placed.withColumn("__g", (F.size(F.filter(some, passed)) - 1) * step)
    placed = placed.withColumn("__b", F.col("__g") + F.size(F.filter(F.slice(every, F.col("__g") + 1, F.lit(step)), passed)) - 1)
    head = F.element_at(every, F.col("__b") + 1)
    first = (head["0"] == F.col("__id")) & (head["1"] == F.col("__k"))
    dealt = placed.withColumn("__behind", F.explode(F.when(first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.withColumn("__b", F.when(F.col("__behind"), F.pmod(F.col("__b") - 1, F.lit(len(bounds)))).otherwise(F.col("__b")))
    w = Window.partitionBy("__b").orderBy("__behind", "__id", "__k")
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("not __behind")
    return found.drop("__id", "__k", "__g", "__b", "__behind")


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract query: each document, its edited text, and the document that follows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return edited_fingerprints(docs)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The digest columns of each row of (doc_id, text without nulls).

    Repeated rows stay repeated and follow each other; rows that share an id follow by the hash of their texts; a single
    row follows itself; an empty table gives no rows.
    """
    words = lexicon(docs)
    rows = _parts(docs.select("doc_id", "text"), words, "text", "parts").select("doc_id", "text", fingerprint("parts").alias("fingerprint"))
    both = with_next(rows, range_bounds(docs), ("text", "fingerprint")).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, int(n_chars - floor(n_chars / 2))), left(next_text, int(floor(n_chars / 2))))"))
    got = _parts(both, words, "edited", "edited_parts").withColumn("edited_fingerprint", fingerprint("edited_parts"))
    got = got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    near = lambda b, name: likeness(parts_of("fingerprint"), parts_of(b)).alias(name)
    return got.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "near_edited"), near("next_fingerprint", "near_next"))
