"""The corpus operators against libraries and brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomgraph.llm import bpe, components, decontaminate, imatch, langid, licenses, quality, sais, simhash, spandedup, tokencount, toxicity

AT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, ids string, rid long"
ODD = [None, "", "a", "  ", "\n\n \t x", "x\u0085 y", "it's we'll 'S", "日本語 🙂🙂", "a\0b", "x" * 700, " " * 300, "12345 ½²", "Ωmega ΣΑΣ naïve", "--- ,,, !!", "<|endoftext|> a", "a", "the same text here " * 40, "the same text here " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{AT}/documents.parquet").collect()]
    rows = real + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_002, "a"), (None, "no id"), (None, None)]
    return rows, spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, 1, "x", 2) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_byte_bpe(docs, empty):
    rows, df = docs
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(enc.decode_bytes(ids))))
    codec = bpe.default_codec()
    assert listed(bpe.digests(df, codec)) == sorted(want, key=str)
    assert bpe.digests(empty, codec).count() == 0
    coded = bpe.encode(df.select("doc_id", "text"), codec)
    for workers in (True, False):
        assert codec.decode(coded, workers=workers).where("decoded <> encode(coalesce(text, ''), 'UTF-8')").count() == 0


def test_long_words(spark):
    """Unbroken runs of letters have the same tokens as in the library, in time that does not grow with their square."""
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = [(1, "abcdefgh" * 12_500), (2, "x" * 100_000), (3, "é" * 255 + " " + "the" * 400), (4, "a" * 257), (5, "1" * 3000 + "!" * 3000)]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_codec()).collect()}
    assert all(got[i] == ",".join(map(str, enc.encode_ordinary(t))) for i, t in rows)


def test_token_counts(docs, empty):
    rows, df = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in rows]
    assert listed(tokencount.count_tokens(df, path)) == sorted(want, key=str)
    assert tokencount.count_tokens(empty, path).count() == 0


def test_simhash(docs, empty, spark, monkeypatch):
    rows, df = docs
    fp = [(i, simhash.fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fp})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fp:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fp), key=str)
    got = lambda: listed(simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id"))
    assert got() == want
    monkeypatch.setattr(simhash, "PAIRED", 1)  # every list is split by masks
    assert got() == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint("a b c") == int(spark.sql("select hex(xxhash64('a b c'))").first()[0], 16)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[j : j + length] for _, t in texts for j in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        runs = sum(bool(g) and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"wide": 2}, {"resolve": "suffix_array"}])
def test_span_dedup(docs, empty, options):
    rows, df = docs
    assert listed(spandedup.remove_repeats(df, 60, **options)) == brute(rows, 60)
    assert spandedup.remove_repeats(empty, 60, **options).count() == 0


def test_span_dedup_contract_length(docs):
    rows, df = docs
    assert listed(spandedup.remove_repeats(df)) == brute(rows, 400)


def test_suffix_array():
    for text in (b"", b"a", b"banana", b"mississippi", b"aaaa", bytes(range(50)) * 3, b"abab" * 9 + b"a"):
        order = sais.suffix_array(list(text), 255)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        common = sais.permuted_common_prefixes(text, order)
        for a, b in zip(order, order[1:]):
            n = 0
            while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert common[b] == n


def test_document_fingerprints(docs, empty):
    rows, df = docs
    clean = df.selectExpr("doc_id", "coalesce(text, '') as text")
    got = imatch.edited_fingerprints(clean).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    text = {(i, len(t or "")): t or "" for i, t in rows}
    for r in got:
        by[text[r["doc_id"], r["n_chars"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert max(map(len, by.values())) == 1
    order = sorted((i, t or "") for i, t in rows if i is not None and i < 10_000)
    sha = {r["doc_id"]: r["edited_sha256"] for r in got}
    for (i, t), (_, after) in zip(order, order[1:]):
        h = len(t) // 2
        assert sha[i] == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
    assert imatch.edited_fingerprints(empty.select("doc_id", "text")).count() == 0


def test_languages(spark, docs, empty):
    real = spark.read.parquet(f"{AT}/documents.parquet")
    model = langid.fit(real)
    known = {r.doc_id: r.lang for r in real.collect()}
    got = langid.identify(docs[1], model).collect()
    held = [(known[r.doc_id], r.lang_pred) for r in got if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert {r.doc_id: r.lang_pred for r in got}[10_000] == "und" and {r.doc_id: r.lang_pred for r in got}[10_013] == "und"
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(docs[0])
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0


def test_quality_and_toxicity(spark, docs, empty):
    at = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    scored = quality.fit(real, labels)
    held = [(truth[r.doc_id].quality, r.predicted) for r in quality.score(real, scored).collect() if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    model = toxicity.fit(real, labels)
    held = [(truth[r.doc_id].toxic, r.predicted) for r in toxicity.score(real, model).collect() if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) and sum(a < b for a, b in held) <= 1
    for out in (quality.score(docs[1], scored), toxicity.score(docs[1], model), quality.score(docs[1], None)):
        got = out.collect()
        assert len(got) == len(docs[0]) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(real, none) is None and len(toxicity.fit(real, none)[0]) == 0
    assert quality.score(empty, scored).count() == 0 and toxicity.score(empty, model).count() == 0


def test_decontamination(spark, docs, empty):
    item = "In March a farmer called Anna sold 12 kg of ripe apples to the town market and then gave 12 coins to her young sister"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short")], "item_id long, text string")
    rows = [
        (1, f"Before this. {item}. And after."),
        (2, item.upper()),
        (3, item.replace("12", "450").replace("Anna", "Berta")),
        (4, item.replace("12 kg", "13 kg")),
        (5, "In March a farmer sold nothing at all to anyone in the whole wide county, which was sad for the apples"),
        (6, None), (7, ""), (None, item),
    ]
    got = {r["doc_id"]: r["same_slots"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1] is True and 2 in got and 3 in got and not {5, 6, 7, None} & set(got)
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs[1], bench.limit(0)).count() == 0


def test_decontamination_finds_verbatim_items(spark):
    d, b = spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/benchmark.parquet")
    want = {(x.doc_id, y.item_id) for x in d.collect() for y in b.collect() if y.text in (x.text or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert want <= got


def test_licenses(spark, empty):
    text = licenses.TEMPLATES["mit"][1]
    rows = [(1, f"code {text} more"), (2, text.replace("without restriction", "with no restriction at all")), (3, "Released under the MIT License."), (4, "a license to drive"), (5, None), (6, "")]
    got = {(r["doc_id"], r["license"], r["template"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "mit", 1), (2, "mit", 1), (3, "mit", 0)}
    one = got[1, "mit", 1]
    assert rows[0][1].encode()[one["start_byte"] : one["end_byte"]].decode() == text.rstrip(".") and one["coverage"] == 1
    assert 0.9 < got[2, "mit", 1]["coverage"] < 1
    assert licenses.scan(empty).count() == 0
