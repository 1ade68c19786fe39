"""Document fingerprints and likenesses against a plain version, in the order of ids, with ties, repeats and a wrap-around."""

import collections
import hashlib
import re
import struct

import regex
import xxhash

from loomgraph.llm import imatch

AT = "/root/testdata/sf0.001"
SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def hash_text(t):
    return SIGNED(xxhash.xxh64_intdigest(t.encode(), 42))


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return SIGNED(seed)


def hash_with(v, k):
    return SIGNED(xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", v), 42)))


def terms(text):
    return list(dict.fromkeys(hash_text(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w))


def lexicon(texts):
    n = collections.Counter(h for t in texts for h in terms(t))
    low = max(imatch.BAND[0], sum(n.values()) / max(1, len(texts)) / imatch.LEXICON_BOUND)
    return {h for h, c in n.items() if low * len(texts) <= c <= imatch.BAND[1] * len(texts)}


def hexed(v):
    return f"{v & 0xFFFFFFFFFFFFFFFF:x}"[-imatch.WIDTH :].rjust(imatch.WIDTH, "0")


def parts(text, words):
    every = terms(text)
    kept = sorted(h for h in every if h in words)
    out = []
    for j in range(imatch.PARTS - 1):
        rate = imatch.RATES[j // imatch.PER_RATE]
        mine = [h for h in kept if all(hash_with(h, k) >> j & 1 for k in range(rate))]
        out.append(hexed(hash_longs(mine)) if mine else "-" * imatch.WIDTH)
    if kept:
        rest = hash_longs(kept)
    elif every:
        rest = hash_longs(sorted(every))
    else:
        rest = SIGNED(xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(text.encode(), 42)))
    return [*out, hexed(rest)]


def likeness(a, b):
    either = [(x, y) for x, y in zip(a, b) if not re.fullmatch("-+", x) or not re.fullmatch("-+", y)]
    return sum(x == y for x, y in either) / len(either)


def plain(rows):
    """The digest columns of (doc_id, text) rows; a missing id comes first."""
    words = lexicon([t for _, t in rows])
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hash_text(r[1])))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        a, b, c = parts(t, words), parts(edited, words), parts(after, words)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def test_same_as_plain_version(spark, monkeypatch):
    real = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{AT}/documents.parquet").collect()]
    rows = [*real, (None, "no id here"), (10, "a second text of ten"), (10_001, ""), (10_002, "repeated"), (10_002, "repeated"), (10_003, "日本語 🙂🙂 naïve"), (-5, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for size in (imatch.RANGE_BYTES, 1 << 14):  # one range, and many
        monkeypatch.setattr(imatch, "RANGE_BYTES", size)
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in imatch.edited_fingerprints(docs).collect()]
        assert sorted(got, key=str) == plain(rows)


def test_one_row_follows_itself(spark):
    got = imatch.edited_fingerprints(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in got] == [(1, 1.0)] and imatch.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
