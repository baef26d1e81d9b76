from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.support import TEXTS, table, with_clashes
from tidewake.llm import bpe, packing, shared, simhash, tokenfile, tokens, wordtable

DATA = "/root/testdata/sf0.001"
PATH = tokens.vocabulary()
LIBRARY, BACK = tokens.Encoder(PATH), bpe.Backtracking(PATH)


def ids(t):
    return LIBRARY.library.encode(t or "", add_special_tokens=False).ids


PIECES = ["a", "b", "th", "e", "s", "'s", "'S", "'re", "!", "!!", "é", "é", "ß", "İ", "Σ", " ", "\n", "\u2009", "\x85", "1", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|>", "</w>", "w", "😀", "字", "ﬁ", "\x1c", "\x00", "-", "x" * 30, "'ll", "ſ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_ids_equal_the_librarys(text):
    want = ids(text)
    assert LIBRARY([text])[0].tolist() == want
    assert BACK([text])[0].tolist() == want


SOME = ["one two three four five", "one six", "", "seven one", "it's 12 we'll ''s don'tx " * 9, "a" * 40 + " " + "ab" * 30, "abcdefghij abcdefghik abcdefgh \u4e2d one \u4e2d'll"]


@pytest.mark.parametrize("kind", [tokens.Encoder, bpe.Backtracking])
def test_caches_may_empty(monkeypatch, kind):
    monkeypatch.setattr(wordtable, "LIMIT", 6)
    monkeypatch.setattr(wordtable, "STRETCH", 50)
    monkeypatch.setattr(tokens, "KEPT", 50)
    small = kind(PATH)
    for _ in range(2):
        for t in SOME:
            assert small([t, t])[1].tolist() == ids(t)
        assert [x.tolist() for x in small(SOME)] == [ids(t) for t in SOME]


def test_words_of_one_tag_are_told_apart(monkeypatch):
    monkeypatch.setattr(wordtable, "_mix", [np.uint64(0)] * 4)  # all words of 8 bytes or more have one tag, and all words one place
    small = tokens.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in small(SOME)] == [ids(t) for t in SOME]


def test_every_entry_is_its_own_encoding():
    rng = random.Random(7)
    for form in rng.sample(list(BACK.id), 3000):
        if ord(form[-1]) >= bpe.END and all(ord(c) < bpe.END for c in form[:-1]):
            assert BACK.word(form) == [BACK.id[form]]
            inner = [BACK.id[c] for c in form]
            assert len(inner) == len(form)


def test_bpe(spark):
    rows = bpe.op5_bpe(with_clashes(table(spark))).collect()

    def digest(t):
        n = ids(t)
        return len(n), hashlib.sha256(" ".join(map(str, n)).encode()).hexdigest(), hashlib.sha256(LIBRARY.library.decode(n, skip_special_tokens=False).encode()).hexdigest()

    assert collections.Counter(tuple(r) for r in rows) == collections.Counter((d, *digest(t)) for d, t in TEXTS)
    assert bpe.op5_bpe(table(spark).limit(0)).collect() == []


def test_long_texts(spark):
    long = "word " * 400_000 + "x" * 300_000 + " 1" * 100_000
    docs = table(spark, [(1, long), (2, "short")])
    n = np.array([*ids(long), 1], "<u4")
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.op10_tokenfile(docs).collect()} == {(1, len(n), zlib.crc32(n.tobytes())), (2, 2, zlib.crc32(np.array([*ids("short"), 1], "<u4").tobytes()))}
    row = bpe.op5_bpe(docs).filter("doc_id = 1").first()
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, n[:-1])).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(LIBRARY.library.decode(n[:-1].tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_token_file(spark):
    for docs in (shared.documents(spark, DATA), with_clashes(table(spark))):
        want, at = [], 0
        for d, t in sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
            n = np.array([*ids(t), 1], "<u4")
            want.append((d, len(n), zlib.crc32(n.tobytes())))
            at += len(n)
        got = sorted((tuple(r) for r in tokenfile.op10_tokenfile(docs).collect()), key=lambda r: r[1])
        assert collections.Counter((d, n, c) for d, _, n, c in got) == collections.Counter(want)
        assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
        order = [(d is not None, d or 0) for d, _, _, _ in got]
        assert order == sorted(order)
    assert tokenfile.op10_tokenfile(table(spark).limit(0)).collect() == []


def test_batches_stay_small(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, most, plain = spark.conf.get(limit), 2 * shared.BATCH, tokens.small

    def checked(batches):
        for batch in batches:
            if batch.slice(0, batch.num_rows - 1).nbytes > most:  # a long text may be the last of one
                raise ValueError(f"{batch.nbytes} bytes in a batch")
            yield from plain([batch])

    monkeypatch.setattr(tokenfile, "small", checked)
    monkeypatch.setattr(simhash, "small", checked)
    texts = [(k, f"text {k} " * 1500) for k in range(1500)] + [(1500, "long " * shared.BATCH)]
    docs = table(spark, texts).coalesce(1)
    got = tokenfile.op10_tokenfile(docs).agg({"n_tokens": "sum", "doc_id": "count"}).first()
    whole = [len(ids) + 1 for ids in tokens.encoder(PATH)([t for _, t in texts])]
    assert (got["sum(n_tokens)"], got["count(doc_id)"]) == (sum(whole), 1501)
    assert shared.written(simhash.fingerprints(docs)).count() == 1501
    assert spark.conf.get(limit) == before
    with shared.bounded(spark):
        with pytest.raises(ZeroDivisionError), shared.bounded(spark):
            raise ZeroDivisionError
        assert spark.conf.get(limit) == str(shared.BATCH)
    assert spark.conf.get(limit) == before


def test_documents_of_a_token_file(spark):
    docs, folder = shared.documents(spark, DATA), shared.scratch(spark)
    tokenfile.write(docs, folder, PATH, block_ids=3000)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    asked = [*list(texts)[::17], -5]
    got = {r.doc_id: r.ids for r in tokenfile.documents(spark, folder, asked).collect()}
    assert got == {d: [*ids(texts[d]), 1] for d in asked if d in texts}
    got = {r.doc_id: r.ids for r in tokenfile.documents(spark, folder, asked, 3, 9).collect()}
    assert got == {d: [*ids(texts[d]), 1][3:9] for d in asked if d in texts}
    assert tokenfile.documents(spark, folder, []).collect() == []


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 32])
def test_bit_packing(width, monkeypatch):
    rng = np.random.default_rng(width)
    monkeypatch.setattr(tokenfile, "RUN", 64)
    n = rng.integers(0, 1 << width, 1000, np.uint64).astype("<u4")
    data = tokenfile.packed(n, width)
    assert len(data) == -(-1000 * width // 8)
    for a, b in ((0, 1000), (37, 999), (5, 5), (999, 1000)):
        assert (tokenfile.unpacked(data, width, a, b) == n[a:b]).all()


def check_packing(rows, docs):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); docs: (doc_id, text)."""
    want = collections.Counter()
    for d, t in docs:
        n = np.array([*ids(t), 0], "<u4")
        for k, a in enumerate(range(0, len(n), 2048)):
            want[(d, k, a, len(n[a : a + 2048]), zlib.crc32(n[a : a + 2048].tobytes()))] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r[5]].append((r[6], r[3]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins)


def test_packing(spark):
    docs = shared.documents(spark, DATA)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    made = packing.pieces(docs, PATH)
    least = -(-sum(len(ids(t)) + 1 for _, t in texts) // 2048)
    for per_part in (50_000, 40):
        rows = [tuple(r) for r in packing.pack(made, per_part).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
        # partitions of 40 pieces can't be as full as whole ones
        assert check_packing(rows, texts) <= (least + 1 if per_part > 1000 else least * 1.03 + 1)
    check_packing([tuple(r) for r in packing.op4_packing(with_clashes(table(spark))).collect()], TEXTS)
    assert packing.op4_packing(table(spark).limit(0)).collect() == []


def test_lower_bounds_hold():
    rng = random.Random(3)

    def fewest(items, capacity):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= items[i]:
                    place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        bound = packing.lower_bound(np.array(items), 20)
        assert bound <= fewest(items, 20) <= len(packing.best_fit(np.array(items), 20)[2])
    assert packing.lower_bound(np.full(9, 1025)) == 9
