from __future__ import annotations

import collections
import random
import tracemalloc

import numpy as np
import xxhash

import corpus_pipeline
from tests.llm.support import TEXTS, grouped, table, with_clashes
from tidewake.llm import components, passages, quality, shared, simhash, winnow

DATA = "/root/testdata/sf0.001"


def prose(rng, n):
    return [rng.choice("bcdfgklm") + rng.choice("aeiou") + str(rng.randint(0, 9999)) for _ in range(n)]


def fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    for docs in (shared.documents(spark, DATA), with_clashes(table(spark))):
        rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        known = {f for _, f in rows}
        top = grouped([(a, b) for a in known for b in known if (a ^ b).bit_count() <= 3], known)
        least = {}
        for d, f in rows:
            if d is not None:
                least[top[f]] = min(d, least.get(top[f], d))
        got = collections.Counter(tuple(r) for r in simhash.op6_simhash(docs).collect())
        assert got == collections.Counter((d, f"{f:016x}", least.get(top[f])) for d, f in rows)
    assert simhash.op6_simhash(table(spark).limit(0)).collect() == []


def test_no_link_between_fingerprints_is_lost(spark):
    rng = np.random.default_rng(1)
    base, known = rng.integers(0, 1 << 63, 60, dtype=np.uint64), set()
    for i in range(900):
        b = int(base[i % 60])
        for k in rng.integers(0, 64, rng.integers(0, 5)):
            b ^= 1 << int(k)
        known.add(b)
    signed = lambda v: int(np.uint64(v).view(np.int64))
    df = spark.createDataFrame([(signed(v),) for v in known], "fp long")
    got = {r.node: r.root for r in components.components(simhash.near_fingerprints(df)).collect()}
    want = grouped([(signed(a), signed(b)) for a in known for b in known if (a ^ b).bit_count() <= 3], [signed(v) for v in known])
    assert {v: got.get(v, v) for v in want} == want
    # keys of more than five members are refined, then cut into blocks
    got = {r.node: r.root for r in components.components(simhash.near_fingerprints(df, crowd=5)).collect()}
    assert {v: got.get(v, v) for v in want} == want
    x = np.array(sorted(known), np.uint64)
    plain = grouped(simhash.grown(x, simhash.near_bits(3)), range(len(x)))
    assert grouped(simhash.grown_in_blocks(x, simhash.near_bits(3), 64), range(len(x))) == plain


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (401, 400), (402, 401)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(80)}, **{400 + i: 400 for i in range(3)}}


def test_near_groups(spark):
    rng = random.Random(5)
    texts, group, n = [], {}, 0
    for g in range(25):
        base = prose(rng, rng.choice([60, 80, 250, 900]))  # at 60 words one change leaves a similarity of 0.84
        for copy in range(4):
            w = list(base)
            for _ in range(0 if copy < 2 else max(1, len(w) // 120)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 99))
            texts.append((n, " ".join(w)))
            group[n] = g
            n += 1
    rng.shuffle(texts)
    kept = [r.doc_id for r in simhash.stage(with_clashes(table(spark, texts))).collect()]
    assert len(kept) == len(set(kept)) and {group[d] for d in kept} == set(range(25)) and len(kept) <= 27
    odd = simhash.stage(table(spark, TEXTS)).collect()
    assert len({(r.doc_id, r.text) for r in odd}) == len(odd)
    assert simhash.stage(table(spark, TEXTS).limit(0)).collect() == []


def test_near_groups_are_exact(spark):
    rng = random.Random(21)
    texts, sets = [], []
    for _ in range(30):
        base = prose(rng, 400)
        for changes in (0, 5, 7, 9, 10, 11, 12, 14):  # 5 shingles each: similarities of 0.70 to 0.88
            w = list(base)
            for at in range(changes):
                w[10 + at * 25] = prose(rng, 1)[0] + "x"
            texts.append((len(texts), " ".join(w)))
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    pairs = [(a, b) for g in range(0, len(sets), 8) for a in range(g, g + 8) for b in range(a) if b >= g and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = collections.defaultdict(set)
    for r in simhash.near_groups(table(spark, texts)).collect():
        got[r.root].add(r.doc_id)
    want = collections.defaultdict(set)
    for d, top in grouped(pairs, range(len(texts))).items():
        want[top].add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def exact(texts, n=50):
    """Words of each document (ids are unique) in runs of n that an earlier one has."""
    first, out = {}, {}
    for d, t in sorted(texts):
        w, new, hit = [x.lower() for x in t.split()], [], set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in first:
                hit.update(range(i, i + n))
            else:
                new.append(g)
        first.update(dict.fromkeys(new, d))
        out[d] = hit
    return out


def planted():
    rng = random.Random(11)
    shared_one, fuzzy = prose(rng, 60), prose(rng, 120)
    texts = [(i, prose(rng, 200)) for i in range(30)]
    for i in (3, 7, 20, 29):
        texts[i] = (i, texts[i][1][:50] + shared_one + texts[i][1][50:])
    for i in (5, 9):
        w = list(fuzzy)
        if i == 9:
            w[30], w[70] = "other", "words"
            del w[100]
        texts[i] = (i, texts[i][1][:10] + w + texts[i][1][10:])
    short = prose(rng, 30)
    for i in (1, 2):
        texts[i] = (i, short + texts[i][1])
    texts.append((40, list(texts[0][1])))
    return [(i, " ".join(w)) for i, w in texts]


def test_passages(spark):
    texts = planted()
    rows = passages.op2_passages(with_clashes(table(spark, texts))).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50 and r.source_id < r.doc_id
    want = exact(texts)
    assert {d for d in got} == {7, 20, 29, 9, 40}
    for d, words in want.items():
        assert words <= got[d]
    assert abs(len(got[9]) - 119) <= 3  # two words changed, one gone
    assert {r.source_id for r in rows if r.doc_id == 40} == {0}


def test_passages_of_repeated_words_and_lines(spark):
    rng = random.Random(12)
    line = prose(rng, 12)
    stretches = [["word"] * 140, ["one", "two"] * 45, line * 8, ["word"] * 60, prose(rng, 50)]
    texts = [(k, prose(rng, 40) + x + prose(rng, 40)) for k, x in enumerate(stretches)]
    texts += [(10, prose(rng, 30) + ["word"] * 300), (11, ["two", "one"] * 30), (12, line[5:] + line * 6 + prose(rng, 9)), (13, list(texts[0][1])), (14, stretches[4] + prose(rng, 70))]
    texts = [(d, " ".join(w)) for d, w in texts]
    got = collections.defaultdict(set)
    for r in passages.op2_passages(table(spark, texts)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert set(got) == {3, 10, 11, 12, 13, 14}
    for d, words in exact(texts).items():
        assert words <= got[d], d


def test_passages_with_changed_words():
    rng = np.random.default_rng(6)
    text = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def found(length, every):
        one = text(length)
        two = one.copy()
        at = np.arange(rng.integers(every), length, every)
        two[at] = text(len(at))
        one, two = (np.concatenate([text(60), x, text(60)]) for x in (one, two))
        (h, s), (g, p) = passages.seeds(one), passages.seeds(two)
        pos, source = (np.array(x) for x in zip(*[(b, a) for x, a in zip(h, s, strict=True) for y, b in zip(g, p, strict=True) if x == y], strict=True)) if np.isin(g, h).any() else ([], [])
        made = passages.chains(pos, source) if len(pos) else []
        stretches = {(a, e, 0, c) for x in made for a, e, c in passages.aligned(two.tolist(), one.tolist(), sorted(pos[x].tolist()), sorted(source[x].tolist()))}
        return bool(passages.joined(sorted(stretches)))

    for length in (60, 80, 120):
        for every, least in ((15, 97), (12, 94)):
            assert sum(found(length, every) for _ in range(100)) >= least, (length, every)
    run = text(13)  # any 13 equal words share a seed
    one, two = (np.concatenate([text(30), run, text(30)]) for _ in range(2))
    assert np.isin(passages.seeds(one)[0], passages.seeds(two)[0]).any()


def test_word_hashes_keep_nothing():
    text = " ".join(f"W{k}" for k in range(200_000)).encode()
    assert passages.word_hashes(b"A b\x0ba").tolist() == [xxhash.xxh64_intdigest(w) for w in (b"a", b"b", b"a")]
    tracemalloc.start()
    try:
        assert len(passages.word_hashes(text)) == 200_000
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()


def test_passages_are_cut(spark):
    texts = planted()
    left = {r.doc_id: r for r in passages.stage(with_clashes(table(spark, texts))).collect()}
    assert 40 not in left and len(left) == 30  # a whole copy has no word left
    before = dict(texts)
    for d, r in left.items():
        assert r.n_chars == len(r.text) and r.kept == 7
        if d not in (7, 20, 29, 9):
            assert r.text == before[d]
        else:
            assert 195 <= len(r.text.split()) <= 203
    odd = passages.stage(table(spark, TEXTS))
    assert collections.Counter((r.doc_id, r.text) for r in odd.collect()) == collections.Counter(TEXTS)
    assert passages.op2_passages(table(spark, TEXTS)).collect() == []
    assert passages.op2_passages(table(spark).limit(0)).collect() == []


def test_chains_are_best():
    rng = random.Random(2)

    def best(anchors):
        score = {}
        for p, s in sorted(anchors):
            score[p, s] = passages.GRAM + max([0.0, *(v - passages.GAP_COST * (p - a + s - b) for (a, b), v in score.items() if a < p and b < s)])
        return max(score.values())

    for _ in range(40):
        anchors = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 25))})
        made = passages.chains(np.array([a for a, _ in anchors]), np.array([b for _, b in anchors]))
        assert sorted(i for c in made for i in c) == list(range(len(anchors)))
        value = []
        for c in made:
            at = [anchors[i] for i in c]
            assert all(a < b and x < y for (a, x), (b, y) in zip(at, at[1:], strict=False))
            value.append(sum(passages.GRAM - (passages.GAP_COST * (b[0] - a[0] + b[1] - a[1]) if a else 0) for a, b in zip([None, *at], at, strict=False)))
        if all(b - a <= passages.GAP + passages.GRAM for c in made for a, b in zip([anchors[i][0] for i in c], [anchors[i][0] for i in c][1:], strict=False)):
            assert max(value) <= best(anchors) + 1e-9


def slow_winnow(t, k=winnow.GRAM, w=winnow.WINDOW):
    if not t:
        return []
    k = min(k, len(t))
    h = winnow.hashes(winnow.points(t), k).tolist()
    w, out = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


def test_winnowing_of_long_texts(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in (0, 5, 42, 43, 44, 99, 100, 101, 158, 159, 700)] + ["ab" * 300]
    plain = [winnow.fingerprint(winnow.points(t)).tolist() for t in texts]
    monkeypatch.setattr(winnow, "STRETCH", 100)
    assert [winnow.fingerprint(winnow.points(t)).tolist() for t in texts] == plain
    words = np.array([5, (1 << 24) - 3, 20, 30, (1 << 24) - 1, 8], np.uint64)
    assert winnow.places(words).tolist() == [5, (1 << 24) - 3, (1 << 24) + 20, (1 << 24) + 30, (1 << 25) - 1, (1 << 25) + 8]


def test_winnowing():
    rng = random.Random(4)
    split = lambda words: [(int(x) >> 24, int(x) & 0xFFFFFF) for x in words]
    for n in (0, 1, 5, 12, 13, 42, 43, 44, 300):
        t = "".join(rng.choice("ab é😀") for _ in range(n))
        assert split(winnow.fingerprint(winnow.points(t))) == slow_winnow(t)
    run = "".join(rng.choice("abcdefgh ") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = (winnow.fingerprint(winnow.points("".join(rng.choice("xyz") for _ in range(77)) + run + "".join(rng.choice("uvw") for _ in range(91)))) for _ in range(2))
    assert winnow.likeness(a, b) > 0


def test_winnow(spark):
    import hashlib

    for docs in (shared.documents(spark, DATA), with_clashes(table(spark))):
        signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
        rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])))
        want = collections.Counter()
        for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            one, two, three = (winnow.fingerprint(winnow.points(x)) for x in (t, e, n))
            want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), winnow.text_form(one), winnow.text_form(two), winnow.likeness(one, two), winnow.likeness(one, three))] += 1
        assert collections.Counter(tuple(r) for r in winnow.op8_winnow(docs).collect()) == want
    assert winnow.op8_winnow(table(spark).limit(0)).collect() == []
    assert winnow.op8_winnow(table(spark, [(1, "one and only")])).first().near_next == 1.0


def test_pipeline(spark):
    docs = shared.documents(spark, DATA)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = shared.written(stage(spark, kept, DATA))
        assert kept.columns == docs.columns and kept.count() <= before, name
    verdict = {r.doc_id: r.kept for r in quality.op7_quality(docs).collect()}
    assert all(verdict[r.doc_id] for r in kept.collect())
    out = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, DATA)
    assert out.count() == again.count()  # a second run takes nothing from the first one's result
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
