"""Operators of rootscope.llm against brute force, round trips and odd input."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from rootscope.llm import components, decontaminate, html_text, language, licenses, line_dedup, near_copies, packing, quality, simhash, substring_dedup, suffix_dedup
from rootscope.llm.shared import finished, joined

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
DOCS = "doc_id long, text string, keys string, th long"  # two columns whose names clash with the operators' own
rng = random.Random(5)
WORDS = ["the", "of", "and", "in", "to", "was", "Über", "naïve", "Straße", "x1", "a#b", "don't", "end."]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [sentence(n) for n in (120, 200, 60, 90)]
    lines = ["\n".join(sentence(8) for _ in range(12)) for _ in range(4)]
    rows = [base[0], base[0], base[0].replace("the", "THE", 1), base[1] + " tail", "lead " + base[1], base[2] + " " + base[3], base[3], None, "", " \n\t ", "word"]
    rows += [lines[0], lines[0] + "\nextra line here", "first\n" + lines[0], lines[1] + "\n" + lines[2], lines[2] + "\n" + lines[2], lines[3]]
    rows += ["ab" * 400, "ab" * 300 + "c", "same line of text\n" * 60, sentence(5000)]
    out = [(i, t, "k", i) for i, t in enumerate(rows)]
    return out + [(3, base[1] + " tail", "k", 1), (None, base[0], "k", 1), (4, "another text under a used id " + base[2], "k", 1)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def known(corpus):
    return [(d, (t or "").encode()) for d, t, *_ in corpus if d is not None]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_suffix_dedup_is_brute_force(docs, corpus):
    first = {}
    for d, t in sorted(known(corpus)):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    want = Counter()
    for d, t in known(corpus):
        spans = joined([(i, i + 50) for i in range(len(t) - 49) if first[t[i : i + 50]] < d])
        want[(d, *suffix_dedup.figures(t, spans))] += 1
    found = suffix_dedup.repeated_bytes(docs)
    got = rows_of(suffix_dedup.result(docs, found).filter("doc_id is not null"))
    assert got == want


def test_run_index_against_scan():
    r = random.Random(1)
    for alphabet in (b"ab", b"abcdef \0\xff"):
        for _ in range(40):
            base = bytes(r.choice(alphabet) for _ in range(160))
            plan = suffix_dedup.BytesPlan(10, 8)
            group = sorted({(base[a : a + r.randint(10, 60)], r.randint(0, 4)) for a in (r.randint(0, 100) for _ in range(6))}, key=lambda x: x[1])
            group = [x for x in dict(group).items() if len(x[0]) >= 10]
            group.sort(key=lambda x: x[1])
            least = {}
            for c, d in group:
                for i in range(len(c) - 9):
                    least[c[i : i + 10]] = min(least.get(c[i : i + 10], 9), d)
            for (c, d), spans in zip(group, plan.resolve([group])[0]):
                assert spans == joined([(i, i + 10) for i in range(len(c) - 9) if least[c[i : i + 10]] < d])


def test_matching_statistics_are_brute_force():
    r = random.Random(4)
    for alphabet in (b"ab", b"abcde\0\xff"):
        for _ in range(60):
            base = bytes(r.choice(alphabet) for _ in range(80))
            cut = lambda: base[(a := r.randint(0, 60)) : a + r.randint(1, 40)] + bytes(r.choice(alphabet) for _ in range(r.randint(0, 5)))
            strings = [(cut(), r.randint(0, 2), r.random() < 0.5) for _ in range(12)]
            text = np.frombuffer(b"".join(x for x, *_ in strings), np.uint8)
            size = np.array([len(x) for x, *_ in strings], np.int64)
            off, tags = np.cumsum(size) - size, np.array([t for _, t, _ in strings], np.int64)
            held = np.array([h for *_, h in strings])
            if held.all() or not held.any():
                continue
            for w in (1, 3, 9):
                index = suffix_dedup.RunIndex(text, off[held], size[held], tags[held], w)
                assert int(index.length.sum()) == int((size[held] + 1).sum())
                got = sorted(index.matching_statistics(text, off[~held], size[~held], tags[~held]).tolist())
                want = []
                for (x, t, h), a in zip(strings, off.tolist()):
                    own = [y for y, u, k in strings if k and u == t]
                    want += [a + i for i in range(len(x) - w + 1) if not h and any(x[i : i + w] in y for y in own)]
                assert got == sorted(want)


def brute_bytes(rows, w=50):
    first, out = {}, {}
    for d, t in sorted(rows):
        for i in range(len(t) - w + 1):
            first.setdefault(t[i : i + w], d)
    for d, t in rows:
        out[d] = joined([(i, i + w) for i in range(len(t) - w + 1) if first[t[i : i + w]] < d])
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 100])
def test_keys_with_many_contents(spark, hot):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(d, some(r.randint(0, 30)) + passage + some(r.randint(0, 30))) for d in range(700)]  # one passage in 700 settings
    rows += [(700 + d, rows[d][1][5:]) for d in range(60)] + [(800 + d, "ab" * (40 + d % 3)) for d in range(120)]
    rows += [(1000, "a" * 70_000), (1001, "b" + "a" * 69_000)]  # longer than what is streamed as one
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_bytes([(d, t.encode()) for d, t in rows])
    out = suffix_dedup.result(df, suffix_dedup.repeated_bytes(df, hot=hot)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in out} == {d: suffix_dedup.figures(t.encode(), want[d]) for d, t in rows}


def test_many_contents_are_matched_in_little_memory():
    r = random.Random(4)
    groups = []
    for g in range(48):  # 4 MB: of each two contents, the second has half of the first
        a = r.randbytes(42_000)
        groups.append([(a, 2 * g), (a[:21_000] + bytes([a[21_000] ^ 1]) + r.randbytes(20_999), 2 * g + 1)])
    plan = suffix_dedup.BytesPlan()
    plan.resolve(groups[:1])
    tracemalloc.start()
    got = plan.resolve(groups)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[[], [(0, 21_000)]]] * 48
    assert most < 200 << 20


def brute_words(corpus):
    first, out = {}, {}
    for d, t in sorted(known(corpus)):
        w = t.split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in known(corpus):
        w = t.split()
        out[d, t] = joined([(i, i + 50) for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d])
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup_is_brute_force(docs, corpus, batches):
    spans = brute_words(corpus)
    want = Counter((d, *substring_dedup.figures(t, spans[d, t])) for d, t in known(corpus))
    out = finished(docs, substring_dedup.repeated_words(docs, batches), substring_dedup.figures, "n_words long, n_removed long, kept_sha256 string")
    assert rows_of(out.filter("doc_id is not null")) == want


def test_earlier_batches_keep_every_holder_of_a_key(spark, tmp_path):
    plan, r = substring_dedup.WordsPlan(), random.Random(3)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    old, new = [], []
    while len(new) < 12:  # variants that share a window's key, but no window; then a window of each
        gram = some(20)
        three = [" ".join(some(40) + gram + some(40)) for _ in range(3)]
        u = plan.units([x.encode() for x in three])
        held = {}
        for d, s, k in zip(u.doc.tolist(), u.start.tolist(), u.key.tolist()):
            held.setdefault(k, {})[d] = s
        starts = next((x for x in held.values() if len(x) == 3), None)
        if starts:
            old += three
            new += [" ".join(x.split()[starts[i] : starts[i] + 50]) for i, x in enumerate(three)]
    df = spark.createDataFrame(list(enumerate(old + new)), "doc_id long, text string")
    edges = (0, 6, len(old), len(old + new))
    for fan_in in (2, 4):
        index = substring_dedup.FingerprintIndex(spark, str(tmp_path / str(fan_in)), fan_in=fan_in)
        first, second, last = (index.ingest(df.filter(F.col("doc_id").between(a, b - 1)).coalesce(1)) for a, b in zip(edges, edges[1:]))
        assert first.count() == second.count() == 0
        assert sorted(x.doc_id for x in last.collect()) == list(range(len(old), len(old + new)))


def test_index_compacts_opens_again_and_refuses_old_ids(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "index")
    marks, levels = None, []
    for a, b in ((0, 2), (3, 5), (6, 9), (10, 99)):
        index = substring_dedup.FingerprintIndex(spark, path)  # opened again for each batch
        m = index.ingest(docs.filter(F.col("doc_id").between(a, b)))
        marks = m if marks is None else marks.union(m)
        levels.append([r["level"] for r in index.runs])
    assert levels == [[0], [1], [1, 0], [2]]
    spans = brute_words(corpus)
    got = {r.doc_id for r in marks.collect()}
    assert got == {d for (d, _), s in spans.items() if s}
    with pytest.raises(ValueError):
        index.ingest(docs.filter("doc_id = 5"))
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path, window=40)
    assert len(substring_dedup.FingerprintIndex(spark, path).runs) == 1
    assert index.ingest(docs.filter("doc_id > 1000")).count() == 0  # an empty batch


def test_line_dedup_is_brute_force(docs, corpus):
    seen, want = {}, Counter()
    order = sorted(range(len(corpus)), key=lambda i: (corpus[i][0] is None, corpus[i][0] or 0))
    texts = {}
    for i in order:
        d, t, *_ = corpus[i]
        if d is None or t is None:
            texts[i] = t
            continue
        lines, keep = t.encode().split(b"\n"), []
        for a, b in line_dedup.chunks(lines):
            c = b"\n".join(lines[a:b])
            ok = b - a >= 2 and sum(bool(x.strip()) for x in lines[a:b]) >= 2
            if ok and seen.setdefault(c, (d, t, a)) != (d, t, a):
                continue
            keep += lines[a:b]
        texts[i] = b"\n".join(keep).decode()
    for i, (d, _, k, th) in enumerate(corpus):
        want[(d, texts[i], k, th)] += 1
    out = line_dedup.remove_lines(docs)
    assert out.columns == docs.columns and rows_of(out) == want


def brute_lines(rows):
    """Lines left by doc_id: what stands in a window of two lines with words that stands earlier goes."""
    first, out = {}, {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(at, at[1:]):
            was = first.setdefault(tuple(lines[a : b + 1]), (d, a))
            if was != (d, a):
                gone |= set(range(max(a, was[1] + b + 1 - a) if was[0] == d else a, b + 1))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_windows_are_brute_force(spark):
    r = random.Random(8)
    some = lambda n: [r.choice(["", " ", *(f"line {r.randrange(10**6)}" for _ in range(9))]) for _ in range(n)]
    passages = [[f"passage {i} line {k}" for k in range(2 + i % 5)] for i in range(8)]
    rows = []
    for d in range(60):
        parts = [some(r.randint(0, 6)), r.choice(passages), some(r.randint(0, 4)), r.choice(passages)[r.randint(0, 1) :]]
        rows.append((d, "\n".join(x for p in parts for x in p)))
    rows += [(100 + d, t) for d, t in rows[:20]]  # exact copies
    rows += [(200, "same\n" * 9 + "end"), (201, "a\nb\n\na\nb\na\nb"), (202, "end\nsame\nsame\nsame"), (203, ""), (204, "one line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.text for x in line_dedup.remove_lines(df, whole=True).collect()}
    assert got == brute_lines(rows)
    assert all(len([x for x in got[100 + d].split("\n") if x.strip()]) == 0 for d in range(20))
    cols = "n_lines long, n_removed long, n_runs long, kept_sha256 string"
    out = finished(df, line_dedup.repeated_chunks(df, whole=True), line_dedup.figures, cols).collect()
    assert {x.doc_id: x.kept_sha256 for x in out} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in got.items()}
    assert line_dedup.remove_lines(df.limit(0), whole=True).count() == 0


def test_simhash_is_brute_force(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    fp = {(d, t): simhash.fingerprint((t or "").encode()) for d, t, *_ in corpus if d is not None}
    label = {d: d for d, _ in fp}
    changed = True
    while changed:
        changed = False
        for (a, _), x in fp.items():
            for (b, _), y in fp.items():
                if (x ^ y).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert all(r.component_id == (None if r.doc_id is None else label[r.doc_id]) for r in got)


def test_near_copies_are_brute_force_jaccard(spark, docs, corpus):
    r = random.Random(2)
    rows = [(i, t) for i, t, *_ in corpus if i is not None]
    for base in range(12):
        words = [f"v{r.randrange(5000)}" for _ in range(r.randint(60, 400))]
        for copy in range(5):
            own = list(words)
            for at in r.sample(range(len(own)), max(1, len(own) * copy // 90)):
                own[at] = "Other"
            rows.append((100 + 5 * base + copy, " ".join(own)))
    sets = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = {d: d for d, _ in rows}
    changed, far = True, 0
    while changed:
        changed = False
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows[:i]):
                if label[a] != label[b] and (a == b or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                    worst, best = max(label[a], label[b]), min(label[a], label[b])
                    label = {d: best if x == worst else x for d, x in label.items()}
                    changed = True
                    x, y = (simhash.fingerprint((rows[k][1] or "").encode()) for k in (i, j))
                    far += (x ^ y).bit_count() > 2
    assert far > 10
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = near_copies.near_copies(df).collect()
    assert all(x.component_id == (None if x.doc_id is None else label[x.doc_id]) for x in got) and len(got) == len(rows) + 1
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "").collect()
    assert Counter(x.doc_id for x in kept) == Counter([None, *(d for d, _ in rows if label[d] == d)])
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_near_copies_meet_by_simhash():
    r = np.random.default_rng(6)
    for n in (1, 4, 16, 17, 600):
        held = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        bits = np.unpackbits(near_copies.fingerprint(held).view(np.uint8), bitorder="little")
        ones = np.zeros(len(bits), int)
        for x in held:
            h = near_copies.mixed((x ^ near_copies._SEEDS[0, : len(bits) // 64]) * near_copies._SEEDS[1, : len(bits) // 64])
            ones += np.unpackbits(h.view(np.uint8), bitorder="little")
        assert len(bits) == 64 * near_copies.WORDS * (1 if n > near_copies.SMALL else 2) and (bits == (2 * ones > n)).all()
    for common, more in ((4, (0, 1)), (8, (1, 1)), (20, (5, 0)), (80, (10, 10)), (800, (100, 100))):  # similarity 0.8
        for _ in range(40):
            x = r.integers(0, 1 << 63, common + sum(more), dtype=np.uint64)
            two = [near_copies.fingerprint(np.unique(y)) for y in (x[: common + more[0]], np.append(x[:common], x[common + more[0] :]))]
            short = min(map(len, two))
            (c, w), (d, v) = (near_copies.cells(f[None, :short].copy()) for f in two)
            assert ((c == d) & (np.bitwise_count(w ^ v) <= near_copies.RADIUS)).any()


def test_linked_cells_are_brute_force():
    r = np.random.default_rng(8)
    word = r.integers(0, 1 << 63, 12, dtype=np.uint64)[r.integers(0, 12, 300)]
    for _ in range(9):  # chains, too: up to nine steps of one bit in each word
        word ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
        word ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
    cell, fp = r.integers(0, 9, 300).astype("<u4"), r.permutation(300)
    label, changed = list(range(300)), True
    while changed:
        changed = False
        for i in range(300):
            for j in range(300):
                if cell[i] == cell[j] and int(word[i] ^ word[j]).bit_count() <= near_copies.RADIUS and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    want = [sorted(fp[i] for i in range(300) if label[i] == k) for k in set(label)]
    for joined_at in (1 << 18, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_copies, "JOINED", joined_at)
            got = [x.tolist() for x in near_copies.linked_cells(cell, word, fp)]
        assert sorted(got) == sorted(x for x in want if len(x) > 1)


def test_near_copies_send_each_set_once(spark, monkeypatch):
    r = random.Random(9)
    base, rows = [f"v{r.randrange(5000)}" for _ in range(200)], []
    for i in range(150):  # one group of near copies, on either side of similarity 0.8
        own = list(base)
        for at in r.sample(range(200), 1 + i % 4):
            own[at] = f"o{i}"
        rows.append((i, " ".join(own)))
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    both = [(a, b, len(np.intersect1d(sets[a], sets[b]))) for b in range(150) for a in range(b)]
    linked = [(a, b) for a, b, n in both if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    assert 0 < len(linked) < len(both)
    label, made, stored = _groups(range(150), linked), {}, near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name: made.setdefault(name, stored(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()} == label
    # However many cells a group shares, it has a row for each set, and links that span it.
    assert made["candidates"].count() == made["candidates"].select("fp").distinct().count() <= 150
    assert made["links"].count() < 150


def test_forests_span_the_links():
    r = np.random.default_rng(4)
    a, b = r.integers(-400, 400, (2, 500)) << 40
    want = _groups(np.concatenate([a, b]), list(zip(a.tolist(), b.tolist())))
    for joined_at in (1 << 18, 60, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_copies, "JOINED", joined_at)
            out = list(near_copies._forests(iter(zip(np.split(a, 50), np.split(b, 50)))))
            assert len(out) > 1 if joined_at == 0 else len(out[-1][0]) <= 800
        u, v = np.concatenate(out, axis=1)
        assert (v < u).all() and _groups(np.concatenate([a, b]), list(zip(u.tolist(), v.tolist()))) == want
    u, v = near_copies.forest(a, b)
    assert len(np.unique(u)) == len(u) and dict(zip(u.tolist(), v.tolist())) == {x: y for x, y in want.items() if x != y}


def test_both_words_keep_near_copies():
    r = np.random.default_rng(7)
    for common, more in ((4, (0, 1)), (8, (1, 1)), (20, (5, 0)), (80, (10, 10)), (800, (100, 100))):  # similarity 0.8
        for _ in range(40):
            x = r.integers(0, 1 << 63, common + sum(more), dtype=np.uint64)
            two = [near_copies.fingerprint(np.unique(y)) for y in (x[: common + more[0]], np.append(x[:common], x[common + more[0] :]))]
            prints = np.stack([f[: min(map(len, two))] for f in two])
            cell, word = near_copies.cells(prints)
            other = near_copies.compared(prints, near_copies.WORDS // 4)
            name = np.repeat([5, 3], cell.shape[1])
            found = list(near_copies.linked_cells(cell.ravel(), word.ravel(), name, other.ravel()))
            assert found and all(f.tolist() == [3, 5] for f in found)
    far = np.array([0, (1 << 21) - 1], np.uint64)  # alike in one word, 21 bits apart in the other
    alike = np.zeros(2, np.uint64)
    assert not list(near_copies.linked_cells(np.zeros(2, "<u4"), alike, np.arange(2), far))
    assert list(near_copies.linked_cells(np.zeros(2, "<u4"), alike, np.arange(2), far >> np.uint64(1)))


@pytest.mark.parametrize("distance", [3, 9])
def test_simhash_at_other_distances_is_brute_force(spark, distance):
    r = random.Random(6)
    rows = []
    for base in range(40):
        words = [f"v{r.randrange(5000)}" for _ in range(150)]
        rows.append((2 * base, " ".join(words)))
        for at in r.sample(range(150), distance // 3 + base % 4):
            words[at] = "other"
        rows.append((2 * base + 1, " ".join(words)))
    fp = [simhash.fingerprint(t.encode()) for _, t in rows]
    pairs = [(a, b) for b in range(len(fp)) for a in range(b) if (fp[a] ^ fp[b]).bit_count() <= distance]
    assert any((fp[a] ^ fp[b]).bit_count() == distance for a, b in pairs)
    label = _groups(range(len(fp)), pairs)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(df, distance=distance).collect()} == label


def test_fingerprint_by_definition():
    import xxhash

    text = "One two THREE four five one two three".encode()
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(b" ") == 0


def test_large_cells_lose_no_link():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(3), base ^ np.uint64(1 << 40)]))
    ends = lambda pairs: _groups(fp, pairs)
    assert ends(simhash.links(fp, 2, cell=5)) == ends(simhash.links(fp, 2))
    pairs = [(int(a), int(b)) for i, a in enumerate(fp) for b in fp[:i] if int(a ^ b).bit_count() <= 2]
    assert ends(pairs) == ends(simhash.links(fp, 2, cell=2))
    alike = np.array([sum(1 << int(k) for k in r.choice(64, 32, replace=False)) for _ in range(300)], np.uint64)
    assert all(int(x).bit_count() == 32 for x in simhash.turned(alike, 5))


def _groups(fp, pairs):
    label = {int(x): int(x) for x in fp}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_decontamination_is_brute_force(spark, docs, corpus):
    items = [("1", sentence(25)), ("2", corpus[5][1][:200]), ("2", "the of and"), ("3", None), ("10", ""), (None, corpus[0][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = lambda t: bytes(t or "", "utf8").translate(decontaminate.ALNUM).split()
    pats = {}
    for item, t in items:
        w = cut(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            pats.setdefault(tuple(w[i : i + n]), set()).add(item or "")
    for block in (1 << 20, 300):
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        assert len(got) == len(corpus)
        for r in got:
            w = cut(r.text)
            hit, found = set(), set()
            for n in {len(p) for p in pats}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in pats:
                        hit |= set(range(i, i + n))
                        found |= pats[tuple(w[i : i + n])]
            s = r["spans"]
            assert decontaminate.covered(list(zip(s[::2], s[1::2]))) == len(hit) and set(r["items"]) == found and r["n_words"] == len(w)
    kept = decontaminate.remove_contaminated(docs, bench.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(corpus)


def test_packing_round_trip(docs, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER, capacity=256, fan=2).collect()
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = Counter()
    for d, t, *_ in corpus:
        x = ids(t)
        for k, a in enumerate(range(0, len(x), 256)):
            want[(d, k, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in rows) // 256) + 2


@pytest.mark.parametrize("text", ["Hello 'tis don't WE'LL x²! “q”… <|endoftext|> é", "<|EndOfText|> İ. ǅ", "中文，字。12.5, ½. ;;; 'S.", "éa. Àb, \x85 z"])
def test_word_ids_are_the_tokenizers(text):
    w = packing.WordTokens(TOKENIZER)
    assert next(w.ids([text.encode()])) == np.array(w.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_quality_by_definition(docs, corpus):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_figures(docs, ["doc_id"]).collect()}
    want = set()
    for d, t, *_ in corpus:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n3 = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i in range(len(w) - 2) if n3[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        want.add((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert got == want


def test_compression_bands():
    z = zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600))
    assert quality.judge(prose.encode(), z)[6]
    assert not quality.judge((prose[:40] * 60).encode(), z)[6] and not quality.judge(hashlib.sha512(b"x").hexdigest().encode() * 40, z)[6]


def test_last_and_short_chunks_are_judged():
    z, r = zstandard.ZstdCompressor(level=3), random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))[:n].encode()
    noise = lambda n: bytes(r.randrange(33, 256) for _ in range(n))
    n_chunks, bad = quality.judge(prose(900), z)[8:10]
    assert (n_chunks, bad) == (1, 0)
    assert quality.judge(prose(2048) + noise(900), z)[8:10] == (3, 1)  # the tail is noise
    assert quality.judge(prose(8192) + noise(3 * 1024), z)[8:10] == (11, 3)
    mixed = prose(1100) + noise(1972)
    assert quality.in_band(len(mixed), 1.4) and quality.judge(mixed, z)[8:10] == (3, 2) and not quality.judge(mixed, z)[6]
    assert quality.judge(prose(4096) + (b"again and " * 400)[:3000], z, 4096)[8:10] == (2, 1)
    assert quality.judge(b"", z)[8:10] == (0, 0)


def test_licences(spark):
    a = licenses.automaton()
    scan = lambda t: licenses.scan(t.encode(), a)
    n, base, first, last, base_labels, labels, score, _ = scan("x CC-BY 4.0 and cc by cc by. All Rights Reserved")
    assert (base, first, last, base_labels) == (4, 1, 10, "cc-by,reserved") and score == 0.0 and n == 13
    assert scan("SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0")[5] == "apache-2.0,gpl-2.0-only,mit"
    assert licenses.evaluate(licenses.tokens(b" GPL-3.0 OR MIT", 0))[1] == 0.9 and licenses.evaluate(licenses.tokens(b" GPL-3.0 AND MIT", 0))[1] == 0.5
    assert licenses.evaluate(["(", "mit"])[1] is None and scan("") [:6] == (0, 0, None, None, "", "")


def test_language_spans(spark):
    en = ["the house and the garden of the old man was there with this thing"] * 5
    de = ["das haus und der garten von dem alten mann war nicht hier mit ihnen"] * 5
    ru = ["дом и сад старого человека были там"] * 3
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([*((t, "en") for t in en), *((t, "de") for t in de), *((t, "ru") for t in ru), ("x", None), (None, "en")])], "doc_id long, text string, lang string")
    m = language.fit(df, "doc_id")
    assert m.langs == ["de", "en", "ru"]
    mixed = f"{en[0]} {en[0]}. {de[0]} {de[0]}"
    lang, _, spans = m.label(mixed)
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[1]["start"] - mixed.index("das")) < 12
    assert m.label("где он был")[0] == "ru" and m.label(None) == ("und", 0.0, []) and m.label("12 !?")[0] == "und"
    out = language.identify(df, m, ["doc_id"]).collect()
    assert len(out) == 15 and all(0 <= r.score <= 1 for r in out)
    nothing = language.fit(df.filter("lang is null"), "doc_id")
    assert nothing.label("the")[0] == "und"


def test_viterbi_shortcut_is_exact():
    m = language.Model(["a", "b", "c"], np.ones((3, language.BUCKETS)), np.ones((3, 4)))
    r = np.random.default_rng(0)
    for _ in range(300):
        s = r.normal(0, 3, (int(r.integers(1, 25)), 3))
        value = lambda p: s[np.arange(len(s)), p].sum() - 6 * (np.diff(p) != 0).sum()
        assert value(m.path(s, 6.0)) == pytest.approx(value(language.viterbi(s, 6.0)))


def test_html(spark):
    w = {"?": -0.25, "-": -0.05, "p": -0.05, "/p": -0.05, "article": -30.0, "/article": -30.0}
    page = (
        "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><a>menu</a></nav><article><h1>T &amp; U</h1><p>one\n two<b>three</b><br>four"
        "<p>five &#233;&nbsp;six<aside>no</aside><div class='comments'><p>nice</p></div><!-- c --><p>seven</article><footer>f</footer>"
    )
    assert html_text.main_text(page, w) == "T & U\none twothree four\nfive é six\nseven"
    assert html_text.main_text(None, w) == "" and html_text.main_text("<div><p", w) == ""
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string")
    got = html_text.extract(df, html_text.fit(df, "page_id"), ["page_id", "url"]).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and len(got) == 3


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = language.op1(spark, sf).collect()
    known = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(out) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and known[r.doc_id].lang is not None and any(c.isalpha() for c in known[r.doc_id].text or "")]
    assert len(held) > 100 and sum(r.lang_pred == known[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in known[r.doc_id].text or "")) for r in out)


def test_marks_are_no_words(spark):
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(["de", "en"] * 3)], "doc_id long, text string, lang string")
    m = language.fit(df, "doc_id")
    for text in ("\u0301 \u0308", "\u0301", "12 \u0301!"):
        assert m.label(text) == ("und", 0.0, []) and next(iter(language.labelled_batch(m, [text], 12.0))) == ("und", 0.0, [])
    assert m.label("a\u0301 \u0301")[0] != "und"


class Article(HTMLParser):
    """Blocks of text in the article, by the standard library's parser, without elements that are no content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.held = [], [], []

    def inside(self):
        return any(n == "article" for n, _ in self.open) and not any(d for _, d in self.open)

    def cut(self, name):
        if name not in html_text.INLINE:
            self.blocks.append("".join(self.held))
            self.held = []

    def handle_starttag(self, name, attrs):
        text = "".join(f' {k}="{v or ""}"' for k, v in attrs)
        within = sum(n in ("article", "main") for n, _ in self.open)
        self.held += [" "] if name == "br" else []
        if name != "br":
            self.cut(name)
        if name not in html_text.VOID:
            self.open.append((name, html_text.marked(name, text, within)))

    def handle_endtag(self, name):
        self.cut(name)
        at = max((i for i, (n, _) in enumerate(self.open) if n == name), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.inside():
            self.held.append(data)


def test_html_is_the_article(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in html_text.op2(spark, sf).collect()}
    same = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        if (r.html or "").count("<article") != 1:
            continue
        p = Article()
        p.feed(r.html)
        p.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in [*p.blocks, "".join(p.held)]) if x)
        total += 1
        same += want == got[r.page_id].text and got[r.page_id].n_chars == len(want)
    assert total > 20 and same >= 0.98 * total


@pytest.mark.parametrize(
    "page", ["<a " * 350_000 + '"', '<a ">" ' * 150_000 + "'", "<b>" * 150_000 + "</i>" * 150_000, "<ul>" + "<b>" * 100_000 + "<li/>" * 100_000, "<!--" * 250_000, "<" * 1_000_000]
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page, {"?": -0.25, "-": -0.05})
    assert time.process_time() - began < 30


def test_licences_are_brute_force():
    a, r = licenses.automaton(), random.Random(3)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "GNU", "x1", "é", "mit"]
    phrases = {p: tuple(p.split()) for p in licenses.BASE}
    for n in (0, 1, 5, 40, 400):
        for _ in range(30):
            text = "".join(r.choice(words) + r.choice([" ", "-", "\n", "_", ", "]) for _ in range(n))
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            at = [(i, p) for p, own in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(own)]) == own]
            got = licenses.scan(text.encode(), a)
            starts = [i for i, _ in at]
            base = ",".join(sorted({licenses.BASE[p] for _, p in at}))
            assert got[:5] == (len(w), len(at), min(starts, default=None), max(starts, default=None), base)
            assert set(base.split(",")) <= {*got[5].split(","), ""} and 0 <= got[6] <= 1
    began = time.process_time()
    assert licenses.scan(b"cc by " * 100_000, a)[:4] == (200_000, 100_000, 0, 199_998)
    assert len(licenses.scan(b"SPDX-License-Identifier: MIT OR GPL-2.0\n" * 20_000, a)[7]) == 20_000
    assert time.process_time() - began < 30


def test_clashing_columns(spark):
    names = ["doc_id", "text", "spans", "items", "n_words", "raw", "page", "m_id", "keys", "th"]
    df = spark.createDataFrame([(i, f"one two three {i} four\nfive six\nseven", *([str(i)] * 8)) for i in range(3)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    bench = spark.createDataFrame([("1", "six seven")], "item_id string, text string")
    found = decontaminate.contamination(df, bench)
    assert found.columns[: len(names)] == names and [r[-2] for r in found.collect()] == [[6, 8]] * 3 and decontaminate.remove_contaminated(df, bench).count() == 0
    assert line_dedup.remove_lines(df, whole=True).columns == names
    assert html_text.extract(df.withColumn("html", F.col("text")), {"?": -0.25}, ["page", "raw"], "html").columns == ["page", "raw", "text", "n_chars"]
    assert language.identify(df, language.fit(df.withColumn("lang", F.lit("en")), "doc_id"), ["raw", "th"]).count() == 3
    assert licenses.license_scan(df, ["raw", "th"]).columns[:2] == ["raw", "th"]
    assert simhash.one_of_each(df).columns == names and near_copies.first_copies(df).columns == names


def test_empty_tables(spark, empty):
    assert suffix_dedup.result(empty, suffix_dedup.repeated_bytes(empty)).count() == 0
    assert finished(empty, substring_dedup.repeated_words(empty), substring_dedup.figures, "n_words long, n_removed long, kept_sha256 string").count() == 0
    assert line_dedup.remove_lines(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    assert packing.pack(empty, TOKENIZER).count() == 0 and quality.quality_figures(empty, ["doc_id"]).count() == 0 and licenses.license_scan(empty, ["doc_id"]).count() == 0
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(empty, bench).count() == 0


def brute_quality(texts):
    """Texts that the base rules and bands fitted on all texts keep."""
    z = zstandard.ZstdCompressor(level=3)
    ratio = lambda x: len(x) / len(z.compress(x))
    cut = lambda x: [x[i : i + 1024] for i in range(0, len(x), 1024)]
    cls = lambda x: int(4 * np.log2(len(x)))
    held = {}
    for x in texts:
        if x:
            held.setdefault((0, cls(x)), []).append(ratio(x))
            for c in cut(x):
                held.setdefault((1, cls(c)), []).append(ratio(c))

    def ok(kind, x):
        v = np.sort(np.floor(np.minimum(50, np.array(held[kind, cls(x)])) * 200))
        if len(v) < 100:
            return quality.in_band(len(x), ratio(x))
        a, m, b = (v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.5, 0.75))
        low, high = (m + 0.5 - 5 * max(1, m - a) / 0.6745) / 200, (m + 0.5 + 5 * max(1, b - m) / 0.6745) / 200
        return low <= ratio(x) <= high

    def keep(x):
        w = x.split()
        n3 = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i in range(len(w) - 2) if n3[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(w) < 50 or 100 * len(rep) > 50 * len(w):
            return False
        return ok(0, x) and 2 * sum(not ok(1, c) for c in cut(x)) <= len(cut(x))

    return [keep(x) for x in texts]


def brute_near(rows):
    """Least doc_id of each component of five-word shingle sets alike to 0.8."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in t.split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return _groups([d for d, _ in rows], pairs) if pairs else {d: d for d, _ in rows}


def test_bands_reject_repetition_and_noise(spark):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))
    clean = [prose(r.randint(150, 300)) for _ in range(1500)]
    junk = [" ".join(f"{w}{'###' if i % 2 else '%%%'}" for i, w in enumerate(prose(200).split())) for _ in range(20)]
    noise = [" ".join("".join(chr(r.randrange(33, 127)) for _ in range(6)) for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*clean, *junk, *noise])]
    out = {x.doc_id: x for x in quality.quality_figures(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert sum(out[i].kept for i in range(1500)) >= 1495
    assert not any(out[i].kept for i in range(1500, len(rows))) and all(out[i].ratio_failed or out[i].chunks_failed for i in range(1500, len(rows)))
    assert [out[i].kept for i, _ in rows] == brute_quality([t.encode() for _, t in rows])
    assert quality.fit_bands(spark.createDataFrame(rows[:0], "doc_id long, text string")) == {}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: spark.createDataFrame(stages[name](spark, df, sf).collect(), docs.schema)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = step("quality_rules", docs)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert texts(good).keys() == {d for (d, _), k in zip(rows, brute_quality([t for _, t in rows])) if k}

    lined = step("line_dedup", good)
    assert texts(lined) == {d: t for d, t in brute_lines(list(texts(good).items())).items() if t.split()}
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    apart = step("simhash_near_dedup", lined)
    roots = brute_near(list(texts(lined).items()))
    assert texts(apart) == {d: t for d, t in texts(lined).items() if roots[d] == d}

    clean = step("benchmark_decontamination", apart)
    cut = lambda t: (t or "").encode().translate(decontaminate.ALNUM).split()
    bad = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = cut(r.text)
        n = min(10, len(w))
        bad |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in bad}
    hit = {d for d, t in texts(apart).items() if any(tuple(cut(t)[i : i + n]) in bad for n in sizes for i in range(len(cut(t)) - n + 1))}
    assert texts(clean) == {d: t for d, t in texts(apart).items() if d not in hit}

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    pieces = stages["best_fit_packing"](spark, clean, sf).collect()
    want = Counter()
    for d, t in texts(clean).items():
        x = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(x), 2048)):
            want[d, k, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    # No two sequences could be one, and there are hardly more than the tokens need.
    least = -(-sum(filled.values()) // 2048)
    assert max(filled.values()) <= 2048 and sum(sorted(filled.values())[:2]) > 2048 and len(filled) <= 1.02 * least + 2, (len(filled), least)
