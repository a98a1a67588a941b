"""The operators on documents against brute force, and on odd input."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tabulare.llm import bpe, common, fingerprints, mixing, pii, quality, simhash, suffix_dedup
from tabulare.session import local_fs_path

from .conftest import LONG

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------- 1 mixing
def _targets(sizes):
    """Targets by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= set(over)


def _check_mix(data, got):
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in data}
    sizes = Counter()
    for i, t, s in data:
        sizes[s] += len(WORDS.findall(t or ""))
    want = _targets(sizes)
    taken = Counter()
    for r, s in got:
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    return size, want, taken


def test_mix_meets_every_target_exactly(docs, rows):
    source = {r.doc_id: r.source for r in rows}
    got = mixing.mix(docs).collect()
    size, want, taken = _check_mix([(r.doc_id, r.text, r.source) for r in rows], [(r, source[r.doc_id]) for r in got])
    assert {r.doc_id: r.size for r in got} == size
    for s, t in want.items():
        assert taken[s] == int(t)                            # the budget, to the word
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_mix_small_sources_stop_at_three_times(spark):
    data = [(i, "w " * n, s, 0) for i, (n, s) in enumerate([(2, "a"), (500, "b"), (300, "c"), (1, None), (0, "z")])]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert got[0].target == 6 and got[0].taken == 6          # weight 5, but stopped at 3 times 2
    assert got[3].target <= 3 and got[4].taken == 0
    _check_mix([(d[0], d[1], d[2]) for d in data], [(got[d[0]], d[2]) for d in data])


def test_mix_cuts_one_row_of_a_source(spark):
    """A third of a source's rows under NULL, one id, or wholly equal: the budget to the word, one row cut."""
    for doc_id, equal in ((None, False), (1, False), (1, True)):
        data = [(doc_id, "w w w w equal" if equal else f"w w w w {i}", "b", 0) for i in range(400)] + [(-1, "w " * 700, "a", 0)]
        df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long").repartition(5)
        got = mixing.mix(df).collect()
        taken = [r.taken for r in got if r.doc_id != -1]
        target = int(next(r.target for r in got if r.doc_id != -1))
        assert 0 < target % 5 and sum(taken) == target and sum(0 < x % 5 for x in taken) == 1
        words = [len(WORDS.findall(r.text)) for r in mixing.mix_documents(df).collect() if r.source == "b"]
        assert sum(words) == target and sum(n != 5 for n in words) == 1


def test_mix_odd_input(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    taken = defaultdict(set)
    for r in got:
        taken[r.doc_id].add(r.taken)
    assert len(taken[1]) == 1                                # repeated rows are treated alike
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixing.mix_documents(empty).count() == 0
    kept = mixed.collect()
    assert {2, 3, 4} <= {r.doc_id for r in kept}             # without words: in no budget
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all((r.text or "") == (texts[r.doc_id] or "") or (texts[r.doc_id] or "").startswith(r.text) for r in kept if r.doc_id is not None)


def test_first_words_keeps_the_text_as_written(spark):
    df = spark.createDataFrame([(" a  b\tc d ", 2), ("a b", 1), ("x\ny", 2)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a  b", "a", "x\ny"]


# ---------------------------------------------------------------- 3 fingerprints
def _shingles(text, k=5):
    w = WORDS.findall(text or "")
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints_against_shingle_sets(docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    down = rows[::-1]
    off = []
    for r, nxt in zip(down, down[1:] + down[:1]):
        cut = len(r.text) // 3
        edited = r.text[:len(r.text) - cut] + nxt.text[:cut]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = _shingles(r.text), _shingles(edited), _shingles(nxt.text)
        if min(len(a), len(b)) >= 200:
            off.append(abs(len(a & b) / min(len(a), len(b)) - g.near_edited))
        assert 0 <= g.near_next <= 1 and (a & c or g.near_next == 0)
    assert np.mean(off) < 0.04
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_suffix_anchors_of_one_string_stay_few_as_batches_grow():
    """Four surroundings of one passage in every batch: what a task sends of its anchors does not grow with the batches."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh"), 150))
    noise = lambda: "".join(rng.choice(list("ijklmnop"), 120))

    def batches(n):
        for b in range(n):
            yield pa.RecordBatch.from_arrays([pa.array([4 * b + i for i in range(4)], pa.int64()),
                                              pa.array([noise() + passage + noise() for _ in range(4)])], names=["doc_id", "text"])
    most = []
    for n in (10, 40, 160):
        sent = Counter()
        for out in suffix_dedup._scan(batches(n)):
            rows = out.to_pydict()
            sent.update(h for k, h in zip(rows["kind"], rows["h"]) if k == suffix_dedup.ANCHOR)
        most.append(max(sent.values()))
    assert max(most) <= suffix_dedup.HEAVY + 4


def test_fingerprints_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"),
        fingerprints.sketch(F.concat("a", F.lit(" "), "b")).alias("ab"))
    r = df.select("*", fingerprints.likeness(F.col("a"), F.col("ab")).alias("in_ab"), fingerprints.likeness(F.col("a"), F.col("b")).alias("none")).first()
    assert (set(r.a) | set(r.b)) <= set(r.ab) and r.in_ab == 1 and r.none == 0
    assert 60 < len(r.a) < 140                               # a quarter of 396


def test_fingerprints_ranges_hold_their_share_with_a_hot_id(spark, monkeypatch):
    import hashlib

    import xxhash

    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 100)
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text {i} of some words and {i * i} more") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    d, _ = fingerprints.in_ranges(df)
    sizes = [r["count"] for r in d.where("NOT guest").groupBy("range").count().collect()]
    guests = d.where("guest").groupBy("range").count().collect()
    assert sum(sizes) == 3000 and max(sizes) < 250 and all(r["count"] == 1 for r in guests) and len(guests) == len(sizes)
    tie = lambda t: (lambda x: x - (x >> 63 << 64))(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie(r[1])), reverse=True)
    want = set()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        want.add((i, hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert {(r.doc_id, r.edited_sha256) for r in fingerprints.fingerprints(df).collect()} == want


def test_fingerprints_odd_input(odd, empty):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == odd.count() and fingerprints.fingerprints(empty).count() == 0
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    one = fingerprints.fingerprints(odd.where("doc_id = 7")).first()
    assert one.near_next == 1 and len(one.fingerprint) >= 16


# ---------------------------------------------------------------- 4 repeated substrings
def _repeats(texts):
    """Brute force: every 100-byte window, earliest first."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeats_against_every_window(docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, spans=False, kept=False, digest=True).collect()}
    want = _repeats([r.text for r in rows])
    assert [got[r.doc_id] for r in rows] == want and sum(w[1] for w in want) > 0


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY, 0, 2])
def test_repeats_shared_passages_and_runs(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    line, passage = word(19), word(60)
    texts = [word(30) + line + word(10) + (passage if i % 3 else "") + word(20) for i in range(40)]
    texts += ["a" * 500, "ab" * 300, texts[3], texts[3][7:], "é" * 120, line, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, spans=False, kept=False, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == _repeats(texts)


def test_repeats_in_texts_over_one_buffer(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 700)
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefgh"), 5000))
    texts = [base, base[1000:2500] + "x" + base[300:900], base[:650] + base[:650]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, spans=False, kept=False, digest=True).collect()}
    assert [got[i] for i in range(3)] == _repeats(texts)


def test_repeats_tell_texts_of_one_id_apart(spark):
    """Two texts of one id (or none) whose hashes agree in 16 bits are two documents."""
    line = "".join(np.random.default_rng(7).choice(list("abcdefgh"), 150))
    low, pair = {}, None
    for i in range(10_000):
        text = f"{i:05d} " + "".join(np.random.default_rng(i).choice(list("mnopqrst"), 40)) + line
        other = low.setdefault(xxhash.xxh64_intdigest(text.encode()) & 0xFFFF, text)
        if other != text:
            pair = [other, text]
            break
    for doc_id in (None, 5):
        for parts in (1, 2):                                   # in one batch, and met in the joins
            df = spark.createDataFrame([(doc_id, t) for t in pair], "doc_id long, text string").repartition(parts)
            got = sorted(r.n_removed for r in suffix_dedup.remove_repeats(df).collect())
            assert got == [0, 150], (doc_id, parts, got)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_rounds_leave_no_shuffle_files(docs, spark):
    """What a round has shuffled is deleted when the round is written, also if the JVM collects no garbage; of the rounds only spans stay."""
    before = _shuffle_files(spark)
    spans = suffix_dedup.repeated_spans(docs.repartition(3))              # writes both rounds
    scratch = os.path.dirname(os.path.dirname(local_fs_path(spans.inputFiles()[0])))
    assert {x.rsplit("-", 1)[0] for x in os.listdir(scratch) if x.startswith("suffix")} == {"suffix-spans"}
    until = time.time() + 15
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spans.count() > 0


def test_materialize_keeps_the_sessions_setting(spark, docs):
    for value in ("false", "true", None):
        if value is None:
            spark.conf.unset(common._CLEANUP)
        else:
            spark.conf.set(common._CLEANUP, value)
        as_set = spark.conf.get(common._CLEANUP, None)
        assert common.materialize(docs.groupBy("lang").count(), "test").count() > 1
        assert spark.conf.get(common._CLEANUP, None) == as_set


def test_repeated_windows_of_a_task_are_one_row_a_passage():
    """Nineteen copies of 61 windows are 19 marks, not 1,159; a gap of more than a window starts another."""
    import pyarrow as pa
    import zstandard

    passage = bytes(np.random.default_rng(4).integers(97, 123, 300, np.uint8))
    edges = [{"kind": suffix_dedup.HEAVY_EDGE, "h": 1, "at": 100, "span": 60}]
    ids = list(range(20))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([7] * 20), pa.array([zstandard.compress(passage)] * 20), pa.array([edges] * 20)],
                                       names=["doc", "tie", "z", "edges"])
    rows = [r for out in suffix_dedup._windows(iter([batch])) for r in out.to_pylist()]
    marks = [r for r in rows if r["kind"] == suffix_dedup.MARK]
    assert len(rows) - len(marks) == 61 and {r["doc"] for r in rows if r["kind"] != suffix_dedup.MARK} == {0}
    assert [(r["doc"], r["at"], r["span"]) for r in marks] == [(i, 40, 60) for i in ids[1:]]
    ends = [(r["at"], r["ctx"]) for out in suffix_dedup._settle_windows(iter([pa.RecordBatch.from_pylist(marks, suffix_dedup._WINDOW_SCHEMA)]))
            for r in out.to_pylist()]
    assert ends == [(40, 200)] * 19
    runs = list(suffix_dedup._runs([(1, 5, 300), (1, 5, 10), (1, 5, 110), (1, 5, 211), (1, 6, 212), (1, 5, 110)]))
    assert runs == [(1, 5, 10, 110), (1, 5, 211, 300), (1, 6, 212, 212)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_marks_are_merged_as_they_stream(size):
    """Documents that go on over batches: one row each, spans merged and in order."""
    import pyarrow as pa

    rng, marks, want = np.random.default_rng(size), [], {}
    for doc, tie in [(-5, 3), (1, -9), (1, 2), (4, 0), ((1 << 63) - 1, 1)]:
        gone = np.zeros(5000, bool)
        for a in sorted(rng.integers(0, 4000, 60 if doc == 4 else 6).tolist()):
            marks.append((doc, tie, a << 32 | a + 100))
            gone[a:a + 100] = True
        at = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        want[doc, tie] = [{"start": int(a), "end": int(b)} for a, b in zip(at[::2], at[1::2])]
    marks.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*marks[i:i + size])], names=["doc", "tie", "place"])
               for i in range(0, len(marks), size)]
    got = [(r["doc"], r["tie"], r["spans"]) for out in suffix_dedup._united(iter(batches)) for r in out.to_pylist()]
    assert [g[:2] for g in got] == sorted(want) and all(want[d, t] == s for d, t, s in got)
    assert list(suffix_dedup._united(iter([]))) == []


def test_repeats_odd_input(odd, empty):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count() and suffix_dedup.remove_repeats(empty).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[3][0].n_bytes == 0 and by[6][0].n_removed == len(LONG) and by[6][0].kept == b""
    # the text repeats itself: what is left of the first copy is what occurs nowhere earlier
    assert by[5][0].n_removed + len(by[5][0].kept) == len(LONG)
    assert len({(r.n_removed, bytes(r.kept)) for r in by[1]}) == 1


# ---------------------------------------------------------------- 5 SimHash
def _fingerprint(text, k=3):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fps, bits=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [_fingerprint(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [got[r.doc_id].component_id for r in rows] == [rows[c].doc_id for c in _classes(fps)]


def test_index_finds_every_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    for c in centres:                                         # dense clusters, as near copies make them
        for _ in range(120):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in simhash.linked_within(fps):
        assert bin(int(fps[a]) ^ int(fps[b])).count("1") <= 2 and find(a) != find(b)   # a forest of links
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = _classes([int(f) for f in fps])
    mine = [find(i) for i in range(len(fps))]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_every_link_shares_a_bucket():
    masks = simhash.segment_masks(2)
    rng = np.random.default_rng(4)
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (-5, 7)]
    got = dict((r.v, r.root) for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert {got[i] for i in range(1, 61)} == {-5} and {got[i] for i in (100, 200, 300)} == {100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_one_row_of_each_component(spark):
    word = lambda seed: " ".join("".join(np.random.default_rng([seed, i]).choice(list("abcdefgh"), 5)) for i in range(40))
    a, b, c, d = (word(i) for i in range(4))
    data = [(7, a), (7, b), (7, b), (8, b), (None, a), (None, c), (None, c), (None, c.upper()), (None, d), (9, d), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(data)], "doc_id long, text string, n long").repartition(4)
    got = simhash.keep_first(df).collect()
    assert len(_classes([_fingerprint(t) for t in (a, b, c, d, "")])) == 5
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got) == sorted([(7, a), (7, b), (0, c), (9, d), (5, "")])
    assert next(r.n for r in got if r.text == b) == 1


def test_components_leave_only_their_last_tables(spark):
    import os

    from tabulare.session import scratch_path

    root = os.path.dirname(scratch_path(spark, "x")).replace("file:", "")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    chain = spark.range(1, 200).selectExpr("id + 1 AS a", "id AS b")
    got = simhash.components(chain)
    assert {r.root for r in got.collect()} == {1} and got.count() == 200
    left = sorted(x.split("-")[1] for x in set(os.listdir(root)) - before if x.startswith("cc-"))
    assert left == ["edges"], left


def test_simhash_odd_input(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(empty).count() == 0
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in got if r.fingerprint == next(x.fingerprint for x in got if x.doc_id == 1)} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # the rows without id are copies of 1 (the sentence) and of 2 (no words), so none of them is the row that stays
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8] and ids.count(None) == 0
    assert simhash.keep_first(empty).count() == 0


# ---------------------------------------------------------------- 7 quality
def test_quality_fits_on_one_bag_per_label(spark, monkeypatch):
    """One labelled id on many rows sends one bag to the driver and does not crowd out the others."""
    bags = []

    def fit(cls, x, y, *a, **kw):
        bags.append((len(x), list(y)))
        raise StopIteration
    monkeypatch.setattr(quality.AttentionModel, "fit", classmethod(fit))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(ids[0], f"hot text {i} with words") for i in range(3000)] + [(i, f"text of {i}") for i in ids[1:]]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    for sample, want in ((1000, 40), (10, 10)):
        with pytest.raises((StopIteration, RuntimeError)):
            quality.fit(d, labels, sample=sample)
        assert bags[-1][0] == want


def _plain_score(p, bag):
    """Gated attention of one bag, passage by passage."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = [np.tanh(x @ p["W"] + p["w0"]) for x in bag]
    weights = np.exp([float(np.sum(p["a"] * np.tanh(h @ p["V"]) * sigmoid(h @ p["U"]))) for h in hidden])
    z = sum(w * h for w, h in zip(weights / weights.sum(), hidden))
    return float(sigmoid(z @ p["c"] + p["c0"][0]))


def test_quality_attention_equals_the_plain_form():
    rng = np.random.default_rng(14)
    bags = [rng.normal(size=(int(n), quality.FEATURES)) for n in (1, 5, 2, 9, 1)]
    model = quality.AttentionModel.fit(bags, np.array([0.0, 1, 0, 1, 1]), epochs=3)
    scaled = [(b - model.mean) / model.scale for b in bags]
    assert np.allclose(model._score(scaled), [_plain_score(model.params, b) for b in scaled], rtol=1e-12)
    order = rng.permutation(9)                                          # a bag has no order
    assert np.isclose(model._score([scaled[3][order]])[0], _plain_score(model.params, scaled[3]))


def test_quality_steps_go_down_the_gradient():
    """The first step of the fit moves every parameter against the numeric gradient of the plain loss."""
    rng = np.random.default_rng(15)
    bags = [rng.normal(size=(int(n), quality.FEATURES)) for n in rng.integers(1, 6, 12)]
    labels = np.array([0.0, 1] * 6)
    rate, decay = 0.01, 1e-4
    after = quality.AttentionModel.fit(bags, labels, epochs=1, batch=len(bags), rate=rate, decay=decay, seed=3)
    scaled = [(b - after.mean) / after.scale for b in bags]
    start = np.random.default_rng(3)                                    # the fit's own first draws
    shape = {k: v.shape for k, v in after.params.items()}
    p = {"W": start.normal(0, quality.FEATURES ** -0.5, shape["W"]), "w0": np.zeros(shape["w0"])}
    p |= {k: start.normal(0, 0.2, shape[k]) for k in ("V", "U", "a", "c")} | {"c0": np.zeros(1)}

    def loss():
        y = np.array([_plain_score(p, b) for b in scaled])
        return float(-np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y)) + decay / 2 * sum((v ** 2).sum() for v in p.values()))

    checked = 0
    for k, v in p.items():
        flat = v.reshape(-1)
        for i in rng.choice(len(flat), min(25, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            slope, flat[i] = (up - loss()) / 2e-5, old
            if abs(slope) > 1e-5:
                checked += 1
                assert np.isclose(old - after.params[k].reshape(-1)[i], rate * np.sign(slope), rtol=0.01), (k, i)
    assert checked > 80


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 50 and sum(p == t for p, t in out) / len(out) > 0.95
    # never an input: what the labels of held-out documents say
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(d, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_quality_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 1), (6, 1), (7, 1), (8, None), (None, 0), (99, 1)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}


def test_passages_of_a_long_text_do_not_depend_on_its_neighbours():
    data = np.frombuffer(LONG.encode(), np.uint8)
    whole = quality.passage_features(data)
    assert whole.shape[1] == quality.FEATURES and np.isfinite(whole).all()
    old, quality.SEGMENT = quality.SEGMENT, 1 << 16
    try:
        parts = quality.passage_features(data)
    finally:
        quality.SEGMENT = old
    assert abs(len(parts) - len(whole)) < 40 and np.allclose(parts.mean(0), whole.mean(0), atol=0.02)


# ---------------------------------------------------------------- 8 personal data
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _ok(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def _base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if _ok(k, m.group())]


def _check_pii(texts, got):
    for t, r in zip(texts, got):
        b = _base(t)
        assert r.base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest(), (t, b, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in b) for k in PLAIN]
        assert set(b) <= set(r.spans.split(","))


def test_pii_base_spans(docs, rows):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    _check_pii([r.text for r in rows], [got[r.doc_id] for r in rows])


def test_pii_patterns_equal_the_plain_ones(spark):
    rng = np.random.default_rng(5)
    bits = ["a", "7", "4", "@", ".", "-", "+", " ", "(", ")", "_", "%", "é", "\U0001f600", "x@y.z", "1.2.3.4", "4845168114407329", "+1 (017) 555-7713", "\n"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(600)] + ["a@b.com_x@d.com", "1.2.3.4.5.6.7.8", "0255.1.1.1", "5" * 3000, "a" * 3000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    _check_pii(texts, [got[i] for i in range(len(texts))])


def test_pii_contexts_discover_unseen_identifiers(spark):
    cards = ["4845168114407329", "7536784127813050", "4929348385146306", "4952935900253052", "2669109448945250", "4795522935961213", "4417744280351547"]
    texts = [f"please charge my card number {c} thanks" for c in cards]
    texts += ["please charge my card number 4845-1681-1440-7320-11 thanks", "the room number 12 is free", "my flat number 44 too"]
    texts += [f"see room number {i} please" for i in range(20, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[7].n_card == 0 and got[7].spans == "card:29:51"          # fails the checks, but the context says card
    assert all(got[i].spans == "" for i in range(8, len(texts)))        # an ambiguous word is no pattern
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[7] == "please charge my card number <CARD> thanks" and masked[0] == "please charge my card number <CARD> thanks"
    assert masked[8] == texts[8]


def test_pii_a_context_of_two_kinds_and_chains_of_contexts(spark):
    """``contact:`` precedes e-mails and phones alike; each later context is learned through the one before it."""
    texts = [f"contact: user{i}@site{i}.example.org ok" for i in range(6)] + [f"contact: +1 555 010 {1000 + i} ok" for i in range(5)]
    texts += ["contact: user77(at)site.example ok"]
    texts += [f"call me: +1 555 010 {2000 + i} ok" for i in range(8)] + [f"call me: x55-{i} ok" for i in range(2)]
    texts += [f"dial this: x55-{i} ok" for i in range(2)] + [f"dial this: +1 555 010 {3000 + i} ok" for i in range(7)]
    texts += [f"dial this: y66-{i} ok" for i in range(2)]
    texts += [f"ring there: y66-{i} ok" for i in range(2)] + [f"ring there: +1 555 010 {4000 + i} ok" for i in range(9)] + ["ring there: z77-1 ok"]
    texts += [f"nothing like: q{i}9 ok" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        if "(at)" in t:
            assert got[i].startswith("email:9:")                        # six e-mails to five phones
        elif "x55" in t or "y66" in t or "z77" in t:
            at = t.index(": ") + 2
            assert got[i] == f"phone:{at}:{len(t) - 3}", (t, got[i])
        elif "nothing" in t:
            assert got[i] == ""


def test_pii_contexts_of_long_words(spark):
    """The two words before an identifier are whole, however long, and different long words are different contexts."""
    long = "w" * 300
    texts = [f"{long} a{long}: +1 555 010 {1000 + i}" for i in range(6)] + [f"{long} a{long}: x55-1", f"{long} b{long}: x55-2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[6] == f"phone:604:609" and got[7] == ""


def test_pii_mask_covers_overlapping_spans(spark):
    texts = ["a +1 234 567 8901@x.example.com z", "ip 10.1.2.3.4 (555) +10.20.30.40 12 3", "x " + "bob@example.org " * 40 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert "phone" in spans[0] and "email" in spans[0]
    out = sorted((r.doc_id, r.text) for r in pii.mask(df).collect())
    assert len(out) == 4 and out[0] == out[1] and not re.search("[0-9]", out[0][1]) and out[0][1].startswith("a <")
    for i, text in out:
        assert not _base(text), text
    assert out[-1][1] == "x " + "<EMAIL> " * 40 + "end"


def test_pii_merged_spans_are_the_union(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        at = sorted({(int(a), int(a) + int(rng.integers(1, 9)), int(rng.integers(4))) for a in rng.integers(0, 60, rng.integers(0, 12))})
        rows.append((i, [dict(zip(("start", "end", "kind"), t)) for t in at]))
    df = spark.createDataFrame(rows, "i int, s array<struct<start:long,end:long,kind:int>>")
    for r in df.select("i", "s", pii.merged(F.col("s")).alias("m")).collect():
        want = []
        for a, b, k in [(x.start, x.end, x.kind) for x in r.s]:
            if want and a < want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b, k])
        assert [[x.start, x.end, x.kind] for x in r.m] == want


def test_pii_odd_input(odd, empty):
    got = pii.report(odd).collect()
    assert len(got) == odd.count() and pii.report(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[7].spans == "email:5:20,phone:24:41" and by[8].spans == "ip:24:31" and by[3].spans == ""
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count() and pii.mask(empty).count() == 0
    m = {r.doc_id: r for r in masked.collect()}
    assert m[7].text == "mail <EMAIL> or <PHONE> now" and m[7].n_chars == len(m[7].text)
    assert m[3].text is None and m[5].text == LONG


# ---------------------------------------------------------------- 9 BPE
@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(VOCAB))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip_and_ids(docs, rows, reference_encoding):
    got = {r.doc_id: r for r in bpe.tokenize(docs, VOCAB, public_tokenizers.PATTERN, decoded=True, digests=True).collect()}
    for r in rows:
        g, ids = got[r.doc_id], reference_encoding.encode_ordinary(r.text)
        assert list(g.ids) == ids and g.n_tokens == len(ids) and bytes(g.decoded) == r.text.encode()
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_memory_bound_does_not_change_ids(reference_encoding):
    enc = bpe.Encoder(bpe.read_ranks(VOCAB), public_tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    bits = ["the", " and", "  ", "\n", "don't", " 's", "'", "été", "\U0001f600", "42", "$$", " x", "\x1c", " ", "\t", "a" * 90, "<|endoftext|>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(400)] + ["", " ", "  a", "a  "]
    memory = bpe.Memory(enc, 50)
    out = [p for i in range(0, len(texts), 16) for p in memory.encode(texts[i:i + 16])]
    assert [np.frombuffer(p, "<u4").tolist() for p in out] == [reference_encoding.encode_ordinary(t) for t in texts]
    assert len(memory.known) <= 50 and len(memory.chunks) <= 50


def test_bpe_memory_is_bounded_in_bytes(reference_encoding):
    enc = bpe.Encoder(bpe.read_ranks(VOCAB), public_tokenizers.PATTERN)
    memory = bpe.Memory(enc, 200_000)
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefgh天地éß"))
    for n in (20_000, 200, 12):
        texts = [" ".join("".join(rng.choice(letters, n)) for _ in range(max(2, 4000 // n))) for _ in range(8)]
        out = memory.encode(texts)
        assert [np.frombuffer(p, "<u4").tolist() for p in out] == [reference_encoding.encode_ordinary(t) for t in texts]
        for held in (memory.known, memory.chunks):
            assert sum(4 * len(k) + len(v) + bpe.ENTRY for k, v in held.items()) <= 200_000 and all(len(k) <= bpe.LONGEST for k in held)


def test_perfect_hash_is_minimal_and_rejects_foreign_keys():
    keys = [f"key{i}".encode() for i in range(5000)]
    ph = bpe.PerfectHash.build(keys)
    assert len(ph.rank) == len(keys) and sorted(ph.rank) == list(range(5000))
    assert (ph.lookup(bpe.hash_keys(keys)) == np.arange(5000)).all()
    assert (ph.lookup(bpe.hash_keys([b"foreign", b""])) == -1).all()


def test_bpe_odd_input(odd, empty):
    got = bpe.tokenize(odd, VOCAB, public_tokenizers.PATTERN, decoded=True).collect()
    texts = Counter(((r.text or "").encode(), r.doc_id) for r in odd.collect())
    assert Counter((bytes(r.decoded), r.doc_id) for r in got) == texts
    assert bpe.tokenize(empty, VOCAB, public_tokenizers.PATTERN).count() == 0
