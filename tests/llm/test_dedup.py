import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardframe.llm import exact_dedup, exchange, ngram_join, substring_dedup
from shardframe.llm.components import components
from shardframe.llm.wordhash import text_hash, window_hashes, word_hashes
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact ------------------------------------------------------------------------------------------------------------


def test_exact(docs):
    texts = ["a", "b", "a", None, "", "a ", "A", "b"]
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(texts)).collect()}
    assert [rows[i]["keep_id"] for i in range(8)] == [2, 7, 2, 4, 4, 5, 6, 7]
    assert [rows[i]["group_size"] for i in range(8)] == [2, 2, 2, 2, 2, 1, 1, 2]
    assert all(rows[i]["kept"] == (rows[i]["keep_id"] == i) and rows[i]["text_sha256"] == sha(t or "") for i, t in enumerate(texts))
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(docs(texts)).collect()) == [2, 4, 5, 6, 7]


def test_exact_takes_odd_rows(odd, nothing, docs):
    assert exact_dedup.exact_dedup(odd).count() == len(ODD) + 1
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0
    rows = exact_dedup.exact_dedup(docs(["a", "a", "b"], ids=[None, 3, None])).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["kept"]) for r in rows if r["keep_id"]) == [(False, 3, True), (True, 3, False)]
    assert [r["kept"] for r in rows if r["keep_id"] is None] == [True]
    table = docs(["a", "a", "a", "b", "b", None, ""], ids=[4, 4, 3, None, None, None, None])
    kept = exact_dedup.keep_one(table)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "b"), (4, "a")] and kept.columns == table.columns


def test_hot_groups_go_by_broadcast(docs):
    texts = ["hot"] * 1200 + [str(i) for i in range(300)] + ["pair", "pair"]
    rows = exact_dedup.exact_dedup(docs(texts)).collect()
    assert len(rows) == len(texts) and {r["keep_id"] for r in rows if r["group_size"] == 1200} == {1199}
    assert sum(r["kept"] for r in rows) == 302


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_agree_and_meet_a_filled_index(spark, docs, monkeypatch, batches):
    """Texts over several batches: the index has each text once, with its largest id, and the anti-join drops the rest."""
    rng = random.Random(batches)
    texts = [f"t{rng.randrange(40)}" for _ in range(200)]
    ids = [None if rng.random() < 0.1 else rng.randrange(1000) for _ in texts]
    held, real = [], exact_dedup.DigestIndex.append_new

    def append_new(self, groups):
        before = self.read().count()
        real(self, groups)
        held.append((before, groups.count(), self.read().count()))

    monkeypatch.setattr(exact_dedup.DigestIndex, "append_new", append_new)
    rows = exact_dedup.exact_dedup(docs(texts, ids=ids), batches=batches).collect()
    largest = {t: max((i for i, x in zip(ids, texts, strict=True) if x == t and i is not None), default=None) for t in texts}
    want = sorted((i or -1, largest[t] or -1, texts.count(t), i == largest[t], sha(t)) for i, t in zip(ids, texts, strict=True))
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in rows) == want
    assert len(held) == batches and held[-1][2] == len(set(texts))
    assert batches == 1 or all(0 < before < after + 1 <= before + new for before, new, after in held[1:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_hot_groups_of_a_batch_are_split_with_a_filled_index(docs, spark, tmp_path):
    """A text that the index holds once and a batch a thousand times is hot by the batch's count."""
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    exact_dedup.exact_dedup(docs(["hot", "b"]), index).collect()
    found = exact_dedup.exact_dedup(docs(["hot"] * 1500 + ["c"] * 20, ids=range(10, 1530)), index)
    assert {(r["keep_id"], r["group_size"]) for r in found.collect()} == {(0, 1500), (1529, 20)}
    assert any(k in found._jdf.queryExecution().optimizedPlan().toString() for k in ("strategy=broadcast", "broadcast"))
    index.drop()


def test_the_index_outlives_its_session(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(docs(["a", "b"]), first).collect()
    spark.sql(f"DROP TABLE {first.table}")
    again = exact_dedup.DigestIndex(spark, path, 4)
    rows = exact_dedup.exact_dedup(docs(["a", "c", "c"], ids=[10, 11, 12]), again).collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows} == {10: (0, False), 11: (12, False), 12: (12, True)}
    assert again.read().count() == 3
    join = again.read().alias("i").hint("merge").join(again.read().hint("merge"), "digest")
    assert "Exchange" not in join._jdf.queryExecution().executedPlan().toString()


# exchange ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("marked", [False, True])
@pytest.mark.parametrize("wide", [1024, 16, 4])
def test_shared_keys_are_the_same_however_they_are_dealt(docs, monkeypatch, marked, wide):
    """Keys of two units or more (one of which marks them), dealt at once or by groups of ranges."""
    monkeypatch.setattr(exchange, "WIDE", wide)
    monkeypatch.setattr(exchange, "BATCH", 2000)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400).astype(np.uint64)
    units = {f"u{i}": (i + 1, np.unique(rng.choice(pool, 30)), None) for i in range(60)}
    units = {t: (u, k, rng.random(len(k)) < 0.5) for t, (u, k, _) in units.items()}
    texts = [*units, *list(units)[:20]]
    table = docs([texts[i] for i in rng.permutation(len(texts))]).repartition(5)
    found = exchange.shared_keys(table, lambda own: (units[t] for t in own), 61, np.uint8 if marked else np.uint16, marked).collect()
    have, by_mark = defaultdict(set), set()
    for u, keys, marks in units.values():
        for k, m in zip(keys.tolist(), marks.tolist(), strict=True):
            have[k].add(u)
            by_mark |= {k} if m else set()
    bits = 39 if marked else 48

    def sent(k):
        return (k & ((1 << bits) - 1)) | ((k >> 32) * 61 >> 32) << 48

    shared = {u: {sent(k) for k in keys.tolist() if len(have[k]) > 1} for u, keys, _ in units.values()}
    want = {u: {sent(k) for k in keys.tolist() if len(have[k]) > 1 and (not marked or k in by_mark)} for u, keys, _ in units.values()}
    got = {r["unit"]: set(np.frombuffer(r["keys"], "<u8").tolist()) for r in found}
    assert len(got) > 50 and all(want[u] <= got.get(u, set()) <= shared[u] for u in want)
    assert marked or got == {u: k for u, k in want.items() if k}


# hashes -----------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x1c", max_size=40), max_size=6), st.integers(1, 4))
def test_hashes_agree_with_words(texts, width):
    words, begin = word_hashes([t.encode() for t in texts])
    own = [WORD.findall(t) for t in texts]
    assert np.diff(begin).tolist() == [len(w) for w in own]
    by_word, by_window = {}, {}
    windows = window_hashes(words, width) if len(words) >= width else []
    for w, a in zip(own, begin, strict=False):
        for i, x in enumerate(w):
            assert by_word.setdefault(x, words[a + i]) == words[a + i]
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            assert by_window.setdefault(key, windows[a + i]) == windows[a + i]
    assert len(set(map(int, by_word.values()))) == len(by_word) and len(set(map(int, by_window.values()))) == len(by_window)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from shardframe.llm import wordhash

    data = [b"some words " * 50, b"", b"x" * 3000 + b" y", b"tail"]
    words, begin = word_hashes(data)
    windows = window_hashes(words, 5)
    monkeypatch.setattr(wordhash, "BLOCK", 64)
    again, same = word_hashes(data)
    assert (again == words).all() and (same == begin).all() and (window_hashes(words, 5) == windows).all()
    assert text_hash(words[:3]) != text_hash(words[:2])


# substrings -------------------------------------------------------------------------------------------------------


def brute_cut(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    found = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        found[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return found


def passages(seed, n):
    """Texts that share passages at all offsets, copies, and short or long repeats."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    shared = [[word() for _ in range(rng.choice([30, 49, 50, 51, 75, 130]))] for _ in range(8)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(60))] + rng.choice(shared)
        w += [word() for _ in range(rng.randrange(60))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return texts + texts[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_as_by_brute_force(docs, seed):
    texts = passages(seed, 60)
    ids = random.Random(seed).sample(range(1000), len(texts))
    want = brute_cut(list(zip(ids, texts, strict=True)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs(texts, ids=ids)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_cut_documents(docs):
    texts = passages(3, 20)
    rows = substring_dedup.cut_documents(docs(texts)).collect()
    want = brute_cut(list(enumerate(texts)))
    assert len(rows) == len(texts)
    for r in rows:
        assert sha(" ".join(WORD.findall(r["text"]))) == want[r["doc_id"]][2]


def test_substrings_take_odd_rows(odd, nothing, docs):
    rows = substring_dedup.substring_dedup(odd).collect()
    want = brute_cut(list(enumerate(ODD)))
    assert len(rows) == len(ODD) + 1
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in rows)
    assert substring_dedup.substring_dedup(nothing).count() == 0
    text = " ".join(map(str, range(60)))
    found = substring_dedup.substring_dedup(docs([text, text, text, text], ids=[None, 4, 4, 7])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found) == [(0, 0), (4, 0), (4, 0), (7, 60)]


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_texts_that_alternate_by_a_pattern_are_told_apart(docs):
    """Words and sequences that cancel out in any polynomial over 64 bits."""
    texts = []
    for pick in ("alpha", "beta"), ("beta", "alpha"):
        texts.append(" ".join(f"{w} {'u' if pick[0] == 'alpha' else 'v'}{i}" for i, w in enumerate(thue_morse(1024, *pick))))
    same = [" ".join(thue_morse(2048, a, b)) for a, b in (("alpha", "beta"), ("beta", "alpha"))]
    long = ["".join(thue_morse(1024, a, b)) for a, b in (("a", "b"), ("b", "a"))]
    words, _ = word_hashes([x.encode() for x in long])
    assert words[0] != words[1] and len({text_hash(word_hashes([x.encode()])[0]) for x in same}) == 2
    want = brute_cut(list(enumerate([*texts, *same])))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs([*texts, *same])).collect()}
    assert got == want and got[1][1] == 0 and got[3][1] > 0


def test_rows_of_one_id_are_cut_by_their_texts(docs, odd, nothing):
    shared = " ".join(f"s{i}" for i in range(60))
    a, b = f"{shared} a", f"b {shared}"
    found = substring_dedup.cut_documents(docs([shared, a, b, None, "", shared], ids=[1, 5, 5, 5, None, None])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == sorted([(1, shared), (5, "a"), (5, "b"), (5, None), (None, ""), (None, shared)], key=repr)
    assert substring_dedup.cut_documents(odd).count() == len(ODD) + 1 and substring_dedup.cut_documents(nothing).count() == 0
    assert substring_dedup.cut_documents(odd).columns == odd.columns


# near duplicates --------------------------------------------------------------------------------------------------


def brute_join(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverse[x].add(k)
    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in inverse[x] if j < k}:
            other, t = sets[j]
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = root(i), root(other)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets}


def families(seed, n):
    """Families of near copies with more and more edits, chains of them, shared passages, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(3000)}"
    passage = [word() for _ in range(80)]
    texts = []
    while len(texts) < n:
        w = [word() for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 200]))] + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 1, 2, 9, 30])):
            texts.append(" ".join(w))
            w = list(w) if rng.random() < 0.5 else w  # else the edits go on from copy to copy
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
    return [t.lower() if rng.random() < 0.2 else t for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_as_by_brute_force(docs, seed):
    texts = families(seed, 250)
    ids = random.Random(seed).sample(range(5000), len(texts))
    want = brute_join(list(zip(ids, texts, strict=True)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(texts, ids=ids)).collect()}
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 30
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(docs(texts, ids=ids)).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_links_take_odd_rows(odd, nothing, docs):
    rows = ngram_join.ngram_join(odd).collect()
    want = brute_join(list(enumerate(ODD)))
    assert len(rows) == len(ODD) + 1 and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in rows)
    assert ngram_join.ngram_join(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0
    found = ngram_join.ngram_join(docs(["a b c", "A b c", None], ids=[None, 4, None])).collect()
    assert sorted((r["n_shingles"], r["component_id"] or 0) for r in found) == [(0, 0), (1, 4), (1, 4)]


def test_one_row_stays_where_ids_are_null_or_repeated(docs):
    near = " ".join(f"n{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(None, "alone with no id"), (None, near + " x"), (3, near), (5, near + " y"), (5, "five alone"), (None, other), (None, other + " z"), (None, other), (7, "a b c"), (7, "A b c"), (8, "again"), (8, "again"), (None, ""), (None, None)]
    found = ngram_join.keep_one(docs([t for _, t in rows], ids=[i for i, _ in rows])).collect()
    kept = [(r["doc_id"], r["text"]) for r in found]
    assert len([x for x in kept if x[0] is None and x[1] and x[1].startswith("o0 ")]) == 1
    assert len([x for x in kept if x[0] == 7]) == 1
    others = [x for x in kept if x[0] != 7 and not (x[1] or "").startswith("o0 ")]
    assert sorted(others, key=repr) == sorted([(None, "alone with no id"), (3, near), (5, "five alone"), (8, "again"), (8, "again"), (None, ""), (None, None)], key=repr)


def test_the_threshold_is_exact(docs):
    common = [f"c{i}" for i in range(94)]
    texts = [" ".join([*common, *(f"a{i}" for i in range(n))]) for n in (0, 30, 31)]  # 90 of 120 and 90 of 121 shingles
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs([texts[0], texts[1]])).collect()}
    assert got == {0: 0, 1: 0}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs([texts[0], texts[2]])).collect()}
    assert got == {0: 0, 1: 1}


@pytest.mark.parametrize("block", [2, 64])
def test_skipped_blocks_hold_no_pairs(monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(4)
    n = np.sort(rng.integers(1, 60, 80))
    at = rng.integers(0, 20, 80) % n
    i, j = ngram_join.block_pairs(n, at, 75)
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if ngram_join.may_link(n[a], at[a], n[b], at[b], 75)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) < 80 * 79 / 4
    assert ngram_join.block_pairs(n, at, 75, len(want)) is not None and ngram_join.block_pairs(n, at, 75, 10) is None


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), min_size=1, max_size=120))
def test_sketches_differ_in_no_more_bits_than_sets(a, b):
    keys = [np.array(sorted(x), np.uint64) for x in (a, b)]
    sizes = np.array([len(a), len(b)])
    folds = ngram_join.Sketches(sizes, sizes, [ngram_join.sketch(k) for k in keys], 75).folds
    m = folds[min(folds)]
    assert np.bitwise_count(m[0] ^ m[1]).sum() <= len(a ^ b)


def test_lists_with_sketches_lose_no_link():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 40, 90).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        own[rng.choice(90, rng.integers(0, 40), replace=False)] = rng.integers(0, 1 << 40, 1)
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 40, rng.integers(0, 30)).astype(np.uint64)])))
    sets.sort(key=len)
    n, at = np.array([len(x) for x in sets]), np.zeros(120, np.int64)
    i, j = ngram_join.block_pairs(n, at, 75, allow=ngram_join.Sketches(n, n, [ngram_join.sketch(x) for x in sets], 75).allow)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    links = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert links <= found and len(found) < 2 * len(links) + 200


@pytest.mark.parametrize("edits", [0, 8, 40])
def test_answers_follow_from_the_middle(edits):
    """Overlaps derived from the middle's are those of a direct count, for near and for far asks."""
    rng = np.random.default_rng(edits)
    base = rng.integers(0, 1 << 40, 90).astype(np.uint64)

    def near():
        own = base.copy()
        own[rng.choice(90, rng.integers(0, edits + 1), replace=False)] = rng.integers(0, 60, 1)
        return np.unique(np.concatenate([own, rng.integers(0, 60, rng.integers(0, 6)).astype(np.uint64)]))

    members, asks = [near() for _ in range(40)], [near() for _ in range(40)] + [np.arange(50, dtype=np.uint64)]
    alone = rng.integers(0, 5, 81)  # shingles that no other set has count in the sizes
    sizes = np.array([len(x) for x in [*members, *asks]]) + alone
    linked = {(z, i) for z, t in enumerate(asks) for i, s in enumerate(members) if 100 * (c := len(np.intersect1d(s, t))) >= 75 * (sizes[i] + sizes[40 + z] - c)}
    found = list(ngram_join.answers(members, sizes[:40], asks, sizes[40:], 75))
    assert set(found) <= linked and {z for z, _ in found} == {z for z, _ in linked} and len(found) == len({z for z, _ in found})
    for i in range(3):
        assert set(ngram_join.answers(members[i : i + 1], sizes[i : i + 1], asks, sizes[40:], 75)) == {(z, 0) for z, k in linked if k == i}


def run_by_method(monkeypatch, docs, texts, **limits):
    """The join's result with other limits, and how often each step ran."""
    ran = defaultdict(int)
    for name in ("with_lead", "across"):
        real = getattr(ngram_join, name)

        def counted(*args, real=real, name=name):
            ran[name] += 1
            return real(*args)

        monkeypatch.setattr(ngram_join, name, counted)
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(texts)).collect()}, ran


def spread_family(seed, n, edits):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(*edits)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("limits", [{}, {"LAST_PAIRS": 0, "PART_ROWS": 8}, {"PART_BYTES": 4000, "SENT_FAMILIES": 0, "OUTSIDE_ROWS": 4, "FEW_PAIRS": 0}, {"SHORT": 2, "BLOCK": 3, "FEW_PAIRS": 1000}])
def test_the_method_decides(docs, monkeypatch, limits):
    """A family whose sets are near a middle that is not among them: links are found by leads, by blocks, or by derived
    answers, as the limits have it, and by nothing else."""
    texts = spread_family(8, 70, (2, 7)) + spread_family(9, 12, (1, 3)) + [f"o{i} " * 3 + "x y z" for i in range(5)]
    want = brute_join(list(enumerate(texts)))
    got, ran = run_by_method(monkeypatch, docs, texts, **limits)
    assert got == want and len({c for _, c in want.values()}) > 2
    assert ran["across"] == (limits.get("FEW_PAIRS") != 1000)


def test_the_method_is_not_bypassed(docs, monkeypatch):
    """Without its derived answers the join finds fewer links."""
    texts = spread_family(8, 70, (2, 7))
    monkeypatch.setattr(ngram_join, "answers", lambda members, *a: iter(()))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs(texts)).collect()}
    assert len(set(got.values())) == 70


@pytest.mark.parametrize("most", [10**6, 8, 0])
def test_components(spark, monkeypatch, most):
    from shardframe.llm import components as module

    monkeypatch.setattr(module, "ONE_TASK", most)
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5), (20, 21), (21, 20)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    path = [(i, i + 1) for i in range(60)] if most else [(i, i + 1) for i in range(12)]
    assert {r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
