import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from shardframe.llm import langid, mixing, packing, training_order
from tests.llm.conftest import ODD


def ids_of(text, name="word_bpe_49k.json", end=1):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids, kind="<u4"):
    return zlib.crc32(np.array(ids, kind).tobytes())


# packing ----------------------------------------------------------------------------------------------------------


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs):
    texts = [*ODD, *(f"word{i} " * (i % 90 + 1) for i in range(150))]
    packed = packing.pack(docs(texts), capacity=256, keep_ids=True)
    rows = packed.collect()
    used = check_layout(rows, 256)
    whole = {i: ids_of(t) for i, t in enumerate(texts)}
    total = sum(map(len, whole.values()))
    assert sum(r["length"] for r in rows) == total and used <= -(-total // 256) * 1.02 + 1
    for r in rows:
        own = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and r["ids_crc32"] == crc(own)
    sequence = packing.sequences(packed).collect()
    assert len(sequence) == used and sum(len(r["ids"]) for r in sequence) == 4 * total


def brute_bins(lengths, capacity):
    """The least number of sequences, by trying."""
    best = len(lengths)

    def place(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= capacity:
                place(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]])
        place(left[1:], [*bins, left[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_plans_hold_every_piece(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, 12)
    rows = [{"sequence_id": first + k, "offset": offset, "length": n} for n, _, took, first, offset in runs for k in range(took)]
    used = check_layout(rows, 12)
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    for n in counts:  # ranks are dense
        assert sorted(x for m, rank, took, _, _ in runs if m == n for x in range(rank, rank + took)) == list(range(counts[n]))
    best = brute_bins(lengths, 12)
    assert used <= best * 11 / 9 + 1
    if all(3 * n > 12 for n in lengths):
        assert used == best  # matching large pieces is optimal


def test_packing_takes_odd_rows(odd, nothing):
    rows = packing.pack(odd).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(ODD))) and sum(r["doc_id"] == 7 for r in rows) == 2
    check_layout(rows, 4096)
    assert packing.pack(nothing).count() == 0


# mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(totals, weights=(5, 2, 1), share=1.0):
    names = sorted(totals, key=lambda s: (s is None, s.encode() if s else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, found = share * sum(totals.values()), set(names), {}
    while free:
        rate = left / sum(w[s] for s in free)
        above = {s for s in free if w[s] * rate > 3 * totals[s]}
        if not above:
            return found | {s: w[s] * rate for s in free}
        for s in above:
            found[s] = 3.0 * totals[s]
            left -= found[s]
        free -= above
    return found


def test_mixing(docs):
    rng = np.random.default_rng(2)
    names = ["b", "a", None, "é", "big", "tiny"]
    sources = [names[i] for i in rng.choice(6, 400, p=[0.1, 0.1, 0.1, 0.1, 0.59, 0.01])]
    texts = ["w " * int(n) for n in rng.integers(0, 60, 400)]
    table = docs(texts, sources=sources)
    rows = mixing.mix(table).collect()
    sizes = dict(enumerate(t.count("w") for t in texts))
    totals = {s: sum(sizes[i] for i in range(400) if sources[i] == s) for s in set(sources)}
    want = brute_targets(totals)
    assert len(rows) == 400
    taken = dict.fromkeys(totals, 0)
    for r in rows:
        s = sources[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], totals[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in totals if totals[s] > 300)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(table.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    copies = mixing.mixed(table)
    assert copies.columns == table.columns and copies.count() == sum(r["taken"] // r["size"] for r in rows if r["size"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 40))
def test_budgets_are_fitted_best(items, budget):
    lengths, spare = [a for a, _ in items], [b for _, b in items]
    take = mixing.fit(lengths, spare, budget)
    assert all(0 <= t <= s for t, s in zip(take, spare, strict=True))
    flat = [n for n, s in items for _ in range(s)]
    best = min(abs(sum(c) - budget) for k in range(len(flat) + 1) for c in combinations(flat, k))
    assert abs(sum(t * n for t, n in zip(take, lengths, strict=True)) - budget) == best


def test_large_budgets_are_met():
    lengths, spare = list(range(100, 3000, 7)), [40] * len(range(100, 3000, 7))
    take = mixing.fit(lengths, spare, 1_234_567)
    assert abs(1_234_567 - sum(t * n for t, n in zip(take, lengths, strict=True))) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.floats(0, 1))
def test_the_programme_is_left_a_few_of_the_longest(items, share):
    lengths, spare = [a for a, _ in items], [b for _, b in items]
    total = sum(a * b for a, b in items)
    budget = int(total * share)
    take = mixing.in_proportion(lengths, spare, budget)
    assert all(0 <= t <= s for t, s in zip(take, spare, strict=True))
    assert 0 <= budget - sum(t * n for t, n in zip(take, lengths, strict=True)) < max(lengths)
    assert all(abs(t - s * budget / total) <= 2 * max(lengths) / n for t, s, n in zip(take, spare, lengths, strict=True))


def test_the_programme_decides(docs, monkeypatch):
    """With proportion alone a source misses its target by more than the programme does."""
    texts = ["w " * n for n in (7, 11, 13, 17, 19, 23, 29, 31) * 20]
    sources = ["ab"[i % 2] for i in range(len(texts))]

    def missed():
        rows = mixing.mix(docs(texts, sources=sources)).collect()
        return max(abs(sum(r["taken"] for r in rows if r["target"] == t) - t) for t in {r["target"] for r in rows})

    assert missed() <= 1
    monkeypatch.setattr(mixing, "fit", mixing.in_proportion)
    assert missed() > 1


def test_equal_rows_and_rows_without_ids_are_ranked_apart(docs):
    """A length that most documents have, without ids or with one id and text: as many are taken as fit."""
    texts, ids = ["same text"] * 300 + [f"x{i} y" for i in range(300)] + ["b " * 40] * 10, [5] * 300 + [None] * 300 + list(range(10))
    rows = mixing.mix(docs(texts, ids=ids, sources=["a"] * 600 + ["b"] * 10)).collect()
    goal = {r["source_size"]: r["target"] for r in rows}
    assert len(rows) == 610 and set(goal) == {1200, 400}
    for size, target in goal.items():
        assert abs(sum(r["taken"] for r in rows if r["source_size"] == size) - target) <= (1 if size == 1200 else 20)


def test_mixing_takes_odd_rows(odd, nothing, docs):
    assert mixing.mix(odd).count() == len(ODD) + 1 and mixing.mix(nothing).count() == 0
    rows = mixing.mix(docs([None, ""], sources=["a", None])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_rows_with_null_and_repeated_ids_are_mixed_by_row(docs):
    texts = [f"w{i} " * (1 + i % 7) for i in range(300)]
    ids = [None if i % 3 == 0 else i % 20 for i in range(300)]
    table = docs(texts, ids=ids, sources=["ab"[i % 2] for i in range(300)])
    goal = {r["source_size"]: r["target"] for r in mixing.mix(table).collect()}
    sizes = {s: sum(1 + i % 7 for i in range(300) if "ab"[i % 2] == s) for s in "ab"}
    found = mixing.mixed(table).collect()
    assert len(goal) == 2 and any(r["doc_id"] is None for r in found)
    for s in "ab":
        assert abs(sum(len(r["text"].split()) for r in found if r["source"] == s) - goal[sizes[s]]) <= 1
    own = dict(zip(texts, ids, strict=True))
    assert all(own[r["text"]] == r["doc_id"] for r in found)


# training order ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_the_network_permutes(count):
    found = training_order.permuted(np.arange(count), count, 7)
    assert sorted(found.tolist()) == list(range(count))
    other = training_order.permuted(np.arange(count), count, 8)
    assert count < 10 or (found != other).any()
    assert (training_order.permuted(np.arange(count)[::-1], count, 7) == found[::-1]).all()


def stream_of(texts, ids=None):
    """The stream of all ids, and for each of its places the document and the place in it."""
    stream, origin = [], []
    for i, t in zip(ids or range(len(texts)), texts, strict=True):
        own = ids_of(t, "byte_bpe_50k.json", 50256)
        stream += own
        origin += [(i, k) for k in range(len(own))]
    return stream, origin


def test_training_order(spark, docs, tmp_path):
    texts = [*ODD, *(f"text number {i} " * (i % 40) for i in range(60))]
    ids = [None if i == 5 else i for i in range(len(texts))]
    path = f"file://{tmp_path}/shards"
    table = docs(texts, ids=ids).coalesce(1)
    rows = training_order.training_order(table, path, length=32, shard_rows=100).collect()
    stream, origin = stream_of(texts, ids)
    count = -(-len(stream) // 32)
    assert sorted(r["slot"] for r in rows) == list(range(count)) and count > 1000
    place = np.argsort(training_order.permuted(np.arange(count), count, 20_240_601))  # by slot
    for r in rows:
        at = 32 * int(place[r["slot"]])
        assert (r["shard"], r["place"]) == divmod(r["slot"], 100) and r["byte_offset"] == r["place"] * r["record_bytes"]
        assert (r["doc_id"], r["start"]) == origin[at] and r["n_tokens"] == len(stream[at : at + 32])
        assert r["ids_crc32"] == crc(stream[at : at + 32], "<u2")
    layout = training_order.Layout("byte_bpe_50k.tiktoken", 32, 100)
    (folder,) = tmp_path.glob("shards/shards-*")
    files = sorted(folder.glob("shard=*/part-*"), key=lambda f: int(f.parent.name[6:]))
    data = b"".join(f.read_bytes() for f in files)
    assert len(files) == -(-count // 100) and len(data) == count * layout.stride
    for slot in (0, 1, 99, 100, count - 1):  # by seeking alone
        record = data[slot * layout.stride : (slot + 1) * layout.stride]
        at = 32 * int(place[slot])
        own = np.frombuffer(record[30 : 30 + 64], "<u2").tolist()
        assert own == (stream[at : at + 32] + [50256] * 32)[:32] and record[-2:] == b"\n\n"
    rest = training_order.read_records(spark, f"file://{folder}", layout, 150).orderBy("shard", "place").collect()
    assert [r["slot"] for r in rest] == list(range(150, count))


def test_a_broken_run_is_resumed(docs, tmp_path, monkeypatch):
    """Missing shards are written again, the others are left as they are, and the sequences are not made again."""
    table = docs([f"text number {i} " * (i % 40) for i in range(80)])
    options = {"path": f"file://{tmp_path}/out", "length": 16, "shard_rows": 50}
    want = sorted(map(tuple, training_order.training_order(table, **options).collect()))
    (folder,) = tmp_path.glob("out/shards-*")
    shards = sorted(folder.glob("shard=*"))
    for f in shards[1].iterdir():
        f.unlink()
    stamps = {f: f.stat().st_mtime_ns for s in (shards[0], *shards[2:]) for f in s.glob("part-*")}
    monkeypatch.setattr(training_order, "token_sequences", None)
    assert sorted(map(tuple, training_order.training_order(table, **options).collect())) == want and len(shards) > 4
    assert {f: f.stat().st_mtime_ns for f in stamps} == stamps


def test_training_order_over_many_tasks(docs):
    texts = [f"text number {i} " * (i % 40) for i in range(90)]
    rows = training_order.training_order(docs(texts).repartition(7), length=16, shard_rows=64).collect()
    whole = {i: ids_of(t, "byte_bpe_50k.json", 50256) for i, t in enumerate(texts)}
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["n_tokens"] for r in rows) == sum(map(len, whole.values()))
    inside = [r for r in rows if r["start"] + r["n_tokens"] <= len(whole[r["doc_id"]])]
    assert len(inside) > 100
    assert all(r["ids_crc32"] == crc(whole[r["doc_id"]][r["start"] : r["start"] + r["n_tokens"]], "<u2") for r in inside)


def test_wide_vocabularies_have_wide_ids(monkeypatch):
    name = "byte_bpe_50k.tiktoken"
    assert (training_order.Layout(name, 8, 1).width, training_order.Layout(name, 8, 1).stride) == (2, 48)
    monkeypatch.setitem(training_order._encodings, name, type("Wide", (), {"n_vocab": 100_000})())
    assert (training_order.Layout(name, 8, 1).width, training_order.Layout(name, 8, 1).stride) == (4, 64)


def test_training_order_takes_odd_rows(odd, nothing):
    rows = training_order.training_order(odd, length=64).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(ids_of(t, "byte_bpe_50k.json", 50256)) for t in [*ODD, "same text here"])
    assert training_order.training_order(nothing).count() == 0


# pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_takes_odd_rows(spark, docs, nothing, tmp_path):
    """Null, empty and very long texts, repeated rows, null ids, clashing columns, and an empty table, stage by stage."""
    words = "the house of the water and the road to the sea with all of the people in it".split()
    texts = [*ODD, *(" ".join(np.random.default_rng(i).permutation(words)) + f" number {i}" for i in range(30))]
    texts += [texts[20], texts[20] + " more", texts[21], "the house of the water " * 4000]
    ids = [*range(len(texts) - 4), None, None, 21, 77]
    langs = ["en" if t and t.startswith("the") or i > 11 else None for i, t in enumerate(texts)]
    table = docs(texts, ids=ids, langs=langs, sources=["a", None, "b"] * (len(texts) // 3) + ["a"] * (len(texts) % 3))
    table = table.unionByName(table.where("doc_id = 25"))
    for name, rows in (("odd", table), ("nothing", nothing)):
        columns, left = rows.columns, [rows.count()]
        for stage, f in corpus_pipeline.STAGES:
            f(spark, rows, "").write.parquet(str(tmp_path / name / stage))
            rows = spark.read.parquet(str(tmp_path / name / stage))
            left.append(rows.count())
            assert stage == "packing" or rows.columns == columns
            if stage == "language_id":
                assert all(any(c.isalpha() for c in r["text"]) for r in rows.select("text").collect())
            if stage == "exact_dedup":
                assert rows.select("text").distinct().count() == left[-1]
        assert left[0] == 0 or left[1] > 30 and left[1] > left[2] > left[3] > 0 < left[5]
        assert left[0] or left == [0] * 6


def test_accepted_rows_keep_their_columns(odd, docs, nothing):
    texts = ["the house of the water and the road " * 3] * 40
    model = langid.fit(docs(texts, langs=["en", "de"] * 20))
    for rows in (odd, nothing):
        kept = langid.accepted(rows, model)
        verdict = langid.predict(rows, model)
        assert kept.columns == rows.columns and kept.count() == verdict.where("not rejected").count()
    assert langid.accepted(odd, langid.fit(nothing)).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    from tests.llm.test_dedup import brute_join

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    known = kept["language_id"]
    assert len(known) >= 195
    last = {}
    for r in known:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == sorted(last.values())
    joined = brute_join([(r["doc_id"], r["text"]) for r in kept["exact_dedup"]])
    assert sorted(r["doc_id"] for r in kept["ngram_join"]) == sorted({c for _, c in joined.values()})
    sizes = {r["doc_id"]: len(r["text"].split()) for r in kept["ngram_join"]}
    assert sum(sizes[r["doc_id"]] for r in kept["mixing"]) == pytest.approx(sum(sizes.values()), rel=0.005)
    check_layout(kept["packing"], 4096)
    assert sum(r["length"] for r in kept["packing"]) == sum(len(ids_of(r["text"])) for r in kept["mixing"])
    assert len(kept["packing"]) == corpus_pipeline.run(spark, sf).count()
