"""Whitening, sharding and spelling variants against brute force, with nulls, ties, repeated rows, hot groups and empty tables."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import sharding, spelling, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], DOCS)


# -- whitening


def plain_whitening(vectors, most=4):
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, sums, strict=True)) for r in x]
    return n, deviation, (x - sums / n) @ (basis[:, order] / np.sqrt(values[order])), values[order] / values.sum()


@pytest.mark.parametrize("kind", ["spread", "copies", "flat"])
def test_rank_one_updates(kind):
    rng, d = np.random.default_rng(3), 12
    x = rng.integers(-150, 150, (90, d))
    if kind == "copies":
        x[30:60] = x[7]
    if kind == "flat":
        x[:, 4:] = x[:, :1]
    half = [whitening.Spectrum(d), whitening.Spectrum(d)]
    for k, v in enumerate(x):
        half[k % 3 == 0].add(v)
    half[0].join(half[1])
    wanted = (x - x.mean(0)).T @ (x - x.mean(0))
    got = half[0]
    assert np.allclose(got.basis @ np.diag(got.values) @ got.basis.T, wanted, atol=1e-12 * np.abs(wanted).max())
    assert np.allclose(got.basis.T @ got.basis, np.eye(d), atol=1e-13)
    assert got.sums.tolist() == x.sum(0).tolist() and got.n == 90


@pytest.mark.parametrize("seed", range(5))
def test_secular_roots(seed):
    rng = np.random.default_rng(seed)
    d = np.sort(rng.random(9)) * 10.0 ** rng.integers(-3, 9)
    d[4] = d[3] * (1 + 1e-13)
    z = rng.standard_normal(9)
    z /= np.linalg.norm(z)
    pole, x = whitening.secular_roots(d, z * z, 2.5)
    assert np.allclose(np.sort(d[pole] + x), np.linalg.eigvalsh(np.diag(d) + 2.5 * np.outer(z, z)), rtol=1e-12, atol=1e-12 * d.max())


def test_whitened_against_whole_decomposition(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 0.2) * (1 + j) for j in range(10)] for _ in range(300)]
    vectors += [vectors[0]] * 150  # a third are copies of one
    table = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, component string").repartition(9)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(table).collect()}
    n, deviation, white, explained = plain_whitening(vectors)
    assert len(got) == 4 * 450
    signs = [np.sign(got[0, c + 1].whitened * white[0, c]) for c in range(4)]
    for (i, c), r in got.items():
        assert r.n == n == 300 and r.deviation == deviation[i]
        assert r.whitened == pytest.approx(white[i, c - 1] * signs[c - 1], abs=1e-9)
        assert r.explained == pytest.approx(explained[c - 1], rel=1e-10) and r.identity_error < 1e-10


def test_whitened_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [-0.0, 0.001]), (None, [0.25]), (8, [])]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted([("1", 1), ("1", 1), ("1", 2), ("1", 2), ("6", 1), ("6", 2), ("8", 1), ("8", 2), ("None", 1), ("None", 2)])
    assert {r.n for r in got} == {3}  # 6 and 8 are both zeros
    assert whitening.whitened(spark.createDataFrame([(1, [0.5]), (2, [0.5])], schema)).collect() == []  # no direction
    assert whitening.whitened(spark.createDataFrame([(1, [])], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []


def test_deviations_are_exact():
    x, sums = np.array([[1 << 40, 3], [5, -7]]), [(1 << 40) + 5, -4]
    assert whitening.deviations(x, 2, sums) == [None, sum((2 * int(a) - b) ** 2 for a, b in zip(x[1], sums, strict=True)) if sum((2 * int(a) - b) ** 2 for a, b in zip(x[1], sums, strict=True)) < 1 << 63 else None]
    assert whitening.deviations(np.array([[1, 2]]), 3, [4, 5]) == [2]


# -- sharding


def shard_rows(spark, n=600):
    rng = random.Random(2)
    return [(i, "w" * rng.randrange(60) if i % 41 else None, None if i % 29 == 0 else "hot" if i % 3 == 0 else f"s{rng.randrange(6)}") for i in range(n)]


def plain_shards(rows, shards, seed=sharding.SEED):
    import hashlib

    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, len((t or "").encode()) + 8))
    order = sorted(((2 * r + 1) / (2 * len(v)), s is not None, s or "", *x) for s, v in by.items() for r, x in enumerate(sorted(v)))
    out, slots = {}, Counter()
    for p, x in enumerate(order):
        shard = p * shards // len(order)
        out[x[4]] = (shard, slots[shard])
        slots[shard] += 1
    return out


def test_shards_by_rows_against_sorting(spark):
    rows = shard_rows(spark)
    got = {r.doc_id: r for r in sharding.sharded(docs(spark, rows), 24).collect()}
    assert {i: (r.shard, r.slot) for i, r in got.items()} == plain_shards(rows, 24)
    assert all(got[i].size == len(t or "") + 8 and got[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t, _ in rows)
    counts = Counter(r.shard for r in got.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    sources, both = Counter(s for *_, s in rows), Counter((r.shard, r.source) for r in got.values())
    assert all(abs(both[k, s] - n / 24) <= 2 for k in range(24) for s, n in sources.items())


def test_shards_by_bytes(spark):
    rows = shard_rows(spark)
    got = sharding.sharded(docs(spark, rows), 7, "bytes").collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 68
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)


def test_shards_awkward_rows(spark):
    rows = [(1, "a", "x")] * 3 + [(None, None, None), (2, "", "x"), (3, "z" * 100_000, None)]
    got = sharding.sharded(docs(spark, rows), 4).collect()
    assert len(got) == 6 and sorted(Counter(r.shard for r in got).values()) == [1, 1, 2, 2]
    assert {r.size for r in got} == {8, 9, 100_008}
    assert sharding.sharded(docs(spark, []), 4).collect() == []
    assert sharding.sharded(docs(spark, []), 4, "bytes").collect() == []
    with pytest.raises(ValueError):
        sharding.sharded(docs(spark, rows), 4, "luck")


def test_written_shards(spark, tmp_path):
    rows = shard_rows(spark, 90)
    sharding.written_shards(docs(spark, rows), str(tmp_path / "out"), 5)
    read = spark.read.parquet(str(tmp_path / "out")).selectExpr("shard", "slot", "doc.doc_id", "doc.text", "doc.word").collect()
    assert {r.doc_id: (r.shard, r.slot) for r in read} == plain_shards(rows, 5)
    assert {r.doc_id: r.text for r in read} == {i: t for i, t, _ in rows} and {r.word for r in read} == {"clash"}
    for k in range(5):
        for part in sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet")):
            slots = pq.read_table(part)["slot"].to_pylist()
            assert slots == sorted(slots)


# -- spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=5, times=5):
    import re

    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    links = {w: [v for v in n if near(v, w)] for w in n}
    form = {w: min((-n[v], v) for v in vs)[1] if vs and max(n[v] for v in vs) >= times * n[w] else None for w, vs in links.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(spark, rows, **more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs(spark, rows).repartition(5), **more).collect()}


def edited(rng, word, letters):
    i, c = rng.randrange(len(word) + 1), rng.choice(letters)
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdé×", "abcdefghijklmnop"])
def test_variants_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(40)]
    words = base + [edited(rng, w, letters) for w in base for _ in range(4)]
    words += [edited(rng, w, letters) for w in words[40:]]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([8, 60, len(words)])]) for _ in range(60)) + ("’s,ă" if i % 2 else "\n"), "x") for i in range(90)]
    wanted = plain_variants(rows)
    assert got_variants(spark, rows) == wanted and any(form for form, *_ in wanted.values())


def test_trie_finds_every_edit(spark):
    """Every word of one edit, at every place, in runs of one letter too."""
    words = {"aaaaaa", "aaabbb", "abcdef"}
    for w in list(words):
        words |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in ("", "a", "b", "z") for k in (0, 1)}
    words = sorted(w for w in words if len(w) >= 6)
    got = {(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}


def test_long_words(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (62, 63, 64, 64, 65, 300, 301)]
    words = sorted({*base, *(edited(rng, w, "abcz") for w in base for _ in range(6)), "x" * 500, "x" * 501, "x" * 499 + "y"})
    got = {(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}


def test_variants_awkward_rows(spark):
    rows = [(1, "wonder " * 40, "x"), (1, "wonder " * 40, "x"), (2, "wondeß " * 6, None), (3, None, "x"), (4, "", "x"), (5, "Wonders wonders! wonders1wonders,wonders", "x"), (6, "short " * 9 + "x" * 3_000, "x")]
    assert got_variants(spark, rows) == plain_variants(rows)
    assert got_variants(spark, rows)["wonders"][:2] == ("wonder", "wonder")
    assert got_variants(spark, []) == {}
    assert got_variants(spark, [(None, "abcdef " * 7, "x")])["abcdef"][2] == 7


def test_runs_by_bytes():
    text = "AbÀÿtail x×÷yzabc Āabcdefā abc1defghij €price€ ABCDEFG hijklmn中zzzzzz"
    import re

    wanted = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [w.decode() for w in spelling.runs(text.encode())] == [w for w in wanted if len(w.encode()) >= 6]
