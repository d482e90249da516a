"""The corpus operators against brute force on small inputs, and their edge cases."""

import collections
import hashlib
import random
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.llm import (
    catalog, html_text, licenses, mixing, near_dup, packing, quality_model, quality_rules, suffix_dedup, token_counts, vector_search,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, a long text, copies, and a column with another operator's name."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None, "en", "a", 0, "x"), (2, "", None, None, 0, "x"), (3, " \n\t ", "en", "a", 0, None), (4, base, "en", "a", 9, "x"), (5, base, "en", "b", 9, "x"),
        (5, base, "en", "b", 9, "x"), (6, " ".join(near), "en", "b", 9, "x"), (None, words(rng, 40), "en", None, 9, "x"), (7, words(rng, 6000), "en", "c", 9, "x"),
        (8, "Ünï çødé " * 60, "fr", "c", 9, "x"), (9, words(rng, 90) + "\n" + base, "en", "a", 9, "x"), (10, "line a b c d\n" * 30, "en", "a", 9, "x"),
    ]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "size").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_registered_once_each():
    names = sorted(catalog.queries())
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))


@pytest.mark.parametrize("m", [quality_rules, mixing])
def test_sql_twins(spark, m):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = m.query(spark, SF)
    exp = con.sql(m.SQL)
    key = lambda r: tuple(str(x) for x in r)
    assert list(exp.columns) == df.columns and sorted(map(tuple, df.collect()), key=key) == sorted(exp.fetchall(), key=key)


def brute_rules(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(odd, none):
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(odd).collect())
    assert got == sorted((str(i), *brute_rules(t)) for i, t in rows_of(odd))
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and 7 in {r["doc_id"] for r in kept.collect()} and 10 not in {r["doc_id"] for r in kept.collect()}


def test_rules_keep_columns_of_any_name(odd):
    clash = odd.selectExpr("*", "'mine' as n_words_", "1 as __rep", "2 as __words", "3 as failed", "4 as w", "5 as c0")
    kept = quality_rules.keep_good(clash)
    assert kept.columns == clash.columns and {tuple(r[-6:]) for r in kept.collect()} == {("mine", 1, 2, 3, 4, 5)}


def test_repeats_by_lookup_and_by_sort_agree(spark):
    rng = random.Random(2)
    many = " ".join(words(rng, 60) for _ in range(1))
    text = many + " " + many  # more than 32 repeated windows
    d = spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")
    assert quality_rules.judge(d).collect()[0]["n_repeat_words"] == brute_rules(text)[4]


def test_mixing_bounds_and_reruns(odd, none):
    a, b = (sorted(map(tuple, mixing.mix_counts(odd).collect()), key=str) for _ in range(2))
    assert a == b and all(taken <= 2 * size for _, size, _, _, taken, _ in a)
    assert mixing.mix_counts(none).count() == 0
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in mixing.mix_counts(odd).collect())


def test_mixing_twin_on_a_null_source(odd):
    con = duckdb.connect()
    documents = odd.select("doc_id", "text", "source").toArrow()
    con.register("documents", documents)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, mixing.mix_counts(odd).collect()), key=key) == sorted(con.sql(mixing.SQL).fetchall(), key=key)


def test_mixing_targets(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, words(rng, rng.randint(5, 60)), "s%d" % (i % 5 if i % 2 else 0)) for i in range(3000)], "doc_id bigint, text string, source string")
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 100
    try:
        r = mixing.mix_counts(d).groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
    finally:
        mixing.BUCKET_ROWS = old
    assert all(abs(x["t"] - x["target"]) < 200 and x["target"] <= 2 * x["source_size"] for x in r)
    assert sum(x["target"] for x in r) == pytest.approx(1.5 * sum(x["source_size"] for x in r))


def brute_classes(rows, radius=2):
    fps = [near_dup.text_fingerprint(t) & (1 << 64) - 1 for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_simhash(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (odd, docs):
        assert sorted(map(tuple, near_dup.near_duplicates(d).collect()), key=str) == brute_classes(rows_of(d))
    assert near_dup.near_duplicates(none).count() == 0


def test_fingerprint_is_written_out():
    from xxhash import xxh64_intdigest

    w = "a bb ccc dddd e".split()
    h = [xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert near_dup.text_fingerprint("A  bb\tccc\ndddd E") & (1 << 64) - 1 == want
    assert near_dup.text_fingerprint(None) == 0 == near_dup.text_fingerprint(" \n")


def test_hot_blocks_link_as_pairs_do(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 2)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id bigint, __fp bigint")
    results = []
    for bucket in (1, 10_000):
        from coterie.operators.components import connected_components

        parts = connected_components(near_dup.links(d.select("__fp"), bucket=bucket))
        results.append(sorted(map(tuple, parts.collect())))
    assert results[0] == results[1] and len(results[0]) >= 150


def test_keep_one_of_each(odd, none):
    kept = near_dup.keep_one_of_each(odd)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == odd.columns and ids == sorted([1, 4, None, 7, 8, 9, 10], key=str)
    assert near_dup.keep_one_of_each(none).count() == 0


def test_parity_never_rules_out_a_similar_pair():
    rng = np.random.default_rng(4)
    p, q, y, like = [], [], [], []
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = rng.integers(-(1 << 62), 1 << 62, n)
        b = np.concatenate([a[: max(1, int(n * rng.random() ** 0.2))], rng.integers(-(1 << 62), 1 << 62, int(n * 0.3 * rng.random()))])
        p, q = [*p, near_dup.parity(a)], [*q, near_dup.parity(b)]
        both = len(set(a) & set(b))
        y, like = [*y, len(a) + len(b)], [*like, both / (len(a) + len(b) - both)]
    differ, y, like = near_dup.parity_differences(p, q), np.array(y), np.array(like)
    passes = differ <= y * 0.2 / 1.8 + 1e-6
    assert passes[like >= 0.8].all() and (like >= 0.8).sum() > 50 and not passes[like < 0.6].any()


def brute_kept(rows, similarity=0.8):
    """Ids that stay when of each connected group of similar texts the smallest does."""
    sets = [near_dup._shingle_set(t, 5) for _, t in rows]
    often = collections.Counter(g for s in sets for g in s)
    at = {g: k for k, g in enumerate(g for g, c in often.items() if c > 1)}
    m = np.zeros((len(sets), len(at)), np.float32)
    for k, s in enumerate(sets):
        m[k, [at[g] for g in s if g in at]] = 1
    both, n = m @ m.T, np.array(list(map(len, sets)))
    like = (both >= similarity * (n[:, None] + n - both)) | np.eye(len(sets), dtype=bool)
    part = np.arange(len(sets))
    while (new := np.where(like, part, len(sets)).min(1)).tolist() != part.tolist():
        part = new
    return {min(d for (d, _), p in zip(rows, part) if p == k) for k in set(part.tolist())}


def edited(rng, text, n):
    out = text.split()
    for k in rng.sample(range(len(out)), n):
        out[k] = words(rng, 1) + str(rng.random())
    return " ".join(out)


def test_near_copies_at_the_limit_are_all_found(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        base = words(rng, 200)
        near = base.split()
        for k in range(4):  # four edits lose 20 of 196 shingles: a similarity of 176 / 216, just over 0.8
            near[20 + 45 * k] = f"edit{i}x{k}"
        rows += [(2 * i, base), (2 * i + 1, " ".join(near))]
    got = {r["doc_id"] for r in near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_kept(rows) == {2 * i for i in range(400)}


def test_large_groups_of_independent_edits(spark):
    """Copies at 0.8 or more to their original, if it is there, and less to each other."""
    rng = random.Random(9)
    one, two = words(rng, 200), words(rng, 200)
    texts = [one, *(edited(rng, one, 3) for _ in range(1100)), *(edited(rng, two, 4) for _ in range(150))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"] for r in near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_kept(rows) and len(got) > 100


def test_equal_fingerprints_link_by_every_text(spark, monkeypatch):
    """Three texts of which only two are similar; SimHash takes all for equal."""
    monkeypatch.setattr(near_dup, "text_fingerprint", lambda *_: 7)
    rng = random.Random(10)
    b = words(rng, 200)
    rows = []
    for k in range(12):  # in some order of the texts' MD5s the middle one is not the head
        rows += [(3 * k, f"k{k} " + b), (3 * k + 1, edited(rng, f"k{k} " + b, 3)), (3 * k + 2, words(rng, 200))]
    got = {r["doc_id"] for r in near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_kept(rows)


def test_near_copies_are_sought_by_simhash_first(spark, monkeypatch):
    """Copies within two bits are confirmed by the first comparison and not compared again; each pair is compared once."""
    rng = random.Random(12)
    base = words(rng, 400)
    rows = [(0, base), *((k, base + " " + words(rng, 1)) for k in range(1, 9)), *((100 + k, words(rng, 200)) for k in range(20))]
    fps = {d: near_dup.text_fingerprint(t) for d, t in rows}
    near = [d for d in range(1, 9) if (fps[d] ^ fps[0]).bit_count() <= 2 and fps[d] != fps[0]]
    asked, similar = [], near_dup._similar

    def spy(pairs, *args):
        out = similar(pairs, *args)
        asked.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(near_dup, "_similar", spy)
    got = {r["doc_id"] for r in near_dup.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_kept(rows) == {0, *range(100, 120)}
    assert near and asked[0][1] >= 8 and asked[1][1] == 0 == asked[2][0]


def brute_repeats(rows, n=suffix_dedup.LENGTH, first=False):
    data = [(d, t.encode()) for d, t in rows]
    seen = collections.Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        rest = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for i in range(len(b)) if mark[i] and (not i or not mark[i - 1]))
        out.append((d, len(b), sum(mark), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BYTES, 500])
def test_repeated_strings(spark, odd, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (odd, docs):
        assert sorted(map(tuple, suffix_dedup.repeat_digest(d).collect()), key=str) == brute_repeats(rows_of(d))
    assert suffix_dedup.repeat_digest(none).count() == 0


def test_previous_factors_by_hand():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 60)
        text = bytes(rng.choices(b"ab", k=n))
        order = sorted(range(n), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), n)
        shared = np.array([0, *(common(a, b) for a, b in zip(order, order[1:]))])
        got = suffix_dedup.longest_previous_factors(np.array(order), shared)
        assert [int(got[order.index(i)]) for i in range(n)] == [max([common(i, j) for j in range(i)], default=0) for i in range(n)]


def test_grams_hash_by_content_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(4)
    t = bytes(rng.choices(b"abcdef", k=5000))
    text, start, count, value, _ = suffix_dedup.segments([t, t], suffix_dedup.GramHash(suffix_dedup.GRAM))
    assert len(set(value.tolist())) > 30
    covered = sorted((i, a + k) for i, a, n in zip(text, start, count) for k in range(n))
    assert covered == [(i, a) for i in range(2) for a in range(len(t) - suffix_dedup.LENGTH + 1)]


def test_remove_repeats_keeps_the_first(spark, odd):
    out = suffix_dedup.remove_repeats(odd)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    base = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert out.columns == odd.columns and texts[4] == base[4] and 5 not in texts and base[4] not in texts[9] and texts[9] and texts[1] is None
    left = [t for t in texts.values() if t]
    n = suffix_dedup.LENGTH
    assert max(collections.Counter(b[i : i + n] for b in (t.encode() for t in left) for i in range(len(b) - n + 1)).values()) >= 1


def test_packing(spark, odd, none):
    t = packing.tokenizer().whole
    for d in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = collections.Counter()
        for _, text in rows_of(d):
            want[tuple(t.encode(text, add_special_tokens=False).ids + [1])] += 1
        got = packing.pack(d).collect()
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at == 2048 or at & (at - 1) == 0
        assert sum(r["length"] for r in got) == sum(len(k) * n for k, n in want.items())
        by = collections.defaultdict(list)
        for r in got:
            by[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"], r["width"]))
        for (_, n), parts in by.items():
            if sum(len(x) // w for _, x, w in parts) == n:
                ids = np.frombuffer(b"".join(x for _, x, _ in sorted(parts)), "<u2").tolist()
                assert want[tuple(ids)] > 0
        crc = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.pack_digest(d).collect()}
        assert all(crc[r["sequence_id"], r["offset"]] == zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) for r in got)
    assert packing.pack(none).count() == 0


def test_words_tokenize_as_texts_do():
    t = packing.tokenizer()
    for text in ("It's don't x'S 12a3 ''s a<|endoftext|>b \x0b\x0c q", "Ünïcödé ĳ İstanbul ﬁ ß ΣΑΣ é 日本  x\x1cy", "A" * 500, "ÀÉÎ ª º µ ÷×"):
        assert np.frombuffer(t(text.encode()), t.dtype).tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_exact_patterns_fill_sequences():
    rng = np.random.default_rng(0)
    c = rng.poisson(20 * np.exp(-np.arange(2048) / 700))
    c[0] = 0
    done, left = packing.exact_patterns(c)
    used = np.zeros(2048, int)
    for m, uses in done:
        assert sum(a * b for a, b in uses.items()) == 2048 and m > 0
        for a, b in uses.items():
            used[a] += m * b
    assert (used + left == c).all() and (left >= 0).all() and (left * np.arange(2048)).sum() < 0.05 * (c * np.arange(2048)).sum()


def greedy(word, pieces):
    """Longest matches; a piece that does not close is taken only where bytes follow it."""
    n, i = 0, 0
    while i < len(word):
        i = next(j for j in range(len(word), i, -1) if (*word[i:j], *([256] if j == len(word) else [])) in pieces)
        n += 1
    return n


def test_token_counts(spark, odd, none):
    rng = random.Random(1)
    for _ in range(60):
        pieces = {tuple(rng.choices([97, 98, 99], k=rng.randint(1, 5))) for _ in range(8)} | {(97, 98, 256)}
        a = token_counts.LongestMatch(pieces)
        every = pieces | {(b,) for b in range(256)} | {(b, 256) for b in range(256)}
        for _ in range(20):
            w = bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
            assert a.count(w) == greedy(w, every)
    every = token_counts.load_vocabulary()
    a = token_counts.automaton()
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        assert a.text(r["text"].encode())[1] == sum(greedy(w, every) for w in r["text"].encode().lower().split())
    got = token_counts.token_counts(odd).collect()
    assert len(got) == odd.count() and all((r["n_words"] == 0) == (r["n_tokens"] == 0) for r in got) and token_counts.token_counts(none).count() == 0


def test_quality_model(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    out = quality_model.score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_model.score(none, labels).count() == 0 and quality_model.score(odd, labels.limit(0)).count() == odd.count()


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality_model.AdditiveModel(pairs=2).fit(x, y).score(x) > 0.5) == y).mean() > 0.9


def brute_nearest(rows, k=5):
    """By row number: the k nearest (score, id) of each row whose id 50 divides; lengths apart, its own row left out."""
    out = {}
    for n, (q, v) in enumerate(rows):
        if q % 50 == 0:
            near = [(-float(v @ w) / float(np.sqrt((v @ v) * (w @ w))), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v)]
            out[n] = sorted((round(s, 12), i) for s, i in near)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(8)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (None, rows[1][1])]
    rows += [(50, rows[50][1]), (50, rows[50][1]), (100, rows[7][1])]  # a query's row repeated, and its id with another vector
    rows += [(2150, [1.0]), (2151, [-2.0]), (2152, [4.0]), (2200, [3e200] * 16), (2250, [2e-200] * 15 + [1e-200])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    ok = [(i, vector_search.scaled(np.array([v]))[0]) for i, v in rows if i is not None and v is not None and np.isfinite(v).all() and any(v)]
    want = collections.Counter()
    for n, near in brute_nearest(ok).items():
        if ok[n][0] != 50 or n == 50:  # equal rows are one query
            want.update((ok[n][0], r + 1, i, -s) for r, (s, i) in enumerate(near))
    assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got) == want
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 0) == [1000, 1001, 1002, 1003, 1004]
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 50)[:2] == [50, 50] and [r["vec_id"] for r in got if r["query_id"] == 2150] == [2152, 2151]
    assert vector_search.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("clusters", [40, 0])
def test_nearest_recall_with_lists(spark, clusters):
    """Over several lists: recall, exact scores, one vector on a third of the rows, and repeated rows."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(21_000, 16))
    if clusters:
        x = 0.25 * x + rng.normal(size=(clusters, 16))[rng.integers(0, clusters, len(x))]
        x[12_000:19_000] = x[7]
    x = x.astype(np.float32).astype(float)
    ids = np.arange(len(x))
    ids[20_950] = 20_900  # a repeated row
    x[20_950] = x[20_900]
    d = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(dict)
    for r in vector_search.nearest(d).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    u = vector_search.unit(x)
    hits = 0
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q in got:
        s = u @ u[q]
        s[q] = -9
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for i, score in got[q].values():
            assert abs(float(u[q] @ u[i]) - score) < 1e-12
        edge = np.sort(s)[-5]
        hits += sum(score >= edge - 1e-12 for _, score in got[q].values())
    assert hits / (5 * len(got)) >= 0.9
    if clusters:
        assert [i for i, _ in got[12_000].values()] == [7, 12_001, 12_002, 12_003, 12_004]


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=x>Home</a></header><div id="cookie-notice">We use cookies. Accept?</div>
<div class="layout with-sidebar"><div class="menu"><a>a</a></div><div class="content"><h2>The title</h2><p>One long paragraph, with &lt;words&gt; and more   words, it has many.</p>
<p>Short.</p><blockquote>He said: "hello &amp; goodbye".</blockquote><p>Another long paragraph, having text < 5 and so on.</p></div><div class="sidebar"><p>Read this too, a lot
of text here.</p></div></div><div class="comments"><p>I like it.</p></div><form>Mail <input></form><script>var a="</p>";</script><footer>c 2020</footer></body></html>"""


def test_main_text(spark):
    want = 'The title\nOne long paragraph, with <words> and more words, it has many.\nShort.\nHe said: "hello & goodbye".\nAnother long paragraph, having text < 5 and so on.'
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain text only") == "plain text only" and html_text.main_text("<p>a<b <p>c") is not None
    d = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id bigint, url string, html string")
    assert sorted(map(tuple, html_text.extract(d, ["page_id", "url"]).collect()), key=str) == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0)], key=str)


class Plain(HTMLParser):
    """The made pages' articles, written out: blocks of <article>, by the standard parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.parts, self.blocks = False, [], []
        self.feed(page)
        self.cut()

    def cut(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "a", "i", "em", "span"):
            self.cut()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "article", "h1"):
            self.cut()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_main_text_of_every_page(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = ["\n".join(Plain(p or "").blocks) for p in pages]
    assert [html_text.main_text(p) for p in pages] == want and len(pages) > 200
    monkeypatch.setattr(html_text, "THRESHOLD", 0)  # the threshold on the path ratios is what decides
    assert not any(html_text.main_text(p) == w for p, w in zip(pages, want) if p)


def test_main_text_without_telling_names():
    """Ratios alone: no article element, no class, no navigation element."""
    rng = random.Random(3)
    say = lambda: " ".join(words(rng, 12) + rng.choice([",", "."]) for _ in range(6))
    body = [say() for _ in range(9)]
    menu = "".join(f"<li><a href=x>{words(rng, 2)}</a></li>" for _ in range(8))
    page = f"<body><div><ul>{menu}</ul></div><div><div><h2>A title</h2>{''.join(f'<p>{b}</p>' for b in body)}<ul><li>one</li><li>two</li></ul><p>{body[0]}</p></div></div><div><span>Contact us</span></div></body>"
    assert html_text.main_text(page) == "\n".join(["A title", *body, "one", "two", body[0]])


def test_main_text_of_deep_pages():
    assert html_text.main_text("<div>" * 100_000 + "Deep text, with words." + "</div>" * 100_000 + "<nav>x</nav>") == "Deep text, with words."


def test_licenses(spark, odd, none):
    m = licenses.model()
    assert m.paragraph("Licensed under the Apache License, Version 2.0.")[0] == "apache-2.0"
    assert m.paragraph("This work is licensed under the GNU General Public License, version 3.")[0] == "gpl-3.0"
    assert m.paragraph("Licensed under CC BY-NC 4.0.")[0] == "cc-by-nc-4.0"
    rng = random.Random(0)
    assert m.paragraph(words(rng, 200) + " Released under the MIT License. " + words(rng, 200))[0] == "mit"
    assert m.paragraph("He lost his driving license in the general store, version of events unknown") is None and m.paragraph(words(rng, 50)) is None
    out = licenses.scan(odd.withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License."))))
    assert {r["families"] for r in out.where("n_paragraphs > 0").collect()} == {"mit"} and licenses.scan(none).count() == 0


def found_in(text):
    return [h[1] for h in licenses.model().scan(text)[1]]


def test_like_licenses_are_told_apart():
    cases = {
        "Licensed under CC BY-ND 4.0.": "cc-by-nd-4.0", "Licensed under CC BY 4.0.": "cc-by-4.0", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0",
        "GNU Affero General Public License version 3": "agpl-3.0", "GNU General Public License version 3": "gpl-3.0", "GNU General Public License version 2": "gpl-2.0",
        "GNU Lesser General Public License version 2.1": "lgpl-2.1", "Eclipse Public License 2.0": "epl-2.0", "Licensed under the ISC License.": "isc",
        "Licensed under the Apache License, Version 1.1.": "apache-1.1", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    }
    assert {t: found_in(t) for t in cases} == {t: [f] for t, f in cases.items()}
    rng = random.Random(7)
    for t, f in cases.items():
        assert found_in(words(rng, 60) + " " + t + " " + words(rng, 60)) == [f]


def test_wrapped_notices(spark):
    gpl = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation. */"""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction"
    assert found_in(gpl) == ["gpl-3.0"] and found_in(bsd) == ["bsd"] and found_in(mit) == ["mit"]
    rng = random.Random(1)
    text = words(rng, 70) + "\n\n" + words(rng, 30) + "\n" + gpl + "\n" + words(rng, 50)
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert rows[0]["families"] == "gpl-3.0" and [h["paragraph"] for h in rows[0]["hits"]] == [2] and rows[0]["n_paragraphs"] == 6


def test_every_notice_of_a_line(spark):
    rng = random.Random(2)
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    assert sorted(found_in(f"{mit} {apache}")) == ["apache-2.0", "mit"]
    assert found_in(f"{mit} {words(rng, 200)} {apache} {words(rng, 100)} {mit}") == ["mit", "apache-2.0", "mit"]
    assert found_in("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"] and found_in(apache) == ["apache-2.0"]
    for family, templates in licenses.TEMPLATES.items():
        assert all(set(found_in(t)) == {family} for t in templates if licenses.model().paragraph(t))
    row = licenses.scan(spark.createDataFrame([(1, f"{mit} {apache}")], "doc_id bigint, text string")).collect()[0]
    assert row["families"] == "apache-2.0,mit" and row["n_licenses"] == 2 and row["n_paragraphs"] == 1


def test_pipeline_against_brute_force(spark, odd):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        if name == "quality_rules":
            bad = {r["doc_id"] for r in before.collect() if brute_rules(r["text"])[0] < 10 or 100 * brute_rules(r["text"])[4] > 20 * brute_rules(r["text"])[0]}
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "simhash_near_dedup":
            sets = {r["doc_id"]: set(near_dup._shingle_set(r["text"], 5)) for r in before.collect()}
            like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            stay = {r["doc_id"] for r in kept.collect()}
            assert all(any(like(g, s) for s in sets if s != g) for g in set(sets) - stay)
            close = [(a, b) for a in stay for b in stay if a < b and like(a, b)]
            assert len(close) <= 0.05 * len(sets)
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
    pieces = c.STAGES[-1][1](spark, kept, SF)
    n = kept.count()
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count() and pieces.count() >= n


def test_license_windows_equal_a_dense_plain_scorer():
    import numpy as np

    from coterie.llm import licenses

    m = licenses.model()
    for words in (t for _, t in m.templates):
        words = ["some", "words", *words, "and", "more"]
        z = m.w.astype(float) @ m.vector(words) * m.scale
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family, got, like = m.window(words)
        assert m.families[int(p.argmax())] == family and abs(p.max() - got) < 1e-6
        assert like == max((len(b & set(licenses.grams(words))) / len(b) for f, b in m.bags if f == family), default=0.0)
