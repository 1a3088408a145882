"""Each training-data operator on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roadgraph.llm.common import row_key
from roadgraph.llm import decontamination, exact_dedup, html_text, kd_sharding, language_id, packing, pii, quality, set_join, substring_dedup

DATA = "/root/testdata/sf0.001"
random.seed(5)
VOCAB = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(random.choices(VOCAB, k=n))


LONG = prose(40_000)
BASE = prose(300)
NEAR = " ".join(w if i != 150 else "changed" for i, w in enumerate(BASE.split()))
PASSAGE = prose(60)
TEXTS = [None, "", " \t\n", BASE, BASE, NEAR, BASE.replace(" ", "  "), LONG, LONG[:-9], "one", "one two", "Two\x0bwords", prose(50) + " " + PASSAGE, PASSAGE + " " + prose(50), "ünïcode ßtraße 東京 " * 40, "a " * 500]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, 1, 2, "x", 3) for i, t in enumerate(TEXTS)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h int, n int, token string, chunk int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t):
    return (t or "").encode().split()


def test_language_id(docs):
    langs, protos = language_id.learn(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("en")))
    assert langs == ["en", "xx"]
    got = by_id(language_id.predict(docs, langs, protos))
    assert len(got) == len(TEXTS)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9].lang_pred in langs
    assert {r.lang_pred for r in language_id.predict(docs, *language_id.learn(docs.limit(0))).collect()} == {"und"}


def test_language_id_held_out(spark):
    got = language_id.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


@pytest.mark.parametrize("n", [1, 4, 24])
def test_sharding(docs, n):
    got = kd_sharding.kd_shards(docs, n_shards=n).toPandas()
    assert len(got) == len(TEXTS) + 1 and got["shard"].between(0, n - 1).all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS)}
    assert all((r.size, r.text_crc32) == want[r.doc_id] for r in got.itertuples())


def test_sharding_is_even_and_keeps_copies(spark):
    rows = [(i, prose(40) if i % 3 else "copy of a text " * 5, "en", f"s{i % 2}") for i in range(1200)]
    got = kd_sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), target_bytes=30_000).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.min() < 1.1 and sizes.max() < 33_000
    assert got[got.doc_id % 3 == 0]["shard"].nunique() <= 3


def test_no_rows(docs):
    none = docs.limit(0)
    items = none.select(F.col("doc_id").alias("item_id"), "text")
    for out in (
        kd_sharding.kd_shards(none, n_shards=4), packing.pack_documents(none), substring_dedup.without_repeats(none), pii.find_pii(none), decontamination.contaminated(docs, items),
        decontamination.contaminated(none, items), exact_dedup.exact_dedup(none), set_join.similar_groups(none), quality.score(none, None),
        html_text.extract_text(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))),
    ):
        assert out.count() == 0


def test_packing(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs.dropDuplicates(["doc_id"])).toPandas()
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = got[got.doc_id == i].sort_values("piece")
        assert list(own["start"]) == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
        assert (own["length"].iloc[1:] == 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048


def test_best_fit():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 5, 4, 5, 7, 8, 3, 9)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (3, 0), (2, 7), (4, 0)]
    assert fit.open == 2 and fit.put(9) == (5, 0)  # the fullest went


def brute_repeats(texts, window):
    first, out = {}, {}
    for i, t in enumerate(texts):
        for s in range(len(words(t)) - window + 1):
            first.setdefault(tuple(words(t)[s : s + window]), (i, s))
    for i, t in enumerate(texts):
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_dedup(docs):
    got = by_id(substring_dedup.without_repeats(docs, shard_words=500))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute_repeats(TEXTS, 20)


def test_substring_dedup_of_many_mutations(spark):
    base = [prose(200) for _ in range(4)]
    texts = [" ".join(w if random.random() > 0.02 else random.choice(VOCAB) for w in random.choice(base).split()) for _ in range(120)]
    got = by_id(substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_words=2000))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute_repeats(texts, 20)


@pytest.mark.parametrize("window", [32, 50])
def test_substring_dedup_of_wide_windows(spark, window):
    base = prose(400)
    texts = [" ".join(w if random.random() > 0.01 else random.choice(VOCAB) for w in base.split()) for _ in range(40)]
    got = by_id(substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=window, shard_words=2000))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute_repeats(texts, window)


@pytest.mark.parametrize("few", [0, 100_000])
def test_substring_dedup_of_repeated_and_null_ids(spark, monkeypatch, few):
    """Rows with one id, or none, and different texts are documents of their own, in the order of a hash."""
    monkeypatch.setattr(substring_dedup, "FEW", few)
    shared = prose(60)
    texts = [(7, shared), (7, prose(2)), (None, prose(30) + " " + shared), (None, prose(40)), (None, shared + " " + prose(9)), (3, shared), (7, shared), (9, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ties = {t: h for t, h in df.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted({(i if i is not None else -(2**63), ties[t] if i in (7, None) else 0, t or "") for i, t in texts})
    want = brute_repeats([t for _, _, t in order], 20)
    want = {(i, t): want[k] for k, (i, _, t) in enumerate(order)}
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.without_repeats(df).collect())
    assert got == sorted((str(i), *want[(i if i is not None else -(2**63), t or "")]) for i, t in texts)


def test_substring_dedup_of_a_hot_passage(spark):
    """A passage in every text with other words around it: its anchors fill many shards, are cut again and parted into blocks."""
    few = VOCAB[:6]
    passage = prose(45)
    texts = [" ".join(random.choices(few, k=random.randint(1, 4))) + " " + passage + " " + " ".join(random.choices(few, k=random.randint(1, 6))) + " " + prose(10) for _ in range(400)]
    got = by_id(substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_words=300))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute_repeats(texts, 20)


def test_an_anchor_of_many_wordings_is_parted(spark, monkeypatch):
    """50,000 wordings of one anchor never meet in one index."""
    import pyarrow as pa

    seen = []
    make = substring_dedup.Shard.__init__
    monkeypatch.setattr(substring_dedup.Shard, "__init__", lambda self, own, window: (seen.append(sum(len(p[3]) + 1 for p in own)), make(self, own, window))[1])
    n, window, most = 50_000, 20, 100_000
    rng = random.Random(1)
    core = prose(19).encode()
    rows = [(1, k % 13, True, other, i, 0, 0, b" ".join([core, str(i % 9_000).encode()])) for k in range(13) for other in (False, True) for i in range(n) if (i % 13 == k) != other]
    cols = list(zip(*rows))
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["anchor", "block", "parted", "other", "doc_id", "tie", "start", "text"])
    found = {d for b in substring_dedup._resolve(window, most)(iter([batch])) for d in b.column("doc_id").to_pylist()}
    assert found == set(range(9_000, n)) and len(seen) == 13 and max(seen) < most and rng


def test_matching_statistics():
    import numpy as np

    from roadgraph.llm.fm_index import FMIndex

    rng = random.Random(3)
    text = [rng.randint(1, 6) if rng.random() > 0.05 else 0 for _ in range(800)] + [0]
    query = [rng.choice([1, 2, 3, 4, 5, 6, 9, -1]) for _ in range(300)]
    index = FMIndex(np.array(text), 4)
    cuts = [0, 40, 41, 160, 300]
    size, low, high = index.matching(np.array(query), np.array(cuts[1:]), np.diff(cuts))
    where = {}
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            where.setdefault(tuple(text[i : i + n]), []).append(i)
    for a, b in zip(cuts, cuts[1:]):
        for i in range(a, b):
            n = 0
            while n < 4 and i + n < b and tuple(query[i : i + n + 1]) in where:
                n += 1
            assert size[i] == n
            assert not n or high[i] - low[i] == len(where[tuple(query[i : i + n])])
            assert n < 4 or index.earliest(low[i : i + 1])[0] == min(where[tuple(query[i : i + n])])


def test_pii(spark):
    texts = [
        None, "", "write to Ann.Lee+x@mail.example.org, or a@b", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "host 10.0.0.255 and 10.0.0.256 v1.2.3.4.5.6.7.8",
        "call +1 (415) 555-0100 now, +12", "IBAN GB82 WEST 1234 5698 7654 32 ok, DE89370400440532013001", "ssn 123-45-6789 000-12-3456", "é" * 50 + " a@b.co " + "x@" * 2000, "1 " * 30_000,
        ("a.b@c.de ") * 1500, "my iban DE89370400440532013000 and my social security 123-45-6789", "a sample DE89370400440532013000, part 123-45-6789, order 4111111111111111",
    ]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.value) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == got[9] == []
    assert [x[3] for x in got[11]] == ["DE89370400440532013000", "123-45-6789"] and [x[0] for x in got[12]] == ["card"]
    assert got[2] == [("email", 9, 35, "Ann.Lee+x@mail.example.org")]
    assert got[3] == [("card", 5, 24, "4111 1111 1111 1111")]
    assert [x[3] for x in got[4]] == ["10.0.0.255", "1.2.3.4", "5.6.7.8"]
    assert got[5] == [("phone", 5, 22, "+1 (415) 555-0100")]
    assert [x[:1] + x[3:] for x in got[6]] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert [x[3] for x in got[7]] == ["123-45-6789"]
    assert got[8][0] == ("email", 51, 57, "a@b.co")
    assert len(got[10]) == 1500 and all(texts[10][s:e] == v for _, s, e, v in got[10])


def test_decontamination(spark, docs):
    item = PASSAGE.upper().replace(" ", ", ")
    items = spark.createDataFrame([(1, item), (2, prose(40)), (3, None), (4, "too short"), (5, PASSAGE + " " + prose(200)), (1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared, r.containment) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(12, 1): (56, 56, 1.0), (13, 1): (56, 56, 1.0)}
    part = " ".join(PASSAGE.split()[:30])
    near = spark.createDataFrame([(1, part), (2, LONG + " " + PASSAGE)], "doc_id long, text string")
    assert [(r.doc_id, r.n_shared) for r in decontamination.contaminated(near, items.filter("item_id = 1")).collect()] == [(2, 56)]


def test_decontamination_by_short_items(spark):
    """Every text holds one item of 5 to 10 words, at a place of its own."""
    parts = {n: prose(n) for n in range(5, 11)}
    rows = [(n_words * 1000 + n * 100 + i, prose(n_words // 3) + " " + part + " " + prose(n_words)) for n_words in (500, 1000, 20_000) for n, part in parts.items() for i in range(8 if n_words < 5000 else 2)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    long_item = (99, prose(200))
    got = decontamination.contaminated(texts, spark.createDataFrame([*parts.items(), long_item], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.containment for r in got} == {(i, i % 1000 // 100 or 10): 1.0 for i, _ in rows}


def shingles_of(text, k=5):
    w = [x for x in __import__("re").split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 0, "broadcast_texts": 0}])
def test_decontamination_recall(spark, how):
    """Items of 52 to 200 words of which texts of 100 to 20,000 words hold a share around 0.8: by broadcast and by shuffle."""
    items = {n: prose(52 + n % 149) for n in range(300)}
    rows = []
    for n, item in items.items():
        words = item.split()
        parts = " ".join(words[: int(len(words) * random.uniform(0.78, 0.95))])
        rows.append((n if n % 10 else None, prose(n) + " " + parts + " " + prose((100, 1000, 20_000)[n % 97 % 3] if n % 30 == 0 else 100)))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), **how).collect()}
    want = {(rows[n][0], n) for n, item in items.items() if len(shingles_of(item) & shingles_of(rows[n][1])) >= 0.8 * len(shingles_of(item))}
    assert len(want) > 200 and got <= want and len(got) >= 0.99 * len(want)


def brute_dedup(texts):
    norm = {i: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r") for i, t in enumerate(texts)}
    groups = {}
    for i, n in norm.items():
        groups.setdefault(n, []).append(i)
    best = {n: min(g, key=lambda i: (-len(texts[i] or ""), i)) for n, g in groups.items()}
    return {i: (best[n], i == best[n], hashlib.sha256(n.encode()).hexdigest()) for i, n in norm.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    """weak: a hash with few values, so that groups hold different texts and bytes must tell them apart."""
    how = {"content_hash": lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)} if weak else {}
    rows = exact_dedup.exact_dedup(docs, **how).collect()
    assert len(rows) == len(TEXTS) + 1
    assert {r.doc_id: (r.keep_id, r.kept, r.text_sha256) for r in rows} == brute_dedup(TEXTS)
    assert {r.doc_id: r.group_size for r in rows}[3] == 4


def brute_groups(texts):
    def shingles(t):
        w = [x.lower() for x in words(t)]
        return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return {i: (len(s), up[i]) for i, s in enumerate(sets)}


def test_set_join(docs):
    got = by_id(set_join.similar_groups(docs))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_groups(TEXTS)


def test_set_join_of_repeated_and_null_ids(spark):
    """Rows with one id, or none, and different texts are documents of their own; each has a near copy elsewhere."""
    a, b = prose(200), prose(200)
    near = lambda t: " ".join(w if i != 9 else "changed" for i, w in enumerate(t.split()))
    rows = [(None, a), (None, b), (7, near(a)), (8, near(b)), (9, prose(80)), (9, prose(80)), (9, ""), (None, None), (None, prose(50)), (8, near(b))]
    got = set_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), keyed=True).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.first) for r in got) == sorted([
        ("None", 198, "7", False), ("None", 198, "8", False), ("7", 198, "7", True), ("8", 198, "8", True), ("8", 198, "8", True), ("9", 78, "9", True), ("9", 78, "9", True),
        ("9", 0, "9", True), ("None", 0, "None", True), ("None", 48, "None", True)])


@pytest.mark.parametrize("cell", [8192, 16])
def test_set_join_in_cells(spark, monkeypatch, cell):
    """Texts that all share their rarest words but are no near copies of their leader: long lists, also parted into blocks."""
    monkeypatch.setattr(set_join, "CELL", cell)
    base = prose(90).split()
    texts = [" ".join(w if random.random() > rate else random.choice(VOCAB) for w in base) for rate in (0.01, 0.03, 0.05) for _ in range(50)]
    got = by_id(set_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_groups(texts)


def test_pairs_between_groups_grow_with_the_smaller_groups():
    """All pairs but those within the largest group, each once; its members cost nothing but their place."""
    import numpy as np

    rng = np.random.default_rng(3)
    cell = np.sort(rng.integers(0, 5, 300))
    c = {"cell": cell, "n": np.concatenate([np.sort(rng.integers(80, 120, (cell == x).sum())) for x in range(5)]), "group": rng.integers(0, 4, 300) * rng.integers(0, 2, 300)}
    got = [(a, b) for i, j in set_join.between_groups(c, 90) for a, b in zip(i.tolist(), j.tolist())]
    main = {x: np.bincount(c["group"][cell == x]).argmax() for x in range(5)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cell[i] == cell[j] and 90 * c["n"][j] <= 100 * c["n"][i] and not c["group"][i] == c["group"][j] == main[cell[i]]}
    assert len(got) == len(set(got)) and {(i, j) for i, j in got if c["group"][i] != c["group"][j]} == {(i, j) for i, j in want if c["group"][i] != c["group"][j]}
    big = {"cell": np.zeros(200_000, np.int64), "n": np.full(200_000, 100), "group": np.r_[np.zeros(199_990, np.int64), np.arange(1, 11)]}
    assert sum(len(i) for i, _ in set_join.between_groups(big, 90)) == 199_990 * 10 + 45


@pytest.mark.parametrize("n_groups", [1, 2, 10])
def test_groups_are_met_by_their_representatives(n_groups):
    """Groups of near copies with one common token: no member is met by another group's, however many there are."""
    import numpy as np

    rng = np.random.default_rng(n_groups)
    for members in (4_000, 8_000):
        base = rng.integers(-(2**63), 2**63 - 1, (n_groups, 4))
        group = rng.integers(0, n_groups, members)
        sketch = base[group]
        sketch[np.arange(members), rng.integers(0, 4, members)] ^= 1 << rng.integers(0, 62, members)  # one parity differs
        c = {"cell": np.zeros(members, np.int64), "n": np.sort(rng.integers(200, 210, members)), "group": group} | {f"k{x}": np.ascontiguousarray(sketch[:, x]) for x in range(4)}
        assert sum(len(i) for i, _ in set_join.between_groups(c, 90)) == 0


def test_no_pair_that_sketches_allow_is_passed_over():
    import numpy as np

    rng = np.random.default_rng(5)
    cell = np.sort(rng.integers(0, 3, 700))
    group = rng.integers(0, 4, 700)
    sketch = rng.integers(-(2**63), 2**63 - 1, (1, 4)) ^ (1 << rng.integers(0, 62, (4, 4)))[group] ^ (1 << rng.integers(0, 62, (700, 4)))
    sketch[::3] = rng.integers(-(2**63), 2**63 - 1, (len(sketch[::3]), 4))
    n = np.concatenate([np.sort(rng.integers(150, 200, (cell == x).sum())) for x in range(3)])
    c = {"cell": cell, "n": n, "group": group} | {f"k{x}": np.ascontiguousarray(sketch[:, x]) for x in range(4)}
    got = [(a, b) for i, j in set_join.between_groups(c, 90) for a, b in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and all(i < j and cell[i] == cell[j] for i, j in got)
    apart = lambda i, j: sum(int(np.bitwise_count(np.uint64(int(sketch[i, x] ^ sketch[j, x]) & (2**64 - 1)))) for x in range(4))
    slack = lambda i, j: int(n[i] + n[j]) - 2 * -(-90 * int(n[i] + n[j]) // 190)
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if cell[i] == cell[j] and group[i] != group[j] and 90 * n[j] <= 100 * n[i] and apart(i, j) <= slack(i, j)}
    assert want and want <= set(got)


@pytest.mark.parametrize("percent", [60, 85, 90, 97])
def test_linked_sets_have_a_part_in_common(percent):
    """Pairs around the threshold: linked ones share an entry of the index. Of sets that only share a passage few do."""
    import numpy as np

    rng = np.random.default_rng(percent)
    drawn = lambda n: rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    linked = 0
    for n in np.r_[rng.integers(1, 40, 500), rng.integers(40, 900, 500)].tolist():
        a = np.unique(drawn(n))
        loss, gain = rng.integers(0, max(2, n * (100 - percent) // 80), 2).tolist()
        b = np.unique(np.r_[rng.permutation(a)[loss:], drawn(gain)])
        o = len(np.intersect1d(a, b))
        if o and 100 * o >= percent * (len(a) + len(b) - o) and not np.array_equal(a, b):
            linked += 1
            assert len(np.intersect1d(*set_join.indexed([a, b], percent)))
    assert linked > 100
    if percent >= 90:
        passage = drawn(100)
        x = set_join.indexed([np.unique(np.r_[passage, drawn(200)]) for _ in range(100)], percent)
        assert sum(len(np.intersect1d(x[i], x[j])) > 0 for i in range(100) for j in range(i)) < 50


@pytest.mark.parametrize("rows", [1, 3, 50_000])
def test_lists_pass_through_whatever_the_batches(monkeypatch, rows):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(set_join, "NARROW", rows)
    rng = np.random.default_rng(rows)
    entries = sorted({(int(t), int(c)) for t, c in zip(rng.integers(0, 60, 200), rng.integers(0, 40, 200), strict=True)} | {(7, c) for c in range(50)})
    repeated = sorted(entries + entries[::5])
    batch = pa.table({"token": [t for t, _ in repeated], "rank": [c for _, c in repeated]}).to_batches(max_chunksize=2)
    got = sorted(tuple(r.values()) for b in set_join._led(iter(batch)) for r in b.to_pylist())
    lists = {t: [c for u, c in entries if u == t] for t, _ in entries}
    assert got == sorted((t, own[0], c) for t, own in lists.items() if len(own) > 1 for c in own)


def test_set_join_of_many_near_copies(spark):
    base = [prose(n) for n in (60, 150, 400)]
    texts = [" ".join(w if random.random() > rate else random.choice(VOCAB) for w in random.choice(base).split()) for rate in (0.004, 0.01, 0.02, 0.04) for _ in range(60)]
    texts += [PASSAGE + " " + prose(random.randint(5, 300)) for _ in range(60)]
    got = by_id(set_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_groups(texts)


def test_set_join_of_copies_with_additions(spark):
    """Each text has one copy with words that occur nowhere else, appended, inserted or in the place of others."""
    texts = []
    for n in (97, 200, 500):
        for percent in range(1, 11):
            new = [f"new{n}x{percent}x{i}" for i in range(max(1, n * percent // 100))]
            for how in ("append", "insert", "replace"):
                own = prose(n).split()
                at = n if how == "append" else n // 2
                texts += [" ".join(own), " ".join(own[:at] + [f"{how}{x}" for x in new] + own[at + (len(new) if how == "replace" else 0) :])]
    got = by_id(set_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_groups(texts)


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.op4_quality(spark, DATA).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()
    assert (rows.predicted == rows.quality).mean() > 0.8
    got = quality.score(docs, quality.learn(spark.read.parquet(f"{DATA}/documents.parquet"), labels)).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in got)
    assert quality.learn(docs, labels.limit(0)) is None
    assert quality.keep_good(docs, None).count() == len(TEXTS) + 1
    assert list(quality.isotonic(*map(__import__("numpy").array, ([1, 1, 2, 1], [1, 0, 1, 1])))) == [0.5, 0.5, 0.5, 1]


PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>x<li>y<ol start=3><li>z</ol></ul>tail": "- x\n- y\n  3. z\n\ntail",
    "<table><tr><th>Name<th>N<tr><td>Alpha<td>1<tr><td colspan=2>wide</table>": "Name   N\nAlpha  1\nwide",
    '<div hidden>no</div><div style="display : NONE">no</div><script>if (a<b) "</p>"</script><!-- no -->yes': "yes",
    "<pre>a  b\n c</pre>": "a  b\n c",
    "x<br>y &amp; z &lt;b&gt;": "x\ny & z <b>",
    "<b>bold</b> and <i>it</i>alic": "bold and italic",
    "3 < 4 and 5 > 2": "3 < 4 and 5 > 2",
    "<p>open <b>never closed": "open never closed",
    "<details><summary>s</summary>body</details><select><option>1<option>2</select>": "s\n1\n2",
    "": "",
    "plain": "plain",
    "<div>" * 5000 + "deep": "deep",
}


def test_html_text(spark):
    rows = [(i, p) for i, p in enumerate(PAGES)] + [(99, None)]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    for i, (page, want) in enumerate(PAGES.items()):
        assert got[i].text == want, page[:60]
    assert got[99].text == "" and got[99].n_lines == 0


def plain_stages(spark, docs, model, items):
    """What each stage keeps, as lists of (doc_id, text, other columns), with plain Python."""
    last = lambda i: (i is None, i or 0)
    key = {(r.doc_id, r.text): bytes(r.k) for r in docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    rows = [tuple(r) for r in docs.collect()]
    good = [r for r in rows if model is None or model.score(quality._stack([r[1]]))[0] >= quality.THRESHOLD]
    by_norm = {}
    for r in good:
        by_norm.setdefault("".join(c for c in (r[1] or "") if c not in " \t\n\x0b\x0c\r"), []).append(r)
    exact = [min(g, key=lambda r: (-len(r[1] or ""), last(r[0]), key[r[:2]])) for g in by_norm.values()]
    groups = brute_groups([r[1] for r in exact])
    of = {}
    for k, r in enumerate(exact):
        of.setdefault(groups[k][1], []).append(r)
    near = [min(g, key=lambda r: (last(r[0]), key[r[:2]])) for g in of.values()]
    wanted = [shingles_of(t or "") for t in items]
    clean = [r for r in near if not any(w and len(w & shingles_of(r[1] or "")) >= 0.8 * len(w) for w in wanted)]
    return good, exact, near, clean


def check_stages(spark, docs, sf_dir, model, items):
    """All five stages, each on what the one before it kept, row for row."""
    import corpus_pipeline as c

    kept = docs
    for (name, stage), want in zip(c.STAGES, plain_stages(spark, docs, model, items)):
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
        kept = set_join.stored(kept, "test")
        assert sorted(str(r[:2]) for r in map(tuple, kept.collect())) == sorted(str(r[:2]) for r in want), name
    packed = c.STAGES[4][1](spark, kept, sf_dir).toPandas()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    lengths = sorted((-1 if i is None else i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in kept.select("doc_id", "text").collect())
    pieces = packed.fillna({"doc_id": -1})
    assert sum(n for _, n in lengths) == pieces["length"].sum() and len(pieces) == sum(-(-n // 2048) for _, n in lengths)
    assert set(pieces["doc_id"].astype(int)) == {i for i, _ in lengths}
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    return packed


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fitted(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    packed = check_stages(spark, docs, DATA, model, items)
    assert sorted(c.run(spark, DATA).toPandas()["doc_id"]) == sorted(packed["doc_id"])


def test_pipeline_of_nulls_repeats_and_ties(spark, tmp_path):
    """No label matches, so stage 1 keeps all. Null ids with texts of their own stay; of repeated ids every text counts."""
    item = prose(40)
    near = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    a, b, c, d = (prose(n) for n in (120, 150, 90, 60))
    texts = [
        (None, a), (None, b), (None, c), (1, a), (2, "  " + b), (3, c + "\n"), (3, d), (3, near(d, 5)), (3, d), (None, d), (4, near(a, 7)), (None, near(b, 9)), (None, prose(30)), (None, prose(30)),
        (5, prose(20) + " " + item), (None, item.upper() + " " + prose(9)), (6, None), (6, ""), (None, None), (None, " \t"), (7, "one"), (8, "one two"), (8, "one two"), (9, LONG), (9, LONG[:-7]),
    ]
    rows = [(i, t, 1, "x", None, k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_of_id int, chosen_id string, h string, row_key long")
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check_stages(spark, docs, str(tmp_path), None, [item])
    check_stages(spark, docs.limit(0), str(tmp_path), None, [item])
