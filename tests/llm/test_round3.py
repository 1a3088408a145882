"""Alignment, divergence audit and mixing against plain versions, on given documents and on awkward ones."""

import bisect
import collections
import hashlib
import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgraph.llm import alignment, divergence, mixing
from roadgraph.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = [hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 6] for i in range(300)]
AWKWARD = [
    (1, None, "en", "a"), (None, "", "en", None), (None, "null id", None, "a"), (2, "twice the same", "en", "a"), (2, "twice the same", "en", "a"), (2, "other text, same id", "en", "b"),
    (3, "  two  spaces \n and\tends ", "", ""), (4, "émoji 😀 日本語テキスト です ﬁ é", "ja", "b"), (5, "a ▁ b", "ja", "b"), (6, "<|endoftext|> <s> <0x41>", "en", "b"), (7, "x" * 3000, "en", "c"), (8, " ", "en", "c"),
    (9, " nbsp here em \x00 nul", "en", "c"), (10, "don't we've 12345 !!! ... \r\n\r\n  end", "en", "c"), (11, "ÄÖ äö ABC abc Straße", "de", "a"), (12, "abc äö abc", "de", "b"), (13, "abc straße ÄÖ", "de", "b"),
]


def awkward(spark, rng):
    more = [(100 + i, " ".join(rng.choices(WORDS[:60], k=rng.randrange(1, 40))), rng.choice(["en", "de"]), rng.choice("abcd")) for i in range(60)]
    more += [(200, " ".join(rng.choices(WORDS, k=20_000)), "en", "a")]
    rows = AWKWARD + more
    # columns whose names clash with those that the operators make
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("n", "block", "pair", "term", "place", "size", "quota", "text_no"))), rows


def result(df, *keys):
    return sorted(map(tuple, df.collect()), key=repr)


# alignment -----------------------------------------------------------------------------------------------------------
def plain_alignment(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of (id, text), with the vocabularies' own readers and sets."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        entries = {i: e for e, i in json.load(f)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    bytes_a = lambda i: bytes(back[c] for c in entries[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], collections.Counter()
    for _, text in rows:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            want = (" " + text).encode()
            if b"".join(map(bytes_a, ia)) == want == b"".join(map(bytes_b, ib)):
                ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, ia), (bytes_b, ib))]
                p = q = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    r, s = (bisect.bisect_right(e, cut) for e in ends)
                    groups.append((ia[p:r], ib[q:s]))
                    p, q = r, s
        docs.append(groups)
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = collections.Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), groups in zip(rows, docs, strict=True):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == top[x[0]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr), counts, top


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_awkward_texts(spark, monkeypatch, small):
    if small:  # hot pairs, many blocks; the worker sees these as arguments of the plan only where they are used on the driver
        monkeypatch.setattr(alignment, "HOT_ROWS", 1)
    docs, rows = awkward(spark, random.Random(3))
    found, links = alignment.align_documents(docs)
    want, counts, top = plain_alignment([(r[0], r[1]) for r in rows])
    assert result(found) == want
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in links.collect()} == {k: (n, n == top[k[0]]) for k, n in counts.items()}


def test_alignment_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_alignment"](spark, DATA)) == plain_alignment(rows)[0]


def test_alignment_takes_any_id_and_an_empty_table(spark):
    docs = spark.createDataFrame([("x", "some words"), (None, "some words"), ("y", None)], "doc_id string, text string")
    found = {r.doc_id: r for r in alignment.align_documents(docs)[0].collect()}
    assert found["x"][1:] == found[None][1:] and found["x"].count_sum == 2 * found["x"].n_links and found["y"][1:] == (0, 0, 0, 0, 0, 0, "")
    found, links = alignment.align_documents(docs.limit(0))
    assert found.count() == 0 and links.count() == 0


def test_lockstep_equals_set_intersection():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 400))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in range(2))
        common = np.intersect1d(a, b)
        some = common[:-1][rng.random(len(common) - 1) < 0.2]
        lanes = [np.append(0, np.searchsorted(x, some) + 1) for x in (a, b)]
        got = alignment.lockstep(a, b, *lanes)
        assert (a[got[1] - 1] == common).all() and (b[got[3] - 1] == common).all()
        assert (got[0][1:] == got[1][:-1]).all() and (got[2][1:] == got[3][:-1]).all()


def test_types_of_equal_codes_are_told_apart(monkeypatch):
    monkeypatch.setattr(alignment, "_MIX_A", np.uint64(0))
    monkeypatch.setattr(alignment, "_MIX_B", np.uint64(0))
    ids_a, ids_b = np.array([1, 2, 1, 3], np.int32), np.array([5, 6, 5, 5], np.int32)
    groups = np.array([[0, 1, 2, 3], [1, 2, 3, 4], [0, 1, 2, 3], [1, 2, 3, 4]])
    first, kind = alignment._types(ids_a, ids_b, groups)
    assert kind.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_alignment_of_a_very_long_text_stays_small(tmp_path):
    """5 MB in one document: the worker's own memory, measured in a process of its own."""
    import subprocess
    import sys

    code = (
        "import resource, random, hashlib\nfrom roadgraph.llm import alignment as A\nr = A.Reader('byte_bpe_50k.json', 'piece_bpe_32k.model')\n"
        "w = [hashlib.md5(str(i).encode()).hexdigest()[:3 + i % 6] for i in range(5000)]\nt = ' '.join(random.Random(1).choices(w, k=800_000))\n"
        "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nx = A.align_block([t], r)\nprint(len(t), x['n_a'][0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(said[0]) > 5e6 and int(said[1]) > 1e6 and int(said[2]) < 1000


# divergence ----------------------------------------------------------------------------------------------------------
def plain_terms(text):
    own, out = "", []
    for c in (text or "") + " ":
        if ord(c) >= 128 or c.isascii() and c.isalpha():
            own += c.lower() if ord(c) < 128 else c
        elif own:
            out.append(own)
            own = ""
    return out


def plain_audit(rows, top=200):
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        words = plain_terms(text)
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {k[0] for k in groups}:
        kept = {t for t, n in docs[lang].items() if n >= 3}
        own = {s: {t: c[t] for t in kept} for (l, s), c in groups.items() if l == lang}
        of = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p = {s: of(c) for s, c in own.items()}
        q = of({t: sum(c[t] for c in own.values()) for t in kept})
        for s, c in own.items():
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if c[t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], k + 1) for part, found in (("pair", pair), ("term", term)) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_audit_of_awkward_rows(spark, bits):
    """Also with a bit table in which nearly all prefixes collide."""
    docs, rows = awkward(spark, random.Random(5))
    long_ones = [(300 + i, "q" * 700 + " " + "q" * 699 + "z" * i, "en", "d") for i in range(4)]
    own = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(long_ones, SCHEMA)).withColumn("prefix", F.lit(1)).withColumn("value", F.lit(2))
    assert sorted(map(tuple, divergence.audit(own, top=7, n_bits=bits).collect())) == plain_audit(rows + long_ones, 7)


def test_audit_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(tuple, QUERIES["op12_divergence"](spark, DATA).collect())) == plain_audit(rows)


def test_audit_discards_prefixes_level_by_level(spark):
    """A prefix that too few documents share is not extended: later levels see only what begins with a survivor."""
    docs = [{"abcd", "abce", "xy"}, {"abcd", "abcf"}, {"abcd", "zz"}]
    words = sorted(set().union(*docs))
    term, doc = zip(*((words.index(w), i) for i, d in enumerate(docs) for w in sorted(d)), strict=True)
    as_bytes = lambda x: np.array(x, np.uint32).tobytes()
    row = {"lang": "en", "terms": " ".join(words).encode(), "sources": ["a"], "of_doc": as_bytes([0, 0, 0]), "term": as_bytes(term), "doc": as_bytes(doc), "n": as_bytes([1] * len(doc))}
    seen = lambda before, length, bits: {r["prefix"]: r["docs"] for b in divergence._count_block(row, before, length, bits) for r in b.to_pylist()}
    assert seen(0, 2, None) == {b"ab": 3, b"xy": 1, b"zz": 1}
    bits = np.zeros(1 << 14, np.uint64)
    k = divergence._bit(b"en", b"ab", 1 << 20)
    bits[k >> 6] = np.uint64(1) << np.uint64(k & 63)
    assert seen(2, 4, bits) == {b"abcd": 3, b"abce": 1, b"abcf": 1}
    assert divergence.terms_of("AbÄb c1d".encode()) == {"abÄb".encode(): 1, b"c": 1, b"d": 1}


def test_audit_of_an_empty_table_and_texts_without_terms(spark):
    docs = spark.createDataFrame([(1, "12 34", "en", "a"), (2, None, "en", "b"), (3, "", None, None)], SCHEMA)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.limit(0)).count() == 0


# mixing --------------------------------------------------------------------------------------------------------------
def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def check_mix(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    target = plain_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) <= 1e-9 * max(1, r.target)
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.004 * t), (s, taken[s], t)


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows)
    again = mixing.mix_documents(docs.repartition(7, "n_chars")).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_in_shards_with_hot_rows(spark, monkeypatch):
    """Nulls, empty texts, one row a thousand times, several shards; the blocks that are listed add up to what is taken."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 200)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs, _ = awkward(spark, random.Random(7))
    hot = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text in most rows").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    mixed = mixing.mix_documents(docs.select("doc_id", "text", "lang", "source").union(hot).withColumn("size", F.lit(1)).withColumn("shard", F.lit("x")))
    rows = mixed.collect()
    assert len(rows) == docs.count() + 1000
    check_mix(rows)
    shards = collections.Counter(r.shard for r in rows if r.source == "a")
    assert len(shards) >= 5 and max(shards.values()) < 300
    listed = mixing.selected_blocks(mixed).groupBy("source").agg(F.sum(F.col("n_words") * F.col("times")).alias("x"), F.max("times").alias("t")).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert {r.source: r.x for r in listed} == {s: n for s, n in taken.items() if n} and max(r.t for r in listed) == 2


def test_mixing_of_an_empty_table_and_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", None)], SCHEMA)
    assert sorted(r.taken for r in mixing.mix_documents(docs).collect()) == [0, 0]
    assert mixing.mix_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_apportion_is_sainte_lague(spark, seed):
    rng = random.Random(seed)
    parties = [(g, i, float(rng.choice([rng.randrange(1, 30), rng.randrange(1, 3000)]))) for g in range(3) for i in range(rng.randrange(1, 40))]
    seats = {g: rng.randrange(0, 400) for g in range(3)}
    df = spark.createDataFrame([(*p, seats[p[0]]) for p in parties], "g int, i int, w double, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "i", "w", "seats").collect()}
    want = dict.fromkeys(((g, i) for g, i, _ in parties), 0)
    for g in range(3):
        own = [p for p in parties if p[0] == g]
        for _ in range(seats[g]):
            best = min(own, key=lambda p: (-p[2] / (2 * want[p[:2]] + 1), p[1]))
            want[best[:2]] += 1
    assert got == want


@pytest.mark.parametrize("name", ["op12_divergence", "op13_mixing"])
def test_queries_equal_their_sql(spark, name):
    from roadgraph.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
