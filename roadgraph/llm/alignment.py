"""Cross-tokenizer alignment: lockstep vectorised merging of two tokenisations, and corpus-wide counts of linked ids.

1. A pass over the texts encodes each with both vocabularies and merges their tokens by byte offsets. All documents of a block
   advance together: a state array has one column for every lane (a document, or a run of a long one that begins at a common cut)
   with its places in A and B. A step compares where the two current tokens end, moves A, B or both, and where both end
   closes a group: the cut, and the ranges of A and B tokens that are linked with each other. Lanes that are done leave
   the array. Equal groups of a block are one type; a document keeps its types, a block the id pairs of its types,
   and, for every pair, in how many of its documents it is linked.
2. Spark sums these into corpus-wide counts and the highest count of each A id.
3. Counts go back to the blocks by pair (a pair is one row for each block, hot pairs are broadcast, of which there are few by
   definition) and are summed for types and documents, a block at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, small_batches, stored, table, text_of

#: Text and documents of a block.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 8192
#: Words of a lane, about: a longer document has several.
LANE = 32
#: Words that a worker remembers with their tokens, the longest of them in bytes, and the tokens it remembers for all.
CACHE = 300_000
LONGEST = 64
CACHE_TOKENS = 4_000_000
#: A pair that is in more blocks than this, and in more than this share of all rows of pairs, is hot; so at most 1 / HOT_SHARE are.
HOT_ROWS = 10_000
HOT_SHARE = 1e-4
#: Pairs of ids that are expanded at once.
EXPANDED = 4_000_000

KEPT = "block long, text_no int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, types binary, times binary, pair long, pos int, docs long, type_n binary, type_pos binary, type_times binary"
#: A word: cut at single spaces between other characters than blanks. Neither vocabulary has a token across such a cut.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_state: dict = {}


class Reader:
    """Words to tokens of both vocabularies. Tokens of all words met lie one after another in pools; a word is its number."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece

        place = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.encode_a, self.bytes_a = _byte_level(place(a))
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(b))
        byte = lambda piece: bytes([int(piece[1:-1], 16)])
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.bytes_b = [byte(p) if self.b.is_byte(i) else p.encode().replace(b"\xe2\x96\x81", b" ") for i, p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ok: list[bool] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.ids_a = np.zeros(0, np.int32)
        self.ids_b = np.zeros(0, np.int32)

    def add(self, words: list[str]) -> dict[str, int]:
        """Numbers of words that are not remembered yet; long ones are forgotten after this block."""
        got_a = self.encode_a([" " + w for w in words])
        got_b = self.b.encode(words, num_threads=1)
        first = len(self.ok)
        for w, a, b in zip(words, got_a, got_b, strict=True):
            data = b" " + w.encode("utf-8", "surrogatepass")
            self.ok.append(b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b]))
            self.n_a.append(len(a))
            self.n_b.append(len(b))
        flat = lambda old, new: np.concatenate([old, np.fromiter((i for x in new for i in x), np.int32)])
        self.ids_a, self.ids_b = flat(self.ids_a, got_a), flat(self.ids_b, got_b)
        new = {w: first + i for i, w in enumerate(words)}
        self.number.update((w, i) for w, i in new.items() if len(w) <= LONGEST)
        return new

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, and how many each text has."""
        if len(self.number) > CACHE or len(self.ids_a) > CACHE_TOKENS:
            self.clear()
        cut = [_CUT.split(t) if t else [] for t in texts]
        known = self.number
        new = list(dict.fromkeys(w for c in cut for w in c if w not in known))
        if new:
            known = known | self.add(new) if len(max(new, key=len)) > LONGEST else (self.add(new), self.number)[1]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter((known[w] for c in cut for w in c), np.int64, int(n.sum())), n


def _byte_level(path: str):
    """A function of many texts, and the bytes of every id. Where the vocabulary comes as a table of ranks as well, that is read:
    the same ids several times faster. Strings of special tokens are plain text."""
    import json
    import os

    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level entry shows as themselves
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    data = [b""] * (1 + max(told["model"]["vocab"].values()))
    for entry, i in told["model"]["vocab"].items():
        data[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            reader = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
        return lambda texts: [reader.encode_ordinary(t) for t in texts], data
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)], data


def _reader(a: str, b: str) -> Reader:
    if _state.get("names") != (a, b):
        _state.update(names=(a, b), reader=Reader(a, b))
    return _state["reader"]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for n places, one range after another."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lane_a: np.ndarray, lane_b: np.ndarray) -> np.ndarray:
    """Groups (rows a0, a1, b0, b1: half-open ranges of tokens) of two tokenisations given by where their tokens end, in order.

    lane_a, lane_b: the tokens at which lanes begin, both at common cuts; the tokenisations end together. Tokens of no
    bytes end where the token before them ends and go into its group.
    """
    n = len(lane_a)
    if not n:
        return np.zeros((4, 0), np.int64)
    # rows: place in A and B, start of the open group in A and B, end of the lane in A and B
    state = np.stack([lane_a, lane_b, lane_a, lane_b, np.append(lane_a[1:], len(end_a)), np.append(lane_b[1:], len(end_b))])
    closed = []
    while state.shape[1]:
        a, b = end_a[state[0]], end_b[state[1]]
        state[0] += a <= b
        state[1] += b <= a
        cut = np.flatnonzero(a == b)
        if cut.size:
            at = state[:, cut]
            closed.append(at[[2, 0, 3, 1]])
            state[2:4, cut] = at[:2]
            over = (at[0] == at[4]) | (at[1] == at[5])
            if over.any():
                left = np.ones(state.shape[1], bool)
                left[cut[over]] = False
                state = state[:, left]
    found = np.concatenate(closed, axis=1)
    return found[:, np.argsort(found[0], kind="stable")]


_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _types(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each type, and every group's type. Groups are one type if their ids are equal one by one."""
    a0, a1, b0, b1 = groups
    n_a, n_b = a1 - a0, b1 - b0
    own_a, own_b = np.repeat(np.arange(len(a0)), n_a), np.repeat(np.arange(len(b0)), n_b)
    at_a, at_b = np.arange(len(ids_a)) - a0[own_a], np.arange(len(ids_b)) - b0[own_b]
    with np.errstate(over="ignore"):
        code = n_a.astype(np.uint64) * _MIX_B + n_b.astype(np.uint64)
        for ids, at, start, mix in ((ids_a, at_a, a0, _MIX_A), (ids_b, at_b, b0, _MIX_B)):
            power = np.cumprod(np.full(int(at.max()) + 1, mix, np.uint64))
            x = (ids.astype(np.uint64) + np.uint64(1)) * power[at]
            code = (code ^ (code >> np.uint64(29))) * _MIX_A + np.add.reduceat(x ^ (x >> np.uint64(31)), start)
    _, first, kind = np.unique(code, return_index=True, return_inverse=True)
    to = first[kind]
    same = bool((n_a == n_a[to]).all() and (n_b == n_b[to]).all())
    if same and (ids_a == ids_a[a0[to][own_a] + at_a]).all() and (ids_b == ids_b[b0[to][own_b] + at_b]).all():
        return first, kind
    seen: dict[tuple[bytes, bytes], int] = {}  # two types share a code: told apart one by one
    kind = np.fromiter((seen.setdefault((ids_a[p:q].tobytes(), ids_b[r:s].tobytes()), len(seen)) for p, q, r, s in groups.T), np.int64, groups.shape[1])
    return np.unique(kind, return_index=True)[1], kind


def _distinct(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each range: how many, which, how often."""
    code, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids[_ranges(start, n)].astype(np.int64), return_counts=True)
    return np.bincount(code >> 32, minlength=len(n)), code & 0xFFFFFFFF, times


def _pairs_of_types(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each type: how many distinct pairs a << 32 | b it links, which, and how often."""
    a0, a1, b0, b1 = groups
    k_a, of_a, times_a = _distinct(ids_a, a0, a1 - a0)
    k_b, of_b, times_b = _distinct(ids_b, b0, b1 - b0)
    own = np.repeat(np.arange(len(k_a)), k_a)  # the type of each distinct A id, which meets each distinct B id of the type
    at_a = np.repeat(np.arange(len(of_a)), k_b[own])
    at_b = _ranges((np.cumsum(k_b) - k_b)[own], k_b[own])
    return k_a * k_b, of_a[at_a] << 32 | of_b[at_b], times_a[at_a] * times_b[at_b]


def _docs_of_pairs(n_docs: int, doc_type: np.ndarray, type_n: np.ndarray, type_pos: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many documents each pair is linked. doc_type: distinct type << 32 | document. Pairs of one type only have as many as
    the type; for the others documents are told apart."""
    kind, doc = doc_type >> 32, doc_type & 0xFFFFFFFF
    of_type = np.bincount(kind, minlength=len(type_n))
    owner = np.repeat(np.arange(len(type_n)), type_n)
    several = np.bincount(type_pos, minlength=n_pairs)[type_pos] > 1
    found = np.zeros(n_pairs, np.int64)
    found[type_pos[~several]] = of_type[owner[~several]]
    # the rest pair by pair in slices, so that a slice has all documents of its pairs
    pos, owner = type_pos[several], owner[several]
    order = np.argsort(pos, kind="stable")
    pos, owner = pos[order], owner[order]
    upto, begin = np.cumsum(of_type[owner]), np.cumsum(of_type) - of_type
    at = 0
    while at < len(pos):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EXPANDED)))
        while end < len(pos) and pos[end] == pos[end - 1]:
            end += 1
        n = of_type[owner[at:end]]
        code = np.unique(np.repeat(pos[at:end], n) << 32 | doc[_ranges(begin[owner[at:end]], n)])
        found += np.bincount(code >> 32, minlength=n_pairs)
        at = end
    return found


def align_block(texts: list[str], reader: Reader) -> dict:
    """Both tokenisations of each text, merged: arrays by document, by type and by pair (see _aligned)."""
    words, n_words = reader.words(texts)
    doc = np.repeat(np.arange(len(texts)), n_words)
    whole = np.array(reader.ok, bool)[words]
    bad = np.zeros(len(texts), bool)
    bad[doc[~whole]] = True
    words, doc = words[~bad[doc]], doc[~bad[doc]]
    counts_a, counts_b = np.array(reader.n_a, np.int64), np.array(reader.n_b, np.int64)
    w_a, w_b = counts_a[words], counts_b[words]
    ids_a = reader.ids_a[_ranges((np.cumsum(counts_a) - counts_a)[words], w_a)]
    ids_b = reader.ids_b[_ranges((np.cumsum(counts_b) - counts_b)[words], w_b)]
    begin_a, begin_b = np.cumsum(w_a) - w_a, np.cumsum(w_b) - w_b
    # a lane begins with a document, and after each LANE words of it: a word's start is a common cut
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    lanes = (np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))) % LANE == 0
    groups = lockstep(np.cumsum(reader.length_a[ids_a]), np.cumsum(reader.length_b[ids_b]), begin_a[lanes], begin_b[lanes])
    by_doc = lambda of, values: np.bincount(of, values, minlength=len(texts)).astype(np.int64)
    if not len(words):
        zero, none = np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "kind": none, "first": none, "group_of": none, "groups": groups, "ids_a": ids_a, "ids_b": ids_b}
    group_of = doc[np.searchsorted(begin_a, groups[0], side="right") - 1]
    first_of_type, kind = _types(ids_a, ids_b, groups)
    links = (groups[1] - groups[0]) * (groups[3] - groups[2])
    return {
        "n_a": by_doc(doc, w_a), "n_b": by_doc(doc, w_b), "n_groups": np.bincount(group_of, minlength=len(texts)), "n_links": by_doc(group_of, links),
        "kind": kind, "first": first_of_type, "group_of": group_of, "groups": groups, "ids_a": ids_a, "ids_b": ids_b,
    }


def _written(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray) -> list[str]:
    """a1,a2|b1 for each group."""
    n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
    a, b = (list(map(str, ids[_ranges(start, n)].tolist())) for ids, start, n in ((ids_a, groups[0], n_a), (ids_b, groups[2], n_b)))
    upto_a, upto_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
    return [",".join(a[p:q]) + "|" + ",".join(b[r:s]) for p, q, r, s in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)]  # noqa: B905


def _aligned(a: str, b: str, id_type: pa.DataType):
    names = [x.split()[0] for x in KEPT.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in KEPT.split(", ")]

    def rows(n: int, block: int, ids=None, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names[1:], kinds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *arrays, ids if ids is not None else pa.nulls(n, id_type)], names=[*names, "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, base = _reader(a, b), TaskContext.get().partitionId() << 32
        for k, batch in enumerate(blocks(batches, 1, BLOCK_BYTES, BLOCK_ROWS)):
            x = align_block(batch.column(1).to_pylist(), reader)
            n, kind = batch.num_rows, x["kind"]
            shown = _written(x["ids_a"], x["ids_b"], x["groups"][:, x["first"]])
            ends = np.cumsum(x["n_groups"])
            spelled = lambda i, kind=kind, shown=shown, ends=ends, x=x: ";".join([shown[t] for t in kind[ends[i] - x["n_groups"][i] : ends[i]].tolist()])
            sha = [hashlib.sha256(spelled(i).encode()).hexdigest() if x["n_groups"][i] else "" for i in range(n)]
            doc_types, times = np.unique(x["group_of"] << 32 | kind, return_counts=True)
            at = np.searchsorted(doc_types >> 32, np.arange(n + 1))
            of_docs, times = (doc_types & 0xFFFFFFFF).astype(np.uint32), times.astype(np.uint32)
            cut = lambda v, at=at: [v[p:q].tobytes() for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield rows(n, base + k, batch.column(0), text_no=range(n), types=cut(of_docs), times=cut(times), groups_sha256=sha, **{c: x[c] for c in ("n_a", "n_b", "n_groups", "n_links")})
            if not len(kind):
                continue
            type_n, pairs, pair_times = _pairs_of_types(x["ids_a"], x["ids_b"], x["groups"][:, x["first"]])
            known, pos = np.unique(pairs, return_inverse=True)
            docs = _docs_of_pairs(n, np.unique(kind << 32 | x["group_of"]), type_n, pos, len(known))
            as_bytes = lambda v: [v.astype(np.uint32).tobytes()]
            yield rows(1, base + k, type_n=as_bytes(type_n), type_pos=as_bytes(pos), type_times=as_bytes(pair_times))
            yield rows(len(known), base + k, pair=known, pos=np.arange(len(known)), docs=docs)

    return run


def _summed(id_type: pa.DataType):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block: its documents and types, and the counts of its pairs."""
        given = left.filter(pc.is_valid(left["text_no"]))
        types = left.filter(pc.is_valid(left["type_n"]))
        n_best, count_sum = np.zeros(given.num_rows, np.int64), np.zeros(given.num_rows, np.int64)
        if types.num_rows:
            type_n, pos, times = (np.frombuffer(types[c][0].as_py(), np.uint32).astype(np.int64) for c in ("type_n", "type_pos", "type_times"))
            count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
            at = right["pos"].to_numpy()
            count[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
            start = np.cumsum(type_n) - type_n
            per_type = [np.add.reduceat(times * v[pos], start) for v in (best, count)]
            for i, (own, k) in enumerate(zip(given["types"].to_pylist(), given["times"].to_pylist(), strict=True)):
                own, k = np.frombuffer(own, np.uint32), np.frombuffer(k, np.uint32).astype(np.int64)
                n_best[i], count_sum[i] = ((k * v[own]).sum() for v in per_type)
        columns = [given["doc_id"], *(given[c] for c in names[1:5]), pa.array(n_best), pa.array(count_sum), given["groups_sha256"]]
        return pa.Table.from_arrays(columns, names=names)

    return run


def align_documents(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and id pairs (a_id, b_id, n, best: in how many
    documents they are linked, and whether that is the A id's highest number).

    A space and the text is encoded by byte-level vocabulary a, the text by piece vocabulary b, which adds the space. Null and
    empty texts, and those whose tokens' bytes differ from a space and the text, have no tokens: zeros and ''. Every row is a
    document of its own, also where ids or texts repeat; ids may be of any type, or null. Of an A id's pairs with equal highest
    numbers all are best. An empty table gives empty results; other columns are ignored. A worker holds one block (BLOCK_BYTES of
    text, or one longer text) and its memory of words; a group of very many tokens costs the product of its distinct ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = pa.schema(_arrow_schema(src)).field("doc_id").type
    kept = stored(src.mapInArrow(_aligned(a, b, kind), f"{KEPT}, doc_id {src.schema['doc_id'].dataType.simpleString()}"), "aligned")
    pairs = kept.filter("pair is not null").select("block", "pos", "pair", "docs")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    counts = stored(counts.select("pair", "n", "n_rows", F.shiftright("pair", 32).alias("a_id")), "aligned-counts")
    top = counts.groupBy("a_id").agg(F.max("n").alias("top"))  # no more rows than vocabulary a has entries
    counts = stored(counts.join(F.broadcast(top), "a_id").withColumn("best", F.col("n") == F.col("top")).drop("top"), "aligned-best")
    links = counts.select("a_id", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n", "best")

    hot = F.col("n_rows") > max(HOT_ROWS, int(pairs.count() * HOT_SHARE))
    values = counts.select("pair", "n", F.col("best").cast("long").alias("best"))
    marked = pairs.drop("docs").join(F.broadcast(values.join(counts.filter(hot).select("pair"), "pair").select("pair", F.col("n").alias("hot_n"), F.col("best").alias("hot_best"))), "pair", "left")
    rest = marked.filter("hot_n is null").join(values.hint("merge"), "pair").select("block", "pos", "n", "best")
    back = rest.union(marked.filter("hot_n is not null").select("block", "pos", "hot_n", "hot_best")).withColumnRenamed("block", "of_block")
    left = kept.filter("pair is null").select("block", "text_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "types", "times", "type_n", "type_pos", "type_times")
    out = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return left.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_summed(kind), out), links


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))[0]
