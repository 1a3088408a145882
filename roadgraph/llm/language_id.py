"""Language id with hyperdimensional profiles.

Every letter has a fixed random vector of -1 and 1. A 3-gram's vector is the product of its letters' vectors,
each rolled by its place. A document's vector is the sum of its 3-grams' vectors; a language's prototype is the
sum of its training documents' unit vectors. The prediction is the prototype with the largest cosine.

As a sum over 3-grams is a product of counts and vectors, a batch of documents costs one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, id_crc, small_batches, table

DIMENSIONS = 1024
#: Slots for letters: 0 is everything else, 1 to 26 are a to z, other letters share the rest by hash.
SLOTS = 128
SEED = 20240501
#: Characters that are counted at once, and cells of one table of counts or vectors (4 bytes each).
CHUNK = 1_000_000
CELLS = 8_000_000
#: Documents that prototypes are learned from, drawn by hash from all labelled ones.
MAX_TRAIN = 20_000
#: Languages whose prototypes fit the driver and every task.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"

_made: dict = {}


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Character -> slot, and the letter vectors rolled for each place of a 3-gram."""
    if not _made:
        slot = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                slot[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % 2**32 >> 8) % (SLOTS - 27)
        letters = np.random.Generator(np.random.PCG64(SEED)).choice(np.array([-1, 1], np.float32), (SLOTS, DIMENSIONS))
        _made.update(slot=slot, rolled=[np.roll(letters, 2 - k, axis=1) for k in range(3)])
    return _made["slot"], _made["rolled"]


def _codes(text: str) -> tuple[np.ndarray, bool]:
    """3-gram codes of a whole text, other characters folded to one blank, and whether it has a letter."""
    slot, _ = _tables()
    out, carry, letters = [], np.zeros(1, np.uint8), False
    for at in range(0, len(text), CHUNK):
        new = slot[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = letters or bool(new.any())
        s = np.concatenate([carry, new])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep].astype(np.int32)
        if len(s) > 2:
            out.append((s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:])
        carry = s[-2:].astype(np.uint8)
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), letters


def _chunks(texts: list[str | None]) -> Iterator[list[int]]:
    own, size = [], 0
    for i, x in enumerate(texts):
        if own and size + len(x or "") > CHUNK:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(x or "")
    if own:
        yield own


def document_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors (n, DIMENSIONS) and whether each text has a letter."""
    _, rolled = _tables()
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    lookup = np.zeros(SLOTS**3, np.int32)
    for own in _chunks(texts):
        made = [_codes(texts[i] or "") for i in own]
        has[own] = [x for _, x in made]
        codes = np.concatenate([c for c, _ in made])
        if not len(codes):
            continue
        seen = np.zeros(SLOTS**3, bool)
        seen[codes] = True
        grams = np.flatnonzero(seen)
        lookup[grams] = np.arange(len(grams))
        row, at = np.repeat(np.arange(len(own)), [len(c) for c, _ in made]), lookup[codes]
        step = max(1, CELLS // max(len(own), DIMENSIONS))
        if len(grams) > step:  # many scripts: in blocks of 3-grams, each a stretch of the codes in their order
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
        for low in range(0, len(grams), step):
            some = grams[low : low + step]
            x, y = (0, len(at)) if len(grams) <= step else np.searchsorted(at, [low, low + len(some)])
            counts = np.bincount(row[x:y] * len(some) + at[x:y] - low, minlength=len(own) * len(some)).reshape(len(own), -1).astype(np.float32)
            bound = rolled[0][some // SLOTS**2]
            bound *= rolled[1][some // SLOTS % SLOTS]
            bound *= rolled[2][some % SLOTS]
            out[own] += counts @ bound
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        v, _ = document_vectors(b.column(1).to_pylist())
        lang = np.array(b.column(0).to_pylist(), object)
        for k in set(lang):
            sums[k] = sums.get(k, 0) + _unit(v[lang == k]).astype(np.float64).sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([list(x) for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
    )


def learn(docs: DataFrame, max_train: int = MAX_TRAIN, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from about max_train rows with a text and a language, or all if they are fewer.

    Rows are drawn by a hash of the id, so rows that repeat an id are drawn together. Texts without a letter add
    nothing. An empty table gives no language.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("u")).filter("lang is not null and text is not null")
    n = own.count()
    if n > max_train:
        own = own.filter(drawn("u", max_train, n))
    sums = own.select("lang", "text").mapInArrow(_bundle, "lang string, v array<double>")
    cells = sums.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vectors = np.array([[c["x"] for c in r["v"]] for r in found], np.float32).reshape(-1, DIMENSIONS)
    return [r["lang"] for r in found], _unit(vectors)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (the cosine, from 0), margin to the second language.

    A null text, a text without a letter and a model without languages give und with score 0. Ties go to the
    first language by name. Repeated rows are predicted one by one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, has = document_vectors(b.column(1).to_pylist())
            like = _unit(v) @ prototypes.T if languages else np.zeros((len(v), 1), np.float32)
            best = like.argmax(axis=1)
            top = np.sort(like, axis=1)
            margin = top[:, -1] - top[:, -2] if like.shape[1] > 1 else top[:, -1]
            known = has & bool(languages)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, np.clip(top[:, -1], 0, 1), 0).astype(np.float64)),
                    pa.array(np.where(known, margin, 0).astype(np.float64)),
                ],
                names=["doc_id", "lang_pred", "score", "margin"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows outside the held-out quarter, predicts all."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    languages, prototypes = learn(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), languages, prototypes).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "margin")
