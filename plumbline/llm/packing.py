"""Packing along a space-filling curve.

Each document's token ids give a hashed count vector, a fixed random projection of it a point in a few
dimensions, and the point a Hilbert key. Documents are range-sorted by (key, doc_id), laid end to end along the
curve, and cut at every multiple of the sequence length. Only the last sequence of all is padded.

Defined results: null text is empty and still yields the end id; repeated rows are packed as often as they
occur; extra columns are ignored; an empty table gives no rows. Texts with an equal key, such as copies, are
split over range partitions by doc_id.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_counts import load_tokenizer

LENGTH = 2048
END_ID = 1
#: Entries of a worker's memo of encoded words, about 200 bytes each.
MEMO = 300_000
#: Megabytes that a worker gets at once; larger batches repeat more of their words.
BATCH = 12
DIMS, BITS, BUCKETS, SEED = 4, 8, 1024, 7
#: ASCII and the letters of Latin-1: lower-casing and composition are plain there.
_PLAIN = re.compile(r"[\t\n\r\x0b\x0c\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Letters, then perhaps ASCII symbols: two pre-tokens at most, and the first ends in the one id that ends a word.
_LETTERS = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-^`{-~]*)")
JOINED = 256


class WordIds:
    """Ids of a batch of texts. The tokenizer drops white space and never joins across it, so each distinct word of a batch is looked up once, and encoded once by a worker."""

    def __init__(self, tokenizer, memo: int = MEMO):
        self.tokenizer, self.memo, self.known = tokenizer, memo, {}
        self.ends = np.zeros(1 << 16, bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _one_by_one(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, dtype="<u2").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters, many in one text: each ends with its only id that ends a word."""
        out = {}
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u2")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(own) or cut[-1] != len(ids):
                out |= self._one_by_one(own)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(own, cut, strict=True):
                out[w], at = raw[2 * at : 2 * end], end
        return out

    def _fresh(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of words met first; letters and the symbols after them are encoded apart."""
        known, match = self.known, _LETTERS.fullmatch
        parts = {w: m.groups() for w in missing if (m := match(w))}
        letters = self._letters(list({a for a, _ in parts.values()} - known.keys()))
        rest = self._one_by_one(list({b for _, b in parts.values() if b} - known.keys()) + [w for w in missing if w not in parts])
        look = lambda w: letters.get(w) or rest.get(w) or known[w]
        return letters | rest | {w: look(a) + look(b) if b else look(a) for w, (a, b) in parts.items()}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry: the end)."""
        plain = [t.lower() if "<|" not in t and _PLAIN.fullmatch(t) else t for t in texts]
        cut = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self.known
        got = list(map(known.get, words))
        missing = [w for w, g in zip(words, got, strict=True) if g is None]
        fresh = self._fresh(missing)
        got = [fresh[w] if g is None else g for w, g in zip(words, got, strict=True)]
        room = self.memo - len(known)
        known.update(fresh if len(fresh) <= room else dict(islice(fresh.items(), max(room, 0))))
        flat, sizes = np.frombuffer(b"".join(got), "<u2"), np.array([len(g) // 2 for g in got], np.int64)
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.cumsum(each)
        first = (np.cumsum(sizes) - sizes)[codes]
        ids = flat[np.repeat(first - (ends - each), each) + np.arange(ends[-1])] if len(ends) and ends[-1] else flat[:0]
        begin = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return ids, begin


def projection(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def points(ids: list[np.ndarray], plane: np.ndarray) -> np.ndarray:
    """Coordinates from 0 to 2**BITS - 1: damped counts of hashed ids, at unit length, projected and squashed."""
    out = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        h = np.log1p(np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS))
        out[i] = (h / max(np.linalg.norm(h), 1e-12)) @ plane
    return np.clip((1 / (1 + np.exp(-2 * out)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points (rows), by Gray-code unwinding of the axes from the top bit down."""
    x = at.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _encoded(tokenizer_path: str, end_id: int, memo: int):
    @common.tidy
    def run(batches):
        words = common.worker_state(f"words {tokenizer_path} {memo}", lambda: WordIds(load_tokenizer(tokenizer_path), memo))
        plane, end = projection(), np.array([end_id], "<u2")
        for batch in batches:
            ids, begin = words(batch.column("text").to_pylist())
            own = [np.concatenate([ids[a:b], end]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            raw = [x.tobytes() for x in own]
            key = hilbert(points(own, plane)) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.int64()), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "curve_key", "doc_tokens", "ids"])

    return run


def _laid(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("doc_tokens").to_numpy()
        first = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part), pa.int32()), pa.array(first, pa.int64())], [*batch.schema.names, "part", "first"])


def _cut(base: dict[int, int], length: int):
    @common.tidy
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, n, raw, part, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "part", "first")), strict=True):
                ids, at, start = np.frombuffer(raw, "<u2").astype("<u4"), base[part] + first, 0
                while start < n:
                    size = min(n - start, length - (at + start) % length)
                    out.append((doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, (at + start) // length, (at + start) % length))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def laid_out(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """A stored table of documents in curve order: doc_id, curve_key, doc_tokens, ids (16-bit), part, first (place in its part)."""
    common.arrow_batches(df.sparkSession, BATCH)
    encoded = common.stored(common.ids_and_text(df, id_col, text_col).mapInArrow(_encoded(tokenizer_path, end_id, memo), "doc_id long, curve_key long, doc_tokens long, ids binary"), "pack-ids")
    ranged = encoded.repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    laid = common.stored(ranged.mapInArrow(_laid, "doc_id long, curve_key long, doc_tokens long, ids binary, part int, first long"), "pack-laid")
    common.drop_scratch(df.sparkSession, encoded)
    return laid


def pack(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Needs a vocabulary below 65,536 ids."""
    laid = laid_out(df, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id, memo=memo)
    # a row per range partition, whatever the number of documents
    totals, base, at = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}, {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    return laid.select("doc_id", "doc_tokens", "ids", "part", "first").mapInArrow(_cut(base, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
