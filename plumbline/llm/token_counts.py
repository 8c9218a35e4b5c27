"""Token counts of whole texts; documents beyond a chunk are encoded in overlapping chunks.

Texts up to `chunk` characters are encoded as a whole. A longer one is cut into windows that overlap. Each
window is encoded with offsets, and two neighbours are spliced at a boundary that both encodings share and
that is proven stable: after a character that is no white space and before one of space, tab, line feed and
carriage return. Every alternative of the byte-level pre-tokenizer's pattern ends before white space that
follows something else, and matches from such a place on depend on nothing before it; special tokens hold no
white space. Where an overlap has no such boundary it is doubled, in the end up to the rest of the text.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

LIMIT = 512
CHUNK = 32_768
OVERLAP = 256
#: Entries that a worker's memo of encoded pieces holds at most.
MEMO = 400_000
_BREAKS = " \t\n\r"
_PIECES = re.compile(r"\s*\S+|\s+")
#: Python calls these white space, the tokenizers' patterns don't.
_ODD = re.compile(r"[\x1c-\x1f]")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceCounts:
    """Tokens of a text as the sum over its pieces, cut at stable boundaries; pieces are encoded once and kept."""

    def __init__(self, tokenizer, memo: int = MEMO):
        self.tokenizer, self.memo, self.known = tokenizer, memo, {}

    def encode(self, pieces: list[str]) -> dict[str, int]:
        return {p: len(e) for p, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True)}

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [[t] if _ODD.search(t) else _PIECES.findall(t) for t in texts]
        missing = set().union(*cut) - self.known.keys() if cut else set()
        fresh = self.encode(list(missing))
        room = self.memo - len(self.known)
        if len(fresh) <= room:
            self.known.update(fresh)
            look = self.known.__getitem__
        else:
            for p in list(fresh)[: max(room, 0)]:
                self.known[p] = fresh[p]
            known = self.known
            look = lambda p: known[p] if p in known else fresh[p]
        return [sum(map(look, pieces)) for pieces in cut]


def is_stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in _BREAKS and not text[at - 1].isspace() and not _ODD.match(text[at - 1])


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """Token ids of a text, in runs, from overlapping windows; equal to those of one encoding of the whole."""

    def window(start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        return e.ids, [(start + a, start + b) for a, b in e.offsets]

    start, skip, end = 0, 0, min(len(text), chunk + overlap)
    ids, spans = window(start, end)
    while end < len(text):
        wide = overlap
        while True:
            then = max(start + 1, end - wide)
            after = min(len(text), then + max(chunk, wide) + wide)
            ids2, spans2 = window(then, after)
            ends = {b for _, b in spans2}
            at = next((b for _, b in reversed(spans) if then < b < end and b in ends and is_stable(text, b)), None)
            if at is not None:
                break
            wide *= 2
            if end - wide <= start:  # no common boundary in the whole window: it grows instead
                end = min(len(text), end + wide)
                ids, spans = window(start, end)
                if end == len(text):
                    break
        if at is None:
            break
        yield ids[skip : sum(a < at for a, _ in spans)]
        skip = sum(a < at for a, _ in spans2)
        start, end, ids, spans = then, after, ids2, spans2
    yield ids[skip:]


def _count(tokenizer_path: str, chunk: int, overlap: int, memo: int):
    @common.tidy
    def run(batches):
        pieces = common.worker_state(f"counts {tokenizer_path} {memo}", lambda: PieceCounts(load_tokenizer(tokenizer_path), memo))
        tokenizer = pieces.tokenizer
        for batch in batches:
            texts = batch.column("text").to_pylist()
            short = [t for t in texts if len(t) <= chunk]
            counted = iter(pieces(short))
            n = [next(counted) if len(t) <= chunk else sum(map(len, spliced_ids(tokenizer, t, chunk, overlap))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, memo: int = MEMO) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A map without shuffle; memory is bounded by a batch and the memo."""
    common.arrow_batches(df.sparkSession)
    rows = common.ids_and_text(df, id_col, text_col).mapInArrow(_count(tokenizer_path, chunk, overlap, memo), "doc_id long, n_bytes long, n_tokens long")
    return rows.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} as over_limit")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
