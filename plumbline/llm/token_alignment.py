"""Aligns two tokenizers' tokens of each text by an event sweep.

A map encodes every text with both tokenizers and sends each one's token ends as runs of events. The union of both sides'
runs is repartitioned by document and sorted within partitions by offset; a state machine goes through each partition's
stream once. It holds the tokens since the last byte at which both sides end, and cuts a group at each such byte. Its
state is one open group and one run, however long the document. A run is a row of many events: its ids, from which the
ends follow by the lengths of the tokens' bytes (a number a vocabulary entry).

Links are the pairs of A and B tokens of one group. Tasks count for each pair of ids the documents that hold it linked,
and Spark sums these counts. The most frequent TOP pairs, a fixed number, go to all workers; a document's links to other
pairs meet the counts in a shuffled join. Results don't depend on TOP.

Encoding cuts texts before blanks, line feeds and tabs that follow something else, where neither tokenizer can have a
token across (B's vocabulary is asked), and looks up words that a worker has met. Texts with characters on whose kind
the two libraries differ, and vocabularies without that property, are encoded whole.

Defined results: null and empty texts, and those whose joined bytes of either side differ from blank + text (such as
texts with U+2581), have no tokens: zeros and ''. Repeated rows are documents of their own, also in the counts; a null
doc_id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_counts import _ODD

BLANK = "▁"
#: Tokens of a run at most, words that a worker remembers, and pairs of ids whose counts go to every worker (18 MB).
RUN, MEMO, TOP = 1 << 16, 400_000, 1 << 20
#: Links that are made at once, and pairs that a task gathers before it gives their counts on.
LINKS, GATHERED = 1 << 21, 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabularies:
    """What the sweep needs of two tokenizers: each token's length in bytes."""

    a_lengths: np.ndarray
    b_lengths: np.ndarray

    @property
    def width(self) -> np.dtype:
        return np.dtype("<u2" if max(len(self.a_lengths), len(self.b_lengths)) <= 1 << 16 else "<u4")


class Tokenizers:
    """Both tokenizers, their tokens' bytes, and where texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(alphabet[c] for c in n) if n and all(c in alphabet for c in n) else (n or "").encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.lead = self.b.piece_to_id(BLANK)
        shown = [p.replace(BLANK, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        blanks = any(" " in p.lstrip(" ") for p in shown)
        self.free = "" if blanks or pieces[self.lead] != BLANK else "".join([" ", *(c for c in "\n\t" if not any(c in p[1:] for p in shown))])
        self.cut = re.compile(rf"(?<=\S)(?=[{self.free}])") if self.free else None

    def lengths(self) -> Vocabularies:
        return Vocabularies(*self.sizes)

    def words(self, text: str) -> list[str]:
        """Parts of blank + text that both tokenizers encode on their own."""
        return [f" {text}"] if self.cut is None or _ODD.search(text) else self.cut.split(f" {text}")

    def split(self, texts: list[str]) -> pa.ListArray:
        """The words of each text; of an empty one none."""
        if any("\x00" in t for t in texts):
            return pa.array([self.words(t) if t else [] for t in texts], pa.large_list(pa.large_string()))
        marked: list[str | None] = []
        for t in texts:
            if not t:
                marked.append(None)
                continue
            even = t
            for c in self.free[1:]:
                even = even.replace(c, " ")
            if self.cut is None or " ".join(even.split()) != even:
                marked.append("\x00".join(self.words(t)))
            else:  # each of these characters follows something else, and there is no other white space
                said = f" {t}"
                for c in self.free:
                    said = said.replace(c, f"\x00{c}")
                marked.append(said[1:])
        return pc.fill_null(pc.split_pattern(pa.array(marked, pa.large_string()), "\x00"), [])

    def one_by_one(self, words: list[str]) -> tuple[list, list, list[bool]]:
        """Ids of parts, and whether their bytes come back. B puts a blank before what it gets: a part's own, or one that is taken off again."""
        a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        for i, w in enumerate(words):
            if w[0] != " ":
                if b[i][:1] != [self.lead]:
                    raise ValueError("a part's leading blank joined what follows")
                del b[i][0]
            elif w == " ":
                b[i] = [self.lead]  # of nothing the library makes nothing
        return a, b, [self.faithful(w, x, y) for w, x, y in zip(words, a, b, strict=True)]

    def together(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Each side's ids of parts that may stand side by side, and how many each part has; None if their bytes don't come back."""
        text = "".join(words)
        raw = text.encode()
        ids = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        ends = np.cumsum([len(w.encode()) for w in words])
        out = []
        for side, shown, lengths in zip(ids, (self.a_bytes, self.b_bytes), self.sizes, strict=True):
            if b"".join(map(shown.__getitem__, side)) != raw:
                return None
            own = np.array(side, np.int64)
            by = np.cumsum(lengths[own])
            at = np.searchsorted(by, ends)
            if (by[at] != ends).any():
                return None
            out.append((own, steps(at + 1)))
        return out

    def faithful(self, word: str, a: list[int], b: list[int]) -> bool:
        raw = word.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))


def steps(at: np.ndarray) -> np.ndarray:
    """Differences, the first from 0."""
    out = at.copy()
    out[1:] -= at[:-1]
    return out


class Ragged:
    """Rows of whole numbers, appended in bulk and gathered in bulk."""

    def __init__(self, dtype: np.dtype):
        self.flat, self.starts, self.sizes, self.used = np.zeros(1 << 16, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        more = len(ids)
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(more, len(self.flat)), self.flat.dtype)])
        self.flat[self.used : self.used + more] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes, self.used = np.concatenate([self.sizes, sizes]), self.used + more

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of codes one after another, and their sizes."""
        sizes = self.sizes[codes]
        return self.flat[np.repeat(self.starts[codes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


class Words:
    """Words met, with both sides' ids. Beyond `memo` words it begins anew."""

    def __init__(self, tokenizers: Tokenizers, memo: int):
        self.tokenizers, self.memo = tokenizers, memo
        self._clear()

    def _clear(self) -> None:
        width = self.tokenizers.lengths().width
        self.codes, self.sides, self.good = {}, (Ragged(width), Ragged(width)), np.zeros(0, bool)

    def _learn(self, fresh: list[str]) -> None:
        """Both sides' ids of new words: of those that may stand side by side 4096 at once, of others one by one."""
        free = self.tokenizers.free
        alone = [w for w in fresh if w[0] != " " or w[0] not in free or w[-1].isspace() or BLANK in w]
        kept = set(alone)
        joined = [w for w in fresh if w not in kept] if alone else fresh
        for i in range(0, len(joined), 4096):
            some = joined[i : i + 4096]
            both = self.tokenizers.together(some)
            if both is None:
                alone += some
                continue
            self._note(some, both, np.ones(len(some), bool))
        for i in range(0, len(alone), 4096):
            some = alone[i : i + 4096]
            *both, good = self.tokenizers.one_by_one(some)
            self._note(some, [(np.array([x for ids in side for x in ids], np.int64), np.array([len(ids) for ids in side], np.int64)) for side in both], np.array(good, bool))

    def _note(self, words: list[str], both: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> None:
        first = len(self.codes)
        self.codes.update(zip(words, range(first, first + len(words)), strict=True))
        for side, (ids, sizes) in zip(self.sides, both, strict=True):
            side.extend(ids, sizes)
        self.good = np.concatenate([self.good, good])

    def __call__(self, texts: list[str]):
        """For each text its ids of both sides; none for texts whose bytes don't come back."""
        split = self.tokenizers.split(texts)
        met = split.flatten().dictionary_encode()
        words = met.dictionary.to_pylist()
        if len(self.codes) + len(words) > self.memo:
            self._clear()
        if fresh := [w for w in words if w not in self.codes]:
            self._learn(fresh)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))[met.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
        gathered = [side.gather(codes) for side in self.sides]
        at = [np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].tolist() for _, sizes in gathered]
        bad = np.concatenate([[0], np.cumsum(~self.good[codes])])[np.concatenate([[0], ends])].tolist()
        for i, text in enumerate(texts):
            a, b = (ids[p[i] : p[i + 1]] for (ids, _), p in zip(gathered, at, strict=True))
            if bad[i + 1] == bad[i] or self.tokenizers.faithful(f" {text}", a.tolist(), b.tolist()):
                yield a, b
            else:
                yield a[:0], b[:0]


def _packed(ids: np.ndarray, to: zstandard.ZstdCompressor) -> bytes:
    """Ids with their bytes by place, compressed."""
    return to.compress(ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes()) if len(ids) else b""


def _unpacked(raw: bytes, width: np.dtype, to: zstandard.ZstdDecompressor) -> np.ndarray:
    if not raw:
        return np.zeros(0, width)
    planes = np.frombuffer(to.decompress(raw), np.uint8).reshape(width.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(width).ravel()


def _events(a_path: str, b_path: str, vocabularies: Vocabularies, memo: int, call: str):
    """Runs of events of both sides: doc row, offset at which a run begins, side, ids."""
    lengths = vocabularies.a_lengths, vocabularies.b_lengths

    @common.tidy
    def run(batches):
        words = common.worker_state(call, lambda: Words(Tokenizers(a_path, b_path), memo))
        to = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out: list[tuple] = []
            for i, sides in enumerate(words(texts)):
                for side, ids in enumerate(sides):
                    if len(ids) <= RUN:
                        out.append((i, 0, side == 1, _packed(ids, to)))
                        continue
                    ends = np.cumsum(lengths[side][ids])
                    out += [(i, int(ends[at - 1]) if at else 0, side == 1, _packed(ids[at : at + RUN], to)) for at in range(0, len(ids), RUN)]
            at, offsets, seconds, runs = zip(*out, strict=True) if out else ((), (), (), ())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(rows), batch.column("doc_id").take(rows), pa.array(offsets, pa.int64()), pa.array(seconds, pa.bool_()), pa.array(runs, pa.binary())], ["row_key", "doc_id", "offset", "second", "ids"])

    return run


def common_ends(a: np.ndarray, b: np.ndarray, v: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """For each byte at which tokens of both sides end, how many tokens of each side end by then; both begin at one byte."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends_a, ends_b = np.cumsum(v.a_lengths[a]), np.cumsum(v.b_lengths[b])
    ended = np.zeros(max(ends_a[-1], ends_b[-1]) + 1, np.uint8)
    ended[ends_a] = 1
    ended[ends_b] |= 2
    return np.flatnonzero(ended[ends_a] == 3) + 1, np.flatnonzero(ended[ends_b] == 3) + 1


class _Spelling:
    """The text of groups: every token's digits and the sign behind them, in rows of equal width of which the used part is taken."""

    def __init__(self, v: Vocabularies):
        self.wide = len(str(max(len(v.a_lengths), len(v.b_lengths)))) + 1
        self.shown, self.used = [], []
        for lengths in (v.a_lengths, v.b_lengths):
            digits = np.array([f"{i},".encode() for i in range(len(lengths))], f"S{self.wide}")
            self.shown.append(digits.view(np.uint8).reshape(-1, self.wide))
            self.used.append(np.char.str_len(digits).astype(np.int64))

    def __call__(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """Each group with its semicolon."""
        rows, used = np.empty((len(a) + len(b), self.wide), np.uint8), np.empty(len(a) + len(b), np.int64)
        before_b = np.concatenate([[0], cut_b[:-1]])
        at_a = np.arange(len(a)) + np.repeat(before_b, steps(cut_a))
        at_b = np.arange(len(b)) + np.repeat(cut_a, steps(cut_b))
        for at, ids, cut, shown, size, sign in zip((at_a, at_b), (a, b), (cut_a, cut_b), self.shown, self.used, b"|;", strict=True):
            rows[at], used[at] = shown[ids], size[ids]
            ends = at[cut - 1]
            rows[ends, used[ends] - 1] = sign
        return rows[np.arange(self.wide) < used[:, None]].tobytes()


class Sweep:
    """The state machine over one document's runs in order of offset: the tokens since the last common end, counts, and a running digest."""

    def __init__(self, v: Vocabularies, spelling: _Spelling):
        self.v, self.spelling = v, spelling
        self.open = [np.zeros(0, v.width), np.zeros(0, v.width)]
        self.counts, self.digest, self.parts = np.zeros(4, np.int64), hashlib.sha256(), 0
        self.held = b""

    def feed(self, second: bool, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Takes a run; the tokens of the groups that are complete now, if any."""
        self.open[second] = np.concatenate([self.open[second], ids]) if len(self.open[second]) else ids
        a, b = self.open
        cut_a, cut_b = common_ends(a, b, self.v)
        if not len(cut_a):
            return None
        n, m = cut_a[-1], cut_b[-1]
        self.counts += [n, m, len(cut_a), int((steps(cut_a) * steps(cut_b)).sum())]
        said = self.held + self.spelling(a[:n], b[:m], cut_a, cut_b)
        self.digest.update(said[:-1])
        self.held, self.parts = said[-1:], self.parts + 1  # the last semicolon stands only if a group follows
        self.open = [a[n:], b[m:]]
        return a[:n], b[:m]

    def end(self) -> tuple:
        if any(len(x) for x in self.open):
            raise ValueError("the sides of a document end at different bytes")
        return (*self.counts.tolist(), self.digest.hexdigest() if self.parts else "")


SWEPT = "row_key long, doc_id long, part int, last boolean, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _swept(v: Vocabularies):
    """From the sorted stream of runs, rows of whole groups (part 0, 1, ...) and each document's digest in its last row."""
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])

    @common.tidy
    def run(batches):
        spelling, to, back = _Spelling(v), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        current, doc, state, waiting, out, size = None, None, None, None, [], 0

        def finished():
            a, b = waiting or (np.zeros(0, v.width),) * 2
            return (current, doc, max(0, state.parts - 1), True, _packed(a, to), _packed(b, to), *state.end())

        for batch in batches:
            for key, doc_id, second, ids in zip(*(batch.column(c).to_pylist() for c in ("row_key", "doc_id", "second", "ids")), strict=True):
                if key != current:
                    if state is not None:
                        out.append(finished())
                    current, doc, state, waiting = key, doc_id, Sweep(v, spelling), None
                got = state.feed(second, _unpacked(ids, v.width, back))
                if got is not None:
                    if waiting is not None:
                        out.append((current, doc, state.parts - 2, False, _packed(waiting[0], to), _packed(waiting[1], to), None, None, None, None, None))
                    waiting = got
                size += len(ids)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)
                    out, size = [], 0
        if state is not None:
            out.append(finished())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def links(a: np.ndarray, b: np.ndarray, v: Vocabularies):
    """The linked pairs of ids (a times B's entries plus b) of whole groups, with repeats, at most about LINKS at once, and of each array how often its pairs stand.

    A group with more links than that is counted by its different ids, a slice of A's at a time.
    """
    cut_a, cut_b = common_ends(a, b, v)
    sizes_a, sizes_b, n_b = steps(cut_a), steps(cut_b), len(v.b_lengths)
    from_b = cut_b - sizes_b
    total = np.cumsum(sizes_a * sizes_b)
    start = 0
    while start < len(cut_a):
        done = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, done + LINKS, "right"))
        if stop == start:  # one large group
            xs, x_times = np.unique(a[cut_a[start] - sizes_a[start] : cut_a[start]], return_counts=True)
            ys, y_times = np.unique(b[from_b[start] : cut_b[start]], return_counts=True)
            step = max(1, LINKS // len(ys))
            for i in range(0, len(xs), step):
                yield (xs[i : i + step, None].astype(np.int64) * n_b + ys).ravel(), (x_times[i : i + step, None] * y_times).ravel()
            start += 1
            continue
        tokens = slice(cut_a[start] - sizes_a[start], cut_a[stop - 1])
        each = np.repeat(sizes_b[start:stop], sizes_a[start:stop])
        first = np.repeat(from_b[start:stop], sizes_a[start:stop])
        at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        yield np.repeat(a[tokens].astype(np.int64), each) * n_b + b[at], None
        start = stop


def _batches_of_links(batch: pa.RecordBatch, v: Vocabularies, back: zstandard.ZstdDecompressor):
    """(row in the batch, pair, times) of each row's distinct pairs."""
    rows, pairs, times, size = [], [], [], 0

    def given():
        row, pair = np.repeat(np.array([r for r, _ in rows]), [n for _, n in rows]), np.concatenate(pairs)
        order = np.lexsort((pair, row)) if len(v.a_lengths) * len(v.b_lengths) >= 1 << 40 or len(rows) >= 1 << 22 else np.argsort(row << 40 | pair, kind="stable")
        row, pair, much = row[order], pair[order], np.concatenate(times)[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])]))
        return row[new], pair[new], np.add.reduceat(much, new)

    for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
        for pair, much in links(_unpacked(a, v.width, back), _unpacked(b, v.width, back), v):
            rows.append((i, len(pair)))
            pairs.append(pair)
            times.append(np.ones(len(pair), np.int64) if much is None else much)
            size += len(pair)
        if size > LINKS:
            yield given()
            rows, pairs, times, size = [], [], [], 0
    if size:
        yield given()


def _pair_counts(v: Vocabularies):
    """(pair, docs) of whole documents, summed within a task; (pair, row_key) where a document has several parts."""

    def out(pair, docs, key=None):
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.full(len(pair), 0) if key is None else key, pa.int64(), mask=np.ones(len(pair), bool) if key is None else None)], ["pair", "docs", "row_key"])

    def summed(held):
        pair, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        pair, place = np.unique(pair, return_inverse=True)
        return pair, np.bincount(place, weights=docs).astype(np.int64)

    @common.tidy
    def run(batches):
        back, held, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            whole = np.array([p == 0 and last for p, last in zip(batch.column("part").to_pylist(), batch.column("last").to_pylist(), strict=True)], bool)
            keys = batch.column("row_key").to_numpy()
            for row, pair, _ in _batches_of_links(batch, v, back):
                one = whole[row]
                if not one.all():
                    yield out(pair[~one], np.ones(int((~one).sum()), np.int64), keys[row[~one]])
                pair = pair[one]
                if len(pair):
                    held.append((*np.unique(pair, return_counts=True),))
                    size += len(held[-1][0])
                if size > GATHERED:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*summed(held))

    return run


def pair_counts(swept: DataFrame, v: Vocabularies) -> DataFrame:
    """A stored table pair, docs, best: in how many documents each pair of ids stands linked, and whether no pair of the same A id stands in more."""
    found = swept.select("row_key", "part", "last", "a", "b").mapInArrow(_pair_counts(v), "pair long, docs long, row_key long")
    several = found.where("row_key is not null").select("pair", "row_key").distinct().select("pair", F.lit(1).cast("long").alias("docs"))
    counts = common.stored(found.where("row_key is null").select("pair", "docs").unionByName(several).groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    own = F.expr(f"pair div {len(v.b_lengths)}").alias("a")
    most = counts.groupBy(own).agg(F.max("docs").alias("most"))  # a row an entry of A's vocabulary at most
    return common.stored(counts.withColumn("a", own).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-table")


def frequent_pairs(counts: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of at least so many documents that there are at most `top`, sorted, with documents and best."""
    if top <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    step = F.floor(F.log2("docs") * 8).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).collect(), key=lambda r: -r["step"]):  # a row a step: 512 at most
        total += r["n"]
        if total > top:
            break
        least = r["least"]
    if least is None:
        return frequent_pairs(counts, 0)
    t = counts.where(F.col("docs") >= least).toArrow().sort_by("pair")
    return t.column("pair").to_numpy(), t.column("docs").to_numpy(), t.column("best").to_numpy()


def _scored(v: Vocabularies, sent):
    """For each row of groups: the sums over its frequent pairs, with its digest; and its links to other pairs."""
    names = ["row_key", "pair", "links", "n_best", "count_sum"]

    @common.tidy
    def run(batches):
        back = zstandard.ZstdDecompressor()
        known, docs, best = sent.value
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for row, pair, times in _batches_of_links(batch, v, back):
                at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                r, t, at = row[hit], times[hit], at[hit]
                n = int(row[-1]) + 1
                sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums[0], r, t * best[at])
                np.add.at(sums[1], r, t * docs[at])
                some = np.unique(r)
                miss = ~hit
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), none, none, pa.array(sums[0][some]), pa.array(sums[1][some])], names)
                if miss.any():
                    gone = pa.nulls(int(miss.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row[miss]], pa.int64()), pa.array(pair[miss]), pa.array(times[miss]), gone, gone], names)

    return run


def sweep(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> tuple[DataFrame, Vocabularies]:
    """A stored table of whole groups, a row a document (long ones have several), with each document's counts and digest in its last row."""
    spark = df.sparkSession
    common.arrow_batches(spark, 4)
    v = Tokenizers(a_path, b_path).lengths()
    own = common.ids_and_text(df, id_col, text_col).withColumn("row_key", F.monotonically_increasing_id())
    events = own.mapInArrow(_events(a_path, b_path, v, memo, uuid.uuid4().hex), "row_key long, doc_id long, offset long, second boolean, ids binary")
    ordered = events.repartition("row_key").sortWithinPartitions("row_key", "offset", "second")
    return common.stored(ordered.mapInArrow(_swept(v), SWEPT), "swept"), v


def align(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, top: int = TOP) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, mark = df.sparkSession, common.mark()
    swept, v = sweep(df, a_path, b_path, id_col=id_col, text_col=text_col, memo=memo)
    counts = pair_counts(swept, v)
    sent = spark.sparkContext.broadcast(frequent_pairs(counts, top))
    scored = common.stored(swept.select("row_key", "a", "b").mapInArrow(_scored(v, sent), "row_key long, pair long, links long, n_best long, count_sum long"), "scored")
    rest = scored.where("pair is not null").select("row_key", "pair", "links").join(counts, "pair")
    more = rest.select("row_key", F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("docs")).alias("count_sum"))
    own = swept.where("last").select("row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    parts = [own, *(x.select("row_key", *nothing, "n_best", "count_sum").select(*own.columns) for x in (scored.where("pair is null"), more))]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("row_key").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    result = common.stored(summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "aligned")
    sent.destroy()
    common.drop_since(spark, mark, result)
    return result


def groups(swept: DataFrame, v: Vocabularies) -> DataFrame:
    """The groups themselves: row_key, doc_id, part, at (place in the part), start and length in bytes from the part's begin, a_ids, b_ids."""
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    @common.tidy
    def run(batches):
        back = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, doc, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("row_key", "doc_id", "part", "a", "b")), strict=True):
                a, b = _unpacked(a, v.width, back), _unpacked(b, v.width, back)
                cut_a, cut_b = common_ends(a, b, v)
                ends = np.cumsum(v.a_lengths[a])[cut_a - 1] if len(cut_a) else cut_a
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cut]), pa.int32()), pa.array(ids, pa.int32())) for cut, ids in ((cut_a, a), (cut_b, b))]
                n, start = len(cut_a), ends - steps(ends)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(np.arange(n)), pa.array(start), pa.array(ends - start), *lists], schema=schema)

    return swept.select("row_key", "doc_id", "part", "a", "b").mapInArrow(run, "row_key long, doc_id long, part int, at long, start long, length long, a_ids array<int>, b_ids array<int>")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
