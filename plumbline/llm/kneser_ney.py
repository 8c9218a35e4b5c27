"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, as sharded tables.

Training counts the trigrams of all documents that labels call good, in two halves by hash of doc_id, each a model of
its own. A trusted document's cost is that by the half which doesn't hold it, so all of them set the thresholds;
other documents' cost is the mean of both. (Callers who name a `share` or a number up to which it is half, `least`, get
one model of that part of each language's trusted documents; the others set the thresholds.)

Texts are stored once as blocks of word codes. All trigrams, of trusted texts and of those to be judged, then meet in
shards by their middle word, where the counts of trigrams, of contexts, and of words before a bigram are whole. A middle
word with very many places (`HOT`) is dealt by contexts instead, and such a context by trigrams; what goes beyond a shard
then (bigrams of hot words, totals of both) is summed in groups of its own and told to the shards that need it, as is,
for every word of a shard, the number of its contexts. So a trigram's probability is known in its shard, and a
document's perplexity is a sum over shards. Shards are worked off in up to `PARTS` parts, one after the other, which
bounds what lies in shuffles at once; results don't depend on their number.

N-grams are 64-bit hashes of words, which hold the word's shape: an unseen word costs by the share that its
shape has among words seen once. Languages with fewer than `MODEL_DOCS` trusted documents share a model of these and
of all other trusted documents (of a part of those with a `share`); each other language has its own, however large the rest is.

Every whole document is scored, with an end after its last token. Its perplexity is the exponential of the mean cost
of tokens and end; for the decision the mean is drawn towards the trusted one by `prior` tokens, since short texts say
little. The threshold is, by language, the `quantile` of that score, up to 1/1024, over all trusted documents that their
model hasn't seen, plus `slack`; documents above it are rejected. Mean and threshold are a language's own from `OWN_DOCS` such
documents on.

Defined results: null or empty texts have 0 tokens, no perplexity, and are rejected; null languages use the
shared model; repeated rows are scored alike; where one half has no document of a model, the other alone gives the costs and
its own documents set no threshold; a doc_id that labels call both good and bad is not trusted. Without
trusted documents nothing can be judged and every document with tokens is kept. Scores equal to the threshold are kept.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: For a model of a part: the part of a language's trusted documents, and the number up to which it is half of them.
SHARE, LEAST, SHARED = 0.0625, 400, ""
#: Part of these that other languages give to its shared model.
SHARED_PART = 0.125
QUANTILE, SLACK, PRIOR = 0.99, 0.1, 20.0
#: Held-out trusted documents a language needs for a threshold of its own, and trusted ones for a model of its own.
OWN_DOCS, MODEL_DOCS = 20, 20
#: Steps of a score in which thresholds are found.
STEPS = 1024
#: Parts into which the shards are dealt at most, the places in texts from which there is one more, and those of a shard
#: and of a group of words.
PARTS, PART, SHARD, GROUP = 12, 1_500_000, 600_000, 6_000_000
#: Places from which a middle word, or a context, is dealt over all shards.
HOT = 1_000_000
#: The number, in a row, of a document that isn't scored.
NOWHERE = 0xFFFF
#: Sizes of tables that scoring had before; nothing reads them now, but callers may set them.
FILTER_BITS, SLOT_BITS = 26, 22
#: Megabytes of text that a worker gets at once.
BATCH = 8
#: Turns in which texts meet labels and words are counted; trusted documents from which texts take turns.
TURNS, MANY = 4, 10_000
#: Places of a language's documents by hash.
PLACES = 1 << 20
#: Spellings that a worker remembers.
MEMO = 150_000
#: Hashes of the start and the end of a text; like all, they have their shape (0) in the lowest three bits.
START, END = 8, 16
_TOKENS = re.compile(r"\w+|[^\w\s]+")
# The primes of the hash function.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def plain(word: str) -> str:
    """A capitalised word in small letters; others as they are."""
    return word.lower() if word[0].isupper() and (len(word) == 1 or word[1:].islower()) else word


def shape(word: str) -> int:
    """Class 1 to 7 of a word: small letters, capitals, mixed, digits, digits and letters, one symbol, more symbols."""
    if word.isalpha():
        return 1 if word.islower() else 2 if word.isupper() and len(word) > 1 else 3
    if any(c.isalnum() for c in word):
        return 4 if word.isdigit() else 5
    return 6 if len(word) == 1 else 7


def hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's xxhash64 of a column of longs, given the hash of the columns before it."""
    x = x * P2
    x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * P1
    h = (seed + P5 + np.uint64(8)) ^ x
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """xxhash64(a, b)."""
    return hash_long(b, hash_long(a, np.uint64(42)))


def seed_of(model: str) -> int:
    return xxhash.xxh64_intdigest(model, seed=3)


class Ngrams:
    """Hashes of the n-grams of a batch of texts; distinct runs between blanks are cut and hashed once."""

    def __init__(self, memo: int = MEMO):
        self.memo, self.known = memo, {}

    def _run(self, run: str) -> bytes:
        return b"".join((xxhash.xxh64_intdigest(w) & ~7 | shape(w)).to_bytes(8, "little") for w in map(plain, _TOKENS.findall(run)))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and the number of each text's."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        runs, known = coded.dictionary.to_pylist(), self.known
        own = [known.get(r) for r in runs]
        fresh = {r: self._run(r) for r, g in zip(runs, own, strict=True) if g is None}
        own = [fresh[r] if g is None else g for r, g in zip(runs, own, strict=True)]
        known.update(islice(fresh.items(), max(self.memo - len(known), 0)))
        flat, sizes = np.frombuffer(b"".join(own), np.uint64), np.array([len(g) // 8 for g in own], np.int64)
        codes = coded.indices.to_numpy()
        each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        first = (np.cumsum(sizes) - sizes)[codes] if len(codes) else each
        hashes = flat[np.repeat(first - (ends - each), each) + np.arange(ends[-1])] if len(ends) and ends[-1] else flat[:0]
        begin = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return hashes, np.diff(begin)

    def __call__(self, texts: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Numbers of tokens; and, for all texts in a row (two starts, words, end), each place's text and its word's key."""
        hashes, n = self.words(texts)
        at = np.repeat(np.arange(len(n)), n + 3)
        first = np.cumsum(n + 3) - (n + 3)
        y = np.full(len(at), START, np.uint64)
        y[np.arange(len(hashes)) + 3 * np.repeat(np.arange(len(n)), n) + 2] = hashes
        y[first + n + 2] = END
        return n, at, hash_long(y, seeds[at]) & ~np.uint64(7) | y & np.uint64(7)


def discounts(counts: dict[int, int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many n-grams occur once to four times."""
    n = [0.0] + [float(counts.get(i, 0)) for i in (1, 2, 3, 4)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) if n[i] else 0.5 * i for i in (1, 2, 3)]


def _joined_bytes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values from each cut to the next."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


_BLOCK = "block long, doc_id array<long>, row_key array<long>, lang array<string>, model array<int>, half array<int>, scored array<boolean>, n array<long>, places long, words binary, owners binary, codes binary"


_READ = ["block", "half", "scored", "n", "words", "owners", "codes"]


def _planes(codes: np.ndarray, words: int) -> bytes:
    """The codes' lowest bytes, then their second ones and so on, which compresses better."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[: 3 if words <= 1 << 24 else 4]).tobytes()


def _from_planes(data: bytes, words: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3 if words <= 1 << 24 else 4, -1)
    codes = planes[0].astype(np.uint32)
    for i, plane in enumerate(planes[1:], 1):
        codes |= plane.astype(np.uint32) << np.uint32(8 * i)
    return codes


def _emit_blocks(seeds: dict[int, int], call: str, turn: int):
    """A row for each batch of texts: its distinct words (keys, and the models they belong to) and, for all places in a row, their codes."""

    @common.tidy
    def run(batches):
        ngrams, number = common.worker_state(call, Ngrams), turn << 56 | TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            model = batch.column("model").to_numpy()
            n, at, k1 = ngrams(batch.column("text"), np.array([seeds[int(m)] for m in model], np.uint64))
            coded = pa.array(k1).dictionary_encode()
            words, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words have small codes
            place = np.empty(len(words), np.int32)
            place[often] = np.arange(len(words), dtype=np.int32)
            words, codes = words[often], place[codes]
            owners = np.zeros(len(words), np.int32)
            owners[codes] = model[at]
            lists = [pa.array([batch.column(c).to_pylist()], pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("row_key", pa.int64()), ("lang", pa.string()), ("model", pa.int32()), ("half", pa.int32()), ("scored", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([n], pa.list_(pa.int64())), pa.array([len(codes)], pa.int64()), *(pa.array([x], pa.binary()) for x in (words.tobytes(), owners.tobytes(), _planes(codes, len(words))))], [x.split()[0] for x in _BLOCK.split(", ")])
            number += 1

    return run


def _to(keys: np.ndarray, number: int) -> np.ndarray:
    """The shard of a key."""
    return ((keys >> np.uint64(20)) % np.uint64(number)).astype(np.int64)


class _Block:
    """A stored block: its distinct words, and the codes of those at all places."""

    def __init__(self, row: dict, hot: tuple[np.ndarray, np.ndarray]):
        self.words, self.owners = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["owners"], np.int32)
        self.codes = _from_planes(row["codes"], len(self.words))
        n = np.array(row["n"], np.int64) + 3
        self.ends = np.cumsum(n)
        self.edges = np.r_[self.ends - n, self.ends - 1]
        self.half = np.array([-1 if h is None else h for h in row["half"]], np.int8)
        self.scored = np.array(row["scored"], bool)
        self.hot, self.hot_word = hot, np.isin(self.words, hot[0])

    def middle(self, chosen: np.ndarray) -> np.ndarray:
        """Places of chosen words in the middle of a trigram."""
        here = chosen[self.codes]
        here[self.edges] = False
        return np.flatnonzero(here)

    def keys(self, places: np.ndarray) -> np.ndarray:
        return self.words[self.codes[places]]

    def part(self, part: int, parts: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of a part of the shards, their shards (by middle word; where that is hot, by context; where that is hot too, by trigram), and which of these it is."""
        of_word = _to(self.words, shards)
        own = self.middle((of_word % parts == part) & ~self.hot_word)
        shard, level = of_word[self.codes[own]], np.zeros(len(own), np.int8)
        if self.hot_word.any():
            here = self.middle(self.hot_word)
            uv = joined(self.keys(here - 1), self.keys(here))
            to, of = _to(uv, shards), np.ones(len(here), np.int8)
            split = np.flatnonzero(np.isin(uv, self.hot[1]))
            to[split], of[split] = _to(joined(uv[split], self.keys(here[split] + 1)), shards), 2
            mine = to % parts == part
            own, shard, level = np.r_[own, here[mine]], np.r_[shard, to[mine]], np.r_[level, of[mine]]
        return own, shard, level


def _emit_hot(least: int):
    """Words in the middle and contexts with their number of places in a block, from `least` on."""

    @common.tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, (np.zeros(0, np.uint64),) * 2)
                n = np.bincount(block.codes[block.middle(np.ones(len(block.words), bool))], minlength=len(block.words))
                many = np.flatnonzero(n >= least)
                here = block.middle(n >= least)
                uv, m = np.unique(joined(block.keys(here - 1), block.keys(here)), return_counts=True)
                key, count = np.r_[block.words[many], uv[m >= least]], np.r_[n[many], m[m >= least]]
                order = np.r_[np.ones(len(many), np.int32), np.full(len(key) - len(many), 2, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(key.view(np.int64)), pa.array(count, pa.int64())], ["words", "key", "n"])

    return run


def _hot(blocks: DataFrame, places: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all middle words and contexts with HOT places or more (and some from half of that on): few, whatever the input."""
    found: dict[int, list[int]] = {1: [], 2: []}
    if places >= HOT:
        # one with HOT places has half of them in blocks where it has HOT / (2 * number) or more
        rows = blocks.select(*_READ).mapInArrow(_emit_hot(max(1, HOT // (2 * number))), "words int, key long, n long").groupBy("words", "key").agg(F.sum("n").alias("n"))
        for r in rows.where(F.col("n") >= HOT // 2).collect():
            found[r["words"]].append(r["key"])
    return tuple(np.sort(np.array(found[i], np.int64).view(np.uint64)) for i in (1, 2))


_NGRAMS = {"u": "u8", "v": "u8", "w": "u8", "model": "i4", "level": "i1", "c0": "u4", "c1": "u4"}
_NGRAM_ROW, _WITH_DOCS = "shard long, " + ", ".join(f"{x} binary" for x in _NGRAMS), ", n binary, docs binary, block long"


def _emit_ngrams(part: int, parts: int, shards: int, hot: tuple[np.ndarray, np.ndarray], with_docs: bool = False):
    """For each block and shard of this part a row of its distinct trigrams with their counts in both halves; and, if asked for, the documents at their places."""

    @common.tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, hot)
                own, shard, level = block.part(part, parts, shards)
                if not len(own):
                    continue
                u, v, w = (block.codes[own + i].astype(np.uint64) for i in (-1, 0, 1))
                if len(block.words) < 1 << 21:
                    key = v << np.uint64(42) | u << np.uint64(21) | w
                else:
                    key = joined(joined(block.words[u], block.words[v]), block.words[w])
                order = np.argsort(key)
                order = order[np.argsort((shard[order] // parts).astype(np.min_scalar_type(shards)), kind="stable")]
                key, own, shard, level = key[order], own[order], shard[order], level[order]
                begin = _firsts(key)  # a trigram has one shard
                first, docs = own[begin], np.searchsorted(block.ends, own, "right")
                half = block.half[docs]
                out = {"u": block.keys(first - 1), "v": block.keys(first), "w": block.keys(first + 1), "model": block.owners[block.codes[first]], "level": level[begin]}
                out |= {f"c{j}": np.add.reduceat(half == j, begin, dtype=np.uint32) for j in (0, 1)}
                cuts = np.r_[_firsts(shard[begin]), len(begin)]
                columns = [pa.array(shard[begin[cuts[:-1]]]), *(_binaries(out[x].astype(t), cuts) for x, t in _NGRAMS.items())]
                names = ["shard", *_NGRAMS]
                if with_docs:
                    begin = np.r_[begin, len(own)]
                    docs = np.where(block.scored[docs], docs, NOWHERE).astype("u2")
                    columns += [_binaries(np.diff(begin).astype("u4"), cuts), _binaries(docs, begin[cuts]), pa.array(np.full(len(cuts) - 1, row["block"]), pa.int64())]
                    names += ["n", "docs", "block"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


#: What shards and groups of words tell each other: a row of counts for each kind, group and shard.
_TOLD = {"model": "i4", "x": "u8", "y": "u8", "c0": "u4", "c1": "u4"}
_TOLD_ROW = "kind int, to long, shard long, " + ", ".join(f"{x} binary" for x in _TOLD)
#: Kinds: for each word the contexts before it; for each bigram of a hot word the words before it; and, for the driver,
#: how many trigrams, bigrams and words (by shape) have a count, and the same of each hot context and hot word.
WORDS, PAIRS, OF3, OF2, OF1, CONTEXTS, HOT_WORDS = range(7)


def _told(kind: int, shard: int, to: np.ndarray | int, model: np.ndarray, x: np.ndarray, y: np.ndarray | int, c: list[np.ndarray]) -> pa.Table:
    """Rows by group, each in the order at hand."""
    to = np.zeros(len(x), np.int64) + to
    order = np.argsort(to, kind="stable")
    cuts = np.r_[_firsts(to[order]), len(order)]
    y = y if isinstance(y, np.ndarray) else np.full(len(x), y)
    own = [pa.array(np.full(len(cuts) - 1, kind), pa.int32()), pa.array(to[order][cuts[:-1]], pa.int64()), pa.array(np.full(len(cuts) - 1, shard), pa.int64())]
    return pa.table([*own, *(_binaries(z[order].astype(t), cuts) for z, t in zip((model, x, y, *c), _TOLD.values(), strict=True))], ["kind", "to", "shard", *_TOLD])


def _of_counts(kind: int, model: np.ndarray, key: np.ndarray, c: list[np.ndarray], total: bool = False) -> pa.Table:
    """By key how often a count is 1, 2, 3, 4 and more (y), and their sum (y = 0)."""
    keys, first, at = np.unique(key, return_index=True, return_inverse=True)
    n = []
    for own in c:
        of = np.bincount(at * 6 + np.minimum(own, 5), minlength=6 * len(keys)).reshape(-1, 6)
        of[:, 0] = np.bincount(at, own, len(keys))
        n.append(of.ravel())
    return _told(kind, -1, -1, np.repeat(model[first], 6), np.repeat(keys, 6), np.tile(np.arange(6), len(keys)), n)


def _of_models(kind: int, model: np.ndarray, c: list[np.ndarray]) -> pa.Table:
    return _of_counts(kind, model, model.astype(np.uint64), c)


def _count_shard(groups: int):
    """Counts that go beyond a shard. Of all its words, also those without trusted contexts: the answer says what other shards have."""

    def run(table: pa.Table) -> pa.Table:
        shard, own = table.column("shard")[0].as_py(), {x: _joined_bytes(table.column(x), t) for x, t in _NGRAMS.items()}
        uv = joined(own["u"], own["v"])
        _, first, at = np.unique(joined(uv, own["w"]), return_index=True, return_inverse=True)
        c = [np.bincount(at, own[f"c{j}"], len(first)).astype(np.int64) for j in (0, 1)]
        uv, v, w, model, level = (x[first] for x in (uv, own["v"], own["w"], own["model"], own["level"]))
        out, hot = [_of_models(OF3, model, c)], np.flatnonzero(level == 2)
        if len(hot):
            out.append(_of_counts(CONTEXTS, model[hot], uv[hot], [x[hot] for x in c]))
        key, first, at = np.unique(joined(v, w), return_index=True, return_inverse=True)
        c = [np.bincount(at, x > 0, len(first)).astype(np.int64) for x in c]
        v, w, model, level = (x[first] for x in (v, w, model, level))
        whole, split = np.flatnonzero(level == 0), np.flatnonzero(level > 0)
        out.append(_of_models(OF2, model[whole], [x[whole] for x in c]))
        words, first, at = np.unique(w, return_index=True, return_inverse=True)
        out.append(_told(WORDS, shard, _to(words, groups), model[first], words, 0, [np.bincount(at, (x > 0) & (level == 0), len(words)).astype(np.int64) for x in c]))
        out.append(_told(PAIRS, shard, _to(key[split], groups), model[split], v[split], w[split], [x[split] for x in c]))
        return pa.concat_tables(out)

    return run


def _answers(table: pa.Table, c: list[np.ndarray], lengths: np.ndarray) -> pa.Table:
    """The rows of shards with the counts of all shards."""
    cuts = np.r_[0, np.cumsum(lengths)]
    none = pa.array([b""] * len(table), pa.binary())
    own = pa.table([*(table.column(x).combine_chunks() for x in ("kind", "to", "shard")), none, none, none, *(_binaries(x.astype("u4"), cuts) for x in c)], ["kind", "to", "shard", *_TOLD])
    return own.filter(pc.greater_equal(own.column("shard"), 0))


def _lengths(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64) // size


def _count_pairs(groups: int):
    def run(table: pa.Table) -> pa.Table:
        own = {x: _joined_bytes(table.column(x), t) for x, t in _TOLD.items()}
        _, first, at = np.unique(joined(own["x"], own["y"]), return_index=True, return_inverse=True)
        c = [np.bincount(at, own[f"c{j}"], len(first)).astype(np.int64) for j in (0, 1)]
        v, w, model = (own[x][first] for x in ("x", "y", "model"))
        words, of, to = np.unique(w, return_index=True, return_inverse=True)
        more = _told(WORDS, -1, _to(words, groups), model[of], words, 0, [np.bincount(to, x > 0, len(words)).astype(np.int64) for x in c])
        return pa.concat_tables([_answers(table, [x[at] for x in c], _lengths(table.column("x"), 8)), more, _of_counts(HOT_WORDS, model, v, c)])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    own = {x: _joined_bytes(table.column(x), t) for x, t in _TOLD.items()}
    words, first, at = np.unique(own["x"], return_index=True, return_inverse=True)
    c = [np.bincount(at, own[f"c{j}"], len(words)).astype(np.int64) for j in (0, 1)]
    model = own["model"][first]
    return pa.concat_tables([_answers(table, [x[at] for x in c], _lengths(table.column("x"), 8)), _of_counts(OF1, model, model.astype(np.uint64) << np.uint64(3) | words & np.uint64(7), c)])


def _apart(batches):
    """Rows for the driver, one for each count."""
    for batch in batches:
        own = {x: _joined_bytes(pa.chunked_array([batch.column(x)]), t).astype(np.int64) if x not in "xy" else _joined_bytes(pa.chunked_array([batch.column(x)]), "i8") for x, t in _TOLD.items()}
        kind = np.repeat(batch.column("kind").to_numpy(), _lengths(pa.chunked_array([batch.column("x")]), 8))
        yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, own.values())], ["kind", *own])


def _rated(c: np.ndarray, of: np.ndarray, n: int, d: np.ndarray, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of counts c with contexts `of` and their discounts: the discounted share of each, and of each context what is left to lower orders. Sums of `known` contexts are given."""
    total, taken = np.bincount(of, c, n), np.bincount(of, d, n)
    at, total[at], taken[at] = known
    some = np.maximum(total, 1)
    return (c - d) / some[of], np.where(total > 0, taken / some, 1.0)


def _score_shard(groups: int, d: np.ndarray, totals: np.ndarray, unseen: np.ndarray, hot: tuple, sums: tuple):
    """By block the cost of each document's places in a shard.

    d: discounts by order, half, model and count; totals: of a model's words; unseen: cost of these by shape; sums: totals
    of hot words and hot contexts and what discounts take of them, by half.
    """

    def known(kind: int, keys: np.ndarray, j: int) -> tuple:
        at = np.flatnonzero(np.isin(keys, hot[kind]))
        own = sums[kind][np.searchsorted(hot[kind], keys[at]), j]
        return at, own[:, 0], own[:, 1]

    def told(answers: pa.Table, kind: int, keys: np.ndarray, j: int) -> np.ndarray:
        rows = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("to")
        out = np.zeros(len(keys), np.int64)
        out[np.argsort(_to(keys, groups), kind="stable")] = _joined_bytes(rows.column(f"c{j}"), "u4")
        return out

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = {x: _joined_bytes(table.column(x), t) for x, t in _NGRAMS.items()}
        uv = joined(own["u"], own["v"])
        _, first, at = np.unique(joined(uv, own["w"]), return_index=True, return_inverse=True)
        model, level, v, w = (own[x][first] for x in ("model", "level", "v", "w"))
        contexts, uv = np.unique(uv[first], return_inverse=True)
        pairs, second, vw = np.unique(joined(v, w), return_index=True, return_inverse=True)
        befores, before = np.unique(v[second], return_inverse=True)
        words, third, word = np.unique(w[second], return_index=True, return_inverse=True)
        split, model2, model1 = np.flatnonzero(level[second] > 0), model[second], model[second][third]
        n, lengths = _joined_bytes(table.column("n"), "u4"), _lengths(table.column("u"), 8)
        docs = np.repeat(np.repeat(np.arange(len(lengths)), lengths), n) << 16 | _joined_bytes(table.column("docs"), "u2")
        key, to = np.unique(docs, return_inverse=True)
        keep, costs = key & NOWHERE != NOWHERE, []
        for j in (0, 1):
            c3 = np.bincount(at, own[f"c{j}"], len(first)).astype(np.int64)
            c2 = np.bincount(vw, c3 > 0, len(second)).astype(np.int64)
            c2[split] = told(answers, PAIRS, pairs[split], j)
            c1 = told(answers, WORDS, words, j)
            p1 = (c1 - d[0, j, model1, np.minimum(c1, 3)]) / totals[j, model1] + unseen[j, model1, (words & np.uint64(7)).astype(np.int64)]
            share2, left2 = _rated(c2, before, len(befores), d[1, j, model2, np.minimum(c2, 3)], known(0, befores, j))
            p2 = share2 + left2[before] * np.where(p1 > 0, p1, 1.0)[word]
            share3, left3 = _rated(c3, uv, len(contexts), d[2, j, model, np.minimum(c3, 3)], known(1, contexts, j))
            cost = -np.log(share3 + left3[uv] * p2[vw])
            costs.append(np.bincount(to, np.repeat(cost[at], n), len(key))[keep].astype(np.float32))
        begin = np.searchsorted(key[keep] >> 16, np.arange(len(lengths) + 1))
        return pa.table([table.column("block").combine_chunks(), _binaries((key[keep] & NOWHERE).astype("u2"), begin), *(_binaries(x, begin) for x in costs)], ["block", "docs", "cost0", "cost1"])

    return run


def _sum_block(table: pa.Table) -> pa.Table:
    docs = _joined_bytes(table.column("docs"), "u2")
    own = np.unique(docs)
    sums = [np.bincount(docs, _joined_bytes(table.column(f"cost{j}"), "f4").astype(np.float64), int(own[-1]) + 1)[own] if len(own) else np.zeros(0) for j in (0, 1)]
    return pa.table([pa.array(np.full(len(own), table.column("block")[0].as_py()), pa.int64()), pa.array(own, pa.int32()), *(pa.array(x) for x in sums)], ["block", "doc", "cost0", "cost1"])


def _taken(d: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What discounts take of contexts, from how often they have the counts 1 to 5 (places 1 to 5 of the last axis)."""
    return d[..., 1] * of[..., 1] + d[..., 2] * of[..., 2] + d[..., 3] * of[..., 3:].sum(-1)


def _costs(texts: DataFrame, models: dict[str, int], large: bool) -> tuple[DataFrame, list[set[int]]]:
    """Of texts (doc_id, row_key, lang, text, model, half, scored) a stored table of those to be scored, with n_tokens and a cost by each half; and the models that each half has.

    Texts are stored as words once, many of them in turns, since they meet their labels in a shuffle. Trigrams then are counted, and scored, a part of all shards at a time, so that only a part is in shuffles at once.
    """
    spark, mark = texts.sparkSession, common.mark()
    seeds, size = {i: seed_of(x) for x, i in models.items()}, max(models.values()) + 1
    call, turns, turn = uuid.uuid4().hex, TURNS if large else 1, F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(TURNS))
    blocks = [common.stored((texts.where(turn == i) if large else texts).mapInArrow(_emit_blocks(seeds, call, i), _BLOCK), "kn-blocks") for i in range(turns)]
    blocks = functools.reduce(DataFrame.unionByName, blocks)
    found = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("places"), F.lit(0)).alias("places")).first()
    hot = _hot(blocks, found["places"], max(1, found["n"]))
    parts = min(PARTS, -(-found["places"] // PART) or 1)
    shards, groups = parts * max(1, -(-found["places"] // (SHARD * parts))), -(-found["places"] // GROUP) or 1

    # counts of shards; then those of words, and of bigrams of hot words, over all shards, for each shard that has them
    fewer, asked = -(-2 * parts // 3), []  # counting moves less than scoring
    for i in range(fewer):
        rows = blocks.select(*_READ).mapInArrow(_emit_ngrams(i, fewer, shards, hot), _NGRAM_ROW)
        asked.append(common.stored(rows.groupBy("shard").applyInArrow(_count_shard(groups), _TOLD_ROW), "kn-counts"))
    asks = functools.reduce(DataFrame.unionByName, asked)
    own, kind = asks.where(F.col("kind") == WORDS), F.col("kind")
    told = []
    if len(hot[0]):
        told.append(common.stored(asks.where(kind == PAIRS).groupBy("to").applyInArrow(_count_pairs(groups), _TOLD_ROW), "kn-pairs"))
        own = own.unionByName(told[0].where((kind == WORDS) & (F.col("shard") < 0)))
    turns = min(TURNS, groups)
    told += [common.stored(own.where(F.col("to") % turns == i).groupBy("to").applyInArrow(_count_words, _TOLD_ROW), "kn-words") for i in range(turns)]
    counts = functools.reduce(DataFrame.unionByName, [asks, *told]).where(kind >= OF3).mapInArrow(_apart, "kind int, model long, x long, y long, c0 long, c1 long")
    counts = counts.groupBy("kind", "model", "x", "y").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))

    # at the driver six rows for each model, shape, hot word and hot context
    of, shapes, hot_of = np.zeros((3, 2, size, 6)), np.zeros((2, size, 8, 6)), [{}, {}]
    for r in counts.collect():
        c = r["c0"], r["c1"]
        if r["kind"] == OF1:
            shapes[:, r["model"], r["x"] & 7, r["y"]] = c
        elif r["kind"] in (OF2, OF3):
            of[1 if r["kind"] == OF2 else 2, :, r["model"], r["y"]] += c
        else:
            hot_of[r["kind"] == CONTEXTS].setdefault(r["x"], (r["model"], np.zeros((2, 6))))[1][:, r["y"]] = c
    common.drop_since(spark, mark, blocks, *told)
    of[0] = shapes.sum(2)
    for m, c in hot_of[0].values():
        of[1, :, m] += c
    d = np.array([[[[0.0, *discounts(dict(enumerate(of[i, j, m])))] for m in range(size)] for j in (0, 1)] for i in range(3)])
    once, kinds = shapes[:, :, :, 1] + 1, shapes[:, :, :, 1:].sum(-1) + 1
    once[:, :, 0] = 0.0
    totals = np.maximum(of[0, :, :, 0], 1)
    unseen = (_taken(d[0], of[0]) / totals)[:, :, None] * once / once.sum(-1)[:, :, None] / kinds
    sums = []
    for i in (0, 1):
        own = np.zeros((len(hot[i]), 2, 2))
        for at, x in enumerate(hot[i].view(np.int64).tolist()):
            if x in hot_of[i]:
                m, c = hot_of[i][x]
                own[at] = np.stack([c[:, 0], _taken(d[1 + i, :, m], c)], -1)
        sums.append(own)

    score, costs = _score_shard(groups, d, totals, unseen, hot, tuple(sums)), []
    answers = functools.reduce(DataFrame.unionByName, told).where((F.col("shard") >= 0) & kind.isin(WORDS, PAIRS)).select("shard", "kind", "to", "c0", "c1")
    for i in range(parts):
        rows = blocks.select(*_READ).mapInArrow(_emit_ngrams(i, parts, shards, hot, True), _NGRAM_ROW + _WITH_DOCS).groupBy("shard")
        rows = rows.cogroup(answers.where(F.col("shard") % parts == i).groupBy("shard")).applyInArrow(score, "block long, docs binary, cost0 binary, cost1 binary")
        costs.append(common.stored(rows.groupBy("block").applyInArrow(_sum_block, "block long, doc int, cost0 double, cost1 double"), "kn-costs"))
    costs = functools.reduce(DataFrame.unionByName, costs).groupBy("block", "doc").agg(F.sum("cost0").alias("cost0"), F.sum("cost1").alias("cost1"))
    each = blocks.select("block", F.posexplode(F.arrays_zip("doc_id", "row_key", "lang", "model", "half", "scored", F.col("n").alias("n_tokens"))).alias("doc", "own")).select("block", "doc", "own.*").where("scored")
    scores = common.stored(each.join(costs, ["block", "doc"]).drop("block", "doc", "scored"), "scores")
    common.drop_since(spark, mark, scores)
    return scores, [{m for m in range(size) if of[0, j, m, 0] > 0} for j in (0, 1)]


def row_key() -> Column:
    """Identifies a document where doc_id may be null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key")


def _trusted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """doc_id, row_key, lang, text of docs; the stored doc_id, lang, place of trusted ones; and how many of these a language has."""
    common.arrow_batches(docs.sparkSession, BATCH)
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), F.coalesce(F.col("lang").cast("string"), F.lit(SHARED)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = own.select("doc_id", "lang").distinct().join(good, "doc_id").withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(PLACES)))
    trusted = common.stored(found, "trusted")
    return own, trusted, {r["lang"]: r["n"] for r in trusted.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}


def _owners(sizes: dict[str, int]) -> tuple[list[str], dict[str, int]]:
    """The languages with models of their own, and all models by language."""
    langs = sorted(x for x, n in sizes.items() if n >= MODEL_DOCS and x != SHARED)
    return langs, {SHARED: 0} | {x: i + 1 for i, x in enumerate(langs)}


def _texts(own: DataFrame, counted: DataFrame, langs: list[str], models: dict[str, int], shared: DataFrame | None) -> DataFrame:
    """What _costs() takes; `counted` (doc_id, lang, half) are counted, and `shared` of them for the shared model too."""
    texts = own.withColumn("model", _model_of(langs, models)).join(counted, ["doc_id", "lang"], "left").withColumn("scored", F.lit(True))
    if shared is not None:
        texts = texts.unionByName(own.join(shared, ["doc_id", "lang"]).withColumn("model", F.lit(0)).withColumn("scored", F.lit(False)))
    return texts.select("doc_id", "row_key", "lang", "text", "model", "half", "scored")


def scored(docs: DataFrame, labels: DataFrame, *, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """By models of a part: a stored table doc_id, row_key, lang, n_tokens, cost of all docs; and the held-out trusted doc_ids."""
    spark, mark = docs.sparkSession, common.mark()
    own, trusted, sizes = _trusted(docs, labels)
    langs, models = _owners(sizes)
    # a row a language: its model, and the places of documents trained on
    places = {x: int(PLACES * max(share, min(0.5, least / n))) for x, n in sizes.items()}
    table = spark.createDataFrame([(x, models.get(x, 0), places[x]) for x in sizes], "lang string, model int, places int")
    pool = trusted.join(F.broadcast(table), "lang").where("place < places")
    chosen = common.stored(pool.select("doc_id", "lang", F.lit(0).alias("half"), (F.col("place") < F.col("places") * SHARED_PART).alias("shared"), "model"), "trained-on")
    shared = None
    if langs and own.where(~F.col("lang").isin(langs)).limit(1).count():  # some documents need the shared model
        shared = chosen.where("shared and model > 0").select("doc_id", "lang", "half")
    scores, _ = _costs(_texts(own, chosen.select("doc_id", "lang", "half"), langs, models, shared), models, sum(sizes.values()) >= MANY)
    held = common.stored(trusted.select("doc_id").join(chosen.select("doc_id").distinct(), "doc_id", "left_anti").distinct(), "held-out")
    common.drop_since(spark, mark, scores, held)
    return scores.select("doc_id", "row_key", "lang", "n_tokens", F.col("cost0").alias("cost")), held


def cross_scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By models of both halves of all trusted documents: tables as of scored(); all trusted doc_ids whose costs are by the other half."""
    spark, mark = docs.sparkSession, common.mark()
    own, trusted, sizes = _trusted(docs, labels)
    langs, models = _owners(sizes)
    halved = trusted.withColumn("model", _model_of(langs, models)).withColumn("half", (F.col("place") >= PLACES // 2).cast("int"))
    counted, shared = halved.select("doc_id", "lang", "half"), None
    if langs and own.where(~F.col("lang").isin(langs)).limit(1).count():  # some documents need the shared model
        shared = halved.where("model > 0").select("doc_id", "lang", "half")
    costs, (first, second) = _costs(_texts(own, counted, langs, models, shared), models, sum(sizes.values()) >= MANY)
    there = [F.col("model").isin(sorted(x)) if x else F.lit(False) for x in (first, second)]
    other = (F.col("half") == 0) & there[1] | (F.col("half") == 1) & there[0]
    cost = F.when(other, F.when(F.col("half") == 0, F.col("cost1")).otherwise(F.col("cost0")))
    cost = cost.when(there[0] & there[1], (F.col("cost0") + F.col("cost1")) / 2).otherwise(F.when(there[0], F.col("cost0")).otherwise(F.col("cost1")))
    scores = common.stored(costs.select("doc_id", "row_key", "lang", "n_tokens", cost.alias("cost")), "scores")
    held = common.stored(halved.where(other).select("doc_id").distinct(), "held-out")
    common.drop_since(spark, mark, scores, held)
    return scores, held


def _model_of(langs: list[str], models: dict[str, int]) -> Column:
    if not langs:
        return F.lit(0)
    pairs = [F.lit(x) for lang in langs for x in (lang, models[lang])]
    return F.coalesce(F.create_map(*pairs)[F.col("lang")], F.lit(0))


def _limits(rows: DataFrame, quantile: float, keys: list[str]) -> DataFrame:
    """keys, limit: the upper end of the step in which the quantile of `score` lies. Rows meet as counts by step."""
    steps = rows.groupBy(*keys, F.floor(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto = steps.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("step"))).withColumn("of", F.sum("n").over(Window.partitionBy(*keys)))
    return upto.where(F.col("upto") >= quantile * F.col("of")).groupBy(*keys).agg(((F.min("step") + 1) / STEPS).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, *, share: float | None = None, least: int | None = None, quantile: float = QUANTILE, slack: float = SLACK, prior: float = PRIOR) -> DataFrame:
    """Per document: doc_id, lang, n_tokens, perplexity, score, threshold, keep, row_key."""
    spark = docs.sparkSession
    if share is None and least is None:
        scores, held = cross_scored(docs, labels)
    else:
        scores, held = scored(docs, labels, share=SHARE if share is None else share, least=LEAST if least is None else least)
    mark = common.mark()
    rest = scores.join(held, "doc_id", "left_semi").where("n_tokens > 0")
    tokens = F.col("n_tokens") + 1
    mean = F.sum("cost") / F.sum(tokens)

    def score(middle: Column) -> Column:
        return (F.col("cost") + prior * middle) / (tokens + prior)

    middle = F.lit(rest.agg(mean).first()[0] or 0.0)
    general = _limits(rest.select(score(middle).alias("score"), F.lit(0).alias("all")), quantile, ["all"]).first()
    general = F.lit(general["limit"] + slack if general else None).cast("double")
    # a row a language
    means = common.stored(rest.groupBy("lang").agg(mean.alias("middle"), F.count(F.lit(1)).alias("held")).where(F.col("held") >= OWN_DOCS).drop("held"), "language-means")
    limits = _limits(rest.join(F.broadcast(means), "lang").select("lang", score(F.col("middle")).alias("score")), quantile, ["lang"])
    limits = common.stored(means.join(limits, "lang").select("lang", "middle", (F.col("limit") + slack).alias("own")), "language-limits")
    common.drop_since(spark, mark, limits)
    out = scores.join(F.broadcast(limits), "lang", "left").withColumn("score", F.when(F.col("n_tokens") > 0, score(F.coalesce("middle", middle)))).withColumn("threshold", F.coalesce("own", general))
    keep = (F.col("n_tokens") > 0) & (F.col("threshold").isNull() | (F.col("score") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_tokens", F.when(F.col("n_tokens") > 0, F.exp(F.col("cost") / tokens)).alias("perplexity"), "score", "threshold", keep.alias("keep"), "row_key")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
