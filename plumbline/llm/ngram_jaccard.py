"""N-gram Jaccard join: components of documents whose sets of word 5-grams have a similarity of 0.75 or more.

Words are runs of other than ASCII white space in the text with A-Z in small letters. Equal sets form a class.
Shingles are hashes, and their order by hash is the first global one. For sets x, y that overlap enough, the prefixes of
length |x| - ceil(0.75 |x|) + k share at least k tokens; a prefix extended by k - 1 thus stands for all
combinations of k of its tokens, and k grows with the set. Tokens of at most `rare` classes are indexed singly: their lists
give pairs with the number of shared tokens. Tokens of longer lists are the frequent class. They only lower the count
that a pair needs by as many frequent tokens as both have.

Classes whose frequent tokens alone could make up k are indexed anew among themselves, in an order with frequent tokens last:
all their tokens are counted, and prefixes taken of rare tokens first. Sets that merely share a passage then have none but
rare tokens in their prefixes. What is left are sets made of frequent tokens for the most part. Up to `HIGH` shingles
these are indexed by combinations of two frequent tokens, which every similar pair without a shared rare token shares;
longer ones, whose combinations would be too many, by single tokens. Of lists of these beyond `rare`, all classes are verified
against the first, the leader. What is linked to the leader is joined. What is not is compared, in blocks of bounded
size, with the leader's other members, but for those linked to it that cannot be within reach: the Jaccard distance is a
metric, so a link needs |d(l, y) - d(l, x)| <= 1/4. A block yields a forest of its links, not pairs. Candidates are verified
on whole sets. So every link between different sets is found or implied by links found; components are those of all links.

Tokens that hold a good part of all postings are told by a sample of classes and leave the shuffled lists; that
they are frequent is certain from the sample alone.

Defined results: null and empty texts have no shingles and are linked with nothing; texts of fewer than five words
are one shingle; equal rows are in one component; null doc_ids take part and count as the largest. Extra
columns are ignored. An empty table gives no rows. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, PERCENT, RARE = 5, 75, 32
#: Sets up to HIGH shingles are indexed by combinations of two frequent tokens, those above LOW by single ones. Similar sets differ
#: by less than HIGH / LOW in size, so each pair has one of the two in common.
LOW, HIGH = 64, 86
#: Part of classes whose postings are counted beforehand, and tokens that leave the lists at most.
SAMPLED, TOP = 64, 20_000
#: Sets on each side of a block.
BLOCK = 640
#: Words whose hashes a worker remembers.
MEMO = 200_000
NULL_ID = (1 << 63) - 1
#: Documents to verify up to which their ids (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: Odd multipliers that spread the words of a shingle.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shingles:
    """Sorted distinct hashes of a text's shingles; words are hashed once each and kept."""

    def __init__(self, width: int = WORDS):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64).view(np.int64) if words else np.zeros(0, np.int64)
        known = self.known
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > MEMO:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = len(h) - self.width + 1
        a = h[:n] * _ODD[0]
        for i in range(1, self.width):
            a = (a ^ (a >> np.uint64(31))) * _ODD[i % len(_ODD)] + h[i : i + n]
        a = (a ^ (a >> np.uint64(29))) * _ODD[1]
        return np.unique((a ^ (a >> np.uint64(32))).view(np.int64))


def signature(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def shared_needed(n):
    """k: tokens of the extended prefix that similar sets of n or more shingles share. Never falls with n."""
    return 1 + np.maximum(n // 32, np.minimum(n // 4, 16))


def _shared_needed(n: Column) -> Column:
    return 1 + F.greatest(F.floor(n / 32), F.least(F.floor(n / 4), F.lit(16)))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + int(shared_needed(n)))


def shared_late(n):
    """k in the order with frequent tokens last: at least 2, so that similar sets share a combination of two."""
    return np.minimum(4, np.maximum(2, 1 + n // 4))


def _shared_late(n: Column) -> Column:
    return F.least(F.lit(4), F.greatest(F.lit(2), 1 + F.floor(n / 4)))


def _sets(width: int, percent: int):
    @common.tidy
    def run(batches):
        shingles, met = Shingles(width), set()
        for batch in batches:
            size, sig, prefix = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                size.append(len(s))
                sig.append(signature(s))
                fresh = len(s) and sig[-1] not in met  # copies in one task are posted once
                if fresh and len(met) < 1 << 20:
                    met.add(sig[-1])
                prefix.append(s[: prefix_length(len(s), percent)].tobytes() if fresh else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "n", "sig", "prefix"])

    return run


def _post(batches):
    for batch in batches:
        prefix, sig, n = batch.column("prefix"), batch.column("sig").to_numpy(), batch.column("n").to_numpy()
        own = [np.frombuffer(p.as_buffer(), np.int64) for p in prefix]
        sizes = [len(p) for p in own]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(sig, sizes)), pa.array(np.repeat(n, sizes))], ["token", "sig", "n"])


_FOUND = ["a", "b", "na", "nb", "shared"]


def _lists(rare: int, percent: int, flush: int = 1 << 18):
    """From postings sorted by token and class: pairs of rare lists with shared > 0, rows (token, class, -, n, 0) of frequent ones."""

    def batch_of(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FOUND)

    @common.tidy
    def run(batches):
        held: list[np.ndarray] = []
        held_rows = 0
        tail = np.zeros((3, 0), np.int64)  # the last token's list, which may go on
        frequent = None  # its token, if its rows have begun to leave as a frequent list's

        def pairs(rows: np.ndarray) -> None:
            nonlocal held_rows
            token, cls, n = rows
            for d in range(1, rare):
                at = np.flatnonzero(token[:-d] == token[d:]) if len(token) > d else []
                if not len(at):
                    break
                na, nb = n[at], n[at + d]
                at = at[100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)]
                held.append(np.stack([cls[at], cls[at + d], n[at], n[at + d], np.ones(len(at), np.int64)]))
                held_rows += len(at)

        def summed() -> pa.RecordBatch:
            nonlocal held, held_rows
            x = np.concatenate(held, axis=1)
            x = x[:, np.lexsort((x[1], x[0]))]
            first = np.flatnonzero(np.r_[True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
            shared = np.add.reduceat(x[4], first) if x.shape[1] else x[4]
            held, held_rows = [], 0
            return batch_of([*x[:4, first], shared]) if x.shape[1] else batch_of([[]] * 5)

        def emit(rows: np.ndarray, last: bool):
            """Pairs or frequent rows of complete lists; keeps the last list unless it is the end."""
            nonlocal tail, frequent
            token = rows[0]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(token)])
            big = sizes > rare
            if len(starts) and frequent is not None and token[0] == frequent:
                big[0] = True
            if len(starts) and not last and not big[-1]:
                tail, rows = rows[:, starts[-1] :], rows[:, : starts[-1]]
                starts, sizes, big = starts[:-1], sizes[:-1], big[:-1]
                frequent = None
            else:
                tail = rows[:, :0]
                frequent = token[-1] if len(token) else None
            many = np.repeat(big, sizes)
            pairs(rows[:, ~many])
            return rows[:, many]

        last_row = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("token", "sig", "n")])
            if not rows.shape[1]:
                continue
            same = np.r_[last_row == (rows[0, 0], rows[1, 0]), (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])].astype(bool)
            last_row = (rows[0, -1], rows[1, -1])
            many = emit(np.concatenate([tail, rows[:, ~same]], axis=1), False)
            if many.shape[1]:
                yield batch_of([many[0], many[1], np.zeros(many.shape[1], np.int64), many[2], np.zeros(many.shape[1], np.int64)])
            if held_rows >= flush:
                yield summed()
        many = emit(tail, True)
        if many.shape[1]:
            yield batch_of([many[0], many[1], np.zeros(many.shape[1], np.int64), many[2], np.zeros(many.shape[1], np.int64)])
        if held:
            yield summed()

    return run


def _combined(tokens: np.ndarray) -> np.ndarray:
    """A token for each pair of tokens, whatever their order in the pair."""
    i, j = np.triu_indices(len(tokens), 1)
    low, high = np.minimum(tokens[i], tokens[j]).view(np.uint64), np.maximum(tokens[i], tokens[j]).view(np.uint64)
    x = (low * _ODD[0]) ^ (low >> np.uint64(31))
    x = (x + high) * _ODD[1]
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def late_prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the order with frequent tokens last: its rare and its frequent tokens."""
    n, often = len(tokens), np.isin(tokens, frequent, assume_unique=True)
    size = min(n, n - -(-percent * n // 100) + int(shared_late(n)))
    rare = tokens[~often][:size]
    return rare, tokens[often][: size - len(rare)]


def _late(percent: int):
    """sig, n, f (frequent tokens in the prefix), rare, singles and pairs to post."""

    @common.tidy
    def run(batches):
        for batch in batches:
            out = []
            for tokens, often in zip(batch.column("tokens"), batch.column("often").to_pylist(), strict=True):
                tokens = np.frombuffer(tokens.as_buffer(), np.int64)
                n = len(tokens)
                rare, common_ = late_prefix(tokens, np.array(often or [], np.int64), percent)
                least = int(shared_late(-(-percent * n // 100)))  # of the smallest similar set
                hot = len(common_) >= least
                pairs = _combined(common_[: len(common_) - least + 2]) if hot and n <= HIGH else common_[:0]
                out.append((n, len(common_), rare.tobytes(), (common_ if hot and n > LOW else common_[:0]).tobytes(), pairs.tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), *columns], ["sig", "n", "f", "rare", "singles", "pairs"])

    return run


def _whole_sets(width: int):
    @common.tidy
    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            own = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["sig", "tokens"])

    return run


def _top_tokens(posting: DataFrame, rare: int) -> DataFrame:
    """Tokens, TOP at most, that more than `rare` classes of a sample alone have in their prefix; stored."""
    sample = posting.where(F.pmod(F.xxhash64("sig"), F.lit(SAMPLED)) == 0).mapInArrow(_post, "token long, sig long, n long").select("token", "sig").distinct()
    counts = common.stored(sample.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > rare), "sampled-tokens")
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    return common.stored(counts.where(F.col("m") >= -(-total // TOP)).select("token"), "top-tokens")


def _listed(posting: DataFrame, rare: int, percent: int) -> DataFrame:
    """Of posting (sig, n, prefix): a, b, na, nb, shared of rare lists' pairs, and rows (token, sig, -, n, 0) of frequent ones; stored."""
    top = F.broadcast(_top_tokens(posting, rare))
    posted = posting.mapInArrow(_post, "token long, sig long, n long")
    often = posted.join(top, "token", "left_semi").distinct().select(F.col("token").alias("a"), F.col("sig").alias("b"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), F.lit(0).cast("long").alias("shared"))
    rest = posted.join(top, "token", "left_anti").repartition("token").sortWithinPartitions("token", "sig")
    return common.stored(rest.mapInArrow(_lists(rare, percent), "a long, b long, na long, nb long, shared long").unionByName(often), "lists")


def _frequent_in(found: DataFrame) -> DataFrame:
    return found.where("shared = 0").select(F.col("a").alias("token"), F.col("b").alias("sig"), F.col("nb").alias("n"))


def _rare_pairs(found: DataFrame, spare: DataFrame, needed) -> DataFrame:
    """a, b of pairs that share as many rare tokens as they need beside the frequent ones `f` of spare (sig, f)."""
    pairs = found.where("shared > 0").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    fa, fb = spare.select(F.col("sig").alias("a"), F.col("f").alias("fa")), spare.select(F.col("sig").alias("b"), F.col("f").alias("fb"))
    least = F.least(needed(F.col("na")), needed(F.col("nb"))) - F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0)))
    return pairs.join(fa, "a", "left").join(fb, "b", "left").where(F.col("shared") >= least).select("a", "b")


def late_index(sets: DataFrame, rare: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) among sets (sig, tokens) by prefixes with frequent tokens last, and the frequent lists (token, sig, n); stored."""
    posted = sets.select("sig", F.lit(0).cast("long").alias("n"), F.col("tokens").alias("prefix")).mapInArrow(_post, "token long, sig long, n long").select("token", "sig")
    counts = common.stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > rare).withColumn("often", F.lit(True)), "frequent-tokens")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    own = common.hot_split(posted, counts, ["token"], ["often"], total).where("often").groupBy("sig").agg(F.collect_list("token").alias("often"))  # a set's own tokens
    late = common.stored(sets.join(own, "sig", "left").mapInArrow(_late(percent), "sig long, n long, f long, rare binary, singles binary, pairs binary"), "late-prefixes")
    post = lambda column: late.where(F.length(column) > 0).select("sig", "n", F.col(column).alias("prefix"))
    found, combined = _listed(post("rare"), rare, percent), _listed(post("pairs"), rare, percent)
    pairs = _rare_pairs(found, late.where("f > 0").select("sig", "f"), _shared_late).unionByName(combined.where("shared > 0").select("a", "b")).distinct()
    lists = post("singles").mapInArrow(_post, "token long, sig long, n long").unionByName(_frequent_in(combined)).unionByName(_frequent_in(found))
    return common.stored(pairs, "late-pairs"), common.stored(lists, "late-lists")


def _overlaps(batches):
    for batch in batches:
        common_, least = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            common_.append(int((large[at] == small).sum()))
            least.append(len(x) + len(y) - common_[-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common_, pa.int64()), pa.array(least, pa.int64())], ["a", "b", "both", "either"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with both, either and linked; stored."""
    joined = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    found = joined.mapInArrow(_overlaps, "a long, b long, both long, either long")
    return common.stored(found.withColumn("linked", 100 * F.col("both") >= percent * F.col("either")), "verified")


def _sizes_fit(percent: int, na: str = "na", nb: str = "nb") -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _block_links(percent: int, columns: int = 4096):
    """Links between the sets of two blocks, as a forest: pairs that are joined already need no look."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sigs = np.concatenate([left.column("sig").to_numpy(), right.column("sig").to_numpy()])
        own = [np.frombuffer(t.as_buffer(), np.int64) for t in [*left.column("tokens"), *right.column("tokens")]]
        n = left.num_rows
        sizes = np.array([len(x) for x in own])
        _, token = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True)
        row = np.repeat(np.arange(len(own)), sizes)
        both = np.zeros((n, len(own) - n), np.float32)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, columns):  # so many tokens at a time
            a, b = np.searchsorted(token, [low, low + columns])
            x = np.zeros((len(own), columns), np.float32)
            x[row[a:b], token[a:b] - low] = 1
            both += x[:n] @ x[n:].T
        linked = 100 * both >= percent * (sizes[:n, None] + sizes[None, n:] - both)
        parent = {int(k): int(k) for k in sigs}

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = root(int(sigs[i])), root(int(sigs[n + j]))
            if x != y:
                parent[x] = y
                out.append((int(sigs[i]), int(sigs[n + j])))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return run


def _frequent_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the frequent lists (token, sig, n) that join all that their links join."""
    reach = 1 - percent / 100
    leaders = lists.groupBy("token").agg(F.min("sig").alias("a"), F.min_by("n", "sig").alias("na"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    met = common.stored(lists.join(leaders, "token").where("sig <> a").select("a", "na", "sig", "n").distinct(), "met")
    tested = _verified(met.where(_sizes_fit(percent, "na", "n")).select("a", F.col("sig").alias("b")), sets, percent)
    known = met.join(tested.withColumnRenamed("b", "sig"), ["a", "sig"], "left")
    far = 1 - F.coalesce(F.col("both") / F.col("either"), F.least("na", "n") / F.greatest("na", "n"))
    known = common.stored(known.select("a", "sig", F.coalesce("linked", F.lit(False)).alias("linked"), far.alias("far")), "known")
    apart = known.where("not linked")
    least = apart.groupBy("a").agg(F.min("far").alias("least"), F.count(F.lit(1)).alias("apart"))
    # members linked to a leader are joined; they matter for others only where these may be within their reach
    others = known.join(least, "a").where(~F.col("linked") | (F.col("far") >= F.col("least") - reach - 1e-9))
    size = others.groupBy("a").agg(F.count(F.lit(1)).alias("others")).join(least, "a")
    size = common.stored(size.select("a", F.ceil(F.col("apart") / BLOCK).alias("rows"), F.ceil(F.col("others") / BLOCK).alias("columns")), "blocks")
    block = lambda of: F.pmod(F.xxhash64("sig"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1))
    left = apart.join(size, "a").select("a", "sig", block("rows").alias("i"), "columns").select("a", "sig", "i", every("columns").alias("j"))
    right = others.select("a", "sig").join(size, "a").select("a", "sig", block("columns").alias("j"), "rows").select("a", "sig", every("rows").alias("i"), "j")
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in ("a", "i", "j", "sig", "tokens"))).groupBy("a", "i", "j")  # noqa: E731  both sides come from one table
    found = fresh(left.join(sets, "sig")).cogroup(fresh(right.join(sets, "sig"))).applyInArrow(_block_links(percent), "a long, b long")
    return tested.where("linked").select("a", "b").unionByName(common.stored(found, "block-links"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over links (a, b); only nodes that have links."""
    both = common.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = common.stored(state.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jumped = hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", "old", F.least(F.coalesce("root", "label"), "label").alias("label"))
        jumped = common.stored(jumped, "labels")
        moved = jumped.where("old <> label").limit(1).count()
        state = jumped.select("node", "label")
        if not moved:
            return state


def join(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark, mark = df.sparkSession, common.mark()
    common.arrow_batches(spark)
    texts = common.ids_and_text(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    posting = common.stored(texts.mapInArrow(_sets(width, percent), "doc_id long, n long, sig long, prefix binary"), "prefixes")
    docs = common.stored(posting.select("doc_id", "n", "sig"), "sets")
    total = docs.count()
    classes = common.stored(docs.groupBy("sig", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes")

    found = _listed(posting.where("prefix is not null").select("sig", "n", "prefix"), rare, percent)
    common.drop_scratch(spark, posting)
    spare = common.stored(_frequent_in(found).groupBy("sig", "n").agg(F.count(F.lit(1)).alias("f")), "spare")
    rare_pairs = common.stored(_rare_pairs(found, spare, _shared_needed), "rare-pairs")
    hot = common.stored(spare.where(F.col("f") >= _shared_needed(F.ceil(F.col("n") * percent / 100))).select("sig"), "hot")

    wanted = rare_pairs.select(F.col("a").alias("sig")).unionByName(rare_pairs.select(F.col("b").alias("sig"))).unionByName(hot).distinct()
    ids = common.stored(classes.join(wanted, "sig").select(F.col("first").alias("doc_id")).distinct(), "wanted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = common.stored(texts.join(ids, "doc_id", "left_semi").mapInArrow(_whole_sets(width), "sig long, tokens binary").dropDuplicates(["sig"]), "whole-sets")
    late_pairs, lists = late_index(sets.join(hot, "sig", "left_semi"), rare, percent)
    pairs = rare_pairs.unionByName(late_pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(pairs, sets, percent).where("linked").select("a", "b")
    links = links.unionByName(_frequent_links(lists, sets, percent)).where("a <> b").distinct()
    firsts = classes.select("sig", "first")
    by_id = links.join(firsts.select(F.col("sig").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("sig").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(classes, by_id)
    named = classes.join(labels.withColumnRenamed("node", "first"), "first", "left").select("sig", "n", "rows", F.coalesce("label", "first").alias("component_id"))
    named = common.stored(named.where("n > 0"), "components")
    common.drop_since(spark, mark, docs, named)
    out = common.hot_split(docs.select("doc_id", "n", "sig"), named, ["sig", "n"], ["component_id"], total)
    known = F.nullif(F.col("doc_id"), F.lit(NULL_ID))
    return out.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NULL_ID)).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
