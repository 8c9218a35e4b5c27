"""Similarity join, WARC, vector search and the pipeline against plain versions."""

import base64
import hashlib
import io

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline.llm import common, exact_topk, ngram_jaccard, permutation_index, registry, vectors, warc

DATA = "/root/testdata/sf0.001"


def brute_components(rows):
    cut = {}
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        cut[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(cut[i] & cut[j])
            if both and 100 * both >= 75 * (len(cut[i]) + len(cut[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), len(cut[i]), str(least[root(i)])) for i in range(len(rows)))


def joined(df, **more):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_jaccard.join(df, **more).collect())


@pytest.mark.parametrize("rare", [32, 3])
def test_join_equals_brute_force(spark, rare):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    for i in range(60):  # a group of near copies about the threshold, which makes frequent tokens
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 5), replace=False):
            w[k] = f"e{i}{k}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, "A common passage of words in front of it all " + " ".join(f"u{i}x{k}" for k in range(i % 9))) for i in range(45)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "two words"), (3004, "Two\tWORDS"), (None, "two words"), (3005, rows[60][1]), (1003, rows[63][1]), (3006, "É é É é é"), (3007, "é é é é é")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    assert joined(df, rare=rare) == brute_components(rows)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_join_of_groups_made_of_frequent_shingles(spark, monkeypatch, broadcast):
    """Near copies of short and long texts about the threshold, in groups beyond `rare`, and the sizes where the two indexes meet."""
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(ngram_jaccard, "SAMPLED", 1)  # every class is sampled: many tokens leave the lists beforehand
    rng, rows = np.random.default_rng(17), []
    for g, size in enumerate((8, 14, 40, 68, 90, 130)):
        base = [f"g{g}w{i}" for i in range(size)]
        for _ in range(28):
            w = list(base)
            for k in rng.choice(size, rng.integers(0, max(2, size // 12)), replace=False):
                w[k] = f"e{len(rows)}x{k}"
            w = w[: len(w) - int(rng.integers(0, size // 8 + 1))] + [f"t{len(rows)}x{k}" for k in range(rng.integers(0, size // 8 + 1))]
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert joined(df, rare=3) == want and 20 < len({w[2] for w in want}) < 160


def test_sets_that_share_a_passage_cost_rows_in_proportion(spark):
    made = {}
    for m in (300, 1200):
        own = [("licence text " + " ".join(f"l{i}" for i in range(200)) + " " + " ".join(f"d{d}w{i}" for i in range(110))) for d in range(m)]
        cut = ngram_jaccard.Shingles()
        df = spark.createDataFrame([(ngram_jaccard.signature(cut(t)), cut(t).tobytes()) for t in own], "sig long, tokens binary")
        pairs, lists = ngram_jaccard.late_index(df, 32, 75)
        made[m] = pairs.count() + lists.count()
    assert made == {300: 0, 1200: 0}  # nothing to compare: prefixes hold rare shingles alone


def test_late_prefixes_share_what_they_must():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 120))
        x = np.unique(rng.integers(0, 1 << 40, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.uniform(0, 0.25)], rng.integers(0, 1 << 40, rng.integers(0, max(1, n // 6)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        often = rng.permutation(np.union1d(x, y))[: int(rng.integers(0, 2 * n))]
        (rx, fx), (ry, fy) = (ngram_jaccard.late_prefix(v, often, 75) for v in (x, y))
        k = int(min(ngram_jaccard.shared_late(len(x)), ngram_jaccard.shared_late(len(y))))
        same_rare, same_often = len(np.intersect1d(rx, ry)), len(np.intersect1d(fx, fy))
        assert same_rare + same_often >= min(k, len(x), len(y))
        if not same_rare and min(len(x), len(y)) > 1:
            least = [int(ngram_jaccard.shared_late(-(-75 * len(v) // 100))) for v in (x, y)]
            a, b = (ngram_jaccard._combined(f[: len(f) - at + 2]) for f, at in zip((fx, fy), least))
            assert len(np.intersect1d(a, b))


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert joined(empty) == [] and joined(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [("1", 0, "1")]


def test_prefix_lengths_never_fall_below_the_lemma():
    for n in range(1, 3000):
        assert ngram_jaccard.shared_needed(n + 1) >= ngram_jaccard.shared_needed(n)
        assert ngram_jaccard.prefix_length(n) >= min(n, n - -(-75 * n // 100) + 1)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 150)]
    got = {r["node"]: r["label"] for r in ngram_jaccard.components(None, spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {100} and got[200] == got[150] == 150 or got[150] == 100


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = [(11, "long", "ab<p>é" * 400_000), (5, "u\n x", "é<b>" * 50), (3, None, "é<b>" * 50), (None, "z", "é<b>" * 50), (9, "a", None), (7, "b", ""), (8, "", "q"), (3, "again", "é<b>" * 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = warc.write_archives(df, common.scratch_path(spark, "test-warc"))
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    html = {r[0]: r[2] for r in rows}
    for r in got:
        own = html[r["page_id"]]
        assert r["payload_bytes"] == len((own or "").encode()) and r["payload_digest"] == digest(own)
        assert r["record_type"] == ("response" if r["page_id"] in (3, 7, 8, 11) else "revisit")
        assert r["refers_to"] == {5: 3, None: 3, 9: 7}.get(r["page_id"])
        assert r["payload"] == ((own or "").encode() if r["record_type"] == "response" else None)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), common.scratch_path(spark, "test-warc"))).count() == 0


def test_warc_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, warc.write_archives(df, common.scratch_path(spark, "test-warc"), least=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_streams_an_archive_in_chunks(monkeypatch):
    """Frames across chunks, one larger than many chunks; the same faults at the same bytes as of a whole archive."""
    dictionary = warc.train([b"WARC/1.1 some header text with words %d" % i * 9 for i in range(400)])
    codec = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    payloads = [b"", b"x", np.random.default_rng(1).bytes(300_000), b"end" * 50]
    frames = [codec.compress(warc.record(i, f"u{i}", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None, False)) for i, p in enumerate(payloads)]
    archive = warc.dictionary_frame(dictionary) + warc.BETWEEN + warc.BETWEEN.join(frames) + warc.BETWEEN

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert n > 0
            got = super().read(n)
            self.most = max(self.most, len(got))
            return got

    for chunk in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        source = Counted(archive)
        assert [r["payload"] for r in warc.records(source)] == payloads and source.most <= max(chunk, 2 * max(map(len, [*frames, dictionary])))
        for bad in (archive[:-12], archive[:5000], archive[: len(archive) // 2], b"junk" + archive):
            with pytest.raises(ValueError) as small:
                list(warc.records(Counted(bad)))
            monkeypatch.setattr(warc, "CHUNK", 1 << 24)
            with pytest.raises(ValueError) as whole:
                list(warc.records(bad))
            monkeypatch.setattr(warc, "CHUNK", chunk)
            assert str(small.value) == str(whole.value)


def test_warc_reader_uses_the_dictionary_and_checks():
    dictionary = warc.train([b"WARC/1.1 some header text with words %d" % i * 9 for i in range(400)])
    codec = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    good = warc.record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, False)
    archive = warc.dictionary_frame(dictionary) + warc.BETWEEN + codec.compress(good) + warc.BETWEEN
    assert [r["payload"] for r in warc.records(archive)] == [b"payload"]
    for bad in (archive[:-12], archive[: len(archive) // 2], warc.dictionary_frame(dictionary) + codec.compress(good.replace(b"payload\r", b"Payload\r")), warc.dictionary_frame(dictionary) + codec.compress(good[:-1]), b"junk" + archive, warc.dictionary_frame(dictionary) + codec.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def vectors_table(spark, n=700, dim=16):
    """Random vectors, forty of them equal, and rows that take no part or are alone in their dimension."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[100:140] = x[100:101]
    rows = [(i, [float(v) for v in x[i]], 7) for i in range(n)]
    rows += [(5000, None, 7), (5020, [], 7), (5040, [float("nan")] * dim, 7), (5060, [None, *[1.0] * (dim - 1)], 7), (5080, [0.0] * dim, 7), (5100, [1.0, 2.0], 7), (5120, [3.0, 1.0], 7), (20, rows[20][1], 7), (None, rows[3][1], 7)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(rows, score, usable):
    own = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and usable(v):
            own[r["vec_id"]] = np.array(v, np.float64)
    out = {}
    for q in own:
        if q % 20 == 0:
            found = sorted((-score(own[q], x), i) for i, x in own.items() if i != q and len(x) == len(own[q]))[:20]
            out[q] = [(i, -s) for s, i in found]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_exact_topk(spark):
    df = vectors_table(spark)
    want = brute(df.collect(), lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), lambda v: True)
    assert listed(exact_topk.search(df, lambda i: i % 20 == 0)) == {q: [(i, int(s)) for i, s in v] for q, v in want.items() if v}


def test_exact_topk_of_huge_components_and_nothing(spark):
    df = spark.createDataFrame([(0, [1e15, 3.0]), (1, [1e15, -2.0]), (2, [-5.0, 7.5])], "vec_id long, embedding array<double>")
    want = {0: [(1, (1 << 63) - 1), (2, int(64e15) * -320 + 192 * 480)]}
    got = listed(exact_topk.search(df, lambda i: i % 20 == 0))
    assert got[0][0] == want[0][0] and got[0][1] == (2, max(want[0][1][1], -(1 << 63)))
    assert exact_topk.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_elimination_skips_rows_and_stays_exact():
    rng = np.random.default_rng(3)
    x = np.rint(np.concatenate([rng.normal(0, 40, (3000, 8)) + 900, rng.normal(0, 40, (3000, 8)) - 900]))
    far = np.linalg.norm(x[:, None] - x[[0, 3000]][None], axis=2)
    least = np.abs(far - far[5]).max(1)
    bound = (x[5] @ x[5] + (x * x).sum(1) - least**2) / 2 + 1
    ids, scores, seen = exact_topk.top_k(x[5], bound, x, np.arange(6000), 10)
    order = np.lexsort((np.arange(6000), -(x @ x[5])))[:10]
    assert ids.tolist() == order.tolist() and seen < 6000


def test_permutation_index_recall_and_order(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").unionByName(vectors_table(spark, 200, 64).where("vec_id >= 5000 or vec_id is null").selectExpr("vec_id", "embedding", "score as label"))
    want = brute(df.collect(), lambda a, b: float(a @ b), lambda v: any(v))
    got = listed(permutation_index.search(df, lambda i: i % 20 == 0))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items() if w]
    assert np.mean(hits) >= 0.9
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values()) and 5080 not in got
    assert all(abs(dict(w)[i] - s) < 1e-9 for q, w in want.items() for i, s in got[q] if i in dict(w))
    assert permutation_index.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_permutation_index_recall_with_a_hot_third(spark):
    rng = np.random.default_rng(11)
    x, centre = rng.standard_normal((6000, 64)), rng.standard_normal(64)
    x[::3] = centre / np.linalg.norm(centre) + rng.uniform(0.02, 0.3, (2000, 1)) * rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, hits = listed(permutation_index.search(df, lambda i: i % 20 == 0)), []
    for q in range(0, 6000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits.append(len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.93 and np.percentile(hits, 5) >= 0.7


@pytest.mark.parametrize("block", [1 << 20, 1 << 14])
def test_permutation_index_recall_of_a_minority_dimension(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)  # several blocks of a cell and of its queries
    rng = np.random.default_rng(12)
    x, y = rng.standard_normal((6000, 32)), rng.standard_normal((700, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("order", F.lit(1))  # clashing names
    got, hits = listed(permutation_index.search(df, lambda i: i % 20 == 0)), {32: [], 24: []}
    for base, v in ((0, x), (10_000, y)):
        for q in range(0, len(v), 20):
            scores = v @ v[q]
            scores[q] = -np.inf
            hits[v.shape[1]].append(len({i - base for i, _ in got[base + q]} & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert len(got) == 300 + 35 and np.mean(hits[32]) >= 0.93 and np.mean(hits[24]) >= 0.93


def test_spread_pivots_do_not_follow_density():
    x = np.concatenate([np.full((900, 2), 5.0), np.array([[0.0, 0.0], [0.0, 9.0]])])
    assert sorted(map(tuple, permutation_index.spread(x, 128).tolist())) == [(0.0, 0.0), (0.0, 9.0), (5.0, 5.0)]


def test_footrule():
    rng = np.random.default_rng(0)
    order = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = permutation_index.InvertedFiles(order, 12)

    def place(row, p):
        return row.index(p) if p in row else 5

    for q in order[:6]:
        want = [sum(abs(place(r.tolist(), p) - place(q.tolist(), p)) for p in range(12)) for r in order]
        assert files.footrule(q).tolist() == want
    assert len(files.row) == 40 * 5  # a posting for each place of a prefix


def test_top_k_floors_leave_out_only_what_falls_below(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 1 << 12)
    rng = np.random.default_rng(8)
    centres = 900 * rng.standard_normal((6, 8))
    x = np.concatenate([c + 30 * rng.standard_normal((300, 8)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, floor int")
    want = brute(df.collect(), lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), lambda v: True)
    assert listed(exact_topk.search(df, lambda i: i % 20 == 0, pivots=12)) == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}
    q, whole = 40, np.floor(64 * x)
    scores = whole @ whole[q]
    scores[q] = -np.inf
    floor = int(np.sort(scores)[-20])
    p = whole[:: len(x) // 12][:12]
    far = np.linalg.norm(whole[:, None] - p[None], axis=2)
    cell = far.argmin(1)
    ranges = [(c, far[cell == c].min(0), far[cell == c].max(0), (whole[cell == c] ** 2).sum(1).max()) for c in np.unique(cell)]
    batch = pa.RecordBatch.from_arrays([pa.array([q]), pa.array([8], pa.int32()), pa.array([whole[q].tolist()]), pa.array([far[q].tolist()]), pa.array([floor]), pa.array([0], pa.int32())], ["vec_id", "dim", "whole", "far", "floor", "cell"])
    reached = next(exact_topk._reached({8: ranges}, {(8, int(c)): int(c) for c in cell})(iter([batch]))).column("pack").to_pylist()
    assert set(cell[np.argsort(-scores)[:20]]) <= set(reached) and len(reached) < len(ranges)


def test_oracles(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        got = registry.queries()[name](spark, DATA)
        assert sorted(map(str, ([r[n] for n in names] for r in got.collect()))) == sorted(map(str, map(list, want.fetchall())))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        assert 0 < docs.count() <= seen
        seen = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == seen
    assert docs.where("n_chars <> length(text)").count() == 0


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline

    text = "Some ordinary words that nobody else has written in this order before, number "
    rows = [(None, None, None, None, None), (None, text + "one", "en", "s", 1), (1, "", "en", None, 0), (2, text * 3 + "two", None, "s", 5), (2, text * 3 + "two", None, "s", 5), (2, "another text under the same number, " + text, "xx", "s", 9), (3, "x", "en", "s", 1), (4, "Mr. Kim Fox, " + text * 40, "fr", "s", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            extra = docs.withColumn("row_key", F.lit("x")).withColumn("n_entities", F.lit("y")).withColumn("sig", F.lit(1))  # clashing names
            docs = common.stored(stage(spark, extra, DATA), f"odd-{name}")
            assert docs.columns == corpus_pipeline.COLUMNS
        left = [r["text"] for r in docs.collect()]
        assert len(left) == len(set(left)) and None not in left and "" not in left and not any("Kim" in t for t in left)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert (packed.count() > 0) == bool(left)
    assert len(left) == 0
