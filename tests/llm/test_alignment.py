"""The event sweep against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, token_alignment

DATA = "/root/testdata/sf0.001"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "a  b\n\nc   \t d ", "x" * 3000, "ab" * 900, "日本語 テキスト " * 40, "😀😀   nb", "İstanbul é <|endoftext|> <s> </s>x", "a\x1cb  c", "don't;\r\n stop\t\tnow ", "\n\n", "\nx", "▁low ▁line", "x▁", "nul\x00 in it", "word " * 2000, "<0x41> <unk>", "a b 　c"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_groups(libraries, text):
    """Groups of (A ids, B ids) by the libraries alone."""
    a, b = libraries
    if not text:
        return []
    alphabet = token_alignment.byte_alphabet()
    a_ids, b_ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    a_raw = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
    b_raw = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    if b"".join(a_raw) != f" {text}".encode() or b"".join(b_raw) != f" {text}".encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        n, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a_ids[i:n], b_ids[j:m]))
        i, j = n, m
    return out


def plain(libraries, texts):
    """The contract's columns of each text."""
    grouped = [plain_groups(libraries, t) for t in texts]
    linked = [[(x, y) for a, b in g for x in a for y in b] for g in grouped]
    docs = Counter(p for own in linked for p in set(own))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for g, own in zip(grouped, linked, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


def table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (7, "word again and again"), (7, "word again and again"), (None, "no id")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    return odd.union(spark.read.parquet(f"{DATA}/documents.parquet").limit(80).selectExpr("doc_id + 1000", "text")).withColumn("n_a", F.lit("x")).withColumn("row_key", F.lit(1)).withColumn("pair", F.lit(1))


def same(result, libraries, df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, plain(libraries, [t for _, t in rows]), strict=True))
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in result.collect())
    assert got == want
    return want


@pytest.mark.parametrize("top", [token_alignment.TOP, 300, 0])
def test_align_equals_plain(spark, libraries, top):
    df = table(spark).repartition(3)
    df = common.stored(df, "align-test")
    result = token_alignment.align(df, *PATHS, top=top, memo=500)
    want = same(result, libraries, df)
    assert any(w[2] == 0 and w[0] == ODD.index("▁low ▁line") for w in want)
    common.release(result)


def test_runs_parts_and_slices(spark, libraries, monkeypatch):
    """Documents of many runs and parts, links made in slices, a group with more links than a slice."""
    from pyspark import cloudpickle

    for name, value in (("RUN", 16), ("LINKS", 40), ("GATHERED", 64)):
        monkeypatch.setattr(token_alignment, name, value)
    cloudpickle.register_pickle_by_value(token_alignment)  # workers must see the small bounds
    try:
        df = common.stored(table(spark).where("length(text) < 20000 or text is null").limit(60), "align-runs")
        same(token_alignment.align(df, *PATHS, top=100), libraries, df)
        swept, v = token_alignment.sweep(df, *PATHS)
        assert swept.where("part > 0").count() > 0
        got = defaultdict(list)
        for r in token_alignment.groups(swept, v).collect():
            got[r["row_key"]].append((r["part"], r["at"], r["a_ids"], r["b_ids"], r["doc_id"]))
        texts = {r["doc_id"]: r["text"] for r in df.where("doc_id >= 1000").collect()}
        seen = 0
        for own in got.values():
            if own[0][4] in texts:
                seen += 1
                assert [(a, b) for _, _, a, b, _ in sorted(own)] == [(list(a), list(b)) for a, b in plain_groups(libraries, texts[own[0][4]])]
        assert seen == len([t for t in texts.values() if t])
    finally:
        cloudpickle.unregister_pickle_by_value(token_alignment)


def test_one_large_group():
    v = token_alignment.Vocabularies(np.array([2, 3, 5]), np.array([1, 7]))
    a, b = np.array([1, 1, 2, 1], "<u2"), np.array([1, 1], "<u2")  # ends 3 6 11 14 and 7 14: one group
    got = Counter()
    for pair, times in token_alignment.links(a, b, v):
        got.update(dict(zip(pair.tolist(), [1] * len(pair) if times is None else times.tolist(), strict=True)) if times is not None else Counter(pair.tolist()))
    assert got == Counter(int(x) * 2 + int(y) for x in a for y in b)


def test_empty_and_registered(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(df, *PATHS).count() == 0
    got = token_alignment.op11_token_alignment(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert got.where("n_best > n_links or n_groups > n_a or n_groups > n_b").count() == 0
