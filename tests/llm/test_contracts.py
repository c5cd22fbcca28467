"""What each opN_ query returns: names, types and fields over a table with nulls, empty and very long texts, ties, repeated rows and columns of any name; and over an empty table."""

import hashlib
import zlib

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm import queries

NAMES = "shard offset slot size slots template n h k key cid component item hash pos first many id t piece row known weight ratio tokens media tensors r l i g u v".split()
COLUMNS = {
    1: "doc_id bigint, held_out boolean, lang_pred string, score double",
    2: "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    3: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    4: "doc_id bigint, n_sentences int, n_removed int, spans array<struct<start:int,end:int>>, text string",
    5: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    6: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    7: "page_id bigint, url string, text string, n_chars bigint",
    8: "doc_id bigint, source string, lang string, topic string, tokens bigint, probability double, kept boolean",
    9: "doc_id bigint, n_shingles bigint, component_id bigint",
    10: "doc_id bigint, contaminated boolean, cover double, re_parameterised boolean, item_ids array<bigint>",
    11: "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    12: "query_id bigint, rank int, vec_id bigint, score bigint",
    13: "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}
#: Rows that aren't one a document: pages; vectors that take part; the best of two queries; what is checked in a test of its own.
ROWS = {7: 5, 11: 3, 12: 8, 13: None}
QUERIES = {int(k[2:].split("_")[0]): v for k, v in queries.QUERIES.items()}
ITEM = "what is the name of the river that flows through the old town and under the stone bridge"


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """Tables of a folder like those of the queries, with more columns."""
    path = str(tmp_path_factory.mktemp("tables"))
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id between 100 and 159")
    more = spark.createDataFrame([(900, f"Asked here: {ITEM}? We know.", "en", "s", 1), (901, "word " * 30_000, "en", "s", 1), (902, "Alpha beta gamma. Delta epsilon zeta!", None, None, 5), (903, "a" * 200_000, "de", "t", 1)], texts.schema)
    docs = odd.select(texts.columns).unionByName(texts).unionByName(more)
    pages = spark.createDataFrame([(1, "http://a.example/1", "<body><nav>Menu</nav><article><h1>Head</h1><p>Text&nbsp;one</p></article></body>"), (1, "http://a.example/1", "<body><nav>Menu</nav><article><h1>Head</h1><p>Text&nbsp;one</p></article></body>"), (2, None, None), (3, "x", ""), (None, "http://a.example/2", "<p>" + "long " * 40_000)], "page_id bigint, url string, html string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "")], "item_id bigint, text string")
    vectors = [(0, [0.5] * 64), (0, [0.5] * 64), (50, None), (51, [0.1] * 63), (52, [float("nan")] * 64), (53, []), (None, [0.25] * 64)]
    vectors = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    for name, df in (("documents", docs), ("pages", pages), ("benchmark", bench), ("embeddings", vectors)):
        for c in NAMES:
            df = df.withColumn(c, F.lit(c))
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    """Documents by id, and the rows of every query."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {n: q(spark, folder) for n, q in QUERIES.items()}
    types = {n: {f.name: f.dataType.simpleString() for f in df.schema} for n, df in found.items()}
    return docs, types, {n: df.collect() for n, df in found.items()}


def by_id(rows):
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_names_types_and_numbers_of_rows(rows, n):
    docs, types, found = rows
    want = dict(c.rsplit(" ", 1) for c in COLUMNS[n].split(", "))
    assert {k: types[n][k] for k in want} == want
    assert len(found[n]) == (ROWS.get(n, len(docs)) or len(found[n]))


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_empty_tables(spark, empty, n):
    assert QUERIES[n](spark, empty).count() == 0


def test_language(rows):
    docs, _, found = rows
    got = by_id(found[1])
    for r in docs:
        if r.doc_id is not None:
            assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in found[1]) and {r.lang_pred for r in found[1]} <= {"en", "de", "fr", "es", "und"}


def test_media(rows):
    docs, _, found = rows
    got = by_id(found[2])
    for r in docs:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(got[1].feature, got[1].media_sha256), (got[8].feature, got[8].media_sha256), (got[902].feature, got[902].media_sha256)}) == 1


def test_token_counts(rows):
    docs, _, found = rows
    m, got = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), by_id(found[3])
    for r in docs:
        n = len(m.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit, got[r.doc_id].n_bytes) == (n, n > 4096, len((r.text or "").encode()))


def test_shards(rows):
    docs, _, found = rows
    sizes, slots, of = [0] * 16, {}, {}
    got = sorted(found[5], key=lambda r: (r.shard, r.slot))
    texts = {r.doc_id: r.text for r in docs}
    for r in got:
        t = texts[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r["slot"])
        assert of.setdefault(t, r.shard) == r.shard
    assert all(s == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes) <= max(largest, sum(sizes) / 16 + largest)


def test_token_store(rows):
    docs, _, found = rows
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs)
    got = sorted(found[6], key=lambda r: r.start)
    assert sorted(r.n_tokens for r in got) == want
    start, last = 0, -1
    for r in got:
        assert r.start == start and (r.doc_id is None or r.doc_id >= last)
        start, last = start + r.n_tokens, -1 if r.doc_id is None else r.doc_id


def test_pages(rows):
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in rows[2][7])
    assert got[0] == (0, ("long " * 40_000).strip(), 5 * 40_000 - 1) and got[1:] == [(1, "Head\n\nText one", 14)] * 2 + [(2, "", 0), (3, "", 0)]


def test_components(rows):
    docs, _, found = rows
    got = by_id(found[9])
    assert got[1].component_id == got[8].component_id == got[902].component_id == 1 and got[1].n_shingles == 2
    assert [got[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and got[2].component_id == 2
    assert got[5].component_id == 5 and got[901].n_shingles == 1


def test_contamination(rows):
    got = by_id(rows[2][10])
    assert got[900].contaminated and got[900].item_ids == [1] and not got[900].re_parameterised and got[900].cover == 1.0
    assert not any(r.contaminated for r in rows[2][10] if r.doc_id in (1, 2, 3, 5, 901, 903))


def test_products(rows):
    """Both rows of id 0 are queries; each finds the other, the shorter vectors (missing components count as 0, also in one without any), and the row without an id."""
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows[2][12]]
    assert sorted(got) == sorted(2 * [(0, 1, 0, 64 * 128 * 128), (0, 2, None, 64 * 128 * 64), (0, 3, 51, 63 * 128 * 25), (0, 4, 53, 0)])


def test_collocations(rows):
    """The very long text of one word has two phrases, of which the longer one stays."""
    got = [r for r in rows[2][13] if r.phrase == "word word word"]
    assert [(r.lang, r.a) for r in got] == [("en", 2 * 29_998)]
    assert not [r for r in rows[2][13] if r.phrase == "word word"] and all(r.a >= 10 for r in rows[2][13])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    other = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        other.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    rel = other.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got == sorted(map(repr, rel.select(*columns).fetchall()))
