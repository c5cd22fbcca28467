"""Token counts, the token store, spans, decontamination, audio and pages against plain versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scholia.llm import audio, decontaminate
from scholia.llm.token_counts import independent, pre_tokens, token_counts
from scholia.llm.token_store import Encoder, PerfectHash, key_hash, write_store

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "bé", "'s", "1", "9.", "<|endoftext|>", "<s>", "▁", "　", "\xa0", "Hello", "\r", "你"]


def odd_strings(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(ALPHABET, rng.integers(0, 14))) for _ in range(n)]


# ---- token counts


def test_pre_tokens_count_as_whole_texts():
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert independent(PIECES)
    for t in odd_strings(1, 4000):
        assert len(m.encode(t)) == sum(len(m.encode(p[1:])) or 1 for p in pre_tokens(t)), repr(t)


@pytest.mark.parametrize("sent", [0, 50])
def test_counts_equal_the_library(spark, docs, odd, none, sent):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(m.encode(r.text or ""))) for r in df.collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(df, PIECES, most_sent=sent).collect())
        assert got == want
    assert token_counts(none, PIECES).count() == 0


# ---- token store


def test_encoder_equals_the_library():
    e, t = Encoder(BPE), Tokenizer.from_file(BPE)
    texts = odd_strings(2, 4000)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    small = Encoder(BPE, remember=5)
    assert small.encode(texts) == e.encode(texts) and len(small.known) <= 5 + len(texts)


def test_perfect_hash_is_minimal_and_perfect():
    h = key_hash(list(range(5000)))
    mph = PerfectHash.build(h)
    assert sorted(mph.slots(h).tolist()) == list(range(5000))
    assert PerfectHash.build(h[:0]).slots(h[:3]).tolist() == [-1, -1, -1]


def test_bytes_read_for_a_key_are_independent_of_the_shards_size(spark):
    """Every document has one token, so a key's ids are 4 bytes."""
    read = {}
    for n in (50, 20_000):
        store = write_store(spark.range(n).selectExpr("id AS doc_id", "'a' AS text"), BPE, shard_bytes=1 << 30)
        assert store.n_shards == 1 and all(len(store.get(k)) == 1 for k in (0, n - 1, n // 2))
        shard = store.shard(0, 0)
        before, most = shard.bytes_read, 0
        for k in range(0, n, max(1, n // 50)):
            shard.bytes_read = 0
            assert store.get(k)[0].tolist() == t_ids("a")
            most = max(most, shard.bytes_read)
        read[n] = most
        assert store.get(n + 5) == [] and before <= 2048 + 3 * most
    assert max(read.values()) <= 12 * 72 + 16 + 16 + 4  # one block a level tried, slot, offsets, ids; shard and index of the large store have over 500 KB


def t_ids(text):
    return [*Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids, 0]


def test_what_is_sent_to_a_task_doesnt_grow_with_the_shards(spark, docs):
    """The closure of the tasks that read holds a row for each directory, of which there are ``most_tasks`` at most."""
    from pyspark.cloudpickle import dumps

    from scholia.llm.token_store import _holding

    rows = [{"number": i, "uri": f"hdfs://store/folder/with/a/long/name/directory-{i:06d}-0123456789ab", "n_shards": 25, "n_ids": 10**9, "low": i * 100, "high": i * 100 + 99, "has_null": i == 0, "before": i * 10**9} for i in range(4096)]
    assert sum(r["n_shards"] for r in rows) > 10**5 and len(dumps(rows)) < 1_000_000
    assert _holding(rows, 100 * 77 + 5) == [77] and _holding(rows, None) == [0] and _holding(rows, -1) == _holding(rows, 409_600) == []


def test_a_folder_without_a_scheme(spark, docs, tmp_path):
    from scholia.llm.common import qualified

    assert qualified(spark, "/a/b") == "file:///a/b" and qualified(spark, "file:/a/b") == "file:///a/b"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://other/")
        conf.set("fs.viewfs.mounttable.other.link./a", f"file://{tmp_path}")
        assert qualified(spark, "/a/b") == "viewfs://other/a/b"
    finally:
        conf.set("fs.defaultFS", before)
    store = write_store(docs.limit(20), BPE, folder=str(tmp_path))
    assert store.parts[0]["uri"].startswith("file:///") and store.read(docs.limit(20).select("doc_id")).count() == 20


def test_store_round_trip(spark, docs, odd, none):
    t = Tokenizer.from_file(BPE)
    store = write_store(docs, BPE, shard_bytes=60_000)
    assert store.n_shards > 3
    start = 0
    got = {r.doc_id: r for r in store.read(docs.select("doc_id")).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = docs.first()
    assert store.get(one.doc_id)[0][:-1].tolist() == t.encode(one.text, add_special_tokens=False).ids
    assert store.get(one.doc_id)[0][:-1].tolist() == t.encode(one.text, add_special_tokens=False).ids
    assert store.get(10**9) == []
    few = write_store(docs, BPE, shard_bytes=30_000, most_tasks=2)  # several shards a task
    assert len(few.parts) == 2 and few.n_shards > 6
    again = {r.doc_id: r for r in few.read(docs.select("doc_id")).collect()}
    assert again == got and few.get(one.doc_id)[0].tolist() == store.get(one.doc_id)[0].tolist() and few.get(10**9) == []
    odd_store = write_store(odd, BPE)
    rows = odd_store.read(odd.select("doc_id")).collect()
    assert len(rows) == odd.count() and len(odd_store.get(1)) == 2 and len(odd_store.get(None)) == 1
    assert write_store(none, BPE).read(none.select("doc_id")).count() == 0


# ---- decontamination


def test_copies_and_changed_slots_are_found(spark):
    item = "A train leaves Boston at 7 km per hour and meets another train near Denver after 12 hours of steady travel through open country"
    changed = "well then: A train leaves London at 9 miles per hour and meets another train near Paris after 44 days of steady travel through open country so"
    mixed_up = "A train leaves London at 9 km per hour and meets another train near London after 9 hours of steady travel through open country"
    clean = "A plane leaves Boston at seven and nobody on board has ever met another traveller who was asked about trains or hours in Denver before"
    rows = [(1, f"before that. {item} and so on"), (2, changed), (3, mixed_up), (4, clean), (5, None), (6, ""), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "too short"), (0, item)], "item_id bigint, text string")
    for sent in (1000, 0):
        found = decontaminate.contamination(docs, bench, most_sent=sent)
        ids = {r.doc_id: r.exact for r in docs.withColumn("k", decontaminate.row_key()).join(found, "k").collect()}
        assert ids == {1: True, 2: False, 7: True}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, found).collect()} == {3, 4, 5, 6}


def test_every_verbatim_item_is_found(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [r.text for r in bench.collect() if len(r.text.split()) >= 10]
    clean = docs.collect()
    truth = {r.doc_id for r in clean if any(x in r.text for x in items)}
    planted = docs.unionByName(spark.createDataFrame([(50_000 + i, f"{clean[i].text} {x} {clean[i + 1].text}", "en", "p", 1) for i, x in enumerate(items)], docs.schema))
    found = decontaminate.contamination(planted, bench)
    got = {r.doc_id for r in planted.withColumn("k", decontaminate.row_key()).join(found, "k").collect()}
    assert truth | {50_000 + i for i in range(len(items))} <= got
    assert len(got - truth - {50_000 + i for i in range(len(items))}) <= 2


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    assert decontaminate.clean_documents(odd, decontaminate.contamination(odd, bench)).count() == 10
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0


# ---- audio


def test_media_are_lossless_and_features_equal(spark, docs, odd, none):
    media = odd.unionByName(docs, allowMissingColumns=True).select("doc_id", "text", audio.to_media("text").alias("media"))
    out = media.select("text", "media", audio.features("media").alias("r")).withColumn("d", audio.digest("r.tensors")).collect()
    by = {}
    for r in out:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert audio.payload_in(bytes(r.media)) == payload and r.r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert r.r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.r.tail_crc32 == zlib.crc32(payload[-32:])
        assert by.setdefault(r.text or "", r.d) == r.d
    assert none.select(audio.to_media("text")).count() == 0


def test_resampling_keeps_a_tone_and_tensors_their_shape():
    a = audio.Audio()
    x = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000).astype(np.float32)
    y = audio.resampled(x, a)
    assert len(y) == 10000 and abs(y - np.sin(np.arange(10000) * 2 * np.pi * 440 / 10000))[100:-100].max() < 0.01
    rows, energy = audio.log_mels(y, a)
    assert rows.shape == (1 + (10000 - 250) // 100, 24)
    with pa.ipc.open_stream(audio.tensors_of(rows, audio.segments_of(energy, a), a)) as r:
        t = r.read_all()
    assert isinstance(t.schema.field("log_mel").type, pa.FixedShapeTensorType) and t.schema.field("log_mel").type.shape == [32, 24]
    assert t["end_s"].to_pylist()[-1] <= len(y) / 10000 + 1


def test_hysteresis_holds_between_thresholds():
    a = audio.Audio(open_db=3, close_db=-3)
    e = np.array([-9, -9, 9, 1, -1, 1, -9, 1, 1, 9, 9, -9], np.float32)
    assert audio.segments_of(e, a).tolist() == [[2, 6], [9, 11]]


def test_foreign_bytes_raise():
    with pytest.raises(ValueError):
        audio.payload_in(b"\x00" * 100)


def test_features_against_a_plain_transform():
    """Resampled by the sum of its definition and transformed by the definition of the discrete Fourier transform."""
    a = audio.Audio()
    x = np.random.default_rng(3).integers(0, 256, 3000).astype(np.uint8)
    rows, energy = audio.media_mels(x, a)
    signal = (x.astype(float) - 128) / 128
    reach = 8 * a.down
    t = np.arange(-reach, reach + 1)
    h = np.sinc(t / a.down) * np.hanning(len(t) + 2)[1:-1]
    h *= a.up / h.sum()
    y = np.zeros(-(-len(x) * a.up // a.down))
    for j in range(len(y)):  # output j stands at j * down among the inputs spread by ``up``
        for i in range(max(0, (j * a.down - reach) // a.up), min(len(x), (j * a.down + reach) // a.up + 1)):
            if abs(i * a.up - j * a.down) <= reach:
                y[j] += signal[i] * h[i * a.up - j * a.down + reach]
    assert len(rows) == 1 + (len(y) - a.window) // a.hop
    n = np.arange(a.window)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(a.fft // 2 + 1), n) / a.fft)
    for f in (0, 5, len(rows) - 1):
        w = y[f * a.hop : f * a.hop + a.window]
        power = np.abs(basis @ (w * np.hanning(a.window))) ** 2
        assert np.allclose(rows[f], np.log10(10.0**a.floor + power @ audio.mel_bank(a)), atol=1e-3)
        assert abs(energy[f] - 10 * np.log10(1e-8 + (w**2).mean())) < 1e-2


def test_pieces_of_a_long_medium_join():
    a = audio.Audio()
    x = np.random.default_rng(4).integers(0, 256, 50_001).astype(np.uint8)
    whole, small = audio.media_mels(x, a), audio.media_mels(x, a, piece=7)
    assert all(np.allclose(p, q, atol=1e-4) for p, q in zip(whole, small))
    y = audio.resampled((x.astype(np.float32) - 128) / 128, a)
    assert np.allclose(audio.log_mels(y, a)[0], whole[0], atol=1e-4)


def test_stored_tensors_are_read_back(spark, docs):
    """The table of tensors holds Arrow tensors of fixed shape with the time span of each, and every frame lies in one."""
    t = docs.limit(20).select("doc_id", audio.features(audio.to_media("text")).alias("r")).select("doc_id", "r.*").collect()
    for r in t:
        with pa.ipc.open_stream(r.tensors) as s:
            table = s.read_all()
        mel = [i for i, k in enumerate(table["kind"].to_pylist()) if k == "mel"]
        assert table.schema.field("log_mel").type.shape == [32, 24] and len(mel) == -(-r.n_frames // 32)
        assert table["kind"].to_pylist().count("segment") == r.n_segments and all(b > a for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))
