import hashlib
import zlib

import pytest

from skein.llm import bpe, media

TEXTS = [None, "", "x", "é" * 32, "a" * 64, "b" * 65, "same", "same", "long " * 5000]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, shard string, offset int").repartition(3)


def test_payloads_round_trip(spark, tmp_path):
    index, folder = media.store(docs(spark), f"file://{tmp_path}/m")
    rows = {r.doc_id: r for r in media.read_back(index, folder).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.width, r.height) == (64, len(padded) // 64) and r.stored_sha256 == r.media_sha256
    assert rows[6].feature == rows[7].feature
    heads = {r.doc_id: r for r in media.headers(index, folder).collect()}
    assert all((heads[i].width, heads[i].height, heads[i].depth) == (64, rows[i].height, 8) for i in rows)


def test_shards_are_tar_files(spark, tmp_path):
    import tarfile

    index, folder = media.store(docs(spark), f"file://{tmp_path}/m")
    members = {}
    for shard in {r.shard for r in index.collect()}:
        with tarfile.open(f"{tmp_path}/m/shards/{shard}") as tar:
            members |= {(shard, m.offset_data): (m.name, tar.extractfile(m).read()) for m in tar}
    for r in index.collect():
        name, data = members[r.shard, r.offset]
        assert name == f"{r.digest}.png" and len(data) == r.length and hashlib.sha256(media.from_png(data)).hexdigest() == r.digest


def test_damage_is_seen():
    png = bytearray(media.to_png(b"q" * 64))
    png[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_round_trip_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.vocabulary_path())
    rows = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs(spark)))).collect()}
    for i, t in enumerate(TEXTS):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert bpe.decode(bpe.encode(none)).count() == 0
    index, folder = media.store(none)
    assert media.read_back(index, folder).count() == 0
