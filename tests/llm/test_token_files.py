"""Token files: exact round trips, digests against plain encoding, damaged blocks."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from haulcast.llm import id_coder, token_cache, token_files
from haulcast.llm.token_files import Format
from haulcast.staging import new_path
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

FORM = Format(public_tokenizers.path("word_bpe_49k.json"), block=64, lanes=8, part_bytes=20_000)

HARD = [
    (5, "Plain words, don't  they?\nNew line\ttab\x0bmore\x1f\x85 wide　end"),
    (3, ""),
    (4, None),
    (9, 'a "quoted" " thing <|endoftext|> and<|startoftext|>more'),
    (9, "the same id again"),
    (9, "the same id again"),
    (None, "no id at all"),
    (7, "é ́mark ÉTÉ ΣΑΣ 数据 😀 " * 50),
    (8, "x" * 5000),
    (2, "w " * 3000),
]


def plainly(rows):
    """Digests of all documents by whole-text encoding, one after the other."""
    encoder = Tokenizer.from_file(FORM.tokenizer)
    at, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def written(spark, df, form=FORM):
    path = new_path(spark, "tokens")
    token_files.write_tokens(df, path, form)
    return path


def test_hard_texts_in_small_blocks(spark, docs):
    rows = [r for r in HARD if r[1] != "the same id again"]
    path = written(spark, docs(rows))
    got = token_files.read_tokens(spark, path, with_ids=True, lanes=3).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == plainly(rows)


def test_rows_that_repeat_an_id_have_places_of_their_own(spark, docs):
    got = token_files.read_tokens(spark, written(spark, docs(HARD))).collect()
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert len(got) == len(HARD)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(r.ids_crc32 for r in got) == sorted(p[3] for p in plainly(HARD))
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_real_texts(spark, sf_dir, real):
    form = Format(FORM.tokenizer, part_bytes=1 << 18)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = written(spark, df, form)
    assert spark.read.parquet(path).select("part").distinct().count() > 1
    got = sorted(tuple(r) for r in token_files.read_tokens(spark, path).collect())
    assert got == sorted(p[:4] for p in plainly(real))


def test_no_documents(spark, docs):
    assert token_files.read_tokens(spark, written(spark, docs([]))).count() == 0


def test_frames_compress_and_a_damaged_one_is_refused(spark, docs):
    path = written(spark, docs([(1, "one two three four five " * 200)]), Format(FORM.tokenizer))
    frames = spark.read.parquet(path)
    size, n = frames.agg(F.sum(F.octet_length("frame")), F.sum("n")).first()
    assert size < n  # some bits an id, where plain numbers take 16 or 32
    broken = new_path(spark, "tokens")
    flipped = F.overlay("frame", F.unhex(F.lit("ff")), F.lit(20))
    frames.withColumn("frame", flipped).write.parquet(broken)
    with pytest.raises(PySparkException, match="checksum"):
        token_files.read_tokens(spark, broken).collect()


@pytest.mark.parametrize("size", [2, 16, 300, 49408, 1 << 20])
def test_coder_round_trip(size):
    rng = random.Random(size)
    lengths = np.array([200, 200, 131, 17, 1])
    ids = np.zeros((200, 5), np.uint32)
    for lane, n in enumerate(lengths):
        skewed = [min(int(rng.expovariate(1) * size / 50), size - 1) for _ in range(n)]
        ids[:n, lane] = skewed if lane % 2 else [size - 1] * n
    payloads = id_coder.encode(ids, lengths, size)
    back = id_coder.decode(payloads, lengths, size)
    for lane, n in enumerate(lengths):
        assert (back[:n, lane] == ids[:n, lane]).all()


def test_lanes_do_not_depend_on_each_other():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1000, (50, 6)).astype(np.uint32)
    together = id_coder.encode(ids, np.full(6, 50), 1000)
    alone = [id_coder.encode(np.ascontiguousarray(ids[:, [i]]), np.full(1, 50), 1000)[0] for i in range(6)]
    assert together == alone


def test_carries_run_through_written_words():
    """Long runs of almost certain symbols keep the interval at its upper end."""
    ids = np.full((3000, 2), 65535, np.uint32)
    ids[::97, 1] = 0
    lengths = np.full(2, 3000)
    assert (id_coder.decode(id_coder.encode(ids, lengths, 65536), lengths, 65536) == ids).all()


def test_crc_of_joined_pieces():
    a, b = b"some bytes", b"and some more of them" * 9
    moved = token_files.crc_before(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert moved[0] ^ moved[1] == zlib.crc32(a + b)


def test_words_in_one_text_get_the_ids_of_words_alone():
    draw = random.Random(5)
    words = ["".join(draw.choice("abeé'7ß数😀.\u0301") for _ in range(draw.randrange(1, 12))) for _ in range(3000)]
    words += ["a\x01b", "\x01", "\u0301abc", "<|endoftext|>", "x<|startoftext|>y", "don't", "'s", "ΑΣ", "a\u00a0b", "\u2003", "x" * 3000]
    joined = token_cache.word_encoder(FORM.tokenizer)
    for some in (words, words[-11:], words[:1], []):
        ids, counts = joined(some)
        plain, sizes = token_cache.json_encoder(FORM.tokenizer)(some)
        assert ids.tolist() == plain.tolist() and counts.tolist() == sizes.tolist()
