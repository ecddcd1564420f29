import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from taskframe.llm import common, huffman, packing, token_counts
from taskframe.llm.tokens import Encoder

TRICKY = ["", None, "a\n\nb", " a b ", "x <|endoftext|> y<|endoftext|>\n<|startoftext|> z", "tab\tb c d", "ÄÖ é ́x 12 3'4 it's", "日本語 テスト", "a\r\nb", "\n", " ", "a \nb", "x  y", "The end. Of it, so.", "A.\nB,\nC", "word " * 3000, "İstanbul ΣΑΣ ſ", "a.b, c,d .x ,y ..", "don't. we'll, it's"]
EXTRA = "doc_id long, text string, n_tokens long, digest string, ids string"


def plain(name, text, end=()):
    library = Tokenizer.from_file(common.tokenizer_path(name))
    return [*library.encode(text or "", add_special_tokens=False).ids, *end]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x", None) for i, t in enumerate(texts)], EXTRA)


@pytest.mark.parametrize("name", [common.WORD_TOKENIZER, common.BYTE_TOKENIZER])
def test_word_cache_gives_the_librarys_ids(name, monkeypatch):
    monkeypatch.setattr("taskframe.llm.tokens.CACHE_WORDS", 40)  # it is emptied between batches
    monkeypatch.setattr("taskframe.llm.tokens.BATCH_BYTES", 64)
    ids, ends = Encoder(common.tokenizer_path(name)).encode(pa.array(TRICKY * 2))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [plain(name, t) for t in TRICKY * 2]


def test_length_limited_codes_are_optimal_and_decodable():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.3, 900).astype(np.int64)
    free = huffman.code_lengths(counts, 60)
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() <= 12 and sum(2.0 ** -lengths.astype(int)) == 1
    assert (counts * free).sum() <= (counts * lengths).sum() < 1.05 * (counts * free).sum()
    docs = [rng.choice(900, n) for n in (0, 1, 63, 64, 65, 1000, 0)]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    payload, steps = huffman.pack_bits(np.concatenate(docs), ends, huffman.canonical(lengths), lengths)
    assert (huffman.unpack_bits(payload, steps, np.diff(ends), huffman.decode_table(lengths)) == np.concatenate(docs)).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(counts, 9)
    assert huffman.code_lengths(np.array([0, 5]), 8).tolist() == [0, 1] and not huffman.code_lengths(np.zeros(3, int), 8).any()


def test_token_files_round_trip(spark, tmp_path):
    source = docs(spark, TRICKY).union(docs(spark, [None, "twice"])).union(spark.createDataFrame([(None, "no id", 1, "", "")], EXTRA))
    huffman.write_ids(source, f"{tmp_path}/f", common.tokenizer_path(common.WORD_TOKENIZER))
    got = sorted((r.start, r) for r in huffman.read_ids(spark, f"{tmp_path}/f").collect())
    assert [r.doc_id for _, r in got] == [None, 0, 0, 1, 1, *range(2, len(TRICKY))]
    assert [s for s, _ in got] == np.cumsum([0] + [r.n_tokens for _, r in got])[:-1].tolist()
    want = sorted([plain(common.WORD_TOKENIZER, t, [2]) for t in [*TRICKY, None, "twice", "no id"]])
    assert sorted(r.ids for _, r in got) == want
    digests = {(r.start, r.ids_crc32) for r in huffman.read_ids(spark, f"{tmp_path}/f", digest=True).collect()}
    assert digests == {(s, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for s, r in got}
    huffman.write_ids(source.limit(0), f"{tmp_path}/none", common.tokenizer_path(common.WORD_TOKENIZER))
    assert huffman.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_packing(spark):
    rows = packing.pack(docs(spark, TRICKY), common.tokenizer_path(common.WORD_TOKENIZER), longest=512).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == r.bucket == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 512 for r in rows)
    for i, t in enumerate(TRICKY):
        own, want = sorted((r.start, r) for r in rows if r.doc_id == i), plain(common.WORD_TOKENIZER, t, [2])
        assert sum([r.ids for _, r in own], []) == want and all(r.doc_tokens == len(want) and want[r.start :][: r.length] == r.ids and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for _, r in own)
    assert packing.pack(docs(spark, []), common.tokenizer_path(common.WORD_TOKENIZER)).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(np.array([1]), 100)


def test_token_counts_use_and_extend_the_cache(spark, tmp_path):
    cache, tokenizer = f"{tmp_path}/cache", common.tokenizer_path(common.BYTE_TOKENIZER)
    source = docs(spark, TRICKY + ["same"] * 50)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(source, tokenizer, cache).collect()}
    assert got == {(i, len((t or "").encode()), len(plain(common.BYTE_TOKENIZER, t)), len(plain(common.BYTE_TOKENIZER, t)) > 1024) for i, t in enumerate(TRICKY + ["same"] * 50)}
    assert spark.read.parquet(cache).count() == len(set(TRICKY) - {None}) + 1
    # a planted count shows that the cache is read; only the new text is encoded
    spark.createDataFrame([(token_counts.version_of(tokenizer), bytearray(hashlib.sha256(b"planted").digest()), 77)], token_counts.CACHE).write.mode("append").parquet(cache)
    again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, ["planted", "new text", "same"]), tokenizer, cache).collect()}
    assert again[0] == 77 and again[1] == len(plain(common.BYTE_TOKENIZER, "new text"))
    assert spark.read.parquet(cache).count() == len(set(TRICKY) - {None}) + 3
    assert token_counts.count_tokens(docs(spark, []), tokenizer, cache).count() == 0
