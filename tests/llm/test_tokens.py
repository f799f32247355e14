"""Operators 4, 8 and 9 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilsift.llm import bpe, token_counts, wavelet

from .conftest import ODD_TEXTS

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def random_texts(n=60):
    rng = random.Random(3)
    letters = "abcdeEXYZéǘ \n\t.,'!?#0123あ中\U0001f600  "
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    texts = [*ODD_TEXTS, *random_texts()]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dict(enumerate(texts))


def test_counts(docs):
    df, texts = docs
    got = {r.doc_id: r for r in token_counts.count_tokens(df, limit=20).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        n = len(ids_of(WORDS, text))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 20), repr(text)


def test_counts_of_other_files(docs):
    df, texts = docs
    kept = token_counts.count_tokens(df, name="byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in kept.collect()} == {k: len(ids_of(BYTES, t)) for k, t in texts.items()}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    whole = token_counts.count_tokens(df, name="piece_bpe_32k.model")
    assert {r.doc_id: r.n_tokens for r in whole.collect()} == {k: len(model.encode(t or "")) for k, t in texts.items()}


def test_unknown_pre_tokenizers_are_refused(tmp_path):
    (tmp_path / "t.json").write_text('{"pre_tokenizer": {"type": "Whitespace"}}')
    with pytest.raises(ValueError):
        token_counts.white_space_of(str(tmp_path / "t.json"))


def test_decoding_in_one_step_and_of_unknown_ids(spark, docs):
    df, texts = docs
    for r in bpe.encode_bpe(df, decoded_col="back").collect():
        assert r.back == WORDS.decode(ids_of(WORDS, texts[r.doc_id]), skip_special_tokens=False)
    rows = [(1, [320, 4_000_000_000, 330]), (2, [60_000]), (3, []), (4, None), (5, [49407, 99_999])]
    ids = spark.createDataFrame(
        [(k, None if x is None else bytearray(np.array(x, "<u4").tobytes())) for k, x in rows], "k int, ids binary"
    )
    got = {r.k: r.decoded for r in bpe.decode_bpe(ids.withColumn("decoded", F.lit(0))).collect()}
    assert got == {k: None if x is None else WORDS.decode([i for i in x if i < 49408], skip_special_tokens=False) for k, x in rows}


def test_very_long_texts(spark):
    """Texts of many slices, whole words of a megabyte among them."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**5)}" for _ in range(40_000)]
    long = [" ".join(rng.choices(words, k=400_000)), "ab" * 500_000, "x\n" * 300_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    for r in bpe.encode_bpe(df, decoded_col="back").collect():
        want = ids_of(WORDS, long[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want and counts[r.doc_id] == len(want)
        assert r.back == WORDS.decode(want, skip_special_tokens=False)


def test_bpe_and_back(docs):
    df, texts = docs
    for r in bpe.decode_bpe(bpe.encode_bpe(df)).collect():
        want = ids_of(WORDS, texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want, repr(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.decoded == WORDS.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    vocabulary = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice("aabbctheé") for _ in range(rng.randrange(1, 60)))
        ids = vocabulary.symbols(word)
        assert vocabulary.merge_short(list(ids)) == vocabulary.merge_long(ids)


def test_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "old", 5), (2, "hi", "old", 6)], "doc_id int, text string, ids string, n_tokens int")
    rows = bpe.decode_bpe(bpe.encode_bpe(df)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [0, 1] and rows[0].decoded == ""
    empty = df.limit(0)
    assert bpe.encode_bpe(empty).count() == 0 and token_counts.count_tokens(empty).count() == 0
    none = df.withColumn("ids", F.lit(None).cast("binary"))
    assert {r.decoded for r in bpe.decode_bpe(none).collect()} == {None}


def test_matrix_against_lists():
    rng = np.random.default_rng(1)
    for n, top in ((0, 4), (1, 4), (700, 3), (5000, 50257), (513, 1)):
        values = rng.integers(0, top, n)
        matrix = wavelet.WaveletMatrix.build(values, 16)
        assert matrix.values().tolist() == values.tolist()
        if not n:
            continue
        at = rng.integers(0, n, 50)
        assert matrix.access(at).tolist() == values[at].tolist()
        for token in {*values[:5].tolist(), 49999}:
            low, high = sorted(rng.integers(0, n + 1, 2).tolist())
            assert matrix.count(token, low, high) == int((values[low:high] == token).sum())
            assert matrix.occurrences(token, low, high).tolist() == (low + np.flatnonzero(values[low:high] == token)).tolist()


def expected_shards(texts):
    start, out = 0, {}
    for k in sorted(texts):
        ids = [*ids_of(BYTES, texts[k]), 2]
        out[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    return out


def test_shards_round_trip(spark, docs, tmp_path):
    df, texts = docs
    path = str(tmp_path / "shards")
    wavelet.write_token_shards(df, path, shard_tokens=300)  # several shards a range
    files = [f for f in (tmp_path / "shards").iterdir() if f.name.startswith("part-")]
    assert len(files) > 2
    rows = wavelet.read_token_shards(spark, path, ids=True)
    rows.write.parquet(str(tmp_path / "documents"))
    want = expected_shards(texts)
    got = wavelet.with_starts(spark.read.parquet(str(tmp_path / "documents"))).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) == want[r.doc_id]
    assert wavelet.count_token(spark, path, 2).agg(F.sum("n")).first()[0] == sum(w[3].count(2) for w in want.values())
    assert wavelet.find_token(spark, path, 2).count() == sum(w[3].count(2) for w in want.values())


def test_shards_of_repeated_null_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x"), (3, None)], "doc_id long, text string")
    wavelet.write_token_shards(df, str(tmp_path / "a"))
    rows = wavelet.read_token_shards(spark, str(tmp_path / "a")).orderBy("place").collect()
    assert [(r.doc_id, r.n_tokens) for r in rows][0] == (None, 3) and len(rows) == 4
    wavelet.write_token_shards(df.limit(0), str(tmp_path / "b"))
    assert wavelet.read_token_shards(spark, str(tmp_path / "b")).count() == 0


def test_queries(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(enumerate(ODD_TEXTS))
    want = expected_shards(texts)
    for r in wavelet.op8_wavelet_shards(spark, str(tmp_path)).collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == want[r.doc_id][:3]
    for r in bpe.op4_bpe(spark, str(tmp_path)).collect():
        ids = ids_of(WORDS, texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(WORDS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_plain_words_need_no_patterns(monkeypatch):
    met = []

    class Pattern:
        def fullmatch(self, piece):
            met.append(piece)

    monkeypatch.setattr(wavelet, "PLAIN_PIECE", Pattern())
    encoder = wavelet.PieceEncoder(wavelet.vocabulary_path("byte_bpe_50k.json"))
    plain, other = ["word", " Words", " end.", "stop?!", " a,;"], [" ", "..", " a1", "x\ny", " été", "  b", "don't", "c.d"]
    want = [encoder.tokenizer.encode(p, add_special_tokens=False).ids for p in plain + other]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(plain + other)] == want
    assert met == other


def test_words_are_merged_once_whatever_marks_follow():
    encoder = wavelet.PieceEncoder(wavelet.vocabulary_path("byte_bpe_50k.json"))
    tails = ["", ".", "!?", "$$$", "<|>", "***", ")", '"']
    texts = [f"Start gem{a} straße{b} then's{a}  end{b}" for a in tails for b in tails] + ["", "gem", " ", "<|endoftext|> gem<|endoftext|>"]
    merged, kept = [], encoder.merged
    encoder.known.compute = lambda words: merged.extend(words) or kept(words)
    flat, sizes, codes, offsets = encoder.texts(pa.array(texts))
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    for k, text in enumerate(texts):
        got = [i for c in codes[offsets[k]:offsets[k + 1]] for i in ids[c].tolist()]
        assert got == ids_of(BYTES, text), text
    assert merged.count(" gem") == 1 and not any(w.startswith(" gem") and w != " gem" for w in merged)
    encoder.texts(pa.array(["a gem"]))
    assert merged.count(" gem") == 1  # known to the next texts


def test_known_words_are_bounded():
    known = wavelet.KnownWords(lambda words: [np.array([len(w)] * 2, "<u2").tobytes() for w in words], np.dtype("<u2"), 3, 100)
    for words in (["a", "bb", "a"], ["ccc", "dddd", "bb"], ["dddd", "e" * 200, "a"], ["x" * 300, "a"]):
        flat, n, place = known(pa.array(words))
        assert [flat[2 * p:2 * p + 2].tolist() for p in place] == [[len(w)] * 2 for w in words] and set(n.tolist()) == {2}
        assert known.words.to_pylist() == ["a", "bb", "ccc"][:len(known.words)] and len(known.flat) == 2 * len(known.words)


def test_matrix_of_several_spans():
    values = np.random.default_rng(4).integers(0, 50257, 2 * wavelet.SPAN + 7)
    assert (wavelet.WaveletMatrix.build(values, 16).values() == values).all()
