"""Digest dedup, token store, SentencePiece encoding and token counts against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from silolake.llm import digest_dedup, sentencepiece_stream, token_count, token_store
from silolake.llm.common import tokenizer_path
from silolake.llm.mphf import Mphf, mix

TEXTS = ["", None, "a", "a b c", " lead", "trail ", "two  spaces", "line\nend\n next", "日本語 テスト", "😀 x\ty", "x" * 300, "ab" * 4000,
         "the cat sat on the mat " * 400, "é" * 50, "a b 　c", "12 3's it's", "\x00a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(100, "a b c", "x"), (101, "a b c", "x"), (101, "a b c", "x"), (None, "a b c", "n"), (None, None, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def test_perfect_hash_is_minimal_and_survives_bytes():
    h = mix(np.arange(5000, dtype=np.uint64), 3)
    made, slots = Mphf.build(np.concatenate([h, h[:2]]))  # two hashes occur twice: they go to the tail
    assert sorted(slots[slots >= 0]) == list(range(4998)) and (slots < 0).sum() == 4
    again = Mphf.from_bytes(made.to_bytes())
    assert (again.slots(h[2:]) == made.slots(h[2:])).all()
    assert Mphf.build(np.zeros(0, np.uint64))[0].slots(h).max() == -1


def test_exact_dedup_matches_plain_grouping(docs):
    rows = {(r["doc_id"], r["text_sha256"]): r for r in digest_dedup.exact_dedup(docs).collect()}
    plain: dict = {}
    for i, t, _ in [tuple(r) for r in docs.collect()]:
        plain.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    assert len(rows) == len({(i, d) for d, ids in plain.items() for i in ids})
    for (i, d), r in rows.items():
        keep = max((x for x in plain[d] if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(plain[d]), i == keep)
    kept = digest_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(plain)


def test_exact_dedup_of_an_empty_table(docs):
    assert digest_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_history_members_and_nonmembers(spark, docs):
    table = digest_dedup.digests(docs)
    found = digest_dedup.groups(table.where("doc_id < 5"), table.where("doc_id >= 5 or doc_id is null"))
    sizes = {bytes(r["digest"]): (r["member"], r["group_size"]) for r in found.collect()}
    assert sizes[hashlib.sha256(b"a b c").digest()] == (True, 5)
    assert sizes[hashlib.sha256(b"trail ").digest()] == (False, 1)


def test_token_store_round_trip(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    store = token_store.write_tokens(docs, shards=3)
    got = token_store.read_ids(store, store.manifest.select("doc_id", "nth")).collect()
    assert len(got) == docs.count()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start = 0
    for r, g in zip(rows, sorted(got, key=lambda g: g["start"]), strict=True):
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids"]) == (r["doc_id"], start, len(ids), ids)
        start += len(ids)
    digest = {(g["doc_id"], g["nth"]): g["ids_crc32"] for g in token_store.read_ids(store, store.manifest.select("doc_id", "nth"), digest=True).collect()}
    assert all(digest[g["doc_id"], g["nth"]] == zlib.crc32(np.array(g["ids"], "<u4").tobytes()) for g in got)


def test_token_store_unknown_keys_and_empty_table(spark, docs):
    store = token_store.write_tokens(docs, shards=2)
    keys = spark.createDataFrame([(2,), (7777,), (2,)], "doc_id long")
    assert [r["doc_id"] for r in token_store.find(store, keys).collect()] == [2]
    empty = token_store.write_tokens(docs.limit(0), shards=2)
    assert token_store.read_ids(empty, empty.manifest.select("doc_id", "nth")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_stream.encoder(tokenizer_path("piece_bpe_32k.model"))


def plain_viterbi(v, text: str) -> list[int]:
    """The whole lattice at once."""
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            found = v.pieces.get(text[start:end])
            if found is None and end - start > 1:
                continue
            total = best[start] + (found[1] if found else v.unknown_score)
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (start, [found[0]] if found else v.spelled(text[start:end]))
    out, end = [], len(text)
    while end:
        end, ids = back[end]
        out = ids + out
    return out


@pytest.mark.parametrize("text", [t for t in TEXTS if t and len(t) < 1000] + ["thonre was ntti" * 20])
def test_encoding_equals_the_whole_lattice(encoder, text):
    want = plain_viterbi(encoder.v, encoder.v.normalised(text))
    assert encoder.encode(text).tolist() == want
    chunks = [encoder.v.normalised(text)[k:k + 5] for k in range(0, len(text) + 1, 5)]
    assert [i for part in encoder.search(chunks) for i in part] == want
    assert encoder.decode(want) == text


def test_stream_window_stays_short(encoder):
    encoder.window = 0
    list(encoder.search([encoder.v.normalised("ab" * 20000)]))
    assert encoder.window <= 8 * encoder.v.longest


def test_word_table_starts_anew_and_long_words_stream(encoder, monkeypatch):
    small = sentencepiece_stream.Encoder(encoder.v)
    small._words._entries = 3
    long = "x" * (2 * sentencepiece_stream.CHUNK + 7)
    for text in ["the thonre erheou", f"ntti {long} the", "was is the\u2581 a", long, " lead", "a b c d e f g"]:
        assert small.encode(text).tolist() == encoder.encode(text).tolist() == plain_viterbi(encoder.v, encoder.v.normalised(text))
    assert len(small._words._number) <= 2 + 7 and long not in small._words._number


def test_byte_pieces_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    encode, width = token_store.byte_bpe_encoder(path)
    texts = ["", " ", "a", " a", "a ", "a  b", "x" * 50 + " y", "new\nline tab\t end ", "\u00e4\u6f22 \U0001f600!", *[t or "" for t in TEXTS]]
    for _ in range(2):
        got = encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(g, f"<u{width}").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(pa.array([], pa.string())) == []


def test_library_agrees_on_the_best_segmentation(encoder):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores read as a unigram model
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for word in "the thonre erheou ntti whereas unbelievable Anblewh sttible".split():
        pieces = lib.nbest_encode_as_pieces(word, 2)[0]
        assert encoder.encode(word).tolist() == [lib.piece_to_id(p) for p in pieces]


def test_encode_decode_and_count_frames(docs):
    coded = sentencepiece_stream.encode_documents(docs, digest=True).collect()
    assert len(coded) == docs.count() and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in coded)
    texts = {r["doc_id"]: r["text"] for r in sentencepiece_stream.decode_documents(sentencepiece_stream.encode_documents(docs)).where("doc_id < 50").collect()}
    assert texts == {i: t or "" for i, t in enumerate(TEXTS)}
    counts = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_count.count_tokens(docs).collect())
    assert counts == sorted((str(r["doc_id"]), r["n_ids"]) for r in coded)
    assert token_count.count_tokens(docs.limit(0)).count() == 0


def test_counter_stream_equals_words(encoder):
    counter = token_count.counter(tokenizer_path("piece_bpe_32k.model"))
    for t in TEXTS:
        if t:
            assert counter.stream(encoder.v.normalised(t)) == len(encoder.encode(t)) == counter.count(t)
