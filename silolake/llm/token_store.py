"""Token-id shards with a minimal-perfect-hash index from document keys to shard offsets.

Writing: documents are range-partitioned by doc_id and sorted, so shard ``k``
holds smaller ids than shard ``k + 1``; each task encodes its rows and streams
the raw ids (u16 when the vocabulary fits, else u32, little-endian) into one
new file after a 32-byte header. A retried task writes another file; only the
files that the stored manifest names count, so lost executors leave orphans,
never wrong data. The manifest and the index are Parquet tables:

* manifest: doc_id, nth (0, 1, … among rows repeating a doc_id), shard, file, at (ids before it in the shard), n_tokens
* index: one row per bucket of keys: a minimal perfect hash, and slots holding
  (fingerprint, shard, at, n_tokens); a key costs one bucket, one slot and one
  fingerprint comparison, whatever the number of documents.

The key is (doc_id, nth). Equal doc_ids share a shard. Defined results: null
text is empty (its ids are the end id alone); a null doc_id is a key of its own
and comes first; a key that is not indexed gives no row; other columns are
ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, open_input, open_output, shared_folder, ship_package, stored, text_or_empty, tokenizer_path
from .mphf import Mphf
from .viterbi import WordTable

MAGIC = b"SILOTOK1"
HEADER = 32
BUCKET_KEYS = 4096
#: Longer pieces are encoded each time.
MEMO_PIECE = 40
#: Pieces that an encoder remembers, in about 200 bytes each, before its table starts anew.
MEMO_PIECES = 1_200_000
#: Missing pieces that the library encodes as one text.
JOINED_PIECES = 512

_MANIFEST = "doc_id long, nth long, shard int, file string, at long, n_tokens long"
_SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<i4"), ("at", "<i8"), ("n_tokens", "<i8")])
_INDEX = "bucket long, mphf binary, slots binary, tail binary"
_FOUND = "doc_id long, nth long, shard int, at long, n_tokens long"


@dataclass(frozen=True)
class TokenStore:
    folder: str
    manifest: DataFrame
    index: DataFrame
    buckets: int


def header(width: int, ids: int) -> bytes:
    return (MAGIC + np.array([width, 0, ids], "<i8").tobytes())[:HEADER]


_ENCODERS: dict[str, tuple] = {}


def encoder(path: str) -> tuple[Callable[[pa.Array], list[bytes]], int]:
    """One encoder, with its memo, per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = byte_bpe_encoder(path)
    return _ENCODERS[path]


def byte_bpe_encoder(path: str) -> tuple[Callable[[pa.Array], list[bytes]], int]:
    """A function from texts to raw ids with the ``tokenizers`` library, and the id width in bytes.

    The byte-level pre-tokenizer always ends a pre-token where a space follows
    a non-space, so Arrow cuts a text there, numbers the pieces of a batch, and
    the library encodes each once per worker (a bounded table). Missing pieces go through the
    library joined to one text; tokens are spelled in one character per byte,
    so the bytes they cover tell where each piece ends. A vocabulary with another
    pre-tokenizer or a normalizer, and a text with a run of spaces or an added
    token in it, go through the library whole.
    """
    import json

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    lib = Tokenizer.from_file(path)
    code = "H" if lib.get_vocab_size() <= 1 << 16 else "I"
    spec = json.loads(lib.to_str())
    splits = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" \
        and not spec["pre_tokenizer"].get("add_prefix_space") and spec.get("truncation") is None
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def library(texts: list[str]) -> list[bytes]:
        return [array(code, e.ids).tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(text: str) -> bytes:
        return library([text])[0]

    covers = np.zeros(max(lib.get_vocab().values(), default=0) + 1, np.int64)  # bytes of each token
    for token, i in lib.get_vocab().items():
        covers[i] = len(token)
    width = array(code).itemsize

    def together(words: list[str]) -> list[bytes]:
        ids = np.array(lib.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, f"<u{width}")
        ends, asked = np.cumsum(covers[ids]), np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy() + 1)
        at = np.searchsorted(ends, asked)
        if len(ends) == 0 or ends[-1] != asked[-1] or (ends[at] != asked).any():
            return library([" " + w for w in words])
        raw, cuts = ids.tobytes(), [0, *(width * (at + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def pieces(words: list[str]) -> list[bytes]:
        empty = words[:1] == [""]  # sorted and distinct; joined to others it would make a run of spaces
        out = library([" "]) if empty else []
        for k in range(len(out), len(words), JOINED_PIECES):
            out += together(words[k:k + JOINED_PIECES])
        return out

    # pieces by what stands after their space; a text's first piece has none before it
    table = WordTable(pieces, lambda word: whole(" " + word), MEMO_PIECE, MEMO_PIECES, f"<u{width}")

    def encode(texts: pa.Array) -> list[bytes]:
        odd = np.full(len(texts), not splits)
        for cut in ("  ", *added):
            odd |= pc.match_substring(texts, cut).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        flat, ends = table.encode(pc.list_slice(cut, 1))  # a last space is an empty piece after its space
        begun = iter(library(pc.list_element(cut, 0).to_pylist()))
        rest = iter(np.split(flat, ends[:-1]))
        return [whole(t.as_py()) if o else next(begun) + next(rest).tobytes() for o, t in zip(odd, texts, strict=True)]

    return encode, width


def _writer(folder: str, vocabulary: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = width = out = None
        at, nth, last = 0, 0, object()
        for batch in batches_of(batches):
            if out is None:
                encode, width = encoder(vocabulary)
                shard = batch.column("shard")[0].as_py()
                file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                out = open_output(file)
                out.write(header(width, 0))
                end = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()
            ids = batch.column("doc_id").to_pylist()
            ats, sizes, nths = [], [], []
            for doc_id, raw in zip(ids, encode(batch.column("text")), strict=True):
                out.write(raw + end)
                n = (len(raw) + len(end)) // width
                nth = nth + 1 if doc_id == last else 0
                last = doc_id
                ats.append(at)
                sizes.append(n)
                nths.append(nth)
                at += n
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(nths, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([file] * n, pa.string()),
                 pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "nth", "shard", "file", "at", "n_tokens"])
        if out is not None:
            out.close()

    return write


def _hash(*salt: int) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), F.col("nth"), *[F.lit(s) for s in salt])


def _keyed(keys: DataFrame, buckets: int) -> DataFrame:
    return (keys.withColumn("h", _hash()).withColumn("fingerprint", _hash(1))
            .withColumn("bucket", F.pmod(F.shiftright("h", 17), F.lit(buckets))))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    made, at = Mphf.build(rows["h"].to_numpy("int64").view("u8"))
    slots = np.zeros(len(rows), _SLOT)
    for name in _SLOT.names:
        slots[name] = rows[name].to_numpy("int64").view("u8") if name == "fingerprint" else rows[name].to_numpy()
    placed = np.zeros(made.n, _SLOT)
    placed[at[at >= 0]] = slots[at >= 0]
    return pd.DataFrame({"bucket": [key[0]], "mphf": [made.to_bytes()], "slots": [placed.tobytes()], "tail": [slots[at < 0].tobytes()]})


def _find(key: tuple, keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(index) or not len(keys):
        return pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("doc_id", "nth", "shard", "at", "n_tokens")})
    made, slots = Mphf.from_bytes(index["mphf"][0]), np.frombuffer(index["slots"][0], _SLOT)
    tail = np.frombuffer(index["tail"][0], _SLOT)
    mark = keys["fingerprint"].to_numpy("int64").view("u8")
    at = made.slots(keys["h"].to_numpy("int64").view("u8"))
    for i, m in enumerate(tail["fingerprint"]):
        at[mark == m] = made.n + i
    slots = np.concatenate([slots, tail])
    hit = at >= 0
    hit[hit] = slots["fingerprint"][at[hit]] == mark[hit]
    got = slots[at[hit]]
    out = keys.loc[hit, ["doc_id", "nth"]].reset_index(drop=True).astype("Int64")
    return out.assign(shard=got["shard"], at=got["at"], n_tokens=got["n_tokens"])


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int | None = 2, shards: int | None = None) -> TokenStore:
    """Encode ``docs`` (doc_id, text) into shard files and index them."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = shared_folder(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
             .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
             .withColumn("shard", F.spark_partition_id()))
    write = _writer(folder, vocabulary or tokenizer_path("byte_bpe_50k.json"), end_id)
    manifest = stored(dealt.mapInArrow(write, _MANIFEST), "token-manifest")
    buckets = max(1, -(-manifest.count() // BUCKET_KEYS))
    index = stored(_keyed(manifest, buckets).select("bucket", "h", "fingerprint", "shard", "at", "n_tokens")
                   .groupBy("bucket").applyInPandas(_build, _INDEX), "token-index")
    return TokenStore(folder, manifest, index, buckets)


def find(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Locators (doc_id, nth, shard, at, n_tokens) of the distinct keys (doc_id[, nth]) that the index holds."""
    nth = F.col("nth").cast("long") if "nth" in keys.columns else F.lit(0).cast("long")
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), nth.alias("nth")).distinct()
    asked = _keyed(asked, store.buckets).select("bucket", "doc_id", "nth", "h", "fingerprint")
    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInPandas(_find, _FOUND)


def shard_starts(store: TokenStore) -> DataFrame:
    """(shard, file, start): ids in all shards before it; one row per shard."""
    sums = store.manifest.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _read(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[tuple[pa.RecordBatch, list]]:
    file = name = None
    for batch in batches:
        out = []
        for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
            if path != name:
                if file is not None:
                    file.close()
                file, name = open_input(path), path
                head = file.read(HEADER)
                if head[:8] != MAGIC:
                    raise ValueError(f"{path} is not a token shard")
                width = int(np.frombuffer(head, "<i8", 1, 8)[0])
            file.seek(HEADER + at * width)
            out.append(make(np.frombuffer(file.read(n * width), f"<u{width}").astype("<u4")))
        yield batch, out
    if file is not None:
        file.close()


def read_ids(store: TokenStore, keys: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, nth, start (ids before it in the whole store), n_tokens, and ``ids`` (or with ``digest`` their ``ids_crc32``).

    Keys are looked up in the index, and each task reads the ranges of its shards in file order.
    """
    made = "ids_crc32" if digest else "ids"
    kind = "long" if digest else "array<long>"
    same = ("doc_id", "nth", "start", "n_tokens")

    def make(ids: np.ndarray):
        return zlib.crc32(ids.tobytes()) if digest else ids.astype("i8")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _read(batches, make):
            columns = [*(batch.column(c) for c in same), pa.array(values, pa.int64() if digest else pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*same, made])

    located = find(store, keys).join(shard_starts(store), "shard")
    located = (located.select("doc_id", "nth", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "file", "at")
               .repartition("file").sortWithinPartitions("file", "at"))
    return located.mapInArrow(read, f"doc_id long, nth long, start long, n_tokens long, {made} {kind}")
