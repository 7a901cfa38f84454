"""Exact dedup against a history of digests held in a minimal perfect hash.

The distinct SHA-256 digests of the historical documents are dealt into buckets
by digest; each bucket is one row of the stored index: a minimal perfect hash
and its slots (full 32-byte digest, winner locator = largest doc_id, rows).
Incoming digests are first summed (one row per distinct digest), then looked up
in their bucket: the slot's digest is compared byte by byte, so a member joins
the historical group and a nonmember forms a group of its own. A group of any
number of copies is one row before every shuffle that groups.

Defined results: null text counts as empty. Texts are equal when identical.
Of equal texts the row with the largest doc_id stays; a null doc_id loses
against any other, and a group with only null ids keeps one of them. Rows that
repeat both doc_id and text are one document (they count in ``group_size``).
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored, text_or_empty
from .mphf import Mphf

#: Distinct historical digests in a bucket of the index, on average.
BUCKET_KEYS = 4096

_SLOT = np.dtype([("digest", "S32"), ("winner", "<i8"), ("known", "?"), ("rows", "<i8")])
_INDEX = "bucket long, mphf binary, slots binary, tail binary"
_GROUP = "digest binary, keep_id long, group_size long, member boolean"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, rows): one row for each distinct (doc_id, text)."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))
            .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")))


def _summed(table: DataFrame, buckets: int) -> DataFrame:
    return (table.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("rows").alias("rows"))
            .withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))))


def _records(frame: pd.DataFrame) -> np.ndarray:
    rows = np.zeros(len(frame), _SLOT)
    if len(frame):
        rows["digest"] = np.array([bytes(x) for x in frame["digest"]], "S32")
        rows["known"] = frame["winner"].notna().to_numpy()
        rows["winner"] = frame["winner"].fillna(0).to_numpy("int64")
        rows["rows"] = frame["rows"].to_numpy("int64")
    return rows


def _hashes(digest: np.ndarray) -> np.ndarray:
    """First 8 bytes of each digest ('S32' drops trailing zero bytes only in Python objects, not in the buffer)."""
    return np.ascontiguousarray(digest).view(np.uint8).reshape(-1, 32)[:, :8].copy().view("<u8").ravel()


def _build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    rows = _records(frame)
    made, at = Mphf.build(_hashes(rows["digest"]))
    slots = np.zeros(made.n, _SLOT)
    slots[at[at >= 0]] = rows[at >= 0]
    return pd.DataFrame({"bucket": [key[0]], "mphf": [made.to_bytes()], "slots": [slots.tobytes()], "tail": [rows[at < 0].tobytes()]})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The stored index of the (doc_id, digest, rows) table ``history``."""
    return stored(_summed(history, buckets).groupBy("bucket").applyInPandas(_build, _INDEX), "digest-index")


def _lookup(key: tuple, incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    asked = _records(incoming)
    if len(index):
        made, slots = Mphf.from_bytes(index["mphf"][0]), np.frombuffer(index["slots"][0], _SLOT).copy()
        tail = np.frombuffer(index["tail"][0], _SLOT)
    else:
        made, slots, tail = Mphf.build(np.zeros(0, np.uint64))[0], np.zeros(0, _SLOT), np.zeros(0, _SLOT)
    at = made.slots(_hashes(asked["digest"])) if len(asked) else np.zeros(0, np.int64)
    hit = at >= 0
    hit[hit] = slots["digest"][at[hit]] == asked["digest"][hit]  # all 32 bytes
    known = np.concatenate([slots, tail])
    in_tail = {d: made.n + i for i, d in enumerate(tail["digest"])}
    for i in np.flatnonzero(~hit) if in_tail else ():
        if asked["digest"][i] in in_tail:
            at[i], hit[i] = in_tail[asked["digest"][i]], True
    mine, theirs = asked[hit], at[hit]
    known["rows"][theirs] += mine["rows"]
    better = mine["known"] & (~known["known"][theirs] | (mine["winner"] > known["winner"][theirs]))
    known["winner"][theirs[better]] = mine["winner"][better]
    known["known"][theirs[better]] = True
    out = np.concatenate([known, asked[~hit]])
    raw = np.ascontiguousarray(out["digest"]).view(np.uint8).reshape(-1, 32)
    return pd.DataFrame({"digest": [r.tobytes() for r in raw], "keep_id": pd.Series(out["winner"], dtype="Int64").mask(~out["known"]),
                         "group_size": out["rows"], "member": np.arange(len(out)) < len(known)})


def groups(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, member) of all distinct digests of both (doc_id, digest, rows) tables.

    ``member``: the digest is in the history.
    """
    ship_package(history.sparkSession)
    buckets = max(1, -(-history.count() // BUCKET_KEYS))
    index = build_index(history, buckets)
    return _summed(incoming, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_lookup, _GROUP)


def split_history(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A digest table in two halves by a hash of doc_id: what counts as history, and what comes in."""
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)) == 0
    return table.where(old), table.where(~old)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, member."""
    table = stored(digests(docs), "digests")
    found = groups(*split_history(table))
    return (table.drop("rows").join(found, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "member"))


def _row_key(digest: str, doc_id: str) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.hex(digest), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies, with its own columns."""
    columns = docs.columns
    found = groups(*split_history(stored(digests(docs), "digests"))).select(_row_key("digest", "keep_id").alias("_key"))
    marked = (docs.withColumn("_text_digest", F.unhex(F.sha2(text_or_empty(), 256))).withColumn("_id", F.col("doc_id").cast("long"))
              .withColumn("_key", _row_key("_text_digest", "_id")).drop("_text_digest", "_id"))
    # one key per document on both sides: no copies meet in a task, and the second step reuses the join's partitions
    return marked.join(found, "_key").dropDuplicates(["_key"]).select(*columns)
