"""Documents with planted periods and conversations with planted faults: inputs of the registered queries of operators 11 and 13."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, ship_package, text_or_empty


def _repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches):
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for i, doc_id in enumerate(ids):
            h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
            if h % 10 == 0 and (words := texts[i].split()):  # of bytes: at 0x20 and 0x09-0x0D only
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                block = words[a:a + p]
                texts[i] = b" ".join(words[:a] + (block * (-(-(n - a) // p)))[:n - a])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periods planted in the documents whose ``crc32`` of the decimal doc_id (null: of nothing) ends in 0.

    With ``g`` the other digits of that number, the words from word ``g % n`` on repeat with period ``1 + (n - a) // (3 + g % 8)``.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(_repeat, "doc_id long, text string")


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by ``crc32('conv_id:turn') % 20``; nulls are one space.

    0 drops the turn, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 gives it the role user.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    rows = turns.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_sql() -> str:
    """DuckDB SQL of operator 13's query: a recursion from each conversation's last turn to its first.

    ``z0`` to ``z3`` hold the best (cost, letters, lines) to the end from each state of the grammar. The inputs are damaged
    in SQL too; ``crc32`` is folded byte by byte over its table, which follows from the polynomial.
    """
    def best(*options: str) -> str:
        return f"list_min([x for x in [{', '.join(options)}] if x is not null])"

    def edit(cost: str, letter: str, line: str, after: str) -> str:
        return f"struct_pack(c := {cost} + {after}.c, a := '{letter}' || {after}.a, o := {line} || {after}.o)"

    kept = "chr(10) || role || ':' || text"
    follow = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    name = {"u": "user", "a": "assistant"}

    def stay(s: int) -> str:
        letter, to = follow[s]
        options = [edit("3", "D", "''", f"z{s}"), f"CASE WHEN fault NOT IN ('b', 'd') THEN {edit('2 + cut', 'R', f'chr(10) || {chr(39)}{name[letter]}:{chr(39)} || text', f'z{to}')} END"]
        for said, goes in {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[s]:
            options.append(f"CASE WHEN fault NOT IN ('b', 'd') AND role[1] = '{said}' THEN {edit('cut', 'K', kept, f'z{goes}')} END")
        return best(*options)

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    end0, end2 = "struct_pack(c := 0, a := '', o := '')", f"struct_pack(c := 2, a := 'I', o := {assistant})"
    return f"""
        WITH RECURSIVE bits(n, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
                 SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
             crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
             rows AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
             hashed AS (SELECT rows.*, xor(list_reduce([4294967295] || [ascii(id[i]) FOR i IN range(1, length(id) + 1)],
                                   lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1])), 4294967295) % 20 AS f FROM rows, crc),
             damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                                CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
                         FROM hashed, range(2) AS copy(i) WHERE f <> 0 AND (i = 0 OR f = 3)),
             placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
             numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
                                 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM placed),
             faulty AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                               lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM numbered),
             known AS (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM faulty),
             totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                               count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, max(i) AS last,
                               count(*) FILTER (i > 1 AND prior[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM known GROUP BY 1),
             walk AS (SELECT conv_id, last + 1 AS i, {end0} AS f0, struct_pack(c := 4, a := 'II', o := {user} || {assistant}) AS f1, {end2} AS f2, {end0} AS f3 FROM totals
                      UNION ALL
                      SELECT conv_id, i, {best("b0", edit("2", "I", user, "b2"), edit("4", "II", f"{user} || {assistant}", "b3"))},
                             {best("b1", edit("2", "I", user, "b2"), edit("4", "II", f"{user} || {assistant}", "b3"))},
                             {best("b2", edit("2", "I", assistant, "b3"))}, {best("b3", edit("2", "I", user, "b2"))}
                      FROM (SELECT conv_id, i, {stay(0)} AS b0, {stay(1)} AS b1, {stay(2)} AS b2, {stay(3)} AS b3
                            FROM (SELECT k.*, w.f0 AS z0, w.f1 AS z1, w.f2 AS z2, w.f3 AS z3
                                  FROM walk AS w JOIN known AS k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i - 1))),
             done AS (SELECT conv_id, f0 FROM walk WHERE i = 1)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(f0.o[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN totals AS t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
             LEFT JOIN done AS d ON d.conv_id IS NOT DISTINCT FROM e.conv_id"""
