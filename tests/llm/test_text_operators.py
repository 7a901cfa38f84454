"""Toxicity, chat formatting, mixing, WARC and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from silolake.llm import chat_preference, soft_mixing, toxicity, warc
from silolake.llm.toxicity import INSULT, NEGATION, OTHER, QUOTE, REPORT, TARGET, THREAT, clause_weight

SMALL = "/root/testdata/sf0.001"


def test_grammar_scores_clauses():
    plain = clause_weight([(OTHER, 0), (INSULT, 2.0)])
    assert plain == 2.0
    assert clause_weight([(TARGET, 0), (INSULT, 2.0)]) == 3.0 == clause_weight([(INSULT, 2.0), (TARGET, 0)])
    assert clause_weight([(NEGATION, 0), (OTHER, 0), (INSULT, 2.0)]) == 0.5
    assert clause_weight([(NEGATION, 0), *[(OTHER, 0)] * 3, (INSULT, 2.0)]) == 2.0
    assert clause_weight([(REPORT, 0), (INSULT, 2.0)]) == 1.0 == clause_weight([(QUOTE, 0), (INSULT, 2.0)])
    assert clause_weight([(THREAT, 2.0)]) == 0.0 and clause_weight([(TARGET, 0), (THREAT, 2.0)]) == 3.0


def labelled(spark, n=200):
    rows = [(i, f"calm words here {i}. nothing at all" if i % 2 else f"you are a zog{'aeiou'[i % 5]}k and a blarg {i}. more words") for i in range(n)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "what a blarg you zogak blarg"), (902, "plain " * 50000)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'x' as score", "1 as toxic")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(n)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == 204 and any(r["held_out"] for r in rows.values())
    assert all(rows[i]["predicted"] == 1 - i % 2 for i in range(200))
    assert rows[900]["score"] == rows[901]["score"] < 0.5 and rows[None]["predicted"] == 1 and rows[902]["predicted"] == 0
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == 103


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 10)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn int, role string, text string").selectExpr("*", "'x' as part", "1 as loss")


def test_preference_pairs(spark):
    same = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    chosen = turns(spark, [*same, (1, 2, "user", "more"), (1, 3, "assistant", "good"), (2, 0, "user", "only"), (3, 0, None, None), (None, 0, "user", "n")])
    rejected = turns(spark, [*same, (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (1, 4, "user", "x"), (3, 0, None, None), (4, 0, "user", "r"), (None, 0, "user", "n")])
    got = {r["pair_id"]: r for r in chat_preference.preference_pairs(chosen, rejected).collect()}
    assert got[1]["prompt_turns"] == 3
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n"
    assert [tuple(s) for s in got[1]["chosen"]] == [("<|assistant|>\n", False), ("good<|end|>\n", True)]
    assert [tuple(s) for s in got[1]["rejected"]] == [("<|assistant|>\n", False), ("bad<|end|>\n", True), ("<|user|>\n", False), ("x<|end|>\n", False)]
    assert (got[2]["prompt"], got[2]["rejected"], len(got[2]["chosen"])) == ("", [], 2)
    assert (got[3]["prompt"], got[3]["chosen"]) == ("<||>\n<|end|>\n", []) and got[None]["prompt_turns"] == 1
    assert got[4]["chosen"] == [] and chat_preference.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_turns_after_the_swapped_reply_stay_on_both_sides(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "good"), (2, 2, "user", "thanks"), (2, 3, "user", "bye"), (3, 0, "assistant", "other"), (5, 0, "user", "u")]
    pairs = chat_preference.preference_pairs(*chat_preference.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    got = {r["pair_id"]: r for r in pairs.collect()}
    after = [("<|user|>\n", False), ("thanks<|end|>\n", False), ("<|user|>\n", False), ("bye<|end|>\n", False)]
    assert got[2]["prompt_turns"] == 1
    assert [tuple(s) for s in got[2]["chosen"]] == [("<|assistant|>\n", False), ("good<|end|>\n", True), *after]
    assert [tuple(s) for s in got[2]["rejected"]] == [("<|assistant|>\n", False), ("other<|end|>\n", True), *after]
    assert (got[5]["prompt_turns"], got[5]["chosen"], got[5]["rejected"]) == (1, [], [])


def test_chat_plan_is_native(spark):
    conversations = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    plan = chat_preference.preference_pairs(*chat_preference.swapped_replies(conversations))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rates_match_plain_projected_gradient(spark):
    rnd = np.random.default_rng(4)
    p = np.round(rnd.dirichlet([0.4, 0.3, 0.2], 300), 2)
    p /= p.sum(1, keepdims=True)
    tokens = rnd.integers(1, 500, 300)
    table = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    found, totals = soft_mixing.rates(table, ["a", "b", "c"], {"a": 0.2, "b": 0.3, "c": 0.5}, budget=60000.0)
    assert all(abs(now / target - 1) <= 2e-3 for now, target in totals.values())
    share, target = (tokens[:, None] * p).sum(0), 60000 * np.array([0.2, 0.3, 0.5])
    rate, size = np.ones(300), 1 / max(share / target)
    for _ in range(soft_mixing.STEPS):
        off = ((tokens * rate)[:, None] * p).sum(0) / target - 1
        if abs(off).max() <= soft_mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ (size * off))
    got = {tuple(r["p"]): r["rate"] for r in found.collect()}
    assert all(abs(got[tuple(row)] - r) < 1e-6 for row, r in zip(p.tolist(), rate, strict=True)) and rate.min() >= 0


def test_rates_reach_rare_domains_without_dropping(spark):
    rnd = np.random.default_rng(7)
    p = np.round(np.concatenate([rnd.dirichlet([9, 0.3, 0.01], 400), rnd.dirichlet([0.4, 6, 0.02], 300), rnd.dirichlet([0.05, 0.1, 3], 6)]), 2)
    p /= p.sum(1, keepdims=True)
    tokens = rnd.integers(1, 500, len(p))
    table = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    for budget, least in ((None, 1.0), (90000.0, 0.0)):
        found, totals = soft_mixing.rates(table, ["en", "de", "es"], {"en": 0.5, "de": 0.3, "es": 0.2}, budget=budget, steps=8)
        rate = {tuple(r["p"]): r["rate"] for r in found.collect()}
        assert min(rate.values()) >= least
        got = sum(t * rate[tuple(row)] * np.array(row) for t, row in zip(tokens.tolist(), p.tolist(), strict=True))
        assert abs(got / got.sum() / [0.5, 0.3, 0.2] - 1).max() <= 2e-3
        assert abs(got - [now for now, _ in totals.values()]).max() < 1 and (budget is None or abs(got.sum() / budget - 1) <= 2e-3)


def test_rates_keep_the_largest_domain_and_report_misses(spark):
    table = spark.createDataFrame([(900, [1.0, 0.0]), (100, [0.0, 1.0])], "tokens long, p array<double>")
    found, totals = soft_mixing.rates(table, ["en", "es"], {"en": 0.5, "es": 0.5})
    assert {tuple(r["p"]): round(r["rate"], 2) for r in found.collect()} == {(1.0, 0.0): 1.0, (0.0, 1.0): 9.0}
    with pytest.warns(UserWarning, match="en 900 of 0 tokens"):
        soft_mixing.rates(table, ["en", "es"], {"es": 1.0}, steps=8)
    mixed = spark.createDataFrame([(900, [1.0, 0.0]), (100, [0.5, 0.5])], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="misses its targets"):
        soft_mixing.rates(mixed, ["en", "es"], {"en": 0.2, "es": 0.8}, steps=8)


def test_mix_keeps_every_document_and_handles_odd_rows(spark):
    rows = [(i, "le chat et la souris " * (1 + i % 3) if i % 4 == 0 else "the cat and the mouse " * (1 + i % 5), "x") for i in range(80)]
    docs = spark.createDataFrame([*rows, (90, None, "x"), (91, "", "x"), (None, "the end", "x"), (1, rows[1][1], "x")], "doc_id long, text string, rate string")
    marks = docs.where("doc_id < 60").selectExpr("doc_id", "text", "if(doc_id % 4 = 0, 'fr', 'en') as domain")
    mixed, domains = soft_mixing.mix(docs, marks, {"fr": 0.5, "en": 0.5, "xx": 0.3})
    got = {r["doc_id"]: r for r in mixed.collect()}
    assert domains == ["en", "fr"] and len(got) == 83 and all(r["copies"] >= 1 for r in got.values())
    assert all((got[i]["p"][1] > 0.5) == (i % 4 == 0) for i in range(80))
    assert got[64]["rate"] > 1.5 > got[65]["rate"]
    out = soft_mixing.repeat(docs, mixed)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got.values()) + got[1]["copies"]
    plain, none = soft_mixing.mix(docs, marks.limit(0), {"fr": 1.0})
    assert none == [] and {r["copies"] for r in plain.collect()} == {1}
    assert soft_mixing.mix(docs.limit(0), marks, {"fr": 1.0})[0].count() == 0


def pages(spark):
    rows = [(1, "http://a.example/x?y=1", "<p>é</p>"), (2, "http://b.example", "same"), (5, "http://b.example/2", "same"), (3, None, None), (4, "bad\r\nurl [", ""),
            (None, "http://n.example", "same"), (6, "http://c.example", "long " * 60000), (7, "http://d.example", "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as sha")


def test_warc_round_trip(spark):
    table = pages(spark)
    folder, manifest = warc.write_archives(table, archives=3)
    captures = warc.assemble(warc.read_records(spark, folder, manifest))
    assert captures.where("size(requests) = 1 and size(metadata) = 1").count() == 8
    got = {r["page_id"]: r for r in warc.page_captures(captures).collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in table.collect()}
    assert all((r["payload_bytes"], r["payload_digest"]) == (len(html[i]), warc.digest(html[i])) for i, r in got.items())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None),
        None: ("response", None), 6: ("response", None), 7: ("response", None)}
    payloads = {bytes(r["payload"]) for r in captures.where("type = 'response'").collect()}
    assert payloads == set(html.values())
    folder, manifest = warc.write_archives(table, least=10)
    assert warc.read_records(spark, folder, manifest).where("type = 'revisit'").count() == 0


def test_warc_empty_table(spark):
    folder, manifest = warc.write_archives(pages(spark).limit(0))
    assert warc.page_captures(warc.assemble(warc.read_records(spark, folder, manifest))).count() == 0


def test_transactions_join_whichever_side_names_the_other(spark):
    row = lambda ident, kind, to: ("f", ident, kind, "u", to, None, 1, "d", {}, b"x")
    rows = [row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["q1"]), row("r2", "response", []), row("m2", "metadata", ["r2", "r1"]), row("q9", "request", ["lost"])]
    got = {r["record_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert {k: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for k, r in got.items()} == {
        "r1": (["q1"], ["m1", "m2"]), "r2": ([], ["m2"])}


def test_pipeline_keeps_columns_and_drops_copies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == columns
        if name == "exact_dedup":
            stages_texts = docs.selectExpr("coalesce(text, '')").distinct().count()
        stages.append((name, docs.count(), out.count()))
        docs = out
    (_, n, clean), (_, _, once), (_, _, apart), (_, _, mixed) = stages
    assert n >= clean >= once >= apart <= mixed
    assert once == stages_texts and apart < once  # of equal texts one stays; near copies go
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert coded.count() == mixed


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "jaccard_join", "soft_mixing", "sentencepiece"])
def test_stages_take_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL).count() == 0
