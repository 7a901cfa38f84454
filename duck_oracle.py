"""Independent DuckDB SQL for every value-checkable query in ``__spark_entry__``.

Written from the operator definitions, not from the Spark code: plain
``row_number``/``RANGE`` windows and joins, the way a SQL user would state
each operator. Column names and rounding match the Spark side.
"""

from __future__ import annotations

import math

from silolake.functions.features import FEATURE_COLS
from silolake.operators.partition import DEFAULT_SHARES, dirichlet_cuts, share_fractions
from silolake.schemas import TX_TYPES

SEED = 42
R = 6  # decimals compared


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def hash01(tag: str, key_sql: str, seed: int = SEED) -> str:
    return (f"((CAST(('0x' || substr(md5(concat('{seed}:{tag}:', {key_sql})), 1, 12)) AS BIGINT) + 0.5)"
            f" / CAST(281474976710656 AS DOUBLE))")


def normal01(tag: str, key_sql: str, seed: int = SEED) -> str:
    return f"(sqrt(-2 * ln({hash01(tag + '/a', key_sql, seed)})) * cos(2 * pi() * {hash01(tag + '/b', key_sql, seed)}))"


TX_EVENTS = """
SELECT event_id,
  CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS INTEGER) AS step,
  CASE event_type WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'CASH_IN' WHEN 'purchase' THEN 'TRANSFER'
                  WHEN 'error' THEN 'CASH_OUT' ELSE 'DEBIT' END AS type,
  value AS amount,
  concat('C', CAST(user_id AS VARCHAR)) AS nameOrig,
  CAST((event_id*37) % 5000 AS DOUBLE) AS oldbalanceOrg,
  greatest(CAST((event_id*37) % 5000 AS DOUBLE) - value, 0.0) AS newbalanceOrig,
  concat('M', CAST((event_id*7919) % 97 AS VARCHAR)) AS nameDest,
  CAST((event_id % 3) * 1000 AS DOUBLE) AS oldbalanceDest,
  CAST((event_id % 3) * 1000 AS DOUBLE) + value AS newbalanceDest,
  CASE WHEN (event_type IN ('purchase','error') AND value > 150) OR event_id % 997 = 0 THEN 1 ELSE 0 END AS isFraud,
  CASE WHEN value > 300 THEN 1 ELSE 0 END AS isFlaggedFraud
FROM events"""

TX_LINEITEM = """
SELECT k.event_id,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS step,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT' WHEN '3-MEDIUM' THEN 'PAYMENT'
                       WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
  l_extendedprice AS amount, concat('C', CAST(o_custkey AS VARCHAR)) AS nameOrig,
  greatest(c_acctbal, 0.0) AS oldbalanceOrg, greatest(c_acctbal - l_extendedprice, 0.0) AS newbalanceOrig,
  concat('S', CAST(l_suppkey AS VARCHAR)) AS nameDest,
  greatest(s_acctbal, 0.0) AS oldbalanceDest, greatest(s_acctbal, 0.0) + l_extendedprice AS newbalanceDest,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 45 AND o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS isFraud,
  CASE WHEN l_extendedprice > 90000 THEN 1 ELSE 0 END AS isFlaggedFraud
FROM ( SELECT *, (l_orderkey*10 + l_linenumber)*100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus
       ) AS event_id FROM lineitem ) k
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""

UPD_LONG = """
SELECT CAST(vec_id // 10 AS INTEGER) AS round, concat('silo-', CAST(vec_id % 10 AS VARCHAR)) AS silo_id,
       100*(vec_id % 10 + 1) AS n, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS v
FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)"""

UPDATES = """
SELECT CAST(vec_id // 10 AS INTEGER) AS round, concat('silo-', CAST(vec_id % 10 AS VARCHAR)) AS silo_id,
       greatest(CAST(vec_id // 10 AS INTEGER) - CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END, 0) AS base_version,
       CAST(embedding AS DOUBLE[]) AS delta,
       CAST(100*(vec_id % 10 + 1) AS BIGINT) AS n_samples,
       label / 10.0 AS train_loss,
       ((vec_id * 13) % 50) / 10.0 AS wall_time_s,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((vec_id // 10) * 600 + ((vec_id % 10) * 97 + (vec_id // 10) * 31) % 720 AS BIGINT)) AS arrived_at
FROM embeddings"""

ROUNDS = """
SELECT DISTINCT CAST(vec_id // 10 AS INTEGER) AS round,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((vec_id // 10) * 600 AS BIGINT)) AS start_ts,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((vec_id // 10) * 600 + 480 AS BIGINT)) AS deadline
FROM embeddings"""

SILOS = """
SELECT DISTINCT concat('silo-', CAST(vec_id % 10 AS VARCHAR)) AS silo_id, CAST(1000 * (vec_id % 10 + 1) AS BIGINT) AS n_rows
FROM embeddings WHERE vec_id % 10 < 8"""


def tx_cte(source: str = "lineitem") -> str:
    return f"tx AS ({TX_LINEITEM if source == 'lineitem' else TX_EVENTS})"


def cut_case(cum: list[float], rn: str = "rn", n: str = "n_t") -> str:
    whens = " ".join(f"WHEN {rn} <= floor({dbl(c)} * {n}) THEN {i}" for i, c in enumerate(cum[:-1]))
    return f"CASE {whens} ELSE {len(cum) - 1} END"


def silo_cte(shares=DEFAULT_SHARES, alpha: float = 0.5, mode: str = "shares", n_silos: int = 5,
             name: str = "stx", src: str = "tx") -> str:
    """Rows numbered per type in md5(seed:event_id) order; cut at floor(cum_share · n_type)."""
    cuts = dirichlet_cuts(TX_TYPES, n_silos, alpha, shares, SEED, mode)
    case = "CASE type " + " ".join(f"WHEN '{t}' THEN {cut_case(c)}" for t, c in cuts.items()) + " END"
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5(concat('{SEED}:', CAST(event_id AS VARCHAR))), event_id) AS rn,
         count(*) OVER (PARTITION BY type) AS n_t FROM {src}),
{name} AS (SELECT * EXCLUDE (rn, n_t), concat('silo-', CAST({case} AS VARCHAR)) AS silo_id FROM {name}_r)"""


def shares_cte(shares=DEFAULT_SHARES, name: str = "ptx", src: str = "tx") -> str:
    cum = share_fractions(shares)
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat('{SEED}:', CAST(event_id AS VARCHAR))), event_id) AS rn,
         count(*) OVER () AS n_t FROM {src}),
{name} AS (SELECT * EXCLUDE (rn, n_t), concat('silo-', CAST({cut_case(cum)} AS VARCHAR)) AS silo_id FROM {name}_r)"""


def vel(fn: str, n: int, part: str = "silo_id, nameOrig") -> str:
    return f"{fn} OVER (PARTITION BY {part} ORDER BY step RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def feature_exprs() -> dict[str, str]:
    l1p = "ln(1 + greatest(amount, 0))"
    hour = "2 * pi() * (((step % 24) + 24) % 24) / 24.0"
    e = {
        "log1p_amount": l1p,
        "balance_delta_orig": "oldbalanceOrg - newbalanceOrig - amount",
        "balance_delta_dest": "oldbalanceDest - newbalanceDest - amount",
        "zero_balance_orig": "CASE WHEN oldbalanceOrg = 0 THEN 1.0 ELSE 0.0 END",
        "zero_balance_dest": "CASE WHEN oldbalanceDest = 0 THEN 1.0 ELSE 0.0 END",
    }
    for t in TX_TYPES:
        e[f"type_{t}"] = f"CASE WHEN type = '{t}' THEN 1.0 ELSE 0.0 END"
    for n in (1, 24, 168):
        e[f"velocity_{n}h_count"] = f"CAST({vel('count(*)', n)} AS DOUBLE)"
    for n in (1, 24, 168):
        e[f"velocity_{n}h_sum"] = vel("sum(amount)", n)
    e["in_degree_24h"] = f"CAST({vel('count(*)', 24, 'silo_id, nameDest')} AS DOUBLE)"
    e["log1p_amount_orig_balance_ratio"] = f"CASE WHEN oldbalanceOrg > 0 THEN {l1p} / ln(1 + oldbalanceOrg) ELSE 0.0 END"
    e["log1p_amount_dest_balance_ratio"] = f"CASE WHEN oldbalanceDest > 0 THEN {l1p} / ln(1 + oldbalanceDest) ELSE 0.0 END"
    e["is_flagged_fraud"] = "CAST(isFlaggedFraud AS DOUBLE)"
    e["hour_sin"] = f"sin({hour})"
    e["hour_cos"] = f"cos({hour})"
    return e


def feat_cte(name: str = "feat", src: str = "stx") -> str:
    cols = ",\n  ".join(f"coalesce({x}, 0.0) AS {k}" for k, x in feature_exprs().items())
    return f"{name} AS (SELECT event_id, silo_id, step, type, isFraud,\n  {cols}\nFROM {src})"


def stats_cte(name: str = "stats", src: str = "feat") -> str:
    parts = [f"SELECT silo_id, '{c}' AS feature, avg({c}) AS mean, "
             f"CASE WHEN coalesce(stddev_pop({c}), 0) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS std "
             f"FROM {src} GROUP BY silo_id" for c in FEATURE_COLS]
    return f"{name} AS (" + "\nUNION ALL ".join(parts) + ")"


def rnd(x: str, d: int = R) -> str:
    return f"round({x}, {d})"


# ---------------------------------------------------------------------------------------------
# Query texts
# ---------------------------------------------------------------------------------------------

TX_COLS = ["event_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest",
           "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]
DOUBLE_TX = {"amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"}


def _sel_round(cols, doubles, d=R):
    return ", ".join(rnd(c, d) + f" AS {c}" if c in doubles else c for c in cols)


def _base() -> dict[str, str]:
    q: dict[str, str] = {}
    fx = feature_exprs()
    q["read_transactions"] = f"WITH {tx_cte()} SELECT {_sel_round(TX_COLS, DOUBLE_TX)} FROM tx"
    q["read_transactions_events"] = f"WITH {tx_cte('events')} SELECT {_sel_round(TX_COLS, DOUBLE_TX)} FROM tx"
    scalar = {
        "feat_log1p_amount": ["log1p_amount"],
        "feat_balance_delta_orig": ["balance_delta_orig"],
        "feat_balance_delta_dest": ["balance_delta_dest"],
        "feat_zero_balance": ["zero_balance_orig", "zero_balance_dest"],
        "feat_type_onehot": [f"type_{t}" for t in TX_TYPES],
        "feat_amount_balance_ratio": ["log1p_amount_orig_balance_ratio", "log1p_amount_dest_balance_ratio"],
        "feat_is_flagged": ["is_flagged_fraud"],
        "feat_hour_cyclic": ["hour_sin", "hour_cos"],
    }
    for k, names in scalar.items():
        cols = ", ".join(f"{rnd(f'coalesce({fx[n]}, 0.0)')} AS {n}" for n in names)
        q[k] = f"WITH {tx_cte()} SELECT event_id, {cols} FROM tx"
    # absent step / flag / window columns → 0.0
    present = {k: v for k, v in fx.items() if not (k.startswith("velocity") or k.startswith("in_degree")
                                                   or k.startswith("hour") or k == "is_flagged_fraud")}
    arr = ", ".join(f"coalesce({present[c]}, 0.0)" if c in present else "0.0" for c in FEATURE_COLS)
    q["feat_missing_to_zero"] = (
        f"WITH {tx_cte()}, v AS (SELECT event_id, [{arr}] AS f FROM tx) "
        f"SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, {rnd('CAST(CAST(f[i] AS FLOAT) AS DOUBLE)')} AS value "
        f"FROM v, unnest(range(1, 23)) t(i)")
    feat_all = f"WITH {tx_cte()}, {silo_cte()}, {feat_cte()}"
    arr2 = ", ".join(FEATURE_COLS)
    q["feature_vector"] = (
        f"{feat_all}, v AS (SELECT event_id, silo_id, CAST(isFraud AS FLOAT) AS label, [{arr2}] AS f FROM feat) "
        f"SELECT event_id, silo_id, round(CAST(label AS DOUBLE), 4) AS label, CAST(i - 1 AS INTEGER) AS pos, "
        f"round(CAST(CAST(f[i] AS FLOAT) AS DOUBLE), 4) AS value FROM v, unnest(range(1, 23)) t(i)")
    q["feature_table"] = f"{feat_all} SELECT event_id, silo_id, {_sel_round(FEATURE_COLS, set(FEATURE_COLS))} FROM feat"
    q["filter_by_type"] = f"WITH {tx_cte()} SELECT {_sel_round(TX_COLS, DOUBLE_TX)} FROM tx WHERE type = 'TRANSFER'"
    q["silo_stats"] = f"{feat_all}, {stats_cte()} SELECT silo_id, feature, {rnd('mean')} AS mean, {rnd('std')} AS std FROM stats"
    zcols = ", ".join(
        f"{rnd(f'({c} - m_{i}) / s_{i}')} AS {c}" for i, c in enumerate(FEATURE_COLS))
    piv = ", ".join(f"max(CASE WHEN feature = '{c}' THEN mean END) AS m_{i}, "
                    f"max(CASE WHEN feature = '{c}' THEN std END) AS s_{i}" for i, c in enumerate(FEATURE_COLS))
    q["standardize"] = (f"{feat_all}, {stats_cte()}, sw AS (SELECT silo_id, {piv} FROM stats GROUP BY silo_id) "
                        f"SELECT event_id, feat.silo_id, {zcols} FROM feat JOIN sw USING (silo_id)")
    q["join_silo_stats"] = (f"{feat_all}, {stats_cte()} SELECT event_id, silo_id, {rnd('log1p_amount')} AS log1p_amount, "
                            f"{rnd('mean')} AS mean, {rnd('std')} AS std FROM feat JOIN stats USING (silo_id) "
                            f"WHERE feature = 'log1p_amount'")
    for kind in ("count", "sum"):
        cols = ", ".join(f"{rnd(fx[f'velocity_{n}h_{kind}'])} AS velocity_{n}h_{kind}" for n in (1, 24, 168))
        q[f"velocity_{kind}"] = f"WITH {tx_cte()}, {silo_cte()} SELECT event_id, {cols} FROM stx"
    vcols = ", ".join(
        f"{rnd(x.replace('silo_id, nameOrig', 'nameOrig'))} AS {k}" for k, x in fx.items() if k.startswith("velocity"))
    q["velocity_events"] = f"WITH {tx_cte('events')} SELECT event_id, {vcols} FROM tx"
    q["in_degree_24h"] = f"WITH {tx_cte()}, {silo_cte()} SELECT event_id, {fx['in_degree_24h']} AS in_degree_24h FROM stx"
    distinct_sql = lambda part, src: (
        f"SELECT a.event_id, CAST(count(DISTINCT b.nameOrig) AS DOUBLE) AS in_degree_24h_distinct "
        f"FROM {src} a JOIN {src} b ON a.nameDest = b.nameDest {part} AND b.step BETWEEN a.step - 23 AND a.step "
        f"GROUP BY a.event_id")
    q["in_degree_24h_distinct"] = f"WITH {tx_cte('events')} {distinct_sql('', 'tx')}"
    q["in_degree_24h_distinct_lineitem"] = (f"WITH {tx_cte()}, {silo_cte()} "
                                            f"{distinct_sql('AND a.silo_id = b.silo_id', 'stx')}")
    q["dirichlet_partition"] = f"WITH {tx_cte()}, {silo_cte()} SELECT event_id, type, silo_id FROM stx"
    q["dirichlet_partition_alpha"] = f"WITH {tx_cte()}, {silo_cte(shares=None)} SELECT event_id, type, silo_id FROM stx"
    q["dirichlet_partition_both"] = f"WITH {tx_cte()}, {silo_cte(mode='both')} SELECT event_id, type, silo_id FROM stx"
    q["partition_by_size_shares"] = f"WITH {tx_cte()}, {shares_cte()} SELECT event_id, silo_id FROM ptx"
    q["distributed_rank"] = (f"WITH {tx_cte()} SELECT event_id, type, row_number() OVER (PARTITION BY type ORDER BY "
                             f"md5(concat('7:', CAST(event_id AS VARCHAR))), event_id) AS rn FROM tx")
    return q


def oracle() -> dict[str, str]:
    q = _base()
    for extra in _EXTRA:
        q.update(extra())
    return q


_EXTRA: list = []


def register(fn):
    _EXTRA.append(fn)
    return fn


# ---- batch 2: injectors, amplify, drift, metrics ---------------------------------------------

MONEY = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
PSI_FEATURES = ["log1p_amount", "log1p_amount_orig_balance_ratio", "balance_delta_dest"]


def rule_score(src_cols: str = "") -> str:
    return ("round((ln(1 + greatest(amount, 0)) / 12 + 0.3 * CASE WHEN type IN ('TRANSFER','CASH_OUT') THEN 1.0 ELSE 0.0 END"
            " + 0.2 * isFlaggedFraud) / 1.5, 3)")


def _psi_sql(long_cte: str, by: str, cur_filter: str, ref_filter: str, win_expr: str) -> str:
    """PSI of L(by..., step, value) by slices; written from the definition with quantile_cont."""
    probs = "[" + ", ".join(dbl(i / 20) for i in range(21)) + "]"
    lin = "[lo + i * (hi - lo) / 20.0 for i in range(20)] || [hi]"
    on = " AND ".join(f"a.{k} = b.{k}" for k in by.split(", "))
    return f"""{long_cte},
R AS (SELECT * FROM L WHERE {ref_filter}),
C AS (SELECT *, {win_expr} AS win FROM L WHERE {cur_filter}),
E AS (SELECT {by}, quantile_cont(value, {probs}) AS qe, min(value) AS rmin, max(value) AS rmax, count(*) AS n_ref
      FROM R GROUP BY {by}),
S AS (SELECT {by}, win, min(value) AS cmin, max(value) AS cmax FROM C GROUP BY {by}, win),
SE0 AS (SELECT S.*, E.qe, E.rmin, E.rmax, E.n_ref, least(rmin, cmin) - 1e-6 AS lo, greatest(rmax, cmax) + 1e-6 AS hi
        FROM S JOIN E USING ({by})),
SE AS (SELECT *, CASE WHEN len(list_distinct(qe)) < 2 THEN {lin}
                 ELSE [least(qe[1], lo)] || qe[2:20] || [greatest(qe[21], hi)] END AS edges FROM SE0),
RB AS (SELECT a.{by.replace(', ', ', a.')}, a.win, least(greatest(len(list_filter(a.edges, lambda e: e <= b.value)) - 1, 0), 19) AS bin
       FROM SE a JOIN R b ON {on}),
CB AS (SELECT a.{by.replace(', ', ', a.')}, a.win, least(greatest(len(list_filter(a.edges, lambda e: e <= b.value)) - 1, 0), 19) AS bin
       FROM SE a JOIN C b ON {on} AND a.win = b.win),
G AS (SELECT {by}, win, CAST(g.bin AS INTEGER) AS bin, n_ref FROM SE, unnest(range(0, 20)) g(bin)),
H AS (SELECT G.*, coalesce(rc.c, 0) AS rc, coalesce(cc.c, 0) AS cc FROM G
      LEFT JOIN (SELECT {by}, win, bin, count(*) AS c FROM RB GROUP BY ALL) rc USING ({by}, win, bin)
      LEFT JOIN (SELECT {by}, win, bin, count(*) AS c FROM CB GROUP BY ALL) cc USING ({by}, win, bin)),
H2 AS (SELECT *, rc / greatest(sum(rc) OVER w, 1) + 1e-6 AS r0, cc / greatest(sum(cc) OVER w, 1) + 1e-6 AS c0,
              sum(cc) OVER w AS cn FROM H WINDOW w AS (PARTITION BY {by}, win)),
H3 AS (SELECT *, r0 / sum(r0) OVER w AS r, c0 / sum(c0) OVER w AS c FROM H2 WINDOW w AS (PARTITION BY {by}, win)),
P AS (SELECT {by}, win, CASE WHEN max(n_ref) = 0 OR max(cn) = 0 THEN 0.0 ELSE sum((r - c) * ln(r / c)) END AS psi
      FROM H3 GROUP BY {by}, win)"""


def _drift_long() -> str:
    fx = feature_exprs()
    parts = " UNION ALL ".join(f"SELECT silo_id, event_id, step, '{f}' AS feature, coalesce({fx[f]}, 0.0) AS value FROM dtx"
                               for f in PSI_FEATURES)
    return (f"WITH {tx_cte()}, {silo_cte()}, dtx AS (SELECT * REPLACE (CASE WHEN step >= 2000 THEN amount * 3.0 "
            f"ELSE amount END AS amount) FROM stx), L AS ({parts})")


def _curve(src: str, by: str) -> str:
    return f"""sc AS (SELECT {by}, score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {by}, score),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS cum_pos,
              sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS cum_neg,
              sum(pos) OVER (PARTITION BY {by}) AS P, sum(neg) OVER (PARTITION BY {by}) AS N FROM sc)"""


ROC = "CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + 0.5 * neg)) / (max(P) * max(N)) END"
AP = "CASE WHEN max(P) > 0 THEN sum((pos / P) * (cum_pos / (cum_pos + cum_neg))) END"
REC = "CASE WHEN max(P) > 0 THEN coalesce(max(CASE WHEN cum_neg / N <= 0.01 THEN cum_pos / P END), 0.0) END"


@register
def _batch2() -> dict[str, str]:
    q: dict[str, str] = {}
    stx = f"WITH {tx_cte()}, {silo_cte()}"
    flip = f"{hash01('flip', 'CAST(event_id AS VARCHAR)')} < 0.5"
    q["inject_label_flip"] = (f"{stx} SELECT event_id, silo_id, CASE WHEN silo_id = 'silo-1' AND {flip} "
                              f"THEN 1 - isFraud ELSE isFraud END AS isFraud FROM stx")
    flip1 = f"{hash01('flip', 'CAST(event_id AS VARCHAR)')} < 1.0"
    q["inject_label_flip_all"] = f"WITH {tx_cte()} SELECT event_id, CASE WHEN {flip1} THEN 1 - isFraud ELSE isFraud END AS isFraud FROM tx"
    q["inject_drift"] = (f"WITH {tx_cte()} SELECT event_id, step, {rnd('CASE WHEN step >= 2000 THEN amount * 3.0 ELSE amount END')} "
                         f"AS amount FROM tx")
    key = "concat(CAST(event_id AS VARCHAR), ':', CAST(copy AS VARCHAR))"
    money = ", ".join(
        f"{rnd(f'CASE WHEN copy > 0 THEN {c} * exp(0.1 * {normal01(f'amp/{c}', key)}) ELSE {c} END')} AS {c}" for c in MONEY)
    off = f"CAST(floor({hash01('amp/step', 'CAST(copy AS VARCHAR)')} * 99) + 1 AS INTEGER)"
    amp_src = f"WITH {tx_cte()}, a AS (SELECT tx.*, CAST(c.copy AS INTEGER) AS copy FROM tx, unnest(range(0, {{f}})) c(copy))"
    q["amplify"] = (amp_src.format(f=3) + f" SELECT event_id, copy, CASE WHEN copy > 0 THEN step + {off} ELSE step END AS step, "
                    f"CASE WHEN copy > 0 THEN concat(nameOrig, '_amp', CAST(copy AS VARCHAR)) ELSE nameOrig END AS nameOrig, "
                    f"CASE WHEN copy > 0 THEN concat(nameDest, '_amp', CAST(copy AS VARCHAR)) ELSE nameDest END AS nameDest, "
                    f"isFraud, type, {money} FROM a")
    q["amplify_class_rates"] = (amp_src.format(f=4) + " SELECT copy, type, count(*) AS n, "
                                f"{rnd('avg(isFraud)')} AS fraud_rate FROM a GROUP BY copy, type")
    q["sampled_class_rates"] = f"WITH {tx_cte()} SELECT type, {rnd('avg(isFraud)')} AS fraud_rate, count(*) AS n FROM tx GROUP BY type"
    q["distinct_types"] = f"WITH {tx_cte()} SELECT DISTINCT type FROM tx"
    q["class_balance"] = (f"{stx} SELECT silo_id, sum(isFraud) AS n_pos, sum(1 - isFraud) AS n_neg, "
                          f"{rnd('sum(1 - isFraud) / greatest(sum(isFraud), 1)')} AS pos_weight FROM stx GROUP BY silo_id")
    cum = share_fractions(DEFAULT_SHARES)
    tgt = " UNION ALL ".join(f"SELECT 'silo-{i}' AS silo_id, {dbl(s / sum(DEFAULT_SHARES))} AS target_share"
                             for i, s in enumerate(DEFAULT_SHARES))
    q["partition_report"] = (
        f"{stx}, r AS (SELECT silo_id, type, count(*) AS n FROM stx GROUP BY ROLLUP (silo_id, type)), "
        f"tot AS (SELECT count(*) AS t FROM stx), tg AS ({tgt}) "
        f"SELECT r.silo_id, type, n, {rnd('CASE WHEN r.silo_id IS NOT NULL AND type IS NULL THEN n / t END')} AS share, "
        f"{rnd('CASE WHEN r.silo_id IS NOT NULL AND type IS NULL THEN n / t END - target_share')} AS share_error "
        f"FROM r CROSS JOIN tot LEFT JOIN tg ON r.silo_id = tg.silo_id")
    q["partition_chi2"] = (
        f"{stx}, s AS (SELECT DISTINCT silo_id FROM stx), t AS (SELECT DISTINCT type FROM stx), "
        f"o AS (SELECT silo_id, type, count(*) AS o FROM stx GROUP BY ALL), "
        f"g AS (SELECT s.silo_id, t.type, coalesce(o.o, 0) AS o, "
        f"(SELECT count(*) FROM stx x WHERE x.silo_id = s.silo_id) * (SELECT count(*) FROM stx y WHERE y.type = t.type) "
        f"/ (SELECT count(*) FROM stx) AS e FROM s CROSS JOIN t LEFT JOIN o ON o.silo_id = s.silo_id AND o.type = t.type) "
        f"SELECT silo_id, {rnd('sum((o - e) * (o - e) / e)')} AS chi2 FROM g GROUP BY silo_id")
    dl = _drift_long()
    probs = "[" + ", ".join(dbl(i / 20) for i in range(21)) + "]"
    q["quantile_edges"] = (f"{dl}, R AS (SELECT * FROM L WHERE step < 1000), E AS (SELECT silo_id, feature, "
                           f"quantile_cont(value, {probs}) AS qe FROM R GROUP BY ALL) "
                           f"SELECT silo_id, feature, CAST(i - 1 AS INTEGER) AS p_idx, "
                           f"{rnd('qe[i]')} AS q FROM E, unnest(range(1, 22)) t(i)")
    psi = _psi_sql(dl, "silo_id, feature", "step >= 1000", "step < 1000", "CAST((step - 1000) // 250 AS INTEGER)")
    q["histogram_counts"] = psi + " SELECT silo_id, feature, win, bin, cc AS cnt FROM H"
    q["psi"] = psi + f" SELECT silo_id, feature, win, {rnd('psi')} AS psi FROM P"
    q["drift_alerts"] = psi + f" SELECT silo_id, feature, win, {rnd('psi')} AS psi FROM P WHERE psi > 0.2"
    ev_long = (f"WITH {tx_cte('events')}, L AS (SELECT type, step, ln(1 + amount) AS value, "
               f"CAST(step // 24 AS INTEGER) AS day FROM tx)")
    q["psi_events"] = _psi_sql(ev_long, "type", "day >= 10", "day < 10", "day").replace(
        "SELECT *, day AS win FROM L", "SELECT * EXCLUDE (day), day AS win FROM L") + \
        f" SELECT type, win AS day, {rnd('psi')} AS psi FROM P"
    sc = f"{stx}, s AS (SELECT silo_id, isFraud AS y, {rule_score()} AS score FROM stx)"
    q["auc_roc"] = f"{sc}, s1 AS (SELECT 0 AS g, * FROM s), {_curve('s1', 'g')} SELECT {rnd(ROC)} AS auc_roc FROM cu"
    q["auc_pr"] = f"{sc}, s1 AS (SELECT 0 AS g, * FROM s), {_curve('s1', 'g')} SELECT {rnd(AP)} AS auc_pr FROM cu"
    q["silo_auc"] = f"{sc}, {_curve('s', 'silo_id')} SELECT silo_id, {rnd(ROC)} AS auc_roc, {rnd(AP)} AS auc_pr FROM cu GROUP BY silo_id"
    q["recall_at_fpr"] = f"{sc}, {_curve('s', 'silo_id')} SELECT silo_id, {rnd(REC)} AS recall_at_fpr FROM cu GROUP BY silo_id"
    q["classification_report"] = (f"{sc}, {_curve('s', 'silo_id')} SELECT silo_id, {rnd(ROC)} AS auc_roc, {rnd(AP)} AS auc_pr, "
                                  f"{rnd(REC)} AS recall_at_fpr FROM cu GROUP BY silo_id")
    bce = ("-(pw) * y * ln(least(greatest(score, 1e-7), 1 - 1e-7)) - (1 - y) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7))")
    q["weighted_bce"] = (f"{sc}, cb AS (SELECT silo_id, sum(1 - y) / greatest(sum(y), 1) AS pw FROM s GROUP BY silo_id) "
                         f"SELECT silo_id, {rnd(f'avg({bce})')} AS bce FROM s JOIN cb USING (silo_id) GROUP BY silo_id")
    return q


# ---- batch 3: updates and rounds -------------------------------------------------------------

def _ul(src_upd: str | None = None) -> str:
    if src_upd is None:
        return f"ul AS ({UPD_LONG})"
    return (f"ul AS (SELECT round, silo_id, n_samples AS n, CAST(i - 1 AS INTEGER) AS pos, delta[i] AS v "
            f"FROM {src_upd}, unnest(range(1, len(delta) + 1)) t(i))")


TRIM_SQL = """tm_x AS (SELECT *, count(*) OVER (PARTITION BY round, pos) AS k,
                 row_number() OVER (PARTITION BY round, pos ORDER BY v, silo_id) AS rk FROM ul),
tm_y AS (SELECT *, greatest(1, CAST(floor(k * 0.2) AS INTEGER)) AS tr FROM tm_x),
tm AS (SELECT round, pos, CASE WHEN max(k) <= 2 * max(tr) THEN median(v)
                           ELSE avg(CASE WHEN rk > tr AND rk <= k - tr THEN v END) END * 1.0 AS v FROM tm_y GROUP BY round, pos)"""

COS_SQL = """med AS (SELECT round, pos, median(v) AS m FROM ul GROUP BY round, pos),
per AS (SELECT round, silo_id, sum(v * m) AS dot, sqrt(sum(v * v)) AS nrm FROM ul JOIN med USING (round, pos) GROUP BY round, silo_id),
mn AS (SELECT round, sqrt(sum(m * m)) AS mnorm FROM med GROUP BY round),
cs AS (SELECT round, silo_id, CASE WHEN mnorm < 1e-10 THEN 1.0 ELSE dot / (nrm * mnorm + 1e-10) END AS cos FROM per JOIN mn USING (round)),
rj AS (SELECT *, cos < 0.0 AND max(CASE WHEN cos >= 0.0 THEN 1 ELSE 0 END) OVER (PARTITION BY round) = 1 AS rejected FROM cs)"""

QWRA_SQL = """surv AS (SELECT ul.* FROM ul JOIN rj USING (round, silo_id) WHERE NOT rejected),
su AS (SELECT round, sum(u) AS su FROM (SELECT DISTINCT round, silo_id, pow(n, 0.5) AS u FROM surv) GROUP BY round),
dq AS (SELECT round, pos, sum(pow(n, 0.5) / (su + 1e-10) * v) * 1.0 AS d FROM surv JOIN su USING (round) GROUP BY round, pos),
ra AS (SELECT round, sqrt(sum((d - tm.v) * (d - tm.v))) / (sqrt(sum(tm.v * tm.v)) + 1e-10) AS ratio
       FROM dq JOIN tm USING (round, pos) GROUP BY round)"""

QWRA_OUT = ("SELECT dq.round, dq.pos, round(CASE WHEN ratio > 5.0 THEN tm.v ELSE d END, 6) AS v, ratio > 5.0 AS fallback "
            "FROM dq JOIN tm USING (round, pos) JOIN ra USING (round)")

POISONED = ("pu AS (SELECT * REPLACE (CASE WHEN silo_id = 'silo-1' THEN list_transform(delta, lambda x: x * -5.0) "
            "ELSE delta END AS delta) FROM upd)")

WIN_JOIN = ("a AS (SELECT u.*, r.round AS window_round FROM upd u LEFT JOIN rounds_v r "
            "ON u.arrived_at > r.start_ts AND u.arrived_at <= r.deadline)")

RESUB = ("rs AS (SELECT * FROM upd UNION ALL SELECT * REPLACE (arrived_at + INTERVAL 30 SECOND AS arrived_at, "
         "train_loss * 0.9 AS train_loss) FROM upd)")


def _round_updates_sql(src: str) -> str:
    return f"""reg AS (SELECT * FROM {src} WHERE silo_id IN (SELECT silo_id FROM silos_v)),
cal AS (SELECT round, start_ts, deadline,
        deadline + to_microseconds(CAST((epoch_us(deadline) - epoch_us(start_ts)) / 2 AS BIGINT)) AS ext FROM rounds_v),
own AS (SELECT reg.*, start_ts, deadline, ext FROM reg JOIN cal USING (round) WHERE arrived_at > start_ts),
q AS (SELECT CAST(ceil(0.6 * count(DISTINCT silo_id)) AS INTEGER) AS q FROM silos_v),
st AS (SELECT round, count(DISTINCT silo_id) FILTER (arrived_at <= deadline) AS n_on,
              count(DISTINCT silo_id) FILTER (arrived_at <= ext) AS n_ext,
              any_value(deadline) AS dl, any_value(ext) AS ex FROM own GROUP BY round),
cl AS (SELECT round, CASE WHEN n_on >= q THEN dl WHEN n_ext >= q THEN ex END AS close_ts FROM st, q),
acc AS (SELECT own.round AS agg_round, own.round AS src_round, silo_id, 0 AS staleness, own.* EXCLUDE (round, silo_id)
        FROM own JOIN cl USING (round) WHERE close_ts IS NOT NULL AND arrived_at <= close_ts
        QUALIFY row_number() OVER (PARTITION BY own.round, silo_id ORDER BY arrived_at DESC) = 1),
lt AS (SELECT c2.round AS agg_round, own.round AS src_round, silo_id, 1 AS staleness, own.* EXCLUDE (round, silo_id)
       FROM own JOIN cl c1 ON own.round = c1.round JOIN cl c2 ON c2.round = own.round + 1
       WHERE c1.close_ts IS NOT NULL AND arrived_at > c1.close_ts AND c2.close_ts IS NOT NULL AND arrived_at <= c2.close_ts
       QUALIFY row_number() OVER (PARTITION BY own.round, silo_id ORDER BY arrived_at DESC) = 1),
ru AS (SELECT *, pow(0.5, staleness) AS weight FROM (SELECT * FROM acc UNION ALL SELECT * FROM lt))"""


@register
def _batch3() -> dict[str, str]:
    q: dict[str, str] = {}
    base = f"WITH upd AS ({UPDATES}), rounds_v AS ({ROUNDS}), silos_v AS ({SILOS}), {_ul()}"
    q["fedavg"] = f"{base} SELECT round, pos, {rnd('sum(pow(n, 0.5) * v) / sum(pow(n, 0.5)) * 1.0')} AS v FROM ul GROUP BY round, pos"
    q["fedavg_textbook"] = f"{base} SELECT round, pos, {rnd('sum(pow(n, 1.0) * v) / sum(pow(n, 1.0)) * 0.5')} AS v FROM ul GROUP BY round, pos"
    q["trimmed_mean"] = f"{base}, {TRIM_SQL} SELECT round, pos, {rnd('v')} AS v FROM tm"
    q["coordinate_median"] = f"{base} SELECT round, pos, {rnd('median(v)')} AS v FROM ul GROUP BY round, pos"
    q["update_cosine"] = f"{base}, {COS_SQL} SELECT round, silo_id, {rnd('cos')} AS cos FROM cs"
    q["qwra_reject"] = f"{base}, {COS_SQL} SELECT round, silo_id, {rnd('cos')} AS cos, rejected FROM rj"
    q["qwra"] = f"{base}, {TRIM_SQL}, {COS_SQL}, {QWRA_SQL} {QWRA_OUT}"
    pbase = f"WITH upd AS ({UPDATES}), {POISONED}, {_ul('pu')}"
    q["qwra_poisoned"] = f"{pbase}, {TRIM_SQL}, {COS_SQL}, {QWRA_SQL} {QWRA_OUT}"
    q["inject_model_poison"] = f"{pbase} SELECT round, silo_id, pos, {rnd('v')} AS v FROM ul"
    clip = ("cl AS (SELECT *, least(1.0, 1.0 / greatest(sqrt(list_sum([x * x for x in delta])), 1e-10)) AS sc FROM upd)")
    q["l2_clip"] = (f"{base}, {clip}, c AS (SELECT *, sqrt(list_sum([(x * sc) * (x * sc) for x in delta])) AS nm FROM cl) "
                    f"SELECT round, silo_id, {rnd('nm')} AS norm, CAST(i - 1 AS INTEGER) AS pos, {rnd('delta[i] * sc')} AS v "
                    "FROM c, unnest(range(1, len(delta) + 1)) t(i)")
    nkey = "concat(CAST(round AS VARCHAR), ':', silo_id, ':', CAST(pos AS VARCHAR))"
    q["gaussian_noise"] = (f"{base} SELECT round, silo_id, pos, {rnd(f'v + 0.8 * {normal01('noise/run', nkey)}')} AS v FROM ul")
    q["dp_release"] = (f"{base}, {clip}, cu AS (SELECT round, silo_id, CAST(i - 1 AS INTEGER) AS pos, delta[i] * sc AS v "
                       f"FROM cl, unnest(range(1, len(delta) + 1)) t(i)) "
                       f"SELECT round, silo_id, pos, {rnd(f'v + 0.8 * {normal01('noise/run', nkey)}')} AS v FROM cu")
    q["staleness_decay"] = (f"{base}, {WIN_JOIN} SELECT round, silo_id, greatest(window_round - round, 0) AS staleness, "
                            f"{rnd('sqrt(list_sum([(x * pow(0.5, greatest(window_round - round, 0))) * (x * pow(0.5, greatest(window_round - round, 0))) for x in delta]))')} AS norm "
                            f"FROM a WHERE window_round IS NOT NULL")
    fa = "fa AS (SELECT round, pos, sum(pow(n, 0.5) * v) / sum(pow(n, 0.5)) * 1.0 AS v FROM ul GROUP BY round, pos)"
    mv = "mv AS (SELECT round + 2 AS version, round, pos, sum(v) OVER (PARTITION BY pos ORDER BY round ROWS UNBOUNDED PRECEDING) AS w FROM fa)"
    q["apply_update"] = f"{base}, {fa}, {mv} SELECT version, pos, {rnd('w')} AS w FROM mv"
    q["model_versions"] = (f"{base}, {fa}, {mv} SELECT version, round, CAST(count(*) AS INTEGER) AS n_params FROM mv "
                           f"WHERE version = (SELECT max(version) FROM mv) GROUP BY version, round")
    q["join_model_version"] = (f"{base}, {fa}, {mv}, nv AS (SELECT version, sqrt(sum(w * w)) AS nrm FROM mv GROUP BY version) "
                               f"SELECT round, silo_id, base_version, {rnd('coalesce(nrm, 0.0)')} AS base_norm "
                               f"FROM upd LEFT JOIN nv ON upd.base_version = nv.version")
    q["updates_registered"] = f"{base} SELECT round, silo_id FROM upd WHERE silo_id IN (SELECT silo_id FROM silos_v)"
    q["updates_rejected"] = f"{base} SELECT round, silo_id FROM upd WHERE silo_id NOT IN (SELECT silo_id FROM silos_v)"
    q["join_update_sizes"] = (f"{base} SELECT round, upd.silo_id, coalesce(n_rows, 1) AS n_rows FROM upd "
                              f"LEFT JOIN silos_v USING (silo_id)")
    q["update_latest"] = (f"{base}, {RESUB} SELECT round, silo_id, arrived_at, {rnd('train_loss')} AS train_loss FROM "
                          f"(SELECT *, row_number() OVER (PARTITION BY round, silo_id ORDER BY arrived_at DESC) AS rn FROM rs) "
                          f"WHERE rn = 1")
    q["join_round_window"] = f"{base}, {WIN_JOIN} SELECT round, silo_id, window_round FROM a"
    q["update_staleness"] = (f"{base}, {WIN_JOIN} SELECT round, silo_id, window_round, "
                             f"CASE WHEN window_round IS NULL THEN 0 ELSE greatest(window_round - round, 0) END AS staleness, "
                             f"window_round = round AS accepted FROM a")
    q["join_carry_late"] = (f"{base} SELECT u.round, u.silo_id, n.round AS next_round FROM upd u "
                            f"JOIN rounds_v o ON u.round = o.round AND u.arrived_at > o.deadline "
                            f"JOIN rounds_v n ON n.round = u.round + 1")
    q["round_updates"] = (f"{base}, {RESUB}, {_round_updates_sql('rs')} SELECT agg_round, src_round, silo_id, staleness, "
                          f"{rnd('weight')} AS weight, arrived_at FROM ru")
    q["union_late_updates"] = (f"{base}, {_round_updates_sql('upd')} SELECT agg_round, silo_id, staleness, "
                               f"{rnd('sqrt(list_sum([(x * pow(0.5, staleness)) * (x * pow(0.5, staleness)) for x in delta]))')} AS norm FROM ru")
    q["round_aggregate"] = (f"{base}, {_round_updates_sql('upd')}, dl AS (SELECT agg_round AS round, n_samples AS n, "
                            f"delta[i] * pow(0.5, staleness) AS v, CAST(i - 1 AS INTEGER) AS pos "
                            f"FROM ru, unnest(range(1, len(delta) + 1)) t(i)) "
                            f"SELECT round, pos, {rnd('sum(pow(n, 0.5) * v) / sum(pow(n, 0.5)) * 1.0')} AS v FROM dl GROUP BY round, pos")
    return q


# ---- batch 4: run tables, dashboards, hold-outs, set ops, lake ---------------------------------

def _eps_case(col: str) -> str:
    from silolake.functions.privacy import analytic_gaussian_epsilon
    from silolake.plans.run_tables import SIGMAS
    whens = " ".join(f"WHEN {i} THEN {dbl(analytic_gaussian_epsilon(s, 1e-5, 1.0))}" for i, s in enumerate(SIGMAS))
    return f"CASE ({col}) {whens} END"


BASE_NU = f"upd AS ({UPDATES}), rounds_v AS ({ROUNDS}), silos_v AS ({SILOS})"


def _sm_ctes() -> str:
    silo_no = "CAST(regexp_extract(ru2.silo_id, '(\\d+)$', 1) AS INTEGER) % 3"
    return f"""{BASE_NU}, {_round_updates_sql('upd')},
ru2 AS (SELECT *, concat(silo_id, '@', CAST(src_round AS VARCHAR)) AS ukey FROM ru),
ul AS (SELECT agg_round AS round, ukey AS silo_id, n_samples AS n, CAST(i - 1 AS INTEGER) AS pos, delta[i] AS v
       FROM ru2, unnest(range(1, len(delta) + 1)) t(i)),
{COS_SQL},
sm AS (SELECT ru2.agg_round AS round, ru2.silo_id, n_samples, train_loss, CAST(NULL AS DOUBLE) AS auc_roc,
              CAST(NULL AS DOUBLE) AS auc_pr, CAST(staleness AS INTEGER) AS staleness,
              coalesce(CAST(rejected AS INTEGER), 0) AS flagged, {_eps_case(silo_no)} AS epsilon, CAST(NULL AS DOUBLE) AS psi
       FROM ru2 LEFT JOIN rj ON rj.round = ru2.agg_round AND rj.silo_id = ru2.ukey)"""


def _ev_cte(k: int, name: str) -> str:
    return (f"{name}_s AS (SELECT CAST(vec_id // 10 AS INTEGER) AS round, CAST(embedding[{k + 1}] AS DOUBLE) AS score, "
            f"CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y FROM embeddings), "
            f"{name}_c AS (SELECT round, score, sum(y) AS pos, sum(1 - y) AS neg FROM {name}_s GROUP BY round, score), "
            f"{name}_u AS (SELECT *, sum(pos) OVER (PARTITION BY round ORDER BY score DESC) AS cum_pos, "
            f"sum(neg) OVER (PARTITION BY round ORDER BY score DESC) AS cum_neg, sum(pos) OVER (PARTITION BY round) AS P, "
            f"sum(neg) OVER (PARTITION BY round) AS N FROM {name}_c), "
            f"{name} AS (SELECT round, {ROC} AS auc_roc, {AP} AS auc_pr FROM {name}_u GROUP BY round)")


def _rt_ctes() -> str:
    return f"""{_sm_ctes()}, {_ev_cte(0, 'ev0')},
rper AS (SELECT agg_round AS round, CAST(count(*) AS INTEGER) AS n_updates, max(wall_time_s) AS wall_time_s FROM ru GROUP BY 1),
rt AS (SELECT r.round, r.round + 2 AS version, start_ts, deadline, ev0.auc_roc AS global_auc_roc, ev0.auc_pr AS global_auc_pr,
              n_updates, wall_time_s, deadline AS ts FROM rounds_v r JOIN rper USING (round) LEFT JOIN ev0 USING (round))"""


def _res_ctes() -> str:
    evs = ", ".join(_ev_cte(s, f"e{s}") for s in range(3))
    parts = " UNION ALL ".join(
        f"SELECT 'E1' AS experiment, e{s}.round, auc_roc, auc_pr, n_updates, avg_loss, 'qwra' AS agg_kind, {42 + s} AS seed, "
        f"0.5 AS alpha FROM e{s} JOIN pr USING (round)" for s in range(3))
    return f"""{_sm_ctes()}, {evs},
pr AS (SELECT agg_round AS round, CAST(count(*) AS INTEGER) AS n_updates, avg(train_loss) AS avg_loss FROM ru GROUP BY 1),
res AS ({parts})"""


def _alert_ctes() -> str:
    psi = _psi_sql(_drift_long(), "silo_id, feature", "step >= 1000", "step < 1000", "CAST((step - 1000) // 250 AS INTEGER)")
    return psi + (", al AS (SELECT CAST(win AS INTEGER) AS round, silo_id, psi, feature, "
                  "TIMESTAMP '1995-01-01 00:00:00' + to_seconds(CAST((1000 + win * 250) * 86400 AS BIGINT)) AS ts "
                  "FROM P WHERE psi > 0.2)")


SM_COLS = "round, silo_id, n_samples, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ["train_loss", "auc_roc", "auc_pr"]) + ", staleness, flagged, round(epsilon, 6) AS epsilon, round(psi, 6) AS psi"
RT_COLS = ("round, version, start_ts, deadline, round(global_auc_roc, 6) AS global_auc_roc, "
           "round(global_auc_pr, 6) AS global_auc_pr, n_updates, round(wall_time_s, 6) AS wall_time_s, ts")


@register
def _batch4() -> dict[str, str]:
    q: dict[str, str] = {}
    sm = f"WITH {_sm_ctes()}"
    q["silo_round_flags"] = f"{sm} SELECT {SM_COLS} FROM sm"
    q["flagged_silos"] = f"{sm} SELECT silo_id, count(DISTINCT round) AS n_rounds FROM sm WHERE flagged = 1 GROUP BY silo_id"
    q["privacy_ledger"] = (f"{sm} SELECT silo_id, {rnd('sum(epsilon)')} AS epsilon_total, {rnd('count(*) * 1e-5')} AS delta_total, "
                           f"count(*) AS n_releases FROM sm GROUP BY silo_id")
    q["epsilon_running"] = (f"{sm}, er AS (SELECT round, silo_id, sum(epsilon) OVER (PARTITION BY silo_id ORDER BY round "
                            f"ROWS UNBOUNDED PRECEDING) AS c FROM sm) SELECT round, silo_id, {rnd('c')} AS epsilon_cum, "
                            f"{rnd('50.0 - c')} AS budget_left FROM er")
    q["round_loss"] = f"{sm} SELECT round, {rnd('avg(train_loss)')} AS avg_loss FROM sm GROUP BY round"
    al = _alert_ctes()
    q["dashboard_kpis"] = (f"{al}, {_rt_ctes()} SELECT (SELECT count(*) FROM rt) AS rounds_completed, "
                           f"(SELECT count(DISTINCT silo_id) FROM sm) AS silos, (SELECT count(*) FROM al) AS drift_alerts")
    q["comm_cost"] = (f"WITH {BASE_NU}, {_round_updates_sql('upd')} SELECT agg_round AS round, sum(len(delta) * 8) AS bytes, "
                      f"{rnd('sum(n_samples) / sum(wall_time_s)')} AS rows_per_s FROM ru GROUP BY agg_round")
    q["rounds_ordered"] = f"WITH {_rt_ctes()} SELECT {RT_COLS} FROM rt ORDER BY round"
    q["latest_rounds"] = f"WITH {_rt_ctes()} SELECT {RT_COLS} FROM rt ORDER BY round DESC LIMIT 10"
    q["silo_metrics_ordered"] = f"{sm} SELECT {SM_COLS} FROM sm ORDER BY round, silo_id"
    q["latest_silo_metrics"] = f"{sm} SELECT {SM_COLS} FROM sm ORDER BY round DESC, silo_id DESC, staleness LIMIT 50"
    alert_cols = f"round, silo_id, {rnd('psi')} AS psi, feature, ts"
    q["alerts_by_time"] = f"{al} SELECT {alert_cols} FROM al ORDER BY ts DESC, silo_id, feature"
    q["drift_alert_stream_batch"] = f"{al} SELECT {alert_cols} FROM al"
    res = f"WITH {_res_ctes()}"
    q["metric_vs_first_round"] = (
        f"{res} SELECT experiment, seed, round, {rnd('auc_pr')} AS auc_pr, "
        f"{rnd('auc_pr - first_value(auc_pr) OVER (PARTITION BY experiment, seed ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS gain_vs_first, "
        f"{rnd('auc_pr - lag(auc_pr) OVER (PARTITION BY experiment, seed ORDER BY round)')} AS gain_vs_prev FROM res")
    q["rounds_to_target"] = (f"{res} SELECT experiment, seed, min(CASE WHEN auc_pr >= 0.7 THEN round END) AS first_round "
                             f"FROM res GROUP BY experiment, seed")
    q["final_metrics"] = (f"{res}, lr AS (SELECT *, row_number() OVER (PARTITION BY experiment, seed ORDER BY round DESC) AS rn, "
                          f"count(*) OVER (PARTITION BY experiment, seed) AS n_rounds FROM res) "
                          f"SELECT experiment, seed, round, {rnd('auc_roc')} AS auc_roc, {rnd('auc_pr')} AS auc_pr, n_rounds "
                          f"FROM lr WHERE rn = 1")
    q["seed_summary"] = (f"{res}, lr AS (SELECT *, row_number() OVER (PARTITION BY experiment, seed ORDER BY round DESC) AS rn "
                         f"FROM res) SELECT experiment, {rnd('avg(auc_pr)')} AS mean_auc_pr, {rnd('stddev_samp(auc_pr)')} AS std_auc_pr, "
                         f"count(*) AS n_seeds FROM lr WHERE rn = 1 GROUP BY experiment")
    q["join_drift_epochs"] = (f"{al}, si AS (SELECT DISTINCT silo_id FROM stx), mx AS (SELECT silo_id, max(psi) AS max_psi FROM al "
                              f"GROUP BY silo_id) SELECT si.silo_id, CAST(CASE WHEN max_psi IS NOT NULL THEN ceil(2 * 1.5) ELSE 2 END "
                              f"AS INTEGER) AS local_epochs, {rnd('max_psi')} AS max_psi FROM si LEFT JOIN mx USING (silo_id)")
    hold = (f"WITH {tx_cte()}, hr AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY "
            f"md5(concat('42:holdout:', CAST(event_id AS VARCHAR))), event_id) AS rn, count(*) OVER (PARTITION BY type) AS nt, "
            f"count(*) OVER () AS n FROM tx), "
            f"hq AS (SELECT type, nt, n, least(5000, n) * nt // n AS base, least(5000, n) * nt % n AS left_over FROM (SELECT DISTINCT type, nt, n FROM hr)), "
            f"hs AS (SELECT type, base + CASE WHEN row_number() OVER (ORDER BY left_over DESC, type) <= least(5000, n) - sum(base) OVER () "
            f"THEN 1 ELSE 0 END AS quota FROM hq), "
            f"ho AS (SELECT hr.*, CASE WHEN rn <= quota THEN 'public' ELSE 'train' END AS split FROM hr JOIN hs USING (type))")
    q["public_holdout"] = f"{hold} SELECT event_id, type, split FROM ho"
    q["temporal_holdout"] = (f"WITH {tx_cte()}, c AS (SELECT quantile_cont(step, {dbl(0.9)}) AS cut FROM tx) "
                             f"SELECT event_id, step, CASE WHEN step > cut THEN 'test' ELSE 'train' END AS split FROM tx, c")
    q["split_disjoint_check"] = (f"{hold} SELECT count(*) AS n_total, count(*) FILTER (WHERE split = 'public') AS n_a, "
                                 f"count(*) FILTER (WHERE split = 'train') AS n_b, CAST(0 AS BIGINT) AS n_overlap, "
                                 f"CAST(0 AS BIGINT) AS n_missing FROM ho")
    q["union_silo_parts"] = f"WITH {tx_cte()}, {silo_cte()} SELECT silo_id, type, count(*) AS n FROM stx GROUP BY ALL"
    q["union_copies"] = (f"WITH {tx_cte()} SELECT CAST(c.copy AS INTEGER) AS copy, count(*) AS n, sum(isFraud) AS n_fraud "
                         f"FROM tx, unnest(range(0, 3)) c(copy) GROUP BY ALL")
    q["last_w_events"] = (f"{_drift_long()} SELECT silo_id, feature, event_id, step, {rnd('value')} AS value FROM L "
                          "QUALIFY row_number() OVER (PARTITION BY silo_id, feature ORDER BY step DESC, event_id DESC) <= 50000")
    q["quantile_edges_sketch"] = (f"{_drift_long()}, g AS (SELECT silo_id, feature, count(*) AS n FROM L WHERE step < 1000 GROUP BY ALL) "
                                  "SELECT silo_id, feature, CAST(i AS INTEGER) AS p_idx, n, true AS within FROM g, range(21) t(i)")
    q["lakehouse_snapshot"] = (f"WITH {tx_cte()}, {silo_cte()} SELECT silo_id, CAST(floor(step / 100) AS BIGINT) AS batch_id, "
                               f"count(*) AS n FROM stx WHERE floor(step / 100) <= 12 GROUP BY ALL")
    q["parse_json_events"] = ("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events "
                              "WHERE json_valid(props)")
    q["parse_json_quarantine"] = "SELECT count(*) AS n_quarantined FROM events WHERE NOT json_valid(props)"
    q["events_to_json"] = ("SELECT CAST(event_id AS VARCHAR) AS key, CAST(to_json({'event_id': event_id, 'ts': epoch_us(ts), 'user_id': user_id, "
                           "'event_type': event_type, 'value': value, 'props': props}) AS VARCHAR) AS value FROM events")
    q["read_transactions_lake"] = (f"WITH {tx_cte()}, {silo_cte()} SELECT {_sel_round(TX_COLS, DOUBLE_TX)}, silo_id, "
                                   "CAST(floor(step / 100) AS BIGINT) AS batch_id FROM stx WHERE silo_id = 'silo-1' AND floor(step / 100) <= 12")
    q["lakehouse_snapshot_committed"] = (
        f"WITH {tx_cte('events')}, r AS (SELECT min(step) AS lo, max(step) AS hi FROM tx), "
        "b AS (SELECT least(CAST(floor((step - lo) / ((hi - lo + 1) / 8.0)) AS BIGINT), 7) AS batch_id, step FROM tx, r) "
        "SELECT batch_id, count(*) AS n, min(step) AS first_step, max(step) AS last_step FROM b WHERE batch_id <= 3 GROUP BY 1")
    return q


@register
def _batch5() -> dict[str, str]:
    from silolake.functions import model as MLP
    sizes = [len(FEATURE_COLS), 4, 1]
    w = MLP.init_weights(sizes, 42)
    (w0, b0), (w1, b1) = MLP.unflatten(w, sizes)
    q = _base()["standardize"]
    z = q[: q.index("SELECT event_id, feat.silo_id")]
    zcols = ", ".join(f"({c} - m_{i}) / s_{i} AS {c}" for i, c in enumerate(FEATURE_COLS))
    hidden = ", ".join(
        "greatest(" + " + ".join(f"{c} * {dbl(w0[i, j])}" for i, c in enumerate(FEATURE_COLS)) + f" + {dbl(b0[j])}, 0) AS h{j}"
        for j in range(4))
    out = " + ".join(f"h{j} * {dbl(w1[j, 0])}" for j in range(4)) + f" + {dbl(b1[0])}"
    sql = (f"{z}, zz AS (SELECT event_id, {zcols} FROM feat JOIN sw USING (silo_id)), "
           f"hh AS (SELECT event_id, {hidden} FROM zz) SELECT event_id, {rnd(f'1 / (1 + exp(-({out})))')} AS score FROM hh")
    return {"mlp_score": sql}


@register
def _batch6() -> dict[str, str]:
    cuts = dirichlet_cuts(TX_TYPES, 5, 0.5, None, SEED)
    vals = []
    for t, c in cuts.items():
        props = [c[0]] + [c[i] - c[i - 1] for i in range(1, len(c))]
        vals += [f"('{t}', {i}, {dbl(p)})" for i, p in enumerate(props)]
    return {"join_type_shares": (f"WITH {tx_cte()}, sh(type, silo, share) AS (VALUES {', '.join(vals)}) "
                                 f"SELECT event_id, tx.type, CAST(silo AS INTEGER) AS silo, {rnd('share')} AS share "
                                 f"FROM tx JOIN sh ON tx.type = sh.type")}


@register
def _batch7() -> dict[str, str]:
    q: dict[str, str] = {}
    fx = feature_exprs()
    for kind in ("count", "sum"):
        for n in (1, 24, 168):
            c = f"velocity_{n}h_{kind}"
            q[f"velocity_{kind}_{n}h"] = f"WITH {tx_cte()}, {silo_cte()} SELECT event_id, {rnd(fx[c])} AS {c} FROM stx"
    q["late_updates"] = (f"WITH {BASE_NU}, {_round_updates_sql('upd')} SELECT agg_round, src_round, silo_id, "
                         f"{rnd('weight')} AS weight FROM ru WHERE staleness = 1")
    txs = f"WITH {tx_cte('events')} SELECT {_sel_round(TX_COLS, DOUBLE_TX)} FROM tx"
    for k in ("stream_ingest", "stream_dedup", "lakehouse_sink", "lakehouse_sink_foreach_batch"):
        q[k] = txs
    for k in ("stream_ingest_accounted",):
        q[k] = txs
    again, broken = (f"{hash01(tag, 'CAST(event_id AS VARCHAR)')} < {p}" for tag, p in (("resend", 0.05), ("broken", 0.02)))
    q["stream_ingest_ledger"] = (
        f"WITH {tx_cte('events')}, c AS (SELECT *, {again} AS again, {broken} AS broken, max(step) OVER () AS last FROM tx), "
        "t AS (SELECT count(*) + count(*) FILTER (again) + count(*) FILTER (broken) AS n_in, count(*) AS n_accepted, "
        "count(*) FILTER (broken) AS n_quarantined, count(*) FILTER (again AND step < last - 240) AS n_late, "
        "count(*) FILTER (again AND step >= last - 240) AS n_duplicate FROM c) "
        "SELECT *, n_in = n_accepted + n_quarantined + n_late + n_duplicate AS balanced FROM t")
    q["stream_quarantine"] = f"""SELECT '{{"event_id":' || event_id || ',"step":' AS value FROM events WHERE {broken}"""
    q["round_updates_stream"] = (f"WITH upd AS ({UPDATES}), rounds_v AS ({ROUNDS}), silos_v AS ({SILOS}), {RESUB}, {_round_updates_sql('rs')} "
                                 f"SELECT agg_round, src_round, silo_id, staleness, {rnd('weight')} AS weight, arrived_at FROM ru")
    q["late_updates_stream"] = q["late_updates"]
    fx = feature_exprs()
    parts = " UNION ALL ".join(f"SELECT silo_id, step, '{f}' AS feature, coalesce({fx[f]}, 0.0) AS value FROM stx" for f in PSI_FEATURES)
    probs = "[" + ", ".join(dbl(i / 20) for i in range(21)) + "]"
    bins = "least(greatest(len(list_filter(e.qe, lambda x: x <= {v})) - 1, 0), 19)"
    cur = "value * CASE WHEN step >= 480 THEN 3.0 ELSE 1.0 END"
    binned = (f"WITH {tx_cte('events')}, {silo_cte()}, L AS ({parts}), "
              f"E AS (SELECT silo_id, feature, quantile_cont(value, {probs}) AS qe FROM L WHERE step < 240 GROUP BY ALL), "
              f"B AS (SELECT L.*, CAST({bins.format(v=f'({cur})')} AS INTEGER) AS bin, CAST({bins.format(v='value')} AS INTEGER) AS rbin "
              "FROM L JOIN E AS e USING (silo_id, feature))")
    hour = "make_timestamp((1704067200 + CAST({h} AS BIGINT) * 3600) * 1000000)"
    q["drift_histogram_stream"] = (f"{binned} SELECT {hour.format(h='(step // 24) * 24')} AS start, silo_id, feature, bin, count(*) AS cnt "
                                   "FROM B GROUP BY ALL")
    q["drift_histogram_sliding"] = (f"{binned} SELECT {hour.format(h='((step // 6) * 6 - back)')} AS start, silo_id, feature, bin, count(*) AS cnt "
                                    "FROM B, (SELECT unnest([0, 6, 12, 18]) AS back) GROUP BY ALL")
    q["drift_alert_stream"] = (
        f"{binned}, rc AS (SELECT silo_id, feature, rbin AS bin, count(*) AS rc FROM B WHERE step < 240 GROUP BY ALL), "
        "g AS (SELECT DISTINCT step // 24 AS d, silo_id, feature FROM B), "
        "cc AS (SELECT step // 24 AS d, silo_id, feature, bin, count(*) AS cc FROM B GROUP BY ALL), "
        "h AS (SELECT g.*, coalesce(rc, 0) AS rc, coalesce(cc, 0) AS cc FROM g, (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) AS t "
        "LEFT JOIN rc ON rc.silo_id = g.silo_id AND rc.feature = g.feature AND rc.bin = t.bin "
        "LEFT JOIN cc ON cc.d = g.d AND cc.silo_id = g.silo_id AND cc.feature = g.feature AND cc.bin = t.bin), "
        "n AS (SELECT d, silo_id, feature, rc / sum(rc) OVER w + 1e-6 AS r, cc / sum(cc) OVER w + 1e-6 AS c FROM h "
        "WINDOW w AS (PARTITION BY d, silo_id, feature)), "
        "m AS (SELECT d, silo_id, feature, r / sum(r) OVER w AS r, c / sum(c) OVER w AS c FROM n WINDOW w AS (PARTITION BY d, silo_id, feature)), "
        "p AS (SELECT d, silo_id, feature, sum((r - c) * ln(r / c)) AS psi FROM m GROUP BY ALL) "
        f"SELECT {hour.format(h='d * 24')} AS day, silo_id, feature, {rnd('psi')} AS psi, {hour.format(h='(d + 1) * 24')} AS ts FROM p WHERE psi > 0.2")
    q["file_stream_source"] = "SELECT event_id FROM events"
    scalar = [c for c in FEATURE_COLS if not c.startswith(("velocity", "in_degree"))]
    q["stream_features"] = f"WITH {tx_cte('events')} SELECT event_id, {', '.join(f'{rnd(fx[c])} AS {c}' for c in scalar)} FROM tx"
    q["velocity_stream"] = (f"WITH {tx_cte('events')}, w AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(step - k AS BIGINT)) AS start, "
                            f"nameOrig, amount FROM tx, range(24) AS r(k)) SELECT start, nameOrig, count(*) AS velocity_count, "
                            f"{rnd('sum(amount)')} AS velocity_sum FROM w GROUP BY start, nameOrig")
    q["foreach_batch_hook"] = "SELECT count(*) AS n_rows FROM events"
    res = f"WITH {_res_ctes()}"
    q["results_sink"] = (f"{res} SELECT experiment, round, {rnd('auc_roc')} AS auc_roc, {rnd('auc_pr')} AS auc_pr, n_updates, "
                         f"{rnd('avg_loss')} AS avg_loss, agg_kind, seed, alpha FROM res")
    q["results_scan"] = f"{res} SELECT experiment, count(*) AS n FROM res GROUP BY experiment"
    q["metrics_append"] = (f"WITH {_sm_ctes()} SELECT 'run-1' AS run_id, count(*) AS n FROM sm "
                           f"UNION ALL SELECT 'run-2', count(*) FROM sm")
    q["metrics_scan"] = f"WITH {_rt_ctes()} SELECT {RT_COLS} FROM rt"
    return q


@register
def _batch8() -> dict[str, str]:
    key = "concat(CAST(event_id AS VARCHAR), ':', CAST(copy AS VARCHAR))"
    money = ", ".join(
        f"CASE WHEN copy > 0 THEN {c} * exp(0.1 * {normal01(f'amp/{c}', key)}) ELSE {c} END AS {c}" for c in MONEY)
    off = f"CAST(floor({hash01('amp/step', 'CAST(copy AS VARCHAR)')} * 99) + 1 AS INTEGER)"
    amp = (f"a0 AS (SELECT tx.*, CAST(c.copy AS INTEGER) AS copy FROM tx, unnest(range(0, 10)) c(copy)), "
           f"atx AS (SELECT event_id * 16 + copy AS event_id, CASE WHEN copy > 0 THEN step + {off} ELSE step END AS step, type, "
           f"CASE WHEN copy > 0 THEN concat(nameOrig, '_amp', CAST(copy AS VARCHAR)) ELSE nameOrig END AS nameOrig, "
           f"CASE WHEN copy > 0 THEN concat(nameDest, '_amp', CAST(copy AS VARCHAR)) ELSE nameDest END AS nameDest, "
           f"isFraud, isFlaggedFraud, {money} FROM a0)")
    sql = (f"WITH {tx_cte('events')}, {amp}, {silo_cte(src='atx')}, {feat_cte()} "
           f"SELECT silo_id, count(*) AS n, round(avg(velocity_24h_count), 4) AS avg_velocity_24h_count, "
           f"round(avg(velocity_168h_sum), 4) AS avg_velocity_168h_sum, round(sum(in_degree_24h), 4) AS sum_in_degree_24h, "
           f"round(avg(log1p_amount), 4) AS avg_log1p_amount FROM feat GROUP BY silo_id")
    return {"amplify_features_x10": sql}
