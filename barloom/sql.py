"""The bar queries in DuckDB SQL, put together from named parts; each query takes only the parts it needs."""

from __future__ import annotations

import re

A = 2.0 / 15  # smoothing of span 14
BLOCK = 256  # rows of which exponential means are summed; what lies two blocks back weighs less than 1e-15

W = "PARTITION BY symbol ORDER BY dt"


def _full(f: str, col: str, n: int, last: int = 0, part: str = W) -> str:
    """f(col) over n rows, null unless all have a value."""
    frame = f"OVER ({part} ROWS BETWEEN {n - 1 - last} PRECEDING AND {'CURRENT ROW' if last == 0 else f'{-last} PRECEDING'})"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {f}({col}) {frame} END"


def _own(col: str, lead: int) -> str:
    """The exponential mean of a column that begins at row `lead`, as if each block of rows were alone."""
    r = f"(rn - {lead})"
    return f"""power({1 - A!r}, {r} % {BLOCK}) * sum(CASE WHEN {r} = 0 THEN {col} ELSE {A!r} * {col} END * power({1 - A!r}, -({r} % {BLOCK})))
  OVER (PARTITION BY symbol, {r} // {BLOCK} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


WEEK = "PARTITION BY symbol ORDER BY week_end"



def bars_by(symbol: str, source: str = "lineitem") -> str:
    """Daily bars of the lines, with this expression as symbol."""
    return f"""SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS dt, arg_min(price, key) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, key) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM (SELECT *, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS price,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS key FROM {source}) GROUP BY 1, 2"""


PARTS = {
    "bars": bars_by("l_returnflag"),
    "weeks": """SELECT symbol, CAST(dt + CAST((5 - isodow(dt) + 7) % 7 AS INTEGER) AS DATE) AS week_end, arg_min(open, dt) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, dt) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""",
    "weekma": f"SELECT symbol, week_end, {_full('avg', 'close', 5, part=WEEK)} AS weekly_ma5, {_full('avg', 'close', 13, part=WEEK)} AS weekly_ma13 FROM weeks",
    "weekly": f"""SELECT *, weekly_ma5 / nullif(lag(weekly_ma5) OVER ({WEEK}), 0) - 1 AS weekly_ma5_slope,
  weekly_ma13 / nullif(lag(weekly_ma13) OVER ({WEEK}), 0) - 1 AS weekly_ma13_slope, CASE WHEN weekly_ma5 > weekly_ma13 THEN 1 ELSE -1 END AS weekly_trend FROM weekma""",
    "moves": f"""SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS gain,
  CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0) END AS loss FROM (SELECT *, lag(close) OVER ({W}) AS pc FROM bars)""",
    "numbered": f"SELECT *, row_number() OVER ({W}) - 1 AS rn FROM moves",
    "own": f"SELECT *, {_own('true_range', 0)} AS own_t, {_own('gain', 1)} AS own_g, {_own('loss', 1)} AS own_l FROM numbered",
    "ends": f"SELECT symbol, rn // {BLOCK} AS b, arg_max(own_t, rn) AS e FROM own GROUP BY 1, 2",
    "late_ends": f"SELECT symbol, (rn - 1) // {BLOCK} AS b, arg_max(own_g, rn) AS eg, arg_max(own_l, rn) AS el FROM own WHERE rn > 0 GROUP BY 1, 2",
    "means": f"""SELECT o.*, own_t + power({1 - A!r}, rn % {BLOCK} + 1) * coalesce(x.e, 0) AS atr14, own_g + power({1 - A!r}, (rn - 1) % {BLOCK} + 1) * coalesce(y.eg, 0) AS g,
  own_l + power({1 - A!r}, (rn - 1) % {BLOCK} + 1) * coalesce(y.el, 0) AS l FROM own o LEFT JOIN ends x ON o.symbol = x.symbol AND x.b = o.rn // {BLOCK} - 1
  LEFT JOIN late_ends y ON o.symbol = y.symbol AND y.b = (o.rn - 1) // {BLOCK} - 1""",
    "rolled": f"""SELECT *, {_full('avg', 'close', 20)} AS m20,
  {_full('stddev_samp', 'close', 20)} AS s20, {_full('avg', 'close', 25)} AS ma25, {_full('avg', 'close', 75)} AS ma75,
  close / nullif(lag(close, 5) OVER ({W}), 0) - 1 AS mom5, close / nullif(lag(close, 20) OVER ({W}), 0) - 1 AS mom20 FROM means""",
    "daily": """SELECT symbol, dt, open, high, low, close, volume, atr14, (close - (m20 - 2 * s20)) / nullif((m20 + 2 * s20) - (m20 - 2 * s20), 0) AS bb_pct_b,
  100 - 100 / (1 + g / nullif(l, 0)) AS rsi14, ma25, ma75, (close - ma25) / nullif(ma25, 0) AS dev_ma25, (close - ma75) / nullif(ma75, 0) AS dev_ma75,
  (high - low) / nullif(atr14, 0) AS range_vs_atr, mom5, mom20, mom5 - mom20 AS mom_accel,
  (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_ratio, (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_ratio,
  (high - greatest(open, close)) / nullif(greatest(open, close) - least(open, close), 0) AS upper_wick_body_ratio,
  (least(open, close) - low) / nullif(greatest(open, close) - least(open, close), 0) AS lower_wick_body_ratio,
  CASE WHEN close >= open THEN 1 ELSE -1 END AS candle_dir FROM rolled""",
    "with_weeks": """SELECT d.*, w.weekly_ma5, w.weekly_ma13, w.weekly_ma5_slope, w.weekly_ma13_slope, w.weekly_trend
  FROM daily d ASOF LEFT JOIN weekly w ON d.symbol = w.symbol AND d.dt >= w.week_end""",
    "step1": """SELECT * FROM with_weeks WHERE bb_pct_b IS NOT NULL AND rsi14 IS NOT NULL AND dev_ma25 IS NOT NULL AND dev_ma75 IS NOT NULL AND range_vs_atr IS NOT NULL
  AND mom_accel IS NOT NULL AND upper_wick_ratio IS NOT NULL AND upper_wick_body_ratio IS NOT NULL AND weekly_ma5_slope IS NOT NULL AND weekly_ma13_slope IS NOT NULL AND weekly_trend IS NOT NULL""",
    "scored": f"""SELECT *, (dev_ma25 - {_full('avg', 'dev_ma25', 60)}) / nullif({_full('stddev_samp', 'dev_ma25', 60)}, 0) AS dev_ma25_zscore,
  (dev_ma75 - {_full('avg', 'dev_ma75', 60)}) / nullif({_full('stddev_samp', 'dev_ma75', 60)}, 0) AS dev_ma75_zscore,
  CASE WHEN count(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20
  THEN min({{'price': close, 'at': dt, 'rsi': rsi14}}) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS prior, (close - ma25) / nullif(atr14, 0) AS atr_dev_ma25 FROM step1""",
    "flagged": """SELECT * EXCLUDE (prior), CAST(coalesce(dev_ma25_zscore <= -2, false) AS INTEGER) AS oversold_flag, CAST(coalesce(dev_ma25_zscore >= 2, false) AS INTEGER) AS overbought_flag,
  CAST(coalesce(close <= prior.price AND rsi14 > prior.rsi, false) AS INTEGER) AS rsi_bullish_divergence,
  CASE WHEN coalesce(close <= prior.price AND rsi14 > prior.rsi, false) THEN rsi14 - prior.rsi ELSE 0.0 END AS rsi_divergence_strength,
  CAST(coalesce(abs(atr_dev_ma25) >= 2, false) AS INTEGER) AS is_overheated, CAST(coalesce(atr_dev_ma25 >= 2, false) AS INTEGER) AS is_overbought_heat,
  CAST(coalesce(atr_dev_ma25 <= -2, false) AS INTEGER) AS is_oversold_heat, greatest(atr_dev_ma25, 0.0) * greatest(mom_accel, 0.0) AS pump_temporary_score,
  CAST(coalesce(atr_dev_ma25 >= 2 AND mom_accel > 0, false) AS INTEGER) AS is_likely_temporary_pump FROM scored""",
    "step2": "SELECT * FROM flagged WHERE dev_ma25_zscore IS NOT NULL AND dev_ma75_zscore IS NOT NULL AND atr_dev_ma25 IS NOT NULL",
}


def _labels(name: str, h: int, up: str, down: str, mode: str) -> dict[str, str]:
    """Parts that label step 2 by a self-join on row numbers."""
    return {
        f"{name}_rows": f"SELECT *, row_number() OVER ({W}) AS i, {up} AS up, {down} AS down FROM step2",
        f"{name}_touch": f"""SELECT a.symbol, a.i, count(*) AS ahead, min(CASE WHEN b.high >= a.up THEN b.i - a.i END) AS tp, min(CASE WHEN b.low <= a.down THEN b.i - a.i END) AS sl,
  arg_max(b.close, b.i) AS last, min(b.low) AS low FROM {name}_rows a JOIN {name}_rows b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + {h} GROUP BY 1, 2""",
        f"{name}_all": f"""SELECT r.* EXCLUDE (i, up, down), CASE WHEN ahead = {h} THEN CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 0 WHEN tp IS NOT NULL THEN 1 ELSE CAST(last > close AS INTEGER) END END AS tb_label,
  CASE WHEN ahead = {h} THEN CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN 'stop_loss' WHEN tp IS NOT NULL THEN 'take_profit' ELSE 'time_out' END END AS tb_barrier,
  CAST(CASE WHEN ahead = {h} THEN CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN sl WHEN tp IS NOT NULL THEN tp ELSE {h} END END AS INTEGER) AS tb_days_to_touch,
  (CASE WHEN ahead = {h} THEN CASE WHEN sl IS NOT NULL AND (tp IS NULL OR sl <= tp) THEN down WHEN tp IS NOT NULL THEN up ELSE last END END - close) / nullif(close, 0) AS tb_return,
  '{mode}' AS tb_barrier_mode, (t.low - close) / nullif(close, 0) AS forward_max_drawdown,
  CASE WHEN t.low IS NOT NULL THEN CAST((t.low - close) / nullif(close, 0) <= -0.03 AS INTEGER) END AS avoid_entry_flag
  FROM {name}_rows r LEFT JOIN {name}_touch t ON r.symbol = t.symbol AND r.i = t.i""",
        f"{name}_step3": f"SELECT * FROM {name}_all WHERE tb_label IS NOT NULL AND avoid_entry_flag IS NOT NULL",
    }


PARTS |= _labels("atr", 10, "close + 2.0 * atr14", "close - 1.5 * atr14", "atr")
PARTS |= _labels("pct", 45, "close * (1 + 0.1)", "close * (1 - 0.05)", "fixed_pct")
PARTS |= _labels("long", 500, "close + 6.0 * atr14", "close - 5.0 * atr14", "atr")
PARTS |= {
    "turns": f"""SELECT *, CAST(coalesce({_full('min', 'rsi14', 5, -1)} <= 35 AND rsi14 > lag(rsi14) OVER ({W}), false) OR rsi_bullish_divergence = 1 AS INTEGER) AS rsi_reversal_flag,
  CAST(coalesce(dev_ma25_zscore < 0 AND dev_ma25_zscore > lag(dev_ma25_zscore, 5) OVER ({W}), false) AS INTEGER) AS deviation_shrink_flag, is_overbought_heat AS overheat_warning_flag FROM atr_step3""",
    "step5": "SELECT *, CASE WHEN overheat_warning_flag = 1 THEN '警戒' WHEN rsi_reversal_flag = 1 AND deviation_shrink_flag = 1 THEN '強気' ELSE '中立' END AS assist_signal FROM turns",
    "dates": """SELECT dt, n, i, total, k AS fold, total - (6 - k) * (total // 6) AS start, total // 6 AS ts FROM (SELECT dt, count(*) AS n, row_number() OVER (ORDER BY dt) - 1 AS i,
  count(*) OVER () AS total FROM atr_step3 GROUP BY dt), (SELECT unnest([1, 2, 3, 4, 5]) AS k)""",
    "folds": "SELECT dt, n, fold, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role FROM dates WHERE i < start + ts",
    "fold_rows": """SELECT fold, min(dt) FILTER (WHERE role = 'train') AS train_start, max(dt) FILTER (WHERE role = 'train') AS train_end, min(dt) FILTER (WHERE role = 'test') AS test_start,
  max(dt) FILTER (WHERE role = 'test') AS test_end, CAST(coalesce(sum(n) FILTER (WHERE role = 'train'), 0) AS BIGINT) AS n_train, CAST(coalesce(sum(n) FILTER (WHERE role = 'test'), 0) AS BIGINT) AS n_test FROM folds GROUP BY fold""",
    "fold_table": "SELECT * FROM fold_rows WHERE n_train >= 100 AND n_test > 0",
    "standin": """SELECT s.symbol, s.dt, f.fold, s.tb_label AS y_true, CAST(s.mom5 > 0 AS INTEGER) AS y_pred, least(1.0, greatest(0.0, 0.5 + round(s.mom5, 3))) AS y_proba
  FROM atr_step3 s JOIN folds f ON s.dt = f.dt AND f.role = 'test' JOIN fold_table USING (fold)""",
    "metrics": """SELECT fold, n AS n_test, ok / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (ranks - p * (p + 1) / 2) / nullif(p * (n - p), 0) AS roc_auc FROM (SELECT fold, count(*) AS n,
  CAST(count(*) FILTER (WHERE y_true = y_pred) AS DOUBLE) AS ok, CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y_true = 1) AS DOUBLE) AS p, sum(r) FILTER (WHERE y_true = 1) AS ranks
  FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY y_proba) + (count(*) OVER (PARTITION BY fold, y_proba) - 1) / 2.0 AS r FROM standin) GROUP BY fold)""",
}

PRIME = (1 << 31) - 1


def _push(half: str, step: int) -> str:
    return f"((({half}) % {PRIME} + key + {step * 1_000_003}) % {PRIME}) * ((({half}) % {PRIME} + key + {step * 1_000_003}) % {PRIME}) % {PRIME}"


def _network(rounds: int = 5) -> str:
    """(fold, turn, x, y): where a Feistel network over pairs sends each number below a * b."""
    sql = "SELECT fold, turn, key, a, b, x, x // b AS l, x % b AS r FROM (SELECT *, unnest(range(a * b)) AS x FROM permutation_keys)"
    for k in range(1, rounds + 1):
        sql = f"SELECT * REPLACE ((l + {_push('r', 2 * k)}) % a AS l) FROM ({sql})"
        sql = f"SELECT * REPLACE ((r + {_push('l', 2 * k + 1)}) % b AS r) FROM ({sql})"
    return f"SELECT fold, turn, x, l * b + r AS y FROM ({sql})"


def _key(*parts: str) -> str:
    key = "CAST(0 AS BIGINT)"
    for x in parts:
        key = f"(({key}) * 8191 + ({x}) % {PRIME} + 12345) % {PRIME}"
    return key


PARTS |= {
    "tested": """SELECT f.fold, s.mom5, s.mom20, s.tb_label, row_number() OVER (PARTITION BY f.fold ORDER BY s.dt, s.symbol) - 1 AS i, count(*) OVER (PARTITION BY f.fold) AS n
  FROM atr_step3 s JOIN folds f ON s.dt = f.dt AND f.role = 'test' JOIN fold_table USING (fold)""",
    "permutation_keys": f"""SELECT fold, turn, n, a, CAST(ceil(n / a) AS BIGINT) AS b, {_key("42", "fold", "turn")} AS key
  FROM (SELECT fold, max(n) AS n, CAST(ceil(sqrt(max(n))) AS BIGINT) AS a, unnest([1, 2, 3, 4, 5]) AS turn FROM tested GROUP BY fold)""",
    "network": _network(),
    "walk": """SELECT k.fold, k.turn, k.n, m.x AS i, m.y AS place FROM permutation_keys k JOIN network m USING (fold, turn) WHERE m.x < k.n
  UNION ALL SELECT w.fold, w.turn, w.n, w.i, m.y FROM walk w JOIN network m ON w.fold = m.fold AND w.turn = m.turn AND w.place = m.x WHERE w.place >= w.n""",
    "ends_of_labels": """SELECT a.*, b.dt AS label_end FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM atr_all) a
  LEFT JOIN (SELECT symbol AS s2, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS j FROM atr_all) b ON a.symbol = b.s2 AND b.j = a.i + a.tb_days_to_touch WHERE tb_label IS NOT NULL AND avoid_entry_flag IS NOT NULL""",
    "spans": "SELECT f.fold, s.symbol, min(s.dt) AS first, max(s.dt) AS last FROM atr_step3 s JOIN folds f ON s.dt = f.dt AND f.role = 'test' JOIN fold_table USING (fold) GROUP BY 1, 2",
}


def query(select: str, **changed: str) -> str:
    """The select with the parts that it names, and those that these name, in their order; `changed` parts replace others."""
    parts_of = PARTS | changed
    need, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in parts_of:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(parts_of[name])
    parts = ",\n".join(f"{n} AS ({t})" for n, t in parts_of.items() if n in need)
    return f"WITH {'RECURSIVE ' if 'walk' in need else ''}{parts}\n{select}" if parts else select


# Prices and sums of whole numbers, and their plain differences, are the same in any engine; they are compared unrounded,
# as many lie half-way between two roundings.
EXACT = {"open", "high", "low", "close", "volume", "true_range", "gain", "loss"}


def rounded(keys: str, ints: str = "", floats: str = "", source: str = "", **changed: str) -> str:
    """keys and ints as they are, floats rounded to six places unless they are exact."""
    columns = [c for c in f"{keys} {ints}".split()] + [c if c in EXACT else f"round({c}, 6) AS {c}" for c in floats.split()]
    return query(f"SELECT {', '.join(columns)} FROM {source}", **changed)
