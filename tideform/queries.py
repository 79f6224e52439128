"""Registry of the engine's queries: name to function of (spark, folder), and name to the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideform.functions import clusters, folds, machines as sessions, portfolios, ranks, retellings, scalars, scans
from tideform.operators import audit, bars, brackets, candidates, catalogue, contexts, crossings, execution, families, features, indicators, matching, metrics, retests, signals, structure, universe
from tideform.plans import features as language
from tideform.plans.sql import Plan, dialect
from tideform.sources import masks, tape
from tideform.sources.written import written
from tideform.streaming import impulses as machines

TAPE = tape.TAPE
MINUTES = (*TAPE, bars.bars(60_000, "m1"))
QUOTES = tape.carried("quotes", "ticks", {"bid": "bid_u"}, "ask_u > bid_u")
RAW = (*TAPE, tape.RAW)
SESSIONS = (*TAPE, tape.SESSIONS)
BARS = (*TAPE, bars.bars())
NUMBERED = (*BARS, bars.NUMBERED)
RANGE = (*NUMBERED, indicators.TRUE_RANGE)
LEVELS = (*NUMBERED, structure.FRACTALS, structure.LEVELS)
BREAKS = (*LEVELS, structure.BREAKS)
LEDGER = (*SESSIONS, tape.INTENTS, *execution.STEPS)
EQUITY = (*LEDGER, *metrics.EQUITY)
DAILY = (*LEDGER, metrics.DAILY)
FOLDS = (*DAILY, metrics.FOLDS)
SHOCKS = (*RANGE, signals.SHOCKS)
ATRS = (*RANGE, brackets.ATRS)
HELD = (*SHOCKS, execution.NEXT, *brackets.STEPS)
PATHS = (*HELD, brackets.PATHS, brackets.managed())
BROKEN = (*BREAKS, retests.BROKEN)
RETURNING = (*BROKEN, retests.INFORCE, retests.INSIDE, retests.OPPOSED, retests.AFTERWARDS)
CROSSED = (*LEVELS, retests.INFORCE, retests.INSIDE, retests.CROSSED, retests.CROSS_OPPOSED, retests.LATER, retests.SOON, retests.FINALS, retests.SETTLED)
PERIODS = (*LEDGER, metrics.PERIODS)
BOXED = (*LEVELS, retests.BOX_MARKS, retests.BOX_STATE)
PAIRED = (*SHOCKS, brackets.ATRS, contexts.CONDITIONS)
STATUS = (*universe.UNIVERSE, universe.STATUS)
TOKENS = (universe.TOKENS, universe.PRIORS, universe.IDF)

PLANS: dict[str, Plan] = {
    name: Plan(*steps, select=select)
    for name, steps, select in (
        ("tick_view", TAPE, "SELECT symbol, seq, ts_ns, session_day, bid_u, ask_u FROM ticks"),
        ("tick_audit", (*RAW, *tape.carried("followed", "raw", audit.FOLLOWED)), audit.TAPE),
        ("spread_percentiles", RAW, audit.SPREADS),
        ("session_map", SESSIONS, audit.SESSION_MAP),
        ("session_membership", SESSIONS, audit.MEMBERS),
        ("session_audit", SESSIONS, audit.SESSIONS),
        ("shard_chain", TAPE, audit.SHARD_CHAIN),
        ("time_segments", (*TAPE, audit.SEGMENTS, audit.ANCHORS), audit.TIME_AUTHORITY),
        ("bars_hour", BARS, "SELECT symbol, session_day, bucket, open_u, high_u, low_u, close_u, first_seq, last_seq, n_ticks FROM bars"),
        ("bars_minute", MINUTES, "SELECT symbol, session_day, bucket, open_u, high_u, low_u, close_u, first_seq, last_seq FROM m1"),
        ("bars_multi", MINUTES, bars.MULTI),
        ("bars_mid", TAPE, bars.MID),
        ("bars_coarser", (*BARS, bars.coarser(4, "b4")), "SELECT symbol, bucket, open_u, high_u, low_u, close_u, first_seq, last_seq FROM b4"),
        ("bars_weekly", TAPE, bars.WEEKLY),
        ("bars_executable", (*TAPE, bars.bars(name="xb", where="ask_u > bid_u")), "SELECT symbol, session_day, bucket, open_u, high_u, low_u, close_u FROM xb"),
        ("exec_quote_cache", RAW, bars.EXEC_CACHE),
        ("tick_counts", BARS, bars.COUNTS),
        ("quote_coverage", RAW, bars.COVERAGE),
        ("gap_runs", NUMBERED, bars.GAPS),
        ("bars_valid", NUMBERED, bars.VALID),
        ("zone_map", TAPE, bars.ZONES),
        ("feat_prev_bar", NUMBERED, features.PREVIOUS),
        ("feat_scalar", NUMBERED, features.SCALAR),
        ("feat_lag_cross", NUMBERED, features.CROSSES),
        ("feat_highest_lowest", NUMBERED, features.EXTREMES),
        ("ind_atr_sma", RANGE, indicators.ATR),
        ("ind_roc", NUMBERED, indicators.ROC),
        ("ind_cci", NUMBERED, indicators.CCI),
        ("ind_stoch", NUMBERED, indicators.STOCHASTIC),
        ("ctx_rolling_quantile", RANGE, indicators.CONTEXT),
        ("ind_imbalance", (*TAPE, *tape.carried("mids", "ticks", {"mid": "bid_u + ask_u"}), indicators.MOVES, indicators.MOVE_DAYS, indicators.SUMMED), indicators.IMBALANCE),
        ("auction_score", (*RETURNING, retests.RECLAIMED, *ATRS[len(NUMBERED) :], indicators.MICRO, indicators.SPREAD_P50, indicators.AUCTIONS, indicators.AUCTION_PARTS), indicators.FAES),
        ("fractals", LEVELS[:-1], structure.PIVOTS),
        ("levels", LEVELS, "SELECT symbol, bar, high_level, high_id, low_level, low_id FROM levels"),
        ("level_breaks", BREAKS, "SELECT symbol, bar, level_id, side FROM breaks"),
        ("box_history", LEVELS, structure.BOXES),
        ("touch_reclaim", (*RETURNING, retests.TOUCHED), retests.TOUCH_RECLAIM),
        ("tick_crosses", (*NUMBERED, *QUOTES), structure.TICK_CROSSES),
        ("replay_intents", LEDGER, execution.REPLAY),
        ("target_before_stop", LEDGER, execution.LABELS),
        ("cost_scenarios", LEDGER, execution.COSTS),
        ("ledger_validate", (*LEDGER, execution.TRADE_DAYS, execution.FOLLOWING), execution.VALIDATE),
        ("ledger_parity", (*LEDGER, *execution.POSITIONS, *execution.RETOLD), execution.PARITY),
        ("ledger_metrics", LEDGER, metrics.METRICS),
        ("drawdown", EQUITY, metrics.DRAWDOWN),
        ("underwater", (*EQUITY, *metrics.WATER), metrics.UNDERWATER),
        ("streaks", (*EQUITY, *metrics.LOST, *metrics.WON), metrics.STREAKS),
        ("daily_sharpe", DAILY, metrics.SHARPE),
        ("period_concentration", PERIODS, metrics.CONCENTRATION),
        ("year_results", PERIODS, metrics.YEARS),
        ("var_cvar", DAILY, metrics.TAIL),
        ("walk_forward", FOLDS, metrics.WALK),
        ("cpcv_pairs", FOLDS, metrics.CPCV),
        ("leave_fold_out", FOLDS, metrics.LEAVE_OUT),
        ("top_removed", LEDGER, metrics.TOP_REMOVED),
        ("missed_trades", LEDGER, families.MISSED),
        ("persistence_families", (*NUMBERED, families.BASES), families.PERSISTENCE),
        ("shock_families", (*ATRS, families.BASES, families.SHOCKED), families.SHOCK_FAMILIES),
        ("shape_thresholds", NUMBERED, families.SHAPES),
        ("confirmation_kinds", SHOCKS, families.CONFIRMED),
        ("cost_spreads", (*LEDGER, families.COSTED), families.COST_SPREADS),
        ("walk_forward_verdict", (*LEDGER, families.COSTED, families.FOLD_OF, families.FOLDED), families.WALK_VERDICT),
        ("gate_screens", (*LEDGER, families.COSTED, families.FOLD_OF), families.SCREENS),
        ("parity_classes", (*LEDGER, *execution.POSITIONS, families.TOLD, families.TOLD_AGAIN), families.PARITY_CLASSES),
        ("result_integrity", (*PERIODS, families.COSTED), families.INTEGRITY),
        ("raw_brackets", HELD, families.RAW_BRACKETS),
        ("signals_merged", SHOCKS, families.MERGED_SIGNALS),
        ("gate_screen", (*LEDGER, ("metrics", metrics.METRICS)), metrics.SCREEN),
        ("hac_test", (*DAILY, metrics.HAC), metrics.HAC_T),
        ("hac_p", (*DAILY, metrics.HAC), metrics.HAC_P),
        ("bh_by_adjust", (*DAILY, metrics.TESTS), metrics.ADJUSTED),
        ("by_reject", (*DAILY, metrics.TESTS), metrics.REJECTED),
        ("corr_daily", (*DAILY, metrics.SUMS), metrics.CORRELATION),
        ("shock_signals", SHOCKS, signals.SHOCK_COUNTS),
        ("confirmations", SHOCKS, signals.CONFIRMED),
        ("bar_shape_filters", NUMBERED, signals.WICKS),
        ("persistence", NUMBERED, signals.PERSISTENCE),
        ("gate_session", (*TAPE, bars.bars(900_000, "m15"), signals.QUARTERS), signals.SESSION_GATE),
        ("mtf_asof", (*NUMBERED, bars.coarser(4, "b4")), signals.MTF),
        ("jaccard_pairs", SHOCKS, signals.JACCARD),
        ("set_algebra", SHOCKS, signals.SETS),
        ("gate_zones", NUMBERED, catalogue.ZONES),
        ("offset_brackets", (*TAPE, audit.SEGMENTS, audit.ANCHORS), catalogue.BRACKETED),
        ("family_combinations", (catalogue.SETTINGS, catalogue.COMBINED), catalogue.COMBINATIONS),
        ("signature_partitions", (catalogue.SETTINGS, catalogue.COMBINED), catalogue.PARTITIONS),
        ("config_ids", universe.UNIVERSE, catalogue.IDENTITIES),
        ("universe_parity", universe.UNIVERSE, catalogue.PARITY),
        ("page_sections", (), catalogue.SECTIONS),
        ("text_normalised", (catalogue.NORMALISED,), catalogue.NORMAL_STATS),
        ("gate_report", (*EQUITY, *DAILY[len(LEDGER) :], ("metrics", metrics.METRICS), metrics.TESTS, ("adjusted", metrics.ADJUSTED)), catalogue.REPORT),
        ("median_spread", RAW, catalogue.MEDIAN_SPREAD),
        ("tolerant_parity", ATRS, catalogue.TOLERANT),
        ("pivot_windows", NUMBERED, catalogue.PIVOT_WINDOWS),
        ("level_crosses", (*LEVELS, *QUOTES, indicators.TRUE_RANGE, brackets.ATRS), catalogue.LEVEL_CROSSES),
        ("atr_brackets", (*HELD, execution.XBARS, brackets.REACHED, brackets.STRUCK), brackets.BRACKETS),
        ("managed_exits", PATHS, brackets.MANAGED),
        ("exact_decimal_r", HELD, brackets.EXACT_R),
        ("candidate_outcomes", (*NUMBERED, *candidates.STEPS), (candidates.OUTCOMES, candidates.CHECK)),
        ("level_replacement", (*LEVELS, retests.REPLACED), retests.REPLACEMENT),
        ("first_return", (*RETURNING, retests.RETURNED), retests.FIRST_RETURN),
        ("close_reclaim", (*RETURNING, retests.RECLAIMED), retests.CLOSE_RECLAIM),
        ("event_ids", BREAKS, retests.EVENT_IDS),
        ("gate_volatility", ATRS, contexts.VOLATILITY),
        ("atr_periods", RANGE, contexts.SMOOTHING),
        ("shock_numerators", ATRS, contexts.NUMERATORS),
        ("ctx_spread", NUMBERED, contexts.SPREAD),
        ("ctx_intensity", NUMBERED, contexts.INTENSITY),
        ("gap_conditioned", SHOCKS, contexts.GAP_KINDS),
        ("interactions", PAIRED, contexts.INTERACTIONS),
        ("universe_decode", universe.UNIVERSE, "SELECT birth, expiry, fast, slow, stop FROM decoded"),
        ("universe_aliases", STATUS, universe.ALIASES),
        ("universe_account", STATUS, universe.ACCOUNT),
        ("universe_pairs", STATUS, universe.PAIRS),
        ("universe_slice", universe.UNIVERSE, universe.SLICE),
        ("text_tokens", TOKENS[:1], universe.TOKEN_STATS),
        ("tfidf_nearest", TOKENS, universe.NEAREST),
        ("text_tags", (), universe.TAGS),
        ("url_hosts", (), universe.URLS),
    )
}

BARS_TR = Plan(*RANGE, select="SELECT symbol, bar, high_u, low_u, close_u, tr FROM tr")
TRADES = Plan(*LEDGER, select="SELECT symbol, session_day, intent_id, entry_seq, exit_seq, entry_ts_ns, exit_ts_ns FROM ledger")
DAYS = Plan(*DAILY, select="SELECT symbol, d, r FROM daily")
BAR_ATR = Plan(*ATRS, select="SELECT b.symbol, b.bar, b.session_day, b.open_u, b.high_u, b.low_u, b.close_u, b.prev_close, a.tr, a.atr14 FROM nb b JOIN atrs a ON a.symbol = b.symbol AND a.bar = b.bar")
BOXES = Plan(*BOXED, indicators.TRUE_RANGE, brackets.ATRS, select="SELECT x.symbol, x.bar, x.middle, x.width, x.width1, x.width2, a.atr14 FROM box_state x JOIN atrs a ON a.symbol = x.symbol AND a.bar = x.bar")
BOX_WIDTHS = Plan(*BOXED, indicators.TRUE_RANGE, brackets.ATRS, select="SELECT x.symbol, x.bar, x.middle, x.width, x.width1, x.width2, x.width3, a.atr14 FROM box_state x JOIN atrs a ON a.symbol = x.symbol AND a.bar = x.bar")
CARRIER = Plan(*CROSSED, select=retests.CARRIER)
IMPULSE_BARS = Plan(*ATRS, indicators.MICRO, indicators.SPREAD_P50, select="SELECT b.symbol, b.bar, b.bucket, b.open_u, b.high_u, b.low_u, b.close_u, a.atr14, m.up_share, b.spread_sum * 1.0 / b.n_ticks AS spread, p.p50 AS spread_p50 FROM nb b JOIN atrs a ON a.symbol = b.symbol AND a.bar = b.bar JOIN micro m ON m.symbol = b.symbol AND m.bar = b.bar JOIN spread_p50 p ON p.symbol = b.symbol AND p.bar = b.bar")
OUTCOMES = Plan(*PATHS, select=brackets.MANAGED)
#: Yearly totals in billionths, so that their sums are exact.
BLOCKS = Plan(*DAILY, select="SELECT symbol, session_day ~div~ 10000 AS fold, CAST(round(sum(r) * 1000000000) AS BIGINT) AS r FROM daily GROUP BY symbol, session_day ~div~ 10000")
EDGES = Plan(*SHOCKS, select=f"SELECT symbol || ':' || CAST(side AS VARCHAR(9)) || ':' || CAST(threshold_a AS VARCHAR(9)) AS a, symbol || ':' || CAST(side AS VARCHAR(9)) || ':' || CAST(threshold_b AS VARCHAR(9)) AS b, jaccard AS weight FROM ({signals.JACCARD}) WHERE jaccard >= 0.5")
EVENTS = Plan(*SHOCKS, select="SELECT symbol, threshold, side, bar FROM shocks")


def _recursive(plan: Plan, name: str, steps: str, select: str) -> str:
    """The checking SQL of a fold: a recursion over the same rows."""
    inner = plan.text(False)
    return f"WITH RECURSIVE {name} AS ({inner}),\n{steps}\n{select}"


#: Trades that a greedy pass in entry order accepts: from each accepted one to the first that enters after its exit.
_ADMITTED = """o AS (SELECT symbol, intent_id, entry_seq, exit_seq, row_number() OVER (PARTITION BY symbol ORDER BY entry_seq, intent_id) AS n FROM l),
nx AS (SELECT o.n, o.symbol, o.intent_id, o.exit_seq, (SELECT min(x.n) FROM o x WHERE x.symbol = o.symbol AND x.entry_seq > o.exit_seq) AS next_n FROM o),
a AS (SELECT symbol, intent_id, next_n FROM nx WHERE n = 1 UNION ALL SELECT nx.symbol, nx.intent_id, nx.next_n FROM a JOIN nx ON nx.symbol = a.symbol AND nx.n = a.next_n)"""

_EMA8 = '''e AS (SELECT symbol, CAST(8 AS BIGINT) AS bar, avg(close_u) AS ema8 FROM b WHERE bar <= 8 GROUP BY symbol HAVING count(*) = 8
 UNION ALL SELECT b.symbol, b.bar, e.ema8 + (b.close_u - e.ema8) * 2 / 9.0 FROM e JOIN b ON b.symbol = e.symbol AND b.bar = e.bar + 1)'''


def _fold_sql() -> str:
    """Every recurrence of folds.indicator_folds as one recursion over bars, seeds from running sums."""
    ema = ", ".join(f"CASE WHEN b.bar = {n} THEN CAST(b.cs AS DOUBLE) / {n} WHEN b.bar > {n} THEN e.e{n} + (2e0 / {n + 1}) * (b.close_u - e.e{n}) END AS e{n}" for n in folds.EMAS)
    means = (("atr", "tr", "ts", 14), ("up", "up", "us", 15), ("dn", "dn", "ds", 15), ("pm", "pdm", "ps", 14), ("mm", "mdm", "ms", 14))
    wilder = ", ".join(f"CASE WHEN b.bar = {at} THEN CAST(b.{total} AS DOUBLE) / 14 WHEN b.bar > {at} THEN e.{name} + (1e0 / 14) * (b.{x} - e.{name}) END AS {name}" for name, x, total, at in means)
    names = ", ".join([*(f"e{n}" for n in folds.EMAS), *(m[0] for m in means)])
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in [*names.split(", "), "sdx", "adx"])
    return f'''WITH RECURSIVE b0 AS ({BARS_TR.text(False)}),
d AS (SELECT symbol, bar, close_u, tr, greatest(close_u - pc, 0) AS up, greatest(pc - close_u, 0) AS dn,
  CASE WHEN high_u - ph > pl - low_u AND high_u > ph THEN high_u - ph ELSE 0 END AS pdm, CASE WHEN pl - low_u > high_u - ph AND pl > low_u THEN pl - low_u ELSE 0 END AS mdm
  FROM (SELECT symbol, bar, high_u, low_u, close_u, tr, lag(close_u) OVER w AS pc, lag(high_u) OVER w AS ph, lag(low_u) OVER w AS pl FROM b0 WINDOW w AS (PARTITION BY symbol ORDER BY bar))),
b AS (SELECT symbol, bar, close_u, tr, up, dn, pdm, mdm, sum(close_u) OVER w AS cs, sum(tr) OVER w AS ts, sum(up) OVER w AS us, sum(dn) OVER w AS ds, sum(pdm) OVER w AS ps, sum(mdm) OVER w AS ms
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT symbol, bar, close_u, close_u AS ei, {nulls} FROM b WHERE bar = 1
 UNION ALL SELECT symbol, bar, close_u, ei, {names}, CASE WHEN bar >= 14 THEN coalesce(sdx, 0) + dx END, CASE WHEN bar = 27 THEN (sdx + dx) / 14 WHEN bar > 27 THEN adx + (1e0 / 14) * (dx - adx) END FROM (
  SELECT *, CASE WHEN pi + mi > 0 THEN 100 * abs(pi - mi) / (pi + mi) ELSE 0e0 END AS dx FROM (
   SELECT *, CASE WHEN atr > 0 THEN 100 * pm / atr ELSE 0e0 END AS pi, CASE WHEN atr > 0 THEN 100 * mm / atr ELSE 0e0 END AS mi FROM (
    SELECT b.symbol, b.bar, b.close_u, e.ei + CAST(2 * (b.close_u - e.ei) // 6 AS BIGINT) AS ei, {ema}, {wilder}, e.sdx, e.adx FROM e JOIN b ON b.symbol = e.symbol AND b.bar = e.bar + 1)))),
g AS (SELECT *, lag(e8) OVER w AS b8, lag(e20) OVER w AS b20, lag(e35) OVER w AS b35, CASE WHEN bar >= 15 THEN CASE WHEN up + dn > 0 THEN 100 * up / (up + dn) ELSE 50e0 END END AS rsi FROM e WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
x AS (SELECT symbol, bar, e8 > e20 AND b8 <= b20 AS crossed_up, e8 < e20 AND b8 >= b20 AS crossed_down FROM g)
'''


def _shut(**gates: str) -> str:
    return ", ".join(f"coalesce({e}, FALSE) AS {n}" for n, e in gates.items())


_TREND = {
    "up": "e8 > e20 AND e20 > e35", "down": "e8 < e20 AND e20 < e35", "price_up": "close_u > e8 AND e8 > e20 AND e20 > e35", "price_down": "close_u < e8 AND e8 < e20 AND e20 < e35",
    "slope_up": "e8 > e20 AND e20 > e35 AND e8 > b8 AND e20 > b20 AND e35 > b35", "slope_down": "e8 < e20 AND e20 < e35 AND e8 < b8 AND e20 < b20 AND e35 < b35",
}
_STRENGTH = {"strong": "adx >= 25", "rising": "CASE WHEN atr > 0 THEN (e20 - b20) / atr END >= 0.1e0", "falling": "CASE WHEN atr > 0 THEN (e20 - b20) / atr END <= -0.1e0"}
_RECENT = {s: f"EXISTS (SELECT 1 FROM x WHERE x.symbol = g.symbol AND x.bar BETWEEN g.bar - 4 AND g.bar AND x.crossed_{s})" for s in ("up", "down")}
EVENTS_10 = Plan(*SHOCKS, select="SELECT symbol, side, bar FROM shocks WHERE threshold = 10")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.indicator_folds(BARS_TR.run(spark, sf_dir))


def _gated(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return folds.gates(_folded(spark, sf_dir)).select("symbol", "bar", *names)


def _conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a bar under the gates of the bar before, each family by the signal's side, and all of them."""
    gates = folds.gates(_folded(spark, sf_dir)).withColumn("bar", F.col("bar") + 1)
    f = EVENTS_10.run(spark, sf_dir).join(gates, ["symbol", "bar"])
    by = lambda up, down, name: F.when(F.col("side") == 1, F.col(up)).otherwise(F.col(down)).alias(name)
    f = f.select("symbol", "bar", "side", by("up", "down", "trend"), "strong", by("momentum_up", "momentum_down", "momentum"), by("recent_up", "recent_down", "recent"))
    return f.withColumn("all_open", F.col("trend") & F.col("strong") & F.col("momentum") & F.col("recent"))


#: The tape has a tick every few hours: its bars, and what follows from them, are as much longer.
SLOW_TAPE = machines.Clock(fast=4 * bars.HOUR_MS, slow=12 * bars.HOUR_MS, expire=16 * bars.HOUR_MS, confirm=60_000)


def _impulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.impulses(IMPULSE_BARS.run(spark, sf_dir))


_SIGNS = f'''WITH RECURSIVE g AS ({BLOCKS.text(False)}),
n AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY fold) AS b, count(*) OVER (PARTITION BY symbol) AS blocks FROM g),
x AS (SELECT 0 AS i, CAST(76 AS UBIGINT) AS s
 UNION ALL SELECT i + 1, xor(s, s >> 27) FROM (SELECT i, xor(s, (s & 549755813887) << 25) AS s FROM (SELECT i, xor(s, s >> 12) AS s FROM x WHERE i < 999 * (SELECT max(blocks) FROM n)))),
t AS (SELECT n.symbol, k.rep, sum(CASE WHEN x.s & 1 = 1 THEN n.r ELSE -n.r END) AS sample FROM n CROSS JOIN (SELECT unnest(generate_series(0, 998)) AS rep) k JOIN x ON x.i = k.rep * n.blocks + n.b GROUP BY n.symbol, k.rep)
SELECT o.symbol, o.blocks, CASE WHEN o.total > 0 THEN (1 + count(*) FILTER (WHERE t.sample >= o.total)) / 1000e0 ELSE 1e0 END AS p
FROM t JOIN (SELECT symbol, count(*) AS blocks, sum(r) AS total FROM n GROUP BY symbol) o ON o.symbol = t.symbol GROUP BY o.symbol, o.blocks, o.total'''


HOUR, FOUR_HOURS = bars.HOUR_MS, 4 * bars.HOUR_MS
# One definition for each operator over bars of two lengths; one program with parameters; and operators over quotes.
EVERY_OPERATOR = {
    "o1": f"OPEN:{HOUR}", "c1": f"CLOSE:{HOUR}", "h4": f"HIGH:{FOUR_HOURS}", "l4": f"LOW:{FOUR_HOURS}", "two": "CONST:2", "total": "ADD:c1:o1", "step": "SUB:c1:o1", "least_of": "MIN:c1:l4", "most_of": "MAX:c1:h4",
    "gt": "GT:c1:o1", "ge": "GE:c1:o1", "lt": "LT:step:two", "le": "LE:c1:h4", "eq": "EQ:c1:o1", "lag3": "LAG:c1:3", "lag_gt": "LAG:gt:2", "high5": "HIGHEST:c1:5", "low4": "LOWEST:o1:4", "ema3": "EMA:c1:3",
    "up": "CROSS_UP:c1:o1", "down": "CROSS_DOWN:c1:h4", "both_true": "AND:gt:ge", "either": "OR:lt:up", "negated": "NOT:le", "range4": "SUB:h4:l4",
}
OPERATOR_OUTPUTS = [n for n in EVERY_OPERATOR if n != "two"]
CROSSING = {"close": f"CLOSE:{HOUR}", "fast": "EMA:close:$fast", "slow": "EMA:close:$slow", "up": "CROSS_UP:fast:slow", "down": "CROSS_DOWN:fast:slow", "sig": "OR:up:down"}
OVER_QUOTES = {"bid": "BID", "ask": "ASK", "spread": "SPREAD", "close": f"CLOSE:{HOUR}", "away": "SUB:bid:close", "lag2": "LAG:away:2", "high16": "HIGHEST:ask:16", "over": "CROSS_UP:bid:close", "wide": "GT:spread:one", "one": "CONST:1", "sig": "AND:over:wide"}


def _graph(spark: SparkSession, sf_dir: str, definitions: dict[str, str], outputs: list[str], **parameters: int) -> language.Graph:
    return language.Graph(written(PLANS["tick_view"].run(spark, sf_dir), "ticks"), language.compile_graph(definitions, outputs, parameters))


def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the crossing program at each choice of its parameters that its constraint allows."""
    ticks = written(PLANS["tick_view"].run(spark, sf_dir), "ticks")
    out = None
    for fast, slow in ((f, s) for f in (2, 4) for s in (3, 5) if f < s):
        graph = language.Graph(ticks, language.compile_graph(CROSSING, ["sig", "up"], {"fast": fast, "slow": slow}))
        values = graph.values("sig", "up")
        found = language.signals(values, "sig").join(values.select("symbol", "seen", "up"), ["symbol", "seen"]).select("symbol", F.lit(fast).alias("fast"), F.lit(slow).alias("slow"), "seen", "version", "up")
        out = found if out is None else out.unionByName(found)
    return out


_CLOSED = """SELECT symbol, lead(first_seq) OVER (PARTITION BY symbol ORDER BY first_seq) AS seen, o, h, l, c FROM (
  SELECT symbol, min(seq) AS first_seq, arg_min(bid_u, seq) AS o, max(bid_u) AS h, min(bid_u) AS l, arg_max(bid_u, seq) AS c FROM ticks GROUP BY symbol, session_day, ts_ns // ({0} * CAST(1000000 AS BIGINT))) QUALIFY seen IS NOT NULL"""
_TICK_VIEW = PLANS["tick_view"].text(False)
_CUT = "CAST(2 * (b.c - e.{0}) // {1} AS BIGINT)"
_OPERATORS_SQL = f"""WITH RECURSIVE ticks AS ({_TICK_VIEW}), c1 AS ({_CLOSED.format(HOUR)}), c4 AS ({_CLOSED.format(FOUR_HOURS)}),
k1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seen) AS n FROM c1),
e AS (SELECT symbol, n, c AS e3 FROM k1 WHERE n = 1 UNION ALL SELECT b.symbol, b.n, e.e3 + {_CUT.format('e3', 4)} FROM e JOIN k1 b ON b.symbol = e.symbol AND b.n = e.n + 1),
s1 AS (SELECT k1.symbol, k1.seen, k1.o, k1.c, lag(k1.c, 3) OVER w AS lag3, lag(k1.c > k1.o, 2) OVER w AS lag_gt, CASE WHEN k1.n >= 5 THEN max(k1.c) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS high5,
   CASE WHEN k1.n >= 4 THEN min(k1.o) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS low4, CASE WHEN k1.n >= 3 THEN e.e3 END AS ema3, CASE WHEN lag(k1.c) OVER w IS NOT NULL THEN lag(k1.c) OVER w <= lag(k1.o) OVER w AND k1.c > k1.o END AS up
   FROM k1 JOIN e ON e.symbol = k1.symbol AND e.n = k1.n WINDOW w AS (PARTITION BY k1.symbol ORDER BY k1.seen)),
u AS (SELECT symbol, seen FROM c1 UNION SELECT symbol, seen FROM c4),
g AS (SELECT u.symbol, u.seen, s1.o AS o1, s1.c AS c1, f.h AS h4, f.l AS l4, s1.lag3, s1.lag_gt, s1.high5, s1.low4, s1.ema3, s1.up
   FROM u LEFT JOIN s1 ON s1.symbol = u.symbol AND s1.seen = (SELECT max(x.seen) FROM s1 x WHERE x.symbol = u.symbol AND x.seen <= u.seen) LEFT JOIN c4 f ON f.symbol = u.symbol AND f.seen = (SELECT max(x.seen) FROM c4 x WHERE x.symbol = u.symbol AND x.seen <= u.seen))
SELECT symbol, seen, seen - 1 AS version, o1, c1, h4, l4, c1 + o1 AS total, c1 - o1 AS step, CASE WHEN c1 < l4 THEN c1 WHEN c1 >= l4 THEN l4 END AS least_of, CASE WHEN c1 > h4 THEN c1 WHEN c1 <= h4 THEN h4 END AS most_of,
  c1 > o1 AS gt, c1 >= o1 AS ge, c1 - o1 < 2 AS lt, c1 <= h4 AS le, c1 = o1 AS eq, lag3, lag_gt, high5, low4, ema3, up, CASE WHEN h4 IS NOT NULL AND lag(h4) OVER w IS NOT NULL THEN lag(c1) OVER w >= lag(h4) OVER w AND c1 < h4 END AS down,
  c1 > o1 AND c1 >= o1 AS both_true, CASE WHEN up IS NOT NULL THEN c1 - o1 < 2 OR up END AS either, NOT (c1 <= h4) AS negated, h4 - l4 AS range4
FROM g WINDOW w AS (PARTITION BY symbol ORDER BY seen)"""
_PROGRAM_SQL = f"""WITH RECURSIVE ticks AS ({_TICK_VIEW}), c1 AS ({_CLOSED.format(HOUR)}), k1 AS (SELECT symbol, seen, c, row_number() OVER (PARTITION BY symbol ORDER BY seen) AS n FROM c1),
e AS (SELECT symbol, n, seen, c AS e2, c AS e3, c AS e4, c AS e5 FROM k1 WHERE n = 1
 UNION ALL SELECT b.symbol, b.n, b.seen, {', '.join(f"e.e{k} + " + _CUT.format(f"e{k}", k + 1) for k in (2, 3, 4, 5))} FROM e JOIN k1 b ON b.symbol = e.symbol AND b.n = e.n + 1),
p AS (SELECT e.symbol, e.seen, e.n, v.fast, v.slow, CASE v.fast WHEN 2 THEN e2 ELSE e4 END AS f, CASE v.slow WHEN 3 THEN e3 ELSE e5 END AS s FROM e CROSS JOIN (VALUES (2, 3), (2, 5), (4, 5)) AS v(fast, slow)),
x AS (SELECT symbol, fast, slow, seen, lag(f) OVER w <= lag(s) OVER w AND f > s AS up, lag(f) OVER w >= lag(s) OVER w AND f < s AS down FROM p WHERE n >= slow WINDOW w AS (PARTITION BY symbol, fast, slow ORDER BY seen))
SELECT symbol, fast, slow, seen, seen - 1 AS version, up FROM (SELECT *, coalesce(lag(up OR down) OVER (PARTITION BY symbol, fast, slow ORDER BY seen), FALSE) AS before FROM x) WHERE (up OR down) AND NOT before"""
_QUOTES_SQL = f"""WITH ticks AS ({_TICK_VIEW}), c1 AS ({_CLOSED.format(HOUR)}),
t AS (SELECT t.symbol, t.seq, t.bid_u, t.ask_u, c1.c FROM ticks t ASOF LEFT JOIN c1 ON c1.symbol = t.symbol AND c1.seen <= t.seq)
SELECT symbol, seen, seen AS version, away, lag2, high16, over_close AS over, CASE WHEN over_close IS NOT NULL THEN over_close AND wide END AS sig FROM (
  SELECT symbol, seq AS seen, bid_u - c AS away, lag(bid_u - c, 2) OVER w AS lag2, CASE WHEN seq >= 16 THEN max(ask_u) OVER (w ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) END AS high16,
    CASE WHEN lag(c) OVER w IS NOT NULL THEN lag(bid_u) OVER w <= lag(c) OVER w AND bid_u > c END AS over_close, ask_u - bid_u > 1 AS wide FROM t WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""


OVER_TAPE = {"bid": "BID", "close": f"CLOSE:{HOUR}", "away": "SUB:bid:close", "fast": "EMA:bid:$fast", "slow": "EMA:bid:$slow", "drift": "EMA:away:50", "up": "CROSS_UP:fast:slow"}
_TAPE_SQL = f"""WITH RECURSIVE ticks AS ({_TICK_VIEW}), c1 AS ({_CLOSED.format(HOUR)}),
t AS (SELECT t.symbol, t.seq, t.bid_u AS c, t.bid_u - c1.c AS away FROM ticks t ASOF LEFT JOIN c1 ON c1.symbol = t.symbol AND c1.seen <= t.seq),
e AS (SELECT symbol, seq, c AS e12, c AS e80 FROM t WHERE seq = 1 UNION ALL SELECT b.symbol, b.seq, e.e12 + {_CUT.format('e12', 13)}, e.e80 + {_CUT.format('e80', 81)} FROM e JOIN t b ON b.symbol = e.symbol AND b.seq = e.seq + 1),
a AS (SELECT symbol, seq, away AS c, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM t WHERE away IS NOT NULL),
d AS (SELECT symbol, seq, n, c AS e50 FROM a WHERE n = 1 UNION ALL SELECT b.symbol, b.seq, b.n, d.e50 + {_CUT.replace('e.{0}', 'd.{0}').format('e50', 51)} FROM d JOIN a b ON b.symbol = d.symbol AND b.n = d.n + 1),
v AS (SELECT e.symbol, e.seq, CASE WHEN e.seq >= 12 THEN e12 END AS fast, CASE WHEN e.seq >= 80 THEN e80 END AS slow, CASE WHEN d.n >= 50 THEN d.e50 END AS drift FROM e LEFT JOIN d ON d.symbol = e.symbol AND d.seq = e.seq)
SELECT symbol, seq AS seen, seq AS version, fast, slow, drift, CASE WHEN lag(slow) OVER w IS NOT NULL THEN lag(fast) OVER w <= lag(slow) OVER w AND fast > slow END AS up FROM v WINDOW w AS (PARTITION BY symbol ORDER BY seq)"""


def _averaged(spark: SparkSession, sf_dir: str, specs: list[scans.Average]) -> DataFrame:
    rows = written(BARS_TR.run(spark, sf_dir).select("symbol", "bar", "close_u", "tr"), "bars")
    return scans.averages(rows, "bar", specs).select("symbol", "bar", *(F.round(s.name, 6).alias(s.name) for s in specs))


# Periods of the averages of closes, and of the ranges.
EMA_PERIODS = (5, 8, 9, 10, 13, 18, 20, 21, 26, 34, 35, 44, 50, 53, 55, 70, 79, 88, 89, 100, 105, 131, 140, 144, 158, 200, 210)
ATR_PERIODS = (7, 10, 14, 20, 28, 50)
CLOSE_AVERAGES = [scans.Average(f"e{n}", "close_u", "ema", n) for n in EMA_PERIODS]
RANGE_AVERAGES = [scans.Average(f"{kind}{n}", "tr", kind, n) for kind in ("wilder", "ema") for n in ATR_PERIODS]


def _averages_sql(specs: list[scans.Average], plan: Plan = BARS_TR, late: tuple[str, ...] = (), also: str = "") -> str:
    """The same averages as one recursion over a symbol's bars; values in ``late`` begin at the second bar."""
    sums = ", ".join(f"sum({v}) OVER w AS sum_{v}" for v in dict.fromkeys(s.value for s in specs))
    step = ", ".join(f"CASE WHEN b.bar = {s.n + (s.value in late)} THEN CAST(b.sum_{s.value} AS DOUBLE) / {s.n} WHEN b.bar > {s.n + (s.value in late)} THEN e.{s.name} + CAST({s.alpha!r} AS DOUBLE) * (b.{s.value} - e.{s.name}) END AS {s.name}" for s in specs)
    return f"""WITH RECURSIVE b AS (SELECT *, {sums} FROM ({plan.text(False)}) WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT symbol, bar, {', '.join(f'CAST(NULL AS DOUBLE) AS {s.name}' for s in specs)} FROM b WHERE bar = 1
 UNION ALL SELECT b.symbol, b.bar, {step} FROM e JOIN b ON b.symbol = e.symbol AND b.bar = e.bar + 1)
{also or f"SELECT symbol, bar, {', '.join(f'round({s.name}, 6) AS {s.name}' for s in specs)} FROM e"}"""


#: Bars of one and two steps of the ladder above an hour, each known at the first tick of the next.
STEPS_UP = {"four_hours": 4, "day": 24}
_ABOVE = ("nb", """
SELECT symbol, bucket, high_u, low_u, close_u, CAST(row_number() OVER w AS BIGINT) AS bar, lag(close_u) OVER w AS prev_close, lead(first_seq) OVER w AS available FROM upper_bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket)""")
UPPER = {n: (*BARS, bars.coarser(k, "upper_bars"), _ABOVE) for n, k in STEPS_UP.items()}
UPPER_VALUES = {n: Plan(*steps, select="SELECT symbol, bar, available, close_u, CASE WHEN prev_close IS NOT NULL THEN greatest(close_u - prev_close, 0) END AS up, CASE WHEN prev_close IS NOT NULL THEN greatest(prev_close - close_u, 0) END AS dn FROM nb") for n, steps in UPPER.items()}
UPPER_CCI = {n: Plan(*steps, select=indicators.CCI) for n, steps in UPPER.items()}
HOURS = Plan(*NUMBERED, select="SELECT symbol, bar, last_seq FROM nb")
UPPER_AVERAGES = [*(scans.Average(f"e{n}", "close_u", "ema", n) for n in (35, 70, 105)), scans.Average("gain", "up", "wilder", 14), scans.Average("loss", "dn", "wilder", 14)]
_UPPER_RULES = {
    "trend_buy": "close_u > e35 AND e35 > e70 AND e70 > e105", "trend_sell": "close_u < e35 AND e35 < e70 AND e70 < e105", "rsi_buy": "CASE WHEN gain + loss > 0 THEN gain >= loss ELSE gain IS NOT NULL END",
    "rsi_sell": "CASE WHEN gain + loss > 0 THEN gain <= loss ELSE gain IS NOT NULL END", "cci_buy": "cci20 > 0", "cci_sell": "cci20 < 0",
}


def _rules_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the last completed bar one and two steps up, for every hour: a union in the order of ticks, filled forward."""
    hours, out = written(HOURS.run(spark, sf_dir), "hours"), None
    for name in STEPS_UP:
        values = written(UPPER_VALUES[name].run(spark, sf_dir), "upper")
        known = scans.averages(values, "bar", UPPER_AVERAGES).join(UPPER_CCI[name].run(spark, sf_dir), ["symbol", "bar"], "left").where("available is not null")
        rules = known.select("symbol", F.col("available").alias("moment"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("bar"), F.struct(F.col("bar").alias("context"), *(F.expr(f"coalesce({e}, false)").alias(n) for n, e in _UPPER_RULES.items())).alias("rules"))
        asked = hours.select("symbol", F.col("last_seq").alias("moment"), F.lit(0).alias("kind"), "bar", F.lit(None).cast(rules.schema["rules"].dataType).alias("rules"))
        past = Window.partitionBy("symbol").orderBy("moment", "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = rules.unionByName(asked).withColumn("rules", F.last("rules", True).over(past)).where("kind = 0")
        part = found.select("symbol", "bar", F.lit(name).alias("step"), F.col("rules.context").alias("context"), *(F.coalesce(F.col("rules")[n], F.lit(False)).alias(n) for n in _UPPER_RULES))
        out = part if out is None else out.unionByName(part)
    return out


def _rules_above_sql() -> str:
    parts = []
    for name in STEPS_UP:
        flags = ", ".join(f"coalesce({e}, FALSE) AS {n}" for n, e in _UPPER_RULES.items())
        inner = _averages_sql(UPPER_AVERAGES, UPPER_VALUES[name], ("up", "dn"), f"SELECT e.symbol, e.bar, b.available, {flags} FROM e JOIN b USING (symbol, bar) LEFT JOIN ({UPPER_CCI[name].text(False)}) c USING (symbol, bar)")
        parts.append(f"SELECT h.symbol, h.bar, '{name}' AS step, c.bar AS context, {', '.join(f'coalesce(c.{n}, FALSE) AS {n}' for n in _UPPER_RULES)} FROM ({HOURS.text(False)}) h ASOF LEFT JOIN ({inner}) c ON c.symbol = h.symbol AND c.available < h.last_seq")
    return "\nUNION ALL ".join(parts)


def _near_ema(boxes: DataFrame, emas: DataFrame) -> DataFrame:
    """Boxes that contract, are narrow against the range, and lie around the average."""
    rows = boxes.where("atr14 is not null").join(emas.where("ema8 is not null").select("symbol", "bar", "ema8"), ["symbol", "bar"])
    return rows.selectExpr("symbol", "bar", "coalesce(width < width1 and width1 < width2, false) as contracting", "width <= 3 * atr14 as narrow", "abs(middle - ema8) <= atr14 as near_ema")


MARKS = Plan(*SHOCKS, select=signals.MARKS)
PAIR_MARKS = Plan(*PAIRED, select=contexts.PAIR_MARKS)
IDENTITIES = Plan(*BREAKS, select=contexts.IDENTITIES)


RAISED = Plan(*NUMBERED, candidates.RAISED, select="SELECT r.symbol, t.session_day, r.mode, CAST(r.side AS INT) AS side, r.signal_seq FROM raised r JOIN ticks t ON t.symbol = r.symbol AND t.seq = r.signal_seq")
MOVING = sessions.Rules(even_ppm=500_000, even_u=50, trail_u=2000)
OFFERS = Plan(*LEDGER, select=execution.OFFERS)
SIGNALLED = Plan(*LEDGER, select=execution.OUTCOMES)
_SCHEDULE_SQL = f"""WITH RECURSIVE l AS ({SIGNALLED.text(False)}), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_day ORDER BY signal_seq, intent_id) AS k FROM l),
f AS (SELECT symbol, session_day, k, r, signal_seq, intent_id, CASE WHEN NOT inside THEN 'SESSION' ELSE state END AS reason, CASE WHEN inside AND state = '' THEN exit_seq ELSE -1 END AS busy, CASE WHEN inside AND state = '' THEN 1 ELSE 0 END AS n FROM o WHERE k = 1
 UNION ALL SELECT symbol, session_day, k, r, signal_seq, intent_id, reason, CASE WHEN reason = '' THEN exit_seq ELSE busy END, CASE WHEN reason = '' THEN n + 1 ELSE n END FROM (
  SELECT o.symbol, o.session_day, o.k, o.r, o.signal_seq, o.intent_id, o.exit_seq, f.busy, f.n, CASE WHEN o.signal_seq <= f.busy THEN 'PAST' WHEN NOT o.inside THEN 'SESSION' WHEN f.n >= 3 THEN 'CAP' ELSE o.state END AS reason
  FROM f JOIN o ON o.symbol = f.symbol AND o.session_day = f.session_day AND o.k = f.k + 1)),
e AS (SELECT symbol, r, eq, greatest(0e0, max(eq) OVER (PARTITION BY symbol ORDER BY signal_seq, intent_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM (
  SELECT symbol, r, signal_seq, intent_id, sum(r) OVER (PARTITION BY symbol ORDER BY signal_seq, intent_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM f WHERE reason = ''))
SELECT c.*, t.trades, t.total_r, t.gains_r, t.losses_r, t.drawdown_r FROM (SELECT symbol, count(*) AS signals, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS {r.lower()}" for r in portfolios.REASONS)} FROM f GROUP BY symbol) c
LEFT JOIN (SELECT symbol, count(*) AS trades, round(sum(r), 6) AS total_r, round(sum(greatest(r, 0e0)), 6) AS gains_r, round(sum(greatest(-r, 0e0)), 6) AS losses_r, round(max(peak - eq), 6) AS drawdown_r FROM e GROUP BY symbol) t ON t.symbol = c.symbol"""
BANDS = Plan(*RANGE, brackets.ATRS, crossings.PIVOTS, crossings.KNOWN, crossings.IN_FORCE, select=crossings.THRESHOLDS)
#: Moves from the tick before, whatever it is, and from the last executable quote to the next.
EVERY_MOVE = Plan(*TAPE, *tape.carried("every_tick", "ticks", {"bid": "bid_u"}), select=crossings.MOVES.format("every_tick"))
VALID_MOVE = Plan(*TAPE, *QUOTES, select=crossings.MOVES.format("quotes"))


def _crossed(moves: Plan) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    run = lambda spark, sf_dir: crossings.crosses(moves.run(spark, sf_dir), written(BANDS.run(spark, sf_dir), "bands"))
    return run, f"WITH m AS ({moves.text(False)}), t AS ({BANDS.text(False)}){crossings.PLAIN}"


# Lookbacks of the contexts, and the quantiles that they compare with.
CONTEXTS: dict[str, tuple[Plan, tuple[int, ...], dict[str, tuple[int, int]], dict[str, str]]] = {
    "ctx_volatility_lookbacks": (
        Plan(*RANGE, select="SELECT symbol, bar, CASE WHEN count(*) OVER w = 14 THEN CAST(sum(tr) OVER w AS BIGINT) END AS v FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"),
        (20, 50, 100, 200, 500), {"q20": (1, 5), "q50": (1, 2), "q80": (4, 5)},
        {"rising": "reference > q50", "middle": "reference >= q20 AND reference <= q80", "high": "reference >= q80", "low": "reference <= q20"},
    ),
    "ctx_spread_lookbacks": (
        Plan(*NUMBERED, select="SELECT symbol, bar, CASE WHEN spread_sum > 0 THEN spread_sum * 1.0 / n_ticks END AS v FROM nb"),
        (50, 100, 500, 2000), {"q75": (3, 4), "q90": (9, 10)}, {"below_q75": "reference <= q75", "below_q90": "reference <= q90", "below_cap": "reference <= 2"},
    ),
    "ctx_intensity_lookbacks": (Plan(*NUMBERED, select="SELECT symbol, bar, n_ticks AS v FROM nb"), (20, 50, 100, 500), {"q50": (1, 2), "q80": (4, 5)}, {"busy": "reference > q50", "busiest": "reference >= q80"}),
}


def _context(name: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    plan, lookbacks, quantiles, flags = CONTEXTS[name]
    shown = [f"{e} AS {n}" for n, e in flags.items()]
    run = lambda spark, sf_dir: ranks.rolling(plan.run(spark, sf_dir), "v", lookbacks, quantiles).selectExpr("symbol", "bar", "lookback", "reference", *quantiles, *shown)
    one = "\nUNION ALL ".join(
        f"SELECT symbol, bar, {n} AS lookback, reference, vs, {', '.join(f'list_sort(vs)[{ranks.nearest_rank(n, *q)}] AS {c}' for c, q in quantiles.items())} FROM (SELECT symbol, bar, lag(v) OVER o AS reference, "
        f"list(v) FILTER (WHERE v IS NOT NULL) OVER (o ROWS BETWEEN {n + 1} PRECEDING AND 2 PRECEDING) AS vs FROM b WINDOW o AS (PARTITION BY symbol ORDER BY bar)) WHERE len(vs) = {n} AND reference IS NOT NULL"
        for n in lookbacks
    )
    return run, f"WITH b AS ({plan.text(False)}) SELECT symbol, bar, lookback, reference, {', '.join(quantiles)}, {', '.join(shown)} FROM ({one})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nearest(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return matching.nearest(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"), **options)


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and conversions over the orders: dates of which some are none, names, digests, parts per million, multiples, decimals."""
    o = _table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("bigint") + F.col("o_orderkey") % 3 * 15
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    kind = F.col("o_orderkey") % 5
    number = (F.col("o_custkey") % 40 / 8).cast("decimal(9,3)")
    text = F.when(kind == 0, F.concat(F.lit("R"), scalars.plain_decimal(number))).when(kind == 1, F.concat(F.lit("AT"), scalars.plain_decimal(number), F.lit("R"))).when(kind == 2, F.concat(F.lit("BE_AT_"), scalars.plain_decimal(number), F.lit("R"))).when(kind == 3, "OFF").otherwise("free")
    price = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("decimal(18,4)") / 100
    return o.select(
        "o_orderkey", scalars.valid_date(day).alias("dated"), scalars.valid_name(F.col("o_orderpriority")).alias("named"), scalars.valid_hash(F.when(kind < 4, digest).otherwise(F.upper(digest))).alias("hashed"),
        scalars.parts_per_million(F.col("o_custkey"), F.col("o_orderkey") % 7 * 1000).alias("ppm"), scalars.multiple(text).alias("multiple"), scalars.plain_decimal(price.cast("decimal(18,4)")).alias("price"),
    )


_SCALARS_SQL = """SELECT o_orderkey, try_strptime(CAST(day AS VARCHAR), '%Y%m%d') IS NOT NULL AND length(CAST(day AS VARCHAR)) = 8 AND CAST(substring(CAST(day AS VARCHAR), 7, 2) AS INT) <= 31 AS dated,
  regexp_full_match(o_orderpriority, '[A-Za-z0-9_-]{1,128}') AS named, k < 4 OR NOT regexp_matches(digest, '[a-f]') AS hashed, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey * 1000000 // (o_orderkey % 7 * 1000) END AS ppm,
  CASE WHEN k <= 2 THEN o_custkey % 40 / 8e0 END AS multiple, CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) ELSE rtrim(CAST(CAST(cents AS DECIMAL(18, 2)) / 100 AS VARCHAR), '0') END AS price
FROM (SELECT *, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) + o_orderkey % 3 * 15 AS day, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, o_orderkey % 5 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a program at every tick as text, NA where there is none: the form in which features leave for other tools."""
    names = ["bid", "spread", "away", "lag2", "high16", "over", "sig"]
    values = _graph(spark, sf_dir, OVER_QUOTES, ["lag2", "high16", "sig"]).values(*names)
    shown = lambda c: F.when(F.col(c), "1").otherwise("0") if values.schema[c].dataType.typeName() == "boolean" else F.col(c).cast("string")
    return values.select("symbol", F.col("seen").alias("seq"), *(F.when(F.col(c).isNull(), "NA").otherwise(shown(c)).alias(c) for c in names))


_MATRIX_SQL = f"""WITH q AS ({_QUOTES_SQL}), v AS ({_TICK_VIEW})
SELECT q.symbol, q.seen AS seq, {', '.join(f"coalesce(CAST({e} AS VARCHAR), 'NA') AS {n}" for n, e in (('bid', 'v.bid_u'), ('spread', 'v.ask_u - v.bid_u'), ('away', 'q.away'), ('lag2', 'q.lag2'), ('high16', 'q.high16'), ('over', 'CAST(q.over AS INT)'), ('sig', 'CAST(q.sig AS INT)')))}
FROM q JOIN v ON v.symbol = q.symbol AND v.seq = q.seen"""


# Settings of the geometry gate; null switches a part off.
_GEOMETRY = "CROSS JOIN (VALUES (CAST(NULL AS INT)), (2), (3), (4)) AS a(contracting) CROSS JOIN (VALUES (CAST(NULL AS INT)), (2), (3), (5)) AS b(widest) CROSS JOIN (VALUES (CAST(NULL AS INT)), (1), (2)) AS c(furthest)"
_GEOMETRY_OPEN = """CASE contracting WHEN 2 THEN width < width1 WHEN 3 THEN width < width1 AND width1 < width2 WHEN 4 THEN width < width1 AND width1 < width2 AND width2 < width3 ELSE TRUE END
  AND (widest IS NULL OR atr14 > 0 AND width <= widest * atr14) AND (furthest IS NULL OR atr14 > 0 AND abs(middle - e35) <= furthest * atr14)"""


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that pass each setting: boxes that contract, are narrow, and lie around the average of 35."""
    emas = _averaged(spark, sf_dir, [scans.Average("e35", "close_u", "ema", 35)])
    rows = BOX_WIDTHS.run(spark, sf_dir).join(emas, ["symbol", "bar"])
    return spark.sql(f"SELECT symbol, contracting, widest, furthest, count(*) AS bars, count_if(coalesce({_GEOMETRY_OPEN}, FALSE)) AS passing FROM {{rows}} {_GEOMETRY} GROUP BY symbol, contracting, widest, furthest", rows=rows)


def _momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules of momentum for either side at every bar."""
    rsi = _folded(spark, sf_dir).select("symbol", "bar", F.round("rsi14", 6).alias("rsi14"))
    out = rsi
    for name in ("ind_roc", "ind_cci", "ind_stoch"):
        out = out.join(PLANS[name].run(spark, sf_dir), ["symbol", "bar"], "left")
    return out.selectExpr("symbol", "bar", *_MOMENTUM)


_MOMENTUM = [f"coalesce({e}, FALSE) AS {n}" for n, e in (
    ("rsi_buy", "rsi14 >= 55"), ("rsi_sell", "rsi14 <= 45"), ("roc_buy", "roc5 > 0"), ("roc_sell", "roc5 < 0"), ("cci_buy", "cci20 > 0"), ("cci_sell", "cci20 < 0"), ("stoch_buy", "d3 > 50"), ("stoch_sell", "d3 < 50"),
)]


def _packed(plan: Plan, by: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: written(masks.pack(plan.run(spark, sf_dir), by), "masks")


def _unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mask packed, written, read again and unpacked."""
    packed = _packed(MARKS, ["config"])(spark, sf_dir)
    read = masks.unpack(packed, ["config"]).groupBy("config").agg(F.count("*").alias("events"), F.min("number").alias("first_bar"), F.max("number").alias("last_bar"), F.sum("number").alias("total"))
    return read.join(masks.masks(packed, ["config"]).select("config", "class_hash", "chunks"), "config")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each symbol by itself, then the classes of those, by content again."""
    packed = _packed(PAIR_MARKS, ["symbol", "config"])(spark, sf_dir)
    groups = written(masks.classes(packed, ["symbol"], "config"), "classes")
    named = F.concat_ws(":", "symbol", "config").alias("name")
    first = packed.join(groups.select("symbol", F.col("representative").alias("config")), ["symbol", "config"], "left_semi")
    merged = masks.aliases(first.select(named, "chunk", "n", "first", "last", "digest", "deltas"), [], "name")
    parts = groups.select(F.concat_ws(":", "symbol", "representative").alias("name"), F.col("aliases").alias("own"))
    return merged.join(parts, "name").groupBy("class_hash").agg(F.min("name").alias("representative"), F.sum("own").alias("aliases"), F.max("events").alias("events"), F.bool_and("same").alias("exact"), F.count("*").alias("parts"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations, classes by content, and masks that are unequal in spite of an equal digest."""
    own = masks.aliases(_packed(PAIR_MARKS, ["symbol", "config"])(spark, sf_dir), ["symbol"], "config")
    return own.groupBy("symbol").agg(F.count("*").alias("configs"), F.countDistinct("config").alias("distinct_configs"), F.countDistinct("class_hash").alias("classes"), F.sum("events").alias("events"), F.count_if(~F.col("same")).alias("unequal"))


def _mask_sql(plan: Plan, by: str) -> str:
    """Masks with the digest of their chunks' digests, and all their numbers as one text."""
    floor = f"(number - ((number % {masks.SPAN}) + {masks.SPAN}) % {masks.SPAN}) // {masks.SPAN}"
    return f"""WITH marks AS (SELECT DISTINCT {by}, number FROM ({plan.text(False)})),
chunks AS (SELECT {by}, {floor} AS chunk, sha256(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number)) AS digest, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS text, count(*) AS n, min(number) AS low, max(number) AS high, sum(number) AS total FROM marks GROUP BY ALL),
m AS (SELECT {by}, sha256(string_agg(digest, ',' ORDER BY chunk)) AS class_hash, string_agg(text, ',' ORDER BY chunk) AS ids, CAST(sum(n) AS BIGINT) AS events, count(*) AS chunks, min(low) AS low, max(high) AS high, CAST(sum(total) AS BIGINT) AS total FROM chunks GROUP BY {by})
"""


FOLDED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "ind_folds": (
        lambda s, d: _folded(s, d).selectExpr("symbol", "bar", "ema_int5", *(f"round({c}, 6) as {c}" for c in ("ema8", "ema20", "ema35", "atr14", "rsi14", "adx14"))),
        _fold_sql() + "SELECT symbol, bar, ei AS ema_int5, round(e8, 6) AS ema8, round(e20, 6) AS ema20, round(e35, 6) AS ema35, round(atr, 6) AS atr14, round(rsi, 6) AS rsi14, round(adx, 6) AS adx14 FROM g",
    ),
    "gate_trend": (lambda s, d: _gated(s, d, *_TREND), _fold_sql() + f"SELECT symbol, bar, {_shut(**_TREND)} FROM g"),
    "gate_cross_recency": (lambda s, d: _gated(s, d, "recent_up", "recent_down"), _fold_sql() + f"SELECT symbol, bar, {_RECENT['up']} AS recent_up, {_RECENT['down']} AS recent_down FROM g"),
    "gate_conjunction": (
        _conjunction,
        _fold_sql() + f""", s AS ({EVENTS_10.text(False)}),
c AS (SELECT symbol, bar + 1 AS bar, {_shut(**_TREND, strong="adx >= 25", mu="rsi >= 55", md="rsi <= 45")}, {_RECENT['up']} AS ru, {_RECENT['down']} AS rd FROM g)
SELECT symbol, bar, side, trend, strong, momentum, recent, trend AND strong AND momentum AND recent AS all_open FROM (
  SELECT s.symbol, s.bar, s.side, CASE WHEN s.side = 1 THEN c.up ELSE c.down END AS trend, c.strong, CASE WHEN s.side = 1 THEN c.mu ELSE c.md END AS momentum, CASE WHEN s.side = 1 THEN c.ru ELSE c.rd END AS recent
  FROM s JOIN c ON c.symbol = s.symbol AND c.bar = s.bar)""",
    ),
    "feature_operators": (lambda s, d: _graph(s, d, EVERY_OPERATOR, OPERATOR_OUTPUTS).values(*OPERATOR_OUTPUTS), _OPERATORS_SQL),
    "feature_program": (_program, _PROGRAM_SQL),
    "feature_quotes": (lambda s, d: _graph(s, d, OVER_QUOTES, ["lag2", "high16", "sig"]).values("away", "lag2", "high16", "over", "sig"), _QUOTES_SQL),
    "scalar_checks": (_scalars, _SCALARS_SQL),
    "feature_matrix": (_matrix, _MATRIX_SQL),
    "rules_above": (_rules_above, _rules_above_sql()),
    "geometry_settings": (
        _geometry,
        f"SELECT symbol, contracting, widest, furthest, count(*) AS bars, count(*) FILTER (WHERE coalesce({_GEOMETRY_OPEN}, FALSE)) AS passing FROM ({BOX_WIDTHS.text(False)}) x JOIN ({_averages_sql([scans.Average('e35', 'close_u', 'ema', 35)])}) e USING (symbol, bar) {_GEOMETRY} GROUP BY symbol, contracting, widest, furthest",
    ),
    "momentum_rules": (
        _momentum,
        _fold_sql() + f", r AS ({PLANS['ind_roc'].text(False)}), c AS ({PLANS['ind_cci'].text(False)}), k AS ({PLANS['ind_stoch'].text(False)}) SELECT symbol, bar, {', '.join(_MOMENTUM)} FROM (SELECT symbol, bar, round(rsi, 6) AS rsi14 FROM g) LEFT JOIN r USING (symbol, bar) LEFT JOIN c USING (symbol, bar) LEFT JOIN k USING (symbol, bar)",
    ),
    "year_bootstrap": (lambda s, d: folds.year_bootstrap(BLOCKS.run(s, d)), None),
    "missed_trades": (lambda s, d: retellings.missed(Plan(*LEDGER, select="SELECT symbol, intent_id, net_u FROM ledger").run(s, d), families.BLOCKS), PLANS["missed_trades"].text(False)),
    "tfidf_nearest": (
        lambda s, d: _nearest(s, d, tagged=False, apart=universe.APART).selectExpr("doc_id", "item_id", "round(score, 6) as score"),
        PLANS["tfidf_nearest"].text(False),
    ),
    "hybrid_nearest": (
        lambda s, d: _nearest(s, d).selectExpr("doc_id", "item_id", "round(lexical, 6) as lexical", "round(tagged, 6) as tagged", "round(score, 6) as score"),
        matching.check_sql() + " SELECT doc_id, item_id, round(lexical, 6) AS lexical, round(tagged, 6) AS tagged, round(score, 6) AS score FROM best",
    ),
    "dispatch_waves": (lambda s, d: matching.waves(_nearest(s, d), _table(s, d, "documents"), _table(s, d, "labels")), matching.waves_sql()),
    "first_wave": (
        lambda s, d: matching.waves(_nearest(s, d), _table(s, d, "documents"), _table(s, d, "labels"), top=30),
        f"SELECT * FROM ({matching.waves_sql()}) WHERE wave = 1 ORDER BY rank DESC, doc_id LIMIT 30",
    ),
    **{name: _context(name) for name in CONTEXTS},
    "structure_crosses": _crossed(EVERY_MOVE),
    "structure_crosses_valid": _crossed(VALID_MOVE),
    "mask_pack": (_unpacked, _mask_sql(MARKS, "config") + "SELECT config, events, low AS first_bar, high AS last_bar, total, class_hash, chunks FROM m"),
    "mask_dedupe": (
        lambda s, d: masks.classes(_packed(MARKS, ["config"])(s, d), [], "config"),
        _mask_sql(MARKS, "config") + "SELECT class_hash, min(config) AS representative, count(*) AS aliases, max(events) AS events, count(DISTINCT ids) = 1 AS exact FROM m GROUP BY class_hash",
    ),
    "ternary_masks": (
        lambda s, d: masks.aliases(_packed(PAIR_MARKS, ["symbol", "config"])(s, d), ["symbol"], "config").where("same").selectExpr("symbol", "config", "canonical", "class_hash as mask_sha", "events"),
        _mask_sql(PAIR_MARKS, "symbol, config") + "SELECT symbol, config, min(config) OVER (PARTITION BY symbol, ids) AS canonical, class_hash AS mask_sha, events FROM m",
    ),
    "result_audit": (_audited, _mask_sql(PAIR_MARKS, "symbol, config") + """
SELECT symbol, count(*) AS configs, count(DISTINCT config) AS distinct_configs, count(DISTINCT ids) AS classes, CAST(sum(events) AS BIGINT) AS events, count(*) FILTER (WHERE low_ids <> ids) AS unequal
FROM (SELECT *, min(ids) OVER (PARTITION BY symbol, class_hash) AS low_ids FROM m) GROUP BY symbol"""),
    "mask_merge": (_merged, _mask_sql(PAIR_MARKS, "symbol, config") + """
SELECT class_hash, min(symbol || ':' || representative) AS representative, CAST(sum(aliases) AS BIGINT) AS aliases, max(events) AS events, count(DISTINCT ids) = 1 AS exact, count(*) AS parts FROM (
  SELECT class_hash, ids, symbol, min(config) AS representative, count(*) AS aliases, max(events) AS events FROM m GROUP BY class_hash, ids, symbol) GROUP BY class_hash"""),
    "mask_conjunctions": (
        lambda s, d: masks.conjunctions(MARKS.run(s, d), ["symbol"], "config"),
        f"WITH k AS ({MARKS.text(False)}) SELECT a.symbol, a.config AS config_a, b.config AS config_b, count(*) AS both_n FROM k a JOIN k b ON a.symbol = b.symbol AND a.number = b.number AND a.config < b.config GROUP BY a.symbol, a.config, b.config",
    ),
    "content_roots": (
        lambda s, d: masks.sorted_roots(IDENTITIES.run(s, d), F.col("shard")),
        f"SELECT shard, count(*) AS n, sha256(string_agg(id || chr(10), '' ORDER BY id)) AS root FROM (SELECT DISTINCT id, shard FROM ({IDENTITIES.text(False)})) GROUP BY shard",
    ),
    "feature_tape_ema": (lambda s, d: language.Graph(written(PLANS["tick_view"].run(s, d), "ticks"), language.compile_graph(OVER_TAPE, ["drift", "up"], {"fast": 12, "slow": 80})).values("fast", "slow", "drift", "up"), _TAPE_SQL),
    "ind_ema_periods": (lambda s, d: _averaged(s, d, CLOSE_AVERAGES), _averages_sql(CLOSE_AVERAGES)),
    "atr_smoothings": (lambda s, d: _averaged(s, d, RANGE_AVERAGES), _averages_sql(RANGE_AVERAGES)),
    "feat_ema_int": (
        lambda s, d: folds.indicator_folds(BARS_TR.run(s, d)).select("symbol", "bar", "ema_int5"),
        _recursive(BARS_TR, "b", """e AS (SELECT symbol, bar, close_u AS ema_int5 FROM b WHERE bar = 1
 UNION ALL SELECT b.symbol, b.bar, e.ema_int5 + CAST(2 * (b.close_u - e.ema_int5) // 6 AS BIGINT) FROM e JOIN b ON b.symbol = e.symbol AND b.bar = e.bar + 1)""", "SELECT symbol, bar, ema_int5 FROM e"),
    ),
    "ind_atr_wilder": (
        lambda s, d: folds.indicator_folds(BARS_TR.run(s, d)).where("atr14 is not null").selectExpr("symbol", "bar", "round(atr14, 4) as atr14"),
        _recursive(BARS_TR, "b", """e AS (SELECT symbol, CAST(14 AS BIGINT) AS bar, avg(tr) AS atr FROM b WHERE bar <= 14 GROUP BY symbol HAVING count(*) = 14
 UNION ALL SELECT b.symbol, b.bar, e.atr + (b.tr - e.atr) / 14.0 FROM e JOIN b ON b.symbol = e.symbol AND b.bar = e.bar + 1)""", "SELECT symbol, bar, round(atr, 4) AS atr14 FROM e"),
    ),
    "non_overlap_select": (
        lambda s, d: folds.greedy(TRADES.run(s, d)).where("accepted").select("symbol", "intent_id"),
        _recursive(TRADES, "l", _ADMITTED, "SELECT symbol, intent_id FROM a"),
    ),
    "overlap_admission": (
        lambda s, d: folds.greedy(TRADES.run(s, d)),
        _recursive(TRADES, "l", _ADMITTED, "SELECT l.symbol, l.intent_id, a.intent_id IS NOT NULL AS accepted, CASE WHEN a.intent_id IS NULL THEN 'OVERLAP' ELSE '' END AS reason FROM l LEFT JOIN a ON a.symbol = l.symbol AND a.intent_id = l.intent_id"),
    ),
    "refractory": (
        lambda s, d: folds.refractory(EVENTS.run(s, d), 5),
        _recursive(EVENTS, "l", """nx AS (SELECT o.symbol, o.threshold, o.side, o.bar, (SELECT min(x.bar) FROM l x WHERE x.symbol = o.symbol AND x.threshold = o.threshold AND x.side = o.side AND x.bar > o.bar + 5) AS next_bar FROM l o),
a AS (SELECT symbol, threshold, side, bar, next_bar FROM nx WHERE bar = (SELECT min(bar) FROM l WHERE l.symbol = nx.symbol AND l.threshold = nx.threshold AND l.side = nx.side)
 UNION ALL SELECT nx.symbol, nx.threshold, nx.side, nx.bar, nx.next_bar FROM a JOIN nx ON nx.symbol = a.symbol AND nx.threshold = a.threshold AND nx.side = a.side AND nx.bar = a.next_bar)""", "SELECT symbol, threshold, side, bar FROM a"),
    ),
    "candidate_machine": (lambda s, d: sessions.trades(PLANS["tick_view"].run(s, d), RAISED.run(s, d), MOVING), None),
    "portfolio_allocation": (lambda s, d: portfolios.allocate(OFFERS.run(s, d)).select("session_day", "symbol", F.col("offer_id").alias("intent_id"), (F.col("reason") == "").alias("accepted"), "reason"), None),
    "portfolio_report": (lambda s, d: portfolios.settle(written(portfolios.allocate(OFFERS.run(s, d)), "allocated"), 10**9), None),
    "session_schedule": (lambda s, d: portfolios.schedule_report(portfolios.schedule(SIGNALLED.run(s, d))), _SCHEDULE_SQL),
    "gate_geometry": (
        lambda s, d: _near_ema(BOXES.run(s, d), folds.indicator_folds(BARS_TR.run(s, d))),
        f"WITH RECURSIVE x AS ({BOXES.text(False)}), b AS ({BARS_TR.text(False)}), {_EMA8}" + '''
SELECT x.symbol, x.bar, coalesce(x.width < x.width1 AND x.width1 < x.width2, FALSE) AS contracting, x.width <= 3 * x.atr14 AS narrow, abs(x.middle - e.ema8) <= x.atr14 AS near_ema
FROM x JOIN e ON e.symbol = x.symbol AND e.bar = x.bar WHERE x.atr14 IS NOT NULL''',
    ),
    "gate_momentum": (
        lambda s, d: folds.indicator_folds(BARS_TR.run(s, d)).where("rsi14 is not null").selectExpr("symbol", "bar", "round(rsi14, 6) as rsi14", "rsi14 >= 55 as up", "rsi14 <= 45 as down"),
        f"WITH RECURSIVE b AS ({BAR_ATR.text(False)})," + '''
e AS (SELECT symbol, CAST(15 AS BIGINT) AS bar, avg(greatest(close_u - prev_close, 0)) AS u, avg(greatest(prev_close - close_u, 0)) AS dn FROM b WHERE bar BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
 UNION ALL SELECT b.symbol, b.bar, e.u + (greatest(b.close_u - b.prev_close, 0) - e.u) / 14.0, e.dn + (greatest(b.prev_close - b.close_u, 0) - e.dn) / 14.0 FROM e JOIN b ON b.symbol = e.symbol AND b.bar = e.bar + 1)
SELECT symbol, bar, round(r, 6) AS rsi14, r >= 55 AS up, r <= 45 AS down FROM (SELECT symbol, bar, CASE WHEN u + dn > 0 THEN 100 * u / (u + dn) ELSE 50.0 END AS r FROM e)''',
    ),
    "gate_trend_strength": (lambda s, d: _gated(s, d, *_STRENGTH), _fold_sql() + f"SELECT symbol, bar, {_shut(**_STRENGTH)} FROM g"),
    "candidate_trades": (
        lambda s, d: folds.schedule(PLANS["candidate_outcomes"].run(s, d), by=("symbol", "mode", "session_day")),
        _recursive(PLANS["candidate_outcomes"], "l", """o AS (SELECT symbol, mode, session_day, intent_id, entry_seq, exit_seq, row_number() OVER (PARTITION BY symbol, mode, session_day ORDER BY entry_seq, intent_id) AS k FROM l),
a AS (SELECT symbol, mode, session_day, k, intent_id, exit_seq AS busy, 1 AS n, '' AS reason FROM o WHERE k = 1
 UNION ALL SELECT symbol, mode, session_day, k, intent_id, CASE WHEN reason = '' THEN exit_seq ELSE busy END, CASE WHEN reason = '' THEN n + 1 ELSE n END, reason FROM (
  SELECT o.symbol, o.mode, o.session_day, o.k, o.intent_id, o.exit_seq, a.busy, a.n, CASE WHEN o.entry_seq <= a.busy THEN 'OVERLAP' WHEN a.n >= 3 THEN 'DAILY_LIMIT' ELSE '' END AS reason
  FROM a JOIN o ON o.symbol = a.symbol AND o.mode = a.mode AND o.session_day = a.session_day AND o.k = a.k + 1))""", "SELECT symbol, mode, session_day, intent_id, reason = '' AS accepted, reason FROM a"),
    ),
    "retest_filter": (lambda s, d: folds.retests(CARRIER.run(s, d)), retests.RETEST_SQL.format(CARRIER.text(False))),
    "daily_schedule": (
        lambda s, d: folds.schedule(OUTCOMES.run(s, d)),
        _recursive(OUTCOMES, "l", """o AS (SELECT symbol, session_day, intent_id, entry_seq, exit_seq, row_number() OVER (PARTITION BY symbol, session_day ORDER BY entry_seq, intent_id) AS k FROM l),
a AS (SELECT symbol, session_day, k, intent_id, exit_seq AS busy, 1 AS n, '' AS reason FROM o WHERE k = 1
 UNION ALL SELECT symbol, session_day, k, intent_id, CASE WHEN reason = '' THEN exit_seq ELSE busy END, CASE WHEN reason = '' THEN n + 1 ELSE n END, reason FROM (
  SELECT o.symbol, o.session_day, o.k, o.intent_id, o.exit_seq, a.busy, a.n, CASE WHEN o.entry_seq <= a.busy THEN 'OVERLAP' WHEN a.n >= 3 THEN 'DAILY_LIMIT' ELSE '' END AS reason
  FROM a JOIN o ON o.symbol = a.symbol AND o.session_day = a.session_day AND o.k = a.k + 1))""", "SELECT symbol, session_day, intent_id, reason = '' AS accepted, reason FROM a"),
    ),
    "impulse_states": (_impulses, None),
    "impulse_ticks": (
        lambda s, d: machines.impulses(PLANS["tick_view"].run(s, d), SLOW_TAPE).selectExpr("symbol", "entry_ms", "seq", "side", "round(score_v1, 6) as score_v1", "round(score_v2, 6) as score_v2", "eligible"), None,
    ),
    "impulse_score": (lambda s, d: _impulses(s, d).selectExpr("symbol", "side", "bar", "confirmed_bar", *(f"round({dialect(indicators.ips(v), True)}, 6) as score_v{v}" for v in (1, 2))), None),
    "sign_flip": (lambda s, d: folds.sign_flip(BLOCKS.run(s, d)), _SIGNS),
    "config_clusters": (
        lambda s, d: clusters.medoids(EDGES.run(s, d)),
        f"WITH RECURSIVE g AS ({EDGES.text(False)}), w AS (SELECT a AS u, b AS v, weight FROM g UNION ALL SELECT b, a, weight FROM g)," + '''
r AS (SELECT DISTINCT u AS node, u AS seen FROM w UNION SELECT r.node, w.v FROM r JOIN w ON w.u = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node), s AS (SELECT u AS node, round(sum(weight), 6) AS weight FROM w GROUP BY u)
SELECT component, count(*) AS members, arg_min(node, (-weight, node)) AS medoid, max(weight) AS weight FROM c JOIN s USING (node) GROUP BY component''',
    ),
    "bootstrap": (lambda s, d: folds.block_bootstrap(DAYS.run(s, d)), None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan.run for name, plan in PLANS.items()} | {name: f for name, (f, _) in FOLDED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: plan.text(False) for name, plan in PLANS.items()} | {name: sql for name, (_, sql) in FOLDED.items() if sql}
