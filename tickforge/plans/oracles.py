"""The same queries in DuckDB SQL, written on their own from the definitions in FIXTURES.md."""

from __future__ import annotations

_EV = """ev as (select event_id, event_type, value, epoch_us(ts) // 1000 as ms, ['BINANCE','BYBIT','COINBASE','KRAKEN'][user_id % 4 + 1] as venue, ['BTCUSDT','ETHUSDT','SOLUSDT'][event_id % 3 + 1] as instrument from events)"""
_TR = _EV + """, tr as (select event_id, venue, instrument, 100.0::double + value as price, ((event_id * 37) % 500 + 1) / 100.0 as size, case when event_id % 2 = 0 then 'buy' else 'sell' end as side, event_id::varchar as trade_id, ms as ts, ms - (event_id * 31) % 250 as tx, row_number() over (partition by venue, instrument order by ms, event_id) as seq from ev),
t as (select *, round_even(price * 1e8, 0)::bigint as p, round_even(size * 1e8, 0)::bigint as q from tr)"""
_DE = _TR + ", dt as (select * replace (1704067200000 + (ts - 1704067200000) // 720 as ts) from t)"
_BK = _DE + """, bk as (select venue, instrument, seq, ts, k, price - k * case when event_id % 97 = 0 then 5.0 else 0.5 end as bid, price + k * case when event_id % 97 = 0 then 5.0 else 0.5 end as ask,
  ((event_id * 17 + k * 29) % 100 + 1) / 10.0 * case when (event_id // 200) % 2 = 0 then 4.0 else 1.0 end as bs, ((event_id * 17 + k * 29) % 100 + 1) / 10.0 as az from dt, unnest(range(1, 6 + (event_id // 3) % 8)) u(k)),
bi as (select *, case when bid > 0 and ask >= bid then (ask - bid) / ((ask + bid) / 2) * 10000 else 0 end as bps, coalesce((bd - ad) / nullif(bd + ad, 0), 0) as imb, bd + ad as depth from
  (select venue, instrument, seq, ts, max(bid) as bid, min(ask) as ask, sum(bs) as bd, sum(az) as ad, count(*) as lv from bk group by all))"""
_SUM = "(sum({0})::bigint) / 1e8"


def _candles(tf: str, ms: int, src: str = "t", ts: str = "ts", seq: str = "seq") -> str:
    return f"""c0 as (select venue, instrument, {ts} - {ts} % {ms} as window_start, arg_min(p, {seq}) / 1e8 as open, max(p) / 1e8 as high, min(p) / 1e8 as low, arg_max(p, {seq}) / 1e8 as close, {_SUM.format('q')} as volume,
  {_SUM.format("case when side = 'buy' then q else 0 end")} as buy_volume, {_SUM.format("case when side = 'sell' then q else 0 end")} as sell_volume, count(*) as trade_count, min({seq}) as seq_first, max({seq}) as seq_last from {src} group by all),
c as (select *, '{tf}' as timeframe, window_start + {ms} as window_end, window_start < max(window_start) over (partition by venue, instrument) as is_closed from c0)"""


_OHLC = "round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume"
_H = _TR + ", " + _candles("1h", 3_600_000)


def _volume(ms: int) -> str:
    return f"v as (select venue, instrument, tx - tx % {ms} as window_start, {_SUM.format('q')} as total_volume, {_SUM.format(chr(99) + 'ase when side = ' + repr('buy') + ' then q else 0 end')} as buy_volume, {_SUM.format('case when side = ' + repr('sell') + ' then q else 0 end')} as sell_volume, count(*) as trade_count, sum(price * size) / sum(size) as vwap from t group by all)"


def _tape(ms: int) -> str:
    return f"""tp as (select venue, instrument, ts - ts % {ms} as window_start, count(*) as trade_count, count(*) filter (side = 'buy') as buy_count, count(*) filter (side = 'sell') as sell_count, coalesce(sum(q) filter (side = 'buy'), 0)::bigint / 1e8 as buy_volume, coalesce(sum(q) filter (side = 'sell'), 0)::bigint / 1e8 as sell_volume,
  {_SUM.format('q')} as total_volume, {_SUM.format('round_even(price * size * 1e8, 0)::bigint')} as notional, max(price) as max_price, min(price) as min_price, arg_max(price, seq) as last_price, max(size) as max_size from dt group by all)"""


_ST = _EV + """, m as (select venue, instrument, ms, round_even((100.0 + value) * 1e8, 0)::bigint as m, ((event_id * 13) % 201 - 100) / 1e6 as fr, row_number() over (partition by venue, instrument order by ms, event_id) as seq from ev where event_type = 'view'),
l as (select venue, instrument, ms, round_even(((event_id * 37) % 500 + 1) / 100.0 * 1e8, 0)::bigint as q, case when event_id % 2 = 0 then 'buy' else 'sell' end as side from ev where event_type = 'error'),
u as (select venue, instrument, ms, m, case when fr <> 0 then round_even(fr * 1e9, 0)::bigint end as f, seq, null::bigint as q, null::varchar as side from m union all select venue, instrument, ms, null, null, null, q, side from l)"""


def _stats(ms: int) -> str:
    return f"""st as (select venue, instrument, ms - ms % {ms} as window_start, sum(q)::bigint / 1e8 as liq_volume, (sum(q) filter (side = 'buy'))::bigint / 1e8 as liq_buy_volume, count(q) as liq_count, arg_min(m, seq) / 1e8 as mark_open, max(m) / 1e8 as mark_high, min(m) / 1e8 as mark_low, arg_max(m, seq) / 1e8 as mark_close, count(m) as mark_count, sum(f)::bigint as fs, count(f) as funding_count from u group by all)"""


_DIRTY = _TR + """, d0 as (select * replace (case when event_id % 101 = 0 then 0.0 else price end as price, case when event_id % 103 = 0 then 'hold' else side end as side, case when event_id % 53 = 0 then seq - 3 else seq end as seq) from t), dd as (select *, 0 as copy from d0 union all select *, 1 from d0 where event_id % 20 = 0)"""
_HC = _H + """, hot as (select venue, instrument, window_start, open, close, case when window_start < 1705795200000 then volume + 1 else volume end as volume from c where window_start >= 1705622400000), cold as (select venue, instrument, window_start, open, close, volume from c where window_start < 1705795200000)"""
_VP = _TR + """, n as (select *, price * 1.0 / 100 as n from t), f as (select *, case when pow(10, greatest(-8, ceil(log10(n) - 1e-12))) < n then pow(10, greatest(-8, ceil(log10(n) - 1e-12)) + 1) else pow(10, greatest(-8, ceil(log10(n) - 1e-12))) end as f from n),
b as (select *, round(coalesce(list_filter([f, 0.5 * f, 0.25 * f, 0.2 * f, 0.1 * f, 0.05 * f], lambda x: x <= n and abs(x / 0.01 - round(x / 0.01)) < 1e-9)[1], 0.05 * f), 8) as bin from f),
g as (select *, round(floor(price / bin) * bin, 8) as price_low, round(round(floor(price / bin) * bin, 8) + bin, 8) as price_high, ts - ts % 3600000 as window_start from b),
vp as (select venue, instrument, window_start, price_low, price_high, coalesce(sum(q) filter (side = 'buy'), 0)::bigint as bq, coalesce(sum(q) filter (side = 'sell'), 0)::bigint as sq, sum(q)::bigint as tq, min(seq) as seq_min, max(seq) as seq_max from g group by all)"""
_DP = _TR + """, dp as (select venue, instrument, ts - ts % 86400000 as window_start, floor(price / 5.0) * 5.0 as price_low, sum(q)::bigint as tq from t group by all)"""
_XV = _TR + """, lp as (select *, """ + ", ".join(f"last_value(case when venue = '{v}' then price end ignore nulls) over (partition by instrument order by ts, event_id rows unbounded preceding) as {v}" for v in ("BINANCE", "BYBIT", "COINBASE", "KRAKEN")) + """ from t),
xs as (select instrument, trade_id, venue, ts, list_filter([{'p': BINANCE, 'v': 'BINANCE'}, {'p': BYBIT, 'v': 'BYBIT'}, {'p': COINBASE, 'v': 'COINBASE'}, {'p': KRAKEN, 'v': 'KRAKEN'}], lambda x: x.p is not null) as k from lp),
xm as (select *, list_min(list_transform(k, lambda x: x.p)) as lo, list_max(list_transform(k, lambda x: x.p)) as hi from xs where len(k) >= 2),
x as (select instrument, trade_id, venue, ts as ts_ingest_ms, len(k)::bigint as venues, lo as min_price, list_filter(k, lambda x: x.p = lo)[1].v as min_venue, hi as max_price, list_filter(k, lambda x: x.p = hi)[1].v as max_venue, round(hi - lo, 8) as spread_abs, round((hi + lo) / 2, 8) as mid, round_even((hi - lo) / round((hi + lo) / 2, 8) * 10000, 4) as spread_bps from xm)"""
_LV = _TR + """, k as (select *, event_id % 50 = 0 as snap from t, unnest([1, 2, 3, 4]) u(k)),
lv as (
  select venue, instrument, seq, ts, snap, side, price, max(size) as size from (
    select venue, instrument, seq, ts, snap, 'bid' as side, (100 + (event_id * 7 + k * 3) % 40)::double as price,
      case when not snap and (event_id + k) % 7 = 0 then 0.0 else ((event_id * 17 + k * 29) % 100 + 1) / 10.0 end as size from k
    union all
    select venue, instrument, seq, ts, snap, 'ask', (141 + (event_id * 11 + k * 5) % 40)::double,
      case when not snap and (event_id + k) % 7 = 0 then 0.0 else ((event_id * 17 + k * 29) % 100 + 1) / 10.0 end from k) group by all)"""


def _book(bound: str) -> str:
    """The levels after all messages within the bound: from the last snapshot on, the last size of each price."""
    return _LV + f""", fr as (select venue, instrument, max(seq) as s0 from lv where snap and {bound} group by all),
bo as (
  select venue, instrument, side, price, arg_max(size, seq) as size, max(seq) as last_seq
  from lv left join fr using (venue, instrument) where {bound} and seq >= coalesce(s0, 0) group by all having arg_max(size, seq) > 0)"""


_BD = _book("true")
_LB = _BK + """, la as (select venue, instrument, max(seq) as seq from bi group by all), lb as (select bi.*, max(ts) over (partition by instrument) as now from bi join la using (venue, instrument, seq))"""



_POS = "po as (select o_custkey % 10 as account, ['BINANCE','BYBIT','COINBASE','KRAKEN'][o_orderkey % 4 + 1] as venue, ['BTCUSDT','ETHUSDT','SOLUSDT'][o_custkey % 3 + 1] as symbol, o_orderkey % 2 = 0 as long, 1.0::double + o_orderkey % 7 as qty, o_totalprice from orders)"
_REC = _TR + ", r as (select * from t where tx > (select max(tx) from t) - 86400000)"
_BIG = "t as (select *, round_even(price * 1e8, 0)::bigint as p, round_even(size * 1e8, 0)::bigint as q from (select ['BINANCE','BYBIT','COINBASE','KRAKEN'][l_suppkey % 4 + 1] as venue, ['BTCUSDT','ETHUSDT','SOLUSDT'][l_partkey % 3 + 1] as instrument, l_extendedprice / l_quantity as price, l_quantity as size, case when l_linenumber % 2 = 0 then 'buy' else 'sell' end as side, (epoch_us(l_shipdate) // 1000) + (l_orderkey * 7919 + l_linenumber * 104729) % 86400000 as ts, {'a': (epoch_us(l_shipdate) // 1000) + (l_orderkey * 7919 + l_linenumber * 104729) % 86400000, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey} as seq from lineitem))"
_TREND = _H + """, x as (select *, row_number() over w as x from c window w as (partition by venue, instrument order by window_start)),
tr2 as (select *, count(*) over w as n, regr_slope(close, x) over w / avg(close) over w as slope, first_value(close) over w as first from x window w as (partition by venue, instrument order by window_start rows between 19 preceding and current row)),
trend as (select venue, instrument, window_start, slope, (close - first) / first as move, case when abs(slope) >= 0.0015 and abs((close - first) / first) >= 0.006 then 'trending' else 'ranging' end as kind from tr2 where n = 20),
pv as (select *, lag(close) over w as pc from c window w as (partition by venue, instrument order by window_start)),
tr3 as (select *, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) as trg, count(*) over w14 as n14, (close - pc) / pc as mv, count(*) over w20 as n20, avg(volume) over w20 as mvol from pv window w14 as (partition by venue, instrument order by window_start rows between 13 preceding and current row), w20 as (partition by venue, instrument order by window_start rows between 20 preceding and 1 preceding)),
vol as (select venue, instrument, window_start, atr, case when atr / close >= 0.015 then 'high_volatility' when atr / close <= 0.004 then 'low_volatility' else 'normal' end as kind from (select *, avg(trg) over (partition by venue, instrument order by window_start rows between 13 preceding and current row) as atr from tr3) where n14 = 14),
brk as (select venue, instrument, window_start, mv as move, volume from tr3 where n20 = 20 and abs(mv) >= 0.0075 and volume >= 1.8 * mvol)"""
_ROLL64 = "window w as (partition by venue, instrument order by seq rows between 63 preceding and current row)"

SQL: dict[str, str] = {
    "trades_flat": f"with {_TR} select venue || ':' || instrument as partition_key, venue, instrument, trade_id, price, size, side, tx as ts_exchange_ms, ts as ts_ingest_ms, seq from t",
    "volume_stats_5m": f"with {_TR}, {_volume(300_000)} select venue, instrument, window_start, round(total_volume, 6) as total_volume, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, trade_count, round(vwap, 6) as vwap from v",
    "market_summary": f"with {_REC} select venue, instrument, count(*) as trade_count, round(sum(q)::bigint / 1e8, 4) as volume, round(coalesce(sum(q) filter (side = 'buy'), 0)::bigint / 1e8, 4) as buy_volume, round(100.0::double * coalesce(sum(q) filter (side = 'buy'), 0)::bigint / sum(q)::bigint, 4) as buy_pct, round(min(price), 4) as low, round(max(price), 4) as high, round(sum(price * size) / sum(size), 4) as vwap, max(tx) as latest_ms from r group by all",
    "v_candles": f"with {_H} select venue, instrument, window_start, round(open, 4) as open, round(high, 4) as high, round(low, 4) as low, round(close, 4) as close, round(volume, 4) as volume, trade_count, round(close - open, 4) as change, round((close - open) * 100 / open, 4) as change_pct from c",
    "v_volume_stats": f"with {_TR}, {_volume(3_600_000)} select venue, instrument, window_start, round(total_volume, 4) as total_volume, round(buy_volume * 100 / total_volume, 4) as buy_pct, round(sell_volume * 100 / total_volume, 4) as sell_pct, round((buy_volume - sell_volume) * 100 / total_volume, 4) as delta_pct, round(vwap, 4) as vwap from v",
    "v_cvd": f"with {_TR}, {_volume(300_000)} select venue, instrument, window_start, round(buy_volume - sell_volume, 6) as delta, round((sum(round_even((buy_volume - sell_volume) * 1e8, 0)::bigint) over (partition by venue, instrument order by window_start rows unbounded preceding))::bigint / 1e8, 6) as cvd from v",
    "v_ingestion_latency": f"with {_TR} select venue, instrument, trade_id, ts - tx as latency_ms from t where ts >= tx",
    "kpi_trades": f"with {_REC} select venue, count(*) as trades from r group by all",
    "kpi_volume": f"with {_REC} select instrument, round(sum(q)::bigint / 1e8, 6) as volume from r group by all",
    "kpi_active_instruments": f"with {_TR} select count(distinct venue || ':' || instrument) as active from t where tx > (select max(tx) from t) - 3600000",
    "kpi_buy_sell_ratio": f"with {_REC} select venue, round((sum(q) filter (side = 'buy'))::double / (sum(q) filter (side = 'sell'))::double, 6) as ratio from r group by all",
    "kpi_latency_p50": f"with {_TR} select round(quantile_cont(ts - tx, 0.5)::double, 6) as p50 from t",
    "volume_by_exchange": f"with {_TR} select venue, round(sum(q)::bigint / 1e8, 6) as volume, count(*) as trades from t group by all",
    "top_instruments": f"with {_TR} select venue, instrument, count(*) as trades, round(sum(q)::bigint / 1e8, 4) as volume, round(100.0::double * coalesce(sum(q) filter (side = 'buy'), 0)::bigint / sum(q)::bigint, 4) as buy_pct, round(sum(round_even(price * size * 1e8, 0)::bigint)::bigint / sum(q)::bigint, 4) as vwap from t group by all order by trades desc, venue, instrument limit 25",
    "hourly_volume": f"with {_H} select window_start, round(sum(round_even(volume * 1e8, 0)::bigint)::bigint / 1e8, 6) as volume, sum(trade_count)::bigint as trades from c group by all",
    "latency_percentiles": f"with {_TR} select venue, round(avg(ts - tx), 6) as avg_ms, round(quantile_cont(ts - tx, 0.5)::double, 6) as p50, round(quantile_cont((ts - tx)::double, 0.95), 6) as p95, round(quantile_cont((ts - tx)::double, 0.99), 6) as p99 from t group by all",
    "data_freshness": f"with {_TR}, a as (select max(ts) as now from t), f as (select venue, instrument, max(ts) as last_ms, max(now) - max(ts) as lag_ms, count(*) filter (ts > now - 86400000) as last_day from t, a group by all) select *, case when lag_ms < 30000 then 'flowing' when lag_ms < 3600000 then 'partial' when last_day > 0 then 'stale' else 'inactive' end as status from f",
    "op_candles_all_tf": f"with {_H}, x as (select * from (select '1h' as tf, 3600000 as d union all select '4h', 14400000 union all select '1d', 86400000), c where is_closed) select venue, instrument, tf as timeframe, (window_start - window_start % d)::bigint as window_start, arg_min(round(open, 6), x.window_start) as open, round(max(high), 6) as high, round(min(low), 6) as low, arg_max(round(close, 6), x.window_start) as close, round(sum(round_even(volume * 1e8, 0)::bigint)::bigint / 1e8, 6) as volume, sum(trade_count)::bigint as trade_count from x group by venue, instrument, tf, (x.window_start - x.window_start % d)",
    "rollup_1h_from_1m": f"with {_H} select venue, instrument, window_start, timeframe, window_end, {_OHLC}, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, trade_count, seq_first, seq_last, is_closed from c",
    "stats_1h": f"with {_ST}, {_stats(3_600_000)} select venue, instrument, window_start, round(liq_volume, 6) as liq_volume, round(liq_buy_volume, 6) as liq_buy_volume, liq_count, round(mark_open, 6) as mark_open, round(mark_high, 6) as mark_high, round(mark_low, 6) as mark_low, round(mark_close, 6) as mark_close, mark_count, funding_count from st",
    "funding_avg_1h": f"with {_ST}, {_stats(3_600_000)} select venue, instrument, window_start, funding_count, round((fs // funding_count) / 1e9, 9) as funding_avg from st where funding_count > 0",
    "quality_flags": f"with {_ST}, {_stats(14_400_000)} select venue, instrument, window_start, ((mark_count = 0)::int + 2 * (funding_count = 0)::int + 4 * (liq_count = 0)::int)::bigint as quality_flags from st",
    "tape_5s": f"with {_DE}, {_tape(5000)} select venue, instrument, window_start, trade_count, buy_count, sell_count, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, round(total_volume, 6) as total_volume, round(notional, 6) as notional, round(max_price, 6) as max_price, round(min_price, 6) as min_price, round(last_price, 6) as last_price, round(max_size, 6) as max_size, round(notional / total_volume, 6) as vwap, round(trade_count * 1000.0::double / 5000, 6) as rate, round((buy_volume - sell_volume) / (buy_volume + sell_volume), 6) as imbalance, trade_count > 3 as is_burst from tp",
    "burst_windows": f"with {_DE}, {_tape(1000)} select venue, instrument, window_start, trade_count from tp where trade_count > 1",
    "delta_volume_5s": f"with {_DE}, {_tape(5000)} select venue, instrument, window_start, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, round(buy_volume - sell_volume, 6) as delta, trade_count from tp",
    "cvd_5s": f"with {_DE}, {_tape(5000)} select venue, instrument, window_start, round((sum(round_even((buy_volume - sell_volume) * 1e8, 0)::bigint) over (partition by venue, instrument order by window_start rows unbounded preceding))::bigint / 1e8, 6) as cvd from tp",
    "bar_stats_5s": f"with {_DE}, {_tape(5000)} select venue, instrument, window_start, trade_count, round(total_volume, 6) as total_volume, round(total_volume / trade_count, 6) as avg_size, round(notional / total_volume, 6) as vwap, round(max_size, 6) as max_size, round(max_price - min_price, 6) as range from tp",
    "oi_delta": f"with {_EV}, o as (select *, 1000.0::double + value * 10 as oi, row_number() over (partition by venue, instrument order by ms, event_id) as seq from ev where event_type = 'signup'), p as (select *, lag(oi) over (partition by venue, instrument order by seq) as b from o) select venue, instrument, seq, round(oi, 6) as open_interest, round(coalesce(oi - b, 0), 6) as delta, round(case when b > 0 then (oi - b) / b else 0 end, 6) as delta_pct from p",
    "oi_cadence": f"with {_EV}, o as (select *, row_number() over (partition by venue, instrument order by ms, event_id) as seq from ev where event_type = 'signup'), p as (select *, list(ms) over (partition by venue, instrument order by seq rows between 9 preceding and current row) as a from o), g as (select *, list_sort(list_filter(list_transform(range(2, len(a) + 1), lambda i: a[i] - a[i - 1]), lambda x: x > 0)) as g from p), c as (select *, case when len(g) > 0 then (g[(len(g) - 1) // 2 + 1] + g[len(g) // 2 + 1]) // 2 else 0 end::bigint as cadence_ms from g) select venue, instrument, seq, cadence_ms, case when len(g) = 0 then 'low' when cadence_ms < 5000 then 'high' when cadence_ms < 30000 then 'medium' else 'low' end as confidence from c",
    "seq_audit": f"with {_DIRTY}, a as (select *, max({{'s': seq, 't': ts}}) over (partition by venue, instrument order by ts, event_id rows between unbounded preceding and 1 preceding) as top from dd where copy = 0) select venue, instrument, case when seq < 0 then 'seq_invalid' when top is null or seq > top.s then 'accept' when seq = top.s then 'replay_duplicate' when ts < top.t or top.s - seq <= 2048 then 'stale_event' else 'seq_non_monotonic' end as verdict, count(*) as rows from a group by all",
    "dedup_trades": f"with {_DIRTY} select venue, instrument, count(*) as rows, sum(seq)::bigint as seq_sum from dd where copy = 0 group by all",
    "candle_gaps": f"with {_H}, n as (select venue, instrument, window_start, lead(window_start) over (partition by venue, instrument order by window_start) as nx from c) select venue, instrument, window_start + 3600000 as gap_start, nx as gap_end, (nx - window_start) // 3600000 - 1 as missing from n where nx > window_start + 3600000",
    "invalid_ticks": f"with {_DIRTY} select venue, instrument, case when price <= 0 then 'non_positive_price' else 'bad_side' end as reason, count(*) as rows from dd where price <= 0 or side not in ('buy', 'sell') group by all",
    "rule_violations": f"with {_DIRTY}, v as (select trade_id, concat_ws(',', case when event_id % 11 = 0 then 'required:id' end, case when event_id % 7 = 0 then 'not_empty:venue' end, case when side <> 'buy' then 'equals:side' end) as violations from dd where copy = 0) select trade_id, case when violations = '' then 'passed' else 'failed' end as status, violations from v",
    "drift_report": f"with {_HC}, j as (select coalesce(hot.venue, cold.venue) as venue, coalesce(hot.instrument, cold.instrument) as instrument, coalesce(hot.window_start, cold.window_start) as window_start, trunc(hot.volume * 100)::bigint::varchar as a, trunc(cold.volume * 100)::bigint::varchar as b from hot full join cold on hot.venue = cold.venue and hot.instrument = cold.instrument and hot.window_start = cold.window_start) select venue, instrument, window_start, case when a is null then 'new' when b is null then 'dropped' else 'mismatch' end as kind, case when a is not null and b is not null then 'v' end as field, case when b is not null then a end as expected, case when a is not null then b end as actual from j where a is distinct from b",
    "consistency_report": f"with {_HC}, j as (select coalesce(hot.venue, cold.venue) as venue, coalesce(hot.instrument, cold.instrument) as instrument, coalesce(hot.window_start, cold.window_start) as w, hot.window_start as h, cold.window_start as k from hot full join cold on hot.venue = cold.venue and hot.instrument = cold.instrument and hot.window_start = cold.window_start) select venue, instrument, count(h) as hot_count, count(k) as cold_count, count(*) filter (h is not null and k is not null) as overlap, count(*) filter (h is null) as missing_hot, count(*) filter (k is null) as missing_cold, min(w) as first_ts, max(w) as last_ts from j group by all",
    "federated_candles": f"with {_HC} select venue, instrument, window_start, round(open, 6) as open, round(close, 6) as close, round(volume, 6) as volume from (select * from hot union all select * from cold c2 where not exists (select 1 from hot h where h.venue = c2.venue and h.instrument = c2.instrument and h.window_start = c2.window_start))",
    "first_last_candle": f"with {_H} select venue, instrument, min(window_start) as first_start, round(arg_min(open, window_start), 6) as first_open, max(window_start) as last_start, round(arg_max(close, window_start), 6) as last_close from c group by all",
    "range_tail": f"with {_H} select venue, instrument, window_start, round(close, 6) as close from c where window_start between 1705276800000 and 1706140800000 order by window_start desc, venue, instrument limit 1000",
    "retention_filter": f"with {_H} select venue, instrument, window_start, round(volume, 6) as volume from c where window_start >= (select max(window_start) from c) - 1209600000",
    "profile_upsert_merge": f"with {_VP}, s as (select venue, instrument, window_start, price_low, sum(bq)::bigint as bq, sum(sq)::bigint as sq, min(seq_min) as seq_min, max(seq_max) as seq_max from vp group by all) select venue, instrument, window_start, round(price_low, 6) as price_low, round(2 * bq / 1e8, 6) as buy_volume, round(2 * sq / 1e8, 6) as sell_volume, seq_min, seq_max from s",
    "vpvr_1h": f"with {_VP} select venue, instrument, window_start, round(price_low, 6) as price_low, round(price_high, 6) as price_high, round(bq / 1e8, 6) as buy_volume, round(sq / 1e8, 6) as sell_volume, round(tq / 1e8, 6) as total_volume, seq_min, seq_max from vp",
    "vpvr_poc": f"with {_VP} select venue, instrument, window_start, round(arg_max(price_low, {{'a': tq, 'b': -price_low}}), 6) as poc, round(min(price_low), 6) as low, round(max(price_high), 6) as high, round(sum(tq)::bigint / 1e8, 6) as volume, count(*) as buckets from vp group by all",
    "vpvr_compressed": f"with {_DP}, k as (select *, row_number() over (partition by venue, instrument, window_start order by tq desc, price_low) as k, count(*) over (partition by venue, instrument, window_start) as n from dp) select venue, instrument, window_start, round(price_low, 6) as price_low, round(tq / 1e8, 6) as total_volume from k where k <= ceil(n * 0.5)",
    "heatmap_1h": f"with {_BK}, u as (select venue, instrument, ts, seq, 'bid' as kind, bid as price, bs as size from bk where k <= 8 union all select venue, instrument, ts, seq, 'ask', ask, az from bk where k <= 8 union all select venue, instrument, ts, seq, 'trade', price, size from dt), g as (select venue, instrument, ts - ts % 60000 as window_start, floor(price / 2.0) * 2.0 as price_low, case when size < 0.25 then 'XS' when size < 1 then 'S' when size < 5 then 'M' when size < 20 then 'L' else 'XL' end as size_class, kind, round_even(size * 1e8, 0)::bigint as q, seq from u) select venue, instrument, window_start, round(price_low, 6) as price_low, size_class, round(coalesce(sum(q) filter (kind = 'bid'), 0)::bigint / 1e8, 6) as bid_liquidity, round(coalesce(sum(q) filter (kind = 'ask'), 0)::bigint / 1e8, 6) as ask_liquidity, round(coalesce(sum(q) filter (kind = 'trade'), 0)::bigint / 1e8, 6) as trade_volume, count(*) as samples, min(seq) as seq_min, max(seq) as seq_max from g group by all",
    "session_vp": f"with {_H}, l as (select *, floor((high + low + 2 * close) / 4 / 5.0) * 5.0 as price_low, date_trunc('day', make_timestamp(window_start * 1000) - interval 6 hours - interval 510 minutes) + interval 510 minutes + interval 6 hours as ss from c) select venue, instrument, epoch_ms(ss) as session_start, round(price_low, 6) as price_low, round(sum(round_even(volume * 1e8, 0)::bigint)::bigint / 1e8, 6) as total_volume, count(*) as candles, round(price_low + 5.0, 6) as price_high from l group by venue, instrument, ss, price_low",
    "footprint_1h": f"with {_TR} select venue, instrument, ts - ts % 3600000 as window_start, round(floor(price / 5.0) * 5.0, 6) as price_low, round(coalesce(sum(q) filter (side = 'buy'), 0)::bigint / 1e8, 6) as buy_volume, round(coalesce(sum(q) filter (side = 'sell'), 0)::bigint / 1e8, 6) as sell_volume, count(*) as trade_count from t group by all",
    "dom_fills": f"with {_TR}, g as (select venue, instrument, floor(price / 10.0) * 10.0 as price_low, coalesce(sum(q) filter (side = 'buy'), 0)::bigint / 1e8 as b, coalesce(sum(q) filter (side = 'sell'), 0)::bigint / 1e8 as s, sum(round_even(price * size * 1e8, 0)::bigint)::bigint / sum(q)::bigint as vwap, sum(p)::bigint / 1e8 / count(*) as twap from t group by all) select venue, instrument, round(price_low, 6) as price_low, round(b, 6) as buy_volume, round(s, 6) as sell_volume, round(vwap, 6) as vwap, round(twap, 6) as twap, round(coalesce((b - s) / nullif(b + s, 0), 0), 6) as imbalance from g",
    "cross_venue_snapshot": f"with {_XV} select * replace (round(min_price, 4) as min_price, round(max_price, 4) as max_price, round(spread_abs, 4) as spread_abs, round(mid, 4) as mid, round(spread_bps, 4) as spread_bps) from x",
    "spread_signal": f"with {_XV} select instrument, trade_id, venues, round(spread_abs, 4) as spread_abs, round(spread_bps, 4) as spread_bps from x where venues >= 3 and spread_bps >= 2000",
    "cross_venue_book": f"with {_LB}, f as (select * from lb where now - ts <= 60000 and bid > 0 and ask > 0), g as (select instrument, count(*) as venues, max(bid) as best_bid, min(ask) as best_ask, arg_min(venue, {{'a': -bid, 'b': venue}}) as bid_venue, arg_min(venue, {{'a': ask, 'b': venue}}) as ask_venue, max(bps) - min(bps) as divergence_bps from f group by all) select instrument, venues, round(best_bid, 6) as best_bid, round(best_ask, 6) as best_ask, bid_venue, ask_venue, round(divergence_bps, 6) as divergence_bps, round(case when best_bid > 0 and best_ask >= best_bid then (best_ask - best_bid) / ((best_ask + best_bid) / 2) * 10000 else 0 end, 6) as spread_bps from g",
    "fused_depth": f"with {_LB}, f as (select bk.* from bk join lb using (venue, instrument, seq) where now - lb.ts <= 600000), u as (select instrument, venue, 'bid' as side, round_even(bid * 1e8, 0)::bigint as p, round_even(bs * 1e8, 0)::bigint as q from f union all select instrument, venue, 'ask', round_even(ask * 1e8, 0)::bigint, round_even(az * 1e8, 0)::bigint from f), g as (select instrument, side, p, sum(q)::bigint as q, array_to_string(list_sort(list(distinct venue)), ',') as venues from u group by all), k as (select *, row_number() over (partition by instrument, side order by case when side = 'bid' then -p else p end) as rank from g) select instrument, side, rank, round(p / 1e8, 6) as price, round(q / 1e8, 6) as size, venues from k where rank <= 50",
    "fused_vp_value_area": f"with {_DP}, f as (select instrument, window_start, price_low, sum(tq)::bigint as tq from dp group by all), k as (select *, coalesce(sum(tq) over (partition by instrument, window_start order by tq desc, price_low rows between unbounded preceding and 1 preceding), 0) as before, sum(tq) over (partition by instrument, window_start) as total from f) select instrument, window_start, round(min(price_low), 6) as va_low, round(max(price_low + 5.0), 6) as va_high, count(*) as va_buckets from k where before < total * 0.7 group by all",
    "book_as_of": f"with {_book('ts <= 1705708800000')} select venue, instrument, side, price, round(size, 6) as size, last_seq from bo",
    "grouped_book": f"with {_BD}, g as (select venue, instrument, side, floor(price / 5.0) * 5.0 as group_price, sum(round_even(size * 1e8, 0)::bigint)::bigint as q, count(*) as levels from bo group by all) select venue, instrument, side, group_price, round(q / 1e8, 6) as size, levels, row_number() over w as rank, round((sum(q) over w)::bigint / 1e8, 6) as cumulative from g window w as (partition by venue, instrument, side order by case when side = 'bid' then -group_price else group_price end rows unbounded preceding)",
    "regime_trend": f"with {_TREND} select venue, instrument, window_start, round(slope, 6) as slope, round(move, 6) as move, kind from trend",
    "regime_volatility": f"with {_TREND} select venue, instrument, window_start, round(atr, 6) as atr, kind from vol",
    "regime_breakout": f"with {_TREND} select venue, instrument, window_start, round(move, 6) as move, round(volume, 6) as volume from brk",
    "regime_arbitrated": f"with {_TREND}, a as (select v.venue, v.instrument, v.window_start, case when b.window_start is not null then 'breakout' when t.kind = 'trending' then 'trending' else v.kind end as kind from vol v left join trend t using (venue, instrument, window_start) left join brk b using (venue, instrument, window_start)) select *, coalesce(lag(kind) over (partition by venue, instrument order by window_start) <> kind, false) as transition from a",
    "ev_spread_explosion": f"with {_BK}, r as (select *, count(*) over w as n, (bps - avg(bps) over w) as d, stddev_pop(bps) over w as sd from bi {_ROLL64}), z as (select *, case when sd > 1e-9 then d / sd else 0 end as z from r) select venue, instrument, seq, round(bps, 4) as spread_bps, round(z, 4) as z, case when least(0.99, 0.5 + z / 10) >= 0.95 then 'critical' when 0.5 + z / 10 >= 0.85 then 'high' when 0.5 + z / 10 >= 0.7 then 'medium' else 'low' end as severity from z where n >= 10 and z > 2.5 and bps > 10",
    "ev_thinning": f"with {_BK}, r as (select *, count(*) over w as n, avg(depth) over w as mean, stddev_pop(depth) over w as sd from bi {_ROLL64}) select venue, instrument, seq, round(depth, 4) as depth, round(1 - depth / mean, 4) as drop_share from r where n >= 10 and sd > 1e-9 and (depth - mean) / sd <= -2 and depth <= mean * 0.7",
    "ev_imbalance_streak": f"with {_BK}, s as (select *, case when imb >= 0.3 then 1 when imb <= -0.3 then -1 else 0 end as sign from bi), i as (select *, seq - row_number() over (partition by venue, instrument, sign order by seq) as isl from s) select venue, instrument, sign::bigint as sign, count(*) as length, min(seq) as seq_start, max(seq) as seq_end from i where sign <> 0 group by venue, instrument, sign, isl having count(*) >= 10",
    "ev_sweep": f"with {_BK}, r as (select *, lag(lv) over w - lv as lost, lag(bd) over w as pb, lag(ad) over w as pa from bi window w as (partition by venue, instrument order by seq)), h as (select *, case when lost >= 5 and pb > 0 and bd <= pb * (1 - 0.4::double) then 'bid' when lost >= 5 and pa > 0 and ad <= pa * (1 - 0.4::double) then 'ask' end as side from r) select venue, instrument, seq, side, round(bd, 4) as bid_depth, round(ad, 4) as ask_depth from h where side is not null",
    "symbol_exposure": f"with {_POS} select account, symbol, sum(case when long then qty else -qty end) as net_qty, sum(round_even(o_totalprice * 100, 0)::bigint)::bigint as gross_cents, count(distinct venue) as venues from po group by all",
    "exposure_divergence": f"with {_POS}, v as (select account, symbol, venue, count(*) filter (long) as l, count(*) filter (not long) as s from po group by all) select account, symbol, count(*) filter (l > s) as long_venues, count(*) filter (l < s) as short_venues from v group by all having count(*) filter (l > s) > 0 and count(*) filter (l < s) > 0",
    "slo_burn": f"with {_EV}, g as (select venue, ms - ms % 3600000 as hour, count(*) as total, count(*) filter (event_type = 'error') as errors from ev group by all), b as (select *, errors / (total * 0.01::double) as b1, sum(errors) over w::double / (sum(total) over w * 0.01::double) as b6 from g window w as (partition by venue order by hour range between 18000000 preceding and current row)) select venue, hour, total, errors, round(b1, 6) as burn_1h, round(b6, 6) as burn_6h, b1 > 14.4 and b6 > 6 as breach from b",
    "coverage_matrix": f"with {_EV} select venue, instrument, count(*) filter (event_type = 'view') as n_view, count(*) filter (event_type = 'error') as n_error, count(*) filter (event_type = 'signup') as n_signup from ev group by all",
    "subscription_match": f"with {_EV}, f(filter_id, fv, fi, fe) as (values (1::bigint, 'BINANCE', '', ''), (2, '', 'BTCUSDT', 'error'), (3, 'KRAKEN', 'ETHUSDT', ''), (4, '', '', 'signup')) select filter_id, venue, instrument, count(*) as events, max(ms) as latest_ms from ev, f where (fv = '' or fv = venue) and (fi = '' or fi = instrument) and (fe = '' or fe = event_type) group by all",
    "subjects": f"with {_TR} select 'trade/' || venue || '/' || instrument || '/raw' as subject, count(*) as rows, max((price > 400)::int + 2 * (size > 4)::int)::bigint as max_flags from t group by all",
    "envelopes": f"with {_TR} select venue, instrument, count(*) filter (event_id % 211 <> 0) as good, (sum(p) filter (event_id % 211 <> 0))::bigint as price_fp, count(*) filter (event_id % 211 = 0) as quarantined from t group by all",
    "candles_big_1d": f"with {_BIG}, {_candles('1d', 86_400_000)} select venue, instrument, window_start, timeframe, window_end, {_OHLC}, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, trade_count, is_closed from c",
}
for _tf, _ms in (("1m", 60_000), ("5m", 300_000), ("15m", 900_000), ("1h", 3_600_000)):
    SQL[f"candles_{_tf}"] = f"with {_TR}, {_candles(_tf, _ms)} select venue, instrument, window_start, timeframe, window_end, {_OHLC}, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, trade_count, is_closed from c"

SQL["fused_heatmap"] = SQL["heatmap_1h"].replace("select venue, instrument, window_start, round(price_low, 6)", "select instrument, window_start, round(price_low, 6)").replace("count(*) as samples, min(seq) as seq_min, max(seq) as seq_max", "count(*) as samples, count(distinct venue) as venues")
SQL["trade_size_class"] = f"with {_TR}, a as (select *, (q * count(q) over w)::hugeint as x, sum(q) over w as y from t window w as (partition by venue, instrument order by seq rows between 17 preceding and current row)) select venue, instrument, case when y <= 0 then 'medium' when x * 20 < y then 'dust' when x * 2 < y then 'small' when x >= y * 10 then 'whale' when x >= y * 3 then 'large' else 'medium' end as size_class, count(*) as trades, max(seq) as last_seq from a group by all"
SQL["venue_trades"] = f"with {_TR} select ['BINANCE','BYBIT','COINBASE','HYPERLIQUID','KRAKEN','KRAKENF'][event_id % 6 + 1] as venue, case when event_id % 6 < 2 then instrument else replace(instrument, 'USDT', 'USD') end as instrument, trade_id, price, size, side, tx as ts_exchange_ms from t"
SQL["book_states"] = f"""with {_BD}, mq as (select venue, instrument, seq, max(snap::int) as sn from lv group by all), ms as (select venue, instrument, seq, sum(sn) over (partition by venue, instrument order by seq) as ep from mq),
le as (select lv.*, ep from lv join ms using (venue, instrument, seq)), st as (select m.venue, m.instrument, m.seq, l.side, l.price, arg_max(l.size, l.seq) as size from ms m join le l on l.venue = m.venue and l.instrument = m.instrument and l.ep = m.ep and l.seq <= m.seq group by all),
ag as (select venue, instrument, seq, max(price) filter (side = 'bid' and size > 0) as b, min(price) filter (side = 'ask' and size > 0) as a, count(*) filter (side = 'bid' and size > 0) as nb, count(*) filter (side = 'ask' and size > 0) as na from st group by all)
select venue, instrument, seq, 'ok' as status, round(b, 4) as best_bid, round(a, 4) as best_ask, round(case when b is null or a is null then -1 else (a - b) / ((a + b) / 2) * 10000 end, 4) as spread_bps, nb as bid_levels, na as ask_levels from ag"""
_CELLS = SQL["heatmap_1h"].replace("% 60000", "% 300000")
_CUT = _CELLS.rindex(") select ") + 1
_TIMES = [1, 2, 4, 8, 16, 32, 64]
SQL["heatmap_coarse"] = f"""{_CELLS[:_CUT]}, h as ({_CELLS[_CUT:]}), cn as (select venue, instrument, window_start, {", ".join(f"count(distinct floor(price_low / {2.0 * m})) as n{m}" for m in _TIMES)} from h group by all),
ch as (select venue, instrument, window_start, case {" ".join(f"when n{m} <= 24 then {m}" for m in _TIMES)} else 64 end::bigint as times from cn),
re as (select venue, instrument, window_start, times, floor(price_low / (2.0 * times)::double) * (2.0 * times)::double as price_low, size_class, sum(bid_liquidity * 100)::bigint as b, sum(ask_liquidity * 100)::bigint as a, sum(trade_volume * 100)::bigint as v, sum(samples)::bigint as samples, min(seq_min) as seq_min, max(seq_max) as seq_max from h join ch using (venue, instrument, window_start) group by all),
rk as (select *, row_number() over (partition by venue, instrument, window_start order by b + a + v desc, price_low, size_class) as k from re) select venue, instrument, window_start, times, round(price_low, 6) as price_low, size_class, round(b / 100.0, 6)::double as bid_liquidity, round(a / 100.0, 6)::double as ask_liquidity, round(v / 100.0, 6)::double as trade_volume, samples, seq_min, seq_max from rk where k <= 60"""
SQL["display_groups"] = f"with {_TR}, g as (select venue, price, case when venue in ('BINANCE', 'BYBIT') then case when price < 1000 then 1.0 else 10.0 end when venue = 'COINBASE' then 0.01 else pow(10, floor(log10(price * 0.0001))) end::double as group_size from t) select venue, round(group_size, 6) as group_size, count(*) as trades, round(max(price), 6) as max_price from g group by all"
SQL["ev_spread_regime"] = f"""with {_BK}, r as (select *, row_number() over o as n, (bps - avg(bps) over w) as d, stddev_pop(bps) over w as sd, case when bps < 5 then 'TIGHT' when bps <= 20 then 'NORMAL' when bps <= 50 then 'WIDE' else 'BLOWN' end as regime from bi where bps > 0 {_ROLL64}, o as (partition by venue, instrument order by seq)),
z as (select *, case when n = 10 then first_value(regime) over o else lag(regime) over o end as before from r window o as (partition by venue, instrument order by seq)) select venue, instrument, seq, round(bps, 4) as spread_bps, before, regime, case regime when 'BLOWN' then 0.95::double when 'WIDE' then 0.85::double else 0.6::double end as confidence from z where n >= 10 and sd > 1e-9 and d / sd >= 2.5 and bps > 10 and before <> regime"""
SQL["ev_tape_absorption"] = f"""with {_BK}, {_tape(5000)}, tq as (select venue, instrument, ts - ts % 5000 as window_start, max(seq) as seq from dt group by all), tv as (select venue, instrument, window_start, seq, total_volume, row_number() over o as n, avg(total_volume) over w as mean from tp join tq using (venue, instrument, window_start) {_ROLL64}, o as (partition by venue, instrument order by seq)),
sp as (select venue, instrument, seq, bps from bi where bps > 0) select tv.venue, tv.instrument, tv.seq, window_start, round(total_volume, 4) as total_volume, round(bps, 4) as spread_bps, round(total_volume / mean, 4) as volume_ratio from tv asof join sp on tv.venue = sp.venue and tv.instrument = sp.instrument and tv.seq >= sp.seq where n >= 10 and bps <= 50 and total_volume / mean >= 2"""
_O = "(partition by venue, instrument order by window_start"
SQL["ind_moving"] = f"with {_H}, m as (select venue, instrument, window_start, count(*) over w as n, avg(close) over w as sma, stddev_pop(close) over w as sd, sum((high + low + close) / 3 * volume) over dy / sum(volume) over dy as vwap from c window w as {_O} rows 19 preceding), dy as (partition by venue, instrument, window_start - window_start % 86400000 order by window_start rows unbounded preceding)) select venue, instrument, window_start, round(sma, 4) as sma, round(sma + 2 * sd, 4) as upper, round(sma - 2 * sd, 4) as lower, round(vwap, 4) as vwap from m where n = 20"
SQL["ind_rsi"] = f"with {_H}, m as (select *, close - lag(close) over {_O}) as mv from c), r as (select venue, instrument, window_start, count(mv) over w as n, sum(greatest(mv, 0)) over w as up, sum(abs(mv)) over w as total from m window w as {_O} rows 13 preceding)) select venue, instrument, window_start, round(coalesce(up * 100 / nullif(total, 0), 50), 4) as rsi from r where n = 14"


def _ema(x: str, n: int) -> str:
    stay = repr(1 - 2 / (n + 1))
    return f"list_sum(list_transform({x}, lambda y, i: y * pow({stay}, len({x}) - i))) / list_sum(list_transform({x}, lambda y, i: pow({stay}, len({x}) - i)))"


SQL["ind_macd"] = f"with {_H}, l as (select venue, instrument, window_start, list(close) over {_O} rows 95 preceding) as f, list(close) over {_O} rows 207 preceding) as s from c), m as (select venue, instrument, window_start, {_ema('f', 12)} - {_ema('s', 26)} as macd from l), g as (select *, list(macd) over {_O} rows 71 preceding) as ml from m), h as (select *, {_ema('ml', 9)} as sig from g) select venue, instrument, window_start, round(macd, 4) as macd, round(sig, 4) as signal, round(macd - sig, 4) as histogram from h"
SQL["ind_heikin_ashi"] = f"""with recursive {_H}, n as (select *, row_number() over {_O}) as k, (open + high + low + close) / 4 as hc from c),
ha as (select venue, instrument, k, window_start, high, low, hc, (open + close) / 2 as ho from n where k = 1 union all select n.venue, n.instrument, n.k, n.window_start, n.high, n.low, n.hc, (ha.ho + ha.hc) / 2 from ha join n on n.venue = ha.venue and n.instrument = ha.instrument and n.k = ha.k + 1)
, fin as (select * from ha) select venue, instrument, window_start, round(ho, 4) as ha_open, round(greatest(high, ho, hc), 4) as ha_high, round(least(low, ho, hc), 4) as ha_low, round(hc, 4) as ha_close from fin"""

SQL["event_categories"] = f"with {_EV} select case event_type when 'view' then 'delta' when 'click' then 'snapshot' when 'error' then 'close_final' when 'purchase' then 'telemetry' else 'unknown' end as category, venue, count(*) as events from ev group by all"
SQL["envelope_audit"] = f"""with {_TR}, e as (select *, case when event_id % 107 = 0 then 'venue' when event_id % 109 = 0 then 'ts_ingest' when event_id % 113 = 0 then 'idempotency_key' else '' end as field from t),
q as (select *, case when field <> '' then 'validation_failed' when event_id % 101 = 0 then 'unknown_event_type' when event_id % 103 = 0 then 'unknown_event_version' when event_id % 127 = 0 then 'decode_failed' end as reason, field || case when event_id % 101 = 0 then ' marketdata.quote ' else ' marketdata.trade ' end || case when event_id % 103 = 0 then '2' else '1' end as error from e)
select instrument, reason, error, count(*) as rows, min(seq) as first_seq from q where reason is not null group by all"""
SQL["candle_audit"] = f"""with {_H}, b as (select venue, instrument, case when (window_start // 3600000) % 7 = 0 then ['high', 'low'] else [] end || case when (window_start // 3600000) % 11 = 0 then ['volume'] else [] end as rs from c), u as (select venue, instrument, unnest(rs) as rule from b) select venue, instrument, rule, count(*) as candles from u group by all"""
SQL["tape_audit"] = f"with {_DE}, w as (select distinct venue, instrument, ts - ts % 5000 as window_start from dt) select venue, instrument, 'counts' as rule, count(*) as windows from w where (window_start // 5000) % 5 = 0 group by all"
SQL["run_digest"] = f"with {_TR} select count(*) as rows, sum(('0x' || substr(md5(venue || '|' || instrument || '|' || seq || '|' || trade_id || '|' || ts), 1, 8))::bigint)::bigint as digest from t"
SQL["latest_versions"] = f"with {_H} select venue, instrument, window_start, round(case when window_start % 10800000 = 0 then close + 1 else close end, 6) as close, case when window_start % 10800000 = 0 then 2 else 1 end::bigint as version from c"
SQL["strict_order"] = f"with {_TR}, l as (select venue, instrument, tx - tx % 60000 as w, max(tx - tx % 60000) over (partition by venue, instrument order by event_id rows between unbounded preceding and 1 preceding) as top from t) select venue, instrument, count(*) as trades, count(*) filter (top > w) as late from l group by all"
SQL["catch_up"] = f"with {_TR}, l as (select *, max(ts) over (partition by venue, instrument order by event_id rows unbounded preceding) as top from t) select venue, instrument, count(*) as trades, max(trade_id) as last_id from l where top - ts <= 3600000 group by all"
SQL["content_keys"] = f"with {_EV}, l as (select *, row_number() over (partition by venue, instrument order by ms, event_id) as seq from ev where event_type = 'error'), k as (select venue, instrument, seq, case when event_id % 2 = 0 then event_id::varchar else sha256('sell|' || ms) end as dedup_key from l) select venue, instrument, dedup_key, min(seq) as seq, 2 * count(*) as copies from k group by all"
SQL["backfill_assembled"] = f"with {_TR} select venue, instrument, row_number() over (partition by venue, instrument order by tx, trade_id) as seq, trade_id, tx as ts_ingest_ms, venue || ':' || instrument || ':' || trade_id as idempotency_key from t"
SQL["event_range_newest"] = f"with {_TR} select 'trade/' || venue || '/' || instrument || '/raw' as subject, seq, trade_id, ts as ts_ingest_ms from t where ts <= 1705708800000 qualify row_number() over (partition by venue, instrument order by ts desc, seq desc) <= 5"
SQL["vpvr_changes"] = f"with {_TR}, b as (select *, floor(price / 5.0) * 5.0 as pl, ts - ts % 86400000 as ws from t) select venue, instrument, ws as window_start, round(pl, 6) as price_low, seq, round(sum(case when side = 'buy' then q else 0 end) over w::bigint / 1e8, 6) as buy_volume, round(sum(case when side = 'sell' then q else 0 end) over w::bigint / 1e8, 6) as sell_volume, round(sum(q) over w::bigint / 1e8, 6) as total_volume from b window w as (partition by venue, instrument, ws, pl order by seq rows unbounded preceding)"
SQL["bar_counter"] = f"with {_H}, b as (select venue, instrument, window_start, sum(round_even(volume * 1e8, 0)::bigint) over w as v, sum(trade_count) over w::bigint as trades, sum(round_even(buy_volume * 1e8, 0)::bigint) over w as bv from c window w as (partition by venue, instrument order by window_start rows 19 preceding)) select venue, instrument, window_start, round(v::bigint / 1e8, 4) as volume, trades, round(bv::bigint * 100.0::double / v::bigint, 4) as buy_pct from b"
SQL["thinned_candles"] = f"with {_H}, k as (select *, row_number() over (partition by venue, instrument order by window_start) as k from c) select venue, instrument, window_start, round(close, 6) as close from k where k % 3 = 0 or window_start % 86400000 = 0"
SQL["reject_reasons"] = f"with {_DIRTY} select venue, case when price <= 0 then 'non_positive_price' else 'bad_side' end as reason, count(*) as rows from dd where price <= 0 or side not in ('buy', 'sell') group by all order by rows desc, venue, reason limit 10"
SQL["capped_books"] = f"""with {_BD}, r as (select *, row_number() over (partition by venue, instrument, side order by case when side = 'bid' then -price else price end) as k from bo),
g as (select venue, instrument, string_agg(price::bigint::varchar, ',' order by k) filter (side = 'bid' and k <= 3) as bids, string_agg(price::bigint::varchar, ',' order by k) filter (side = 'ask' and k <= 3) as asks, count(*) filter (side = 'bid') as bid_levels, count(*) filter (side = 'ask') as ask_levels, max(price) filter (side = 'bid') as b, min(price) filter (side = 'ask') as a from r group by all) select venue, instrument, coalesce(bids, '') as bids, coalesce(asks, '') as asks, bid_levels, ask_levels, round(coalesce((a - b) / ((a + b) / 2) * 10000, -1), 4) as spread_bps from g"""
SQL["throttled_books"] = f"with {_DE} select venue, instrument, ts - ts % 10000 as interval_start, max(seq) as seq, max(ts) as ts_ingest_ms from dt group by all"
SQL["newest_evidence"] = f"select venue, instrument, seq, side from ({SQL['ev_sweep']}) qualify row_number() over (partition by venue, instrument order by seq desc) <= 3"

SQL["precise_trades"] = f"with {_TR}, p as (select venue, instrument, trade_id, case when instrument = 'SOLUSDT' then round(price / 7, 3) else round(price / 7, 2) end as price, case when instrument = 'SOLUSDT' then round(size / 7, 4) else round(size / 7, 6) end as size from t) select venue, instrument, trade_id, price, size from p"
SQL["confidence_decay"] = f"with {_BK}, r as (select *, count(*) over w as n, (bps - avg(bps) over w) as d, stddev_pop(bps) over w as sd from bi {_ROLL64}), e as (select venue, instrument, seq, ts, least(0.99::double, 0.5 + d / sd / 10) as c, max(ts) over (partition by venue, instrument) as now from r where n >= 10 and sd > 1e-9 and d / sd > 2.5 and bps > 10) select venue, instrument, seq, round(greatest(0::double, least(1::double, c * pow(0.5, (now - ts) / 600000))), 4) as confidence from e"

_REGIMES = _H + """, o as (
  select *, row_number() over w as x, lag(close) over w as pc
  from c window w as (partition by venue, instrument order by window_start)),
m as (
  select *, count(*) over w20 as n20, regr_slope(close, x) over w20 / avg(close) over w20 as slope,
    (close - first_value(close) over w20) / first_value(close) over w20 as net,
    (max(close) over w20 - min(close) over w20) / avg(close) over w20 as rng,
    count(pc) over w14 as n14,
    avg(case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end) over w14 as atr,
    count(*) over p20 as np, volume / avg(volume) over p20 as vr, (close - pc) / pc as mv
  from o window w20 as (partition by venue, instrument order by window_start rows between 19 preceding and current row),
    w14 as (partition by venue, instrument order by window_start rows between 13 preceding and current row),
    p20 as (partition by venue, instrument order by window_start rows between 20 preceding and 1 preceding)),
trend as (
  select venue, instrument, window_start, slope, net as move, case when is_trend then 'trending' else 'ranging' end as kind,
    case when is_trend then 0.5 * least(1, abs(slope) / 0.003) + 0.5 * least(1, abs(net) / 0.012)
      else 0.5 * (1 - least(1, abs(slope) / 0.003)) + 0.5 * (1 - least(1, rng / 0.024)) end::double as strength
  from (select *, abs(slope) >= 0.0015 and abs(net) >= 0.006 as is_trend from m where n20 = 20)),
vol as (
  select venue, instrument, window_start, atr, case when r >= 0.015 then 'high_volatility' else 'low_volatility' end as kind,
    case when r >= 0.015 then least(1, (r - 0.015) / 0.015 + 0.5) else least(1, (0.004 - r) / 0.004 + 0.5) end::double as strength
  from (select *, atr / close as r from m where n14 = 14) where r >= 0.015 or r <= 0.004),
brk as (
  select venue, instrument, window_start, mv as move, volume, vr as volume_ratio,
    (0.5 * least(1, abs(mv) / 0.015) + 0.5 * least(1, vr / 3.6))::double as strength
  from m where np = 20 and abs(mv) >= 0.0075 and vr >= 1.8),
every as (
  select venue, instrument, window_start, 'breakout' as kind, strength, 1 as place from brk
  union all select venue, instrument, window_start, kind, strength, 2 from trend
  union all select venue, instrument, window_start, kind, strength, 3 from vol),
best as (
  select venue, instrument, window_start, kind, strength from every
  qualify row_number() over (partition by venue, instrument, window_start order by strength * 1.0 desc, place) = 1),
arb as (
  select *, 1.0::double as confidence, coalesce(lag(kind) over (partition by venue, instrument order by window_start) <> kind, false) as transition from best)
"""
SQL["regime_trend"] = f"with {_REGIMES} select venue, instrument, window_start, round(slope, 6) as slope, round(move, 6) as move, kind, round(strength, 6) as strength from trend"
SQL["regime_volatility"] = f"with {_REGIMES} select venue, instrument, window_start, round(atr, 6) as atr, kind, round(strength, 6) as strength from vol"
SQL["regime_breakout"] = f"""with {_REGIMES} select venue, instrument, window_start, round(move, 6) as move, round(volume, 6) as volume,
  round(volume_ratio, 6) as volume_ratio, round(strength, 6) as strength from brk"""
SQL["regime_arbitrated"] = f"with {_REGIMES} select venue, instrument, window_start, kind, round(strength, 6) as strength, confidence, transition from arb"
SQL["regime_history"] = f"""with {_REGIMES} select venue, instrument, window_start, kind, round(strength, 6) as strength from arb
  qualify row_number() over (partition by venue, instrument order by window_start desc) <= 10"""
SQL["regime_latest"] = f"""with {_REGIMES}, z as (
  select venue, instrument, max(window_start) as now, coalesce(max(window_start) filter (transition), min(window_start)) as since, count(*) filter (transition) as transitions
  from arb group by all) select z.venue, z.instrument, kind, round(strength, 6) as strength, since, transitions
  from z join arb on arb.venue = z.venue and arb.instrument = z.instrument and arb.window_start = z.now"""


def _rated(x: str, critical: float, high: float) -> str:
    return f"case when {x} >= {critical} then 'critical' when {x} >= {high} then 'high' else 'medium' end as severity, case when {x} >= {critical} then 0.95 when {x} >= {high} then 0.85 else 0.7 end::double as confidence"


_EXPLOSIONS = _BK + f""", ob as (select * from bi where bid > 0 and ask > bid),
r as (select *, count(*) over w as n, bps - avg(bps) over w as d, stddev_pop(bps) over w as sd from ob {_ROLL64}),
ex as (
  select *, {_rated('z', 5, 3.5)} from (select *, case when sd > 1e-9 then d / sd else 0 end as z from r)
  where n >= 10 and z > 2.5 and bps > 10)"""
SQL["ev_spread_explosion"] = f"with {_EXPLOSIONS} select venue, instrument, seq, round(bps, 4) as spread_bps, round(z, 4) as z, severity, confidence from ex"
SQL["confidence_decay"] = f"""with {_EXPLOSIONS}, e as (select *, max(ts) over (partition by venue, instrument) as now from ex)
  select venue, instrument, seq, round(confidence * pow(0.5, (now - ts) / 600000), 4) as confidence from e"""
SQL["ev_thinning"] = f"""with {_BK}, r as (select *, count(*) over w as n, avg(depth) over w as mean, stddev_pop(depth) over w as sd from bi {_ROLL64}),
th as (
  select *, {_rated('gone', 0.7, 0.5)} from (select *, 1 - depth / mean as gone from r where mean > 0)
  where n >= 10 and sd > 1e-9 and (depth - mean) / sd <= -2 and depth <= mean * 0.7) select venue, instrument, seq, round(depth, 4) as depth, round(gone, 4) as drop_share, severity, confidence from th"""
SQL["ev_persistent_imbalance"] = f"""with {_BK}, s as (select *, case when imb >= 0.3 then 1 when imb <= -0.3 then -1 else 0 end as sign from bi),
i as (select *, seq - row_number() over (partition by venue, instrument, sign order by seq) as isl from s),
k as (select *, row_number() over w as consecutive, min(seq) over w as seq_start from i where sign <> 0 window w as (partition by venue, instrument, sign, isl order by seq)),
p as (select *, {_rated('consecutive', 30, 20)} from k where consecutive >= 10) select venue, instrument, seq, seq_start, sign::bigint as sign, consecutive, severity, confidence from p"""
_SWEEPS = _BK + """, b4 as (
  select *, lag(lv) over w - lv as lost, lag(bd) over w as pb, lag(ad) over w as pa from bi window w as (partition by venue, instrument order by seq)),
dr as (select *, case when pb > 0 and bd < pb then (pb - bd) / pb else 0 end as b_drop, case when pa > 0 and ad < pa then (pa - ad) / pa else 0 end as a_drop from b4),
sw as (
  select *, case when side = 'bid' then b_drop else a_drop end as gone
  from (select *, case when lost >= 5 and b_drop >= 0.4::double then 'bid' when lost >= 5 and a_drop >= 0.4::double then 'ask' end as side from dr) where side is not null),
sv as (
  select *, case when lost >= 12 or gone >= 0.75 then 'critical' when lost >= 8 or gone >= 0.6 then 'high' else 'medium' end as severity,
    case when lost >= 12 or gone >= 0.75 then 0.95 when lost >= 8 or gone >= 0.6 then 0.85 else 0.7 end::double as confidence from sw)"""
SQL["ev_sweep"] = f"with {_SWEEPS} select venue, instrument, seq, side, round(bd, 4) as bid_depth, round(ad, 4) as ask_depth, lost as levels_lost, severity, confidence from sv"
SQL["newest_evidence"] = f"with {_SWEEPS} select venue, instrument, seq, side from sv qualify row_number() over (partition by venue, instrument order by seq desc) <= 3"


def _cooled(found: str) -> str:
    """kept: the rows of `found` that come 5 s or more after the one kept before, by following each time to the next that is far enough."""
    return f"""ca as (select venue, instrument, ts, min(seq) as seq from {found} group by all),
nx as (select venue, instrument, ts, min(ts) over (partition by venue, instrument order by ts range between 5000 following and unbounded following) as next_ts from ca),
ch as (
  select venue, instrument, min(ts) as ts from ca group by all
  union all select ch.venue, ch.instrument, nx.next_ts from ch join nx on nx.venue = ch.venue and nx.instrument = ch.instrument and nx.ts = ch.ts where nx.next_ts is not null),
kept as (select f.* from {found} f join ca using (venue, instrument, ts, seq) join ch using (venue, instrument, ts))"""


SQL["ev_cooled"] = f"with recursive {_EXPLOSIONS}, {_cooled('ex')} select venue, instrument, seq, ts as ts_ingest_ms, severity, confidence from kept"
SQL["latest_evidence"] = f"with recursive {_SWEEPS}, {_cooled('sv')} select venue, instrument, count(*) as kept, max(seq) as last_seq, arg_max(side, seq) as last_side from kept group by all"
SQL["ev_absorption"] = f"""with recursive {_TR}, ab as (
  select venue, instrument, seq, ts, 100 + (ts - 1704067200000) / 86400000 * 0.02::double + (price - 100) / 20000 as price, q,
    sum(q) over w as ring, count(*) over w as n from t {_ROLL64}),
fo as (
  select venue, instrument, seq, price as ref, 0::hugeint as total, seq as start, null::bigint as last, false as hit, null::double as at_ref, null::bigint as at_start, null::hugeint as at_total, null::double as vr
  from ab where seq = 1
  union all
  select venue, instrument, seq, case when early or moved or found then price else ref end, case when early or moved or found then 0 else total end,
    case when early or moved or found then seq else start end, case when found then ts else last end, found, ref, start, total, total / ring
  from (
    select *, not early and not moved and total >= 2 * ring and (last is null or ts - last >= 5000) as found
    from (
      select ab.venue, ab.instrument, ab.seq, ab.ts, ab.price, ab.ring, ab.n < 10 as early, abs(ab.price - fo.ref) / fo.ref > 0.001 as moved,
        fo.ref, fo.start, fo.last, case when ab.n < 10 then 0 else fo.total + ab.q end as total
      from fo join ab on ab.venue = fo.venue and ab.instrument = fo.instrument and ab.seq = fo.seq + 1))),
hits as (select *, {_rated('vr', 8, 4)} from fo where hit) select venue, instrument, seq, at_start as seq_start, round(at_ref, 4) as ref_price, round(at_total::bigint / 1e8, 4) as volume, round(vr, 4) as volume_ratio, severity, confidence from hits"""
SQL["ev_spread_regime"] = SQL["ev_spread_regime"].replace("before, regime, case", "before, regime, case regime when 'BLOWN' then 'critical' when 'WIDE' then 'high' else 'low' end as severity, case")
SQL["ev_tape_absorption"] = SQL["ev_tape_absorption"].replace("as volume_ratio from", "as volume_ratio, case when total_volume / mean >= 8 then 'critical' when total_volume / mean >= 4 then 'high' else 'medium' end as severity from")

# Spark's rounding of the results is half to even on x * 10^n; so is this
SQL = {name: "".join([*(parts := text.rpartition(") select "))[:2], parts[2].replace("round(", "round_even(")]) for name, text in SQL.items()}
