"""DuckDB SQL for the queries of views.py and for the profiles that grow outward."""

from __future__ import annotations

from tickforge.plans.oracles import _BIG, _DE, _DP, _EV, _H, _HC, _LV, _ST, _TR, _LB, _candles, _stats, _tape, _volume  # noqa: F401

_T1 = _DE + ", " + _tape(60_000)
_OI = _EV + """, o as (
  select venue, instrument, ms, 1000.0::double + value * 10 as oi, row_number() over (partition by venue, instrument order by ms, event_id) as seq from ev where event_type = 'signup'),
ow as (select venue, instrument, ms - ms % 300000 as window_start, arg_max(oi, seq) as oi from o group by all),
od as (select *, lag(oi) over (partition by venue, instrument order by window_start) as b from ow)"""
_FUND = _ST + ", " + _stats(3_600_000).replace("count(f) as funding_count", "count(f) as funding_count, (sum(q) filter (side = 'sell'))::bigint / 1e8 as liq_sell_volume, arg_max(f, seq) filter (f is not null) / 1e9 as f_last, min(seq) as seq_first, max(seq) as seq_last")


def _recent(table: str, ms: int) -> str:
    return f"window_start >= (select max(window_start) from {table}) - {ms}"


SQL: dict[str, str] = {
    "agg_candles": f"""with {_H} select venue, instrument, window_start, round_even(close, 4) as close, round_even(buy_volume, 4) as buy_volume, round_even(sell_volume, 4) as sell_volume,
      round_even(buy_volume * 100 / volume, 4) as buy_pct, round_even(close - open, 4) as price_change from c""",
    "agg_stats": f"""with {_FUND} select venue, instrument, window_start, liq_buy_volume, liq_sell_volume, liq_volume, liq_count, mark_close, mark_high, mark_low,
      case when funding_count > 0 then (fs // funding_count) / 1e9 end as funding_avg, f_last as funding_last, seq_first, seq_last from st""",
    "agg_open_interest": f"""with {_OI} select venue, instrument, window_start, round_even(oi, 4) as open_interest, round_even(coalesce(oi - b, 0), 4) as delta,
      round_even(case when b > 0 then (oi - b) / b else 0 end, 4) as delta_pct from od""",
    "agg_cvd": f"""with {_T1} select venue, instrument, window_start, round_even(buy_volume - sell_volume, 6) as delta,
      round_even((sum(round_even((buy_volume - sell_volume) * 1e8, 0)::bigint) over (partition by venue, instrument order by window_start rows unbounded preceding))::bigint / 1e8, 6) as cvd from tp""",
    "agg_tape": f"""with {_T1} select venue, instrument, window_start, trade_count, buy_count, sell_count, round_even(total_volume, 4) as total_volume, round_even(max_size, 4) as max_size,
      round_even(trade_count * 1000.0::double / 60000, 4) as rate, round_even((buy_volume - sell_volume) / (buy_volume + sell_volume), 4) as imbalance, trade_count > 12 as is_burst,
      round_even(notional / total_volume, 4) as vwap, round_even(last_price - notional / total_volume, 4) as last_less_vwap from tp""",
    "agg_delta_volume": f"""with {_T1} select venue, instrument, window_start, round_even(buy_volume, 4) as buy_volume, round_even(sell_volume, 4) as sell_volume,
      round_even(buy_volume - sell_volume, 4) as delta, trade_count, round_even(buy_volume * 100 / (buy_volume + sell_volume), 4) as buy_pct from tp""",
    "recent_volume_stats": f"""with {_TR}, {_volume(300_000)} select venue, instrument, window_start, round_even(buy_volume, 4) as buy_volume, round_even(sell_volume, 4) as sell_volume,
      round_even((buy_volume - sell_volume) * 100 / total_volume, 4) as delta_pct from v where {_recent('v', 21_600_000)}""",
    "recent_closes": f"""with {_H} select venue, instrument, window_start, round_even(close, 4) as close, round_even(high, 4) as high, round_even(low, 4) as low, round_even(volume, 4) as volume, trade_count
      from c where {_recent('c', 604_800_000)}""",
    "recent_liquidations": f"""with {_FUND.replace('% 3600000', '% 300000')} select venue, instrument, window_start, round_even(liq_buy_volume, 4) as liq_buy_volume, round_even(liq_sell_volume, 4) as liq_sell_volume
      from st where {_recent('st', 21_600_000)}""",
    "recent_open_interest": f"""with {_OI} select venue, instrument, window_start, round_even(oi, 4) as open_interest, round_even(coalesce(oi - b, 0), 4) as delta,
      round_even(case when b > 0 then (oi - b) / b else 0 end, 4) as delta_pct from od where {_recent('od', 86_400_000)}""",
    "recent_cvd": f"""with {_TR}, {_volume(300_000)}, r as (select venue, instrument, window_start, round_even((buy_volume - sell_volume) * 1e8, 0)::bigint as d from v)
      select venue, instrument, window_start, d / 1e8 as delta, cvd / 1e8 as cvd
      from (select *, (sum(d) over (partition by venue, instrument order by window_start rows unbounded preceding))::bigint as cvd from r) where {_recent('r', 86_400_000)}""",
    "recent_funding": f"""with {_FUND}, f as (select * from st where f_last is not null)
      select venue, instrument, window_start, f_last as funding_last, case when funding_count > 0 then (fs // funding_count) / 1e9 end as funding_avg from f where {_recent('f', 604_800_000)}""",
    "recent_tape": f"""with {_T1} select venue, instrument, window_start, round_even(trade_count * 1000.0::double / 60000, 4) as rate, round_even((buy_volume - sell_volume) / (buy_volume + sell_volume), 4) as imbalance,
      trade_count > 12 as is_burst, round_even(notional / total_volume, 4) as vwap, round_even(last_price, 4) as last_price from tp where {_recent('tp', 1_800_000)}""",
    "latency_nearest_rank": f"""with {_TR}, l as (select venue, ts - tx as ms, row_number() over (partition by venue order by ts - tx) - 1 as k, count(*) over (partition by venue) as n from t)
      select venue, max(ms) filter (k = n * 50 // 100) as p50, max(ms) filter (k = n * 95 // 100) as p95, max(ms) filter (k = n * 99 // 100) as p99 from l group by all""",
    "coverage_gaps": f"""with {_H}, w as (
        select venue, instrument, window_start from c
        union all select distinct venue, instrument, 1704067200000 - 3600000 from c
        union all select distinct venue, instrument, 1704067200000 + 2592000000::bigint + 3600000 from c),
      n as (select *, lead(window_start) over (partition by venue, instrument order by window_start) as nx from w)
      select venue, instrument, window_start + 3600000 as gap_start, nx - 3600000 as gap_end, (nx - window_start) // 3600000 - 1 as missing from n where nx > window_start + 3600000""",
    "level_reasons": f"""with {_LV} select venue, instrument, case when seq % 101 = 0 then 'nan' when seq % 103 = 0 then 'inf' when seq % 107 = 0 then 'neg_price' when seq % 109 = 0 then 'zero_price' else 'neg_qty' end as reason,
      count(*) as levels from lv where seq % 101 = 0 or seq % 103 = 0 or seq % 107 = 0 or seq % 109 = 0 or seq % 113 = 0 group by all""",
    "stream_health": f"""with {_TR}, m as (select venue, instrument, ts, event_id, case when venue = 'KRAKEN' and event_id % 43 = 0 then seq - 2 else seq end as seq from t where event_id % 41 <> 0),
      p as (select *, max(seq) over (partition by venue, instrument order by ts, event_id rows between unbounded preceding and 1 preceding) as top from m)
      select venue, instrument, max(seq) as last_seq, count(*) filter (seq > top + 1) as gaps, coalesce(sum(seq - top - 1) filter (seq > top + 1), 0)::bigint as missing,
        count(*) filter (seq < top) as out_of_order, count(*) filter (seq = top) as duplicates,
        case when count(*) filter (seq <= top) > 0 then 'NEEDS_ATTENTION' else 'HEALTHY' end as state from p group by all""",
    "federated_range": f"""with {_HC}, u as (select *, 0 as tier from hot union all select *, 1 from cold)
      select venue, instrument, window_start, round_even(open, 6) as open, round_even(close, 6) as close, round_even(volume, 6) as volume
      from (select * from u where window_start between 1705708800000 - 86400000 and 1705708800000 + 86400000
        qualify row_number() over (partition by venue, instrument, window_start order by tier) = 1)
      order by window_start, venue, instrument limit 500""",
    "tier_times": f"with {_HC} select venue, instrument, window_start from hot union select venue, instrument, window_start from cold",
    "dimension_totals": f"""with {_TR}, e as (select venue, min(tx) as first_seen_ms from t group by all)
      select venue, 'USDT' as quote, first_seen_ms, count(*) as trades, sum(q)::bigint / 1e8 as volume from t join e using (venue) group by all""",
    "catalog": f"""with {_H}, tw as (select venue, instrument, '1m' as timeframe, (1704067200000 + (ts - 1704067200000) // 720) as w from t),
      x as (
        select 'tape' as artifact, venue, instrument, timeframe, w - w % 60000 as window_start from tw
        union all
        select 'candle', venue, instrument, tf, (window_start - window_start % d)::bigint
        from (select '1h' as tf, 3600000 as d union all select '4h', 14400000 union all select '1d', 86400000), c where is_closed)
      select artifact, venue, instrument, timeframe, min(window_start) as first_start, max(window_start) as last_start, count(distinct window_start) as windows from x group by all""",
    "burn_rates": f"""with {_EV}, g as (select venue, ms - ms % 300000 as at_ms, count(*) as total, count(*) filter (event_type = 'error') as errors from ev group by all),
      b as (
        select *, sum(errors) over w5 / sum(total) over w5 / (1 - 0.99::double) as b5, sum(errors) over w60 / sum(total) over w60 / (1 - 0.99::double) as b60,
          sum(errors) over w30 / sum(total) over w30 / (1 - 0.99::double) as b30, sum(errors) over w360 / sum(total) over w360 / (1 - 0.99::double) as b360
        from g window w5 as (partition by venue order by at_ms range between 0 preceding and current row), w60 as (partition by venue order by at_ms range between 3300000 preceding and current row),
          w30 as (partition by venue order by at_ms range between 1500000 preceding and current row), w360 as (partition by venue order by at_ms range between 21300000 preceding and current row))
      select venue, at_ms as "at", total, errors, round_even(b5, 4) as burn_5m, round_even(b60, 4) as burn_60m, round_even(b30, 4) as burn_30m, round_even(b360, 4) as burn_360m,
        case when b5 > 14.4 and b60 > 14.4 then 'fast' when b30 > 6 and b360 > 6 then 'slow' else 'none' end as breach from b""",
    "fused_profile": f"""with {_TR}, v as (
        select instrument, ts - ts % 86400000 as window_start, floor(price / 5.0) * 5.0 as price_low, venue, coalesce(sum(q) filter (side = 'buy'), 0)::bigint as b, coalesce(sum(q) filter (side = 'sell'), 0)::bigint as s
        from t group by all),
      g as (
        select instrument, window_start, price_low, sum(b)::bigint as b, sum(s)::bigint as s, list((venue, b + s) order by venue) as mix from v group by all),
      k as (
        select *, row_number() over (partition by instrument, window_start order by price_low) as k from g)
      select instrument, window_start, price_low, price_low + 5.0 as price_high, b / 1e8 as buy_volume, s / 1e8 as sell_volume, (b + s) / 1e8 as total_volume,
        array_to_string(list_transform(mix, lambda x: x[1] || ':' || printf('%.2f', round(x[2] * 100 / (b + s), 2))), ',') as mix,
        row_number() over (partition by instrument, window_start order by b + s desc, price_low) = 1 as is_poc from k where k <= 400""",
    "fusion_meta": f"""with {_LB}, a as (select instrument, now - ts as age, bps, now - ts <= 5000 as fresh from lb),
      g as (select instrument, count(*) as sources, count(*) filter (fresh) as fresh, max(age) as oldest_ms, min(age) as newest_ms, coalesce(max(bps) filter (fresh) - min(bps) filter (fresh), 0) as dv from a group by all),
      c as (select *, fresh / sources * case when fresh = 1 then 0.7 else 1 end::double as confidence from g)
      select instrument, sources, fresh, oldest_ms, newest_ms, round_even(case when fresh > 0 then 100.0::double / fresh else 0 end, 4) as weight_pct, round_even(confidence, 4) as confidence, round_even(dv, 4) as divergence_bps,
        concat_ws(',', case when confidence < 0.5 then 'degraded' end, case when confidence >= 0.9 then 'high_confidence' end, case when fresh < sources and fresh > 0 then 'partial_sources' end,
          case when fresh = 1 then 'single_source' end, case when dv > 50 then 'venue_divergent' end) as tags from c""",
    "heatmap_bins": f"""with {_TR}, f as (select '5s' as timeframe, 0.1 as pc union all select '1m', 0.5 union all select '1h', 2.5),
      n as (select timeframe, venue, price * pc::double / 100 as n from t, f),
      p as (select *, case when pow(10, greatest(-8, ceil(log10(n) - 1e-12))) < n then pow(10, greatest(-8, ceil(log10(n) - 1e-12)) + 1) else pow(10, greatest(-8, ceil(log10(n) - 1e-12))) end as f from n),
      b as (select timeframe, venue, round(coalesce(list_filter([f, 0.5 * f, 0.25 * f, 0.2 * f, 0.1 * f, 0.05 * f], lambda x: x <= n and abs(x / 0.01 - round(x / 0.01)) < 1e-9)[1], 0.05 * f), 8) as bin from p)
      select timeframe, venue, round_even(bin, 6) as bin, count(*) as trades from b group by all""",
    "subject_routes": f"""with {_TR}, p as (select *, event_id % 89 = 0 as bad from t)
      select case when not bad then venue end as venue, case when not bad then instrument end as symbol, case when not bad then 'raw' end as timeframe, count(*) as trades, max(floor(price * 10) / 10) as max_price from p group by 1, 2, 3""",
    "freshness_by_channel": f"""with {_EV} select venue, event_type, max(ms) as last_ms, count(*) as events, (select max(ms) from ev) - max(ms) as lag_ms, (select max(ms) from ev) - max(ms) < 30000 as flowing from ev group by all""",
    "row_checksums": f"with {_TR} select venue, instrument, count(*) as changed, min(seq) as first_seq from t where event_id % 97 = 0 group by all",
}

_SERIES = "venue = 'BINANCE' and instrument = 'BTCUSDT' and window_start between 1704067800000 and 1705795200000 order by window_start limit 1000"
SQL |= {
    "range_stats": f"with {_FUND} select venue, instrument, window_start, round_even(liq_volume, 4) as liq_volume, round_even(mark_close, 4) as mark_close, funding_count from st where {_SERIES}",
    "range_tape": f"with {_T1} select venue, instrument, window_start, trade_count, round_even(notional / total_volume, 4) as vwap from tp where {_SERIES}",
    "range_open_interest": f"with {_OI} select venue, instrument, window_start, round_even(oi, 4) as open_interest, round_even(coalesce(oi - b, 0), 4) as delta from od where {_SERIES}",
    "range_delta_volume": f"with {_T1} select venue, instrument, window_start, round_even(buy_volume - sell_volume, 4) as delta from tp where {_SERIES}",
    "range_cvd": f"""with {_T1}, cv as (
      select venue, instrument, window_start, (sum(round_even((buy_volume - sell_volume) * 1e8, 0)::bigint) over (partition by venue, instrument order by window_start rows unbounded preceding))::bigint / 1e8 as cvd from tp)
      select venue, instrument, window_start, round_even(cvd, 4) as cvd from cv where {_SERIES}""",
    "range_bar_stats": f"with {_T1} select venue, instrument, window_start, round_even(total_volume / trade_count, 4) as avg_size, round_even(max_price - min_price, 4) as range from tp where {_SERIES}",
}


def _outward(rows: str) -> str:
    """grown: from the fullest bucket (the lowest on ties) outward, the fuller neighbour first and the lower one on ties, to 70 per cent. rows: venue, instrument, ss, price_low, price_high, v."""
    return f"""nb as materialized (select *, row_number() over p as i, sum(v) over (partition by venue, instrument, ss) as total, count(*) over (partition by venue, instrument, ss) as n from {rows} window p as (partition by venue, instrument, ss order by price_low)),
top as (select venue, instrument, ss, arg_max(i, (v, -i)) as i from nb group by all),
gr as (
  select t.venue, t.instrument, t.ss, 1 as step, t.i as poc, t.i as lo, t.i as hi, b.v::hugeint as acc, b.total, b.n from top t join nb b on b.venue = t.venue and b.instrument = t.instrument and b.ss = t.ss and b.i = t.i
  union all
  select g.venue, g.instrument, g.ss, step + 1, poc, case when down then lo - 1 else lo end, case when down then hi else hi + 1 end, acc + case when down then vl else vh end, total, n
  from (
    select g.*, coalesce(l.v, 0) as vl, coalesce(h.v, 0) as vh, hi = g.n or (lo > 1 and coalesce(l.v, 0) >= coalesce(h.v, 0)) as down
    from gr g left join nb l on l.venue = g.venue and l.instrument = g.instrument and l.ss = g.ss and l.i = g.lo - 1
      left join nb h on h.venue = g.venue and h.instrument = g.instrument and h.ss = g.ss and h.i = g.hi + 1
    where acc < g.total * 0.7::double and (lo > 1 or hi < g.n)) g),
grown as (
  select g.venue, g.instrument, g.ss, p.price_low as poc, l.price_low as va_low, h.price_high as va_high, g.acc
  from (select * from gr qualify row_number() over (partition by venue, instrument, ss order by step desc) = 1) g
    join nb p on p.venue = g.venue and p.instrument = g.instrument and p.ss = g.ss and p.i = g.poc
    join nb l on l.venue = g.venue and l.instrument = g.instrument and l.ss = g.ss and l.i = g.lo
    join nb h on h.venue = g.venue and h.instrument = g.instrument and h.ss = g.ss and h.i = g.hi)"""


_SESSIONS = _H + """, sp as (
  select venue, instrument, window_start - window_start % 86400000 as ss, floor((high + low + 2 * close) / 4 / 5.0) * 5.0 as price_low, sum(round_even(volume * 1e8, 0)::bigint)::bigint as v from c group by all),
sb as (select *, price_low + 5.0 as price_high from sp)"""


def _letters(step: int) -> str:
    return _TR + ", " + _candles("30m", 1_800_000) + f""", pd as (select *, window_start - window_start % 86400000 as ss, (window_start % 86400000) // 1800000 as period from c),
ll as (select venue, instrument, ss, chr((65 + least(23, period))::int) as letter, unnest(range(floor(low / {step})::bigint, ceil(high / {step})::bigint)) as level from pd where high > low),
lt as (
  select venue, instrument, ss, level * {step}::double as price_low, (level + 1) * {step}::double as price_high, string_agg(distinct letter, '' order by letter) as letters, count(distinct letter)::bigint as v
  from ll group by all)"""


SQL |= {
    "session_value_area": f"""with recursive {_SESSIONS}, {_outward('sb')}
      select venue, instrument, ss as session_start, round_even(poc, 6) as poc, round_even(va_low, 6) as va_low, round_even(va_high, 6) as va_high, round_even(acc::bigint / 1e8, 6) as va_volume from grown""",
    "tpo_profile": f"with {_letters(1)} select venue, instrument, ss as session_start, price_low, letters, v as n_letters from lt",
    "tpo_summary": f"""with recursive {_letters(10)}, {_outward('lt')},
      bo as (select venue, instrument, ss, max(high) filter (period <= 1) as ib_high, min(low) filter (period <= 1) as ib_low, max(high) as range_high, min(low) as range_low from pd group by all)
      select venue, instrument, ss as session_start, poc, va_low, va_high, round_even(ib_high, 6) as ib_high, round_even(ib_low, 6) as ib_low, round_even(range_high, 6) as range_high, round_even(range_low, 6) as range_low from grown join bo using (venue, instrument, ss)""",
}
