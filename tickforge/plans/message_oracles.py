"""The queries of messages as DuckDB SQL."""

from __future__ import annotations

from tickforge.plans.oracles import _TR

#: Names as two venues write them in US dollars, once canonical.
_DOLLARS = "case when event_id % {0} < 2 then instrument else replace(instrument, 'USDT', 'USD') end"
_PRICE = "case when event_id % 101 <> 0 and event_id % 103 <> 0 then price end"

SQL: dict[str, str] = {
    "venue_books": f"""with {_TR}, v as (
  select ['BINANCE','BYBIT','COINBASE','HYPERLIQUID','KRAKEN','KRAKENF'][event_id % 6 + 1] as venue, {_DOLLARS.format(6)} as instrument,
    case when event_id % 6 = 0 then event_id - 3 when event_id % 6 <> 3 then event_id end as u, event_id, price, size, tx
  from t)
select venue, instrument, u::bigint as first_id, case when venue = 'HYPERLIQUID' then tx else event_id end::bigint as final_id,
  case when venue = 'BINANCE' then event_id - 4 end::bigint as prev_final,
  case when venue = 'BINANCE' then false when venue = 'HYPERLIQUID' then true else event_id % 5 = 0 end as is_snapshot, tx::bigint as ts_exchange_ms, side,
  round(price + case side when 'bid' then -k else k end, 6) as price, round(case when k = 2 and event_id % 7 = 0 then 0.0 else size * k end, 6)::double as size
from v, unnest(['bid', 'ask']) s(side), unnest([1, 2]) n(k)""",
    "venue_marks": f"""with {_TR}, v as (
  select event_id, ['BINANCE','BYBIT','COINBASE','KRAKEN','KRAKENF'][event_id % 5 + 1] as venue, {_DOLLARS.format(5)} as instrument, {_PRICE} as mark_price, price + 0.5 as index_price,
    ((event_id * 13) % 201 - 100) / 1e6::double as funding_rate, case when event_id % 5 in (1, 3) and (event_id // 5) % 2 = 0 then ts else tx end as ts_exchange_ms
  from t)
select venue, instrument, round(mark_price, 9) as mark_price, case when venue <> 'COINBASE' then round(index_price, 9) end as index_price,
  case when venue <> 'COINBASE' then round(funding_rate, 9)::double end as funding_rate, ts_exchange_ms::bigint as ts_exchange_ms
from v where mark_price is not null""",
    "venue_liquidations": f"""with {_TR}, v as (select *, ['BINANCE','BYBIT'][(event_id // 2) % 2 + 1] as source from t)
select source as venue, instrument, side, round(price, 6) as price, round(size, 6)::double as size, tx::bigint as ts_exchange_ms from v where source = 'BYBIT' or event_id % 107 <> 0
union all
select source, instrument, case side when 'buy' then 'sell' else 'buy' end, round(price, 6), round(size * 2, 6)::double, tx::bigint from v where source = 'BYBIT' and event_id % 3 <> 0""",
    "event_range_oldest": f"""with {_TR} select 'trade/' || venue || '/' || instrument || '/raw' as subject, seq, trade_id, ts as ts_ingest_ms from t
where ts >= 1705708800000 qualify row_number() over (partition by venue, instrument order by ts, seq) <= 5""",
    "evidence_metrics": f"""with {_TR}, m as (
  select event_id, 'size' as name, size::double as value from t
  union all select event_id, 'price', price from t
  union all select event_id, 'm' || k, (size * k)::double from t, unnest(range(8)) n(k) where event_id % (k + 2) <> 0),
r as (select *, row_number() over (partition by event_id order by name) as k from m)
select event_id, (k - 1)::bigint as at, name, round(value, 6) as value from r where k <= 8""",
    "evidence_fragments": f"""with {_TR}, f as (
  select event_id, list_filter([trim(side), case when event_id % 2 = 0 then '' else 'odd' end, left(repeat(instrument, 20), 120), 'at ' || venue, trade_id], lambda x: x <> '')[1:4] as x from t)
select event_id, unnest(range(len(x)))::bigint as at, unnest(x) as fragment from f""",
}
