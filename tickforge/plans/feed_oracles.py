"""The queries of feeds as DuckDB SQL."""

from __future__ import annotations

from tickforge.plans.oracles import _DE, _EV, _TR

_ENV = _TR + """,
env as (
  select t.*, ev.event_type, event_id % 199 = 0 as other, event_id % 211 = 0 as newer, event_id % 197 = 0 as broken, event_id % 193 = 0 and ev.event_type = 'signup' as lacking,
    case ev.event_type when 'click' then 'trade' when 'purchase' then 'bookdelta' when 'view' then 'markprice' when 'error' then 'liquidation' else 'openinterest' end as kind
  from t join (select event_id, event_type from ev) ev using (event_id)
),
good as (select * from env where not (other or newer or broken or lacking))"""

#: The FNV-1a digest of a list of bytes.
_FNV = """lower(to_hex(list_reduce(list_prepend(14695981039346656037::hugeint, {}), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint))"""
_TEXT = "[ascii(c)::hugeint for c in string_split({}, '')]"
_LONG = "[(({} >> k) & 255)::hugeint for k in [56, 48, 40, 32, 24, 16, 8, 0]]"


def _joined(*parts: str) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat(list_append({out}, 0::hugeint), {p})"
    return out


def _chain() -> str:
    """Candles of a second and the levels that follow from closed ones."""
    out = f"""with {_DE}, c0 as (
  select venue, instrument, ts - ts % 1000 as window_start, arg_min(p, event_id) / 1e8 as open, max(p) / 1e8 as high, min(p) / 1e8 as low, arg_max(p, event_id) / 1e8 as close,
    sum(q)::bigint / 1e8 as volume, count(*) as trade_count
  from dt group by all
),
k0 as (select *, window_start < max(window_start) over (partition by venue, instrument) as is_closed from c0)"""
    levels = [("5s", 5000), ("1m", 60_000), ("5m", 300_000), ("15m", 900_000)]
    for n, (_, ms) in enumerate(levels, 1):
        out += f""",
c{n} as (
  select venue, instrument, w as window_start, arg_min(open, window_start) as open, max(high) as high, min(low) as low, arg_max(close, window_start) as close,
    sum(round_even(volume * 1e8, 0)::bigint)::bigint / 1e8 as volume, sum(trade_count)::bigint as trade_count
  from (select *, window_start - window_start % {ms} as w from k{n - 1} where is_closed) group by venue, instrument, w
),
k{n} as (select *, window_start < max(window_start) over (partition by venue, instrument) as is_closed from c{n})"""
    rows = [f"select venue, instrument, '{tf}' as timeframe, window_start, round_even(open, 6) as open, round_even(high, 6) as high, round_even(low, 6) as low, round_even(close, 6) as close, round_even(volume, 6) as volume, trade_count, is_closed from k{n}" for n, (tf, _) in enumerate(levels, 1)]
    return out + "\n" + "\nunion all ".join(rows)


_CHANNELS = _EV + """,
feed as (
  select venue, instrument as symbol, event_type as channel, case when event_id % 2 = 0 then '1m' else '' end as aggregation, case when event_type = 'purchase' then 20 else 0 end as depth, event_id as seq, ms
  from ev
)"""


def _fits(f: str, e: str) -> str:
    return " and ".join([f"({f}.{c} = '' or {f}.{c} = {e}.{c})" for c in ("venue", "symbol", "channel", "aggregation")] + [f"({f}.depth = 0 or {f}.depth = {e}.depth)"])


SQL = {
    "routed_trades": f"""with {_ENV} select venue, instrument, event_id as seq, ts as ts_ingest_ms, tx as ts_exchange_ms, round_even(price, 6) as price, round_even(size, 6) as size, side, trade_id
      from good where kind = 'trade'""",
    "routed_books": f"""with {_ENV}
      select venue, instrument, event_id as seq, event_id % 50 = 0 as is_snapshot, s.side as side, round_even(price + s.sign * k, 6) as price, round_even(size * k, 6) as size
      from good, (values ('bid', -1), ('ask', 1)) s(side, sign), (values (1), (2)) n(k) where kind = 'bookdelta'""",
    "routed_marks": f"""with {_ENV} select venue, instrument, event_id as seq, round_even(price, 9) as mark_price, round_even(price, 9) as index_price, round_even(((event_id * 13) % 201 - 100) / 1e6, 9) as funding_rate
      from good where kind = 'markprice'""",
    "routed_liquidations": f"with {_ENV} select venue, instrument, event_id as seq, round_even(price, 6) as price, round_even(size, 6) as size, side from good where kind = 'liquidation'",
    "routed_interest": f"with {_ENV} select venue, instrument, event_id as seq, round_even(1000.0 + (price - 100.0) * 10, 6) as open_interest from good where kind = 'openinterest'",
    "routed_quarantine": f"""with {_ENV}
      select case when other then 'marketdata.other' else 'marketdata.' || kind end as type, case when newer then 2 else 1 end::bigint as version, lower(venue) as venue, instrument, event_id as seq,
        case when other then 'unknown_event_type' when newer then 'unknown_event_version' when broken then 'decode_failed' else 'field_missing' end as reason
      from env where other or newer or broken or lacking""",
    "stream_keys": f"""with {_TR}
      select venue, instrument, event_id as at, {_FNV.format(_joined(_TEXT.format("venue"), _TEXT.format("instrument"), _TEXT.format("'marketdata.trade'"), _LONG.format("event_id")))} as key from t
      union all
      select venue, instrument, w as at, {_FNV.format(_joined(_TEXT.format("venue"), _TEXT.format("instrument"), _TEXT.format("'1h'"), _TEXT.format("w::varchar")))} as key
      from (select distinct venue, instrument, ts - ts % 3600000 as w from t)""",
    "repeats_within": f"""with recursive {_TR},
      k as (select venue, instrument, event_id, ((event_id * 7919 + event_id // 90 * 13) % 150)::varchar as key, row_number() over (partition by venue, instrument order by ts, event_id) as n from t),
      r as (
        select venue, instrument, 0::bigint as n, []::varchar[] as ring, false as is_repeat, null::bigint as event_id, null::varchar as key from (select distinct venue, instrument from k)
        union all
        select k.venue, k.instrument, k.n, case when list_contains(ring, k.key) then ring when len(ring) >= 64 then list_append(ring[2:], k.key) else list_append(ring, k.key) end, list_contains(ring, k.key), k.event_id, k.key
        from r join k on k.venue = r.venue and k.instrument = r.instrument and k.n = r.n + 1
      )
      select venue, instrument, event_id, key, is_repeat from r where n > 0""",
    "ownership_audit": f"""with {_TR},
      top as (select venue, instrument, max(seq) as top from t where ts < 1705708800000 group by all),
      x as (
        select t.* replace (case when event_id % 53 = 0 then seq - 3 when event_id % 47 = 0 then seq - 1 when event_id % 499 = 0 then -1 else seq end as seq), case when ts >= 1705708800000 then 'b' else 'a' end as owner,
          event_id % 50 = 0 as snap, case when ts >= 1705708800000 then top + 4 else 0 end as handoff, case when ts >= 1705708800000 then top + 8 else 0 end as pending
        from t left join top using (venue, instrument)
      ),
      y as (select *, pending > 0 and not snap and seq <= pending as waits, handoff > 0 and seq <= handoff as handed from x),
      z as (select *, max({{'s': seq, 't': ts, 'o': owner}}) filter (seq > 0 and not waits and not handed) over (partition by venue, instrument order by ts, event_id rows between unbounded preceding and 1 preceding) as last from y),
      v as (
        select *, case when seq <= 0 then 'seq_invalid' when waits then 'resync_overlap' when seq = last.s then 'replay_duplicate' when owner <> last.o and seq <= greatest(handoff, last.s) then 'owner_change'
          when snap and handed then 'resync_overlap' when last is null or seq > last.s then 'accept' when ts < last.t or last.s - seq <= 2048 then 'stale_event' else 'seq_non_monotonic' end as reason
        from z
      )
      select venue, instrument, case when reason = 'accept' then 'accept' when reason = 'owner_change' or reason = 'resync_overlap' and not waits then 'convert_to_resync' else 'drop' end as action, reason,
        count(*) as rows, min(event_id) as first_event
      from v group by all""",
    "ordered_digests": f"""with {_TR},
      d as (select venue, instrument, md5(seq || '|' || length(trade_id) || ':' || trade_id || '|' || length(side) || ':' || side || '|' || length(ts::varchar) || ':' || ts) as d from t)
      select venue, instrument, count(*) as rows, lower({" || ".join(f"lpad(to_hex((sum(('0x' || substr(d, {8 * k + 1}, 8))::bigint) % 4294967296)::ubigint), 8, '0')" for k in range(4))}) as digest
      from d group by all""",
    "subscription_counts": f"""with {_CHANNELS},
      f as (
        select o_orderkey as filter_id, ['BINANCE', 'BYBIT', '', 'COINBASE', 'KRAKEN'][o_orderkey % 5 + 1] as venue, ['BTCUSDT', 'ETHUSDT', 'SOLUSDT', ''][o_custkey % 4 + 1] as symbol,
          ['view', 'error', '', 'click', 'purchase', 'none'][o_orderkey // 5 % 6 + 1] as channel, ['', '1m', '5m'][o_orderkey // 7 % 3 + 1] as aggregation, [0, 20, 0, 0][o_orderkey // 11 % 4 + 1] as depth
        from orders
      ),
      g as (select venue, symbol, channel, aggregation, depth, count(*) as n, max(ms) as latest from feed group by all)
      select filter_id, sum(n)::bigint as events, max(latest) as latest_ms from f join g on {_fits("f", "g")} group by filter_id""",
    "subscription_feed": f"""with {_CHANNELS},
      f as (
        select n_nationkey as id, 1704067200000 + (n_nationkey - 1) * 86400000 as since, ['BINANCE', '', 'KRAKEN'][n_nationkey % 3 + 1] as venue, ['', 'ETHUSDT'][n_nationkey % 2 + 1] as symbol,
          ['view', '', 'error', 'click'][n_nationkey % 4 + 1] as channel, '' as aggregation, 0 as depth
        from nation
      ),
      h as (select f.id, f.since, e.venue, e.symbol, e.channel, case when e.seq % 37 = 0 then e.seq - 500 else e.seq end as seq, e.ms from f join feed e on {_fits("f", "e")}),
      s as (select id, venue, symbol, channel, max({{'q': seq, 'm': ms}}).q as last from h where ms <= since group by all)
      select id, venue, symbol, channel, 'snapshot' as kind, 1::bigint as events, last as first_seq, last as last_seq from s
      union all
      select id, venue, symbol, channel, 'delta', count(*), min(seq), max(seq) from h left join s using (id, venue, symbol, channel) where ms > since and (last is null or seq > last) group by all""",
    "session_bounds": f"""with {_TR},
      h as (select distinct venue, instrument, ts - ts % 3600000 + 1234567 as ts from t),
      b as (
        select a.anchor, ts, case when a.anchor = 'custom' then ts - ts % 18000000 else ts - (ts - a.opens) % 86400000 end as session_start, a.length
        from h, (values ('exchange', 52200000, 23400000), ('utc', 28800000, 28800000), ('custom', 0, 18000000)) a(anchor, opens, length)
      )
      select anchor, session_start, session_start + length as session_end, ts >= session_start + length as is_closed, count(*) as hours, min(ts) as first_ts from b group by all""",
    "rolled_from_seconds": _chain(),
    "bursts": "with " + _DE + ", m as (select *, ts - ts % 600000 + ts % 1000 as moved from dt) " + " union all ".join(
        f"select venue, instrument, '{tf}' as timeframe, moved - moved % {ms} as window_start, count(*) as trade_count, sum(q)::bigint as volume_fp, count(*) > {limit} as is_burst from m group by venue, instrument, moved - moved % {ms}"
        for tf, ms, limit in (("250ms", 250, 25), ("1s", 1000, 80), ("5s", 5000, 300))
    ),
}
