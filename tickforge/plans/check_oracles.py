"""The queries of checks as DuckDB SQL."""

from __future__ import annotations

from tickforge.plans import oracles
from tickforge.plans.oracles import _EV, _TR

#: CRC-32 of the ASCII text {}, bit by bit.
_CRC = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, [ascii(c)::ubigint for c in string_split({}, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint for i in range(8)]), lambda u, v: xor(u >> 1, 3988292384::ubigint * (u & 1)))))"""

_HEAT, _PROFILE, _STATS, _BOOK = (oracles.SQL[k] for k in ("heatmap_1h", "vpvr_1h", "stats_1h", "book_as_of"))

#: What all rules on books find, by their own SQL.
_EVIDENCE = " union all ".join(
    f"select '{kind}' as kind, venue, instrument, seq, severity, confidence from ({oracles.SQL[name]})"
    for kind, name in (("spread_explosion", "ev_spread_explosion"), ("thinning", "ev_thinning"), ("imbalance", "ev_persistent_imbalance"), ("sweep", "ev_sweep"))
)


def _broken(table: str, artifact: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select venue, instrument, '{rule}' as rule, count(*) as rows, '{artifact}' as artifact from {table} where {bad} group by all" for rule, bad in rules.items())


_ROWS = "select venue, instrument, kind, reason, count(*) as rows from {} where reason is not null group by all"

SQL = {
    "subject_categories": f"""with {_EV},
      s as (select 'md.' || event_type || ['.delta.v2.x', '_snapshot', '.v1.close', '.window_close', '.telemetry.v3', '.v10', '.bookdelta'][event_id % 7 + 1] as head from ev),
      t as (select regexp_replace(head, '(^|\\.)v[0-9]+(\\..*)?$', '') as event_type from s)
      select event_type, case when regexp_matches(event_type, '\\.close|\\.final|_close$|_final$|window_close') then 'close_final' when contains(event_type, 'telemetry') then 'telemetry'
          when regexp_matches(event_type, '\\.snapshot|_snapshot$') then 'snapshot' when regexp_matches(event_type, '\\.delta|_delta$|bookdelta$') then 'delta' else 'unknown' end as category, count(*) as events
      from t group by all""",
    "fused_cells": f"""with h as (select *, bid_liquidity + ask_liquidity + trade_volume as v, price_low + 2.0 as price_high from ({_HEAT})),
      k as (select *, row_number() over (partition by instrument, window_start order by price_low, price_high, size_class) as rank from (select distinct instrument, window_start, price_low, price_high, size_class from h)),
      w as (select *, sum(bid_liquidity) over c as b, sum(ask_liquidity) over c as a, sum(trade_volume) over c as t, sum(samples) over c as n, sum(v) over c as whole from h window c as (partition by instrument, window_start, price_low, size_class))
      select instrument, window_start, price_low, price_high, size_class, round_even(b, 5) as bid_liquidity, round_even(a, 5) as ask_liquidity, round_even(t, 5) as trade_volume, n::bigint as samples, venue,
        round_even(v, 5) as volume, round_even(v / whole, 5) as weight
      from w join k using (instrument, window_start, price_low, price_high, size_class) where rank <= 40""",
    "invalid_books": f"""with {_TR},
      r as (
        select venue, instrument, 'snapshot' as kind, case when event_id % 107 = 0 then 'bad_time' when event_id % 113 = 0 then 'bids_neg_price' when event_id % 101 = 0 then 'bids_order' when event_id % 103 = 0 then 'asks_zero_qty' end as reason from t
        union all
        select venue, instrument, 'delta', case when event_id % 107 = 0 then 'bad_time' when event_id % 113 = 0 then 'bids_neg_price' when event_id % 101 = 0 then 'bids_order'
          when event_id % 2 = 0 then null when event_id % 127 = 0 then 'update_ids' when event_id % 109 = 0 then case when event_id = 1 then 'update_ids' else 'update_order' end end from t
      ) {_ROWS.format("r")}""",
    "invalid_marks": f"""with {_EV},
      r as (
        select venue, instrument, 'mark_price' as kind, case when event_id % 11 = 0 then 'non_finite' when event_id % 13 = 0 then 'non_positive_price' when event_id % 17 = 0 then 'non_finite_rate' end as reason from ev where event_type = 'view'
        union all
        select venue, instrument, 'liquidation', case when event_id % 11 = 0 then 'non_positive_size' when event_id % 13 = 0 then 'bad_side' when event_id % 17 = 0 then 'bad_time' end from ev where event_type = 'error'
        union all
        select venue, instrument, 'open_interest', case when event_id % 11 = 0 then 'negative' when event_id % 13 = 0 then 'non_finite' end from ev where event_type = 'signup'
      ) {_ROWS.format("r")}""",
    "artifact_audit": f"""with st as (select *, window_start // 3600000 as h from ({_STATS})),
      vp0 as (select *, window_start // 3600000 as h from ({_PROFILE})),
      vp as (select *, h % 11 = 0 as twice from vp0 union all select *, true from vp0 where h % 11 = 0),
      hm as (select * from ({_HEAT})),
      out as (
        {_broken("st", "stats", {"total": "h % 7 = 0 and liq_volume is not null", "mark_range": "h % 11 = 0 and mark_count > 0"})}
        union all {_broken("vp", "profile", {"total": "h % 7 = 0", "unique": "twice"})}
        union all {_broken("hm", "heatmap", {"samples": "price_low % 34 = 0", "sequence": "price_low % 38 = 0"})}
      ) select * from out""",
    "ingest_decisions": f"""with {_EV},
      e as (select event_id, ['', 'validation_failed', 'duplicate', 'unavailable', 'internal', 'timeout', 'conflict', 'out_of_order', 'internal'][event_id % 9 + 1] as code,
        case when event_id % 14 = 0 then 'decode_failed' when event_id % 15 = 0 then 'unknown_event_type' else '' end as why from ev),
      r as (
        select code, case when code = '' then 'ok' when why <> '' then why when event_id % 8 = 0 or code = 'unavailable' or code = 'internal' and event_id % 4 <> 0 then 'transient_failure'
          when code in ('validation_failed', 'duplicate', 'conflict', 'out_of_order') then 'validation_failed' else 'transient_failure' end as reason_code from e
      )
      select code, case reason_code when 'ok' then 'ack' when 'transient_failure' then 'nak' else 'term' end as disposition, reason_code, reason_code not in ('ok', 'transient_failure') as quarantine, count(*) as messages from r group by all""",
    "rule_results": f"""with {_TR},
      m as (
        select venue as binding, case venue when 'BINANCE' then 2 when 'BYBIT' then 1 when 'KRAKEN' then 1 end::bigint as config_version, side, event_id,
          event_id % 31 = 0 or event_id % 37 = 0 as broken, case when event_id % 3 = 0 then 'blank' when event_id % 5 = 0 then 'there' else 'missing' end as note from t
      ),
      v as (
        select *, case when venue_bad then [('runtime.active_config', 'active_config_not_found')] when broken then [('payload', 'payload_decode_failed')]
          when binding = 'BINANCE' and note = 'missing' then [('required:note', 'missing_required_field'), ('not_empty:note', 'field_must_not_be_empty')] when binding = 'BINANCE' and note = 'blank' then [('not_empty:note', 'field_must_not_be_empty')]
          when binding = 'BYBIT' and side <> 'buy' then [('equals:side', 'field_must_equal_expected_value')] else [(null::varchar, null::varchar)] end as found
        from (select *, config_version is null as venue_bad from m)
      ),
      x as (select binding, config_version, case when venue_bad or broken then 'error' when found[1][1] is null then 'passed' else 'failed' end as status, unnest(found) as f from v)
      select binding, config_version, status, f[1] as rule, f[2] as reason, count(*) as messages from x group by all""",
    "payload_drift": f"""with {_EV},
      x as (
        select event_id, unnest([('mismatch', 'price', event_id % 7 = 0), ('dropped', 'side', event_id % 11 = 0), ('dropped', 'meta.tags[1]', event_id % 17 = 0), ('new', 'extra', event_id % 13 = 0)]) as f from ev
      )
      select event_id, f[1] as kind, f[2] as path, not (event_id % 7 = 0 or event_id % 11 = 0 or event_id % 17 = 0) as compatible from x where f[3]""",
    "fills_against_largest": f"""with {_TR},
      g as (select venue, instrument, floor(price / 10.0) * 10.0 as price_low, coalesce(sum(q) filter (side = 'buy'), 0)::bigint as b, coalesce(sum(q) filter (side = 'sell'), 0)::bigint as s from t group by all)
      select venue, instrument, round_even(price_low, 6) as price_low, round_even(b / 1e8 + s / 1e8, 6) as volume, round_even(max(b / 1e8 + s / 1e8) over w, 6) as max_volume,
        round_even((b / 1e8 + s / 1e8) / max(b / 1e8 + s / 1e8) over w, 6) as share_of_max, round_even(((sum(b) over w)::bigint / 1e8 - (sum(s) over w)::bigint / 1e8) / ((sum(b) over w)::bigint / 1e8 + (sum(s) over w)::bigint / 1e8), 6) as series_imbalance
      from g window w as (partition by venue, instrument)""",
    "coverage_status": f"""with {_EV},
      late as (select *, case event_type when 'signup' then 'interest' when 'error' then 'liquidations' when 'view' then 'marks' end as own from ev where ms > (select max(ms) from ev) - 10800000),
      have as (select venue, instrument, 'trades' as artifact from late union select venue, instrument, own from late where own is not null),
      g as (
        select a.artifact, count(*) as total, count(*) filter (a.artifact <> 'footprints' and h.venue is not null) as available, count(*) filter (a.artifact <> 'footprints' and h.venue is null) as empty, count(*) filter (a.artifact = 'footprints') as unavailable
        from (select distinct venue, instrument from ev) s, (values ('trades'), ('interest'), ('liquidations'), ('marks'), ('empties'), ('footprints')) a(artifact)
          left join have h on h.venue = s.venue and h.instrument = s.instrument and h.artifact = a.artifact group by all
      )
      select *, case when unavailable = total then 'unavailable' when empty = total then 'empty' when available > 0 and empty > 0 then 'partial' when unavailable > 0 then 'partial' else 'available' end as status from g""",
    "position_state": """with o as (
        select o_custkey % 10 as account, ['BINANCE','BYBIT','COINBASE','KRAKEN'][o_orderkey % 4 + 1] as venue, ['BTCUSDT','ETHUSDT','SOLUSDT'][o_custkey % 3 + 1] as symbol, o_orderkey % 2 = 0 as long, epoch_ms(o_orderdate::timestamp) as filled from orders
      ),
      p as (select account, venue, symbol, long, max(filled) as filled from o group by all)
      select account, symbol, count(*) as positions, count(*) filter ((select max(filled) from o) - filled > 5184000000::bigint) as stale, bool_or(long) and bool_or(not long) as diverges from p group by all""",
    "evidence_by_kind": f"select * from ({_EVIDENCE}) qualify row_number() over (partition by kind, venue, instrument order by seq desc) <= 3",
    "latest_by_subject": f"""with e as ({_EVIDENCE})
      select venue, instrument, count(*) over w as findings, kind, seq, severity from e window w as (partition by venue, instrument) qualify row_number() over (partition by venue, instrument order by seq desc, kind desc) = 1""",
    "sampled_violations": f"""with {_TR},
      x as (select * replace (case when event_id % 53 = 0 then seq - 3 else seq end as seq) from t),
      a as (select *, max({{'s': seq, 't': ts}}) over (partition by venue, instrument order by ts, event_id rows between unbounded preceding and 1 preceding) as top from x),
      v as (select event_id, case when seq < 0 then 'seq_invalid' when top is null or seq > top.s then 'accept' when seq = top.s then 'replay_duplicate' when ts < top.t or top.s - seq <= 2048 then 'stale_event' else 'seq_non_monotonic' end as verdict from a)
      select verdict, count(*) over (partition by verdict) as rows, event_id from v where verdict <> 'accept' qualify row_number() over (partition by verdict order by event_id) <= 64""",
    "capped_checksums": f"""with b as (select * from ({_BOOK})),
      r as (select *, row_number() over (partition by venue, instrument, side order by case when side = 'bid' then -price else price end) as k, round_even(price * 1e8, 0)::bigint || ':' || round_even(size * 1e8, 0)::bigint as x from b),
      g as (
        select venue, instrument, count(*) filter (side = 'bid') as bid_levels, count(*) filter (side = 'ask') as ask_levels, max(price) filter (side = 'bid') as hi, min(price) filter (side = 'ask') as lo,
          coalesce(string_agg(x, '|' order by k) filter (side = 'bid'), '') || '#' || coalesce(string_agg(x, '|' order by k) filter (side = 'ask'), '') as text
        from r group by all
      )
      select venue, instrument, bid_levels, ask_levels, round_even(coalesce((lo - hi) / ((lo + hi) / 2) * 10000, -1), 6) as spread_bps, {_CRC.format("text")}::bigint as checksum from g""",
}
