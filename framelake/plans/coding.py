"""Queries of predictive sample coding, on 16-bit samples with J = 8 and r = 16."""

from pyspark.sql import functions as F

from framelake.operators import ricecode as rice
from framelake.plans.catalog import query
from framelake.plans.fixtures import samples, with_

J, R, N = 8, 16, 16
_KS = list(rice.splits(N))
_B = f"""b as (select s.series_id, i, x, i // {J * R} seg, (i // {J}) % {R} blk, i % {J} j from samples s join (select series_id, (max(i) + 1) // {J * R} n from samples group by all) e using (series_id) where i // {J * R} < n)"""
_D = "d as (select *, x - pred d from (select *, coalesce(lag(x) over (partition by series_id, seg order by i), 0) pred from b))"
_V = f"""v as (select *, case when d >= 0 and d <= th then 2 * d when d < 0 and -d <= th then -2 * d - 1 else th + abs(d) end v from (select *, least(pred, {(1 << N) - 1} - pred) th from d))"""
_Z = """z as (select series_id, seg, blk, is_zero, case when is_zero then row_number() over (partition by series_id, seg, is_zero, island order by blk) - 1 end run_index
from (select *, blk - sum(is_zero::int) over (partition by series_id, seg order by blk) island from (select series_id, seg, blk, max(v) = 0 is_zero from v group by all)))"""
_S = f"""s as (select series_id, seg, blk, {N * J}::bigint nc, case when se <= {32 * J} then se end se, {', '.join(f'case when k{k} <= {32 * J} then k{k} end k{k}' for k in _KS)} from
(select series_id, seg, blk, sum((a + b) * (a + b + 1) // 2 + b + 1)::bigint se, {', '.join(f'sum(k{k})::bigint k{k}' for k in _KS)} from
(select series_id, seg, blk, j // 2 pair, sum(case when j % 2 = 0 then v else 0 end) a, sum(case when j % 2 = 1 then v else 0 end) b, {', '.join(f'sum((v >> {k}) + {k + 1}) k{k}' for k in _KS)} from v group by all) group by all))"""
_U = "u as (" + " union all ".join(f"select series_id, seg, blk, {c} bits, {r} rank, '{c}' opt from s where {c} is not null" for c, r in [("se", 0), ("nc", 1), *((f"k{k}", 2 + k) for k in _KS)]) + ")"
_O = "o as (select z.series_id, z.seg, z.blk, case when is_zero then 'zb' else opt end as option, cast(case when is_zero then run_index + 1 else bits end as bigint) body_bits, run_index from z join (select * from u qualify row_number() over (partition by series_id, seg, blk order by bits, rank) = 1) q using (series_id, seg, blk))"
_W = rice.id_width(N)
_L = f"""l as (select *, cast(sum(bits) over (partition by series_id order by seg, blk) - bits as bigint) bit_offset from (select *, cast(id_bits + case when option = 'se' then {16 * J} else body_bits end as bigint) bits from
(select *, cast({_W} + (option in ('zb', 'se'))::int as bigint) id_bits, cast(case when option = 'nc' then {(1 << _W) - 1} when option like 'k%' then substr(option, 2)::int + 1 when option = 'se' then 1 else 0 end as bigint) id_value from o)))"""
_PAD = "lpad(bin({}), {}, '0')"
_C = f"""c as (select series_id, seg, blk, option, bit_offset, lpad(bin(id_value), id_bits::int, '0') || case when option = 'zb' then repeat('0', run_index::int) || '1' when option = 'nc' then nc when option = 'se' then se {' '.join(f"when option = 'k{k}' then u{k} || l{k}" for k in _KS)} end code from l join
(select series_id, seg, blk, string_agg({_PAD.format('v', N)}, '' order by j) nc, {', '.join(f"string_agg(repeat('0', (v >> {k})::int) || '1', '' order by j) filter (where v >> {k} <= {32 * J}) u{k}, " + (f"string_agg({_PAD.format(f'v & {(1 << k) - 1}', k)}, '' order by j) l{k}" if k else "'' l0") for k in _KS)} from v group by all) t using (series_id, seg, blk) join
(select series_id, seg, blk, string_agg(case when g < 4294967296 then {_PAD.format('g', 32)} end, '' order by pair) se from (select series_id, seg, blk, pair, (a + b) * (a + b + 1) // 2 + b g from (select series_id, seg, blk, j // 2 pair, sum(case when j % 2 = 0 then v else 0 end)::bigint a, sum(case when j % 2 = 1 then v else 0 end)::bigint b from v group by all)) group by all) w using (series_id, seg, blk))"""


def _sql(*parts: str) -> str:
    return with_("samples", more=",\n".join(parts))


@query("c1_blockize", _sql(_B) + "select * from b")
def c1(spark, sf_dir):
    return rice.blockize(samples(spark, sf_dir), J=J, r=R)


@query("c2_delta_predict", _sql(_B, _D) + "select * from d")
def c2(spark, sf_dir):
    return rice.delta_predict(c1(spark, sf_dir))


@query("c3_map_residual", _sql(_B, _D, _V) + "select * exclude (th) from v")
def c3(spark, sf_dir):
    return rice.map_residual(c2(spark, sf_dir), n_bits=N)


@query("c4_zero_runs", _sql(_B, _D, _V, _Z) + "select * from z")
def c4(spark, sf_dir):
    return rice.zero_runs(c3(spark, sf_dir))


@query("c5_option_sizes", _sql(_B, _D, _V, _S) + "select * from s")
def c5(spark, sf_dir):
    return rice.option_sizes(c3(spark, sf_dir), J=J, n_bits=N)


@query("c6_select_option", _sql(_B, _D, _V, _Z, _S, _U, _O) + "select * from o")
def c6(spark, sf_dir):
    return rice.select_option(c5(spark, sf_dir), c4(spark, sf_dir), n_bits=N)


@query("c7_coded_layout", _sql(_B, _D, _V, _Z, _S, _U, _O, _L) + "select * from l")
def c7(spark, sf_dir):
    return rice.coded_layout(c6(spark, sf_dir), J=J, n_bits=N)


@query("c8_encode_blocks", _sql(_B, _D, _V, _Z, _S, _U, _O, _L, _C) + "select * from c")
def c8(spark, sf_dir):
    return rice.encode_blocks(c3(spark, sf_dir), c7(spark, sf_dir), J=J, n_bits=N)


@query("c8_pack_segments", _sql(_B, _D, _V, _Z, _S, _U, _O, _L, _C) + "select series_id, seg, length(code)::bigint n_bits, hex(unbin(rpad(code, (ceil(length(code) / 8) * 8)::int, '0'))) payload from (select series_id, seg, string_agg(code, '' order by blk) code from c group by all)")
def c8_packed(spark, sf_dir):
    return rice.pack_segments(c3(spark, sf_dir), c7(spark, sf_dir), J=J, n_bits=N).withColumn("payload", F.hex("payload"))


@query("c9_coding_report", _sql(_B, _D, _V, _Z, _S, _U, _O, _L) + f"select series_id, seg, option, count(*) n_blocks, sum(bits)::bigint bits, count(*) * {N * J} raw_bits from l group by all")
def c9(spark, sf_dir):
    return rice.coding_report(c7(spark, sf_dir), n_bits=N, J=J)
