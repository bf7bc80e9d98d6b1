"""Queries of the wavelet decomposition and its coefficient statistics, on 64 x 64 images."""

from pyspark.sql import functions as F

from framelake.operators import wavelet as wl
from framelake.plans.catalog import query
from framelake.plans.fixtures import image, with_

H = W = 64
S = 16  # blocks in a segment


def _dwt(src: str, out: str, along: str, n: int) -> str:
    """One integer lifting pass over table src, by joins with explicit mirrored places."""
    keys = f"image_id, {'y' if along == 'x' else 'x'}"
    g = lambda k: f"get(a, {k})"
    get = f"list(v order by {along}) a"
    half = n // 2
    inner = lambda i, left, right: f"a[{i}] - floor((9 * (a[{i} - 1] + a[{i} + 1]) - ({left} + {right})) / 16.0 + 0.5)"
    # lists count from 1: sample k is a[k + 1]
    high = f"""list_transform(range(0, {half}), lambda i: case when i = {half - 1} then a[2*i+2] - floor((9 * a[2*i+1] - a[2*i-1]) / 8.0 + 0.5)
else a[2*i+2] - floor((9 * (a[2*i+1] + a[2*i+3]) - ((case when i = 0 then a[3] else a[2*i-1] end) + (case when i = {half - 2} then a[2*i+3] else a[2*i+5] end))) / 16.0 + 0.5) end)"""
    low = f"list_transform(range(0, {half}), lambda i: case when i = 0 then a[1] - floor(-h[1] / 2.0 + 0.5) else a[2*i+1] - floor(-(h[i] + h[i+1]) / 4.0 + 0.5) end)"
    return f"""{out} as (select {keys}, cast(p - 1 as int) {along}, cast(o[p] as bigint) v from (select {keys}, list_concat({low}, h) o from (select {keys}, a, {high} h from (select {keys}, {get} from {src} group by {keys}))), range(1, {n + 1}) r(p))"""


def _levels(source: str = "image", step=_dwt) -> str:
    parts, src, size = [], f"(select image_id, y, x, v from {source})", 64
    for k in (1, 2, 3):
        parts += [step(src, f"r{k}", "x", size), step(f"r{k}", f"c{k}", "y", size)]
        size //= 2
        src = f"(select * from c{k} where y < {size} and x < {size})"
    parts.append("dwt as (select image_id, y, x, v from c1 where y >= 32 or x >= 32 union all select image_id, y, x, v from c2 where y >= 16 or x >= 16 union all select image_id, y, x, v from c3)")
    return ",\n".join(parts)


_BAND = """(select *, case when y >= 32 or x >= 32 then 1 when y >= 16 or x >= 16 then 2 else 3 end l from dwt)"""
_SCALED = f"scaled as (select image_id, y, x, cast(v * (case when y < (64 >> l) and x < (64 >> l) then 8 when y >= (64 >> l) and x >= (64 >> l) then 1 << (l - 1) else 1 << l end) as bigint) v from {_BAND})"
_REGROUPED = """regrouped as (select image_id, cast(i // s * 8 + i % s + case when dn then s else 0 end as int) y, cast(j // s * 8 + j % s + case when rt then s else 0 end as int) x, v from
(select *, y - case when dn then 64 >> l else 0 end i, x - case when rt then 64 >> l else 0 end j, 8 >> l s from
(select *, y >= (64 >> l) dn, x >= (64 >> l) rt from (select *, case when y >= 32 or x >= 32 then 1 when y >= 16 or x >= 16 then 2 else 3 end l from scaled))))"""
_BLOCKS = f"blocks as (select image_id, cast(((y // 8) * 8 + x // 8) // {S} as int) seg, cast((y // 8) * 8 + x // 8 as int) blk, cast((y % 8) * 8 + x % 8 as int) pos, v c from regrouped)"
_LEN = "(case when {0} = 0 then 0 else length(bin({0})) end)"
_DEPTHS = f"""depths as (select image_id, seg, blk, dc, ac_bits, max(ac_bits) over w depth_ac, max(case when dc >= 0 then dl + 1 else dl end) over w depth_dc from
(select *, {_LEN.format('abs(dc)')} dl from (select image_id, seg, blk, max(case when pos = 0 then c end) dc, {_LEN.format('max(case when pos > 0 then abs(c) else 0 end)')} ac_bits from blocks group by all)) window w as (partition by image_id, seg))"""
_QUANT = """quant as (select *, cast(tw >> q as bigint) shifted, cast(tw & ((1::bigint << q) - 1) as bigint) rem, greatest(depth_dc - q, 1) "N" from
(select *, case when dc < 0 then dc + (1::bigint << depth_dc) else dc end & ((1::bigint << depth_dc) - 1) tw from
(select *, cast(case when depth_dc <= 3 then 0 when depth_dc - ((1 + depth_ac) >> 1) <= 1 then depth_dc - 3 when depth_dc - ((1 + depth_ac) >> 1) > 10 then depth_dc - 10 else 1 + (depth_ac >> 1) end as int) q from depths)))"""
_MAP = "case when d >= 0 and d <= th then 2 * d when d < 0 and -d <= th then -2 * d - 1 else th + abs(d) end"
_DPCM = f"""dpcm as (select * exclude (pb, d, th, tw), case when pb is null then shifted else {_MAP} end code, pb is null is_first from
(select *, signed - pb d, least(pb + (1::bigint << ("N" - 1)), (1::bigint << ("N" - 1)) - 1 - pb) th from
(select *, lag(signed) over (partition by image_id, seg order by blk) pb from (select *, case when "N" = 1 then shifted when shifted >= 1::bigint << ("N" - 1) then shifted - (1::bigint << "N") else shifted end signed from quant))))"""
_ACDPCM = f"""acdpcm as (select * exclude (pb, d, th), cast(case when pb is null then ac_bits else {_MAP} end as bigint) code, pb is null is_first from
(select *, ac_bits - pb d, least(pb, (1::bigint << "N") - 1 - pb) th from (select *, lag(ac_bits) over (partition by image_id, seg order by blk) pb, {_LEN.format('depth_ac')} "N" from depths)))"""


def _gaggles(src: str) -> str:
    sums = ", ".join(f"coalesce(sum((rest >> {k}) + {1 + k}), 0) + rb s{k}" for k in range(9))
    pick = " union all ".join(f"select image_id, seg, gaggle, {k} k, s{k} bits from g where {k} <= mk" for k in range(9))
    return f"""g0 as (select *, case when not is_first then code end rest, (blk - min(blk) over (partition by image_id, seg)) // 16 gaggle from {src}),
g1 as (select *, sum(case when is_first then "N" else 0 end) over (partition by image_id, seg, gaggle) rb from g0),
g as (select image_id, seg, gaggle, count(*) size, max("N") n, max(case when "N" <= 2 then 0 when "N" <= 4 then 2 when "N" <= 8 then 6 else 8 end) mk, {sums} from g1 group by image_id, seg, gaggle, rb),
gk as (select * from ({pick}) qualify row_number() over (partition by image_id, seg, gaggle order by bits, k) = 1)
select image_id, seg, cast(gaggle as int) gaggle, size, cast(case when bits < n * size then k else -1 end as int) k, cast(case when bits < n * size then bits else n * size end as bigint) bits, cast(case when n <= 2 then 1 when n <= 4 then 2 when n <= 8 then 3 else 4 end as int) id_bits from g join gk using (image_id, seg, gaggle)"""


def _sql(*parts: str) -> str:
    return with_("image", more=",\n".join(parts))


_ALL = (_levels(), _SCALED, _REGROUPED, _BLOCKS)


@query("w2_dwt1d_int", _sql(_dwt("(select image_id, y, x, v from image)", "o", "x", 64)) + "select image_id, y, x, v from o")
def w2(spark, sf_dir):
    return wl.dwt1d_int(image(spark, sf_dir), partition=["image_id", "y"], order="x", length=W).select("image_id", "y", "x", "v")


def _mirror(k: str) -> str:
    return f"(case when {k} < 0 then -({k}) when {k} > 63 then 126 - ({k}) else {k} end)"


_LOW = " + ".join([f"{wl.LOW_TAPS[0]!r} * a[2*i+1]"] + [f"{t!r} * (a[{_mirror(f'2*i-{k}')} + 1] + a[{_mirror(f'2*i+{k}')} + 1])" for k, t in enumerate(wl.LOW_TAPS) if k])
_HIGH = " + ".join([f"({wl.HIGH_TAPS[0]!r}) * a[2*i+2]"] + [f"({t!r}) * (a[{_mirror(f'2*i+1-{k}')} + 1] + a[{_mirror(f'2*i+1+{k}')} + 1])" for k, t in enumerate(wl.HIGH_TAPS) if k])


@query("w3_dwt1d_float", _sql() + f"select image_id, y, cast(i + 32 * up as int) x, cast(floor((case when up = 1 then {_HIGH} else {_LOW} end) * 16 + 0.5) as bigint) v from (select image_id, y, list(v::double order by x) a from image group by all), range(32) r(i), range(2) s(up)")
def w3(spark, sf_dir):
    """In sixteenths, so that sums in another order give the same numbers."""
    out = wl.dwt1d_float(image(spark, sf_dir).withColumn("v", F.col("v").cast("double")), partition=["image_id", "y"], order="x", length=W)
    return out.select("image_id", "y", "x", F.floor(F.col("v") * 16 + 0.5).alias("v"))


@query("w4_dwt2d", _sql(_levels()) + "select image_id, y, x, v from c1")
def w4(spark, sf_dir):
    return wl.dwt2d(image(spark, sf_dir).withColumn("v", F.col("v").cast("long")), height=H, width=W).select("image_id", "y", "x", "v")


@query("w5_dwt2d_multilevel", _sql(_levels()) + "select * from dwt")
def w5(spark, sf_dir):
    return wl.dwt2d_multilevel(image(spark, sf_dir), height=H, width=W).select("image_id", "y", "x", "v")


@query("w6_round_half_away", "select vec_id, cast(i - 1 as int) i, cast(case when e >= 0 then floor(e + 0.5) else ceil(e - 0.5) end as bigint) r from (select vec_id, i, embedding[i]::double * 8 e from embeddings, range(1, 65) r(i))")
def w6(spark, sf_dir):
    from framelake.plans.fixtures import table

    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select("vec_id", "i", wl.round_half_away(F.col("e").cast("double") * 8).alias("r"))


@query("w7_scale_subbands", _sql(_levels(), _SCALED) + "select * from scaled")
def w7(spark, sf_dir):
    return wl.scale_subbands(w5(spark, sf_dir), height=H, width=W)


@query("w8_regroup_blocks", _sql(_levels(), _SCALED, _REGROUPED) + "select * from regrouped")
def w8(spark, sf_dir):
    return wl.regroup_blocks(w7(spark, sf_dir), height=H, width=W)


@query("w9_assign_segments", _sql(*_ALL) + "select * from blocks")
def w9(spark, sf_dir):
    return wl.assign_segments(w8(spark, sf_dir), width=W, segment_size=S)


@query("w10_segment_bit_depths", _sql(*_ALL, _DEPTHS) + "select * from depths")
def w10(spark, sf_dir):
    return wl.segment_bit_depths(w9(spark, sf_dir))


@query("w11_quantize_dc", _sql(*_ALL, _DEPTHS, _QUANT) + "select * exclude (tw) from quant")
def w11(spark, sf_dir):
    return wl.quantize_dc(w10(spark, sf_dir))


@query("w12_dc_dpcm", _sql(*_ALL, _DEPTHS, _QUANT, _DPCM) + "select * from dpcm")
def w12(spark, sf_dir):
    return wl.dc_dpcm(w11(spark, sf_dir))


@query("w13_gaggle_code", _sql(*_ALL, _DEPTHS, _QUANT, _DPCM, _gaggles("dpcm").rpartition("\nselect")[0]) + "select" + _gaggles("dpcm").rpartition("\nselect")[2])
def w13(spark, sf_dir):
    return wl.gaggle_code(w12(spark, sf_dir))


@query("w14_ac_depth_code", _sql(*_ALL, _DEPTHS, _ACDPCM, _gaggles("acdpcm").rpartition("\nselect")[0]) + "select" + _gaggles("acdpcm").rpartition("\nselect")[2])
def w14(spark, sf_dir):
    return wl.gaggle_code(wl.ac_dpcm(w10(spark, sf_dir)))


@query("w15_dc_refinement_bits", _sql(*_ALL, _DEPTHS, _QUANT) + "select image_id, seg, n_blocks, p planes, p * n_blocks up_front_bits, i * n_blocks in_plane_bits from (select image_id, seg, count(*) n_blocks, cast(greatest(max(q) - max(depth_ac), 0) as int) p, cast(case when max(q) > 3 then greatest(least(max(q), max(depth_ac)) - 3, 0) else 0 end as int) i from quant group by all)")
def w15(spark, sf_dir):
    return wl.dc_refinement_bits(w11(spark, sf_dir))


_STATS = f"""m as (select *, {_LEN.format('abs(c)')} bits, greatest(pos // 8, pos % 8) far from blocks where pos > 0),
f as (select *, case when far < 2 then 'parent' when far < 4 then 'child' else 'grandchild' end generation, case when far < 2 then 1 when far < 4 then 2 else 4 end sz from m),
g as (select *, cast(case when pos // 8 >= sz and pos % 8 >= sz then 2 when pos // 8 >= sz then 1 else 0 end as int) family from f),
t as (select *, max(bits) over (partition by image_id, seg, family, generation) most from g)"""


@query("w16_bitplane_stats", _sql(*_ALL, _STATS) + """select image_id, seg, family, generation, cast(b as int) plane, count(*) filter (where bits = b) significant, count(*) filter (where bits > b) refinement, count(*) filter (where bits = b) sign from t, range(1, 64) r(b)
where b <= most and b > (case generation when 'parent' then 3 when 'child' then case when family = 2 then 1 else 2 end else case when family = 2 then 0 else 1 end end) group by all""")
def w16(spark, sf_dir):
    return wl.bitplane_stats(w9(spark, sf_dir))


@query("w17_segment_headers", _sql(*_ALL, _DEPTHS) + "select image_id, seg, seg = 0 is_first, seg = m is_last, cast(seg % 256 as int) seg_field, depth_dc, depth_ac, case when seg = m then 3 else 0 end pad_rows, case when seg = m then 32 else 24 end header_bits from (select *, max(seg) over (partition by image_id) m from (select image_id, seg, max(depth_dc) depth_dc, max(depth_ac) depth_ac from depths group by all))")
def w17(spark, sf_dir):
    return wl.segment_headers(w10(spark, sf_dir), pad_rows=3)


@query("w18_decompose", _sql(*_ALL) + "select * from blocks")
def w18(spark, sf_dir):
    return wl.decompose(image(spark, sf_dir), height=H, width=W, segment_size=S)


#: Images of 60 x 61, so that rows and columns are padded to 64.
CUT_H, CUT_W = 60, 61
_PADDED = f"padded as (select g.image_id, ty y, tx x, v from (select image_id, cast(b.ty as int) ty, cast(c.tx as int) tx from (select distinct image_id from image) i, range(64) b(ty), range(64) c(tx)) g join image p on p.image_id = g.image_id and p.y = least(ty, {CUT_H - 1}) and p.x = least(tx, {CUT_W - 1}))"


def _dwt_float(src: str, out: str, along: str, n: int) -> str:
    keys = f"image_id, {'y' if along == 'x' else 'x'}"
    at = lambda k: f"a[(case when {k} < 0 then -({k}) when {k} > {n - 1} then {2 * n - 2} - ({k}) else {k} end) + 1]"
    taps = lambda t, c: " + ".join([f"({t[0]!r}) * a[{c} + 1]"] + [f"({x!r}) * ({at(f'({c} + {k})')} + {at(f'({c} - {k})')})" for k, x in enumerate(t) if k])
    half = f"range(0, {n // 2})"
    both = f"list_concat(list_transform({half}, lambda i: {taps(wl.LOW_TAPS, '2*i')}), list_transform({half}, lambda i: {taps(wl.HIGH_TAPS, '(2*i+1)')}))"
    return f"{out} as (select {keys}, cast(p - 1 as int) {along}, o[p] v from (select {keys}, {both} o from (select {keys}, list(v::double order by {along}) a from {src} group by {keys})), range(1, {n + 1}) r(p))"


_ROUNDED = "scaled as (select image_id, y, x, cast(case when v >= 0 then floor(v + 0.5) else ceil(v - 0.5) end as bigint) v from dwt)"


def _segment_sql(kind: str) -> str:
    steps = (_levels("padded"), _SCALED) if kind == "int" else (_levels("padded", _dwt_float), _ROUNDED)
    in_plane = "case when max(q) > 3 then greatest(least(max(q), max(depth_ac)) - 3, 0) else 0 end" if kind == "int" else "least(max(q), max(depth_ac))"
    skipped = "(case generation when 'parent' then 3 when 'child' then case when family = 2 then 1 else 2 end else case when family = 2 then 0 else 1 end end)" if kind == "int" else "0"
    gaggles = lambda name, src: f'{name}_g as (with {_gaggles(src)}),\n{name}_s as (select image_id, seg, sum(bits + case when nn > 1 then id_bits else 0 end) b from {name}_g join (select image_id, seg, max("N") nn from {src} group by all) using (image_id, seg) group by all)'
    planes = f"""planes as (with {_STATS} select image_id, seg, family, generation, b, count(*) filter (where bits = b) s, count(*) filter (where bits > b) r from t, range(1, 64) r(b) where b <= most and b > {skipped} group by all),
stats as (select image_id, seg, sum(s) s, sum(r) r, list_sort(list([family, case generation when 'parent' then 0 when 'child' then 1 else 2 end, b, s, r])) l from planes group by all)"""
    totals = f"totals as (select image_id, seg, count(*) n_blocks, max(depth_dc) depth_dc, max(depth_ac) depth_ac, max(q) q, greatest(max(q) - max(depth_ac), 0) p, {in_plane} i from quant group by all)"
    shown = f"""rows_ as (select image_id, seg, seg = 0 is_first, seg = max(seg) over (partition by image_id) is_last, seg % 256 seg_field, depth_dc, depth_ac, q, n_blocks, p planes_, p * n_blocks up_front_bits, i * n_blocks in_plane_bits,
d.b dc_bits, a.b ac_depth_bits, coalesce(s, 0) significant, coalesce(r, 0) refinement, coalesce(l, []) l from totals join dc_s d using (image_id, seg) join ac_s a using (image_id, seg) left join stats using (image_id, seg))"""
    more = (_PADDED, *steps, _REGROUPED, _BLOCKS, _DEPTHS, _QUANT, _DPCM, _ACDPCM, gaggles("dc", "dpcm"), gaggles("ac", "acdpcm"), planes, totals, shown)
    return _sql(*more) + f"""select image_id, seg, is_first, is_last, seg_field, depth_dc, depth_ac, case when is_last then {64 - CUT_H} else 0 end pad_rows, case when is_last then 32 else 24 end header_bits,
q, n_blocks, planes_ up_front_planes, up_front_bits::bigint up_front_bits, in_plane_bits::bigint in_plane_bits, dc_bits::bigint dc_bits, ac_depth_bits::bigint ac_depth_bits, significant::bigint significant, refinement::bigint refinement, significant::bigint sign, l planes,
(case when is_last then 32 else 24 end + dc_bits + up_front_bits + ac_depth_bits + in_plane_bits + refinement + significant)::bigint known_bits from rows_"""


def _cut(spark, sf_dir):
    return image(spark, sf_dir).where(f"y < {CUT_H} and x < {CUT_W}")


@query("w18_segment_table", _segment_sql("int"))
def w18_table(spark, sf_dir):
    return wl.segment_table(_cut(spark, sf_dir), segment_size=S)


@query("w18_segment_table_float", _segment_sql("float"))
def w18_table_float(spark, sf_dir):
    return wl.segment_table(_cut(spark, sf_dir), segment_size=S, kind="float")
