"""Queries of encryption and of radar focusing."""

from pyspark.sql import functions as F

from framelake.operators import cipher, radar
from framelake.plans.catalog import query
from framelake.plans.fixtures import filled, payloads, pulses, scenes, table, with_

KEY, IV = "2b7e151628aed2a6abf7158809cf4f3c", "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"
_IV_LIMBS = [int(IV[8 * k : 8 * k + 8], 16) for k in range(4)]


@query("e1_split_blocks", with_("payloads") + "select o_orderkey, cast(b as int) b, substr(hex(payload), (b * 32 + 1)::int, 32) as block from payloads, range(0, 99) r(b) where b * 16 < octet_length(payload)")
def e1(spark, sf_dir):
    return payloads(spark, sf_dir).select("o_orderkey", F.posexplode(cipher.split_blocks(F.col("payload"))).alias("b", "block")).withColumn("block", F.hex("block"))


_COUNTER = f"""select o_orderkey, printf('%08X%08X%08X%08X', l0 & 4294967295, l1 & 4294967295, l2 & 4294967295, l3 & 4294967295) as counter from
(select *, {_IV_LIMBS[0]} + (l1 >> 32) l0 from (select *, {_IV_LIMBS[1]} + (l2 >> 32) l1 from (select *, {_IV_LIMBS[2]} + (b >> 32) + (l3 >> 32) l2 from (select o_orderkey, b, {_IV_LIMBS[3]} + (b & 4294967295) l3 from (select o_orderkey, o_orderkey::bigint * 123456789012 as b from orders)))))"""


@query("e2_ctr_counter", _COUNTER)
def e2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(cipher.ctr_counter(IV, F.col("o_orderkey") * F.lit(123456789012))).alias("counter"))


@query("e3_ctr_keystream")
def e3(spark, sf_dir):
    """No SQL: DuckDB has no AES; tests hold it against published vectors."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(cipher.ctr_keystream(cipher.ctr_counter(IV, F.col("o_orderkey")), KEY)).alias("keystream"))


@query("e4_xor_bytes", "select o_orderkey, printf('%016X', xor(o_orderkey::bigint, o_custkey::bigint * 1000003)) as x from orders")
def e4(spark, sf_dir):
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(cipher.xor_bytes(number(F.col("o_orderkey")), number(F.col("o_custkey") * 1000003))).alias("x"))


@query("e5_encrypt_ctr")
def e5(spark, sf_dir):
    return cipher.encrypt_ctr(payloads(spark, sf_dir), "payload", KEY, IV).select("o_orderkey", F.hex("ciphertext").alias("ciphertext"))


@query("e5_round_trip", with_("payloads") + "select o_orderkey, hex(payload) as payload from payloads")
def e5_back(spark, sf_dir):
    coded = cipher.encrypt_ctr(payloads(spark, sf_dir), "payload", KEY, IV)
    return cipher.decrypt_ctr(coded.drop("payload"), "ciphertext", KEY, IV, "payload").select("o_orderkey", F.hex("payload").alias("payload"))


@query("e5_chunks_round_trip", with_("payloads") + "select o_orderkey, hex(payload) as payload from payloads")
def e5_chunks(spark, sf_dir):
    """Payloads in chunks of one block, encrypted whole, decrypted by chunk and put together again."""
    coded = cipher.encrypt_ctr(payloads(spark, sf_dir), "payload", KEY, IV).drop("payload")
    chunks = cipher.chunk_payloads(coded, "ciphertext", chunk_bytes=16)
    plain = cipher.decrypt_ctr(chunks, "ciphertext", KEY, IV, "payload", first_block=F.col("first_block"))
    return cipher.join_chunks(plain, ["o_orderkey"], "payload").withColumn("payload", F.hex("payload"))


# --- radar; integers where the oracle compares ---


def _integers(spark, sf_dir):
    number = lambda c: F.transform(c, lambda v: F.floor((v.cast("double") + 1) * 1000).cast("double"))
    return pulses(spark, sf_dir).select("scene_id", "az", number("re").alias("re"), number("im").alias("im"))


_P = f"""p as (select cast(vec_id // 480 as int) scene_id, cast(vec_id % 480 as int) az, cast(k as int) k, floor((embedding[2 * k + 1]::double + 1) * 1000)::bigint re, floor((embedding[2 * k + 2]::double + 1) * 1000)::bigint im from {filled(480)} e, range(32) r(k)),
sc as (select distinct cast(vec_id // 480 as int) scene_id from {filled(480)} e),
a as (select scene_id, cast(patch as int) patch, cast(i as int) i, cast(c as int) k, coalesce(re, 0) re, coalesce(im, 0) im from sc, range(4) x(patch), range(128) y(i), range(32) z(c) left join p on p.scene_id = sc.scene_id and p.az = patch * 120 + i and p.k = c)"""
_P = _P.replace("select scene_id, cast(patch", "select sc.scene_id, cast(patch").replace("from sc, range(4) x(patch), range(128) y(i), range(32) z(c) left join", "from sc cross join range(4) x(patch) cross join range(128) y(i) cross join range(32) z(c) left join")


def _long(df, line):
    return df.select("scene_id", "patch", line, F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("scene_id", "patch", line, "k", F.col("z.re").cast("long").alias("re"), F.col("z.im").cast("long").alias("im"))


@query("s5_assign_patches", f"with {_P} select * from a")
def s5(spark, sf_dir):
    return _long(radar.assign_patches(_integers(spark, sf_dir), scenes(spark, sf_dir)), "i")


@query("s7_pad_pow2", "select vec_id, size, cast(case when size <= 1 then 1 else 2 ** length(bin(size - 1)) end as int) padded, total from (select vec_id, cast(1 + vec_id % 64 as int) size, list_sum(list_transform(embedding[1:1 + vec_id % 64], lambda v: floor(v::double * 1000)))::bigint total from embeddings)")
def s7(spark, sf_dir):
    """On lines of 1 to 64 samples."""
    cut = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 64).cast("int")), lambda v: F.floor(v.cast("double") * 1000).cast("double")).alias("re"))
    padded = radar.pad_pow2(cut.withColumn("im", F.col("re")).withColumn("size", F.size("re")))
    return padded.select("vec_id", "size", F.size("re").alias("padded"), F.aggregate("re", F.lit(0.0), lambda a, b: a + b).cast("long").alias("total"))


@query("r8_corner_turn", f"with {_P} select scene_id, patch, k as j, i as k, re, im from a where k < 24")
def r8(spark, sf_dir):
    turned = radar.corner_turn(radar.assign_patches(_integers(spark, sf_dir), scenes(spark, sf_dir)), n_out=24, tile=7)
    return _long(turned, "j")


def _patches(spark, sf_dir):
    s = scenes(spark, sf_dir)
    return radar.assign_patches(pulses(spark, sf_dir), s), s


_F = """f as (select scene_id, avg(atan2(b, a)) * 1000.0 / (2 * pi()) fdc from (select scene_id, k, sum(x.re * y.re + x.im * y.im) a, sum(x.re * y.im - x.im * y.re) b from q x join q y using (scene_id, k) where y.az = x.az + 1 and y.az < 128 group by all) group by scene_id)"""
_Q = f"""q as materialized (select cast(vec_id // 480 as int) scene_id, vec_id % 480 az, k, embedding[2 * k + 1]::double re, embedding[2 * k + 2]::double im from {filled(480)} e, range(32) r(k))"""


#: The chain in SQL: patches x, chirps h (range) and g (azimuth, by scene), range-compressed y. A product of spectra is a circular correlation of lines.
_X = f"""{_Q}, s1 as (select distinct scene_id from q),
x as materialized (select s1.scene_id, cast(patch as int) patch, cast(i as int) i, cast(c as int) k, coalesce(re, 0) re, coalesce(im, 0) im from s1 cross join range(4) a(patch) cross join range(128) b(i) cross join range(32) d(c)
left join q on q.scene_id = s1.scene_id and q.az = patch * 120 + i and q.k = c)"""
_H = "h as materialized (select n, cos(p) re, sin(p) im from (select n, pi() * 1e13::double * t * t p from (select n, (n - 4.0::double) / 2e7::double t from range(8) r(n))))"
_G = f"""{_F}, rd as (select scene_id, fdc, (8e5::double + 12 * {radar.C}::double / 4e7::double) / sqrt(1 - (0.1::double * fdc / 14000.0::double) ** 2) rdc from f),
g as materialized (select scene_id, n, cos(p) re, sin(p) im from (select scene_id, n, 2 * pi() * fdc * t + pi() * (-2 * 7000.0::double ** 2 / (0.1::double * rdc)) * t * t p from
(select scene_id, fdc, rdc, n, (n - size / 2) / 1000.0::double t from (select *, floor(rdc * 0.01::double * 0.8::double / 7000.0::double * 1000.0::double) size from rd), range(128) r(n) where n < size)))"""
_Y = "y as materialized (select scene_id, patch, i, cast(m as int) k, sum(x.re * h.re + x.im * h.im) re, sum(x.im * h.re - x.re * h.im) im from x, range(32) r(m), h where x.k = (m + n) % 32 group by all)"
_DFT = "sum({0}.re * cos(w) {1} {0}.im * sin(w)) re, sum({0}.im * cos(w) {2} {0}.re * sin(w)) im"
_FORWARD, _BACK = (lambda name: _DFT.format(name, "+", "-")), (lambda name: _DFT.format(name, "-", "+"))
_MILLI = "cast(round(re * 1000) as bigint) re, cast(round(im * 1000) as bigint) im"
_HF = f"hf as materialized (select cast(f as int) k, {_FORWARD('h')} from (select *, 2 * pi() * ((f * n) % 32) / 32 w from h, range(32) r(f)) h group by all)"
_GF = f"gf as materialized (select scene_id, cast(f as int) k, {_FORWARD('g')} from (select *, 2 * pi() * ((f * n) % 128) / 128 w from g, range(128) r(f)) g group by all)"


def _thousandths(df, line="i"):
    """Samples as whole thousandths, so that sums in another order give the same numbers."""
    flat = df.select(*(c for c in ("scene_id", "patch", line) if c in df.columns), F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return flat.select(*(c for c in flat.columns if c != "z"), F.round(F.col("z.re") * 1000).cast("long").alias("re"), F.round(F.col("z.im") * 1000).cast("long").alias("im"))


@query("r1_chirp", f"with {_Q}, {_H} select scene_id, cast(c as int) k, cast(round(coalesce(re, 0) * 1000) as bigint) re, cast(round(coalesce(im, 0) * 1000) as bigint) im from (select distinct scene_id from q) cross join range(32) r(c) left join h on n = c")
def r1(spark, sf_dir):
    c = F.col
    return _thousandths(radar.chirp(scenes(spark, sf_dir), fc=F.lit(0.0), slope=c("slope"), tau=c("tau"), fs=c("fs"), length=c("rsize")))


@query("r2_references", f"with {_Q}, {_H}, {_HF}, {_G}, {_GF} select scene_id, 0 as patch, k, {_MILLI} from (select distinct scene_id from q), hf union all select scene_id, 1, k, {_MILLI} from gf")
def r2(spark, sf_dir):
    patches, s = _patches(spark, sf_dir)
    both = radar.range_reference(s).withColumn("patch", F.lit(0)).unionByName(radar.azimuth_reference(s, radar.doppler_centroid(patches, s)).withColumn("patch", F.lit(1)))
    return _thousandths(both)


@query("r3_doppler_centroid", f"with {_Q}, {_F} select scene_id, cast(round(fdc * 1000) as bigint) millihertz from f")
def r3(spark, sf_dir):
    """In thousandths of a hertz, so that sums in another order give the same numbers."""
    return radar.doppler_centroid(*_patches(spark, sf_dir)).select("scene_id", F.round(F.col("fdc") * 1000).cast("long").alias("millihertz"))


@query("r4_migration_table", f"with {_Q}, {_F} select scene_id, cast(i as int) i, cast(j as int) j, cast(round((1 / sqrt(1 - ((0.1::double * (j * 1000.0::double / 120 + fdc)) / 14000.0::double) ** 2) - 1) * (8e5::double + i * ({radar.C}::double / 4e7::double)) / ({radar.C}::double / 4e7::double)) as int) shift from f, range(24) a(i), range(128) b(j)")
def r4(spark, sf_dir):
    patches, s = _patches(spark, sf_dir)
    return radar.migration_table(s, radar.doppler_centroid(patches, s))


@query("r5_line_fft", f"with {_X} select scene_id, patch, i, k, {_MILLI} from (select scene_id, patch, i, cast(f as int) k, {_FORWARD('x')} from (select scene_id, patch, i, f, re, im, 2 * pi() * ((f * k) % 32) / 32 w from x, range(32) r(f)) x group by all)")
def r5(spark, sf_dir):
    return _thousandths(radar.line_fft(_patches(spark, sf_dir)[0]))


@query("r6_matched_filter", f"with {_X}, {_H}, {_HF} select scene_id, patch, i, k, {_MILLI} from (select scene_id, patch, i, k, x.re * hf.re + x.im * hf.im re, x.im * hf.re - x.re * hf.im im from x join hf using (k))")
def r6(spark, sf_dir):
    patches, s = _patches(spark, sf_dir)
    return _thousandths(radar.matched_filter(patches, radar.range_reference(s)))


@query("r7_range_compress", f"with {_X}, {_H}, {_Y} select scene_id, patch, i, k, {_MILLI} from y")
def r7(spark, sf_dir):
    return _thousandths(radar.range_compress(*_patches(spark, sf_dir)))


_SHIFT = f"cast(round((1 / sqrt(1 - ((0.1::double * (k * 1000.0::double / 120 + fdc)) / 14000.0::double) ** 2) - 1) * (8e5::double + j * ({radar.C}::double / 4e7::double)) / ({radar.C}::double / 4e7::double)) as int)"


@query("r9_migration_correct", f"with {_P}, {_Q}, {_F}, t as (select scene_id, patch, k j, i k, re, im from a where k < 24) select t.scene_id, t.patch, t.j, t.k, coalesce(o.re, 0) re, coalesce(o.im, 0) im from t join f using (scene_id) left join t o on o.scene_id = t.scene_id and o.patch = t.patch and o.k = t.k and o.j = t.j + {_SHIFT.replace('(k *', '(t.k *').replace('+ j *', '+ t.j *')}")
def r9(spark, sf_dir):
    """Moves integer lines by the shifts of the true scene."""
    s = scenes(spark, sf_dir)
    turned = radar.corner_turn(radar.assign_patches(_integers(spark, sf_dir), s), n_out=24, out="j")
    fdc = radar.doppler_centroid(radar.assign_patches(pulses(spark, sf_dir), s), s)
    return _long(radar.migration_correct(turned, s, fdc, line="j"), "j")


@query("r10_azimuth_compress", f"with {_X}, {_H}, {_Y}, {_G} select scene_id, patch, j, k, {_MILLI} from (select y.scene_id, patch, k j, cast(m as int) k, sum(y.re * g.re + y.im * g.im) re, sum(y.im * g.re - y.re * g.im) im from y, g, range(128) r(m) where y.scene_id = g.scene_id and y.k < 24 and y.i = (m + n) % 128 group by all)")
def r10(spark, sf_dir):
    patches, s = _patches(spark, sf_dir)
    turned = radar.corner_turn(radar.range_compress(patches, s), n_out=24)
    return _thousandths(radar.azimuth_compress(radar.line_fft(turned), radar.azimuth_reference(s, radar.doppler_centroid(patches, s))), "j")


@query("r11_multilook", f"with {_P}, m as (select scene_id, patch * 1 + i // 80 as r, k // 4 as c, sqrt(re * re + im * im) v from a where i < 80 and k < 24) select scene_id, cast(r as int) as row, cast(c as int) as col, cast(round(log2(sum(v) / 320) * 1000) as bigint) value from m group by all")
def r11(spark, sf_dir):
    """In thousandths, on integer lines: blocks of 80 lines and 4 bins."""
    s = scenes(spark, sf_dir)
    looked = radar.multilook(radar.assign_patches(_integers(spark, sf_dir), s), s, looks=4)
    return looked.select("scene_id", "row", "col", F.round(F.col("value") * 1000).cast("long").alias("value"))


@query("r12_quantize_minmax", "select label scene_id, cast(vec_id as int) as row, cast(i - 1 as int) as col, cast(case when hi = lo then 0 else least(floor(256 / (hi - lo) * (value - lo)), 255) end as int) as level from (select *, min(value) over (partition by label) lo, greatest(max(value) over (partition by label), 1.17549435e-38) hi from (select label, vec_id, i, round(embedding[i]::double, 6) value from embeddings, range(1, 65) r(i)))")
def r12(spark, sf_dir):
    """On the embeddings as images, with the label as the scene."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scene_id"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return radar.quantize_minmax(rows.select("scene_id", "row", "col", F.round(F.col("e").cast("double"), 6).alias("value")))


_FOCUS = f"""z as materialized (select scene_id, patch, j, cast(f as int) k, {_FORWARD('y')} from (select scene_id, patch, k j, f, re, im, 2 * pi() * ((f * i) % 128) / 128 w from y, range(128) r(f) where k < 24) y group by all),
mv as materialized (select t.scene_id, t.patch, t.j, t.k, coalesce(o.re, 0) re, coalesce(o.im, 0) im from z t join f using (scene_id) left join z o on o.scene_id = t.scene_id and o.patch = t.patch and o.k = t.k and o.j = t.j + {_SHIFT.replace('(k *', '(t.k *').replace('+ j *', '+ t.j *')}),
az as materialized (select mv.scene_id, patch, j, mv.k, mv.re * gf.re + mv.im * gf.im re, mv.im * gf.re - mv.re * gf.im im from mv join gf on gf.scene_id = mv.scene_id and gf.k = mv.k),
im as (select scene_id, patch, j, i, {_BACK('az')} from (select scene_id, patch, j, i, re, im, 2 * pi() * ((i * k) % 128) / 128 w from az, range(80) r(i)) az group by all),
lo as (select scene_id, patch as row, cast(j // 4 as int) as col, case when sum(sqrt(re * re + im * im)) = 0 then 0 else log2(sum(sqrt(re * re + im * im)) / 128 / 320) end value from im group by all)"""


@query("r13_focus", f"with {_X}, {_H}, {_Y}, {_G}, {_GF}, {_FOCUS} select scene_id, row, col, cast(case when hi = l then 0 else least(floor(256 / (hi - l) * (value - l)), 255) end as int) as level from (select *, min(value) over (partition by scene_id) l, greatest(max(value) over (partition by scene_id), 1.17549435e-38) hi from lo)")
def r13(spark, sf_dir):
    return radar.focus(pulses(spark, sf_dir), scenes(spark, sf_dir))
