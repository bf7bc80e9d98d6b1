"""Queries of the calibration, comparison and display operators."""

import uuid

from framelake.functions.scratch import Scratch, scratch_path, written
from framelake.operators import calib, compare
from framelake.plans.catalog import ORACLES, query
from framelake.plans.fixtures import frames, image, maps, table, with_

_OFF = "off_ as (select f.frame_id, f.y, f.x, cast((f.v - m.off + 65536) % 65536 as int) v from frames f join maps m using (y, x))"
_REPLACED = """near as (select b.y, b.x, g.y gy, g.x gx from maps b join maps g on g.y between b.y - 1 and b.y + 1 and g.x between b.x - 1 and b.x + 1 where b.bad = 1 and g.bad = 0),
mean_ as (select s.frame_id, n.y, n.x, sum(s.v) // count(*) mean from near n join {src} s on s.y = n.gy and s.x = n.gx group by all),
rep as (select s.frame_id, s.y, s.x, cast(case when m.bad = 1 then coalesce(mean_.mean, 0) else s.v end as int) v from {src} s join maps m using (y, x) left join mean_ on mean_.frame_id = s.frame_id and mean_.y = s.y and mean_.x = s.x)"""
_PREPARED = _OFF + ",\n" + _REPLACED.format(src="off_") + ",\nprep as (select frame_id, y, x, v from frames where frame_id < 4 union all select frame_id, y, x, v from rep where frame_id >= 4)"
_SCRUBBED = """scrub(t, y, x, p2, p1) as (select 1, a.y, a.x, cast(a.v as bigint), cast(b.v as bigint) from prep a join prep b using (y, x) where a.frame_id = 0 and b.frame_id = 1
union all select s.t + 1, s.y, s.x, s.p1, ((case when c.v > 2 * ((s.p2 + s.p1 + n.v + f.v) // 4) then (s.p2 + s.p1 + n.v + f.v) // 4 else c.v end) * m.gain >> 16) & 65535
from scrub s join prep c on c.frame_id = s.t + 1 and c.y = s.y and c.x = s.x join prep n on n.frame_id = s.t + 2 and n.y = s.y and n.x = s.x join prep f on f.frame_id = s.t + 3 and f.y = s.y and f.x = s.x join maps m on m.y = s.y and m.x = s.x)"""


@query("s4_frame_roles", with_("frames") + "select frame_id, y, x, v, case when frame_id < 2 then 'prior' when frame_id > (select max(frame_id) from frames) - 2 then 'later' else 'data' end as role from frames")
def s4(spark, sf_dir):
    return calib.frame_roles(frames(spark, sf_dir))


#: Images of odd sizes: image k lacks its last 1 + k % 5 rows and 2 + k % 7 columns.
_ODD = "c as (select *, 63 - image_id % 5 as h, 62 - image_id % 7 as w from image), d as (select * from c where y < h and x < w)"


@query("s8_pad_edge", with_("image", more=f"{_ODD}, g as (select image_id, h, w, ty, tx from (select distinct image_id, h, w from d), range(64) a(ty), range(64) b(tx) where ty < (h + 7) // 8 * 8 and tx < (w + 7) // 8 * 8)") + "select g.image_id, cast(ty as int) y, cast(tx as int) x, v from g join d on d.image_id = g.image_id and d.y = least(ty, g.h - 1) and d.x = least(tx, g.w - 1)")
def s8(spark, sf_dir):
    """All images, each without some of its last rows and columns, so that there is something to pad."""
    return calib.pad_edge(image(spark, sf_dir).where("y < 63 - image_id % 5 and x < 62 - image_id % 7"))


@query("i1_offset_correct", with_("frames", "maps", more=_OFF) + "select * from off_")
def i1(spark, sf_dir):
    return calib.offset_correct(frames(spark, sf_dir), maps(spark, sf_dir)).select("frame_id", "y", "x", "v")


@query("i2_replace_masked", with_("frames", "maps", more=_REPLACED.format(src="frames")) + "select * from rep")
def i2(spark, sf_dir):
    return calib.replace_masked(frames(spark, sf_dir), maps(spark, sf_dir))


_MEAN = "(lag(v, 2) over w + lag(v, 1) over w + lead(v, 1) over w + lead(v, 2) over w) // 4"


@query("i3_scrub_window", with_("frames") + f"select frame_id, y, x, cast(case when v > 2 * m then m else v end as int) v from (select *, {_MEAN} m from frames window w as (partition by y, x order by frame_id))")
def i3_window(spark, sf_dir):
    return calib.scrub_temporal(frames(spark, sf_dir), mode="window").select("frame_id", "y", "x", "v")


@query("i3_scrub_recursive", with_("frames", "maps", more="prep as (select * from frames),\n" + _SCRUBBED, recursive=True) + "select cast(t as int) frame_id, y, x, cast(p1 as int) v from scrub where t >= 2")
def i3_recursive(spark, sf_dir):
    gained = frames(spark, sf_dir).join(maps(spark, sf_dir).select("y", "x", "gain"), ["y", "x"])
    return calib.scrub_temporal(gained, mode="recursive", gain="gain").select("frame_id", "y", "x", "v")


@query("i3_scrub_business", "select user_id, event_id, cast(case when v > 2 * m then m else v end as int) v from (select *, " + _MEAN + " m from (select user_id, event_id, cast(floor(value * 100) as int) v from events) window w as (partition by user_id order by event_id))")
def i3_business(spark, sf_dir):
    """The same operator on an ordinary event table."""
    events = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "cast(floor(value * 100) as int) v")
    return calib.scrub_temporal(events, partition=["user_id"], order="event_id").select("user_id", "event_id", "v")


@query("i4_gain_correct", with_("frames", "maps") + "select frame_id, y, x, cast((v * gain >> 16) & 65535 as int) v from (select f.frame_id, f.y, f.x, cast(f.v as bigint) v, m.gain from frames f join maps m using (y, x))")
def i4(spark, sf_dir):
    return calib.gain_correct(frames(spark, sf_dir), maps(spark, sf_dir)).select("frame_id", "y", "x", "v")


@query("i5_bin_spatial", with_("frames") + "select frame_id, cast(y // 2 as int) y, cast(x // 2 as int) x, cast(sum(v) as bigint) v from frames group by all having count(*) = 4")
def i5(spark, sf_dir):
    return calib.bin_spatial(frames(spark, sf_dir))


@query("i6_coadd", with_("frames") + "select y, x, cast(sum(v) as bigint) v from frames group by all")
def i6(spark, sf_dir):
    return calib.coadd(frames(spark, sf_dir))


@query("i7_calibrate", with_("frames", "maps", more=_PREPARED + ",\n" + _SCRUBBED, recursive=True) + "select cast(y // 2 as int) y, cast(x // 2 as int) x, cast(sum(p1) as bigint) v from scrub where t >= 2 group by all")
def i7(spark, sf_dir):
    """Also I8: the first four frames come prepared."""
    m = maps(spark, sf_dir)
    return calib.calibrate(frames(spark, sf_dir), m, m, m)


@query("i7_calibrate_campaign", ORACLES["i7_calibrate"])
def i7_campaign(spark, sf_dir):
    """Frames in two parts to a table bucketed by tile, calibrated from there without a shuffle."""
    m, whole, name = maps(spark, sf_dir), frames(spark, sf_dir), f"framelake_campaign_{uuid.uuid4().hex}"
    with Scratch(spark, "campaign") as work:
        try:
            path = work.path("tiles")
            for mode, part in (("errorifexists", "frame_id < 7"), ("append", "frame_id >= 7")):
                calib.write_tiles(calib.tiles(whole.where(part), m, m, m, tile=16), name, n_buckets=8, path=path, mode=mode)
            return written(calib.calibrate_tiles(spark.table(name), tile=16), scratch_path(spark, "result"))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("i8_calibrate_clean", with_("frames", "maps", more=_PREPARED.replace("frame_id < 4", "frame_id < 0").replace("frame_id >= 4", "frame_id >= 0") + ",\n" + _SCRUBBED, recursive=True) + "select cast(y // 2 as int) y, cast(x // 2 as int) x, cast(sum(p1) as bigint) v from scrub where t >= 2 group by all")
def i8(spark, sf_dir):
    m = maps(spark, sf_dir)
    return calib.calibrate(frames(spark, sf_dir), m, m, m, first_prepared=0)


_PAIR = """a as (select o_orderkey, cast(floor(o_totalprice) as bigint) price from orders),
b as (select o_orderkey, price + case when o_orderkey % 50 = 0 then 2 else 0 end + case when o_orderkey % 75 = 0 then 1 else 0 end as price from a where o_orderkey % 200 <> 0),
d as (select o_orderkey, a.price a, b.price b from a full join b using (o_orderkey) where abs(a.price - b.price) > 1 or a.price is null or b.price is null)"""


def _pair(spark, sf_dir):
    a = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(floor(o_totalprice) as bigint) price")
    b = a.where("o_orderkey % 200 <> 0").selectExpr("o_orderkey", "price + case when o_orderkey % 50 = 0 then 2 else 0 end + case when o_orderkey % 75 = 0 then 1 else 0 end as price")
    return a, b


@query("v1_compare_tables", f"with {_PAIR} select * from d")
def v1(spark, sf_dir):
    return compare.compare_tables(*_pair(spark, sf_dir), keys=["o_orderkey"], value="price")


@query("v2_compare_summary", f"with {_PAIR} select count(*) n_errors, max(abs(a - b)) max_difference from d")
def v2(spark, sf_dir):
    return compare.compare_summary(*_pair(spark, sf_dir), keys=["o_orderkey"], value="price")


@query("v3_first_mismatch", f"with {_PAIR} select * from d order by o_orderkey limit 5")
def v3(spark, sf_dir):
    return compare.first_mismatch(*_pair(spark, sf_dir), keys=["o_orderkey"], value="price", n=5)


@query("t1_channel_mean", with_("frames") + "select cast(frame_id // 3 as int) frame_id, y, x, cast(floor(avg(v)) as int) v from frames group by all")
def t1(spark, sf_dir):
    """Three frames as the channels of one."""
    return calib.channel_mean(frames(spark, sf_dir).selectExpr("cast(frame_id div 3 as int) frame_id", "y", "x", "v"))


@query("t2_sqrt_stretch", with_("frames") + "select y, x, cast(least(greatest(floor(sqrt(v)) * 300, 0), 65535) as int) v from (select y, x, sum(v) v from frames group by all)")
def t2(spark, sf_dir):
    return calib.sqrt_stretch(calib.coadd(frames(spark, sf_dir)), brightness=300)
