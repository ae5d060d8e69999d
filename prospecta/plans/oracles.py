"""Independent DuckDB SQL of the visibility queries, in naive form (cross joins, no rewrites)."""

from __future__ import annotations

import re

from prospecta.fixtures import FIXTURES

_BASIS_POINTS = "x - 0.5 as rx, y - 0.25 as ry, z - 0.125 as rz"

#: Named steps that the queries build on; each may use those before it.
STEPS = dict(FIXTURES) | {
    "near": """select o.origin_id, o.ox, o.oy, s.seg_id, x1-ox as x1, y1-oy as y1, x2-ox as x2, y2-oy as y2,
        sqrt((x1-ox)*(x1-ox)+(y1-oy)*(y1-oy)) as d1, sqrt((x2-ox)*(x2-ox)+(y2-oy)*(y2-oy)) as d2 from fx_origins2d o, fx_segments2d s
        where sqrt((x1-ox)*(x1-ox)+(y1-oy)*(y1-oy)) <= 30 or sqrt((x2-ox)*(x2-ox)+(y2-oy)*(y2-oy)) <= 30""",
    "rays": "select cast(i as int) as ray_id, cos(i*(2*pi()/360)) as c, sin(i*(2*pi()/360)) as s from range(360) t(i)",
    "crossings": """select origin_id, seg_id, ray_id, (x1*(-(y2-y1)) - y1*(-(x2-x1))) / nullif(c*(-(y2-y1)) - s*(-(x2-x1)), 0) as t,
        (c*y1 - s*x1) / nullif(c*(-(y2-y1)) - s*(-(x2-x1)), 0) as u from near, rays""",
    "hits": "select * from crossings where t > 0 and t < 30 and u between 0 and 1",
    "radii": """select o.origin_id, r.ray_id, coalesce(min(h.t), 30) as r, any_value(c) as c, any_value(s) as s, any_value(ox) as ox, any_value(oy) as oy
        from fx_origins2d o cross join rays r left join hits h on h.origin_id = o.origin_id and h.ray_id = r.ray_id group by o.origin_id, r.ray_id""",
    "areas": """select origin_id, abs(sum(dx*ny - nx*dy))/2 as area from (select a.origin_id, a.c*a.r as dx, a.s*a.r as dy, b.c*b.r as nx, b.s*b.r as ny
        from radii a join radii b on a.origin_id = b.origin_id and b.ray_id = (a.ray_id+1)%360) group by origin_id""",
    "stats2d": "select origin_id, min(r) as min_distance, max(r) as max_distance, avg(r) as mean_distance, stddev_pop(r) as std_distance from radii group by origin_id",
    "wallpts": """select origin_id, seg_id, cast(i as int) as i, x1+(x2-x1)*(i/(n-1+1e-6)) as x, y1+(y2-y1)*(i/(n-1+1e-6)) as y from
        (select *, cast(floor(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/(15.0/360)) as bigint) as n from near) w, lateral (select unnest(range(n)) as i)""",
    "wallbins": """select origin_id, sqrt(x*x+y*y) as t, cast(round_even((atan2(x, y) + case when atan2(x, y) < 0 then 2*pi() else 0 end)/(2*pi()/359), 0) as int) as ray_id
        from wallpts where sqrt(x*x+y*y) <= 30""",
    "dradii": """select o.origin_id, cast(i as int) as ray_id, least(coalesce(min(t), 1000), 30) as r, cast(cast(any_value(sin(i*(2*pi()/359))) as float) as double) as c,
        cast(cast(any_value(cos(i*(2*pi()/359))) as float) as double) as s from fx_origins2d o cross join range(360) g(i) left join wallbins w on w.origin_id = o.origin_id and w.ray_id = i group by o.origin_id, i""",
    "dareas": """select origin_id, abs(sum(dx*ny - nx*dy))/2 as area from (select a.origin_id, a.c*a.r as dx, a.s*a.r as dy, b.c*b.r as nx, b.s*b.r as ny
        from dradii a join dradii b on a.origin_id = b.origin_id and b.ray_id = (a.ray_id+1)%360) group by origin_id""",
    "pieces": """select origin_id, seg_id, cast(k as int) as piece, x1+(x2-x1)*(k/n) as px1, y1+(y2-y1)*(k/n) as py1, case when n=1 then x2 else x1+(x2-x1)*((k+1)/n) end as px2,
        case when n=1 then y2 else y1+(y2-y1)*((k+1)/n) end as py2 from (select *, case when sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 5 then
        cast(ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/5) as bigint) else 1 end as n from near) w, lateral (select unnest(range(n)) as k)""",
    "polar": "select *, atan2(py1,px1) as b0, atan2(py2,px2) as b1, sqrt(px1*px1+py1*py1) as e0, sqrt(px2*px2+py2*py2) as e1 from pieces",
    "ccw": """select origin_id, seg_id, piece, case when w then b1 else b0 end as a0, case when w then b0 else b1 end as a1, case when w then e1 else e0 end as d0, case when w then e0 else e1 end as d1
        from (select *, (b1-b0) - 2*pi()*floor((b1-b0)/(2*pi())) > pi() as w from polar)""",
    "cutpieces": """select origin_id, seg_id, piece, 0 as part, a0, d0, case when a0>0 and a1<0 and a0-a1>=pi() then pi() else a1 end as a1, d1 from ccw
        union all select origin_id, seg_id, piece, 1, -pi(), d0, a1, d1 from ccw where a0>0 and a1<0 and a0-a1>=pi()""",
    "span": "select origin_id, min(least(a0,a1)) as low, max(greatest(a0,a1)) as high from cutpieces group by origin_id",
    "grid": "select origin_id, cast(k as int) as k, case when k=119 then high else low + k*((high-low)/119) end as theta from span, range(120) t(k)",
    "env": """select g.origin_id, g.k, g.theta, greatest(least(coalesce(min(case when c.a0=c.a1 then least(c.d0,c.d1) else c.d0+(c.d1-c.d0)/nullif(c.a1-c.a0,0)*(g.theta-c.a0) end), 30), 30), 0) as r
        from grid g left join cutpieces c on c.origin_id=g.origin_id and g.theta >= least(c.a0,c.a1) and g.theta <= greatest(c.a0,c.a1) group by g.origin_id, g.k, g.theta""",
    "careas": "select o.origin_id, coalesce(avg(r*r)*pi(), pi()*900) as area from fx_origins2d o left join env e on e.origin_id=o.origin_id group by o.origin_id",
    "edge20": "select * from fx_segments2d where seg_id < 20",
    "bsample": """select cast(row_number() over (order by ox, oy) - 1 as bigint) as origin_id, ox, oy from (select distinct round_even(x1+(x2-x1)*((i+0.5)/n), 12) as ox, round_even(y1+(y2-y1)*((i+0.5)/n), 12) as oy
        from (select *, greatest(cast(ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/2.5) as bigint), 1) as n from edge20) w, lateral (select unnest(range(n)) as i))""",
    "bsample3": """select cast(row_number() over (order by ox, oy) - 1 as bigint) as origin_id, ox, oy from (select distinct round_even(x1+(x2-x1)*t, 12) as ox, round_even(y1+(y2-y1)*t, 12) as oy
        from edge20, (select case when i=4 then 1.0 else i/4 end as t from range(5) r(i)))""",
    "bhits": """select origin_id, ray_id, min(t) as t from (select origin_id, ray_id, ((x1-ox)*(-(y2-y1)) - (y1-oy)*(-(x2-x1))) / nullif(c*(-(y2-y1)) - s*(-(x2-x1)), 0) as t,
        (c*(y1-oy) - s*(x1-ox)) / nullif(c*(-(y2-y1)) - s*(-(x2-x1)), 0) as u from bsample, edge20, rays
        where sqrt((x1-ox)*(x1-ox)+(y1-oy)*(y1-oy)) <= 30 or sqrt((x2-ox)*(x2-ox)+(y2-oy)*(y2-oy)) <= 30) where t > 0 and t < 30 and u between 0 and 1 group by 1, 2""",
    "bradii": "select b.origin_id, r.ray_id, coalesce(h.t, 30) as r, c, s from bsample b cross join rays r left join bhits h on h.origin_id=b.origin_id and h.ray_id=r.ray_id",
    "dirs": """select cast(i as int) as dir_id, cast(cast(sin(phi)*cos(th) as float) as double) as dx, cast(cast(sin(phi)*sin(th) as float) as double) as dy, cast(cast(cos(phi) as float) as double) as dz
        from (select i, acos(1-2*(i+0.5)/300) as phi, pi()*(1+sqrt(5))*(i+0.5) as th from range(300) t(i))""",
    # View direction (1,0,0): right = (0,-1,0), up = (0,0,1).
    "fdirs": "select * from dirs where dx > 0 and abs(atan2(-dy, dx)) <= 0.6 and abs(atan2(dz, dx)) <= 0.45",
    "pts": f"select *, sqrt(rx*rx+ry*ry+rz*rz) as dist from (select *, {_BASIS_POINTS} from fx_points3d) where sqrt(rx*rx+ry*ry+rz*rz) between 0 and 6",
    "near3": "select point_id, arg_min(dir_id, (-dot, dir_id)) as dir_id, any_value(dist) as dist from (select point_id, dir_id, dist, rx/(dist+1e-5)*dx+ry/(dist+1e-5)*dy+rz/(dist+1e-5)*dz as dot from pts, dirs) group by point_id",
    "fnear3": "select point_id, arg_min(dir_id, (-dot, dir_id)) as dir_id, any_value(dist) as dist from (select point_id, dir_id, dist, rx/(dist+1e-5)*dx+ry/(dist+1e-5)*dy+rz/(dist+1e-5)*dz as dot from pts, fdirs) group by point_id",
    "bins3": "select d.dir_id, any_value(dx) as dx, any_value(dy) as dy, any_value(dz) as dz, coalesce(min(dist), 1e5) as dist from dirs d left join near3 n on n.dir_id=d.dir_id group by d.dir_id",
    "fbins3": "select d.dir_id, any_value(dx) as dx, any_value(dy) as dy, any_value(dz) as dz, coalesce(min(dist), 1e5) as dist from fdirs d left join fnear3 n on n.dir_id=d.dir_id group by d.dir_id",
    "known3": "select dir_id, dx, dy, dz, case when dist > 6 then 0 else dist end as dist from bins3",
    "clipped3": """select dir_id, case when dist*dz < -2-0.125 then sqrt(greatest(0, dist*dist - (dist + (-2-0.125))*(dist + (-2-0.125)))) when dist*dz > 2-0.125
        then sqrt(greatest(0, dist*dist - (dist-(2-0.125))*(dist-(2-0.125)))) else dist end as dist from bins3""",
    "poses": """select *, -(m0*tx+m3*ty+m6*tz) as cx, -(m1*tx+m4*ty+m7*tz) as cy, -(m2*tx+m5*ty+m8*tz) as cz, m6/sqrt(m6*m6+m7*m7+m8*m8) as vx, m7/sqrt(m6*m6+m7*m7+m8*m8) as vy,
        m8/sqrt(m6*m6+m7*m7+m8*m8) as vz from (select *, 1-s*(qy*qy+qz*qz) as m0, s*(qx*qy-qz*qw) as m1, s*(qx*qz+qy*qw) as m2, s*(qx*qy+qz*qw) as m3, 1-s*(qx*qx+qz*qz) as m4, s*(qy*qz-qx*qw) as m5,
        s*(qx*qz-qy*qw) as m6, s*(qy*qz+qx*qw) as m7, 1-s*(qx*qx+qy*qy) as m8 from (select *, 2.0/(qx*qx+qy*qy+qz*qz+qw*qw) as s from fx_cameras))""",
    "cam": "select cam_id, point_id, m0*x+m1*y+m2*z+tx as X0, m3*x+m4*y+m5*z+ty as Y0, m6*x+m7*y+m8*z+tz as depth from fx_points3d, poses",
    "pin": "select cam_id, point_id, depth, round_even(40*(X0/depth)+32, 0) as px, round_even(40*(Y0/depth)+24, 0) as py from cam where depth > 0",
    "framed": "select cam_id, point_id, depth, cast(px as bigint) as px, cast(py as bigint) as py, cast(py as bigint)*64+cast(px as bigint) as pix from pin where px between 0 and 63 and py between 0 and 47",
    "seen": "select cam_id, pix, depth, point_id from framed qualify row_number() over (partition by cam_id, pix order by depth, point_id) = 1",
    # The basis of the view direction, with the small terms of its normalisation.
    "basis": "select f, f/(f+1e-9) as q from (select 1/(1+1e-9) as f)",
    "fru": """select * from (select p.*, -q*(y-0.25) as cx, q*f*(z-0.125) as cy, f*(x-0.5) as depth from fx_points3d p, basis)
        where depth > 1e-6 and depth between 0 and 40 and abs(cx/depth) <= tan(0.6) and abs(cy/depth) <= tan(0.45)""",
    "ras": """select *, vi*64+ui as pix from (select *, least(greatest(cast(trunc(((cx/depth/tan(0.6))*0.5+0.5)*63) as int), 0), 63) as ui, least(greatest(cast(trunc((0.5-(cy/depth/tan(0.45))*0.5)*47) as int), 0), 47) as vi from fru)""",
    "won": """select pix, ui, vi, depth, point_id, cast(trunc(least(greatest(r*255,0),255)) as int) as r8, cast(trunc(least(greatest(g*255,0),255)) as int) as g8, cast(trunc(least(greatest(b*255,0),255)) as int) as b8
        from ras qualify row_number() over (partition by pix order by depth, point_id) = 1""",
    "nn": "select src, dst, dist, rank from (select a.point_id as src, b.point_id as dst, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) as dist, cast(row_number() over (partition by a.point_id order by sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)), b.point_id) as int) as rank from fx_knn a join fx_knn b on a.point_id <> b.point_id) where rank <= 3",
    "pairs": "select distinct least(src,dst) as src, greatest(src,dst) as dst from nn",
    "twoway": "select src, dst from pairs union all select dst, src from pairs",
    "gnodes": "select cast(row_number() over (order by point_id) - 1 as bigint) as node_id, x, y, z from fx_knn union all select count(*), 0, 0, 0 from fx_knn",
    "gedges": """select a.node_id as src, b.node_id as dst, 'knn' as kind from twoway e join (select point_id, row_number() over (order by point_id) - 1 as node_id from fx_knn) a on a.point_id=e.src join (select point_id, row_number() over (order by point_id) - 1 as node_id from fx_knn) b on b.point_id=e.dst
        union all select (select count(*) from fx_knn), node_id, 'origin' from gnodes where node_id < (select count(*) from fx_knn) union all select node_id, (select count(*) from fx_knn), 'origin' from gnodes where node_id < (select count(*) from fx_knn)""",
}

STEPS["walked"] = """select distinct walk_id, -1 as step, 0.5::double as x, 0.5::double as y, 0.25::double as th, 0.25::double as yaw from fx_noise union all
    select walk_id, step, case when ok1 then x1 when ok2 then x2 else x end, case when ok1 then y1 when ok2 then y2 else y end, case when ok1 then th1 else th2 end,
        0.9*yaw + 0.1*(case when ok1 then th1 else th2 end) + n_view from (
      select *, exists (select 1 from fx_rects where x1 between xmin and xmax and y1 between ymin and ymax) as ok1, exists (select 1 from fx_rects where x2 between xmin and xmax and y2 between ymin and ymax) as ok2 from (
        select *, x+len*cos(th1) as x1, y+len*sin(th1) as y1, x+len*cos(th2) as x2, y+len*sin(th2) as y2 from (
          select n.walk_id, n.step, w.x, w.y, w.yaw, w.th+n_theta as th1, w.th+n_theta+pi()+n_bounce as th2, greatest(0.0, 0.2+n_step) as len, n_view
          from walked w join fx_noise n on n.walk_id = w.walk_id and n.step = w.step+1)))"""

_XYZ = "fx_points3d"

#: The queries by ID.
QUERIES = {
    "src_json_segments": "select cast(row_number() over (order by seg_id) - 1 as bigint) as seg_id, x1, y1, x2, y2 from fx_segments2d",
    "sink_json_segments": "select cast(row_number() over (order by seg_id) - 1 as bigint) as seg_id, x1, y1, x2, y2 from fx_segments2d",
    "src_ply": "select cast(row_number() over (order by point_id) - 1 as bigint) as point_id, x, y, z, round(round_even(r*255, 0)/255.0, 6) as r, round(round_even(g*255, 0)/255.0, 6) as g, round(round_even(b*255, 0)/255.0, 6) as b from fx_points3d",
    "src_pcd": "select cast(row_number() over (order by point_id) - 1 as bigint) as point_id, x, y, z from fx_points3d qualify (row_number() over (order by point_id) - 1) % 5 = 0",
    "src_camera_csv": "select 'set/DSC_0' || cam_id || '.JPG' as image_name, qx, qy, qz, qw, tx, ty, tz from fx_cameras",
    "image_select": "select 'set/DSC_0' || cam_id || '.JPG' as image_name, qx, qy, qz, qw, tx, ty, tz from fx_cameras where cam_id = 3",
    "src_rhino_layer": "select min(curve_id) as layer_index from fx_polyline where 'L' || curve_id % 7 = 'L3' or 'site::L' || curve_id % 7 = 'L3'",
    "src_rhino_extract": """select curve_id, cast(part as int) as part, x1, y1, z1, x2, y2, z2 from (select curve_id, row_number() over w - 1 as part, x as x1, y as y1, z as z1, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2 from fx_polyline where curve_id % 2 = 0 window w as (partition by curve_id order by vertex_idx)) where x2 is not null
        union all select curve_id, 0, arg_min(x, vertex_idx), arg_min(y, vertex_idx), arg_min(z, vertex_idx), arg_max(x, vertex_idx), arg_max(y, vertex_idx), arg_max(z, vertex_idx) from fx_polyline where curve_id % 2 = 1 group by curve_id""",
    "src_rhino_point": "select curve_id, vertex_idx, cast(x as double) as x, cast(y as double) as y, cast(z as double) as z from fx_polyline",
    "polyline_to_segments": "select curve_id, cast(part as int) as part, x1, y1, z1, x2, y2, z2 from (select curve_id, row_number() over w - 1 as part, x as x1, y as y1, z as z1, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2 from fx_polyline window w as (partition by curve_id order by vertex_idx)) where x2 is not null",
    "curve_chord": "select curve_id, arg_min(x, vertex_idx) as x1, arg_min(y, vertex_idx) as y1, arg_min(z, vertex_idx) as z1, arg_max(x, vertex_idx) as x2, arg_max(y, vertex_idx) as y2, arg_max(z, vertex_idx) as z2 from fx_polyline group by curve_id",
    "drop_z": "select curve_id, cast(part as int) as part, x1, y1, x2, y2 from (select curve_id, row_number() over w - 1 as part, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from fx_polyline window w as (partition by curve_id order by vertex_idx)) where x2 is not null",
    "src_array": "select * from fx_segments2d where seg_id < 50",
    "seg_radius_filter": "select origin_id, seg_id from near",
    "seg_translate": "select origin_id, seg_id, x1, y1, x2, y2, round(d1, 6) as d1, round(d2, 6) as d2 from near",
    "pt_range_filter": "select point_id from pts",
    "pt_dist_filter_2d": "select origin_id, count(*) as n, round(sum(t), 6) as total from wallbins group by origin_id",
    "frustum_dirs": "select dir_id from fdirs",
    "frustum_points": "select point_id, round(cx, 6) as cx, round(cy, 6) as cy, round(depth, 6) as depth from fru",
    "in_front": "select cam_id, point_id from cam where depth > 0",
    "in_frame": "select cam_id, point_id, px, py, pix from framed",
    "in_union_rects": "select origin_id from fx_origins2d o where exists (select 1 from fx_rects where ox between xmin and xmax and oy between ymin and ymax)",
    "rect_area": "select rect_id, greatest(0.0, xmax-xmin)*greatest(0.0, ymax-ymin) as area from fx_rects",
    "valid_rays": "select dir_id, round(dist, 6) as dist from bins3 where dist <= 6 and dist > 0",
    "gen_rays_ccw": "select ray_id, round(c, 6)+0.0 as dx, round(s, 6)+0.0 as dy from rays",
    "gen_rays_cw": "select cast(i as int) as ray_id, round(cast(cast(sin(i*(2*pi()/359)) as float) as double), 6)+0.0 as dx, round(cast(cast(cos(i*(2*pi()/359)) as float) as double), 6)+0.0 as dy from range(360) t(i)",
    "gen_fibonacci_sphere": "select dir_id, round(dx, 6) as dx, round(dy, 6) as dy, round(dz, 6) as dz from dirs",
    "gen_theta_grid": "select origin_id, k, round(theta, 6) as theta from grid",
    "subdivide_long_segments": "select origin_id, seg_id, piece, round(px1, 6) as px1, round(py1, 6) as py1, round(px2, 6) as px2, round(py2, 6) as py2 from pieces",
    "segment_to_points": "select origin_id, seg_id, i, round(x, 6)+0.0 as x, round(y, 6)+0.0 as y from wallpts",
    "sample_boundary": "select origin_id, round(ox, 6) as ox, round(oy, 6) as oy from bsample",
    "sample_boundary_ends": "select origin_id, round(ox, 6) as ox, round(oy, 6) as oy from bsample3",
    "wrap_split": "select origin_id, seg_id, piece, part, round(a0, 6) as a0, round(d0, 6) as d0, round(a1, 6) as a1, round(d1, 6) as d1 from cutpieces",
    "background_interval": "select origin_id, round(low, 6) as a0, 30.0::double as d0, round(high, 6) as a1, 30.0::double as d1 from span",
    "uniform_down_sample": "select point_id from fx_points3d where point_id % 7 = 0",
    "gen_pixel_grid": "select cast(i as int) as pix, cast(i%64 as int) as ui, cast(floor(i/64) as int) as vi from range(64*48) t(i)",
    "ray_segment_join": "select origin_id, seg_id, ray_id, round(t, 6) as t from hits",
    "grid_interval_join": "select origin_id, k, round(r, 6) as r from env",
    "nearest_ray_2d": "select origin_id, ray_id, count(*) as n from wallbins group by origin_id, ray_id",
    "nearest_dir_3d": "select point_id, dir_id from near3",
    "nearest_dir_frustum": "select point_id, dir_id from fnear3",
    "nearest_color": "select dir_id, point_id, r, g, b from (select dir_id, point_id, r, g, b, row_number() over (partition by dir_id order by sqrt((ex-rx)*(ex-rx)+(ey-ry)*(ey-ry)+(ez-rz)*(ez-rz)), point_id) as k from (select dir_id, dx*dist as ex, dy*dist as ey, dz*dist as ez from known3 where dist > 0) e, pts) where k = 1",
    "knn_graph": "select src, dst from twoway",
    "safe_knn": "select src, dst, round(cast(cast(sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) as float) as double), 6) as weight from twoway join fx_knn a on a.point_id=src join fx_knn b on b.point_id=dst",
    "edge_endpoint_join": "select src, dst, b.x-a.x as dx, b.y-a.y as dy, b.z-a.z as dz from twoway join fx_knn a on a.point_id=src join fx_knn b on b.point_id=dst",
    "origin_star_edges": "select src, dst from gedges where kind = 'origin'",
    "gather_visible": "select cam_id, s.point_id, x, y, z, r, g, b from seen s join fx_points3d p on p.point_id=s.point_id",
    "batch_origins": "select origin_id, round(area, 6) as area from areas",
    "min_hit": "select origin_id, ray_id, round(r, 6) as r from radii",
    "min_envelope": "select origin_id, k, round(theta, 6) as theta, round(r, 6) as r from env",
    "bin_min_2d": "select origin_id, ray_id, round(r, 6) as r from dradii",
    "bin_min_3d": "select dir_id, round(dist, 6) as dist from bins3",
    "unknown_policy": "select dir_id, round(case when dist > 6 then 0 else dist end, 6) as zero, round(case when dist > 6 then 6 else dist end, 6) as far from bins3",
    "polygon_area": "select origin_id, round(area, 6) as area from areas",
    "mean_square_area": "select origin_id, round(area, 6) as area from careas",
    "distance_stats": "select origin_id, round(min_distance, 6) as min_distance, round(max_distance, 6) as max_distance, round(mean_distance, 6) as mean_distance, round(std_distance, 6) as std_distance from stats2d",
    "sphere_volume": "select round(4*pi()/(3*count(*))*sum(dist*dist*dist), 6) as vol from known3",
    "ray_stats_3d": "select round(min(dist), 6) as min_dist, round(max(dist), 6) as max_dist, round(avg(dist), 6) as mean_dist, round(stddev_pop(dist), 6) as std_dist from known3",
    "zbuffer_image": "select cam_id, pix, point_id from seen",
    "zbuffer_render": "select pix, point_id, round(depth, 6) as depth from won",
    "raster_scatter": "select cast(i as int) as pix, coalesce(r8, 0) as r8, coalesce(g8, 0) as g8, coalesce(b8, 0) as b8, coalesce(round(depth, 6), -1) as depth from range(64*48) t(i) left join won on pix = i",
    "area_normalise": "select rect_id, round(area/sum(area) over (), 6) as share from (select rect_id, greatest(0.0, xmax-xmin)*greatest(0.0, ymax-ymin) as area from fx_rects)",
    "distinct_points": "select count(*) as n from bsample",
    "distinct_edges": "select src, dst from pairs",
    "outlier_removal": "select src as point_id from (select src, avg(dist) as m from nn group by src) where m <= (select avg(m) + 1.0*stddev_samp(m) from (select avg(dist) as m from nn group by src))",
    "win_first_per_group": "select cam_id, pix, point_id from seen",
    "win_lead_pairs": "select curve_id, vertex_idx, next_x from (select curve_id, vertex_idx, lead(x) over (partition by curve_id order by vertex_idx) as next_x from fx_polyline) where next_x is not null",
    "win_ring_lead": "select a.origin_id, a.ray_id, round(b.r, 6) as next_r from radii a join radii b on a.origin_id=b.origin_id and b.ray_id=(a.ray_id+1)%360",
    "win_interp_linear": """select dir_id, round(coalesce(case when dist <> 0 then dist end, v0+(v1-v0)*((dir_id-i0)/nullif(i1-i0,0)), v0, v1), 6) as value from (select k.dir_id, k.dist, a.dir_id as i0, a.dist as v0, b.dir_id as i1, b.dist as v1 from known3 k
        left join known3 a on a.dir_id = (select max(dir_id) from known3 z where z.dist <> 0 and z.dir_id <= k.dir_id) left join known3 b on b.dir_id = (select min(dir_id) from known3 z where z.dist <> 0 and z.dir_id >= k.dir_id))""",
    "win_interp_knn": """select dir_id, round(coalesce(max(case when gap=0 then v end), sum(v/nullif(gap,0))/sum(1.0/nullif(gap,0))), 6) as value from (select k.dir_id, abs(k.dir_id-z.dir_id) as gap, z.dist as v from known3 k, known3 z where z.dist <> 0
        qualify row_number() over (partition by k.dir_id order by abs(k.dir_id-z.dir_id), z.dir_id) <= 3) group by dir_id""",
    "win_rank_knn": "select src, dst, rank, round(dist, 6) as dist from nn",
    "sort_by_angle": "select origin_id, seg_id, piece, cast(row_number() over (partition by origin_id order by round(a0 - 2*pi()*floor(a0/(2*pi())), 6), seg_id, piece) as int) as pos from ccw",
    "lexsort_pixel_depth": "select cam_id, point_id, cast(row_number() over (partition by cam_id order by pix, depth, point_id) as int) as pos from framed",
    "argsort_visible": "select point_id, cast(row_number() over (order by point_id) as int) as pos from won",
    "topk_nn": "select src, dst from nn where rank = 1",
    "sort_unique_rows": "select origin_id, round(ox, 6) as ox, round(oy, 6) as oy from bsample",
    "union_short_long": "select origin_id, count(*) as n from pieces group by origin_id",
    "union_wrap": "select origin_id, part, count(*) as n from cutpieces group by origin_id, part",
    "union_edges": "select src, dst from twoway",
    "union_graph": "select src, dst, kind from gedges",
    "fn_hypot": f"select point_id, round(sqrt(x*x+y*y), 6) as v from {_XYZ}",
    "fn_norm": f"select point_id, round(sqrt(x*x+y*y+z*z), 6) as v from {_XYZ}",
    "fn_atan2": f"select point_id, round(atan2(y, x), 6) as v from {_XYZ}",
    "fn_mod_angle": f"select point_id, round(x - 2*pi()*floor(x/(2*pi())), 6) as v from {_XYZ}",
    "fn_ccw_orient": "select origin_id, seg_id, piece, round(a0, 6) as a0, round(a1, 6) as a1, round(d0, 6) as d0, round(d1, 6) as d1 from ccw",
    "fn_wrap_test": "select origin_id, seg_id, piece, a0>0 and a1<0 and a0-a1>=pi() as wraps from ccw",
    "fn_polar_lerp": f"select point_id, round(case when x=y then least(r,g) else r+(g-r)/nullif(y-x,0)*(z-x) end, 4) as v from {_XYZ}",
    "fn_polar_to_xy": f"select point_id, round(x+r*cos(z), 6) as px, round(y+r*sin(z), 6) as py from {_XYZ}",
    "fn_clip_nonneg": f"select point_id, round(greatest(x, 0.0), 6) as v from {_XYZ}",
    "fn_linspace": "select cast(i as int) as i, round(case when i=10 then 2.5 else -1.25+i*(3.75/10) end, 6) as closed, round(-1.25+i*(3.75/11), 6) as half_open from range(11) t(i)",
    "fn_cartesian_to_spherical": f"select point_id, round(cast(cast(sqrt(x*x+y*y+z*z) as float) as double), 6) as radius, round(cast(cast(atan2(y,x) as float) as double), 6) as azimuth, round(cast(cast(atan2(z, sqrt(x*x+y*y)) as float) as double), 6) as elevation from {_XYZ}",
    "fn_quat_to_matrix": "select cam_id, " + ", ".join(f"round(m{k}, 6) as m{k}" for k in range(9)) + " from poses",
    "fn_camera_center": "select cam_id, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz from poses",
    "fn_view_dir_world": "select cam_id, round(vx, 6) as vx, round(vy, 6) as vy, round(vz, 6) as vz from poses",
    "fn_fov": "select round(2*atan(6208/(2*3408.59)), 6) as fov_x, round(2*atan(4135/(2*3408.87)), 6) as fov_y",
    "fn_project_pinhole": "select cam_id, point_id, px, py from pin",
    "fn_project_raster": "select point_id, ui, vi, pix from ras",
    "fn_camera_basis": """select cam_id, round(rx/n,6) as rx, round(ry/n,6) as ry, round(rz/n,6) as rz from (select cam_id, sqrt(rx*rx+ry*ry+rz*rz)+1e-9 as n, rx, ry, rz from (select cam_id,
        case when abs(vz) > 0.99 then -vz else vy end as rx, case when abs(vz) > 0.99 then 0 else -vx end as ry, case when abs(vz) > 0.99 then vx else 0 end as rz from poses))""",
    "fn_rotation_a_to_b": "select cam_id, 1.0::double as along, 0.0::double as off_y, 0.0::double as off_z from poses",
    "fn_align": "select cam_id, point_id, round(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))/7, 6) as dist, round(((x-cx)*vx+(y-cy)*vy+(z-cz)*vz)/7+0.00000013, 6) as ahead from fx_points3d, poses",
    "fn_fibonacci": "select dir_id, round(dx*dx+dy*dy+dz*dz, 5) as unit from dirs",
    "fn_height_clip": "select dir_id, round(dist, 4) as dist from clipped3",
    "fn_color_u8": f"select point_id, cast(trunc(least(greatest(r*255,0),255)) as int) as v from {_XYZ}",
    "fn_round12": f"select point_id, round(round_even(x/3, 12), 11) as v from {_XYZ}",
    "isovist_segments_angle": "select origin_id, round(area, 6) as area from areas",
    "isovist_corner": "select origin_id, round(area, 6) as area from careas",
    "isovist_discretized": "select origin_id, round(area, 6) as area from dareas",
    "single_point": "select cast(0 as bigint) as origin_id, round(area, 6) as area, round(min_distance, 6) as min_distance, round(max_distance, 6) as max_distance, round(mean_distance, 6) as mean_distance, round(std_distance, 6) as std_distance from areas join stats2d using (origin_id) where origin_id = 3",
    "visibility_polygon": "select cast(0 as bigint) as origin_id, ray_id, round(ox+c*r, 6) as hx, round(oy+s*r, 6) as hy from radii where origin_id = 3",
    "area_array": "select origin_id, round(area, 6) as area, round(mean_distance, 6) as mean_distance from areas join stats2d using (origin_id)",
    "boundary_isovist": """select origin_id, round(abs(sum(dx*ny - nx*dy))/2, 5) as area from (select a.origin_id, a.c*a.r as dx, a.s*a.r as dy, b.c*b.r as nx, b.s*b.r as ny
        from bradii a join bradii b on a.origin_id = b.origin_id and b.ray_id = (a.ray_id+1)%360) group by origin_id""",
    "data2d_calculate_2d": "select cast(0 as bigint) as origin_id, round(area, 6) as area from areas where origin_id = 3",
    "data2d_calculate_array": "select origin_id, round(area, 6) as area from careas",
    "volume_spherical": "select round(4*pi()/(3*count(*))*sum(dist*dist*dist), 6) as vol, round(min(dist), 6) as min_dist, round(max(dist), 6) as max_dist, round(avg(dist), 6) as mean_dist, round(stddev_pop(dist), 6) as std_dist from known3",
    "directional_raycast": "select dir_id, round(ex, 6) + 0.0 as ex, round(ey, 6) + 0.0 as ey, round(ez, 6) + 0.0 as ez, point_id, r, g, b from (select dir_id, ex, ey, ez, point_id, r, g, b, row_number() over (partition by dir_id order by sqrt((ex-rx)*(ex-rx)+(ey-ry)*(ey-ry)+(ez-rz)*(ez-rz)), point_id) as k from (select dir_id, dx*dist as ex, dy*dist as ey, dz*dist as ez from fbins3 where dist > 0 and dist <= 6) e, pts) where k = 1",
    "volume_frustum": "select round(4*asin(sin(0.6)*sin(0.45))/(3*count(*))*sum(d*d*d), 6) as vol, round(avg(d), 6) as mean_dist from (select case when dist > 6 then 0 else dist end as d from fbins3)",
    "volume_single_point": "select round(4*asin(sin(0.6)*sin(0.45))/(3*count(*))*sum(d*d*d), 6) as vol, round(min(d), 6) as min_dist, round(max(d), 6) as max_dist, round(avg(d), 6) as mean_dist, round(stddev_pop(d), 6) as std_dist from (select case when dist > 6 then 0 else dist end as d from fbins3)",
    "visible_points_in_image": "select cam_id, s.point_id, x, y, z from seen s join fx_points3d p on p.point_id=s.point_id",
    "raycast_img_with_points": "select pix, ui, vi, r8, g8, b8, round(depth, 6) as depth, point_id from won",
    "graph_origin_last": """select src, dst, kind, round(cast(cast(sqrt(dx*dx+dy*dy+dz*dz) as float) as double), 5) as radius from (select src, dst, kind, cast(cast(b.x as float) as double)-cast(cast(a.x as float) as double) as dx, cast(cast(b.y as float) as double)-cast(cast(a.y as float) as double) as dy,
        cast(cast(b.z as float) as double)-cast(cast(a.z as float) as double) as dz from gedges join gnodes a on a.node_id=src join gnodes b on b.node_id=dst)""",
    "graph_origin_first": "select case when src = (select count(*) from fx_knn) then 0 else src+1 end as src, case when dst = (select count(*) from fx_knn) then 0 else dst+1 end as dst, kind from gedges",
    "heading_walk": "select walk_id, step, round(x, 6) as x, round(y, 6) as y, round(yaw, 6) as yaw, round(cos(-0.1)*cos(yaw), 6) as vx, round(cos(-0.1)*sin(yaw), 6) as vy, round(sin(-0.1), 6) as vz from walked where step >= 0",
}


def oracle(name: str) -> str | None:
    """The SQL of a query with the steps that it needs."""
    sql = QUERIES.get(name)
    if sql is None:
        return None
    need, found = set(), sql
    for step in reversed(STEPS):
        if re.search(rf"\b{step}\b", found):
            need.add(step)
            found += " " + STEPS[step]
    steps = [f"{s} as ({STEPS[s]})" for s in STEPS if s in need]
    return ("with recursive " + ",\n".join(steps) + "\n" if steps else "") + sql
