"""Registered queries on frames and pixels, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixeltide.operators import pixels as P
from pixeltide.operators import resample as R
from pixeltide.operators import stats as A
from pixeltide.operators import stencil as N
from pixeltide.plans.fixtures import ctes, fixture

Q, SQL = {}, {}
GRAY, BGR, MOSAIC = "f1_gray", "f2_bgr", "f10_mosaic"


def put(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def on(fix, f):
    return lambda spark, d: f(fixture(spark, d, fix))


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in rows) + ")"


def packed(spark, d, fix):
    return P.pixels_to_frames(fixture(spark, d, fix))


G, B, M = (ctes(x) for x in (GRAY, BGR, MOSAIC))
WIDE = "w AS (SELECT frame_id, y, x, max(CASE WHEN c=0 THEN v END) AS b, max(CASE WHEN c=1 THEN v END) AS g, max(CASE WHEN c=2 THEN v END) AS r FROM f2_bgr GROUP BY frame_id, y, x)"

put("frames_to_pixels", lambda s, d: P.frames_to_pixels(packed(s, d, GRAY)), f"{G} SELECT frame_id, y, x, c, v FROM f1_gray")
put(
    "pixels_to_frames",
    lambda s, d: packed(s, d, BGR).withColumn("data", F.concat_ws(",", F.transform("data", lambda v: v.cast("string")))),
    f"{B} SELECT frame_id, max(y)+1 AS height, max(x)+1 AS width, max(c)+1 AS channels, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x, c) AS data FROM f2_bgr GROUP BY frame_id",
)
LUMA = "(9798*r+19235*g+3735*b+16384) >> 15"
GRAY_SQL = f"{B}, {WIDE} SELECT frame_id, y, x, k.c, CAST({LUMA} AS INT) AS v FROM w, (VALUES (0),(1),(2)) k(c)"
put("grayscale", on(BGR, P.grayscale), GRAY_SQL)
put("grayscale_frames", lambda s, d: P.frames_to_pixels(P.grayscale_frames(packed(s, d, BGR))), GRAY_SQL)
put("brightness", on(BGR, lambda p: P.brightness(p, 60)), f"{B} SELECT frame_id, y, x, c, CAST(least(255, abs(v+60)) AS INT) AS v FROM f2_bgr")
put("contrast", on(BGR, lambda p: P.contrast(p, 1.25)), f"{B} SELECT frame_id, y, x, c, CAST(least(255, greatest(0, round_even(abs(v*CAST(1.25 AS DOUBLE)), 0))) AS INT) AS v FROM f2_bgr")
put("gamma", on(BGR, lambda p: P.gamma(p, 2.2)), f"{B} SELECT f.frame_id, f.y, f.x, f.c, l.n AS v FROM f2_bgr f JOIN {values(enumerate(P.gamma_table(2.2)))} l(v, n) ON f.v = l.v")
CUTS = {"binary": "CASE WHEN v>127 THEN 255 ELSE 0 END", "binary_inv": "CASE WHEN v>127 THEN 0 ELSE 255 END", "trunc": "least(v, 127)", "tozero": "CASE WHEN v>127 THEN v ELSE 0 END", "tozero_inv": "CASE WHEN v>127 THEN 0 ELSE v END"}
for kind, sql in CUTS.items():
    put(f"threshold_{kind}", on(GRAY, lambda p, k=kind: P.threshold(p, k, 127)), f"{G} SELECT frame_id, y, x, c, CAST({sql} AS INT) AS v FROM f1_gray")
OTSU = """h AS (SELECT frame_id, v, count(*) AS n FROM f1_gray GROUP BY frame_id, v),
u AS (SELECT frame_id, v, sum(n) OVER a AS w, sum(n*v) OVER a AS s, sum(n) OVER (PARTITION BY frame_id) AS nn, sum(n*v) OVER (PARTITION BY frame_id) AS ss FROM h WINDOW a AS (PARTITION BY frame_id ORDER BY v)),
t AS (SELECT frame_id, v AS t, row_number() OVER (PARTITION BY frame_id ORDER BY CAST(s*nn-ss*w AS DOUBLE)*CAST(s*nn-ss*w AS DOUBLE)/CAST(w*(nn-w) AS DOUBLE) DESC, v) AS k FROM u WHERE w < nn)"""
put("otsu", on(GRAY, P.otsu), f"{G}, {OTSU} SELECT f.frame_id, y, x, c, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM f1_gray f JOIN t ON t.frame_id = f.frame_id AND k = 1")
put("trigger_count", on(GRAY, lambda p: P.trigger_count(p, 127, 25)), f"{G} SELECT frame_id, count(*) FILTER (WHERE v>127) AS n_over, count(*) FILTER (WHERE v>127) >= 25 AS fired FROM f1_gray GROUP BY frame_id")
put("apply_colormap", lambda s, d: P.apply_colormap(fixture(s, d, GRAY), s.createDataFrame(P.palette("jet"), "v int, b int, g int, r int")), f"{G} SELECT f.frame_id, f.y, f.x, k.c, CASE k.c WHEN 0 THEN b WHEN 1 THEN g ELSE r END AS v FROM f1_gray f JOIN {values(P.palette('jet'))} l(v, b, g, r) ON f.v = l.v, (VALUES (0),(1),(2)) k(c)")
HSV = f"""{WIDE}, hm AS (SELECT *, greatest(b,g,r) AS hv, greatest(b,g,r)-least(b,g,r) AS d FROM w),
hh AS (SELECT *, CASE WHEN d=0 THEN 0e0 WHEN hv=r THEN (g-b)*30/CAST(d AS DOUBLE) WHEN hv=g THEN (b-r)*30/CAST(d AS DOUBLE)+60 ELSE (r-g)*30/CAST(d AS DOUBLE)+120 END AS q FROM hm),
hsv AS (SELECT frame_id, y, x, CAST(round_even(CASE WHEN q<0 THEN q+180 ELSE q END, 0) AS INT)%180 AS h, CASE WHEN hv=0 THEN 0 ELSE CAST(round_even(d*255/CAST(hv AS DOUBLE), 0) AS INT) END AS s, hv AS v FROM hh)"""
put("bgr_to_hsv", on(BGR, P.bgr_to_hsv), f"{B}, {HSV} SELECT frame_id, y, x, k.c, CASE k.c WHEN 0 THEN h WHEN 1 THEN s ELSE v END AS v FROM hsv, (VALUES (0),(1),(2)) k(c)")


def _back(table):
    k = "((k.n + h/CAST(30 AS DOUBLE)) - 6*floor((k.n + h/CAST(30 AS DOUBLE))/6))"
    return f"SELECT frame_id, y, x, k.c, CAST(least(255, greatest(0, round_even(v - v*(s/CAST(255 AS DOUBLE))*greatest(0e0, least({k}, 4-{k}, 1e0)), 0))) AS INT) AS v FROM {table}, (VALUES (0, 1e0), (1, 3e0), (2, 5e0)) k(c, n)"


put("hsv_to_bgr", on(BGR, lambda p: P.hsv_to_bgr(P.bgr_to_hsv(p))), f"{B}, {HSV} {_back('hsv')}")
EQ = """ec AS (SELECT frame_id, v, sum(count(*)) OVER (PARTITION BY frame_id ORDER BY v) AS cdf, sum(count(*)) OVER (PARTITION BY frame_id) AS nn FROM hsv GROUP BY frame_id, v),
el AS (SELECT frame_id, v, cdf, nn, min(cdf) OVER (PARTITION BY frame_id) AS lo FROM ec),
eq AS (SELECT a.frame_id, y, x, h, s, CASE WHEN nn=lo THEN a.v ELSE CAST(round_even((cdf-lo)*255/CAST(nn-lo AS DOUBLE), 0) AS INT) END AS v FROM hsv a JOIN el ON el.frame_id=a.frame_id AND el.v=a.v)"""
put("equalize_hist", on(BGR, P.equalize_hist), f"{B}, {HSV}, {EQ} {_back('eq')}")


def normalized(p):
    out = None
    for mode in ("unit", "signed", "imagenet", "raw"):
        one = P.normalize(p, mode).select(F.lit(mode).alias("mode"), "frame_id", "y", "x", "c", F.round("v", 6).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


_PICK = "CASE c WHEN 2 THEN {0}e0 WHEN 1 THEN {1}e0 ELSE {2}e0 END"
put("normalize", on(BGR, normalized), f"""{B}, m AS (SELECT *, v/255e0 AS unit, v/127.5e0 - 1 AS signed, (v/255e0 - {_PICK.format(*P.MEAN)})/({_PICK.format(*P.STD)}) AS imagenet, CAST(v AS DOUBLE) AS raw FROM f2_bgr)
SELECT k.mode, frame_id, y, x, 2-c AS c, round(CASE k.mode WHEN 'unit' THEN unit WHEN 'signed' THEN signed WHEN 'imagenet' THEN imagenet ELSE raw END, 6) AS v FROM m, (VALUES ('unit'),('signed'),('imagenet'),('raw')) k(mode)""")
put(
    "tensor",
    on(BGR, lambda p: P.tensor(P.normalize(p, "raw")).withColumn("data", F.concat_ws(",", F.transform("data", lambda v: v.cast("int").cast("string"))))),
    f"{B} SELECT frame_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY 2-c, y, x) AS data FROM f2_bgr GROUP BY frame_id",
)
put(
    "denormalize",
    lambda s, d: P.denormalize(fixture(s, d, "f8_planes").withColumnRenamed("class_id", "c"), first=1),
    f"{ctes('f8_planes')} SELECT frame_id, y, x, 2-(class_id-1) AS c, CAST(floor(least(255e0, greatest(0e0, v*255e0))) AS INT) AS v FROM f8_planes WHERE class_id BETWEEN 1 AND 3",
)
put("crop", on(GRAY, lambda p: P.crop(p, 0.25, 0.9, 0.1, 0.75, 8, 8)), f"{G} SELECT frame_id, y-0 AS y, x-2 AS x, c, v FROM f1_gray WHERE x>=2 AND x<7 AND y>=0 AND y<6")
for h, v in ((True, False), (False, True), (True, True)):
    name = "flip_" + "h" * h + "v" * v
    put(name, on(GRAY, lambda p, h=h, v=v: P.flip(p, h, v, 8, 8)), f"{G} SELECT frame_id, {'7-y' if v else 'y'} AS y, {'7-x' if h else 'x'} AS x, c, v FROM f1_gray")


def _resized(base, table, w, h, nw, nh, mode):
    wx, wy = R.axis_weights(w, nw, mode), R.axis_weights(h, nh, mode)
    return f"""{base}, rs AS (SELECT frame_id, wy.d AS y, wx.d AS x, c, sum(CAST(v AS BIGINT)*wx.a*wy.a) AS s FROM {table} f JOIN {values(wx)} wx(d, s, a) ON wx.s=f.x JOIN {values(wy)} wy(d, s, a) ON wy.s=f.y GROUP BY ALL),
small AS (SELECT frame_id, y, x, c, CAST(least(255, greatest(0, (s + 2097152) >> 22)) AS INT) AS v FROM rs)"""


def _nearest(w, h, nw, nh):
    return f"SELECT f.frame_id, CAST(ty.d AS INT) AS y, CAST(tx.d AS INT) AS x, c, v FROM f1_gray f JOIN range({nw}) tx(d) ON f.x = CAST(floor(tx.d*{w}/CAST({nw} AS DOUBLE)) AS INT) JOIN range({nh}) ty(d) ON f.y = CAST(floor(ty.d*{h}/CAST({nh} AS DOUBLE)) AS INT)"


put("resize_nearest", on(GRAY, lambda p: R.resize(p, 8, 8, 12, 6, "nearest")), f"{G} {_nearest(8, 8, 12, 6)}")
for mode, fix, base, shape in (("nearest_exact", GRAY, G, (8, 8, 12, 6)), ("linear", GRAY, G, (8, 8, 12, 10)), ("area", MOSAIC, M, (64, 64, 24, 16)), ("cubic", GRAY, G, (8, 8, 13, 11)), ("lanczos4", MOSAIC, M, (64, 64, 40, 48))):
    put(f"resize_{mode}", on(fix, lambda p, m=mode, z=shape: R.resize(p, *z, m)), f"{_resized(base, fix, *shape, mode)} SELECT * FROM small")
put("letterbox", on(MOSAIC, lambda p: R.letterbox(p, 64, 64, 48, 32)), f"{_resized(M, MOSAIC, 64, 64, 32, 32, 'linear')} SELECT fr.frame_id, CAST(gy.i AS INT) AS y, CAST(gx.i AS INT) AS x, fr.c, coalesce(v, 114) AS v FROM (SELECT DISTINCT frame_id, c FROM f10_mosaic) fr, range(32) gy(i), range(48) gx(i) LEFT JOIN small ON small.frame_id=fr.frame_id AND small.c=fr.c AND small.y=gy.i AND small.x=gx.i")

VIEW = dict(pitch=20, yaw=200, roll=10, imagepoint=0.5, in_width=8, in_height=8, width=16, height=8)


def view_places(s, d):
    frames = fixture(s, d, GRAY).select("frame_id").distinct()
    places = R.view_map(s, **VIEW).select("y", "x", F.round("src_y", 6).alias("src_y"), F.round("src_x", 6).alias("src_x"))
    return frames.crossJoin(F.broadcast(places))  # 128 places, whatever the frames


def _view_sql():
    import math

    p, q, r = (math.radians(VIEW[k]) for k in ("pitch", "yaw", "roll"))
    n = lambda x: f"({x!r}::DOUBLE)"
    asp = 0.561 * 8 / 16
    return f"""g AS (SELECT CAST(gy.i AS INT) AS y, CAST(gx.i AS INT) AS x, (gx.i*{n(2 * 0.561 / 16)} - {n(0.561)})/{n(1.5)} AS u, (gy.i*{n(2 * asp / 8)} - {n(asp)})/{n(1.5)} AS w FROM range(8) gy(i), range(16) gx(i)),
g1 AS (SELECT *, u*u+w*w AS uu FROM g), g2 AS (SELECT *, (-2*uu + sqrt(4*uu*uu - 4*(1+uu)*(uu-1)))/(2*(1+uu)) AS t FROM g1),
g3 AS (SELECT y, x, t AS px, u*(t+1)*{n(math.cos(r))} + w*(t+1)*{n(math.sin(r))} AS py, w*(t+1)*{n(math.cos(r))} - u*(t+1)*{n(math.sin(r))} AS pz FROM g2),
g4 AS (SELECT y, x, px*{n(math.cos(p))} - pz*{n(math.sin(p))} AS px, py, px*{n(math.sin(p))} + pz*{n(math.cos(p))} AS pz FROM g3),
g5 AS (SELECT y, x, px*{n(math.cos(q))} + py*{n(math.sin(q))} AS px, py*{n(math.cos(q))} - px*{n(math.sin(q))} AS py, pz FROM g4),
g6 AS (SELECT y, x, px, py, asin(pz) AS lat, asin(least(1e0, greatest(-1e0, py/cos(asin(pz))))) AS side FROM g5),
vm AS (SELECT y, x, lat*8/pi() + 4 AS src_y, (CASE WHEN px<0 THEN (CASE WHEN py>0 THEN pi() WHEN py<0 THEN -pi() ELSE 0 END) - side ELSE side END)*8/(2*pi()) + 4 AS src_x FROM g6)"""


def _cubic(t, k):
    d = f"abs({k} - ({t}))"
    return f"CASE WHEN {d} <= 1 THEN 1.25e0*{d}*{d}*{d} - 2.25e0*{d}*{d} + 1 ELSE -0.75e0*{d}*{d}*{d} + 3.75e0*{d}*{d} - 6e0*{d} + 3 END"


put("equirect_map", view_places, f"{G}, {_view_sql()} SELECT f.frame_id, y, x, round(src_y, 6) AS src_y, round(src_x, 6) AS src_x FROM vm, (SELECT DISTINCT frame_id FROM f1_gray) f")
put("equirect_view", on(GRAY, lambda p: R.equirect_view(p, **VIEW)), f"""{G}, {_view_sql()},
taps AS (SELECT y, x, CAST(floor(src_y) AS INT) + ky.i AS sy, CAST(floor(src_x) AS INT) + kx.i AS sx, ({_cubic("src_y - floor(src_y)", "ky.i")}) * ({_cubic("src_x - floor(src_x)", "kx.i")}) AS wt FROM vm, range(-1, 3) ky(i), range(-1, 3) kx(i)),
sums AS (SELECT f.frame_id, t.y, t.x, f.c, sum(f.v * wt) AS s FROM f1_gray f JOIN taps t ON t.sy = f.y AND t.sx = f.x GROUP BY ALL)
SELECT frame_id, y, x, c, CAST(least(255, greatest(0, round_even(round(s, 6), 0))) AS INT) AS v FROM sums""")


def _mirror(e, n):
    return f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= {n} THEN {2 * (n - 1)}-({e}) ELSE {e} END)"


put("box_blur", on(MOSAIC, lambda p: N.box_blur(p, 5, 64, 64, tile=32)), f"{M} SELECT t.frame_id, t.y, t.x, t.c, CAST(round_even(sum(s.v)/CAST(25 AS DOUBLE), 0) AS INT) AS v FROM f10_mosaic t, range(-2, 3) dy(i), range(-2, 3) dx(i) JOIN f10_mosaic s ON s.frame_id=t.frame_id AND s.c=t.c AND s.y={_mirror('t.y+dy.i', 64)} AND s.x={_mirror('t.x+dx.i', 64)} GROUP BY ALL")
put("box_blur_even", on(GRAY, lambda p: N.box_blur(p, 4, 8, 8)), f"{G} SELECT t.frame_id, t.y, t.x, t.c, CAST(round_even(sum(s.v)/CAST(16 AS DOUBLE), 0) AS INT) AS v FROM f1_gray t, range(-2, 2) dy(i), range(-2, 2) dx(i) JOIN f1_gray s ON s.frame_id=t.frame_id AND s.c=t.c AND s.y={_mirror('t.y+dy.i', 8)} AND s.x={_mirror('t.x+dx.i', 8)} GROUP BY ALL")
KERNEL = [[0, -0.5, 0], [-0.5, 1, -0.25], [0, -0.25, 0.75]]


def _kernel(k, gain=1):
    return values([(dy, dx, float(w * gain)) for dy, row in enumerate(k, -1) for dx, w in enumerate(row, -1) if w])


put("filter3x3", on(MOSAIC, lambda p: N.filter3x3(p, KERNEL, 2.0, 64, 64, tile=32)), f"{M} SELECT t.frame_id, t.y, t.x, t.c, CAST(least(255, greatest(0, round_even(sum(s.v*CAST(k.w AS DOUBLE)), 0))) AS INT) AS v FROM f10_mosaic t, {_kernel(KERNEL, 2)} k(dy, dx, w) JOIN f10_mosaic s ON s.frame_id=t.frame_id AND s.c=t.c AND s.y={_mirror('t.y+k.dy', 64)} AND s.x={_mirror('t.x+k.dx', 64)} GROUP BY ALL")
put("canny", on(MOSAIC, lambda p: N.canny(p, 100, 200, 64, 64, tile=16)), f"""{ctes(MOSAIC, recursive=True)},
grad AS (SELECT t.frame_id, t.y, t.x, CAST(sum(s.v*k.a) AS INT) AS gx, CAST(sum(s.v*k.b) AS INT) AS gy FROM f10_mosaic t, {values([(dy, dx, N.SOBEL_X[dy + 1][dx + 1], N.SOBEL_Y[dy + 1][dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])} k(dy, dx, a, b) JOIN f10_mosaic s ON s.frame_id=t.frame_id AND s.y={_mirror('t.y+k.dy', 64)} AND s.x={_mirror('t.x+k.dx', 64)} GROUP BY ALL),
mag AS (SELECT *, abs(gx)+abs(gy) AS m, CASE WHEN abs(gy)*1000 < abs(gx)*414 THEN 1 WHEN abs(gy)*1000 > abs(gx)*2414 THEN 0 WHEN (gx>=0)=(gy>=0) THEN 1 ELSE -1 END AS dx, CASE WHEN abs(gy)*1000 < abs(gx)*414 THEN 0 ELSE 1 END AS dy FROM grad),
cand AS (SELECT a.frame_id, a.y, a.x, a.m > 200 AS strong FROM mag a LEFT JOIN mag n ON n.frame_id=a.frame_id AND n.y=a.y+a.dy AND n.x=a.x+a.dx LEFT JOIN mag p ON p.frame_id=a.frame_id AND p.y=a.y-a.dy AND p.x=a.x-a.dx WHERE a.m>100 AND a.m>coalesce(p.m,0) AND a.m>=coalesce(n.m,0)),
edge(frame_id, y, x) AS (SELECT frame_id, y, x FROM cand WHERE strong UNION SELECT c.frame_id, c.y, c.x FROM edge e JOIN cand c ON c.frame_id=e.frame_id AND abs(c.y-e.y)<=1 AND abs(c.x-e.x)<=1)
SELECT f.frame_id, f.y, f.x, f.c, CASE WHEN e.y IS NULL THEN 0 ELSE 255 END AS v FROM f10_mosaic f LEFT JOIN edge e ON e.frame_id=f.frame_id AND e.y=f.y AND e.x=f.x""")
_W = N.gaussian()


def _mscn(source, n, name):
    return f"""{name}_mu AS (SELECT t.frame_id, t.y, t.x, t.c, t.v, sum(s.v*CAST(ky.w AS DOUBLE)*CAST(kx.w AS DOUBLE)) AS mu, sum(CAST(s.v*s.v AS DOUBLE)*CAST(ky.w AS DOUBLE)*CAST(kx.w AS DOUBLE)) AS sq FROM {source} t, {values(enumerate(_W, -3))} ky(i, w), {values(enumerate(_W, -3))} kx(i, w) JOIN {source} s ON s.frame_id=t.frame_id AND s.y={_mirror('t.y+ky.i', n)} AND s.x={_mirror('t.x+kx.i', n)} GROUP BY ALL),
{name} AS (SELECT frame_id, y, x, c, (v-mu)/(sqrt(greatest(0e0, sq-mu*mu))+1) AS m FROM {name}_mu)"""


MSCN = _mscn("f1_gray", 8, "mm")
put("mscn", on(GRAY, lambda p: N.mscn(p).withColumn("m", F.round("m", 6))), f"{G}, {MSCN} SELECT frame_id, y, x, c, round(m, 6) AS m FROM mm")
put("mscn_moments", on(GRAY, lambda p: A.mscn_moments(p).select("frame_id", "n", *[F.round(c, 6).alias(c) for c in ("m1", "m2", "mabs")])), f"{G}, {MSCN} SELECT frame_id, count(*) AS n, round(avg(m), 6) AS m1, round(avg(m*m), 6) AS m2, round(avg(abs(m)), 6) AS mabs FROM mm GROUP BY frame_id")


def _scene(source, shift):
    """Features of one scale: products with each neighbour, their moments, and the shape whose ratio of moments is nearest."""
    p = f"{source}_"
    lines = {1: ("y", "x"), 2: ("x", "y"), 3: ("y-x", "x"), 4: ("y+x", "x")}
    products = ", ".join(f"m * lead(m) OVER (PARTITION BY frame_id, {part} ORDER BY {order}) AS p{k}" for k, (part, order) in lines.items())
    return f"""{p}pr AS (SELECT frame_id, m AS p0, {products} FROM {source}),
{p}lg AS ({" UNION ALL ".join(f"SELECT frame_id, {k} AS k, p{k} AS p FROM {p}pr WHERE p{k} IS NOT NULL" for k in range(5))}),
{p}mo AS (SELECT frame_id, k, avg(p*p) AS m2, avg(abs(p)) AS mabs, coalesce(avg(p*p) FILTER (WHERE p < 0), 0) AS lv, coalesce(avg(p*p) FILTER (WHERE p > 0), 0) AS rv FROM {p}lg GROUP BY ALL),
{p}ga AS (SELECT *, CASE WHEN m2 > 0 THEN mabs*mabs/m2 ELSE 0 END AS r, CASE WHEN rv > 0 THEN sqrt(lv/rv) ELSE 1 END AS g FROM {p}mo),
{p}ra AS (SELECT *, CASE WHEN k = 0 THEN r ELSE r*(g*g*g+1)*(g+1)/((g*g+1)*(g*g+1)) END AS q FROM {p}ga),
{p}sh AS (SELECT frame_id, k, m2, lv, rv, arg_min(alpha, abs(ratio-q)) AS alpha FROM {p}ra, shapes GROUP BY ALL),
{p}fe AS (SELECT frame_id, 1+{shift} AS feature, alpha AS value FROM {p}sh WHERE k = 0 UNION ALL SELECT frame_id, 2+{shift}, m2 FROM {p}sh WHERE k = 0
UNION ALL SELECT frame_id, 4*k-1+i+{shift}, CASE i WHEN 0 THEN alpha WHEN 1 THEN sqrt(rv)-sqrt(lv) WHEN 2 THEN lv ELSE rv END FROM {p}sh, range(4) z(i) WHERE k > 0)"""


SHAPES = "shapes AS (SELECT a/1000e0 AS alpha, gamma(2000e0/a)*gamma(2000e0/a)/(gamma(1000e0/a)*gamma(3000e0/a)) AS ratio FROM range(200, 10001, 5) z(a))"
HALF = "half AS (SELECT frame_id, y//2 AS y, x//2 AS x, c, CAST((sum(v)*1048576 + 2097152) >> 22 AS INT) AS v FROM f1_gray GROUP BY ALL)"
put("brisque_features", on(GRAY, lambda p: A.brisque_features(p).withColumn("value", F.round("value", 6))), f"{G}, {SHAPES}, {HALF}, {MSCN}, {_mscn('half', 4, 'hm')}, {_scene('mm', 0)}, {_scene('hm', 18)} SELECT frame_id, CAST(feature AS INT) AS feature, round(value, 6) AS value FROM (SELECT * FROM mm_fe UNION ALL SELECT * FROM hm_fe) z")
put("rgb_histogram", on(BGR, A.rgb_histogram), f"{B}, h AS (SELECT frame_id, c, v, count(*) AS n FROM f2_bgr GROUP BY ALL), k AS (SELECT frame_id, c, sum(n) AS t FROM h GROUP BY ALL) SELECT k.frame_id, k.c, CAST(r.v AS INT) AS v, coalesce(h.n, 0) AS n, coalesce((SELECT CAST(floor(t/32) AS BIGINT) FROM k z WHERE z.frame_id=k.frame_id AND z.c=0), 0) AS ceiling FROM k, range(256) r(v) LEFT JOIN h ON h.frame_id=k.frame_id AND h.c=k.c AND h.v=r.v")
put("depth_stats", on(GRAY, A.depth_stats), f"{G} SELECT frame_id, min(v) AS v_min, max(v) AS v_max, avg(v) AS v_mean, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM f1_gray GROUP BY frame_id")
LAT = ctes("f5_latency")
put("fps", on("f5_latency", lambda p: A.fps(p).withColumn("fps", F.round("fps", 6)).withColumn("mean_ms", F.round("mean_ms", 6))), f"""{LAT}, a AS (SELECT *, avg(elapsed_ms) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_ms FROM f5_latency), b AS (SELECT *, CASE WHEN mean_ms>0 THEN 1000e0/mean_ms ELSE 0e0 END AS f FROM a)
SELECT node, seq, elapsed_ms, round(mean_ms, 6) AS mean_ms, round(f, 6) AS fps, 'FPS:' || CASE WHEN f>1 THEN lpad(CAST(CAST(floor(f) AS BIGINT) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(floor(f) AS BIGINT) AS VARCHAR))) AS INT), '0') ELSE printf('%.2f', f) END || ' (' || lpad(CAST(elapsed_ms AS VARCHAR), CAST(greatest(4, length(CAST(elapsed_ms AS VARCHAR))) AS INT), '0') || 'ms)' AS label FROM b""")
put("total_fps", on("f5_latency", lambda p: A.total_fps(p).select("seq", F.round("total_ms", 6).alias("total_ms"), F.round("fps", 6).alias("fps"), "label")), f"""{LAT}, a AS (SELECT *, avg(elapsed_ms) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_ms FROM f5_latency), t AS (SELECT seq, round(sum(mean_ms), 6) AS total_ms FROM a GROUP BY seq), b AS (SELECT *, CASE WHEN total_ms>0 THEN 1000e0/total_ms ELSE 0e0 END AS f FROM t)
SELECT seq, round(total_ms, 6) AS total_ms, round(f, 6) AS fps, 'FPS:' || CASE WHEN f>1 THEN lpad(CAST(CAST(floor(f) AS BIGINT) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(floor(f) AS BIGINT) AS VARCHAR))) AS INT), '0') ELSE printf('%.2f', f) END AS label FROM b""")
put("latency_text", on("f5_latency", lambda p: p.select("node", "seq", A.latency_text(F.col("elapsed_ms")).alias("text")).withColumn("back", A.parse_latency(F.col("text")))), f"{LAT} SELECT node, seq, lpad(CAST(elapsed_ms AS VARCHAR), CAST(greatest(4, length(CAST(elapsed_ms AS VARCHAR))) AS INT), '0') || 'ms' AS text, elapsed_ms AS back FROM f5_latency")
