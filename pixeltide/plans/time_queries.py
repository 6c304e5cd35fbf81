"""Registered queries on sampling, tracks and pipeline documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators import annotate as N
from pixeltide.operators import motmetrics as M
from pixeltide.operators import sampling as S
from pixeltide.operators import track as T
from pixeltide.operators import trackers as K
from pixeltide.plans import pipeline as L
from pixeltide.plans.detect_queries import BOXROW, color, iou_sql, labels, parts
from pixeltide.plans.fixtures import ctes, fixture

Q, SQL = {}, {}


def put(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def on(fix, f):
    return lambda spark, d: f(fixture(spark, d, fix))


FR, ST = ctes("f5_frames"), ctes("f4_stream")
NUM = "n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY source_id) AS total FROM f5_frames)"
put("skip_frames", on("f5_frames", lambda p: S.skip_frames(p, 3)), f"{FR}, {NUM} SELECT source_id, frame_no, frame_id, ts, payload FROM n WHERE k % 3 = 0")


def ticks(s, d):
    n = fixture(s, d, "f5_frames").groupBy("source_id").agg(F.count("*").alias("n"))
    return n.select("source_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("tick"))


put("loop_schedule", lambda s, d: S.loop_schedule(ticks(s, d), fixture(s, d, "f5_frames"), 3), f"{FR}, {NUM} SELECT a.source_id, CAST(a.k AS INT) AS tick, (a.k*3-1) % a.total AS shown, b.frame_id FROM n a JOIN n b ON b.source_id=a.source_id AND b.k-1 = (a.k*3-1) % a.total")
put("play_once", lambda s, d: S.loop_schedule(ticks(s, d), fixture(s, d, "f5_frames"), 3, loop=False), f"{FR}, {NUM} SELECT a.source_id, CAST(a.k AS INT) AS tick, a.k*3-1 AS shown, b.frame_id FROM n a JOIN n b ON b.source_id=a.source_id AND b.k-1 = a.k*3-1")


def sought(s, d):
    req = fixture(s, d, "f5_params").select("source_id", "ts", (F.floor(F.col("param") * 40000) - 200000).alias("seek"))
    return S.seek_frames(req, fixture(s, d, "f5_frames"))


SEEK = f"""{ctes("f5_frames", "f5_params")}, {NUM}, r AS (SELECT source_id, ts, least(10000000, greatest(0, CAST(floor(param*40000)-200000 AS INT))) AS seek FROM f5_params),
q AS (SELECT r.source_id, r.ts, least(t.total-1, greatest(0, CAST(floor(t.total*seek/1e7) AS BIGINT))) AS pos FROM r JOIN (SELECT DISTINCT source_id, total FROM n) t USING (source_id)),
sk AS (SELECT q.source_id, q.ts, q.pos, n.frame_id FROM q JOIN n ON n.source_id=q.source_id AND n.k-1=q.pos)"""
put("seek_frames", sought, f"{SEEK} SELECT * FROM sk")
put("dedupe_seek", lambda s, d: S.dedupe_seek(sought(s, d)), f"{SEEK} SELECT *, lag(pos) OVER (PARTITION BY source_id ORDER BY ts) IS DISTINCT FROM pos AS reread FROM sk")
put("throttle_latest", on("f5_frames", lambda p: S.throttle_latest(p, "6 hours").drop("start")), f"{FR}, b AS (SELECT *, row_number() OVER (PARTITION BY source_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') ORDER BY ts DESC) AS k FROM f5_frames) SELECT source_id, frame_id, ts FROM b WHERE k = 1")
put(
    "apply_param_feed",
    lambda s, d: S.apply_param_feed(fixture(s, d, "f5_frames"), fixture(s, d, "f5_params"), 5.0, 80.0, 10.0),
    f"{ctes('f5_frames', 'f5_params')} SELECT f.*, round(least(80e0, greatest(5e0, coalesce(p.param, 10e0))), 3) AS param FROM f5_frames f ASOF LEFT JOIN f5_params p ON p.source_id=f.source_id AND f.ts >= p.ts",
)
TICK = "t AS (SELECT user_id AS source_id, ts, event_type IN ('view','click') AS has_frame, CASE WHEN event_type IN ('view','click') THEN value END AS payload FROM events)"


def tick_table(s, d):
    e = fixture(s, d, "events")
    has = F.col("event_type").isin("view", "click")
    return e.select(F.col("user_id").alias("source_id"), "ts", has.alias("has_frame"), F.when(has, F.col("value")).alias("payload"))


put("recording_sessions", lambda s, d: S.recording_sessions(tick_table(s, d)), f"WITH {TICK}, u AS (SELECT *, CASE WHEN has_frame AND NOT coalesce(lag(has_frame) OVER w, false) THEN 1 ELSE 0 END AS st FROM t WINDOW w AS (PARTITION BY source_id ORDER BY ts)), v AS (SELECT source_id, ts, has_frame, payload, CAST(sum(st) OVER (PARTITION BY source_id ORDER BY ts) AS BIGINT) AS session FROM u) SELECT * FROM v WHERE has_frame")
put("hold_last", lambda s, d: S.hold_last(tick_table(s, d)), f"WITH {TICK} SELECT source_id, ts, has_frame, last_value(payload IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS payload FROM t")
put("gate", lambda s, d: S.gate(fixture(s, d, "f5_frames"), fixture(s, d, "f5_switch")), f"{ctes('f5_frames', 'f5_switch')} SELECT f.* FROM f5_frames f ASOF LEFT JOIN f5_switch p ON p.source_id=f.source_id AND f.ts >= p.ts WHERE coalesce(p.state, 'ON') = 'ON'")


def streamed(s, d, run, schema, mode="append"):
    """Rows of a table through a stream and back: the stream writes what it emits to the checkpoint folder."""
    import uuid

    from pixeltide.operators.rounds import checkpoint

    checkpoint(s.range(1))
    at = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    q = run(s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out")
    q.awaitTermination()
    return s.read.schema(schema).parquet(f"{at}/out")


def stream_throttle(s, d):
    from pixeltide.streaming import stateful

    def run(events):
        f = events.where("event_type in ('view','click')").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_id"), "ts")
        return stateful.throttle_latest(stateful.prepare(f, "1 hour"), "6 hours")

    return streamed(s, d, run, "source_id long, start timestamp, frame_id long, at timestamp")


#: What a stream has given out at its end: windows that end no later than the last time seen less the delay.
put("stream_throttle_latest", lambda s, d: stream_throttle(s, d).select("source_id", "frame_id", F.col("at").cast("timestamp_ntz").alias("at")), f"{FR}, b AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w FROM f5_frames), k AS (SELECT *, row_number() OVER (PARTITION BY source_id, w ORDER BY ts DESC) AS k FROM b) SELECT source_id, frame_id, ts AS at FROM k WHERE k = 1 AND w + INTERVAL '6 hours' <= (SELECT max(ts) FROM f5_frames) - INTERVAL '1 hour'")


def stream_sessions(s, d):
    from pixeltide.streaming import stateful

    def run(events):
        f = events.where("event_type in ('view','click')").select(F.col("user_id").alias("source_id"), "ts")
        return stateful.recording_sessions(stateful.prepare(f, "1 hour"), "12 hours")

    out = streamed(s, d, run, "source_id long, start timestamp, end timestamp, frames long")
    return out.select("source_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "frames")


put("stream_recording_sessions", stream_sessions, f"""{FR}, n AS (SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL '12 hours' >= ts THEN 0 ELSE 1 END AS st FROM f5_frames WINDOW w AS (PARTITION BY source_id ORDER BY ts)),
g AS (SELECT *, sum(st) OVER (PARTITION BY source_id ORDER BY ts) AS k FROM n), x AS (SELECT source_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS frames FROM g GROUP BY source_id, k)
SELECT source_id, start, "end", frames FROM x WHERE "end" <= (SELECT max(ts) FROM f5_frames) - INTERVAL '1 hour'""")

def scratch(s) -> str:
    """A new folder beside the checkpoints."""
    import uuid

    from pixeltide.operators.rounds import checkpoint

    checkpoint(s.range(1))
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def feed(s, rows, at, batches):
    """Files to be read one by one: the rows of a batch after those of the one before. Gives the stream of them."""
    for k in batches:
        rows.where(F.col("batch") == k).drop("batch").repartition(1).write.mode("append").parquet(at)
    return s.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(at)


#: Frames as they come in: five days in a batch; some twice in it, some again in the next, some only in the next or the one after.
FEED = """SELECT source_id, frame_id, ts, CASE WHEN frame_id % 11 = 0 THEN b + 1 WHEN frame_id % 13 = 0 THEN b + 2 ELSE b END AS batch FROM {base}
UNION ALL SELECT source_id, frame_id, ts, b AS batch FROM {base} WHERE frame_id % 5 = 0 AND frame_id % 11 <> 0 AND frame_id % 13 <> 0
UNION ALL SELECT source_id, frame_id, ts, b + 1 AS batch FROM {base} WHERE frame_id % 7 = 0 AND frame_id % 11 <> 0 AND frame_id % 13 <> 0"""
_BASE = "SELECT source_id, frame_id, ts, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 5) AS INT) AS b FROM {f5_frames}"


def stream_intake(s, d):
    from pixeltide.streaming import stateful

    base = s.sql(_BASE, f5_frames=fixture(s, d, "f5_frames"))
    from pixeltide.operators.rounds import checkpoint

    at, rows = scratch(s), checkpoint(s.sql(FEED, base=base))  # read once for each batch
    last = rows.agg(F.max("batch")).first()[0]
    frames = stateful.prepare(feed(s, rows, f"{at}/in", range(last + 1)), "1 day", ["source_id", "frame_id"])
    q = stateful.intake(frames, "1 day").writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out")
    q.awaitTermination()
    out = s.read.schema(stateful.INTAKE).parquet(f"{at}/out")
    return out.select("source_id", "kind", "frame_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "since")], "frames", "late")


#: w: the watermark in a batch, from what the batches before hold. Rows behind that of the batch before are dropped by Spark.
put("stream_intake", stream_intake, f"""{FR}, base AS ({_BASE.format(f5_frames="f5_frames")}), feed AS ({FEED.format(base="base")}),
ends AS (SELECT batch, date_trunc('millisecond', max(ts)) AS m FROM feed GROUP BY batch),
w AS (SELECT n.k AS batch, (SELECT max(m) FROM ends WHERE ends.batch < n.k) - INTERVAL '1 day' AS w FROM range((SELECT max(batch) + 2 FROM feed)) n(k)),
own AS (SELECT DISTINCT source_id, frame_id, ts, min(batch) OVER (PARTITION BY source_id, frame_id) AS batch FROM (
  SELECT f.* FROM feed f LEFT JOIN w ON w.batch = f.batch - 1 WHERE w.w IS NULL OR f.ts > w.w)),
turn AS (SELECT source_id, batch, max(ts) AS newest, min(ts) AS oldest FROM own GROUP BY ALL),
clock AS (SELECT t.*, max(newest) OVER (PARTITION BY source_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turn t),
begun AS (SELECT c.*, CASE WHEN before IS NULL OR coalesce(date_trunc('millisecond', before) + INTERVAL '1 day' < w.w, false) THEN 1 ELSE 0 END AS new FROM clock c LEFT JOIN w ON w.batch = c.batch - 1),
part AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY batch) AS life FROM begun),
told AS (SELECT o.source_id, o.frame_id, o.ts, p.life, CASE WHEN p.new = 0 AND o.ts < p.before THEN 'late' ELSE 'frame' END AS kind FROM own o JOIN part p USING (source_id, batch)),
lives AS (SELECT source_id, life, max(ts) AS newest, count(*) FILTER (WHERE kind = 'frame') AS frames, count(*) FILTER (WHERE kind = 'late') AS late FROM told GROUP BY ALL),
since AS (SELECT source_id, life, arg_min(oldest, batch) AS since FROM part GROUP BY ALL)
SELECT source_id, kind, frame_id, ts AS at, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS BIGINT) AS frames, CAST(NULL AS BIGINT) AS late FROM told
UNION ALL SELECT source_id, 'closed', NULL, newest, since, frames, late FROM lives JOIN since USING (source_id, life)
  WHERE life < (SELECT max(life) FROM part p WHERE p.source_id = lives.source_id) OR date_trunc('millisecond', newest) + INTERVAL '1 day' < (SELECT max(w) FROM w)""")


def stream_recordings(s, d):
    """Recordings to files: a run over the first two weeks, and another one, from the same checkpoint, over the rest."""
    from pixeltide.sources import images
    from pixeltide.streaming import stateful

    stateful.prepare(s.range(1).withColumn("ts", F.current_timestamp()))  # the state store
    rows = tick_table(s, d).withColumn("batch", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    at, kind = scratch(s), "source_id long, ts timestamp, payload double, session long"
    for weeks in ((0, 1), (2, 3, 4)):
        ticks = feed(s, rows, f"{at}/in", weeks)
        images.stream_frames(stateful.recordings(ticks), f"{at}/out", f"{at}/state").awaitTermination()
    return images.read_streamed(s, f"{at}/out", kind).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


put("stream_recordings", stream_recordings, f"WITH {TICK}, u AS (SELECT *, CASE WHEN has_frame AND NOT coalesce(lag(has_frame) OVER w, false) THEN 1 ELSE 0 END AS st FROM t WINDOW w AS (PARTITION BY source_id ORDER BY ts)), v AS (SELECT source_id, ts, has_frame, payload, CAST(sum(st) OVER (PARTITION BY source_id ORDER BY ts) AS BIGINT) AS session FROM u) SELECT source_id, ts, payload, session FROM v WHERE has_frame")

# --- pairs of boxes of one stream: a frame's with the next frame's
A = "a AS MATERIALIZED (SELECT stream_id, frame_no, det_id AS a_id, x1, y1, x2, y2, score FROM f4_stream), b AS MATERIALIZED (SELECT stream_id, frame_no-1 AS frame_no, det_id AS b_id, x1, y1, x2, y2, score FROM f4_stream)"
ONCE = ST.replace("f4_stream AS (", "f4_stream AS MATERIALIZED (")
FKEY = ["stream_id", "frame_no"]


def next_pairs(s, d, **how):
    f = fixture(s, d, "f4_stream")
    a = f.withColumnRenamed("det_id", "a_id")
    b = f.withColumn("frame_no", F.col("frame_no") - 1).withColumnRenamed("det_id", "b_id")
    return T.iou_pairs(a, b, FKEY, **how)


PAIRS = f"{A}, pr AS (SELECT a.stream_id, a.frame_no, a_id, b_id, a.score AS a_score, b.score AS b_score, {iou_sql('a', 'b', 0, '1e-7')} AS iou FROM a JOIN b ON b.stream_id=a.stream_id AND b.frame_no=a.frame_no)"
put("iou_pairs", lambda s, d: next_pairs(s, d).select(*FKEY, "a_id", "b_id", F.round("iou", 6).alias("iou")), f"{ONCE}, {PAIRS} SELECT stream_id, frame_no, a_id, b_id, round(iou, 6) AS iou FROM pr")
put("overlapping_pairs", lambda s, d: next_pairs(s, d, only_overlapping=True).select(*FKEY, "a_id", "b_id", F.round("iou", 6).alias("iou")), f"{ONCE}, {PAIRS} SELECT stream_id, frame_no, a_id, b_id, round(iou, 6) AS iou FROM pr WHERE iou > 0")
DEEP = (("x1", "x2"), ("y1", "y2"), ("z1", "z2"))


def crowd_pairs(s, d):
    """Boxes of a frame with a depth, by their scores: those of class 0 with those of class 1."""
    f = fixture(s, d, "f3_crowd").withColumn("z1", F.floor(F.col("score") * 10).cast("double")).withColumn("z2", F.col("z1") + 1 + F.col("det_id") % 3)
    a, b = f.where("class_id = 0").withColumnRenamed("det_id", "a_id"), f.where("class_id = 1").withColumnRenamed("det_id", "b_id")
    return T.iou_pairs(a.drop("score"), b.drop("score"), ["frame_id"], only_overlapping=True, axes=DEEP)


put("overlapping_solids", lambda s, d: crowd_pairs(s, d).select("frame_id", "a_id", "b_id", F.round("iou", 6).alias("iou")), f"""{ctes("f3_crowd").replace("f3_crowd AS (", "f3_crowd AS MATERIALIZED (")}, z AS MATERIALIZED (SELECT frame_id, det_id, class_id, x1, y1, x2, y2, floor(score*10) AS z1, floor(score*10)+1+det_id%3 AS z2 FROM f3_crowd),
o AS (SELECT a.frame_id, a.det_id AS a_id, b.det_id AS b_id, (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))*(least(a.z2,b.z2)-greatest(a.z1,b.z1)) AS i, (a.x2-a.x1)*(a.y2-a.y1)*(a.z2-a.z1)+(b.x2-b.x1)*(b.y2-b.y1)*(b.z2-b.z1) AS s
FROM z a JOIN z b ON a.frame_id=b.frame_id AND a.class_id=0 AND b.class_id=1 AND least(a.x2,b.x2)>greatest(a.x1,b.x1) AND least(a.y2,b.y2)>greatest(a.y1,b.y1) AND least(a.z2,b.z2)>greatest(a.z1,b.z1))
SELECT frame_id, a_id, b_id, round(i/(s-i+1e-7), 6) AS iou FROM o""")


def appearance(s, d):
    e = fixture(s, d, "embeddings")
    p = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("fa")).join(e.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("fb")), "a_id")
    p = p.withColumn("iou", (F.col("a_id") % 10) / 10)
    return T.appearance_pairs(p).select("a_id", *[F.round(c, 6).alias(c) for c in ("cosdist", "similarity", "aptitude")])


put("appearance_pairs", appearance, "WITH p AS (SELECT a.vec_id AS a_id, greatest(0e0, 1-list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS c FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1) SELECT a_id, round(c, 6) AS cosdist, round(1-c/2, 6) AS similarity, round((a_id%10)/10e0*(0.5+0.5*(1-c/2)), 6) AS aptitude FROM p")
put("fuse_cost", lambda s, d: T.fuse_cost(next_pairs(s, d).withColumn("score", F.col("b_score")).withColumn("reid", (F.col("a_id") + 1) / (F.col("b_id") + 2)).withColumn("gate", F.abs(F.col("a_id") - F.col("b_id")).cast("double"))).select(*FKEY, "a_id", "b_id", *[F.round(c, 6).alias(c) for c in ("by_score", "by_iou", "by_motion")]), f"{ONCE}, {PAIRS} SELECT stream_id, frame_no, a_id, b_id, round(1-iou*b_score, 6) AS by_score, round(1-(a_id+1)/CAST(b_id+2 AS DOUBLE)*(1+iou)/2, 6) AS by_iou, round(0.98e0*(1-iou)+0.02e0*abs(a_id-b_id), 6) AS by_motion FROM pr")


def gated(s, d):
    f = fixture(s, d, "f4_stream")
    m = lambda p: [((F.col("x1") + F.col("x2")) / 2).alias(f"{p}x"), ((F.col("y1") + F.col("y2")) / 2).alias(f"{p}y"), ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias(f"{p}a"), (F.col("y2") - F.col("y1")).alias(f"{p}h")]
    a = f.select(*FKEY, F.col("det_id").alias("a_id"), *m("a"))
    b = f.select("stream_id", (F.col("frame_no") - 1).alias("frame_no"), F.col("det_id").alias("b_id"), *m("b"))
    p = a.join(b, FKEY)
    var = lambda n: F.lit(0.0101) if n == "a" else F.col("ah") * F.col("ah") * 0.0125
    p = p.select("*", *[e for n in "xyah" for e in ((F.col(f"a{n}") - F.col(f"b{n}")).alias(f"{n}_d"), var(n).alias(f"{n}_var"))])
    return T.gate_pairs(p).select(*FKEY, "a_id", "b_id", F.round("gate", 6).alias("gate"))


_MEAS = "SELECT stream_id, frame_no, det_id, (x1+x2)/2 AS x, (y1+y2)/2 AS y, (x2-x1)/(y2-y1) AS a, y2-y1 AS h FROM f4_stream"
put("gate_pairs", gated, f"""{ST}, m AS ({_MEAS}), g AS (SELECT p.stream_id, p.frame_no, p.det_id AS a_id, q.det_id AS b_id, (p.x-q.x)*(p.x-q.x)/(p.h*p.h*0.0125e0) + (p.y-q.y)*(p.y-q.y)/(p.h*p.h*0.0125e0) + (p.a-q.a)*(p.a-q.a)/0.0101e0 + (p.h-q.h)*(p.h-q.h)/(p.h*p.h*0.0125e0) AS gate
FROM m p JOIN m q ON q.stream_id = p.stream_id AND q.frame_no = p.frame_no + 1) SELECT stream_id, frame_no, a_id, b_id, round(gate, 6) AS gate FROM g WHERE gate <= 9.4877e0""")


def costs(s, d):
    """Distances in whole tenths, so that ties and conflicts occur."""
    f = fixture(s, d, "f4_stream")
    a = f.select(*FKEY, F.col("det_id").alias("a_id"), F.col("x1").alias("ax"))
    b = f.select("stream_id", (F.col("frame_no") - 1).alias("frame_no"), F.col("det_id").alias("b_id"), F.col("x1").alias("bx"))
    return a.join(b, FKEY).select(*FKEY, "a_id", "b_id", F.abs(F.col("ax") - F.col("bx") - 60).alias("cost"))


COST = "c AS (SELECT a.stream_id, a.frame_no, a.det_id AS a_id, b.det_id AS b_id, abs(a.x1-b.x1-60) AS cost FROM f4_stream a JOIN f4_stream b ON b.stream_id=a.stream_id AND b.frame_no=a.frame_no+1)"
put("assign_greedy", lambda s, d: T.assign_greedy(costs(s, d), FKEY, 150.0), f"""{ctes("f4_stream", recursive=True)}, {COST}, k AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_no ORDER BY cost, a_id, b_id) AS r FROM c WHERE cost < 150),
rec AS (SELECT stream_id, frame_no, r, [{{'a': a_id, 'b': b_id, 'c': cost}}] AS kept FROM k WHERE r=1 UNION ALL SELECT k.stream_id, k.frame_no, k.r, CASE WHEN len([q FOR q IN kept IF q.a=k.a_id OR q.b=k.b_id]) = 0 THEN list_append(kept, {{'a': k.a_id, 'b': k.b_id, 'c': k.cost}}) ELSE kept END FROM rec JOIN k ON k.stream_id=rec.stream_id AND k.frame_no=rec.frame_no AND k.r=rec.r+1),
done AS (SELECT stream_id, frame_no, unnest(arg_max(kept, r)) AS q FROM rec GROUP BY stream_id, frame_no) SELECT stream_id, frame_no, q.a AS a_id, q.b AS b_id, q.c AS cost FROM done""")
put("assign_optimal", lambda s, d: T.assign_optimal(costs(s, d), FKEY, 150.0))


def least_cost(s, d):
    """How much the pairs made save, against leaving everything alone; the best assignment isn't always the only one."""
    made = T.assign_optimal(costs(s, d), FKEY, 150.0)
    return made.groupBy(*FKEY).agg(F.count("*").alias("pairs"), F.sum(150 - F.col("cost")).alias("saved"))


#: All ways to pair three with three at most; a pair that saves nothing needn't be made, so only savings are compared.
put("assign_optimal_cost", lambda s, d: least_cost(s, d).where("saved > 0").select(*FKEY, "saved"), f"""{ONCE}, {COST}, g AS (SELECT stream_id, frame_no, {", ".join(f"coalesce(max(150-cost) FILTER (WHERE a_id={i} AND b_id={j} AND cost<=150), 0) AS g{i}{j}" for i in range(3) for j in range(3))} FROM c GROUP BY stream_id, frame_no),
m AS (SELECT stream_id, frame_no, greatest({", ".join("+".join(f"g{i}{j}" for i, j in enumerate(p)) for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)))}) AS saved FROM g) SELECT * FROM m WHERE saved > 0""")


def multi(s, d):
    """Pairs over a low bound besides the assigned ones, where greedy and best assignment are the same: costs without ties."""
    pairs = next_pairs(s, d).withColumn("cost", 1 - F.col("iou") + F.col("a_id") * 1e-4 + F.col("b_id") * 1e-5)
    best = pairs.where("a_id = 0").withColumn("r", F.row_number().over(Window.partitionBy(*FKEY).orderBy("cost"))).where("r = 1")
    return T.multi_match(pairs, T.assign_optimal(best, FKEY, 2.0), FKEY, 0.1, 0.02).select(*FKEY, "a_id", "b_id", "extra")


put("multi_match", multi, f"""{ONCE}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_no ORDER BY 1-iou+a_id*1e-4+b_id*1e-5) AS r FROM pr WHERE a_id = 0),
o AS (SELECT stream_id, frame_no, b_id AS own FROM r WHERE r = 1) SELECT stream_id, frame_no, a_id, b_id, b_id <> own AS extra FROM pr JOIN o USING (stream_id, frame_no) WHERE a_id = 0 AND (b_id = own AND iou >= 0.1 OR b_id <> own AND iou > 0.02)""")

TK = ["stream_id", "det_id"]
RST = ctes("f4_stream", recursive=True)
RANK = "k AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h, (x2-x1)/(y2-y1) AS ar, row_number() OVER (PARTITION BY stream_id, det_id ORDER BY frame_no) AS r FROM f4_stream)"


def _kalman_sql(axes, z, first, noise, sizes=(), dt="CAST(1 AS DOUBLE)"):
    """axes: names; z: measurement columns; first: (a, c) of each axis; noise: (qp, qb, qv, r) of each axis."""
    start = ", ".join(f"{z[n]} AS {n}, 0e0 AS v{n}, CAST({first[n][0]} AS DOUBLE) AS a{n}, 0e0 AS b{n}, CAST({first[n][1]} AS DOUBLE) AS c{n}" for n in axes) + "".join(f", {z[n]} AS {n}, 1000e0 AS p{n}" for n in sizes)
    pre = ", ".join(f"s.{n}+{dt}*s.v{n} AS {n}, s.v{n} AS v{n}, s.a{n}+2*{dt}*s.b{n}+{dt}*{dt}*s.c{n}+{noise[n][0]} AS a{n}, s.b{n}+{dt}*s.c{n}+{noise[n][1]} AS b{n}, s.c{n}+{noise[n][2]} AS c{n}, {noise[n][3]} AS r{n}, k.{z[n]} AS z{n}" for n in axes) + "".join(f", s.{n} AS {n}, s.p{n}+10 AS p{n}, k.{z[n]} AS z{n}" for n in sizes)
    post = ", ".join(f"{n}+a{n}/(a{n}+r{n})*(z{n}-{n}), v{n}+b{n}/(a{n}+r{n})*(z{n}-{n}), a{n}*(1-a{n}/(a{n}+r{n})), b{n}*(1-a{n}/(a{n}+r{n})), c{n}-b{n}/(a{n}+r{n})*b{n}" for n in axes) + "".join(f", {n}+p{n}/(p{n}+1)*(z{n}-{n}), p{n}*(1-p{n}/(p{n}+1))" for n in sizes)
    out = ", ".join(f"round({n}, 6) AS {n}" for n in [*axes, *sizes]) + "".join(f", round(v{n}, 6) AS v{n}" for n in axes)
    return f"""{RST}, {RANK}, s AS (SELECT stream_id, det_id, frame_no, r, {start} FROM k WHERE r=1
UNION ALL SELECT stream_id, det_id, frame_no, r, {post} FROM (SELECT k.stream_id, k.det_id, k.frame_no, k.r, {pre} FROM s JOIN k ON k.stream_id=s.stream_id AND k.det_id=s.det_id AND k.r=s.r+1) p)
SELECT stream_id, det_id, frame_no, {out} FROM s"""


def six(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


_DT = "(1/30e0)"
_Q = (f"5000*{_DT}*{_DT}*{_DT}*{_DT}/4", f"5000*{_DT}*{_DT}*{_DT}/2", f"5000*{_DT}*{_DT}", "0.1e0")
put("kalman_box", on("f4_stream", lambda p: six(T.kalman_smooth(p, TK), "cx", "cy", "w", "h", "vcx", "vcy")), _kalman_sql(["cx", "cy"], {n: n for n in ("cx", "cy", "w", "h")}, {n: (1000, 1000) for n in ("cx", "cy")}, {n: _Q for n in ("cx", "cy")}, ("w", "h"), _DT))
_HN = ("s.h*s.h*0.0025e0", "0e0", "s.h*s.h*(1/25600e0)", "(s.h+s.vh)*(s.h+s.vh)*0.0025e0")
_RN = ("1e-4", "0e0", "1e-10", "1e-2")
put("kalman_xyah", on("f4_stream", lambda p: six(T.kalman_smooth(p, TK, "xyah"), "cx", "cy", "r", "h", "vcx", "vcy", "vr", "vh").withColumnsRenamed({"r": "ra", "vr": "vra"})), _kalman_sql(["cx", "cy", "ra", "h"], {"cx": "cx", "cy": "cy", "ra": "ar", "h": "h"}, {n: ("1e-4", "1e-10") if n == "ra" else ("h*h*0.01e0", "h*h*0.00390625e0") for n in ("cx", "cy", "ra", "h")}, {n: _RN if n == "ra" else _HN for n in ("cx", "cy", "ra", "h")}))


def classed(s, d):
    return fixture(s, d, "f4_stream").withColumn("class_id", (F.col("frame_no") * 7 % 5 % 3).cast("int"))


put("smooth_tracks", lambda s, d: six(T.smooth_tracks(classed(s, d), TK), "score", "x1", "y1", "x2", "y2"), f"""{RST}, k AS (SELECT *, frame_no*7%5%3 AS cls, row_number() OVER (PARTITION BY stream_id, det_id ORDER BY frame_no) AS r FROM f4_stream),
s AS (SELECT stream_id, det_id, frame_no, r, score, x1, y1, x2, y2 FROM k WHERE r=1 UNION ALL SELECT k.stream_id, k.det_id, k.frame_no, k.r, s.score*0.8e0+k.score*0.2e0, s.x1*0.5e0+k.x1*0.5e0, s.y1*0.5e0+k.y1*0.5e0, s.x2*0.5e0+k.x2*0.5e0, s.y2*0.5e0+k.y2*0.5e0 FROM s JOIN k ON k.stream_id=s.stream_id AND k.det_id=s.det_id AND k.r=s.r+1),
c AS (SELECT a.stream_id, a.det_id, a.frame_no, b.cls, count(*) AS n, min(b.frame_no) AS f FROM k a JOIN k b ON b.stream_id=a.stream_id AND b.det_id=a.det_id AND b.frame_no<=a.frame_no GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY stream_id, det_id, frame_no ORDER BY n DESC, f) AS q FROM c)
SELECT s.stream_id, s.det_id, s.frame_no, round(score, 6) AS score, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, CAST(m.cls AS INT) AS class_id FROM s JOIN m ON m.stream_id=s.stream_id AND m.det_id=s.det_id AND m.frame_no=s.frame_no AND q=1""")


def two_sides(s, d):
    """Detections as tracks: even frames tracked, and the frames after them as lost ones, aged by their number."""
    f = fixture(s, d, "f4_stream").select("stream_id", "frame_no", F.col("det_id").alias("track_id"), *T.BOX, (F.col("frame_no") % 11).alias("age"))
    return f.where("frame_no % 2 = 0"), f.where("frame_no % 2 = 1").withColumn("frame_no", F.col("frame_no") - 1)


def deduped(s, d):
    a, b = T.dedupe_tracks(*two_sides(s, d), FKEY)
    return a.withColumn("side", F.lit("tracked")).unionByName(b.withColumn("side", F.lit("lost"))).select(*FKEY, "track_id", "age", "side")


put("dedupe_tracks", deduped, f"""{ST}, f AS (SELECT stream_id, frame_no, det_id AS track_id, x1, y1, x2, y2, frame_no%11 AS age FROM f4_stream), a AS (SELECT * FROM f WHERE frame_no%2=0), b AS (SELECT stream_id, frame_no-1 AS frame_no, track_id, x1, y1, x2, y2, age FROM f WHERE frame_no%2=1),
p AS (SELECT a.stream_id, a.frame_no, a.track_id AS i, b.track_id AS j, a.age > b.age AS older FROM a JOIN b ON b.stream_id=a.stream_id AND b.frame_no=a.frame_no WHERE 1-{iou_sql('a', 'b')} < 0.15e0)
SELECT stream_id, frame_no, track_id, age, 'tracked' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.stream_id=a.stream_id AND p.frame_no=a.frame_no AND p.i=a.track_id AND NOT older) UNION ALL SELECT stream_id, frame_no, track_id, age, 'lost' AS side FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.stream_id=b.stream_id AND p.frame_no=b.frame_no AND p.j=b.track_id AND older)""")
put("history_sample", on("f4_stream", lambda p: T.history_sample(p, TK)), f"""{RST}, k AS (SELECT stream_id, det_id, frame_no, row_number() OVER (PARTITION BY stream_id, det_id ORDER BY frame_no) AS r, min(frame_no) OVER (PARTITION BY stream_id, det_id) AS st FROM f4_stream),
s AS (SELECT stream_id, det_id, r, st, [frame_no] AS a FROM k WHERE r=1 UNION ALL SELECT k.stream_id, k.det_id, k.r, k.st, CASE WHEN len(a)<4 THEN list_append(a, k.frame_no) WHEN k.frame_no-k.st >= (a[1]-k.st)*4 THEN list_append(a[2:4], k.frame_no) ELSE a END FROM s JOIN k ON k.stream_id=s.stream_id AND k.det_id=s.det_id AND k.r=s.r+1)
SELECT stream_id, det_id, unnest(arg_max(a, r)) AS frame_no FROM s GROUP BY stream_id, det_id""")
NAMED = "tr AS (SELECT *, stream_id || ':' || (frame_no // 20) || ':' || det_id AS track_id FROM f4_stream), di AS (SELECT stream_id, track_id, row_number() OVER (PARTITION BY stream_id ORDER BY min(struct_pack(a := frame_no, b := det_id)), track_id)-1 AS display_id FROM tr GROUP BY stream_id, track_id)"


def named(s, d):
    f = fixture(s, d, "f4_stream")
    return f.withColumn("track_id", F.concat_ws(":", F.col("stream_id").cast("string"), F.floor(F.col("frame_no") / 20).cast("string"), F.col("det_id").cast("string")))


put("display_ids", lambda s, d: T.display_ids(named(s, d), ["stream_id"], ["frame_no", "det_id"]).select("stream_id", "frame_no", "det_id", "track_id", "display_id"), f"{ST}, {NAMED} SELECT tr.stream_id, frame_no, det_id, tr.track_id, display_id FROM tr JOIN di USING (stream_id, track_id)")
put("namespaced_ids", lambda s, d: T.namespaced_ids(named(s, d)).select("stream_id", "frame_no", "det_id", "track_id"), f"{ST}, {NAMED} SELECT stream_id, frame_no, det_id, class_id || '_' || track_id AS track_id FROM tr")


def tagged(s, d):
    t = T.display_ids(named(s, d), ["stream_id"], ["frame_no", "det_id"]).withColumn("frame_id", F.col("stream_id") * 1000 + F.col("frame_no"))
    return N.annotate_tracks(t, labels(s, d))


_X, _Y = "floor(x1)", "floor(y1)"
put("annotate_tracks", tagged, f"{ST}, {NAMED}, an AS (SELECT stream_id*1000+frame_no AS frame_id, x1, y1, x2, y2, 'TID:' || display_id || '(' || printf('%.2f', score) || ')' AS t1, 'CID:' || class_id || '(' || n_name || ')' AS t2, {color('display_id')} FROM tr JOIN di USING (stream_id, track_id) LEFT JOIN nation ON n_nationkey=class_id) {parts('an', [(*BOXROW, 2), ('text', _X, _Y + '-36', _X, _Y + '-36', 't1', 2), ('text', _X, _Y + '-12', _X, _Y + '-12', 't2', 2)])}")
for kind in K.TRACKERS:
    put(f"track_{kind}", on("f4_stream", lambda p, k=kind: K.track(p, k)))
put("track_box_acceleration", on("f4_stream", lambda p: K.track(p, "box", motion="acceleration")))
put("track_score_crowded", on("f4_stream", lambda p: K.track(p, "score", crowded=True)))
put("track_point_corners", on("f4_stream", lambda p: K.track(p, "point", distance="corners", limit=20.0, period=2)))


def featured(s, d):
    """Detections with a vector: that of their stream and object."""
    f, e = fixture(s, d, "f4_stream"), fixture(s, d, "embeddings")
    n = e.count()
    return f.withColumn("vec_id", (F.col("stream_id") * 3 + F.col("det_id")) % n).join(e.select("vec_id", F.col("embedding").alias("feature")), "vec_id").drop("vec_id")


put("track_box_features", lambda s, d: K.track(featured(s, d), "box", beta=0.5))


def stream_tracks(s, d):
    """Tracks of the detections as a stream reads them."""
    import uuid

    from pixeltide.operators.rounds import checkpoint
    from pixeltide.streaming import stateful

    checkpoint(s.range(1))
    at = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    s.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    fixture(s, d, "f4_stream").drop("ts").write.parquet(f"{at}/in")
    rows = s.readStream.schema(s.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    q = stateful.track(rows, "box").writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out")
    q.awaitTermination()
    return s.read.schema(K.SCHEMA).parquet(f"{at}/out")


put("stream_track_box", stream_tracks)


def scored(s, d):
    f = fixture(s, d, "f4_stream")
    truth = f.select(F.col("stream_id").alias("seq"), "frame_no", F.col("det_id").alias("id"), *T.BOX)
    pred = K.track(f, "box").select(F.col("stream_id").alias("seq"), "frame_no", F.col("track_id").alias("id"), *T.BOX)
    return M.mot_metrics(truth, pred)


put("mot_metrics", scored)


def shifted(s, d):
    """Predictions: the truth moved by a few pixels, some missing, names that change every 20 frames."""
    f = fixture(s, d, "f4_stream")
    truth = f.select(F.col("stream_id").alias("seq"), "frame_no", F.col("det_id").alias("id"), *T.BOX)
    pred = f.where("(frame_no + det_id) % 9 <> 0").select(F.col("stream_id").alias("seq"), "frame_no", (F.floor(F.col("frame_no") / 20) * 10 + F.col("det_id")).alias("id"), (F.col("x1") + F.col("frame_no") % 5).alias("x1"), "y1", (F.col("x2") + F.col("frame_no") % 5).alias("x2"), "y2")
    return truth, pred


put("mot_counts", lambda s, d: M.mot_metrics(*shifted(s, d)).select("seq", "n_truth", "n_pred", "tp", "fp", "fn", "switches", F.round("motp", 6).alias("motp")), f"""{ST}, p AS (SELECT stream_id, frame_no, det_id, frame_no // 20 AS part, x1+frame_no%5 AS x1, y1, x2+frame_no%5 AS x2, y2 FROM f4_stream WHERE (frame_no+det_id)%9 <> 0),
m AS (SELECT t.stream_id, t.det_id, p.part, t.frame_no, 1-{iou_sql('t', 'p')} AS dist FROM f4_stream t JOIN p ON p.stream_id=t.stream_id AND p.frame_no=t.frame_no AND p.det_id=t.det_id),
w AS (SELECT *, coalesce(part <> lag(part) OVER (PARTITION BY stream_id, det_id ORDER BY frame_no), false) AS sw FROM m),
h AS (SELECT stream_id, count(*) AS tp, sum(dist) AS dist, count(*) FILTER (WHERE sw) AS sw FROM w GROUP BY stream_id),
j AS (SELECT stream_id AS seq, (SELECT count(*) FROM f4_stream f WHERE f.stream_id=h.stream_id) AS n_truth, (SELECT count(*) FROM p f WHERE f.stream_id=h.stream_id) AS n_pred, tp, dist, sw FROM h)
SELECT seq, CAST(sum(n_truth) AS BIGINT) AS n_truth, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred)-sum(tp) AS BIGINT) AS fp, CAST(sum(n_truth)-sum(tp) AS BIGINT) AS fn, CAST(sum(sw) AS BIGINT) AS switches, round(sum(dist)/sum(tp), 6) AS motp FROM j GROUP BY ROLLUP (seq)""")

# --- pipeline documents
ND, LK = ctes("f9_nodes"), ctes("f9_links")
RLK = ctes("f9_links", recursive=True)


def documents(s, d):
    """One exported document per pipeline, as text, from the node and link tables."""
    n, e = fixture(s, d, "f9_nodes"), fixture(s, d, "f9_links")
    name = lambda i, t: F.concat_ws(":", i.cast("string"), t)
    setting = F.create_map(F.lit("ver"), F.col("ver"), F.lit("gain"), F.col("node_id").cast("string"))
    body = F.struct(F.col("node_id").cast("string").alias("id"), F.col("port_type").alias("name"), setting.alias("setting"))
    nodes = n.groupBy("pipeline_id").agg(F.sort_array(F.collect_list(F.struct("node_id", name(F.col("node_id"), F.col("port_type")).alias("k"), F.to_json(body).alias("b")))).alias("n"))
    src = F.concat_ws(":", name(F.col("src"), F.col("src_type")), F.col("src_type"), F.lit("Output01"))
    dst = F.concat_ws(":", name(F.col("dst"), F.col("dst_type")), F.col("dst_type"), F.lit("Input01"))
    links = e.groupBy("pipeline_id").agg(F.sort_array(F.collect_list(F.array(src, dst))).alias("l"))
    quoted = F.concat(F.lit('["'), F.array_join(F.transform("n", lambda x: x["k"]), '","'), F.lit('"]'))
    bodies = F.array_join(F.transform("n", lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["b"])), ",")
    doc = F.concat(F.lit('{"node_list":'), quoted, F.lit(',"link_list":'), F.to_json(F.coalesce("l", F.array().cast("array<array<string>>"))), F.lit(","), bodies, F.lit("}"))
    return nodes.join(links, "pipeline_id", "left").select("pipeline_id", doc.alias("doc"))


put("parse_pipelines", lambda s, d: L.parse_nodes(documents(s, d)).select("pipeline_id", "pos", "node_id", "node_tag", "ver", F.col("settings")["gain"].alias("gain")), f"{ND} SELECT pipeline_id, node_id-1 AS pos, node_id, port_type AS node_tag, ver, CAST(node_id AS VARCHAR) AS gain FROM f9_nodes")
put("parse_links", lambda s, d: L.parse_links(documents(s, d)).select("pipeline_id", "src", "src_type", "src_port", "dst", "dst_type", "dst_port"), f"{LK} SELECT pipeline_id, src, CASE WHEN src=2 AND dst=1 THEN 'Image' ELSE src_type END AS src_type, 'Output01' AS src_port, dst, dst_type, 'Input01' AS dst_port FROM f9_links")
VALID = "v AS (SELECT pipeline_id, src, dst, src_type, dst_type FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, dst ORDER BY src) AS k FROM f9_links WHERE src_type=dst_type) WHERE k=1)"
put("validate_links", on("f9_links", lambda p: L.validate_links(p, ["src"])), f"{LK}, {VALID} SELECT * FROM v")
put("pipeline_levels", lambda s, d: L.pipeline_levels(fixture(s, d, "f9_nodes"), fixture(s, d, "f9_links")), f"""{RLK}, lv(pipeline_id, node_id, level) AS (SELECT pipeline_id, node_id, 0 FROM f9_nodes n WHERE NOT EXISTS (SELECT 1 FROM f9_links l WHERE l.pipeline_id=n.pipeline_id AND l.dst=n.node_id) UNION SELECT l.pipeline_id, l.dst, level+1 FROM lv JOIN f9_links l ON l.pipeline_id=lv.pipeline_id AND l.src=lv.node_id WHERE l.pipeline_id NOT IN (SELECT pipeline_id FROM f9_links WHERE src=2 AND dst=1))
SELECT n.pipeline_id, n.node_id, CASE WHEN n.pipeline_id IN (SELECT pipeline_id FROM f9_links WHERE src=2 AND dst=1) THEN NULL ELSE max(level) END AS level FROM f9_nodes n LEFT JOIN lv USING (pipeline_id, node_id) GROUP BY n.pipeline_id, n.node_id""")


def current(s, d):
    kinds = fixture(s, d, "f9_nodes").select("port_type").distinct()
    return kinds.withColumn("ver", F.when(F.col("port_type") == "Text", "0.0.2").otherwise("0.0.1"))


put("version_check", lambda s, d: L.version_check(fixture(s, d, "f9_nodes"), current(s, d)).select("pipeline_id", "node_id", "port_type", "ver", "code_ver"), f"{ND} SELECT pipeline_id, node_id, port_type, ver, CASE WHEN port_type='Text' THEN '0.0.2' ELSE '0.0.1' END AS code_ver FROM f9_nodes WHERE ver <> CASE WHEN port_type='Text' THEN '0.0.2' ELSE '0.0.1' END")


def without(s, d):
    n, e = fixture(s, d, "f9_nodes"), fixture(s, d, "f9_links")
    left, links = L.delete_nodes(n, e, n.where("ver = '0.0.0'").select("pipeline_id", "node_id"))
    one = left.select("pipeline_id", F.col("node_id").alias("src"), F.lit(None).cast("int").alias("dst"))
    return one.unionByName(links.select("pipeline_id", "src", "dst"))


put("delete_node", without, f"{LK}, g AS (SELECT pipeline_id, node_id FROM f9_nodes WHERE ver='0.0.0') SELECT pipeline_id, node_id AS src, CAST(NULL AS INT) AS dst FROM f9_nodes WHERE ver <> '0.0.0' UNION ALL SELECT pipeline_id, src, dst FROM f9_links l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.pipeline_id=l.pipeline_id AND g.node_id IN (l.src, l.dst))")


def run_document(s, d):
    from pixeltide.operators import pixels as P
    from pixeltide.operators.stencil import box_blur

    doc = {
        "node_list": ["1:Image", "4:Threshold", "2:Blur", "3:Brightness"],
        "link_list": [["1:Image:Image:Output01", "2:Blur:Image:Input01"], ["2:Blur:Image:Output01", "3:Brightness:Image:Input01"], ["3:Brightness:Image:Output01", "4:Threshold:Image:Input01"]],
        "2:Blur": {"id": "2", "name": "Blur", "setting": {"ver": "0.0.1", "k": 3}},
        "3:Brightness": {"id": "3", "name": "Brightness", "setting": {"ver": "0.0.1", "beta": 30}},
        "4:Threshold": {"id": "4", "name": "Threshold", "setting": {"ver": "0.0.1", "kind": "binary", "t": 140}},
    }
    operators = {"Blur": lambda p, k: box_blur(p, k, 8, 8), "Brightness": P.brightness, "Threshold": P.threshold}
    return L.run_pipeline(doc, {"1:Image": fixture(s, d, "f1_gray")}, operators)["4:Threshold"]


_M8 = "(CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= 8 THEN 14-({0}) ELSE {0} END)"
put("run_pipeline", run_document, f"{ctes('f1_gray')}, b AS (SELECT t.frame_id, t.y, t.x, t.c, least(255, round_even(sum(s.v)/CAST(9 AS DOUBLE), 0)+30) AS v FROM f1_gray t, range(-1, 2) dy(i), range(-1, 2) dx(i) JOIN f1_gray s ON s.frame_id=t.frame_id AND s.y={_M8.format('t.y+dy.i')} AND s.x={_M8.format('t.x+dx.i')} GROUP BY ALL) SELECT frame_id, y, x, c, CASE WHEN v > 140 THEN 255 ELSE 0 END AS v FROM b")


def double_every_third(frame):
    if int(frame.frame_id.iloc[0]) % 3 == 2:
        raise ValueError("third")
    return frame.assign(payload=frame.payload * 2)


put("apply_user_code", on("f5_frames", lambda p: L.apply_user_code(p.select("frame_id", "payload"), double_every_third)), f"{FR} SELECT frame_id, CASE WHEN frame_id%3=2 THEN payload ELSE payload*2 END AS payload, CASE WHEN frame_id%3=2 THEN 'ValueError: third' END AS error FROM f5_frames")
