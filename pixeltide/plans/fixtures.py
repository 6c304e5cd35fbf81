"""Frame, detection, stream and pipeline tables derived from the given tables, for Spark and for the oracle.

Each is one SELECT. `{emb}` and the names of other fixtures stand for tables; V scales a vector component to a pixel value
and P to a probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

V = "CAST(LEAST(255, GREATEST(0, FLOOR((e+0.6)*200))) AS INT)"
P = "LEAST(1e0, GREATEST(0e0, (e+0.6)/1.2))"

FIXTURES = {
    "f1_gray": f"SELECT vec_id AS frame_id, CAST(FLOOR(i/8) AS INT) AS y, i%8 AS x, 0 AS c, {V} AS v FROM {{emb}}",
    "f2_bgr": f"SELECT CAST(FLOOR(vec_id/3) AS BIGINT) AS frame_id, CAST(FLOOR(i/8) AS INT) AS y, i%8 AS x, CAST(vec_id%3 AS INT) AS c, {V} AS v FROM {{emb3}}",
    "f3_det": """SELECT l_orderkey AS frame_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) AS INT) AS det_id,
  CAST(l_partkey%40 AS DOUBLE) AS x1, CAST(l_suppkey%40 AS DOUBLE) AS y1,
  CAST(l_partkey%40+20+l_quantity AS DOUBLE) AS x2, CAST(l_suppkey%40+20+l_linenumber*5 AS DOUBLE) AS y2,
  CAST((l_partkey*37+l_linenumber*11)%1000 AS DOUBLE)/1000 AS score, CAST(l_partkey%5 AS INT) AS class_id
FROM {lineitem}""",
    "f3_crowd": """SELECT l_suppkey AS frame_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey) AS INT) AS det_id,
  CAST((l_partkey*7+l_orderkey)%300 AS DOUBLE) AS x1, CAST(l_orderkey*3%300 AS DOUBLE) AS y1,
  CAST((l_partkey*7+l_orderkey)%300+20+l_quantity AS DOUBLE) AS x2, CAST(l_orderkey*3%300+20+l_linenumber*5 AS DOUBLE) AS y2,
  CAST((l_partkey*37+l_linenumber*11)%1000 AS DOUBLE)/1000 AS score, CAST(l_partkey%5 AS INT) AS class_id
FROM {lineitem}""",
    "f4_stream": """SELECT stream_id, frame_no, ts, k AS det_id,
  CAST(100*k+(frame_no*(2+k))%60 AS DOUBLE) AS x1, CAST(50*k+frame_no%30 AS DOUBLE) AS y1,
  CAST(100*k+(frame_no*(2+k))%60+40 AS DOUBLE) AS x2, CAST(50*k+frame_no%30+60 AS DOUBLE) AS y2,
  CAST(3+(event_id+k)%7 AS DOUBLE)/10 AS score, k AS class_id
FROM (SELECT user_id AS stream_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS INT) AS frame_no, ts, event_id FROM {events}) e
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) o
WHERE (event_id+k)%7 <> 0""",
    "f5_frames": """SELECT user_id AS source_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS INT) AS frame_no, event_id AS frame_id, ts, value AS payload
FROM {events} WHERE event_type IN ('view','click')""",
    "f5_latency": "SELECT event_type AS node, CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts,event_id) AS INT) AS seq, CAST(FLOOR(value) AS INT) AS elapsed_ms FROM {events}",
    "f5_switch": "SELECT user_id AS source_id, ts, CASE WHEN event_type='signup' THEN 'ON' ELSE 'OFF' END AS state FROM {events} WHERE event_type IN ('signup','error')",
    "f5_params": "SELECT user_id AS source_id, ts, value AS param FROM {events} WHERE event_type='purchase'",
    "f6_rawpred": f"SELECT CAST(FLOOR(vec_id/8) AS BIGINT) AS frame_id, i AS anchor_id, CAST(vec_id%8 AS INT) AS attr, CASE WHEN vec_id%8<4 THEN e ELSE {P} END AS val FROM {{emb8}}",
    "f7_scores": "SELECT vec_id AS frame_id, i AS class_id, e AS score FROM {emb}",
    "f7_keypoints": f"""SELECT vec_id AS frame_id, 0 AS obj_id, CAST(FLOOR(i/3) AS INT) AS kp_id, MAX(CASE WHEN i%3=0 THEN {V} END) AS x,
  MAX(CASE WHEN i%3=1 THEN {V} END) AS y, MAX(CASE WHEN i%3=2 THEN {P} END) AS score
FROM {{emb}} WHERE i<63 GROUP BY vec_id, CAST(FLOOR(i/3) AS INT)""",
    "f8_planes": f"SELECT CAST(FLOOR(vec_id/4) AS BIGINT) AS frame_id, CAST(vec_id%4 AS INT) AS class_id, CAST(FLOOR(i/8) AS INT) AS y, i%8 AS x, {P} AS v FROM {{emb4}}",
    "f9_nodes": """SELECT o_custkey AS pipeline_id, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey) AS INT) AS node_id,
  CASE SUBSTR(o_orderpriority,1,1) WHEN '1' THEN 'Int' WHEN '2' THEN 'Float' WHEN '3' THEN 'Image' WHEN '4' THEN 'TimeMS' ELSE 'Text' END AS port_type,
  CASE WHEN o_orderkey%10=0 THEN '0.0.0' ELSE '0.0.1' END AS ver FROM {orders}""",
    "f9_links": """SELECT a.pipeline_id, a.node_id AS src, b.node_id AS dst, a.port_type AS src_type, b.port_type AS dst_type
FROM {f9_nodes} a JOIN {f9_nodes} b ON a.pipeline_id=b.pipeline_id AND b.node_id-a.node_id IN (1,2,3)
UNION ALL SELECT pipeline_id, 2, 1, 'Image', 'Image' FROM {f9_nodes} WHERE node_id=2 AND pipeline_id%50=0""",
    "f10_mosaic": f"SELECT CAST(FLOOR(vec_id/64) AS BIGINT) AS frame_id, CAST(FLOOR((vec_id%64)/8)*8+FLOOR(i/8) AS INT) AS y, CAST((vec_id%8)*8+i%8 AS INT) AS x, 0 AS c, {V} AS v FROM {{emb64}}",
}
#: The vectors, and as many of zeros as fill the last group of k.
_PADDED = """SELECT vec_id, i, e FROM {{emb}} UNION ALL SELECT n + k.j AS vec_id, i, CAST(0 AS DOUBLE) AS e
FROM (SELECT COUNT(*) AS n FROM {{embeddings}}) c CROSS JOIN ({numbers}) k CROSS JOIN ({places}) p WHERE n % {k} <> 0 AND k.j < {k} - n % {k}"""
PADDED = {f"emb{k}": _PADDED.format(k=k, numbers=" UNION ALL ".join(f"SELECT {j} AS j" for j in range(k)), places=" UNION ALL ".join(f"SELECT {i} AS i" for i in range(64))) for k in (3, 4, 8, 64)}
_EMB_SPARK = "SELECT vec_id, i, CAST(e AS DOUBLE) AS e FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, e"
_EMB_ORACLE = "SELECT vec_id, CAST(r.i AS INT) AS i, CAST(embedding[r.i+1] AS DOUBLE) AS e FROM embeddings, range(64) r(i)"


def filled(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """PADDED for Spark, with the number of vectors from the files' footers."""
    emb, n = fixture(spark, sf_dir, "emb"), spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    if n % k == 0:
        return emb
    more = spark.range(n * 64, (n + k - n % k) * 64, 1, 1)
    return emb.unionByName(more.selectExpr("id div 64 AS vec_id", "CAST(id % 64 AS INT) AS i", "CAST(0 AS DOUBLE) AS e"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def named(text: str) -> dict[str, DataFrame]:
        return {t: fixture(spark, sf_dir, t) for t in ("emb", *PADDED, "embeddings", "lineitem", "events", "orders", "f9_nodes") if "{" + t + "}" in text}

    if name in PADDED:
        return filled(spark, sf_dir, int(name[3:]))
    text = _EMB_SPARK if name == "emb" else FIXTURES.get(name)
    if text is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(text, **named(text))


def ctes(*names: str, recursive: bool = False) -> str:
    """`WITH name AS (...), ...,` for the oracle; the caller's own tables or SELECT follow."""
    need: list[str] = []
    for name in names:
        text = FIXTURES[name]
        for t in PADDED:
            if "{" + t + "}" in text:
                text += PADDED[t]
        for t in ("emb", *PADDED, "f9_nodes"):
            if "{" + t + "}" in text and t not in need:
                need.append(t)
        if name not in need:
            need.append(name)
    plain = {t: t for t in ("emb", *PADDED, "embeddings", "lineitem", "events", "orders", "f9_nodes")}
    body = ",\n".join(f"{n} AS ({_EMB_ORACLE if n == 'emb' else (FIXTURES | PADDED)[n].format(**plain)})" for n in need)
    return ("WITH RECURSIVE " if recursive else "WITH ") + body
