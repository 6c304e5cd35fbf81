"""Pipeline documents: parsed into tables, checked, ordered, changed, and run as one plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """pipeline_id (the file's place), doc: one JSON document per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("pipeline_id"), F.col("value").alias("doc"))


def parse_nodes(docs: DataFrame) -> DataFrame:
    """pipeline_id, pos, node_id, node_tag, ver and settings (name to text) of docs(pipeline_id, doc)."""
    d = docs.select("pipeline_id", F.from_json("doc", "map<string,string>").alias("d"))
    n = d.select("pipeline_id", "d", F.posexplode(F.from_json(F.col("d")["node_list"], "array<string>")).alias("pos", "name"))
    body = F.from_json(F.expr("d[name]"), "struct<id:string,name:string,setting:map<string,string>>")
    n = n.select("pipeline_id", "pos", F.split("name", ":").alias("p"), body.alias("b"))
    return n.select("pipeline_id", "pos", F.col("p")[0].cast("int").alias("node_id"), F.col("p")[1].alias("node_tag"), F.col("b.setting")["ver"].alias("ver"), F.map_filter(F.col("b.setting"), lambda k, _: ~k.isin("ver", "pos")).alias("settings"))


def parse_links(docs: DataFrame) -> DataFrame:
    """pipeline_id, pos, and id, tag, type and port of both ends of each link."""
    d = docs.select("pipeline_id", F.from_json("doc", "map<string,string>")["link_list"].alias("l"))
    e = d.select("pipeline_id", F.posexplode(F.from_json("l", "array<array<string>>")).alias("pos", "l"))
    e = e.select("pipeline_id", "pos", F.split(F.col("l")[0], ":").alias("s"), F.split(F.col("l")[1], ":").alias("t"))
    ends = [(F.col(a)[i].cast("int") if i == 0 else F.col(a)[i]).alias(n) for a, p in (("s", "src"), ("t", "dst")) for i, n in enumerate((p, f"{p}_tag", f"{p}_type", f"{p}_port"))]
    return e.select("pipeline_id", "pos", *ends)


def validate_links(links: DataFrame, order: list[str], port: list[str] | None = None) -> DataFrame:
    """Links between equal types, the first one (by order) into each destination."""
    w = Window.partitionBy("pipeline_id", *(port or ["dst"])).orderBy(*order)
    return links.where(F.col("src_type") == F.col("dst_type")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pipeline_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """pipeline_id, node_id, level: 0 for producers, else one more than the highest input; null on or behind a cycle.

    A document is a handful of nodes: each is settled by itself, from its nodes and links as arrays. An input that is no
    node of the document counts as a producer.
    """
    n = nodes.select("pipeline_id", "node_id").distinct().groupBy("pipeline_id").agg(F.collect_list("node_id").alias("ns"))
    e = links.select("pipeline_id", "src", "dst").distinct().groupBy("pipeline_id").agg(F.collect_list(F.struct("src", "dst")).alias("es"))
    docs = n.join(e, "pipeline_id", "left").select("pipeline_id", "ns", *[F.coalesce(F.col("es").getField(c), F.array().cast(f"array<{links.schema[c].dataType.simpleString()}>")).alias(c) for c in ("src", "dst")])

    @F.pandas_udf(f"array<struct<node_id:{nodes.schema['node_id'].dataType.simpleString()},level:int>>")
    def settle(ns: pd.Series, srcs: pd.Series, dsts: pd.Series) -> pd.Series:
        return pd.Series([levels(*x) for x in zip(ns, srcs, dsts, strict=True)])

    return docs.select("pipeline_id", F.inline(settle("ns", "src", "dst")))


def levels(nodes, srcs, dsts) -> list[dict]:
    waits, leads = dict.fromkeys(nodes, 0), {}
    for a, b in zip(srcs, dsts, strict=True):
        if b in waits:
            waits[b] += 1
            leads.setdefault(a, []).append(b)
    level = {a: 0 for a in {*waits, *leads} if not waits.get(a)}
    ready = list(level)
    for a in ready:
        for b in leads.get(a, ()):
            waits[b] -= 1
            if not waits[b]:
                level[b] = level[a] + 1  # inputs come in order of level, so the last one is the highest
                ready.append(b)
    return [{"node_id": n, "level": level.get(n)} for n in nodes]


def version_check(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes whose saved ver differs from current(key, ver)'s: the join is on the columns both have but ver."""
    keys = [c for c in current.columns if c != "ver"]
    return nodes.join(current.withColumnRenamed("ver", "code_ver"), keys).where(~F.col("ver").eqNullSafe(F.col("code_ver")))


def delete_nodes(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of gone(pipeline_id, node_id), and without the links at them."""
    left = nodes.join(gone, ["pipeline_id", "node_id"], "left_anti")
    for end in ("src", "dst"):
        links = links.join(gone.select("pipeline_id", F.col("node_id").alias(end)), ["pipeline_id", end], "left_anti")
    return left, links


def run_pipeline(document: dict, sources: dict[str, DataFrame], operators: dict[str, Callable[..., DataFrame]]) -> dict[str, DataFrame]:
    """One document, as lazy DataFrames by node name. operators[tag](*inputs, **settings); sources by node name.

    A document is a handful of nodes, so it is ordered here; what the nodes do is one Spark plan.
    """
    into: dict[str, list[str]] = {n: [] for n in document["node_list"]}
    for src, dst in document["link_list"]:
        a, b = (":".join(x.split(":")[:2]) for x in (src, dst))
        if src.split(":")[2] == dst.split(":")[2]:
            into[b].append(a)
    out = dict(sources)
    todo = [n for n in document["node_list"] if n not in out]
    while todo:
        ready = [n for n in todo if all(a in out for a in into[n])]
        if not ready:
            raise ValueError(f"a cycle, or no source, at {', '.join(todo)}")
        for n in ready:
            settings = {k: v for k, v in document[n]["setting"].items() if k not in ("ver", "pos")}
            out[n] = operators[document[n]["name"]](*[out[a] for a in into[n]], **settings)
        todo = [n for n in todo if n not in ready]
    return out


def apply_user_code(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """fn on each frame (a one-row table with the columns of frames), as a function; where it fails, the frame and the error."""
    schema = T.StructType([*frames.schema.fields, T.StructField("error", T.StringType())])

    names = frames.columns

    def run(batches):
        for b in batches:
            own = list(zip(*(b[c].tolist() for c in names), strict=True))
            out, errors = [[] for _ in names], []
            for i in range(len(b)):
                try:
                    made = fn(b.iloc[i : i + 1].copy())
                    made = made if isinstance(made, pd.DataFrame) and set(names) <= set(made.columns) else made[names]
                    values, error = [made[c].tolist() for c in names], None
                except Exception as e:  # the user's own code: its error is data
                    values, error = [[v] for v in own[i]], f"{type(e).__name__}: {e}"
                for column, v in zip(out, values, strict=True):
                    column += v
                errors += [error] * len(values[0])
            if not errors:
                continue
            yield pd.DataFrame(dict(zip(names, out, strict=True)) | {"error": pd.Series(errors, dtype=object)}, columns=[*names, "error"])

    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by their bytes, rows would be put together in few
    return frames.repartition(tasks).mapInPandas(run, schema)
